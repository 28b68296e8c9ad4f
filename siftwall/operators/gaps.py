"""Time since the previous row of the same IP."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import spread_hot


def interarrival_gaps(events: DataFrame, parts: int | None = None) -> DataFrame:
    """Add ``gap_us``: microseconds since the IP's previous row, null for its first.

    Rows are ordered per (ip, part): an IP that holds many rows is cut into time ranges by
    ``spread_hot``, all others are one part. Where there are such IPs, the first rows of
    their parts, one per part, are put in order among themselves and take the last instant of
    the part before. Rows without an IP or a time are left out.
    """
    usable = events.where(F.col("ip").isNotNull() & F.col("timestamp").isNotNull())
    rows, cut = spread_hot(usable.withColumn("_ts", F.unix_micros("timestamp")), "ip", "_ts", parts)
    part = Window.partitionBy("ip", "part")
    inside = F.lag("_ts").over(part.orderBy("_ts"))
    found = rows.withColumn("_before", inside)
    if cut:
        found = found.withColumn("_last", F.max("_ts").over(part)).withColumn(
            "_edge", F.when(F.col("_before").isNull(), -2).otherwise(F.col("part"))
        )
        edges = Window.partitionBy("ip", "_edge").orderBy("part")
        earlier = F.when(F.col("_edge") == -2, F.lag("_last").over(edges))
        found = found.withColumn("_before", F.coalesce("_before", earlier))
    return found.withColumn("gap_us", F.col("_ts") - F.col("_before")).select(*events.columns, "gap_us")

