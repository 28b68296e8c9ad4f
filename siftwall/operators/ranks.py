"""Exact ranks, medians and cuts without a window over all rows.

A rank over the whole table needs all its values in order. Instead of sorting them in
one task, equal values are folded and dealt in order into as many parts as the session
has shuffle partitions; each part is ordered on its own, and totals of earlier parts
shift the ranks within a part to ranks in the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carried, dealt_in_order

# Values held by at least one row in this many count as heavy, so that at most this
# many values per metric are heavy.
HEAVY_SHARE = 1000
# Bits that one pass of the radix selection looks at, and the most rows it fetches.
DIGIT_BITS = 16
MOST_ROWS = 1 << DIGIT_BITS


def cumulative(folded: DataFrame, group: str) -> DataFrame:
    """Add ``before``, rows of the group with a smaller value, and the group's totals.

    ``folded`` has the group column, ``value`` (distinct in a group) and its rows ``n``.
    Totals are ``rows`` and ``different``, the number of values. ``folded`` is stored in
    order; parts follow the session and the table, whatever the values are.
    """
    dealt = dealt_in_order(folded.select(group, "value", "n"), [group, "value"], "in-order")
    shifts = carried(dealt, [group], sum_n=F.sum("n"))
    totals = dealt.groupBy(group).agg(F.sum("n").alias("rows"), F.count("*").alias("different"))
    # one row per part, and one per group: a part reaches into the next group at most once
    edges = shifts.join(totals, group)
    own = Window.partitionBy("part", group).orderBy("value")
    return (
        dealt.withColumn("upto", F.sum("n").over(_running(own)))
        .join(edges, ["part", group])
        .select(
            group,
            "value",
            "n",
            (F.coalesce("sum_n", F.lit(0)) + F.col("upto") - F.col("n")).alias("before"),
            "rows",
            "different",
        )
    )


def _running(ordered):
    return ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def metric_ranks(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Average-rank percentiles: ``ip, metric, value, pct``.

    ``pct`` is the mean rank of equal values over the number of rows. ``rows`` is read
    several times; hand in a stored table.
    """
    long = rows.unpivot("ip", list(metrics), "metric", "value").where(
        F.col("value").isNotNull()
    )
    folded = long.groupBy("metric", "value").agg(F.count("*").alias("n"))
    table = cumulative(folded, "metric").select(
        "metric",
        "value",
        "n",
        "rows",
        F.when(F.col("different") <= 1, F.lit(0.5))
        .otherwise((F.col("before") + (F.col("n") + 1) / 2) / F.col("rows"))
        .alias("pct"),
    )
    return _attach(long, table)


def _attach(long: DataFrame, table: DataFrame) -> DataFrame:
    """Bring each value's percentile to its rows.

    Values shared by very many rows would pile up in one join task. They are few by
    definition, at most ``HEAVY_SHARE`` per metric, so these are broadcast, and their
    rows are spread evenly in the join that serves all other values.
    """
    is_heavy = F.col("n") * HEAVY_SHARE >= F.col("rows")
    heavy = table.where(is_heavy).select("metric", "value", F.col("pct").alias("heavy_pct"))
    light = table.where(~is_heavy).select(
        "metric", "value", F.col("pct").alias("light_pct"), F.lit(0).cast("bigint").alias("lane")
    )
    lane = F.when(F.col("heavy_pct").isNotNull(), F.pmod(F.xxhash64("ip"), F.lit(1_000_000)) + 1)
    return (
        long.join(F.broadcast(heavy), ["metric", "value"], "left")
        .withColumn("lane", F.coalesce(lane, F.lit(0)))
        .join(light, ["metric", "value", "lane"], "left")
        .select("ip", "metric", "value", F.coalesce("heavy_pct", "light_pct").alias("pct"))
    )


def sortable(value: Column) -> Column:
    """A double as a long in the same order; both zeros are one value, NaN is the largest."""
    # + 0.0 turns the negative zero; the method is a plain one of the JVM's own library
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def middle_values(values: DataFrame) -> tuple[float, float] | None:
    """The two middle values of the double column ``value``, null rows apart; None without rows.

    Radix selection: the leading 16 bits of all values are counted, and only values in the
    buckets of the two middle ranks are looked at further, by their next 16 bits. At most
    four passes, of which each brings at most 2 x 65,536 counts to the driver; as soon as
    the buckets hold no more rows than that, their values are fetched. Exact for any values.
    """
    keyed = values.where(F.col("value").isNotNull()).select("value", sortable(F.col("value")).alias("key"))
    buckets: list[int] | None = None
    ranks, before = [0, 0], [0, 0]
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        near = keyed if buckets is None else keyed.where(F.shiftright("key", shift + DIGIT_BITS).isin(buckets))
        counts = near.groupBy(F.shiftright("key", shift).alias("bucket")).agg(F.count("*").alias("n")).collect()
        in_order = sorted((r["bucket"], r["n"]) for r in counts)
        if buckets is None:
            rows = sum(n for _, n in in_order)
            if not rows:
                return None
            ranks = [(rows - 1) // 2, rows // 2]
        found, sizes = [], {}
        for k, rank in enumerate(ranks):
            # the middle ranks follow one another: rows of both buckets lie side by side
            at = before[0]
            for bucket, n in in_order:
                if rank < at + n:
                    found.append((bucket, at))
                    sizes[bucket] = n
                    break
                at += n
        before = [found[0][1], found[0][1]]
        buckets = [b for b, _ in found]
        if sum(sizes.values()) <= MOST_ROWS or shift == 0:
            break
    chosen = keyed.where(F.shiftright("key", shift).isin(buckets))
    folded = chosen.groupBy("key").agg(F.count("*").alias("n"), F.max("value").alias("value")).collect()
    out, at = [], before[0]
    for _, n, value in sorted((r["key"], r["n"], r["value"]) for r in folded):
        out += [value for rank in ranks if at <= rank < at + n]
        at += n
    return out[0], out[1]


def median(rows: DataFrame, column: str) -> DataFrame:
    """One row ``median``: the exact median of a double column, null without rows.

    ``rows`` is read a few times; hand in a stored table.
    """
    found = middle_values(rows.select(F.col(column).cast("double").alias("value")))
    middle = None if found is None else (found[0] + found[1]) / 2
    return rows.sparkSession.range(1).select(F.lit(middle).cast("double").alias("median"))


def mad_cutoff(rows: DataFrame, column: str, multiplier: float) -> DataFrame:
    """One row ``median, mad, sigma, cutoff``: robust left-tail cut-off.

    Both medians are found by radix selection when this is called.
    """
    middle = median(rows, column).first()["median"]
    apart = rows.select(F.abs(F.col(column).cast("double") - F.lit(middle)).alias("apart"))
    mad = None if middle is None else median(apart, "apart").first()["median"]
    if mad is not None and mad > 1e-12:
        spread = rows.sparkSession.range(1).select(F.lit(1.4826 * mad).alias("sigma"))
    else:
        spread = rows.agg(F.stddev_pop(column).alias("sigma"))
    middle, mad = F.lit(middle).cast("double"), F.lit(mad).cast("double")
    return spread.select(
        middle.alias("median"),
        mad.alias("mad"),
        "sigma",
        F.when(F.col("sigma") < 1e-12, middle)
        .otherwise(middle - F.lit(multiplier) * F.col("sigma"))
        .alias("cutoff"),
    )


def hash_split(rows: DataFrame, label: str, key: str, fraction: float, seed: int) -> DataFrame:
    """Add ``is_train``: a stratified split, repeatable under any partitioning.

    In each class the rows with the smallest hashes of ``key`` go to training: the
    given fraction, rounded, with at least one row left on either side.
    """
    hashed = rows.withColumn("value", F.xxhash64(F.lit(seed), F.col(key)))
    folded = hashed.groupBy(label, "value").agg(F.count("*").alias("n"))
    table = cumulative(folded, label)
    wanted = F.greatest(
        F.lit(1), F.least(F.col("rows") - 1, F.round(F.col("rows") * fraction).cast("bigint"))
    )
    last = (
        table.where(F.col("before") < wanted)
        .groupBy(label)
        .agg(F.max("value").alias("last_hash"))
    )
    return hashed.join(last, label, "left").withColumn(
        "is_train", F.coalesce(F.col("value") <= F.col("last_hash"), F.lit(False))
    ).drop("value", "last_hash")


def class_sample(rows: DataFrame, label: str, key: str, most: int, seed: int) -> DataFrame:
    """At most about ``most`` rows, with ``weight``: as many of each class as fit in equal shares.

    Classes with no more rows than ``most`` / classes stay whole; of a larger one those with the
    smallest hashes of ``key`` stay. ``weight`` makes classes count alike and keeps the
    number of rows: rows / (classes x rows of the class that stay). Classes must be few:
    one count each reaches the driver. Rows above about twice a class's share never leave
    their task.
    """
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return rows.withColumn("weight", F.lit(1.0))
    share = max(1, most // len(sizes))
    total = sum(sizes.values())
    table = [(k, n, min(n, share), total / (len(sizes) * min(n, share))) for k, n in sizes.items()]
    kind = rows.schema[label].dataType.simpleString()
    classes = F.broadcast(
        rows.sparkSession.createDataFrame(table, f"{label} {kind}, __n long, __most long, weight double")
    )
    # of hashes uniform over the signed 64-bit range, twice the share and a reserve
    drawn = rows.join(classes, label).withColumn("__hash", F.xxhash64(F.lit(seed), F.col(key)))
    fraction = F.least(F.lit(1.0), (F.col("__most") * 2.0 + 100.0) / F.col("__n"))
    few = drawn.where(F.col("__hash").cast("double") <= (fraction * 2.0 - 1.0) * F.lit(2.0**63))
    place = F.row_number().over(Window.partitionBy(label).orderBy("__hash", key))
    return (
        few.withColumn("__place", place)
        .where(F.col("__place") <= F.col("__most"))
        .drop("__n", "__most", "__hash", "__place")
    )
