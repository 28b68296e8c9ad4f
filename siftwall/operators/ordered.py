"""Rows in the order of keys, dealt so that no key has to fit into one task.

A window partitioned by a key puts all rows of a hot key into one task. Here rows are cut
into *parts*, ranges of the whole order that hold about equally many rows whatever the
keys are. Windows then run per (part, key), and what earlier parts of the same key
contribute is carried over by a table with one row per (part, key): as many rows as there
are keys, and one more for every part that a key reaches into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Ranges are cut for at least so many parts.
LEAST_PARTS = 8


def dealt_in_order(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with a column ``part`` that never falls in ascending ``order`` (null first).

    Ties beyond ``order`` are cut as well, so that rows which agree in all of it spread over
    parts. The rows are stored: bounds come from a sample, and every later reader has to
    see the same ones.
    """
    spark = rows.sparkSession
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = "__tie"
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(
        parts, *[F.asc_nulls_first(c) for c in order], F.asc(tie)
    )
    return stage(ranged.withColumn("part", F.spark_partition_id()).drop(tie), name)


def carried(dealt: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Aggregates of all earlier parts of a key: ``*keys, part`` and one column per total.

    A total's name tells how its values per part are combined: ``sum_x``, ``max_x``,
    ``min_x`` or ``xor_x``. Null in the first part of a key.
    """
    per_part = dealt.groupBy(*keys, "part").agg(*[c.alias(k) for k, c in totals.items()])
    # a hot key has at most one row per part here
    earlier = (
        Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    combine = {"sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor}
    return per_part.select(
        *keys, "part", *[combine[k.split("_")[0]](k).over(earlier).alias(k) for k in totals]
    )


#: Sampled rows per part; what reaches the driver is bounded by it.
SAMPLE_PER_PART = 100
#: Lanes for rows of one hot key that share one value.
LANES = 64


def spread_hot(
    rows: DataFrame, key: str, value: str, parts: int | None = None
) -> tuple[DataFrame, bool]:
    """``rows`` with a column ``part``, and whether any key was cut into several.

    Parts are ranges of the long ``value``. A key is cut if it holds more than half a part's share of a sample. Its parts never fall
    with ``value``; a single value with more than a part's share is dealt over lanes by the
    rows' content. All other keys have the one part -1. Bounds are literals of the plan, so the parts
    are the same whenever they are computed again; ``rows`` stay lazy. Null keys and
    values belong to part -1.
    """
    spark = rows.sparkSession
    parts = parts or max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = SAMPLE_PER_PART * parts
    sample: dict = {}
    narrow = rows.select(key, value).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    for k, v in narrow.orderBy(F.rand(17)).limit(size).collect():
        sample.setdefault(k, []).append(v)
    taken = sum(map(len, sample.values()))
    bounds, tied = {}, {}
    for k, values in sample.items():
        pieces = -(-2 * len(values) * parts // taken)
        if 2 * len(values) * parts <= taken or taken < parts:
            continue
        values.sort()
        marks = [values[len(values) * i // pieces] for i in range(1, pieces)]
        bounds[k] = sorted(set(marks))
        tied[k] = sorted({a for a, b in zip(marks, marks[1:]) if a == b})
    if not bounds:
        return rows.withColumn("part", F.lit(-1)), False

    def of_key(table: dict) -> Column:
        pairs = [F.struct(F.lit(k), F.array(*[F.lit(v).cast("long") for v in vs])) for k, vs in table.items()]
        return F.try_element_at(F.map_from_entries(F.array(*pairs)), F.col(key))

    # bounds in groups, so that a row is held against two roots of them rather than all
    step = max(2, round(max(map(len, bounds.values())) ** 0.5))
    coarse = of_key({k: b[step - 1 :: step] for k, b in bounds.items()})
    below = F.size(F.filter(coarse, lambda b: b <= F.col(value))) * step
    fine = F.slice(of_key(bounds), below + 1, F.lit(step))
    place = below + F.size(F.filter(fine, lambda b: b <= F.col(value)))
    lane = F.when(
        F.array_contains(of_key(tied), F.col(value)), F.pmod(F.xxhash64(*rows.columns), F.lit(LANES))
    ).otherwise(F.lit(LANES))
    hot = coarse.isNotNull() & F.col(value).isNotNull()
    part = F.when(hot, place.cast("long") * (LANES + 1) + lane).otherwise(F.lit(-1))
    return rows.withColumn("part", part.cast("int")), True
