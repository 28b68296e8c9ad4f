"""Features, gaps, ranks, medians and splits against plain computations."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from helpers import events, seconds
from pyspark.sql import functions as F

from siftwall.operators import features as A
from siftwall.operators import ranks as R
from siftwall.operators.gaps import interarrival_gaps


def test_single_row_and_nulls(spark):
    df = events(
        spark,
        [
            {"t": 1, "path": "/a", "agent": "x", "method": "POST"},
            {"t": 1, "ip": "2.2.2.2", "path": None, "status": None},
            {"t": 1, "ip": "2.2.2.2", "path": "/b", "status": 404},
            {"t": 1, "ip": None},
        ],
    )
    rows = {r["ip"]: r for r in A.behavior_features(df).collect()}
    assert set(rows) == {"1.1.1.1", "2.2.2.2"}
    one, two = rows["1.1.1.1"], rows["2.2.2.2"]
    assert (one["avg_interval"], one["post_fraction"]) == (0.0, 1.0)
    # all rows in one instant score lowest
    assert one["burstiness"] == pytest.approx(1 / (1 + 1e6))
    assert one["requests_per_minute"] == pytest.approx(1 / (1e-3 / 60))
    assert (two["unique_paths"], two["error_rate"], two["fraction_2xx"]) == (1, 0.5, 0.0)


def test_features_of_a_busy_ip(spark):
    rng = random.Random(2)
    rows = [
        {
            "t": i / 10,
            "ip": "hot" if i % 3 else str(i % 5),
            "path": f"/{rng.randrange(9)}",
            "agent": f"a{rng.randrange(4)}",
            "status": rng.choice([200, 301, 404, 500]),
            "bytes_sent": rng.randrange(100),
        }
        for i in range(600)
    ]
    p = pd.DataFrame(rows)
    found = A.ip_features(events(spark, rows)).toPandas().set_index("ip").sort_index()
    g = p.groupby("ip")
    assert (found.total_requests == g.size()).all()
    assert (found.unique_paths == g.path.nunique()).all()
    assert (found.unique_user_agents == g.agent.nunique()).all()
    assert (found.total_bytes == g.bytes_sent.sum()).all()
    assert np.allclose(found.avg_bytes, g.bytes_sent.mean())
    assert np.allclose(found.error_rate, g.status.apply(lambda s: (s >= 400).mean()))
    gaps = g.t.apply(lambda s: s.sort_values().diff().mean())
    assert np.allclose(found.avg_interval, gaps)


def test_modal_label_ties_and_fallback(spark):
    def rows(ip, *labels, status=200):
        return [{"t": 0, "ip": ip, "classification": c, "status": status} for c in labels]

    df = events(
        spark,
        rows("tie", "b_kind", "a_kind")
        + rows("normal", "normal", "normal", "x")
        + rows("errors", "normal", status=500)
        + rows("half", "normal", status=500)
        + rows("half", "normal"),
    )
    labels = {r["ip"]: r["label"] for r in A.modal_labels(df).collect()}
    assert labels == {
        "tie": "a_kind",
        "normal": "normal",
        "errors": "access_brute_force",
        "half": "normal",
    }


def test_align_fills_and_orders(spark):
    df = spark.createDataFrame([("a", 1, None)], "ip string, x bigint, y double")
    out = A.align_features(df, ["y", "z", "x"])
    assert out.columns == ["ip", "y", "z", "x"]
    assert out.first() == ("a", 0.0, 0.0, 1.0)


def test_gaps_over_part_borders(spark):
    rng = random.Random(4)
    rows = [{"t": rng.random() * 3000, "ip": rng.choice(["h", "h", "x"])} for _ in range(300)]
    rows += [{"t": 900000, "ip": "x"}, {"t": 900000, "ip": "x"}]
    out = interarrival_gaps(events(spark, rows), parts=12).collect()
    assert len(out) == len(rows)
    by_ip = {}
    for r in rows:
        by_ip.setdefault(r["ip"], []).append(round(r["t"] * 1e6))
    for ip, times in by_ip.items():
        times.sort()
        expected = sorted(b - a for a, b in zip(times, times[1:]))
        found = [r["gap_us"] for r in out if r["ip"] == ip]
        assert sorted(g for g in found if g is not None) == expected
        assert found.count(None) == 1
    assert seconds(out[0]["timestamp"]) >= 0


@pytest.mark.parametrize("rows", [1, 2, 7, 30_001])
def test_median_is_exact(spark, rows):
    df = spark.range(rows).select(((F.col("id") * 7919) % 10007 / 3).alias("v"))
    values = df.toPandas().v.to_numpy()
    assert R.median(df, "v").first()["median"] == np.median(values)


def test_median_with_a_value_on_most_rows(spark):
    df = spark.range(9999).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(5).alias("v"))
    assert R.median(df, "v").first()["median"] == np.median(df.toPandas().v)


def test_mad_fallbacks(spark):
    def cutoff(values):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        return R.mad_cutoff(df, "v", 2.0).first()["cutoff"]

    assert cutoff([3, 3, 3]) == 3.0
    # no deviation of the median row: the standard deviation stands in
    assert cutoff([1, 1, 1, 5]) == pytest.approx(1 - 2 * np.std([1, 1, 1, 5]))
    spread = [1, 2, 4, 8, 16]
    assert cutoff(spread) == pytest.approx(4 - 2 * 1.4826 * np.median(np.abs(np.array(spread) - 4)))


def test_ranks_with_heavy_ties(spark):
    """A third of all IPs share one value; ranks equal the usual average ranks."""
    df = spark.range(6000).select(
        F.col("id").cast("string").alias("ip"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") * 7919 % 997) / 7).alias("a"),
        (F.col("id") * 31 % 6007).cast("double").alias("b"),
        F.lit(1.0).alias("c"),
    )
    p = df.toPandas().set_index("ip")
    found = R.metric_ranks(df, ["a", "b", "c"]).toPandas()
    wide = found.pivot(index="ip", columns="metric", values="pct").loc[p.index]
    assert np.allclose(wide.a, p.a.rank(pct=True))
    assert np.allclose(wide.b, p.b.rank(pct=True))
    assert (wide.c == 0.5).all()


def test_split_is_stratified_and_repeatable(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("ip"),
        F.when(F.col("id") < 2, "two").when(F.col("id") < 100, "few").otherwise("many").alias("y"),
    )
    one = R.hash_split(df, "y", "ip", 0.7, 1)
    two = R.hash_split(df.repartition(13), "y", "ip", 0.7, 1)
    assert one.exceptAll(two).count() == 0
    train = one.where("is_train").groupBy("y").agg(F.count("*").alias("n"))
    sizes = {r["y"]: r["n"] for r in train.collect()}
    assert sizes == {"two": 1, "few": 69, "many": 630}
