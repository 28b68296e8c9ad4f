"""One key with most of the rows: nothing a task holds grows with it, results stay exact."""

from __future__ import annotations

import math
import random
import struct

import pytest
from helpers import events
from pyspark.sql import functions as F

from siftwall.operators import burst, chain, ordered
from siftwall.operators import ranks as R
from siftwall.operators.gaps import interarrival_gaps


def test_account_with_nearly_all_rows(spark):
    rng = random.Random(3)
    rows, logins, failures = [], [], []
    for _ in range(6000):
        t, user = rng.randrange(0, 4000) + rng.choice([0, 0, 0.5]), "hot" if rng.random() < 0.99 else "cold"
        if rng.random() < 0.02:
            logins.append((t, user))
            rows.append({"t": t, "path": "ssh/accepted", "method": "SSH", "auth_user": user, "ip": "9"})
        else:
            failures.append((t, user))
            rows.append({"t": t, "path": "sudo/auth_failure", "method": "SUDO", "auth_user": user, "ip": "1"})
    expected = []
    for t, user in logins:
        near = [f for f, u in failures if u == user and t <= f <= t + 600]
        if len(near) >= 5 and min(near) <= t + 240:
            expected.append((len(near), round(max(near) * 1e6)))
    found = chain.privilege_escalation(events(spark, rows), mode="heuristic")
    got = [(r["count"], r["us"] % 10**10) for r in found.withColumn("us", F.unix_micros("timestamp")).collect()]
    base = events(spark, [{"t": 0}]).select(F.unix_micros("timestamp")).first()[0]
    assert sorted(got) == sorted((n, (base + us) % 10**10) for n, us in expected)


def test_rows_of_one_cell_are_all_that_a_chain_window_holds(spark):
    df = events(spark, [{"t": 0}])
    plan = chain.privilege_escalation(df, mode="heuristic")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("slot" in line for line in windows)
    assert any("cell" in line for line in windows)


def floats(seed: int) -> list[float]:
    """Doubles of all sizes, by their bits."""
    rng = random.Random(seed)
    made = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    return [x for x in made if not math.isnan(x)]


@pytest.mark.parametrize(
    "values",
    [
        floats(1),
        floats(2) + [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324],
        [0.0, -0.0],
        [-1.0, 1.0],
        [1.0, math.nextafter(1.0, 2)] * 50_000,
        [3.0] * 70_000 + [2.0] * 70_000,
        [1e300, -1e300, 1e-300],
        [7.0],
    ],
)
def test_median_by_radix_selection(spark, monkeypatch, values):
    monkeypatch.setattr(R, "MOST_ROWS", 100)  # several passes
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ordered_values = sorted(values)
    n = len(values)
    low, high = ordered_values[(n - 1) // 2], ordered_values[n // 2]
    assert R.middle_values(df.select(F.col("v").alias("value"))) == (low, high)
    assert R.median(df, "v").first()["median"] == (low + high) / 2


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert R.median(df, "v").first()["median"] is None
    assert tuple(R.mad_cutoff(df, "v", 2.0).first()) == (None, None, None, None)


def test_medians_have_no_window(spark):
    df = spark.range(1000).select((F.col("id") / 7).alias("v"))
    assert "Window" not in R.mad_cutoff(df, "v", 2.0)._jdf.queryExecution().toString()


@pytest.mark.parametrize("instants", [1, 7, 5000])
def test_gaps_of_one_ip_with_all_rows(spark, instants):
    rng = random.Random(instants)
    times = [rng.randrange(instants) / 4 for _ in range(4000)]
    df = events(spark, [{"t": t, "ip": "hot", "path": str(k)} for k, t in enumerate(times)] + [{"t": 1, "ip": "x"}])
    got = [r["gap_us"] for r in interarrival_gaps(df, parts=16).where("ip = 'hot'").collect()]
    times.sort()
    assert sorted(g for g in got if g is not None) == sorted(
        round((b - a) * 1e6) for a, b in zip(times, times[1:])
    )
    assert got.count(None) == 1
    rows, cut = ordered.spread_hot(df.withColumn("_ts", F.unix_micros("timestamp")), "ip", "_ts", 16)
    sizes = [r["count"] for r in rows.where("ip = 'hot'").groupBy("part").count().collect()]
    assert cut and max(sizes) < 4000 / 8


def test_parts_do_not_fall_and_cold_keys_stay_whole(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        ((F.col("id") * 7919) % 1000).alias("v"),
    )
    rows, cut = ordered.spread_hot(df, "k", "v", 8)
    table = rows.toPandas()
    hot = table[table.k == "hot"].sort_values(["part", "v"])
    assert cut and hot.v.is_monotonic_increasing and hot.part.nunique() > 4
    assert set(table[table.k != "hot"].part) == {-1}


def test_dealt_parts_carry_totals(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), F.lit(4).alias("v")
    )
    dealt = ordered.dealt_in_order(df, ["k", "v"], "test-dealt")
    before = {(r["k"], r["part"]): r["sum_n"] or 0 for r in ordered.carried(dealt, ["k"], sum_n=F.count("*")).collect()}
    rows = dealt.toPandas()
    assert rows.groupby("part").size().max() < 1500  # a third of the rows is one value
    for (k, part), n in before.items():
        assert n == ((rows.k == k) & (rows.part < part)).sum()


@pytest.mark.parametrize("cells", [1, 2, 5])
@pytest.mark.parametrize("measure, column", [("rows", None), ("sum", "bytes_sent"), ("distinct", "path")])
def test_sessions_over_chunk_borders(spark, monkeypatch, cells, measure, column):
    monkeypatch.setattr(burst, "CHUNK_CELLS", cells)
    rng = random.Random(cells)
    rows, t = [], {"a": 0.0, "b": 0.0}
    for k in range(900):
        ip = rng.choice("aab")
        t[ip] += rng.choice([0, 1, 2.5, 3, 3, 3.000001, 9, 40])
        rows.append({"t": t[ip], "ip": ip, "path": f"/{k % 7}", "bytes_sent": k % 5})
    rule = burst.BurstRule("k", "true", 1, 3, 0.5, measure, column)
    found = burst.burst_sessions(events(spark, rows), [rule])
    got = sorted((r["ip"], r["end_us"] - r["start_us"], r["amount"]) for r in found.collect())
    expected = []
    for ip in "ab":
        session: list = []
        for r in [*sorted((r for r in rows if r["ip"] == ip), key=lambda r: r["t"]), None]:
            if session and (r is None or round(r["t"] * 1e6) - round(session[-1]["t"] * 1e6) > 3_000_000):
                amount = {"rows": len(session), "sum": sum(s["bytes_sent"] for s in session)}.get(
                    measure, len({s["path"] for s in session})
                )
                expected.append((ip, round(session[-1]["t"] * 1e6) - round(session[0]["t"] * 1e6), amount))
                session = []
            if r is not None:
                session.append(r)
    assert got == sorted(expected)


def test_ranks_of_a_table_with_few_different_values(spark):
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("ip"), F.when(F.col("id") < 2999, 1.5).otherwise(-2.0).alias("a")
    )
    found = {r["pct"] for r in R.metric_ranks(df, ["a"]).collect()}
    assert found == {1 / 3000, 1501 / 3000}
