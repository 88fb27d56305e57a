"""Ranks and quantiles by ordered cells, against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import forecast, ordered, stats


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(11)
    groups = {
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(400)],
        "close": [1e9 + rnd.random() * 1e-4 for _ in range(900)],
        "ties": [float(rnd.randrange(3)) for _ in range(500)] + [0.0, -0.0],
        "one": [7.5],
        "two": [1.0, 2.0],
        "tiny": [rnd.random() * 1e-9 for _ in range(700)],
        "ends": [float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308],
        None: [rnd.gauss(0, 1) for _ in range(300)],
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("wide", None), ("void", None)]
    rnd.shuffle(rows)
    return groups, spark.createDataFrame(rows, "g string, x double").repartition(5).cache()


def test_quantiles(mixed):
    groups, df = mixed
    probs = {"a": 0.0, "b": 0.005, "c": 0.5, "d": 0.77, "e": 1.0}
    got = {r.g: r for r in ordered.quantiles(df, ["g"], "x", probs).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        xs = sorted(xs)
        for c, p in probs.items():
            at = p * (len(xs) - 1)
            lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
            want = lo if lo == hi else lo * (math.ceil(at) - at) + hi * (at - math.floor(at))
            assert got[g][c] == pytest.approx(want, rel=1e-12, abs=1e-300) or math.isnan(got[g][c]) and math.isnan(want), (g, c)


def test_cells_grow_with_values(spark):
    rnd = random.Random(2)
    xs = sorted({rnd.choice([-1, 1]) * 10 ** rnd.uniform(-320, 308) for _ in range(3000)} | {0.0, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 5e-324})
    cells = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", ordered.fine_cell(F.col("x")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells)
    ps = sorted({rnd.random() for _ in range(2000)} | {10 ** rnd.uniform(-40, 0) for _ in range(2000)} | {1 - 10 ** rnd.uniform(-16, 0) for _ in range(2000)} | {0.0, 0.5, 1.0})
    cells = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(ps)], "i int, x double").select("i", ordered.share_cell(F.col("x")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells) and len(set(cells)) > 0.95 * len(ps)


def test_rank_counts(mixed):
    groups, df = mixed
    got = {(r.g, r.x): (r._c, r._k, r._m) for r in ordered.rank_counts(ordered.cells(df, ["g"], "x"), ["g"], "x").collect()}
    want = {(g, x + 0.0): (sum(y == x for y in xs), sum(y <= x for y in xs), len(xs)) for g, xs in groups.items() for x in xs}
    assert got == want


def test_crowded_p_values_are_spread(spark):
    """All p-values lie below 1e-9 or next to 1: no cell, so no task, sees more than a small share."""
    n = 40_000
    p = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, (F.rand(7) + 1e-6) * 1e-9).otherwise(1 - F.rand(7) * 1e-9).alias("p_value")).cache()
    cells = ordered.cells(p, [], "p_value", shares=True)
    rows = cells.count()
    assert rows > 0.9 * n
    assert cells.groupBy("_g", "_f").count().agg(F.max("count")).first()[0] < rows / 200
    assert cells.groupBy("_g").agg(F.count_distinct("_f").alias("n")).agg(F.max("n")).first()[0] < rows / 20
    got = {r.id: (r.p_value, r.bh_reject) for r in stats.benjamini_hochberg(p).collect()}
    order = sorted(x for x, _ in got.values())
    cut = max((x for k, x in enumerate(order, 1) if x <= 0.05 * k / n), default=-1)
    assert all(hit == (x <= cut) for x, hit in got.values()) and any(hit for _, hit in got.values())


def test_no_buffer_of_a_groups_values(spark):
    """The plan has no percentile and no window over a whole group's rows."""
    df = spark.range(100).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("x"))
    plan = ordered.quantiles(df, ["g"], "x", {"m": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan
    assert np.isclose(ordered.quantiles(df, ["g"], "x", {"m": 0.5}).first().m, 49.5)


def test_quantiles_of_many_paths(spark):
    params = spark.createDataFrame([("a", 1, 0.1, 5.0, 1.0, 0.5), ("b", 2, -0.2, -4.0, 2.0, 0.1)], "indicator string, no long, drift double, last double, sd_state double, sd_obs double")
    sim = forecast.paths(params, 400, 3, rate=0.2).withColumn("threshold", F.lit(0.0)).cache()
    for f in (forecast.path_quantiles, forecast.event_rates):
        one, two = ({(r[0], r[1]): tuple(r)[2:] for r in f(sim, many=m).collect()} for m in (False, True))
        assert one.keys() == two.keys() and len(one) == 6
        assert all(one[k] == pytest.approx(two[k], rel=1e-12) for k in one)
