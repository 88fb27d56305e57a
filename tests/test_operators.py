"""Operators on small hand-made frames, and properties that must hold whatever the data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidecast.functions import boolean_text, crps_sql, horizon_key, phi_sql
from tidecast.operators import calibrate, combine, forecast, govern, score, series, stats
from tidecast.operators import survey as sv

OBS = "indicator string, t long, value double"
FC = "indicator string, horizon long, q05 double, q50 double, q95 double"


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS)


@pytest.fixture(scope="module")
def walk(spark):
    rnd = random.Random(1)
    rows = []
    for name, drift in (("a", 0.5), ("b", -0.2)):
        y = 10.0
        for t in range(40):
            y += drift + rnd.gauss(0, 1)
            rows.append((name, t, y))
    return obs(spark, rows).cache()


def test_phi_and_crps(spark):
    z = [x / 10 for x in range(-69, 70)]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", F.expr(phi_sql("z")).alias("p")).collect()
    assert max(abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) for r in got) < 1e-14
    (row,) = spark.sql(f"SELECT {crps_sql('1.5e0', '0e0', '2e0')} AS c").collect()
    u = 0.75
    want = 2 * (u * (2 * 0.5 * math.erfc(-u / math.sqrt(2)) - 1) + 2 * math.exp(-u * u / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))
    assert abs(row.c - want) < 1e-12


def test_published_example_of_the_score(spark):
    # fixed value: a published toy row (y, mu, sigma) and its score
    (row,) = spark.sql(f"SELECT {crps_sql('-0.6428e0', '-0.5124e0', '0.2310e0')} AS c").collect()
    assert abs(row.c - 0.08257) < 2e-3


def test_text_helpers(spark):
    rows = spark.createDataFrame([("5",), ("h7",), ("H12",), ("x",), (None,)], "s string").select(horizon_key(F.col("s")).alias("h")).collect()
    assert [r.h for r in rows] == [5, 7, 12, None, None]
    rows = spark.createDataFrame([(x,) for x in ("True", "y", "0", "2.5", "no", None)], "s string").select(boolean_text(F.col("s")).alias("b")).collect()
    assert [r.b for r in rows] == [1, 1, 0, 1, 0, 0]
    texts = ["1999-12-31", "1984", "12/31/2001", "wave 1976b", "abc", "99999", "", None]
    got = [r.y for r in spark.createDataFrame([(x,) for x in texts], "s string").select(series.year_from_text(F.col("s")).alias("y")).collect()]
    assert got == [1999, 1984, 2001, 1976, None, None, None, None]


def test_breaks_are_dated_by_the_later_step(spark):
    rows = [("a", t, float(t)) for t in range(8)] + [("a", 9, 60.0), ("a", 10, 61.0), ("b", 1, 1.0), ("b", 2, 9.0)]
    assert [(r.indicator, r.t) for r in series.break_flags(obs(spark, rows)).where("is_break").collect()] == [("a", 9)]


def test_densify_and_nulls(spark):
    got = series.densify(obs(spark, [("a", 1, 1.0), ("a", 4, 2.0)])).orderBy("t").collect()
    assert [(r.t, r.value) for r in got] == [(1, 1.0), (2, None), (3, None), (4, 2.0)]
    df = spark.createDataFrame([("a", 1, float("nan")), (None, 1, 2.0), ("a", 1, 4.0)], OBS)
    (r,) = series.observe(df, F.col("indicator"), F.col("t"), F.col("value")).collect()
    assert r.value == 4.0


@pytest.mark.parametrize("make", [forecast.persistence, forecast.linear_trend, forecast.walk_drift, forecast.smoothing, forecast.drift_forecast, forecast.local_level, forecast.shock_moments])
def test_no_leakage(walk, make):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(make(walk, 25, 5)) == key(make(walk.where("t <= 25"), 25, 5))


def test_quantiles_are_ordered(walk):
    for make in (forecast.drift_forecast, forecast.local_level, forecast.shock_moments):
        assert make(walk, 30, 8).where("not (q05 <= q50 and q50 <= q95)").isEmpty()


def test_local_level_is_flat_and_counts_noise_once(walk):
    one = forecast.local_level(walk, 30, 5)
    assert one.groupBy("indicator").agg(F.count_distinct("q50").alias("n")).where("n > 1").isEmpty()
    two = {(r.indicator, r.horizon): r.q95 for r in forecast.local_level(walk, 30, 5, noise=2).collect()}
    assert all(two[r.indicator, r.horizon] > r.q95 for r in one.collect())


def test_local_level_against_plain_filter(spark):
    y = [3.0, 4.0, 3.5, 5.0, 6.5, 6.0, 7.5, 7.0]
    best = None
    grid = [10 ** (-6 + 12 * k / 60) for k in range(61)]
    for stage in range(2):
        for q in grid:
            a, p, s, lg = y[0], 1 + q, 0.0, 0.0
            for v in y[1:]:
                f = p + 1
                s, lg = s + (v - a) ** 2 / f, lg + math.log(f)
                a, p = a + p / f * (v - a), p * (1 - p / f) + q
            fit = (len(y) - 1) * math.log(s / (len(y) - 1)) + lg
            if best is None or stage and fit < best[0] or not stage and fit < best[0]:
                best = (fit, q, a, s / (len(y) - 1), p)
        grid = [10 ** (math.log10(best[1]) - 0.2 + 0.4 * k / 60) for k in range(61)]
    _, q, a, s2, p = best
    got = forecast.local_level(obs(spark, [("a", t, v) for t, v in enumerate(y)]), 7, 2).orderBy("horizon").collect()
    assert got[1].q50 == pytest.approx(a) and got[1].q95 == pytest.approx(a + forecast.Z95 * math.sqrt(s2 * (p + q + 1)))


def test_paths_follow_their_moments(spark, walk):
    params = forecast.moments(walk).withColumn("no", F.when(F.col("indicator") == "a", 1).otherwise(2).cast("long"))
    sim = forecast.paths(params, 4000, 6, rate=0.0).cache()
    again = forecast.paths(params.repartition(3), 4000, 6, rate=0.0)
    assert sim.exceptAll(again).isEmpty()
    want = {r.indicator: r for r in params.collect()}
    for r in sim.where("horizon = 6").groupBy("indicator").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s")).collect():
        w = want[r.indicator]
        sd = math.sqrt(6 * w.sd_state**2 + w.sd_obs**2)
        assert abs(r.m - (w["last"] + 6 * w.drift)) < 4 * sd / math.sqrt(4000) and abs(r.s / sd - 1) < 0.06
    longer = forecast.paths(params, 4000, 9, rate=0.0).where("horizon <= 6")
    assert longer.join(sim.withColumnRenamed("y", "z"), ["indicator", "path", "horizon"]).where("abs(y - z) > 1e-9").isEmpty()


def test_reordering_keeps_marginals(spark):
    sim = spark.createDataFrame([("a", p, 1, float((p * 7) % 11)) for p in range(11)], "indicator string, path long, horizon long, y double")
    template = spark.createDataFrame([("a", p, 1, float(-p)) for p in range(11)], "indicator string, path long, horizon long, x double")
    got = [r.y for r in forecast.ecc_reorder(sim, template).orderBy("path").collect()]
    assert got == [float(10 - p) for p in range(11)]


def points(spark, rows):
    return spark.createDataFrame(rows, "indicator string, t long, horizon long, q05 double, q50 double, q95 double, y double")


def test_coverage_is_inclusive_and_monotone(spark):
    p = points(spark, [("a", k, k, -1.0, 0.0, 1.0, k / 5) for k in range(-10, 11)])
    got = {r.level: r for r in score.coverage_summary(score.coverage_points(p)).collect()}
    assert got[0.9].covered == 11 and got[0.9].total == 21 and got[0.5].covered <= got[0.9].covered
    for alpha in (0.5, 1.0, 2.0):
        bands = calibrate.rescale_bands(p.select("indicator", "horizon", "q05", "q50", "q95"), alpha).first()
        assert bands.hi_90 == pytest.approx(alpha)


def test_spread_search_by_hand(spark):
    p = points(spark, [("a", k, k, -1.0, 0.0, 1.0, k / 5) for k in range(1, 16)] + [("b", k, k, -1.0, 0.0, 1.0, 0.5 if k < 10 else 5.0) for k in range(1, 11)])
    got = {r.indicator: r for r in calibrate.spread_search(p).collect()}
    assert got["b"].alpha == 1.0 and got["b"].coverage_before == 0.9
    lo, hi, best, err = 0.25, 8.0, 1.0, abs(5 / 15 - 0.9)
    for _ in range(30):
        mid = (lo + hi) / 2
        cov = sum(k / 5 <= mid for k in range(1, 16)) / 15
        if abs(cov - 0.9) < err:
            best, err = mid, abs(cov - 0.9)
        lo, hi = (lo, mid) if cov >= 0.9 else (mid, hi)
    assert got["a"].alpha == best and got["a"].coverage_after == pytest.approx(sum(k / 5 <= best for k in range(1, 16)) / 15)


def test_least_alpha_mean_and_bias(spark):
    p = points(spark, [("a", 1, 1, -1.0, 0.0, 1.0, 3.0), ("a", 2, 2, -1.0, 1.0, 2.0, 0.0), ("b", 1, 1, -1.0, 0.0, 1.0, 0.0)])
    got = {r.indicator: r for r in calibrate.least_alpha(p).collect()}
    assert got["a"].misses == 1 and got["a"].alpha == pytest.approx(3.03) and got["b"].alpha == 1.0
    fits = {r.indicator: (r.a, r.b) for r in calibrate.mean_fit(p).collect()}
    assert fits == {"a": (0.0, 1.0), "b": (0.0, 1.0)}
    assert {r.indicator: r.delta for r in calibrate.bias(p).collect()} == {"a": 1.0, "b": 0.0}


def test_truth_is_deduplicated_and_null_truth_dropped(spark):
    f = spark.createDataFrame([("a", h, 0.0, 1.0, 2.0) for h in (1, 2, 3)], FC)
    truth = obs(spark, [("a", 11, 5.0), ("a", 11, 4.0), ("a", 12, None), ("a", 99, 1.0)])
    assert [(r.t, r.y) for r in calibrate.join_truth(f, truth, 10).collect()] == [(11, 4.0)]


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([(0, 0.001), (1, 0.02), (2, 0.02), (3, 0.04), (4, None)], "i int, p_value double")
    hits = lambda a: {r.i for r in stats.benjamini_hochberg(p, a).where("bh_reject").collect()}
    assert hits(0.05) == {0, 1, 2, 3} and hits(0.03) == {0, 1, 2} and hits(0.0001) == set()
    assert hits(0.0001) <= hits(0.03) <= hits(0.05)


def test_published_significance(spark):
    # fixed values: 12 of 15 at level 0.5 and 14 of 15 at level 0.9
    s = spark.createDataFrame([("ba", 0.5, 12, 15), ("ba", 0.9, 14, 15)], "indicator string, level double, x long, n long")
    got = {r.level: r for r in stats.significance(s).collect()}
    assert got[0.5].p_value == pytest.approx(0.02014, abs=1e-5) and got[0.9].p_value == pytest.approx(0.66695, abs=1e-4)
    assert got[0.5].wilson_low == pytest.approx(0.5481, abs=1e-4) and got[0.5].wilson_high == pytest.approx(0.9295, abs=1e-4)


def test_ensemble_of_equal_models_is_the_model(spark):
    f = spark.createDataFrame([("a", 1, 0.0, 1.0, 2.0), ("b", 1, 3.0, 4.0, None)], FC)
    got = combine.ensemble_equal({"x": f, "y": f}).select(*f.columns)
    assert got.exceptAll(f).isEmpty() and f.exceptAll(got).isEmpty()


def test_overlap_of_null_bands_is_null(spark):
    f = spark.createDataFrame([("a", 1, 0.0, 1.0, 2.0), ("a", 2, 1.0, 2.0, 3.0), ("b", 1, None, 1.0, None), ("b", 2, None, 3.0, None)], FC)
    (r,) = combine.overlap_matrix(f).collect()
    assert r.band_overlap_90 is None and r.dir_agree == 1.0 and (r.h_first, r.h_last) == (1, 2)


def test_weights_sum_to_one_and_best_pair_ties(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 4.0, 1.0), (1, 9.0, -1.0), (1, None, 5.0)], "year int, v double, w double")
    (r,) = sv.weighted(df, "year", "v", "w").collect()
    assert r.w_total == pytest.approx(1) and r.w_mean == pytest.approx(2.5) and r.w_sd == pytest.approx(math.sqrt(0.75))
    th = spark.createDataFrame([(1, 2, 10.0, 20.0, 30.0, 70.0), (1, None, 10.0, 50.0, 0.0, 100.0)], "year int, pid int, a double, b double, c double, d double")
    (r,) = sv.best_pair(th, "year", "pid", [("a", "b"), ("c", "d")]).collect()
    assert r.pair == 1 and r.gap == 40.0


def test_audit_report_and_gate(spark):
    assert "_(no data)_" in govern.markdown(spark.createDataFrame([], "a int"), "t")
    assert "| 1 |" in govern.markdown(spark.createDataFrame([(1,)], "a int"), "t")
    rows = spark.createDataFrame([(1.0, 2.0, 1.0, 2.0, 3.0, 2.0, 0.01, 0.1)], "crps_model double, crps_base double, brier_model double, brier_base double, loss_model double, loss_base double, coverage_error double, skill double")
    assert govern.acceptance(rows).first().accepted


def test_jump_paths(spark, walk):
    m = forecast.standardised_steps(walk).withColumn("no", F.when(F.col("indicator") == "a", 1).otherwise(2).cast("long"))
    calm = {r.indicator: r for r in forecast.jump_paths(m, 2000, 1, rate=0.0).groupBy("indicator").agg(F.avg("y").alias("m"), F.stddev("y").alias("s")).collect()}
    for r in m.collect():
        assert abs(calm[r.indicator].m - (r["mean"] + r.sd * (r["last"] + r.drift))) < 5 * r.sd * r.step / 2000**0.5
        assert 0.9 < calm[r.indicator].s / (r.sd * r.step) < 1.1
    wild = forecast.path_quantiles(forecast.jump_paths(m, 2000, 4, rate=1.0, df=3)).where("horizon = 4").collect()
    quiet = {r.indicator: r.q95 - r.q05 for r in forecast.path_quantiles(forecast.jump_paths(m, 2000, 4, rate=0.0)).where("horizon = 4").collect()}
    assert all(r.q95 - r.q05 > quiet[r.indicator] for r in wild)
    again = forecast.jump_paths(m.repartition(7), 50, 3).exceptAll(forecast.jump_paths(m.coalesce(1), 50, 3))
    assert again.count() == 0
    assert forecast.jump_paths(m.limit(0), 10, 3).count() == 0
    with pytest.raises(ValueError):
        forecast.jump_paths(m, 1, 1, df=0)


@pytest.mark.parametrize("df", [1, 2, 3, 4])
def test_t_draws(spark, df):
    u = lambda s: forecast.uniform_sql(f"(id * 7919 + {s} * 15485863)")
    (row,) = spark.range(40000).select(F.expr(forecast.jump_sql(u, df)).alias("t")).agg(F.percentile("t", F.lit(0.75)).alias("q"), F.percentile("t", F.lit(0.5)).alias("m")).collect()
    # quartiles of the Student distribution
    assert abs(row.q - {1: 1.0, 2: 0.816497, 3: 0.764892, 4: 0.740697}[df]) < 0.04 and abs(row.m) < 0.03


def test_local_trend(spark):
    line = obs(spark, [("line", t, 2.0 * t) for t in range(10)] + [("late", t, 1.0) for t in range(20, 30)] + [("flat", t, 5.0) for t in range(5)] + [("short", 0, 1.0), ("short", 1, 2.0), ("line", 50, 999.0), ("line", 4, None)])
    got = {(r.indicator, r.horizon): r for r in forecast.local_trend(line, 15, 2).collect()}
    assert {i for i, _ in got} == {"line", "flat"}
    assert abs(got["line", 1].q50 - 20) < 0.7 and abs(got["line", 2].q50 - got["line", 1].q50 - 2) < 0.7
    assert got["flat", 2].q50 == got["flat", 2].q05 == 5.0


def test_match_sample(spark):
    f = spark.createDataFrame([("a", 1, 0.0, 1.0, 2.0), ("a", 2, 1.0, 3.0, 5.0), ("flat", 1, 1.0, 2.0, 3.0), ("flat", 2, 1.0, 2.0, 3.0), ("none", 1, 1.0, 2.0, 3.0)], FC)
    o = obs(spark, [("a", 1, 10.0), ("a", 2, 14.0), ("a", 3, None), ("a", 9, 1e9), ("flat", 1, 4.0)])
    got = {(r.indicator, r.horizon): (r.q05, r.q50, r.q95) for r in calibrate.match_sample(f, o, 5).collect()}
    assert got == {("a", 1): (13.0, 15.0, 17.0), ("a", 2): (15.0, 19.0, 23.0), ("flat", 1): (3.0, 4.0, 5.0), ("flat", 2): (3.0, 4.0, 5.0), ("none", 1): (1.0, 2.0, 3.0)}


def test_complete_steps(spark):
    o = obs(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, None), ("b", 2, 5.0), ("b", 3, 6.0)])
    assert sorted(map(tuple, series.complete_steps(o).collect())) == [("a", 2, 2.0), ("b", 2, 5.0)]
    assert series.complete_steps(o.limit(0)).count() == 0


def test_step_up_control_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 0.0, 0.01, 1.0, rnd.random() ** 3 / 5])) for _ in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, p_value double")

    def brute(some, alpha):
        known = sorted(p for _, p in some if p is not None)
        cut = max([p for k, p in enumerate(known, 1) if p <= alpha * k / len(known)], default=-1.0)
        return {i for i, p in some if p is not None and p <= cut}

    for alpha in (0.05, 0.2, 0.001):
        got = {r.i for r in stats.benjamini_hochberg(df, alpha).where("bh_reject").collect()}
        assert got == brute([(i, p) for i, (_, p) in enumerate(rows)], alpha)
        got = {r.i for r in stats.benjamini_hochberg(df, alpha, by=("f",)).where("bh_reject").collect()}
        assert got == set().union(*[brute([(i, p) for i, (g, p) in enumerate(rows) if g == f], alpha) for f in ("a", "b", None)])
    assert stats.benjamini_hochberg(df.limit(0)).count() == 0 and stats.benjamini_hochberg(df.where("p_value IS NULL")).where("bh_reject").count() == 0


def test_rolling_origins_never_look_ahead(spark):
    rows = [("a", t, float(t * t % 17)) for t in range(60)] + [("b", t, float(t % 5)) for t in range(20, 60)]
    obs = spark.createDataFrame(rows, "indicator string, t long, value double")
    origins = [25, 40, 50]
    for model in (forecast.drift_forecast, forecast.local_level, forecast.linear_trend, forecast.smoothing, forecast.local_trend):
        many = {(r.indicator, r.origin, r.horizon): round(r.q50, 6) for r in forecast.rolling(obs, origins, model, 3).collect()}
        for o in origins:
            known = obs.where(F.col("t") <= o)
            one = {(r.indicator, o, r.horizon): round(r.q50, 6) for r in model(known, o, 3).collect()}
            assert one == {k: v for k, v in many.items() if k[1] == o}
        table = spark.createDataFrame([(o,) for o in [*origins, 25, None]], "origin long")
        assert forecast.rolling(obs.where("t <= 50"), table, model, 3).count() == len(many)


def test_poisson_counts_have_their_mean_and_variance(spark):
    for rate in (0.2, 4.0, 30.0):
        got = spark.range(20001).select(F.expr(forecast.poisson_sql("((id + 5e-1) / 20001)", rate)).alias("k")).agg(F.avg("k"), F.var_pop("k"), F.max("k")).first()
        assert got[0] == pytest.approx(rate, rel=0.01) and got[1] == pytest.approx(rate, rel=0.02)
    assert got[2] > 50


def test_band_membership_whichever_way_the_ends_stand(spark):
    from tidecast.functions import between_sql

    values = [None, -1.0, 0.0, 0.5, 1.0, 2.0]
    rows = [(y, a, b) for y in values for a in values for b in values]
    df = spark.createDataFrame(rows, "y double, a double, b double").select("*", F.expr(between_sql("y", "a", "b")).alias("x"))
    for r in df.collect():
        known = [v for v in (r.a, r.b) if v is not None]
        assert r.x == int(r.y is not None and bool(known) and min(known) <= r.y <= max(known))


def test_a_level_that_is_missing_is_an_error(spark):
    covered = spark.createDataFrame([("a", 1, 0.5, 1)], "indicator string, horizon long, level double, covered long")
    pits = spark.createDataFrame([("a", 1, 0.4)], "indicator string, horizon long, pit double")
    with pytest.raises(Exception, match="lack a level"):
        score.metrics_by_horizon(covered, pits).collect()
    assert score.metrics_by_horizon(covered.limit(0), pits).count() == 0


def test_reports_state_what_they_leave_out(spark):
    df = spark.range(5)
    assert "_(3 more rows)_" in govern.markdown(df, "T", 2) and "more rows" not in govern.markdown(df, "T")
    text = govern.final_report("Release", {"Coverage": df, "Nothing": None, "Empty": df.limit(0)}, ["a note"])
    assert text.count("_(no data)_") == 2 and "- a note" in text and "| 4 |" in text


def test_full_manifest(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a")
    text = govern.full_manifest(spark, str(tmp_path), "v1", ["run it"])
    assert "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb" in text and "run it" in text and spark.version in text


def test_revisions_and_metadata(spark):
    v = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 1, 2, 5.0), ("a", 1, 3, 7.0), ("a", 2, 1, None), ("a", 2, 2, 1.0)], "indicator string, t long, vintage long, value double")
    assert {(r.t, r.vintage, r.change) for r in series.revisions(v).collect()} == {(1, 3, 2.0), (2, 2, None)}
    meta = spark.createDataFrame([("a", "pct", [2])], "indicator string, unit string, breaks array<long>")
    got = {(r.indicator, r.t): (r.unit, r.regime) for r in series.with_metadata(v.select("indicator", "t").distinct().union(spark.createDataFrame([("z", 9)], "indicator string, t long")), meta).collect()}
    assert got == {("a", 1): ("pct", 0), ("a", 2): ("pct", 1), ("z", 9): (None, 0)}
