"""The copula's factor and latents, and the joint filter, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import Z95
from tidecast.operators import joint, series

OBS = "indicator string, t long, value double"


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(5, 5))
    walk = np.cumsum(rng.normal(size=(130, 5)) @ mix, 0) * 3 + 50
    rows = [(name, t - 20, float(walk[t, i])) for i, name in enumerate("abcde") for t in range(130) if not (i == 2 and t % 11 == 3)]
    rows += [("a", 500, None), ("e", 5000, 1.0)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, OBS).repartition(3).cache()


def test_factor(panel):
    pairs = series.correlation_pairs(panel)
    (row,) = joint.factor(pairs, panel).collect()
    c = np.eye(5)
    for r in pairs.collect():
        i, j = "abcde".index(r.a), "abcde".index(r.b)
        c[i, j] = c[j, i] = r["corr"]
    assert row.names == list("abcde")
    l = np.array([x + [0.0] * (5 - len(x)) for x in row.l])  # noqa: E741
    assert np.allclose(l, np.linalg.cholesky(c), atol=1e-10)
    table = {(r.i, r.j): r.l for r in joint.factor_rows(joint.factor(pairs, panel)).collect()}
    assert len(table) == 15 and table["b", "a"] == pytest.approx(l[1, 0])


def test_factor_of_what_is_no_correlation_matrix(spark):
    """Latents stay standard normal; an indicator that repeats another follows it."""
    names = spark.createDataFrame([(x,) for x in "abc"], "indicator string")
    rows = [("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", -0.9)]
    (row,) = joint.factor(spark.createDataFrame(rows, "a string, b string, corr double"), names).collect()
    assert all(sum(x * x for x in r) == pytest.approx(1.0) for r in row.l)
    rows = [("a", "b", 1.0), ("a", "c", None), ("b", "c", 0.0)]
    made = joint.factor(spark.createDataFrame(rows, "a string, b string, corr double"), names)
    x = {(r.indicator, r.path): r.x for r in joint.latents(made, 50).collect()}
    assert all(x["a", k] == pytest.approx(x["b", k]) for k in range(50)) and x["a", 1] != pytest.approx(x["c", 1])
    assert joint.factor(spark.createDataFrame([], "a string, b string, corr double"), names.limit(0)).count() == 0
    many = spark.range(joint.MOST + 1).select(F.col("id").cast("string").alias("indicator"))
    with pytest.raises(Exception, match="joint model"):
        joint.factor(spark.createDataFrame([], "a string, b string, corr double"), many).collect()


def test_latents_and_coupling(panel):
    pairs = series.correlation_pairs(panel)
    made = joint.factor(pairs, panel)
    latent = joint.latents(made, 4000).repartition(7).cache()
    x = latent.groupBy("path").pivot("indicator", list("abcde")).agg(F.first("x")).orderBy("path").toPandas()
    x = x[list("abcde")].to_numpy()
    assert abs(x.mean(0)).max() < 0.08 and abs(x.std(0) - 1).max() < 0.05
    checked = joint.latent_correlations(made, latent, pairs).collect()
    assert len(checked) == 10 and all(r.within for r in checked)
    assert all(r["corr"] == pytest.approx(r.target, abs=1e-9) for r in checked)
    sim = latent.select("indicator", "path", F.explode(F.array(F.lit(1), F.lit(2))).alias("horizon")).withColumn("y", F.rand(3) * F.col("horizon"))
    sim = sim.cache()
    got = joint.couple(sim, latent)
    wide = got.where("horizon = 2").groupBy("path").pivot("indicator", list("abcde")).agg(F.first("y")).orderBy("path").toPandas()[list("abcde")].to_numpy()
    rank = lambda m: m.argsort(0).argsort(0)
    assert (rank(wide) == rank(x)).all()
    one, two = (sorted(r.y for r in d.where("indicator = 'c' AND horizon = 1").collect()) for d in (sim, got))
    assert one == two


def kalman(y, corr, ql, qt, noise, prior):
    k = y.shape[1]
    f = np.block([[np.eye(k), np.eye(k)], [np.zeros((k, k)), np.eye(k)]])
    h = np.hstack([np.eye(k), np.zeros((k, k))])
    q = np.block([[ql * corr, np.zeros((k, k))], [np.zeros((k, k)), qt * corr]])
    m, p = np.zeros(2 * k), prior * np.eye(2 * k)
    for v in y:
        m, p = f @ m, f @ p @ f.T + q
        gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + noise * np.eye(k))
        m, p = m + gain @ (v - h @ m), p - gain @ h @ p
    out = []
    for x in range(1, 6):
        m, p = f @ m, f @ p @ f.T + q
        out.append((m[:k], np.diag(p)[:k] + noise))
    return out


@pytest.mark.parametrize("steps", [1, 13, 512])
def test_joint_trend(panel, steps, monkeypatch):
    monkeypatch.setattr(joint, "STEPS", steps)
    rows = sorted(panel.where("t <= 90 AND value IS NOT NULL").collect(), key=lambda r: (r.t, r.indicator))
    at = {}
    for r in rows:
        at.setdefault(r.t, []).append(r.value)
    y = np.array([v for v in at.values() if len(v) == 5])
    mean, sd = y.mean(0), y.std(0, ddof=1)
    want = kalman((y - mean) / sd, np.corrcoef(y.T), 0.1, 0.2, 0.3, 1.0)
    got = {(r.indicator, r.horizon): r for r in joint.joint_trend(panel, 90, 5, noise_var=0.3, trend_var=0.2).collect()}
    assert len(got) == 25
    for x, (m, v) in enumerate(want, 1):
        for i, name in enumerate("abcde"):
            r = got[name, x]
            assert r.q50 == pytest.approx(mean[i] + sd[i] * m[i], rel=1e-8)
            assert (r.q95 - r.q50) == pytest.approx(Z95 * sd[i] * np.sqrt(v[i]), rel=1e-8)


def test_joint_trend_of_nothing(spark):
    assert joint.joint_trend(spark.createDataFrame([], OBS), 5, 3).count() == 0
