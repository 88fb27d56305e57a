"""Recursions by chunks equal the recursions step by step."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import forecast, scan

OBS = "indicator string, t long, value double"


@pytest.fixture(scope="module")
def long(spark):
    rnd = random.Random(5)
    rows = []
    for name, n, far in (("a", 700, 1e7), ("b", 41, 0.0), ("c", 5, -3.0), ("d", 1, 2.0)):
        y, slope, t = far, 0.1, -300
        for _ in range(n):
            t += rnd.choice([1, 1, 1, 2, 5])
            slope += rnd.gauss(0, 0.05)
            y += slope + rnd.gauss(0, 1)
            rows.append((name, t, y + rnd.gauss(0, 0.5)))
        rows.append((name, t + 1, None))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, OBS).repartition(4).cache()


def series(df):
    out = {}
    for r in sorted(df.where("value IS NOT NULL").collect(), key=lambda r: r.t):
        out.setdefault(r.indicator, []).append(r.value)
    return out


def filtered(y, q, r=1.0):
    a, p, s, l = y[0], r + q, 0.0, 0.0
    for v in y[1:]:
        f = p + r
        s, l = s + (v - a) ** 2 / f, l + math.log(f)
        a, p = a + p / f * (v - a), p * r / f + q
    return a, p, s, l


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_level_filter(long, size):
    each = scan.chunks(long, size=size).withColumn("q", F.explode(F.array(F.lit(1e-4), F.lit(0.3), F.lit(50.0))))
    assert each.agg(F.max(F.size("y"))).first()[0] <= size
    got = {(r.indicator, r.q): (r.mean, r.variance, r.s, r.l, r.n) for r in scan.level_filter(each, ["indicator", "q"]).collect()}
    want = {(k, q): (*filtered(y, q), len(y)) for k, y in series(long).items() for q in (1e-4, 0.3, 50.0)}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-8, abs=1e-6), k


@pytest.mark.parametrize("size", [1, 9, 100_000])
def test_trend_filter_and_smoothing(long, size, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", size)
    got = {r.indicator: (r.last, r.trend, r.n) for r in scan.trend_filter(long, 0.1, 0.4).collect()}
    for k, y in series(long).items():
        if len(y) < 2:
            assert got[k][0] == y[-1] and got[k][2] == len(y)
            continue
        b, p = y[1] - y[0], 0.1 + 0.4
        for u, v in zip(y[1:], y[2:]):
            b, p = b + p / (p + 0.1) * (v - u - b), p + 0.4 - p * p / (p + 0.1)
        assert got[k] == pytest.approx((y[-1], b, len(y)), rel=1e-6, abs=1e-7)
    level = {r.indicator: r.level for r in scan.smoothed_level(long, 0.3).collect()}
    for k, y in series(long).items():
        x = y[0]
        for v in y[1:]:
            x += 0.3 * (v - x)
        assert level[k] == pytest.approx(x, rel=1e-12)


def test_forecasts_do_not_depend_on_the_chunks(long, monkeypatch):
    def run():
        out = {}
        for f in (forecast.local_level, forecast.local_trend, forecast.smoothing):
            for r in f(long, 10_000, 3).collect():
                out[f.__name__, r.indicator, r.horizon] = [x for x in r[2:]]
        return out

    whole = run()
    monkeypatch.setattr(scan, "CHUNK", 16)
    parts = run()
    assert whole.keys() == parts.keys() and len(whole) > 20
    for k in whole:
        assert np.allclose(whole[k], parts[k], rtol=1e-7), k
