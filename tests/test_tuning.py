"""The nested search against a plain one in numpy, and what it must not see."""

import math

import numpy as np
import pytest

from tidecast.operators import tuning

ORIGINS, H, SEARCH = [30, 40], 4, dict(number=10, inner=5, stride=2, spans=(5, 12))


def panel(spark, seed=3, cut=None, extra=()):
    rng = np.random.default_rng(seed)
    rows = [(i, t, float(np.round(v, 3))) for i in "ab" for t, v in enumerate(rng.normal(size=50).cumsum() + 10) if not (i == "b" and t in (7, 25, 33))]
    rows = [r for r in rows if cut is None or r[1] <= cut]
    return rows, spark.createDataFrame([*rows, *extra], "indicator string, t long, value double")


def settled(df):
    """Rows in order, without the last bits that the order of a sum leaves open."""
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect())


def plain(rows, grid, outer):
    """{indicator: (candidate, n, mae, [q50], w)} at one outer origin."""
    out = {}
    for i in sorted({r[0] for r in rows}):
        y = {t: v for j, t, v in rows if j == i}

        def ahead(o, g):
            ts = [t for t in y if o - g.span < t <= o]
            if len(ts) < 3:
                return None
            b, _ = np.polyfit([t - o for t in ts], [y[t] for t in ts], 1)
            b /= 1 + g.penalty
            line = np.mean([y[t] for t in ts]) - b * np.mean([t - o for t in ts])
            base = g.mix * y[max(ts)] + (1 - g.mix) * line
            return [base + b * sum(g.phi**k for k in range(1, j + 1)) for j in range(1, H + 1)]

        scored = []
        for g in grid:
            es = []
            for k in range(1, SEARCH["inner"] + 1):
                o = outer - k * SEARCH["stride"]
                for j, q in enumerate(ahead(o, g) or [], 1):
                    if o + j <= outer and o + j in y:
                        es.append(abs(y[o + j] - q))
            if es and ahead(outer, g):
                scored.append((-len(es), np.mean(es), g.candidate, es, ahead(outer, g)))
        n, mae, c, es, q = min(scored, key=lambda s: s[:3])
        out[i] = (c, -n, mae, q, sorted(es)[min(math.ceil((len(es) + 1) * 0.9 - 1e-9), len(es)) - 1])
    return out


def test_nested_search_by_hand(spark):
    rows, obs = panel(spark)
    grid = tuning.seeded_grid(spark, SEARCH["number"], spans=SEARCH["spans"]).collect()
    got = tuning.nested_search(obs, ORIGINS, H, **SEARCH).collect()
    assert len(got) == 2 * len(ORIGINS) * H
    for o in ORIGINS:
        for i, (c, n, mae, q, w) in plain(rows, grid, o).items():
            mine = sorted((r for r in got if r.origin == o and r.indicator == i), key=lambda r: r.horizon)
            assert {(r.candidate, r.n) for r in mine} == {(c, n)}
            assert [r.q50 for r in mine] == pytest.approx(q) and mine[0].mae == pytest.approx(mae)
            assert [r.q95 - r.q50 for r in mine] == pytest.approx([w] * H)


def test_grid_depends_on_the_seed_alone(spark):
    a, b = (tuning.seeded_grid(spark, 50, seed=s).collect() for s in (1, 2))
    assert a == tuning.seeded_grid(spark, 50, seed=1).collect() and a != b
    assert {r.penalty for r in a} == set(tuning.PENALTIES) and all(6 <= r.span <= 30 and 0 < r.mix < 1 and 0.8 <= r.phi <= 0.99 for r in a)


def test_nothing_after_the_origin_is_read(spark):
    whole = settled(tuning.nested_search(panel(spark)[1], [30], H, **SEARCH))
    assert whole == settled(tuning.nested_search(panel(spark, cut=30)[1], [30], H, **SEARCH))


def test_nulls_short_series_and_empty_tables(spark):
    extra = [("b", 60, None), ("none", 3, None), ("short", 29, 1.0), (None, 5, 1.0)]
    usual = settled(tuning.nested_search(panel(spark)[1], [30], H, **SEARCH))
    assert settled(tuning.nested_search(panel(spark, extra=extra)[1], [30], H, **SEARCH)) == usual
    empty = panel(spark)[1].where("false")
    assert tuning.nested_search(empty, ORIGINS, H, **SEARCH).count() == tuning.coupled_members(empty, ORIGINS, H, **SEARCH).count() == 0


def test_members_follow_the_errors(spark):
    obs = panel(spark)[1]
    chosen = {(r.indicator, r.horizon): r for r in tuning.nested_search(obs, [40], H, **SEARCH).collect()}
    errors = tuning.nested_errors(obs, [40], H, **SEARCH)[2].collect()
    got = tuning.coupled_members(obs, [40], H, **SEARCH).collect()
    for i in "ab":
        own = [e for e in errors if e.indicator == i and e.candidate == chosen[i, 1].candidate]
        inner = sorted(o for o in {e.inner for e in own} if sum(e.inner == o for e in own) == H)
        for h in range(1, H + 1):
            e = [next(x.e for x in own if x.inner == o and x.horizon == h) for o in inner]
            y = [r.y for r in sorted((r for r in got if (r.indicator, r.horizon) == (i, h)), key=lambda r: r.path)]
            assert np.argsort(y).tolist() == np.argsort(e).tolist()
            assert np.mean(y) == pytest.approx(chosen[i, h].q50)
            assert len(y) == len(inner) > 1 and max(y) <= chosen[i, h].q95 + (chosen[i, h].q95 - chosen[i, h].q50)


def test_bands_by_root_mean_square(spark):
    obs = panel(spark)[1]
    a, b = (sorted(tuning.nested_search(obs, [40], H, conformal=c, **SEARCH).collect()) for c in (True, False))
    assert [r.q50 for r in a] == [r.q50 for r in b] and [r.q95 for r in a] != [r.q95 for r in b]
