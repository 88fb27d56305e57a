"""Queries of the models that hold several indicators together."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions import Z95, num
from tidecast.operators import forecast, joint, series
from tidecast.plans import _HS, _TR, KEY, N_PATHS, _sim, _sim_sql, query
from tidecast.plans.testbed import OBS, ORIGIN, PRIORITIES, H, obs_orders

_K = len(PRIORITIES)
_PAIRS = "cp AS (SELECT a.indicator AS a, b.indicator AS b, count(*) AS n, corr(a.value, b.value) AS corr FROM tr a JOIN tr b ON a.t = b.t AND a.indicator < b.indicator GROUP BY ALL)"


def _factor_sql() -> str:
    """The factor of the correlation matrix, an expression for each entry: rows ``r`` and, brought to length 1, ``l``."""
    known = ", ".join(f"coalesce(max(CASE WHEN a = '{PRIORITIES[j]}' AND b = '{PRIORITIES[i]}' THEN corr END), 0e0) AS c_{i}_{j}" for i in range(_K) for j in range(i))
    steps = []
    for i in range(_K):
        for j in range(i):
            done = "".join(f" - r_{i}_{k} * l_{j}_{k}" for k in range(j))
            steps.append(f"CASE WHEN l_{j}_{j} > 0 THEN (c_{i}_{j}{done}) / l_{j}_{j} ELSE 0e0 END AS r_{i}_{j}")
        pivot = "1e0" + "".join(f" - r_{i}_{k} * r_{i}_{k}" for k in range(i))
        steps.append(f"CASE WHEN {pivot} > 1e-12 THEN sqrt({pivot}) ELSE 0e0 END AS r_{i}_{i}")
        length = " + ".join(f"r_{i}_{k} * r_{i}_{k}" for k in range(i + 1))
        steps.append(", ".join(f"r_{i}_{j} / sqrt({length}) AS l_{i}_{j}" for j in range(i + 1)))
    chain = [f"SELECT {known} FROM cp", *[f"SELECT *, {x} FROM f{n}" for n, x in enumerate(steps)]]
    tables = [f"f{n} AS MATERIALIZED ({x})" for n, x in enumerate(chain)]
    return f"{_PAIRS}, {', '.join(tables)}, fa AS (SELECT * FROM f{len(steps)})"


def _latent_sql(seed: int = 12345) -> str:
    u = lambda j, s: forecast.uniform_sql(f"({seed} + path * 7919 + {j} * 104729 + {s} * 15485863)", "duckdb")
    e = ", ".join(f"sqrt(-2e0 * ln({u(j, 1)})) * cos(2e0 * pi() * {u(j, 2)}) AS e_{j}" for j in range(_K))
    rows = " UNION ALL ".join(f"SELECT '{p}' AS indicator, path, {' + '.join(f'l_{i}_{j} * e_{j}' for j in range(i + 1))} AS x FROM ee, fa" for i, p in enumerate(PRIORITIES))
    return f"ee AS (SELECT path, {e} FROM (SELECT CAST(p AS BIGINT) AS path FROM range(0, {N_PATHS}) r(p))), lx AS ({rows})"


def _factored(spark, d):
    o = forecast.train(obs_orders(spark, d), ORIGIN)
    pairs = series.correlation_pairs(o)
    return joint.factor(pairs, o), pairs


_L = " UNION ALL ".join(f"SELECT '{PRIORITIES[i]}' AS i, '{PRIORITIES[j]}' AS j, R(l_{i}_{j}) AS l FROM fa" for i in range(_K) for j in range(i + 1))


@query(f"{_TR}, {_factor_sql()} {_L}", 6)
def copula_factor(spark, d):
    return joint.factor_rows(_factored(spark, d)[0])


_T = " UNION ALL ".join(f"SELECT '{PRIORITIES[i]}' AS a, '{PRIORITIES[j]}' AS b, {' + '.join(f'l_{i}_{k} * l_{j}_{k}' for k in range(i + 1))} AS target FROM fa" for i in range(_K) for j in range(i + 1, _K))


@query(f"""{_TR}, {_factor_sql()}, {_latent_sql()}, tg AS ({_T}), sm AS (SELECT a.indicator AS a, b.indicator AS b, corr(a.x, b.x) AS sample, count(*) AS n FROM lx a JOIN lx b ON a.path = b.path AND a.indicator < b.indicator GROUP BY ALL)
SELECT sm.a, sm.b, R(corr) AS corr, R(target) AS target, R(sample) AS sample, sm.n, abs(sample - target) <= 4 * (1 - target * target) / sqrt(sm.n) + 1e-9 AS within FROM sm JOIN tg USING (a, b) LEFT JOIN cp USING (a, b)""", 6)
def copula_correlations(spark, d):
    made, pairs = _factored(spark, d)
    return joint.latent_correlations(made, joint.latents(made, N_PATHS), pairs)


@query(f"""{_TR}, {_sim_sql()}, {_factor_sql()}, {_latent_sql()}, a AS (SELECT *, row_number() OVER (PARTITION BY indicator, horizon ORDER BY y, path) AS r FROM sim12345), b AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY x, path) AS r FROM lx)
SELECT a.indicator, b.path, a.horizon, R(a.y) AS y FROM a JOIN b ON a.indicator = b.indicator AND a.r = b.r""", 2)
def copula_paths(spark, d):
    """Simulated paths whose indicators move together as they did: every horizon's draws in the order of correlated latents."""
    made, _ = _factored(spark, d)
    return joint.couple(_sim(spark, d), joint.latents(made, N_PATHS))


def _joint_sql(ql: float = 0.1, qt: float = 0.1, noise: float = 0.1, prior: float = 1.0) -> str:
    """The filter of two levels and trends step by step; the covariance's rows and columns are levels, then trends."""
    q_l, q_t, r, p0 = num(ql), num(qt), num(noise), num(prior)
    p = lambda x, y: f"p{min(x, y)}{max(x, y)}"
    cells = [(x, y) for x in range(4) for y in range(x, 4)]
    ahead = {}
    for x, y in cells:
        move = "" if x // 2 != y // 2 else f" + {q_l if x < 2 else q_t}" + ("" if x == y else " * rho")
        parts = [p(a, b) for a in ([x, x + 2] if x < 2 else [x]) for b in ([y, y + 2] if y < 2 else [y])]
        ahead[x, y] = " + ".join(parts) + move
    w = lambda x, y: f"w{min(x, y)}{max(x, y)}"
    predict = ", ".join([f"{e} AS w{x}{y}" for (x, y), e in ahead.items()])
    det = f"((w00 + {r}) * (w11 + {r}) - w01 * w01)"
    inv = [[f"(w11 + {r}) / {det}", f"-w01 / {det}"], [f"-w01 / {det}", f"(w00 + {r}) / {det}"]]
    gains = ", ".join(f"{w(x, 0)} * ({inv[0][c]}) + {w(x, 1)} * ({inv[1][c]}) AS g{x}{c}" for x in range(4) for c in range(2))
    state = ["(m0 + m2)", "(m1 + m3)", "m2", "m3"]
    means = ", ".join(f"{state[x]} + g{x}0 * (z0 - m0 - m2) + g{x}1 * (z1 - m1 - m3)" for x in range(4))
    covs = ", ".join(f"{w(x, y)} - g{x}0 * {w(0, y)} - g{x}1 * {w(1, y)}" for x, y in cells)
    names = ", ".join([*[f"m{x}" for x in range(4)], *[f"p{x}{y}" for x, y in cells]])
    start = ", ".join([*["0e0"] * 4, *[p0 if x == y else "0e0" for x, y in cells]])
    one, two = PRIORITIES[:2]
    out = " UNION ALL ".join(
        f"SELECT '{n}' AS indicator, horizon, mean{k} + sd{k} * (m{k} + horizon * m{k + 2}) AS mu, sd{k} * sqrt(p{k}{k} + 2 * horizon * p{k}{k + 2} + horizon * horizon * p{k + 2}{k + 2} + horizon * {q_l} + {q_t} * (horizon - 1) * horizon * (2 * horizon - 1) / 6e0 + {r}) AS s FROM e, {_HS}"
        for k, n in enumerate((one, two))
    )
    return f"""WITH RECURSIVE {OBS}, y AS (SELECT a.t, a.value AS y0, b.value AS y1 FROM obs a JOIN obs b ON a.t = b.t WHERE a.indicator = '{one}' AND b.indicator = '{two}' AND a.t <= {ORIGIN}),
sp AS (SELECT avg(y0) AS mean0, stddev_samp(y0) AS sd0, avg(y1) AS mean1, stddev_samp(y1) AS sd1, corr(y0, y1) AS rho FROM y),
z AS (SELECT row_number() OVER (ORDER BY t) AS i, (y0 - mean0) / sd0 AS z0, (y1 - mean1) / sd1 AS z1, sp.* FROM y, sp),
k(i, {names}) AS (SELECT CAST(0 AS BIGINT), {start} UNION ALL SELECT i, {means}, {covs} FROM (SELECT *, {gains} FROM (SELECT z.i, z0, z1, m0, m1, m2, m3, {predict} FROM k JOIN z ON z.i = k.i + 1))),
e AS (SELECT k.*, sp.* FROM k, sp WHERE i = (SELECT max(i) FROM k)), f AS ({out})
SELECT indicator, horizon, R(mu - {num(Z95)} * s) AS q05, R(mu) AS q50, R(mu + {num(Z95)} * s) AS q95 FROM f"""


@query(_joint_sql(), 2)
def joint_trend(spark, d):
    """Two indicators, so that SQL can follow; any number is tested against numpy."""
    return joint.joint_trend(obs_orders(spark, d).where(F.col(KEY).isin(PRIORITIES[:2])), ORIGIN, H)
