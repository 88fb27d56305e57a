"""Queries of the nested rolling-origin search."""

from __future__ import annotations

from tidecast.operators import tuning
from tidecast.plans import _ORIGINS, query
from tidecast.plans.testbed import LINES, OBS, obs_lines, obs_orders

H, NUMBER, INNER, STRIDE = 6, 24, 6, 3


def _searched(obs: str) -> str:
    """The chosen forecasts ``ch`` and the known errors ``er``."""
    outer = ", ".join(f"({o})" for o in _ORIGINS)
    columns = ", ".join(f"{x} AS {c}" for c, x in tuning.grid_columns(dialect="duckdb").items())
    return f"""WITH {obs}, ca AS MATERIALIZED (SELECT candidate, {columns} FROM (SELECT CAST(i AS BIGINT) AS candidate FROM range({NUMBER}) r(i))),
oi AS (SELECT CAST(o AS BIGINT) AS oo, CAST(o - {STRIDE} * i AS BIGINT) AS ii FROM (VALUES {outer}) v(o), range(1, {INNER + 1}) r(i)),
og AS (SELECT oo AS o FROM oi UNION SELECT ii FROM oi),
ft AS (SELECT indicator, o, span, arg_max(value, t) AS last, avg(value) AS m, avg(t - o) AS c, regr_slope(value, t - o) AS b FROM obs, og, (SELECT DISTINCT span FROM ca) s WHERE value IS NOT NULL AND t <= o AND t > o - span GROUP BY ALL HAVING count(*) >= 3),
fw AS (SELECT indicator, o, candidate, CAST(h AS BIGINT) AS horizon, mix * last + (1 - mix) * (m - b / (1 + penalty) * c) + b / (1 + penalty) * phi * (1 - pow(phi, h)) / (1 - phi) AS q50 FROM ft JOIN ca USING (span), range(1, {H + 1}) r(h)),
er AS MATERIALIZED (SELECT fw.indicator, oo, ii, candidate, horizon, value - q50 AS e FROM oi JOIN fw ON fw.o = ii JOIN obs ON obs.indicator = fw.indicator AND obs.t = ii + horizon WHERE value IS NOT NULL AND obs.t <= oo),
sc AS (SELECT indicator, oo, candidate, count(*) AS n, avg(abs(e)) AS mae FROM er GROUP BY ALL),
be AS MATERIALIZED (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY indicator, oo ORDER BY n DESC, mae, candidate) = 1),
wi AS (SELECT indicator, oo, abs(e) AS a, row_number() OVER (PARTITION BY indicator, oo ORDER BY abs(e)) AS r, count(*) OVER (PARTITION BY indicator, oo) AS k FROM er JOIN be USING (indicator, oo, candidate)),
wd AS (SELECT indicator, oo, a AS w FROM wi WHERE r = least(ceil((k + 1) * 9e-1 - 1e-9), k)),
ch AS MATERIALIZED (SELECT be.indicator, be.oo, horizon, be.candidate, span, penalty, mix, phi, n, mae, q50, w FROM be JOIN fw ON fw.indicator = be.indicator AND fw.o = be.oo AND fw.candidate = be.candidate JOIN ca ON ca.candidate = be.candidate JOIN wd ON wd.indicator = be.indicator AND wd.oo = be.oo)"""


_CHOSEN = "SELECT indicator, oo AS origin, horizon, candidate, span, R(penalty) AS penalty, R(mix) AS mix, R(phi) AS phi, n, R(mae) AS mae, R(q50 - w) AS q05, R(q50) AS q50, R(q50 + w) AS q95 FROM ch"


@query(f"{_searched(OBS)} {_CHOSEN}", 3)
def nested_search(spark, d):
    """Outer origins with the candidate that their inner ones choose, and conformal bands."""
    return tuning.nested_search(obs_orders(spark, d), _ORIGINS, H, number=NUMBER, inner=INNER, stride=STRIDE)


@query(f"{_searched(LINES)} {_CHOSEN}", 1)
def nested_search_lines(spark, d):
    return tuning.nested_search(obs_lines(spark, d), _ORIGINS, H, number=NUMBER, inner=INNER, stride=STRIDE)


@query(f"""{_searched(OBS)}, tp AS (SELECT indicator, oo, ii, horizon, e FROM er JOIN be USING (indicator, oo, candidate) QUALIFY count(*) OVER (PARTITION BY indicator, oo, ii) = {H}),
rk AS (SELECT indicator, oo, horizon, dense_rank() OVER (PARTITION BY indicator, oo ORDER BY ii) - 1 AS path, row_number() OVER (PARTITION BY indicator, oo, horizon ORDER BY e, ii) AS r, count(*) OVER (PARTITION BY indicator, oo, horizon) AS k FROM tp)
SELECT indicator, oo AS origin, CAST(path AS BIGINT) AS path, horizon, R(q50 + w * (2e0 * (r - 5e-1) / k - 1) / 9e-1) AS y FROM rk JOIN ch USING (indicator, oo, horizon)""", 3)
def coupled_members(spark, d):
    """Members of the chosen forecasts in the rank order of the inner errors."""
    return tuning.coupled_members(obs_orders(spark, d), _ORIGINS, H, number=NUMBER, inner=INNER, stride=STRIDE)
