"""Registered queries over the driver's tables and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast import sources
from tidecast.functions import Z75, Z90, Z95, Z975, between_sql, boolean_text, crps_sql, horizon_key, num, phi_sql
from tidecast.operators import calibrate, combine, forecast, govern, score, series, stats
from tidecast.operators import survey as sv
from tidecast.plans import testbed as tb
from tidecast.plans.testbed import BASE, DAYS, LINES, OBS, ORIGIN, PRIORITIES, SURVEY, H, fc, mom, obs_days, obs_lines, obs_orders, points, table

_QUERIES: dict = {}
_ORACLES: dict = {}
KEY = "indicator"
SU = f"greatest((q95 - q50) / {num(Z95)}, 1e-8)"
SM = f"greatest((q95 - q05) / (2e0 * {num(Z95)}), 1e-6)"


def rounded(df, digits: int):
    """Doubles to a fixed number of digits, so that both engines' last bits agree."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "bigint") else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None, digits: int = 4):
    """Register a query; the oracle's doubles are rounded alike. ``sql`` ends in a SELECT."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d), digits)
        if sql:
            _ORACLES[f.__name__] = _with_rounding(sql, digits)
        return f

    return add


def _with_rounding(sql: str, digits: int) -> str:
    """``R(x)`` in an oracle stands for the rounded expression."""
    out, at = [], 0
    while (i := sql.find("R(", at)) >= 0:
        if i and (sql[i - 1].isalnum() or sql[i - 1] == "_"):
            out.append(sql[at : i + 2])
            at = i + 2
            continue
        depth, j = 1, i + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out.append(sql[at:i] + f"(round(CAST({sql[i + 2 : j - 1]} AS DOUBLE), {digits}) + 0e0)")
        at = j
    return "".join(out) + sql[at:]


# -- series ---------------------------------------------------------------


@query(f"WITH {OBS} SELECT indicator, t, R(value) AS value FROM obs")
def annualize(spark, d):
    return obs_orders(spark, d)


@query(f"""WITH {DAYS}, s AS (SELECT indicator, unnest(range(min(t), max(t) + 1)) AS t FROM obs GROUP BY indicator)
SELECT s.indicator, s.t, R(obs.value) AS value FROM s LEFT JOIN obs ON obs.indicator = s.indicator AND obs.t = s.t""")
def densify_gaps(spark, d):
    return series.densify(obs_days(spark, d))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS iso_year, CAST(year(o_orderdate) AS BIGINT) AS digit_year FROM orders")
def year_from_text(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", series.year_from_text(day).alias("iso_year"), series.year_from_text(F.concat(F.lit("wave "), F.date_format("o_orderdate", "yyyy"), F.lit("b"))).alias("digit_year"))


@query("SELECT o_custkey, o_orderkey, R(o_totalprice) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedupe_first(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return series.dedupe_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"WITH {DAYS} SELECT indicator, t, R(value) AS value FROM obs WHERE t IN (SELECT t FROM obs GROUP BY t HAVING count(DISTINCT indicator) = (SELECT count(DISTINCT indicator) FROM obs))")
def complete_steps(spark, d):
    return series.complete_steps(obs_days(spark, d))


_P = ", ".join(f"R(max(CASE WHEN indicator = '{p}' THEN value END)) AS p{p[0]}" for p in PRIORITIES)


@query(f"WITH {OBS} SELECT t, {_P} FROM obs WHERE t <= {ORIGIN} GROUP BY t")
def origin_panel(spark, d):
    wide = series.origin_panel(obs_orders(spark, d), ORIGIN, 8, PRIORITIES)
    return wide.select("t", *[F.col(f"`{p}`").alias(f"p{p[0]}") for p in PRIORITIES])


@query(f"WITH {OBS} SELECT indicator, count(value) AS n_total, count(CASE WHEN t <= {ORIGIN} THEN value END) AS n_train FROM obs GROUP BY indicator")
def history_counts(spark, d):
    return series.history_counts(obs_orders(spark, d), ORIGIN)


@query(f"WITH {OBS}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY indicator ORDER BY t) AS diff FROM obs) SELECT indicator, R(avg(diff)) AS drift, R(stddev_samp(diff)) AS volatility, count(diff) AS n_diff FROM d GROUP BY indicator")
def first_diff_stats(spark, d):
    return series.difference_stats(obs_orders(spark, d))


@query(f"""WITH {OBS} SELECT indicator, t, R((value - avg(CASE WHEN t <= {ORIGIN} THEN value END) OVER (PARTITION BY indicator)) / stddev_samp(CASE WHEN t <= {ORIGIN} THEN value END) OVER (PARTITION BY indicator)) AS z FROM obs""", 6)
def zscore_window(spark, d):
    return series.zscore(obs_orders(spark, d), ORIGIN).select(KEY, "t", "z")


@query(f"""WITH {OBS}, e AS (SELECT indicator, quantile_cont(value, 5e-3) AS lo, quantile_cont(value, 9.95e-1) AS hi FROM obs GROUP BY indicator)
SELECT obs.indicator, t, R(least(greatest(value, lo), hi)) AS value FROM obs JOIN e USING (indicator)""")
def winsorize(spark, d):
    return series.winsorize(obs_orders(spark, d))


@query("SELECT l_orderkey, l_linenumber, R(CASE WHEN l_discount > 0 AND l_discount < 1 THEN ln(l_discount / (1 - l_discount)) END) AS logit, R(ln(1 + l_quantity)) AS log1p, R(l_tax) AS same FROM lineitem", 6)
def transforms(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", series.transform(F.col("l_discount"), "logit_share").alias("logit"), series.transform(F.col("l_quantity"), "log1p").alias("log1p"), series.transform(F.col("l_tax"), "identity").alias("same"))


@query(f"""WITH {LINES}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY indicator ORDER BY t) AS diff FROM obs),
s AS (SELECT indicator, quantile_cont(abs(diff), 5e-1) AS med, stddev_pop(diff) AS sd, count(value) AS n FROM d GROUP BY indicator)
SELECT d.indicator, d.t, R(diff) AS diff, coalesce(n > 2 AND CASE WHEN med > 0 THEN med ELSE sd END > 0 AND abs(diff) > 3 * CASE WHEN med > 0 THEN med ELSE sd END, FALSE) AS is_break FROM d JOIN s USING (indicator)""", 5)
def break_flags(spark, d):
    return series.break_flags(obs_lines(spark, d))


@query(f"WITH {OBS} SELECT a.indicator AS a, b.indicator AS b, count(*) AS n, R(corr(a.value, b.value)) AS corr FROM obs a JOIN obs b ON a.t = b.t AND a.indicator < b.indicator GROUP BY ALL", 6)
def corr_pairs(spark, d):
    return series.correlation_pairs(obs_orders(spark, d))


@query(f"""WITH v AS (SELECT o_orderpriority AS indicator, CAST(year(o_orderdate) AS BIGINT) AS t, CAST(month(o_orderdate) AS BIGINT) AS vintage, avg(o_totalprice) AS value FROM orders GROUP BY ALL)
SELECT indicator, t, R(arg_max(value, vintage)) AS value, max(vintage) AS vintage FROM v WHERE vintage <= 9 GROUP BY ALL""")
def latest_vintage(spark, d):
    o = table(spark, d, "orders")
    v = o.groupBy(F.col("o_orderpriority").alias(KEY), F.year("o_orderdate").cast("long").alias("t"), F.month("o_orderdate").cast("long").alias("vintage")).agg(F.avg("o_totalprice").alias("value"))
    return series.latest_vintage(v, 9)


_VINTAGES = "v AS (SELECT o_orderpriority AS indicator, CAST(year(o_orderdate) AS BIGINT) AS t, CAST(month(o_orderdate) AS BIGINT) AS vintage, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"


@query(f"""WITH {_VINTAGES}, l AS (SELECT *, lag(value) OVER w AS was, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY indicator, t ORDER BY vintage)) SELECT indicator, t, vintage, R(value) AS value, R(was) AS was, R(value - was) AS change FROM l WHERE n > 1 AND value IS DISTINCT FROM was""")
def revision_log(spark, d):
    o = table(spark, d, "orders")
    return series.revisions(o.groupBy(F.col("o_orderpriority").alias(KEY), F.year("o_orderdate").cast("long").alias("t"), F.month("o_orderdate").cast("long").alias("vintage")).agg(F.avg("o_totalprice").alias("value")))


_META = [("1-URGENT", "usd", "log1p", "demand", [24, 48]), ("2-HIGH", "usd", "identity", "demand", [36]), ("3-MEDIUM", "usd", "identity", "supply", None)]


@query(f"""WITH {OBS}, m AS (SELECT * FROM (VALUES ('1-URGENT', 'usd', 'log1p', 'demand', [24, 48]), ('2-HIGH', 'usd', 'identity', 'demand', [36]), ('3-MEDIUM', 'usd', 'identity', 'supply', NULL)) v(indicator, unit, transform, category, breaks))
SELECT indicator, t, R(value) AS value, unit, transform, category, CAST(coalesce(len(list_filter(breaks, lambda b: b <= t)), 0) AS BIGINT) AS regime FROM obs LEFT JOIN m USING (indicator)""")
def metadata_regimes(spark, d):
    meta = spark.createDataFrame(_META, "indicator string, unit string, transform string, category string, breaks array<long>")
    return series.with_metadata(obs_orders(spark, d), meta)


@query("SELECT o_orderkey, CAST(make_date(year(o_orderdate), 1, 1) AS VARCHAR) AS start FROM orders")
def year_starts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", series.year_start(F.year("o_orderdate")).cast("string").alias("start"))


@query("SELECT event_type AS indicator, CAST(date_trunc('day', ts) AS VARCHAR) AS start, R(avg(value)) AS value, count(*) AS n FROM events GROUP BY ALL", 6)
def windowed_events(spark, d):
    from tidecast.streaming import windowed_mean

    got = windowed_mean(table(spark, d, "events"), "ts", "event_type", "value")
    return got.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


# -- survey ---------------------------------------------------------------


@query(f"WITH {SURVEY}, x AS (SELECT year, CASE WHEN ideology BETWEEN 1 AND 7 THEN ideology END AS v FROM sv) SELECT year, count(v) AS n, R(avg(v)) AS mean, R(stddev_samp(v)) AS sd_sample, R(stddev_pop(v)) AS sd_population FROM x GROUP BY year", 6)
def survey_dispersion(spark, d):
    s = tb.survey(spark, d)
    return sv.dispersion(s.select("year", sv.valid(F.col("ideology"), 1, 7).alias("v")), "year", "v")


@query(f"""WITH {SURVEY}, x AS (SELECT year, ideology AS v, weight AS w FROM sv WHERE ideology BETWEEN 1 AND 7 AND weight > 0), m AS (SELECT *, sum(w * v) OVER (PARTITION BY year) / sum(w) OVER (PARTITION BY year) AS m FROM x)
SELECT year, count(*) AS n, R(max(m)) AS w_mean, R(sqrt(sum(w * (v - m) * (v - m)) / sum(w))) AS w_sd, R(1) AS w_total FROM m GROUP BY year""", 6)
def survey_weighted(spark, d):
    s = tb.survey(spark, d)
    return sv.weighted(s.select("year", sv.valid(F.col("ideology"), 1, 7).alias("v"), "weight"), "year", "v", "weight")


_PAIRS = " UNION ALL ".join(f"SELECT year, pid, {i} AS pair, abs(CASE WHEN th{a} BETWEEN 0 AND 100 THEN th{a} END - CASE WHEN th{b} BETWEEN 0 AND 100 THEN th{b} END) AS gap FROM sv" for i, (a, b) in enumerate(((0, 1), (2, 3), (4, 5))))


@query(f"""WITH {SURVEY}, p AS ({_PAIRS}), g AS (SELECT year, pair, count(gap) AS n_valid, count(CASE WHEN pid IS NOT NULL THEN gap END) AS n_pid, CASE WHEN count(pid) > 0 THEN avg(CASE WHEN pid IS NOT NULL THEN gap END) ELSE avg(gap) END AS gap FROM p GROUP BY ALL)
SELECT year, CAST(pair AS BIGINT) AS pair, n_valid, n_pid, R(gap) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n_valid DESC, n_pid DESC, gap IS NULL, pair DESC) AS k FROM g) WHERE k = 1""", 6)
def survey_best_pair(spark, d):
    return sv.best_pair(tb.survey(spark, d), "year", "pid", [("th0", "th1"), ("th2", "th3"), ("th4", "th5")])


@query(f"""WITH {SURVEY}, a AS (SELECT year, R(avg(ideology)) AS ideology FROM sv GROUP BY year), b AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS year, R(avg(l_quantity)) AS quantity FROM lineitem GROUP BY ALL) SELECT year, ideology, quantity FROM a FULL OUTER JOIN b USING (year)""", 6)
def survey_outer_merge(spark, d):
    a = tb.survey(spark, d).groupBy("year").agg(F.avg("ideology").alias("ideology"))
    b = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(F.avg("l_quantity").alias("quantity"))
    return sv.outer_merge([a, b], "year")


_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM sv" for c in ("year", "ideology", "pid", "th0"))


@query(f"""WITH {SURVEY}, p AS ({_PROFILE}), g AS (SELECT col, avg(CASE WHEN x IN (1,2,3,4,5,6,7) THEN 1e0 ELSE 0e0 END) AS s7, avg(CASE WHEN x BETWEEN 0 AND 100 THEN 1e0 ELSE 0e0 END) AS s100, avg(CASE WHEN x BETWEEN 1948 AND 2025 THEN 1e0 ELSE 0e0 END) AS sy, count(DISTINCT x) AS n FROM p GROUP BY col)
SELECT col AS "column", R(s7) AS share_1_7, R(s100) AS share_0_100, R(sy) AS share_year, n AS n_distinct, R(CASE WHEN sy > 5e-1 AND n < 200 THEN sy * (1e0 - least(n, 500) / 5e2) END) AS year_score FROM g""", 6)
def column_profile(spark, d):
    return sv.column_profile(tb.survey(spark, d), ["year", "ideology", "pid", "th0"])


@query(f"""WITH {SURVEY}, p AS ({_PROFILE}), g AS (SELECT col, avg(CASE WHEN x BETWEEN 1948 AND 2025 THEN 1e0 ELSE 0e0 END) AS sy, count(DISTINCT x) AS n FROM p GROUP BY col)
SELECT col AS "column", R(sy * (1e0 - least(n, 500) / 5e2)) AS year_score FROM g WHERE sy > 5e-1 AND n < 200 ORDER BY 2 DESC, 1 LIMIT 1""", 6)
def year_column_pick(spark, d):
    return sv.year_column(tb.survey(spark, d), ["year", "ideology", "pid", "th0"])


_GAP = f"""p AS ({_PAIRS}), g AS (SELECT year, pair, count(gap) AS n_valid, count(CASE WHEN pid IS NOT NULL THEN gap END) AS n_pid, CASE WHEN count(pid) > 0 THEN avg(CASE WHEN pid IS NOT NULL THEN gap END) ELSE avg(gap) END AS gap FROM p GROUP BY ALL),
bp AS (SELECT year, CAST(pair AS BIGINT) AS pair, gap FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n_valid DESC, n_pid DESC, gap IS NULL, pair DESC) AS k FROM g) WHERE k = 1)"""
_THERMO = [("th0", "th1"), ("th2", "th3"), ("th4", "th5")]


def _polar(kind: str) -> str:
    spread = {
        "weighted": "m AS (SELECT *, sum(w * v) OVER (PARTITION BY year) / sum(w) OVER (PARTITION BY year) AS m FROM (SELECT year, ideology AS v, weight AS w FROM sv WHERE ideology BETWEEN 1 AND 7 AND weight > 0)), d AS (SELECT year, count(*) AS n, sqrt(sum(w * (v - m) * (v - m)) / sum(w)) AS sd FROM m GROUP BY year)",
        "sample": "d AS (SELECT year, count(v) AS n, stddev_samp(v) AS sd FROM (SELECT year, CASE WHEN ideology BETWEEN 1 AND 7 THEN ideology END AS v FROM sv) GROUP BY year)",
        "population": "d AS (SELECT year, count(v) AS n, stddev_pop(v) AS sd FROM (SELECT year, CASE WHEN ideology BETWEEN 1 AND 7 THEN ideology END AS v FROM sv) GROUP BY year)",
    }[kind]
    return f"WITH {SURVEY}, {_GAP}, {spread} SELECT year, n, R(sd) AS ideology_sd, pair, R(gap) AS affect_gap FROM d FULL OUTER JOIN bp USING (year) WHERE sd IS NOT NULL OR gap IS NOT NULL"


@query(_polar("weighted"), 6)
def polarisation_weighted(spark, d):
    return sv.polarisation(tb.survey(spark, d), "year", "ideology", "pid", _THERMO, weight="weight")


@query(_polar("sample"), 6)
def polarisation_unweighted(spark, d):
    return sv.polarisation(tb.survey(spark, d), "year", "ideology", "pid", _THERMO)


@query(_polar("population"), 6)
def polarisation_wave(spark, d):
    return sv.polarisation(tb.survey(spark, d), "year", "ideology", "pid", _THERMO, population=True)


# -- forecasts ------------------------------------------------------------

_TR = f"WITH {OBS}, {mom()}"
_HS = f"(SELECT CAST(h AS BIGINT) AS horizon FROM range(1, {H + 1}) r(h))"


@query(f"{_TR} SELECT indicator, horizon, R(last) AS q50 FROM mom, {_HS}")
def baseline_persistence(spark, d):
    return forecast.persistence(obs_orders(spark, d), ORIGIN, H)


@query(f"{_TR}, f AS (SELECT indicator, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM tr GROUP BY indicator) SELECT indicator, horizon, R(a + b * (horizon + {ORIGIN})) AS q50 FROM f, {_HS}")
def baseline_trend(spark, d):
    return forecast.linear_trend(obs_orders(spark, d), ORIGIN, H)


_RW = f"rw AS (SELECT indicator, arg_max(value, t) AS last, (arg_max(value, t) - arg_min(value, t)) / (count(*) - 1) AS step FROM tr GROUP BY indicator)"


@query(f"{_TR}, {_RW} SELECT indicator, horizon, R(last + horizon * step) AS q50 FROM rw, {_HS}")
def baseline_rw_drift(spark, d):
    return forecast.walk_drift(obs_orders(spark, d), ORIGIN, H)


_SES = """o AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY t) AS i FROM tr),
ses AS (SELECT indicator, i, value AS level FROM o WHERE i = 1 UNION ALL SELECT o.indicator, o.i, ses.level + 3e-1 * (o.value - ses.level) FROM ses JOIN o ON o.indicator = ses.indicator AND o.i = ses.i + 1),
sl AS (SELECT indicator, arg_max(level, i) AS level FROM ses GROUP BY indicator)"""
_RTR = _TR.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{_RTR}, {_SES} SELECT indicator, horizon, R(level) AS q50 FROM sl, {_HS}")
def baseline_ses(spark, d):
    return forecast.smoothing(obs_orders(spark, d), ORIGIN, H)


@query(f"""{_RTR}, {_SES}, {_RW}, f AS (SELECT indicator, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM tr GROUP BY indicator),
u AS (SELECT indicator, horizon, last AS q50, 1 AS m FROM mom, {_HS} UNION ALL SELECT indicator, horizon, a + b * (horizon + {ORIGIN}), 2 FROM f, {_HS} UNION ALL SELECT indicator, horizon, last + horizon * step, 3 FROM rw, {_HS} UNION ALL SELECT indicator, horizon, level, 4 FROM sl, {_HS})
SELECT indicator, horizon, R(avg(q50)) AS q50, count(DISTINCT m) AS n_models FROM u GROUP BY ALL""")
def baseline_equal_weight(spark, d):
    o = obs_orders(spark, d)
    models = {"persistence": forecast.persistence, "trend": forecast.linear_trend, "walk": forecast.walk_drift, "smoothing": forecast.smoothing}
    return combine.ensemble_equal({k: f(o, ORIGIN, H) for k, f in models.items()}, ("q50",))


@query(f"{_TR} SELECT indicator, n, R(drift) AS drift, R(last) AS last, R(sd_state) AS sd_state, R(sd_obs) AS sd_obs FROM mom")
def ll_moments(spark, d):
    return forecast.moments(forecast.train(obs_orders(spark, d), ORIGIN))


_KF = """kf{n} AS (SELECT g.indicator, g.q, 1 AS i, o.value AS a, 1e0 + g.q AS p, 0e0 AS s, 0e0 AS l FROM {g} g JOIN o ON o.indicator = g.indicator AND o.i = 1
UNION ALL SELECT k.indicator, k.q, k.i + 1, k.a + k.p / (k.p + 1e0) * (o.value - k.a), k.p * (1e0 - k.p / (k.p + 1e0)) + k.q, k.s + (o.value - k.a) * (o.value - k.a) / (k.p + 1e0), k.l + ln(k.p + 1e0) FROM kf{n} k JOIN o ON o.indicator = k.indicator AND o.i = k.i + 1),
e{n} AS (SELECT * FROM (SELECT *, max(i) OVER (PARTITION BY indicator) AS n FROM kf{n}) WHERE i = n),
b{n} AS (SELECT * FROM (SELECT *, s / (n - 1) AS s2, row_number() OVER (PARTITION BY indicator ORDER BY (n - 1) * ln(s / (n - 1)) + l, q) AS k FROM e{n}) WHERE k = 1)"""


@query(f"""{_RTR}, o AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY t) AS i FROM tr),
g1 AS (SELECT indicator, pow(1e1, -6e0 + x * {num(12 / 60)}) AS q FROM mom, range(0, 61) r(x) WHERE n >= 5), {_KF.format(n=1, g='g1')},
g2 AS (SELECT indicator, pow(1e1, log10(q) - {num(0.2)} + x * {num(24 / 60 / 60)}) AS q FROM b1, range(0, 61) r(x)), {_KF.format(n=2, g='g2')}
SELECT indicator, horizon, R(a - {num(Z95)} * sqrt(s2 * (p + (horizon - 1) * q + 1))) AS q05, R(a) AS q50, R(a + {num(Z95)} * sqrt(s2 * (p + (horizon - 1) * q + 1))) AS q95 FROM b2, {_HS}""", 2)
def ll_kalman(spark, d):
    return forecast.local_level(obs_orders(spark, d), ORIGIN, H)


@query(f"WITH {OBS}, {mom()}, {fc()} SELECT indicator, horizon, R(q05) AS q05, R(q50) AS q50, R(q95) AS q95 FROM fc")
def fsm_moments_quantiles(spark, d):
    return tb.fcst(spark, d)


@query(f"WITH {OBS}, {mom()}, {fc(0.2 * 4.0)} SELECT indicator, horizon, R(q05) AS q05, R(q50) AS q50, R(q95) AS q95 FROM fc")
def fsm_shock_moments(spark, d):
    return forecast.shock_moments(obs_orders(spark, d), ORIGIN, H)


N_PATHS = 10_000


def _sim(spark, d, rate=0.2, seed=12345, h=H):
    m = forecast.moments(forecast.train(obs_orders(spark, d), ORIGIN)).withColumn("no", F.substring(KEY, 1, 1).cast("long"))
    return forecast.paths(m, N_PATHS, h, seed=seed, rate=rate)


def _sim_sql(seed=12345, rate=0.2):
    u = lambda s: forecast.uniform_sql(f"({seed} + no * 7368787 + path * 7919 + horizon * 104729 + {s} * 15485863)", "duckdb")
    normal = lambda s: f"sqrt(-2e0 * ln({u(s)})) * cos(2e0 * pi() * {u(s + 1)})"
    shock = f" + sqrt({forecast.poisson_sql(u(5), rate)}) * 2e0 * sd_state * {normal(6)}" if rate else ""
    return f"""c{seed} AS (SELECT mom.*, CAST(substr(indicator, 1, 1) AS BIGINT) AS no, path, horizon FROM mom, (SELECT CAST(p AS BIGINT) AS path FROM range(0, {N_PATHS}) r(p)), {_HS}),
sim{seed} AS (SELECT indicator, path, horizon, last + sum(drift + sd_state * {normal(1)}{shock}) OVER (PARTITION BY indicator, path ORDER BY horizon) + sd_obs * {normal(3)} AS y FROM c{seed})"""


@query(f"{_TR}, {_sim_sql()} SELECT indicator, horizon, R(quantile_cont(y, 5e-2)) AS q05, R(quantile_cont(y, 5e-1)) AS q50, R(quantile_cont(y, 9.5e-1)) AS q95 FROM sim12345 GROUP BY ALL", 2)
def fsm_paths(spark, d):
    return forecast.path_quantiles(_sim(spark, d))


H_LONG = 40


@query(f"{_TR}, {_sim_sql().replace(_HS, _HS.replace(str(H + 1), str(H_LONG + 1)))} SELECT indicator, horizon, R(quantile_cont(y, 5e-2)) AS q05, R(quantile_cont(y, 5e-1)) AS q50, R(quantile_cont(y, 9.5e-1)) AS q95 FROM sim12345 GROUP BY ALL", 2)
def fsm_paths_long(spark, d):
    return forecast.path_quantiles(_sim(spark, d, h=H_LONG))


@query(f"{_TR}, {_sim_sql().replace(_HS, _HS.replace(str(H + 1), str(H_LONG + 1)))} SELECT indicator, horizon, R(quantile_cont(y, 5e-2)) AS q05, R(quantile_cont(y, 5e-1)) AS q50, R(quantile_cont(y, 9.5e-1)) AS q95, horizon <= 15 AS scored FROM sim12345 GROUP BY ALL", 2)
def fsm_scored_and_scenario(spark, d):
    return forecast.scored_and_scenario(_sim(spark, d, h=H_LONG), H)


@query(f"""{_TR}, {_sim_sql()}, {_sim_sql(777, 0.0)}, tp AS (SELECT i.indicator, s.path, s.horizon, s.y AS x FROM sim777 s, (SELECT DISTINCT indicator FROM sim777) i WHERE s.indicator = '1-URGENT'),
a AS (SELECT *, row_number() OVER (PARTITION BY indicator, horizon ORDER BY y, path) AS r FROM sim12345), b AS (SELECT *, row_number() OVER (PARTITION BY indicator, horizon ORDER BY x, path) AS r FROM tp)
SELECT a.indicator, b.path, a.horizon, R(a.y) AS y FROM a JOIN b ON a.indicator = b.indicator AND a.horizon = b.horizon AND a.r = b.r""", 2)
def ecc_reorder(spark, d):
    template = _sim(spark, d, 0.0, 777).where(f"{KEY} = '{PRIORITIES[0]}'").select("path", "horizon", F.col("y").alias("x"))
    template = template.withColumn(KEY, F.explode(F.array(*[F.lit(p) for p in PRIORITIES])))
    return forecast.ecc_reorder(_sim(spark, d), template)


@query(f"{_TR}, {_sim_sql()} SELECT indicator, horizon, R(avg(CASE WHEN y < last * 9.8e-1 THEN 1e0 ELSE 0e0 END)) AS rate, quantile_cont(y, 5e-1) < max(last) * 9.8e-1 AS flag FROM sim12345 JOIN mom USING (indicator) GROUP BY ALL", 6)
def event_probs(spark, d):
    last = forecast.train(obs_orders(spark, d), ORIGIN).groupBy(KEY).agg((F.max_by("value", "t") * 0.98).alias("threshold"))
    return forecast.event_rates(_sim(spark, d).join(last, KEY))


def _jump_sql(seed=12345, rate=0.2, df=4):
    u = lambda s: forecast.uniform_sql(f"({seed} + no * 7368787 + path * 7919 + horizon * 104729 + {s} * 15485863)", "duckdb")
    noise = f"sqrt(-2e0 * ln({u(1)})) * cos(2e0 * pi() * {u(2)})"
    return f"""zm AS (SELECT *, avg(value) OVER (PARTITION BY indicator) AS mean, stddev_samp(value) OVER (PARTITION BY indicator) AS sd FROM tr),
zd AS (SELECT *, (value - mean) / sd AS z, (value - mean) / sd - lag((value - mean) / sd) OVER (PARTITION BY indicator ORDER BY t) AS dz FROM zm),
zs AS (SELECT indicator, CAST(substr(indicator, 1, 1) AS BIGINT) AS no, max(mean) AS mean, max(sd) AS sd, coalesce(avg(dz), 0) AS drift, greatest(coalesce(stddev_samp(dz), 1e-1), 1e-1) AS step, arg_max(z, t) AS last FROM zd GROUP BY indicator),
zc AS (SELECT zs.*, path, horizon FROM zs, (SELECT CAST(p AS BIGINT) AS path FROM range(0, {N_PATHS}) r(p)), {_HS}),
zp AS (SELECT indicator, path, horizon, mean + sd * (last + sum(drift + step * ({noise} + CASE WHEN {forecast.poisson_sql(u(5), rate)} > 0 THEN {forecast.jump_sql(u, df)} ELSE 0e0 END)) OVER (PARTITION BY indicator, path ORDER BY horizon)) AS y FROM zc)"""


@query(f"{_TR}, {_jump_sql()} SELECT indicator, horizon, R(quantile_cont(y, 5e-2)) AS q05, R(quantile_cont(y, 5e-1)) AS q50, R(quantile_cont(y, 9.5e-1)) AS q95 FROM zp GROUP BY ALL", 2)
def jump_paths(spark, d):
    m = forecast.standardised_steps(forecast.train(obs_orders(spark, d), ORIGIN)).withColumn("no", F.substring(KEY, 1, 1).cast("long"))
    return forecast.path_quantiles(forecast.jump_paths(m, N_PATHS, H))


@query(f"""{_RTR}, o AS (SELECT indicator, (value - avg(value) OVER p) / stddev_samp(value) OVER p AS z, avg(value) OVER p AS mean, stddev_samp(value) OVER p AS sd, row_number() OVER (PARTITION BY indicator ORDER BY t) AS i FROM tr WINDOW p AS (PARTITION BY indicator)),
lt AS (SELECT o.indicator, o.mean, o.sd, o.i, o.z AS l, o.z - a.z AS b, 2e-1 AS p FROM o JOIN o a ON a.indicator = o.indicator AND a.i = 1 WHERE o.i = 2
UNION ALL SELECT lt.indicator, lt.mean, lt.sd, o.i, o.z, lt.b + lt.p / (lt.p + 1e-1) * (o.z - lt.l - lt.b), lt.p + 1e-1 - lt.p * lt.p / (lt.p + 1e-1) FROM lt JOIN o ON o.indicator = lt.indicator AND o.i = lt.i + 1),
e AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY i DESC) AS k FROM lt)
SELECT indicator, horizon, R(mean + sd * (l + horizon * b) - {num(Z95)} * sd * sqrt(horizon)) AS q05, R(mean + sd * (l + horizon * b)) AS q50, R(mean + sd * (l + horizon * b) + {num(Z95)} * sd * sqrt(horizon)) AS q95 FROM e, {_HS} WHERE k = 1""", 2)
def local_trend(spark, d):
    return forecast.local_trend(obs_orders(spark, d), ORIGIN, H)


# -- calibration ----------------------------------------------------------

_CRIT = "CASE WHEN y = q50 THEN 0e0 WHEN y > q50 THEN (y - q50) / (q95 - q50) ELSE (q50 - y) / (q50 - q05) END"
_COV = lambda a: f"CAST(len(list_filter(c, lambda x: x <= {a})) AS DOUBLE) / len(c)"


@query(f"""{BASE.replace('WITH', 'WITH RECURSIVE', 1)}, l AS (SELECT indicator, list({_CRIT}) AS c FROM pts GROUP BY indicator),
s AS (SELECT indicator, c, 0 AS k, 2.5e-1 AS lo, 8e0 AS hi, 1e0 AS best, abs({_COV('1e0')} - 9e-1) AS err, {_COV('1e0')} AS before FROM l UNION ALL
 SELECT indicator, c, k + 1, CASE WHEN v >= 9e-1 THEN lo ELSE m END, CASE WHEN v >= 9e-1 THEN m ELSE hi END, CASE WHEN abs(v - 9e-1) < err THEN m ELSE best END, least(err, abs(v - 9e-1)), before
 FROM (SELECT *, (lo + hi) / 2e0 AS m, {_COV('(lo + hi) / 2e0')} AS v FROM s WHERE k < 30)),
a AS (SELECT indicator, c, before, CASE WHEN abs(before - 9e-1) <= 5e-3 THEN 1e0 ELSE best END AS alpha FROM s WHERE k = 30)
SELECT indicator, R(alpha) AS alpha, R(before) AS coverage_before, R({_COV('alpha')}) AS coverage_after FROM a""", 6)
def sigma_calibrate(spark, d):
    return calibrate.spread_search(points(spark, d))


@query(f"""{BASE} SELECT indicator, count(CASE WHEN y < least(q05, q95) OR y > greatest(q05, q95) THEN 1 END) AS misses, R(coalesce(max(CASE WHEN y < least(q05, q95) OR y > greatest(q05, q95) THEN abs(y - q50) / (abs(q95 - q50) + 1e-12) END) * 1.01e0, 1e0)) AS alpha FROM pts GROUP BY indicator""", 6)
def alpha_min(spark, d):
    return calibrate.least_alpha(points(spark, d))


@query(f"""{BASE}, f AS (SELECT indicator, CASE WHEN count(*) >= 3 AND var_pop(q50) > 0 THEN regr_intercept(y, q50) ELSE 0 END AS a, CASE WHEN count(*) >= 3 AND var_pop(q50) > 0 THEN regr_slope(y, q50) ELSE 1 END AS b FROM pts GROUP BY indicator),
m AS (SELECT fc.indicator, horizon, coalesce(a, 0) + coalesce(b, 1) * q50 AS mu, {SM} AS s FROM fc LEFT JOIN f USING (indicator)) SELECT indicator, horizon, R(mu - {num(Z95)} * s) AS q05, R(mu) AS q50, R(mu + {num(Z95)} * s) AS q95 FROM m""", 2)
def mean_calibrate(spark, d):
    return calibrate.apply_mean(tb.fcst(spark, d), calibrate.mean_fit(points(spark, d)))


@query(f"{BASE}, b AS (SELECT indicator, avg(y - q50) AS delta FROM pts GROUP BY indicator) SELECT fc.indicator, horizon, R(q05 + coalesce(delta, 0)) AS q05, R(q50 + coalesce(delta, 0)) AS q50, R(q95 + coalesce(delta, 0)) AS q95 FROM fc LEFT JOIN b USING (indicator)")
def bias_correct(spark, d):
    return calibrate.shift(tb.fcst(spark, d), calibrate.bias(points(spark, d)))


_MS = "* CASE WHEN sd_mid > 0 THEN sd_obs / sd_mid ELSE 1e0 END + last - mid"


@query(f"""WITH {OBS}, {mom()}, {fc()}, s AS (SELECT indicator, stddev_pop(value) AS sd_obs, arg_max(value, t) AS last FROM tr GROUP BY indicator),
m AS (SELECT indicator, stddev_pop(q50) AS sd_mid, arg_min(q50, horizon) AS mid FROM fc GROUP BY indicator)
SELECT indicator, horizon, R(q05 {_MS}) AS q05, R(q50 {_MS}) AS q50, R(q95 {_MS}) AS q95 FROM fc JOIN s USING (indicator) JOIN m USING (indicator)""", 2)
def match_sample(spark, d):
    return calibrate.match_sample(tb.fcst(spark, d), obs_orders(spark, d), ORIGIN)


_BAND = lambda z, sign: f"R(q50 + CASE WHEN indicator = '2-HIGH' THEN 8.5e-1 ELSE 1e0 END * {sign}{num(z)} * (q95 - q05) / (2e0 * {num(Z95)}))"


_AL = f"al AS (SELECT indicator, CASE WHEN abs(before - 9e-1) <= 5e-3 THEN 1e0 ELSE best END AS alpha, before, c FROM s WHERE k = 30)"
_SEARCH = f"""l AS (SELECT indicator, list({_CRIT}) AS c FROM pts GROUP BY indicator),
s AS (SELECT indicator, c, 0 AS k, 2.5e-1 AS lo, 8e0 AS hi, 1e0 AS best, abs({_COV('1e0')} - 9e-1) AS err, {_COV('1e0')} AS before FROM l UNION ALL
 SELECT indicator, c, k + 1, CASE WHEN v >= 9e-1 THEN lo ELSE m END, CASE WHEN v >= 9e-1 THEN m ELSE hi END, CASE WHEN abs(v - 9e-1) < err THEN m ELSE best END, least(err, abs(v - 9e-1)), before
 FROM (SELECT *, (lo + hi) / 2e0 AS m, {_COV('(lo + hi) / 2e0')} AS v FROM s WHERE k < 30))"""
_ALLF = f"fa AS (SELECT * FROM fc UNION ALL SELECT l_returnflag || l_linestatus, horizon, avg(l_quantity), avg(l_quantity), avg(l_quantity) FROM lineitem, {_HS} GROUP BY ALL)"


def _all_forecasts(spark, d):
    """The forecast, and flat ones of series that have no truth."""
    li = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias(KEY)).agg(F.avg("l_quantity").alias("m"))
    flat = forecast._horizons(li, H).select(KEY, "horizon", F.col("m").alias("q05"), F.col("m").alias("q50"), F.col("m").alias("q95"))
    return tb.fcst(spark, d).union(flat)


@query(f"""{BASE.replace('WITH', 'WITH RECURSIVE', 1)}, {_SEARCH}, {_AL}, {_ALLF} SELECT i.indicator, R(coalesce(alpha, 1e0)) AS alpha, R(before) AS coverage_before, R({_COV('alpha')}) AS coverage_after FROM (SELECT DISTINCT indicator FROM fa) i LEFT JOIN al USING (indicator)""", 6)
def sigma_scales(spark, d):
    return calibrate.sigma_scales(_all_forecasts(spark, d), points(spark, d))


@query(f"""{BASE.replace('WITH', 'WITH RECURSIVE', 1)}, {_SEARCH}, {_AL}, {_ALLF} SELECT fa.indicator, horizon, R(q50 + coalesce(alpha, 1e0) * (q05 - q50)) AS q05, R(q50) AS q50, R(q50 + coalesce(alpha, 1e0) * (q95 - q50)) AS q95, R(coalesce(alpha, 1e0)) AS alpha FROM fa LEFT JOIN al USING (indicator)""", 3)
def sigma_apply(spark, d):
    fcst = _all_forecasts(spark, d)
    return calibrate.scale_spread(fcst, calibrate.sigma_scales(fcst, points(spark, d)))


@query(f"WITH {OBS}, {mom()}, {fc()} SELECT indicator, horizon, R(q50) AS q50, {_BAND(Z75, '-')} AS lo_50, {_BAND(Z75, '')} AS hi_50, {_BAND(Z95, '-')} AS lo_90, {_BAND(Z95, '')} AS hi_90 FROM fc")
def rescale(spark, d):
    return calibrate.rescale_bands(tb.fcst(spark, d), 0.85, "2-HIGH")


# -- scores ---------------------------------------------------------------

_COVP = f"""cp AS (SELECT indicator, t, horizon, 5e-1 AS level, CAST({between_sql('y', f'q50 - {num(Z75)} * {SU}', f'q50 + {num(Z75)} * {SU}')} AS BIGINT) AS covered FROM pts
UNION ALL SELECT indicator, t, horizon, 9e-1, CAST({between_sql('y', f'q50 - {num(Z95)} * {SU}', f'q50 + {num(Z95)} * {SU}')} AS BIGINT) FROM pts)"""
_SUM = f"{_COVP}, cs AS (SELECT indicator, level, CAST(sum(covered) AS BIGINT) AS covered, count(*) AS total, sum(covered) / CAST(count(*) AS DOUBLE) AS coverage_rate FROM cp GROUP BY ALL)"
_PIT = f"pt AS (SELECT *, {phi_sql(f'((y - q50) / {SU})')} AS pit FROM pts)"


@query(f"{BASE}, {_COVP} SELECT indicator, t, horizon, R(level) AS level, covered FROM cp", 6)
def verify_points(spark, d):
    return score.coverage_points(points(spark, d))


@query(f"{BASE}, {_SUM} SELECT indicator, R(level) AS level, covered, total, R(coverage_rate) AS coverage_rate FROM cs", 6)
def verify_summary(spark, d):
    return score.coverage_summary(score.coverage_points(points(spark, d)))


@query(f"{BASE}, {_PIT} SELECT indicator, t, horizon, R(pit) AS pit FROM pt", 6)
def pit(spark, d):
    return score.pit(points(spark, d)).select(KEY, "t", "horizon", "pit")


@query(f"{BASE} SELECT indicator, CAST({ORIGIN} AS BIGINT) AS origin, horizon, R(y) AS y, R(q50) AS mu, R({SM}) AS sigma, R({crps_sql('y', 'q50', SM)}) AS crps FROM pts")
def crps(spark, d):
    return score.crps(points(spark, d)).select(KEY, "origin", "horizon", "y", "mu", "sigma", "crps")


_ORIGINS = (36, 48, 60)
#: Of the batch: eight, as far as the tables reach.
_BATCH_ORIGINS = (24, 30, 36, 42, 48, 54, 60, 66)


def _rolled(select: str, origins=_ORIGINS) -> str:
    """``select`` over ``ro``: the drift forecast fitted apart at every origin, with the truth ``y``; one fit for each in SQL."""
    parts = ", ".join(f"r{o} AS (WITH {mom(o)}, {fc()} SELECT fc.*, CAST({o} AS BIGINT) AS origin, {o} + horizon AS t, obs.value AS y FROM fc JOIN obs ON obs.indicator = fc.indicator AND obs.t = {o} + horizon WHERE obs.value IS NOT NULL)" for o in origins)
    return f"WITH RECURSIVE {OBS}, {parts}, ro AS ({' UNION ALL '.join(f'SELECT * FROM r{o}' for o in origins)}){select}"


def rolled(spark, d, origins=_ORIGINS):
    o = obs_orders(spark, d)
    return calibrate.join_rolling(forecast.rolling(o, origins, forecast.drift_forecast, H), o)


@query(_rolled(f" SELECT indicator, origin, count(*) AS n, R(avg({crps_sql('y', 'q50', SM)})) AS crps FROM ro GROUP BY ALL"), 2)
def multi_origin_crps(spark, d):
    return score.crps(rolled(spark, d)).groupBy(KEY, "origin").agg(F.count("*").alias("n"), F.avg("crps").alias("crps"))


_BATCH = f""", l AS (SELECT indicator, origin, list({{crit}}) AS c FROM ro GROUP BY ALL),
s AS (SELECT indicator, origin, c, 0 AS k, 2.5e-1 AS lo, 8e0 AS hi, 1e0 AS best, abs({{cov1}} - 9e-1) AS err, {{cov1}} AS before FROM l UNION ALL
 SELECT indicator, origin, c, k + 1, CASE WHEN v >= 9e-1 THEN lo ELSE m END, CASE WHEN v >= 9e-1 THEN m ELSE hi END, CASE WHEN abs(v - 9e-1) < err THEN m ELSE best END, least(err, abs(v - 9e-1)), before
 FROM (SELECT *, (lo + hi) / 2e0 AS m, {{covm}} AS v FROM s WHERE k < 30)),
al AS (SELECT indicator, origin, CASE WHEN abs(before - 9e-1) <= 5e-3 THEN 1e0 ELSE best END AS alpha FROM s WHERE k = 30),
rc AS (SELECT ro.indicator, ro.origin, alpha, y, q50 + alpha * (q05 - q50) AS q05, q50, q50 + alpha * (q95 - q50) AS q95 FROM ro JOIN al USING (indicator, origin)),
u AS (SELECT indicator, origin, 5e-1 AS level, {between_sql('y', f'q50 - {num(Z75)} * {SU}', f'q50 + {num(Z75)} * {SU}')} AS c FROM rc UNION ALL SELECT indicator, origin, 9e-1, {between_sql('y', f'q50 - {num(Z95)} * {SU}', f'q50 + {num(Z95)} * {SU}')} FROM rc)
SELECT indicator, origin, R(level) AS level, CAST(sum(c) AS BIGINT) AS covered, count(*) AS total, R(sum(c) / CAST(count(*) AS DOUBLE)) AS coverage_rate FROM u GROUP BY ALL"""


@query(_rolled(_BATCH.format(crit=_CRIT, cov1=_COV("1e0"), covm=_COV("(lo + hi) / 2e0")), _BATCH_ORIGINS), 6)
def batch_origins(spark, d):
    """Forecast, spread calibration and verification at every origin, in one plan."""
    p = rolled(spark, d, _BATCH_ORIGINS)
    scaled = p.join(calibrate.by_origin(p, calibrate.spread_search).select(KEY, "origin", "alpha"), [KEY, "origin"])
    move = lambda c: (F.col("q50") + F.col("alpha") * (F.col(c) - F.col("q50"))).alias(c)
    scaled = scaled.select(KEY, "origin", "horizon", "t", "y", move("q05"), "q50", move("q95"))
    return calibrate.by_origin(scaled, lambda x: score.coverage_summary(score.coverage_points(x)))


@query(f"""WITH {OBS}, {', '.join(f"t{o} AS (SELECT indicator, regr_slope(value, t) AS b, avg(value) AS m, avg(t) AS c FROM obs WHERE t <= {o} AND value IS NOT NULL GROUP BY indicator HAVING count(*) >= 3)" for o in _ORIGINS)},
f AS ({' UNION ALL '.join(f"SELECT indicator, {o} AS origin, {o} + h AS t, m, b, {o} + h - c AS dx FROM t{o}, range(1, {H + 1}) r(h)" for o in _ORIGINS)}),
e AS (SELECT f.indicator, penalty, count(*) AS n, avg(abs(value - (m + b / (1e0 + penalty) * dx))) AS mae FROM f JOIN obs ON obs.indicator = f.indicator AND obs.t = f.t, (VALUES (5e-2), (1e-1), (2e-1)) p(penalty) WHERE value IS NOT NULL GROUP BY ALL)
SELECT indicator, R(penalty) AS penalty, n, R(mae) AS mae, row_number() OVER (PARTITION BY indicator ORDER BY mae, penalty) = 1 AS best FROM e""", 4)
def penalty_grid(spark, d):
    return forecast.penalty_grid(obs_orders(spark, d), _ORIGINS, H)


@query(f"""{BASE}, e AS (SELECT indicator, list_sort(list(abs(y - q50))) AS e FROM pts GROUP BY indicator), w AS (SELECT indicator, e[CAST(least(ceil((len(e) + 1) * 9e-1 - 1e-9), len(e)) AS BIGINT)] AS w, CAST(len(e) AS BIGINT) AS n FROM e)
SELECT indicator, horizon, R(q50 - w) AS q05, R(q50) AS q50, R(q50 + w) AS q95, n FROM fc JOIN w USING (indicator)""", 2)
def conformal_bands(spark, d):
    return calibrate.conformal(tb.fcst(spark, d), points(spark, d))


@query(f"{BASE}, {_PIT}, k AS (SELECT indicator, pit, row_number() OVER (PARTITION BY indicator ORDER BY pit) AS i, count(*) OVER (PARTITION BY indicator) AS n FROM pt) SELECT indicator, max(n) AS n, R(max(greatest(i / CAST(n AS DOUBLE) - pit, pit - (i - 1) / CAST(n AS DOUBLE)))) AS ks FROM k GROUP BY indicator", 6)
def ks_uniform(spark, d):
    return score.ks_uniform(score.pit(points(spark, d)))


_IN = lambda z: between_sql("y", f"q50 - {num(z)} * {SM}", f"q50 + {num(z)} * {SM}")


@query(f"{BASE} SELECT CASE WHEN grouping(indicator) = 1 THEN 'ALL' ELSE indicator END AS indicator, count(*) AS n, R(avg({_IN(Z75)})) AS cov50, R(avg({_IN(Z95)})) AS cov90 FROM pts GROUP BY GROUPING SETS ((indicator), ())", 6)
def coverage_rollup(spark, d):
    return score.coverage_rollup(points(spark, d))


@query(f"{BASE}, {_PIT}, b AS (SELECT indicator, CAST(least(floor(pit * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM pt GROUP BY ALL) SELECT indicator, bin, n, R(n / sum(n) OVER (PARTITION BY indicator)) AS share, n / sum(n) OVER (PARTITION BY indicator) <= 2e-1 AS ok FROM b", 6)
def reliability_bins(spark, d):
    return score.reliability(score.pit(points(spark, d)))


@query(f"{BASE} SELECT indicator, t, horizon, R(CASE WHEN y <= q05 THEN 5e-2 WHEN y >= q95 THEN 9.5e-1 WHEN y <= q50 THEN 5e-2 + 4.5e-1 * (y - q05) / (q50 - q05) ELSE 5e-1 + 4.5e-1 * (y - q50) / (q95 - q50) END) AS pit FROM pts", 6)
def piecewise_pit(spark, d):
    return score.piecewise_pit(points(spark, d)).select(KEY, "t", "horizon", "pit")


_MBH = f"""w AS (SELECT indicator, horizon, avg(CASE WHEN level = 5e-1 THEN covered END) AS covered_50_rate, avg(CASE WHEN level = 9e-1 THEN covered END) AS covered_90_rate FROM cp GROUP BY ALL),
pp AS (SELECT indicator, horizon, avg(pit) AS pit_mean, CASE WHEN count(pit) > 1 THEN var_samp(pit) END AS pit_var, count(pit) AS pit_n FROM pt GROUP BY ALL)"""


@query(f"{BASE}, {_COVP}, {_PIT}, {_MBH} SELECT w.indicator, w.horizon, R(covered_50_rate) AS covered_50_rate, R(covered_90_rate) AS covered_90_rate, R(pit_mean) AS pit_mean, R(pit_var) AS pit_var, pit_n FROM w LEFT JOIN pp USING (indicator, horizon)", 6)
def metrics_by_horizon(spark, d):
    p = points(spark, d)
    return score.metrics_by_horizon(score.coverage_points(p), score.pit(p))


@query(f"{BASE}, {_SUM} SELECT indicator, R(level) AS level, covered, total, R(coverage_rate) AS coverage_rate, R(abs(coverage_rate - level)) AS loss FROM cs", 6)
def coverage_loss(spark, d):
    return score.coverage_loss(score.coverage_summary(score.coverage_points(points(spark, d))))


@query(f"""{BASE}, b AS (SELECT indicator, avg(pow({phi_sql(f'((1.5e5 - q50) / {SM})')} - CASE WHEN y < 1.5e5 THEN 1e0 ELSE 0e0 END, 2)) AS brier, count(*) AS n, avg({crps_sql('y', 'q50', SM)}) AS crps FROM pts GROUP BY indicator) SELECT indicator, n, R(brier) AS brier, R(crps) AS crps, R(5e-1 * crps + 5e-1 * brier) AS composite FROM b""")
def brier_composite(spark, d):
    p = points(spark, d)
    c = score.crps(p).groupBy(KEY).agg(F.avg("crps").alias("crps"))
    return score.event_brier(p, F.lit(1.5e5)).join(c, KEY).withColumn("composite", 0.5 * F.col("crps") + 0.5 * F.col("brier"))


_EVENTS = [("urgent_low", "1-URGENT", 145000.0, False), ("high_up", "2-HIGH", 150000.0, True), ("medium_low", "3-MEDIUM", 155000.0, False), ("open_up", "4-NOT SPECIFIED", 145000.0, True), ("low_low", "5-LOW", 150000.0, False)]
_EV = ", ".join(f"('{e}', '{i}', {num(t)}, {str(a).upper()})" for e, i, t, a in _EVENTS)
_EVP = f"ev AS (SELECT * FROM (VALUES {_EV}) v(event, indicator, threshold, above)), ep AS (SELECT pts.*, event, CASE WHEN above THEN 1 - {phi_sql(f'((threshold - q50) / {SM})')} ELSE {phi_sql(f'((threshold - q50) / {SM})')} END AS p, CASE WHEN above = (y >= threshold) THEN 1e0 ELSE 0e0 END AS o FROM pts JOIN ev USING (indicator))"


def _catalogue(spark):
    return spark.createDataFrame(_EVENTS, "event string, indicator string, threshold double, above boolean")


@query(f"{BASE}, {_EVP} SELECT event, indicator, horizon, count(*) AS n, R(avg(p)) AS p, R(avg(o)) AS rate, R(avg((p - o) * (p - o))) AS brier FROM ep WHERE horizon IN (1, 3, 5, 10, 15) GROUP BY ALL", 6)
def event_catalogue(spark, d):
    return score.event_catalogue(points(spark, d), _catalogue(spark))


@query(f"{BASE}, {_EVP}, b AS (SELECT CAST(greatest(0, least(floor(p * 10), 9)) AS BIGINT) AS bin, count(*) AS n, avg(p) AS p, avg(o) AS rate FROM ep GROUP BY ALL) SELECT bin, n, R(p) AS p, R(rate) AS rate, abs(p - rate) <= 1e-1 AS ok FROM b", 6)
def reliability_curve(spark, d):
    return score.reliability_curve(points(spark, d), _catalogue(spark))


@query(f"{BASE}, {_COVP}, c3 AS (SELECT * FROM cp UNION ALL SELECT indicator, t, horizon, 8e-1, CAST({between_sql('y', f'q50 - {num(Z90)} * {SU}', f'q50 + {num(Z90)} * {SU}')} AS BIGINT) FROM pts) SELECT indicator, R(level) AS level, CAST(sum(covered) AS BIGINT) AS covered, count(*) AS total, R(sum(covered) / CAST(count(*) AS DOUBLE)) AS coverage_rate FROM c3 GROUP BY ALL", 6)
def coverage_inner80(spark, d):
    return score.coverage_summary(score.coverage_points(points(spark, d), inner80=True))


_GATE = f"""{BASE}, {_EVP}, f2 AS (SELECT indicator, CAST(h AS BIGINT) AS horizon, last + h * drift AS mu, sqrt(h * sd_state * sd_state * 1.8e0 + sd_obs * sd_obs) AS s FROM mom, range(1, {H + 1}) r(h)),
p2 AS (SELECT indicator, horizon, pts.y, mu - {num(Z95)} * s AS q05, mu AS q50, mu + {num(Z95)} * s AS q95 FROM f2 JOIN pts USING (indicator, horizon)),
e2 AS (SELECT p2.*, CASE WHEN above THEN 1 - {phi_sql(f'((threshold - q50) / {SM})')} ELSE {phi_sql(f'((threshold - q50) / {SM})')} END AS p, CASE WHEN above = (y >= threshold) THEN 1e0 ELSE 0e0 END AS o FROM p2 JOIN ev USING (indicator)),
m1 AS (SELECT indicator, avg((p - o) * (p - o)) FILTER (WHERE horizon IN (1, 3, 5, 10, 15)) AS brier, avg({crps_sql('y', 'q50', SM)}) AS crps, abs(avg({between_sql('y', 'q05', 'q95')}) - 9e-1) AS loss FROM ep GROUP BY indicator),
m2 AS (SELECT indicator, avg((p - o) * (p - o)) FILTER (WHERE horizon IN (1, 3, 5, 10, 15)) AS brier, avg({crps_sql('y', 'q50', SM)}) AS crps, abs(avg({between_sql('y', 'q05', 'q95')}) - 9e-1) AS loss FROM e2 GROUP BY indicator),
p3 AS (SELECT pts.indicator, pts.y, (pts.q05 + p2.q05) / 2 AS q05, (pts.q50 + p2.q50) / 2 AS q50, (pts.q95 + p2.q95) / 2 AS q95 FROM pts JOIN p2 USING (indicator, horizon)),
m3 AS (SELECT indicator, avg({crps_sql('y', 'q50', SM)}) AS crps FROM p3 GROUP BY indicator),
v AS (SELECT m1.indicator, CAST(m1.crps < m2.crps AS BIGINT) + CAST(m1.brier < m2.brier AS BIGINT) + CAST(m1.loss < m2.loss AS BIGINT) AS votes, m1.loss AS coverage_error, 1 - m1.crps / m3.crps AS skill FROM m1 JOIN m2 USING (indicator) JOIN m3 USING (indicator))"""


@query(f"{_GATE} SELECT indicator, votes, R(coverage_error) AS coverage_error, R(skill) AS skill, votes >= 2 AND coverage_error <= 5e-2 AND skill >= 0 AS accepted FROM v", 6)
def acceptance_gate(spark, d):
    """Votes against the shock model, skill against the equal-weight mean of both."""
    o = obs_orders(spark, d)

    def measured(fcst, name):
        p = calibrate.join_truth(fcst, o, ORIGIN)
        events = score.event_catalogue(p, _catalogue(spark)).groupBy(KEY).agg((F.sum(F.col("brier") * F.col("n")) / F.sum("n")).alias(f"brier_{name}"))
        cover = p.groupBy(KEY).agg(F.abs(F.avg(F.expr(between_sql("y", "q05", "q95"))) - 0.9).alias(f"loss_{name}"))
        return score.crps(p).groupBy(KEY).agg(F.avg("crps").alias(f"crps_{name}")).join(events, KEY).join(cover, KEY)

    model, base = tb.fcst(spark, d), forecast.shock_moments(o, ORIGIN, H)
    mean = combine.ensemble_equal({"model": model, "base": base}, ("q05", "q50", "q95"))
    equal = score.crps(calibrate.join_truth(mean, o, ORIGIN)).groupBy(KEY).agg(F.avg("crps").alias("crps_equal"))
    both = measured(model, "model").join(measured(base, "base"), KEY).join(equal, KEY)
    both = both.withColumn("coverage_error", F.col("loss_model")).withColumn("skill", 1 - F.col("crps_model") / F.col("crps_equal"))
    return govern.acceptance(both).select(KEY, "votes", "coverage_error", "skill", "accepted")


@query(f"{BASE}, {_SUM} SELECT indicator, R(level) AS level, R(coverage_rate) AS coverage_rate, abs(coverage_rate - level) <= 1.00000000001e-1 AS within FROM cs", 6)
def coverage_gate(spark, d):
    return score.coverage_gate(score.coverage_summary(score.coverage_points(points(spark, d)))).select(KEY, "level", "coverage_rate", "within")


@query(f"{BASE}, {_SUM} SELECT indicator, R(max(CASE WHEN level = 5e-1 THEN coverage_rate END)) AS coverage_50, R(max(CASE WHEN level = 9e-1 THEN coverage_rate END)) AS coverage_90 FROM cs GROUP BY indicator", 6)
def coverage_pivot(spark, d):
    return score.coverage_pivot(score.coverage_summary(score.coverage_points(points(spark, d))))


@query(f"""{BASE}, {_SUM}, {_EVP}, c AS (SELECT indicator, avg({crps_sql('y', 'q50', SM)}) AS crps FROM pts GROUP BY indicator), br AS (SELECT indicator, avg((p - o) * (p - o)) AS brier FROM ep WHERE horizon IN (1, 3, 5, 10, 15) GROUP BY indicator)
SELECT cs.indicator, R(level) AS level, covered, total, R(coverage_rate) AS coverage_rate, R(crps) AS crps, R(brier) AS brier FROM cs LEFT JOIN c USING (indicator) LEFT JOIN br USING (indicator)""", 4)
def scorecard(spark, d):
    p = points(spark, d)
    events = score.event_catalogue(p, _catalogue(spark))
    briers = events.groupBy(KEY).agg((F.sum(F.col("brier") * F.col("n")) / F.sum("n")).alias("brier"))
    return score.scorecard(score.coverage_summary(score.coverage_points(p)), score.crps(p), briers)


# -- statistics -----------------------------------------------------------

_ZP = lambda x, n, p: f"2e0 * (1e0 - {phi_sql(f'abs(({x} / CAST({n} AS DOUBLE) - {p}) / sqrt({p} * (1e0 - {p}) / {n}))')})"
_W = lambda sign: f"((x / CAST(n AS DOUBLE)) + {num(Z975**2)} / (2e0 * n)) / (1e0 + {num(Z975**2)} / n) {sign} {num(Z975)} * sqrt((x / CAST(n AS DOUBLE)) * (1e0 - x / CAST(n AS DOUBLE)) / n + {num(Z975**2)} / (4e0 * n * n)) / (1e0 + {num(Z975**2)} / n)"
_SIG = f"""g AS (SELECT indicator, level, covered AS x, total AS n, {_ZP('covered', 'total', 'level')} AS p_value FROM cs), k AS (SELECT *, greatest(0e0, {_W('-')}) AS wilson_low, least(1e0, {_W('+')}) AS wilson_high, row_number() OVER (ORDER BY p_value, indicator, level) AS i, count(*) OVER () AS m FROM g),
b AS (SELECT *, max(CASE WHEN p_value <= 5e-2 * i / m THEN i END) OVER () AS cut FROM k)"""


@query(f"{BASE}, {_SUM}, {_SIG} SELECT indicator, R(level) AS level, x, n, R(p_value) AS p_value, R(wilson_low) AS wilson_low, R(wilson_high) AS wilson_high, coalesce(i <= cut, FALSE) AS bh_reject, level BETWEEN wilson_low AND wilson_high AS within_ci FROM b", 6)
def significance(spark, d):
    s = score.coverage_summary(score.coverage_points(points(spark, d))).select(KEY, "level", F.col("covered").alias("x"), F.col("total").alias("n"))
    return stats.significance(s)


@query(f"""{BASE}, {_COVP}, {_PIT}, {_MBH}, cs AS (SELECT indicator, level, CAST(sum(round_even(rate, 0)) AS BIGINT) AS covered, count(*) AS total FROM (SELECT indicator, 5e-1 AS level, covered_50_rate AS rate FROM w UNION ALL SELECT indicator, 9e-1, covered_90_rate FROM w) WHERE rate IS NOT NULL GROUP BY ALL), {_SIG} SELECT indicator, R(level) AS level, x, n, R(p_value) AS p_value, R(wilson_low) AS wilson_low, R(wilson_high) AS wilson_high, coalesce(i <= cut, FALSE) AS bh_reject, level BETWEEN wilson_low AND wilson_high AS within_ci FROM b""", 6)
def significance_from_rates(spark, d):
    p = points(spark, d)
    rates = score.metrics_by_horizon(score.coverage_points(p), score.pit(p))
    return stats.significance(stats.counts_from_rates(rates, {"covered_50_rate": 0.5, "covered_90_rate": 0.9}))


@query("SELECT indicator, level, CAST(sum(round_even(rate, 0)) AS BIGINT) AS x, count(*) AS n FROM (SELECT l_returnflag AS indicator, 5e-1 AS level, l_quantity / 2e0 AS rate FROM lineitem UNION ALL SELECT l_returnflag, 9e-1, l_quantity / 4e0 FROM lineitem) GROUP BY ALL")
def half_even_counts(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias(KEY), (F.col("l_quantity") / 2).alias("a"), (F.col("l_quantity") / 4).alias("b"))
    return stats.counts_from_rates(li, {"a": 0.5, "b": 0.9})


_TESTS = f"g AS (SELECT o_custkey, CAST(sum(CASE WHEN o_totalprice > 2.5e5 THEN 1 ELSE 0 END) AS BIGINT) AS x, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 8), p AS (SELECT *, {_ZP('x', 'n', '5e-1')} AS p_value FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY p_value, o_custkey) AS i, count(*) OVER (PARTITION BY n) AS m FROM p)"


@query(f"WITH {_TESTS} SELECT o_custkey, x, n, R(p_value) AS p_value, coalesce(i <= max(CASE WHEN p_value <= 5e-2 * i / m THEN i END) OVER (PARTITION BY n), FALSE) AS bh_reject FROM k", 6)
def fdr(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_totalprice") > 2.5e5).cast("long")).alias("x"), F.count("*").alias("n")).where("n >= 8")
    return stats.benjamini_hochberg(stats.z_test(o.withColumn("half", F.lit(0.5)), p0="half"), by=("n",)).drop("half")


# -- sources --------------------------------------------------------------

_FC = f"WITH {OBS}, {mom()}, {fc()} SELECT indicator, horizon, R(q05) AS q05, R(q50) AS q50, R(q95) AS q95 FROM fc"


@query(_FC)
def nested_quantiles(spark, d):
    """Quantiles nested by horizon and name, as a document has them, and flattened again."""
    cell = F.create_map(F.lit("q5"), F.col("q05"), F.lit("median"), F.col("q50"), F.lit("q95"), F.col("q95"))
    nested = tb.fcst(spark, d).groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("h"), F.col("horizon").cast("string")).alias("k"), cell.alias("v")))).alias("q"))
    return sources.flatten_quantiles(nested)


@query(_FC)
def alias_columns(spark, d):
    other = {KEY: "Series", "horizon": "Lead", "q05": "P05", "q50": "Median", "q95": "quantile_95"}
    return sources.normalize_quantiles(tb.fcst(spark, d).withColumnsRenamed(other)).select(KEY, "horizon", "q05", "q50", "q95")


@query(_FC)
def csv_round_trip(spark, d):
    """The forecast written to one CSV file and read again."""
    import uuid

    path = f"{sources.shared_folder(spark)}/forecast-{uuid.uuid4().hex}"
    sources.write_csv(tb.fcst(spark, d), path)
    return sources.normalize_quantiles(sources.read_csv(spark, path))


@query(f"WITH {OBS} SELECT indicator, t, R(value) AS value FROM obs", 4)
def series_directory(spark, d):
    """Series written to a folder, a file for each, and read from all files at once."""
    import uuid

    folder = f"{sources.shared_folder(spark)}/series-{uuid.uuid4().hex}"
    year = lambda t: F.concat(F.lpad((t + 1000).cast("string"), 4, "0"), F.lit("-01-01"))
    rows = obs_orders(spark, d).select(KEY, F.col("value"), year(F.col("t")).alias("date"))
    for p in PRIORITIES:
        sources.write_csv(rows.where(F.col(KEY) == p).drop(KEY), f"{folder}/{p[0]}")
    got = sources.read_series_dir(spark, f"{folder}/*/*.csv")
    files = sources.headed_lines(spark, f"{folder}/*/*.csv").select("path").distinct()
    which = F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), F.regexp_extract("path", r"/(\d)/[^/]+$", 1).cast("int"))
    names = files.select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("file"), which.alias("name"))
    return got.join(F.broadcast(names), got[KEY] == names.file).select(F.col("name").alias(KEY), (F.col("t") - 1000).alias("t"), "value")  # a row for each file


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 IN (0, 3) THEN 1 ELSE 0 END AS BIGINT) AS flag, CAST(CASE WHEN o_orderkey % 5 <> 4 THEN o_orderkey % 40 END AS BIGINT) AS horizon FROM orders")
def text_keys(spark, d):
    """Mixed truth values and horizon keys, as tables of runs spell them."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    said = F.element_at(F.array(F.lit(" Yes"), F.lit("no"), F.lit("0"), F.lit("2.5 ")), (k % 4 + 1).cast("int"))
    h = (k % 40).cast("string")
    key = F.when(k % 5 == 0, h).when(k % 5 == 1, F.concat(F.lit("h"), h)).when(k % 5 == 2, F.concat(F.lit(" H"), h)).when(k % 5 == 3, F.concat(h, F.lit(" "))).otherwise(F.concat(F.lit("x"), h))
    return o.select("o_orderkey", boolean_text(said).cast("long").alias("flag"), horizon_key(key).cast("long").alias("horizon"))


# -- combination ----------------------------------------------------------


@query(f"WITH {OBS}, {mom()}, {fc()} SELECT indicator, horizon, R(quantile) AS quantile, R(value) AS value FROM (SELECT indicator, horizon, 5e-2 AS quantile, q05 AS value FROM fc UNION ALL SELECT indicator, horizon, 5e-1, q50 FROM fc UNION ALL SELECT indicator, horizon, 9.5e-1, q95 FROM fc)")
def quantiles_long(spark, d):
    return series.quantiles_long(tb.fcst(spark, d))


@query(f"WITH {OBS}, {mom()}, {fc()} SELECT indicator, horizon, R(q05) AS q05, R(q50) AS q50, R(q95) AS q95 FROM fc")
def quantiles_wide(spark, d):
    return series.quantiles_wide(series.quantiles_long(tb.fcst(spark, d)))


@query(f"""WITH {OBS}, {mom()}, {fc()}, f2 AS ({'SELECT indicator, horizon, mu - Z * s AS q05, mu AS q50, mu + Z * s AS q95 FROM (SELECT indicator, CAST(h AS BIGINT) AS horizon, last + h * drift AS mu, sqrt(h * sd_state * sd_state * 1.8e0 + sd_obs * sd_obs) AS s FROM mom, range(1, 16) r(h))'.replace('Z', num(Z95))})
SELECT indicator, horizon, R(avg(q05)) AS q05, R(avg(q50)) AS q50, R(avg(q95)) AS q95, count(DISTINCT m) AS n_models FROM (SELECT *, 1 AS m FROM fc UNION ALL SELECT *, 2 FROM f2) GROUP BY ALL""")
def ensemble_equal(spark, d):
    o = obs_orders(spark, d)
    return combine.ensemble_equal({"walk": forecast.drift_forecast(o, ORIGIN, H), "shock": forecast.shock_moments(o, ORIGIN, H)})


@query(f"""WITH {OBS}, {mom()}, {fc()}, r AS (SELECT *, q50 - {num(Z75)} * (q95 - q05) / (2e0 * {num(Z95)}) AS lo, q50 + {num(Z75)} * (q95 - q05) / (2e0 * {num(Z95)}) AS hi FROM fc)
SELECT a.indicator AS indicator_a, b.indicator AS indicator_b, R(avg(CASE WHEN greatest(a.lo, b.lo) <= least(a.hi, b.hi) THEN 1e0 ELSE 0e0 END)) AS band_overlap_50, R(avg(CASE WHEN greatest(a.q05, b.q05) <= least(a.q95, b.q95) THEN 1e0 ELSE 0e0 END)) AS band_overlap_90,
R(CASE WHEN sign(arg_max(a.q50, a.horizon) - arg_min(a.q50, a.horizon)) = sign(arg_max(b.q50, a.horizon) - arg_min(b.q50, a.horizon)) THEN 1 ELSE 0 END) AS dir_agree, min(a.horizon) AS h_first, max(a.horizon) AS h_last
FROM r a JOIN r b ON a.horizon = b.horizon AND a.indicator < b.indicator GROUP BY ALL""", 6)
def overlap_matrix(spark, d):
    return combine.overlap_matrix(tb.fcst(spark, d))


@query(f"""WITH {OBS}, {mom()}, {fc()}, px AS (SELECT r_name AS region, o_orderpriority AS indicator, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) - {ORIGIN} AS horizon, avg(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
j AS (SELECT region, fc.*, y FROM px JOIN fc ON px.indicator = fc.indicator AND px.horizon = fc.horizon), l AS (SELECT region, indicator, 5e-1 AS level, {between_sql('y', f'q50 - {num(Z75)} * (q95 - q05) / (2e0 * {num(Z95)})', f'q50 + {num(Z75)} * (q95 - q05) / (2e0 * {num(Z95)})')} AS c FROM j UNION ALL SELECT region, indicator, 9e-1, {between_sql('y', 'q05', 'q95')} FROM j)
SELECT region, indicator, R(level) AS level, CAST(sum(c) AS BIGINT) AS covered, count(*) AS total, R(sum(c) / CAST(count(*) AS DOUBLE)) AS coverage_rate FROM l GROUP BY ALL""", 6)
def proxy_validation(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    proxy = rows.groupBy(F.col("r_name").alias("region"), F.col("o_orderpriority").alias(KEY), tb._month("o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("value"))
    return combine.proxy_validation(tb.fcst(spark, d), proxy, ORIGIN)


@query(f"""{BASE}, {_SUM} SELECT run, origin, indicator, R(level) AS level, covered, total, R(coverage_rate) AS coverage_rate FROM cs, (VALUES ('walk_1999_cal', '1999'), ('walk', '')) v(run, origin)""", 6)
def diagnostics_rollup(spark, d):
    """Two runs are written to a tree of folders, one with its columns in another order, and the tree is scanned."""
    import uuid

    tree = f"{sources.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    s = score.coverage_summary(score.coverage_points(points(spark, d)))
    sources.write_csv(s, f"{tree}/walk_1999_cal")
    sources.write_csv(s.select(*reversed(s.columns)), f"{tree}/walk")
    return sources.read_tagged(spark, f"{tree}/*/*.csv", "indicator string, level double, covered long, total long, coverage_rate double")


@query(f"{BASE} SELECT indicator AS subgroup, count(*) AS n, R(avg(y - q50)) AS bias, R(avg(abs(y - q50))) AS mae FROM pts GROUP BY indicator")
def subgroup_errors(spark, d):
    return govern.subgroup_errors(points(spark, d).withColumnRenamed(KEY, "subgroup"), "subgroup")


_NATIONS = "e AS (SELECT CAST(o_custkey AS VARCHAR) AS name, o_orderpriority AS key FROM orders GROUP BY ALL)"
_AUDIT = f"""WITH {_NATIONS}, k AS (SELECT DISTINCT key FROM e), n AS (SELECT CAST(c_custkey AS VARCHAR) AS name FROM customer)
SELECT x.name, x.key, 'missing key' AS problem FROM (SELECT DISTINCT e.name, k.key FROM e, k) x ANTI JOIN e ON e.name = x.name AND e.key = x.key UNION ALL SELECT name, NULL, 'missing entry' FROM n WHERE name NOT IN (SELECT name FROM e)"""


@query(_AUDIT)
def config_audit(spark, d):
    """Customers as entries whose keys are the priorities that they ordered with."""
    o = table(spark, d, "orders")
    entries = o.select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderpriority").alias("key")).distinct()
    return govern.config_audit(entries, entries.select("key").distinct(), table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("name")))


def _audited(entries, spark, keys, names):
    rows = [(x["name"], k) for x in entries for k in x if k != "name"]
    return govern.config_audit(spark.createDataFrame(rows, "name string, key string"), spark.createDataFrame([(k,) for k in keys], "key string"), names)


def _written(spark, d, line):
    """A configuration with a block for each nation, as text; those with an odd key have no region."""
    rows = table(spark, d, "nation").select("n_nationkey", line.alias("line")).orderBy("n_nationkey").collect()  # a row for each nation
    return "\n".join(r.line for r in rows) + "\n"


_REGIONLESS = """WITH n AS (SELECT n_name FROM nation WHERE n_nationkey < 20) SELECT n_name AS name, 'region' AS key, 'missing key' AS problem FROM n JOIN nation USING (n_name) WHERE n_nationkey % 2 = 1
UNION ALL SELECT n_name, NULL, 'missing entry' FROM nation WHERE n_nationkey >= 20"""


def _nations(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"))


@query(_REGIONLESS)
def config_audit_by_patterns(spark, d):
    region = F.when(F.expr("n_nationkey % 2 = 0"), F.format_string("\n    region: %d", "n_regionkey")).otherwise("")
    block = F.when(F.col("n_nationkey") < 20, F.concat(F.format_string("  - name: '%s'  # nation\n    number: %d", "n_name", "n_nationkey"), region)).otherwise("")
    return _audited(sources.config_blocks("nations:\n" + _written(spark, d, block)), spark, ["number", "region"], _nations(spark, d))


@query(_REGIONLESS)
def baselines_audit(spark, d):
    """The same from mappings by name, by the reader of nested documents."""
    region = F.when(F.expr("n_nationkey % 2 = 0"), F.format_string("\n  region: {number: %d, near: [a, b]}", "n_regionkey")).otherwise("")
    block = F.when(F.col("n_nationkey") < 20, F.concat(F.format_string('"%s":\n  number: %d', "n_name", "n_nationkey"), region)).otherwise("")
    return _audited(sources.read_config(_written(spark, d, block), "nations"), spark, ["number", "region"], _nations(spark, d))


@query("SELECT CAST(page_id AS VARCHAR) AS file, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages")
def sha_manifest(spark, d):
    return govern.digests(table(spark, d, "pages"), "page_id", "html")


@query("SELECT parse_filename(filename) AS file, size AS bytes, sha256(content) AS sha256 FROM read_blob('/root/testdata/sf0.01/*')")
def file_manifest(spark, d):
    return govern.manifest(spark, d)


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)


from tidecast.plans import joint as _joint, tuned as _tuned  # noqa: E402,F401  register their queries
