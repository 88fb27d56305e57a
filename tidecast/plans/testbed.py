"""The driver's tables read as observations, forecasts, survey answers and proxies, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions import Z95, num
from tidecast.operators import calibrate, forecast, series

ORIGIN, H = 48, 15
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _month(c):
    return (F.year(c) - 1995) * 12 + F.month(c) - 1


def obs_orders(spark, d):
    return series.observe(table(spark, d, "orders"), F.col("o_orderpriority"), _month("o_orderdate"), F.col("o_totalprice"))


def obs_lines(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("indicator"), _month("l_shipdate").cast("long").alias("t"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return rows.groupBy("indicator", "t").agg(F.sum("v").alias("value"))


def obs_days(spark, d):
    """By day: most series miss some days."""
    return series.observe(table(spark, d, "orders"), F.col("o_orderpriority"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")), F.col("o_totalprice"))


def fcst(spark, d, origin=ORIGIN):
    return forecast.drift_forecast(obs_orders(spark, d), origin, H)


def points(spark, d):
    return calibrate.join_truth(fcst(spark, d), obs_orders(spark, d), ORIGIN)


def survey(spark, d):
    o = table(spark, d, "orders")
    thermo = lambda k: (F.col("o_totalprice") + k).cast("long") % 110
    return o.select(
        F.year("o_orderdate").cast("long").alias("year"),
        (F.col("o_orderkey") % 9).cast("double").alias("ideology"),
        F.when(F.col("o_custkey") % 9 != 8, F.col("o_custkey") % 9).alias("pid"),
        F.col("o_totalprice").alias("weight"),
        *[thermo(k * 7).cast("double").alias(f"th{k}") for k in range(6)],
    )


OBS = "obs AS (SELECT o_orderpriority AS indicator, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS t, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"
LINES = "obs AS (SELECT l_returnflag || l_linestatus AS indicator, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS t, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY ALL)"
DAYS = "obs AS (SELECT o_orderpriority AS indicator, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS t, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"


def mom(origin=ORIGIN):
    return f"""tr AS (SELECT * FROM obs WHERE t <= {origin} AND value IS NOT NULL),
df AS (SELECT *, value - lag(value) OVER w AS diff, CAST(row_number() OVER w - 1 AS DOUBLE) AS k FROM tr WINDOW w AS (PARTITION BY indicator ORDER BY t)),
d2 AS (SELECT *, avg(diff) OVER (PARTITION BY indicator) AS drift, first_value(value) OVER (PARTITION BY indicator ORDER BY t) AS y0 FROM df),
mom AS (SELECT indicator, count(*) AS n, max(drift) AS drift, arg_max(value, t) AS last, greatest(coalesce(stddev_samp(diff - drift), 0), 1e-6) AS sd_state, greatest(coalesce(stddev_samp(value - y0 - k * drift), 0), 1e-6) AS sd_obs FROM d2 GROUP BY indicator HAVING count(*) >= 3)"""


def fc(shock=0.0, h=H):
    return f"""fc AS (SELECT indicator, horizon, mu - {num(Z95)} * s AS q05, mu AS q50, mu + {num(Z95)} * s AS q95 FROM
(SELECT indicator, CAST(h AS BIGINT) AS horizon, last + h * drift AS mu, sqrt(h * sd_state * sd_state * {num(1 + shock)} + sd_obs * sd_obs) AS s FROM mom, range(1, {h + 1}) r(h)))"""


PTS = f"pts AS (SELECT fc.*, {ORIGIN} + horizon AS t, obs.value AS y FROM fc JOIN obs ON obs.indicator = fc.indicator AND obs.t = {ORIGIN} + horizon WHERE obs.value IS NOT NULL)"
BASE = f"WITH {OBS}, {mom()}, {fc()}, {PTS}"

SURVEY = "sv AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(o_orderkey % 9 AS DOUBLE) AS ideology, CASE WHEN o_custkey % 9 <> 8 THEN o_custkey % 9 END AS pid, o_totalprice AS weight, " + ", ".join(f"CAST(CAST(trunc(o_totalprice + {k * 7}) AS BIGINT) % 110 AS DOUBLE) AS th{k}" for k in range(6)) + " FROM orders)"
