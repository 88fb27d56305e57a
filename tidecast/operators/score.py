"""Scores and diagnostics of forecasts joined with truth (``y``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import Z75, Z90, Z95, between_sql, crps_sql, num, phi_sql
from tidecast.operators import ordered
from tidecast.operators.series import KEY

SIGMA = f"greatest((q95 - q05) / (2e0 * {num(Z95)}), 1e-6)"
SIGMA_UPPER = f"greatest((q95 - q50) / {num(Z95)}, 1e-8)"


def pit(points: DataFrame, sigma: str = SIGMA_UPPER) -> DataFrame:
    return points.withColumn("pit", F.expr(phi_sql(f"((y - q50) / {sigma})")))


def crps(points: DataFrame) -> DataFrame:
    return points.withColumn("mu", F.col("q50")).withColumn("sigma", F.expr(SIGMA)).withColumn("crps", F.expr(crps_sql("y", "q50", SIGMA)))


def coverage_points(points: DataFrame, inner80: bool = False) -> DataFrame:
    """One row for each forecast and level, with 1 where the band holds the truth."""
    levels = [(0.5, Z75), (0.9, Z95)] + [(0.8, Z90)] * inner80
    row = lambda level, z: f"named_struct('level', {num(level)}, 'covered', CAST({between_sql('y', f'q50 - {num(z)} * s', f'q50 + {num(z)} * s')} AS BIGINT))"
    rows = points.withColumn("s", F.expr(SIGMA_UPPER)).withColumn("p", F.explode(F.expr(f"array({', '.join(row(*x) for x in levels)})")))
    return rows.select(KEY, F.col("t").alias("t"), "horizon", "p.level", "p.covered")


def coverage_summary(covered: DataFrame) -> DataFrame:
    got = covered.where("level IS NOT NULL").groupBy(KEY, "level").agg(F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"), F.count("covered").alias("total"))
    return got.withColumn("coverage_rate", F.try_divide(F.col("covered"), F.col("total")))


def coverage_rollup(points: DataFrame) -> DataFrame:
    """Rates of both bands by indicator, with a grand total row ``ALL``."""
    lo, hi = (lambda z: f"q50 - {num(z)} * s"), (lambda z: f"q50 + {num(z)} * s")
    rows = points.withColumn("s", F.expr(SIGMA)).select(KEY, F.expr(between_sql("y", lo(Z75), hi(Z75))).alias("in50"), F.expr(between_sql("y", lo(Z95), hi(Z95))).alias("in90"))
    got = rows.rollup(KEY).agg(F.grouping(KEY).alias("g"), F.count("*").alias("n"), F.avg("in50").alias("cov50"), F.avg("in90").alias("cov90"))
    return got.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(KEY)).alias(KEY), "n", "cov50", "cov90")


def ks_uniform(pits: DataFrame) -> DataFrame:
    """Largest distance of the PIT's distribution function from the uniform one, by indicator."""
    known = pits.where("pit IS NOT NULL").select(KEY, "pit")
    rows = ordered.rank_counts(ordered.cells(known, [KEY], "pit", shares=True), [KEY], "pit")
    return rows.groupBy(KEY).agg(F.max("_m").alias("n"), F.max(F.greatest(F.col("_k") / F.col("_m") - F.col("pit"), F.col("pit") - (F.col("_k") - F.col("_c")) / F.col("_m"))).alias("ks"))


def reliability(pits: DataFrame, bins: int = 10) -> DataFrame:
    """PIT histogram with each bin's share, and whether it holds at most twice what it should."""
    b = F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1)).cast("long")
    got = pits.where("pit IS NOT NULL").groupBy(KEY, b.alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(KEY))
    return got.withColumn("share", share).withColumn("ok", F.col("share") <= 2.0 / bins)


def piecewise_pit(points: DataFrame) -> DataFrame:
    """PIT by straight lines between the three quantiles; 0.05 and 0.95 bound what lies outside them."""
    e = "CASE WHEN y <= q05 THEN 5e-2 WHEN y >= q95 THEN 9.5e-1 WHEN y <= q50 THEN 5e-2 + 4.5e-1 * (y - q05) / (q50 - q05) ELSE 5e-1 + 4.5e-1 * (y - q50) / (q95 - q50) END"
    return points.withColumn("pit", F.expr(e))


def event_brier(points: DataFrame, threshold) -> DataFrame:
    """Brier score of the event that the truth lies below a threshold."""
    p = points.withColumn("th", threshold).withColumn("p", F.expr(phi_sql(f"((th - q50) / {SIGMA})"))).withColumn("o", (F.col("y") < F.col("th")).cast("double"))
    return p.groupBy(KEY).agg(F.avg((F.col("p") - F.col("o")) ** 2).alias("brier"), F.count("*").alias("n"))


def event_catalogue(points: DataFrame, events: DataFrame, horizons=(1, 3, 5, 10, 15)) -> DataFrame:
    """(event, indicator, horizon, n, p, rate, brier) of threshold events at the given horizons.

    ``events``: event, indicator, threshold, and ``above``, true for events that
    the value reaches the threshold and false for those that it stays below it.
    Every event is judged by its own indicator.
    """
    rows = points.where(F.col("horizon").isin(*horizons)).join(events, KEY)
    below = F.expr(phi_sql(f"((threshold - q50) / {SIGMA})"))
    rows = rows.withColumn("p", F.when(F.col("above"), 1 - below).otherwise(below)).withColumn("o", (F.col("above") == (F.col("y") >= F.col("threshold"))).cast("double"))
    return rows.groupBy("event", KEY, "horizon").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("o").alias("rate"), F.avg((F.col("p") - F.col("o")) ** 2).alias("brier"))


def reliability_curve(points: DataFrame, events: DataFrame, bins: int = 10, gate: float = 0.1) -> DataFrame:
    """(bin, n, p, rate, ok): mean probability and observed rate of events by bin of probability; ``ok`` if they differ by ``gate`` at most."""
    rows = points.join(events, KEY)
    below = F.expr(phi_sql(f"((threshold - q50) / {SIGMA})"))
    rows = rows.select(F.when(F.col("above"), 1 - below).otherwise(below).alias("p"), (F.col("above") == (F.col("y") >= F.col("threshold"))).cast("double").alias("o"))
    b = F.greatest(F.lit(0), F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))).cast("long")
    got = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("o").alias("rate"))
    return got.withColumn("ok", F.abs(F.col("p") - F.col("rate")) <= gate)


def coverage_gate(summary: DataFrame, gate: float = 0.1) -> DataFrame:
    """Whether each coverage rate lies within ``gate`` of its level; a soft gate, nothing is rejected."""
    return summary.withColumn("within", F.abs(F.col("coverage_rate") - F.col("level")) <= gate + 1e-12)


def coverage_pivot(summary: DataFrame, levels=(0.5, 0.9)) -> DataFrame:
    """Coverage rates with a column for each level."""
    return summary.groupBy(KEY).agg(*[F.max(F.when(F.col("level") == lv, F.col("coverage_rate"))).alias(f"coverage_{round(lv * 100)}") for lv in levels])


def scorecard(summary: DataFrame, crps_points: DataFrame, briers: DataFrame) -> DataFrame:
    """(indicator, level, covered, total, coverage_rate, crps, brier): one row for each level, with the indicator's mean scores."""
    c = crps_points.groupBy(KEY).agg(F.avg("crps").alias("crps"))
    rows = summary.select(KEY, "level", "covered", "total", "coverage_rate")
    return rows.join(c, KEY, "left").join(briers.select(KEY, "brier"), KEY, "left")


def metrics_by_horizon(covered: DataFrame, pits: DataFrame) -> DataFrame:
    """Coverage of both levels as columns, with PIT mean, sample variance (null for one) and count.

    It is an error, raised when the result is read, if a level has no rows at all.
    """
    there = covered.agg(*[F.coalesce(F.max(F.col("level") == lv), F.lit(False)).alias(f"has_{n}") for lv, n in ((0.5, 50), (0.9, 90))], F.count("*").alias("rows"))
    whole = F.assert_true(F.col("has_50") & F.col("has_90") | (F.col("rows") == 0), "coverage rows lack a level, 0.5 or 0.9")
    wide = covered.groupBy(KEY, "horizon").agg(*[F.avg(F.when(F.col("level") == lv, F.col("covered"))).alias(f"covered_{n}_rate") for lv, n in ((0.5, 50), (0.9, 90))])
    p = pits.groupBy(KEY, "horizon").agg(F.avg("pit").alias("pit_mean"), F.when(F.count("pit") > 1, F.var_samp("pit")).alias("pit_var"), F.count("pit").alias("pit_n"))
    checked = wide.crossJoin(F.broadcast(there)).where(whole.isNull()).select(*wide.columns)  # one row
    return checked.join(p, [KEY, "horizon"], "left")


def coverage_loss(summary: DataFrame) -> DataFrame:
    return summary.withColumn("loss", F.abs(F.col("coverage_rate") - F.col("level")))
