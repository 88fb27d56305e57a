"""Calibration of quantile forecasts against truth. ``fcst``: indicator, horizon, q05, q50, q95; ``truth``: indicator, t, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import Z95, num
from tidecast.operators.series import KEY, dedupe_first


def join_truth(fcst: DataFrame, truth: DataFrame, origins) -> DataFrame:
    """Forecast rows with the value at ``origin + horizon``, for one origin or several.

    Null truth is dropped. Of repeated truth rows the smallest value counts.
    """
    origins = [origins] if isinstance(origins, int) else list(origins)
    ok = dedupe_first(truth.where("value IS NOT NULL"), [KEY, "t"], ["value"]).select(KEY, "t", F.col("value").alias("y"))
    at = fcst.withColumn("origin", F.explode(F.array(*[F.lit(o).cast("long") for o in origins]))).withColumn("t", F.col("origin") + F.col("horizon"))
    return at.join(ok, [KEY, "t"])


def join_rolling(fcst: DataFrame, truth: DataFrame) -> DataFrame:
    """Forecast rows that carry their own ``origin``, with the value at ``origin + horizon``. Null truth is dropped."""
    ok = dedupe_first(truth.where("value IS NOT NULL"), [KEY, "t"], ["value"]).select(KEY, "t", F.col("value").alias("y"))
    return fcst.withColumn("t", F.col("origin") + F.col("horizon")).join(ok, [KEY, "t"])


def by_origin(points: DataFrame, step) -> DataFrame:
    """``step`` over every (indicator, origin) as an indicator of its own; the result has both again."""
    name = F.to_json(F.struct(F.col(KEY).alias("i"), F.col("origin").alias("o")))
    out = step(points.withColumn(KEY, name))
    was = F.from_json(KEY, "i string, o long")
    return out.select(was["i"].alias(KEY), was["o"].alias("origin"), *[c for c in out.columns if c not in (KEY, "origin")])


def sigma_scales(fcst: DataFrame, points: DataFrame, **search) -> DataFrame:
    """A scale for every indicator of the forecast: that of the search, or 1 with null coverages where there is no truth."""
    return fcst.select(KEY).distinct().join(spread_search(points, **search), KEY, "left").withColumn("alpha", F.coalesce("alpha", F.lit(1.0)))


def conformal(fcst: DataFrame, points: DataFrame, target: float = 0.9) -> DataFrame:
    """Bands of the split-conformal half-width: the absolute error of rank ceil((n + 1) * target) among the n known, the largest at most."""
    sized = points.groupBy(KEY).agg(F.array_sort(F.collect_list(F.abs(F.col("y") - F.col("q50")))).alias("e"))
    rank = F.least(F.ceil((F.size("e") + 1) * F.lit(target) - 1e-9), F.size("e")).cast("int")
    widths = sized.select(KEY, F.get("e", rank - 1).alias("w"), F.size("e").cast("long").alias("n"))
    return fcst.join(widths, KEY).select(KEY, "horizon", (F.col("q50") - F.col("w")).alias("q05"), "q50", (F.col("q50") + F.col("w")).alias("q95"), "n")


def spread_search(points: DataFrame, target: float = 0.9, low: float = 0.25, high: float = 8.0, steps: int = 30, tolerance: float = 0.005) -> DataFrame:
    """(indicator, alpha, coverage_before, coverage_after) by bisection on the scale of the band around the median.

    Each point covers from a critical scale on, so one list for an indicator
    serves all steps. The scale 1 stays if its coverage is within tolerance;
    otherwise the midpoint with strictly the smallest error so far is kept.
    """
    crit = F.expr("CASE WHEN y >= q50 THEN try_divide(y - q50, q95 - q50) ELSE try_divide(q50 - y, q50 - q05) END")
    crit = F.when(F.col("y") == F.col("q50"), 0.0).otherwise(F.coalesce(F.when(crit >= 0, crit), F.lit(1e300)))
    lists = points.select(KEY, crit.alias("c")).groupBy(KEY).agg(F.array_sort(F.collect_list("c")).alias("c"))
    cov = lambda a: f"CAST(size(filter(c, x -> x <= {a})) AS DOUBLE) / size(c)"
    first = F.expr(cov("1e0"))
    step = f"""transform(transform(array((s.lo + s.hi) / 2e0), m -> named_struct('m', m, 'v', {cov("m")})), p -> named_struct(
        'lo', CASE WHEN p.v >= {num(target)} THEN s.lo ELSE p.m END, 'hi', CASE WHEN p.v >= {num(target)} THEN p.m ELSE s.hi END,
        'best', CASE WHEN abs(p.v - {num(target)}) < s.err THEN p.m ELSE s.best END, 'err', least(s.err, abs(p.v - {num(target)}))))[0]"""
    search = F.expr(f"aggregate(sequence(1, {steps}), named_struct('lo', {num(low)}, 'hi', {num(high)}, 'best', 1e0, 'err', abs(before - {num(target)})), (s, i) -> {step}).best")
    got = lists.withColumn("before", first).withColumn("alpha", F.when(F.abs(F.col("before") - target) <= tolerance, F.lit(1.0)).otherwise(search))
    return got.select(KEY, "alpha", F.col("before").alias("coverage_before"), F.expr(cov("alpha")).alias("coverage_after"))


def scale_spread(fcst: DataFrame, alphas: DataFrame) -> DataFrame:
    """Quantiles moved to ``q50 + alpha * (q - q50)``; indicators without a scale keep theirs."""
    joined = fcst.join(alphas.select(KEY, "alpha"), KEY, "left").withColumn("alpha", F.coalesce("alpha", F.lit(1.0)))
    move = lambda c: (F.col("q50") + F.col("alpha") * (F.col(c) - F.col("q50"))).alias(c)
    return joined.select(KEY, "horizon", move("q05"), "q50", move("q95"), "alpha")


def rescale_bands(fcst: DataFrame, alpha: float, indicator: str | None = None) -> DataFrame:
    """50 and 90 per cent bands, synthesised from the quantiles where absent, scaled around the median."""
    sigma = (F.col("q95") - F.col("q05")) / (2 * Z95)
    have = set(fcst.columns)
    q25 = F.col("q25") if "q25" in have else F.col("q50") - 0.6744897501960817 * sigma
    q75 = F.col("q75") if "q75" in have else F.col("q50") + 0.6744897501960817 * sigma
    bands = {"lo_50": q25, "hi_50": q75, "lo_90": F.col("q05"), "hi_90": F.col("q95")}
    bands = {k: F.col(k) if k in have else v for k, v in bands.items()}
    on = F.lit(True) if indicator is None else F.col(KEY) == indicator
    return fcst.select(KEY, "horizon", "q50", *[F.when(on, F.col("q50") + alpha * (v - F.col("q50"))).otherwise(v).alias(k) for k, v in bands.items()])


def least_alpha(points: DataFrame) -> DataFrame:
    """Smallest scale that covers every miss of the 90 per cent band, with one per cent to spare; 1 without misses."""
    ratio = F.abs(F.col("y") - F.col("q50")) / (F.abs(F.col("q95") - F.col("q50")) + 1e-12)
    miss = (F.col("y") < F.least("q05", "q95")) | (F.col("y") > F.greatest("q05", "q95"))
    return points.groupBy(KEY).agg(F.count_if(miss).alias("misses"), F.coalesce(F.max(F.when(miss, ratio)) * 1.01, F.lit(1.0)).alias("alpha"))


def mean_fit(points: DataFrame) -> DataFrame:
    """Least-squares line of truth on the median; (0, 1) under three points or without spread."""
    got = points.groupBy(KEY).agg(F.count("*").alias("n"), F.regr_intercept("y", "q50").alias("a"), F.regr_slope("y", "q50").alias("b"), F.var_pop("q50").alias("v"))
    ok = (F.col("n") >= 3) & (F.col("v") > 0)
    return got.select(KEY, F.when(ok, F.col("a")).otherwise(0.0).alias("a"), F.when(ok, F.col("b")).otherwise(1.0).alias("b"))


def apply_mean(fcst: DataFrame, fits: DataFrame) -> DataFrame:
    sigma = F.greatest((F.col("q95") - F.col("q05")) / (2 * Z95), F.lit(1e-6))
    mu = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(1.0)) * F.col("q50")
    return fcst.join(fits, KEY, "left").select(KEY, "horizon", (mu - Z95 * sigma).alias("q05"), mu.alias("q50"), (mu + Z95 * sigma).alias("q95"))


def bias(points: DataFrame) -> DataFrame:
    return points.groupBy(KEY).agg(F.avg(F.col("y") - F.col("q50")).alias("delta"))


def shift(fcst: DataFrame, deltas: DataFrame) -> DataFrame:
    d = F.coalesce("delta", F.lit(0.0))
    return fcst.join(deltas, KEY, "left").select(KEY, "horizon", *[(F.col(c) + d).alias(c) for c in ("q05", "q50", "q95")])


def match_sample(fcst: DataFrame, obs: DataFrame, origin: int) -> DataFrame:
    """Scale quantiles by the deviation of the observed values over that of the medians, then shift by the last value less the first median.

    Medians that do not vary keep their scale. Indicators without history stay as they are.
    """
    seen = obs.where((F.col("t") <= origin) & F.col("value").isNotNull()).groupBy("indicator").agg(F.stddev_pop("value").alias("sd_obs"), F.max_by("value", "t").alias("last"))
    mids = fcst.groupBy("indicator").agg(F.stddev_pop("q50").alias("sd_mid"), F.min_by("q50", "horizon").alias("mid"))
    scale = F.when(F.col("sd_mid") > 0, F.coalesce(F.col("sd_obs") / F.col("sd_mid"), F.lit(1.0))).otherwise(1.0)
    rows = fcst.join(mids.join(seen, "indicator", "left"), "indicator")
    return rows.select("indicator", "horizon", *[(F.col(q) * scale + F.coalesce(F.col("last") - F.col("mid"), F.lit(0.0))).alias(q) for q in ("q05", "q50", "q95")])
