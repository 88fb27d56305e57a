"""Annual (or otherwise regular) indicator series: ``indicator``, ``t`` (integer step) and ``value``.

All functions take and return DataFrames and never collect. NaN is read as
null; rows without indicator or step are dropped; null values stay unless said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.operators import ordered

KEY = "indicator"


def clean(df: DataFrame) -> DataFrame:
    return df.where("indicator IS NOT NULL AND t IS NOT NULL").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def observe(df: DataFrame, indicator: Column, t: Column, value: Column) -> DataFrame:
    """Group mean by indicator and step, the annualising aggregate."""
    rows = df.select(indicator.alias(KEY), t.cast("long").alias("t"), value.cast("double").alias("value"))
    return clean(rows).groupBy(KEY, "t").agg(F.avg("value").alias("value"))


def year_from_text(c: Column) -> Column:
    """The year of a date-like text, else its first four digits that lie in 1700..2100."""
    dated = F.year(F.coalesce(F.try_to_date(c), F.try_to_date(c, "M/d/yyyy")))
    whole = F.regexp_extract(c, r"^\s*(\d{4})([-/]\d{1,2}){0,2}\s*$", 1).try_cast("int")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substring(c, i, F.lit(4)))
    digits = F.filter(windows, lambda w: w.rlike(r"^\d{4}$") & w.try_cast("int").between(1700, 2100))
    dated = F.when(dated.between(1, 9999), dated)
    return F.coalesce(dated, whole, F.get(digits, F.lit(0)).try_cast("int"))


def densify(obs: DataFrame) -> DataFrame:
    """A row for every step from the first to the last of each indicator, null in the gaps."""
    span = obs.groupBy(KEY).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    grid = span.select(KEY, F.explode(F.sequence("lo", "hi")).alias("t"))
    return grid.join(obs, [KEY, "t"], "left").select(KEY, "t", "value")


def dedupe_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def history_counts(obs: DataFrame, origin: int) -> DataFrame:
    return obs.groupBy(KEY).agg(F.count("value").alias("n_total"), F.count_if((F.col("t") <= origin) & F.col("value").isNotNull()).alias("n_train"))


def origin_panel(obs: DataFrame, origin: int, least: int, indicators: list[str]) -> DataFrame:
    """Wide panel of steps up to ``origin``; indicators with fewer than ``least`` values are left out."""
    train = obs.where(F.col("t") <= origin)
    enough = train.groupBy(KEY).agg(F.count("value").alias("n")).where(F.col("n") >= least).select(KEY)
    return train.join(enough, KEY, "left_semi").groupBy("t").pivot(KEY, indicators).agg(F.first("value"))


def complete_steps(obs: DataFrame) -> DataFrame:
    """Observations of the steps at which every indicator has a value."""
    rows = obs.where("value IS NOT NULL")
    total = rows.agg(F.count_distinct(KEY).alias("n_all"))  # one row
    full = rows.groupBy("t").agg(F.count_distinct(KEY).alias("n")).join(F.broadcast(total), F.col("n") == F.col("n_all")).select("t")
    return rows.join(full, "t", "left_semi").select(KEY, "t", "value")


def with_difference(obs: DataFrame) -> DataFrame:
    """Differences between consecutive observed steps; a gap counts as one step."""
    w = Window.partitionBy(KEY).orderBy("t")
    return obs.where("value IS NOT NULL").withColumn("diff", F.col("value") - F.lag("value").over(w))


def difference_stats(obs: DataFrame) -> DataFrame:
    return with_difference(obs).groupBy(KEY).agg(F.avg("diff").alias("drift"), F.stddev_samp("diff").alias("volatility"), F.count("diff").alias("n_diff"))


def zscore(obs: DataFrame, origin: int) -> DataFrame:
    """Values standardised by mean and sample deviation of the training window; rows are not gathered by indicator."""
    inside = F.when(F.col("t") <= origin, F.col("value"))
    known = obs.groupBy(KEY).agg(F.avg(inside).alias("_m"), F.stddev_samp(inside).alias("_s"))
    return obs.join(known, KEY).withColumn("z", F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def winsorize(obs: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Values within two exact quantiles of their indicator, what lies outside them set to the nearer one."""
    edges = ordered.quantiles(obs, [KEY], "value", {"lo": low, "hi": high})
    return obs.join(edges, KEY, "left").select(KEY, "t", F.least(F.greatest("value", "lo"), "hi").alias("value"))


def transform(c: Column, kind: str) -> Column:
    """``identity``, ``log1p`` or ``logit_share``; null outside the domain."""
    if kind == "identity":
        return c
    if kind == "log1p":
        return F.when(c > -1, F.log1p(c))
    if kind == "logit_share":
        return F.when((c > 0) & (c < 1), F.log(c / (1 - c)))
    raise ValueError(kind)


def break_flags(obs: DataFrame, factor: float = 3.0) -> DataFrame:
    """Steps whose change exceeds ``factor`` times the median absolute change, dated by the later step.

    Where the median is 0 the population deviation stands in; with two
    observations or fewer, or no scale, nothing is flagged.
    """
    d = with_difference(obs)
    stats = d.groupBy(KEY).agg(F.stddev_pop("diff").alias("sd"), F.count("value").alias("n"))
    stats = stats.join(ordered.quantiles(d.select(KEY, F.abs("diff").alias("move")), [KEY], "move", {"med": 0.5}), KEY, "left")
    scale = F.when(F.col("med") > 0, F.col("med")).otherwise(F.col("sd"))
    hit = (F.col("n") > 2) & (scale > 0) & (F.abs("diff") > factor * scale)
    return d.join(stats, KEY).select(KEY, "t", "diff", F.coalesce(hit, F.lit(False)).alias("is_break"))


def correlation_pairs(obs: DataFrame) -> DataFrame:
    """Pearson correlation of every unordered pair on the steps that both have; null under two of them."""
    a = obs.where("value IS NOT NULL").select("t", F.col(KEY).alias("a"), F.col("value").alias("x"))
    b = obs.where("value IS NOT NULL").select("t", F.col(KEY).alias("b"), F.col("value").alias("y"))
    both = a.join(b, "t").where("a < b").groupBy("a", "b")
    return both.agg(F.count("*").alias("n"), F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("corr"))


def latest_vintage(df: DataFrame, cut) -> DataFrame:
    """Of each step's releases the newest one up to ``cut``."""
    return df.where(F.col("vintage") <= F.lit(cut)).groupBy(KEY, "t").agg(F.max_by("value", "vintage").alias("value"), F.max("vintage").alias("vintage"))


def revisions(df: DataFrame) -> DataFrame:
    """(indicator, t, vintage, value, was, change) of every release that changed a step's value; a re-release is a new vintage, nothing is edited in place."""
    w = Window.partitionBy(KEY, "t").orderBy("vintage")
    rows = df.withColumn("was", F.lag("value").over(w)).withColumn("_n", F.row_number().over(w))
    changed = rows.where((F.col("_n") > 1) & ~F.col("value").eqNullSafe(F.col("was")))
    return changed.select(KEY, "t", "vintage", "value", "was", (F.col("value") - F.col("was")).alias("change"))


def with_metadata(obs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Observations with their indicator's metadata and the regime they lie in: the number of its declared ``breaks`` up to the step.

    ``metadata``: indicator, ``breaks`` (an array of steps, null for none) and
    whatever else is known. Indicators without metadata keep their rows.
    """
    both = obs.join(metadata, KEY, "left")
    regime = F.size(F.filter(F.coalesce("breaks", F.array().cast("array<long>")), lambda b: b <= F.col("t")))
    return both.withColumn("regime", regime.cast("long")).drop("breaks")


def year_start(year: Column) -> Column:
    """The first of January of a year; null outside 1..9999."""
    return F.when(year.between(1, 9999), F.make_date(year.cast("int"), F.lit(1), F.lit(1)))


def quantiles_long(fcst: DataFrame, columns: dict[str, float] | None = None) -> DataFrame:
    """(indicator, horizon, quantile, value) from a column for each quantile."""
    columns = columns or {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    row = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(c).cast("double").alias("value")) for c, q in columns.items() if c in fcst.columns]))
    return fcst.select(KEY, "horizon", row.alias("r")).select(KEY, "horizon", "r.*")


def quantiles_wide(rows: DataFrame, columns: dict[str, float] | None = None) -> DataFrame:
    """A column for each quantile from (indicator, horizon, quantile, value); the largest of repeated values counts."""
    columns = columns or {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    return rows.groupBy(KEY, "horizon").agg(*[F.max(F.when(F.abs(F.col("quantile") - q) < 1e-9, F.col("value"))).alias(c) for c, q in columns.items()])
