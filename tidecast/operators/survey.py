"""Aggregates over survey micro-data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.between(lo, hi), c)


def dispersion(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd_sample"), F.stddev_pop(value).alias("sd_population"))


def weighted(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Weighted mean and population deviation (two passes), with weights brought to sum 1 in each group; weights that are null or not above 0 are left out."""
    ok = df.where(f"`{value}` IS NOT NULL AND `{weight}` > 0")
    w = Window.partitionBy(by)
    share = F.try_divide(F.col(weight), F.sum(weight).over(w))
    rows = ok.select(by, F.col(value).alias("x"), share.alias("share"))
    centred = rows.withColumn("mean", F.sum(F.col("share") * F.col("x")).over(w))
    return centred.groupBy(by).agg(F.count("*").alias("n"), F.max("mean").alias("w_mean"), F.sqrt(F.sum(F.col("share") * (F.col("x") - F.col("mean")) ** 2)).alias("w_sd"), F.sum("share").alias("w_total"))


def best_pair(df: DataFrame, by: str, pid: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Of several column pairs the one with most valid rows in each group, with its mean absolute gap.

    Ties go to the pair with more gaps, then to one with a gap at all, then to
    the last. Rows without ``pid`` carry no gap, unless a group has none at all.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), valid(F.col(a), 0, 100).alias("d"), valid(F.col(b), 0, 100).alias("r")) for i, (a, b) in enumerate(pairs)]))
    rows = df.select(by, pid, stacked.alias("p")).select(by, pid, "p.*").withColumn("gap", F.abs(F.col("d") - F.col("r")))
    got = rows.groupBy(by, "pair").agg(
        F.count("gap").alias("n_valid"),
        F.count(F.when(F.col(pid).isNotNull(), F.col("gap"))).alias("n_pid"),
        F.when(F.count(pid) > 0, F.avg(F.when(F.col(pid).isNotNull(), F.col("gap")))).otherwise(F.avg("gap")).alias("gap"),
    )
    w = Window.partitionBy(by).orderBy(F.desc("n_valid"), F.desc("n_pid"), F.col("gap").isNull(), F.desc("pair"))
    return got.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def outer_merge(frames: list[DataFrame], on: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "full_outer"), frames)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shares of each column's values in 1..7, in 0..100 and among plausible years, in one pass."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").try_cast("double").alias("x")) for c in columns]))
    rows = df.select(stacked.alias("p")).select("p.*")
    share = lambda ok: F.avg(F.coalesce(ok, F.lit(False)).cast("int"))
    seven = F.col("x").isin(*[float(k) for k in range(1, 8)])
    year = F.col("x").between(1948, 2025)
    got = rows.groupBy("column").agg(share(seven).alias("share_1_7"), share(F.col("x").between(0, 100)).alias("share_0_100"), share(year).alias("share_year"), F.count_distinct("x").alias("n_distinct"))
    return got.withColumn("year_score", F.when((F.col("share_year") > 0.5) & (F.col("n_distinct") < 200), F.col("share_year") * (1 - F.least("n_distinct", F.lit(500)) / 500)))


def year_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, year_score): the column that looks most like years, the first by name among equals; none where none does."""
    return column_profile(df, columns).where("year_score IS NOT NULL").orderBy(F.desc("year_score"), "column").limit(1).select("column", "year_score")


def polarisation(df: DataFrame, year: str, ideology: str, pid: str, pairs: list[tuple[str, str]], weight: str | None = None, population: bool = False) -> DataFrame:
    """(year, n, ideology_sd, pair, affect_gap): spread of ideology on 1..7 and mean gap of the best thermometer pair, of every wave that has either.

    With ``weight`` the deviation is weighted; else it is that of the population
    or of a sample. One wave is a table with one year.
    """
    placed = df.select(F.col(year).alias("year"), valid(F.col(ideology), 1, 7).alias("v"), *([F.col(weight).alias("w")] if weight else []))
    if weight:
        spread = weighted(placed, "year", "v", "w").select("year", "n", F.col("w_sd").alias("ideology_sd"))
    else:
        spread = dispersion(placed, "year", "v").select("year", "n", F.col("sd_population" if population else "sd_sample").alias("ideology_sd"))
    gaps = best_pair(df, year, pid, pairs).select(F.col(year).alias("year"), "pair", F.col("gap").alias("affect_gap"))
    return outer_merge([spread, gaps], "year").where("ideology_sd IS NOT NULL OR affect_gap IS NOT NULL")
