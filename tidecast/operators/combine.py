"""Combining and comparing models, and validation outside the home region."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import Z75, Z95, between_sql, num
from tidecast.operators.series import KEY


def union_models(models: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("model", F.lit(m)) for m, df in models.items()])


#: Quantile and band columns that models may share.
CANONICAL = ("q05", "q25", "q50", "q75", "q95", "lo_50", "hi_50", "lo_90", "hi_90")


def ensemble_equal(models: dict[str, DataFrame], columns=None) -> DataFrame:
    """Equal-weight mean over the models that have a value, of the given columns or of all canonical ones that any model has."""
    if columns is None:
        columns = [c for c in CANONICAL if any(c in df.columns for df in models.values())]
    rows = union_models(models).where(f"{KEY} IS NOT NULL AND horizon IS NOT NULL")
    return rows.groupBy(KEY, "horizon").agg(*[F.avg(c).alias(c) for c in columns], F.count_distinct("model").alias("n_models"))


def overlap_matrix(fcst: DataFrame) -> DataFrame:
    """For each pair of indicators: share of common horizons where their 90 and 50 per cent bands meet, and whether the medians move the same way."""
    s = (F.col("q95") - F.col("q05")) / (2 * Z95)
    rows = fcst.select(KEY, "horizon", "q05", "q50", "q95", (F.col("q50") - Z75 * s).alias("lo"), (F.col("q50") + Z75 * s).alias("hi"))
    a, b = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns]), rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    pair = a.join(b, (F.col("a_horizon") == F.col("b_horizon")) & (F.col(f"a_{KEY}") < F.col(f"b_{KEY}")))

    def meet(lo: str, hi: str):
        whole = reduce(lambda x, y: x & y, [F.col(f"{p}_{c}").isNotNull() for p in "ab" for c in (lo, hi)])
        return F.when(whole, (F.greatest(f"a_{lo}", f"b_{lo}") <= F.least(f"a_{hi}", f"b_{hi}")).cast("double"))

    move = lambda p: F.signum(F.max_by(f"{p}_q50", "a_horizon") - F.min_by(f"{p}_q50", "a_horizon"))
    got = pair.groupBy(F.col(f"a_{KEY}").alias("indicator_a"), F.col(f"b_{KEY}").alias("indicator_b")).agg(
        F.avg(meet("lo", "hi")).alias("band_overlap_50"), F.avg(meet("q05", "q95")).alias("band_overlap_90"), (move("a") == move("b")).cast("double").alias("dir_agree"), F.min("a_horizon").alias("h_first"), F.max("a_horizon").alias("h_last")
    )
    return got


def proxy_validation(fcst: DataFrame, proxy: DataFrame, origin: int, last: int = 15) -> DataFrame:
    """Coverage of the bands by proxy observations ``(region, indicator, t, value)`` on horizons 1 to ``last``."""
    p = proxy.where("value IS NOT NULL").withColumn("horizon", (F.col("t") - origin).cast("long")).where(F.col("horizon").between(1, last)).select("region", KEY, "horizon", F.col("value").alias("y"))
    rows = p.join(fcst, [KEY, "horizon"]).withColumn("s", (F.col("q95") - F.col("q05")) / (2 * Z95))
    level = lambda lv, z: f"named_struct('level', {num(lv)}, 'covered', CAST({between_sql('y', f'q50 - {num(z)} * s', f'q50 + {num(z)} * s')} AS BIGINT))"
    rows = rows.withColumn("p", F.explode(F.expr(f"array({level(0.5, Z75)}, {level(0.9, Z95)})"))).select("region", KEY, "p.*")
    got = rows.groupBy("region", KEY, "level").agg(F.sum("covered").alias("covered"), F.count("*").alias("total"))
    return got.withColumn("coverage_rate", F.try_divide(F.col("covered"), F.col("total")))
