"""Significance of coverage and false-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import Z975, phi_sql
from tidecast.operators import ordered


def wilson(df: DataFrame, x: str = "x", n: str = "n") -> DataFrame:
    """Wilson 95 per cent interval of a rate, kept within 0..1."""
    p, z, z2 = F.col(x) / F.col(n), Z975, Z975 * Z975
    d = 1 + z2 / F.col(n)
    centre = (p + z2 / (2 * F.col(n))) / d
    half = z * F.sqrt(p * (1 - p) / F.col(n) + z2 / (4 * F.col(n) * F.col(n))) / d
    return df.withColumn("wilson_low", F.greatest(F.lit(0.0), centre - half)).withColumn("wilson_high", F.least(F.lit(1.0), centre + half))


def z_test(df: DataFrame, x: str = "x", n: str = "n", p0: str = "level") -> DataFrame:
    """Two-sided p-value of the rate against its nominal level."""
    z = f"abs(({x} / CAST({n} AS DOUBLE) - {p0}) / sqrt({p0} * (1e0 - {p0}) / {n}))"
    return df.withColumn("p_value", F.expr(f"2e0 * (1e0 - {phi_sql(z)})"))


def benjamini_hochberg(df: DataFrame, alpha: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Mark the hypotheses that step-up control rejects; null p-values are never rejected nor counted.

    A hypothesis is rejected if its p-value is at most the largest p for which
    the family has p * m / alpha p-values or more up to it. ``by`` names the
    families; null is a family too.
    """
    names = [f"_{i}" for i in range(len(by))]
    known = df.where("p_value IS NOT NULL").select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("p_value").alias("_p"))
    ranks = ordered.rank_counts(ordered.cells(known, names, "_p", shares=True), names, "_p")
    cut = ranks.where(F.col("_p") <= alpha * F.col("_k") / F.col("_m")).groupBy(*names).agg(F.max("_p").alias("_cut"))
    if not by:
        return df.crossJoin(F.broadcast(cut)).withColumn("bh_reject", F.coalesce(F.col("p_value") <= F.col("_cut"), F.lit(False))).drop("_cut")  # one row
    both = df.join(cut, [F.col(c).eqNullSafe(cut[n]) for c, n in zip(by, names)], "left")
    return both.withColumn("bh_reject", F.coalesce(F.col("p_value") <= F.col("_cut"), F.lit(False))).drop("_cut", *names)


def counts_from_rates(rates: DataFrame, levels: dict[str, float]) -> DataFrame:
    """(indicator, level, x, n) from one rate for each indicator and horizon: rates are rounded half to even and summed."""
    row = F.explode(F.array(*[F.struct(F.lit(float(lv)).alias("level"), F.col(c).cast("double").alias("rate")) for c, lv in levels.items()]))
    rows = rates.select("indicator", row.alias("r")).select("indicator", "r.*").where("rate IS NOT NULL")
    return rows.groupBy("indicator", "level").agg(F.sum(F.bround("rate", 0).cast("long")).alias("x"), F.count("*").alias("n"))


def significance(rates: DataFrame) -> DataFrame:
    """(indicator, level, x, n) with p-value, interval, and rejection over all rows."""
    return benjamini_hochberg(wilson(z_test(rates))).withColumn("within_ci", F.col("level").between(F.col("wilson_low"), F.col("wilson_high")))
