"""Scalar expressions shared by the operators; the text is valid in Spark SQL and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.6448536269514722
Z75 = 0.6744897501960817
Z90 = 1.2815515655446004
Z975 = 1.959963984540054

# Hart (1968) / West (2005), highest power first.
_NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def num(x: float) -> str:
    """A literal that is a double in both dialects."""
    return f"{x:.17e}"


def _horner(z: str, coefficients) -> str:
    out = num(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {z} + {num(c)})"
    return out


def phi_sql(x: str) -> str:
    """Standard normal distribution function of an SQL expression, to about 1e-15; null stays null."""
    z = f"abs({x})"
    tail = f"(exp(-({x}) * ({x}) / 2e0) * {_horner(z, _NUMERATOR)} / {_horner(z, _DENOMINATOR)})"
    return f"(CASE WHEN {z} > 37e0 THEN (CASE WHEN ({x}) > 0e0 THEN 1e0 ELSE 0e0 END) WHEN ({x}) > 0e0 THEN 1e0 - {tail} ELSE {tail} END)"


def phi(x: str) -> Column:
    return F.expr(phi_sql(x))


def crps_sql(y: str, mu: str, sigma: str) -> str:
    """Continuous ranked probability score of a normal forecast."""
    s = f"greatest({sigma}, 1e-9)"
    z = f"(({y} - {mu}) / {s})"
    return f"({s} * ({z} * (2e0 * {phi_sql(z)} - 1e0) + 2e0 * exp(-{z} * {z} / 2e0) / sqrt(2e0 * pi()) - 1e0 / sqrt(pi())))"


def between_sql(y: str, lo: str, hi: str) -> str:
    """1 if ``y`` lies in the band, whichever way its ends stand; 0 if not or unknown."""
    return f"(CASE WHEN {y} >= least({lo}, {hi}) AND {y} <= greatest({lo}, {hi}) THEN 1 ELSE 0 END)"


def horizon_key(c: Column) -> Column:
    """``5``, ``'5'`` and ``'h5'`` as 5; null for anything else."""
    return F.regexp_extract(F.trim(c.cast("string")), r"^[hH]?(\d+)$", 1).try_cast("int")


def boolean_text(c: Column) -> Column:
    """Mixed text as 0 or 1: words for true, or a number above 0."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "t", "y", "yes"), 1).when(F.coalesce(t.try_cast("double"), F.lit(0.0)) > 0, 1).otherwise(0)
