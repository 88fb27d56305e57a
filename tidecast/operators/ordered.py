"""Ranks and exact quantiles of groups of any size, by counts in ordered cells.

A value's cell grows with the value and is a rule of the value alone: the
logarithm of its distance from 0 (for shares: from the nearer of 0 and 1), in
fine steps. Coarse cells hold 65,536 fine ones, fine cells hold values that
agree to six digits. Equal values are counted first, so ties are one row. Ranks
are the counts of the coarse cells before, of the fine cells before in the
coarse one, and of the values before in the fine one: no task sorts a group,
and values that crowd in one place are still spread.

A quantile is found by descending: the coarse cell that holds its rank, the fine
cell in it, the value in that. Only the rows of these cells are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fine cells of a factor of two, as a power of two; coarse cells hold 2 ** 16 fine ones.
FINE, COARSE = 20, 16
#: Copies of the few cells that are looked at again, so that one crowded cell isn't one task.
SALTS = 16


def fine_cell(x: Column) -> Column:
    """A long that grows with a double; 0 for zero."""
    size = F.greatest(F.least(F.log2(F.abs(x)), F.lit(1100.0)), F.lit(-1100.0)) + 1200.0
    steps = F.floor(size * (1 << FINE)).cast("long")
    return F.when(x > 0, steps).when(x < 0, -steps).otherwise(F.lit(0).cast("long"))


def share_cell(x: Column) -> Column:
    """The same for shares of 0..1, as fine near 1 as near 0."""
    top = F.lit(1 << (FINE + 12)).cast("long")
    return F.when(x <= 0.5, fine_cell(x)).otherwise(top - fine_cell(1 - x))


def cells(df: DataFrame, names: list[str], value: str, shares: bool = False) -> DataFrame:
    """(names, value, _c, _f, _g): how often each value occurs, its fine cell and its coarse one. Null values are left out."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*names, value).agg(F.count("*").alias("_c"))
    cell = (share_cell if shares else fine_cell)(F.col(value))
    return rows.withColumn("_f", cell).withColumn("_g", F.shiftright(F.col("_f"), COARSE))


def _before(df: DataFrame, names: list[str], by: str) -> Column:
    return F.sum("_c").over(Window.partitionBy(*names).orderBy(by)) - F.col("_c")


def null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null in both."""
    right = right.withColumnsRenamed({n: f"{n}__r" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"{n}__r")) for n in names]
    return left.join(right, same or F.lit(True), how).drop(*[f"{n}__r" for n in names])


def rank_counts(values: DataFrame, names: list[str], value: str) -> DataFrame:
    """(names, value, _c, _k, _m): for each distinct value of :func:`cells` how many rows have it, have it or less, and how many the group has."""
    fine = values.groupBy(*names, "_g", "_f").agg(F.sum("_c").alias("_c"))
    coarse = fine.groupBy(*names, "_g").agg(F.sum("_c").alias("_c"))
    coarse = coarse.select(*names, "_g", _before(coarse, names, "_g").alias("_b1"), F.sum("_c").over(Window.partitionBy(*names)).alias("_m"))
    fine = fine.select(*names, "_g", "_f", _before(fine, [*names, "_g"], "_f").alias("_b2"))
    places = null_safe(fine, coarse, [*names, "_g"])
    rows = values.withColumn("_b3", F.sum("_c").over(Window.partitionBy(*names, "_g", "_f").orderBy(value)))
    rows = null_safe(rows, places, [*names, "_g", "_f"])
    return rows.select(*names, value, "_c", (F.col("_b1") + F.col("_b2") + F.col("_b3")).alias("_k"), "_m")


def quantiles(df: DataFrame, names: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(names, a column for each of ``probs``): exact quantiles with linear interpolation; null values don't count, groups without values have no row."""
    values = cells(df, names, value)
    share = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(p).cast("double").alias("p")) for i, p in enumerate(probs.values())])

    def held(counts: DataFrame, inside: list[str], by: str, wanted: DataFrame | None) -> DataFrame:
        """The cells that hold the wanted ranks, with the rank within the cell."""
        own = [*names, *inside]
        rows = counts.select(*own, by, "_c", _before(counts, own, by).alias("_b"), *([] if wanted is not None else [F.sum("_c").over(Window.partitionBy(*names)).alias("_n")]))
        if wanted is None:
            rows = rows.withColumn("_s", F.explode(share)).withColumn("_x", F.col("_s.p") * (F.col("_n") - 1))
            rows = rows.withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_x"), F.ceil("_x"))))).withColumn("q", F.col("_s.q"))
            rows = rows.withColumn("w", F.greatest(F.lit(0.0), 1 - F.abs(F.col("_x") - F.col("_r"))))
        else:
            rows = null_safe(rows, wanted, own)
        rows = rows.where((F.col("_r") >= F.col("_b")) & (F.col("_r") < F.col("_b") + F.col("_c")))
        return rows.select(*own, by, (F.col("_r") - F.col("_b")).alias("_r"), "q", "w")

    def again(rows: DataFrame, wanted: DataFrame, inside: list[str]) -> DataFrame:
        """The rows of the cells that are wanted, of which a group has two for each quantile at most.

        An inner join: a semi-join would be pushed below the count of equal values, which is then made anew.
        """
        few = wanted.select(*names, *inside).distinct().withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return null_safe(rows.withColumn("_t", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")), few, [*names, *inside, "_t"]).drop("_t")

    first = held(values.groupBy(*names, "_g").agg(F.sum("_c").alias("_c")), [], "_g", None)
    rows = again(values, first, ["_g"])
    second = held(rows.groupBy(*names, "_g", "_f").agg(F.sum("_c").alias("_c")), ["_g"], "_f", first)
    rows = again(rows, second, ["_g", "_f"])
    third = held(rows.select(*names, "_g", "_f", value, "_c"), ["_g", "_f"], value, second)
    out = [F.sum(F.when(F.col("q") == i, F.col("w") * F.col(value))).alias(c) for i, c in enumerate(probs)]
    return third.groupBy(*names).agg(*out)
