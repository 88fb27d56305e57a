"""Nested rolling-origin search over a seeded grid of a damped trend's parameters.

Every outer origin chooses among the candidates by their errors from inner
origins before it, on targets that it knew; nothing after an outer origin takes
part in its choice, its forecast or its bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions import Z95
from tidecast.operators.forecast import ecc_reorder, uniform_sql
from tidecast.operators.series import KEY

PENALTIES = (0.05, 0.1, 0.2)


def grid_columns(penalties=PENALTIES, spans=(6, 30), seed: int = 123, dialect: str = "spark") -> dict[str, str]:
    """Expressions of a candidate's parameters over its number ``candidate``; the same in Spark and DuckDB.

    ``span``: steps of history used; ``penalty``: one of those given; ``mix``:
    weight of the last value against the line; ``phi``: damping, 0.8 to 0.99.
    """
    u = lambda s: uniform_sql(f"({seed} + candidate * 7919 + {s} * 15485863)", dialect)
    chosen = " ".join(f"WHEN {i} THEN {p!r}D" if dialect == "spark" else f"WHEN {i} THEN CAST({p!r} AS DOUBLE)" for i, p in enumerate(penalties))
    return {
        "span": f"CAST({spans[0]} + floor({u(1)} * {spans[1] - spans[0] + 1}) AS BIGINT)",
        "penalty": f"CASE CAST(floor({u(2)} * {len(penalties)}) AS BIGINT) {chosen} END",
        "mix": u(3),
        "phi": f"8e-1 + 1.9e-1 * ({u(4)})",
    }


def seeded_grid(spark: SparkSession, number: int, **options) -> DataFrame:
    """(candidate, span, penalty, mix, phi): ``number`` draws that depend on the seed alone."""
    columns = grid_columns(**options)
    return spark.range(number).select(F.col("id").alias("candidate"), *[F.expr(x.replace("candidate", "id")).alias(c) for c, x in columns.items()])


def fits(obs: DataFrame, origins: list[int], spans: list[int]) -> DataFrame:
    """(indicator, origin, span, last, m, c, b): line and last value of the observed steps in (origin - span, origin], where there are three or more.

    A row is dealt to the origins and spans that it lies in and summed there
    before the shuffle, which so carries a row for each indicator, origin and span.
    """
    each = obs.where("value IS NOT NULL").withColumn("origin", F.explode(F.filter(F.lit(sorted(origins)), lambda o: (F.col("t") <= o) & (F.col("t") > o - max(spans)))))
    each = each.withColumn("k", F.col("t") - F.col("origin")).withColumn("span", F.explode(F.filter(F.lit(sorted(spans)), lambda s: F.col("k") > -s)))
    got = each.groupBy(KEY, F.col("origin").cast("long").alias("origin"), F.col("span").cast("long").alias("span")).agg(
        F.count("*").alias("n"), F.max_by("value", "t").alias("last"), F.avg("value").alias("m"), F.avg("k").alias("c"), F.regr_slope("value", "k").alias("b")
    )
    return got.where("n >= 3 AND b IS NOT NULL").drop("n")


def damped(fit: DataFrame, grid: DataFrame, h: int) -> DataFrame:
    """(indicator, origin, candidate, horizon, q50): the fits of every candidate carried on over ``h`` steps."""
    rows = fit.join(grid, "span").withColumn("slope", F.col("b") / (1 + F.col("penalty")))
    rows = rows.withColumn("base", F.col("mix") * F.col("last") + (1 - F.col("mix")) * (F.col("m") - F.col("slope") * F.col("c")))
    rows = rows.withColumn("horizon", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(h).cast("long"))))
    sums = F.col("phi") * (1 - F.pow("phi", "horizon")) / (1 - F.col("phi"))
    return rows.select(KEY, "origin", "candidate", "horizon", (F.col("base") + F.col("slope") * sums).alias("q50"))


def nested_errors(obs: DataFrame, origins, h: int, number: int = 24, inner: int = 6, stride: int = 3, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid, forecasts at the outer origins, known errors of the inner ones).

    Errors: (indicator, origin, inner, candidate, horizon, e), ``e`` truth less
    forecast, of targets up to the outer ``origin``. Inner origins lie
    ``stride``, 2 ``stride``, ... before it; ``number`` candidates are drawn.
    """
    outer = sorted({int(o) for o in origins})
    grid = seeded_grid(obs.sparkSession, number, **options)
    spans = [r.span for r in grid.select("span").distinct().collect()]  # ``number`` at most
    before = {o - i * stride for o in outer for i in range(1, inner + 1)}
    all_of = damped(fits(obs, sorted(before | set(outer)), spans), grid, h)
    truth = obs.where("value IS NOT NULL").select(KEY, "t", F.col("value").alias("y"))
    back = F.filter(F.lit(outer), lambda o: (o > F.col("origin")) & (o <= F.col("origin") + inner * stride) & ((o - F.col("origin")) % stride == 0) & (o >= F.col("t")))
    errors = all_of.withColumn("t", F.col("origin") + F.col("horizon")).withColumn("outer", F.explode(back)).join(truth, [KEY, "t"])
    errors = errors.select(KEY, F.col("outer").cast("long").alias("origin"), F.col("origin").alias("inner"), "candidate", "horizon", (F.col("y") - F.col("q50")).alias("e"))
    return grid, all_of.where(F.col("origin").isin(outer)), errors


def choose(errors: DataFrame) -> DataFrame:
    """(indicator, origin, candidate, n, mae): of the candidates with the most errors that of the least mean absolute one, then the first."""
    scored = errors.groupBy(KEY, "origin", "candidate").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"))
    best = scored.groupBy(KEY, "origin").agg(F.min_by(F.struct("candidate", "n", "mae"), F.struct(-F.col("n"), "mae", "candidate")).alias("b"))
    return best.select(KEY, "origin", "b.*")


def nested_search(obs: DataFrame, origins, h: int, conformal: bool = True, target: float = 0.9, **search) -> DataFrame:
    """(indicator, origin, horizon, candidate, span, penalty, mix, phi, n, mae, q05, q50, q95): each outer origin's forecast by the candidate chosen there.

    The band's half-width is the absolute inner error of rank
    ceil((n + 1) * target), the largest at most, or without ``conformal`` Z95
    root mean squares. At most inner * h errors are held for a band, a number
    of the parameters. Indicators without a known inner error at an origin have
    no rows there; null values are no observations.
    """
    return _banded(*nested_errors(obs, origins, h, **search), conformal, target)


def _banded(grid: DataFrame, ahead: DataFrame, errors: DataFrame, conformal: bool, target: float) -> DataFrame:
    best = choose(errors)
    own = errors.join(best, [KEY, "origin", "candidate"]).groupBy(KEY, "origin", "candidate")
    rank = F.least(F.ceil((F.size("es") + 1) * F.lit(target) - 1e-9), F.size("es")).cast("int")
    width = F.get("es", rank - 1) if conformal else Z95 * F.col("rms")
    widths = own.agg(F.first("n").alias("n"), F.first("mae").alias("mae"), F.array_sort(F.collect_list(F.abs("e"))).alias("es"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"))
    rows = ahead.join(widths.withColumn("w", width), [KEY, "origin", "candidate"]).join(grid, "candidate")
    return rows.select(KEY, "origin", "horizon", "candidate", "span", "penalty", "mix", "phi", "n", "mae", (F.col("q50") - F.col("w")).alias("q05"), "q50", (F.col("q50") + F.col("w")).alias("q95"))


def coupled_members(obs: DataFrame, origins, h: int, conformal: bool = True, target: float = 0.9, **search) -> DataFrame:
    """(indicator, origin, path, horizon, y): members of the chosen forecasts in the rank order of the inner errors.

    The template is the inner origins whose ``h`` targets were all known: path
    p is the p-th of them by time. A horizon's marginal is as many values at
    equal steps of probability on the line through its band, put in the order
    of that horizon's errors, so paths keep how errors went together.
    """
    grid, ahead, errors = nested_errors(obs, origins, h, **search)
    chosen = _banded(grid, ahead, errors, conformal, target)
    picked = chosen.select(KEY, "origin", "candidate").distinct()
    whole = errors.join(picked, [KEY, "origin", "candidate"]).groupBy(KEY, "origin", "inner").agg(F.collect_list(F.struct("horizon", "e")).alias("es")).where(F.size("es") == h)
    ids = whole.groupBy(KEY, "origin").agg(F.array_sort(F.collect_list("inner")).alias("ids"))  # ``inner`` at most
    name = F.to_json(F.struct(F.col(KEY).alias("i"), F.col("origin").alias("o"))).alias(KEY)
    template = whole.join(ids, [KEY, "origin"]).select(KEY, "origin", (F.array_position("ids", F.col("inner")) - 1).alias("path"), F.inline("es")).select(name, "path", "horizon", F.col("e").alias("x"))
    half = (F.col("q95") - F.col("q05")) / 2
    sim = chosen.join(ids, [KEY, "origin"]).withColumn("k", F.size("ids")).withColumn("path", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    sim = sim.select(name, "path", "horizon", (F.col("q50") + half * (2 * (F.col("path") + 0.5) / F.col("k") - 1) / 0.9).alias("y"))
    was = F.from_json(KEY, "i string, o long")
    return ecc_reorder(sim, template).select(was["i"].alias(KEY), was["o"].alias("origin"), F.col("path").cast("long").alias("path"), "horizon", "y")
