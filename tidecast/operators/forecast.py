"""Quantile forecasts ``(indicator, horizon, q05, q50, q95)`` from observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import Z95, num
from tidecast.operators import ordered, scan
from tidecast.operators.series import KEY


def _horizons(df: DataFrame, h: int) -> DataFrame:
    return df.withColumn("horizon", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(h).cast("long"))))


def quantiles(df: DataFrame, mu, sigma) -> DataFrame:
    return df.select(KEY, "horizon", (mu - Z95 * sigma).alias("q05"), mu.alias("q50"), (mu + Z95 * sigma).alias("q95"))


def train(obs: DataFrame, origin: int, least: int = 3) -> DataFrame:
    """Observed steps up to ``origin`` of indicators with at least ``least`` of them; later data is never read."""
    rows = obs.where((F.col("t") <= origin) & F.col("value").isNotNull())
    n = rows.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(KEY)
    return rows.join(n, KEY, "left_semi")


def rolling(obs: DataFrame, origins, model, h: int, **options) -> DataFrame:
    """``model`` fitted anew at every origin, on what was known then: its rows with ``origin``.

    ``origins`` are numbers or a table with a column ``origin``; it is joined
    before the train cut, and every (indicator, origin) is a series of its own,
    in steps counted from its origin. So any forecaster of ``(obs, origin, h)``
    serves, all origins are one plan, and none sees what came after it.
    """
    table = origins if isinstance(origins, DataFrame) else obs.sparkSession.createDataFrame([(o,) for o in origins], "origin long")
    table = table.select(F.col("origin").cast("long")).where("origin IS NOT NULL").distinct()
    given = table if isinstance(origins, DataFrame) else F.broadcast(table)  # a list is as small as the driver's
    each = obs.join(given, F.col("t") <= F.col("origin"))
    name = F.to_json(F.struct(F.col(KEY).alias("i"), F.col("origin").alias("o")))
    out = model(each.select(name.alias(KEY), (F.col("t") - F.col("origin")).alias("t"), "value"), 0, h, **options)
    was = F.from_json(KEY, "i string, o long")
    return out.select(was["i"].alias(KEY), was["o"].alias("origin"), *[c for c in out.columns if c != KEY])


def moments(obs: DataFrame) -> DataFrame:
    """Drift, state and observation deviation and last value of each indicator; deviations are at least 1e-6."""
    w = Window.partitionBy(KEY).orderBy("t")
    rows = obs.withColumn("diff", F.col("value") - F.lag("value").over(w)).withColumn("k", (F.row_number().over(w) - 1).cast("double"))
    every = Window.partitionBy(KEY)
    rows = rows.withColumn("drift", F.avg("diff").over(every)).withColumn("y0", F.min_by("value", "t").over(every))
    got = rows.groupBy(KEY).agg(
        F.count("*").alias("n"),
        F.max("drift").alias("drift"),
        F.max_by("value", "t").alias("last"),
        F.stddev_samp(F.col("diff") - F.col("drift")).alias("sd_state"),
        F.stddev_samp(F.col("value") - F.col("y0") - F.col("k") * F.col("drift")).alias("sd_obs"),
    )
    floor = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-6)).alias(c)
    return got.select(KEY, "n", "drift", "last", floor("sd_state"), floor("sd_obs"))


def drift_forecast(obs: DataFrame, origin: int, h: int) -> DataFrame:
    """Exact moments of the random walk with drift and observation noise."""
    f = _horizons(moments(train(obs, origin)), h)
    return quantiles(f, F.col("last") + F.col("horizon") * F.col("drift"), F.sqrt(F.col("horizon") * F.col("sd_state") ** 2 + F.col("sd_obs") ** 2))


def shock_moments(obs: DataFrame, origin: int, h: int, rate: float = 0.2, scale: float = 2.0) -> DataFrame:
    """The same with shocks added to the state: a Poisson number at each step, each normal with ``scale`` state deviations."""
    f = _horizons(moments(train(obs, origin)), h)
    var = F.col("horizon") * F.col("sd_state") ** 2 * (1 + rate * scale**2) + F.col("sd_obs") ** 2
    return quantiles(f, F.col("last") + F.col("horizon") * F.col("drift"), F.sqrt(var))


def persistence(obs: DataFrame, origin: int, h: int) -> DataFrame:
    return _horizons(train(obs, origin).groupBy(KEY).agg(F.max_by("value", "t").alias("q50")), h)


def linear_trend(obs: DataFrame, origin: int, h: int) -> DataFrame:
    fit = train(obs, origin).groupBy(KEY).agg(F.regr_slope("value", "t").alias("b"), F.regr_intercept("value", "t").alias("a"))
    return _horizons(fit, h).select(KEY, "horizon", (F.col("a") + F.col("b") * (F.col("horizon") + origin)).alias("q50"))


def walk_drift(obs: DataFrame, origin: int, h: int) -> DataFrame:
    fit = train(obs, origin).groupBy(KEY).agg(F.max_by("value", "t").alias("last"), F.min_by("value", "t").alias("first"), F.count("*").alias("n"))
    step = F.try_divide(F.col("last") - F.col("first"), F.col("n") - 1)
    return _horizons(fit, h).select(KEY, "horizon", (F.col("last") + F.col("horizon") * step).alias("q50"))


def ridge_trend(obs: DataFrame, origin: int, h: int, penalty: float = 0.1) -> DataFrame:
    """Least-squares line whose slope is shrunk: the squared deviation of time grows by ``penalty`` of itself."""
    fit = train(obs, origin).groupBy(KEY).agg((F.regr_slope("value", "t") / (1 + penalty)).alias("b"), F.avg("value").alias("m"), F.avg("t").alias("c"))
    return _horizons(fit, h).select(KEY, "horizon", (F.col("m") + F.col("b") * (F.col("horizon") + origin - F.col("c"))).alias("q50"))


def penalty_grid(obs: DataFrame, origins, h: int, penalties=(0.05, 0.1, 0.2)) -> DataFrame:
    """(indicator, penalty, n, mae, best): absolute errors of the shrunken trend over rolling origins; the least, then the smallest penalty, is best."""
    from functools import reduce

    truth = obs.where("value IS NOT NULL").select(KEY, "t", F.col("value").alias("y"))
    runs = [rolling(obs, origins, ridge_trend, h, penalty=p).withColumn("penalty", F.lit(p)) for p in penalties]
    rows = reduce(DataFrame.union, runs).withColumn("t", F.col("origin") + F.col("horizon")).join(truth, [KEY, "t"])
    got = rows.groupBy(KEY, "penalty").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("q50"))).alias("mae"))
    best = got.groupBy(KEY).agg(F.min_by("penalty", F.struct("mae", "penalty")).alias("b"))
    return got.join(best, KEY).select(KEY, "penalty", "n", "mae", (F.col("penalty") == F.col("b")).alias("best"))


def smoothing(obs: DataFrame, origin: int, h: int, gain: float = 0.3) -> DataFrame:
    """Simple exponential smoothing with a fixed gain; a series is worked on by chunks of its steps."""
    level = scan.smoothed_level(train(obs, origin), gain)
    return _horizons(level.select(KEY, F.col("level").alias("q50")), h)


def local_level(obs: DataFrame, origin: int, h: int, noise: int = 1, points: int = 61, least: int = 5) -> DataFrame:
    """Local-level state space by maximum likelihood over a grid of signal-to-noise ratios, coarse and then fine.

    The filter starts diffuse; a gap counts as one step. ``noise`` is how often
    the observation variance enters the predictive variance (once by default).
    Indicators with fewer than ``least`` observed steps are left out.
    """
    each = scan.chunks(train(obs, origin, least))

    def fitted(grid: DataFrame) -> DataFrame:
        """Filter every (series, q); keep the likeliest, the smallest q among equals."""
        run = scan.level_filter(grid, [KEY, "q"]).withColumn("m", F.col("n") - 1)
        run = run.withColumn("s2", F.greatest(F.col("s") / F.col("m"), F.lit(1e-300)))
        run = run.withColumn("fit", -(F.col("m") * F.log("s2") + F.col("l")))
        best = run.groupBy(KEY).agg(F.max_by(F.struct("q", "s2", F.col("mean").alias("a"), F.col("variance").alias("p")), F.struct("fit", -F.col("q"))).alias("b"))
        return best.select(KEY, "b.*")

    at = lambda lo, width: F.expr(f"transform(sequence(0, {points - 1}), i -> pow(1e1, {lo} + i * {num(width / (points - 1))}))")
    coarse = fitted(each.withColumn("q", F.explode(at("-6e0", 12.0))))
    width = 24.0 / (points - 1)
    near = each.join(coarse.select(KEY, F.log10("q").alias("c")), KEY)
    fine = fitted(near.withColumn("q", F.explode(at(f"c - {num(width / 2)}", width))))
    f = _horizons(fine, h)
    return quantiles(f, F.col("a"), F.sqrt(F.col("s2") * (F.col("p") + (F.col("horizon") - 1) * F.col("q") + noise)))


def uniform_sql(key: str, dialect: str = "spark") -> str:
    """A number in (0, 1) from an integer key: a 32-bit mix of xor-shifts and multiplications, with equal values in Spark and DuckDB."""
    if dialect == "spark":
        fold = lambda x, n: f"(({x}) ^ shiftright({x}, {n}))"
    else:
        fold = lambda x, n: f"xor({x}, ({x}) >> {n})"
    x = f"(CAST({key} AS BIGINT) % 4294967296)"
    x = f"(({fold(x, 16)} * 569420461) % 4294967296)"
    x = f"(({fold(x, 15)} * 1935289751) % 4294967296)"
    return f"(({fold(x, 15)}) + 5e-1) / 4294967296e0"


def _each_path(params: DataFrame, n_paths: int, h: int) -> DataFrame:
    """A row for each path and horizon. Paths are dealt out before their steps are drawn, so that one indicator's are drawn by many tasks."""
    rows = params.withColumn("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_paths - 1).cast("long"))))
    return _horizons(rows.repartition(int(params.sparkSession.conf.get("spark.sql.shuffle.partitions")), KEY, "path"), h)


def paths(params: DataFrame, n_paths: int, h: int, seed: int = 12345, rate: float = 0.0, scale: float = 2.0) -> DataFrame:
    """Monte-Carlo paths ``(indicator, path, horizon, y)`` by counter-based draws, so the partitioning changes nothing.

    ``params`` adds an integer ``no`` to the moments. Shocks: a Poisson number,
    by its inverse distribution function, sums to one normal draw.
    """
    rows = _each_path(params, n_paths, h)
    u = lambda s: uniform_sql(f"({seed} + no * 7368787 + path * 7919 + horizon * 104729 + {s} * 15485863)")
    normal = lambda s: f"sqrt(-2e0 * ln({u(s)})) * cos(2e0 * pi() * {u(s + 1)})"
    rows = rows.withColumn("eta", F.expr(f"drift + sd_state * {normal(1)}")).withColumn("eps", F.expr(f"sd_obs * {normal(3)}"))
    if rate:
        rows = rows.withColumn("u", F.expr(u(5))).withColumn("count", F.expr(poisson_sql("u", rate)))
        rows = rows.withColumn("eta", F.expr(f"eta + sqrt(count) * {num(scale)} * sd_state * {normal(6)}"))
    w = Window.partitionBy(KEY, "path").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(KEY, "path", "horizon", (F.col("last") + F.sum("eta").over(w) + F.col("eps")).alias("y"))


def standardised_steps(obs: DataFrame) -> DataFrame:
    """For each indicator the mean and deviation of its values and, of the standardised ones, drift, step deviation (0.1 at least) and the last."""
    every, w = Window.partitionBy(KEY), Window.partitionBy(KEY).orderBy("t")
    rows = obs.withColumn("mean", F.avg("value").over(every)).withColumn("sd", F.stddev_samp("value").over(every))
    rows = rows.withColumn("z", F.try_divide(F.col("value") - F.col("mean"), F.col("sd")))
    rows = rows.withColumn("dz", F.col("z") - F.lag("z").over(w))
    got = rows.groupBy(KEY).agg(F.max("mean").alias("mean"), F.max("sd").alias("sd"), F.avg("dz").alias("drift"), F.stddev_samp("dz").alias("step"), F.max_by("z", "t").alias("last"))
    return got.withColumn("drift", F.coalesce("drift", F.lit(0.0))).withColumn("step", F.greatest(F.coalesce("step", F.lit(0.1)), F.lit(0.1)))


def jump_sql(uniform, df: int) -> str:
    """A Student-t draw: a normal over the root of a mean of ``df`` squared normals. Two squares at a time are one logarithm."""
    normal = lambda s: f"sqrt(-2e0 * ln({uniform(s)})) * cos(2e0 * pi() * {uniform(s + 1)})"
    squares = [f"(-2e0 * ln({uniform(8 + k)}))" for k in range(df // 2)]
    if df % 2:
        squares.append(f"pow({normal(8 + df // 2)}, 2e0)")
    return f"({normal(6)}) / sqrt(({' + '.join(squares)}) / {num(df)})"


def jump_paths(params: DataFrame, n_paths: int, h: int, seed: int = 12345, rate: float = 0.2, df: int = 4) -> DataFrame:
    """Paths of the standardised walk whose step gains a Student-t jump where a Poisson count is above 0, in the data's own units.

    ``params`` are those of :func:`standardised_steps` with an integer ``no``;
    draws are counter-based as in :func:`paths`.
    """
    if df < 1:
        raise ValueError("df must be 1 or more")
    rows = _each_path(params, n_paths, h)
    u = lambda s: uniform_sql(f"({seed} + no * 7368787 + path * 7919 + horizon * 104729 + {s} * 15485863)")
    noise = f"sqrt(-2e0 * ln({u(1)})) * cos(2e0 * pi() * {u(2)})"
    eta = F.expr(f"drift + step * ({noise} + CASE WHEN {poisson_sql(u(5), rate)} > 0 THEN {jump_sql(u, df)} ELSE 0e0 END)")
    w = Window.partitionBy(KEY, "path").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("eta", eta).select(KEY, "path", "horizon", (F.col("mean") + F.col("sd") * (F.col("last") + F.sum("eta").over(w))).alias("y"))


def local_trend(obs: DataFrame, origin: int, h: int, level_var: float = 0.1, trend_var: float = 0.1) -> DataFrame:
    """Level and trend by a Kalman filter over standardised values without observation noise; bands widen with the root of the horizon.

    The filter starts from the first two values; indicators need three. The
    level is the last value, so the filter carries the trend and its variance,
    and its gains are the same for values that are not standardised.
    """
    rows = train(obs, origin)
    spread = rows.groupBy(KEY).agg(F.stddev_samp("value").alias("sd"))
    run = _horizons(scan.trend_filter(rows, level_var, trend_var).join(spread, KEY), h)
    return quantiles(run, F.col("last") + F.col("horizon") * F.col("trend"), F.col("sd") * F.sqrt("horizon"))


def poisson_sql(u: str, rate: float) -> str:
    """A Poisson count by its inverse distribution function; counts rarer than 1e-13 altogether are the last one."""
    import math

    total, term, k, cases = 0.0, math.exp(-rate), 0, []
    if not 0 <= rate < 700:
        raise ValueError("rate must be from 0 to 700")
    while 1 - total > 1e-13 and (k <= rate or term > 1e-17):
        total += term
        cases.append(f"WHEN {u} <= {num(total)} THEN {k}")
        k += 1
        term *= rate / k
    return f"(CASE {' '.join(cases)} ELSE {k} END)"


def _midpoints(sim: DataFrame, probs: dict[str, float], many: bool) -> DataFrame:
    if many:
        return ordered.quantiles(sim, [KEY, "horizon"], "y", probs)
    q = sim.groupBy(KEY, "horizon").agg(F.percentile("y", F.array(*[F.lit(p) for p in probs.values()])).alias("q"))
    return q.select(KEY, "horizon", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(probs)])


def path_quantiles(sim: DataFrame, many: bool = False) -> DataFrame:
    """Exact linear-interpolated 5, 50 and 95 per cent points by indicator and horizon.

    A task holds the values of one horizon's paths, whose number is a parameter
    of the simulation; with ``many`` they are counted in ordered cells instead.
    """
    return _midpoints(sim, {"q05": 0.05, "q50": 0.5, "q95": 0.95}, many)


def scored_and_scenario(sim: DataFrame, scored: int = 15) -> DataFrame:
    """Quantiles of one simulation over the scenario's horizons; ``scored`` marks those that truth can judge."""
    return path_quantiles(sim).withColumn("scored", F.col("horizon") <= scored)


def ecc_reorder(sim: DataFrame, template: DataFrame) -> DataFrame:
    """Put each marginal's draws in the template's rank order (empirical copula coupling); marginals stay as they are.

    ``template``: ``(path, horizon, indicator, x)``. Ties rank by path.
    """
    rank = lambda v: F.row_number().over(Window.partitionBy(KEY, "horizon").orderBy(v, "path"))
    values = sim.select(KEY, "horizon", rank("y").alias("r"), "y")
    places = template.select(KEY, "horizon", rank("x").alias("r"), "path")
    return values.join(places, [KEY, "horizon", "r"]).select(KEY, "path", "horizon", "y")


def event_rates(sim: DataFrame, threshold: str = "threshold", many: bool = False) -> DataFrame:
    """Share of paths below each indicator's threshold, and whether the median is; ``many`` as in :func:`path_quantiles`."""
    rate = F.avg((F.col("y") < F.col(threshold)).cast("int")).alias("rate")
    if not many:
        return sim.groupBy(KEY, "horizon").agg(rate, (F.percentile("y", F.lit(0.5)) < F.max(threshold)).alias("flag"))
    rates = sim.groupBy(KEY, "horizon").agg(rate, F.max(threshold).alias("_top"))
    both = rates.join(_midpoints(sim, {"_mid": 0.5}, True), [KEY, "horizon"], "left")
    return both.select(KEY, "horizon", "rate", (F.col("_mid") < F.col("_top")).alias("flag"))
