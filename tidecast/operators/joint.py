"""Models that hold several indicators together: a Gaussian copula for simulated paths, and a filter of all levels and trends.

A joint model has up to ``MOST`` indicators; its matrices have a row for each.
More are refused. Steps and paths are as many as there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import Z95
from tidecast.operators.forecast import train, uniform_sql
from tidecast.operators.series import KEY, complete_steps, correlation_pairs

MOST = 256
#: Pivots of a factor below this are read as zero: the indicator is a combination of those before it.
PIVOT = 1e-12

# -- copula -------------------------------------------------------------------


def factor(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """One row (names, l): the indicators in order, and the rows of a lower triangular factor of their correlation matrix.

    ``pairs`` is what :func:`correlation_pairs` gives; unknown correlations are
    0. Where pairwise gaps leave a matrix that is none of correlations, pivots
    stop at 0, and each row is brought to length 1, so that every latent stays
    standard normal.
    """
    both = pairs.select("a", "b", "corr").union(pairs.select("b", "a", "corr"))
    known = both.where("corr IS NOT NULL").groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "corr"))).alias("m"))
    ordered = names.select(F.col(KEY).alias("a")).distinct()
    every = ordered.agg(F.sort_array(F.collect_set("a")).alias("names")).where("size(names) > 0")
    few = F.when(F.size("names") <= MOST, F.col("names")).otherwise(F.raise_error(F.lit(f"a joint model has up to {MOST} indicators")))
    rows = every.withColumn("names", few).select("names", F.posexplode("names").alias("i", "a")).join(known, "a", "left")
    row = F.expr("transform(names, (n, j) -> CASE WHEN j = i THEN 1e0 ELSE coalesce(m[n], 0e0) END)")
    matrix = rows.groupBy("names").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("c")))), lambda r: r["c"]).alias("c"))  # up to MOST rows
    dot = "aggregate(zip_with(slice(r, 1, j), slice({0}, 1, j), (x, y) -> x * y), 0e0, (s, x) -> s + x)"
    below = f"CASE WHEN get(get(l, j), j) > 0e0 THEN (get(get(c, i), j) - {dot.format('get(l, j)')}) / get(get(l, j), j) ELSE 0e0 END"
    pivot = f"get(get(c, i), i) - {dot.format('r')}"
    entry = f"CASE WHEN j < i THEN {below} WHEN {pivot} > {PIVOT:e} THEN sqrt({pivot}) ELSE 0e0 END"
    line = f"aggregate(sequence(0, i), CAST(array() AS array<double>), (r, j) -> concat(r, array({entry})))"
    unit = f"get(transform(array({line}), r -> transform(r, x -> x / sqrt(aggregate(r, 0e0, (s, y) -> s + y * y)))), 0)"
    return matrix.select("names", F.expr(f"aggregate(sequence(0, size(c) - 1), CAST(array() AS array<array<double>>), (l, i) -> concat(l, array({unit})))").alias("l"))


def factor_rows(factored: DataFrame) -> DataFrame:
    """(i, j, l): the factor as a table, its zeros above the diagonal left out."""
    rows = factored.select("names", F.posexplode("l").alias("i", "r")).select("names", "i", F.posexplode("r").alias("j", "l"))
    return rows.select(F.get("names", F.col("i")).alias("i"), F.get("names", F.col("j")).alias("j"), "l")


def latents(factored: DataFrame, n_paths: int, seed: int = 12345) -> DataFrame:
    """(indicator, path, x): standard normals that are correlated between the indicators of a path and independent between paths.

    Draws are counter-based: the partitioning changes nothing.
    """
    u = lambda s: uniform_sql(f"({seed} + path * 7919 + j * 104729 + {s} * 15485863)")
    rows = factored.sparkSession.range(n_paths).select(F.col("id").alias("path")).crossJoin(F.broadcast(factored))  # one row, MOST * MOST numbers
    rows = rows.withColumn("e", F.expr(f"transform(sequence(0, size(names) - 1), j -> sqrt(-2e0 * ln({u(1)})) * cos(2e0 * pi() * {u(2)}))"))
    dot = "aggregate(zip_with(r, slice(e, 1, size(r)), (x, y) -> x * y), 0e0, (s, x) -> s + x)"
    return rows.select("path", "names", F.posexplode(F.expr(f"transform(l, r -> {dot})")).alias("i", "x")).select(F.get("names", F.col("i")).alias(KEY), "path", "x")


def couple(sim: DataFrame, latent: DataFrame) -> DataFrame:
    """Give each marginal's draws to the paths in the order of the indicator's latents; marginals stay as they are.

    Ties rank by path. A path keeps one latent of an indicator over all
    horizons. Paths without latent, and latents without path, go.
    """
    values = sim.select(KEY, "horizon", F.row_number().over(Window.partitionBy(KEY, "horizon").orderBy("y", "path")).alias("r"), "y")
    places = latent.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("x", "path")).alias("r"), "path")
    return values.join(places, [KEY, "r"]).select(KEY, "path", "horizon", "y")


def latent_correlations(factored: DataFrame, latent: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, corr, target, sample, n, within): a pair's correlation in the data, that of the factor, and that of the drawn latents; within four standard errors of the factor's?"""
    a, b = (latent.select(F.col(KEY).alias(c), "path", F.col("x").alias(f"x{c}")) for c in "ab")
    sample = a.join(b, "path").where("a < b").groupBy("a", "b").agg(F.corr("xa", "xb").alias("sample"), F.count("*").alias("n"))
    made = factored.select("names", F.posexplode("l").alias("i", "r"), "l").select("names", "i", "r", F.posexplode("l").alias("j", "s")).where("j > i")
    dot = F.aggregate(F.zip_with("r", F.slice("s", F.lit(1), F.size("r")), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    made = made.select(F.get("names", F.col("i")).alias("a"), F.get("names", F.col("j")).alias("b"), dot.alias("target"))
    got = sample.join(made, ["a", "b"]).join(pairs.select("a", "b", "corr"), ["a", "b"], "left")
    return got.withColumn("within", F.abs(F.col("sample") - F.col("target")) <= 4 * (1 - F.col("target") ** 2) / F.sqrt("n") + 1e-9)


# -- all levels and trends ------------------------------------------------------

#: Steps of a chunk; the filter's elements of a chunk are composed by its task.
STEPS = 512


def _step(y: np.ndarray, f: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple:
    """What one step does to any state before it: predict, then see ``y``, the first half of the state."""
    k = len(y)
    s = np.linalg.inv(q[:k, :k] + r)
    gain = q[:, :k] @ s
    keep = np.eye(2 * k)
    keep[:, :k] -= gain
    hf = f[:k]
    return keep @ f, gain @ y, keep @ q, hf.T @ s @ y, hf.T @ s @ hf


def _then(i: tuple, j: tuple) -> tuple:
    """Element ``i`` and then ``j``."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = i, j
    eye = np.eye(len(b1))
    m = np.linalg.solve((eye + c1 @ j2).T, a2.T).T
    n = np.linalg.solve((eye + j2 @ c1).T, a1).T
    c, jj = m @ c1 @ a2.T + c2, n @ j2 @ a1 + j1
    return m @ a1, m @ (b1 + c1 @ e2) + b2, (c + c.T) / 2, n @ (e2 - j2 @ b1) + e1, (jj + jj.T) / 2


def _flat(element: tuple) -> list[float]:
    return np.concatenate([x.ravel() for x in element]).tolist()


def _unflat(x: np.ndarray, n: int) -> tuple:
    a, b, c, e, j = np.split(x, np.cumsum([n * n, n, n * n, n]))
    return a.reshape(n, n), b, c.reshape(n, n), e, j.reshape(n, n)


def joint_states(obs: DataFrame, origin: int, level_var: float = 0.1, trend_var: float = 0.1, noise_var: float = 0.1, prior: float = 1.0) -> DataFrame:
    """One row (names, mean, sd, state, cov): the filtered levels and trends of all indicators, in standardised units, and their covariance, flat.

    Steps at which an indicator has no value are left out. Levels and trends
    move with the correlations of the indicators, ``level_var`` and
    ``trend_var`` a step; each value has a noise of its own. Before the first
    step the state is 0 with variance ``prior``. The steps of a chunk become
    one element in a task of its own, and the elements are composed.
    """
    rows = complete_steps(train(obs, origin))
    spec = rows.groupBy(KEY).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).orderBy(KEY).limit(MOST + 1).collect()
    if len(spec) > MOST:
        raise ValueError(f"a joint model has up to {MOST} indicators")
    names, k = [r[KEY] for r in spec], len(spec)
    mean, sd = np.array([r["mean"] for r in spec]), np.array([r["sd"] or 1.0 for r in spec])
    corr = np.eye(k)
    for r in correlation_pairs(rows).collect():  # MOST * MOST rows at most
        if r["corr"] is not None:
            a, b = names.index(r["a"]), names.index(r["b"])
            corr[a, b] = corr[b, a] = r["corr"]
    f = np.block([[np.eye(k), np.eye(k)], [np.zeros((k, k)), np.eye(k)]])
    q = np.zeros((2 * k, 2 * k))
    q[:k, :k], q[k:, k:] = level_var * corr, trend_var * corr
    noise = noise_var * np.eye(k)

    def fold(t: pa.Table) -> pa.Table:
        at = np.argsort(t.column("t").to_numpy())
        y = t.column("y").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)[at]
        element = None
        for v in (y - mean) / sd:
            one = _step(v, f, q, noise)
            element = one if element is None else _then(element, one)
        return pa.table({"chunk": [t.column("chunk")[0].as_py()], "e": pa.array([_flat(element)], pa.list_(pa.float64()))})

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("e").to_pylist():
                element = None
                for x in rows:
                    one = _unflat(np.array(x["e"]), 2 * k)
                    element = one if element is None else _then(element, one)
                a, b, c, e, j = element
                p0 = prior * np.eye(2 * k)
                m = np.linalg.solve((np.eye(2 * k) + p0 @ j).T, a.T).T
                state, cov = m @ p0 @ e + b, m @ p0 @ a.T + c
                out = [[names], [mean.tolist()], [sd.tolist()], [state.tolist()], [cov.ravel().tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["names", "mean", "sd", "state", "cov"])

    if not k:
        return obs.sparkSession.createDataFrame([], "names array<string>, mean array<double>, sd array<double>, state array<double>, cov array<double>")
    steps = rows.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct(KEY, "value"))), lambda s: s["value"]).alias("y"))  # a value for each indicator
    steps = steps.withColumn("chunk", F.floor(F.col("t") / STEPS))
    elements = steps.groupBy("chunk").applyInArrow(fold, "chunk long, e array<double>")
    one = elements.agg(F.array_sort(F.collect_list(F.struct("chunk", "e"))).alias("e")).where("size(e) > 0")  # an element for STEPS steps
    return one.mapInArrow(close, "names array<string>, mean array<double>, sd array<double>, state array<double>, cov array<double>")


def joint_trend(obs: DataFrame, origin: int, h: int, noise_var: float = 0.1, level_var: float = 0.1, trend_var: float = 0.1, prior: float = 1.0) -> DataFrame:
    """Quantiles of every indicator from the joint filter; the bands are those of a value, its state's spread and noise.

    At horizon ``x`` a level has gathered its own moves and, by each trend move,
    one step fewer every time.
    """
    got = joint_states(obs, origin, level_var, trend_var, noise_var, prior)
    own = got.select("*", F.posexplode("names").alias("i", KEY)).withColumn("k", F.size("names"))
    cell = lambda a, b: F.get("cov", (F.col(a) if isinstance(a, str) else a) * 2 * F.col("k") + b)
    i, j = F.col("i"), F.col("i") + F.col("k")
    own = own.select(KEY, F.get("mean", i).alias("mean"), F.get("sd", i).alias("sd"), F.get("state", i).alias("level"), F.get("state", j).alias("trend"), cell(i, i).alias("vl"), cell(i, j).alias("vx"), cell(j, j).alias("vt"))
    rows = own.withColumn("horizon", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(h).cast("long"))))
    x = F.col("horizon")
    moved = x * level_var + trend_var * (x - 1) * x * (2 * x - 1) / 6
    variance = F.col("vl") + 2 * x * F.col("vx") + x * x * F.col("vt") + moved + noise_var
    mu, sigma = F.col("mean") + F.col("sd") * (F.col("level") + x * F.col("trend")), F.col("sd") * F.sqrt(variance)
    return rows.select(KEY, "horizon", (mu - Z95 * sigma).alias("q05"), mu.alias("q50"), (mu + Z95 * sigma).alias("q95"))
