"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Centroids, fitted on a bounded sample, cut the vectors into lists; every vector
is put into the list of its nearest centroid. A query probes the lists whose
centroids have the largest inner product with it. Within a probed list all
vectors are turned by one random rotation and read in blocks of columns: after
each block the partial squared distance of a candidate is tested against the
distance that it may have at most to enter the query's best so far. Under a
random rotation the first ``d`` of ``D`` coordinates hold a Beta distributed
share of the squared distance; a partial distance above that share's quantile
rejects the candidate, and its other columns are not read. What is left is
computed in double precision on the original vectors.

Largest inner products are smallest distances of a query once the norms are
known, so every candidate has a radius of its own.

How many lists a query probes isn't guessed: a bounded sample of the queries is
compared with every vector, and the least number of lists that holds ``recall``
of their true neighbours is used for all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, map_arrow, small, table
from tidecast.llm.embeddings import rotation

#: Vectors a list on average, lists at most, and vectors of the sample that the lists are fitted on, on average.
LIST, MOST_LISTS, SAMPLE = 1024, 1024, 16384
#: Queries of the sample that sets the number of probed lists, on average.
TRIALS = 200
#: Columns of a block, and the chance that a test rejects a candidate at exactly the distance it may have.
COLUMNS, ALPHA = 16, 1e-3
#: Candidates and queries of a task at most, on average.
CANDIDATES, QUERIES = 16384, 8192
KEY = ["dim", "list", "cb", "qb"]


@lru_cache(64)
def shares(dim: int) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The ends of the column blocks, and the share of a squared distance that its coordinates up to each end exceed with chance ``ALPHA``."""
    ends = [*range(COLUMNS, dim, COLUMNS), dim]
    x = np.linspace(0, 1, 20001)[1:-1]
    out = []
    for d in ends[:-1]:
        log = (d / 2 - 1) * np.log(x) + ((dim - d) / 2 - 1) * np.log1p(-x)
        mass = np.cumsum(np.exp(log - log.max()))
        out.append(float(x[min(np.searchsorted(mass, (1 - ALPHA) * mass[-1]), len(x) - 1)]))
    return tuple(ends), (*out, 1.0)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added from the first column to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def vectors_of(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, dim)


def best(k: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the ``k`` largest scores of each row, equal ones by smaller id, in this order."""
    order = np.lexsort((ids, -scores, rows))
    at = rows[order]
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, int)
    rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    return order[rank < k]


class Nearest:
    """The best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.rows, self.scores, self.ids = k, np.empty(0, int), np.empty(0), np.empty(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        rows, scores, ids = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        keep = best(self.k, rows, scores, ids)
        self.rows, self.scores, self.ids = rows[keep], scores[keep], ids[keep]
        count = np.bincount(self.rows, minlength=len(self.least))
        last = np.cumsum(count) - 1
        full = count == self.k
        self.least[full] = self.scores[last[full]]


def scan(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> Nearest:
    """The ``k`` nearest candidates ``x`` of each query, but its own rows; ``least`` is the score that an answer must reach."""
    dim = q.shape[1]
    ends, share = shares(dim)
    turn = rotation(dim).T
    qr, xr = q @ turn, x @ turn
    starts = [0, *ends[:-1]]
    qn, xn = (np.cumsum(np.stack([np.einsum("ij,ij->i", v[:, a:b], v[:, a:b]) for a, b in zip(starts, ends)], 1), 1) for v in (qr, xr))
    found = Nearest(len(q), k)
    for ca in range(0, len(x), 512):
        cs = slice(ca, min(ca + 512, len(x)))
        for qa in range(0, len(q), 256):
            qs = slice(qa, min(qa + 256, len(q)))
            need = np.maximum(least[qs], found.least[qs])
            whole = qn[qs, -1:] + xn[cs, -1][None]
            radius = whole - 2 * need[:, None]  # squared distance at that score
            slack = 1e-9 * whole
            alive = own[qs, None] != ids[cs][None]
            product = np.zeros(alive.shape)
            i = j = None
            for b, (a, e) in enumerate(zip(starts, ends)):
                if i is None and b and alive.sum() * 8 < alive.size:  # few are left: go on with pairs
                    i, j = np.nonzero(alive)
                    product, radius, slack = product[i, j], radius[i, j], slack[i, j]
                if i is None:
                    product += qr[qs, a:e] @ xr[cs, a:e].T
                    alive &= qn[qs, b, None] + xn[cs, b][None] - 2 * product <= share[b] * radius + slack
                elif len(i):
                    product += np.einsum("ij,ij->i", qr[qa + i, a:e], xr[ca + j, a:e])
                    good = qn[qa + i, b] + xn[ca + j, b] - 2 * product <= share[b] * radius + slack
                    i, j, product, radius, slack = i[good], j[good], product[good], radius[good], slack[good]
            if i is None:
                i, j = np.nonzero(alive)
            for at in range(0, len(i), 65536):
                ii, jj = qa + i[at : at + 65536], ca + j[at : at + 65536]
                score = inner(q[ii], x[jj])
                good = score >= np.maximum(least[ii], found.least[ii])
                found.add(ii[good], score[good], ids[jj[good]])
    return found


def _able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that take part, as bytes, by length and digest."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        lists = batch.column(1)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        starts = np.cumsum(size) - size
        out: list[tuple] = []
        for dim in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == dim)
            x = flat[starts[rows][:, None] + np.arange(dim)] + 0.0  # -0.0 is 0.0
            able = np.isfinite(x).all(1) & (x != 0).any(1)
            for i, v in zip(rows[able].tolist(), x[able]):
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), np.int64).tolist()
                if ids[i] is not None:
                    out.append((ids[i], dim, d1, d2, v.tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["id", "dim", "d1", "d2", "vec"])


def fit_lists(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` centroids of a sample."""
    rng = np.random.default_rng(len(x))
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest_list(x, centre)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centre


def nearest_list(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre * centre).sum(1)[None] - 2 * x @ centre.T, axis=1)


def probe_order(q: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argsort(-(q @ centre.T), axis=1, kind="stable")


def _by_dim(dims: np.ndarray):
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def _listed(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.zeros(batch.num_rows, np.int32)
            for dim, rows in _by_dim(batch.column("dim").to_numpy()):
                if dim in centres:
                    own[rows] = nearest_list(vectors_of(batch.column("vec").take(pa.array(rows)), dim), centres[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "list"])

    return run


def _probing(centres: dict[int, np.ndarray], probes: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[0]] * batch.num_rows
            for dim, rows in _by_dim(batch.column("dim").to_numpy()):
                if dim in centres:
                    order = probe_order(vectors_of(batch.column("vec").take(pa.array(rows)), dim), centres[dim])
                    for i, o in zip(rows.tolist(), order[:, : probes.get(dim, len(centres[dim]))].tolist()):
                        out[i] = o
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "probes"])

    return run


def _brute(trials: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """For each query of the sample the ``k`` nearest of a task's vectors, with their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {dim: (np.empty(0, int), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32)) for dim in trials}
        for batch in batches:
            for dim, rows in _by_dim(batch.column("dim").to_numpy()):
                if dim not in trials:
                    continue
                own, q = trials[dim]
                ids, lists = batch.column("id").to_numpy()[rows], batch.column("list").to_numpy()[rows]
                score = q @ vectors_of(batch.column("vec").take(pa.array(rows)), dim).T
                score[own[:, None] == ids[None]] = -np.inf
                top = np.argpartition(-score, min(k, score.shape[1] - 1), axis=1)[:, :k]
                at = np.repeat(np.arange(len(q)), top.shape[1])
                top = top.ravel()
                new = (at, score[at, top], ids[top], lists[top])
                new = tuple(c[np.isfinite(new[1])] for c in new)
                old = tuple(np.concatenate(c) for c in zip(kept[dim], new))
                keep = best(k, *old[:3])
                kept[dim] = tuple(c[keep] for c in old)
        for dim, (at, score, ids, lists) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(at.astype(np.int32)), pa.array(score), pa.array(ids), pa.array(lists)], ["dim", "trial", "score", "id", "list"])

    return run


def _scanned(k: int):
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        kinds = {"qid": pa.int64(), "q1": pa.int64(), "q2": pa.int64(), "id": pa.int64(), "score": pa.float64()}
        if not q.num_rows or not c.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        dim = q.column("dim")[0].as_py()
        col = lambda t, n: t.column(n).to_numpy()
        found = scan(vectors_of(q.column("vec"), dim), vectors_of(c.column("vec"), dim), col(q, "qid"), col(c, "id"), col(q, "least"), k)
        rows = found.rows
        return pa.table({"qid": col(q, "qid")[rows], "q1": col(q, "q1")[rows], "q2": col(q, "q2")[rows], "id": found.ids, "score": found.scores})

    return run


def _search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Scan every (query, probed list) of ``queries`` (with ``list``): tasks are a block of a list's candidates and a block of its queries."""
    cell = ["dim", "list"]
    blocks = lambda df, n, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = blocks(candidates, CANDIDATES, "cbs").join(blocks(queries, QUERIES, "qbs"), cell)
    sizes = small(sizes)
    split = lambda key, n: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, cell).withColumn("qb", split(("qid", "q1"), "qbs")).withColumn("cb", every("cbs")).select(*KEY, "qid", "q1", "q2", "vec", "least")
    right = candidates.join(sizes, cell).withColumn("cb", split(("id", "d1"), "cbs")).withColumn("qb", every("qbs")).select(*KEY, "id", "vec")
    return left.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInArrow(_scanned(k), "qid long, q1 long, q2 long, id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid", "q1", "q2").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.97, vec_id: str = "vec_id", embedding: str = "embedding", per_list: int = LIST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k`` rows of the largest inner product found.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without id; only vectors of one length are compared.
    Rows that repeat an id with its vector count once; an id with several
    vectors is as many rows, and as a query has as many answers. Equal scores
    go by the smaller id. Columns other than the two named are not read. An
    empty table gives an empty result.

    ``recall`` is the share of true neighbours that the probed lists must hold,
    as measured on a sample of queries. Of equal vectors only the ``k + 1``
    with the smallest ids can be in any answer, so the others are no
    candidates; all may be queries.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    able = map_arrow(rows, _able, "id long, dim int, d1 long, d2 long, vec binary")
    ready = scratch.keep(able.groupBy("id", "dim", "d1", "d2").agg(F.first("vec").alias("vec")))
    totals = {r.dim: (r.n, r.q) for r in ready.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).collect()}  # a row for each length

    def sample(df: DataFrame, seed: int, want: int, of: int) -> dict[int, list]:
        share = F.pmod(F.xxhash64(F.lit(seed), "id", "d1"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, want / max(of, 1)))
        out: dict[int, list] = {}
        for r in df.where(share).select("dim", "id", "vec").orderBy("dim", "id", "vec").collect():  # about ``want`` rows
            out.setdefault(r.dim, []).append((r.id, bytes(r.vec)))
        return out

    matrix = lambda got, dim: np.frombuffer(b"".join(v for _, v in got), float).reshape(-1, dim)
    centres: dict[int, np.ndarray] = {}
    if any(n > per_list for n, _ in totals.values()):
        for dim, got in sample(ready, 1, SAMPLE, sum(n for n, _ in totals.values())).items():
            lists = min(math.ceil(totals[dim][0] / per_list), MOST_LISTS, len(got) // 16)
            if lists > 1:
                centres[dim] = fit_lists(matrix(got, dim), lists)
    copy = Window.partitionBy("dim", "d1", "d2").orderBy("id")
    few = ready.withColumn("_n", F.row_number().over(copy)).where(F.col("_n") <= k + 1).drop("_n")
    kind = "id long, dim int, d1 long, d2 long, vec binary, list int"
    candidates = scratch.keep(map_arrow(few, _listed(centres), kind))
    asked = ready.where(F.col("id") % every == 0)

    probes: dict[int, int] = {}
    if centres:
        got = {dim: (np.array([i for i, _ in rows]), matrix(rows, dim)) for dim, rows in sample(asked, 2, TRIALS, sum(q for _, q in totals.values())).items() if dim in centres}
        true = map_arrow(candidates, _brute(got, k), "dim int, trial int, score double, id long, list int")
        best_of = Window.partitionBy("dim", "trial").orderBy(F.desc("score"), "id")
        true = true.withColumn("_n", F.row_number().over(best_of)).where(F.col("_n") <= k).select("dim", "trial", "list").collect()  # k a trial
        for dim, (_, q) in got.items():
            place = np.argsort(probe_order(q, centres[dim]), axis=1)
            at = np.array([place[r.trial, r.list] for r in true if r.dim == dim])
            if len(at):
                probes[dim] = int(np.quantile(at, recall, method="inverted_cdf")) + 1
    queries = scratch.keep(map_arrow(asked, _probing(centres, probes), "id long, dim int, d1 long, d2 long, vec binary, probes array<int>"))
    queries = queries.withColumnsRenamed({"id": "qid", "d1": "q1", "d2": "q2"})
    # twice as many lists a round: what was found gives the score that candidates of the next lists must reach
    own, most, lo, hi = ["qid", "q1", "q2"], max(probes.values(), default=1), 0, 1
    found = None
    while lo < most:
        asking = queries.where(F.size("probes") > lo)
        if found is None:
            asking = asking.withColumn("least", F.lit(float("-inf")))
        else:
            reached = found.groupBy(*own).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
            asking = asking.join(reached, own, "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        got = _search(asking.withColumn("list", F.explode(F.slice("probes", lo + 1, hi - lo))), candidates, k)
        found = scratch.keep(ranked(got if found is None else found.drop("rank").union(got), k))
        lo, hi = hi, 2 * hi
    return scratch.result(found.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score"))


def op13_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: Exact; the search finds the same wherever the lists hold all neighbours, as on tables of one list.
ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, q.x AS qx, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, qx ORDER BY score DESC, vec_id) AS n FROM p
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
