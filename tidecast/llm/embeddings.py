"""Near-duplicate embeddings by randomised-rotation binary codes.

Every vector is brought to unit length and turned by one random rotation; the
signs of its coordinates are its code, and the inner product of the vector with
its own code is stored as a correction factor. For a pair, the product of one
vector with the other's code, divided by that factor, is an unbiased estimate
of the cosine. The estimate's confidence bound and an outright bound decide
which pairs are computed again exactly, in double precision: a pair is passed
over only if both lie below the threshold, so no link is lost to the codes.

Labels of any size are compared whole: they are cut into blocks and pairs of
blocks are tasks of bounded size; each returns counts and a spanning forest of
its links, never all pairs. Blocks of large labels are wider, so that a vector
goes to fewer pairs of them.

Only on request (``exact=False``) a label of more than ``EXACT_BLOCKS`` blocks
is not compared as a whole: runs of bits of further rotated codes, as long as
its size asks for, cut it into buckets, many times over, and pairs that share a
bucket are compared as before. The number of cuts follows from the chance that
a pair at the threshold shares no bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, connected_components, map_arrow, table

BLOCK = 2048
#: Labels of more blocks than these have wider ones, of WIDE components; on request they are compared by buckets of BUCKET vectors on average.
EXACT_BLOCKS, BUCKET = 16, 512
#: Components in a wide block, and pairs that are estimated at a time.
WIDE, AT_ONCE = 1 << 20, 1 << 21
#: Chance that a pair at the threshold shares no bucket; closer pairs miss less often.
MISS = 1e-3
#: Standard errors to each side of an estimate.
EPSILON = 4.0


@lru_cache(64)
def rotation(dim: int, number: int = 0) -> np.ndarray:
    """A fixed random orthogonal matrix; each ``number`` has one of its own."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction factors of unit vectors (n, dim)."""
    turned = x @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        starts = np.cumsum(size) - size
        out: list[tuple] = [(0, None, None, None, None, None)] * len(size)
        for dim in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == dim)
            x = flat[starts[rows][:, None] + np.arange(dim)]
            able = np.isfinite(x).all(1) & (x != 0).any(1)
            rows, x = rows[able], x[able]
            if not len(rows):
                continue
            unit = x / np.abs(x).max(1, keepdims=True)
            unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
            code, factor = encode(unit)
            for i, v, u, c, f in zip(rows.tolist(), x, unit, code, factor.tolist()):
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(v.tobytes()), np.int64).tolist()
                out[i] = (dim, d1, d2, u.tobytes(), c.tobytes(), f)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64()]
        cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], ["id", "label", "dim", "d1", "d2", "unit", "code", "factor"])


def cuts(n: int, threshold: float, exact: bool = False) -> tuple[int, int]:
    """(bits, buckets a vector) for a label of ``n`` vectors; (0, 1) for one that is compared whole."""
    if exact or n <= EXACT_BLOCKS * BLOCK:
        return 0, 1
    bits = math.ceil(math.log2(n / BUCKET))
    same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-same))) if same < 1 else 1


def bucket_keys(unit: np.ndarray, bits: int, number: int) -> np.ndarray:
    """(n, number) buckets of unit vectors: each ``bits`` signs of coordinates of further rotations."""
    if not bits:
        return np.zeros((len(unit), 1), np.int64)
    dim = unit.shape[1]
    signs = np.concatenate([unit @ rotation(dim, 1 + r).T > 0 for r in range(-(-bits * number // dim))], 1)[:, : bits * number]
    return signs.reshape(len(unit), number, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _bucketed(threshold: float, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dim = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("total", "dim"))
            unit = batch.column(batch.schema.get_field_index("unit")).to_pylist()
            keys: list[list[int]] = [[]] * len(n)
            for t, d in set(zip(n.tolist(), dim.tolist())):
                rows = np.flatnonzero((n == t) & (dim == d))
                got = bucket_keys(np.frombuffer(b"".join([unit[i] for i in rows]), float).reshape(-1, d), *cuts(t, threshold, exact))
                for i, k in zip(rows.tolist(), got.tolist()):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    return run


def candidates(turned: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (row of ``turned``, code) must be computed exactly."""
    dim = turned.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    product = turned.astype(np.float32) @ signs.T
    rest = np.sqrt(np.maximum(1 - factors**2, 0)).astype(np.float32)
    factor = np.maximum(factors, 1e-9).astype(np.float32)
    estimate = product / factor
    error = EPSILON * rest / factor / np.sqrt(max(dim - 1, 1))
    outright = product * factor + np.sqrt(np.maximum(1 - product * product, 0)) * rest
    slack = np.float32(threshold - 1e-4)
    return (estimate + error >= slack) | (outright >= slack)


def _links(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        ids, block, weight = (t.column(c).to_numpy() for c in ("id", "block", "weight"))
        order = np.lexsort((ids, block))
        ids, block, weight = ids[order], block[order], weight[order]
        dim = t.column("dim")[0].as_py()
        unit = np.frombuffer(b"".join(t.column("unit").to_pylist()), float).reshape(-1, dim)[order]
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        factors = t.column("factor").to_numpy()[order]
        turned = unit @ rotation(dim).T
        band = t.column("band")[0].as_py()
        keys = np.array(t.column("keys").to_pylist(), np.int64)[order] if band else None
        n = len(ids)
        same = t.column("x")[0].as_py() == t.column("y")[0].as_py()
        half = n if same else int((block == block[0]).sum())
        if not same and half == n:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        lo = 0 if same else half
        count = np.zeros(n, np.int64)
        root = np.arange(n)
        step = min(512, max(32, AT_ONCE // n))
        for at in range(0, half, step):
            to = min(at + step, half)
            maybe = candidates(turned[at:to], codes[lo:], factors[lo:], threshold)
            if same:
                maybe &= np.arange(lo, n)[None] > np.arange(at, to)[:, None]
            i, j = np.nonzero(maybe)
            good = np.empty(len(i), bool)
            for k in range(0, len(i), 65536):
                good[k : k + 65536] = np.einsum("ij,ij->i", unit[at + i[k : k + 65536]], unit[lo + j[k : k + 65536]]) >= threshold
            i, j = at + i[good], lo + j[good]
            if band:  # a pair counts in the first bucket that it shares
                first = np.concatenate([(keys[i[k : k + 65536]] == keys[j[k : k + 65536]]).argmax(1) for k in range(0, len(i), 65536)] or [np.empty(0, int)]) == band
                i, j = i[first], j[first]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            first = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1, [len(i)]]) if len(i) else [0]
            for a, b in zip(first[:-1], first[1:]):
                own = np.unique(root[np.append(j[a:b], i[a])])
                if len(own) > 1:
                    root[np.isin(root, own)] = own[0]
        got = count > 0
        return pa.table({"id": ids[got], "links": count[got], "root": ids[root[got]]})

    return run


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, exact: bool = True) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors are linked when their labels are equal and not null, they have the
    same length and their cosine in double precision is ``threshold`` or more.
    Vectors that are null, zero or hold null or non-finite components link
    with nothing, as do rows without id or label. Rows that repeat an id with
    the same vector and label count as one vector. ``component_id`` is the
    smallest id reachable. Vectors of any length are taken whole; columns other
    than the three named are not read. An empty table gives an empty result.

    Every pair of a label is compared, by codes and where they leave it open
    exactly, so the work grows with the square of its different vectors. With
    ``exact=False``, in labels of more than ``EXACT_BLOCKS * BLOCK`` different
    vectors a pair at the threshold is missed with probability ``MISS``, a
    closer one less often.
    """
    scratch = Scratch(vectors.sparkSession)
    keep = scratch.keep
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    kind = "id long, label string, dim int, d1 long, d2 long, unit binary, code binary, factor double"
    ready = keep(map_arrow(rows, _prepare, kind))
    able = ready.where("dim > 0 and id is not null and label is not null")
    # equal vectors are folded into one with a weight
    folded = able.groupBy("label", "dim", "d1", "d2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("weight"), *[F.first(c).alias(c) for c in ("unit", "code", "factor")])
    folded = keep(folded)
    totals = folded.groupBy("label", "dim").agg(F.count("*").alias("total"))
    # the same id may stand for several vectors: a node is an id with its vector
    kind = "label string, dim int, d1 long, id long, weight long, unit binary, code binary, factor double, total long, keys array<long>"
    bare = folded.join(totals, ["label", "dim"]).select("label", "dim", "d1", F.col("rep").alias("id"), "weight", "unit", "code", "factor", "total")
    keyed = keep(map_arrow(bare, _bucketed(threshold, exact), kind))
    cell = ["label", "dim", "band", "key"]
    each = keyed.select("*", F.posexplode("keys").alias("band", "key"))
    width = F.when(F.col("members") > EXACT_BLOCKS * BLOCK, F.greatest(F.lit(BLOCK), F.floor(F.lit(WIDE) / F.col("dim")))).otherwise(F.lit(BLOCK))
    sizes = each.groupBy(*cell).agg(F.count("*").alias("members")).where("members > 1").select(*cell, F.ceil(F.col("members") / width).cast("int").alias("blocks"))
    blocks = each.join(keep(sizes), cell).withColumn("block", F.pmod(F.xxhash64("id", "d1"), "blocks").cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *cell, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "weight", "block", "unit", "code", "factor", F.when(F.col("band") > 0, F.slice("keys", F.lit(1), F.col("band") + 1)).alias("keys")
    )
    found = keep(dealt.groupBy(*cell, "x", "y").applyInArrow(_links(threshold), "id long, links long, root long"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), scratch=scratch)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    near = links.join(components, "id", "left").withColumnRenamed("id", "rep")
    label_of = folded.join(near, "rep", "left").where("weight > 1 or links is not null").select(
        "label", "dim", "d1", "d2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component_id", "rep").alias("component_id")
    )
    keys = ["label", "dim", "d1", "d2"]
    marked = ready.select("id", *keys).join(label_of, keys, "left").select(
        F.col("id").alias(vec_id),
        F.when(F.col("id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
    return scratch.result(marked)


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 9.3e-1
), g AS (
  SELECT a AS u, b AS w FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT u AS id, u AS root FROM g UNION SELECT g.w, r.root FROM r JOIN g ON g.u = r.id
), c AS (
  SELECT id, min(root) AS c FROM r GROUP BY id
), n AS (
  SELECT u AS id, count(*) AS n FROM g GROUP BY u
)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN c ON c.id = vec_id
"""
