"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct word shingles, each a 64-bit fingerprint.
One permutation scatters the fingerprints over a circle of ``CIRCLE`` places; a
second one, shifted circularly by k, gives signature coordinate k, so all
coordinates of a shingle are one slice of a single table. Documents with equal
sets are folded first. Signatures are banded. The members of a band are compared
with its leaders, by exact Jaccard on the full sets: first with the member that
meets most others, then with one of those that this leaves apart from it and one
of those it joins. That ends a band of three, and every band in which one member
at most is still apart. The others are joined to clusters, and what a cluster has
left between its components is compared exactly in blocks, so no link is lost to
a group's size and no group is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, as_bytes, connected_components, map_arrow, small, table

BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
CIRCLE = 1 << 22
BLOCK = 128
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct fingerprints of the word shingles of a text.

    Words are split at ASCII white space, A-Z in lower case. With fewer than
    ``width`` words the whole sequence is one shingle; without words there is
    none.
    """
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    w = min(width, len(words))
    out = np.full(len(words) - w + 1, w, np.uint64)
    for j in range(w):
        out = _mix(out * _M1 + h[j : len(words) - w + 1 + j])
    return np.unique(out)


_TABLE: list[np.ndarray] = []


def _circle() -> np.ndarray:
    """Windows over the second permutation, closed to a circle: row v holds coordinates of place v."""
    if not _TABLE:
        p = np.random.default_rng(20240229).permutation(CIRCLE).astype(np.int32)
        _TABLE.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: COORDINATES - 1]]), COORDINATES))
    return _TABLE[0]


def signatures(sets: list[np.ndarray], step: int = 16384) -> np.ndarray:
    """(n, COORDINATES) minima for non-empty sets, a few thousand shingles at a time."""
    circle = _circle()
    out = np.full((len(sets), COORDINATES), CIRCLE, np.int32)
    flat = np.concatenate(sets)
    # first permutation: a bijective mix, then the place on the circle
    place = (_mix(flat ^ _M1) & np.uint64(CIRCLE - 1)).astype(np.int64)
    ends = np.cumsum([len(s) for s in sets])
    at = 0
    while at < len(flat):
        to = min(at + step, len(flat))
        a, b = np.searchsorted(ends, [at, to - 1], side="right")
        starts = np.maximum(np.concatenate([[0], ends])[a : b + 1] - at, 0)
        low = np.minimum.reduceat(circle[place[at:to]], starts, axis=0)
        np.minimum(out[a : b + 1], low, out=out[a : b + 1])
        at = to
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        h = _mix(h * _M1 + sig[:, r::ROWS].astype(np.uint64) + np.uint64(1))
    return h


def sketch(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(id, n, d1, d2, bands): set size, 128-bit digest of the set, and band keys, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from sketched(batches)
        finally:
            _TABLE.clear()  # the worker outlives the task

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            n = np.zeros(len(texts), np.int64)
            digest = np.zeros((len(texts), 2), np.int64)
            bands: list[np.ndarray | None] = [None] * len(texts)
            held: list[tuple[int, np.ndarray]] = []
            total = 0

            def flush():
                if held:
                    got = _bands(signatures([s for _, s in held])).view(np.int64)
                    for (i, _), b in zip(held, got):
                        bands[i] = b
                held.clear()

            for i, data in enumerate(texts):
                s = shingles(data, width)
                if len(s):
                    n[i] = len(s)
                    digest[i] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    held.append((i, s))
                    total += len(s)
                    if total > 500_000:
                        flush()
                        total = 0
            flush()
            flat = np.concatenate([b for b in bands if b is not None] or [np.empty(0, np.int64)])
            offsets = np.concatenate([[0], np.cumsum([0 if b is None else BANDS for b in bands])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "n", "d1", "d2", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), as_bytes(text).alias("b"))
    return map_arrow(rows, run, "id long, n long, d1 long, d2 long, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(id, d1, d2, set) of the wanted documents, the set as sorted 64-bit integers in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(data, width).tobytes() for data in batch.column(1).to_pylist()]
            digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(s), np.int64) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(sets, pa.binary())], ["id", "d1", "d2", "set"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), as_bytes(text).alias("b"))
    return map_arrow(rows.join(wanted, "id", "left_semi"), run, "id long, d1 long, d2 long, set binary")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = (batch.column(i) for i in range(4))
            ok, last, left = [], None, None
            for i in range(len(a)):
                if (key := a[i].as_py()) != last:
                    last, left = key, np.frombuffer(sa[i].as_buffer(), np.uint64)
                right = np.frombuffer(sb[i].as_buffer(), np.uint64)
                both = _overlap(left, right)
                ok.append(100 * both >= percent * (len(left) + len(right) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return run


def _within_blocks(percent: int):
    """Links between different components of one pair of blocks, as few as join them."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids)
        ids, comp = ids[order], t.column("comp").to_numpy()[order]
        # a member of both sides comes twice
        first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, bool)
        raw = t.column("set").combine_chunks()
        sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in order[first]]
        ids, comp = ids[first], comp[first]
        sizes = np.array([len(s) for s in sets])
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        # shingles of one member alone link nothing; the others become columns
        words, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = seen[at] > 1
        rank = np.cumsum(seen > 1) - 1
        row, col = owner[shared], rank[at[shared]]
        width = int((seen > 1).sum())
        common = np.zeros((len(sets), len(sets)), np.float32)
        by = np.argsort(col, kind="stable")
        row, col = row[by], col[by]
        step = 4096
        for lo in range(0, width, step):
            a, b = np.searchsorted(col, [lo, lo + step])
            m = np.zeros((len(sets), min(step, width - lo)), np.float32)
            m[row[a:b], col[a:b] - lo] = 1
            common += m @ m.T
        common = common.astype(np.int64)  # sums of ones below 2^24: exact
        union = sizes[:, None] + sizes[None] - common
        x, y = np.nonzero(np.triu(100 * common >= percent * union, 1))
        out_a, out_b = [], []
        for i, j in zip(x.tolist(), y.tolist()):
            p, q = find(int(comp[i])), find(int(comp[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out_a.append(int(ids[i]))
                out_b.append(int(ids[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents are linked when ``100 * intersection >= percent * union`` of
    their shingle sets; ``component_id`` is the smallest id reachable by links.
    Nulls, empty and white texts have no shingles and link with nothing. Rows
    that repeat an id are one document with all their links. A row without id
    links with nothing, has no component and is kept. Texts of any length are
    taken whole; columns other than the two named are not read. Which of several
    equally good leaders is taken changes no result. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession)
    keep = scratch.keep
    sig = keep(sketch(docs, doc_id, text, width))
    known = sig.where("n > 0 and id is not null")
    folded = keep(known.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")))
    keys = folded.select("rep", "n", F.explode("bands").alias("key"))
    # tables by key are written before rows meet them, so that a join can split a band of many members
    counts = keep(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = keep(keys.join(counts, "key"))
    # the member of a band that shares bands with most others leads it
    mass = members.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("mass"))
    leader = members.join(mass, "rep").groupBy("key").agg(F.max_by(F.struct("rep", "n"), F.struct("mass", -F.col("rep"))).alias("lead"), F.count("*").alias("size"))
    leader = keep(leader.select("key", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("ln"), "size"))
    pairs = members.drop("size").join(leader, "key").where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"), F.col("ln").alias("na"), F.col("n").alias("nb"))
    pairs = keep(pairs.distinct())
    wanted = keep(members.select(F.col("rep").alias("id")).distinct())
    sets = _full_sets(docs, small(wanted), doc_id, text, width).join(folded.select("d1", "d2", "rep"), ["d1", "d2"], "left_semi")
    sets = keep(sets.select("id", "set").dropDuplicates(["id"]))
    fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def verified(some: DataFrame) -> DataFrame:
        right = some.where(fits).select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        both = right.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")
        return keep(map_arrow(both, _verified(percent), "a long, b long"))

    def split(star: DataFrame) -> DataFrame:
        """(key, rep, n, comp, lead, lcomp): members of the bands of three or more, with their own and their leader's component."""
        own = star.select(F.col("id").alias("rep"), F.col("component_id").alias("comp"))
        heads = keep(leader.where("size > 2").join(own.toDF("lead", "lcomp"), "lead", "left").select("key", "lead", F.coalesce("lcomp", "lead").alias("lcomp")))
        rows = members.where("size > 2").join(own, "rep", "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
        return rows.join(heads, "key")

    links = verified(pairs)
    rows = keep(split(connected_components(links, scratch=scratch)))
    apart = rows.where("comp <> lcomp")
    if not apart.isEmpty():
        outer = keep(apart.groupBy("key").agg(F.min(F.struct("rep", "n", "comp")).alias("o")).select("key", "o.*").toDF("key", "o", "on", "ocomp"))
        inner = keep(rows.where("comp = lcomp and rep <> lead").groupBy("key").agg(F.max(F.struct("rep", "n")).alias("i")))
        inner = keep(inner.join(outer.select("key"), "key", "left_semi").select("key", F.col("i.rep").alias("i"), F.col("i.n").alias("in")))
        more = rows.join(outer, "key").where("comp <> ocomp and rep <> lead").select(F.col("o").alias("a"), F.col("rep").alias("b"), F.col("on").alias("na"), F.col("n").alias("nb"))
        more = more.union(apart.join(inner, "key").select(F.col("i").alias("a"), F.col("rep").alias("b"), F.col("in").alias("na"), F.col("n").alias("nb")))
        links = keep(links.union(verified(more.distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti"))))
        star = connected_components(links, scratch=scratch)
        undone = keep(split(star).where("comp <> lcomp").join(outer.select("key", "o"), "key").where("rep <> o").select("key"))
        edges = keep(rows.join(keep(undone.distinct()), "key", "left_semi").where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
        if not edges.isEmpty():
            links = keep(links.union(_remainder(edges, star, sets, percent, scratch)))
    found = connected_components(links, scratch=scratch)
    label = folded.join(found.withColumnRenamed("id", "rep"), "rep", "left").where("copies > 1 or component_id is not null").select("d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
    mark = sig.join(label, ["d1", "d2"], "left").select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"),
    )
    return scratch.result(mark.withColumn("kept", F.coalesce(F.col("component_id") == F.col(doc_id), F.lit(True))))


def _remainder(edges: DataFrame, star: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between the components of every cluster of bands that the leaders left undone, compared in blocks."""
    keep = scratch.keep
    cluster = connected_components(edges, scratch=scratch)
    placed = cluster.select("id", F.col("component_id").alias("cluster")).join(star, "id", "left").select("id", "cluster", F.coalesce("component_id", "id").alias("comp"))
    sizes = placed.groupBy("cluster", "comp").agg(F.count("*").alias("size"))
    open_ = sizes.groupBy("cluster").agg(F.count("*").alias("comps"), F.sum(F.when(F.col("size") < BLOCK // 4, F.col("size")).otherwise(0)).alias("small")).where("comps > 1")
    spread = keep(sizes.join(open_, "cluster").select("cluster", "comp", "size", "small"))
    placed = placed.join(spread, ["cluster", "comp"])
    alone = F.col("size") >= BLOCK // 4
    block = F.when(alone, F.xxhash64("comp", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)))).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("small") / BLOCK)))
    placed = keep(placed.select("id", "cluster", "comp", block.alias("block"), F.when(alone, F.col("comp")).alias("whole")))
    blocks = placed.select("cluster", "block", "whole").distinct()
    x = blocks.select("cluster", F.col("block").alias("x"), F.col("whole").alias("wx"))
    y = blocks.select("cluster", F.col("block").alias("y"), F.col("whole").alias("wy"))
    tasks = x.join(y, "cluster").where("x <= y and not (wx <=> wy and wx is not null)").select("cluster", "x", "y")
    sides = tasks.select("cluster", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    dealt = sides.join(placed.select("id", "cluster", "comp", "block"), ["cluster", "block"]).join(sets, "id")
    return dealt.groupBy("cluster", "x", "y").applyInArrow(_within_blocks(percent), "a long, b long")


def op6_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of every group of near-duplicates the document with the smallest id stays; five words, similarity 0.8. All columns stay as they are."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), g AS (
  SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT u AS id, u AS root FROM g UNION SELECT g.v, r.root FROM r JOIN g ON g.u = r.id
), c AS (
  SELECT id, min(root) AS c FROM r GROUP BY id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""
