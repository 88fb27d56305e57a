"""Ranked lexical search over an index clustered by recursive graph bisection.

Documents are reordered so that those with the same terms stand together: a
node's documents are cut into halves, and pairs of documents are swapped
between the halves while that lowers the logarithmic gap cost of their terms.
The upper levels of the recursion are fitted on a bounded sample, and every
document goes down the tree to the half where it costs less; a leaf is dealt
out over shards of bounded size, and within a shard the recursion goes on over
all its documents down to clusters of about ``CLUSTER``. The shard's inverted
lists are stored by cluster with the largest impact of each term.

A query's bound on a cluster is the sum of its terms' largest impacts there.
The clusters of the largest bounds give each query a score that its answers
must reach; then every task visits its clusters in the order of the bound and
stops at the first one below that score or the query's own last answer so far.
A cluster that could only tie is still visited, since ties go by ``doc_id``, so
the answer is exact.

Queries come in blocks of bounded size, and only their terms are indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, column_bytes, map_arrow, small, table

#: Terms of a block of queries, with repeats over queries, on average.
QUERY_TERMS = 32768
#: Documents and postings of a shard, documents of a cluster, documents of the sample, on average.
SHARD, POSTINGS, CLUSTER, SAMPLE = 4096, 1 << 20, 64, 2048
#: Rounds of swaps at a level, and documents of the sample at a leaf of its tree at least.
ROUNDS, LEAF = 8, 32
#: Digits, lower-case letters and bytes of other characters stay, A-Z become lower case, all else is a gap.
BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


# -- recursive graph bisection ----------------------------------------------


def _gap(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Cost of the gaps of a term that ``degree`` of ``size`` documents hold."""
    return degree * np.log2(np.maximum(size, 1e-9) / (degree + 1))


def bisect(ptr: np.ndarray, terms: np.ndarray, n_terms: int, depth: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(leaf of every document after ``depth`` levels, for each level what a document of each (node, term) saves by going right).

    ``ptr`` and ``terms`` list the terms of each document once. All nodes of a
    level are worked on side by side.
    """
    n = len(ptr) - 1
    doc = np.repeat(np.arange(n), np.diff(ptr))
    node, saves = np.zeros(n, np.int64), []
    for level in range(depth):
        nodes = 1 << level
        size = np.bincount(node, minlength=nodes)
        order = np.argsort(node, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        right = rank >= (size[node] + 1) // 2
        cell = node[doc] * n_terms + terms
        used, at = np.unique(cell, return_inverse=True)
        total = np.bincount(at, minlength=len(used)).astype(float)
        home = used // n_terms
        for _ in range(rounds):
            r = np.bincount(at, weights=right[doc], minlength=len(used))
            l = total - r  # noqa: E741
            many = np.bincount(node, weights=right, minlength=nodes)
            nr, nl = many[home], (size - many)[home]
            now = _gap(l, nl) + _gap(r, nr)
            to_right = now - _gap(np.maximum(l - 1, 0), nl) - _gap(r + 1, nr)
            to_left = now - _gap(l + 1, nl) - _gap(np.maximum(r - 1, 0), nr)
            gain = np.bincount(doc, weights=np.where(right[doc], to_left[at], to_right[at]), minlength=n)
            order = np.lexsort((np.arange(n), -gain, right, node))
            count = np.bincount(node[order] * 2 + right[order], minlength=2 * nodes)
            start = np.cumsum(count) - count
            pairs = np.minimum(count[::2], count[1::2])
            k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            a, b = order[np.repeat(start[::2], pairs) + k], order[np.repeat(start[1::2], pairs) + k]
            swap = gain[a] + gain[b] > 1e-9
            if not swap.any():
                break
            right[a[swap]], right[b[swap]] = True, False
        r = np.bincount(at, weights=right[doc], minlength=len(used))
        many = np.bincount(node, weights=right, minlength=nodes)
        nr, nl = many[home], (size - many)[home]
        save = np.zeros(nodes * n_terms, np.float32)
        save[used] = _gap(total - r + 1, nl + 1) - _gap(total - r, nl) - _gap(r + 1, nr + 1) + _gap(r, nr)
        saves.append(save)
        node = node * 2 + right
    return node, saves


def descend(ptr: np.ndarray, terms: np.ndarray, n_terms: int, saves: list[np.ndarray]) -> np.ndarray:
    """The leaf that every document reaches."""
    n = len(ptr) - 1
    doc = np.repeat(np.arange(n), np.diff(ptr))
    node = np.zeros(n, np.int64)
    for save in saves:
        node = node * 2 + (np.bincount(doc, weights=save[node[doc] * n_terms + terms], minlength=n) > 0)
    return node


# -- the index --------------------------------------------------------------


def lists(values: np.ndarray, ptr: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, kind))


def unlist(column) -> tuple[np.ndarray, np.ndarray]:
    """(ptr, values) of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(size)]), column.flatten().to_numpy(zero_copy_only=False)


def _forward(known: dict[bytes, int]):
    """Documents with their number of terms and those of the queries' terms that they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, n_terms = known.get, len(known)
        for batch in batches:
            size, found = [], []
            for text in column_bytes(batch.column(1)):
                words = terms_of(text)
                size.append(len(words))
                found.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
            doc = np.repeat(np.arange(len(size)), size)
            term = np.concatenate(found) if found else np.empty(0, np.int64)
            mine = term >= 0
            cell, tf = np.unique(doc[mine] * n_terms + term[mine], return_counts=True)
            ptr = np.concatenate([[0], np.cumsum(np.bincount(cell // n_terms, minlength=len(size)))])
            out = [batch.column(0), pa.array(size, pa.int64()), lists((cell % n_terms).astype(np.int32), ptr, pa.int32()), lists(tf.astype(np.int32), ptr, pa.int32())]
            out = pa.RecordBatch.from_arrays(out, ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(size, np.int64) > 0))

    return run


def _counts(n_terms: int, saves: list[np.ndarray]):
    """A task's documents by term (kind 0), and by leaf with their postings (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = 1 << len(saves)
        df, docs, postings = np.zeros(n_terms, np.int64), np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
        for batch in batches:
            ptr, terms = unlist(batch.column("terms"))
            leaf = descend(ptr, terms, n_terms, saves)
            df += np.bincount(terms, minlength=n_terms)
            docs += np.bincount(leaf, minlength=leaves)
            postings += np.bincount(leaf, weights=np.diff(ptr), minlength=leaves).astype(np.int64)
        kind = np.repeat([0, 1], [n_terms, leaves])
        cols = [kind, np.concatenate([np.arange(n_terms), np.arange(leaves)]), np.concatenate([df, docs]), np.concatenate([df, postings])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["kind", "key", "docs", "postings"])

    return run


def _dealt(n_terms: int, saves: list[np.ndarray], shards: list[int]):
    """Documents with their shard: the leaf's own, dealt out by the row's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.array(shards)
        first = np.cumsum(many) - many
        for batch in batches:
            leaf = descend(*unlist(batch.column("terms")), n_terms, saves)
            shard = first[leaf] + batch.column("row").to_numpy() % many[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(batch.column(c) for c in ("doc_id", "n", "terms", "tfs"))], ["shard", "doc_id", "n", "terms", "tfs"])

    return run


INDEX = "shard long, cluster int, docs array<long>, terms array<int>, most array<int>, ptr array<int>, slots array<int>, impacts array<int>"


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """What a term's weight is multiplied by: its occurrences against the document's length."""
    m = 100 - 50 + (50 * n * n_docs) // n_all
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _built(n_terms: int, n_docs: int, n_all: int):
    """A shard's clusters, each with its inverted lists."""

    def run(t: pa.Table) -> pa.Table:
        ptr, terms = unlist(t.column("terms"))
        tf = unlist(t.column("tfs"))[1].astype(np.int64)
        n = len(ptr) - 1
        ids = t.column("doc_id").combine_chunks()
        depth = max(0, math.ceil(math.log2(n / CLUSTER)))
        cluster, _ = bisect(ptr, terms, n_terms, depth)
        doc = np.repeat(np.arange(n), np.diff(ptr))
        value = impact(tf, t.column("n").to_numpy()[doc], n_docs, n_all).astype(np.int32)
        order = np.argsort(cluster, kind="stable")
        size = np.bincount(cluster, minlength=1 << depth)
        slot = np.empty(n, np.int32)
        slot[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        cell = cluster[doc] * n_terms + terms
        by = np.argsort(cell, kind="stable")
        cell, slots, value = cell[by], slot[doc][by], value[by]
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        most = np.maximum.reduceat(value, start)
        own = cell[start] // n_terms
        held = np.flatnonzero(size)  # clusters
        per_term = np.bincount(own, minlength=len(size))[held]
        per_post = np.bincount(cell // n_terms, minlength=len(size))[held]
        edge = lambda x: np.concatenate([[0], np.cumsum(x)])
        firsts = edge(per_post)
        length = np.diff(np.append(start, len(cell)))
        # within a cluster the lists begin at 0 and end at its number of postings
        inner = np.concatenate([np.append(start[a:b] - f, f2 - f) for a, b, f, f2 in zip(edge(per_term)[:-1], edge(per_term)[1:], firsts[:-1], firsts[1:])])
        assert length.sum() == len(cell)
        return pa.table(
            {
                "shard": pa.array(np.full(len(held), t.column("shard")[0].as_py(), np.int64)),
                "cluster": pa.array(held.astype(np.int32)),
                "docs": pa.ListArray.from_arrays(pa.array(edge(size[held]).astype(np.int32)), ids.take(pa.array(order))),
                "terms": lists((cell[start] % n_terms).astype(np.int32), edge(per_term), pa.int32()),
                "most": lists(most, edge(per_term), pa.int32()),
                "ptr": lists(inner.astype(np.int32), edge(per_term + 1), pa.int32()),
                "slots": lists(slots, firsts, pa.int32()),
                "impacts": lists(value, firsts, pa.int32()),
            }
        )

    return run


# -- the search -------------------------------------------------------------


class Queries:
    """A block of queries: terms by number, in the order of the items, and each term's weight."""

    def __init__(self, rows: list[tuple[int, int]], weight: np.ndarray):
        rows = sorted(rows)
        self.items = sorted({i for i, _ in rows})
        self.terms = np.array([t for _, t in rows])
        size = np.bincount(np.searchsorted(self.items, [i for i, _ in rows]), minlength=len(self.items))
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        self.weight = weight

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What a document of a cluster can score at most, for each item."""
        best = np.zeros(len(self.weight), np.int64)
        best[terms] = self.weight[terms] * most
        return np.add.reduceat(best[self.terms], self.ptr[:-1])

    def scores(self, item: int, n: int, terms: np.ndarray, ptr: np.ndarray, slots: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """Scores of a cluster's ``n`` documents."""
        own = self.terms[self.ptr[item] : self.ptr[item + 1]]
        at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
        there = terms[at] == own
        own, at = own[there], at[there]
        size = ptr[at + 1] - ptr[at]
        post = np.repeat(ptr[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out = np.zeros(n, np.int64)
        np.add.at(out, slots[post], np.repeat(self.weight[own], size) * impacts[post])
        return out


class Answers:
    """The ``k`` best of each item that a task has seen: by score, then by smaller id, no id last."""

    def __init__(self, items: int, k: int, least: np.ndarray):
        self.k, self.least, self.rows = k, least.copy(), [[] for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        good = np.flatnonzero(scores >= self.least[item])
        if len(good):
            rows = self.rows[item]
            rows += [(-int(scores[g]), ids[g] is None, ids[g] or 0) for g in good]
            rows.sort()
            del rows[self.k :]
            if len(rows) == self.k:
                self.least[item] = max(self.least[item], -rows[-1][0])

    def table(self, items: list[int]) -> pa.RecordBatch:
        flat = [(items[i], None if void else doc, -s) for i, rows in enumerate(self.rows) for s, void, doc in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])


def _bounds(q: Queries, most: int):
    """A task's clusters with the largest bounds, ``most`` for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            ptr, terms = unlist(batch.column("terms"))
            value = unlist(batch.column("most"))[1].astype(np.int64)
            shard, cluster = batch.column("shard").to_numpy(), batch.column("cluster").to_numpy()
            if batch.num_rows:
                bound = np.stack([q.bounds(terms[a:b], value[a:b]) for a, b in zip(ptr[:-1], ptr[1:])])
                top = np.argsort(-bound, axis=0, kind="stable")[:most]
                kept += [(i, int(bound[c, i]), int(shard[c]), int(cluster[c])) for i in range(bound.shape[1]) for c in top[:, i] if bound[c, i] > 0]
                kept.sort(key=lambda r: (r[0], -r[1]))
                kept = [r for n, r in enumerate(kept) if n < most or kept[n - most][0] != r[0]]
        rows = [(q.items[i], b, s, c) for i, b, s, c in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["item_id", "bound", "shard", "cluster"])

    return run


def _visited(q: Queries, k: int, least: np.ndarray, listed: bool = False):
    """A task's best documents for each item; with ``listed`` only for the items that a cluster's row names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Answers(len(q.items), k, least)
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: unlist(batch.column(c)) for c in ("terms", "most", "ptr", "slots", "impacts")}
            docs = batch.column("docs").to_pylist()
            part = lambda c, r: cols[c][1][cols[c][0][r] : cols[c][0][r + 1]]
            bound = np.stack([q.bounds(part("terms", r), part("most", r).astype(np.int64)) for r in range(batch.num_rows)])
            if listed:
                named = np.zeros(bound.shape, bool)
                for r, items in enumerate(batch.column("items").to_pylist()):
                    named[r, np.searchsorted(q.items, items)] = True
                bound[~named] = 0
            order = np.argsort(-bound, axis=0, kind="stable")
            for i in range(len(q.items)):
                for r in order[:, i]:
                    if bound[r, i] < best.least[i]:
                        break
                    scores = q.scores(i, len(docs[r]), part("terms", r), part("ptr", r), part("slots", r), part("impacts", r).astype(np.int64))
                    best.add(i, scores, docs[r])
        yield best.table(q.items)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, t) for i, text in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1))) for t in sorted(set(terms_of(text)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "term"])


def _block(docs: DataFrame, pairs: list[tuple[int, bytes]], k: int, scratch: Scratch) -> DataFrame:
    """(item_id, doc_id, score): the best of every task that can be among an item's ``k`` best."""
    vocabulary = sorted({t for _, t in pairs})
    known = {t: n for n, t in enumerate(vocabulary)}
    n_terms = len(known)
    forward = map_arrow(docs, _forward(known), "doc_id long, n long, terms array<int>, tfs array<int>")
    forward = scratch.keep(forward.withColumn("row", F.monotonically_increasing_id()))
    n_docs, n_all, n_held = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.size("terms") > 0)).first()
    held = forward.where(F.size("terms") > 0)
    levels = min(math.ceil(math.log2(max(n_held / SHARD, 1))), int(math.log2(SAMPLE / LEAF)))
    saves: list[np.ndarray] = []
    if levels:
        share = int((1 << 30) * min(1.0, SAMPLE / n_held))
        sample = [r.terms for r in held.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share).select("terms").collect()]  # SAMPLE documents on average
        ptr = np.concatenate([[0], np.cumsum([len(t) for t in sample])])
        _, saves = bisect(ptr, np.array([t for row in sample for t in row], np.int64), n_terms, levels)
    sums = map_arrow(held.select("terms"), _counts(n_terms, saves), "kind long, key long, docs long, postings long")
    sums = {(r.kind, r.key): (r.docs, r.postings) for r in sums.groupBy("kind", "key").agg(F.sum("docs").alias("docs"), F.sum("postings").alias("postings")).collect()}  # terms and leaves
    df = [sums.get((0, t), (0, 0))[0] for t in range(n_terms)]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], np.int64)
    shards = [max(1, math.ceil(d / SHARD), math.ceil(p / POSTINGS)) for d, p in (sums.get((1, leaf), (0, 0)) for leaf in range(1 << len(saves)))]
    q = Queries([(i, known[t]) for i, t in pairs], weight)
    dealt = map_arrow(held, _dealt(n_terms, saves, shards), "shard long, doc_id long, n long, terms array<int>, tfs array<int>")
    index = scratch.keep(dealt.groupBy("shard").applyInArrow(_built(n_terms, n_docs, n_all), INDEX))
    # where the bounds are largest: the score that an answer must reach
    most = max(2, math.ceil(2 * k / CLUSTER))
    top = map_arrow(index.select("shard", "cluster", "terms", "most"), _bounds(q, most), "item_id long, bound long, shard long, cluster long")
    top = top.withColumn("_n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "shard", "cluster"))).where(F.col("_n") <= most)
    chosen = small(scratch.keep(top.groupBy("shard", "cluster").agg(F.collect_set("item_id").alias("items"))), "items")
    none = np.ones(len(q.items), np.int64)
    seen = map_arrow(index.join(chosen, ["shard", "cluster"]), _visited(q, k, none, listed=True), "item_id long, doc_id long, score long")
    reached = ranked(seen, k).where(F.col("rank") == k).select("item_id", "score").collect()  # a row for each item of the block
    least = none.copy()
    for r in reached:
        least[q.items.index(r.item_id)] = r.score
    return map_arrow(index, _visited(q, k, least), "item_id long, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0.

    Null texts have no term; documents and items without terms are in no row
    and in no count. Every row of ``docs`` is a document, repeated ones too;
    those without id count and rank behind equal scores. Rows of one item id
    are one item with the terms of all; rows without id are no items. Equal
    scores go by the smaller ``doc_id``. Very long texts are taken whole.
    Columns other than the four named are not read. Empty tables give an empty
    result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL")
    pairs = scratch.keep(map_arrow(asked, _pairs, "item_id long, term binary").distinct())
    blocks = max(1, math.ceil(pairs.count() / query_terms))
    found = None
    for b in range(blocks):
        own = [(r.item_id, bytes(r.term)) for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]  # about ``query_terms`` rows
        if own:
            part = _block(rows, own, k, scratch)
            found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    return scratch.result(ranked(found, k).select("item_id", "rank", "doc_id", "score"))


def op12_lexical(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), s AS (
  SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, big_n
), i AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // l)) AS x FROM p, s
), g AS (
  SELECT item_id, r, doc_id, CAST(sum(w * x) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN i USING (term) GROUP BY ALL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS n FROM g WHERE score > 0
)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM o WHERE n <= 50
"""
