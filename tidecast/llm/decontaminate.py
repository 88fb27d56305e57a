"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every item is cut into windows of ``size`` consecutive words (one shorter window
for a shorter item) and every window into word shingles. A window occurs only
where all its shingles do, so one of them, the rarest in the corpus, is the
whole necessary prefix. The corpus is cut into shingles once: those that an item
has are kept with their places, counted, and joined with the prefixes. The
shingle's offset bounds where the window must start and its length where it must
end; only for such places are the words fetched and compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, small, table

WINDOW = 10
SHINGLE = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """Words in their own case: runs of digits, letters and everything beyond ASCII."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def _low(raw: Column) -> Column:
    """The words in all-lower case. Words that differ in A-Z only become equal, wherever they stand.

    A letter's lower case may depend on its neighbours (a sigma's does), so the
    words are lowered between single spaces, in documents and windows alike,
    and never between the signs that a text has there.
    """
    return F.split(F.lower(F.array_join(raw, " ")), " ")


def _key(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(n)])


def _windows(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item, len, win, w): every distinct window of every item; ``win`` has A-Z in lower case, ``w`` all letters."""
    items = benchmark.select(F.col(item_id).alias("item"), raw_words(F.col(text)).alias("raw")).where(F.size("raw") > 0)
    items = items.withColumn("len", F.least(F.size("raw"), F.lit(size)))
    cut = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("raw") - F.col("len") + 1))).withColumn("raw", F.slice("raw", F.col("at"), F.col("len")))
    return cut.select("item", "len", F.translate(F.array_join("raw", " "), UPPER, LOWER).alias("win"), _low(F.col("raw")).alias("w")).dropDuplicates(["item", "win"])


def find_windows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """(id, h, item, start, end): where windows of items occur in documents.

    A document is its id with a hash ``h`` of its text; ``start`` counts words from 0, ``end`` is exclusive.
    """
    keep = (scratch or Scratch(docs.sparkSession)).keep
    words = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), raw_words(F.col(text)).alias("raw"))
    wins = keep(_windows(benchmark, item_id, item_text, size).withColumn("n", F.least("len", F.lit(SHINGLE))))
    widths = sorted(r["n"] for r in wins.select("n").distinct().collect())  # SHINGLE of them at most
    if not widths:
        return docs.sparkSession.createDataFrame([], f"id {docs.schema[doc_id].dataType.simpleString()}, h long, item {benchmark.schema[item_id].dataType.simpleString()}, start int, end int")
    by_width = lambda w, at: F.coalesce(*[F.when(F.col("n") == n, _key(F.col(w), F.col(at), n)) for n in widths])
    cut = keep(wins.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("n")))).select("item", "win", "len", "n", "off", by_width("w", "off").alias("key")))
    known = cut.select("n", "key").distinct()
    # every shingle of the corpus that an item has, in one pass
    low = words.select("id", "h", _low(F.col("raw")).alias("low")).select("id", "h", "low", F.posexplode("low").alias("pos", "_w"))
    each = F.array(*[F.when(F.col("pos") <= F.size("low") - n, F.struct(F.lit(n).alias("n"), _key(F.col("low"), F.col("pos"), n).alias("key"))) for n in widths])
    rows = low.select("id", "h", "pos", F.inline(each)).where("key is not null")
    met = keep(rows.join(small(known), ["n", "key"], "left_semi"))
    seen = keep(met.groupBy("n", "key").agg(F.count("*").alias("seen")))
    prefix = cut.join(small(seen), ["n", "key"]).groupBy("item", "win", "len", "n").agg(F.min_by(F.struct("key", "off"), F.struct("seen", "key", "off")).alias("p"), F.count("*").alias("occurring"))
    # a shingle that occurs nowhere rules its window out
    prefix = keep(prefix.where(F.col("occurring") == F.col("len") - F.col("n") + 1).select("item", "win", "len", "n", "p.key", "p.off"))
    placed = met.join(small(prefix, "win", "item"), ["n", "key"]).where("pos >= off").select("id", "h", "item", "win", "len", (F.col("pos") - F.col("off")).alias("start"))
    # the words there, fetched for these places only
    placed = keep(placed)
    some = placed.select(F.col("id").alias("i2"), F.col("h").alias("h2")).distinct()
    texts = words.join(small(some, "i2"), F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left_semi").dropDuplicates(["id", "h"])
    there = texts.select(F.col("id").alias("i2"), F.col("h").alias("h2"), "raw")
    hit = placed.join(there, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))).where(F.col("start") + F.col("len") <= F.size("raw"))
    hit = hit.where(F.translate(F.array_join(F.slice("raw", F.col("start") + 1, F.col("len")), " "), UPPER, LOWER) == F.col("win"))
    return hit.select("id", "h", "item", "start", (F.col("start") + F.col("len")).alias("end"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, h, items, n_hit) of the documents that hold a window of an item.

    Nulls and texts without words hold none, and items without words have no
    window. Rows that repeat an id and its text are one document; an item that
    repeats counts once; an item without id marks words but is not listed.
    Among shingles seen equally often the one with the smaller key, then
    offset, is the prefix; the result does not depend on it. Very long texts
    and items are taken whole. Other columns of both tables, whatever their
    names, are not read. Empty tables give an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    found = find_windows(docs, benchmark, doc_id, text, item_id, item_text, size, scratch)
    spans = found.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.collect_set("item").alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).cast("long").alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
        lambda a: a["n"],
    )
    return scratch.result(spans.select("id", "h", "items", covered.alias("n_hit")))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = contamination(docs, items)
    listed = F.array_join(F.sort_array(F.transform(F.coalesce("items", F.array()), lambda x: x.cast("string"))), ",")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    both = rows.join(hits, rows.doc_id.eqNullSafe(hits.id) & (rows.h == hits.h), "left")
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(listed, F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that hold a window of a benchmark item go. Repeated rows go or stay together; all columns stay as they are."""
    hits = contamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("id").alias("__id"), F.col("h").alias("__h"))
    hits = small(hits, "__id")
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["__id"]) & (F.xxhash64(docs["text"]) == hits["__h"]), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), g AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.s = win.s AND g.n = win.n
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
