"""Interaction audit of filters by lattice edges.

Filters that are applied one after the other in any order walk through the
lattice of their subsets: a step goes from the set already applied along the
edge of the next filter. What a step removes depends on that edge alone, so
every document contributes to the ``k * 2**(k - 1)`` edges (80 for five
filters), the contributions are summed once, and each of the ``k!`` orders is a
path of ``k`` summed edges (600 steps). No order is ever applied to documents.

Documents that fail the same filters contribute alike, so they are counted
before they are spread over the edges.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import table

#: So many filters have 5,040 orders; the table of paths is a literal.
MOST_FILTERS = 7


def edges(k: int) -> list[tuple[int, int]]:
    """(set already applied, as bits; next filter) of every edge of the lattice."""
    return [(taken, nxt) for nxt in range(k) for taken in range(1 << k) if not taken >> nxt & 1]


def paths(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, set already applied, next filter) of every step of every order."""
    out = []
    for order in permutations(range(len(names))):
        taken = 0
        for step, nxt in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, taken, nxt))
            taken |= 1 << nxt
    return out


def edge_sums(cells: DataFrame, k: int) -> DataFrame:
    """(part, taken, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of all edges of every part.

    ``cells``: (part, mask, n, good, toxic), the documents of a part that fail
    exactly the filters in ``mask``.
    """
    edge = F.array(*[F.struct(F.lit(taken).alias("taken"), F.lit(nxt).alias("next")) for taken, nxt in edges(k)])
    each = cells.withColumn("e", F.explode(edge)).select("*", "e.taken", "e.next")
    reached = F.col("mask").bitwiseAND(F.col("taken")) == 0
    fails = F.expr("(mask >> next) & 1") == 1
    total = lambda condition, c="n": F.sum(F.when(condition, F.col(c)).otherwise(0)).cast("long")
    return each.groupBy("part", "taken", "next").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(F.col("mask") == F.expr("1 << next")).alias("unique_fails"),
        total(reached & fails, "good").alias("good_lost"),
        total(reached & fails, "toxic").alias("toxic_lost"),
    )


def audit(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row for every part, order and step: the sums of its edge, and the filter's removals over all orders.

    ``names``: a letter for each filter, by bit of ``mask``. A filter's
    ``shapley`` counts every edge as often as orders pass it.
    """
    k = len(names)
    if not 0 < k <= MOST_FILTERS or any(len(n) != 1 for n in names) or len(set(names)) < k:
        raise ValueError(f"filters are named by 1 to {MOST_FILTERS} different letters")
    sums = edge_sums(cells, k)
    passed = F.element_at(F.array(*[F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k)]), F.bit_count("taken") + 1)
    sums = sums.withColumn("shapley", F.sum(F.col("removed") * passed).over(Window.partitionBy("part", "next")))
    steps = cells.sparkSession.createDataFrame(paths(names), "filter_order string, step int, taken int, next int")
    return sums.join(F.broadcast(steps), ["taken", "next"]).select(  # k * k! rows
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions that a text decides: few words, repeated words, capitals, special characters."""
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


#: By bit of the mask; E, a copy of a document with a smaller id, is decided by the whole table.
NAMES = ["A", "B", "C", "D", "E"]


def failure_cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each language by the filters they fail.

    A null text is an empty one, a null language the part ``''``. Identical
    texts are found by their SHA-256, so no text is shuffled. E holds for all
    rows whose id is above the smallest of their text; rows that repeat this id
    pass, as do rows without id, which make no other row a copy. A document
    with several labels is good or toxic if any of them says so. Very long
    texts are taken whole. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    failed = text_failures(F.col("t"), F.col("w"))
    mask = sum((F.when(failed[n], 1 << NAMES.index(n)).otherwise(0) for n in failed), F.lit(0))
    rows = rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest"))
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))  # rows without id don't meet in one task
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(said("quality"), said("toxic")).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(known, ["id", "salt"], "left").select("id", "salt", "part", "mask", "digest", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # copies are counted before their rows meet: first by id, then by text
    kind = ["digest", "mask", "part", "quality", "toxic"]
    own = rows.groupBy("id", "salt", *kind).agg(F.count("*").alias("c"))
    group = own.groupBy(*kind).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("nameless"), F.min("id").alias("first"), F.min_by("c", "id").alias("at_first"))
    smallest = F.min("first").over(Window.partitionBy("digest"))
    group = group.withColumn("smallest", smallest).withColumn("passes", F.col("nameless") + F.when(F.col("first") == F.col("smallest"), F.col("at_first")).otherwise(0))
    bit = 1 << NAMES.index("E")
    split = F.array(F.struct(F.col("mask"), F.col("passes").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))
    each = group.select("part", "quality", "toxic", F.explode(split).alias("s")).select("part", "quality", "toxic", "s.*")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(failure_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), NAMES)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS caps FROM d
), lab AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS quality, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, len(w) < 100 AS "A", 100 * len(list_distinct(w)) < 80 * len(w) AS "B", 100 * caps > 10 * length(t) AS "C", regexp_matches(t, '[#$%&*|]') AS "D",
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS "E"
  FROM w LEFT JOIN lab USING (doc_id)
), m AS (
  SELECT *, CASE WHEN "A" THEN 'A' ELSE '' END || CASE WHEN "B" THEN 'B' ELSE '' END || CASE WHEN "C" THEN 'C' ELSE '' END || CASE WHEN "D" THEN 'D' ELSE '' END || CASE WHEN "E" THEN 'E' ELSE '' END AS bad FROM f
), c AS (
  SELECT part, bad, count(*) AS n, sum(quality) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), r AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(bad, own) AS fails, bad = own AS sole, length(translate(before, bad, '')) = length(before) AS reached FROM c, s
), g AS (
  SELECT part, filter_order, step, own, CAST(sum(CASE WHEN reached AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN reached AND fails THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN NOT reached AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN sole THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN reached AND fails THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN reached AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""
