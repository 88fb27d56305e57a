"""Line dedup by a distributed suffix array, in DataFrame operations only.

The corpus is a sequence of line ids. Prefix doubling ranks its suffixes: level
0 ranks lines, level j + 1 ranks pairs of level-j ranks 2^j lines apart, always
in sorted order, so a rank of level j is an interval of the suffix array whose
longest common prefix is at least 2^j lines. Suffixes whose interval holds one
text place only are dropped on the way; they repeat nothing.

A run of lines is removed when it has ``min_words`` words or more and occurs
earlier, in order of document and line. Any such maximal run is the union of
its minimal windows: for each line, the shortest run from it and the shortest
run up to it that have ``min_words`` words. A window of L lines is named by two
overlapping ranks of level log2(L); within its interval all but the first are
later copies. Levels end at the longest such window: every longer run is made of
them, so longer common prefixes need no rank of their own. The first place of
every name is a small table of its own, written before the windows meet it, so
that a name borne by many windows is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import Scratch, fresh, set_aside, small, table

MIN_WORDS = 50
DOC = ["id", "h"]


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h, pos, line, words, h1, h2): non-blank lines; ``pos`` counts them, ``line`` is the number among all lines.

    Words are counted as one more than the spaces of the trimmed line.
    """
    parts = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.trim(s["x"]) != "")
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.posexplode(parts).alias("pos", "s")).select("id", "h", "pos", F.col("s.i").alias("line"), F.col("s.x").alias("x"))
    spaces = F.length(F.trim("x")) - F.length(F.replace(F.trim("x"), F.lit(" "), F.lit("")))
    return rows.select("id", "h", "pos", "line", (spaces + 1).cast("long").alias("words"), F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))


def _ranked(rows: DataFrame, keys: list[str], rest: list[str], keep) -> DataFrame:
    """Rows whose key occurs at two places or more, with the key's rank in sorted order as ``r``."""
    place = F.struct(*DOC, "pos")
    groups = rows.groupBy(*keys).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi")
    # ids given along a sorted table rise with the keys: no task sees them all
    names = keep(groups.select(*keys).orderBy(*keys).withColumn("r", F.monotonically_increasing_id()))
    return rows.join(names, keys).select(*DOC, "pos", *rest, "r")


def _minimal_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(id, h, p, e): the shortest runs with ``min_words`` words from each line and up to each line, inside stretches of repeated lines."""
    order = Window.partitionBy(*DOC).orderBy("pos")
    seg = lines.withColumn("seg", F.col("pos") - F.row_number().over(order))
    upto = F.sum("words").over(Window.partitionBy(*DOC, "seg").orderBy("pos"))
    seg = seg.withColumn("to", upto).withColumn("from", F.col("to") - F.col("words"))
    row = lambda kind, key, mark, ask: F.struct(F.lit(kind).alias("kind"), key.alias("key"), mark.cast("int").alias("mark"), ask.cast("int").alias("ask"))
    none = F.lit(None)
    pos = F.col("pos")
    marks = F.array(
        row(0, -F.col("to"), pos, none),
        row(0, -(F.col("from") + min_words), none, pos),
        row(1, F.col("from"), pos, none),
        row(1, F.col("to") - min_words, none, pos),
    )
    rows = seg.select(*DOC, "seg", F.inline(marks))
    near = Window.partitionBy(*DOC, "seg", "kind").orderBy("key", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("other", F.last("mark", ignorenulls=True).over(near)).where("ask is not null and other is not null")
    return got.select(*DOC, F.least("ask", "other").alias("p"), F.greatest("ask", "other").alias("e")).distinct()


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, lines): numbers (from 0) of the lines of each document that lie in a later copy of a run.

    A document is its id with a hash ``h`` of its text. Rows that repeat both
    are one document and no copies of each other. The first copy is the one
    with the smallest id (nulls first), then hash, then line. Null and blank
    texts have no lines; blank lines are passed over. Texts of any length are
    cut into lines whole. Columns other than the two named are not read. An
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    keep = scratch.keep
    lines = keep(_lines(docs, doc_id, text))
    active = keep(_ranked(lines, ["h1", "h2"], ["line", "words"], keep).dropDuplicates([*DOC, "pos"]))
    windows = keep(_minimal_windows(active, min_words).withColumn("len", F.col("e") - F.col("p") + 1))
    longest = windows.agg(F.max("len")).first()[0] or 0
    ranks, level, later = active.select(*DOC, "pos", "r"), 0, None
    while 1 << level <= longest:
        step = 1 << level
        own = windows.where((F.col("len") >= step) & (F.col("len") < 2 * step))
        at = lambda c, name: ranks.select(*DOC, F.col("pos").alias(c), F.col("r").alias(name))  # noqa: E731, B023
        named = own.withColumn("q", F.col("e") - (step - 1))
        named = _same_doc(_same_doc(named, at("p", "r1"), "p"), at("q", "r2"), "q")
        named = keep(named.select(*DOC, "p", "e", "len", "r1", "r2"))
        place = F.struct(*DOC, "p")
        first = keep(named.groupBy("len", "r1", "r2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").drop("hi"))
        copies = named.join(first, ["len", "r1", "r2"]).where(place > F.col("lo")).select(*DOC, "p", "e")
        later = copies if later is None else later.union(copies)
        level += 1
        if 1 << level <= longest:
            pairs = _same_doc(ranks, ranks.select(*DOC, (F.col("pos") - step).alias("pos"), F.col("r").alias("s")), "pos")
            ranks = keep(_ranked(keep(pairs.withColumnRenamed("r", "r0")), ["r0", "s"], [], keep))
    if later is None:
        later = windows.select(*DOC, "p", "e")
    reach = later.groupBy(*DOC, F.col("p").alias("pos")).agg(F.max("e").alias("e"))
    covered = _same_doc(active.select(*DOC, "pos", "line"), reach, "pos", "left")
    covered = covered.withColumn("to", F.max("e").over(Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return scratch.result(covered.where(F.col("to") >= F.col("pos")).groupBy(*DOC).agg(F.sort_array(F.collect_list("line")).alias("lines")))


def _same_doc(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join on the document, whose id may be null, and a place."""
    right = right.select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col(on).alias("__on"), *[c for c in right.columns if c not in (*DOC, on)])
    return left.join(right, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")) & (F.col(on) == F.col("__on")), how).drop("__id", "__h", "__on")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs cut out of ``text``, and ``deleted_lines``, their line numbers.

    Texts without such lines stay as they are, nulls too. A text that is a
    later copy as a whole becomes empty. Other columns pass through, whatever
    their names; an input column named ``deleted_lines`` is replaced.
    """
    rows = docs if text == "deleted_lines" else docs.drop("deleted_lines")
    key, at, gone = (fresh(rows, n) for n in ("id", "h", "gone"))
    found = small(repeated_lines(docs, doc_id, text, min_words).toDF(key, at, gone), key, gone)
    both = rows.join(found, rows[doc_id].eqNullSafe(found[key]) & (F.xxhash64(rows[text]) == found[at]), "left")
    parts = F.split(rows[text], "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    cut = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    new = F.when(F.col(gone).isNull(), rows[text]).otherwise(cut)
    return both.select(*[new.alias(c) if c == text else rows[f"`{c}`"] for c in rows.columns], F.coalesce(F.col(gone), F.array().cast("array<int>")).alias("deleted_lines"))


def op1_linededup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n"))
    done = dedup_lines(docs)
    return done.select(
        "doc_id",
        F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.size("deleted_lines").cast("long").alias("n_deleted"),
        F.sha2(F.array_join("deleted_lines", ","), 256).alias("deleted_sha256"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: later copies of repeated runs are cut; a document of which nothing is left goes, one that had nothing stays."""
    own, back = set_aside(docs, "deleted_lines")
    done = dedup_lines(own)
    return back(done.where((F.size("deleted_lines") == 0) | (F.trim("text") != "")).select(*own.columns))


ORACLE = """
WITH l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos, line, x,
    length(trim(x)) - length(replace(trim(x), ' ', '')) + 1 AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) WHERE trim(x) <> ''
), c AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l
), f AS (
  SELECT a.doc_id, a.pos AS p, min(b.pos) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 49 AND b.upto - a.upto + a.words >= 50 GROUP BY ALL
), k AS (
  SELECT b.doc_id, max(a.pos) AS p, b.pos AS e FROM c b JOIN c a ON a.doc_id = b.doc_id AND a.pos BETWEEN b.pos - 49 AND b.pos AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.pos
), w AS (
  SELECT doc_id, p, e FROM f UNION SELECT doc_id, p, e FROM k
), named AS (
  SELECT w.doc_id, w.p, w.e, string_agg(c.x, chr(10) ORDER BY c.pos) AS s FROM w JOIN c ON c.doc_id = w.doc_id AND c.pos BETWEEN w.p AND w.e GROUP BY ALL
), later AS (
  SELECT doc_id, p, e FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM named) WHERE n > 1
), gone AS (
  SELECT DISTINCT c.doc_id, c.line FROM later JOIN c ON c.doc_id = later.doc_id AND c.pos BETWEEN later.p AND later.e
), g AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS s FROM gone GROUP BY doc_id
), kept AS (
  SELECT a.doc_id, string_agg(a.x, chr(10) ORDER BY a.line) AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) a
  ANTI JOIN gone ON gone.doc_id = a.doc_id AND gone.line = a.line GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_deleted,
  sha256(coalesce(g.s, '')) AS deleted_sha256, sha256(coalesce(kept.t, '')) AS text_sha256
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
