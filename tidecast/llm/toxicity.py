"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model reads which of
the selected words and word beginnings a text holds, and the probabilities of
the categories before it. In training those probabilities are out-of-fold
predictions: a fold's texts, copies included, have no part in the choice of words
or in the weights that predict them, so later models learn from what they will
meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidecast.llm.common import Scratch, map_arrow, table, without

#: The bound of the training sample: rows of each combination of labels, on average; twice that at most.
ROWS_PER_CLASS = 3000
#: Selected words and beginnings, and the least association (chi square) to be one.
FEATURES, LEAST_CHI = 1500, 15.0
FOLDS = 5
BEGINNINGS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+").findall


def features(text: str) -> set[str]:
    """Distinct lower-case words, and their beginnings marked by a trailing asterisk."""
    words = set(_WORD(text.lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 150, rate: float = 0.1) -> np.ndarray:
    """Weights, the intercept last, by Adam over all rows."""
    w, m, v = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    weight = (weight / weight.sum()).astype(np.float32)
    for t in range(1, steps + 1):
        r = weight * (_probability(x, w) - y)
        g = np.append(x.T @ r + l2 * w[:-1], r.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _laid_out(rows: list[np.ndarray], columns: np.ndarray, size: int) -> np.ndarray:
    """0 and 1 for the features ``columns`` of rows that list the numbers of theirs, of ``size`` in all."""
    place = np.full(size, -1)
    place[columns] = np.arange(len(columns))
    x = np.zeros((len(rows), len(columns)), np.float32)
    for i, r in enumerate(rows):
        at = place[r]
        x[i, at[at >= 0]] = 1
    return x


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]
    cuts: list[float]

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, fold: np.ndarray, categories: list[str], names: list[str], chosen: list[np.ndarray]) -> Chain:
        """``rows`` list the numbers of the features of each text, ``y`` is (n, categories); ``weight`` undoes the sample's balance.

        ``chosen`` has the features chosen without each fold, and last those chosen from all.
        """
        unseen = np.zeros((len(rows), len(categories)), np.float32)
        for c in range(len(categories)):
            target = y[:, c].astype(np.float32)
            for k in range(FOLDS):
                held = fold == k
                if held.any() and not held.all():
                    x = np.concatenate([_laid_out(rows, chosen[k], len(names)), unseen[:, :c]], 1)
                    unseen[held, c] = _probability(x[held], logistic(x[~held], target[~held], weight[~held]))
                    del x
        x = _laid_out(rows, chosen[FOLDS], len(names))
        weights, cuts = [], []
        for c in range(len(categories)):
            target = y[:, c].astype(np.float32)
            weights.append(logistic(np.concatenate([x, unseen[:, :c]], 1), target, weight))
            # the cut with the best F1 on the out-of-fold predictions
            tries = np.linspace(0.05, 0.95, 19)
            f1 = [2 * (weight * target * (unseen[:, c] >= t)).sum() / max((weight * (target + (unseen[:, c] >= t))).sum(), 1e-9) for t in tries]
            best = np.flatnonzero(np.isclose(f1, max(f1), atol=1e-4))
            cuts.append(float(tries[best].mean()))
        return cls(categories, {names[j]: i for i, j in enumerate(chosen[FOLDS])}, weights, cuts)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(n, categories); each text's features are summed, never laid out."""
        out = np.zeros((len(texts), len(self.categories)))
        n = len(self.vocabulary)
        words = {f for f in self.vocabulary if not f.endswith("*")}
        begins = [(k, {f[:-1] for f in self.vocabulary if f.endswith("*") and len(f) == k + 1}) for k in BEGINNINGS]
        sparse = np.stack([w[:n] for w in self.weights], 1).astype(float) if self.weights else np.zeros((n, 0))
        for i, text in enumerate(texts):
            found = set(_WORD(text.lower()))
            got = [self.vocabulary[w] for w in found & words]
            for k, known in begins:
                if known:
                    got += [self.vocabulary[b + "*"] for b in {w[:k] for w in found if len(w) > k} & known]
            score = sparse[sorted(got)].sum(0)
            for c, w in enumerate(self.weights):
                z = score[c] + w[n : n + c] @ out[i, :c] + w[-1]
                out[i, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str = "doc_id", text: str = "text") -> Chain | None:
    """Fit the chain on a bounded sample of the labelled rows; None without any.

    ``labels`` has one 0/1 column for each category. Rows with a null label or
    id are passed over; of rows that repeat an id the smallest is taken, and of
    texts too. The sample is chosen by a hash of the id, balanced over the
    combinations of labels; a lost executor changes nothing in it.
    """
    rows = labels.select(F.col(doc_id).alias("id"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    ys = [f"y{i}" for i in range(len(categories))]
    counts = {tuple(r[y] for y in ys): r["n"] for r in rows.groupBy(*ys).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    scratch = Scratch(docs.sparkSession)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (",".join(map(str, k)), min(1.0, ROWS_PER_CLASS / n))])
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < share[F.concat_ws(",", *ys)]).groupBy("id").agg(F.min(F.struct(*ys)).alias("y")).select("id", "y.*")
    chosen = scratch.keep(chosen.orderBy(draw, "id").limit(2 * ROWS_PER_CLASS * len(counts)))  # bounded, so it may be broadcast
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).dropna().join(F.broadcast(chosen), "id").groupBy("id", *ys).agg(F.min("text").alias("text"))
    sample = sample.select("id", "text", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int").alias("fold"), *ys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sorted(features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(got, pa.list_(pa.string()))], ["id", "fold", *ys, "f"])

    kind = StructType([sample.schema["id"], *StructType.fromDDL(", ".join(f"{y} int" for y in ["fold", *ys])).fields, *StructType.fromDDL("f array<string>").fields])
    sample = scratch.keep(map_arrow(sample, cut, kind))
    # of each feature, and of all texts, how many there are in every fold, in all and by category
    by_fold = lambda x, k: F.sum(F.when(F.col("fold") == k, x).otherwise(0))
    sums = [by_fold(x, k).alias(f"{n}_{k}") for k in range(FOLDS) for n, x in (("df", F.lit(1)), *[(y, F.col(y)) for y in ys])]
    total = sample.agg(*sums).first()
    if not total["df_0"] and not any(total[f"df_{k}"] for k in range(FOLDS)):
        return None
    each = scratch.keep(sample.select(F.explode("f").alias("f"), "fold", *ys).groupBy("f").agg(F.count("*").alias("n"), *sums).where("n >= 4"))
    best: list[list[str]] = []
    for left_out in range(FOLDS + 1):
        folds = [k for k in range(FOLDS) if k != left_out]
        n, df = sum(total[f"df_{k}"] for k in folds), sum(F.col(f"df_{k}") for k in folds)
        chis = [F.lit(0.0)]
        for y in ys:
            p = sum(total[f"{y}_{k}"] for k in folds) / max(n, 1)
            if 0 < p < 1:
                chis.append((sum(F.col(f"{y}_{k}") for k in folds) - df * p) ** 2 / (df * p * (1 - p)))
        ranked = each.where(df >= 4).withColumn("chi", F.greatest(*chis, F.lit(0.0))).where(F.col("chi") >= LEAST_CHI)
        best.append([r["f"] for r in ranked.orderBy(F.desc("chi"), "f").limit(FEATURES).select("f").collect()])
    names = sorted(set().union(*best))
    place = {f: i for i, f in enumerate(names)}
    known = docs.sparkSession.createDataFrame([(f, i) for f, i in place.items()], "f string, i int")  # FEATURES rows a fold at most
    listed = sample.select("id", F.explode("f").alias("f")).join(F.broadcast(known), "f").groupBy("id").agg(F.collect_list("i").alias("x"))
    got = sample.select("id", "fold", *ys).join(listed, "id", "left").orderBy("id").collect()
    rows_ = [np.array(sorted(r["x"] or ()), np.int32) for r in got]
    y = np.array([[r[c] for c in ys] for r in got], int)
    weight = np.array([1 / min(1.0, ROWS_PER_CLASS / counts[tuple(v)]) for v in y.tolist()])
    fold = np.array([r["fold"] for r in got])
    del got
    return Chain.fit(rows_, y, weight, fold, categories, names, [np.array(sorted(place[f] for f in b), int) for b in best])


def predict(docs: DataFrame, chain: Chain | None, categories: list[str], text: str = "text") -> DataFrame:
    """Add ``p_<category>`` and ``is_<category>`` for each category, over the whole text, however long.

    Nulls count as empty texts; without a chain, probabilities are null and no
    text is marked; a probability at the very cut marks. Rows are apart from each other; input columns named like an
    output are replaced, all others pass through.
    """
    new = [f"{k}_{c}" for c in categories for k in ("p", "is")]
    base = without(docs, *new)
    names = [f.name for f in base.schema.fields]
    schema = StructType([*base.schema.fields, *StructType.fromDDL(", ".join(f"p_{c} double, is_{c} boolean" for c in categories)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            cols = []
            p = chain.probabilities(texts) if chain else None
            for c in range(len(categories)):
                cols.append(pa.array(p[:, c]) if chain else pa.nulls(len(texts), pa.float64()))
                cols.append(pa.array(p[:, c] >= chain.cuts[c]) if chain else pa.array([False] * len(texts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, *new])

    return map_arrow(base, run, schema)


CATEGORIES = ["low_quality", "toxic"]


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = train(docs, labels, CATEGORIES)
    return predict(docs, chain, CATEGORIES).drop("text")
