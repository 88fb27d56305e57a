"""The scoring network predicts tokens beyond the most frequent ones, and learns from all documents."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidecast.llm import lmscore

LEFT = [f"b{chr(97 + i // 26)}{chr(97 + i % 26)}da" for i in range(130)]
RIGHT = [f"k{chr(97 + i // 26)}{chr(97 + i % 26)}mo" for i in range(130)]


@pytest.fixture(scope="module")
def pairs(spark):
    """Each left word is always followed by its own right word; all have one shape."""
    rows = [(k, " ".join(f"{LEFT[(7 * k + i * i) % 130]} {RIGHT[(7 * k + i * i) % 130]}" for i in range(100))) for k in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_words_beyond_the_first_are_predicted(pairs):
    model = lmscore.train(pairs)
    assert len(model.frequent) == 260 > lmscore.FREQUENT
    classes, _, starts, lengths = model.laid_out([r.text.encode() for r in pairs.collect()])
    model.flat = lmscore.fit_steps(model.flat, lmscore.neighbours(classes, starts, lengths), classes, batch=256)
    right = [f"{LEFT[i]} {RIGHT[i]}".encode() for i in range(130)]
    wrong = [f"{LEFT[i]} {RIGHT[(i + 1) % 130]}".encode() for i in range(130)]
    assert len({lmscore.shape(w.encode()) for w in LEFT + RIGHT}) == 1
    assert model.score(right)[1].mean() > model.score(wrong)[1].mean() + 1


def test_the_two_softmaxes_make_one_distribution():
    flat = lmscore.initial(np.arange(1.0, lmscore.SHAPES + 131))
    flat[:] += np.random.default_rng(1).normal(0, 0.2, len(flat)).astype(np.float32)
    every = np.concatenate([np.arange(lmscore.SHAPES) * lmscore.HASHED, lmscore.RARE + np.arange(132)])  # 11 groups of 12 places
    near = np.tile([lmscore.RARE + 3, lmscore.EDGE, 5, lmscore.RARE + 100], (len(every), 1))
    assert np.isclose(np.exp(lmscore.class_log_probabilities(flat, near, every)).sum(), 1, atol=1e-4)


def test_rare_words_differ_as_neighbours():
    model = lmscore.WindowModel({b"the": 0}, np.zeros((256, 256)), lmscore.initial(np.ones(lmscore.CLASSES)))
    a, b = model.score([b"the bazda the", b"the kozmo the"])[1]
    assert lmscore.shape(b"bazda") == lmscore.shape(b"kozmo") and a != b


def test_every_document_trains(pairs):
    """No remainder of the hash that chooses a round's documents is left out."""
    for k in range(10):
        part = pairs.where(F.pmod(F.xxhash64(F.col("text").cast("binary")), F.lit(10)) == k).limit(8)
        rows = part.select(F.col("text").cast("binary").alias("b"))
        model = lmscore.WindowModel({}, np.zeros((256, 256)), lmscore.initial(np.ones(lmscore.CLASSES)))
        assert part.count() and any(not np.array_equal(lmscore._round(rows, model, r), model.flat) for r in range(lmscore.ROUNDS)), k


def test_partitioning_does_not_matter(pairs, monkeypatch):
    """Several shards a round, copies among the texts, null and empty ones: one task or sixteen, the same parameters and scores."""
    monkeypatch.setattr(lmscore, "SHARD_TOKENS", 4000)
    docs = pairs.union(pairs.where("doc_id < 40")).union(pairs.where("doc_id < 20")).union(pairs.limit(2).select("doc_id", F.lit(None).cast("string").alias("text")))
    one, many = lmscore.train(docs.repartition(1)), lmscore.train(docs.repartition(16))
    assert np.allclose(one.flat, many.flat, rtol=1e-6, atol=1e-7)
    texts = [(r.text or "").encode() for r in docs.collect()]
    assert np.allclose(one.score(texts)[1], many.score(texts)[1], rtol=1e-6)


def test_a_round_by_hand(pairs, monkeypatch):
    """Texts by shard and hash, copies as weights, the mean of the shards by tokens."""
    monkeypatch.setattr(lmscore, "ROUNDS", 1)
    docs = pairs.where("doc_id < 60").union(pairs.where("doc_id < 5")).select(F.col("text").cast("binary").alias("b"))
    model = lmscore.WindowModel({w.encode(): i for i, w in enumerate(LEFT)}, np.zeros((256, 256)), lmscore.initial(np.ones(lmscore.SHAPES + 130)))
    shards: dict[int, list] = {}
    for r in docs.select("b", F.expr("pmod(xxhash64(b, 1), 3)").alias("shard"), F.xxhash64("b").alias("h")).collect():
        shards.setdefault(r.shard, []).append((r.h, bytes(r.b)))
    total, seen = 0, 0
    for rows in shards.values():
        texts = [b for _, b in sorted(set(rows))]
        copies = [sum(b == other for _, other in rows) for b in texts]
        classes, _, starts, lengths = model.laid_out(texts)
        weight = np.concatenate([[c] * n for c, n in zip(copies, lengths)])
        total = total + lmscore.fit_steps(model.flat, lmscore.neighbours(classes, starts, lengths), classes, weight=weight).astype(float) * weight.sum()
        seen += weight.sum()
    assert len(shards) == 3 and np.allclose(lmscore._round(docs, model, 0, 3), total / seen, atol=1e-6)


@pytest.mark.parametrize("parts", [1, 5, 32])
def test_held_out_text_is_better_predicted_than_by_frequency(pairs, parts):
    model = lmscore.train(pairs.where("doc_id % 5 <> 0").repartition(parts))
    held = [r.text.encode() for r in pairs.where("doc_id % 5 = 0").collect()]
    got = model.score(held)[1].sum()
    counts = np.zeros(lmscore.SHAPES + len(model.frequent))
    for r in pairs.where("doc_id % 5 <> 0").collect():
        for t in lmscore.tokens(r.text.encode()):
            counts[lmscore.SHAPES + model.frequent[t]] += 1
    model.flat = lmscore.initial(counts)
    w = lmscore._unpack(model.flat)
    w[3][:], w[5][:] = 0, 0
    assert got > model.score(held)[1].sum()


def test_weights_are_copies():
    """A token of weight two counts as the token twice."""
    flat = lmscore.initial(np.ones(lmscore.CLASSES))
    rng = np.random.default_rng(3)
    near, target = rng.integers(0, lmscore.RARE, (50, 4)), rng.integers(0, lmscore.RARE, 50)
    twice = np.repeat(np.arange(50), np.arange(50) % 2 + 1)
    a = lmscore.fit_steps(flat, near, target, weight=np.arange(50) % 2 + 1)
    assert np.allclose(a, lmscore.fit_steps(flat, near[twice], target[twice]), atol=1e-4)


@pytest.mark.parametrize("scale", [1, 400])
def test_errors_with_and_without_a_common_shift(scale):
    """Of logits in a narrow range one bound is subtracted, of others each row's maximum; the gradient is the softmax's."""
    rng = np.random.default_rng(2)
    w, b = rng.normal(0, scale, (lmscore.HIDDEN, 30)), rng.normal(0, scale, 30)
    h, y, share = np.tanh(rng.normal(0, 1, (50, lmscore.HIDDEN))), rng.integers(0, 30, 50), rng.random(50)
    bias, narrow = lmscore._shifted(w / 30, b / 30)
    assert narrow == (scale == 1)
    z = (h @ (w / 30) + bias).astype(np.float32)
    lmscore._error(z, y, share.astype(np.float32), narrow)
    want = h @ (w / 30) + b / 30
    want = np.exp(want - want.max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    want[np.arange(50), y] -= 1
    assert np.isfinite(z).all() and np.allclose(z, want * share[:, None], atol=1e-5)


def test_tokens_end_with_their_text():
    """Texts are counted together, but no token or pair of bytes reaches from one into the next."""
    texts = [b"one two", b"", b"three", b" ", b"!x"]
    (out,) = lmscore._count(iter([pa.record_batch([pa.array(texts, pa.binary())], ["b"])]))
    got = {(r["kind"], r["key"]): r["n"] for r in out.to_pylist()}
    want = {(0, w): 1 for w in (b"one", b"two", b"three", b"!", b"x")}
    for t in texts:
        line = b" " + b" ".join(lmscore.tokens(t)) + b" " if lmscore.tokens(t) else b""
        for i in range(len(line) - 1):
            want[1, line[i : i + 2]] = want.get((1, line[i : i + 2]), 0) + 1
    assert got == want


def test_coded_texts_are_counted_and_scored_alike(spark, pairs):
    """Texts kept as numbers give the counts and scores of the texts, one row each, null and empty ones too, with the columns kept."""
    odd = [(900, None), (901, ""), (902, " \n"), (903, "Caf\u00e9 7 x7 !! bazda"), (904, "\u6587\u5b57 a  b\tc\x00d"), (905, "solo")]
    docs = pairs.limit(30).union(spark.createDataFrame(odd, "doc_id long, text string")).repartition(3)
    rows = lmscore.coded(docs, "text", "doc_id")
    model = lmscore.train(docs)
    model.flat = model.flat + np.random.default_rng(1).normal(0, 0.1, len(model.flat)).astype(np.float32)
    got = {r.doc_id: r for r in lmscore.score_coded(rows, model).collect()}
    want = lmscore.score(docs, model).collect()
    assert len(want) == len(got) == 36
    for r in want:
        assert got[r.doc_id].n_tokens == r.n_tokens and np.isclose(got[r.doc_id].log_likelihood, r.log_likelihood, rtol=1e-5)
        assert (got[r.doc_id].perplexity is None) == (r.perplexity is None)
    texts = [(r.text or "").encode() for r in docs.collect()]
    count = lambda batch: {(r["kind"], r["key"]): r["n"] for b in lmscore._count(iter([batch])) for r in b.to_pylist()}
    whole = count(pa.record_batch([pa.array(texts, pa.binary())], ["b"]))
    sums: dict = {}
    for b in rows.select("types", "shaped", "places", "lengths").toArrow().to_batches():
        for k, n in count(b).items():
            sums[k] = sums.get(k, 0) + n
    assert sums == whole


@pytest.mark.parametrize("kinds", [200, 300, 70_000])
def test_numbers_of_tokens_of_any_width(spark, kinds):
    """A text with few, many and very many different tokens; every token comes back."""
    text = " ".join(f"w{i * i % kinds}x{i % kinds}" for i in range(kinds))
    (row,) = lmscore.coded(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("types", "shaped", "places", "lengths").toArrow().to_batches()
    ((types, shaped, at, lengths),) = lmscore._read(iter([row]))
    assert [types[i] for i in at] == lmscore.tokens(text.encode()) and lengths.tolist() == [kinds]
    assert shaped.tolist() == lmscore._shaped(types).tolist()


@pytest.mark.parametrize("scale", [0.3, 40])
def test_gradients_of_all_groups_by_hand(scale):
    """Groups cut into blocks of rows, with and without a common shift, against softmaxes in double precision."""
    rng = np.random.default_rng(4)
    h = np.concatenate([np.tanh(rng.normal(0, 1, (70, lmscore.HIDDEN))), np.ones((70, 1))], 1).astype(np.float32)
    w, b = rng.normal(0, scale, (3, lmscore.HIDDEN, 9)).astype(np.float32), rng.normal(0, scale, (3, 9)).astype(np.float32)
    y, share = rng.integers(0, 9, 70), rng.random(70).astype(np.float32)
    runs = [(0, 0, 40), (2, 40, 70)]
    start = rng.normal(0, 1, (70, lmscore.HIDDEN)).astype(np.float32)
    dh, dw, db = start.copy(), np.full_like(w, 7), np.full_like(b, 7)
    lmscore._softmax_errors(h, w, b, y, share, runs, dh, dw, db, 16)
    for k, i, j in [*runs, (1, 70, 70)]:
        own = h[i:j, :-1].astype(float)
        z = own @ w[k] + b[k]
        z = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
        z *= (share[i:j] / z.sum(1))[:, None]
        z[np.arange(j - i), y[i:j]] -= share[i:j]
        assert np.allclose(dh[i:j], start[i:j] + z @ w[k].T, atol=1e-3) and np.allclose(dw[k], own.T @ z, atol=1e-4) and np.allclose(db[k], z.sum(0), atol=1e-4)


def test_steps_are_of_like_size(monkeypatch):
    """A few tokens beyond a whole number of batches make no step of their own."""
    steps = []
    adam = lmscore._adam
    monkeypatch.setattr(lmscore, "_adam", lambda *a: (steps.append(a[4]), adam(*a)))
    flat = lmscore.initial(np.ones(lmscore.CLASSES))
    rng = np.random.default_rng(3)
    lmscore.fit_steps(flat, rng.integers(0, lmscore.RARE, (203, 4)), rng.integers(0, lmscore.RARE, 203), batch=100)
    assert steps == [1, 2]
