"""The filter audit and the two searches against brute force, and on awkward inputs."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidecast.llm import adaptive_scan, interaction, lexical

DOC = "doc_id long, text string, lang string, source string, n_chars long"

# -- 11 --------------------------------------------------------------------


def brute_audit(docs, labels):
    """Every order applied to every document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        bad |= {"A"} if len(words) < 100 else set()
        bad |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        bad |= {"E"} if i is not None and i > first[t] else set()
        rows.append((lang or "", bad, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                gone = sum(f in r[1] for r in own) - len(here)
                kept = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(kept), len(here), gone, sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here), f]
                shapley[f] += len(here)
                left = kept
        for k in out:
            if k[0] == part:
                out[k][6] = shapley[out[k][6]] if isinstance(out[k][6], str) else out[k][6]
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    docs = []
    for i in range(160):
        words = [rnd.choice("abcdefghij") * rnd.randrange(1, 30 if i % 3 else 3) for _ in range(rnd.choice([5, 99, 100, 130]))]
        if i % 4 == 0:
            words = [w.upper() if rnd.random() < 0.3 else w for w in words]
        if i % 5 == 0:
            words[0] += rnd.choice("#$%&*|")
        docs.append((i, rnd.choice([" ", "\n", "\t\x0b"]).join(words), rnd.choice(["en", "fr", None, ""]), "s", 0))
    docs += [(200 + k, docs[k][1], "fr", "s", 0) for k in range(0, 40, 3)]
    docs += [(-3, docs[7][1], "en", None, None), (300, None, None, None, None), (301, "", "en", "s", 0), (302, " \r\n", "de", "s", 0), (303, "Word " * 40_000, "en", "s", 0), (None, docs[1][1], "en", "s", 0), (None, "alone", "fr", "s", 0), (304, "naïve Ünicode ÀÉ ☃", "fr", "s", 0)]
    docs += [docs[9], docs[0], (0, docs[0][1], "xx", "s", 0)]
    labels = [(i, rnd.randrange(2), rnd.randrange(2)) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (999, 1, 1)]
    return docs, labels


def test_filter_audit(spark, corpus):
    docs, labels = corpus
    a = spark.createDataFrame([(*d, 7) for d in docs], DOC + ", mask int").repartition(5)  # a column with a name that is used within
    b = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in interaction.audit(interaction.failure_cells(a, b), interaction.NAMES).collect()}
    want = brute_audit(docs, labels)
    assert len(got) == 600 * len({k[0] for k in want}) and got == want


def test_filter_audit_edges(spark):
    empty = spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(interaction.failure_cells(empty, labels), interaction.NAMES).count() == 0
    assert len(interaction.edges(5)) == 80 and len(interaction.paths(list("ABCDE"))) == 600
    cells = spark.createDataFrame([("x", 3, 5, 2, 1), ("x", 0, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in interaction.audit(cells, ["P", "Q"]).collect()}
    assert (rows["PQ", 1].removed, rows["PQ", 2].redundant, rows["QP", 2].kept, rows["QP", 1].shapley) == (5, 5, 4, 5)
    with pytest.raises(ValueError):
        interaction.audit(cells, list("ABCDEFGH"))


# -- 12 --------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=50):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_all = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = {}
    for item, own in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        rows = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_all
            rows.append((-sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c), i is None, i or 0))
        for rank, (s, void, i) in enumerate(sorted(r for r in rows if r[0] < 0)[:k], 1):
            out[item, rank] = (None if void else i, -s)
    return out


@pytest.fixture(scope="module")
def library():
    rnd = random.Random(21)
    topics = [[f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{x}{t}" for x in range(60)] for t in range(6)]
    common = "the of And to é ñandú x1 Ⅷ".split()
    docs = []
    for i in range(700):
        topic = topics[i % 6]
        docs.append((i * 3 % 701, " ".join(rnd.choice(topic) if rnd.random() < 0.6 else rnd.choice(common) for _ in range(rnd.choice([3, 20, 80])))))
    docs += [(2000 + i, docs[5][1]) for i in range(150)]  # copies
    docs += [(4000, None), (4001, ""), (4002, "?! \n"), (None, docs[5][1]), (4003, "THE " + "bulk " * 30_000 + "bulk"), docs[5], docs[5]]
    items = [(i, " ".join(rnd.choice(topics[i % 6]) for _ in range(8)) + " The of") for i in range(30)]
    items += [(90, None), (91, "..."), (92, "nowhere else"), (None, "the of"), (93, "the the THE"), (3, "bulk x1"), (94, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search(spark, library, small, monkeypatch):
    docs, items = library
    if small:  # several shards, a tree over them, many clusters, and several blocks of queries
        for name, value in (("SHARD", 90), ("CLUSTER", 8), ("SAMPLE", 256), ("LEAF", 8)):
            monkeypatch.setattr(lexical, name, value)
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(a, b, query_terms=100 if small else lexical.QUERY_TERMS).collect()
    assert len({(r.item_id, r["rank"]) for r in got}) == len(got)
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got} == brute_search(docs, items)


def test_lexical_search_of_nothing(spark, library):
    docs, items = library
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), no_items).count() == 0


def test_bisection_brings_like_documents_together():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 12) + 40 * (d % 4)) for d in range(256)]
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    leaf, saves = lexical.bisect(ptr, np.concatenate(rows), 160, 2)
    assert np.bincount(leaf).tolist() == [64] * 4
    for topic in range(4):
        assert np.bincount(leaf[topic::4]).max() >= 60
    down = lexical.descend(ptr, np.concatenate(rows), 160, saves)
    assert (down == leaf).mean() > 0.95


def test_visits_stop_at_the_bound(monkeypatch):
    """Clusters whose bound can't reach the last answer aren't scored; one that could tie is."""
    q = lexical.Queries([(1, 0), (1, 1)], np.array([10, 5]))
    scored = []
    real = lexical.Queries.scores
    monkeypatch.setattr(lexical.Queries, "scores", lambda self, item, n, *a: scored.append(n) or real(self, item, n, *a))
    clusters = [([7, 8], [0], [9], [0, 2], [0, 1], [9, 9]), ([1, 2, 3], [0], [9], [0, 3], [0, 1, 2], [9, 9, 9]), ([5], [1], [9], [0, 1], [0], [9])]
    import pyarrow as pa

    names = ["docs", "terms", "most", "ptr", "slots", "impacts"]
    kinds = [pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array([c[i] for c in clusters], k) for i, k in enumerate(kinds)], names)
    (out,) = lexical._visited(q, 2, np.ones(1, np.int64))(iter([batch]))
    assert out.column("doc_id").to_pylist() == [1, 2] and out.column("score").to_pylist() == [90, 90]
    assert scored == [2, 3]


# -- 13 --------------------------------------------------------------------


def brute_nearest(rows, k=20, every=20):
    able = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for i, v in able:
        if i % every:
            continue
        score = lambda w: float(adaptive_scan.inner(np.array([v]), np.array([w]))[0])
        near = sorted((-score(w), j) for j, w in able if j != i and len(w) == len(v))
        out[i] = [(j, -s) for s, j in near[:k]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(12, 40))
    rows = [(i, (centre[i % 12] + rng.normal(size=40) * 0.6).tolist()) for i in range(900)]
    rows = [(i, [c * (1 + i % 3) for c in v]) for i, v in rows]  # norms differ
    rows += [(1000 + i, rows[40][1]) for i in range(120)]  # copies
    rows += [(2000, None), (2020, []), (2040, [0.0] * 40), (2060, [math.nan] + [1.0] * 39), (2080, [None] + [1.0] * 39), (2100, [1.0, 2.0]), (2101, [3.0, -1.0]), (None, rows[3][1]), (2120, [math.inf] + [1.0] * 39)]
    return [*rows, rows[20], rows[41]]


@pytest.mark.parametrize("per_list", [50, 100_000])
def test_nearest(spark, vectors, per_list, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "CANDIDATES", 64)
    monkeypatch.setattr(adaptive_scan, "QUERIES", 16)
    df = spark.createDataFrame([(*r, 1) for r in vectors], "vec_id long, embedding array<double>, list int").repartition(4)
    got = defaultdict(list)
    for r in sorted(adaptive_scan.nearest(df, per_list=per_list).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = brute_nearest(vectors)
    assert got.keys() == want.keys() and got[2100] == [(2101, 1.0)]
    true = {q: dict(w) for q, w in want.items()}
    hits = sum(len({j for j, _ in got[q]} & true[q].keys()) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    exact = {i: v for i, v in vectors if i is not None}
    for q, near in got.items():
        assert all(s == adaptive_scan.inner(np.array([exact[q]]), np.array([exact[j]]))[0] for j, s in near)
        assert near == sorted(near, key=lambda r: (-r[1], r[0]))
    if per_list > len(vectors):  # one list holds every neighbour
        assert hits >= 0.999 * sum(map(len, want.values()))


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert adaptive_scan.nearest(none).count() == 0
    alone = spark.createDataFrame([(20, [1.0, 2.0]), (40, None)], "vec_id long, embedding array<float>")
    assert adaptive_scan.nearest(alone).count() == 0


def test_tests_abandon_far_candidates_early():
    """Most candidates go before their last columns are read, and none of the nearest does."""
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=(20, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q /= np.linalg.norm(q, axis=1)[:, None]
    x[:400] = q[np.arange(400) % 20] + rng.normal(size=(400, 64)) * 0.05
    read = []
    real = adaptive_scan.inner
    adaptive_scan.inner = lambda a, b: read.append(len(a)) or real(a, b)
    try:
        found = adaptive_scan.scan(q, x, np.full(20, -1), np.arange(4000), np.full(20, -np.inf), 20)
    finally:
        adaptive_scan.inner = real
    assert sum(read) < 0.2 * 20 * 4000
    for i in range(20):
        near = set(np.argsort(-(x @ q[i]))[:20].tolist())
        assert len(near & set(found.ids[found.rows == i].tolist())) >= 19
