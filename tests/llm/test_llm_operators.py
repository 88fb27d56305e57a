"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward inputs."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidecast.llm import bpe, decontaminate, embeddings, html, langid, linededup, lmscore, neardup, secrets, toxicity
from tidecast.llm import common
from tidecast.llm.common import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and thing with over river stone window green walking house under water".split(),
    "fr": "le la les été forêt rivière pierre fenêtre verte maison sous eau très où".split(),
    "de": "der die das über größe fluß stein fenster grün gehen haus unter wasser für".split(),
}


def prose(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    rows = []
    passage = "\n".join(" ".join(f"q{rnd.randrange(900)}" for _ in range(15)) for _ in range(5))
    for i in range(120):
        lang = list(WORDS)[i % 3]
        text = "\n".join(prose(rnd, lang, rnd.randrange(5, 60)) for _ in range(rnd.randrange(1, 6)))
        if i % 10 == 4:
            text += "\n" + passage
        rows.append((i, text, lang, "s", len(text)))
    for k in range(8):  # near and exact copies
        words = rows[k][1].split(" ")
        if k % 2:
            words[len(words) // 2] = "changed"
        rows.append((200 + k, " ".join(words), rows[k][2], "s", 0))
    rows += [(300, None, None, None, None), (301, "", "en", None, 0), (302, " \n\t ", "en", "s", 3), (303, "123 456 !!", None, "s", 0), (None, "no id here at all", "en", "s", 0), (304, "x " * 30000, "en", "s", 0)]
    rows += [rows[5], rows[-1]]  # repeated rows
    return spark.createDataFrame(rows, DOC).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# -- 1 ---------------------------------------------------------------------


def brute_lines(rows, least):
    """All minimal windows by enumeration."""
    docs = sorted({(i is not None, i if i is not None else -1, t) for i, t in rows if t}, key=lambda d: d[:2])
    seen, out = {}, {}
    runs = []
    for known, i, t in docs:
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
        size = [x.strip(" ").count(" ") + 1 for _, x in lines]
        found = set()
        for p in range(len(lines)):
            for e in range(p, len(lines)):
                if sum(size[p : e + 1]) >= least:
                    found.add((p, e))
                    break
            for s in range(p, -1, -1):
                if sum(size[s : p + 1]) >= least:
                    found.add((s, p))
                    break
        runs += [((known, i), p, e, tuple(x for _, x in lines[p : e + 1]), [k for k, _ in lines[p : e + 1]]) for p, e in sorted(found)]
    for doc, p, e, key, nums in sorted(runs, key=lambda r: (r[0], r[1])):
        if key in seen:
            out.setdefault(doc[1], set()).update(nums)
        seen.setdefault(key, 1)
    return out


@pytest.mark.parametrize("least", [50, 12])
def test_line_dedup(corpus, least):
    got = {r.doc_id if r.doc_id is not None else -1: set(r.deleted_lines) for r in linededup.dedup_lines(corpus, min_words=least).collect() if r.deleted_lines}
    want = brute_lines(texts(corpus), least)
    assert got == want and want


def test_line_dedup_text_and_edges(spark, corpus, empty):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n\n{long}\nd"), (3, long), (4, None), (5, ""), (6, f"{long}\n{long}")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"a\n{long}\nb", 2: "c\n\nd", 3: "", 4: None, 5: "", 6: ""}
    assert linededup.dedup_lines(empty).count() == 0
    kept = linededup.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]


# -- 2 ---------------------------------------------------------------------


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_decontaminate(spark, corpus, limit, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    some = [t for _, t in sorted(texts(corpus), key=str) if t][:60]
    items = [(k, t.replace(",", ";").upper() if k % 2 else t) for k, t in enumerate(some[:9])] + [(20, "x x"), (21, "zebra"), (22, None), (23, ""), (None, some[12]), (20, "x x"), (24, "ÉTÉ FORÊT le"), (25, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.h): (sorted(r["items"]), r.n_hit) for r in decontaminate.contamination(corpus, bench).collect()}
    hashes = {(r.doc_id, r.text): r.h for r in corpus.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    want = {}
    for (i, t), h in hashes.items():
        w, hit, its = plain_words(t), set(), set()
        for item, b in items:
            q = plain_words(b)
            n = min(10, len(q))
            for a in range(len(q) - n + 1) if n else ():
                for s in range(len(w) - n + 1) if len(w) < 2000 or n < 3 else ():
                    if w[s : s + n] == q[a : a + n]:
                        hit.update(range(s, s + n))
                        its.add(item)
        if hit:
            want[i, h] = (sorted(x for x in its if x is not None), len(hit))
    assert got == want and len(want) > 5


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_words_are_lowered_apart_from_their_neighbours(spark, limit, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rnd = random.Random(5)
    letters, signs = "ΣσςΑαΙİiIıBßẞéÉKK", " .-'·:_\n "
    text = lambda n: "".join(rnd.choice(letters if rnd.random() < 0.62 else signs) for _ in range(n))
    items = [(k, text(rnd.randrange(1, 26))) for k in range(60)] + [(100, "ΑΣ ΒΓ ΔΕ")]
    docs = [(900, "ΑΣ.ΒΓ ΔΕ one two three"), (901, "ΑΣ ΒΓ ΔΕ one"), (902, "ΑΣ-ΒΓ ΔΕ"), (903, None), (904, ""), (905, "Q " * 20000)]
    for k in range(200):
        w = [x.upper() if x.isascii() and rnd.random() < 0.5 else x for x in plain_words(rnd.choice(items)[1])]
        docs.append((k, text(rnd.randrange(30)) + rnd.choice(" .-") + rnd.choice(" .-:").join(w) + rnd.choice(" .-") + text(9)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("x"))
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("item", F.lit(2))
    got = {r.id: (sorted(r["items"]), r.n_hit) for r in decontaminate.contamination(rows, bench).collect()}
    want = {}
    for i, t in docs[:4] + docs[6:]:
        w, hit, its = plain_words(t), set(), set()
        for item, b in items:
            q = plain_words(b)
            n = min(10, len(q))
            for a in range(len(q) - n + 1) if n else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == q[a : a + n]:
                        hit.update(range(s, s + n))
                        its.add(item)
        if hit:
            want[i] = (sorted(its), len(hit))
    assert got == want and {900, 901, 902} <= set(got)


def test_decontaminate_empty(spark, corpus, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(corpus, none).count() == 0
    assert decontaminate.contamination(empty, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


# -- 3 ---------------------------------------------------------------------


def test_langid(corpus, empty):
    model = langid.train(corpus, use=lambda i: ~langid.held_out(i))
    got = langid.predict(corpus.withColumn("score", F.lit("clash")), model).collect()
    held = [r for r in got if r.lang and r.text and langid.has_letter(r.text.encode()) and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if not r.text or not any(map(str.isalpha, r.text)))
    assert all(0 <= r.score <= 1 for r in got) and len(got) == corpus.count()
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    x = np.frombuffer(np.random.default_rng(1).integers(32, 255, 40 * langid.WINDOW).astype(np.uint8).tobytes(), np.uint8).reshape(40, -1)
    slow = []
    for row in x:
        pooled = [max_over(row, c) for c in model.conv]
        z = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.out_bias
        slow.append(z - np.log(np.exp(z - z.max()).sum()) - z.max())
    assert np.allclose(model.log_probabilities(x), slow, atol=1e-3)


def test_language_stage_rejects_what_is_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(3)
    noise = []
    for i, (text,) in enumerate(docs.select("text").where("length(text) > 300").limit(120).collect()):
        signs = list(text) if i % 2 else [rnd.choice("bcdfghjklmnpqrstvwxyz eioua") for _ in text]
        rnd.shuffle(signs)
        noise.append((10**6 + i, "".join(signs), None, "noise", len(signs)))
    rows = docs.union(spark.createDataFrame(noise, docs.schema)).withColumn("score", F.lit("own")).withColumn("lang_pred", F.lit(7))
    kept = langid.keep_known_language(spark, rows, "")
    assert kept.columns == rows.columns
    got = {r.doc_id: (r.score, r.lang_pred) for r in kept.collect()}
    assert set(got.values()) == {("own", 7)}
    assert sum(i >= 10**6 for i in got) <= 6 and sum(i < 10**6 for i in got) >= 0.995 * docs.count()


def test_language_stage_keeps_short_texts(spark):
    """Sentences of under 60 characters from every language's texts, and those of other languages, stay; letterless ones go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cut = docs.where("lang IS NOT NULL AND length(text) > 300").withColumn("text", F.substring("text", 1, 12 + F.pmod("doc_id", F.lit(47)).cast("int")))
    cut = cut.withColumn("doc_id", F.col("doc_id") + 10**7)
    plain = ["Hello world", "Guten Tag", "Bonjour le monde", "La casa es grande", "The shor.", "Onhaha sh.", "ok"]
    own = spark.createDataFrame([(10**6 + i, t, None, "short", len(t)) for i, t in enumerate([*plain, "12 34", " ", ""])], docs.schema)
    kept = {r.doc_id for r in langid.keep_known_language(spark, docs.union(own).union(cut.select(*docs.columns)), "").collect()}
    assert {i for i in kept if 10**6 <= i < 10**7} == {10**6 + i for i in range(len(plain))}
    want = {r.doc_id for r in cut.collect() if langid.has_letter(r.text.encode())}
    assert len(want) > 300 and {i for i in kept if i >= 10**7} == want


def test_equal_scores_go_to_the_first_language(spark):
    model = langid.ByteCnn(["aa", "bb"], [np.zeros((w, 256, langid.FILTERS), "f4") for w in langid.WIDTHS], np.zeros(36, "f4"), np.zeros((36, 2), "f4"), np.zeros(2, "f4"))
    (r,) = langid.predict(spark.createDataFrame([(1, "word " * 50000)], "doc_id long, text string"), model).collect()
    assert (r.lang_pred, r.score) == ("aa", 0.5)


def max_over(row, c):
    return np.max([sum(c[j][row[t + j]] for j in range(len(c))) for t in range(len(row) - len(c) + 1)], axis=0)


# -- 4 ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav><a>m</a></nav><article><h1>T &amp; x</h1><p>a\n  b<br>c<p>d</article><footer>f</footer>", "T & x\n\na b c\n\nd"),
        ("<div class='ad'>x</div><p>Body &lt; text<p>two<div id=comments><article><p>no</article></div>", "Body < text\n\ntwo"),
        ("<form><article><h1>T</h1>a <aside>s</aside></article></form>", "T\n\na"),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style><!-- c --><main><p>yes</p></main><div class=sidebar>no</div>", "yes"),
        ("plain 3 < 4 &eacute; <b>bold</b> end", "plain 3 < 4 é bold end"),
        ("<article><div class='cookie-notice'>n</div><ul><li>one<li>two</ul></article>", "one\n\ntwo"),
        ("<p>unclosed <!-- comment", "unclosed"),
        ("", ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_style_tree_removes_what_repeats(spark):
    rnd = random.Random(5)
    rows = [(k, "http://h.example/a", f"<div class=x1><p>Same words everywhere</p></div><div class=x2><p>{prose(rnd, 'en', 30)}</p></div>") for k in range(20)]
    rows += [(30, None, None), (31, "http://other", "<p>one page</p>"), (31, "http://other", "<p>one page</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit(1)).withColumn("host", F.lit("own")).withColumn("tree", F.lit(1)).withColumn("site", F.lit(2))
    got = {r.page_id: r for r in html.extract(frame).collect()}
    assert all("Same" not in got[k].main_text and got[k].n_chars > 50 for k in range(20))
    assert got[30].main_text == "" and got[31].main_text == "one page" and (got[31].host, got[31].tree, got[31].site) == ("own", 1, 2)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_equals_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(60):
        body = "".join(f"<p>{prose(rnd, 'en', rnd.randrange(1, 9))}</p>" for _ in range(rnd.randrange(1, 5)))
        rows.append((k, f"https://h{k % 3}.example/{k}", f"<nav><a>Home</a><a>{rnd.choice('ab')}</a></nav><div><div class=t>{body}</div></div><div>foot {k % 7}</div>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    counts = html.branch_counts(frame)
    for keys in (["host", "branch"], ["branch"]):
        pages, styles, said = {}, {}, {}
        for _, url, page in rows:
            host = url.split("/")[2]
            for branch, kind, feature in html.page_counts(page):
                key = (host, branch)[2 - len(keys) :]
                if kind == 2:
                    pages[key] = pages.get(key, 0) + 1
                else:
                    of = (styles if kind == 0 else said).setdefault(key, {})
                    of[feature] = of.get(feature, 0) + 1
        entropy = lambda some: -sum(n / sum(some.values()) * np.log(n / sum(some.values())) for n in some.values())
        got = {tuple(r[k] for k in keys): r for r in html.style_tree(counts, keys).collect()}
        assert got.keys() == pages.keys()
        for key, r in got.items():
            scale = np.log(max(pages[key], 2))
            # a feature's own entropy over the pages that have it, the mean over all mentions
            shared = sum(n * np.log(n) for n in said[key].values()) / sum(said[key].values()) / scale
            assert r.pages == pages[key]
            assert np.isclose(r.presentation, min(1, entropy(styles[key]) / scale)) and np.isclose(r.content, 1 - shared)
            assert np.isclose(r.importance, 0.2 * r.presentation + 0.8 * r.content)


@pytest.mark.parametrize("n", [4, 20, 200])
def test_every_shingle_is_in_a_feature(n):
    """One word changed, wherever it stands, changes a feature; what stays shares most of them."""
    words = prose(random.Random(n), "en", n).split()
    whole = set(html.features(" ".join(words)))
    for i in range(len(words)):
        assert set(html.features(" ".join([*words[:i], "changed", *words[i + 1 :]]))) != whole, i
    assert len(whole & set(html.features(" ".join(["some", "more", *words])))) >= len(whole) - 1


def test_no_feature_of_a_branch_is_left_out(spark):
    """A list of 40 different links in a branch: all of them are counted, for it and what is above it."""
    page = "<ul>" + "".join(f"<li>link {i}</li>" for i in range(40)) + "</ul>"
    rows = [(k, f"http://h{k % 2}/", page + f"<p>page {k}</p>") for k in range(6)]
    counts = html.branch_counts(spark.createDataFrame(rows, "page_id long, url string, html string")).where("kind = 1")
    per_branch = sorted(r["count"] for r in counts.where("n = 3").groupBy("host", "branch").count().collect())
    assert per_branch == [40] * 6


@pytest.mark.parametrize("names", ["declared", "renamed", "bare"])
def test_the_tree_decides_without_declared_roles(spark, names):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: html.main_text(re.search(r"<article>.*?</article>", r.html, re.S)[0]) for r in pages.collect()}
    changed = pages
    if names != "declared":
        ad = ' class="k9"' if names == "renamed" else ""
        changed = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(nav|article|footer)>", "<$1div>"), ' class="ad"', ad))
    got = {r.page_id: r.main_text for r in html.extract(changed).collect()}
    assert sum(got[k] == v for k, v in want.items()) >= (1.0 if names == "declared" else 0.95) * len(want)


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><div class="side-by-side"><p>Body text</p></div></article>', "Body text"),
        ("<article><p class=form-factor>x</p><p class=ad-hoc>y</p><h2>t <a class=header-anchor>q</a></h2><math><mi>m</mi></math><noscript>n</noscript></article>", "x\n\ny\n\nt q\n\nm\n\nn"),
        ("<main><p>intro</p><article>z</article></main>", "intro\n\nz"),
        ("<article><header><div><h1>T</h1><p>by</p></div></header><p>b</article>", "T\n\nb"),
        ("<p title=it's a=\"x>y\" b='>'>don't</p>", "don't"),
        ("<article>a<div class=comments>no<article>no</article></div></article>", "a"),
        ("<article>a<form>no</form>b</article>", "a\n\nb"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_nothing_else_goes(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("part", ["<a ", '<a "', '<a =">', "</x ", "<p><b>", "<div>x", "<![CDATA[", "<!--x"])
def test_long_pages_take_time_in_proportion(part):
    import time

    def took(n):
        began = time.thread_time()
        html.main_text(part * (n // len(part)))
        return time.thread_time() - began

    took(20_000)
    assert took(400_000) < 40 * max(took(40_000), 0.01)


# -- 5 ---------------------------------------------------------------------


def test_secrets_against_regex(spark):
    rnd = random.Random(1)
    parts = ["token", "=", ": ", "Secret", "api_key", "APIKEY", "AKIA", "A" * 16, "0a" * 6, "f" * 12, '"', "'", " ", "x", "é", "passw", "password", "==", "toktoken", "9" * 20, "\n", "日本"]
    rows = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randrange(9)))) for k in range(4000)] + [(9000, None), (9001, ""), (9002, "token=" + "q" * 100000)]
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").withColumn("secrets", F.lit(0))).collect():
        t = r.text or ""
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted((s.kind, s.start, s.end) for s in r.secrets if s.base) == sorted(want), t


def test_secret_rules_that_need_backing_up_are_refused():
    with pytest.raises(ValueError):
        secrets.SecretScanner((secrets.Rule("bad", "ab|abcd"),))


# -- 6 ---------------------------------------------------------------------


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, corpus, empty):
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = texts(corpus)
    for k in range(90):  # a large group whose members differ in more and more words
        w = list(base)
        for _ in range(rnd.randrange(8)):
            w[rnd.randrange(150)] = f"n{rnd.random()}"
        rows.append((1000 + k, " ".join(w)))
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    sets = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            sets[i] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()
    want = brute_components(sets, 85)
    assert {i: r.component_id for i, r in got.items() if i is not None} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets.items())
    assert got[None].component_id is None and got[None].kept
    assert neardup.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    n = 400
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r.id: r.component_id for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


# -- 7 ---------------------------------------------------------------------


def test_bpe_equals_library(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_padding(), t.no_truncation()
    extra = [(900, "it's Don't WE'LL <|endoftext|> x<|startoftext|><|endoftext|>"), (901, "ΣΟΦΟΣ İstanbul 1²½ \x1c\x1d a\x85b é café 日本語 🙂👍🏽 a_b--c\n\n'S"), (902, "<|endoftext"), (903, "a\x00b aaaaaaaaaaaaaaaa")]
    rows = corpus.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    for r in bpe.bpe(rows.withColumn("n_tokens", F.lit("clash"))).collect():
        e = t.encode(r.text or "", add_special_tokens=False)
        assert r.token_ids == e.ids and r.n_tokens == len(e.ids)
        shown = t.decode(e.ids, skip_special_tokens=False)
        assert r.decoded == shown and r.decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()


# -- 8 ---------------------------------------------------------------------


def test_toxicity_chain(spark, empty):
    rnd = random.Random(4)
    rows, labels = [], []
    for k in range(700):
        bad, low = rnd.random() < 0.3, rnd.random() < 0.4
        words = prose(rnd, "en", rnd.randrange(5, 200)).split()
        if low:
            words.insert(0, "buynow")
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["scumbag", "scumlord", "vileness"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(low), int(bad)))
    docs = spark.createDataFrame(rows + [(9000, None), (9001, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels[:500] + [(9000, None, 1), (None, 1, 1), labels[0]], "doc_id long, low_quality int, toxic int")
    chain = toxicity.train(docs, known, toxicity.CATEGORIES)
    assert [len(w) for w in chain.weights] == [len(chain.vocabulary) + 1, len(chain.vocabulary) + 2]
    got = {r.doc_id: r for r in toxicity.predict(docs, chain, toxicity.CATEGORIES).collect()}
    assert sum(got[k].is_toxic == bool(t) for k, _, t in labels[500:]) >= 195
    assert not got[9000].is_toxic and not got[9001].is_toxic and len(got) == 702
    assert toxicity.train(empty, known.limit(0), toxicity.CATEGORIES) is None
    # the sum over words, and the earlier category's probability, by hand
    for k in (3, 501, 502):
        have = toxicity.features(rows[k][1])
        p = []
        for w in chain.weights:
            z = w[-1] + sum(w[i] for f, i in chain.vocabulary.items() if f in have) + sum(a * b for a, b in zip(w[len(chain.vocabulary) : -1], p))
            p.append(1 / (1 + np.exp(-z)))
        assert np.allclose(p, [got[k].p_low_quality, got[k].p_toxic], atol=1e-5)
    twice = toxicity.predict(docs, toxicity.train(docs.repartition(3), known.repartition(2), toxicity.CATEGORIES), toxicity.CATEGORIES)
    assert all(np.isclose(r.p_toxic, got[r.doc_id].p_toxic) for r in twice.collect())
    assert toxicity.predict(spark.createDataFrame([(1, "word " * 50000)], "doc_id long, text string"), chain, toxicity.CATEGORIES).count() == 1
    assert toxicity.predict(empty, None, ["toxic"]).count() == 0


# -- 9 ---------------------------------------------------------------------


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 24))
    rows = []
    for k in range(300):
        v = base[k % 6] + rng.normal(size=24) * rng.choice([0.1, 0.35, 2.0])
        rows.append((k, [float(x) for x in np.float32(v)], k % 3))
    rows += [(400 + k, rows[0][1], 0) for k in range(5)]
    rows += [(500, None, 0), (501, [0.0] * 24, 0), (502, [float("nan")] * 24, 0), (503, [None] * 24, 0), (504, rows[0][1], None), (None, rows[0][1], 0), (505, rows[0][1][:5], 0), (506, [], 0), rows[3]]
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = {i: (np.array(v, float), y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    root = {r[0]: r[0] for r in rows if r[0] is not None}
    links = dict.fromkeys(root, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, y) in ok.items():
        for j, (b, z) in ok.items():
            if i < j and y == z and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, w = find(i), find(j)
                root[max(x, w)] = min(x, w)
    assert {i: (r.n_links, r.component_id) for i, r in got.items() if i is not None} == {i: (links[i], find(i)) for i in root}
    assert got[None].n_links == 0 and max(links.values()) > 20
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_code_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 32))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.3])
    x /= np.sqrt((x * x).sum(1))[:, None]
    codes, factors = embeddings.encode(x)
    maybe = embeddings.candidates(x @ embeddings.rotation(32).T, codes, factors, 0.93)
    assert maybe[x @ x.T >= 0.93].all() and maybe.mean() < 0.6


# -- 10 --------------------------------------------------------------------


def test_lm_scores(spark, corpus, empty):
    model = lmscore.train(corpus)
    got = {r.doc_id: r for r in lmscore.score(corpus.withColumn("perplexity", F.lit(1)), model).collect()}
    assert got[300].n_tokens == 0 and got[300].log_likelihood == 0 and got[300].perplexity is None
    assert all(r.n_tokens == len(lmscore.tokens((r.text or "").encode())) for r in got.values())
    rnd = random.Random(6)
    words = [w for x in WORDS.values() for w in x]
    mixed = [" ".join(rnd.choice(words) for _ in range(40)).encode() for _ in range(20)]
    noise = [bytes(rnd.randrange(97, 123) if rnd.random() < 0.8 else 32 for _ in range(200)) for _ in range(20)]
    score = lambda ts: float((lambda n, s: s.sum() / n.sum())(*model.score(ts)))
    assert score(mixed) > score(noise) + 1
    # the whole sum equals token by token, each from its own neighbours
    text = mixed[0]
    classes, spelled, starts, lengths = model.laid_out([text])
    near = lmscore.neighbours(classes, starts, lengths)
    one = [lmscore.class_log_probabilities(model.flat, near[k : k + 1], classes[k : k + 1])[0] + spelled[k] for k in range(len(classes))]
    assert np.isclose(sum(one), model.score([text])[1][0], rtol=1e-4)
    assert lmscore.score(empty, lmscore.train(empty)).count() == 0


def test_every_tokens_probability_by_hand(corpus):
    """The sum over tokens, worked out number by number from the parameters."""
    import math

    model = lmscore.train(corpus)
    emb, w1, b1, w2, b2, w3, b3 = lmscore._unpack(model.flat)
    names = list(model.frequent)
    size = w3.shape[2]

    def name(token):
        return lmscore.RARE + model.frequent[token] if token in model.frequent else lmscore.shape(token) * lmscore.HASHED + zlib.crc32(token) % lmscore.HASHED

    def log_softmax(z, k):
        top = max(z)
        return z[k] - top - math.log(sum(math.exp(v - top) for v in z))

    some = [t for _, t in texts(corpus) if t and len(t) < 900][:4] + ["zzz Q7 !", ""]
    lengths, totals = model.score([t.encode() for t in some])
    for text, n, total in zip(some, lengths, totals):
        words = lmscore.tokens(text.encode())
        want = 0.0
        for at, token in enumerate(words):
            x = []
            for d in lmscore.SIDES:
                beside = name(words[at + d]) if 0 <= at + d < len(words) else len(emb) - 1
                x += emb[beside].tolist()
            h = [math.tanh(sum(a * float(b) for a, b in zip(x, w1[:, j])) + float(b1[j])) for j in range(lmscore.HIDDEN)]
            head = [sum(a * float(b) for a, b in zip(h, w2[:, j])) + float(b2[j]) for j in range(len(b2))]
            if token in model.frequent:
                group, place = divmod(model.frequent[token], size)
                tail = [sum(a * float(b) for a, b in zip(h, w3[group][:, j])) + float(b3[group][j]) for j in range(size)]
                want += log_softmax(head, lmscore.SHAPES + group) + log_softmax(tail, place)
            else:
                want += log_softmax(head, lmscore.shape(token))
                spelled = b" " + token + b" "
                want += sum(float(model.spelling[a, b]) for a, b in zip(spelled, spelled[1:]))
        assert n == len(words) and math.isclose(total, want, rel_tol=1e-4, abs_tol=1e-6)
    assert names


def test_lm_training_helps(corpus):
    rows = [(t or "").encode() for _, t in texts(corpus)]
    freq = np.ones(lmscore.CLASSES)
    model = lmscore.WindowModel({w.encode(): k for k, w in enumerate(WORDS["en"])}, np.zeros((256, 256)), lmscore.initial(freq))
    classes, _, starts, lengths = model.laid_out(rows)
    near = lmscore.neighbours(classes, starts, lengths)
    before = lmscore.class_log_probabilities(model.flat, near, classes).mean()
    flat = lmscore.fit_steps(model.flat, near, classes, batch=64)
    assert lmscore.class_log_probabilities(flat, near, classes).mean() > before + 0.5


# -- pipeline --------------------------------------------------------------


def test_pipeline(spark, corpus, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, [t for _, t in texts(corpus.where("doc_id = 10"))][0])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r.doc_id for r in got.collect()]
    assert 10 not in ids and 300 not in ids and 303 not in ids and 11 in ids
    assert not {200, 202, 204, 206} & set(ids)
    docs = corpus
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus.columns
    nothing = corpus.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_pipeline_equals_brute_force(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    items = [t for _, t in texts(corpus.where("doc_id in (10, 33)"))] + ["x x", None]
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_sha256, list(r.token_ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # the network decides alone what is a language; all else is worked out anew
    rows = texts(corpus_pipeline.STAGES[0][1](spark, corpus, str(tmp_path)))
    assert {i for i, _ in texts(corpus)} - {i for i, _ in rows} <= {300, 301, 302, 303, 304}
    gone, cut = brute_lines(rows, linededup.MIN_WORDS), []
    for i, t in rows:
        lines = gone.get(-1 if i is None else i, set())
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lines)
        if not lines or left.strip(" "):
            cut.append((i, left))
    sets = {}
    for i, t in cut:
        w = t.encode().lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    known = brute_components({i: x for i, x in sets.items() if i is not None}, 80)
    cut = [(i, t) for i, t in cut if i is None or known[i] == i]
    windows = set()
    for item in items:
        q = plain_words(item)
        n = min(10, len(q))
        windows |= {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    clean = [(i, t) for i, t in cut if not any(tuple(w[k : k + n]) in windows for w in [plain_words(t)] for n in sizes for k in range(len(w) - n + 1))]
    assert 0 < len(clean) < len(cut) < len(rows)
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_padding(), t.no_truncation()
    want = []
    for i, text in clean:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i is not None, i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), ids))
    assert got == sorted(want)


def test_stages_leave_columns_of_any_name_alone(spark, corpus, tmp_path):
    spark.createDataFrame([(1, [t for _, t in texts(corpus.where("doc_id = 10"))][0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = {c: F.lit(f"own {c}") for c in ("id", "h", "gone", "deleted_lines", "n", "component_id", "kept", "key", "items", "score", "lang_pred", "n_tokens", "__id", "__h")}
    docs = corpus.withColumns(own)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert docs.columns == [*corpus.columns, *own]
            assert {tuple(r) for r in docs.select(*own).distinct().collect()} == {tuple(f"own {c}" for c in own)}


def test_operators_take_columns_of_any_name(spark, corpus):
    odd = corpus.withColumns({c: F.lit(1) for c in ("id", "h", "rep", "key", "gone", "component_id", "label", "unit", "band", "f", "y0", "fold", "p_toxic", "__bytes")})
    assert neardup.near_duplicates(odd).count() == corpus.count()
    assert linededup.dedup_lines(odd).count() == corpus.count()
    assert secrets.find_secrets(odd).count() == corpus.count()
    labels = corpus.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("low_quality"), F.lit(0).alias("toxic"))
    assert toxicity.predict(odd, toxicity.train(odd, labels, toxicity.CATEGORIES), toxicity.CATEGORIES).count() == corpus.count()
    assert lmscore.score(odd, lmscore.train(odd)).count() == corpus.count()
    rows = spark.createDataFrame([(1, [1.0] * 5000, 0), (2, [1.0] * 5000, 0)], "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "dim", "unit", "band", "key", "keys")})
    assert [r.n_links for r in embeddings.near_duplicate_vectors(rows).collect()] == [1, 1]


def large_label(spark):
    """A label with some hundred links, and which they are."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 64))
    x = np.concatenate([base, base[:200] + rng.normal(size=(200, 64)) * 0.35, base[:60] + rng.normal(size=(60, 64)) * 0.1])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    links = (unit @ unit.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    assert links.sum() > 200
    return spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), links


def test_large_labels_are_compared_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "EXACT_BLOCKS", 1)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    monkeypatch.setattr(embeddings, "BUCKET", 16)
    rows, links = large_label(spark)
    assert embeddings.cuts(len(links), 0.93)[1] > 1
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(rows, exact=False).collect()}
    found = sum(n for n, _ in got.values())
    assert found <= links.sum() and found >= 0.98 * links.sum()
    assert all(n <= links[k].sum() for k, (n, _) in got.items())


def test_large_labels_lose_no_link(spark, monkeypatch):
    """Beyond the size from which buckets were possible, in wide blocks and few pairs at a time."""
    monkeypatch.setattr(embeddings, "EXACT_BLOCKS", 1)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    monkeypatch.setattr(embeddings, "WIDE", 64 * 150)
    monkeypatch.setattr(embeddings, "AT_ONCE", 4096)
    rows, links = large_label(spark)
    root = np.arange(len(links))
    for _ in range(len(links)):
        least = np.minimum(root, np.where(links, root, len(links)).min(1))
        if (least == root).all():
            break
        root = least
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(rows).collect()}
    assert got == {k: (links[k].sum(), root[k], root[k] == k) for k in range(len(links))}


def test_a_chain_of_weak_links_keeps_all_of_them(spark):
    rnd = random.Random(12)
    rows, words = [], [f"c{k}" for k in range(120)]
    for k in range(160):  # each text differs a little from the one before it, and more from all others
        for _ in range(40 if k % 23 == 0 else 2):
            words[rnd.randrange(120)] = f"m{k}.{rnd.random()}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=92).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    assert got == brute_components(sets, 92) and 1 < len(set(got.values())) < 50


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(RuntimeError):
        common.shared_dir(session)


def test_native_plans_have_no_python(spark):
    for q in (linededup.op1_linededup, decontaminate.op2_decontaminate):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op1_linededup", "op2_decontaminate", "op6_neardup", "op9_embeddings"])
def test_oracles(spark, name):
    from tidecast import llm

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = llm.queries()[name](spark, d)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
