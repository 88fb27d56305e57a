"""Language identification by a byte convolutional network.

Filters of several widths slide over the UTF-8 bytes of fixed-length windows;
each filter's largest response in the window, rectified, goes to a softmax over
the languages. The network is trained in numpy on labelled windows and applied
to every window of every text; a text's languages are scored by the mean of its
windows' log-probabilities, each weighed by the bytes that it adds.

Where texts are to be rejected, the network has one class more, for what is no
language: the training windows with their characters shuffled, and random
letters, digits and signs. The probability from which a text counts as that is
set on labelled texts that the training left out. Short texts, which those
hardly hold, have too few bytes to prove that, and get the likeliest language.
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

from tidecast.llm.common import as_bytes, column_bytes, map_arrow, set_aside, table, without

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: The bound of the training sample: texts a language (on average; twice that at most) and windows a text.
TEXTS_PER_LANG = 400
WINDOWS_PER_TEXT = 4
UNKNOWN = "und"
#: Labelled texts left out of the training to set the bound of rejection, on average as a share of those in it.
LEFT_OUT = 0.5
#: Texts of fewer characters than this are too little evidence of no language and are never rejected.
REJECT_FROM = 60
_ASCII_LETTER = re.compile(rb"[A-Za-z]").search


def has_letter(data: bytes) -> bool:
    return bool(_ASCII_LETTER(data)) or any(map(str.isalpha, data.decode("utf-8", "replace")))


def windows(data: bytes) -> tuple[list[bytes], list[int]]:
    """Fixed-length windows that cover all of ``data``, and the new bytes in each.

    The last one is moved back to end with the text; a text shorter than one
    window is padded with zero bytes.
    """
    n = len(data)
    if n <= WINDOW:
        return [data.ljust(WINDOW, b"\0")], [max(n, 1)]
    full, rest = divmod(n, WINDOW)
    cut = [data[i * WINDOW : (i + 1) * WINDOW] for i in range(full)]
    new = [WINDOW] * full
    if rest:
        cut.append(data[-WINDOW:])
        new.append(rest)
    return cut, new


@dataclass
class ByteCnn:
    langs: list[str]
    conv: list[np.ndarray]  # for each width: (width, 256, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    #: Where the last of ``langs`` is no language: the probability from which a text is of none.
    bound: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
        """Adam on the cross-entropy; ``x`` is (n, WINDOW) bytes, ``y`` the language numbers."""
        rng = np.random.default_rng(seed)
        k = len(WIDTHS) * FILTERS
        conv = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype("f4") for w in WIDTHS]
        params = [*conv, np.zeros(k, "f4"), rng.normal(0, 0.1, (k, len(langs))).astype("f4"), np.zeros(len(langs), "f4")]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        weight = len(y) / np.maximum(np.bincount(y, minlength=len(langs)), 1) / len(langs)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                xb, yb = x[rows], y[rows]
                n = np.arange(len(rows))
                best, pooled = [], []
                for w, c in zip(WIDTHS, params):
                    z = sum(c[j][xb[:, j : WINDOW - w + 1 + j]] for j in range(w))
                    best.append(z.argmax(1))
                    pooled.append(np.take_along_axis(z, best[-1][:, None], 1)[:, 0])
                h = np.concatenate(pooled, 1) + params[-3]
                a = np.maximum(h, 0)
                logits = a @ params[-2] + params[-1]
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[n, yb] -= 1
                d = p * (weight[yb] / len(rows))[:, None].astype("f4")
                dh = (d @ params[-2].T) * (h > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    g = np.zeros_like(params[i])
                    part = dh[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (xb[n[:, None], best[i] + j], np.arange(FILTERS)[None]), part)
                    grads.append(g)
                grads += [dh.sum(0), a.T @ d, d.sum(0)]
                t += 1
                for q, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return cls(langs, params[: len(WIDTHS)], *params[len(WIDTHS) :])

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by byte pair: of the first two bytes of every filter, and of the two bytes after them."""
        one, two = [], []
        for w, c in zip(WIDTHS, self.conv):
            one.append((c[0][:, None] + c[1][None]).reshape(65536, -1))
            if w > 2:
                more = c[3] if w > 3 else np.zeros_like(c[2])
                two.append((c[2][:, None] + more[None]).reshape(65536, -1))
        return np.concatenate(one, 1), np.concatenate(two, 1)

    def log_probabilities(self, x: np.ndarray, tables=None, step: int = 128) -> np.ndarray:
        """(n, languages) for (n, WINDOW) bytes, a few windows at a time."""
        one, two = tables or self.tables()
        k = len(WIDTHS) * FILTERS
        out = np.empty((len(x), len(self.langs)), "f4")
        for at in range(0, len(x), step):
            xb = x[at : at + step].astype(np.int32)
            pair = xb[:, :-1] * 256 + xb[:, 1:]
            z = one[pair]
            m = np.empty((len(xb), k), "f4")
            m[:, :FILTERS] = z[:, :, :FILTERS].max(1)
            # a filter wider than what is left at the end stops at the last place where it fits
            z = z[:, :-2, FILTERS:]
            z += two[pair[:, 2:]]
            m[:, FILTERS:] = z.max(1)
            edge = one[pair[:, -2], FILTERS : 2 * FILTERS] + self.conv[1][2][xb[:, -1]]
            m[:, FILTERS : 2 * FILTERS] = np.maximum(m[:, FILTERS : 2 * FILTERS], edge)
            logits = np.maximum(m + self.bias, 0) @ self.out + self.out_bias
            logits -= logits.max(1, keepdims=True)
            out[at : at + step] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out


def no_language(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows of no language, one for each of ``x``: its characters shuffled, or random letters, digits or signs."""
    out = []
    for row in x:
        kind = rng.integers(4)
        chars = list(row.tobytes().rstrip(b"\0").decode("utf-8", "ignore"))
        if kind < 2:  # the places of white space stay, as it is in the text or in a random word length
            inner = [i for i, c in enumerate(chars) if not c.isspace()] if kind else list(range(len(chars)))
            for i, j in zip(inner, rng.permutation(inner).tolist() if inner else []):
                if i < j:
                    chars[i], chars[j] = chars[j], chars[i]
        else:
            signs = "abcdefghijklmnopqrstuvwxyz     " if kind == 2 else "".join(map(chr, range(32, 127)))
            chars = [signs[i] for i in rng.integers(len(signs), size=len(chars))]
        data = "".join(chars).encode()[:WINDOW]
        out.append(np.frombuffer(data.ljust(WINDOW, b"\0"), np.uint8))
    return np.array(out, np.uint8).reshape(-1, WINDOW)


def shortened(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows, every third one cut to a random length, as short texts are."""
    x = x.copy()
    for i in range(0, len(x), 3):
        x[i, rng.integers(4, WINDOW) :] = 0
    return x


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", use=None, reject: bool = False) -> ByteCnn | None:
    """Fit the network on a bounded sample of the labelled rows for which ``use`` holds.

    The sample is chosen by a hash of ``doc_id``; only its windows, cut out by
    Spark at places that the hash gives, come to the driver, in an order of
    their own. None without labelled text. With ``reject`` there is a class for
    texts of no language, and the bound from which they count as such is set
    so that none of the labelled texts left out of the training does.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("i"), as_bytes(text).alias("b"), F.col(lang).cast("string").alias("l"))
    rows = rows.where(F.col("l").isNotNull() & (F.length("b") > 0))
    if use is not None:
        rows = rows.where(use(F.col("i")))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    most = 1 + LEFT_OUT * reject
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, most * TEXTS_PER_LANG / counts[x]))])
    draw = lambda k: F.pmod(F.xxhash64(F.lit(k), F.coalesce("i", F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where(draw(0) < share[F.col("l")])
    place = [(F.floor(draw(k) * F.greatest(F.length("b") - WINDOW + 1, F.lit(1))) + 1).cast("int") for k in range(1, WINDOWS_PER_TEXT + 1)]
    cut = F.array(*[F.substring(F.col("b"), p, F.lit(WINDOW)) for p in place])
    held = draw(WINDOWS_PER_TEXT + 1) < LEFT_OUT / most if reject else F.lit(False)
    bound = int(2 * most * TEXTS_PER_LANG * len(langs))
    got = rows.select("l", cut.alias("w"), held.alias("held")).orderBy(draw(WINDOWS_PER_TEXT + 2), "l").limit(bound).collect()
    pairs = sorted({(bytes(w).ljust(WINDOW, b"\0"), langs.index(r["l"])) for r in got for w in r["w"] if not r["held"] and has_letter(bytes(w))})
    if not pairs:
        return None
    x = np.frombuffer(b"".join(p for p, _ in pairs), np.uint8).reshape(-1, WINDOW)
    y = np.array([k for _, k in pairs])
    if not reject:
        return ByteCnn.fit(x, y, langs)
    rng = np.random.default_rng(17)
    noise = no_language(x, rng)
    y = np.concatenate([y, np.full(len(noise), len(langs))])
    model = ByteCnn.fit(shortened(np.concatenate([x, noise]), rng), y, [*langs, UNKNOWN])
    model.bound = 0.5
    clean = [[bytes(w).ljust(WINDOW, b"\0") for w in r["w"] if has_letter(bytes(w))] for r in got if r["held"]]
    for w in filter(None, clean):
        logs = model.log_probabilities(np.frombuffer(b"".join(w), np.uint8).reshape(-1, WINDOW)).mean(0, dtype=float)
        p = np.exp(logs - logs.max())
        model.bound = max(model.bound, min(0.999, (1 + p[-1] / p.sum()) / 2))
    return model


def predict(docs: DataFrame, model: ByteCnn | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` for every whole text, however long.

    A text that is null or has no letters, or any text where there is no model,
    gets ``und`` with score 0; a text of no language, where the model has such a
    class and the text at least ``REJECT_FROM`` characters, ``und`` with that
    class's probability. Among equal scores the language first in order
    wins. Rows are apart from each other; input columns named like an output
    are replaced, all others pass through.
    """
    base = without(docs, *[c for c in ("lang_pred", "score") if c != text])
    names = [f.name for f in base.schema.fields]
    schema = StructType([*base.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            texts = column_bytes(batch.column(names.index(text)))
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            cut: list[bytes] = []
            new: list[int] = []
            owners: list[tuple[int, int]] = []

            def flush():
                if not owners:
                    return
                x = np.frombuffer(b"".join(cut), np.uint8).reshape(-1, WINDOW)
                logs = model.log_probabilities(x, tables) * np.array(new, "f4")[:, None]
                starts = [s for _, s in owners]
                total = np.add.reduceat(logs, starts, axis=0).astype(float) / np.add.reduceat(np.array(new, float), starts)[:, None]
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                known = len(model.langs) - (model.langs[-1] == UNKNOWN)
                best = p[:, :known].argmax(1)
                if known < len(model.langs):
                    none = np.flatnonzero(p[:, known] >= model.bound).tolist()
                    best[[k for k in none if len(texts[owners[k][0]].decode("utf-8", "replace")) >= REJECT_FROM]] = known
                for (i, _), k, row in zip(owners, best.tolist(), p):
                    langs[i], scores[i] = model.langs[k], float(row[k])
                cut.clear(), new.clear(), owners.clear()

            for i, data in enumerate(texts):
                if model and has_letter(data):
                    owners.append((i, len(cut)))
                    a, b = windows(data)
                    cut.extend(a)
                    new.extend(b)
                    if len(cut) > 4096:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return map_arrow(base, run, schema)


def held_out(i):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(i.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, use=lambda i: ~held_out(i))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents in a language; null and letterless texts go, and those of ``REJECT_FROM`` characters or more that the network takes for none.

    Texts of any length are judged whole, equal texts alike; all columns stay as they are. Without a labelled text no document is kept.
    """
    model = train(docs, reject=True)
    if model is None:
        return docs.where(F.lit(False))
    own, back = set_aside(docs, "lang_pred", "score")
    return back(predict(own, model).where(F.col("lang_pred") != UNKNOWN).select(*own.columns))
