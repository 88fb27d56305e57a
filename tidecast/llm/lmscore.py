"""Document scores by masked pseudo-likelihood.

A bidirectional window network predicts every token from the two tokens on each
side of it: embeddings of the neighbours, a tanh layer, a softmax over groups of
tokens and shapes, and a softmax over the words of the group. Every token at or
above a share of the corpus is a word of its own; other tokens belong to the
class of their shape and are spelled out by the corpus's byte-pair counts. As
neighbours they are told apart by a hash. Token and byte counts cover all documents. The network is
trained in numpy by rounds, each on a part of the documents and together on all.
A round's documents are dealt to shards by a hash of their text; each shard takes
steps from the same parameters on its texts in the order of their hashes, and the
results are averaged by the tokens seen. Texts are cut into tokens once and kept as
numbers, which counts, rounds and scores read. Shards and order follow from the texts
alone, so another partitioning gives the same scores. Equal texts are folded and
weigh as often as they occur.
A document's score is the sum of the conditional log-probabilities of all its
tokens.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidecast.llm.common import Scratch, as_bytes, column_bytes, map_arrow, materialize, table, without

#: Every token seen this often and of this share of all tokens is a word of the network, and so are the FREQUENT first ones. The share bounds the words at 100,000.
LEAST_COUNT, LEAST_SHARE = 5, 1e-5
FREQUENT = 112
SHAPES, HASHED = 14, 64
CLASSES = FREQUENT + SHAPES  # of the smallest network
RARE = SHAPES * HASHED  # numbers of tokens that are no words, by shape and hash; those of the words follow
EDGE = -1  # the place beside a text's ends
EMBED, HIDDEN = 16, 24
SIDES = (-2, -1, 1, 2)
#: Each round trains on its own part of the documents, by a hash of their text; together the rounds cover all.
ROUNDS = 2
#: Tokens of a shard, on the average. Shards of a round grow with the corpus; a task trains so many of them in turn and passes on their sum, and more where tasks would be over MOST_TASKS.
SHARD_TOKENS, SHARDS_A_TASK, MOST_TASKS = 1 << 19, 4, 20_000
#: Tasks of which the parameters are summed first, before the sums are.
SALTS = 64
#: Distinct tokens that a task counts before it passes them on.
HELD_TOKENS = 200_000
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]").findall
#: Parameters that a row holds when networks are averaged.
BLOCK = 8192


def tokens(data: bytes) -> list[bytes]:
    """Words (ASCII letters in lower case, digits, all bytes beyond ASCII) and single other signs."""
    return _TOKEN(data.lower())


def shape(token: bytes) -> int:
    """The class of a token that is not frequent: sign, number, or a word by length and alphabet."""
    if token.isalpha():
        return 2 + min(5, len(token) // 3)
    if token.isdigit():
        return 0
    if len(token) == 1 and not token.isalnum() and token[0] < 128:
        return 1
    return 8 + min(5, len(token) // 4)


def sizes(words: int) -> list[tuple[int, ...]]:
    """Shapes of the parameters: embeddings (the last is the edge's), hidden layer, softmax over shapes and groups, softmax of every group."""
    size = max(1, int(np.ceil(np.sqrt(words))))
    groups = -(-words // size)
    return [(RARE + words + 1, EMBED), (len(SIDES) * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, SHAPES + groups), (SHAPES + groups,), (groups, HIDDEN, size), (groups, size)]


def _length(words: int) -> int:
    return sum(int(np.prod(s)) for s in sizes(words))


@lru_cache(16)
def _words(length: int) -> int:
    """How many words a network of so many parameters has."""
    lo, hi = 0, length
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if _length(mid) < length else (lo, mid)
    return lo


def _unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in sizes(_words(len(flat))):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def initial(counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Random parameters for ``counts`` of the shapes and then the words; the output biases start at the logs of the frequencies."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.3, s) if len(s) > 1 else np.zeros(s) for s in sizes(len(counts) - SHAPES)]
    parts[1] /= np.sqrt(len(SIDES))
    slots = np.zeros(parts[6].shape)
    slots.ravel()[: len(counts) - SHAPES] = counts[SHAPES:]
    head = np.concatenate([counts[:SHAPES], slots.sum(1)])
    parts[4] = np.log((head + 0.5) / (head.sum() + 0.5 * len(head)))
    parts[6] = np.log((slots + 0.5) / (slots + 0.5).sum(1, keepdims=True))
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def _aims(target: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order of the tokens that puts words last, by groups; in it the classes of all in the first softmax, the places of words in their groups, and where each group begins and ends."""
    group = np.maximum(target - (RARE - size), 0) // size - 1
    order = np.argsort(group.astype(np.int16 if size < 30000 else np.int32), kind="stable")
    own = group.take(order)
    sorted_target = target.take(order)
    first = int(np.searchsorted(own, 0))
    head = own + SHAPES
    head[:first] = sorted_target[:first] // HASHED
    cuts = (first + np.flatnonzero(np.diff(own[first:], prepend=-2))).tolist()
    runs = [(int(own[a]), a - first, b - first) for a, b in zip(cuts, [*cuts[1:], len(order)])]
    return order, head, (sorted_target[first:] - RARE) % size, runs


def _shifted(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Biases less a bound of the logits, where one shift serves all rows, and where it does.

    The hidden layer lies in -1..1, which bounds the logits; where their range is narrow, no row needs its own maximum.
    """
    reach = np.abs(w).sum(-2)
    shift = (b + reach).max(-1, keepdims=True)
    narrow = shift - (b - reach).max(-1, keepdims=True) < 60
    return np.where(narrow, b - shift, b), narrow[..., 0]


def neighbours(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(n, sides) classes beside every token; texts lie end to end and don't see each other."""
    n = len(classes)
    place = np.arange(n) - np.repeat(starts, lengths)
    size = np.repeat(lengths, lengths)
    out = np.full((n, len(SIDES)), EDGE, np.int32)
    for i, d in enumerate(SIDES):
        ok = (place + d >= 0) & (place + d < size)
        at = np.flatnonzero(ok)
        out[at, i] = classes[at + d]
    return out


def fit_steps(flat: np.ndarray, near: np.ndarray, target: np.ndarray, batch: int = 8192, rate: float = 0.02, seed: int = 5, chunk: int = 1024, weight: np.ndarray | None = None) -> np.ndarray:
    """One pass of Adam over the given tokens, from ``flat``; gradients are summed over chunks that fit the processor's cache.

    A step follows the mean loss of its tokens, weighed by ``weight`` where it is given.
    """
    flat = flat.copy()
    if not len(target):
        return flat
    weight = np.ones(len(target), np.float32) if weight is None else weight.astype(np.float32)
    p = _unpack(flat)
    m, v, g = (np.zeros_like(flat) for _ in range(3))
    q = _unpack(g)
    names = len(p[0])
    small = np.int16 if names < 1 << 15 else np.int32
    near = (near % names).astype(small)
    order = np.random.default_rng(seed).permutation(len(target))
    for t, rows in enumerate(np.array_split(order, max(1, round(len(order) / batch))), 1):
        by, head, place, runs = _aims(target.take(rows), p[6].shape[1])
        rows = rows.take(by)
        n = len(rows)
        share = weight.take(rows)
        share /= share.sum()
        x = near.take(rows, axis=0).ravel()
        e = p[0].take(x, axis=0).reshape(n, -1)
        h = np.ones((n, HIDDEN + 1), np.float32)
        h[:, :-1] = np.tanh(e @ p[1] + p[2])
        dh = np.zeros((n, HIDDEN), np.float32)
        _softmax_errors(h, p[3][None], p[4][None], head, share, [(0, 0, n)], dh, q[3][None], q[4][None], chunk)
        of = slice(n - len(place), n)
        _softmax_errors(h[of], p[5], p[6], place, share[of], runs, dh[of], q[5], q[6], chunk)
        dh *= 1 - np.square(h[:, :-1])
        np.matmul(e.T, dh, out=q[1])
        np.matmul(np.ones(n, np.float32), dh, out=q[2])
        # like neighbours side by side, so that their gradients are sums of runs, two numbers at a time
        de = (dh @ p[1].T).view(np.complex64).reshape(len(x), -1)
        by = np.argsort(x, kind="stable")
        named = x.take(by)
        starts = np.flatnonzero(np.diff(named, prepend=-1))
        q[0][:] = 0
        q[0][named.take(starts)] = np.add.reduceat(de.take(by, axis=0), starts, axis=0).view(np.float32)
        _adam(flat, m, v, g, t, rate)
    return flat


def _softmax_errors(h: np.ndarray, w: np.ndarray, b: np.ndarray, y: np.ndarray, share: np.ndarray, runs: list[tuple[int, int, int]], dh: np.ndarray, dw: np.ndarray, db: np.ndarray, chunk: int) -> None:
    """Add the gradients of the loss to ``dh`` and put them in ``dw`` and ``db``, of a softmax by group; ``runs`` are the groups with their first rows and ends.

    The last column of ``h`` is one, so that the biases are a row of the weights.
    """
    bias, narrow = _shifted(w, b)
    w1 = np.concatenate([w, bias[:, None]], axis=1)
    d1 = np.zeros((len(w), w.shape[2], h.shape[1]), np.float32)
    logits, back = np.empty((chunk, w.shape[2]), np.float32), np.empty((chunk, w.shape[1]), np.float32)
    for a, end, block in _blocks(runs, chunk):
        z, own = logits[: end - a], back[: end - a]
        for k, i, j in block:
            np.matmul(h[i:j], w1[k], out=z[i - a : j - a])
        _error(z, y[a:end], share[a:end], narrow.all())
        for k, i, j in block:
            part = z[i - a : j - a]
            np.matmul(part, w[k].T, out=own[i - a : j - a])
            d1[k] += part.T @ h[i:j]
        dh[a:end] += own
    dw[:], db[:] = d1[:, :, :-1].swapaxes(1, 2), d1[:, :, -1]


def _blocks(runs: list[tuple[int, int, int]], rows: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """The runs dealt into blocks of up to so many rows, longer ones cut; each block with its first row and its end."""
    block: list[tuple[int, int, int]] = []
    for k, a, b in runs:
        while a < b:
            first = block[0][1] if block else a
            block.append((k, a, min(b, first + rows)))
            a = block[-1][2]
            if a == first + rows:
                yield first, a, block
                block = []
    if block:
        yield block[0][1], block[-1][2], block


def _adam(flat: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, t: int, rate: float, piece: int = 1 << 17) -> None:
    """Step ``t``, by pieces that the processor's cache can hold."""
    # the means lack their factors of 0.1 and 0.001, which the last steps make good
    root = np.sqrt((1 - 0.999**t) / 0.001)
    spare = np.empty(min(piece, len(flat)), np.float32)
    for at in range(0, len(flat), piece):
        own_m, own_v, own_g = m[at : at + piece], v[at : at + piece], g[at : at + piece]
        s = spare[: len(own_g)]
        own_m *= 0.9
        own_m += own_g
        own_v *= 0.999
        own_v += np.square(own_g, out=s)
        np.sqrt(own_v, out=s)
        s += 1e-8 * root
        np.divide(own_m, s, out=s)
        s *= rate * 0.1 * root / (1 - 0.9**t)
        flat[at : at + piece] -= s


def _error(z: np.ndarray, y: np.ndarray, share: np.ndarray, narrow: bool) -> None:
    """Put the logits' gradient of the loss, of which every token has its ``share``, in their place. ``narrow`` logits are shifted already."""
    if not narrow:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= (share / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    z[np.arange(len(y)), y] -= share


def _softmax_logs(h: np.ndarray, w: np.ndarray, b: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    bias, narrow = _shifted(w, b)
    out = np.empty(len(y), np.float32)
    ones = np.ones(len(b), np.float32)
    for at in range(0, len(y), step):
        z = h[at : at + step] @ w
        z += bias
        own = z[np.arange(len(z)), y[at : at + step]]
        if not narrow:
            top = z.max(1)
            z -= top[:, None]
            own -= top
        out[at : at + step] = own - np.log(np.exp(z, out=z) @ ones)
    return out


def class_log_probabilities(flat: np.ndarray, near: np.ndarray, target: np.ndarray, step: int = 2048) -> np.ndarray:
    """Of every token that is a word, and of every other token's shape."""
    p = _unpack(flat)
    order, head, place, runs = _aims(target, p[6].shape[1])
    near = near.take(order, axis=0) % len(p[0])
    h = np.empty((len(target), HIDDEN), np.float32)
    for at in range(0, len(target), step):
        own = p[0].take(near[at : at + step].ravel(), axis=0).reshape(-1, len(SIDES) * EMBED) @ p[1]
        own += p[2]
        np.tanh(own, out=h[at : at + step])
    logs = _softmax_logs(h, p[3], p[4], head, step)
    others = len(target) - len(place)
    h, of_word = h[others:], logs[others:]
    for k, a, b in runs:
        of_word[a:b] += _softmax_logs(h[a:b], p[5][k], p[6][k], place[a:b], step)
    out = np.empty_like(logs)
    out[order] = logs
    return out


@dataclass
class WindowModel:
    frequent: dict[bytes, int]
    spelling: np.ndarray  # log-probability of the next byte, (256, 256)
    flat: np.ndarray

    def kinds(self, types: list[bytes], shaped: np.ndarray) -> np.ndarray:
        """Classes of different tokens, of which ``shaped`` has the shapes and hashes."""
        found = np.array([self.frequent.get(t, -1) for t in types], np.int32)
        return np.where(found < 0, shaped, RARE + found)

    def spelled(self, types: list[bytes], kinds: np.ndarray) -> np.ndarray:
        """Spelling log-probabilities of different tokens, 0 of words."""
        costs = np.zeros(len(types))
        at = np.flatnonzero(kinds < RARE)
        if len(at):
            # all spelled at once: each byte after the one before it, a space around every token
            fresh = [types[i] for i in at.tolist()]
            b = np.frombuffer(b" " + b" ".join(fresh) + b" ", np.uint8).astype(np.int32)
            steps = self.spelling.ravel()[b[:-1] * 256 + b[1:]]
            size = np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1
            costs[at] = np.add.reduceat(steps, np.cumsum(size) - size)
        return costs

    def laid_out(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes and spelling log-probabilities of all tokens, with the texts' starts and lengths."""
        types, at, lengths = _code(texts)
        kinds = self.kinds(types, _shaped(types))
        return kinds.take(at), self.spelled(types, kinds).take(at), np.cumsum(lengths) - lengths, lengths

    def sums(self, classes: np.ndarray, spelled: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Summed log-probability of each text."""
        if not len(classes):
            return np.zeros(len(lengths))
        logs = class_log_probabilities(self.flat, neighbours(classes, starts, lengths), classes) + spelled
        total = np.concatenate([[0], np.cumsum(logs, dtype=float)])
        return total[starts + lengths] - total[starts]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens and summed log-probability of each text."""
        laid = self.laid_out(texts)
        return laid[-1], self.sums(*laid)


def _code(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different tokens of the texts, the number of every token among them, and the texts' lengths in tokens."""
    lists = [tokens(t) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    at = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int32, int(lengths.sum()))
    return list(number), at, lengths


def _shaped(types: list[bytes]) -> np.ndarray:
    """Class of every token as if it were no word: shape and hash."""
    shapes = np.fromiter(map(shape, types), np.int16, len(types))
    return shapes * HASHED + (np.fromiter(map(zlib.crc32, types), np.uint32, len(types)) % HASHED).astype(np.int16)


def _unsigned(n: int) -> type:
    """The smallest type for numbers below ``n``."""
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    group: list[bytes] = []
    n = 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def coded(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """About a megabyte of whole texts a row, as numbers into the row's own list of different tokens.

    Texts are cut into tokens once, here; counts, training and scores read the
    numbers. With them go the length of each text, two hashes of it and the
    columns ``keep``.
    """
    rows = docs.select(as_bytes(text).alias("b"), F.xxhash64(as_bytes(text)).alias("h"), F.xxhash64(as_bytes(text), F.lit(1)).alias("g"), *keep)
    fields = [StructField(f"keep_{f.name}", ArrayType(f.dataType)) for f in rows.schema.fields[3:]]
    schema = StructType([*StructType.fromDDL("types binary, shaped binary, places binary, lengths array<long>, h array<long>, g array<long>").fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in _chunks(batch.column(0).to_pylist()):
                types, at, lengths = _code(texts)
                own = batch.slice(first, len(texts))
                first += len(texts)
                blobs = [b" ".join(types), _shaped(types).tobytes(), at.astype(_unsigned(len(types))).tobytes()]
                lists = [pa.array(lengths), *own.columns[1:]]
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in blobs], *[pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), x) for x in lists]], schema.names)

    return map_arrow(rows, run, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Different tokens, their shapes, the tokens' numbers and the texts' lengths, of every row that ``coded`` made, and its further columns; of texts only the first four."""
    for batch in batches:
        if batch.num_columns == 1:
            for texts in _chunks(batch.column(0).to_pylist()):
                types, at, lengths = _code(texts)
                yield types, _shaped(types), at, lengths
            continue
        for row in zip(*batch.columns):
            joined, shaped, places = (x.as_py() for x in row[:3])
            types = joined.split(b" ") if joined else []
            yield types, np.frombuffer(shaped, np.int16), np.frombuffer(places, _unsigned(len(types))), row[3].values.to_numpy(), *[x.values for x in row[4:]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: defaultdict = defaultdict(int)
    pairs = np.zeros(65536, np.int64)

    def summed() -> pa.RecordBatch:
        at = np.flatnonzero(pairs)
        keys = [*counts, *[int(i).to_bytes(2, "big") for i in at]]
        kinds = [0] * len(counts) + [1] * len(at)
        out = pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()), pa.array([*counts.values(), *pairs[at].tolist()], pa.int64())], ["kind", "key", "n"])
        counts.clear()
        pairs[:] = 0
        return out

    for types, _, at, *_ in _read(batches):
        if types:
            n = np.bincount(at, minlength=len(types))
            for t, c in zip(types, n.tolist()):
                counts[t] += c
            # no token reaches over the end of a text; a token's bytes, and the space behind it, follow one byte each, as often as the token occurs
            b = np.frombuffer(b" " + b" ".join(types) + b" ", np.uint8).astype(np.int32)
            often = np.repeat(n, np.fromiter(map(len, types), np.int64, len(types)) + 1)
            np.add(pairs, np.bincount(b[:-1] * 256 + b[1:], often, 65536).astype(np.int64), out=pairs)
        if len(counts) > HELD_TOKENS:
            yield summed()
    yield summed()


def train(docs: DataFrame, text: str = "text") -> WindowModel:
    """Count the corpus and fit the network. Works on empty tables: all tokens are then equally likely."""
    return fit(materialize(coded(docs, text)))


def fit(rows: DataFrame, scratch: Scratch | None = None) -> WindowModel:
    """``train`` on texts that are ``coded``."""
    keep = scratch.keep if scratch else materialize
    counts = keep(map_arrow(rows.select("types", "shaped", "places", "lengths"), _count, "kind int, key binary, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    kept = counts.where("kind = 0")
    total = kept.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, LEAST_SHARE * total)
    top = kept.where(F.col("n") >= least).orderBy(F.desc("n"), "key").collect()  # 1 / LEAST_SHARE rows at most
    if len(top) < FREQUENT:
        top = kept.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    frequent = {bytes(r["key"]): i for i, r in enumerate(top)}
    spelling = np.full((256, 256), 0.01)
    for r in counts.where("kind = 1").collect():  # 65,536 rows at most
        spelling[r["key"][0], r["key"][1]] += r["n"]
    spelling = np.log(spelling / spelling.sum(1, keepdims=True))
    freq = np.zeros(SHAPES + max(FREQUENT, len(top)))
    freq[SHAPES : SHAPES + len(top)] = [r["n"] for r in top]
    freq[:SHAPES] = (total - freq.sum()) / SHAPES
    model = WindowModel(frequent, spelling, initial(freq))
    shards = -(-total // (ROUNDS * SHARD_TOKENS))
    for k in range(ROUNDS):
        model = WindowModel(frequent, spelling, _round(rows, model, k, max(1, shards)))
    return model


def _shard_groups(batches: Iterator[pa.RecordBatch], kind: type, size: int = 1 << 18) -> Iterator[tuple[int, list[np.ndarray], list[int]]]:
    """Shard, classes of texts and copies of about ``size`` tokens at a time; the cuts depend on the sorted rows alone, not on the batches."""
    shard, texts, copies, held = -1, [], [], 0
    for batch in batches:
        for own, data, n in zip(*[c.to_pylist() for c in batch.columns]):
            if texts and (own != shard or held >= size):
                yield shard, texts, copies
                texts, copies, held = [], [], 0
            texts.append(np.frombuffer(data, kind))
            shard, held = own, held + len(texts[-1])
            copies.append(n)
    if texts:
        yield shard, texts, copies


def _add_up(batches: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
    """Sum the rows of each block as they come, so that a task holds the parameters once; ``last`` divides by the tokens."""
    sums: dict[int, list] = {}
    for batch in batches:
        for i, s, x, w in zip(*[c.to_pylist() for c in batch.columns]):
            got = sums.setdefault(i, [s, 0.0, 0])
            got[1], got[2] = got[1] + np.frombuffer(x), got[2] + w
    for i, (s, x, w) in sums.items():
        yield pa.RecordBatch.from_pydict({"i": [i], "s": [s], "x": [(x / w if last else x).tobytes()], "w": [w]}, pa.schema([("i", pa.int32()), ("s", pa.int32()), ("x", pa.binary()), ("w", pa.int64())]))


def _round(rows: DataFrame, model: WindowModel, k: int, shards: int = 1) -> np.ndarray:
    """Every shard trains from the same parameters on its own texts; the mean, weighed by tokens, comes back. ``rows`` are texts ``b``, or are coded."""
    rows = rows if "types" in rows.columns else coded(rows, "b")
    rounds = ROUNDS
    kind = np.uint16 if RARE + len(model.frequent) <= 1 << 16 else np.uint32

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for types, shaped, at, lengths, h, g in _read(batches):
            own = model.kinds(types, shaped).astype(kind).take(at)
            ends = np.cumsum(lengths)
            h = h.to_numpy()
            part = np.flatnonzero((lengths > 0) & (h % rounds == k))
            texts = [own[a:b].tobytes() for a, b in zip((ends - lengths)[part].tolist(), ends[part].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h[part]), pa.array((g.to_numpy()[part] % shards).astype(np.int32)), pa.array(texts, pa.binary())], ["h", "shard", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(model.flat)), 0
        at, flat, own = -1, model.flat, 0
        for shard, texts, copies in _shard_groups(batches, kind):
            if shard != at:
                total += flat.astype(float) * own
                at, flat, own = shard, model.flat, 0
            lengths = np.array([len(t) for t in texts])
            classes = np.concatenate(texts).astype(np.int32)
            flat = fit_steps(flat, neighbours(classes, np.cumsum(lengths) - lengths, lengths), classes, weight=np.repeat(np.array(copies), lengths))
            n = int((lengths * copies).sum())
            own, seen = own + n, seen + n
        total += flat.astype(float) * own
        if seen:
            salt = TaskContext.get().partitionId() % SALTS
            blocks = [total[at : at + BLOCK].tobytes() for at in range(0, len(total), BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array(blocks, pa.binary()), pa.array([seen] * n, pa.int64())], ["i", "s", "x", "w"])

    # copies of a text meet as counts, added up before the shuffle, so no shard holds the copies of a frequent one
    share = map_arrow(rows.select("types", "shaped", "places", "lengths", "h", "g"), deal, "h long, shard int, c binary").groupBy("h", "shard", "c").agg(F.count("*").alias("n"))
    tasks = min(-(-shards // SHARDS_A_TASK), MOST_TASKS)
    dealt = share.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard", "h", "c").select("shard", "c", "n")
    ddl = "i int, s int, x binary, w long"
    sums = map_arrow(map_arrow(dealt, run, ddl).repartition("i", "s"), _add_up, ddl)
    means = map_arrow(sums.repartition("i"), partial(_add_up, last=True), ddl)
    flat = model.flat.copy()
    for r in means.collect():  # the parameters in blocks
        flat[r["i"] * BLOCK :][:BLOCK] = np.frombuffer(r["x"])
    return flat


def score(docs: DataFrame, model: WindowModel, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``log_likelihood`` and ``perplexity`` (a token) for every whole text.

    Texts of any length are scored whole. A text that is null or has no tokens
    scores 0 and has no perplexity. Equal
    texts score alike to within rounding. Input columns named like an output
    are replaced, all others pass through.
    """
    new = ["n_tokens", "log_likelihood", "perplexity"]
    base = without(docs, *new)
    names = [f.name for f in base.schema.fields]
    schema = StructType([*base.schema.fields, *StructType.fromDDL("n_tokens long, log_likelihood double, perplexity double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = [], []
            for group in _chunks(column_bytes(batch.column(names.index(text)))):
                a, b = model.score(group)
                n.append(a)
                total.append(b)
            n = np.concatenate(n or [np.empty(0, np.int64)]).astype(np.int64)
            total = np.concatenate(total or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(total), _perplexity(n, total)], [*names, *new])

    return map_arrow(base, run, schema)


def score_coded(rows: DataFrame, model: WindowModel) -> DataFrame:
    """``score`` of texts that are ``coded``: a row a text, with the columns that were kept."""
    kept = [c for c in rows.columns if c.startswith("keep_")]
    fields = [StructField(c.removeprefix("keep_"), rows.schema[c].dataType.elementType) for c in kept]
    schema = StructType([*fields, *StructType.fromDDL("n_tokens long, log_likelihood double, perplexity double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for types, shaped, at, n, *columns in _read(batches):
            kinds = model.kinds(types, shaped)
            total = model.sums(kinds.take(at), model.spelled(types, kinds).take(at), np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(total), _perplexity(n, total)], schema.names)

    return map_arrow(rows.select("types", "shaped", "places", "lengths", *kept), run, schema)


def _perplexity(n: np.ndarray, total: np.ndarray) -> pa.Array:
    return pa.array(np.exp(np.minimum(-total / np.maximum(n, 1), 700)), mask=n == 0)


def op10_lmscore(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    rows = scratch.keep(coded(table(spark, sf_dir, "documents"), "text", "doc_id"))
    return scratch.result(score_coded(rows, fit(rows, scratch)))
