"""BPE encoding and decoding with a pair occurrence index.

The tokenizer file is read, never trained. A partition is taken in blocks of
some millions of bytes, so that memory is bounded. The distinct words of a block
whose tokens are not at hand are laid out side by side as linked symbols. An
index maps each adjacent pair to all its positions in the block; the ranks that
occur are taken in ascending order, every position of a rank's pair is merged,
and only the lists of the pairs beside it are updated. Each merge makes a token
of its own, so pairs made by a merge always rank later and one ascending sweep
equals word-by-word BPE.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidecast.llm.common import map_arrow, table, without

#: Bytes of the words that a worker keeps with their tokens, as counted by ``_cost``; beyond it, it keeps those of the last block.
CACHE_BYTES = 24 << 20
WHITE = "\t-\r \x85\xa0  -     　"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _class(letter: str, top: int = sys.maxunicode) -> str:
    """The ranges of all code points up to ``top`` whose general category starts with ``letter``, as a character class."""
    out, start = [], None
    for i in range(top + 2):
        has = i <= top and unicodedata.category(chr(i))[0] == letter
        if has and start is None:
            start = i
        elif not has and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder for a lower-casing word-end BPE vocabulary file."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        chars = _byte_chars()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + end] for c in chars]
        #: pair of ids, packed -> rank; rank -> its pair and what it makes
        self.ranks: dict[int, int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.pairs.append((vocab[a], vocab[b], vocab[a + b]))
        # the rank of a byte followed by a byte, inside a word and at its end
        self.opening = np.array([[[self.ranks.get(x << 32 | y, -1) for y in row] for x in self.first] for row in (self.first, self.last)], np.int32)
        self.word = self._pattern(_class("L"), _class("N"))
        # most texts need no more than these, and a class without higher planes is one lookup
        self.word_bmp = self._pattern(_class("L", 0xFFFF), _class("N", 0xFFFF))
        self.word_ascii = self._pattern("A-Za-z", "0-9")
        self.higher = re.compile("[\U00010000-\U0010ffff]")
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.spelled = [b""] * (max(self.tokens) + 1)
        for i, t in self.tokens.items():
            self.spelled[i] = t.encode("utf-8", "surrogatepass")
        self.cache: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _pattern(letters: str, numbers: str) -> re.Pattern:
        return re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{WHITE}{letters}{numbers}]+")

    def _learn(self, words: Iterable[str]) -> None:
        """Tokens of words not met yet, by one sweep over their pair index."""
        words = [w for w in words if w not in self.cache]
        if not words:
            return
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(d) for d in data])
        flat = np.frombuffer(b"".join(data), np.uint8)
        size = len(flat)
        closing = np.zeros(size, np.int8)
        closing[ends - 1] = 1
        # symbols side by side, linked within each word
        first = np.where(closing, np.array(self.last)[flat], np.array(self.first)[flat])
        after = np.where(closing, -1, np.arange(1, size + 1))
        before = np.arange(-1, size - 1)
        before[0], before[ends[:-1]] = -1, -1
        rank = np.full(size, -1, np.int32)
        rank[:-1] = np.where(closing[:-1], -1, self.opening[closing[1:], flat[:-1], flat[1:]])
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        active, cuts = np.unique(rank[at], return_index=True)
        index: dict[int, list[int]] = {r: p.tolist() for r, p in zip(active.tolist(), np.split(at, cuts[1:]))} if len(at) else {}
        heap = list(index)  # ascending, so a heap already
        sym, nxt, prv = first.tolist(), after.tolist(), before.tolist()
        known, pairs, pop, push = self.ranks.get, self.pairs, heapq.heappop, heapq.heappush
        while heap:
            r = pop(heap)
            a, b, new = pairs[r]
            where = index.pop(r)
            if a == b:  # only then can occurrences overlap: the leftmost comes first
                where.sort()
            for i in where:
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                k = nxt[j]
                sym[i], sym[j], nxt[i] = new, -1, k
                if k >= 0:
                    prv[k] = i
                    if (q := known(new << 32 | sym[k])) is not None:
                        if q in index:
                            index[q].append(i)
                        else:
                            index[q] = [i]
                            push(heap, q)
                h = prv[i]
                if h >= 0 and (q := known(sym[h] << 32 | new)) is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        push(heap, q)
        left = np.array(sym)
        alive = left >= 0
        ids = left[alive]
        packed = ids.astype("<u4").tobytes()
        stops = (4 * np.cumsum(alive)[ends - 1]).tolist()
        cache, at = self.cache, 0
        for w, to in zip(words, stops):
            cache[w] = packed[at:to]
            at = to
        self.held += self._cost(words) + len(packed)

    @staticmethod
    def _cost(words) -> int:
        """Bytes that words take as keys, with a fixed part for the entry and for the tokens' object."""
        return 200 * len(words) + sum(map(len, words))

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.word_ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.word if self.higher.search(text) else self.word_bmp).findall(text)

    def _pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens stand as themselves, marked by a leading NUL."""
        if self.split is None or "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for part in self.split.split(text):
            if part in self.special:
                out.append("\0" + part)
            elif part:
                out.extend(self._words(part))
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text, its ids as little-endian 32-bit integers and its decoded text in UTF-8; the texts are one block."""
        pieces = [self._pieces(t) for t in texts]
        words = set().union(*pieces)
        if self.held > CACHE_BYTES:
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
            self.held = self._cost(self.cache) + sum(map(len, self.cache.values()))
        for t, i in self.special.items():
            self.cache["\0" + t] = i.to_bytes(4, "little")
        fresh = words.difference(self.cache)
        if fresh:
            self._learn(fresh)
        ids, spelled = self.cache.__getitem__, self.spelled.__getitem__
        joined = [b"".join(map(ids, p)) for p in pieces]
        return [(d, b" ".join(map(spelled, np.frombuffer(d, "<u4").tolist()))) for d in joined]

    def encode(self, text: str) -> list[int]:
        data = self.encode_batch([text])[0][0]
        return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, as the vocabulary file declares no decoder."""
        return " ".join([self.tokens[i] for i in ids])


_LOADED: dict[str, PairIndexBpe] = {}


def _codec(path: str) -> PairIndexBpe:
    if path not in _LOADED:
        _LOADED[path] = PairIndexBpe(path)
    return _LOADED[path]


#: Bytes of text whose words are indexed together.
BLOCK_BYTES = 2 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of a partition's batches of about ``BLOCK_BYTES``."""
    block: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        block.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def bpe(docs: DataFrame, text: str = "text", vocabulary: str | None = None, with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``token_ids`` and ``decoded``.

    A null text counts as empty: no tokens and the digests of nothing. All
    other columns pass through; input columns named like an output are
    replaced. Texts of any length are taken whole. Rows are independent of each other, so ties, repeated rows and
    empty tables need no rule of their own. ``vocabulary`` is the path of the
    tokenizer file on every machine.
    """
    path = vocabulary or default_vocabulary()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids + ["decoded"] * with_decoded
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "token_ids": "array<int>", "decoded": "string"}
    base = without(docs, *[n for n in names if n != text])
    from pyspark.sql.types import StructType

    schema = StructType([*base.schema.fields, *StructType.fromDDL(", ".join(f"{n} {kinds[n]}" for n in names)).fields])
    keep = [f.name for f in base.schema.fields]

    def coded(batch: pa.RecordBatch, pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        cols = [
            pa.array([len(data) // 4 for data, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(data).hexdigest() for data, _ in pairs], pa.string()),
            pa.array([hashlib.sha256(shown).hexdigest() for _, shown in pairs], pa.string()),
        ]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([len(data) // 4 for data, _ in pairs])]).astype(np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join([data for data, _ in pairs]))])
            cols.append(pa.ListArray.from_arrays(pa.array(offsets), flat))
        if with_decoded:
            cols.append(pa.array([shown for _, shown in pairs], pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays([*batch.columns, *cols], keep + names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        try:
            for block in _blocks(batches):
                pairs = codec.encode_batch([t or "" for batch in block for t in batch.column(keep.index(text)).to_pylist()])
                at = 0
                for batch in block:
                    yield coded(batch, pairs[at : at + batch.num_rows])
                    at += batch.num_rows
        finally:
            _LOADED.pop(path, None)  # the worker outlives the task

    return map_arrow(base, run, schema)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe(docs, with_ids=False, with_decoded=False).drop("text")
