"""Held-out items that leaked into documents.

The n-grams of all items' normalised words form a hash set that is sent to all tasks; every token
window of every document is looked up in it, and each hit is verified by the words around it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veldra.llm import dialogue

LEAST_WORDS = 12
#: Words of an n-gram that is looked up. A run of twelve words with two illegible ones still has one.
WINDOW = 4
#: Items of more bytes than this are scanned for in several passes.
ITEM_BYTES = 8 << 20
#: Characters of words that may have been misread into another item's word.
LEAST_NEAR = 5
_TOKENS_AT_ONCE = 200_000
_BITS = 22


class _Memory(dict):
    """Class numbers of tokens seen so far; forgets all when full."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[token] = self.of(token)
        return found


_INDEXES: dict[str, ItemIndex] = {}


def _index(key: str, shared) -> ItemIndex:
    """The index of a broadcast, built once in each worker process."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = ItemIndex(shared.value)
    return _INDEXES[key]


class ItemIndex:
    """Words of items as class numbers (from 1), their n-grams, and a bitmap before them."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        self.ids = [i for i, _ in items]
        words = [[s for t in dialogue.tokens(text) if (s := dialogue.skeletons(t))] for _, text in items]
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for forms in (f for w in words for f in w):
            for f in forms:
                parent[root(f)] = root(forms[0])
        number: dict[str, int] = {}
        self.known = {f: number.setdefault(root(f), len(number) + 1) for f in list(parent)}
        self.near = self._near_classes(len(number) + 1)
        self.forms = [f for w in words for f in w]
        self.flat = np.array([self.known[f[0]] for f in self.forms], np.int64)
        self.owner = np.repeat(np.arange(len(items)), [len(w) for w in words])
        at = self._starts(self.flat, self.owner)
        keys = self._keys(self.flat, at)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self._slot(self.keys)] = True
        self.memory = _Memory(self.class_of)

    def _near_classes(self, classes: int) -> np.ndarray:
        """Sorted codes of ordered pairs of classes with long forms that one misread character tells apart.

        Such forms are equal, or equal to each other's, when each loses at most one character.
        """
        self.classes = classes
        reduced: dict[str, list[str]] = {}
        for f in self.known:
            if len(f) >= LEAST_NEAR:
                for v in {f, *(f[:i] + f[i + 1 :] for i in range(len(f)))}:
                    reduced.setdefault(v, []).append(f)
        pairs = set()
        for forms in reduced.values():
            for i, x in enumerate(forms):
                for y in forms[:i]:
                    a, b = self.known[x], self.known[y]
                    if a != b and dialogue.close(x, y):
                        pairs |= {a * classes + b, b * classes + a}
        return np.array(sorted(pairs), np.int64)

    def _alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which words of other classes may be misread from each other."""
        if not len(self.near):
            return np.zeros(len(x), bool)
        code = x * self.classes + y
        return self.near[np.minimum(np.searchsorted(self.near, code), len(self.near) - 1)] == code

    def _starts(self, flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Where windows of known words of one owner begin."""
        m = len(flat) - self.window + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        ok = owner[:m] == owner[self.window - 1 :]
        for k in range(self.window):
            ok &= flat[k : k + m] > 0
        return np.flatnonzero(ok)

    def _keys(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.window):
                h = (h ^ flat[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
        return h

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, texts: list[str | None], least: int = LEAST_WORDS) -> set[tuple[int, int]]:
        """Pairs (number of the text, number of the item) with a run of at least ``least`` words in order."""
        kept: list[str] = []
        sizes = []
        for text in texts:
            own = dialogue.tokens(text)
            kept += own
            sizes.append(len(own))
        codes = np.fromiter(map(self.memory.__getitem__, kept), np.int64, len(kept))
        is_word = np.flatnonzero(codes >= 0)
        flat, doc = codes[is_word], np.repeat(np.arange(len(texts)), sizes)[is_word]
        at = self._starts(flat, doc)
        keys = self._keys(flat, at)
        may = self.bitmap[self._slot(keys)]
        at, keys = at[may], keys[may]
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        found: set[tuple[int, int]] = set()
        if not n.sum():
            return found
        p = np.repeat(at, n)
        q = self.at[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        maybe = self._run(flat, doc, p, q, least, True) >= least
        p, q = p[maybe], q[maybe]
        sure = self._run(flat, doc, p, q, least, False) >= least
        found |= set(zip(doc[p[sure]].tolist(), self.owner[q[sure]].tolist()))
        for a, b in zip(p[~sure].tolist(), q[~sure].tolist()):
            if (doc[a], self.owner[b]) not in found and self._verified(flat, doc, lambda i: kept[is_word[i]], a, b, least):
                found.add((int(doc[a]), int(self.owner[b])))
        return found

    def class_of(self, token: str) -> int:
        """A token's class number: -1 for no word, 0 for a word of no item."""
        forms = dialogue.skeletons(token)
        return next((self.known[f] for f in forms if f in self.known), 0) if forms else -1

    def _run(self, flat, doc, p, q, least: int, illegible: bool) -> np.ndarray:
        """Length, up to twice ``least``, of the run around each hit; if ``illegible``, words of no item match anything and others what they may be misread from."""
        length = np.full(len(p), self.window)
        for step, first in ((1, self.window), (-1, -1)):
            alive = np.arange(len(p))
            for k in range(first, first + step * least, step):
                a, b = p[alive] + k, q[alive] + k
                inside = (a >= 0) & (a < len(flat)) & (b >= 0) & (b < len(self.flat))
                alive, a, b = alive[inside], a[inside], b[inside]
                same = (flat[a] == self.flat[b]) | (illegible & ((flat[a] == 0) | self._alike(flat[a], self.flat[b])))
                same &= (doc[a] == doc[p[alive]]) & (self.owner[b] == self.owner[q[alive]])
                alive = alive[same]
                length[alive] += 1
        return length

    def _verified(self, flat, doc, token, p: int, q: int, least: int) -> bool:
        run, k = 0, -min(q - int(np.searchsorted(self.owner, self.owner[q])), p - int(np.searchsorted(doc, doc[p])))
        while p + k < len(flat) and q + k < len(self.flat) and doc[p + k] == doc[p] and self.owner[q + k] == self.owner[q]:
            same = flat[p + k] == self.flat[q + k]
            if not same and flat[p + k]:
                same = bool(self._alike(flat[p + k : p + k + 1], self.flat[q + k : q + k + 1])[0])
            elif not same:
                same = any(dialogue.close(x, y) for x in dialogue.skeletons(token(p + k)) for y in self.forms[q + k])
            run = run + 1 if same else 0
            if run >= least:
                return True
            k += 1
        return False


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_id``, ``item_id``: each item of which a document has at least ``least`` consecutive words.

    Cue borders, numbers, times, markup, bracketed sounds, letter case, accents, punctuation, wrong
    encodings and misread characters make no difference. Null and empty texts and items and items
    of fewer words match nothing. A pair comes out once, repeated rows or not; an empty table on
    either side gives no rows. Other columns don't matter.

    The items are the query set: at most ``item_bytes`` of them are sent to all tasks at once, and
    the documents are scanned once for each such block.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).alias("__item"), F.col(item_text).alias("__text")).where("__text is not null").distinct()
    total = wanted.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    kinds = {"doc": dict(docs.dtypes)[doc_id], "item": dict(items.dtypes)[item_id]}
    item_type = to_arrow_type(items.schema[item_id].dataType)
    blocks = max(1, -(-total // item_bytes))
    found = None
    for k in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("__item"), F.lit(blocks)) == k) if blocks > 1 else wanted
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows.sort("__item", "__text").collect()])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(key, shared)
            for b in batches:
                for part in _slices(b):
                    pairs = sorted(index.find(part.column(1).to_pylist(), least))
                    if pairs:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, _ in pairs])), pa.array([index.ids[j] for _, j in pairs], item_type)], names=["__doc", "__item"])

        hits = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__t")).where("__t is not null").mapInArrow(scan, f"__doc {kinds['doc']}, __item {kinds['item']}")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct().select(F.col("__doc").alias(doc_id), F.col("__item").alias(item_id))


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about as many bytes of text; a single text may have more."""
    sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = 0
    while begin < len(sizes):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), 8 * _TOKENS_AT_ONCE, side="right")))
        yield b.slice(begin, end - begin)
        begin = end


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that no item leaked into."""
    return docs.join(found.select(doc_id).distinct(), doc_id, "left_anti")
