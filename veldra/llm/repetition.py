"""Repetition inside single documents: rule statistics, scored by an isolation forest.

The statistics of every document are computed from its whole text, and every document is labelled by
its exact share. A forest is grown on all ordinary documents, level by level; its threshold is
calibrated on all rows so that every row beyond the wanted share is anomalous, and an exact check of
the share follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.forest import Forest, average_path
from veldra.plans.scratch import Scratch

#: Lines of times and of numbers, and markup. The byte order mark may stand before the first number.
_NOT_WORDS = r"(?m)^[^\n]*?-->[^\n]*$|^[\s\x{FEFF}]*\d+[ \t\r]*$|<[^<>]*>|\{[^{}]*\}"
FEATURES = ("repeated_share", "repeated_share_9", "repeated_share_3", "repeated_words", "longest_share")
#: Trees of the forest and the levels below their roots.
TREES, DEPTH = 100, 8
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WORDS_AT_ONCE = 1 << 20


def word_hashes(text: Column) -> Column:
    """Hashes of the words (runs of letters and digits, ignoring case) of all cue lines in order."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), _NOT_WORDS, " "))
    return F.transform(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _covered(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per word: does it lie in a run of n words that began before in the same document?"""
    cover = np.zeros(len(words) + 1, np.int64)
    m = len(words) - n + 1
    if m > 0:
        h = np.zeros(m, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ words[k : k + m]) * _PRIME
                h ^= h >> np.uint64(29)
            h = (h ^ doc[:m].astype(np.uint64)) * _PRIME
        at = np.flatnonzero(doc[:m] == doc[n - 1 :])
        order = at[np.argsort(h[at], kind="stable")]
        again = order[1:][h[order[1:]] == h[order[:-1]]]
        np.add.at(cover, again, 1)
        np.add.at(cover, again + n, -1)
    return np.cumsum(cover[:-1]) > 0


def _statistics(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document of a flat array of word hashes."""
    out = np.zeros((len(sizes), len(FEATURES)))
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some].astype(float)
    start = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
    doc = np.repeat(np.arange(len(some)), sizes[some])
    six = _covered(words, doc, 6)
    share = lambda c: np.add.reduceat(c.astype(np.int64), start) / n
    out[some, 0], out[some, 1], out[some, 2] = share(six), share(_covered(words, doc, 9)), share(_covered(words, doc, 3))
    out[some, 3] = share(_covered(words, doc, 1))
    # the longest stretch of covered words: distance to the last uncovered word or document start
    position = np.arange(len(words))
    last = np.maximum.accumulate(np.where(six, -1, position))
    out[some, 4] = np.maximum.reduceat(np.where(six, position - np.maximum(last, np.repeat(start, sizes[some]) - 1), 0), start) / n
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        begin = 0
        while begin < len(sizes):  # whole documents, about as many words at a time
            end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), _WORDS_AT_ONCE, side="right")))
            part = lists.slice(begin, end - begin)
            words = part.flatten().to_numpy().view(np.uint64)
            stats = _statistics(words, sizes[begin:end])
            ids = b.column(0).slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes[begin:end].astype(np.int64)), *(pa.array(c) for c in stats.T)], names=["__id", "n_words", *FEATURES])
            begin = end


def repetition_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words`` and the statistics FEATURES of each row, from the whole text.

    ``repeated_share`` is the share of words in a run of six or more words that occurred before in
    the document; the next two have runs of nine and three, ``repeated_words`` single words, and
    ``longest_share`` the longest repeated stretch. A null, empty or wordless text has 0 words and
    shares of 0. Rows come out as often as they are stored; other columns don't matter.
    """
    words = docs.select(F.col(doc_id).alias("__id"), F.coalesce(word_hashes(F.col(text)), F.array().cast("array<bigint>")).alias("__w"))
    kind = dict(docs.dtypes)[doc_id]
    shape = f"__id {kind}, n_words bigint, " + ", ".join(f"{c} double" for c in FEATURES)
    return words.mapInArrow(_measure, shape).withColumnRenamed("__id", doc_id)


def _values(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(c).to_numpy() for c in FEATURES])


def ordinary_forest(ordinary: DataFrame, seed: int, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """An isolation forest of all rows of ``ordinary``.

    Each pass over the rows gives the ranges of the nodes of one level of all trees, whose splits are
    drawn within them. What a pass brings to the driver is bounded by ``trees`` and ``depth``.
    """
    sides = [f"{n}{i}" for n in ("lo", "hi") for i in range(len(FEATURES))]
    forest, rng, level = Forest.bare(trees, depth), np.random.default_rng(seed), 0
    while True:
        shared = ordinary.sparkSession.sparkContext.broadcast(forest)

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = trees * 2**level
            n, low, high = np.zeros(size, np.int64), np.full((size, len(FEATURES)), np.inf), np.full((size, len(FEATURES)), -np.inf)
            for b in batches:
                place, count, least, most = shared.value.ranges(_values(b), level)
                n[place] += count
                low[place], high[place] = np.minimum(low[place], least), np.maximum(high[place], most)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), *(pa.array(c) for c in (*low[at].T, *high[at].T))], names=["place", "n", *sides])

        shape = "place bigint, n bigint, " + ", ".join(f"{c} double" for c in sides)
        merged = ordinary.select(*FEATURES).mapInArrow(ranges, shape).groupBy("place")
        t = merged.agg(F.sum("n").alias("n"), *[(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in sides]).toArrow()
        shared.destroy()
        place, n = t["place"].to_numpy(), t["n"].to_numpy()
        low, high = (np.column_stack([t[c].to_numpy() for c in part]) for part in (sides[: len(FEATURES)], sides[len(FEATURES) :]))
        if not level:
            forest.norm = float(max(average_path(n.max(initial=1)), 1e-9))
        if not forest.grow(level, place, n, low, high, rng):
            return forest
        level += 1


def repetition_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_share: float = 0.30, seed: int = 1729) -> DataFrame:
    """Each row's statistics with ``score`` (of the isolation forest) and ``anomalous``.

    All documents with words are labelled by ``least_share``. The forest grows on all ordinary ones.
    Calibration takes all repetitive rows and all ordinary rows lifted to ``least_share``; the
    threshold is the lowest score among them. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repetition")
    stats = scratch.put(repetition_statistics(docs, doc_id, text), "statistics")
    forest = ordinary_forest(stats.where((F.col("n_words") > 0) & (F.col("repeated_share") < least_share)), seed)
    shared = spark.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _values(b)
            s = shared.value.score(x)
            low = x[:, 0] < least_share
            bar = s.copy()
            bar[low] = shared.value.score(np.maximum(x[low], [least_share, 0, least_share, least_share, 0]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(bar)], names=[*b.schema.names, "score", "bar"])

    shape = ", ".join(f"`{n}` {t}" for n, t in stats.dtypes) + ", score double, bar double"
    scored = scratch.put(stats.mapInArrow(score, shape), "scored")
    threshold = scored.where("n_words > 0").agg(F.min("bar")).first()[0]
    scratch.drop("statistics")
    return scored.withColumn("anomalous", F.col("score") >= (0.0 if threshold is None else threshold - 1e-9)).drop("bar")


def repetitive_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_share: float = 0.30, **options) -> DataFrame:
    """``doc_id`` of anomalous documents whose exact share of repeated words is at least ``least_share``."""
    scored = repetition_scores(docs, doc_id, text, least_share, **options)
    return scored.where(F.col("anomalous") & (F.col("repeated_share") >= least_share)).select(doc_id)
