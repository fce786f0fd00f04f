"""Token ids of a whole corpus through a table of its distinct words.

Byte-level BPE never merges across the words its pattern splits a text into. So texts are split in
Spark, each distinct word is encoded once, and the ids are joined back by position.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.plans.scratch import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the tokenizer's public split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word table of more bytes isn't sent to all tasks; blocks of documents are then joined with their own words.
TABLE_BYTES = 48 << 20
BLOCK_BYTES = 64 << 20
_WORDS_AT_ONCE = 1 << 19


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def words_of(text: Column) -> Column:
    """The words of a text by the tokenizer's pattern; together they are the text."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def newer_than_jvm(text: Column) -> Column:
    """Texts with characters that the JVM's Unicode tables don't know, whose classes it can't tell."""
    return text.rlike(r"\p{Cn}")


def word_table(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``word``, ``ids``: each distinct word of the texts with its token ids, encoded once."""
    known = docs.select(F.col(text).alias("__t")).where(~newer_than_jvm(F.col("__t")))
    words = known.select(F.explode(F.array_distinct(words_of(F.col("__t")))).alias("word")).distinct()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for b in batches:
            ids = [e.ids for e in tokenizer.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(encode, "word string, ids array<int>")


class _Table:
    """Word to ids, as Arrow words and flat ids."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        self.words = words
        self.sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        self.flat = ids.flatten().to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if len(words) else np.zeros(0, np.int64)

    def place(self, lists: pa.Array) -> pa.Array:
        """Lists of words to lists of ids, by position."""
        if not len(self.words):
            return pa.array([[]] * len(lists), pa.list_(pa.int32()))
        code = pc.index_in(lists.flatten(), value_set=self.words)
        if code.null_count:
            raise ValueError("a word is missing in the word table")
        code = code.to_numpy()
        size = self.sizes[code]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[code] - (ends - size), size)
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(self.flat[take], pa.int32()))


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about as many words; a single text may have more."""
    sizes = np.diff(b.column(column).offsets.to_numpy())
    begin = 0
    while begin < len(sizes):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), _WORDS_AT_ONCE, side="right")))
        yield b.slice(begin, end - begin)
        begin = end


def _emit(part: pa.RecordBatch, table: _Table, tokenizer) -> pa.RecordBatch:
    ids, whole = table.place(part.column("w")), part.column("whole")
    if whole.null_count < len(whole):
        texts = whole.to_pylist()
        ids = pa.array([i if t is None else tokenizer.encode(t, add_special_tokens=False).ids for i, t in zip(ids.to_pylist(), texts)], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([part.column("__id"), ids], names=["__id", "ids"])


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each row, without special tokens.

    Empty and null texts have an empty list. The strings of special tokens in a text are ordinary
    text. Rows come out as often as they are stored; other columns don't matter. Texts with
    characters newer than the JVM's Unicode tables are encoded whole, since the JVM can't split them.

    A word table of at most ``table_bytes`` is sent to all tasks. A larger one is joined, by word, to
    the distinct words of each block of documents, and each block meets its own part of the table:
    only distinct words of blocks and the texts, once, are shuffled. The results are equal.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    kind = dict(docs.dtypes)[doc_id]
    words = scratch.put(word_table(docs, text, vocabulary), "words")
    n, size = words.agg(F.count("*"), F.sum(F.octet_length("word") + 4 * F.size("ids") + 12)).first()
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    rows = rows.select("__id", "__t", newer_than_jvm(F.col("__t")).alias("__new"))
    split = [F.when(F.col("__new"), F.array().cast("array<string>")).otherwise(words_of(F.col("__t"))).alias("w"), F.when(F.col("__new"), F.col("__t")).alias("whole")]
    if (size or 0) <= table_bytes:
        listed = words.toArrow().combine_chunks() if n else pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, listed.schema) as out:
            out.write_table(listed)
        shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
            one = lambda c: got[c].chunk(0) if got[c].num_chunks else pa.array([], got.schema.field(c).type)
            table, tokenizer = _Table(one("word"), one("ids")), _tokenizer(vocabulary)
            for b in batches:
                for part in _slices(b, 1):
                    yield _emit(part, table, tokenizer)

        return rows.select("__id", *split).mapInArrow(place, f"__id {kind}, ids array<int>").withColumnRenamed("__id", doc_id)

    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    # the words go along with each row, split once and by the same rules as those of the table
    placed = rows.select("__id", *split, F.pmod(F.xxhash64("__id", F.length("__t")), F.lit(blocks)).alias("__b"))
    own = rows.where(~F.col("__new")).select(F.pmod(F.xxhash64("__id", F.length("__t")), F.lit(blocks)).alias("__c"), F.explode(F.array_distinct(words_of(F.col("__t")))).alias("word")).distinct().join(words, "word")

    def meet(texts: pa.Table, table: pa.Table) -> pa.Table:
        one = lambda c, kind: table[c].combine_chunks().cast(kind) if table.num_rows else pa.array([], kind)
        known, tokenizer = _Table(one("word", pa.string()), one("ids", pa.list_(pa.int32()))), _tokenizer(vocabulary)
        parts = []
        for b in texts.select(["__id", "w", "whole"]).to_batches(max_chunksize=500):
            parts += [_emit(part, known, tokenizer) for part in _slices(b, 1)]
        return pa.Table.from_batches(parts, schema=pa.schema([("__id", texts.schema.field("__id").type), ("ids", pa.list_(pa.int32()))]))

    return placed.groupBy("__b").cogroup(own.groupBy("__c")).applyInArrow(meet, f"__id {kind}, ids array<int>").withColumnRenamed("__id", doc_id)


def pieces(spark, vocabulary: str = VOCABULARY) -> DataFrame:
    """``token_id``, ``piece`` (binary) of the vocabulary; its size is fixed."""
    tokenizer = _tokenizer(vocabulary)
    # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the rest for characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    rows = [(i, bytearray(byte_of[c] for c in p) if all(c in byte_of for c in p) else bytearray(p.encode())) for p, i in tokenizer.get_vocab().items()]
    return spark.createDataFrame(rows, "token_id int, piece binary")


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` (unique) and ``text`` again, by a join of ids to pieces. An empty list gives an empty text."""
    flat = encoded.select(F.col(doc_id).alias("__id"), F.posexplode_outer("ids").alias("at", "token_id"))
    joined = flat.join(F.broadcast(pieces(encoded.sparkSession, vocabulary)), "token_id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", F.hex("piece").alias("hex")))))
    text = F.decode(F.unhex(F.array_join(F.transform(ordered, lambda x: x["hex"]), "")), "UTF-8")
    return joined.groupBy("__id").agg(text.alias("text")).withColumnRenamed("__id", doc_id)
