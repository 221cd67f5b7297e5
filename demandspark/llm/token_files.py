"""Token ids as Parquet lists: ordered shards that can be read by column and by range of documents.

A store holds one row for each document, in ascending order of ``doc_id`` over all shards. Ids are a
dictionary-encoded list column; document ids, counts and offsets are written without a dictionary by
the version 2 writer, which delta-encodes them. Row groups and pages are kept small enough for the
page index to skip what a range of documents does not need, and the metadata columns can be read
without touching a single id.

The tokenizers this serves lower their input, drop white space and never join an ASCII letter or digit with
ASCII punctuation other than the apostrophe. So a text is cut at white space and at such places,
A-Z are lowered, each distinct piece is tokenized once and remembered, and the ids of a text are the
ids of its pieces in a row. Texts near a special string such as ``<|endoftext|>`` are cut at white
space only. The tests compare with the library on whole texts.

Defined cases: a null or empty text holds the end id only. Repeated documents are written one by one;
equal ``doc_id`` are ordered by text, a null ``doc_id`` comes first. An empty table gives an empty
store. Further columns are not written.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandspark.llm.tables import (
    BETWEEN_SPACES, LOWER, dictionary_of, ids_and_texts, small_batches, stored, utf8, word_spans,
)
from demandspark.sources.storage import new_folder

STORE = "doc_id bigint, n_tokens bigint, shard int, shard_start bigint, tokens array<int>"
#: Writer settings: see the module's text.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
} | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "n_tokens", "shard_start")}


@cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of words under one tokenizer; remembers words, as Arrow values, up to ``most`` of them."""

    def __init__(self, path: str, most: int = 500_000):
        self.path, self.most = path, most
        self.words, self.ids, self.starts = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A run of ids that holds those of every word, and where each word's begin and how many they are."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        unknown = words.take(pa.array(new))
        more, many = self.encoded(unknown)
        ids = np.concatenate([self.ids, more])
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(many)])
        at[new] = len(self.words) + np.arange(len(new))
        if len(self.words) + len(new) <= self.most:
            self.words, self.ids, self.starts = pa.concat_arrays([self.words, unknown]), ids, starts
        return ids, starts[at], np.diff(starts)[at]

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What the library gives for each word: all ids in a row, and the number of each word's."""
        ids, many = array("i"), array("q")
        for a in range(0, len(words), 4096):  # an encoding takes far more memory than its ids
            texts = [w.decode() for w in words.slice(a, 4096).to_pylist()]
            for e in tokenizer(self.path).encode_batch_fast(texts, add_special_tokens=False):
                own = e.ids
                ids.extend(own)
                many.append(len(own))
        return np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32), np.array(many, np.int64)


@cache
def word_ids(path: str) -> WordIds:
    """One memory for all tasks of a Python worker."""
    return WordIds(path)


#: 1: ASCII letters and digits; 2: ASCII punctuation but the apostrophe.
KINDS = np.array(
    [1 if chr(b).isalnum() else 2 if 33 <= b <= 126 and b != 39 else 0 for b in range(128)] + [0] * 128, np.uint8
)


def encode(texts: pa.Array, words: WordIds, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each text closed by ``end_id``, and where each text begins."""
    data, offsets = utf8(texts)
    mask, breaks = BETWEEN_SPACES[data], None
    if b"<|" not in data.tobytes():
        kinds = KINDS[data]
        breaks = np.flatnonzero(kinds[1:] * kinds[:-1] == 2) + 1
        data = LOWER[data]
    begin, end, first = word_spans(mask, offsets, breaks)
    codes, distinct = dictionary_of(data, mask, end - begin)
    ids, place, many = words.of(distinct)
    closing = int(end_id is not None)
    size = many[codes]
    before = np.concatenate([[0], np.cumsum(size)])
    starts = before[first] + closing * np.arange(len(first))
    out = np.full(int(starts[-1]), end_id or 0, np.int32)
    source = np.repeat(place[codes] - before[:-1], size) + np.arange(before[-1])
    target = np.arange(before[-1]) + np.repeat(closing * np.arange(len(first) - 1), np.diff(before[first]))
    out[target] = ids[source]
    return out, starts


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, shards: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the store of ``docs`` to ``path``. Shards default to the session's shuffle partitions."""
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = word_ids(tokenizer_path), 0
        shard = pyspark.TaskContext.get().partitionId()
        for batch in small_batches(batches, "text", 2 << 20):
            ids, at = encode(batch.column("text"), words, end_id)
            size = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(size), pa.array(np.full(len(size), shard, np.int32)),
                    pa.array(start + at[:-1]), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                ],
                ["doc_id", "n_tokens", "shard", "shard_start", "tokens"],
            )
            start += int(at[-1])
        pa.default_memory_pool().release_unused()  # the worker lives on

    ordered = ids_and_texts(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, STORE).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents ``low`` to ``high`` (ends included) of a store with ``start``, the ids of all documents
    before each. The offsets come from the metadata columns alone; the range is pushed into the scan."""
    store = spark.read.schema(STORE).parquet(path)
    totals = store.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))  # one row a shard
    offsets = stored(offsets, "shard-offsets")  # of known size, so the ids are joined where they are read
    rows = store
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows.join(offsets, "shard").select(
        "doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "tokens"
    )


def with_crc32(rows: DataFrame) -> DataFrame:
    """Replaces ``tokens`` by ``ids_crc32``, over the ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in rows.columns if c != "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.names.index("tokens"))
            at = lists.offsets.to_numpy()
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            crc = [zlib.crc32(flat[a:b].data) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(c)) for c in kept), pa.array(crc, pa.int64())], [*kept, "ids_crc32"]
            )

    names = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in kept)
    return rows.mapInArrow(run, f"{names}, ids_crc32 bigint")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a new store in the shared folder and read it back: ``doc_id, start, n_tokens, tokens``."""
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, id_col=id_col, text_col=text_col)
    return read_tokens(docs.sparkSession, path)
