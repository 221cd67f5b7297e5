"""Reading the given tables and moving their rows through Arrow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.sources.storage import new_folder

#: Characters that separate words, for SQL regular expressions: space and \t\n\v\f\r.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder of the shared storage and read from there.

    Cuts the lineage, survives the loss of executors, and keeps costly Python work from running twice.
    """
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot if more than this part of all rows has it, so there are fewer hot keys than this number.
HOT_KEYS = 1024


def join_spread(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``found`` (one row a key): rows of hot keys, however many, stay where they are.

    There are fewer than ``HOT_KEYS`` hot keys, so these are broadcast; the others are shuffled by key.
    """
    counts = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = stored(counts.where(F.col("n") * HOT_KEYS > total).select(key), "hot-keys")
    there = rows.join(F.broadcast(found.join(F.broadcast(hot), key, "left_semi")), key)
    return there.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(found, key))


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly two columns, ``doc_id`` (long) and ``text`` (null: empty); other columns stay out."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def small_batches(batches: Iterable[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``most`` bytes of text; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(int(a), int(b - a))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text begins (one entry more than texts)."""
    array = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, where, what = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    if what is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_class(ranges: Iterable[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans, true in the given ranges (ends included)."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes of words between white space, and bytes of words of digits, lower-case letters and all beyond ASCII.
BETWEEN_SPACES = ~byte_class([(0x09, 0x0D), (0x20, 0x20)])
ALPHANUMERIC = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: Lower case for A-Z, everything else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_spans(
    mask: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of true bytes, and each text's first run (one entry more).

    ``offsets`` as from :func:`utf8`; no run crosses from one text to the next, nor a place in ``breaks``.
    """
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    for cuts in (offsets, breaks) if breaks is not None else (offsets,):
        before[cuts[cuts < len(mask)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def dictionary_of(data: np.ndarray, mask: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Code of each word, and the distinct words as binary values in order of first use."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    words = pa.Array.from_buffers(
        pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[mask]))]
    )
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
