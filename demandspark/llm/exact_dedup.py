"""Exact duplicates by counting quotient filters and byte verification.

Every partition counts the 64-bit fingerprints of its normalised texts in counting quotient filters,
one for each range of fingerprints: the leading bits name the range, the next bits are the quotient,
the rest is the remainder. Remainders of a quotient form a sorted run; a count above one is encoded in
the run itself. Filters of a range list their fingerprints in sorted order, so they merge without loss
by merging sorted lists; whatever the number of copies, a fingerprint is one entry per partition.
Fingerprints with a count above one lead to the texts that have them, and those are grouped by their
bytes, so equal fingerprints of different texts do no harm.

Defined cases: null counts as the empty text, and empty texts equal each other. The row with the
smallest ``doc_id`` stays; rows that repeat that id as well are all ``kept``, null ids are never the
smallest unless all are null. Empty tables give empty results, further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.tables import SPACES, ids_and_texts, stored

#: Fingerprints of one range, on average at most.
RANGE_ROWS = 1 << 19


@dataclass
class CountingQuotientFilter:
    """Sorted fingerprints of ``quotient_bits + remainder_bits`` bits with counts.

    ``occupied`` has a bit for each quotient; the k-th set bit owns the k-th run of ``slots``, which ends
    where ``run_ends`` has its k-th set bit. Within a run remainders ascend. A remainder x is written
    once or twice for a count of 1 or 2, and as x, count, x beyond (a smaller or zero-led number after x
    marks a counter; counter digits skip 0 and x). For x = 0 a count of 3 is 0 0 0, more is 0 count 0 0.
    """

    quotient_bits: int
    remainder_bits: int
    occupied: bytes
    run_ends: bytes
    slots: np.ndarray

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, quotient_bits: int, remainder_bits: int):
        """From distinct ascending fingerprints (uint64) and their counts."""
        x = prints & np.uint64((1 << remainder_bits) - 1)
        quotient = (prints >> np.uint64(remainder_bits)).astype(np.int64)
        counts = counts.astype(np.uint64)
        zero, many = x == 0, counts > 2
        digit = np.where(zero, np.where(counts > 3, counts - np.uint64(3), 0), counts - np.uint64(2))  # not 0
        digit = np.where(many & ~zero & (digit >= x), digit + np.uint64(1), digit)  # not x
        led = many & ~zero & (digit > x)
        size = np.where(many, np.where(zero, np.where(counts > 3, 4, 3), np.where(led, 4, 3)), counts.astype(np.int64))
        at = np.cumsum(size) - size
        slots = np.repeat(x, size)
        plain = many & ~zero & ~led
        slots[at[plain] + 1] = digit[plain]
        slots[at[led] + 1] = 0
        slots[at[led] + 2] = digit[led]
        lots = zero & (counts > 3)
        slots[at[lots] + 1] = digit[lots]
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotient] = True
        ends = np.zeros(len(slots), bool)
        if len(prints):
            last = np.append(quotient[1:] != quotient[:-1], True)
            ends[(at + size - 1)[last]] = True
        return cls(quotient_bits, remainder_bits, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), slots)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ascending fingerprints and counts."""
        quotients = np.flatnonzero(np.unpackbits(np.frombuffer(self.occupied, np.uint8)))
        stops = np.flatnonzero(np.unpackbits(np.frombuffer(self.run_ends, np.uint8), count=len(self.slots))) + 1
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        owner = np.repeat(np.arange(len(stops)), stops - starts)
        rising = np.ones(len(self.slots), bool)
        rising[1:] = (self.slots[1:] > self.slots[:-1]) | (owner[1:] != owner[:-1])
        odd = np.zeros(len(stops), bool)
        odd[owner[~rising]] = True
        # a run of 0 count 0 0 has equal neighbours, so a run without counters is one that rises throughout
        simple = ~odd[owner]
        prints = [(quotients[owner[simple]].astype(np.uint64) << np.uint64(self.remainder_bits)) | self.slots[simple]]
        counts = [np.ones(int(simple.sum()), np.int64)]
        for k in np.flatnonzero(odd):
            found = self.decoded(self.slots[starts[k] : stops[k]].tolist())
            high = int(quotients[k]) << self.remainder_bits
            prints.append(np.array([high | r for r, _ in found], np.uint64))
            counts.append(np.array([c for _, c in found], np.int64))
        prints, counts = np.concatenate(prints), np.concatenate(counts)
        order = np.argsort(prints, kind="stable")
        return prints[order], counts[order]

    @staticmethod
    def decoded(run: list[int]) -> list[tuple[int, int]]:
        """Remainders and counts of one run."""
        out, i = [], 0
        while i < len(run):
            x, rest = run[i], run[i + 1 :]
            if x == 0 and rest[:2] == [0, 0]:
                out.append((0, 3))
                i += 3
            elif x == 0 and len(rest) > 2 and rest[0] and rest[1:3] == [0, 0]:
                out.append((0, rest[0] + 3))
                i += 4
            elif rest and rest[0] == x:
                out.append((x, 2))
                i += 2
            elif rest and rest[0] < x:
                led = rest[0] == 0
                digit = rest[led]
                out.append((x, digit + 2 - (digit > x)))
                i += 3 + led
            else:
                out.append((x, 1))
                i += 1
        return out

    def to_row(self) -> tuple:
        return self.quotient_bits, self.remainder_bits, self.occupied, self.run_ends, self.slots.tobytes()

    @classmethod
    def of_row(cls, quotient_bits, remainder_bits, occupied, run_ends, slots):
        return cls(quotient_bits, remainder_bits, occupied, run_ends, np.frombuffer(slots, np.uint64))


def merged(filters: list[CountingQuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and summed counts of all filters, by merging their sorted lists."""
    lists = [f.entries() for f in filters]
    prints, counts = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.argsort(prints, kind="stable")  # merges the ascending runs it finds
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])[: len(prints)])
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


FILTER = "range long, quotient_bits int, remainder_bits int, occupied binary, run_ends binary, slots binary"


def filters(marks: DataFrame, range_bits: int) -> DataFrame:
    """One filter per partition and range of the column ``fingerprint``."""

    def of(prints: np.ndarray) -> Iterator[tuple]:
        distinct, counts = np.unique(prints, return_counts=True)
        ranges = (distinct >> np.uint64(64 - range_bits)).astype(np.int64)
        names, at = np.unique(ranges, return_index=True)
        low = np.uint64((1 << (64 - range_bits)) - 1)
        for name, a, b in zip(names.tolist(), at, np.append(at[1:], len(distinct)), strict=True):
            bits = max(3, int(math.log2(b - a + 1)))
            made = CountingQuotientFilter.build(distinct[a:b] & low, counts[a:b], bits, 64 - range_bits - bits)
            yield (name, *made.to_row())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FILTER.split(", ")]
        held, n = [], 0
        for batch in batches:
            held.append(batch["fingerprint"].to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= 1 << 20:
                yield pd.DataFrame(list(of(np.concatenate(held))), columns=columns)
                held, n = [], 0
        if n:
            yield pd.DataFrame(list(of(np.concatenate(held))), columns=columns)

    return marks.select("fingerprint").mapInPandas(run, FILTER)


def counted(marks: DataFrame, range_bits: int) -> DataFrame:
    """``fingerprint, rows`` of all fingerprints that occur more than once."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        prints, counts = merged([CountingQuotientFilter.of_row(*r) for r in rows.drop(columns="range").itertuples(index=False)])
        prints |= np.uint64(int(key[0]) << (64 - range_bits))
        often = counts > 1
        return pd.DataFrame({"fingerprint": prints[often].view(np.int64), "rows": counts[often]})

    return filters(marks, range_bits).groupBy("range").applyInPandas(merge, "fingerprint long, rows long")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACES}]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = ids_and_texts(docs, id_col, text_col).withColumn("text", normalised(F.col("text")))
    rows = rows.withColumn("fingerprint", F.xxhash64("text"))
    marks = rows.select("doc_id", "fingerprint", F.sha2("text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    marks = stored(marks, "fingerprints")
    range_bits = max(6, math.ceil(math.log2(1 + marks.count() / RANGE_ROWS)))
    # stored, so that Spark knows its size: small tables are broadcast, large ones are shuffled
    suspects = stored(counted(marks, range_bits).select("fingerprint"), "repeated-fingerprints")
    groups = rows.join(suspects, "fingerprint", "left_semi").groupBy("fingerprint", "text").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = groups.select("fingerprint", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    keys = ["fingerprint", "text_sha256"]
    # one row stays, also where the smallest id repeats or no row has an id
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    firsts = marks.join(suspects, "fingerprint", "left_semi").groupBy(*keys).agg(F.min(order)["row"].alias("first"))
    groups = stored(groups.join(firsts, keys), "groups")
    return marks.join(groups, keys, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("first"))).alias("kept"),
        "text_sha256",
    )


EXACT_SQL = r"""
WITH rows AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM rows WINDOW w AS (PARTITION BY t)
"""
