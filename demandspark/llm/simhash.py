"""SimHash near-duplicates linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the
perfect [23, 12, 7] Golay code (the missing bits are zero). The indexes of a segment are the numbers of
the codewords to which the segment and its one-bit neighbours decode, 1 to about 6 of 4,096. Two segments that differ in two bits or
fewer have a neighbour (or themselves) in common and so share an index. If two fingerprints differ in
four bits or fewer, at most one of their segments differs in three or more, so they share an index in
at least two segments at once: the pairs of indexes of two segments are the join keys. Every pair with
a common key is verified on the fingerprints inside the join, so only real links leave it.

Equal fingerprints are one class from the start. Links between classes are found in two rounds that
emit no quadratic sets: first every member of a key is compared with the smallest member, which ties
large groups together. Then members of small components are compared with all others of their keys,
and members of large ones with those of other large ones, except inside the key's largest component.
So the pairs that are skipped are in one component already, and only verified links between different
components leave a join.

Defined cases: null, empty and word-less texts have fingerprint zero and are linked like any other;
a text of fewer words than a shingle is one shingle. Repeated ``doc_id`` values are rows of their own
with the same component rules. Empty tables give empty results, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.components import components
from demandspark.llm.tables import BETWEEN_SPACES, LOWER, ids_and_texts, join_spread, small_batches, stored, utf8, word_spans
from demandspark.sources.storage import shuffle_partitions

#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: From this number of fingerprints on, a component counts as large.
LARGE = 32


@cache
def decoder() -> np.ndarray:
    """Number (upper 12 bits of the nearest codeword) for each of the 2^23 words of 23 bits."""
    words = np.arange(1 << 23, dtype=np.uint32)

    def syndromes(w: np.ndarray) -> np.ndarray:
        rest = w.copy()
        for bit in range(22, 10, -1):
            rest ^= np.where(rest >> bit & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
        return rest

    single = (1 << np.arange(23)).astype(np.uint32)
    errors = [np.zeros(1, np.uint32), single]
    pairs = (single[:, None] | single[None, :])[np.triu_indices(23, 1)]
    triples = (pairs[:, None] | single[None, :]).ravel()
    errors += [pairs, np.unique(triples[np.bitwise_count(triples) == 3])]
    patterns = np.concatenate(errors)  # 1 + 23 + 253 + 1771 = 2^11: the code is perfect
    error_of = np.zeros(1 << 11, np.uint32)
    error_of[syndromes(patterns)] = patterns
    return ((words ^ error_of[syndromes(words)]) >> 11).astype(np.uint16)


def segment_indexes(fingerprints: np.ndarray, segment: int) -> list[np.ndarray]:
    """For each fingerprint the distinct codeword numbers of one segment and its one-bit neighbours."""
    low, width = SEGMENTS[segment]
    word = (fingerprints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.uint32)
    around = np.stack([word, *(word ^ np.uint32(1 << b) for b in range(width))], axis=1)
    numbers = np.sort(decoder()[around], axis=1)
    fresh = np.ones(numbers.shape, bool)
    fresh[:, 1:] = numbers[:, 1:] != numbers[:, :-1]
    return np.split(numbers[fresh], np.cumsum(fresh.sum(axis=1))[:-1])


def keys_of(fingerprints: np.ndarray) -> list[np.ndarray]:
    """Join keys of each fingerprint: segment pair, index in the first and index in the second."""
    own = [segment_indexes(fingerprints, s) for s in range(len(SEGMENTS))]
    out = []
    for a, b, c in zip(*own, strict=True):
        a, b, c = (x.astype(np.int64) for x in (a, b, c))
        pairs = [(x[:, None] << 12 | y[None, :]).ravel() + (n << 24) for n, (x, y) in enumerate(((a, b), (a, c), (b, c)))]
        out.append(np.concatenate(pairs))
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each text from the XXH64 (seed 42) of its shingles of ``width`` words."""
    begin, end, first = word_spans(BETWEEN_SPACES[data], offsets)
    # words of all texts with one space after each: every shingle is a run of bytes
    size = end - begin
    place = np.cumsum(size + 1) - (size + 1)
    packed = np.full(int((size + 1).sum()), 32, np.uint8)
    inside = np.repeat(place - begin, size) + np.flatnonzero(BETWEEN_SPACES[data])
    packed[inside] = LOWER[data[BETWEEN_SPACES[data]]]
    n = np.diff(first)
    shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.repeat(first[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    last = at + np.repeat(np.where(n >= width, width, n), shingles) - 1
    raw, of = packed.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (of(raw[a:b], 42) for a, b in zip(place[at].tolist(), (place + size)[last].tolist(), strict=True)),
        np.uint64, len(at),
    )
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(shingles)
    cuts = (np.cumsum(shingles) - shingles)[some]
    for bit in range(64 if len(some) else 0):
        ones = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int32), cuts)
        out[some] |= (2 * ones > shingles[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``doc_id, simhash`` (the fingerprint's bits as a signed long) of every whole text, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            marks = fingerprints_of(*utf8(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "simhash"])

    return stored(ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, simhash bigint"), "simhash")


def with_keys(classes: DataFrame) -> DataFrame:
    """Every row of ``classes`` (which has ``simhash``) once for each of its join keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                own = keys_of(part.column("simhash").to_numpy(zero_copy_only=False).view(np.uint64))
                many = np.array([len(k) for k in own])
                rows = part.take(pa.array(np.repeat(np.arange(len(own)), many)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(own))], [*rows.schema.names, "key"])

    names = ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    # a stored table of few files would be few tasks, while every row becomes some 70
    spread = classes.repartition(shuffle_partitions(classes.sparkSession), "simhash")
    return spread.mapInArrow(run, f"{names}, key bigint")


def distance(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two fingerprints."""
    left, right = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(left.bitwiseXOR(right))


def _met(rows: DataFrame, others: DataFrame, on: Column) -> DataFrame:
    """``rows`` joined to ``others``, where either has a row for each join key of a fingerprint.

    Always by shuffle: Spark takes a row with its some 70 keys for one row, and would broadcast what fills the driver.
    """
    return rows.join(others.hint("merge"), on)


def pivot_links(members: DataFrame, most: int) -> DataFrame:
    """Links ``u, v`` of every member of a key to the key's smallest member."""
    pivots = members.groupBy("key").agg(F.min("simhash").alias("pivot"), F.count(F.lit(1)).alias("n"))
    pivots = pivots.where("n > 1").select(F.col("key").alias("pivot_key"), "pivot")
    near = (F.col("key") == F.col("pivot_key")) & (F.col("simhash") != F.col("pivot")) & (distance("simhash", "pivot") <= most)
    return _met(members, pivots, near).select(F.col("simhash").alias("u"), F.col("pivot").alias("v"))


def _apart(rows: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Links between the labels of ``rows`` and of ``members`` of the same key, where the labels differ."""
    other = [F.col(c).alias(f"{c}_b") for c in ("key", "simhash", "label")]
    apart = (F.col("key") == F.col("key_b")) & (F.col("label") != F.col("label_b")) & (distance("simhash", "simhash_b") <= most)
    return _met(rows, members.select(*other), apart).select(F.col("label").alias("u"), F.col("label_b").alias("v"))


def small_links(members: DataFrame, most: int) -> DataFrame:
    """Links of the members of small components to all others of their keys."""
    return _apart(members.where(F.col("weight") < LARGE), members, most)


def large_links(large: DataFrame, most: int) -> DataFrame:
    """Links of the members of large components to those of other large ones, but for those in the key's largest."""
    homes = large.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("label", F.struct("weight", "label")).alias("home")
    )
    homes = homes.where("low <> high").select(F.col("key").alias("home_key"), "home")
    strays = _met(large, homes, (F.col("key") == F.col("home_key")) & (F.col("label") != F.col("home"))).select("key", "simhash", "label")
    return _apart(strays, large, most)


def linked_classes(marks: DataFrame, most: int = 4) -> DataFrame:
    """``simhash, component_id`` for every distinct fingerprint of ``marks`` (``doc_id, simhash``)."""
    if not 0 <= most <= 4:
        raise ValueError("the keys find all links up to 4 differing bits")
    classes = stored(marks.groupBy("simhash").agg(F.min("doc_id").alias("doc")), "classes")

    # round 1: every member of a key against the smallest one
    groups = components(pivot_links(with_keys(classes.select("simhash")), most).distinct())
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    labels = groups.join(sizes, "component").select(F.col("node").alias("simhash"), "component", "weight")
    labelled = classes.select("simhash").join(labels, "simhash", "left").select(
        "simhash", F.coalesce("component", "simhash").alias("label"), F.coalesce("weight", F.lit(1).cast("long")).alias("weight")
    )
    labelled = stored(labelled, "labelled")

    # round 2: members of small components, and of large ones, against the others of their keys
    third = large_links(with_keys(labelled.where(F.col("weight") >= LARGE)), most)
    second = small_links(with_keys(labelled), most).unionByName(third).distinct()
    joint = components(second).select(F.col("node").alias("label"), "component")

    joint = stored(labelled.select("label").distinct().join(joint, "label", "left").select("label", F.coalesce("component", "label").alias("whole")), "joint")
    merged = stored(join_spread(labelled.select("simhash", "label"), joint, "label").join(classes, "simhash").select("simhash", "doc", "whole"), "merged")
    smallest = merged.groupBy("whole").agg(F.min("doc").alias("component_id"))
    return stored(join_spread(merged.select("simhash", "whole"), smallest, "whole").select("simhash", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """``doc_id, simhash, component_id`` of every row; the component is the smallest ``doc_id`` reachable."""
    marks = fingerprints(docs, id_col, text_col, width)
    return join_spread(marks, linked_classes(marks, most), "simhash").select("doc_id", "simhash", "component_id")
