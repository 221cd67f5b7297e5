"""Benchmark decontamination by a distributed positional inverted index.

Documents are indexed in segments: a segment holds whole documents up to a number of tokens, and for
every distinct word the ascending list of its positions. Segments are rows of a Parquet table, so no
posting is shuffled and a frequent word costs no more than its own share of each segment. A window of
test words is looked up from its rarest word: its positions, less the word's offset in the window, are
intersected with the offset-adjusted lists of the next rarer words until none is left or all agree.
Words are compared as such, not as hashes, so a phrase match needs no second look.

Test items reach the tasks in blocks of at most ``block_bytes`` of text, whatever their number.

Defined cases: null and empty texts, and texts without words, have ``n_words`` 0 and no match. An item
without words has no window; an item shorter than a window is one window. An item without an id is searched
like any other, so its words count in ``n_hit`` and the verdict, but it is in no list of items. Repeated documents are
indexed and answered one by one, repeated items count as often as their distinct ids. Empty tables give
empty results. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.tables import (
    ALPHANUMERIC, LOWER, dictionary_of, ids_and_texts, small_batches, stored, utf8, word_spans,
)

#: Unused positions between documents; windows and distances stay below it.
GAP = 64
SEGMENT = "docs array<bigint>, starts array<int>, sizes array<int>, terms binary, counts binary, postings binary"
SEGMENT_ARROW = pa.schema(
    [("docs", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
     ("terms", pa.binary()), ("counts", pa.binary()), ("postings", pa.binary())]
)
MATCHES = "segment bigint, place int, doc_id bigint, n_words bigint, spans array<struct<begin:int,end:int>>, items array<string>"


def planes(numbers: np.ndarray) -> bytes:
    """Differences of unsigned numbers, byte plane by byte plane, which compresses well."""
    steps = np.diff(numbers.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32).astype(np.int64)


def segment_of(ids: list, codes: list[np.ndarray], sizes: list[np.ndarray], words: list[pa.Array]) -> pa.RecordBatch:
    """One row of the index; ``codes`` refer to ``words`` of the same place."""
    joint = pa.chunked_array(words, pa.binary()).dictionary_encode()
    terms = joint.chunk(0).dictionary if joint.num_chunks else pa.array([], pa.binary())
    remap = [c.indices.to_numpy(zero_copy_only=False) for c in joint.chunks]
    term = np.concatenate([m[c] if len(m) else c for m, c in zip(remap, codes, strict=True)]).astype(np.int64)
    size = np.concatenate(sizes)
    starts = np.cumsum(size + GAP) - (size + GAP)
    position = np.arange(len(term)) + np.repeat(np.arange(len(size)) * GAP, size)
    order = np.argsort(term, kind="stable")
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([starts.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([size.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([b"\n".join(terms.to_pylist())], pa.binary()),
            pa.array([planes(np.bincount(term, minlength=len(terms)))], pa.binary()),
            pa.array([planes(position[order])], pa.binary()),
        ],
        schema=SEGMENT_ARROW,
    )


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 1_500_000) -> DataFrame:
    """The segments of all documents, stored; one row holds about ``segment_tokens`` tokens of whole texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, sizes, words, total = [], [], [], [], 0
        for batch in small_batches(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            data = LOWER[data]
            mask = ALPHANUMERIC[data]
            begin, end, first = word_spans(mask, offsets)
            code, distinct = dictionary_of(data, mask, end - begin)
            ids += batch.column("doc_id").to_pylist()
            codes.append(code)
            words.append(distinct)
            sizes.append(np.diff(first))
            total += len(code)
            if total >= segment_tokens:
                yield segment_of(ids, codes, sizes, words)
                ids, codes, sizes, words, total = [], [], [], [], 0
        if ids:
            yield segment_of(ids, codes, sizes, words)

    segments = ids_and_texts(docs, id_col, text_col).mapInArrow(build, SEGMENT)
    return stored(segments.withColumn("segment", F.monotonically_increasing_id()), "positional-index")


@dataclass
class Windows:
    """Distinct windows of test words: rows of word numbers, padded with -1, and the items of each."""

    words: pa.Array
    rows: np.ndarray
    lengths: np.ndarray
    owner_starts: np.ndarray
    owners: np.ndarray
    items: list[str]


def test_windows(items: list[tuple[str | None, str]], size: int) -> Windows:
    """All windows of ``size`` consecutive words of the items (id, text); those without id own none."""
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    data = LOWER[data]
    mask = ALPHANUMERIC[data]
    begin, end, first = word_spans(mask, offsets)
    codes, words = dictionary_of(data, mask, end - begin)
    names = sorted({i for i, _ in items if i is not None})
    number = {n: k for k, n in enumerate(names)}
    found: dict[tuple[int, ...], set[int]] = {}
    for k, (name, _) in enumerate(items):
        own = codes[first[k] : first[k + 1]].tolist()
        for a in range(max(1, len(own) - size + 1) if own else 0):
            owners = found.setdefault(tuple(own[a : a + size]), set())
            if name is not None:
                owners.add(number[name])
    rows = np.full((len(found), size), -1, np.int64)
    for k, w in enumerate(found):
        rows[k, : len(w)] = w
    owners = [sorted(s) for s in found.values()]
    return Windows(
        words, rows, np.array([len(w) for w in found], np.int64), np.cumsum([0, *map(len, owners)]),
        np.array([i for s in owners for i in s], np.int64), names,
    )


def found_in(segment: dict, probe: Windows, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, end and window number of every match in one segment.

    ``distance`` 0 asks for exact phrases. Beyond, a window matches at a place of its rarest word where
    each of its other words stands at most ``distance`` words away; the match covers what was found.
    """
    terms = pa.array(segment["terms"].split(b"\n") if segment["terms"] else [], pa.binary())
    counts, postings = from_planes(segment["counts"]), from_planes(segment["postings"])
    ends = np.cumsum(counts)
    local = pc.fill_null(pc.index_in(probe.words, value_set=terms), -1).to_numpy(zero_copy_only=False)
    rows = np.where(probe.rows >= 0, local[probe.rows], -2) if len(local) else np.full_like(probe.rows, -1)
    there = np.flatnonzero((rows != -1).all(axis=1))
    rows = rows[there]
    weight = np.where(rows >= 0, counts[np.maximum(rows, 0)], np.iinfo(np.int64).max) if len(rows) else rows
    ranked = np.argsort(weight, axis=1, kind="stable")
    begins, stops, which = [], [], []
    for k, row, order in zip(there, rows, ranked, strict=True):
        order = order[: probe.lengths[k]]
        rarest = row[order[0]]
        at = postings[ends[rarest] - counts[rarest] : ends[rarest]]
        low = high = at = at if distance else at - order[0]
        for o in order[1:]:
            other = postings[ends[row[o]] - counts[row[o]] : ends[row[o]]]
            if not distance:
                place = np.searchsorted(other, at + o)
                at = at[other[np.minimum(place, len(other) - 1)] == at + o]
            else:
                place = np.searchsorted(other, at)
                left = other[np.maximum(place - 1, 0)]
                right = other[np.minimum(place, len(other) - 1)]
                near = np.where(np.abs(right - at) <= np.abs(left - at), right, left)
                keep = np.abs(near - at) <= distance
                at, near = at[keep], near[keep]
                low, high = np.minimum(low[keep], near), np.maximum(high[keep], near)
            if not len(at):
                break
        if len(at):
            begins.append(low if distance else at)
            stops.append(high + 1 if distance else at + probe.lengths[k])
            which.append(np.full(len(at), k))
    if not begins:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(begins), np.concatenate(stops), np.concatenate(which)


def answers(segment: dict, probe: Windows, distance: int) -> pa.RecordBatch:
    """For every document of the segment its words, disjoint matched spans and matched items."""
    starts, n = np.array(segment["starts"], np.int64), len(segment["docs"])
    begin, end, window = found_in(segment, probe, distance)
    order = np.argsort(begin, kind="stable")
    begin, end, window = begin[order], end[order], window[order]
    doc = np.searchsorted(starts, begin, side="right") - 1
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin))[: len(first)] - 1
    span_doc = doc[first]
    span_at = np.searchsorted(span_doc, np.arange(n + 1))
    spans = pa.StructArray.from_arrays(
        [pa.array((x - starts[span_doc]).astype(np.int32)) for x in (begin[first], reach[last])], ["begin", "end"]
    )
    many = np.diff(probe.owner_starts)[window]
    owner = probe.owners[
        np.repeat(probe.owner_starts[window] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    ] if len(window) else window
    pairs = np.unique(np.repeat(doc, many) * max(1, len(probe.items)) + owner)
    item_at = np.searchsorted(pairs // max(1, len(probe.items)), np.arange(n + 1))
    names = pa.array(probe.items, pa.string()).take(pa.array(pairs % max(1, len(probe.items))))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([segment["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
            pa.array(segment["docs"], pa.int64()), pa.array(segment["sizes"], pa.int64()),
            pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), spans),
            pa.ListArray.from_arrays(pa.array(item_at, pa.int32()), names),
        ],
        ["segment", "place", "doc_id", "n_words", "spans", "items"],
    )


def in_pieces(tests: DataFrame, window: int, block_bytes: int, piece_words: int = 1 << 16) -> DataFrame:
    """Items longer than a block as pieces of whole words; neighbours share ``window - 1`` words, so the windows
    of the pieces are those of the item."""
    long = F.octet_length("text") > block_bytes
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(plain, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)
    cut = tests.where(long).select("item", words.alias("w"))
    first = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(piece_words))
    cut = cut.select("item", "w", F.explode(first).alias("at")).where(F.size("w") > 0)
    piece = F.array_join(F.slice("w", F.col("at") + 1, piece_words + window - 1), " ")
    return tests.where(~long).unionByName(cut.select("item", piece.alias("text")))


def search(
    segments: DataFrame, items: DataFrame, window: int = 10, distance: int = 0, block_bytes: int = 16 << 20,
    item_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """Matches of the windows of all test items: one row for every document, with
    ``doc_id, n_words, spans`` (disjoint, ascending, in words of the document) and ``items``."""
    if not 0 < window < GAP or not 0 <= distance < GAP:
        raise ValueError(f"window and distance must be below {GAP}")
    spark = segments.sparkSession
    tests = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    tests = tests.where("text IS NOT NULL").distinct()
    tests = in_pieces(tests, window, block_bytes)
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks = max(1, math.ceil(2 * (total or 0) / block_bytes))
    parts = []
    for k in range(blocks):  # a block: about half of block_bytes, by hash of item and text
        own = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else tests
        probe = spark.sparkContext.broadcast(test_windows([tuple(r) for r in own.collect()], window))

        def ask(batches, probe=probe):
            for batch in batches:
                for row in batch.to_pylist():
                    yield answers(row, probe.value, distance)

        parts.append(segments.mapInArrow(ask, MATCHES))
    if blocks == 1:
        return parts[0].drop("segment", "place")
    joint = parts[0]
    for part in parts[1:]:
        joint = joint.unionByName(part)
    merged = joint.groupBy("segment", "place", "doc_id", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select("doc_id", "n_words", F.expr(DISJOINT).alias("spans"), "items")


#: Sorted spans to disjoint ones.
DISJOINT = """
aggregate(spans, cast(array() AS array<struct<begin:int,end:int>>), (done, s) ->
  CASE WHEN size(done) > 0 AND s.begin <= element_at(done, -1).end THEN concat(slice(done, 1, size(done) - 1),
    array(named_struct('begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, s.end))))
  ELSE concat(done, array(s)) END)
"""


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: words, words inside matched windows, matched items and the verdict."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"]))
    return search(index(docs), items, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "spans",
    )


CONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS varchar) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[a:a + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS a FROM items WHERE len(w) > 0)),
grams AS (
  SELECT k, n, a, array_to_string(w[a:a + n - 1], ' ') AS win
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM docs, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT k, a, n, item FROM grams JOIN windows USING (n, win)),
places AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(a, a + n)) AS p FROM hits) GROUP BY k),
found AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, item FROM hits WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (k) LEFT JOIN found USING (k)
"""
