"""Spelling variants: words at edit distance one, found through an index of variable-length grams.

Words are padded by one mark on each side. Grams have 2 to ``LONGEST`` code points. A longer gram is in
the dictionary if the gram one shorter is too frequent (above a limit) and it is not rare itself (above a
sixteenth of that limit); the limit is a share of all gram places, so the dictionary is bounded
by that share, whatever the vocabulary. A word is decomposed greedily: at every place the longest gram
of the dictionary (or the two code points), without those inside an earlier gram.

For every edit of one code point the grams of a word that it can affect are counted, by overlap and by
what the dictionary would allow beside it: a gram left of the edit can grow into it if the dictionary
has a longer gram with that beginning, and a gram can vanish inside one that covers the edit if the
dictionary has one. The largest count is the word's bound. Words within one edit share all grams but
those, at places that differ by one at most; so if ``bound`` is less than the number of grams, one of
the ``bound + 1`` rarest grams of the word is shared. Only these are listed and merged, under the gram,
the length and the place, and pairs are verified inside the join: no other pair leaves it.

Words whose bound reaches all their grams give no guarantee. A pair of two such words meets in a further
index with a shorter longest gram, the last of which has grams of two code points and a bound of two, less
than the grams of any word of at least four code points.

Defined cases: a null text has no word; a null ``doc_id`` is written as nothing before the colon.
Repeated rows count again. Texts and words of any length are handled whole. Without words the result is
empty. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.tables import LOWER, byte_class, dictionary_of, ids_and_texts, small_batches, stored, utf8, word_spans

LEAST_LENGTH, LEAST_COUNT = 5, 3
DELETED = 97  # a run whose hash this number divides loses one code point
#: Longest gram of each index, and the share of all gram places above which a gram is too frequent.
LONGEST, SHARE = (4, 2), 1 / 16384
ALONE = 64  # words longer than this are handled without padding matrices of their length for others
LETTERS = byte_class([(0x41, 0x5A), (0x61, 0x7A)])


@cache
def crc_table() -> np.ndarray:
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, (rest >> 1) ^ np.uint32(0xEDB88320), rest >> 1)
    return rest


def crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of many byte runs, each going on from the CRC in ``before``."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    table = crc_table()
    many = np.searchsorted(-length, -np.arange(min(int(length.max(initial=0)), ALONE)), side="left")
    for k, n in enumerate(many.tolist()):  # the first n runs have more than k bytes
        state[:n] = table[(state[:n] ^ data[start[:n] + k]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > ALONE).tolist():
        state[i] = zlib.crc32(data[start[i] + ALONE : start[i] + length[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def runs_of(ids: list, texts: pa.Array, deleted: int = DELETED) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of the texts (deletions applied) and how often each occurs."""
    data, offsets = utf8(texts)
    high = np.zeros(len(data), bool)  # a letter of U+00C0 to U+00FF is the byte C3 and another one
    lead = data == 0xC3
    high[1:] = lead[:-1]
    mask = LETTERS[data] | lead | high
    data = LOWER[data]
    begin, end, first = word_spans(mask, offsets)
    codes, words = dictionary_of(data, mask, end - begin)
    counts = np.bincount(codes, minlength=len(words))
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    marks = crcs(data, begin, end - begin, np.repeat(heads, np.diff(first)))
    hit = np.flatnonzero(marks % np.uint32(deleted) == 0)
    more = []
    for k, h in zip(codes[hit].tolist(), marks[hit].tolist(), strict=True):
        word = words[k].as_py().decode()
        at = h % len(word)
        counts[k] -= 1
        more.append((word[:at] + word[at + 1 :]).encode())
    words = pa.concat_arrays([words, pa.array(more, pa.binary())]).cast(pa.string())
    return words, np.concatenate([counts, np.ones(len(more), np.int64)])


def vocabulary(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, deleted: int = DELETED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``word, n`` of the words of at least so many code points and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 8 << 20):
            words, counts = runs_of(batch.column("doc_id").to_pylist(), batch.column("text"), deleted)
            use = pc.greater_equal(pc.utf8_length(words), least_length).to_numpy(zero_copy_only=False) & (counts > 0)
            yield pa.RecordBatch.from_arrays([words.filter(pa.array(use)), pa.array(counts[use])], ["word", "n"])

    found = ids_and_texts(docs, id_col, text_col).mapInArrow(run, "word string, n bigint")
    return stored(found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "words")


# ------------------------------------------------------------------ grams


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters in a row as numbers (1 is the padding mark) with a mark before and after each word, and
    where each padded word begins."""
    data, offsets = utf8(words)
    tail = (data & 0xC0) == 0x80
    codes = data.astype(np.int64)
    codes[np.flatnonzero(data == 0xC3)] = 0
    codes[tail] = data[tail].astype(np.int64) - 0x80 + 2 + 26  # U+00C0 to U+00FF
    plain = ~tail & (data != 0xC3)
    codes[plain] = data[plain] - 97 + 2
    keep = data != 0xC3
    size = np.add.reduceat(np.append(keep, False).astype(np.int64), offsets[:-1]) if len(words) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size + 2)])
    out = np.ones(int(at[-1]), np.int64)
    inner = np.arange(int(size.sum())) + np.repeat(2 * np.arange(len(size)) + 1, size)
    out[inner] = codes[keep]
    return out, at


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the places of its words, and their letters as a matrix."""
    flat, at = letters_of(words)
    size = np.diff(at)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        for a in range(0, len(rows), max(1, (1 << 19) // length)):
            part = rows[a : a + max(1, (1 << 19) // length)]
            yield part, flat[at[part][:, None] + np.arange(length)[None, :]]


def gram_codes(letters: np.ndarray, q: int) -> np.ndarray:
    """Code of the gram of ``q`` letters at every place: seven bits a letter."""
    code = letters[:, : letters.shape[1] - q + 1].copy()
    for k in range(1, q):
        code = code << 7 | letters[:, k : letters.shape[1] - q + 1 + k]
    return code


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(values.shape, bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


@dataclass(frozen=True)
class Grams:
    """The dictionary: per length the sorted codes with their ranks (0 is the rarest), and what they imply."""

    longest: int
    codes: dict[int, np.ndarray]
    ranks: dict[int, np.ndarray]
    starts: dict[int, np.ndarray]  # proper beginnings of longer grams
    inner: dict[int, np.ndarray]  # parts of grams that do not begin them

    @classmethod
    def of(cls, counted: list[tuple[int, int, int]], longest: int) -> Grams:
        """From ``(length, code, count)`` of all pairs of letters and of the longer grams."""
        counted = sorted((n, q, code) for q, code, n in counted if q <= longest)
        codes = {q: [] for q in range(2, longest + 1)}
        starts, inner = ({q: set() for q in range(1, longest + 1)} for _ in range(2))
        for rank, (_, q, code) in enumerate(counted):
            codes[q].append((code, rank))
            if q == 2:
                continue
            for k in range(1, q):
                starts[k].add(code >> 7 * (q - k))
            for low in range(1, q):
                for k in range(1, q - low + 1):
                    inner[k].add(code >> 7 * (q - low - k) & ((1 << 7 * k) - 1))
        ordered = {q: np.array(sorted(c), np.int64).reshape(-1, 2) for q, c in codes.items()}
        array = lambda sets: {k: np.array(sorted(v), np.int64) for k, v in sets.items()}
        return cls(longest, {q: c[:, 0] for q, c in ordered.items()}, {q: c[:, 1] for q, c in ordered.items()}, array(starts), array(inner))

    def decompose(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per place: whether a gram of the word begins there, where it ends, and its rank."""
        n, m = letters.shape
        places = m - 1
        end = np.tile(np.arange(places) + 2, (n, 1))
        pairs = gram_codes(letters, 2)
        rank = self.ranks[2][np.minimum(np.searchsorted(self.codes[2], pairs), len(self.codes[2]) - 1)]
        for q in range(3, self.longest + 1):
            if m < q or not len(self.codes[q]):
                continue
            code = gram_codes(letters, q)
            found = is_in(code, self.codes[q])
            part = end[:, : m - q + 1]
            part[found] = (np.arange(m - q + 1)[None, :] + q).repeat(n, axis=0)[found]
            own = self.ranks[q][np.minimum(np.searchsorted(self.codes[q], code), len(self.codes[q]) - 1)]
            rank[:, : m - q + 1][found] = own[found]
        covered = np.maximum.accumulate(end, axis=1)
        kept = np.ones((n, places), bool)
        kept[:, 1:] = covered[:, :-1] < end[:, 1:]
        return kept, end, rank

    def bound(self, letters: np.ndarray, kept: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The most grams of each word that one edit can affect."""
        n, m = letters.shape
        places, far = m - 1, 1 << 30
        # reach[:, i]: the first place from which a longer gram of the dictionary could grow past place i
        reach = np.full((n, m + 1), far)
        first = np.full((n, places), far)  # from here on to its end, the word's part may lie inside a gram
        for q in range(self.longest - 1, 1, -1):  # longer ones last a smaller place
            if m < q:
                continue
            code = gram_codes(letters, q)
            if len(self.starts[q]):
                grows = is_in(code, self.starts[q])
                for a in range(m - q + 1):
                    reach[:, a + q] = np.where(grows[:, a], np.minimum(reach[:, a + q], a), reach[:, a + q])
            if len(self.inner[q]):
                inside = is_in(code, self.inner[q])
                at = end - q
                fits = (at >= 0) & (at <= np.arange(places)[None, :])
                hit = fits & np.take_along_axis(inside, np.clip(at, 0, inside.shape[1] - 1), axis=1)
                first = np.where(hit, np.minimum(first, at), first)
        worst = np.zeros(n, np.int64)
        for i in range(1, m):
            low, high = max(0, i - 2 * self.longest), min(places, i + self.longest + 1)
            p = np.arange(low, high)[None, :]
            use, e, f = kept[:, low:high], end[:, low:high], first[:, low:high]
            right = (e <= i) & (reach[:, i : i + 1] <= p)
            if i < m - 1:  # letter i replaced or deleted
                hit = ((p <= i) & (i < e)) | right | ((p > i) & (i + 1 >= f))
                worst = np.maximum(worst, (hit & use).sum(axis=1))
            # a letter inserted before letter i
            hit = ((p < i) & (i < e)) | right | ((p >= i) & (i >= f))
            worst = np.maximum(worst, (hit & use).sum(axis=1))
        return worst


def gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """``q, code, n`` of all grams of 2 to ``longest`` letters of the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {q: [] for q in range(2, longest + 1)}
            for _, letters in by_length(batch.column("word")):
                for q in held:
                    if letters.shape[1] >= q:
                        held[q].append(gram_codes(letters, q).ravel())
            for q, parts in held.items():
                if parts:
                    codes, many = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(codes), q, np.int32)), pa.array(codes), pa.array(many.astype(np.int64))], ["q", "code", "n"]
                    )

    parts = words.select("word").mapInArrow(run, "q int, code bigint, n bigint")
    return parts.groupBy("q", "code").agg(F.sum("n").alias("n"))


def dictionary(words: DataFrame, longest: int, share: float = SHARE) -> list[tuple[int, int, int]]:
    """The pairs of letters and the grams that stay, with their counts: some ``16 / share`` a length at most."""
    counts = stored(gram_counts(words, longest), "grams")
    places = counts.where("q = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(2.0, places * share)
    short = counts.where(F.col("n") > limit).select((F.col("q") + 1).alias("q"), F.col("code").alias("short"))
    grown = counts.where((F.col("q") > 2) & (F.col("n") > limit / 16)).withColumn("short", F.shiftright("code", 7))
    grown = grown.join(short, ["q", "short"], "left_semi").select("q", "code", "n")
    kept = counts.where("q = 2").select("q", "code", "n").unionByName(grown)
    return [tuple(r) for r in kept.collect()]


def listed(words: DataFrame, grams: Grams) -> DataFrame:
    """``word, open`` and ``keys``: the rarest grams by rank, length and place; open words have no bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            for rows, letters in by_length(words):
                kept, end, rank = grams.decompose(letters)
                bound, many = grams.bound(letters, kept, end), kept.sum(axis=1)
                order = np.where(kept, rank, np.iinfo(np.int64).max)
                last = np.sort(order, axis=1)[np.arange(len(rows)), np.minimum(bound, many - 1)]
                use = kept & (order <= last[:, None])
                length = np.int64(letters.shape[1] & 0xFFFFF)
                keys = rank << 40 | length << 20 | (np.arange(kept.shape[1]) & 0xFFFFF)[None, :]
                at = np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(rows)), pa.array(bound >= many), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[use]))],
                    ["word", "open", "keys"],
                )

    return words.select("word").mapInArrow(run, "word string, open boolean, keys array<bigint>")


def links(index: DataFrame) -> DataFrame:
    """``a, b``: pairs of words at edit distance one that share a listed gram."""
    length, place = 1 << 20, 1
    left = index.select(F.col("word").alias("a"), F.explode("keys").alias("key"))
    shifts = F.array(*(F.struct(F.lit(s).alias("by"), F.lit(s == 0).alias("same")) for s in (0, length, length + place)))
    right = index.select(F.col("word").alias("b"), F.explode("keys").alias("own"))
    right = right.select("b", "own", F.explode(shifts).alias("shift"))
    right = right.select("b", (F.col("own") - F.col("shift.by")).alias("met"), F.col("shift.same").alias("same"))
    near = (F.col("key") == F.col("met")) & (~F.col("same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, near).select("a", "b").distinct()


def near_words(words: DataFrame, longest: tuple[int, ...] = LONGEST, share: float = SHARE) -> DataFrame:
    """``a, b`` for every pair of distinct words that differ by one code point, each pair once."""
    counted = dictionary(words, max(longest), share)
    found = None
    for q in longest:
        index = stored(listed(words, Grams.of(counted, q)), "index") if counted else words.selectExpr("word", "false AS open", "array(0L) AS keys")
        met = links(index)
        found = met if found is None else found.unionByName(met)
        words = index.where("open").select("word")
    return stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form, by doubling of the way gone; counts at least double from
    word to form, so the ways are short."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("at"), F.col("root").alias("next"))
        gone = ways.join(on, F.col("root") == F.col("at"), "left")
        if gone.where("next IS NOT NULL").isEmpty():
            return ways
        ways = stored(gone.select("word", F.coalesce("next", "root").alias("root")), "ways")


def variants(docs: DataFrame, factor: int = 2, **options) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``; see the module's text."""
    words = vocabulary(docs, **options)
    pairs = near_words(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partner = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    best = both.join(partner, "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best")
    )
    rows = words.join(best, F.col("word") == F.col("a"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")
    )
    taken = F.col("form_n") >= factor * F.col("n")
    rows = rows.withColumn("form", F.when(taken, F.col("form"))).withColumn("form_n", F.when(taken, F.col("form_n")))
    rows = stored(rows, "forms")
    ends = roots(rows.where("form IS NOT NULL")).withColumnRenamed("word", "way")
    return rows.join(ends, F.col("word") == F.col("way"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: The same in DuckDB: CRC-32 by its table, and words that meet under one of their deletions.
VARIANTS_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda b : list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(x AS BIGINT) FOR x IN range(8)]),
    lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
), own AS (
  SELECT doc_id, word, count(*) AS n, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', word))) AS h FROM runs GROUP BY ALL
), marked AS (
  SELECT word, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(length(h) // 2), lambda i : (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
    lambda c, b : xor(t.crc[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM own, t
), written AS (
  SELECT CASE WHEN h % 97 = 0 THEN concat(left(word, CAST(h % length(word) AS BIGINT)), substr(word, CAST(h % length(word) AS BIGINT) + 2)) ELSE word END AS word, n
  FROM marked
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), keys AS (
  SELECT word, word AS k FROM words
  UNION SELECT word, concat(left(word, i), substr(word, i + 2)) FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT DISTINCT a.word AS a, b.word AS b FROM keys a JOIN keys b USING (k)
  WHERE (length(a.word) = length(b.word) + 1 AND k = b.word) OR (length(b.word) = length(a.word) + 1 AND k = a.word)
    OR (length(a.word) = length(b.word) AND len(list_filter(range(1, length(a.word) + 1), lambda i : substr(a.word, CAST(i AS BIGINT), 1) <> substr(b.word, CAST(i AS BIGINT), 1))) = 1)
), best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM pairs JOIN words ON word = b GROUP BY a
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON word = a
), ways AS (
  SELECT word, word AS here FROM forms
  UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.here WHERE forms.form IS NOT NULL
), ends AS (
  SELECT ways.word, here AS root FROM ways JOIN forms ON forms.word = ways.here WHERE forms.form IS NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN ends USING (word)
"""
