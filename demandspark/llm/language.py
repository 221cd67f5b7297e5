"""Language identification with a blended-spectrum string kernel, Nystroem landmarks and ridge regression.

A text is read in blocks of ``BLOCK`` characters. A block's features are the letter n-grams (lengths 1
to 3, lower case, any other character a gap) that are present in it, hashed to ``FEATURES`` places; the
kernel of two blocks is the number of features they share over the geometric mean of their numbers.
Landmark blocks span the Nystroem feature space, in which one ridge regression per language separates
it from the rest. A block's scores are one product of its kernel row with the solved weights, computed
for many blocks at once: presence matrix x (landmark presences x weights). A text's scores are
the mean over all its blocks, weighted by letters.

The fit takes about ``sample_rows`` documents of each language, at most twice as many (chosen by a hash
of the id, texts of up to ``sample_bytes`` bytes); every text is scored whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0. Null ``lang`` values are
not learned from. With one language all texts are given it; with none, all are ``und``. Ties go to the
language first in code-point order. Repeated documents are scored one by one, empty tables give empty
results, further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.tables import ids_and_texts, small_batches, stored, utf8

BLOCK = 2048
FEATURES = 1 << 14
LONGEST = 3
UNDETERMINED = "und"


@cache
def letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all other characters."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low[0])
    return out


def presence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Presence matrix (blocks x features), and each block's text and number of letters."""
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    size = np.diff(begins)
    blocks = -(-size // BLOCK)
    text = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(chars)) - np.repeat(begins[:-1], size)
    block = np.repeat(np.cumsum(blocks) - blocks, size) + nth // BLOCK
    symbol = letters()[chars].astype(np.uint64)
    out = np.zeros((len(text), FEATURES), np.uint8)
    left = np.repeat(begins[1:], size) - np.arange(len(chars))  # characters to the end of the text
    gram = np.zeros(len(chars), np.uint64)
    for n in range(1, LONGEST + 1):
        following = np.zeros_like(symbol)
        following[: len(symbol) - n + 1] = symbol[n - 1 :]
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + following + np.uint64(n)
        place = (gram * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(50)).astype(np.int64)
        real = (left >= n) & (symbol > 0)
        out[block[real], place[real]] = 1
    return out, text, np.bincount(block, symbol > 0, minlength=len(text))


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared features over the geometric mean of the numbers of features."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    norm = np.sqrt(np.maximum(1, a.sum(axis=1))[:, None] * np.maximum(1, b.sum(axis=1))[None, :])
    return a @ b.T / norm


@dataclass
class Model:
    """Languages, and the product of landmark presences and weights (features x languages)."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """One-versus-rest scores of blocks, a batched matrix product."""
        out = np.zeros((len(features), len(self.languages)), np.float32)
        for a in range(0, len(features), 256):
            part = features[a : a + 256].astype(np.float32)
            out[a : a + 256] = part @ self.weights / np.sqrt(np.maximum(1, part.sum(axis=1)))[:, None]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        features, text, weight = presence(*utf8(texts))
        total = np.bincount(text, weight, minlength=len(texts))
        scores = self.scores(features) * weight[:, None]
        mean = np.stack([np.bincount(text, s, minlength=len(texts)) for s in scores.T], axis=1) if self.languages else None
        if mean is None:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        mean /= np.maximum(1, total)[:, None]
        best = mean.argmax(axis=1)
        names = [self.languages[k] if t else UNDETERMINED for k, t in zip(best, total, strict=True)]
        sure = np.clip((mean.max(axis=1) + 1) / 2, 0, 1)
        return names, np.where(total > 0, sure, 0.0)


def solve(texts: list[str], names: list[str], landmarks: int, most_blocks: int, ridge: float) -> Model:
    """Nystroem kernel ridge regression, one language against the rest, on blocks of the texts."""
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32))
    parts = [presence(*utf8(pa.array(texts[a : a + 200], pa.string()))) for a in range(0, len(texts), 200)]
    features = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([p[1] + a for p, a in zip(parts, range(0, len(texts), 200), strict=True)])
    some = np.flatnonzero(np.concatenate([p[2] for p in parts]) > 0)
    if not len(some):
        return Model(languages, np.zeros((FEATURES, len(languages)), np.float32))
    shuffled = np.random.default_rng(7).permutation(some)[:most_blocks]
    marks, features = features[shuffled[:landmarks]], features[shuffled]
    target = np.where(np.array(names)[owner[shuffled]][:, None] == np.array(languages)[None, :], 1.0, -1.0)
    among = kernel(marks, marks).astype(np.float64)
    value, vector = np.linalg.eigh(among)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T  # inverse square root
    mapped = kernel(features, marks).astype(np.float64) @ root
    gram = mapped.T @ mapped + ridge * len(mapped) * np.eye(len(marks))
    dual = root @ np.linalg.solve(gram, mapped.T @ target)
    scaled = marks.astype(np.float32) / np.sqrt(np.maximum(1, marks.sum(axis=1, dtype=np.int64)))[:, None]
    return Model(languages, scaled.T.astype(np.float32) @ dual.astype(np.float32))


def fit(
    docs: DataFrame, held_out: str, sample_rows: int = 400, sample_bytes: int = 1 << 16, landmarks: int = 384,
    most_blocks: int = 4000, ridge: float = 1e-4, most_languages: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Learn from ``docs`` for which the SQL condition ``held_out`` on ``doc_id`` is false.

    The sample has some ``2 * sample_rows`` rows of each language at most, of the ``most_languages`` most frequent ones.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(f"text IS NOT NULL AND lang IS NOT NULL AND NOT ({held_out})")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    counts = stored(counts, "languages")  # one row a language, of known size
    many = counts.count()
    chance = F.lit(sample_rows) / F.col("count")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.where(F.octet_length("text") <= sample_bytes).join(counts, "lang").where(drawn < chance)
    most = 2 * sample_rows * max(1, many)
    sample = rows.select("doc_id", "text", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).collect()
    return solve([r["text"] for r in sample], [r["lang"] for r in sample], landmarks, most_blocks, ridge)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            names, sure = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(sure.astype(np.float64))], ["doc_id", "lang_pred", "score"]
            )

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


#: Rows never learned from.
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2, false)"


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of all documents, learned from those not held out."""
    found = identify(docs, fit(docs, HELD_OUT))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")
