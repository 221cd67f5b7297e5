"""Quality classifier by compression: dictionaries of good and of bad text, and what they save.

Pairs of zstandard dictionaries are trained, one on good and one on bad labelled text. A text is
compressed in chunks with either; the difference of the compressed sizes over their sum, averaged over
the pairs, is high where the good dictionaries help more. A logistic curve turns that difference, with
the log of the compression ratio (text that repeats itself is small for any dictionary), into the
probability of the good label. Each pair leaves out one fold of the labelled texts, and the curve is fitted on
texts scored by the pair that has not seen them.

The fit takes at most ``sample_rows`` rows of a class (those with the smallest hash of their id, texts
of up to ``longest`` bytes) and ``sample_bytes`` of their text; every text is scored whole.

Defined cases: null and empty texts have difference 0 and ratio 1 and get the curve's value there.
Labels that are null or contradict each other for a ``doc_id`` are not learned from; repeated documents
are scored one by one. Without enough labels of both classes every score is 0.5. Empty tables give
empty results, further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.tables import ids_and_texts, small_batches, utf8

CHUNK = 512
LEVEL = 3
FOLDS = 3


@dataclass
class Model:
    """Pairs of dictionaries (good, bad) and the weights of difference, log ratio and 1 on the logit."""

    pairs: list[tuple[bytes, bytes]]
    weights: tuple[float, float, float]

    def compressors(self) -> list[tuple]:
        return [tuple(map(compressor, pair)) for pair in self.pairs]

    def score(self, features: np.ndarray) -> np.ndarray:
        logit = features @ np.array(self.weights[:2]) + self.weights[2]
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    entries = zstandard.ZstdCompressionDict(content)
    entries.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=entries, write_content_size=False)


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def features(text: bytes, pairs: list[tuple]) -> tuple[float, float]:
    """Mean over the pairs of (bad size - good size) / their sum, and the log of size over length."""
    parts = chunks(text)
    if not parts or not pairs:
        return 0.0, 0.0
    differences, total = [], 0
    for pair in pairs:
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in pair)
        differences.append((bad - good) / (bad + good))
        total += bad + good
    return sum(differences) / len(pairs), math.log(total / (2 * len(pairs) * len(text)))


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, ...]:
    """Weighted logistic regression by damped Newton steps, a little ridge; weights of the columns of x and of 1."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    a = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.diag([1e-3] * x.shape[1] + [1e-6]) * weight.sum()
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple((w / np.append(scale, 1.0)).tolist())


def fit(
    docs: DataFrame, labels: DataFrame, held_out: str, label_col: str = "quality", sample_rows: int = 3000,
    sample_bytes: int = 12 << 20, longest: int = 1 << 17, dictionary_bytes: int = 65536,
) -> Model:
    """Learn from labelled ``docs`` (``doc_id, text``) for which the SQL condition ``held_out`` is false."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    own = own.where(f"doc_id IS NOT NULL AND label IN (0, 1) AND NOT ({held_out})")
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high")
    total = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    order = F.xxhash64("doc_id")
    for label in texts:  # sample_rows ids at most, so the join is by a bounded broadcast
        ids = own.where(F.col("label") == label).orderBy(order, "doc_id").limit(sample_rows).select("doc_id")
        rows = ids_and_texts(docs).join(F.broadcast(ids), "doc_id").where("text <> ''")
        rows = rows.where(F.octet_length("text") <= longest).orderBy(order, "doc_id", "text").limit(sample_rows)
        spent = 0
        for row in rows.select("text").toLocalIterator():
            spent += len(text := row["text"].encode())
            if spent > sample_bytes:
                break
            texts[label].append(text)
    return learned(texts, total, dictionary_bytes)


def learned(texts: dict[int, list[bytes]], total: dict[int, int], dictionary_bytes: int = 65536) -> Model:
    """The model of labelled texts; ``total`` is the number of all labels of either class."""
    if not all(len(t) >= FOLDS for t in texts.values()):
        return Model([], (0.0, 0.0, 0.0))
    pairs = []
    for fold in range(FOLDS):
        learn = {k: [t for i, t in enumerate(v) if i % FOLDS != fold] for k, v in texts.items()}
        even = min(sum(map(len, v)) for v in learn.values())  # as much text for either dictionary
        pair = []
        for label in (1, 0):
            parts, spent = [], 0
            for text in learn[label]:
                if spent <= even:
                    parts += chunks(text)
                    spent += len(text)
            pair.append(dictionary(parts, dictionary_bytes))
        pairs.append(tuple(pair))
    unseen = Model(pairs, (0.0, 0.0, 0.0)).compressors()
    rows = [(*features(t, [unseen[i % FOLDS]]), k) for k, v in texts.items() for i, t in enumerate(v)]
    x, y = np.array([r[:2] for r in rows], float), np.array([r[2] for r in rows], float)
    share = {k: total[k] / (y == k).sum() for k in texts}  # classes as frequent as among all labels
    weight = np.where(y == 1, share[1], share[0])
    return Model(pairs, curve(x, y, weight / weight.sum() * len(weight)))


def dictionary(parts: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, parts)) // 4)), parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, difference, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value.compressors()
        for batch in small_batches(batches, "text"):
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            found = np.array([features(raw[a:b], pairs) for a, b in zip(at[:-1], at[1:], strict=True)], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found[:, 0]), pa.array(shared.value.score(found))], ["doc_id", "difference", "score"]
            )

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, difference double, score double")


def passing(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``least``; nothing is shuffled or stored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value.compressors()
        for batch in small_batches(batches, text_col):
            data, at = utf8(batch.column(text_col))
            raw = data.tobytes()
            found = np.array([features(raw[a:b], pairs) for a, b in zip(at[:-1], at[1:], strict=True)], float)
            yield batch.filter(pa.array(shared.value.score(found) >= least))

    return docs.mapInArrow(run, docs.schema)


#: Rows never learned from.
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0, false)"


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Scores of all documents with the verdict 1 (``score`` at least ``threshold``) or 0."""
    if not math.isfinite(threshold):
        raise ValueError("threshold must be a number")
    return score(docs, fit(docs, labels, HELD_OUT)).select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "difference",
    )
