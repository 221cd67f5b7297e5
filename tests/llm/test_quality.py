import zlib

import numpy as np
import pytest
from samples import clashing, documents, empty

from demandspark.llm import quality as op

SF = "/root/testdata/sf0.1"


def test_features_and_curve():
    good, bad = b"the quick brown fox jumps over " * 40, b"$$$ | %%% ### !! " * 60
    pairs = op.Model([(good, bad)], (1.0, 0.0, 0.0)).compressors()
    assert op.features(good[:300], pairs)[0] > 0.2 and op.features(bad[:300], pairs)[0] < -0.2
    assert op.features(b"", pairs) == (0, 0) and op.features(b"ab" * 5000, pairs)[1] < -2
    x = np.array([[-1.0, 0], [-0.5, 1], [0.5, 0], [1.0, 1]] * 50)
    slope, other, offset = op.curve(x, (x[:, 0] > 0).astype(float), np.ones(len(x)))
    assert slope > 1 and abs(other) < slope and len(op.curve(x[:, :1], x[:, 1], np.ones(len(x)))) == 2


def test_odd_rows_and_whole_texts(spark):
    docs = documents(spark)
    given = [(r["doc_id"], r["doc_id"] % 2, 0) for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 200]
    odd = [(None, 1, 0), (10_000, None, 0), (3, 1, 0), (3, 0, 0), (4, 7, 0)]
    labels = clashing(spark.createDataFrame(given + odd, "doc_id long, quality int, toxic int"))
    found = op.judged(docs, labels).collect()
    assert len(found) == docs.count()
    for r in found:
        key = None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == bool(key) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    model = op.fit(docs, labels, op.HELD_OUT)
    pairs = model.compressors()
    want = sorted(((r["doc_id"], op.features((r["text"] or "").encode(), pairs)[0]) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.difference) for r in op.score(docs, model).collect()), key=repr) == want
    again = {(r.doc_id, r.score) for r in op.judged(docs.repartition(7), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in found}


def test_too_few_labels_and_empty_tables(spark):
    docs = documents(spark, use_given=False, long_words=100)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in op.judged(docs, none).collect()} == {0.5}
    assert op.judged(empty(spark), none).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = op.judged(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    score, label = (np.array([r[c] for r in held]) for c in ("score", "quality"))
    right = np.mean([r.predicted == r.quality for r in held])
    ranks = np.argsort(np.argsort(score)) + 1
    good = label == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert right > 0.97 and auc > 0.98 and np.mean(score[good] >= 0.3) > 0.99
    assert abs(score.mean() - label.mean()) < 0.05  # calibrated on the whole
    assert len(held) > 500
    with pytest.raises(ValueError):
        op.judged(docs, labels, float("nan"))
