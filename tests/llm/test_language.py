import zlib

import numpy as np
import pyarrow as pa
from samples import documents, empty

from demandspark.llm import language as op
from demandspark.llm.tables import utf8


def test_kernel_counts_shared_features():
    found, text, letters = op.presence(*utf8(pa.array(["abab", "ab", "", "12", "Ab"])))
    assert text.tolist() == [0, 1, 3, 4] and letters.tolist() == [4, 2, 0, 2]
    # ab: a, b, ab; abab: a, b, ab, ba, aba, bab
    assert found.sum(axis=1).tolist() == [6, 3, 0, 3]
    assert np.allclose(op.kernel(found, found)[0], [1, 3 / np.sqrt(18), 0, 3 / np.sqrt(18)])


def test_grams_do_not_cross_texts_or_lose_blocks():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcxyzéñ 1"), int(n))) for n in rng.integers(0, 5000, 20)]
    whole, text, _ = op.presence(*utf8(pa.array(texts)))
    for k, t in enumerate(texts):
        own, _, _ = op.presence(*utf8(pa.array([t])))
        assert (whole[text == k] == own).all()


def test_batched_scores_are_the_kernel_machine():
    texts = [w * 30 for w in ("the and of ", "der und die ", "le et la ", "to the with ", "nicht der ein ", "la du des ")]
    names = ["en", "de", "fr", "en", "de", "fr"]
    model = op.solve(texts, names, 4, 100, 1e-3)
    assert model.predict(pa.array(texts))[0] == names
    assert model.predict(pa.array([None, "", "123 !", "the of and"]))[0] == ["und", "und", "und", "en"]


def test_odd_rows(spark):
    docs = documents(spark)
    found = op.languages(docs).collect()
    lettered, count = {}, {}
    for d in docs.collect():
        key = repr(d["doc_id"]), any(op.letters()[ord(c)] for c in d["text"] or "")
        lettered[key] = lettered.get(key, 0) + 1
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)
        key = repr(r.doc_id), r.lang_pred != "und"
        count[key] = count.get(key, 0) + 1
    assert count == lettered
    assert {r.lang_pred for r in found} <= {"und", "en", "de", "fr", "es"}


def test_nothing_to_learn_from(spark):
    docs = documents(spark, use_given=False, long_words=50).withColumn("lang", op.F.lit(None).cast("string"))
    assert {r.lang_pred for r in op.languages(docs).collect()} == {"und"}
    assert op.languages(empty(spark)).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = op.languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 2000 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def grams(text):
    """Distinct 1- to 3-grams that begin with a letter, other characters alike."""
    symbols = [int(op.letters()[ord(c)]) for c in text]
    return {tuple(symbols[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1) if symbols[i]}


def test_query_is_kernel_ridge_regression_on_sets_of_grams(spark):
    """With fewer rows than landmarks the fit is the exact one: (K + ridge * n) weights = targets."""
    rng = np.random.default_rng(3)
    words = {"en": "the and of with that this from", "de": "der die und nicht ein mit auf", "fr": "le la et les dans pour une"}
    rows = [(k, " ".join(rng.choice(words[lang].split(), 6)), lang) for k, lang in enumerate(rng.choice(list(words), 60).tolist())]
    rows += [(900, "12 !", "en"), (901, None, "en"), (902, "the und le", None)]
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[2] and r[1] and grams(r[1])]

    def kernel(a, b):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])

    sets, names = [grams(r[1]) for r in learned], sorted(words)
    target = np.array([[1.0 if r[2] == n else -1.0 for n in names] for r in learned])
    weights = np.linalg.solve(kernel(sets, sets) + 1e-4 * len(sets) * np.eye(len(sets)), target)
    found = {r.doc_id: r for r in op.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(found) == len(rows)
    for k, text, _ in rows:
        if not text or not grams(text):
            assert (found[k].lang_pred, found[k].score) == ("und", 0)
            continue
        scores = (kernel([grams(text)], sets) @ weights)[0]
        assert found[k].lang_pred == names[scores.argmax()] or np.ptp(np.sort(scores)[-2:]) < 0.05
        assert abs(found[k].score - min(1, max(0, (scores.max() + 1) / 2))) < 0.03
