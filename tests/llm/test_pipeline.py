import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from samples import SF, documents, empty
from tokenizers import Tokenizer

import __spark_entry__ as contract
from demandspark.llm import decontamination, mixing, quality, simhash
from demandspark.llm.components import components


def stages(spark, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_each_decision_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged, kept, clean, mixed, tokens = stages(spark, docs)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels, tests = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    assert ids(judged) == ids(quality.judged(docs, labels).where("predicted = 1")) < ids(docs)
    assert ids(kept) == {r.component_id for r in simhash.near_duplicates(judged).collect()} < ids(judged)
    assert ids(clean) == ids(decontamination.contamination(kept, tests).where("NOT contaminated")) < ids(kept)
    for df in (judged, kept, clean, mixed):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    taken = mixing.mix(clean).where("taken > 0")
    assert ids(mixed) == ids(taken)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r.doc_id, *library.encode(r.text, add_special_tokens=False).ids, 2) for r in mixed.collect())
    assert Counter((r.doc_id, *r.tokens) for r in tokens.collect()) == want
    spark.catalog.clearCache()


def test_rows_without_documents_or_ids(spark):
    assert [df.count() for df in stages(spark, empty(spark))] == [0] * 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).selectExpr("CAST(NULL AS bigint) AS doc_id", "CAST(NULL AS string) AS text", "lang", "CAST(NULL AS string) AS source", "n_chars")
    out = stages(spark, docs.limit(20).unionByName(odd).unionByName(odd).unionByName(docs.limit(3)))
    assert all(df.count() for df in out)
    spark.catalog.clearCache()


def ragged(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def prose(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(120))


def test_near_duplicates_leave_one_row_of_each_component(spark):
    a, b, c, d = (prose(k) for k in range(4))
    rows = [
        (5, a, "en", "w", 1), (9, a, "en", "w", 1),  # group A: ids 5 and 9
        (5, b, "en", "w", 1), (3, b, "en", "w", 1),  # group B: id 5 again, and 3
        (None, c, "en", "w", 1), (None, c, "de", "w", 1), (None, a, "en", "w", 1),  # only null ids in C; one more of A
        (7, d, "en", "w", 1), (7, d, "en", "w", 1), (7, d, "en", "w", 1),  # the smallest id of D repeats
    ]
    out = corpus_pipeline.near_dedup_stage(spark, ragged(spark, rows), SF)
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter([(5, a), (3, b), (None, c), (7, d)])
    again = corpus_pipeline.near_dedup_stage(spark, ragged(spark, rows[::-1]), SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_quality_and_decontamination_judge_rows_not_ids(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    labels, tests = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    for stage, verdicts in (
        (corpus_pipeline.quality_stage, quality.judged(given, labels).selectExpr("doc_id", "predicted = 0 AS bad")),
        (corpus_pipeline.decontaminate_stage, decontamination.contamination(given, tests).selectExpr("doc_id", "contaminated AS bad")),
    ):
        bad = {r.doc_id for r in verdicts.where("bad").collect()}
        rows = [tuple(r) for r in given.select("doc_id", "text", "lang", "source", "n_chars").collect()]
        assert bad and len(bad) < len(rows)
        one_bad, one_good = next(r for r in rows if r[0] in bad), next(r for r in rows if r[0] not in bad)
        extra = [(None, *one_bad[1:]), (None, *one_good[1:]), (one_good[0], *one_bad[1:]), (one_bad[0], *one_good[1:])]
        got = Counter((r.doc_id, r.text) for r in stage(spark, ragged(spark, rows + extra), SF).collect())
        want = [r for r in rows if r[0] not in bad] + [extra[1], extra[3]]
        assert got == Counter(r[:2] for r in want)


def test_registered():
    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and set(contract.oracle_sql()) <= set(names)


def test_near_dedup_joins_keys_by_shuffle(spark, monkeypatch):
    """Fingerprints with their keys are never broadcast, however small Spark takes them for."""
    plans = []

    def linked(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges)

    monkeypatch.setattr(simhash, "components", linked)
    docs = documents(spark)
    assert 0 < corpus_pipeline.near_dedup_stage(spark, docs, "").count() < docs.count()
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
