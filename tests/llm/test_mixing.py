import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, WORDS, clashing, documents, empty

from demandspark.llm import mixing as op


def brute_targets(sizes):
    """Sharing by weight, round after round, until no source is above its room."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return target
        share = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if share * weight[s] >= 3 * sizes[s]]
        if not above:
            return target | {s: share * weight[s] for s in open_}
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            full.add(s)


def check(docs, rows):
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(WORDS, r["text"] or ""))
    want, taken = brute_targets(sizes), Counter()
    by_target = defaultdict(set)
    for s, t in want.items():
        by_target[sizes[s], round(t, 6)].add(s)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        assert (r.source_size, round(r.target, 6)) in by_target
        taken[r.source_size, round(r.target, 6)] += r.taken
    for key, sources in by_target.items():
        assert abs(taken[key] - len(sources) * key[1]) <= len(sources), (key, taken[key])


def test_documents(spark):
    docs = documents(spark)
    rows = op.mix(docs).collect()
    sizes = sorted((r["doc_id"] is not None, r["doc_id"], len(re.findall(WORDS, r["text"] or ""))) for r in docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id, r["size"]) for r in rows) == sizes
    check(docs, rows)
    assert sorted(op.mix(docs.repartition(5)).collect(), key=repr) == sorted(rows, key=repr)


def test_small_sources_overflow(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(900), "en", rng.choice([None, "a", "b", "big", "big", "big", "big", "é", "Z"]), 1) for k in range(150)]
    rows += [(900, "one", "en", "tiny", 1), (901, "", "en", "nothing", 1)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    check(docs, op.mix(docs).collect())


def test_hypergeometric_draws(spark):
    total, marked, taken, n = 300, 90, 120, 20_000
    df = spark.range(n).select(op.hypergeometric(*(F.lit(x).cast("long") for x in (total, marked, taken)), op.uniform(F.col("id"))).alias("x"))
    found = np.array([r.x for r in df.collect()])
    want = np.random.default_rng(0).hypergeometric(marked, total - marked, taken, n)
    assert abs(found.mean() - want.mean()) < 0.15 and abs(found.std() - want.std()) < 0.1
    edge = spark.sql("SELECT explode(array(named_struct('n', 10L, 'k', 10L, 't', 4L), named_struct('n', 10L, 'k', 0L, 't', 4L), "
                     "named_struct('n', 0L, 'k', 0L, 't', 0L), named_struct('n', 5L, 'k', 3L, 't', 5L))) AS s")  # fmt: skip
    got = edge.select(op.hypergeometric(F.col("s.n"), F.col("s.k"), F.col("s.t"), F.lit(0.3)).alias("x")).collect()
    assert [r.x for r in got] == [4, 0, 0, 3]


def test_tree_keeps_quotas_and_sizes(spark):
    quotas = [1000, 0, 37, 5, 261, 1]
    df = spark.createDataFrame(list(enumerate(quotas)), "number int, quota long")
    rows = op.split_tree(df, 16).collect()
    counts = np.array([r["counts"] for r in sorted(rows)])
    assert counts.shape == (16, 6) and (counts >= 0).all() and counts.sum(axis=0).tolist() == quotas
    assert np.ptp(counts.sum(axis=1)) <= 1
    assert np.abs(counts[:, 0] - 1000 / 16).max() < 40
    with pytest.raises(ValueError):
        op.split_tree(df, 3)


def test_draws_are_disjoint_and_shards_even(spark, tmp_path):
    docs = documents(spark)
    drawn = op.draws(op.sized(docs), shards=8)
    rows = drawn.where("`pass` IS NOT NULL").collect()
    assert len({(r.doc_id, r.source, r.mark, r["copy"], r.block, r["pass"]) for r in rows}) == len(rows)
    shards = Counter(r.shard for r in rows)
    assert sorted(shards) == list(range(8)) and max(shards.values()) - min(shards.values()) <= 1
    assert all(0 < r.words <= op.BLOCK for r in rows)
    op.shard_files(drawn, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == len(rows)
    assert len(list((tmp_path / "mix" / "shard=3").glob("*.parquet"))) == 1


def test_rows_of_the_mix(spark):
    docs = documents(spark)
    mixed = op.mixed(docs)
    assert mixed.columns == docs.columns and [f.dataType for f in mixed.schema] == [f.dataType for f in docs.schema]
    words = Counter()
    whole = defaultdict(list)
    for r in docs.collect():
        whole[r["doc_id"], r["source"]].append(re.findall(WORDS, r["text"] or ""))
    for r in mixed.collect():
        own = re.findall(WORDS, r["text"])
        words[r["doc_id"], r["source"]] += len(own)
        # the words come from one of the documents of that id, in their order
        assert any(own == w or all(x in w for x in own) for w in whole[r["doc_id"], r["source"]])
    taken = Counter()
    sources = {}
    for r in op.draws(op.sized(docs)).collect():
        taken[r.doc_id, r.source] += r.words
        sources[r.doc_id] = r.source
    assert +words == +taken


def test_native_and_empty(spark):
    plan = op.mix(documents(spark, use_given=False, long_words=300))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert op.mix(empty(spark)).collect() == [] and op.mixed(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], SCHEMA)
    assert [(r["size"], r.target, r.taken) for r in op.mix(blank).collect()] == [(0, 0.0, 0)] * 2
