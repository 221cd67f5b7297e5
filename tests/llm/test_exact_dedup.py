import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from samples import documents, empty

from demandspark.llm import exact_dedup as op
from demandspark.llm.exact_dedup import CountingQuotientFilter as Filter


def made(counts: dict[int, int], quotient_bits=4, remainder_bits=6):
    keys = np.array(sorted(counts), np.uint64)
    return Filter.build(keys, np.array([counts[int(k)] for k in keys]), quotient_bits, remainder_bits)


def test_filter_round_trip_and_merge():
    rng = random.Random(0)
    for _ in range(300):
        several = [{rng.randrange(1 << 10): rng.choice([1, 1, 2, 3, 4, 5, 20, 60]) for _ in range(rng.randrange(40))} for _ in range(3)]
        filters = [Filter.of_row(*made(c).to_row()) for c in several]
        for f, c in zip(filters, several, strict=True):
            prints, counts = f.entries()
            assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == c
        total = Counter()
        for c in several:
            total.update(c)
        prints, counts = op.merged(filters)
        assert prints.tolist() == sorted(total)
        assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == dict(total)


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")].append(r["doc_id"])
    out, stayed = [], set()
    for r in rows:
        text = re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "")
        own = groups[text]
        keep = min((i for i in own if i is not None), default=None)
        stays = r["doc_id"] == keep and text not in stayed
        if stays:
            stayed.add(text)
        out.append((r["doc_id"], keep, len(own), stays, hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    docs = documents(spark)
    got = [tuple(r) for r in op.exact_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs.collect()), key=repr)


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(op.F, "xxhash64", lambda *c: op.F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in op.exact_duplicates(docs).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True)}


def test_empty_table(spark):
    assert op.exact_duplicates(empty(spark)).collect() == []


def test_one_row_stays_where_ids_repeat_or_are_missing(spark):
    rows = [(7, "a  b"), (7, "a b"), (9, "a b"), (None, "a b"), (None, "c"), (None, "c"), (None, "c"), (3, "d")]
    got = op.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    kept = sorted((r["doc_id"], r["group_size"]) for r in got if r["kept"] and r["doc_id"] is not None)
    assert kept == [(3, 1), (7, 4)] and sum(r["kept"] for r in got) == 3
