import hashlib
import random
import re

import pytest
from samples import documents, empty, lower

from demandspark.llm import decontamination as op

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, lower(text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        own = words(text)
        for a in range(max(1, len(own) - size + 1) if own else 0):
            windows.setdefault(tuple(own[a : a + size]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for n in lengths:
            for a in range(len(own) - n + 1):
                w = tuple(own[a : a + n])
                if w in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[w]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def planted(spark):
    docs = documents(spark)
    texts = [r["text"] for r in docs.collect() if r["text"] and len(words(r["text"])) > 40]
    rng = random.Random(1)
    items = []
    for k in range(30):
        own = words(rng.choice(texts))
        a = rng.randrange(len(own) - 25)
        items.append((k, " ".join(own[a : a + rng.choice([3, 9, 10, 14, 25])]).upper() if k % 2 else ", ".join(own[a : a + 12])))
    items += [(40, None), (41, ""), (42, "..."), (43, "zzz not there at all"), (44, "one"), (45, "one"), (45, "one two"), (46, "of of the")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = planted(spark)
    tests = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "item_id AS doc_id", "text AS spans")
    found = op.contamination(docs, tests)
    got = sorted((tuple(r)[:6] for r in found.collect()), key=repr)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert got == want and sum(r[5] for r in want) > 20
    for r in found.collect():
        assert r["n_hit"] == sum(s["end"] - s["begin"] for s in r["spans"])


def test_blocks_and_small_segments_change_nothing(spark):
    docs, items = planted(spark)
    tests = spark.createDataFrame(items, "item_id long, text string")
    segments = op.index(docs, segment_tokens=500)
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_words, str(r.spans))
    one = sorted(op.search(segments, tests).collect(), key=key)
    many = sorted(op.search(segments, tests, block_bytes=600).collect(), key=key)
    assert [(r.doc_id, r.n_words, r.spans, sorted(r["items"])) for r in one] == [
        (r.doc_id, r.n_words, r.spans, sorted(r["items"])) for r in many
    ]


def test_items_without_an_id_are_searched_but_not_listed(spark):
    own = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(own[:14])), (3, "nothing of it")], "doc_id long, text string")
    rows = [(None, " ".join(own[18:])), (None, " ".join(own[18:])), (None, "not there"), (7, " ".join(own[:12]))]
    items = spark.createDataFrame(rows, "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op.contamination(docs, items).collect()}
    digest = [hashlib.sha256(x).hexdigest() for x in (b"", b"7")]
    assert got == {1: (24, 1, digest[1], True), 2: (12, 1, digest[1], True), 3: (0, 0, digest[0], False)}
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in op.contamination(docs, items.where("item_id IS NULL")).collect()}
    assert got == {1: (12, 0, digest[0]), 2: (0, 0, digest[0]), 3: (0, 0, digest[0])}
    pieces = op.search(op.index(docs), items, block_bytes=80).collect()  # several blocks
    assert {r.doc_id: ([tuple(s) for s in r.spans], r["items"]) for r in pieces} == {
        1: ([(0, 12), (18, 30)], ["7"]), 2: ([(0, 12)], ["7"]), 3: ([], []),
    }


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x quick a brown b fox y"), (2, "fox quick q q q q q brown"), (3, "quick brown")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown fox")], "item_id long, text string")
    near = {r.doc_id: [tuple(s) for s in r.spans] for r in op.search(op.index(docs), items, distance=4).collect()}
    assert near == {1: [(1, 6)], 2: [], 3: []}
    with pytest.raises(ValueError):
        op.search(op.index(docs), items, window=op.GAP)


def test_empty_tables(spark):
    items = spark.createDataFrame([(7, "quick brown fox")], "item_id long, text string")
    assert op.contamination(empty(spark), items).collect() == []
    got = op.contamination(documents(spark, use_given=False, long_words=20), items.where("false")).collect()
    assert got and not any(r.contaminated for r in got)


def test_sql_counts_windows_of_items_without_id_and_long_items_are_cut(spark):
    import duckdb
    import random

    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(2000)]
    docs = spark.createDataFrame(
        [(1, " ".join(words[500:530])), (2, "two words here"), (3, " ".join(words[1990:])), (4, None), (5, "Two, WORDS!")], "doc_id long, text string"
    )
    items = spark.createDataFrame([(None, "two words"), ("long", " ".join(words)), ("x", None), ("y", "")], "item_id string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    cursor = con.execute(op.CONTAMINATION_SQL)
    names = [d[0] for d in cursor.description]
    found = op.contamination(docs, items).select(*names)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    by_id = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in found.collect()}
    assert by_id[2] == (2, 0) and by_id[5] == (2, 0) and by_id[1] == (30, 1) and by_id[3] == (10, 1)
    # the same through pieces of the long item, which is longer than a block
    tests = items.selectExpr("item_id AS item", "text").where("text IS NOT NULL")
    pieces = op.in_pieces(tests, 10, 500, 64)
    assert pieces.where("item = 'long'").count() == 32
    again = op.search(op.index(docs), pieces.selectExpr("item AS item_id", "text")).collect()
    assert {r["doc_id"]: sum(s["end"] - s["begin"] for s in r["spans"]) for r in again} == {k: v[0] for k, v in by_id.items()}
