import re

import numpy as np
import xxhash
from samples import WORDS, documents, empty, lower

from demandspark.llm import simhash as op
from demandspark.llm.components import components


def fingerprint(text: str | None) -> int:
    words = re.findall(WORDS, lower(text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints: list[int], ids: list, most: int = 4) -> list:
    """Smallest id reachable, by comparing everything with everything."""
    owner = list(range(len(prints)))

    def find(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                owner[find(i)] = find(j)
    best = {}
    for i, k in enumerate(ids):
        if k is not None:
            best[find(i)] = min(best.get(find(i), k), k)
    return [best.get(find(i)) for i in range(len(ids))]


def test_golay_code_is_perfect():
    table = op.decoder()
    assert (np.bincount(table, minlength=4096) == 2048).all()
    zero = np.flatnonzero(table == 0)
    assert np.bitwise_count(zero.astype(np.uint32)).max() == 3


def test_keys_meet_up_to_four_bits():
    rng = np.random.default_rng(5)
    left = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for bits in range(5):
        right = left.copy()
        for i in range(len(right)):
            for b in rng.choice(64, bits, replace=False):
                right[i] ^= np.uint64(1 << int(b))
        pairs = zip(op.keys_of(left), op.keys_of(right), strict=True)
        assert all(set(a.tolist()) & set(b.tolist()) for a, b in pairs)


def test_documents_against_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    prints = [fingerprint(r["text"]) for r in rows]
    want = sorted(zip((r["doc_id"] for r in rows), prints, linked(prints, [r["doc_id"] for r in rows]), strict=True), key=repr)
    got = [(r.doc_id, r.simhash % (1 << 64), r.component_id) for r in op.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == want


def test_links_of_dense_groups(spark):
    """Chains and clouds of fingerprints, where neighbours are linked only through others."""
    rng = np.random.default_rng(11)
    prints = []
    for _ in range(12):
        now = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                now ^= 1 << int(b)
            prints.append(now)
    prints += [prints[0]] * 5 + [0, 0b1111, 0b11111 << 40]
    marks = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(marks, "doc_id long, simhash long")
    got = {r.doc_id: r.component_id for r in df.join(op.linked_classes(df), "simhash").collect()}
    assert [got[i] for i in range(len(prints))] == linked(prints, list(range(len(prints))))


def test_rows_with_keys_are_never_broadcast(spark):
    """A row becomes some 70, which Spark's size estimate does not see."""
    rows = [(i * 0x9E3779B97F4A7C15 % (1 << 63), i, 1 + i % 2 * op.LARGE) for i in range(50)]
    members = op.with_keys(spark.createDataFrame(rows, "simhash long, label long, weight long"))
    for links in (op.pivot_links, op.small_links, op.large_links):
        found = links(members, 4)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, links.__name__


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (3000, 2999)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}, 3000: 2999, 2999: 2999}


def test_empty_table(spark):
    assert op.near_duplicates(empty(spark)).collect() == []
