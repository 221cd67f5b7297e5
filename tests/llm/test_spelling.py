import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from samples import documents, empty, lower

from demandspark.llm import spelling as op

ALPHABET = "abehnstáéñß×÷ÿ"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def pairs_of(words):
    """Through deletions, then compared."""
    keys = {}
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            keys.setdefault(k, []).append(w)
    return {tuple(sorted((a, b))) for group in keys.values() for a in group for b in group if a < b and near(a, b)}


def counted(rows, deleted=97):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % deleted == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def brute(rows, deleted=97):
    words = counted(rows, deleted)
    around = {w: [] for w in words}
    for a, b in pairs_of(words):
        around[a].append(b)
        around[b].append(a)
    forms = {}
    for w, others in around.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= 2 * words[w]:
            forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(around[w]), words[forms[w]] if w in forms else None))
    return sorted(out, key=repr)


def test_documents_against_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in op.variants(docs).collect()), key=repr)
    assert got == brute(rows) and len(got) > 1000
    assert len(op.vocabulary(docs, deleted=3).collect()) == len(counted(rows, 3))


def made_words(n, seed=5, long=300):
    rng = random.Random(seed)
    words = {"".join(rng.choice(ALPHABET) for _ in range(rng.randint(5, 9))) for _ in range(n)} | {"aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababab"}
    for w in sorted(words):
        i = rng.randrange(len(w) + 1)
        words |= {w[:i] + rng.choice(ALPHABET) + w[i:], w[:i] + rng.choice(ALPHABET) + w[i + 1 :]}
    return sorted(w for w in words if len(w) >= 5) + ["x" * long, "x" * (long - 1) + "y", "ab" * 50, "ab" * 49 + "a"]


def test_every_pair_is_found_whatever_the_dictionary(spark):
    words = made_words(600)
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
    want = pairs_of(words)
    for longest, share in (((4, 2), 1 / 256), ((6, 4, 2), 1 / 1024), ((5, 2), 1.0)):
        assert {(r.a, r.b) for r in op.near_words(df, longest, share).collect()} == want


def test_bounds_hold_for_every_edit(spark):
    """Grams of a word that are missing after an edit are no more than its bound says."""
    words = made_words(150)[:-4]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    grams = op.Grams.of(op.dictionary(df, 5, 1 / 512), 5)
    assert all(len(grams.codes[q]) for q in (2, 3, 4, 5))

    def decomposed(many):
        out = {}
        for rows, letters in op.by_length(pa.array(many)):
            kept, end, _ = grams.decompose(letters)
            bound = grams.bound(letters, kept, end)
            for k, r in enumerate(rows):
                own = [tuple(letters[k, p : end[k, p]]) for p in np.flatnonzero(kept[k])]
                out[many[r]] = (Counter(own), int(bound[k]))
        return out

    edited = {w: {w[:i] + c + w[i + j :] for i in range(len(w) + 1) for j in (0, 1) for c in ["", *ALPHABET]} - {w} for w in words[::11]}
    found = decomposed(sorted({*edited, *(e for es in edited.values() for e in es)}))
    for w, es in edited.items():
        own, bound = found[w]
        assert max((own - found[e][0]).total() for e in es) <= bound


def test_crc_of_runs():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 7, 63, 64, 65, 500]))) for _ in range(200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    length = np.array([len(t.encode()) for t in texts])
    head = zlib.crc32(b"12:")
    got = op.crcs(data, np.cumsum(length) - length, length, np.full(len(texts), head, np.uint32))
    assert got.tolist() == [zlib.crc32(b"12:" + t.encode()) for t in texts]


def test_empty_table(spark):
    assert op.variants(empty(spark)).collect() == []
    one = spark.createDataFrame([(1, None), (None, "aaaaaa AAAAAA aaaaaa")], "doc_id long, text string")
    assert [tuple(r) for r in op.variants(one, deleted=10**9 + 7).collect()] == [("aaaaaa", None, "aaaaaa", 3, 0, None)]
