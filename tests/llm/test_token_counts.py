import random

import public_tokenizers
import pyarrow as pa
from samples import documents, empty, rows
from tokenizers import Tokenizer

from demandspark.llm import token_counts as op

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts]


def odd_texts(n=400):
    rng = random.Random(2)
    signs = " \n\t'sStmdrevl abcéßñ漢字😀12²½…!?-_=.\xa0\x1c\x85<|>"
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(n)]
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/"
    return out + ["".join(rng.choice(letters) for _ in range(2000)), "a" * 1500, " " * 700 + "x", "=" * 600, "é" * 400, "x\n" * 300]


def test_counts_are_the_librarys():
    texts = odd_texts() + [r[1] for r in rows()]
    size, counts = op.counts_of(pa.array(texts, pa.string()), op.transducer(PATH))
    assert counts.tolist() == library(texts)
    assert size.tolist() == [len((t or "").encode()) for t in texts]


def test_chunks_compose_at_any_length(monkeypatch):
    texts = odd_texts(60)
    for length in (1, 3, 17):
        monkeypatch.setattr(op, "CHUNK", length)
        assert op.counts_of(pa.array(texts), op.transducer(PATH))[1].tolist() == library(texts)


def test_a_table_that_gets_full():
    machine = op.Transducer(PATH, most_entries=128 * 1024)
    texts = odd_texts(300)
    assert op.counts_of(pa.array(texts), machine)[1].tolist() == library(texts)
    assert len(machine.states) <= 1024 + 1


def test_query_rows(spark):
    docs = documents(spark)
    got = sorted(map(tuple, op.token_counts(docs, PATH).collect()), key=repr)
    found = docs.collect()
    counts = library([r["text"] for r in found])
    want = [(r["doc_id"], len((r["text"] or "").encode()), n, n > 1024) for r, n in zip(found, counts, strict=True)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert op.token_counts(empty(spark), PATH).collect() == []
