import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from samples import documents, empty
from tokenizers import Tokenizer

from demandspark.llm import token_files as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_files_hold_what_the_library_gives(spark):
    docs = documents(spark)
    library = Tokenizer.from_file(PATH)
    ordered = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or ""))
    ids = [library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in ordered]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).tolist()
    want = [
        (r["doc_id"], s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, s, i in zip(ordered, starts, ids, strict=False)
    ]
    got = op.with_crc32(op.token_table(docs, PATH)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_layout_and_selective_reads(spark, tmp_path):
    docs = documents(spark, long_words=3000).where("doc_id IS NOT NULL")
    path = str(tmp_path / "store")
    op.write_tokens(docs, path, PATH, 2, shards=3)
    columns = {}
    for file in (tmp_path / "store").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_column_index and column.has_offset_index or column.num_values == 0
                columns.setdefault(column.path_in_schema.split(".")[0], set()).update(column.encodings)
    assert any("DICTIONARY" in e for e in columns["tokens"])
    assert "DELTA_BINARY_PACKED" in columns["doc_id"] and "DELTA_BINARY_PACKED" in columns["n_tokens"]
    some = op.read_tokens(spark, path, 10, 20)
    whole = op.read_tokens(spark, path)
    assert sorted(some.collect()) == sorted(whole.where("doc_id BETWEEN 10 AND 20").collect())
    plan = some.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "tokens:array" not in plan


def test_empty_table(spark):
    assert op.token_table(empty(spark), PATH).collect() == []
