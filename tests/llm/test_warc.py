import base64
import gzip
import hashlib
import os

from demandspark.llm import warc as op

SCHEMA = "page_id long, url string, html string, member string, shard int, sha2 string"


def rows():
    out = [(i, f"http://a.example/{i % 7}?q=%20 é", f"<p>page {i % 40}</p>" * (1 + i % 5)) for i in range(120)]
    out += [(500, None, None), (501, "", ""), (502, "http://x/\r\nWARC-Type: evil", "x\r\n\r\ny"), (503, "u", "é" * 20_000)]
    out += [(600, "same", "equal rows")] * 4 + [(None, "n", "no id")] * 2 + [(None, None, "<p>page 3</p>"), (601, "same", "equal rows")]
    out += [(700 + i, "hot", "shared by very many") for i in range(300)]
    return out


def frame(spark, given, parts=4):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in given], SCHEMA).repartition(parts)


def brute(given, least=0):
    groups, out = {}, []
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode())
    for r in sorted(given, key=order):
        body = (r[2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = groups.setdefault(body, r) if len(body) >= least else r
        again = first is not r or (len(body) >= least and (body, "seen") in groups)
        groups[body, "seen"] = True
        out.append((r[0], len(body), digest, "revisit" if again else "response", first[0] if again else None))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    given = [tuple(r) for r in rows()]
    got = sorted((tuple(r) for r in op.archived(frame(spark, given)).collect()), key=repr)
    # equal rows are told apart by their number alone
    assert got == brute(given)


def test_least_size_of_revisits(spark):
    given = rows()
    got = sorted((tuple(r) for r in op.archived(frame(spark, given), revisit_from=15).collect()), key=repr)
    assert got == brute(given, 15)


def test_files_do_not_depend_on_the_layout(spark, tmp_path):
    given, seen = rows(), []
    for k, parts in enumerate((1, 7)):
        path = f"file://{tmp_path}/{k}"
        made = op.write_archive(frame(spark, given[:: 1 - 2 * k], parts), path, shards=5, roll_bytes=2500).collect()
        assert len({r.shard for r in made}) == 5 and max(r.seq for r in made) > 0
        for r in made:
            data = open(f"{tmp_path}/{k}/{r.file}", "rb").read()
            assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
        assert os.listdir(f"{tmp_path}/{k}/_temporary") == []
        seen.append(sorted((r.file, r.records, r.sha256) for r in made))
    assert seen[0] == seen[1] and sum(r[1] for r in seen[0]) == len(given)


def test_round_trip_and_references(spark, tmp_path):
    given, path = rows(), f"file://{tmp_path}/a"
    op.write_archive(frame(spark, given), path, shards=3)
    got = op.read_archive(spark, path).collect()
    key = lambda r: repr(r)
    assert sorted([(r.page_id, r.url) for r in got], key=key) == sorted([(r[0], r[1]) for r in given], key=key)
    names = {r.record_id: r for r in got}
    assert len(names) == len(got)
    payloads = {(r[0], r[1]): (r[2] or "").encode() for r in given}
    for r in got:
        if r.record_type == "response":
            assert payloads[r.page_id, r.url] in (bytes(r.payload), b"no id", b"<p>page 3</p>")
        else:
            first = names[r.refers_to_record]
            assert r.payload is None and first.record_type == "response" and first.page_id == r.refers_to
            assert (first.payload_digest, first.payload_bytes) == (r.payload_digest, r.payload_bytes)
    # any gzip reader finds the records in order of their keys
    file = sorted(f for f in os.listdir(f"{tmp_path}/a") if f.endswith(".gz"))[0]
    text = gzip.open(f"{tmp_path}/a/{file}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC-Type: evil") == 0


def test_reader_trusts_the_manifest_and_checks_digests(spark, tmp_path):
    given, path = rows()[:50], f"file://{tmp_path}/a"
    made = op.write_archive(frame(spark, given), path, shards=2).collect()
    (tmp_path / "a" / "part-000009-00000.warc.gz").write_bytes(b"left by a killed job")
    assert op.read_archive(spark, path).count() == 50
    broken = tmp_path / "a" / made[0].file
    with broken.open("rb") as stream:
        records = list(op.members(stream, 100))
    assert len(records) == made[0].records + 1
    records[3] = records[3].replace(b"<p>page", b"<q>page")
    broken.write_bytes(b"".join(map(gzip.compress, records)))
    try:
        op.read_archive(spark, path).count()
    except Exception as e:
        assert "differs" in str(e)
    else:
        raise AssertionError("a changed payload was read")


def test_empty_table(spark):
    assert op.archived(frame(spark, []).limit(0)).collect() == []
