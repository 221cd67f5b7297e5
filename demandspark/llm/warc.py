"""Sharded WARC archives: the same table gives the same files, byte by byte.

Records are ordered by page id (null last), URL and payload. A pass over narrow rows (ids and digests)
sorts them by range, adds up payload bytes to exact positions in that order, and cuts the order into
shards of equal bytes; the first keys of the shards are all that the driver sees. The same rows tell
which record of a payload is the response and which ones revisit it. A payload that very many pages
share is no hot key: the few payloads with more than a 1,024th of all rows (so 1,024 at most) are
joined by broadcast, the others by their digest.

Every page is then compressed where it is read, as one gzip member whose headers and digests are made
from its content alone, and only members travel to their shard. There they meet the rows that tell
revisits, in key order, and are written to files that roll at a compressed size. Files get names of the
attempt first; the manifest takes the rows of successful tasks only, their files are renamed, and the
manifest is written last. A reader trusts the manifest alone, so lost executors, repeated tasks
and killed jobs leave nothing that is read.

Defined cases: a null payload is empty; a null URL or page id leaves its header out (an empty URL keeps
an empty header), such pages come last. Of equal payloads of at least ``revisit_from`` bytes the record
with the smallest key is the response; of rows equal in id, URL and payload the first one written.
Smaller payloads are all responses. One record is held in memory at a time, whatever its length. Control
characters of a URL are percent-encoded in its header. An empty table gives an archive without
files. Further columns are ignored.

Paths are URIs that Arrow's file systems can open on every executor (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandspark.llm.tables import stored
from demandspark.sources.storage import new_folder, shuffle_partitions

#: Payload bytes of a shard at most (a longer record has its own), compressed bytes at which a file is closed.
SHARD_BYTES, ROLL_BYTES = 256 << 20, 64 << 20
#: Pages have no time of capture; records need a date, and the same one on every run.
DATE = "2024-01-01T00:00:00Z"
#: A payload shared by more than this part of all rows is joined by broadcast.
HOT = 1024
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, file string, temporary string, records bigint, bytes bigint, sha256 string"
RECORDS = (
    "file string, record_id string, record_type string, page_id bigint, url string, payload binary, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, refers_to_record string"
)
#: Order of the records; the last one tells the rows of the plan from those of the data.
KEY = ["no_id", "page_id", "no_url", "url", "sha2"]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, sha2: str, date: str) -> str:
    """A name that follows from the record's content."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{sha2}|{date}').urn}>"


def header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def original(value: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def member(fields: list[tuple[str, str]], block: bytes, payload_digest: str | None = None) -> bytes:
    """One record as a gzip member without a time stamp."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields)]
    if payload_digest:
        lines.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def own_fields(kind: str, name: str, date: str, page_id: int | None, url: str | None) -> list[tuple[str, str]]:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", header_value(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    return [*fields, ("Content-Type", "application/http; msgtype=response")]


def response(page_id: int | None, url: str | None, payload: bytes, sha2: str, date: str) -> bytes:
    name = record_id(page_id, url, sha2, date)
    return member(own_fields("response", name, date, page_id, url), http_head(len(payload)) + payload, sha1_base32(payload))


def revisit(row: dict, date: str) -> bytes:
    """A record without payload; ``first_id`` and ``first_url`` name the response it stands for."""
    # rows equal in id, URL and payload have one name; the revisit's is told apart by its number
    name = record_id(row["page_id"], row["url"], f"{row['sha2']}#{row['number']}", date)
    fields = own_fields("revisit", name, date, row["page_id"], row["url"])
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["first_id"], row["first_url"], row["sha2"], date))]
    if row["first_url"] is not None:
        fields.append(("WARC-Refers-To-Target-URI", header_value(row["first_url"])))
    if row["first_id"] is not None:
        fields.append(("X-Refers-To-Page-ID", str(row["first_id"])))
    return member(fields, http_head(row["size"]), row["sha1"])


def keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.col(payload_col)
    payload = F.coalesce(payload if dict(pages.dtypes)[payload_col] == "binary" else F.encode(payload.cast("string"), "UTF-8"), F.lit(b""))
    page_id, url = F.col(id_col).cast("long"), F.col(url_col).cast("string")
    return pages.select(
        page_id.isNull().alias("no_id"), page_id.alias("page_id"), url.isNull().alias("no_url"), url.alias("url"), payload.alias("payload")
    )


def decided(rows: DataFrame, revisit_from: int) -> DataFrame:
    """``KEY, size, sha1`` of every record with ``first`` (key of its payload's response; null: always a response)."""
    digests = stored(
        rows.select(
            *KEY[:-1], F.sha2("payload", 256).alias("sha2"), F.octet_length("payload").cast("long").alias("size"),
            F.unhex(F.sha1("payload")).alias("sha1"),
        ),
        "digests",
    )
    total = digests.count()
    own = F.struct(*KEY[:-1])
    groups = digests.where(F.col("size") >= revisit_from).groupBy("sha2").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1"), "repeated")
    hot = F.broadcast(groups.where(F.col("n") * HOT > total).select(F.col("sha2").alias("same"), "first"))  # HOT rows at most
    cold = groups.where(F.col("n") * HOT <= total).select(F.col("sha2").alias("same"), "first")
    met = digests.join(hot, F.col("sha2") == F.col("same"), "left").drop("same")
    rest = met.where("first IS NULL").drop("first").join(cold, F.col("sha2") == F.col("same"), "left").drop("same")
    return stored(met.where("first IS NOT NULL").unionByName(rest), "decided")


def shard_starts(records: DataFrame, shards: int) -> list[tuple]:
    """Key of the first record of every shard but the first: shards hold equal bytes in the order of the keys."""
    spark = records.sparkSession
    # an empty payload still has headers
    weight = F.col("size") + 512
    rows = records.select(*KEY, weight.alias("weight"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), *KEY).sortWithinPartitions(*KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = pyspark.TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column("weight").to_numpy(zero_copy_only=False)
            here = pa.array(before + sizes.cumsum() - sizes)
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, here, pa.array([part] * batch.num_rows, pa.int32())], [*batch.schema.names, "here", "part"]
            )

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", here bigint, part int"
    placed = stored(rows.mapInArrow(run, schema), "ordered")
    parts = placed.groupBy("part").agg(F.sum("weight").alias("bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = parts.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"), F.sum("bytes").over(Window.partitionBy()).alias("all"))
    at = F.col("before") + F.col("here")
    shard = F.floor(at * F.lit(shards) / F.greatest("all", F.lit(1))).cast("int")
    found = placed.join(F.broadcast(parts), "part").groupBy(shard.alias("shard")).agg(F.min(F.struct(*KEY)).alias("first"))
    found = found.where("shard > 0").orderBy("shard").collect()  # a row a shard
    return [key_of(*r["first"]) for r in found]


def key_of(no_id: bool, page_id: int | None, no_url: bool, url: str | None, sha2: str) -> tuple:
    """A key that Python compares as Spark does: strings by their bytes."""
    return (no_id, page_id or 0, no_url, (url or "").encode(), sha2)


class Roller:
    """Writes members into the files of a shard; a file is closed once it holds ``roll`` bytes."""

    def __init__(self, uri: str, roll: int, date: str):
        self.system, self.folder = fs.FileSystem.from_uri(uri)
        self.roll, self.date, self.shard, self.seq, self.out = roll, date, None, 0, None

    def _open(self, shard: int) -> None:
        self.seq = self.seq + 1 if shard == self.shard else 0
        self.shard, self.records, self.bytes, self.sum = shard, 0, 0, hashlib.sha256()
        self.file = f"part-{shard:06d}-{self.seq:05d}.warc.gz"
        self.temporary = f"_temporary/{self.file}.{uuid.uuid4().hex}"
        self.system.create_dir(f"{self.folder}/_temporary", recursive=True)
        self.out = self.system.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        name = f"<{uuid.uuid5(uuid.NAMESPACE_URL, self.file + self.date).urn}>"
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", self.date), ("WARC-Filename", self.file)]
        self._write(member([*fields, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.bytes += len(data)

    def add(self, shard: int, data: bytes) -> tuple | None:
        """The manifest row of a file that had to be closed first, if any."""
        done = self.close() if self.out and (shard != self.shard or self.bytes >= self.roll) else None
        if self.out is None:
            self._open(shard)
        self._write(data)
        self.records += 1
        return done

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        return (self.shard, self.seq, self.file, self.temporary, self.records, self.bytes, self.sum.hexdigest())


def write_archive(
    pages: DataFrame, path: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES, revisit_from: int = 0, date: str = DATE,
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Write the archive of ``pages`` to the new folder ``path`` and give its manifest.

    ``shards`` defaults to the session's shuffle partitions, or more where these would exceed
    ``SHARD_BYTES``; the files depend on it and on nothing else but the records.
    """
    spark = pages.sparkSession
    rows = keyed(pages, id_col, url_col, payload_col)
    records = decided(rows, revisit_from)
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = shards or max(shuffle_partitions(spark), -(-total // SHARD_BYTES))
    starts = shard_starts(records, shards)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: [] for c in ("shard", "sha2", "member")}
            kept = [batch.column(c).to_pylist() for c in KEY[:-1]]
            for i, (no_id, page_id, no_url, url) in enumerate(zip(*kept, strict=True)):
                payload = batch.column("payload")[i].as_py()
                sha2 = hashlib.sha256(payload).hexdigest()
                lists["shard"].append(bisect.bisect_right(starts, key_of(no_id, page_id, no_url, url, sha2)))
                lists["sha2"].append(sha2)
                lists["member"].append(response(page_id, url, payload, sha2, date))
            arrays = [pa.array(lists["shard"], pa.int32()), *(batch.column(c) for c in KEY[:-1]), pa.array(lists["sha2"], pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lists["member"], pa.binary())], ["shard", *KEY, "member"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
            found = pa.array([bisect.bisect_right(starts, key_of(*k)) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([found, *batch.columns], ["shard", *batch.schema.names])

    keys = "shard int, no_id boolean, page_id bigint, no_url boolean, url string, sha2 string"
    data = rows.mapInArrow(compress, f"{keys}, member binary")
    # what the writer has to know of records that are not plain responses, once for each key
    plan = records.where("first IS NOT NULL").groupBy(*KEY).agg(F.first("size").alias("size"), F.first("sha1").alias("sha1"), F.first("first").alias("first"))
    plan = plan.select(
        *KEY, "size", "sha1", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"),
        (F.struct(*KEY[:-1]).eqNullSafe(F.col("first"))).alias("is_first"),
    )
    more = "size bigint, sha1 binary, first_id bigint, first_url string, is_first boolean"
    plan = plan.mapInArrow(place, f"{keys}, {more}")
    both = data.unionByName(plan, allowMissingColumns=True)
    order = [F.col("shard"), *map(F.col, KEY), F.col("member").isNotNull()]  # the plan's row comes first

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, told, number, done = Roller(path, roll_bytes, date), None, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "member"}
                key = tuple(row[c] for c in ("shard", *KEY))
                data = batch.column("member")[i].as_py()
                if data is None:
                    told, number = row | {"key": key, "sha1": base64.b32encode(row["sha1"]).decode()}, 0
                    continue
                if told and told["key"] == key:
                    number += 1
                    if number > 1 or not told["is_first"]:
                        data = revisit(told | {"number": number}, date)
                done += [out.add(row["shard"], data)]
        done = [d for d in [*done, out.close()] if d]
        if done:
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order)
    written = stored(dealt.mapInArrow(write, MANIFEST), "written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if system.get_file_info(f"{folder}/{temporary}").type != fs.FileType.NotFound:  # a repeated task finds it moved
                    system.move(f"{folder}/{temporary}", f"{folder}/{file}")
            yield batch

    written.mapInArrow(rename, MANIFEST).write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v[1:] for k, _, v in (line.partition(":") for line in lines if line)}


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one at a time."""
    rest = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            rest = rest or stream.read(step)
            if not rest:
                if out or unpack.unconsumed_tail:
                    raise ValueError("an archive ends inside a record")
                return
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(out)


def parsed(data: bytes, file: str) -> tuple | None:
    """A row of ``RECORDS`` for a response or revisit; digests are computed again and compared."""
    head, _, block = data.partition(b"\r\n\r\n")
    own = fields_of(head)
    block = block[: int(own["content-length"])]
    if own["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"{file}: block digest of {own['warc-record-id']} differs")
    if own["warc-type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(fields_of(http)["content-length"]), own["warc-payload-digest"].removeprefix("sha1:")
    kind = own["warc-type"]
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"{file}: payload of {own['warc-record-id']} differs from its digest")
    number = lambda name: int(own[name]) if name in own else None
    url = original(own["warc-target-uri"]) if "warc-target-uri" in own else None
    return (
        file, own["warc-record-id"], kind, number("x-page-id"), url, payload if kind == "response" else None, size, digest,
        number("x-refers-to-page-id"), own.get("warc-refers-to"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records (``RECORDS``) of the files that the manifest of ``path`` names; each file is one stream."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file", "records", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        types = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for file, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                with system.open_input_stream(f"{folder}/{file}", compression=None) as stream:
                    rows, held, seen = [], 0, 0
                    for data in members(stream):
                        row = parsed(data, file)
                        if row is None:
                            continue
                        rows.append(row)
                        held, seen = held + len(data), seen + 1
                        if held >= 4 << 20 or len(rows) >= 1000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)
                if seen != expected:
                    raise ValueError(f"{file} holds {seen} records, the manifest says {expected}")

    files = manifest.repartition(shuffle_partitions(spark), "file")
    return files.mapInArrow(run, RECORDS)


def archived(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the archive (to a new shared folder unless ``path`` is given), read it back and give
    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record."""
    path = path or new_folder(pages.sparkSession, "warc")
    write_archive(pages, path, **options)
    read = read_archive(pages.sparkSession, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB; ``base32`` is spelled out by five-bit groups of the digest.
ARCHIVED_SQL = r"""
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, url, octet_length(body) AS payload_bytes, sha1(body) AS hex, sha256(body) AS sha2 FROM p
), bits AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c : ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), '') AS b
  FROM d
), r AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda j : CAST(substr(b, CAST(i * 5 + j + 1 AS BIGINT), 1) AS INTEGER) * (1 << CAST(4 - j AS INTEGER)))) AS BIGINT), 1)), '') AS payload_digest,
    row_number() OVER g AS place, first_value(page_id) OVER g AS first_id
  FROM bits WINDOW g AS (PARTITION BY sha2 ORDER BY page_id NULLS LAST, url NULLS LAST)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM r
"""
