"""WARC archives: a deterministic sharded writer and a reader.

Records are dealt into shards by ranges of their ids and sorted in them; a task writes its shard's records, each a gzip
member of its own, and begins a new file whenever the compressed size reaches a limit. Headers and digests are made
anew from the payloads. Of equal payloads that are long enough, the record with the least id is a response and the
others revisit it; which those are comes from a grouped minimum over digests, so payloads are shuffled once, to their
shard. Files get their names when whole, and a manifest, written last, tells which count. The same rows give the same
bytes in any run.

Defined results: a null payload is as an empty one; records of one id are in the order of their digests; repeated rows
of one id revisit the first of them (if long enough); a null id sorts first and is written as such; a null URL
is replaced by a name made of the id; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm._common import discard, written
from lamella.llm._files import WholeFile, commit_manifest, store
from lamella.llm._shards import shard_plan

LEAST_REVISIT = 100
SHARD_BYTES = 64 << 20
ROLL_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs
CHUNK = 1 << 20
MANIFEST = "file string, shard int, records bigint, bytes bigint, sha256 string"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}:{digest}')}>"


def _clean(url: str | None, page: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url, page)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}"] + [f"X-Refers-To-Page: {first}"] * (first is not None)
    head += [f"X-Page: {page}"] * (page is not None) + [f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _packed(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class RollingWriter:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.folder, self.shard, self.roll_bytes = folder, shard, roll_bytes
        self.file, self.count = None, 0

    def add(self, data: bytes):
        if self.file is None:
            self.name = f"part-{self.shard:06d}-{self.count:05d}.warc.gz"
            self.file, self.size, self.records, self.sha = WholeFile(self.folder, self.name), 0, 0, hashlib.sha256()
            info = f"format: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            self._put(_packed(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMES, self.name)}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
        self._put(_packed(data))
        self.records += 1
        return self.close() if self.size >= self.roll_bytes else None

    def _put(self, data: bytes) -> None:
        self.file.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> tuple | None:
        if self.file is None:
            return None
        self.file.commit()
        self.file, self.count = None, self.count + 1
        return self.name, self.shard, self.records, self.size, self.sha.hexdigest()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = LEAST_REVISIT, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives; the manifest's rows (MANIFEST)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    plain = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keys = written(plain.where(F.octet_length("payload") >= least_revisit).select("id", F.sha2("payload", 256).alias("digest")), "digests")
    firsts = written(keys.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first"), "firsts")
    again = keys.join(firsts, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first").distinct()
    shard, shards = shard_plan(plain, "id", F.octet_length("payload") + 500, shard_bytes)
    own = plain.select("id", F.sha2("payload", 256).alias("digest"), F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("bigint").alias("first"))
    marks = again.select("id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first")
    dealt = own.union(marks).withColumn("shard", shard.cast("int")).repartitionById(shards, "shard").sortWithinPartitions("id", "digest", "kind", "url")

    def run(batches):
        writer, mark, last, done = None, None, None, []
        for b in batches:
            for page, digest, kind, url, data, first, number in zip(*(b.column(i).to_pylist() for i in range(7))):
                if kind == 0:
                    mark = (page, digest, first)
                    continue
                writer = writer or RollingWriter(folder, number, roll_bytes)
                if mark and mark[:2] == (page, digest):
                    revisit, of = True, mark[2]
                else:
                    revisit, of = len(data) >= least_revisit and last == (page, digest), page
                last = (page, digest)
                done.append(writer.add(record(page, url, data, digest, of, revisit)))
        if writer:
            done.append(writer.close())
        done = [x for x in done if x]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["file", "shard", "records", "bytes", "sha256"])

    manifest = commit_manifest(dealt.mapInArrow(run, MANIFEST), folder)
    discard(keys, firsts)
    return manifest


def members(stream):
    """The members of a gzip stream, one after the other."""
    d, out = zlib.decompressobj(31), []
    data = stream.read(CHUNK)
    while data:
        out.append(d.decompress(data))
        if d.eof:
            yield b"".join(out)
            data, d, out = d.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(CHUNK)
        else:
            data = stream.read(CHUNK)
    if any(out):
        raise ValueError("an archive ends within a record")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the manifest's files, digests checked: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if
    asked for, payload (null for revisits)."""

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                files, at = store(folder)
                rows: list[list] = [[], [], [], [], [], [], []]

                def batch():
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
                    n = 7 if with_payload else 6
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:n], kinds)], names=names[:n])

                held = 0
                with files.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parsed(data)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        if fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                            raise ValueError(f"{name}: a block is not as its digest")
                        payload = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
                        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                        if payload is not None:
                            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                            if "sha256:" + digest != fields["warc-payload-digest"]:
                                raise ValueError(f"{name}: a payload is not as its digest")
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        for c, v in zip(rows, (number("x-page"), fields["warc-target-uri"], fields["warc-type"], number("x-refers-to-page"), size, digest, payload)):
                            c.append(v)
                        held += len(payload or b"") if with_payload else 0
                        if len(rows[0]) >= 5000 or held > 16 << 20:
                            yield batch()
                            rows, held = [[], [], [], [], [], [], []], 0
                if rows[0]:
                    yield batch()

    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string" + ", payload binary" * with_payload
    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(run, schema)


def read_folder(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of a finished archive."""
    return read(spark.read.schema(MANIFEST).json(f"{folder}/_manifest"), folder, with_payload)


#: The same rows in DuckDB's SQL, from the pages themselves.
ORACLE_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
