"""A deterministic sharded WARC writer, and its reader.

Records are cut into shards of equal payload bytes in order of page id (exact prefix
sums, see ``sharding``), sorted inside a shard and written to gzip members, one for each
record; a file ends when its compressed size reaches ``roll_bytes``. Headers are made
anew: record ids and digests follow from the page and its payload, the date is a
parameter, so equal input gives equal files however Spark dealt it. Of equal payloads
of at least ``revisit_from`` bytes the page with the smallest id is the response, the
others are revisits of it without body.

Commit: a task writes to names of its attempt below ``_temporary`` and returns what it
wrote; Spark's own commit of that list (a Parquet table) decides which attempt counts.
A second job moves the listed files to their names, which may be repeated, and the
manifest is written last. Files of lost attempts are in no list and go with the folder.

Paths are opened by ``pyarrow.fs`` in the tasks, so the folder may be on any file system
it knows; it must be shared by the executors.

Edge cases: a null html is the empty payload; payloads below ``revisit_from`` are all
responses; a null page id comes first and has no id header, and is never referred to;
rows equal in page id and payload are each written, with own record ids, all as
responses if theirs is the smallest id; blanks and control characters of a url are
percent-encoded; a null url has no target header; an empty table gives no files and
an empty manifest; other columns are not written.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import keyranges, sharding
from tessera.llm.store import stored

REVISIT_FROM = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "name string, temporary string, shard int, seq int, records bigint, bytes bigint, sha256 string"


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    """The same name for the same page, payload and copy number."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, first: int | None,
                date: str) -> bytes:
    """A response, or a revisit of page ``first``."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode()
    block = http if first is not None else http + payload
    headers = [("WARC-Type", "response" if first is None else "revisit"),
               ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _safe(url)))
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"),
                ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if first is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest, 0))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return _record(headers, block)


def _info(name: str, date: str) -> bytes:
    block = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
                    ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # gzip without name or time
    return z.compress(data) + z.flush()


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _File:
    """One archive that is being written under a name of this attempt."""

    def __init__(self, system, folder: str, name: str, attempt: str, date: str, level: int):
        self.name, self.temporary = name, f"_temporary/{name}.{attempt}"
        self.out = system.open_output_stream(f"{folder}/{self.temporary}", compression=None)
        self.level, self.records, self.bytes, self.sha = level, 0, 0, hashlib.sha256()
        self.write(_info(name, date))
        self.records = 0

    def write(self, record: bytes) -> None:
        data = _member(record, self.level)
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += 1


def _write(uri: str, prefix: str, roll_bytes: int, date: str, level: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_folder(uri)
        system.create_dir(f"{folder}/_temporary", recursive=True)
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        file, shard, seq, marks, last, copy = None, None, 0, {}, None, 0
        written: list[dict] = []

        def end():
            if file is not None:
                file.out.close()
                written.append({"name": file.name, "temporary": file.temporary, "shard": shard, "seq": seq,
                                "records": file.records, "bytes": file.bytes, "sha256": file.sha.hexdigest()})

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                for r in batch.slice(a, 64).to_pylist():
                    if r["shard"] != shard:
                        end()
                        file, shard, seq, marks = None, r["shard"], 0, {}
                    if not r["is_page"]:  # what the following page revisits
                        if marks.get("for") != (r["key"], r["tie"]):
                            marks = {"for": (r["key"], r["tie"])}
                        marks[r["digest"]] = r["first"]
                        continue
                    payload = (r["html"] or "").encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    same = (shard, r["page_id"], digest)
                    copy, last = (copy + 1 if same == last else 0), same
                    first = marks.get(digest) if marks.get("for") == (r["key"], r["tie"]) else None
                    if file is not None and file.bytes >= roll_bytes:
                        end()
                        file, seq = None, seq + 1
                    if file is None:
                        file = _File(system, folder, f"{prefix}-{shard:05d}-{seq:04d}.warc.gz", attempt, date, level)
                    file.write(page_record(r["page_id"], r["url"], payload, digest, copy, first, date))
        end()
        if written:
            yield pa.RecordBatch.from_pylist(written, pa.schema([
                ("name", pa.string()), ("temporary", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()),
                ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))
    return scan


def _move(uri: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_folder(uri)
        for batch in batches:
            for r in batch.to_pylist():
                there = system.get_file_info([f"{folder}/{r['temporary']}", f"{folder}/{r['name']}"])
                if there[0].type != fs.FileType.NotFound:
                    system.move(f"{folder}/{r['temporary']}", f"{folder}/{r['name']}")
                elif there[1].type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{r['temporary']} is listed but not there")
            yield batch
    return scan


def write_warc(pages: DataFrame, folder: str, prefix: str = "pages", page_id: str = "page_id", url: str = "url",
               html: str = "html", shard_bytes: int = 256 << 20, min_shards: int = 64, roll_bytes: int = 1 << 30,
               revisit_from: int = REVISIT_FROM, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write ``pages`` below ``folder`` and return the manifest, one row for each file.

    The number of shards is the payload bytes over ``shard_bytes``, ``min_shards`` at
    least; it does not depend on the cluster.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"),
                        keyranges.key_of(F.col(page_id)).alias("key"), F.crc32(body.cast("binary")).alias("tie"))
    sums = sharding.byte_prefix_sums(sharding.sized_rows(rows, "key", "html"))
    total = F.col("total_bytes")
    shards = F.greatest(F.lit(min_shards).cast("long"), F.ceil(total / shard_bytes))
    width = F.ceil(total / shards)
    firsts = sums.groupBy(F.floor(F.col("bytes_before") / width).alias("s")).agg(
        F.min(F.struct("key", "text_crc32")).alias("f"))  # one row for each shard
    cuts = keyranges.first_keys(firsts.select(F.col("f.key").alias("key"), F.col("f.text_crc32").alias("tie")))
    if not len(cuts):
        return spark.createDataFrame([], _MANIFEST)

    digested = rows.select("page_id", "key", "tie", F.sha2("html", 256).alias("digest"),
                           F.octet_length("html").alias("n")).filter(F.col("n") >= revisit_from)
    digested = stored(digested.drop("n"), "digests")
    smallest = digested.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    smallest = stored(smallest.filter("n > 1 AND first IS NOT NULL").drop("n"), "first-pages")
    marks = digested.join(smallest, "digest").filter("page_id IS NULL OR page_id <> first")

    both = rows.select("page_id", "url", "html", "key", "tie", F.lit(True).alias("is_page"),
                       F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first")).unionByName(
        marks.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"),
                     "key", "tie", F.lit(False).alias("is_page"), "digest", "first"))
    shard = F.shiftright(keyranges.placing(spark, cuts)("key", "tie"), 1).cast("int")
    dealt = both.withColumn("shard", shard).repartitionById(len(cuts), "shard")
    dealt = dealt.sortWithinPartitions("shard", "key", "tie", "is_page", F.col("html"))
    listed = stored(dealt.mapInArrow(_write(folder, prefix, roll_bytes, date, level), _MANIFEST), "warc-attempts")
    moved = listed.repartition(max(1, min(len(cuts), 64)), "name").mapInArrow(_move(folder), _MANIFEST)
    path = f"{folder.rstrip('/')}/manifest.parquet"
    moved.drop("temporary").write.mode("overwrite").parquet(path)
    system, local = open_folder(folder)
    system.delete_dir(f"{local}/_temporary")
    return spark.read.parquet(path)


class _Members:
    """Gzip members of a stream one after another; at most one member is in memory."""

    CHUNK = 1 << 20

    def __init__(self, stream):
        self.stream = stream

    def __iter__(self) -> Iterator[bytes]:
        z, parts, rest = zlib.decompressobj(31), [], b""
        while rest or (rest := self.stream.read(self.CHUNK)):
            parts.append(z.decompress(rest))
            rest = z.unused_data if z.eof else b""
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
        if parts:
            raise EOFError("the file ends inside a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


_READ = [("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string()),
         ("payload", pa.binary())]


def _read(uri: str, with_payload: bool):
    fields = _READ if with_payload else _READ[:-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_folder(uri)
        rows, size = [], 0
        for name in (r["name"] for batch in batches for r in batch.to_pylist()):
            with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                for data in _Members(stream):
                    h, block = parse_record(data)
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    if f"sha256:{hashlib.sha256(block).hexdigest()}" != h["warc-block-digest"]:
                        raise ValueError(f"{name}: a record's block differs from its digest")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if h["warc-type"] == "response" and (
                            len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: a record's payload differs from its digest")
                    row = {"page_id": int(h["warc-page-id"]) if "warc-page-id" in h else None,
                           "record_id": h["warc-record-id"], "record_type": h["warc-type"],
                           "url": h.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest,
                           "refers_to_record": h.get("warc-refers-to")}
                    if with_payload and h["warc-type"] == "response":
                        row["payload"] = payload
                        size += n
                    rows.append(row)
                    if len(rows) >= 1024 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
    return scan


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of the manifest's files, digests verified.

    A revisit has no payload; ``refers_to_record`` names the response that has it.
    """
    names = {"payload_bytes": "bigint", "page_id": "bigint", "payload": "binary"}
    schema = ", ".join(f"{n} {names.get(n, 'string')}" for n, _ in (_READ if with_payload else _READ[:-1]))
    n = max(1, manifest.count())  # one file is one unit of work
    slices = min(n, max(64, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    files = manifest.select("name", (F.col("shard") + 131 * F.col("seq")).alias("at"))
    return files.repartitionById(slices, F.pmod("at", F.lit(slices)).cast("int")).select("name").mapInArrow(
        _read(folder, with_payload), schema)


def with_referred_pages(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``, the page id of the response that a revisit names."""
    pages = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    revisits = records.filter("record_type = 'revisit'").join(pages, "refers_to_record", "left")
    return records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(
        revisits)
