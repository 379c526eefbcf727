"""WARC archives, each record a Zstandard frame, with one dictionary per archive.

A task writes the rows of its partition. It buffers the first records, trains a dictionary on them,
writes it into a skippable frame at the head of the file, and compresses each record on its own with
it. An archive ends at ``ARCHIVE_BYTES`` of records and the next begins with its own dictionary. Each
attempt of a task writes files of its own names and the stored manifest lists those of the attempt
that counted, so lost executors leave no half archive behind that anyone reads.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is a
response; the others are revisits that refer to it and carry no payload.

Defined results: a null html is an empty payload, a null url has no target header, a null page_id has
the record id of no page and is never referred to while a page with an id has the payload; rows
that repeat a page_id and its payload have the same type; other columns are ignored; an empty table
gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from reelmill.llm.batches import text_slices
from reelmill.session import scratch_path, small_side, store

ARCHIVE_BYTES = 1 << 30
DICTIONARY_BYTES = 32 << 10
#: Bytes of records that a dictionary is trained on.
TRAINING_BYTES = 4 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
#: The frame that holds a dictionary, and the profile of revisits.
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def file_system(uri: str):
    """The file system of a folder and the path in it; any that pyarrow can open."""
    from pyarrow.fs import FileSystem

    uri = re.sub(r"^file:/*", "file:///", uri)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return FileSystem.from_uri(uri)


def record_id(page) -> str:
    return "<urn:page:none>" if page is None else f"<urn:page:id:{quote(str(page), safe='')}>"


def page_of(record: str) -> str | None:
    return unquote(record[len("<urn:page:id:") : -1]) if record.startswith("<urn:page:id:") else None


def bare_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page, url: str | None, payload: bytes, refers_to: str | None, digest: str) -> bytes:
    """One WARC/1.1 record with its HTTP head; revisits keep the head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{bare_digest(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Header fields (lower case) with ``block``; a wrong length or block digest is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + bare_digest(block) != fields["warc-block-digest"]:
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    return fields | {"block": block}


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the samples; too few for training: their last bytes as they are."""
    import zstandard

    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            pass  # samples too much alike to train on
    return b"".join(samples)[-size:]


class Archive:
    """One file: dictionary frame, then one frame for each record."""

    def __init__(self, folder: str, samples: list[bytes]):
        import zstandard

        self.name = f"{uuid.uuid4().hex}.warc.zst"
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        self.out = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        words = train(samples)
        self.out.write(DICTIONARY_MAGIC + len(words).to_bytes(4, "little") + words)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True).compress
        self.stored, self.raw, self.records = 8 + len(words), 0, 0

    def add(self, record: bytes) -> None:
        frame = self.pack(record)
        self.out.write(frame)
        self.stored, self.raw, self.records = self.stored + len(frame), self.raw + len(record), self.records + 1


def write_records(records: Iterator[bytes], folder: str) -> Iterator[Archive]:
    """Closed archives with all records in order."""
    archive, waiting, size = None, [], 0
    for record in records:
        if archive is None:
            waiting.append(record)
            size += len(record)
            if size < TRAINING_BYTES:
                continue
            archive = Archive(folder, waiting)
            for r in waiting:
                archive.add(r)
            waiting, size = [], 0
        else:
            archive.add(record)
        if archive.raw >= ARCHIVE_BYTES:
            archive.out.close()
            yield archive
            archive = None
    if waiting:
        archive = Archive(folder, waiting)
        for r in waiting:
            archive.add(r)
    if archive is not None:
        archive.out.close()
        yield archive


def frames(folder: str, name: str) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    fs, path = file_system(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
        if source.read(4) != DICTIONARY_MAGIC:
            raise ValueError(f"{name} does not begin with a dictionary frame")
        words = source.read(int.from_bytes(source.read(4), "little"))
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
        rest = b""
        while rest or (rest := source.read(CHUNK)):
            frame, parts = reader.decompressobj(), []
            while not frame.eof:
                if not rest and not (rest := source.read(CHUNK)):
                    raise ValueError(f"{name} ends inside a record")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
            yield b"".join(parts)


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with sha1 and refers_to; only ids and digests are grouped.

    Payloads stay where they are read as long as the revisits are measured to be small.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    wide = pages.select("page_id", "url", payload.alias("html")).withColumn("sha1", F.sha1("html"))
    narrow = wide.where(F.octet_length("html") >= least).select("page_id", "sha1").groupBy("page_id", "sha1").count()
    groups = narrow.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("pages"))
    repeats = narrow.drop("count").join(groups.where("pages > 1 and refers_to is not null").drop("pages"), "sha1")
    repeats = repeats.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).withColumnsRenamed({"page_id": "p", "sha1": "s"})
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s"))
    return wide.join(small_side(repeats), same, "left").drop("p", "s")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages below ``folder``; a stored manifest of the archives: folder, name, records, raw_bytes, stored_bytes."""
    kinds = [("folder", StringType()), ("name", StringType()), ("records", LongType()), ("raw_bytes", LongType()), ("stored_bytes", LongType())]
    schema = StructType([StructField(n, t) for n, t in kinds])

    def write(batches):
        def records():
            for rows in text_slices(batches, "html"):
                for page, url, html, sha1, refers_to in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to"))):
                    yield make_record(page, url, html, refers_to, base64.b32encode(bytes.fromhex(sha1)).decode())

        for a in write_records(records(), folder):
            yield pa.RecordBatch.from_pylist([{"folder": folder, "name": a.name, "records": a.records, "raw_bytes": a.raw, "stored_bytes": a.stored}], schema=ARROW)

    ARROW = pa.schema([("folder", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("raw_bytes", pa.int64()), ("stored_bytes", pa.int64())])
    return store(mark_revisits(pages, least).mapInArrow(write, schema), "warc-manifest")


def read_archives(manifest: DataFrame, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """All records: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A payload's digest and size are taken from the payload itself and must agree with the header;
    those of revisits, which have none, come from their header.
    """
    schema = StructType([
        StructField("page_id", StringType()), StructField("url", StringType()), StructField("record_type", StringType()),
        StructField("refers_to", StringType()), StructField("payload_bytes", LongType()), StructField("payload_digest", StringType()),
        StructField("payload", BinaryType()),
    ])

    def rows(folder: str, name: str):
        for record in frames(folder, name):
            f = parse_record(record)
            http, _, body = f["block"].partition(b"\r\n\r\n")
            kind, digest = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            if kind == "response" and (len(body) != size or bare_digest(body) != digest):
                raise ValueError(f"damaged payload in {name}: {f['warc-record-id']}")
            url = f.get("warc-target-uri")
            refers_to = page_of(f["warc-refers-to"]) if kind == "revisit" else None
            yield page_of(f["warc-record-id"]), url, kind, refers_to, size, digest, body if payloads and kind == "response" else None

    arrow = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in schema.names])

    def batch(buffered: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buffered), arrow.types)], schema=arrow)

    def read(batches):
        for listed in batches:
            for folder, name in zip(listed.column("folder").to_pylist(), listed.column("name").to_pylist()):
                buffered, size = [], 0
                for row in rows(folder, name):
                    buffered.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 4 << 20:
                        yield batch(buffered)
                        buffered, size = [], 0
                if buffered:
                    yield batch(buffered)

    archives = max(1, manifest.count())
    spread = manifest.select("folder", "name").repartition(archives)
    found = spread.mapInArrow(read, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder."""
    return scratch_path(spark, "warc")
