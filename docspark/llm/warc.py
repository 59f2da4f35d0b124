"""A deterministic, sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, new_path, stored

_MANIFEST = "file string, shard string, n_records long, n_bytes long, sha256 string"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes | None, refers_to, revisit: bool, date: str, digest: str | None = None, size: int = 0) -> bytes:
    """One WARC/1.1 record; headers, digests and ids follow from its content alone.  A revisit may come with its payload's ``digest`` and ``size`` instead of it."""
    digest, size = (digest, size) if payload is None else (payload_digest(payload), len(payload))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]+", "%20", url or "") or f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("X-Page-ID", "" if page_id is None else page_id),
    ]
    if revisit:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", "" if refers_to is None else refers_to)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    text = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id('info', name)}\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return text.encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without a time stamp, so equal records give equal bytes."""
    return gzip.compress(data, compresslevel=6, mtime=0)


class _Roller:
    """Writes the records of one shard to files of about ``roll`` compressed bytes, each under a temporary name until it is whole."""

    def __init__(self, root: str, roll: int, date: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.roll, self.date = roll, date
        self.shard, self.part, self.out, self.done = None, 0, None, []

    def add(self, shard: str, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        elif self.out is not None and self.size >= self.roll:
            self.close()
            self.part += 1
        if self.out is None:
            self.name = f"{shard}-{self.part:05d}.warc.gz"
            self.temp = f"{self.root}/_{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            self._put(_info(self.name, self.date))
            self.n = 0
        self._put(data)

    def _put(self, data: bytes) -> None:
        z = _member(data)
        self.out.write(z)
        self.sha.update(z)
        self.size, self.n = self.size + len(z), self.n + 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.n, self.size, self.sha.hexdigest()))
            self.out = None


def write_warc(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z", broadcast_rows: int = 100_000) -> DataFrame:
    """Write a record per row under ``out_dir`` (a URI that pyarrow can write: file, hdfs, s3, gs) and return the manifest.

    Records are sorted by (payload digest, id descending, url) and cut into shards, ranges of the digest: one for each ``shard_bytes`` of payload, or each 100 rows up to 64 shards
    if those are more.  Of equal payloads of ``min_revisit_bytes`` or more the first, with the largest id, is a response and the
    others revisit it; smaller payloads are all responses.  A digest with as many rows or bytes as a shard is dealt over shards of its own; its largest id is looked up
    beforehand, so its revisits travel without their payload.  Such digests go to all tasks if they are ``broadcast_rows`` at most; more are joined as Spark sees fit.

    Shards, file names, headers, digests and bytes depend on the rows alone, not on partitions, tasks or settings.  A file gets its name when whole; the
    manifest (``out_dir``/_manifest, JSON, by Spark's committer) names the files that count, so a repeated or lost task leaves nothing that is read.

    A null payload is empty; a null url becomes urn:page:<id>; a null id sorts last and is written as an empty field.  Rows that
    repeat an id and a payload are a response and revisits to the same id.  No rows: an empty manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    sums = stored(rows.groupBy("digest").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("page_id").alias("top")), "digests")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-total.bytes // shard_bytes), min(64, total.n // 100))
    fair = max(2, -(-total.n // buckets))
    heavy = sums.where((F.col("n") >= fair) | (F.col("n") > 1) & (F.col("bytes") >= shard_bytes)).select("digest", "top", F.ceil(F.col("n") / fair).alias("subs"))
    heavy = stored(heavy, "heavy")
    if heavy.count() <= broadcast_rows:
        heavy = F.broadcast(heavy)
    bucket = F.lpad(F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("string"), 7, "0")
    spread = F.concat(bucket, F.lit("-"), F.substring("digest", 1, 12), F.lit("-"), F.lpad(F.pmod(F.xxhash64("page_id"), F.col("subs")).cast("string"), 5, "0"))
    keyed = rows.join(heavy, "digest", "left").withColumn("shard", F.when(F.col("subs").isNotNull(), spread).otherwise(bucket))
    again = F.col("subs").isNotNull() & (F.col("size") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("top"))
    dealt = keyed.select("shard", "digest", "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "top", F.col("subs").isNotNull().alias("is_heavy"), "size")
    dealt = dealt.repartitionByRange(n_partitions(spark), "shard").sortWithinPartitions("shard", "digest", F.col("page_id").desc_nulls_last(), "url")
    pafs.FileSystem.from_uri(out_dir)[0].create_dir(pafs.FileSystem.from_uri(out_dir)[1], recursive=True)

    def write(batches):
        roller, before, first = _Roller(out_dir, roll_bytes, date), None, None
        for b in batches:
            for shard, digest, page, url, payload, top, is_heavy, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fresh_run = (shard, digest) != before
                if fresh_run:
                    before, first = (shard, digest), page
                revisit = size >= min_revisit_bytes and (not fresh_run or (is_heavy and page != top))
                sha = base64.b32encode(bytes.fromhex(digest)).decode()
                roller.add(shard, record(page, url, payload, (top if is_heavy else first) if revisit else None, revisit, date, sha, size))
        roller.close()
        cols = list(zip(*roller.done, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", "shard", "n_records", "n_bytes", "sha256"])

    dealt.mapInArrow(write, _MANIFEST).write.json(f"{out_dir}/_manifest")
    return spark.read.schema(_MANIFEST).json(f"{out_dir}/_manifest")


def _members(stream):
    """The gzip members of a stream, one at a time."""
    z, data, out = zlib.decompressobj(31), b"", io.BytesIO()
    while data or (data := stream.read(1 << 20)):
        out.write(z.decompress(data))
        data = b""
        if z.eof:
            data = z.unused_data
            yield out.getvalue()
            z, out = zlib.decompressobj(31), io.BytesIO()


def parse_record(data: bytes) -> tuple | None:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a record; None for warcinfo.

    Digests of blocks and of payloads that are present are computed anew; a mismatch is an error.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if payload_digest(block) != fields["WARC-Block-Digest"].removeprefix("sha1:") or not revisit and payload_digest(payload) != digest:
        raise ValueError(f"digest mismatch in record {fields['WARC-Record-ID']}")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return number("X-Page-ID"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Refers-To-Page-ID"), size, digest, None if revisit else payload


def read_warc(manifest: DataFrame, out_dir: str, payloads: bool = True) -> DataFrame:
    """The records of the files that a manifest names: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A file is streamed member by member in one task; a revisit has the size and digest of the full payload and no payload.
    """

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(out_dir)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names)

        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        if (r := parse_record(data)) is not None:
                            rows.append(r if payloads else (*r[:6], None))
                            size += len(data) if payloads else 300
                            if size > 8 << 20:
                                yield batch(rows)
                                rows, size = [], 0
                yield batch(rows)

    files = manifest.select("file")
    return files.repartition(n_partitions(manifest.sparkSession), "file").mapInArrow(read, _RECORD)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new folder among the shared ones and read the archives back."""
    spark: SparkSession = pages.sparkSession
    out_dir = new_path(spark, "warc")
    return read_warc(write_warc(pages, out_dir, **options), out_dir, payloads=False)
