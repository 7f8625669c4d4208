"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards whose bounds come from a
bounded, hash-chosen sample of ids, so they depend on the data alone. A task
streams its shards in order, rolls a file when its compressed size is reached,
and regenerates every header and digest. Files are written under names of the
task attempt and moved to their final names when complete; the manifest, a
table written after all tasks, is the commit: files it does not list do not
count. A task that is run again writes the same bytes to the same names.

Payloads are shuffled once. Which record revisits which is worked out on
digests alone and joins the payloads as extra rows of the same sorted shards.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidspark.llm.common import stage

SHARD_BYTES, MAX_SHARDS, SAMPLE_PER_SHARD = 16 << 20, 16384, 16
ROLL_BYTES, LEVEL, LEAST_BYTES = 8 << 20, 6, 0
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("5f2c7f0e-8f0b-4c11-9d9f-3a1d9f1f0c55")
_MANIFEST = ("file string, shard int, number int, records long, revisits long, compressed_bytes long, sha256 string, "
             "first_page_id long, last_page_id long")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, sha1: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{sha1}|{url}')}>"


def _clean(url: str | None) -> str:
    """A URL that is safe in a header line: white space and control characters percent-encoded."""
    return "".join(c if c > "\x20" and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "urn:unknown"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed WARC record; a revisit (refers_to given) has the HTTP header but no payload."""
    url, sha1 = _clean(url), digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, sha1, url)),
            ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT), ("X-Refers-To-Page-Id", str(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _info(name: str) -> bytes:
    body = f"software: fidspark\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


class _Roller:
    """The files of one shard at a time."""

    def __init__(self, folder: str, roll_bytes: int) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
        self.roll, self.shard, self.out, self.done = roll_bytes, None, None, []
        self.attempt = TaskContext.get().taskAttemptId()

    def open(self, shard: int, number: int) -> None:
        self.shard, self.number = shard, number
        self.name = f"part-{shard:05d}-{number:05d}.warc.gz"
        self.temporary = f"{self.path}/_temporary/{self.name}.{self.attempt}"
        self.out, self.hash = self.fs.open_output_stream(self.temporary), hashlib.sha256()
        self.size = self.records = self.revisits = 0
        self.first = self.last = None
        self.put(_member(_info(self.name)))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def add(self, shard: int, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        if self.out is None or shard != self.shard:
            self.close()
            self.open(shard, 0)
        elif self.size >= self.roll:
            number = self.number + 1
            self.close()
            self.open(shard, number)
        self.put(_member(record(page_id, url, payload, refers_to)))
        self.records += 1
        self.revisits += refers_to is not None
        self.first, self.last = page_id if self.first is None else self.first, page_id

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.path}/{self.name}")
            self.done.append((self.name, self.shard, self.number, self.records, self.revisits, self.size, self.hash.hexdigest(), self.first, self.last))
            self.out = None


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
               least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) into ``folder``; returns the manifest, staged there.

    Of records with equal payloads of at least ``least_bytes`` bytes, that
    with the largest page_id is a response and the others revisit it; smaller
    payloads are always responses. A null html is an empty payload, a null url
    "urn:unknown". Rows that repeat the largest page_id of their payload are
    responses too, and so are all rows of a payload whose page_ids are all
    null; null page_ids sort first. A payload of any length is one record of
    one file. One shard is one task. An empty table writes no file. Other
    columns are not looked at. The input is read twice.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    heads = stage(rows.select("page_id", F.length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("key")), "warc-heads")
    n, size = heads.agg(F.count("*"), F.sum("bytes")).first()
    shards = min(MAX_SHARDS, max(1, -(-(size or 0) // shard_bytes)))
    share = min(1.0, SAMPLE_PER_SHARD * shards / max(n, 1))
    sample = np.array(sorted(r[0] for r in heads.filter((F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < round(share * (1 << 30))) & F.col("page_id").isNotNull())
                             .select("page_id").collect()), np.int64)
    bounds = np.unique(sample[[len(sample) * k // shards for k in range(1, shards)]]) if len(sample) else sample

    # staged, so that the join below can split a payload that very many pages share
    same = stage(heads.filter(F.col("bytes") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "warc-same")
    again = (heads.join(same, "key").filter("refers_to is not null and not page_id <=> refers_to")
             .select("page_id", "key", "refers_to").distinct())

    @F.pandas_udf("int")
    def shard_of(page_id):
        return pd.Series(np.searchsorted(bounds, page_id.to_numpy(), side="right").astype(np.int32))

    both = (rows.withColumn("key", F.sha2("payload", 256)).withColumn("refers_to", F.lit(None).cast("long"))
            .unionByName(again.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "key", "refers_to")))
    ranged = (both.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(-(2**63) + 1)))).repartitionById(len(bounds) + 1, "shard")
              .sortWithinPartitions("shard", "page_id", F.col("payload").isNotNull(), "key", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, known = None, None, {}
        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "page_id", "url", "payload", "key", "refers_to")]
            for i in range(batch.num_rows):
                shard, page_id, url, payload, key, refers_to = (c[i].as_py() for c in cols)
                if (shard, page_id) != current:
                    current, known = (shard, page_id), {}
                if payload is None:
                    known[key] = refers_to
                else:
                    out = out or _Roller(folder, roll_bytes)
                    out.add(shard, page_id, url, payload, known.get(key))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.done), (
                pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=[x.split()[0] for x in _MANIFEST.split(", ")])

    manifest = f"{folder}/_manifest"
    ranged.mapInArrow(run, _MANIFEST).write.parquet(manifest)
    return spark.read.schema(_MANIFEST).parquet(manifest)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped WARC file."""
    with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                k, _, v = line.decode("utf-8").partition(": ")
                head[k] = v
            block = f.read(int(head["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {head.get('WARC-Record-ID')} does not end where it should")
            yield head, block


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the files that the manifest lists; digests are checked.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if
    asked for, payload (null for a revisit).
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def number(v: str | None) -> int | None:
        return None if v is None else int(v)

    def rows(content: bytes) -> Iterator[tuple]:
        for head, block in parse(content):
            if head["WARC-Type"] == "warcinfo":
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
            said = head["WARC-Payload-Digest"].removeprefix("sha1:")
            full = head["WARC-Type"] == "response"
            if f"sha1:{digest(block)}" != head["WARC-Block-Digest"] or full and (said != digest(payload) or size != len(payload)):
                raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
            yield (number(head.get("X-Page-Id")), head["WARC-Target-URI"], size, said, head["WARC-Type"], number(head.get("X-Refers-To-Page-Id")),
                   *[payload if full else None] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for content in batch.column("content"):
                some = []
                for r in rows(content.as_py()):
                    some.append(r)
                    if len(some) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)

    listed = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest").select("file")
    if listed.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(listed, "file", "left_semi").select("content")
    return files.mapInArrow(run, schema)
