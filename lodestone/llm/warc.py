"""Writes pages as sharded WARC 1.1 archives, and reads them back.

Shards are ranges of the record key, and of the payload's digest among equal or null keys, that
hold about equal bytes.  Their bounds come from a sample picked by a hash of both, so they depend
on the records alone, and a key that very many records have spreads over shards.  A task writes its
shard in key order, each record a gzip member, and starts a new file when the compressed size
would pass a limit.  Files get temporary names with the task's attempt in them, and the rows
that describe them go through Spark's own commit, which takes one attempt of each task.  A
second pass renames the files of those rows, which may be repeated without harm as files are
told by their SHA-256, and writes the manifest; archives that no manifest lists do not exist to
the reader, which checks the files' SHA-256 again.

Of records with equal payloads the one with the least key is stored and the others refer to
it.  Which they are is found on digests alone; payloads are shuffled once, to their shard.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow

#: Payloads shorter than this are always stored.
MIN_REVISIT = 100
SHARD_BYTES, ROLL_BYTES, SAMPLE_KEYS = 64 << 20, 16 << 20, 20_000
DATE = "1970-01-01T00:00:00Z"
_VERSION, _HTTP = b"WARC/1.1\r\n", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-records")
_MANIFEST = "shard int, file string, temporary string, records bigint, bytes bigint, sha256 string"
_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, file string"


def _sha(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _record_id(key: int | None, digest: str, n: int) -> str:
    return f"<{uuid.uuid5(_SPACE, f'{key}/{digest}/{n}').urn}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def _block(headers: dict[str, str | int | None], content: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in headers.items() if v is not None]
    return _VERSION + "".join(lines).encode() + f"Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"


def record(key: int | None, n: int, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record with its headers and digests made anew; ``n`` tells records of equal keys and
    payloads apart."""
    revisit, digest = refers_to is not None, _sha(payload)
    http = _HTTP.format(len(payload)).encode()
    content = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(key, digest, n),
        "WARC-Date": date,
        "WARC-Target-URI": _uri(url),
        "WARC-Profile": _PROFILE if revisit else None,
        "WARC-Refers-To": _record_id(refers_to, digest, 0) if revisit else None,
        "WARC-Payload-Digest": digest,
        "WARC-Block-Digest": _sha(content),
        "Content-Type": "application/http; msgtype=response",
        "X-Record-Key": key,
        "X-Refers-To-Key": refers_to,
        "X-Payload-Length": len(payload),
    }
    return _block(headers, content)


class _Rolling:
    """The files of one shard, under temporary names."""

    def __init__(self, folder: str, shard: int, attempt: int, limit: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.limit = shard, attempt, limit
        self.rows: list[tuple] = []
        self.out: BinaryIO | None = None

    def _open(self) -> None:
        self.file = f"shard-{self.shard:06d}-{len(self.rows):05d}.warc.gz"
        self.temporary = f"_temporary/{self.file}.{self.attempt}"
        self.store.create_dir(f"{self.folder}/_temporary", recursive=True)
        self.out = self.store.open_output_stream(f"{self.folder}/{self.temporary}")
        self.size, self.records, self.sha = 0, 0, hashlib.sha256()
        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": _record_id(None, self.file, 0),
                "WARC-Date": DATE, "WARC-Filename": self.file, "Content-Type": "application/warc-fields"}
        self._put(gzip.compress(_block(info, b"format: WARC File Format 1.1\r\n"), mtime=0))

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, data: bytes) -> None:
        member = gzip.compress(data, 6, mtime=0)
        if self.out and self.records and self.size + len(member) > self.limit:
            self.close()
        if not self.out:
            self._open()
        self._put(member)
        self.records += 1

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.rows.append((self.shard, self.file, self.temporary, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def _written(folder: str, limit: int):
    """Writes rows (shard, key, digest, refers_to, url, payload) in their order; a row without
    a payload says what the next records with its key and digest refer to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files: _Rolling | None = None
        rows: list[tuple] = []
        said, last, n = (None, None, None), object(), 0
        for batch in batches:
            for shard, key, digest, refers_to, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if files is None or files.shard != shard:
                    if files:
                        files.close()
                        rows += files.rows
                    files = _Rolling(folder, shard, context.taskAttemptId(), limit)
                if payload is None:
                    said = (key, digest, refers_to)
                    continue
                n, last = (n + 1 if (key, digest) == last else 0), (key, digest)
                files.add(record(key, n, url, payload, said[2] if said[:2] == (key, digest) else None))
        if files:
            files.close()
            rows += files.rows
        if rows:
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = [x.split()[0] for x in _MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _file_sha(store: fs.FileSystem, path: str) -> str:
    found = hashlib.sha256()
    with store.open_input_stream(path, compression=None) as stream:
        while part := stream.read(1 << 20):
            found.update(part)
    return found.hexdigest()


def _committed(folder: str):
    """Renames the listed files, or finds that an earlier attempt has done so; a file of other
    content under a final name, which no manifest lists, is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{base}/{row['file']}"
                if store.get_file_info(final).type != fs.FileType.NotFound:
                    if _file_sha(store, final) == row["sha256"]:
                        continue
                    store.delete_file(final)
                store.move(f"{base}/{row['temporary']}", final)
            yield batch

    return run


Bounds = list[tuple[int | None, int]]


def _bounds(sizes: DataFrame, shards: int, rows: int) -> Bounds:
    """The first (key, tie) of all shards but the first, by the bytes at a hashed sample of them."""
    if shards == 1:
        return []
    every = max(1, rows // SAMPLE_KEYS)
    picked = sizes.filter(F.pmod(F.xxhash64("key", "tie"), F.lit(every)) == 0) if every > 1 else sizes
    found = picked.groupBy("key", "tie").agg((F.sum("n") + 512 * F.count("*")).alias("n")).collect()
    found.sort(key=lambda r: (r["key"] is not None, r["key"] or 0, r["tie"]))
    passed = np.cumsum([r["n"] for r in found], dtype=float)
    at = [int(np.searchsorted(passed, passed[-1] * i / shards)) for i in range(1, shards)] if found else []
    return [(found[i]["key"], found[i]["tie"]) for i in sorted({min(i, len(found) - 1) for i in at})]


def shards_of(bounds: Bounds, keys: pa.Array, ties: np.ndarray) -> np.ndarray:
    """The number of bounds that are not above each (key, tie); null keys come first."""
    nulls = np.array([t for k, t in bounds if k is None], np.int64)
    first = np.array([k for k, _ in bounds if k is not None], np.int64)
    second = np.array([t for k, t in bounds if k is not None], np.int64)
    values, absent = keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)
    low, high = (np.searchsorted(first, values, side=side) for side in ("left", "right"))
    for i in np.flatnonzero((low < high) & ~absent).tolist():  # keys at a bound
        low[i] += np.searchsorted(second[low[i] : high[i]], ties[i], side="right")
    return np.where(absent, np.searchsorted(nulls, ties, side="right"), low + len(nulls))


def _sharded(bounds: Bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shards_of(bounds, batch.column(0), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *batch.columns], ["shard", *batch.schema.names])

    return run


def write(
    pages: DataFrame,
    folder: str,
    key_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Writes every row as a record and returns the manifest, one row per archive file.

    Keys must be integers.  A null payload is empty and a null URL ``about:blank``.  Null keys
    lie in the first shards; they never are referred to, and stay responses where no key is
    known for their payload.  Rows that tie on the least key of a payload are all responses.
    Repeated rows are records of their own; a payload of any length is one record; an empty table
    has an empty manifest.  ``folder`` must be one that executors reach through Arrow's file
    systems; one that has a manifest already is refused.
    """
    if scratch.exists(pages.sparkSession, f"{folder}/_manifest"):
        raise ValueError(f"{folder} holds archives already")
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    whole = pages.select(F.col(key_col).cast("bigint").alias("key"), F.col(url_col).alias("url"), payload.alias("payload"))
    whole = whole.withColumn("digest", F.sha2("payload", 256)).withColumn("tie", F.xxhash64("digest"))
    narrow = scratch.written(whole.select("key", "tie", "digest", F.octet_length("payload").cast("bigint").alias("n")))
    rows, total = narrow.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, math.ceil(total / shard_bytes))
    bounds = _bounds(narrow.select("key", "tie", "n"), shards, rows)

    long = narrow.filter(F.col("n") >= MIN_REVISIT)
    least = long.groupBy("digest").agg(F.min("key").alias("refers_to"), F.count("*").alias("copies"))
    least = least.filter("copies > 1 and refers_to is not null").select("digest", "refers_to")
    told = long.join(least, "digest").filter("key is null or key <> refers_to").select("key", "tie", "digest", "refers_to").distinct()

    columns = ["key", "tie", "digest", "refers_to", "url", "payload"]
    told = told.withColumn("url", F.lit(None).cast("string")).withColumn("payload", F.lit(None).cast("binary"))
    both = told.select(columns).unionByName(whole.withColumn("refers_to", F.lit(None).cast("bigint")).select(columns))
    dealt = map_arrow(both, _sharded(bounds), "shard int, key bigint, tie bigint, digest string, refers_to bigint, url string, payload binary")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", "key", "tie", "digest", F.col("payload").isNotNull(), "url")
    listed = scratch.written(map_arrow(dealt.drop("tie"), _written(folder, roll_bytes), _MANIFEST))
    manifest = scratch.written(map_arrow(listed, _committed(folder), _MANIFEST), f"{folder}/_manifest")
    scratch.remove(pages.sparkSession, f"{folder}/_temporary")
    return manifest


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and content of each record of an uncompressed stream."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the start of a record")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _parsed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in _READ.split(", ")]
        number = lambda x: int(x) if x is not None else None
        for batch in batches:
            for file, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                if _file_sha(store, f"{base}/{file}") != sha:
                    raise ValueError(f"{file} is not what the manifest lists")
                with store.open_input_stream(f"{base}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, content in parse(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        if headers["warc-block-digest"] != _sha(content):
                            raise ValueError(f"{file}: a block differs from its digest")
                        payload = content.partition(b"\r\n\r\n")[2]
                        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != _sha(payload):
                            raise ValueError(f"{file}: a payload differs from its digest")
                        digest = headers["warc-payload-digest"].partition(":")[2]
                        rows.append((number(headers.get("x-record-key")), int(headers["x-payload-length"]), digest, headers["warc-type"],
                                     number(headers.get("x-refers-to-key")), headers["warc-target-uri"], file))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in a manifest: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, file``; the files' SHA-256 and the digests of blocks and stored
    payloads are verified.  An empty manifest has no records."""
    files = max(1, manifest.count())
    return map_arrow(manifest.select("file", "sha256").repartition(min(files, 10_000), "file"), _parsed(folder), _READ)
