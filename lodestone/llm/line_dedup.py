"""Exact line deduplication over a corpus.

Every line is hashed where its document lies; 128-bit hashes are range-partitioned together
with the document, so a line that a third of all documents hold spreads over many partitions.
Each partition streams its hashes in order, documents from the largest id down, and so meets
the occurrence that stays first.  Only a run of equal hashes that crosses a partition's edge
needs more than its own partition: its documents are written as undecided and settled with the
edges' summaries, at most two per partition.  What comes back is a compressed keep bitmap for
each document that loses lines, never text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.judged import free_names
from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow

#: ASCII white space, stripped from both ends of a line's key.
BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _hashed(min_chars: int):
    """Rows (h1, h2, id, places): the long enough keys of each document, with the numbers of
    the lines that have them as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, ids, places = [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                if (doc := doc.as_py()) is None:
                    continue
                found: dict[bytes, list[int]] = {}
                for n, line in enumerate((text.as_py() or b"").split(b"\n")):
                    if len(key := line.strip(BLANKS)) >= min_chars and _points(key) >= min_chars:
                        found.setdefault(xxhash.xxh3_128_digest(key.lower()), []).append(n)
                for digest, lines in found.items():
                    h1.append(digest[:8])
                    h2.append(digest[8:])
                    ids.append(doc)
                    places.append(np.array(lines, "<u4").tobytes())
            halves = [pa.array(np.frombuffer(b"".join(h), ">i8").astype(np.int64)) for h in (h1, h2)]
            yield pa.RecordBatch.from_arrays(
                [*halves, pa.array(ids, pa.int64()), pa.array(places, pa.binary())], ["h1", "h2", "id", "places"]
            )

    return run


_STREAMED = "kind int, h1 bigint, h2 bigint, id bigint, places binary, docs bigint"
_DROP, _OPEN, _EDGE = 0, 1, 2


def _streamed(min_docs: int):
    """Rows by kind: lines to drop; documents of a run cut by the partition's start; and for
    the first and last run of a partition how many documents it holds and the largest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, first, docs, largest, last_doc = None, True, 0, None, None
        held: list[tuple] = []

        def close(edge: bool) -> None:
            if edge and now is not None:
                out.append((_EDGE, *now, largest, None, docs))
                out.extend((_OPEN, *now, doc, places, 0) for doc, places in held)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for a, b, doc, places in zip(*columns, strict=True):
                if (a, b) != now:
                    close(edge=first)
                    first = now is None
                    now, docs, largest, last_doc, held = (a, b), 0, doc, None, []
                if doc != last_doc:
                    docs, last_doc = docs + 1, doc
                if first:
                    out.append((_OPEN, a, b, doc, places, 0))
                elif doc == largest:
                    continue  # the occurrence that stays
                elif docs < min_docs:
                    held.append((doc, places))
                else:
                    out.extend((_DROP, a, b, d, p, 0) for d, p in held)
                    held = []
                    out.append((_DROP, a, b, doc, places, 0))
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        close(edge=True)
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    names = ["kind", "h1", "h2", "id", "places", "docs"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
    )


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for parts in batch.column(1).to_pylist():
            lines = np.unique(np.frombuffer(b"".join(parts), "<u4"))
            dropped = np.zeros(int(lines[-1]) + 1, np.uint8)
            dropped[lines] = 1
            maps.append(zlib.compress(np.packbits(1 - dropped, bitorder="little").tobytes() + bytes([-len(dropped) % 8])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["id", "keep"])


def kept_lines(keep: bytes | None, lines: int) -> np.ndarray:
    """A bitmap as booleans, one per line; lines beyond its end, and all without one, are kept."""
    kept = np.ones(lines, bool)
    if keep is not None:
        packed = np.frombuffer(zlib.decompress(keep), np.uint8)
        bits = np.unpackbits(packed[:-1], bitorder="little")
        held = bits[: len(bits) - int(packed[-1])].astype(bool)
        kept[: len(held)] = held
    return kept


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``(id, keep)`` for each document that loses lines; ids must be integers.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of
    at least ``min_chars`` code points in at least ``min_docs`` (two or more) documents lose
    all their lines but those in the largest id that holds them.  ``keep`` is a compressed
    bitmap, see :func:`kept_lines`.  Null texts have one empty line; documents with a null id
    neither count nor lose lines; rows that repeat an id count as one document, and a line
    number is lost in each of them if it is lost in one.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be two or more")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    # Written, as the bounds of ranges are sampled from them: texts are hashed once.
    lines = scratch.written(map_arrow(narrow, _hashed(min_chars), "h1 bigint, h2 bigint, id bigint, places binary"))
    ordered = lines.repartitionByRange("h1", "h2", F.desc("id"))
    ordered = ordered.sortWithinPartitions("h1", "h2", F.desc("id"))
    streamed = scratch.written(map_arrow(ordered, _streamed(min_docs), _STREAMED))
    edges = streamed.filter(F.col("kind") == _EDGE).groupBy("h1", "h2")
    edges = edges.agg(F.sum("docs").alias("docs"), F.max("id").alias("largest"))
    edges = edges.filter(F.col("docs") >= min_docs).select("h1", "h2", "largest")
    # Two rows per partition at most: so many rows cannot outgrow the plan that has them.
    settled = streamed.filter(F.col("kind") == _OPEN).join(F.broadcast(edges), ["h1", "h2"])
    dropped = streamed.filter(F.col("kind") == _DROP).select("id", "places")
    dropped = dropped.unionByName(settled.filter("id < largest").select("id", "places"))
    per_doc = dropped.groupBy("id").agg(F.collect_list("places").alias("parts"))
    return map_arrow(per_doc, _bitmaps, "id bigint, keep binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, lost, digests = [], [], []
        texts = batch.column(1).cast(pa.large_binary())
        for text, keep in zip(texts, batch.column(2), strict=True):
            lines = (text.as_py() or b"").split(b"\n")
            kept = kept_lines(keep.as_py(), len(lines))
            left = lines if kept.all() else [x for x, k in zip(lines, kept.tolist(), strict=True) if k]
            n.append(len(lines))
            lost.append(len(lines) - len(left))
            digests.append(hashlib.sha256(b"\n".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests)],
            ["id", "n_lines", "n_dropped", "kept_sha256"],
        )


def _rewritten(at: int):
    """The rows with the text at one place cut down to its kept lines, without the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keeps = batch.column(at), batch.column(batch.num_columns - 1)
            out = []
            for text, keep in zip(texts.to_pylist(), keeps.to_pylist(), strict=True):
                if keep is not None and text is not None:
                    lines = text.split("\n")
                    kept = kept_lines(keep, len(lines)).tolist()
                    text = "\n".join(x for x, k in zip(lines, kept, strict=True) if k)
                out.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def line_counts(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_lines, n_dropped, kept_sha256)`` of every row under its bitmap.

    Null and empty texts have one empty line; rows without a bitmap, null ids among them, keep
    all theirs; repeated rows are counted each.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = narrow.join(bitmaps, "id", "left").select("id", "text", "keep")
    return map_arrow(joined, _applied, f"id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every column, their texts without the dropped lines.

    A text that loses all its lines becomes empty; a null text stays null.  Rows that repeat an
    id lose lines alike, rows with a null id none; an empty table stays empty.
    """
    doc, keep = free_names(docs, 2)
    joined = docs.join(bitmaps.toDF(doc, keep), F.col(id_col) == F.col(doc), "left").drop(doc)
    return map_arrow(joined, _rewritten(docs.columns.index(text_col)), docs.schema)
