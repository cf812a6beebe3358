"""Packs documents into training windows with their lexical neighbours.

Documents are tokenized once into a written table.  Document frequencies, the number of
documents and their mean length cover the whole corpus and give BM25 its weights.  Documents
are then range-partitioned by a cluster of their ids and a min-hash of their pairs of ids, so
that texts with much in common lie together, and each partition streams them through shards of
bounded size.  Clusters are learned from a bounded sample and cover all documents.  A shard
has an inverted index of its documents; the window of a seed document is filled with its best
unused neighbours, the last one is cut where the window is full, and its rest is the next seed.
A window that a shard leaves open goes on with the next shard, so only the last window of a
partition has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm import tokens, topics
from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow

WINDOW, END_ID = 4096, 2
#: A shard is closed at so many documents or tokens, whichever comes first.
SHARD_DOCS, SHARD_TOKENS, CLUSTERS = 2048, 4_000_000, 64
#: Neighbours that are sorted at first; where a window takes more, all are.
_FIRST = 48
K1, B = 1.2, 0.75
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _route(ids: np.ndarray, clusters: topics.Model) -> int:
    """A document's cluster and, below it, the least hash of its pairs of neighbouring ids."""
    pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:] if len(ids) > 1 else ids.astype(np.uint64)
    hashes = pairs * np.uint64(0x9E3779B97F4A7C15)
    hashes ^= hashes >> np.uint64(31)
    least = int((hashes * np.uint64(0xBF58476D1CE4E5B9)).min() >> np.uint64(8))
    return (clusters.number(ids) or 0) << 56 | least


def _tokenized(path: str, end_id: int, clusters: topics.Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        end = np.array([end_id], encoder.dtype)
        for batch in batches:
            n, raw, routes = [], [], []
            for text in batch.column(1):
                ids = np.concatenate((encoder.encode(text.as_py() or ""), end))
                n.append(len(ids))
                raw.append(ids.tobytes())
                routes.append(_route(ids, clusters))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array(routes, pa.int64())],
                ["id", "n", "ids", "route"],
            )

    return run


def _frequencies(dtype: str):
    """(term, docs): in how many documents of a partition each id occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros(1, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_py(), dtype)
                if (top := int(ids.max()) + 1) > len(docs):
                    docs = np.pad(docs, (0, top - len(docs)))
                ids = np.sort(ids)
                docs[ids[np.append(True, ids[1:] != ids[:-1])]] += 1
        terms = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(docs[terms])], ["term", "docs"])

    return run


class Index:
    """The BM25 inverted index of one shard, with weights of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.size = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(self.size, dtype=np.int64), lengths)
        keys, counts = np.unique(np.concatenate(docs).astype(np.int64) << 32 | owner, return_counts=True)
        self.terms, self.docs = keys >> 32, keys & 0xFFFFFFFF
        norm = K1 * (1 - B + B * lengths[self.docs] / mean)
        self.weights = idf[self.terms] * counts * (K1 + 1) / (counts + norm)
        first = np.flatnonzero(np.r_[True, self.terms[1:] != self.terms[:-1]])
        self._start = np.zeros(len(idf) + 1, np.int64)
        self._count = np.zeros(len(idf) + 1, np.int64)
        self._start[self.terms[first]] = first
        self._count[self.terms[first]] = np.diff(np.r_[first, len(self.terms)])
        # Terms of many documents get a row of weights each: summing rows is faster than their postings.
        common = first[np.diff(np.r_[first, len(self.terms)]) * 8 >= self.size]
        self._row = np.full(len(idf) + 1, -1, np.int64)
        self._row[self.terms[common]] = np.arange(len(common))
        at = self._row[self.terms]
        self._rows = np.zeros((len(common), self.size), np.float32)
        self._rows[at[at >= 0], self.docs[at >= 0]] = self.weights[at >= 0]
        by_doc = np.argsort(self.docs, kind="stable")
        self._of = self.terms[by_doc]
        self._at = np.searchsorted(self.docs[by_doc], np.arange(self.size + 1))

    def scores(self, doc: int) -> np.ndarray:
        """The score of every document for the terms of one of them, over their whole postings."""
        terms = self._of[self._at[doc] : self._at[doc + 1]]
        row = self._row[terms]
        found = self._rows[row[row >= 0]].sum(axis=0)
        terms = terms[row < 0]
        start, count = self._start[terms], self._count[terms]
        places = np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)
        return found + np.bincount(self.docs[places], self.weights[places], self.size)


def _ranked(scores: np.ndarray) -> Iterator[int]:
    """The documents from the highest score down, of equal ones the first."""
    n = len(scores)
    few = np.arange(n)
    if n > 4 * _FIRST:
        few = np.flatnonzero(scores >= np.partition(scores, n - _FIRST)[n - _FIRST])
    yield from few[np.argsort(-scores[few], kind="stable")].tolist()
    if len(few) < n:
        yield from np.argsort(-scores, kind="stable")[len(few) :].tolist()


class Packer:
    """Fills windows shard by shard; ``emit`` gets (document, start, length, sequence, offset)."""

    def __init__(self, window: int, idf: np.ndarray, mean: float, emit: Callable[..., None]):
        self.window, self.idf, self.mean, self.emit = window, idf, mean, emit
        self.sequence, self.filled = 0, 0

    def _place(self, doc: int, start: int, left: int) -> int:
        """Put as much of a document as fits into the open window; returns how much."""
        length = min(left, self.window - self.filled)
        self.emit(doc, start, length, self.sequence, self.filled)
        self.filled += length
        if self.filled == self.window:
            self.sequence, self.filled = self.sequence + 1, 0
        return length

    def shard(self, docs: list[np.ndarray]) -> None:
        index = Index(docs, self.idf, self.mean)
        unused = np.ones(len(docs), bool)
        order = iter(range(len(docs)))
        seed, at = None, 0
        while True:
            if seed is None:
                seed = next((d for d in order if unused[d]), None)
                if seed is None:
                    return
                unused[seed], at = False, 0
            sequence = self.sequence
            while at < len(docs[seed]):
                at += self._place(seed, at, len(docs[seed]) - at)
            if self.filled == 0 and self.sequence != sequence:
                seed = None
                continue
            rest = None
            scores = np.where(unused, index.scores(seed), -1.0)
            window = self.sequence
            for neighbour in _ranked(scores):
                if scores[neighbour] <= 0:
                    break
                unused[neighbour] = False
                placed = self._place(neighbour, 0, len(docs[neighbour]))
                if self.sequence != window:
                    rest = (neighbour, placed) if placed < len(docs[neighbour]) else None
                    break
            seed, at = rest or (None, 0)


def _packed(window: int, dtype: str, idf: np.ndarray, mean: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        out: list[tuple] = []
        names: list = []
        docs: list[np.ndarray] = []

        def emit(doc: int, start: int, length: int, sequence: int, offset: int) -> None:
            crc = zlib.crc32(docs[doc][start : start + length].astype("<u4").tobytes())
            out.append((names[doc], start, length, crc, len(docs[doc]), first + sequence, offset))

        packer = Packer(window, idf, mean, emit)

        def close() -> pa.RecordBatch:
            packer.shard(docs)
            columns = list(zip(*out, strict=True))
            for x in (out, names, docs):
                x.clear()
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *(p.split()[0] for p in PIECES.split(", "))])

        tokens = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                names.append(doc_id.as_py())
                docs.append(np.frombuffer(raw.as_py(), dtype))
                tokens += len(docs[-1])
                if len(docs) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    yield close()
                    tokens = 0
        if docs:
            yield close()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    A document's ids are its text's, a null text having none, and ``end_id`` after them; each
    id lies in exactly one piece.  A sequence takes at most ``window`` ids from offset 0 on.
    Rows are packed independently, whether or not their ids are null or repeat.  Document
    frequencies sent to the driver are at most one row per id of the vocabulary.
    """
    spark = docs.sparkSession
    dtype = tokens.encoder(tokenizer).dtype
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    clusters = topics.fit(docs, tokenizer, CLUSTERS, id_col, text_col, None)
    table = scratch.written(
        map_arrow(narrow, _tokenized(tokenizer, end_id, clusters), f"id {kind}, n bigint, ids binary, route bigint")
    )
    count, mean = table.agg(F.count("*"), F.avg("n")).first()
    found = map_arrow(table.select("ids"), _frequencies(dtype.str), "term bigint, docs bigint")
    found = found.groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    idf = np.zeros(max((r["term"] for r in found), default=0) + 1)
    for r in found:
        idf[r["term"]] = np.log1p((count - r["docs"] + 0.5) / (r["docs"] + 0.5))
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    ordered = table.select("id", "ids", "route").repartitionByRange("route", "id")
    ordered = ordered.sortWithinPartitions("route", "id").select("id", "ids")
    return map_arrow(ordered, _packed(window, dtype.str, idf, mean or 1.0, id_type), f"doc_id {kind}, {PIECES}")
