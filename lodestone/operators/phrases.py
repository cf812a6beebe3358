"""The most frequent phrases of texts: only what can be among them is counted in full.

A phrase occurs no more often than any three words in a row within it, and those no more often
than all that share a bucket of a hash with them.  So one pass counts buckets, a table of a fixed
size, and the next ones count the phrases whose every three words lie in buckets that are full
enough.  When the least of the best phrases found reaches that bound, no other can be among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import sentence_words
from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow, table

#: Bits of a bucket's number, and the fullest buckets that are looked at first.
BITS, FIRST = 20, 4096
#: Words in a row that a bucket is counted for: the length of the shortest phrase.
_SEED = 3
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _seeds(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """The batch's distinct words, each word's number among them, where three words of a sentence
    start, and their buckets."""
    inner = batch.column(0).flatten()
    words = inner.flatten().dictionary_encode()
    names, codes = words.dictionary, words.indices.to_numpy()
    if len(codes) < _SEED:
        return names, codes, np.zeros(0, bool), np.zeros(0, np.uint64)
    sentence = np.repeat(np.arange(len(inner)), pc.list_value_length(inner).to_numpy())
    made = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8).digest() for w in names.to_pylist()), "<u8")[codes]
    last = len(codes) - _SEED + 1
    mixed = sum(made[j : last + j] * np.uint64(f) for j, f in enumerate(_FACTORS))
    return names, codes, sentence[:last] == sentence[_SEED - 1 :], mixed >> np.uint64(64 - BITS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, n) of a partition."""
    sums = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        _, _, whole, buckets = _seeds(batch)
        sums += np.bincount(buckets[whole].astype(np.int64), minlength=1 << BITS)
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])


def _phrases(full: np.ndarray, stop: Sequence[str], longest: int) -> Callable:
    """Rows (phrase) of the phrases whose every three words lie in ``full`` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(full, count=1 << BITS).astype(bool)
        for batch in batches:
            names, codes, whole, buckets = _seeds(batch)
            if not whole.any():
                continue
            fits = whole & held[buckets.astype(np.int64)]
            says = pc.and_(pc.greater(pc.utf8_length(names), 3), pc.invert(pc.is_in(names, pa.array(stop, names.type)))).to_numpy(zero_copy_only=False)
            said = np.concatenate([[0], np.cumsum(says[codes])])
            for n in range(_SEED, longest + 1):
                if n > _SEED:
                    fits = fits[:-1] & fits[1:]  # of the first n - 1 words and of the last n - 1
                at = np.flatnonzero(fits & (said[n:] > said[: len(said) - n])) if len(fits) else ()
                if len(at):
                    parts = [names.take(pa.array(codes[at + j])) for j in range(n)]
                    yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*parts, " ")], ["phrase"])

    return run


def top_phrases(texts: DataFrame, stop: Sequence[str], longest: int = 8, top: int = 30, first: int = FIRST, text_col: str = "text") -> DataFrame:
    """``(phrase, n)``: the ``top`` most frequent runs of three to ``longest`` longer words of a
    sentence with at least one word of four letters or more that is no function word.

    Exact: ties fall to the least phrase.  The counted phrases grow as texts have frequent ones
    in common; texts of which none repeats are counted whole.
    """
    spark = texts.sparkSession
    words = texts.select(sentence_words(F.col(text_col)).alias("words"))
    counts = map_arrow(words, _counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = scratch.written(counts, narrow=True)
    fullest = counts.orderBy(F.desc("n")).limit(first).agg(F.count("*"), F.min("n")).first()
    least = fullest[1] if fullest[0] == first else 1
    while True:
        full = np.zeros(1 << BITS, bool)
        full[counts.filter(F.col("n") >= least).select("bucket").toArrow().column(0).to_numpy()] = True
        found = map_arrow(words, _phrases(np.packbits(full), tuple(stop), longest), "phrase string").groupBy("phrase").agg(F.count("*").alias("n"))
        best = [tuple(r) for r in found.orderBy(F.desc("n"), "phrase").limit(top).collect()]
        if least <= 1 or (len(best) == top and best[-1][1] >= least):
            return table(spark, best, phrase=pa.string(), n=pa.int64())
        least = best[-1][1] if len(best) == top else max(1, least // 8)
