"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the whole lower-cased text with logarithmic
counts, weighted by document frequencies over all documents that may be learned from, and
scaled to unit length.  Weights are trained by follow-the-regularised-leader with an elastic
net on a bounded sample, as many documents of each language as of any other; a fifth of the
sample is kept aside to set the temperature that turns margins into probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.arrow import map_arrow, table
from lodestone.plans.size import small

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Documents to learn from in expectation, shared equally by the languages; each has five at least.
SAMPLE_DOCS, LEAST_DOCS = 3000, 5
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 1e-3, 1e-3
UNKNOWN = "und"
_CHUNK = 1 << 20
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's 1- to 3-grams occur in a whole text."""
    total = np.zeros(BUCKETS, np.int64)
    shift = np.uint64(64 - BUCKET_BITS)
    text = text.lower()
    for at in range(0, len(text), _CHUNK):
        part = text[at : at + _CHUNK + 2].encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(part, "<u4").astype(np.uint64)
        mixed = np.zeros(len(points), np.uint64)
        for order, multiplier in enumerate(_MULTIPLIERS):
            n = min(_CHUNK, len(points) - order)
            if n <= 0:
                break
            mixed = (mixed[:n] ^ points[order : order + n] + np.uint64(order + 1)) * multiplier
            total += np.bincount((mixed >> shift).astype(np.int64), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages, weights by (bucket, language), bias, bucket weights and temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        values = (1 + np.log(counts[at])) * self.idf[at]
        return at, values / max(float(np.sqrt(values @ values)), 1e-12)

    def probabilities(self, at: np.ndarray, values: np.ndarray, temperature: float | None = None) -> np.ndarray:
        margins = (self.bias + values @ self.weights[at]) / (temperature or self.temperature)
        odds = np.exp(margins - margins.max())
        return odds / odds.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        odds = self.probabilities(*self.features(gram_counts(text)))
        best = int(odds.argmax())
        return self.langs[best], float(odds[best])


def train(examples: list[tuple[str, np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray) -> Model:
    """FTRL-proximal over (language, buckets, counts); every fifth example sets the temperature."""
    k = len(langs)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    model = Model(langs, np.zeros((BUCKETS, k)), np.zeros(k), idf)
    number = {x: i for i, x in enumerate(langs)}
    ready = []
    for lang, at, counts in examples:
        dense = np.zeros(BUCKETS, np.int64)
        dense[at] = counts
        buckets, values = model.features(dense)
        ready.append((number[lang], np.append(buckets, BUCKETS), np.append(values, 1.0)))

    def solved(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    held = ready[::5] if len(ready) >= 10 else []
    taught = [x for i, x in enumerate(ready) if i % 5 or not held]
    for _ in range(EPOCHS):
        for y, at, values in taught:
            weights = solved(at)
            margins = values @ weights
            odds = np.exp(margins - margins.max())
            odds /= odds.sum()
            odds[y] -= 1
            slope = values[:, None] * odds
            grown = n[at] + slope * slope
            z[at] += slope - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * weights
            n[at] = grown
    whole = solved(slice(None))
    model.weights, model.bias = whole[:BUCKETS], whole[BUCKETS]

    def loss(log_t: float) -> float:
        t = math.exp(log_t)
        found = [model.probabilities(at[:-1], v[:-1], t)[y] for y, at, v in held]
        return -sum(math.log(max(p, 1e-300)) for p in found)

    if held and k > 1:
        low, high, ratio = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        model.temperature = math.exp((low + high) / 2)
    return model


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            docs += gram_counts(text.as_py()) > 0
    at = np.flatnonzero(docs)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(docs[at])], ["bucket", "docs"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = []
        for text in batch.column(2):
            counts = gram_counts(text.as_py())
            at = np.flatnonzero(counts)
            raw.append((at.astype("<u4").tobytes(), counts[at].astype("<u4").tobytes()))
        columns = [pa.array(c, pa.binary()) for c in zip(*raw, strict=True)] or [pa.array([], pa.binary())] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["place", "lang", "at", "counts"])


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                [*batch.schema.names[1:], "lang_pred", "score"],
            )

    return run


def fit(docs: DataFrame, place: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model learned from the rows with a language and at least one letter in their text.

    ``place`` orders documents by a hash; the sample has those with the least hashes of each
    language, in expectation ``SAMPLE_DOCS`` over all.  Every language that occurs is learned.
    Document frequencies cover every row.
    Without such rows the model knows no language and predicts ``und``.
    """
    rows = docs.select(place.alias("place"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter("lang is not null and text is not null and place is not null")
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.ones(BUCKETS))
    each = max(LEAST_DOCS, SAMPLE_DOCS / len(sizes))
    scale = float(1 << 32)
    # One row for each language: as many as the model has columns.
    shares = [(r["lang"], math.ceil(scale * min(1.0, each / r["n"]))) for r in sizes]
    below = table(docs.sparkSession, shares, lang=pa.string(), below=pa.int64())
    chosen = rows.join(small(below), "lang").filter("place < below").select("place", "lang", "text")
    sample = map_arrow(chosen, _examples, "place bigint, lang string, at binary, counts binary")
    examples = [
        (r["lang"], np.frombuffer(r["at"], "<u4"), np.frombuffer(r["counts"], "<u4"))
        for r in sorted(sample.collect(), key=lambda r: (r["place"], r["lang"], r["at"], r["counts"]))
    ]
    found = map_arrow(rows.select("text"), _frequencies, "bucket bigint, docs bigint")
    docs_with = np.zeros(BUCKETS)
    for r in found.groupBy("bucket").agg(F.sum("docs").alias("docs")).collect():
        docs_with[r["bucket"]] = r["docs"]
    idf = np.log((1 + sum(r["n"] for r in sizes)) / (1 + docs_with)) + 1
    langs = sorted({lang for lang, *_ in examples})
    return train(examples, langs, np.maximum(idf, 0.0))


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The kept columns of each row with ``lang_pred`` and ``score``, from its text alone.

    A null text, and one without a letter, is ``und`` with score 0.
    """
    narrow = docs.select(F.col(text_col).alias("__text"), *keep)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    return map_arrow(narrow, _predicted(model), f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: a model learned from the documents whose id's
    CRC-32 leaves no remainder of 2 modulo 4, applied to all of them.

    A null id is neither held out nor learned from; repeated rows are judged alike.
    """
    crc = F.crc32(F.col(id_col).cast("string"))
    held_out = F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False))
    place = F.when(F.col(id_col).isNotNull(), F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 32)))
    model = fit(docs.filter(~held_out), place, text_col, lang_col)
    return predict(docs, model, [F.col(id_col).alias("doc_id"), held_out.alias("held_out")], text_col)
