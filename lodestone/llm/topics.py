"""Topics of documents: spherical k-means over hashed TF-IDF vectors of tokenizer ids.

:func:`clusters` learns from all documents: texts are tokenized once into a written table, and
document frequencies, means, first centres and rounds are passes over it.  Sums are integers, so
that no order of rows or partitions changes a model.  :func:`fit` learns from a bounded sample,
for callers that only route documents.  Where topics should not be the languages over again,
each language's mean vector is taken off its documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow

#: Documents that :func:`fit` learns from at most, features, topics, and rounds of k-means at most.
SAMPLE_DOCS, BITS, TOPICS, ROUNDS = 2000, 12, 6, 50
_FEATURES = 1 << BITS
#: Rounds over all documents end when their mean similarity grows by less than this share of it.
TOLERANCE = 1e-4
#: One in sums over documents, in written weights and in written scales; and the least length of a
#: vector without its language's mean: shorter ones have no direction.
_ONE, _UNIT, _SCALE, _LEAST = 1 << 20, (1 << 16) - 1, 1 << 12, 2.0**-10
#: Texts whose features are counted at once.
_TOGETHER = 128


def names(count: int = TOPICS) -> list[str]:
    return [f"topic{i}" for i in range(count)]


def _hashed(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text's ids and how often each occurs."""
    total = np.bincount(_hashed(ids), minlength=_FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    """Feature weights, what a language's mean adds to each topic, and by feature the centres."""

    tokenizer: str
    idf: np.ndarray
    offsets: dict[str | None, np.ndarray]
    centres: np.ndarray

    def values(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.idf[at]
        return weights / max(float(np.sqrt(weights @ weights)), 1e-12)

    def number(self, ids: np.ndarray, lang: str | None = None) -> int | None:
        """The topic of a text's ids; none without ids, or where nothing was learned."""
        if not len(ids) or not self.centres.shape[1]:
            return None
        at, counts = _counts(ids)
        near = self.values(at, counts) @ self.centres[at] - self.offsets.get(lang, self.offsets[None])
        return int(near.argmax())

    def settle(self, centres: np.ndarray, sizes: np.ndarray, means: dict[str | None, np.ndarray]) -> None:
        """Take the centres, from the largest on, like ones one after another."""
        centres = centres[np.argsort(-sizes, kind="stable")]
        centres = centres[_chained(centres)]
        self.centres = np.ascontiguousarray(centres.T)
        self.offsets = {x: centres @ mean for x, mean in means.items()}


def _chained(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which each is followed by the one most like it of the rest."""
    order, left = [0], np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        near = np.where(left, centres @ centres[order[-1]], -np.inf)
        order.append(int(near.argmax()))
        left[order[-1]] = False
    return np.array(order)


def learn(examples: Sequence[tuple[str | None, np.ndarray, np.ndarray]], tokenizer: str, count: int = TOPICS, by_lang: bool = True) -> Model:
    """A model of (language, features, counts); topics are numbered so that like ones follow
    each other, from the largest on.

    The first centre is the first example, each further one the example least like those
    before, and rounds end when no example moves.
    """
    idf = np.zeros(_FEATURES)
    for _, at, _ in examples:
        idf[at] += 1
    model = Model(tokenizer, np.log((1 + len(examples)) / (1 + idf)), {}, np.zeros((_FEATURES, 0)))
    if not examples:
        return model
    vectors = np.zeros((len(examples), _FEATURES), np.float32)
    for row, (_, at, counts) in zip(vectors, examples, strict=True):
        row[at] = model.values(at, counts)
    langs = np.array([x or "" for x, *_ in examples])
    means = {None: vectors.mean(axis=0) * by_lang}
    if by_lang:
        means |= {x: vectors[langs == x].mean(axis=0) for x in sorted(set(langs.tolist()) - {""})}
    centred = vectors  # in place: the driver holds them once
    for row, x in zip(centred, langs.tolist(), strict=True):
        row -= means.get(x, means[None])
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    chosen, like = [0], centred @ centred[0]
    while len(chosen) < min(count, len(examples)):
        chosen.append(int(like.argmin()))
        like = np.maximum(like, centred @ centred[chosen[-1]])
    centres, of = centred[chosen], None
    for _ in range(ROUNDS):
        now = (centred @ centres.T).argmax(axis=1)
        if of is not None and (now == of).all():
            break
        of = now
        sums = np.stack([centred[of == j].sum(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    model.settle(centres, np.bincount(of, minlength=len(centres)), means)
    return model


def _examples(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            at, counts = [], []
            for text in batch.column(2):
                a, n = _counts(encoder.encode(text.as_py() or ""))
                at.append(a.astype("<u4").tobytes())
                counts.append(n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["place", "lang", "at", "counts"]
            )

    return run


def fit(docs: DataFrame, tokenizer: str, count: int = TOPICS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> Model:
    """A model learned from at most ``SAMPLE_DOCS`` documents, those with the least hashes of
    their ids; no language is looked at without a column for it.  Null texts teach nothing; an
    empty table gives a model without topics."""
    share = min(1.0, 1.2 * SAMPLE_DOCS / max(docs.count(), 1))
    place = F.pmod(F.xxhash64(F.lit("topic"), F.col(id_col)), F.lit(1 << 30))
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col).cast("string")
    picked = docs.select(place.alias("place"), lang.alias("lang"), F.col(text_col).alias("text"))
    picked = picked.filter((F.col("place") < int(share * (1 << 30))) & F.col("text").isNotNull())
    picked = picked.coalesce(docs.sparkSession.sparkContext.defaultParallelism)  # few documents of each partition
    found = map_arrow(picked, _examples(tokenizer), "place bigint, lang string, at binary, counts binary")
    rows = found.filter("length(at) > 0").orderBy("place", "lang", "at", "counts").limit(SAMPLE_DOCS).collect()
    return learn([(r["lang"], np.frombuffer(r["at"], "<u4"), np.frombuffer(r["counts"], "<u4")) for r in rows], tokenizer, count, lang_col is not None)


def _told(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(model.tokenizer)
        for batch in batches:
            sizes, found = [], []
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text.as_py() or "")
                sizes.append(len(ids))
                number = model.number(ids, lang)
                found.append(None if number is None else f"topic{number}")
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(found, pa.string()), *batch.columns[2:]], ["n_tokens", "topic", *batch.schema.names[2:]]
            )

    return run


def tell(docs: DataFrame, model: Model, carry: Sequence[Column], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``n_tokens`` and ``topic`` of every whole text, with the carried columns of its row."""
    narrow = docs.select(F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"), *carry)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[2:])
    return map_arrow(narrow, _told(model), f"n_tokens bigint, topic string{fields}")


class _Rows:
    """The features of a batch's rows one after another, with a value each."""

    def __init__(self, at: pa.Array, values: pa.Array, kind: str):
        at, self.lengths = self._flat(at, "<u2")
        self.at = at.astype(np.int64)
        self.values, _ = self._flat(values, kind)
        self._full = self.lengths > 0
        self._starts = (np.cumsum(self.lengths) - self.lengths)[self._full]

    @staticmethod
    def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
        column, size = column.cast(pa.large_binary()), np.dtype(kind).itemsize
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        flat = np.frombuffer(raw, kind, (bounds[-1] - bounds[0]) // size, bounds[0]) if raw is not None and bounds[-1] > bounds[0] else np.zeros(0, kind)
        return flat, np.diff(bounds) // size

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum of each row's part of ``x``."""
        out = np.zeros(len(self.lengths), x.dtype)
        if len(x):
            out[self._full] = np.add.reduceat(x, self._starts)
        return out

    def spread(self, x: np.ndarray) -> np.ndarray:
        """A row's value for each of its features."""
        return np.repeat(x, self.lengths)

    def units(self, idf: np.ndarray) -> np.ndarray:
        """TF-IDF weights, each row of length one."""
        weights = self.values * idf[self.at]
        return weights / self.spread(np.maximum(np.sqrt(self.sums(weights * weights)), 1e-12))

    def added(self, to: np.ndarray, count: int, values: np.ndarray | None = None) -> np.ndarray:
        """``(count, features)`` sums of whole numbers by the row's place in ``to`` and feature."""
        slots = self.spread(to) * _FEATURES + self.at
        return np.bincount(slots, values, count * _FEATURES).astype(np.int64).reshape(count, _FEATURES)


def _binary(parts: Sequence[np.ndarray], lengths: np.ndarray) -> pa.Array:
    """Numbers one after another as binary values of so many each."""
    flat = np.concatenate(parts) if len(parts) else np.zeros(0, "<u2")
    bounds = np.r_[0, np.cumsum(lengths) * flat.itemsize].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])


def _totals(found: DataFrame, size: int) -> np.ndarray:
    """The sums of rows (slot, n) by slot."""
    told = found.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[told.column(0).to_numpy()] = told.column(1).to_numpy()
    return out


def _slots(*totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task has summed up, as rows (slot, n)."""
    total = np.concatenate([x.reshape(-1) for x in totals]).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


def _counted(tokenizer: str, langs: Sequence[str]):
    """From (text, lang, place, ...), rows (n_tokens, kind, place, at, values, ...): the number of
    a text's language, its features and the logarithms of how often they occur."""
    kinds = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            sizes, lengths, at, values = [], [], [], []
            for begin in range(0, batch.num_rows, _TOGETHER):
                ids = [encoder.encode(text.as_py() or "") for text in batch.column(0).slice(begin, _TOGETHER)]
                sizes.append(np.array([len(x) for x in ids], np.int64))
                total = np.bincount(_hashed(np.concatenate(ids)) + np.repeat(np.arange(len(ids)) * _FEATURES, sizes[-1]), minlength=len(ids) * _FEATURES)
                found = np.flatnonzero(total)
                lengths.append(np.bincount(found >> BITS, minlength=len(ids)))
                at.append((found & _FEATURES - 1).astype("<u2"))
                values.append((1 + np.log(total[found])).astype("<f4"))
            kind = pa.array([kinds.get(x, len(langs)) for x in batch.column(1).to_pylist()], pa.int32())
            sizes, lengths = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (sizes, lengths))
            columns = [pa.array(sizes), kind, batch.column(2), _binary(at, lengths), _binary(values, lengths)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[3:]], ["n_tokens", "kind", "place", "at", "values", *batch.schema.names[3:]])

    return run


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts (at) each feature occurs, then the number of texts."""
    seen, texts = np.zeros(_FEATURES, np.int64), 0
    for batch in batches:
        seen += np.bincount(_Rows._flat(batch.column(0), "<u2")[0], minlength=_FEATURES)
        texts += batch.num_rows
    yield from _slots(seen, np.array([texts]))


def _meant(idf: np.ndarray, kinds: int):
    """From (kind, at, values) the sums of unit vectors by language, then the numbers of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, texts = np.zeros((kinds, _FEATURES), np.int64), np.zeros(kinds, np.int64)
        for batch in batches:
            kind, rows = batch.column(0).to_numpy(), _Rows(batch.column(1), batch.column(2), "<f4")
            sums += rows.added(kind, kinds, np.rint(rows.units(idf) * _ONE))
            texts += np.bincount(kind, minlength=kinds)
        yield from _slots(sums, texts)

    return run


def _centred(idf: np.ndarray, means: np.ndarray):
    """From (n_tokens, kind, place, at, values, ...), rows (n_tokens, kind, place, at, values, scale,
    ...): a unit vector less its language's mean, times its scale, has length one."""
    squares = (means * means).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rows = batch.column(1).to_numpy(), _Rows(batch.column(3), batch.column(4), "<f4")
            units = rows.units(idf)
            square = rows.sums(units * units) - 2 * rows.sums(units * means[rows.spread(kind), rows.at]) + squares[kind]
            scale = np.where(square >= _LEAST**2, 1 / np.sqrt(np.maximum(square, _LEAST**2)), 0.0)
            values = _binary([np.rint(units * _UNIT).astype("<u2")], rows.lengths)
            scale = np.rint(scale * _SCALE).astype(np.int32)
            names = [*batch.schema.names[:5], "scale", *batch.schema.names[5:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], values, pa.array(scale), *batch.columns[5:]], names)

    return run


def _likeness(rows: _Rows, kind: np.ndarray, scale: np.ndarray, centres: np.ndarray, means: np.ndarray) -> np.ndarray:
    """``(centres, rows)``: the cosine of each row, without its language's mean, to each centre."""
    values, lifts = rows.values.astype(np.float32), centres @ means.T
    near = [rows.sums(values * centre.take(rows.at)) for centre in centres.astype(np.float32)]
    return (np.stack(near).astype(np.float64) / _UNIT - lifts[:, kind]) * (scale / _SCALE)


def _raced(step: int, centres: np.ndarray, means: np.ndarray):
    """From (kind, place, at, values, scale) the row that comes first in a task: each waits for a
    time by a hash, the shorter the less it is like the centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, place, scale = (batch.column(i).to_numpy() for i in (0, 1, 4))
            far = np.ones(len(kind))
            if len(centres):
                far -= _likeness(_Rows(batch.column(2), batch.column(3), "<u2"), kind, scale, centres, means).max(axis=0)
            mixed = (place.view(np.uint64) + np.uint64(step + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            chance = ((mixed ^ mixed >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54
            open_ = (scale > 0) & (far > 1e-4)
            wait = np.where(open_, -np.log(np.minimum(chance, 1 - 2.0**-53)) / np.maximum(far, 1e-4), np.inf)
            for i in np.flatnonzero(open_ & (wait == wait.min())).tolist():
                row = (wait[i], batch.column(3)[i].as_py(), batch.column(2)[i].as_py(), int(kind[i]), int(scale[i]))
                best = row if best is None else min(best, row)
        if best is not None:
            kinds = (pa.float64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(best, kinds, strict=True)], ["wait", "values", "at", "kind", "scale"])

    return run


def _gathered(centres: np.ndarray, means: np.ndarray):
    """From (kind, place, at, values, scale), by the nearest centre: the sums of values, those of
    scales by language, the numbers of rows, and the sum of all likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, kinds = len(centres), len(means)
        sums, scales, sizes, like = np.zeros((k, _FEATURES), np.int64), np.zeros(k * kinds, np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            kind, scale, rows = batch.column(0).to_numpy(), batch.column(4).to_numpy(), _Rows(batch.column(2), batch.column(3), "<u2")
            near = _likeness(rows, kind, scale, centres, means)
            of = near.argmax(axis=0)
            sums += rows.added(of, k, rows.values * rows.spread(scale.astype(np.float64)))
            scales += np.bincount(of * kinds + kind, scale, k * kinds).astype(np.int64)
            sizes += np.bincount(of, minlength=k)
            like += int(np.rint(near.max(axis=0) * _ONE).sum()) if len(of) else 0
        yield from _slots(sums, scales, sizes, np.array([like]))

    return run


def _placed(centres: np.ndarray, means: np.ndarray):
    """From (n_tokens, kind, place, at, values, scale, ...), rows (n_tokens, topic, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = np.array([*names(len(centres)), None], object)
        for batch in batches:
            of = np.full(batch.num_rows, len(centres))
            if len(centres) and batch.num_rows:
                rows, full = _Rows(batch.column(3), batch.column(4), "<u2"), batch.column(0).to_numpy() > 0
                near = _likeness(rows, batch.column(1).to_numpy(), batch.column(5).to_numpy(), centres, means)
                of = np.where(full, near.argmax(axis=0), of)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named[of], pa.string()), *batch.columns[6:]], ["n_tokens", "topic", *batch.schema.names[6:]])

    return run


def _seeds(vectors: DataFrame, means: np.ndarray, count: int) -> np.ndarray:
    """First centres, drawn from all rows: each by the hash of its id and the more likely the less
    it is like those before (k-means++); fewer where no row is unlike them."""
    centres = np.zeros((0, _FEATURES))
    for step in range(count):
        raced = map_arrow(vectors, _raced(step, centres, means), "wait double, values binary, at binary, kind int, scale int")
        first = raced.orderBy("wait", "values", "at", "kind").limit(1).collect()
        if not first:
            break
        centre = -means[first[0]["kind"]]
        centre[np.frombuffer(first[0]["at"], "<u2")] += np.frombuffer(first[0]["values"], "<u2") / _UNIT
        centres = np.vstack([centres, centre / max(float(np.linalg.norm(centre)), 1e-12)])
    return centres


def _rounds(vectors: DataFrame, means: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres after rounds over all rows, and how many rows each has."""
    k, kinds, before = len(centres), len(means), 0
    for _ in range(ROUNDS):
        found = _totals(map_arrow(vectors, _gathered(centres, means), "slot bigint, n bigint"), k * (_FEATURES + kinds + 1) + 1)
        sums, scales, sizes = np.split(found[:-1], [k * _FEATURES, k * (_FEATURES + kinds)])
        moved = (sums.reshape(k, _FEATURES) / _UNIT - scales.reshape(k, kinds) @ means) / _SCALE
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        centres = np.where(length > 0, moved / np.maximum(length, 1e-12), centres)
        like = int(found[-1])
        if like - before <= TOLERANCE * like:
            break
        before = like
    return centres, sizes


def clusters(
    docs: DataFrame, tokenizer: str, langs: Sequence[str], carry: Sequence[Column], count: int = TOPICS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> tuple[Model, DataFrame]:
    """A model learned from all documents, and ``n_tokens`` and ``topic`` of every whole text with
    the carried columns of its row.

    The mean of each of ``langs`` is taken off its documents, one mean of all others and of null
    off theirs.  Texts without ids teach nothing and have no topic.  Repeated rows count each; an
    empty table gives a model without topics.  A pass sends the driver one number for each topic
    or language and feature.
    """
    spark, paths = docs.sparkSession, [scratch.folder(docs.sparkSession) for _ in range(2)]
    place, kinds = F.xxhash64(F.lit("topic"), F.col(id_col)), len(langs) + 1
    narrow = docs.select(F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"), place.alias("__place"), *carry)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[3:])
    head = "n_tokens bigint, kind int, place bigint, at binary, values binary"
    counted = scratch.written(map_arrow(narrow, _counted(tokenizer, langs), head + fields), paths[0])
    full = counted.filter("n_tokens > 0")

    found = _totals(map_arrow(full.select("at"), _seen, "slot bigint, n bigint"), _FEATURES + 1)
    idf = np.log((1 + found[-1]) / (1 + found[:-1]))
    found = _totals(map_arrow(full.select("kind", "at", "values"), _meant(idf, kinds), "slot bigint, n bigint"), kinds * (_FEATURES + 1))
    sums, texts = np.split(found, [kinds * _FEATURES])
    means = sums.reshape(kinds, _FEATURES) / _ONE / np.maximum(texts, 1)[:, None]
    told = scratch.written(map_arrow(counted, _centred(idf, means), f"{head}, scale int{fields}"), paths[1])
    scratch.remove(spark, paths[0])

    vectors = told.filter("n_tokens > 0").select("kind", "place", "at", "values", "scale")
    model = Model(tokenizer, idf, {}, np.zeros((_FEATURES, 0)))
    if len(centres := _seeds(vectors, means, count)):
        model.settle(*_rounds(vectors, means, centres), {x: means[i] for i, x in enumerate([*langs, None])})
    topics = scratch.written(map_arrow(told, _placed(np.ascontiguousarray(model.centres.T), means), f"n_tokens bigint, topic string{fields}"))
    scratch.remove(spark, paths[1])
    return model, topics
