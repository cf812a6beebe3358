"""Chunks of articles: sentences packed to a size with overlap, or cut where the topic shifts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean_text, let, section_headers, semantic_sentences, sentences, text_of, word_count
from lodestone.plans.arrow import map_arrow

CHUNK_WORDS, OVERLAP_WORDS, CONTEXT_WORDS, MIN_ARTICLE = 800, 200, 300, 100

_CHUNK = """chunk_id int, text string, word_count int, chunk_position string, sentence_start_idx int, sentence_end_idx int,
chunk_sentence_count int, total_sentences_in_article int, preceding_context string, following_context string, preceding_context_words int,
following_context_words int, chunk_start_sentence string, chunk_end_sentence string, previous_chunk_id int, next_chunk_id int"""


def fold(sums: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of sentences; ``sums`` has the words before each, and all."""
    start, out = 0, []
    for i in range(len(sums) - 1):
        if i > start and sums[i + 1] - sums[start] > size:
            out.append((start, i))
            start = bisect_left(sums, sums[i] - overlap, start, i) if overlap > 0 and i - start > 1 else i
    return [*out, (start, len(sums) - 1)]


def _position(k: int, count: int, end: int, sentences: int) -> str:
    if k == count - 1 == 0:
        return "complete"
    return "end" if k == count - 1 or end >= sentences - 2 else "beginning" if k == 0 else "middle"


#: Articles whose chunks are made at once.
_ARTICLES = 256


def joined_runs(items: pa.Array, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings from each start to its end, with spaces between them."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    places = np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items.take(pa.array(places))), " ")


def _chunked(size: int, overlap: int, context: int, wanted: Sequence[str]):
    """Rows (id, sentences, *carried) as rows of chunks: one pass over an article's sentences.

    Only numbers of words become objects of Python; texts are joined where they lie, for a few
    articles at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, _ARTICLES) for b in batches for i in range(0, b.num_rows, _ARTICLES)):
            flat = part.column(1).flatten()
            words = pc.count_substring_regex(flat, "[^ ]+").to_pylist()
            rows, base = [], 0
            for at, last in enumerate(pc.list_value_length(part.column(1)).to_pylist()):
                if not last:
                    continue
                sums = [0, *accumulate(words[base : base + last])]
                chunks = fold(sums, size, overlap)
                for k, (start, end) in enumerate(chunks):
                    first = bisect_left(sums, sums[start] - context, 0, start)
                    stop = bisect_right(sums, sums[end] + context, end) - 1
                    rows.append((at, base, last, len(chunks), k, start, end, first, stop, sums[end] - sums[start], sums[start] - sums[first], sums[stop] - sums[end]))
                base += last
            if not rows:
                continue
            at, base, last, count, k, start, end, first, stop, own, before, after = np.array(rows).T
            edge = lambda i: pc.binary_join_element_wise(pc.utf8_slice_codeunits(flat.take(pa.array(i)), 0, 150), "...", "")  # noqa: B023, E731
            made = {
                "chunk_id": lambda: k, "text": lambda: joined_runs(flat, base + start, base + end), "word_count": lambda: own,
                "chunk_position": lambda: pa.array([_position(*x) for x in zip(k.tolist(), count.tolist(), end.tolist(), last.tolist(), strict=True)]),
                "sentence_start_idx": lambda: start, "sentence_end_idx": lambda: end - 1, "chunk_sentence_count": lambda: end - start, "total_sentences_in_article": lambda: last,
                "preceding_context": lambda: joined_runs(flat, base + first, base + start), "following_context": lambda: joined_runs(flat, base + end, base + stop),
                "preceding_context_words": lambda: before, "following_context_words": lambda: after,
                "chunk_start_sentence": lambda: edge(base + start), "chunk_end_sentence": lambda: edge(base + end - 1),
                "previous_chunk_id": lambda: pa.array(k - 1, pa.int32(), mask=k == 0), "next_chunk_id": lambda: pa.array(k + 1, pa.int32(), mask=k == count - 1),
            }
            made = [made[name]() for name in wanted]
            made = [x if isinstance(x, pa.Array) else pa.array(x, pa.int32()) for x in made]
            carried = [part.column(i).take(pa.array(at)) for i in (0, *range(2, part.num_columns))]
            yield pa.RecordBatch.from_arrays([carried[0], *made, *carried[1:]], [part.schema.names[0], *wanted, *part.schema.names[2:]])

    return run


def fixed_chunks(
    articles: DataFrame,
    size: int = CHUNK_WORDS,
    overlap: int = OVERLAP_WORDS,
    context: int = CONTEXT_WORDS,
    id_col: str = "doc_id",
    text_col: str = "content",
    min_length: int = MIN_ARTICLE,
    headers: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Chunks of at most ``size`` words, where sentences allow it, each starting with the last
    sentences of the one before that have at most ``overlap`` words.

    A single longer sentence is a chunk of its own; a chunk may exceed the size by what it took
    over.  Contexts are the sentences next to a chunk with at most ``context`` words in all.
    Articles without ``min_length`` characters or without sentences have no chunks.  Sentences
    are split by built-in expressions and folded in one Arrow pass, linear in an article's
    length; nothing is shuffled.  Section headers come with every chunk unless turned off, and of
    its other columns only ``columns`` if given.
    """
    text = text_of(text_col)
    long = articles.filter(F.length(F.trim(text)) >= min_length)
    carried = [section_headers(F.col(text_col)).alias("article_section_headers")] if headers else []
    named = long.select(F.col(id_col).alias("article_id"), sentences(clean_text(text)).alias("sents"), *carried)
    kind = articles.schema[id_col].dataType.simpleString()
    kinds = dict(x.split() for x in _CHUNK.replace("\n", " ").split(", "))
    wanted = tuple(c for c in kinds if columns is None or c in columns)
    schema = ", ".join([f"article_id {kind}", *(f"{c} {kinds[c]}" for c in wanted)]) + (", article_section_headers array<string>" if headers else "")
    # Articles without sentences are left out there: a filter on their number would split texts twice.
    return map_arrow(named, _chunked(size, overlap, context, wanted), schema)


def chunk_key(article_id: Column, chunk_id: Column, articles: int = 1_000_000) -> Column:
    """A key that is unique over all chunks and the same in every run: no global numbering."""
    return article_id.cast("bigint") * articles + chunk_id


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count_distinct("article_id").alias("articles"),
        F.count("*").alias("chunks"),
        F.avg("word_count").alias("avg_words"),
    )


# Semantic chunks ---------------------------------------------------------------------------


def hashed_vector(sentence: Column, dims: int = 16) -> Column:
    """A stand-in for an embedding: counts of a sentence's lower-cased words by hash bucket."""
    tokens = F.regexp_extract_all(F.lower(sentence), F.lit(r"(?U)\w+"), F.lit(0))
    places = F.transform(tokens, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint"), F.lit(dims)).cast("int"))
    counts = lambda at: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(at, lambda p: p == d)).cast("double"))
    return let(places, counts)


def _encoded(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """Rows (sentences, ...) with their vectors; the model is loaded once for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for batch in batches:
            flat = batch.column(0).flatten().to_pylist()
            made = [[float(x) for x in v] for v in encode(flat)] if flat else []
            sizes = [len(x) for x in batch.column(0)]
            ends = list(accumulate(sizes))
            vectors = [made[end - n : end] for n, end in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.list_(pa.float64())))], [*batch.schema.names, "__vectors"])

    return run


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _distance(a: Column, b: Column) -> Column:
    size = F.sqrt(_dot(a, a) * _dot(b, b))
    return F.when(size > 0, 1 - _dot(a, b) / size).otherwise(F.lit(1.0))


def _mean(vectors: Column) -> Column:
    n = F.size(vectors)
    summed = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / n)


def percentile_of(values: Column, amount: float) -> Column:
    """The percentile of an array, linear between ranks."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * (amount / 100.0)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


#: Articles whose sentences are compared at once, and words whose buckets a worker remembers.
_COMPARED, _REMEMBERED = 256, 1 << 20


def _hashed_distances(dims: int, buffer: int) -> Callable:
    """Rows (words of each sentence, ...) with the distances of ``hashed_vector`` of sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for part in (b.slice(i, _COMPARED) for b in batches for i in range(0, b.num_rows, _COMPARED)):
            sents = part.column(0).flatten()
            told = sents.flatten().dictionary_encode()
            if len(known) > _REMEMBERED:
                known.clear()
            places = []
            for w in told.dictionary.to_pylist():
                if w not in known:
                    known[w] = int(md5(w.encode(), usedforsecurity=False).hexdigest()[:7], 16) % dims
                places.append(known[w])
            at = np.repeat(np.arange(len(sents)), pc.list_value_length(sents).to_numpy())
            cells = at * dims + np.array(places, np.int64)[told.indices.to_numpy()] if len(at) else at
            vectors = np.bincount(cells, minlength=len(sents) * dims).reshape(-1, dims).astype(float)
            counts = pc.list_value_length(part.column(0)).to_numpy()
            inner = np.maximum(counts - 2 * buffer, 0)
            offsets = np.concatenate([[0], np.cumsum(inner)])
            # Where the later group of each distance starts, among the sentences of all articles.
            later = np.repeat(np.cumsum(counts) - counts - offsets[:-1], inner) + np.arange(offsets[-1]) + buffer
            means = vectors[: len(vectors) - buffer + 1] if len(vectors) >= buffer else vectors[:0]
            if buffer > 1 and len(means):
                means = sum(vectors[j : len(vectors) - buffer + 1 + j] for j in range(buffer)) / buffer
            a, b = means[later - buffer], means[later]
            size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            away = np.where(size > 0, 1 - np.divide((a * b).sum(axis=1), size, out=np.zeros(len(size)), where=size > 0), 1.0)
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(away, pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], made], [*part.schema.names[1:], "distances"])

    return run


def sentence_distances(articles: DataFrame, buffer: int = 1, id_col: str = "doc_id", text_col: str = "content", embed=hashed_vector, load=None) -> DataFrame:
    """``(article_id, sents, distances)``: cosine distances between the means of the ``buffer``
    sentences before and from each inner sentence on.

    ``load`` returns a model, a function of a list of sentences that gives their vectors; it runs
    in Arrow batches.  Without one ``embed`` makes a vector by built-in expressions; the hashed
    one is counted word by word in Arrow batches instead, to the same distances.
    """
    named = articles.select(semantic_sentences(F.col(text_col)).alias("sents"), F.col(id_col).alias("article_id"), text_of(text_col).alias("__raw"))
    kind = articles.schema[id_col].dataType.simpleString()
    if load is None and embed is hashed_vector:
        tokens = F.transform("sents", lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\w+"), F.lit(0)))
        words = named.select(tokens.alias("__words"), "sents", "article_id", "__raw")
        return map_arrow(words, _hashed_distances(16, buffer), f"sents array<string>, article_id {kind}, __raw string, distances array<double>")
    n = F.size("sents")
    inner = F.when(n > 2 * buffer, F.sequence(F.lit(buffer), n - buffer - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda i: _mean(F.slice("__vectors", i + 1, F.lit(buffer)))
    if load is None:
        out = named.withColumn("__vectors", F.transform("sents", lambda s: embed(s)))
    else:
        out = map_arrow(named, _encoded(load), f"sents array<string>, article_id {kind}, __raw string, __vectors array<array<double>>")
    return out.withColumn("distances", F.transform(inner, lambda i: _distance(group(i - buffer), group(i)))).drop("__vectors")


def threshold(distances: Column, kind: str = "percentile", amount: float = 95.0) -> Column:
    """Above which distance the topic shifts: a percentile of the distances, a number of
    deviations over their mean, or a percentile of their gradients."""
    n = F.size(distances)
    if kind == "percentile":
        return percentile_of(distances, amount)
    if kind == "standard_deviation":
        mean = F.aggregate(distances, F.lit(0.0), lambda s, x: s + x) / n
        squares = F.aggregate(distances, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
        return mean + amount * F.sqrt(squares)
    if kind == "gradient":
        at = lambda i: F.get(distances, i)
        inner = lambda i: (at(F.least(i + 1, n - 1)) - at(F.greatest(i - 1, F.lit(0)))) / (F.least(i + 1, n - 1) - F.greatest(i - 1, F.lit(0)))
        slopes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.abs(inner(i)))
        return F.when(n > 1, percentile_of(slopes, amount)).otherwise(F.lit(0.0))
    raise ValueError(f"unknown kind of threshold: {kind}")


def _merged(smallest: int, largest: int, buffer: int, keep_small: bool) -> Callable:
    """Rows (sentences, distances, limit, raw text, id) as rows (id, chunk_id, text, word_count);
    an article without distances is its raw text, whose words are not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, _COMPARED) for b in batches for i in range(0, b.num_rows, _COMPARED)):
            flat = part.column(0).flatten()
            words = [0, *accumulate(pc.count_substring_regex(flat, "[^ ]+").to_pylist())]
            whole, rows, base = [], [], 0
            for at, (count, limit) in enumerate(zip(pc.list_value_length(part.column(0)).to_pylist(), part.column(2).to_pylist(), strict=True)):
                away = part.column(1)[at].as_py()
                if not away:
                    whole.append(at)
                else:
                    starts = [base, *(base + i + buffer for i, d in enumerate(away) if d > limit), base + count]
                    done, first = [], base
                    for start, end in zip(starts, starts[1:]):
                        if words[start] > words[first] and words[end] - words[first] > largest:
                            done.append((first, start))
                            first = start
                    done.append((first, base + count))
                    kept = [x for x in done if keep_small or words[x[1]] - words[x[0]] >= smallest]
                    rows += [(at, k, start, end, words[end] - words[start]) for k, (start, end) in enumerate(kept)]
                base += count
            at, k, start, end, n = np.array(rows, np.int64).reshape(-1, 5).T
            for places, numbers, texts, counts in (
                (at, pa.array(k, pa.int32()), joined_runs(flat, start, end), pa.array(n, pa.int32())),
                (whole, pa.array([0] * len(whole), pa.int32()), part.column(3).take(pa.array(whole, pa.int64())), pa.nulls(len(whole), pa.int32())),
            ):
                yield pa.RecordBatch.from_arrays([part.column(4).take(pa.array(places, pa.int64())), numbers, texts, counts], ["article_id", "chunk_id", "text", "word_count"])

    return run


def semantic_chunks(
    articles: DataFrame,
    smallest: int = OVERLAP_WORDS,
    largest: int = CHUNK_WORDS,
    kind: str = "percentile",
    amount: float = 95.0,
    buffer: int = 1,
    keep_small: bool = True,
    id_col: str = "doc_id",
    text_col: str = "content",
    embed=hashed_vector,
    load=None,
) -> DataFrame:
    """``(article_id, chunk_id, text, word_count)``: groups of sentences between topic shifts,
    merged up to ``largest`` words.

    Chunks under ``smallest`` words stay unless ``keep_small`` is off, which loses their text.
    An article of too few sentences to compare is one chunk, whole.
    """
    found = sentence_distances(articles, buffer, id_col, text_col, embed, load)
    limit = F.when(F.size("distances") > 0, threshold(F.col("distances"), kind, amount))
    # In one pass: as expressions a lambda would work out the limit, or the cuts, for each sentence again.
    told = found.select("sents", "distances", limit.cast("double").alias("__limit"), "__raw", "article_id")
    of = articles.schema[id_col].dataType.simpleString()
    each = map_arrow(told, _merged(smallest, largest, buffer, keep_small), f"article_id {of}, chunk_id int, text string, word_count int")
    return each.withColumn("word_count", F.coalesce("word_count", word_count(F.col("text"))))
