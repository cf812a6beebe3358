"""Comparison of two versions of a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.functions.text import contains_any, normalized, pieces, text_of, text_stats, word_count, words
from lodestone.plans.arrow import map_arrow, ship

# Words that the comparison leaves out, and its signs of a paywall.
STOP_WORDS = ("a", "aj", "ako", "ale", "alebo", "aby", "by", "bol", "bola", "bolo", "do", "je", "na", "nie", "od", "po", "pre", "pri", "sa", "si", "so", "sú", "to", "v", "vo", "z", "za", "že")
PAYWALL_SIGNS = ("prémium členov", "premium členov", "platených členov", "registrácia", "prihlásiť sa", "predplatné", "webinár", "pokračovanie článku")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, for which Spark has no function."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])


def ratio(a: Column, b: Column) -> Column:
    """The smaller over the larger; one if both are zero, zero if one is."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).when((a == 0) & (b == 0), 1.0).otherwise(0.0)


def _meaning(text: Column, stop: Sequence[str]) -> Column:
    return F.filter(words(normalized(text)), lambda w: ~w.isin(*stop)) if stop else words(normalized(text))


def jaccard(a: Column, b: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Common over all different words; zero when either has none."""
    x, y = F.array_distinct(_meaning(a, stop)), F.array_distinct(_meaning(b, stop))
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), common / (F.size(x) + F.size(y) - common)).otherwise(0.0)


def bags(pairs: DataFrame, key: str, a: str, b: str, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``(key, cosine, overlap)`` of the words of two texts: the cosine of their counts and the
    share of common words, zero where either has none.

    Words of both texts are counted by group at once, so texts of any length are compared
    without an array of their vocabulary; keys must be unique.
    """
    side = lambda c, first: pairs.select(F.col(key), F.explode(_meaning(F.col(c), stop)).alias("w"), F.lit(int(first)).alias("n1"), F.lit(int(not first)).alias("n2"))
    counts = side(a, True).unionByName(side(b, False)).groupBy(key, "w").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    x, y = F.col("n1"), F.col("n2")
    sums = counts.groupBy(key).agg(
        F.sum(x * y).alias("dot"), F.sum(x * x).alias("s1"), F.sum(y * y).alias("s2"),
        F.count_if((x > 0) & (y > 0)).alias("common"), F.count("*").alias("every"),
    )
    some = (F.col("s1") > 0) & (F.col("s2") > 0)
    told = sums.select(
        F.col(key),
        F.when(some, F.col("dot") / F.sqrt(F.col("s1").cast("double") * F.col("s2"))).alias("cosine"),
        F.when(some, F.col("common") / F.col("every")).alias("overlap"),
    )
    joined = pairs.select(key).join(told, key, "left")
    return joined.select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("cosine", "overlap")))


def compare(pairs: DataFrame, key: str = "pair_id", stop: Sequence[str] = STOP_WORDS, titles: bool = True) -> DataFrame:
    """Pairs (key, text_a, text_b, title_a, title_b) with length and word ratios, overlap, cosine
    and, with ``titles``, title similarity.  Null texts count as empty; keys must be unique."""
    ship(pairs.sparkSession)
    a, b = text_of("text_a"), text_of("text_b")
    told = bags(pairs, key, "text_a", "text_b", stop).toDF(key, "similarity_score", "content_overlap")
    out = (
        pairs.withColumn("length_ratio", ratio(F.length(a), F.length(b)))
        .withColumn("word_count_ratio", ratio(word_count(a), word_count(b)))
        .join(told, key)
    )
    return out.withColumn("title_similarity", sequence_ratio(normalized(F.col("title_a")), normalized(F.col("title_b")))) if titles else out


def pair_issues(compared: DataFrame, signs: Sequence[str] = PAYWALL_SIGNS) -> DataFrame:
    """Compared pairs, with ``fetched_paywall``, with an array of issues (type, severity)."""
    length, overlap = F.col("length_ratio"), F.col("content_overlap")
    issue = lambda when, kind, level: F.when(when, F.struct(F.lit(kind).alias("type"), (level if isinstance(level, Column) else F.lit(level)).alias("severity")))
    had = contains_any(F.lower(text_of("text_a")), signs)
    return compared.withColumn("issues", F.array_compact(F.array(
        issue(length < 0.5, "length_mismatch", F.when(length < 0.2, "critical").otherwise("major")),
        issue(overlap < 0.3, "content_mismatch", F.when(overlap < 0.1, "critical").otherwise("major")),
        issue(F.col("title_similarity") < 0.7, "title_mismatch", "minor"),
        issue(had != F.coalesce("fetched_paywall", F.lit(False)), "paywall_status_change", "major"),
        issue(F.col("word_count_ratio") < 0.3, "word_count_change", "major"),
    )))


def pair_structure(pairs: DataFrame) -> DataFrame:
    """Pairs with the ratio and difference of each text statistic."""
    both = pairs.withColumn("__a", text_stats(F.col("text_a"))).withColumn("__b", text_stats(F.col("text_b")))
    names = ("char_count", "word_count", "sentence_count", "paragraph_count", "avg_word_length", "avg_sentence_length")
    for n in names:
        a, b = F.col(f"__a.{n}"), F.col(f"__b.{n}")
        both = both.withColumn(f"{n}_ratio", ratio(a, b)).withColumn(f"{n}_difference", F.abs(a - b))
    return both.drop("__a", "__b")


#: Classes of characters whose counts tell sentences apart, and sentences counted at once.
_CLASSES, _COUNTED = 64, 4096


def _class_counts(texts: Sequence[str]) -> np.ndarray:
    """How many characters of each class the texts have, a row each."""
    out = np.zeros((len(texts), _CLASSES), np.int32)
    for start in range(0, len(texts), _COUNTED):
        part = texts[start : start + _COUNTED]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4") % _CLASSES
        rows = np.repeat(np.arange(len(part)), [len(t) for t in part])
        out[start : start + len(part)] = np.bincount(rows * _CLASSES + codes, minlength=len(part) * _CLASSES).reshape(-1, _CLASSES)
    return out


def _like_any(others: list[str], limit: float) -> Callable[[str], bool]:
    """Whether a text is equal to, or has a ratio over ``limit`` with, any of the others.

    No ratio is greater than what the lengths or the counts of characters allow, so only the few
    whose bounds are over the limit are compared.
    """
    known, counts, ready = set(others), None, {}
    sizes = np.array([len(o) for o in others], np.int64)

    def told(text: str) -> bool:
        nonlocal counts
        if text in known:
            return True
        if not text or not others:
            return False
        near = np.flatnonzero(np.minimum(sizes, len(text)) * 2 / (sizes + len(text)) > limit)
        if not len(near):
            return False
        counts = _class_counts(others) if counts is None else counts
        common = np.minimum(counts[near], _class_counts([text])).sum(axis=1)
        for at in near[common * 2 / (sizes[near] + len(text)) > limit]:
            if others[at] not in ready:
                ready[others[at]] = SequenceMatcher(None, "", others[at])
            ready[others[at]].set_seq1(text)
            if ready[others[at]].ratio() > limit:
                return True
        return False

    return told


def _unlike(limit: float, first: int) -> Callable:
    """Rows (key, sentences and their norms of a, those of b) as rows (key, side, place, sentence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                own_a, norm_a, own_b, norm_b = (batch.column(c)[i].as_py() for c in range(1, 5))
                for side, own, norms, others in (("a", own_a, norm_a, norm_b), ("b", own_b, norm_b, norm_a)):
                    like, kept = _like_any(others, limit), 0
                    for place, (sentence, norm) in enumerate(zip(own, norms, strict=True)):
                        if kept == first:
                            break
                        if not like(norm):
                            at.append(i)
                            rows.append((side, place, sentence))
                            kept += 1
            sides, places, sentences = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(sides, pa.string()), pa.array(places, pa.int32()), pa.array(sentences, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "side", "place", "sentence"])

    return run


def unique_sentences(pairs: DataFrame, key: str = "pair_id", limit: float = 0.8, first: int = 5) -> DataFrame:
    """``(key, side, place, sentence)``: sentences of one text without a similar one in the
    other, the first of each side.

    A pair is one row that nothing shuffles; its sentences are looked at in order until ``first``
    of a side are found.  Equal ones are told by a set, most unlike ones by lengths and counts of
    characters.
    """
    both = pairs.select(key, *(pieces(F.col(f"text_{x}")).alias(f"own_{x}") for x in "ab"))
    norms = lambda x: F.transform(f"own_{x}", normalized).alias(f"norm_{x}")
    kind = pairs.schema[key].dataType.simpleString()
    return map_arrow(both.select(key, "own_a", norms("a"), "own_b", norms("b")), _unlike(limit, first), f"`{key}` {kind}, side string, place int, sentence string")
