"""Full-text search: an inverted index as a table, and ranked look-ups in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow
from lodestone.plans.best import Best
from lodestone.plans.size import SMALL_ROWS, small

TOKEN = r"(?U)\w{2,}"


#: Texts whose terms are counted at once, and sums of a tile of texts and queries.
_TEXTS, _SUMS = 1024, 4_000_000


def _tokens(text_col: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN), F.lit(0))


def _terms(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.explode(_tokens(text_col)).alias("term"))


def inverted_index(rows: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``(term, id, tf)``: a row for each term of a text, with how often it occurs.

    Postings are rows, so a term that very many texts have is never gathered; written sorted by
    term, a look-up reads the row groups of its terms.  Null and empty texts have no terms.
    """
    return _terms(rows, id_col, text_col).groupBy("term", "id").agg(F.count("*").alias("tf"))


def vocabulary(index: DataFrame) -> DataFrame:
    """``(term, df, cf)``: in how many texts a term occurs, and how often in all."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def look_up(index: DataFrame, queries: DataFrame, texts: int, k: int = 10, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """``(query_id, id, score, rank)``: the k best texts of each of a stated set of queries by
    the sum of tf times ln(1 + texts / df) over its distinct terms; ties fall to the least id.

    Queries are broadcast behind a check of their size, so only postings of their terms move.
    """
    asked = small(_terms(queries, id_col, text_col).distinct().withColumnRenamed("id", "query_id"))
    hits = index.join(asked, "term")
    weight = vocabulary(index.join(asked.select("term").distinct(), "term", "left_semi"))
    weight = weight.select("term", F.log1p(F.lit(float(texts)) / F.col("df")).alias("w"))
    scored = hits.join(small(weight), "term").groupBy("query_id", "id").agg(F.sum(F.col("tf") * F.col("w")).alias("score"))
    rank = F.expr("row_number() over (partition by query_id order by round(score, 9) desc, id)")
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _counted(terms: list[str]) -> Callable:
    """Rows (id, words) as rows (id, codes, tfs) of those of the terms that a text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(terms)}
        for part in (b.slice(i, _TEXTS) for b in batches for i in range(0, b.num_rows, _TEXTS)):
            told = part.column(1).flatten().dictionary_encode()
            code = np.array([known.get(w, -1) for w in told.dictionary.to_pylist()] or [-1], np.int64)[told.indices.to_numpy()]
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(1)).to_numpy())[code >= 0]
            pairs, times = np.unique(row * max(1, len(terms)) + code[code >= 0], return_counts=True)
            row, code = np.divmod(pairs, max(1, len(terms)))
            rows, sizes = np.unique(row, return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (code, times)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *lists], ["id", "codes", "tfs"])

    return run


def _met(terms: int) -> Callable:
    """Rows (code, df): in how many of a partition's texts each of so many terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(terms, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["code", "df"])

    return run


def _ranked(ids: list, queries: np.ndarray, bounds: np.ndarray, weights: np.ndarray, k: int) -> Callable:
    """Rows (id, codes, tfs) as rows (query_id, id, score): the k best of a partition for each query.

    The queries that ask for a term lie in ``queries`` between its ``bounds``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        texts = min(_TEXTS, max(1, _SUMS // max(1, len(queries))))
        for part in (b.slice(i, texts) for b in batches for i in range(0, b.num_rows, texts)):
            codes, tfs = (part.column(c).flatten().to_numpy() for c in (1, 2))
            text = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(1)).to_numpy())
            many = bounds[codes + 1] - bounds[codes]
            asking = queries[np.repeat(bounds[codes] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            sums = np.bincount(asking * part.num_rows + np.repeat(text, many), np.repeat(tfs * weights[codes], many), len(ids) * part.num_rows)
            scores = sums.reshape(len(ids), part.num_rows)
            best.add(0, np.where(scores > 0, scores, -np.inf), part.column(0).to_numpy())
        yield from best.rows(ids, ["query_id", "id", "score"])

    return run


def find(rows: DataFrame, queries: DataFrame, texts: int, k: int = 10, text_id: str = "chunk_id", text_col: str = "text", id_col: str = "query_id", query_col: str = "query", limit: int = SMALL_ROWS) -> DataFrame:
    """What ``look_up`` finds in the index of the rows, for queries that are asked once.

    No index is made: terms that are asked for are counted where texts lie, a row for each text,
    and each task holds the k best of its texts for every query, whatever their number.  Ids are
    whole numbers; texts without one are left out, and rows of one id are one text.  Queries of
    more than ``limit`` terms are looked up in an index.
    """
    asked = _terms(queries, id_col, query_col).distinct().withColumnRenamed("id", "query_id")
    told = asked.limit(limit + 1).collect()
    whole = ("bigint", "int")
    if len(told) > limit or rows.schema[text_id].dataType.simpleString() not in whole or queries.schema[id_col].dataType.simpleString() not in whole:
        return look_up(scratch.written(inverted_index(rows, text_id, text_col)), queries, texts, k, id_col, query_col)
    told = [r for r in told if r["query_id"] is not None]
    terms, ids = sorted({r["term"] for r in told}), sorted({r["query_id"] for r in told})
    code, place = ({x: i for i, x in enumerate(xs)} for xs in (terms, ids))
    pairs = np.array(sorted((code[r["term"]], place[r["query_id"]]) for r in told), np.int64).reshape(-1, 2)
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    words = rows.filter(F.col(text_id).isNotNull()).select(F.col(text_id).cast("bigint").alias("id"), _tokens(text_col).alias("words"))
    counted = scratch.written(map_arrow(words, _counted(terms), "id bigint, codes array<int>, tfs array<int>"))
    if counted.groupBy("id").count().filter("count > 1").limit(1).count():
        each = counted.select("id", F.explode(F.arrays_zip("codes", "tfs")).alias("x")).groupBy("id", "x.codes").agg(F.sum("x.tfs").alias("tf"))
        merged = each.groupBy("id").agg(F.collect_list(F.struct("codes", F.col("tf").cast("int").alias("tfs"))).alias("x"))
        counted = scratch.written(merged.select("id", F.col("x.codes").alias("codes"), F.col("x.tfs").alias("tfs")))
    met = map_arrow(counted.select("codes"), _met(len(terms)), "code int, df bigint").groupBy("code").agg(F.sum("df").alias("df")).collect()
    weights = np.zeros(len(terms))
    weights[[r["code"] for r in met]] = np.log1p(texts / np.array([r["df"] for r in met], float))
    found = map_arrow(counted, _ranked(ids, pairs[:, 1], bounds, weights, k), "query_id bigint, id bigint, score double")
    rank = F.expr("row_number() over (partition by query_id order by round(score, 9) desc, id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
