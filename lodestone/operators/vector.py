"""Vector search: exact top-k of a stated query set, and an index of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.plans.arrow import map_arrow
from lodestone.plans.best import Best

#: Queries of one pass over the corpus, and how many of them and of a batch's rows are compared at once.
QUERY_BLOCK, TILE = 16_384, (256, 2048)


def _numbers(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that have so many numbers and no null, and those as a matrix."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten()
    if flat.null_count:
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size).all(axis=1)
        rows = rows[whole]
        flat = column.take(pa.array(rows)).flatten()
    return rows, flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), size)


def _scored(ids: list, matrix: np.ndarray, k: int, metric: str):
    """The k best rows of a partition for each query of a block.

    Queries and rows meet tile by tile, and of each query only its k best so far are held: memory
    is bounded by the block, however large the partition.
    """

    def compared(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            size = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1))
            return np.divide(q @ v.T, size, out=np.zeros(size.shape), where=size > 0)
        return 1 - ((q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * q @ v.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches if len(ids) else ():
            for start in range(0, batch.num_rows, TILE[1]):
                part = batch.slice(start, TILE[1])
                rows, corpus = _numbers(part.column(1), matrix.shape[1])
                if not len(rows):
                    continue
                names = part.column(0).to_numpy(zero_copy_only=False)[rows]
                for first in range(0, len(ids), TILE[0]):
                    best.add(first, compared(matrix[first : first + TILE[0]], corpus), names)
        yield from best.rows(ids, ["query_id", "vec_id", "similarity"])

    return run


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, vec_id, similarity, rank)``: the k nearest vectors of the corpus to each query.

    Exact: each task keeps the k best of its rows for every query, so what is shuffled is k rows
    for each task and query whatever the corpus.  Queries ``(query_id, query_vec)`` come in
    blocks, each of which makes one pass; every query meets every vector, so the time is their
    product and the memory of a task a block's.  Ties fall to the least id; null vectors and ones of
    another length are left out.
    """
    found = None
    block: list = []

    def searched(rows: list) -> DataFrame:
        ids = [r["query_id"] for r in rows]
        matrix = np.array([r["query_vec"] for r in rows], float).reshape(len(rows), -1)
        narrow = corpus.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("vec"))
        return map_arrow(narrow, _scored(ids, matrix, k, metric), "query_id bigint, vec_id bigint, similarity double")

    for row in queries.filter("query_vec is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "query_vec").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            found = searched(block) if found is None else found.unionByName(searched(block))
            block = []
    if block or found is None:
        last = searched(block)
        found = last if found is None else found.unionByName(last)
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by round(similarity, 9) desc, vec_id)"))
    return ranked.filter(F.col("rank") <= k)


def nearest_cells(rows: DataFrame, centroids: DataFrame, probes: int = 1, vec_col: str = "embedding") -> DataFrame:
    """The rows with ``cell``, their ``probes`` nearest of a bounded table ``(cell, centroid)``."""
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("cell", "centroid"))).alias("__cells"))
    joined = rows.crossJoin(F.broadcast(table))  # one row, as large as the table of centroids
    scored = F.transform("__cells", lambda c: F.struct((-vectors.cosine(F.col(vec_col), c["centroid"])).alias("a"), c["cell"].alias("cell")))
    return joined.withColumn("cell", F.explode(F.slice(F.array_sort(scored), 1, probes)["cell"])).drop("__cells")


def cell_centroids(rows: DataFrame, cells: int, sample: int = 10_000, rounds: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(cell, centroid)`` from k-means over at most ``sample`` rows picked by a hash of their id."""
    total = rows.count()
    every = max(1, total // sample)
    picked = rows.filter(F.col(vec_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)).select(id_col, vec_col).limit(2 * sample).collect()
    picked.sort(key=lambda r: r[id_col])
    x = np.array([r[vec_col] for r in picked], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    chosen = [0]
    away = 1 - x @ x[0]
    while len(chosen) < min(cells, len(x)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, 1 - x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        centres = np.array([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>")
