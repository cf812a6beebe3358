"""The k best of very many rows for each of a block of queries, held by a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Queries whose rows are handed over at once.
_QUERIES = 256


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row by score and then by name."""
    if scores.shape[1] <= 4 * k:
        return np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :k]
    few = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    ties = (scores >= np.take_along_axis(scores, few, 1).min(axis=1, keepdims=True)).sum(axis=1).max()
    if ties > k:  # any that are as good as the k-th may have lesser names
        few = np.argpartition(-scores, ties - 1, axis=1)[:, :ties]
    order = np.lexsort((names[few], -np.take_along_axis(scores, few, 1)), axis=1)[:, :k]
    return np.take_along_axis(few, order, 1)


class Best:
    """Of each query the scores, those rounded to nine digits and the names of its best so far;
    ties fall to the least name and what is -inf is nothing."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.raw, self.rounded = np.full((queries, k), -np.inf), np.full((queries, k), -np.inf)
        self.names = np.zeros((queries, k), np.int64)

    def add(self, first: int, scores: np.ndarray, names: np.ndarray) -> None:
        """Scores of rows with these names, a row of the matrix for each query from ``first`` on."""
        tidy = np.round(scores, 9)
        some = np.flatnonzero((tidy >= self.rounded[first : first + len(tidy), -1:]).any(axis=1))
        if not len(some):
            return
        at = first + some
        few = _best(tidy[some], names, self.k)
        rounded = np.hstack([self.rounded[at], np.take_along_axis(tidy[some], few, 1)])
        raw = np.hstack([self.raw[at], np.take_along_axis(scores[some], few, 1)])
        named = np.hstack([self.names[at], names[few]])
        keep = np.lexsort((named, -rounded), axis=1)[:, : self.k]
        self.rounded[at], self.raw[at], self.names[at] = (np.take_along_axis(x, keep, 1) for x in (rounded, raw, named))

    def rows(self, ids: list, columns: list[str]) -> Iterator[pa.RecordBatch]:
        """Rows (query, name, score) of all that is held."""
        queries = np.array(ids, np.int64)
        for first in range(0, len(ids), _QUERIES):
            block = slice(first, first + _QUERIES)
            q, place = np.nonzero(self.rounded[block] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (queries[block][q], self.names[block][q, place], self.raw[block][q, place])], columns)
