"""Pairs out of buckets, without all the pairs of a group.

Rows ``(key, node, ...)`` file nodes under keys.  :func:`shared` range-partitions them by key
and node, so that a key of any size spreads over partitions, and leaves those whose key another
row has, each with the row before it.  Neighbours in that order, and in random ones
(:func:`neighbours`), connect most of what belongs together.  :func:`crossing` then gives every
other pair that matters: of nodes that share a key but no component yet, out of the rows that
:func:`open_rows` leaves.  A key all of whose nodes are in one component gives no pairs, so a
group of like nodes costs a few pairs for each of its rows and not the square of its size.
:func:`settled` compares the rows of a key where they lie, so that only pairs worth keeping ever
become rows; what is too long for one task, or cut by its edge, comes back for :func:`crossing`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow
from lodestone.plans.size import small


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key an adjacent row has, and the first and last of the partition, each with
    the other columns of the row before it if that has its key."""
    held: pa.RecordBatch | None = None  # the last two rows seen; the first of them is done with
    first = True

    def told(rows: pa.RecordBatch, done: int, ending: bool) -> pa.RecordBatch:
        """The rows from ``done`` on whose successor is known."""
        n = len(rows) if ending else len(rows) - 1
        keys = rows.column(0)
        same = pc.equal(keys[1:], keys[:-1])
        none = pa.array([False])
        before, after = pa.concat_arrays([none, same]), pa.concat_arrays([same, none])
        kept = pc.or_(before, after).to_numpy(zero_copy_only=False).copy()
        if first:
            kept[0] = True
        if ending:
            kept[-1] = True
        columns, names = list(rows.columns), list(rows.schema.names)
        for name, column in zip(rows.schema.names[1:], rows.columns[1:], strict=True):
            shifted = pa.concat_arrays([pa.nulls(1, column.type), column[:-1]])
            columns.append(pc.if_else(before, shifted, pa.scalar(None, column.type)))
            names.append(f"prev_{name}")
        kept[:done] = False
        return pa.RecordBatch.from_arrays(columns, names).slice(0, n).filter(pa.array(kept[:n]))

    done = 0
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if len(rows) > 1:
            yield told(rows, done, False)
            first = False
            held, done = rows.slice(len(rows) - 2), 1
        else:
            held, done = rows, 0
    if held is not None:
        yield told(held, done, True)


def shared(keyed: DataFrame, order: list[str]) -> DataFrame:
    """The rows of ``keyed`` (``key`` first) whose key another row has, each with ``prev_``
    columns of the row before it; written.  Rows of an edge between partitions stay in any case."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields]
    fields += [f"prev_{x}" for x in fields[1:]]
    dealt = keyed.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    return scratch.written(map_arrow(dealt, _runs, ", ".join(fields)), narrow=True)


Compare = Callable[[pa.RecordBatch], tuple[list[int], list[int]]]
#: Rows of a key whose pairs are all compared in its task; longer runs are split.
LONG_RUN = 20_000


def settling(compare: Compare, long_run: int, whole: bool = False):
    """Rows sorted by key as pairs ``(a, b)``, the other columns null, of what ``compare`` finds in
    runs of equal keys; and, with null pairs, the rows of runs that are not settled here: those
    that are too long, and unless keys are ``whole`` the partition's first and last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: pa.RecordBatch, a: list[int] | None, b: list[int] | None) -> pa.RecordBatch:
            n = len(rows) if a is None else len(a)
            own = rows.columns if a is None else [pa.nulls(n, c.type) for c in rows.columns]
            ends = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (a, b)]
            return pa.RecordBatch.from_arrays([*own, *ends], [*rows.schema.names, "a", "b"])

        held: pa.RecordBatch | None = None  # a run that may go on
        unsettled = None  # a key whose rows are all left: the partition's first, or a long run's
        for batch in batches:
            if not len(batch):
                continue
            if unsettled is None and not whole:
                unsettled = batch.column(0)[0].as_py()
            rows = batch if held is None or not len(held) else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = rows.column(0).to_numpy()
            if unsettled is not None and (at := int(np.searchsorted(keys, unsettled, side="right"))):
                yield made(rows.slice(0, at), None, None)
                rows, keys = rows.slice(at), keys[at:]
            held = rows.slice(0, 0)
            if not len(rows):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            done, held = rows.slice(0, last), rows.slice(last)
            starts = np.flatnonzero(np.r_[True, keys[1:last] != keys[: last - 1]]) if last else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, last])
            long = np.repeat(sizes > long_run, sizes)
            if long.any():
                yield made(done.filter(pa.array(long)), None, None)
                done = done.filter(pa.array(~long))
            if len(done):
                yield made(done, *compare(done))
            if len(held) > long_run:
                unsettled = int(keys[-1])
                yield made(held, None, None)
                held = rows.slice(0, 0)
        if held is not None and len(held):
            yield made(held, *(compare(held) if whole else (None, None)))

    return run


def settled(rows: DataFrame, order: list[str], compare: Compare, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` of what ``compare`` finds among the rows of each key, and the columns ``keep`` of
    the rows of keys that are not settled.

    Rows that tell the ``size`` of their key are dealt by keys, but for those of longer runs, which
    are left at once; others are range-partitioned, and runs at the edges of partitions are left.
    """
    told = "size" in rows.columns
    short = rows.filter(F.col("size") <= LONG_RUN).drop("size") if told else rows
    dealt = short.repartition("key") if told else short.repartitionByRange("key", *order)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in short.schema.fields]
    found = map_arrow(dealt.sortWithinPartitions("key", *order), settling(compare, LONG_RUN, told), ", ".join([*fields, "a bigint", "b bigint"]))
    found = scratch.written(found.select("a", "b", *keep), narrow=True)
    left = found.filter("a is null").select(*keep)
    if told:
        left = left.unionByName(rows.filter(F.col("size") > LONG_RUN).select(*keep))
    return found.filter("a is not null").select("a", "b"), left


def neighbours(rows: DataFrame, salts: Sequence[int]) -> DataFrame:
    """The rows with ``prev_`` columns as of :func:`shared`, once for each salt, in an order of a
    key's rows that the salt makes; rows without a neighbour are left out."""
    own = [c for c in rows.columns if not c.startswith("prev_")]
    each = rows.select(*own, F.explode(F.array(*map(F.lit, salts))).alias("__salt"))
    each = each.select(F.xxhash64("key", "__salt").alias("key"), *own[1:], F.xxhash64("node", "__salt").alias("__order"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in each.schema.fields]
    fields += [f"prev_{x}" for x in fields[1:]]
    dealt = each.repartitionByRange("key", "__order").sortWithinPartitions("key", "__order")
    return map_arrow(dealt, _runs, ", ".join(fields)).filter("prev_node is not null")


def open_rows(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows, with ``component`` and the ``size`` of their key, of keys whose nodes lie in
    several components; ``members`` are ``(node, component)``, and other nodes are components of
    their own.  Written."""
    found = rows.drop("component", "size", *(c for c in rows.columns if c.startswith("prev_"))).join(small(members), "node", "left")
    found = found.select("key", *(c for c in found.columns if c not in ("key", "component")), F.coalesce("component", "node").alias("component"))
    ends = found.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    return scratch.written(found.join(ends.filter("low < high").select("key", "size"), "key"), narrow=True)


def crossing(rows: DataFrame, near: Column) -> DataFrame:
    """``(a, b)`` of nodes, a < b, of open rows that share a key, lie in different components and
    are ``near``, a condition on columns ``a.*`` and ``b.*``."""
    a, b = rows.alias("a"), rows.alias("b")
    apart = (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & apart & near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
