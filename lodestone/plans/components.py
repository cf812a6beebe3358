"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014);
those of a graph small enough to be broadcast by one task, so that a driver plans one query for
it and not two for each round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow
from lodestone.plans.size import SMALL_ROWS

#: A node is heavy if it has more than this share of all ends of edges; so few can be.
_HEAVY = 1 / 10_000


def _attached(rows: DataFrame, least: DataFrame, ends: int, small: int) -> DataFrame:
    """``rows`` with the columns of ``least`` for their ``u``.

    ``least`` has at most ``ends`` rows, and ``d``, its node's number of edges.  Beyond ``small``
    rows only heavy nodes are broadcast, fewer than 10,000 as their ``d`` sum up to ``ends`` at
    most; so no hub's edges are dealt to one task.
    """
    if ends <= small:
        return rows.join(F.broadcast(least.drop("d")), "u")
    least = scratch.written(least, narrow=True)
    heavy = F.col("d") > int(ends * _HEAVY)
    hubs = F.broadcast(least.filter(heavy).drop("d"))
    light = rows.join(hubs, "u", "left_anti").join(least.filter(~heavy).drop("d"), "u")
    return rows.join(hubs, "u").unionByName(light)


def _step(edges: DataFrame, count: int, small: int) -> DataFrame:
    """One large-star and one small-star step over ``count`` edges (u, v) with u > v.

    Each takes the least neighbour of every node by a pre-aggregating groupBy.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    least = least.select("u", F.least("u", "m").alias("m"), "d")
    large = _attached(both.filter("v > u"), least, 2 * count, small)
    large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    moved = _attached(large, least, count, small).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, component) of all edges (u, v) of whole numbers, which lie in this task."""
    edges = [np.stack([c.to_numpy() for c in batch.columns[:2]]) for batch in batches if batch.num_rows]
    if not edges:
        return
    nodes, ends = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    label = list(range(len(nodes)))

    def least(x: int) -> int:
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    for x, y in ends.reshape(2, -1).T.tolist():
        x, y = least(x), least(y)
        label[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[least(x) for x in label]])], ["node", "component"])


def connected_components(edges: DataFrame, small: int = SMALL_ROWS) -> DataFrame:
    """``(node, component)`` for each node of the edges ``(a, b)``; component is its least node.

    Loops, repeated edges, either direction and edges with a null end are allowed (the last
    are left out).  Rounds go on until nothing changes, about the logarithm of a component's
    size; each is written to the shared folder, which ends its lineage.  Nodes may be of any
    type that has an order.  At most ``small`` edges between whole numbers go to one task.
    """
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, before = scratch.folder(spark), None
    now = scratch.written(now, path, narrow=True)
    kind = now.schema["u"].dataType
    if kind.typeName() in ("integer", "long") and 0 < now.limit(small + 1).count() <= small:
        found = map_arrow(now.coalesce(1), _joined, f"node {kind.simpleString()}, component {kind.simpleString()}")
        return scratch.written(found, narrow=True)
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if state == before or state[0] == 0:
            break
        last, before, path = path, state, scratch.folder(spark)
        now = scratch.written(_step(now, state[0], small), path, narrow=True)
        scratch.remove(spark, last)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
