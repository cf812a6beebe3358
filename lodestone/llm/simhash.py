"""Near duplicates by SimHash fingerprints, bucketed with a Golay code.

Fingerprints of whole texts come from one Arrow pass.  Equal ones collapse to one node before
anything else, so a text with thousands of copies is one row from there on.  Each node is filed
under the keys of :func:`fingerprints.bucket_keys`, which are range-partitioned and sorted, so
that a bucket is a run of rows; all pairs of a run are compared where it lies, and those links
that connect something new come out, fewer than the run has rows.  Runs that are very long, or
that the edge of a partition may cut, are settled by :mod:`buckets`.  Components of all links
give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import buckets, fingerprints, judged
from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow
from lodestone.plans.components import connected_components

#: The distance that the bucket keys are made for.
MAX_BITS = 3


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        prints = [fingerprints.fingerprint(t.as_py()) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "fp"]
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            rows, keys = fingerprints.bucket_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "node"])


def linked(rows: pa.RecordBatch) -> tuple[list[int], list[int]]:
    """A spanning forest of the close pairs within each run of equal keys (key, node)."""
    keys, nodes = (c.to_numpy() for c in rows.columns)
    label, a, b = np.arange(len(keys)), [], []
    for lag in range(1, len(keys)):
        same = keys[lag:] == keys[:-lag]
        if not same.any():
            break
        near = same & (label[lag:] != label[:-lag])
        near &= np.bitwise_count((nodes[lag:] ^ nodes[:-lag]).view(np.uint64)) <= MAX_BITS
        for i in np.flatnonzero(near).tolist():
            x, y = int(label[i]), int(label[i + lag])
            if x != y:
                run = slice(*np.searchsorted(keys, [keys[i], keys[i] + 1]))
                label[run][label[run] == y] = x
                a.append(int(nodes[i]))
                b.append(int(nodes[i + lag]))
    return a, b


def _close(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)`` of different fingerprints within the distance, whose components are those of
    all such pairs; ``prints`` has each ``fp`` once.

    Not every pair is listed: those inside a component that others connect are left out.
    """
    keyed = map_arrow(prints.select("fp"), _keys, "key bigint, node bigint")
    found, rows = buckets.settled(keyed, ["node"], linked, ["key", "node"])
    first = scratch.written(found.distinct(), narrow=True)
    rest = buckets.open_rows(rows, connected_components(first))
    return first.unionByName(buckets.crossing(rest, _close("a.node", "b.node")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` for each row: its fingerprint (signed) and the least id reachable
    over links of at most three differing bits.

    Null and wordless texts have fingerprint zero and link like any other.  A null id never
    names a group: its row gets the group's least id, or null where no other id is in it.
    Repeated rows come out as often as they come in; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = scratch.written(map_arrow(narrow, _prints, f"id {kind}, fp bigint"))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    found = connected_components(links(nodes)).withColumnRenamed("node", "fp")
    named = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = named.filter("component is not null").groupBy("root").agg(F.min("least").alias("of_root"))
    groups = named.join(least, "root", "left").select("fp", F.coalesce("of_root", "least").alias("component"))
    return rows.join(groups, "fp").select("id", "fp", "component")


def without(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The documents, less those whose id is another one than its group's ``(id, component)``.

    Rows with a null id stay, as no group can be named by them.  Of an id that repeats all rows
    stay if one of them does.
    """
    each = groups.filter("id is not null").groupBy("id").agg(F.every(F.col("id") != F.col("component")).alias("copy"))
    return judged.without(docs, each.filter("copy").select("id"), [F.col(id_col)])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of :func:`simhash_groups`, that with its least id; see :func:`without`."""
    return without(docs, simhash_groups(docs, id_col, text_col), id_col)
