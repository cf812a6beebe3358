"""Exact threshold links between embeddings of a label, by dual traversal of cover trees.

Equal vectors of a label collapse to one class with a count, so copies are never paired.  The
classes of a label are one cell of a tree; a cell that is larger than a block is split among
pivots, which are spread far apart over a sample of it, and so on level by level, so pivots grow
in number with the data and none is kept by the driver.  Pairs of cells are followed down these
levels, and those whose covering radii rule out a close pair end there.  Each cell at the bottom
is a block with a cover tree of its own; a pair of blocks is traversed in one task, which returns
a count of links for each vector and a spanning forest of them, no more rows than vectors.
Pivots only decide how many pairs are ruled out, never which links are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import cover_tree
from lodestone.plans import scratch
from lodestone.plans.arrow import map_arrow, ship
from lodestone.plans.components import connected_components
from lodestone.plans.size import small

THRESHOLD = 0.93
#: Vectors in a block, about; vectors sampled of a cell for its pivots, pivots of a cell at most,
#: rows of a cell that are dealt to pivots at once, and levels, after which a cell that is still
#: too large is split by a hash.
BLOCK, SAMPLE, FANOUT, PART, LEVELS = 1024, 512, 64, 4096, 6
_TREES = 16
_BLOCKS = "label string, dim int, cell string, centre array<double>, radius double, keys binary, counts binary, vectors binary"


def _comparable(vec: Column) -> Column:
    """No null, infinite or NaN component, and not all zero."""
    x = vec.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; the largest component first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _chosen(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The pivots of a cell, farthest first over its sample."""
    label, dim, cell, size = key
    units = _units(np.stack(rows.sort_values("key")["vec"].to_numpy()).astype(float))
    wanted = min(len(units), FANOUT, max(2, -(-int(size) // BLOCK)))
    chosen, away = [0], 1 - units @ units[0]
    while len(chosen) < wanted:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, 1 - units @ units[chosen[-1]])
    n = len(chosen)
    return pd.DataFrame({"label": [label] * n, "dim": [dim] * n, "cell": [cell] * n, "pivot": range(n), "centre": units[chosen].tolist()})


def _dealt(key: tuple, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Rows of a cell with the cell of their nearest pivot and the distance to it.  A cell
    without pivots has one child, around zero."""
    if not len(rows):
        return pd.DataFrame({c: [] for c in (*_ROW, "parent", "away")})
    if len(pivots):
        pivots = pivots.sort_values("pivot")
        cosines = _units(np.stack(rows["vec"].to_numpy()).astype(float)) @ np.stack(pivots["centre"].to_numpy()).astype(float).T
        nearest = cosines.argmax(axis=1)
        away = np.sqrt(np.maximum(2 - 2 * cosines[np.arange(len(rows)), nearest], 0)) + cover_tree.SLACK
    else:
        nearest, away = np.zeros(len(rows), np.int64), np.ones(len(rows))
    cells = [f"{key[2]}.{i}" for i in nearest]
    return rows[_ROW[:-1]].assign(cell=cells, parent=key[2], away=away)


_ROW = ["label", "dim", "key", "n", "vec", "cell"]
_CELL = ["label", "dim", "cell"]


def _cells(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The classes with their ``cell`` at the bottom, and for each level the cells made there:
    ``(label, dim, parent, cell, centre, radius)``."""
    rows = scratch.written(classes.withColumn("cell", F.lit("")))
    bottom, levels = [], []
    for level in range(LEVELS):
        sizes = rows.groupBy(*_CELL).agg(F.count("*").alias("size"))
        large = scratch.written(sizes.filter(F.col("size") > BLOCK), narrow=True)
        if large.isEmpty():
            break
        bottom.append(rows.join(small(large), _CELL, "left_anti").select(*_ROW))
        rows = rows.join(small(large), _CELL)
        every = F.ceil(F.col("size") / SAMPLE)
        sample = rows.filter(F.pmod(F.xxhash64("key", F.lit(level)), every) == 0)
        pivots = scratch.written(sample.groupBy(*_CELL, "size").applyInPandas(_chosen, "label string, dim int, cell string, pivot int, centre array<double>"))
        parts = F.ceil(F.col("size") / PART)
        apart = rows.select(*_ROW, F.pmod(F.xxhash64("key", F.lit("part")), parts).alias("part")).groupBy(*_CELL, "part")
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part")
        spread = pivots.join(large, _CELL).select(*_CELL, "pivot", "centre", each).groupBy(*_CELL, "part")
        schema = "label string, dim int, key bigint, n bigint, vec array<double>, cell string, parent string, away double"
        rows = scratch.written(apart.cogroup(spread).applyInPandas(_dealt, schema))
        made = rows.groupBy("label", "dim", "parent", "cell").agg(F.max("away").alias("radius"))
        centres = pivots.select("label", "dim", F.concat("cell", F.lit("."), F.col("pivot").cast("string")).alias("cell"), "centre")
        zero = F.array_repeat(F.lit(0.0), F.col("dim"))
        levels.append(scratch.written(made.join(centres, _CELL, "left").withColumn("centre", F.coalesce("centre", zero))))
        rows = rows.select(*_ROW)
    else:  # still too large: split by a hash, under the same centre
        sizes = rows.groupBy(*_CELL).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        rows = rows.withColumnRenamed("cell", "parent").join(sizes.withColumnRenamed("cell", "parent"), ["label", "dim", "parent"])
        part = F.pmod(F.xxhash64("key", F.lit("block")), F.col("parts")).cast("string")
        rows = scratch.written(rows.withColumn("cell", F.when(F.col("parts") > 1, F.concat("parent", F.lit("#"), part)).otherwise(F.col("parent"))))
        covering = levels[-1].select("label", "dim", F.col("cell").alias("parent"), "centre", "radius")
        parts = rows.filter("parts > 1").select("label", "dim", "parent", "cell").distinct()
        levels.append(scratch.written(parts.join(covering, ["label", "dim", "parent"])))
    for each in bottom:
        rows = rows.select(*_ROW).unionByName(each)
    return rows.select(*_ROW), levels


def _cell_pairs(cells: DataFrame, levels: list[DataFrame], reach: float) -> DataFrame:
    """``(label, dim, cell_a, cell_b)`` of the cells at the bottom that may hold a close pair,
    cell_a <= cell_b: pairs are followed down the levels and dropped where radii rule them out."""
    pairs = cells.select("label", "dim").distinct().select("label", "dim", F.lit("").alias("cell_a"), F.lit("").alias("cell_b"))
    for made in levels:
        for s in ("a", "b"):
            kids = made.select("label", "dim", F.col("parent").alias(f"cell_{s}"), *(F.col(c).alias(f"{c}_{s}_kid") for c in ("cell", "centre", "radius")))
            pairs = pairs.join(kids, ["label", "dim", f"cell_{s}"], "left")
        a, b = (F.coalesce(f"cell_{s}_kid", f"cell_{s}") for s in ("a", "b"))
        split = F.col("cell_a_kid").isNotNull() & F.col("cell_b_kid").isNotNull()
        near = ~split | (_distance("centre_a_kid", "centre_b_kid") <= F.col("radius_a_kid") + F.col("radius_b_kid") + reach)
        once = (F.col("cell_a") != F.col("cell_b")) | (a <= b)
        pairs = scratch.written(pairs.filter(once & near).select("label", "dim", a.alias("cell_a"), b.alias("cell_b")), narrow=True)
    return pairs


def _distance(a: str, b: str) -> Column:
    """The distance of two centres, which are unit vectors or zero."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("key")
    vectors = np.stack(rows["vec"].to_numpy()).astype(float)
    units = _units(vectors)
    tree = cover_tree.build(units)
    label, dim, cell = key
    return pd.DataFrame({
        "label": [label], "dim": [dim], "cell": [cell], "centre": [units[tree.centre].tolist()], "radius": [tree.radius],
        "keys": [rows["key"].to_numpy(np.int64).tobytes()], "counts": [rows["n"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()],
    })


def _forest(edges: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links of two blocks."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    kept = []
    for a, b in edges:
        for u, v in zip(a.tolist(), b.tolist(), strict=True):
            if (x := root(u)) != (y := root(v)):
                parent[x] = y
                kept.append((u, v))
    return kept


def _traversed(threshold: float):
    """Rows (a, b, links): for a vector how many it links to in this pair of blocks, b null; or
    an edge of the forest, links null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[tuple, tuple] = {}  # trees of the last few blocks

        def side(row: dict, s: str) -> tuple:
            name = (row["label"], row["dim"], row[f"cell_{s}"])
            if name not in built:
                if len(built) >= _TREES:
                    built.clear()
                keys = np.frombuffer(row[f"keys_{s}"], np.int64)
                units = _units(np.frombuffer(row[f"vectors_{s}"], np.float64).reshape(len(keys), -1))
                built[name] = (keys, np.frombuffer(row[f"counts_{s}"], np.int64), units, cover_tree.build(units))
            return built[name]

        for batch in batches:
            for row in batch.to_pylist():
                (ka, na, xa, ta), (kb, nb, xb, tb) = side(row, "a"), side(row, "b")
                same = row["cell_a"] == row["cell_b"]
                links: dict[int, int] = {}
                edges = []
                for i, j in cover_tree.close_pairs(ta, tb, xa, xb, threshold):
                    if same:
                        i, j = i[ka[i] < kb[j]], j[ka[i] < kb[j]]
                    for k, n in ((ka[i], nb[j]), (kb[j], na[i])):
                        for u, c in zip(k.tolist(), n.tolist(), strict=True):
                            links[u] = links.get(u, 0) + c
                    edges.append((ka[i], kb[j]))
                kept = _forest(edges)
                a = [*links, *(u for u, _ in kept)]
                b = [None] * len(links) + [v for _, v in kept]
                n = [*links.values()] + [None] * len(kept)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "links"])

    return run


def link_embeddings(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each vector.

    Vectors are compared when their labels are equal and not null and they have as many
    components.  Null, zero and non-finite vectors link with nothing, nor do rows with a null
    id, which have no component and are not kept.  Rows that repeat an id are vectors of their
    own that share its name.
    """
    spark = rows.sparkSession
    ship(spark)
    vec = F.col(vec_col).cast("array<double>")
    able = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & _comparable(F.col(vec_col))
    named = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"), able.alias("able"))
    hashes = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), F.col("vec")).alias("h2")]
    classes = named.filter("able").select("vec_id", "label", "vec", *hashes).groupBy("label", "h1", "h2")
    classes = classes.agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("vec").alias("vec"))
    classes = classes.select("label", "h1", "h2", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("key"), "rep", "n", "vec")
    classes = scratch.written(classes)

    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + 2 * cover_tree.SLACK
    cells, levels = _cells(classes.select("label", "dim", "key", "n", "vec"))
    blocks = scratch.written(cells.groupBy(*_CELL).applyInPandas(_block, _BLOCKS))
    pairs = _cell_pairs(blocks, levels, reach)

    def side(s: str, columns: list[str]) -> DataFrame:
        return blocks.select("label", "dim", *(F.col(c).alias(f"{c}_{s}") for c in columns))

    for s in ("a", "b"):  # the blocks' own centres and radii are closer than the cells'
        pairs = pairs.join(side(s, ["cell", "centre", "radius"]), ["label", "dim", f"cell_{s}"])
    pairs = pairs.filter(_distance("centre_a", "centre_b") <= F.col("radius_a") + F.col("radius_b") + reach)
    pairs = pairs.select("label", "dim", "cell_a", "cell_b")
    for s in ("a", "b"):
        pairs = pairs.join(side(s, ["cell", "keys", "counts", "vectors"]), ["label", "dim", f"cell_{s}"])
    found = scratch.written(map_arrow(pairs, _traversed(threshold), "a bigint, b bigint, links bigint"))

    links = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    members = connected_components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    slim = classes.select("label", "h1", "h2", "key", "rep", "n").join(members, "key", "left").join(links, "key", "left")
    least = slim.filter("component is not null").groupBy("component").agg(F.min("rep").alias("of_component"))
    slim = slim.join(least, "component", "left").select(
        "label", "h1", "h2", F.coalesce("of_component", "rep").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    keyed = named.select("vec_id", "able", F.when(F.col("able"), F.col("label")).alias("label"), *hashes)
    out = keyed.join(slim, ["label", "h1", "h2"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"),
    )
