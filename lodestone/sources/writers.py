"""Writers: keyed upsert, versioned snapshots and uniqueness checks."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER, _METADATA = "CURRENT", "metadata.json"


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file under a temporary name first, then moved over the old one."""
    made, store = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(made, True)
    out.write(text.encode())
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(made, target, options)


def _read_text(spark: SparkSession, path: str) -> str | None:
    made, store = _path(spark, path)
    if not store.exists(made):
        return None
    return spark.read.option("wholetext", True).text(path).first()["value"]


def version_name(when: datetime.datetime, sources: list[str], name: str | None = None) -> str:
    """``v_<date>_<time>_<name>``; without a name the sorted sources."""
    return f"v_{when:%Y%m%d_%H%M%S}_{name or '_'.join(sorted(sources))}"


def commit_snapshot(spark: SparkSession, root: str, version: str, tables: Mapping[str, DataFrame], metadata: Mapping | None = None) -> str:
    """Writes the tables of a version, then its metadata, and last makes it the current one.

    A version that fails half way is never current; writing it again replaces it.
    """
    base = f"{root}/snapshots/{version}"
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{base}/{name}")
    sizes = {name: spark.read.parquet(f"{base}/{name}").count() for name in tables}
    _write_text(spark, f"{base}/{_METADATA}", json.dumps({"version": version, "tables": sizes} | dict(metadata or {}), sort_keys=True))
    _write_text(spark, f"{root}/{_POINTER}", version)
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    return _read_text(spark, f"{root}/{_POINTER}")


def read_snapshot(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    version = version or current_version(spark, root)
    if version is None:
        raise ValueError("there is no snapshot")
    return spark.read.parquet(f"{root}/snapshots/{version}/{table}")


def list_versions(spark: SparkSession, root: str) -> list[dict]:
    """The metadata of complete versions, the newest first."""
    made, store = _path(spark, f"{root}/snapshots")
    if not store.exists(made):
        return []
    names = [s.getPath().getName() for s in store.listStatus(made)]
    found = [_read_text(spark, f"{root}/snapshots/{n}/{_METADATA}") for n in names]
    return sorted((json.loads(x) for x in found if x), key=lambda m: m["version"], reverse=True)


def upserted(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Known rows with those of the same keys replaced by the new ones, of which one per key."""
    fresh = new.dropDuplicates([key])
    return known.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*known.columns))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: a uniqueness constraint holds when there are none."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def write_article_files(articles: DataFrame, path: str, by: str = "source_type") -> None:
    """Articles as JSON, a folder for each source."""
    articles.write.mode("overwrite").partitionBy(by).json(path)


def write_text_list(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, parts: int = 16) -> None:
    """Node and edge tables, nodes sorted by name and edges by their first end for pruning.

    Names of nodes must be unique: raises if :func:`duplicates` finds one that is not.
    """
    if not duplicates(nodes, "name").isEmpty():
        raise ValueError("names of nodes are not unique")
    nodes.repartitionByRange(parts, "name").sortWithinPartitions("name").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartitionByRange(parts, "e1", "e2").sortWithinPartitions("e1", "e2").write.mode("overwrite").parquet(f"{path}/edges")


def write_splits(rows: DataFrame, path: str, **conditions: Column) -> None:
    """A JSON table for each condition, of the rows that meet it; a row may be in several."""
    for name, condition in conditions.items():
        rows.filter(condition).write.mode("overwrite").json(f"{path}/{name}")


def write_report(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """The lines ``(n, line)`` of a report as one small text file; see :mod:`reports`."""
    _write_text(spark, path, "".join(f"{r['line']}\n" for r in lines.orderBy("n").collect()))
