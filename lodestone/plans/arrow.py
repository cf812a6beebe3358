"""Arrow functions over partitions, with this package made importable on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
#: Bytes of a batch: texts lie in a worker several times over, as bytes, words and hashes.
_BATCH, _BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send a zip of this package to the executors, once per application, and keep the batches
    of Arrow functions small unless the session has smaller ones."""
    if int(spark.conf.get(_BATCH_KEY).rstrip("b")) > _BATCH:
        spark.conf.set(_BATCH_KEY, str(_BATCH))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="ship-")  # the driver's own: executors fetch the zip from it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    base = Path(folder) / _ROOT.name
    archive = shutil.make_archive(str(base), "zip", _ROOT.parent, _ROOT.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` for a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, rows: Sequence[tuple], **kinds: pa.DataType) -> DataFrame:
    """A small table of the driver's rows, handed over by Arrow: no Python worker reads it."""
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)}))
