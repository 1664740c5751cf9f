"""Tables that cut a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}
_inside: ContextVar[list[str] | None] = ContextVar("_inside", default=None)  # of each thread its own


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-fillgap-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    """Where a table may be written that the innermost ``scratch`` deletes at its end, or ``clear`` outside of one."""
    path, inside = f"{shared_dir(spark)}/fillgap-{uuid.uuid4().hex}", _inside.get()
    (_written.setdefault(spark.sparkContext.applicationId, []) if inside is None else inside).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage ends there and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that were written to paths of ``new_path``; those that were never written are no error."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, also after an error, what ``cut`` writes inside on this thread; tables from before stay.

    What is wanted has to be written or collected inside: DataFrames made there can't be used afterwards. Scratches may be nested.
    """
    made: list[str] = []
    token = _inside.set(made)
    try:
        yield
    finally:
        _inside.reset(token)
        delete(spark, made)


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` wrote for this application outside of ``scratch``. DataFrames that still read them can't be used any more."""
    delete(spark, _written.pop(spark.sparkContext.applicationId, []))
