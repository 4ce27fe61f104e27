"""Cutting lineage, sizing tasks and attaching small tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = 8_000_000
BROADCAST_ROWS = 500_000

_run: ContextVar[list[str] | None] = ContextVar("kept_tables", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, else one in the warehouse.

    A warehouse on the local disk serves local mode only: executors of a cluster
    would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(warehouse)
    scheme = path.getFileSystem(sc._jsc.hadoopConfiguration()).getScheme()
    if scheme == "file" and sc.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{warehouse}/lacuna-kept"


@contextmanager
def kept_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables kept inside are deleted at the end; those of other runs stay.

    Results have to be written before the end.
    """
    paths: list[str] = []
    token = _run.set(paths)
    try:
        yield paths
    finally:
        _run.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(conf).delete(path, True)


def kept_path(spark: SparkSession, kind: str = "lacuna") -> str:
    """A new path in the shared folder, deleted with the tables of the run."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    run = _run.get()
    if run is not None:
        run.append(path)
    return path


def settle_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Compute now, as a table in the shared folder, and continue from there.

    Later jobs neither repeat the work nor lose it together with an executor.
    ``counts`` are aggregates taken along the way, without another pass.
    """
    spark = df.sparkSession
    path = kept_path(spark)
    schema, seen = df.schema, None
    if counts:
        seen = Observation()
        df = df.observe(seen, *[c.alias(name) for name, c in counts.items()])
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), dict(seen.get) if counts else {}


def settle(df: DataFrame) -> DataFrame:
    return settle_counting(df)[0]


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks over which to spread a scan that produces this many rows."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TASK))


def attach_small(df: DataFrame, small: DataFrame, on, rows: int | None = None) -> DataFrame:
    """Left join of a table that is small as a rule.

    ``rows`` is its number of rows where the caller made it so; otherwise they are
    counted. Up to BROADCAST_ROWS it is broadcast and ``df`` stays where it is;
    a larger one is joined as Spark sees fit.
    """
    if rows is None:
        rows = small.count()
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, "left")
