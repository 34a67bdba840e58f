"""Shared storage for materialised intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; a local one only where none is configured."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
        folder = "/tmp/changeloom-shared"
    spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write once and read back, so that later steps share one result and survive losses."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


_written: dict[tuple[str, str], tuple[str, object]] = {}
_dealt: dict[tuple[str, str], str] = {}


def materialize_once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Like ``materialize``, but a second request in the same application reads the first table."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _written:
        frame = build()
        path = new_path(spark, "derived")
        frame.write.parquet(path)
        _written[key] = (path, frame.schema)
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def materialize_dealt(spark: SparkSession, name: str, keys: list[str], count: Callable[[], int], build: Callable[[int], DataFrame]) -> DataFrame:
    """Like ``materialize_once``, in ``count()`` buckets by ``keys``: joins and windows by them move none of its rows.

    ``build`` returns rows that are dealt by ``keys`` to as many partitions, so each task writes one file.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _dealt:
        parts, table = count(), f"changeloom_{uuid.uuid4().hex}"
        build(parts).write.bucketBy(parts, *keys).option("path", new_path(spark, "dealt")).format("parquet").saveAsTable(table)
        _dealt[key] = table
    return spark.table(_dealt[key])
