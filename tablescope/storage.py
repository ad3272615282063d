"""Where intermediate tables are written, and a session for local work."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    A machine-local folder is made only in local mode and only if the setting is absent."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    folder = tempfile.mkdtemp(prefix="tablescope-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_folder(spark), f"tablescope-{label}-{uuid.uuid4().hex}")


def _parquet_can_hold(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return bool(data_type.fields) and all(_parquet_can_hold(f.dataType) for f in data_type)
    if isinstance(data_type, T.ArrayType):
        return _parquet_can_hold(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return _parquet_can_hold(data_type.keyType) and _parquet_can_hold(data_type.valueType)
    return not isinstance(data_type, (T.NullType, T.CalendarIntervalType))


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage for a frame that many later jobs read.

    A parquet table in the shared folder outlives lost executors and, unlike a checkpoint of
    rows, lets every later job read only the columns it needs. Types parquet cannot hold fall
    back to a reliable checkpoint."""
    spark = df.sparkSession
    if _parquet_can_hold(df.schema):
        path = new_folder(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that `new_folder` named, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a frame that is made and run herein are deleted when the run ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def together(steps: Mapping[str, Callable[[], Any]], at_once: int = 6) -> dict[str, Any]:
    """Run independent Spark actions from several driver threads, so that the short jobs of a
    report overlap instead of queueing; the first error is raised."""
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        running = {name: pool.submit(step) for name, step in steps.items()}
        return {name: future.result() for name, future in running.items()}


def local_session(cores: int | str = 8, app: str = "tablescope") -> SparkSession:
    """Session used by the tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
