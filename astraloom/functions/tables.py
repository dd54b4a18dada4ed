"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """The folder of spark.checkpoint.dir, or, where none is set and all run in this process, one of our own."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="astraloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
    spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df with their lineage cut: a table beside the checkpoints, whose size the optimizer knows. (A checkpoint keeps the size that was
    estimated for its plan, and in a loop of joins these estimates multiply without end.)"""
    return written(df, "cut")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder beside the checkpoints, which the driver deletes when it ends."""
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_clear)
    _LEFT.append((spark, path))
    return path


#: How much smaller ids, paths and syntax rows are in a Parquet file than in memory, at least.
PACKED = "10"


@contextmanager
def true_sizes(spark: SparkSession) -> Iterator[None]:
    """What is planned within takes tables for what they are in memory: by the size of its files a table of millions of ids is sent to every task through the driver,
    in every join of a loop. A factor that the user has set stays."""
    key, late = "spark.sql.sources.fileCompressionFactor", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    mine = float(spark.conf.get(key)) == 1.0
    also = mine and spark.conf.get(late, None) is None  # what a join turns into when its sides are there
    if mine:
        spark.conf.set(key, PACKED)
    if also:
        spark.conf.set(late, "1m")
    try:
        yield
    finally:
        if mine:
            spark.conf.unset(key)
        if also:
            spark.conf.unset(late)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table beside the checkpoints, until `release` or the driver's end: read by column, with filters pushed down."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with true_sizes(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _LEFT_AT[id(found)] = (found, spark, path)
    return found


_LEFT: list[tuple[SparkSession, str]] = []
_LEFT_AT: dict[int, tuple[DataFrame, SparkSession, str]] = {}  # by the frame, which is held so that its number stays its own


def release(*frames: DataFrame | None) -> None:
    """Deletes tables that `written` or `cut` made, once nothing will read them again; other frames are passed over."""
    for frame in frames:
        left = _LEFT_AT.pop(id(frame), None)
        if left is not None:
            _LEFT.remove(left[1:])
            delete(*left[1:])


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    for spark, path in _LEFT:
        try:
            delete(spark, path)
        except Exception:  # the session has ended before us
            return


def dealt(df: DataFrame, at_once: int, by: str) -> DataFrame:
    """df in tasks of some `at_once` rows, and before that in as many as the session's shuffles have: adaptive execution joins partitions by bytes, whatever the work a row is."""
    n = df.count()
    return df.repartition(max(min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 500 + 1), n // at_once), by)


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with the row's number from 1 in the order of all rows: sorted over all partitions, numbered within each, and moved on by the sizes of those before."""
    keys = {f"_{k}": c for k, c in enumerate(order)}
    rows = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    at = F.monotonically_increasing_id()  # the partition, and the place in it
    placed = cut(rows.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(parts), "_part").withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_at", "_part", "_before")


def sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """A query over named frames. Views of these names exist only while it is analysed; what the caller has under them comes back."""
    before = {name: spark.table(name) for name in frames if spark.catalog.tableExists(name)}
    try:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
        return spark.sql(text)
    finally:
        for name in frames:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
