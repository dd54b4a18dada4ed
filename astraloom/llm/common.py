"""What the text operators share: the shared folder, written tables and Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of `documents`, in order.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all run in this process, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="astraloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


_LEFT: list[tuple[SparkSession, str]] = []


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Results are read lazily, so what they need stays until the driver ends."""
    if not _LEFT:
        atexit.register(_clear)
    _LEFT.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    for spark, path in _LEFT:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before us
            return


def release(df: DataFrame) -> None:
    """Deletes a table that `written` made, once nothing will read it again."""
    left = _LEFT_AT.pop(id(df), None)
    if left is not None:
        _LEFT.remove(left[1:])
        _delete(*left[1:])


_LEFT_AT: dict[int, tuple[DataFrame, SparkSession, str]] = {}  # by the frame, which is held so that its number stays its own


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    _LEFT_AT[id(found)] = (found, spark, path)
    return found


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with the hint to broadcast it if it has at most `rows` rows, which are counted; else df."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut by bytes, so that very long texts do not meet in memory with many others."""
    for batch in batches:
        step = max(1, int(batch.num_rows * min(1.0, BATCH_BYTES / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]]) -> DataFrame:
    """df through Arrow: make() builds a task's function from a batch to columns, in the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in sliced(batches):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: Bytes of input that a task's function sees at once, as a rule.
BATCH_BYTES = 8 << 20


def held_out(id_col: str = "doc_id"):
    """True for rows that no model may learn from: crc32 of the id as text is a multiple of 5; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
