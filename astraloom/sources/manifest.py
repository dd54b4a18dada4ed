"""A table that is replaced as a whole: parts by tasks, and a manifest that names them.

Tasks write parts and tell the driver their names; the commit writes the list of them beside the manifest and moves it in, and only then
deletes what the list does not name. Until the move the older parts are what readers see; a run that dies before leaves parts that no
manifest names, which the next commit deletes. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Part(WriterCommitMessage):
    name: str | None  # None: no rows, no file
    rows: int


class ManifestWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, top = _store(self.path)
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = pa.parquet.ParquetWriter(f"{top}/{name}", batch.schema, filesystem=fs)
                out.write_batch(batch)
                rows += batch.num_rows
        if out is not None:
            out.close()
        return Part(name if rows else None, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, top = _store(self.path)
        fs.create_dir(top, recursive=True)
        parts = sorted(m.name for m in messages if m is not None and m.name)
        beside = f"{top}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(beside) as f:
            f.write(json.dumps({"parts": parts, "rows": sum(m.rows for m in messages if m is not None)}).encode())
        fs.move(beside, f"{top}/{MANIFEST}")
        for x in fs.get_file_info(pa.fs.FileSelector(top)):
            if x.type == pa.fs.FileType.File and x.base_name != MANIFEST and x.base_name not in parts:
                fs.delete_file(x.path)

    def abort(self, messages: list[Part | None]) -> None:
        fs, top = _store(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{top}/{m.name}")


class ManifestTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifest_table"

    def writer(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options["path"])


def replace_table(df: DataFrame, path: str) -> None:
    """The rows of df in place of those at path, at once."""
    df.sparkSession.dataSource.register(ManifestTable)
    df.write.format(ManifestTable.name()).mode("append").save(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The rows that the manifest at path names; None without one."""
    fs, top = _store(path)
    if fs.get_file_info(f"{top}/{MANIFEST}").type != pa.fs.FileType.File:
        return None
    with fs.open_input_stream(f"{top}/{MANIFEST}") as f:
        parts = json.loads(f.read())["parts"]
    base = path if "://" in path else f"file://{path}"
    return spark.read.schema(schema).parquet(*(f"{base}/{p}" for p in parts)) if parts else spark.createDataFrame([], schema)
