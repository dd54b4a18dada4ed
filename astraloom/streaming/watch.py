"""Lint over a stream of changed files: every batch is parsed once and its findings replace those of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from astraloom.functions.syntax import syntax_rows
from astraloom.operators import lint
from astraloom.sources.tree import described

CHANGES = "path string, content string, at timestamp"


def lint_changes(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: list[str] | None = None) -> StreamingQuery:
    """Reads Parquet files of changes (path, content, at) as they come; findings go to out/batch=N. Of several versions of a path in a batch the latest counts."""

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by("content", "at").alias("content"))
        files = described(latest).persist()
        rows = syntax_rows(files).persist()
        try:
            lint.findings(rows, files, rules).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            rows.unpersist()
            files.unpersist()

    stream = spark.readStream.schema(CHANGES).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
