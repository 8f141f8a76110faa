"""The comment scan over files as they arrive: the operators are narrow, so they run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import detect, lines


def scan_stream(spark: SparkSession, path: str) -> DataFrame:
    """file_path, lineno, content, rule of comments in tables of files (file_path, code) that are added to `path`; lines that are too long are passed over, so that no file holds up a stream."""
    files = spark.readStream.schema("file_path string, code string").parquet(path)
    return detect.triaged(lines.comments(lines.within_limit(lines.explode_lines(files)))).select("file_path", "lineno", "content", "rule")
