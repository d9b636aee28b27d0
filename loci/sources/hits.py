"""Alignment-hit files: twelve tab-separated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hits import normalize_hits
from ..schema import HIT_FILE


def read_hits(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """Typed hit rows (S3); comments and rows of another width are dropped."""
    hits = parse_hits(spark.read.text(path))
    return normalize_hits(hits) if normalize else hits


def parse_hits(lines: DataFrame) -> DataFrame:
    """Hit rows from a table with ``value`` lines, static or streaming."""
    text = F.regexp_replace("value", r"\r$", "")
    rows = lines.where(~F.col("value").startswith("#")).select(F.split(text, "\t").alias("f")).where(F.size("f") == len(HIT_FILE))
    return rows.select(*[F.col("f")[i].try_cast(field.dataType).alias(field.name) for i, field in enumerate(HIT_FILE)])
