"""File sources read as streams.

Only what is stateless: new feature, hit and sequence files are parsed as they
arrive, and every projection, filter and broadcast look-up of the library may
follow. Ordered passes and joins between tables are batch work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hits import normalize_hits
from ..sources.features import parse_features
from ..sources.hits import parse_hits
from ..sources.sequences import parse_sequences


def stream_hits(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    return normalize_hits(parse_hits(spark.readStream.options(**options).text(folder)))


def stream_sequences(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    return parse_sequences(spark.readStream.options(**options).option("lineSep", "\n>").text(folder))


def stream_features(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    lines = spark.readStream.options(**options).text(folder).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.lit(None).cast("bigint").alias("line_no"),
    )
    return parse_features(lines)
