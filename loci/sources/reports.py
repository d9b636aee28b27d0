"""Tabular outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_report(t: DataFrame, path: str) -> None:
    """Tab-separated report with a header line."""
    t.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def write_library(t: DataFrame, path: str, by: Sequence[str] = ("superfamily", "family")) -> None:
    """One folder per superfamily and family.

    A rebalance hint sizes the output files: small groups share a task, a huge
    one is split over several.
    """
    t.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
