"""Masking a genome by its hits, and the fragments left in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import reverse_complement
from ..operators import hits as h
from ..operators.intervals import merge_intervals, select_disjoint
from ..operators.ordering import number_rows
from ..operators.sequences import CHUNK_SIZE, mask_intervals, sequence_lengths, slice_sequences
from ..operators.summary import coverage_summary
from ..sources.features import write_features
from ..sources.sequences import write_sequences


def mask_genome(
    chunks: DataFrame,
    hits: DataFrame,
    min_identity: float = h.MASKING[0],
    min_length: int = h.MASKING[1],
    size: int = CHUNK_SIZE,
    lengths: DataFrame | None = None,
    spans_only: bool = False,
) -> tuple[DataFrame, DataFrame] | DataFrame:
    """Masked chunks and the coverage summary of a set of hits.

    Hits have the library name as ``query`` and the sequence as ``subject``;
    the code in front of the name decides the class. With ``spans_only`` the
    places to mask are returned and no residues are read.
    """
    good = h.filter_hits(hits, min_identity, min_length)
    placed = good.select(
        F.col("subject").alias("seq_id"),
        F.col("s_start").alias("start"),
        F.col("s_end").alias("end"),
        F.regexp_extract("query", r"^([A-Z]{3})_?-?", 1).alias("code"),
    )
    if spans_only:
        return placed.select("seq_id", "start", "end")
    merged = merge_intervals(placed, label="code")
    masked = mask_intervals(chunks, placed, size)
    return masked, coverage_summary(merged, sequence_lengths(chunks) if lengths is None else lengths)


def find_fragments(
    hits: DataFrame, min_identity: float = h.FRAGMENTS[0], min_length: int = h.FRAGMENTS[1]
) -> DataFrame:
    """Disjoint library matches numbered along each sequence."""
    good = h.filter_hits(hits, min_identity, min_length)
    placed = good.select(
        F.col("subject").alias("seq_id"),
        F.col("s_start").alias("start"),
        F.col("s_end").alias("end"),
        F.col("query").alias("match"),
        "strand",
        "evalue",
        "bits",
        "identity",
    ).where(F.col("end") - F.col("start") + 1 >= min_length)
    ties = [F.col("bits").desc(), F.col("match"), F.col("end").desc(), F.col("evalue"), F.col("identity").desc()]
    kept = select_disjoint(placed, ties)
    numbered = number_rows(kept, ["start"], "number", within=["seq_id"])
    name = F.concat(F.col("match"), F.lit("_fragment_"), F.col("seq_id"), F.lit("-"), F.col("number"))
    return numbered.withColumn("id", name)


def fragment_residues(fragments: DataFrame, chunks: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Fragments with their residues as text (C8); those of the minus strand are turned."""
    cut = slice_sequences(fragments, chunks, ["id"], size).select("id", "residues")
    turned = F.when(F.col("strand") == "-", reverse_complement("residues")).otherwise(F.col("residues"))
    return fragments.join(cut, "id").withColumn("residues", turned)


def write_fragments(fragments: DataFrame, lengths: DataFrame, sequences: str, features: str) -> None:
    """The two files of the fragment job, a record and a feature row each (C8); ``fragments`` have residues."""
    write_sequences(fragments.select("id", "residues"), sequences, name="id")
    rows = fragments.select(
        "seq_id",
        F.lit("loci").alias("source"),
        F.lit("similarity").alias("type"),
        "start",
        "end",
        F.col("bits").cast("double").alias("score"),
        "strand",
        F.lit(None).cast("int").alias("phase"),
        F.create_map(F.lit("ID"), F.array("id"), F.lit("Name"), F.array("match")).alias("attributes"),
    )
    write_features(rows, lengths, features)
