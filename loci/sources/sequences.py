"""Sequence files: a header line that starts with ``>`` and lines of residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import carry_over_tiles
from ..operators.sequences import CHUNK_PAD, CHUNK_SIZE
from .ranges import PIECE, read_range_lines


def _id(header: Column) -> Column:
    return F.regexp_extract(header, r"^(\S*)", 1)


def _description(header: Column) -> Column:
    return F.regexp_extract(header, r"^\S*\s+(.*)$", 1)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (S2), from plain, gz or bz2 files, with the raw ``header`` kept.

    A record must fit in a row; for chromosomes use :func:`read_sequence_chunks`.
    """
    return parse_sequences(spark.read.option("lineSep", "\n>").text(path))


def parse_sequences(records: DataFrame) -> DataFrame:
    """Sequence rows from a table with one record per ``value``, static or streaming."""
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    split = records.select(F.split(text, "\n", 2).alias("f"))
    header = F.col("f")[0]
    residues = F.coalesce(F.regexp_replace(F.get("f", F.lit(1)), r"\s", ""), F.lit(""))
    return split.where(F.trim(header) != "").select(
        _id(header).alias("seq_id"), _description(header).alias("description"), residues.alias("residues"), header.alias("header")
    )


def read_sequence_chunks(
    spark: SparkSession, path: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_PAD, range_bytes: int | None = None
) -> DataFrame:
    """Padded chunks straight from a sequence file, without ever holding a record whole (S2 + F3).

    The file is read by line in its natural splits. Each split passes on the
    open record and how much of it has been read; a line then knows its place
    and is sent to the chunks it touches. Identifiers must be unique per file.

    With ``range_bytes`` the files are read by ranges of bytes instead, which
    cuts records written as one long line, and reads compressed files as
    streams of pieces (:mod:`.ranges`).
    """
    if range_bytes is not None:
        return chunks_of_lines(read_range_lines(spark, path, range_bytes, min(size, PIECE)), size, overlap)
    lines = spark.read.text(path).select(
        F.regexp_replace("value", r"\s+$", "").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_tile"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return chunks_of_lines(lines, size, overlap)


def chunks_of_lines(lines: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_PAD) -> DataFrame:
    """Padded chunks from headers and residues as rows (line, file, _tile, _at), in the order of _tile and _at."""
    opens = F.when(F.col("line").startswith(">"), _id(F.substring(F.col("line"), F.lit(2), F.length("line"))))
    lines = lines.withColumn("_opens", opens)
    last_open = F.max_by("_opens", F.when(F.col("_opens").isNotNull(), F.col("_at")))
    lines = carry_over_tiles(lines, ["file"], last_open, "last")
    in_tile = Window.partitionBy("file", "_tile").orderBy("_at")
    lines = lines.withColumn("seq_id", F.coalesce(F.last("_opens", ignorenulls=True).over(in_tile), F.col("_carry"))).drop("_carry")
    rows = lines.where(F.col("_opens").isNull() & (F.col("line") != "") & F.col("seq_id").isNotNull())

    size_ = F.length("line").cast("bigint")
    per_tile = rows.groupBy("file", "seq_id", "_tile").agg(F.sum(size_).alias("_n"))
    before = Window.partitionBy("file", "seq_id").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    base = per_tile.select("file", "seq_id", "_tile", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ahead = Window.partitionBy("file", "seq_id", "_tile").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(base, ["file", "seq_id", "_tile"]).withColumn(
        "start", F.col("_base") + F.coalesce(F.sum(size_).over(ahead), F.lit(0)) + 1
    )
    placed = placed.select("seq_id", "start", (F.col("start") + size_ - 1).alias("end"), "line")
    first = F.greatest(F.floor((F.col("start") - 1 - overlap) / size).cast("bigint"), F.lit(0))
    last = F.floor((F.col("end") - 1 + overlap) / size).cast("bigint")
    sent = placed.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start"), F.col("chunk_no") * size + 1 - overlap)
    hi = F.least(F.col("end"), (F.col("chunk_no") + 1) * size + overlap)
    pieces = sent.select(
        "seq_id", "chunk_no", lo.alias("lo"), hi.alias("hi"), F.substring(F.col("line"), lo - F.col("start") + 1, hi - lo + 1).alias("piece")
    ).where(F.col("lo") <= F.col("hi"))
    rows = F.sort_array(F.collect_list(F.struct("lo", "piece")))
    chunks = pieces.groupBy("seq_id", "chunk_no").agg(
        F.array_join(F.transform(rows, lambda r: r["piece"]), "").alias("residues"), F.min("lo").alias("_ws"), F.max("hi").alias("_we")
    )
    core_start = F.col("chunk_no") * size + 1
    core_end = F.least((F.col("chunk_no") + 1) * size, F.col("_we"))
    return chunks.where(F.col("_we") >= core_start).select(
        "seq_id",
        "chunk_no",
        core_start.alias("core_start"),
        core_end.alias("core_end"),
        (core_start - F.col("_ws")).alias("left_pad"),
        (F.col("_we") - core_end).alias("right_pad"),
        "residues",
    )


def sequence_text(t: DataFrame, width: int = 60, name: str = "seq_id") -> DataFrame:
    """Records as text, residues cut to lines."""
    lines = F.regexp_replace("residues", "(.{%d})(?=.)" % width, "$1\n")
    return t.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), lines).alias("value"))


def write_sequences(t: DataFrame, path: str, width: int = 60, name: str = "seq_id") -> None:
    """Sequence file with lines of ``width`` letters."""
    sequence_text(t, width, name).write.text(path)
