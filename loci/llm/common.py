"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What separates words of letters and digits (all characters beyond ASCII belong to words).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: White space as the contracts of these operators define it.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; plain ASCII takes the short way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """Words of letters, digits and characters beyond ASCII, in order, in lower case."""
    return F.filter(F.split(lower_ascii(text), NOT_WORD), lambda w: w != "")


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add (names compare without case, as Spark does)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def packed(df: DataFrame, outputs: list[str], **more: Column) -> DataFrame:
    """The caller's columns in one, ``_row``, without those named like the outputs, and ``more`` beside it.

    So no name of the caller's can clash with one of an operator's; ``_row.*``
    gives them back.
    """
    kept = without(df, outputs)
    own = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row")
    return kept.select(own, *[c.alias(n) for n, c in more.items()])


def id_key(doc_id: Column | str) -> dict[str, Column]:
    """An id as two columns that are never null: a join on them and a window by them share one shuffle."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return {"_id": F.coalesce(doc_id.cast("string"), F.lit("")), "_no_id": doc_id.isNull()}
