"""Element names: the key that ties sequences, features, hits and ages together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# side _ code _ singleton _ family number _ element type + number _ sequence _ start _ end
NAME_PATTERN = (
    r"^(?:(5prime|3prime|unk-prime-f|unk-prime-r)_)?([A-Z]{3})_(singleton_)?family([0-9]+)_"
    r"([A-Za-z_]+?)([0-9]+)_(\S+)_([0-9]+)[-_]([0-9]+)$"
)
NAME_FIELDS = ("side", "code", "singleton", "family", "element_type", "element", "seq", "start", "end")


def parse_name(t: DataFrame, col: str = "name") -> DataFrame:
    """Split a name into typed columns (P1); a name of another form gives NULLs.

    The pattern is matched once per row and its groups are read off the result.
    They come out of a generator of one row: a filter on a column is not moved
    in front of it, where it would match the pattern again.
    """
    groups = F.split(F.regexp_replace(F.col(col), NAME_PATTERN, "\t$1\t$2\t$3\t$4\t$5\t$6\t$7\t$8\t$9"), "\t")
    return (
        t.withColumn("_g", F.explode(F.array(groups)))
        .withColumn("_g", F.when(F.size("_g") == len(NAME_FIELDS) + 1, F.col("_g")))
        .withColumns(
            {
                "side": F.when(F.col("_g")[1] != "", F.col("_g")[1]),
                "code": F.col("_g")[2],
                "is_singleton": F.col("_g")[3] != "",
                "family_no": F.col("_g")[4].cast("bigint"),
                "element_type": F.col("_g")[5],
                "element_no": F.col("_g")[6].cast("bigint"),
                "seq_id": F.col("_g")[7],
                "start": F.col("_g")[8].cast("bigint"),
                "end": F.col("_g")[9].cast("bigint"),
            }
        )
        .drop("_g")
    )


def name_column(side: Column | None = None) -> Column:
    parts = [
        F.col("code"),
        F.concat(F.when(F.col("is_singleton"), "singleton_").otherwise(""), F.lit("family"), F.col("family_no")),
        F.concat("element_type", F.col("element_no")),
        F.col("seq_id"),
        F.col("start"),
        F.col("end"),
    ]
    # concat_ws leaves a NULL side out
    return F.concat_ws("_", F.col("side") if side is None else side, *parts)


def format_name(t: DataFrame, out: str = "name") -> DataFrame:
    """Inverse of :func:`parse_name`."""
    return t.withColumn(out, name_column())


def with_code(t: DataFrame, code: str, col: str = "name") -> DataFrame:
    """Put a classification code in front of each name (P20)."""
    return t.withColumn(col, F.concat_ws("_", F.lit(code), F.col(col)))


def compact_length(c: Column | str) -> Column:
    """Length from the two numbers that close a compact name."""
    name = F.col(c) if isinstance(c, str) else c
    pattern = r"([0-9]+)-?_?([0-9]+)$"
    first, last = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    return F.when(last != "", last.cast("bigint") - first.cast("bigint") + 1)
