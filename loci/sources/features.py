"""Feature files: nine tab-separated columns, the last one a list of attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import natural_key

REGION = "repeat_region"
ELEMENT = r"^(?:LTR_retrotransposon|LARD|TRIM|LARD_retrotransposon|TRIM_retrotransposon|terminal_inverted_repeat_element|MITE|helitron|non_LTR_retrotransposon)$"
# Letters written as percent codes inside attributes, percent sign first.
ESCAPES = [("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), ("\t", "%09")]


def decode(c: Column) -> Column:
    """Percent codes to letters; a plus stays a plus and a stray percent sign stays as it is."""
    decoded = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return F.when(F.contains(c, F.lit("%")), decoded).otherwise(c)


def encode(c: Column) -> Column:
    for letter, code in ESCAPES:
        c = F.replace(c, F.lit(letter), F.lit(code))
    return c


def parse_attributes(c: Column) -> Column:
    """``a=1,2;b=3`` -> map of lists; a key given twice keeps all its values."""
    fields = F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "."))
    entries = F.transform(
        fields,
        lambda x: F.struct(
            decode(F.substring_index(x, "=", 1)).alias("k"),
            F.transform(
                F.split(F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise(""), ","), decode
            ).alias("v"),
        ),
    )

    def gathered(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
        merged = F.transform(
            keys,
            lambda k: F.struct(k.alias("k"), F.flatten(F.transform(F.filter(entries, lambda e: e["k"] == k), lambda e: e["v"])).alias("v")),
        )
        return F.map_from_entries(F.when(F.size(keys) == F.size(entries), entries).otherwise(merged))

    # the fields are split once and handed on; named twice, they would be split again for each key
    return F.element_at(F.transform(F.array(entries), gathered), 1)


def format_attributes(c: Column) -> Column:
    """Identifier first, then parent, then the rest by name."""
    rank = lambda k: F.when(k == "ID", 0).when(k == "Parent", 1).otherwise(2)
    rows = F.sort_array(
        F.transform(F.map_entries(c), lambda e: F.struct(rank(e["key"]).alias("r"), e["key"].alias("k"), e["value"].alias("v")))
    )
    text = F.transform(
        rows, lambda e: F.concat(encode(e["k"]), F.lit("="), F.array_join(F.transform(e["v"], encode), ","))
    )
    return F.when(F.size(c) == 0, ".").otherwise(F.array_join(text, ";"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.rtrim(F.regexp_replace("value", r"\r$", "")).alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a feature file (S1); a row without nine columns is kept in ``_corrupt`` alone."""
    return parse_features(_lines(spark, path))


def parse_features(lines: DataFrame) -> DataFrame:
    """Feature rows from a table with ``line``, ``file`` and ``line_no``, static or streaming."""
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t"))
    f = F.when(F.size("f") == 9, F.col("f"))

    def field(i: int) -> Column:
        return F.when(f[i] != ".", f[i])

    return rows.select(
        f[0].alias("seq_id"),
        field(1).alias("source"),
        f[2].alias("type"),
        f[3].try_cast("bigint").alias("start"),
        f[4].try_cast("bigint").alias("end"),
        field(5).try_cast("double").alias("score"),
        F.when(F.size("f") == 9, F.when(f[6].isin("+", "-"), f[6]).otherwise("?")).alias("strand"),
        field(7).try_cast("int").alias("phase"),
        F.when(F.size("f") == 9, parse_attributes(f[8])).alias("attributes"),
        "file",
        "line_no",
        F.when(F.size("f") != 9, F.col("line")).alias("_corrupt"),
    )


def read_sequence_regions(spark: SparkSession, path: str) -> DataFrame:
    """The ``##sequence-region`` lines of a feature file: sequence, first and last position."""
    lines = _lines(spark, path).where(F.col("line").startswith("##sequence-region"))
    f = F.split("line", r"\s+")
    return lines.select(f[1].alias("seq_id"), f[2].cast("bigint").alias("start"), f[3].cast("bigint").alias("end")).distinct()


def region_tree(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature rows as (regions, elements, parts) with identifiers instead of nesting.

    A part belongs to the element named as its parent, or to the element of the
    region named so; it must lie inside that region.
    """
    first = lambda k: F.try_element_at(F.try_element_at("attributes", F.lit(k)), F.lit(1))
    # read off behind an explode of one: a filter that a join asks for would otherwise parse the attributes once more
    known = F.struct(first("ID").alias("id"), first("Parent").alias("parent"), first("name").alias("name"))
    rows = features.withColumn("_a", F.explode(F.array(known))).withColumns({"_id": F.col("_a.id"), "_parent": F.col("_a.parent"), "_name": F.col("_a.name")})
    regions = rows.where(F.col("type") == REGION).select("seq_id", "start", "end", "strand", "source", F.col("_id").alias("region_id"))
    is_element = F.col("type").rlike(ELEMENT)
    bounds = regions.select("seq_id", "region_id", F.col("start").alias("_rs"), F.col("end").alias("_re"))
    inside = (F.col("start") >= F.col("_rs")) & (F.col("end") <= F.col("_re"))
    elements = (
        rows.where(is_element)
        .select("seq_id", "type", "start", "end", "strand", "attributes", F.col("_id").alias("element_id"), F.col("_parent").alias("region_id"))
        .join(bounds, ["seq_id", "region_id"])
        .where(inside)
        .drop("_rs", "_re")
    )
    names = elements.select("seq_id", "element_id", "region_id")
    owners = names.select("seq_id", F.explode(F.array("element_id", "region_id")).alias("_parent"), "element_id", "region_id")
    parts = (
        rows.where((F.col("type") != REGION) & ~is_element)
        .select("seq_id", "type", "start", "end", "strand", "attributes", "_parent", F.col("_name").alias("name"))
        .join(owners, ["seq_id", "_parent"])
        .join(bounds, ["seq_id", "region_id"])
        .where(inside)
        .drop("_rs", "_re", "_parent")
    )
    return regions, elements, parts


def feature_lines(t: DataFrame, lengths: DataFrame) -> DataFrame:
    """Header and rows of a feature file as text with a sort key."""
    spark = t.sparkSession
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    body = t.select(
        F.lit(2).alias("part"),
        natural_key("seq_id").alias("seq_key"),
        F.col("start").alias("at"),
        F.when(F.col("type") == REGION, 0).when(F.col("type").rlike(ELEMENT), 1).otherwise(2).alias("depth"),
        (-F.col("end")).alias("neg_end"),
        F.concat_ws(
            "\t", "seq_id", dot("source"), "type", "start", "end", dot("score"), F.coalesce("strand", F.lit("?")), dot("phase"), format_attributes(F.col("attributes"))
        ).alias("line"),
    )
    none = F.lit(0).cast("bigint")
    regions = lengths.select(
        F.lit(1).alias("part"),
        natural_key("seq_id").alias("seq_key"),
        none.alias("at"),
        F.lit(0).alias("depth"),
        none.alias("neg_end"),
        F.concat_ws(" ", F.lit("##sequence-region"), "seq_id", F.lit(1), "length").alias("line"),
    )
    top = spark.range(1).select(
        F.lit(0).alias("part"),
        F.lit("").alias("seq_key"),
        none.alias("at"),
        F.lit(0).alias("depth"),
        none.alias("neg_end"),
        F.lit("##gff-version 3").alias("line"),
    )
    return top.unionByName(regions).unionByName(body)


def write_features(t: DataFrame, lengths: DataFrame, path: str) -> None:
    """Feature file: header first, rows by sequence and start, parents before children.

    Output files follow each other in order: rows are range-partitioned and
    sorted inside each partition.
    """
    key = ["part", "seq_key", "at", "depth", "neg_end", "line"]
    lines = feature_lines(t, lengths)
    lines.repartitionByRange(*key).sortWithinPartitions(*key).select("line").write.text(path)
