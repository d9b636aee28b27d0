"""Taxonomy look-ups and genome-wide summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_half_up
from ..schema import domain_terms, ontology, taxonomy


def with_taxonomy(t: DataFrame, code: str = "code") -> DataFrame:
    """Superfamily, class, order and name of a classification code."""
    dim = taxonomy(t.sparkSession).withColumnsRenamed(
        {"code": "_code", "superfamily": "superfamily", "class": "class", "order": "order", "name": "repeat_name"}
    )
    # a fixed table of about fifty rows
    out = t.join(F.broadcast(dim), t[code] == dim["_code"], "left").drop("_code")
    return out.fillna("Unknown", ["superfamily", "class", "order", "repeat_name"])


def code_of(t: DataFrame, superfamily: str = "superfamily") -> DataFrame:
    """Classification code of a superfamily name, the other way round."""
    dim = taxonomy(t.sparkSession).where(F.col("superfamily") != "Unknown").groupBy(F.col("superfamily").alias("_sf"))
    codes = dim.agg(F.max("code").alias("code"))
    return t.join(F.broadcast(codes), t[superfamily] == codes["_sf"], "left").drop("_sf")


def with_ontology(features: DataFrame) -> DataFrame:
    """Ontology terms of the feature type and of a domain's name, as an attribute."""
    spark = features.sparkSession
    so = F.broadcast(ontology(spark))
    go = F.broadcast(domain_terms(spark))
    joined = features.join(so, "type", "left").join(
        go, F.element_at(F.try_element_at("attributes", F.lit("name")), 1) == F.col("domain"), "left"
    )
    terms = F.array_compact(F.array("so_term", "go_term"))
    attributes = F.when(
        F.size(terms) > 0, F.map_concat("attributes", F.create_map(F.lit("Ontology_term"), terms))
    ).otherwise(F.col("attributes"))
    return joined.withColumn("attributes", attributes).drop("so_term", "go_term", "domain")


def coverage_summary(merged: DataFrame, lengths: DataFrame, code: str = "code") -> DataFrame:
    """Bases covered per class, order and name with subtotals, and percent of the genome."""
    genome = lengths.agg(F.sum("length")).scalar()
    bases = merged.groupBy(code).agg(F.sum(F.col("end") - F.col("start") + 1).alias("_bases"))
    named = with_taxonomy(bases, code)
    rolled = named.rollup("class", "order", "repeat_name").agg(
        F.sum("_bases").alias("bases"), F.grouping_id().alias("level")
    )
    return rolled.select(
        F.coalesce("class", F.lit("total")).alias("class"),
        F.coalesce("order", F.lit("all")).alias("order"),
        F.coalesce("repeat_name", F.lit("all")).alias("repeat_name"),
        "bases",
        round_half_up(100.0 * F.col("bases") / genome, 2).alias("percent"),
    ).orderBy("class", "order", "repeat_name")
