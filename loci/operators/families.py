"""Families: from clustered parts to numbered, annotated and summarised groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import natural_key, round_half_up
from .hierarchy import label_ends, merged_domains
from .hits import best_hit, filter_compatible, filter_hits_by_coverage
from .ordering import number_rows, top_per_key
from .sequences import slice_sequences


def element_parts(elements: DataFrame, parts: DataFrame, kind: str = "long_terminal_repeat") -> DataFrame:
    """Stretches of each element that are compared on their own.

    The whole element, its two labelled terminal repeats, binding site, tract
    and each merged domain range.
    """
    cols = ["part", "seq_id", "element_id", "start", "end"]
    whole = elements.withColumn("part", F.lit("full")).select(*cols)
    ends = label_ends(parts, kind).withColumn("part", F.col("side")).select(*cols)
    marks = parts.where(F.col("type").isin("primer_binding_site", "RR_tract")).withColumn("part", F.col("type")).select(*cols)
    domains = merged_domains(parts).withColumn("part", F.col("name")).select(*cols)
    return whole.unionByName(ends).unionByName(marks).unionByName(domains)


def concat_domains(parts: DataFrame, chunks: DataFrame, **chunking) -> DataFrame:
    """One sequence per element and domain: its merged ranges in order."""
    ranges = merged_domains(parts).select("seq_id", "element_id", "name", "start", "end")
    pieces = slice_sequences(ranges, chunks, ["element_id", "name"], **chunking)
    rows = F.sort_array(F.collect_list(F.struct("start", "end", "residues")))
    return pieces.groupBy("seq_id", "element_id", "name").agg(
        F.array_join(F.transform(rows, lambda r: r["residues"]), "").alias("residues"),
        F.count("*").alias("ranges"),
    )


def drop_small_groups(t: DataFrame, by: str | Sequence[str], minimum: int = 2) -> DataFrame:
    """Rows of groups that have at least ``minimum`` rows."""
    keys = [by] if isinstance(by, str) else list(by)
    large = t.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum)
    return t.join(large.select(*keys), keys, "left_semi")


def group_sizes(t: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Rows per group."""
    keys = [by] if isinstance(by, str) else list(by)
    return t.groupBy(*keys).agg(F.count("*").alias("n"))


def signature_families(members: DataFrame, parts: Sequence[str] | None = None) -> DataFrame:
    """Elements with the same cluster in every part form a family.

    ``members`` has ``part``, ``cluster_id``, ``element_id``. The signature
    lists the cluster of each part in the given order, ``N`` where there is
    none; without a list of parts it names the parts an element has. An element
    found in several clusters of a part takes the smallest.
    """
    smallest = members.groupBy("element_id", "part").agg(F.min("cluster_id").alias("cluster_id"))
    number = F.col("cluster_id").cast("string")
    if parts is None:
        # one entry per part of an element, so the list is as short as its parts are few
        signature = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "part", number))), "|")
    else:
        signature = F.concat_ws("|", *[F.coalesce(F.max(F.when(F.col("part") == p, number)), F.lit("N")) for p in parts])
    signed = smallest.groupBy("element_id").agg(signature.alias("signature"))
    sizes = signed.groupBy("signature").agg(
        F.count("*").alias("family_size"),
        F.min(F.struct(natural_key("element_id").alias("k"), F.col("element_id").alias("id"))).alias("_first"),
    )
    return signed.join(sizes, "signature").select(
        "element_id",
        "signature",
        "family_size",
        F.col("_first.id").alias("family_key"),
        (F.col("family_size") == 1).alias("is_singleton"),
    )


def number_families(t: DataFrame, within: Sequence[str] = ("superfamily",)) -> DataFrame:
    """Number families from 0, largest first; singletons apart, in natural order.

    ``t`` has ``family_key`` and ``element_id``. Families of equal size are
    ordered by their smallest natural element id.
    """
    first = F.min(F.struct(natural_key("element_id").alias("k"), F.col("element_id").alias("id")))
    sizes = t.groupBy(*within, "family_key").agg(F.count("*").alias("family_size"), first.alias("_first"))
    sizes = sizes.withColumn("is_singleton", F.col("family_size") == 1)
    numbered = number_rows(
        sizes, [-F.col("family_size"), F.col("_first"), "family_key"], name="family_no", within=[*within, "is_singleton"], first=0
    ).drop("_first")
    family = F.concat(F.when(F.col("is_singleton"), "singleton_").otherwise(""), F.lit("family"), F.col("family_no"))
    return numbered.withColumn("family", family)


def recruit(
    singletons: DataFrame,
    families: DataFrame,
    hits: DataFrame,
    query_lengths: DataFrame,
    min_identity: float = 80.0,
    min_length: int = 80,
    coverage: float = 0.5,
) -> DataFrame:
    """Family of each singleton's best compatible hit.

    ``hits`` carry the superfamily of both sides; a singleton joins one family,
    that of its best hit.
    """
    known = families.select(F.col("element_id").alias("subject"), F.col("family").alias("hit_family"))
    usable = hits.join(singletons.select(F.col("element_id").alias("query")), "query", "left_semi").join(known, "subject")
    usable = filter_hits_by_coverage(filter_compatible(usable), query_lengths, None, min_identity, min_length, coverage)
    return best_hit(usable).select(F.col("query").alias("element_id"), F.col("hit_family").alias("family"), "subject", "bits")


def cap_families(
    t: DataFrame, max_members: int | Column | None = None, max_length: int | None = None, family: str = "family"
) -> DataFrame:
    """Members of families that are small and short enough to be aligned (P19); a bound left out holds nothing back."""
    if max_members is None and max_length is None:
        return t
    small = F.lit(True) if max_members is None else F.col("_n") <= max_members
    short = F.lit(True) if max_length is None else F.col("_longest") <= max_length
    ok = (
        t.groupBy(family)
        .agg(F.count("*").alias("_n"), F.max("length").alias("_longest"))
        .where(small & short)
    )
    return t.join(ok.select(family), family, "left_semi")


def top_families(t: DataFrame, n: int, family: str = "family") -> DataFrame:
    """Members of the ``n`` largest families."""
    first = (
        t.groupBy(family)
        .agg(F.count("*").alias("_n"))
        .orderBy(F.col("_n").desc(), natural_key(family), family)
        .limit(n)
        .select(family)
    )
    # n rows
    return t.join(F.broadcast(first), family, "left_semi")


def family_counts(t: DataFrame, by: str = "superfamily") -> DataFrame:
    """Families, their elements, singletons and all elements per superfamily."""
    per_family = t.groupBy(by, "family").agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return per_family.groupBy(by).agg(
        F.sum(F.when(many, 1).otherwise(0)).alias("families"),
        F.sum(F.when(many, F.col("n")).otherwise(0)).alias("elements_in_families"),
        F.sum(F.when(many, 0).otherwise(F.col("n"))).alias("singletons"),
        F.sum("n").alias("elements"),
    )


def family_similarity(hits: DataFrame, members: DataFrame, min_length: int = 80, include_self: bool = True) -> DataFrame:
    """Similarity inside each family of more than one member.

    ``members`` has ``family``, ``element_id``, ``length``; hits count when both
    sides belong to one family.
    """
    fam = members.select("family", "element_id")
    q = fam.select(F.col("element_id").alias("query"), F.col("family").alias("_fq"))
    s = fam.select(F.col("element_id").alias("subject"), F.col("family").alias("_fs"))
    inner = hits.where(F.col("length") >= min_length)
    if not include_self:
        inner = inner.where(F.col("query") != F.col("subject"))
    inner = inner.join(q, "query").join(s, "subject").where(F.col("_fq") == F.col("_fs"))
    means = inner.groupBy(F.col("_fq").alias("family")).agg(
        F.avg("identity").alias("similarity_mean"), F.avg("length").alias("hit_length_mean")
    )
    # distinct first by (family, element): a large family is not gathered to count it
    analysed = (
        inner.select(F.col("_fq").alias("family"), F.explode(F.array("query", "subject")).alias("e"))
        .distinct()
        .groupBy("family")
        .agg(F.count("*").alias("family_count_analyzed"))
    )
    sizes = members.groupBy("family").agg(
        F.count("*").alias("family_size"), F.avg("length").alias("element_length_mean")
    ).where(F.col("family_size") > 1)
    return (
        sizes.join(means, "family")
        .join(analysed, "family")
        .select(
            "family",
            "family_size",
            "family_count_analyzed",
            round_half_up("similarity_mean", 2).alias("similarity_mean"),
            round_half_up("hit_length_mean", 2).alias("hit_length_mean"),
            round_half_up("element_length_mean", 2).alias("element_length_mean"),
        )
        .orderBy(F.col("family_size").desc(), "family")
    )


def library_labels(t: DataFrame) -> DataFrame:
    """Name -> superfamily from ``header`` texts ``name<TAB>superfamily<TAB>source``.

    Blanks become underscores; one row per name.
    """
    fields = F.split("header", "\t")
    named = t.select(fields.alias("f")).where(F.size("f") >= 2)
    label = F.regexp_replace(F.col("f")[1], r"\s+", "_")
    name = F.regexp_replace(F.col("f")[0], r"\s+", "_")
    return named.select(name.alias("name"), label.alias("superfamily")).groupBy("name").agg(F.min("superfamily").alias("superfamily"))


def label_from_library(t: DataFrame, hits: DataFrame, labels: DataFrame, min_identity: float = 80.0, min_length: int = 80) -> DataFrame:
    """Superfamily of each element's best hit to a labelled library (C2 over J12 and W1)."""
    label = F.lower("superfamily")
    call = F.when(label.rlike("^rlg|gypsy"), "Gypsy").when(label.rlike("^rlc|copia"), "Copia")
    named = labels.select(F.col("name").alias("subject"), call.alias("called")).where(F.col("called").isNotNull())
    good = hits.where((F.col("identity") >= min_identity) & (F.col("length") >= min_length)).join(named, "subject")
    best = best_hit(good).select(F.col("query").alias("element_id"), "called")
    return t.join(best, "element_id", "left")


def select_repeats(
    repeats: DataFrame, exemplars: DataFrame, families: DataFrame, all_elements: bool = False
) -> DataFrame:
    """Terminal repeats to analyse.

    Those of the family exemplars; every element when asked for, or in a
    superfamily without an exemplar. Elements without family are
    ``Unclassified``.
    """
    fam = families.select("element_id", "family", "superfamily")
    named = repeats.join(fam, "element_id", "left").fillna("Unclassified", ["family", "superfamily"])
    if all_elements:
        return named
    chosen = exemplars.select("element_id").distinct().withColumn("_ex", F.lit(True))
    # one row per superfamily
    covered = fam.join(chosen, "element_id", "left_semi").groupBy("superfamily").agg(F.lit(True).alias("_covered"))
    marked = named.join(chosen, "element_id", "left").join(covered, "superfamily", "left")
    return marked.where(F.col("_ex") | F.col("_covered").isNull()).drop("_ex", "_covered")


def annotate_families(features: DataFrame, families: DataFrame) -> DataFrame:
    """Element features get a ``family`` attribute."""
    fam = families.select("element_id", "family")
    added = F.when(
        F.col("family").isNotNull(),
        F.map_concat("attributes", F.create_map(F.lit("family"), F.array("family"))),
    ).otherwise(F.col("attributes"))
    return features.join(fam, "element_id", "left").withColumn("attributes", added)


def age_summary(ages: DataFrame, members: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Age rows with family size and superfamily, ordered by type, family, size."""
    sizes = members.groupBy("type", "family").agg(F.count("*").alias("family_size"))
    code = F.regexp_extract("family", r"^([A-Z]{3})_?", 1)
    named = taxonomy.select(F.col("code").alias("_code"), F.col("superfamily"))
    return (
        ages.join(sizes, ["type", "family"])
        .withColumn("_code", code)
        .join(F.broadcast(named), "_code", "left")
        .withColumn("superfamily", F.coalesce("superfamily", F.lit("Unknown")))
        .drop("_code")
        .orderBy(natural_key("type"), natural_key("family"), F.col("family_size").desc(), "element_id")
    )


def exemplars_by_hits(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Member with most hits per family."""
    fam = members.select(F.col("element_id").alias("query"), "family")
    counts = hits.join(fam, "query").groupBy("family", "query").agg(F.count("*").alias("hits"))
    return top_per_key(counts, "family", [F.col("hits").desc(), natural_key("query"), F.col("query")]).select(
        "family", F.col("query").alias("element_id"), "hits"
    )


