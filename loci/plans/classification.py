"""Superfamilies and families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import families as fam
from ..operators import hierarchy as hi
from ..operators.hits import filter_hits_by_coverage, greedy_pairs
from ..operators.sequences import CHUNK_SIZE, slice_sequences
from ..operators.similarity import cluster_sequences
from ..session import materialize


def assign_families(
    elements: DataFrame,
    parts: DataFrame,
    chunks: DataFrame,
    k: int = 16,
    min_share: float = 0.8,
    kind: str = "long_terminal_repeat",
    size: int = CHUNK_SIZE,
    recruiting: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Families of ``elements`` (with ``superfamily``) by clustering each of their parts.

    Parts are compared within one superfamily and kind of part; elements with
    the same clusters throughout form a family. An element no part of which is
    like another's is a singleton; with ``recruiting`` = (hits, lengths) it may
    join the family of its best hit.
    """
    pieces = fam.element_parts(elements, parts, kind)
    # domain ranges of one name are one part: join their residues per element
    cut = slice_sequences(pieces, chunks, ["element_id", "part"], size)
    rows = F.sort_array(F.collect_list(F.struct("start", "residues")))
    joined = cut.groupBy("element_id", "part").agg(F.array_join(F.transform(rows, lambda r: r["residues"]), "").alias("residues"))
    named = joined.join(elements.select("element_id", "superfamily"), "element_id").withColumn(
        "id", F.concat_ws("\t", "part", "element_id")
    )
    named = materialize(fam.drop_small_groups(named, ["superfamily", "part"]))
    clusters = cluster_sequences(named, k, min_share, within=["superfamily", "part"])
    members = fam.drop_small_groups(clusters, "cluster").select(
        F.split("id", "\t")[0].alias("part"), F.split("id", "\t")[1].alias("element_id"), F.col("cluster").alias("cluster_id")
    )
    grouped = fam.signature_families(members).select("element_id", "family_key")
    keyed = elements.select("element_id", "superfamily").join(grouped, "element_id", "left")
    keyed = materialize(keyed.withColumn("family_key", F.coalesce("family_key", "element_id")))
    numbered = fam.number_families(keyed)
    out = keyed.join(numbered.select("superfamily", "family_key", "family", "is_singleton"), ["superfamily", "family_key"])
    out = out.select("element_id", "superfamily", "family", "is_singleton")
    if recruiting is None:
        return out
    hits, lengths = recruiting
    fixed = materialize(out)
    settled, single = fixed.where(~F.col("is_singleton")), fixed.where("is_singleton")
    labels = fixed.select("element_id", "superfamily")
    sided = hits.join(
        labels.withColumnsRenamed({"element_id": "query", "superfamily": "query_superfamily"}), "query"
    ).join(labels.withColumnsRenamed({"element_id": "subject", "superfamily": "subject_superfamily"}), "subject")
    joins = fam.recruit(single, settled, sided, lengths).select(
        "element_id", F.col("family").alias("_family"), F.col("subject").alias("_by")
    )
    host = settled.select(F.col("element_id").alias("_by"), F.col("superfamily").alias("_superfamily"))
    moved = fixed.join(joins.join(host, "_by"), "element_id", "left")
    return moved.select(
        "element_id",
        F.coalesce("_superfamily", "superfamily").alias("superfamily"),
        F.coalesce("_family", "family").alias("family"),
        (F.col("is_singleton") & F.col("_family").isNull()).alias("is_singleton"),
    )


def feature_rows(elements: DataFrame, parts: DataFrame | None, families: DataFrame | None) -> DataFrame:
    """Regions, elements and parts as feature rows, ready to be written.

    An element whose type has become LARD or MITE takes that name with its old
    number, and its parts follow; duplications belong to the region. Elements
    carry their family. Without ``region_id`` elements stand alone.
    """
    has_region = "region_id" in elements.columns
    number = F.regexp_extract("element_id", r"([0-9]+)$", 1)
    new_id = F.when(F.col("type").isin("LARD", "MITE"), F.concat("type", number)).otherwise(F.col("element_id"))
    named = elements.withColumn("new_id", new_id)
    none = F.lit(None).cast("string")

    def shaped(t: DataFrame, attributes: Column) -> DataFrame:
        return t.select(
            "seq_id",
            F.lit("loci").alias("source"),
            "type",
            "start",
            "end",
            F.lit(None).cast("double").alias("score"),
            F.coalesce("strand", F.lit("?")).alias("strand"),
            F.lit(None).cast("int").alias("phase"),
            F.map_filter(attributes, lambda k, v: F.get(v, F.lit(0)).isNotNull()).alias("attributes"),
            "element_id",
        )

    def lists(**values: Column) -> Column:
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(v))])

    region = F.col("region_id") if has_region else none
    out = shaped(named, lists(ID=F.col("new_id"), Parent=region))
    if families is not None:
        out = fam.annotate_families(out, families).drop("family")
    tables = [out]
    if has_region:
        tables.append(shaped(named.withColumn("type", F.lit("repeat_region")), lists(ID=F.col("region_id"))))
    if parts is not None:
        moved = hi.reparent(parts, named.select("element_id", "new_id"))
        name = F.when(hi.is_domain(), F.col("name"))
        tables.append(shaped(moved, lists(Parent=F.col("parent"), name=name)))
    return reduce(DataFrame.unionByName, tables).drop("element_id")


def _reports(elements: DataFrame, parts: DataFrame, families: DataFrame, hits: DataFrame | None) -> dict[str, DataFrame]:
    counted = elements.join(hi.domain_flags(parts).select("element_id", "domains"), "element_id", "left").fillna(0, ["domains"])
    exemplars = {} if hits is None else {"exemplars": fam.exemplars_by_hits(hits, families)}
    return {
        **exemplars,
        "elements": elements,
        "families": families,
        "features": feature_rows(elements, parts, families),
        "family_counts": fam.family_counts(families),
        "length_stats": hi.length_stats(counted, "superfamily", "domains"),
        "architecture_counts": hi.architecture_counts(elements, parts),
        "architecture_detail": hi.architecture_detail(parts).join(families.select("element_id", "family"), "element_id"),
        "superfamily_totals": hi.superfamily_totals(elements),
    }


def classify_ltr(
    elements: DataFrame,
    parts: DataFrame,
    chunks: DataFrame,
    library: tuple[DataFrame, DataFrame] | None = None,
    hits: DataFrame | None = None,
    **clustering,
) -> dict[str, DataFrame]:
    """Superfamilies and families of LTR elements.

    Domains decide first; the rest may be named by the best hit to a labelled
    library = (hits, labels). What stays unnamed and has no domain is a LARD.
    ``hits`` among the elements name the exemplar of each family (W15).
    """
    own = parts.join(elements.select("element_id"), "element_id", "left_semi")
    own = hi.filter_domains(own, hi.TRANSPOSASE, keep=False)
    called = elements.join(hi.domain_flags(own).select("element_id", F.col("superfamily").alias("_sf")), "element_id", "left")
    if library is not None:
        called = fam.label_from_library(called, *library)
    else:
        called = called.withColumn("called", F.lit(None).cast("string"))
    called = called.withColumn("superfamily", F.coalesce("_sf", "called", F.lit("Unclassified"))).drop("_sf", "called")
    lards = hi.relabel(called, own, "LTR_retrotransposon", "LARD")
    unnamed = F.col("superfamily") == "Unclassified"
    called = lards.withColumn("type", F.when(unnamed, F.col("new_type")).otherwise(F.col("type"))).drop("new_type", "new_id")
    called = materialize(called)
    families = assign_families(called, own, chunks, **clustering)
    return _reports(called, own, families, hits)


def classify_tir(
    elements: DataFrame,
    parts: DataFrame,
    chunks: DataFrame,
    size: int = CHUNK_SIZE,
    hits: DataFrame | None = None,
    **clustering,
) -> dict[str, DataFrame]:
    """Superfamilies and families of inverted-repeat elements (C3); ``hits`` as in :func:`classify_ltr`."""
    own = parts.join(elements.select("element_id"), "element_id", "left_semi")
    own = hi.filter_domains(own, hi.TRANSPOSASE, keep=True)
    two = own.where((F.col("type") == "target_site_duplication") & (F.col("end") - F.col("start") + 1 == 2))
    tsd = slice_sequences(two, chunks, ["element_id"], size).select("element_id", "residues")
    whole = slice_sequences(elements, chunks, ["element_id"], size).select("element_id", "residues")
    called = hi.tir_superfamily(hi.tir_evidence(elements, own, tsd, whole)).drop("tsd_8", "tsd_8_11", "tsd_ta", "cact_ends", "domains")
    called = materialize(
        called.withColumn("type", F.when(F.col("superfamily") == "MITE", "MITE").otherwise(F.col("type")))
    )
    families = assign_families(called, own, chunks, kind="terminal_inverted_repeat", size=size, **clustering)
    return _reports(called, own, families, hits)


def pair_families(
    elements: DataFrame,
    hits: DataFrame | None,
    min_identity: float = 80.0,
    min_length: int = 80,
    coverage: float = 0.5,
) -> dict[str, DataFrame]:
    """Two-member families of elements without parts, by best free hit.

    ``elements`` has ``element_id``, ``length`` and ``superfamily``; what finds
    no partner (nothing does without ``hits``) is a singleton. Elements with
    places come back as features with their family too (J11).
    """
    lengths = elements.select(F.col("element_id").alias("id"), "length")
    keyed = elements.select("element_id", "superfamily")
    if hits is None:
        keyed = keyed.withColumn("family_key", F.lit(None).cast("string"))
    else:
        good = filter_hits_by_coverage(hits.where(F.col("query") != F.col("subject")), lengths, None, min_identity, min_length, coverage)
        pairs = greedy_pairs(good.select("query", "subject", "bits"))
        owner = pairs.select(F.explode(F.array("query", "subject")).alias("element_id"), F.col("subject").alias("family_key"))
        keyed = keyed.join(owner, "element_id", "left")
    # both members go by the superfamily of the subject
    host = elements.select(F.col("element_id").alias("family_key"), F.col("superfamily").alias("_sf"))
    keyed = keyed.withColumn("family_key", F.coalesce("family_key", "element_id")).join(host, "family_key")
    keyed = materialize(keyed.select("element_id", "family_key", F.col("_sf").alias("superfamily")))
    numbered = fam.number_families(keyed)
    families = keyed.join(
        numbered.select("superfamily", "family_key", "family", "is_singleton"), ["superfamily", "family_key"]
    ).select("element_id", "superfamily", "family", "is_singleton")
    placed = {"features": feature_rows(elements, None, families)} if {"seq_id", "start", "end", "strand", "type"} <= set(elements.columns) else {}
    return {**placed, "families": families, "family_counts": fam.family_counts(families)}
