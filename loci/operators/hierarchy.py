"""Operators on nested features: regions, elements and their parts.

The tree is kept as flat rows. An element row has ``element_id``, ``seq_id``,
``start``, ``end``, ``strand``; a part row has ``element_id``, ``type``,
``name`` (for domains), ``start`` and ``end``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import natural_key, round_half_up
from ..session import materialize
from .intervals import TILE, carry_over_tiles, contain_join, merge_intervals, overlap_join
from .ordering import top_per_key

# Domain-name patterns, matched without regard to case.
GYPSY_FILTER = r"(?i)RVT_1|Chromo"
COPIA_FILTER = r"(?i)RVT_2|UBN2"
TRANSPOSASE = r"(?i)transpos(?:ase)?|mule|(?:dbd|dde)?_tnp_(?:hat)?|duf4216"
RETRO_DOMAINS = r"(?i)rve|rvt|rvp|gag|chromo|rnase|athila|zf-cchc|ubn2"
GYPSY_CLASS = r"(?i)rvt_1|chromo"
COPIA_CLASS = r"(?i)rvt_2|ubn2"
EXPECTED_DUPLICATE = r"(?i)chromo"

MAX_ELEMENT = 25000
MAX_MITE = 600

DOMAIN = "protein_match"


def is_domain() -> Column:
    return F.col("type") == DOMAIN


def attach_parent(children: DataFrame, elements: DataFrame) -> DataFrame:
    """Parts with the coordinates of their element as ``e_start``, ``e_end``, ``e_strand``."""
    parent = elements.select(
        "seq_id",
        "element_id",
        F.col("start").alias("e_start"),
        F.col("end").alias("e_end"),
        F.col("strand").alias("e_strand"),
    )
    return children.join(parent, ["seq_id", "element_id"])


def score_elements(parts: DataFrame) -> DataFrame:
    """Evidence score per element (A1).

    One point for a binding site, a tract and an inverted repeat, one per
    domain, one when both duplications exist and are equally long. Everything
    is a mergeable aggregate, so a crowded element costs no more memory.
    """
    is_tsd = F.col("type") == "target_site_duplication"
    length = F.col("end") - F.col("start") + 1
    at = F.struct("start", "end")

    def has(kind: str) -> Column:
        return F.max(F.when(F.col("type") == kind, 1).otherwise(0))

    flags = parts.groupBy("element_id").agg(
        has("primer_binding_site").alias("pbs"),
        has("RR_tract").alias("ppt"),
        has("inverted_repeat").alias("ir"),
        F.sum(F.when(is_domain(), 1).otherwise(0)).alias("domains"),
        F.sum(F.when(is_tsd, 1).otherwise(0)).alias("tsds"),
        F.min(F.when(is_tsd, F.struct(at.alias("at"), length.alias("length")))).alias("_first"),
        F.max(F.when(is_tsd, F.struct(at.alias("at"), length.alias("length")))).alias("_last"),
    )
    equal = F.when((F.col("tsds") >= 2) & (F.col("_first")["length"] == F.col("_last")["length"]), 1).otherwise(0)
    return flags.select(
        "element_id",
        "pbs",
        "ppt",
        "ir",
        "domains",
        equal.alias("tsd_equal"),
        (F.col("pbs") + F.col("ppt") + F.col("ir") + F.col("domains") + equal).cast("bigint").alias("score"),
    )


def refine_rules(
    elements: DataFrame,
    parts: DataFrame,
    drop_transposase: bool = True,
    drop_duplicates: bool = True,
    require_domains: bool = False,
    max_length: int = MAX_ELEMENT,
) -> DataFrame:
    """Elements with the first rule that removes them, or NULL (A2).

    Rules in order: gypsy and copia domains in one element; transposase
    domains; a domain found twice (one kind is expected to repeat); too long;
    no domain at all.
    """
    domains = parts.where(is_domain()).withColumn("_name", F.split("name", ";")[0])
    # one row per (element, domain name) before anything is gathered per element
    counted = domains.groupBy("element_id", "_name").agg(F.count("*").alias("_n"))
    gypsy = F.col("_name").rlike(GYPSY_FILTER)
    copia = ~gypsy & F.col("_name").rlike(COPIA_FILTER)
    tnp = ~gypsy & ~copia & F.col("_name").rlike(TRANSPOSASE)
    dup = (F.col("_n") > 1) & ~F.col("_name").rlike(EXPECTED_DUPLICATE)
    flags = counted.groupBy("element_id").agg(
        F.bool_or(gypsy).alias("_gypsy"),
        F.bool_or(copia).alias("_copia"),
        F.bool_or(tnp).alias("_tnp"),
        F.bool_or(dup).alias("_dup"),
    )
    length = F.col("end") - F.col("start") + 1
    rule = F.when(F.col("_gypsy") & F.col("_copia"), "compound_gyp_cop_filtered")
    if drop_transposase:
        rule = rule.when(F.col("_tnp"), "class_II_filtered")
    if drop_duplicates:
        rule = rule.when(F.col("_dup"), "dup_pdoms_filtered")
    rule = rule.when(length >= max_length, "length_filtered")
    if require_domains:
        rule = rule.when(F.col("_gypsy").isNull(), "coding_domain_filtered")
    return elements.join(flags, "element_id", "left").withColumn("rule", rule).drop("_gypsy", "_copia", "_tnp", "_dup")


def refine(elements: DataFrame, parts: DataFrame, **rules) -> DataFrame:
    """Elements that pass every rule (A2)."""
    return refine_rules(elements, parts, **rules).where(F.col("rule").isNull()).drop("rule")


def refine_stats(elements: DataFrame, parts: DataFrame, **rules) -> DataFrame:
    """Elements removed per rule, and the total looked at (A2)."""
    ruled = refine_rules(elements, parts, **rules)
    return (
        ruled.groupBy("rule")
        .agg(F.count("*").alias("n"))
        .select(F.coalesce("rule", F.lit("passed")).alias("rule"), "n")
        .unionByName(ruled.agg(F.count("*").alias("n")).select(F.lit("total_num").alias("rule"), "n"))
    )


_CALL = ["seq_id", "start", "end", "id", "score", "similarity"]


def assign_to_strict(strict: DataFrame, relaxed: DataFrame, bin: int = 4096, levels: int = 4) -> DataFrame:
    """Each relaxed interval that overlaps a strict one, with its ``anchor``.

    The anchor is the strict interval it overlaps most, then the one with the
    smallest start, then id.
    """
    pairs = overlap_join(relaxed.select(*_CALL), strict.select("seq_id", "start", "end", "id"), bin=bin, levels=levels)
    shared = F.least("end", "b_end") - F.greatest("start", "b_start") + 1
    order, ties = [F.col("_shared").desc(), F.col("b_start")], [natural_key("b_id"), F.col("b_id")]
    return top_per_key(pairs.withColumn("_shared", shared), "id", order, ties=ties).select(*_CALL, F.col("b_id").alias("anchor"))


def _top_call(group: DataFrame) -> DataFrame:
    """Highest score, then similarity, then natural id, of each ``anchor``."""
    order, ties = [F.col("score").desc(), F.col("similarity").desc()], [natural_key("id"), F.col("id"), F.col("set")]
    return top_per_key(group, "anchor", order, ties=ties)


def best_of_overlap(strict: DataFrame, relaxed: DataFrame, bin: int = 4096, levels: int = 4) -> DataFrame:
    """Best element of each strict interval and the relaxed ones assigned to it.

    Rows have ``id``, ``seq_id``, ``start``, ``end``, ``score``, ``similarity``.
    Within the group the highest score wins, then similarity, then natural id.
    """
    anchors = strict.select(*_CALL, F.col("id").alias("anchor"), F.lit("strict").alias("set"))
    return _top_call(assign_to_strict(strict, relaxed, bin, levels).withColumn("set", F.lit("relaxed")).unionByName(anchors))


def combine_sets(strict: DataFrame, relaxed: DataFrame, bin: int = 4096, levels: int = 4) -> DataFrame:
    """Best of each overlap group, plus whatever no group consumed.

    The best relaxed interval of each group is found first; strict ones then
    meet it by their id, once: those without one are free, the others compete.
    """
    assigned = materialize(assign_to_strict(strict, relaxed, bin, levels))
    rival = _top_call(assigned.withColumn("set", F.lit("relaxed"))).select("anchor", F.struct(*_CALL, "set").alias("_rival"))
    own = strict.select(F.col("id").alias("anchor"), F.struct(*_CALL, F.lit("strict").alias("set")).alias("_own"))
    met = own.hint("merge").join(rival, "anchor", "left")
    # a strict interval that nothing was assigned to stands alone; otherwise it and its rival come as two rows
    sides = F.when(F.col("_rival").isNull(), F.array("_own")).otherwise(F.array("_own", "_rival"))
    rows = met.select("anchor", F.col("_rival").isNotNull().alias("_used"), F.explode(sides).alias("_r")).select("anchor", "_used", "_r.*")
    best = _top_call(rows.where("_used"))
    free_strict = rows.where(~F.col("_used"))
    free_relaxed = relaxed.select(*_CALL).join(assigned.select("id"), "id", "left_anti")

    def named(t: DataFrame, origin: str) -> DataFrame:
        return t.select(*_CALL, F.lit(origin).alias("origin"))

    return named(best, "best").unionByName(named(free_relaxed, "relaxed")).unionByName(named(free_strict, "strict"))


def label_ends(parts: DataFrame, kind: str = "long_terminal_repeat", key: Sequence[str] = ("seq_id", "element_id")) -> DataFrame:
    """5' and 3' labels of the two terminal repeats of an element.

    Elements with another number of repeats are left out. Count, first and
    last are plain aggregates, so a malformed element with very many repeats
    is never gathered.
    """
    ends = F.struct("start", "end", F.coalesce("strand", F.lit("?")).alias("strand"))
    pair = (
        parts.where(F.col("type") == kind)
        .groupBy(*key)
        .agg(F.count("*").alias("_n"), F.min(ends).alias("_first"), F.max(ends).alias("_second"))
        .where(F.col("_n") == 2)
    )
    both = pair.select(
        *key,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("no"), F.col("_first").alias("at")),
                F.struct(F.lit(2).alias("no"), F.col("_second").alias("at")),
            )
        ).alias("_e"),
    )
    first, strand = F.col("_e.no") == 1, F.col("_e.at.strand")
    side = (
        F.when(strand == "+", F.when(first, "5prime").otherwise("3prime"))
        .when(strand == "-", F.when(first, "3prime").otherwise("5prime"))
        .otherwise(F.when(first, "unk-prime-f").otherwise("unk-prime-r"))
    )
    return both.select(
        *key,
        side.alias("side"),
        F.col("_e.at.start").alias("start"),
        F.col("_e.at.end").alias("end"),
        strand.alias("strand"),
    )


def exclude_by_child(elements: DataFrame, parts: DataFrame, pattern: str = RETRO_DOMAINS) -> DataFrame:
    """Elements without any domain that matches ``pattern``."""
    hit = parts.where(is_domain() & F.col("name").rlike(pattern)).select("element_id")
    return elements.join(hit, "element_id", "left_anti")


def drop_degenerate(elements: DataFrame, parts: DataFrame, kind: str = "terminal_inverted_repeat") -> DataFrame:
    """Elements without two terminal repeats that both equal the element."""
    whole = (
        attach_parent(parts.where(F.col("type") == kind), elements)
        .where((F.col("start") == F.col("e_start")) & (F.col("end") == F.col("e_end")))
        .groupBy("element_id")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") == 2)
    )
    return elements.join(whole, "element_id", "left_anti")


def filter_domains(parts: DataFrame, pattern: str = TRANSPOSASE, keep: bool = False) -> DataFrame:
    """Keep, or ignore, domains whose name matches (P18); other parts stay."""
    match = F.col("name").rlike(pattern)
    return parts.where(~is_domain() | (match if keep else ~match))


def domain_flags(parts: DataFrame) -> DataFrame:
    """Per element: number of domains and the superfamily its domains point at.

    Gypsy wins when the domains point at both.
    """
    name = F.col("name")
    return (
        parts.where(is_domain())
        .groupBy("element_id")
        .agg(
            F.count("*").alias("domains"),
            F.bool_or(name.rlike(GYPSY_CLASS) & ~name.rlike(COPIA_CLASS)).alias("_gypsy"),
            F.bool_or(name.rlike(COPIA_CLASS) & ~name.rlike(GYPSY_CLASS)).alias("_copia"),
        )
        .select(
            "element_id",
            "domains",
            F.when(F.col("_gypsy"), "Gypsy").when(F.col("_copia"), "Copia").alias("superfamily"),
        )
    )


def relabel(elements: DataFrame, parts: DataFrame, kind: str, label: str, max_length: int | None = None) -> DataFrame:
    """Give elements of ``kind`` without domains another type.

    LTR elements become LARDs whatever their length, inverted-repeat elements
    become MITEs when at most 600 long.
    """
    with_domain = parts.where(is_domain()).select("element_id").distinct().withColumn("_has", F.lit(True))
    size = F.col("end") - F.col("start") + 1
    rule = (F.col("type") == kind) & F.col("_has").isNull()
    if max_length is not None:
        rule = rule & (size <= max_length)
    return (
        elements.join(with_domain, "element_id", "left")
        .withColumn("new_type", F.when(rule, label).otherwise(F.col("type")))
        .withColumn(
            "new_id",
            F.when(rule, F.concat(F.lit(label), F.regexp_extract("element_id", r"([0-9]+)$", 1))).otherwise(F.col("element_id")),
        )
        .drop("_has")
    )


def reparent(parts: DataFrame, renamed: DataFrame) -> DataFrame:
    """Children follow a renamed element; duplications stay with their region."""
    names = renamed.select("element_id", "new_id")
    moved = parts.join(names, "element_id", "left")
    stays = F.col("type") == "target_site_duplication"
    return moved.withColumn("parent", F.when(stays, F.col("region_id")).otherwise(F.coalesce("new_id", "element_id"))).drop("new_id")


def without(t: DataFrame, used: DataFrame, key: str | Sequence[str] = "region_id") -> DataFrame:
    """Regions not used yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return t.join(used.select(*keys), keys, "left_anti")


def element_flanks(elements: DataFrame, lengths: DataFrame, size: int = 1000, tile: int = TILE) -> DataFrame:
    """Up to ``size`` letters on both sides of each element that belong to no element.

    Elements that overlap or touch are one stretch; its flanks end at the next
    stretch or at the end of the sequence. Rows have ``flank_id`` (the element
    and its side), ``element_id``, ``seq_id``, ``start``, ``end``, ``length``;
    a side without room has no row. Neighbouring stretches are found tile by
    tile, so a sequence with very many elements is cut over many tasks.
    """
    stretches = merge_intervals(elements.select("seq_id", "start", "end"), gap=1, tile=tile)
    stretches = materialize(stretches.select("seq_id", "start", "end", F.floor((F.col("start") - 1) / tile).cast("bigint").alias("_tile")))
    before = carry_over_tiles(stretches, ["seq_id"], F.max("end"), "max", name="_left")
    both = carry_over_tiles(before, ["seq_id"], F.min("start"), "last", name="_right", descending=True)
    w = Window.partitionBy("seq_id", "_tile").orderBy("start")
    room = both.select(
        "seq_id",
        "start",
        "end",
        F.coalesce(F.lag("end").over(w), F.col("_left"), F.lit(0)).alias("left"),
        F.coalesce(F.lead("start").over(w), F.col("_right")).alias("right"),
    )
    placed = contain_join(elements.select("seq_id", "start", "end", "element_id"), room).join(lengths.select("seq_id", F.col("length").alias("_len")), "seq_id")
    right = F.coalesce("r_right", F.col("_len") + 1)
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.greatest(F.col("r_left") + 1, F.col("r_start") - size).alias("start"), (F.col("r_start") - 1).alias("end")),
        F.struct(F.lit("right").alias("side"), (F.col("r_end") + 1).alias("start"), F.least(right - 1, F.col("r_end") + size).alias("end")),
    )
    rows = placed.select("seq_id", "element_id", F.explode(sides).alias("f")).where(F.col("f.end") >= F.col("f.start"))
    return rows.select(
        F.concat_ws("_", "element_id", "f.side").alias("flank_id"),
        "element_id",
        "seq_id",
        F.col("f.start").alias("start"),
        F.col("f.end").alias("end"),
        (F.col("f.end") - F.col("f.start") + 1).alias("length"),
    )


def flank_matches(flanks: DataFrame, hits: DataFrame, coverage: float = 0.5, min_identity: float | None = None) -> DataFrame:
    """Flanks with whether one hit covers enough of them (first half of J9)."""
    found = hits if min_identity is None else hits.where(F.col("identity") >= min_identity)
    longest = found.groupBy(F.col("query").alias("flank_id")).agg(F.max("length").alias("_hit"))
    return flanks.join(longest, "flank_id", "left").withColumn(
        "matched", F.coalesce(F.col("_hit") / F.col("length") >= coverage, F.lit(False))
    ).drop("_hit")


def filter_gene_like(
    elements: DataFrame, flanks: DataFrame, hits: DataFrame, coverage: float = 0.5, min_identity: float | None = None
) -> DataFrame:
    """Elements that keep at least one flank not covered by a gene hit."""
    flagged = flank_matches(flanks, hits, coverage, min_identity)
    gone = flagged.groupBy("element_id").agg(F.bool_and("matched").alias("_all")).where("_all")
    return elements.join(gone, "element_id", "left_anti")


def gene_filter_totals(elements: DataFrame, kept: DataFrame) -> DataFrame:
    """Found, removed and kept elements of the gene filter."""
    left = kept.agg(F.count("*")).scalar()
    return elements.agg(F.count("*").alias("total")).select(
        "total", (F.col("total") - left).alias("removed"), left.alias("filtered")
    )


# --------------------------------------------------------------------------
# domain architectures


def architecture(parts: DataFrame) -> DataFrame:
    """Domain names of each element in order of position, joined by commas."""
    rows = F.sort_array(F.collect_list(F.struct("start", "end", "name")))
    return (
        parts.where(is_domain())
        .groupBy("element_id")
        .agg(F.array_join(F.transform(rows, lambda r: r["name"]), ",").alias("architecture"))
    )


def architecture_counts(elements: DataFrame, parts: DataFrame) -> DataFrame:
    """Elements per strand and architecture, and per architecture over both strands (A4)."""
    arch = elements.select("element_id", "strand").join(architecture(parts), "element_id")
    return (
        arch.groupingSets([[F.col("strand"), F.col("architecture")], [F.col("architecture")]], "strand", "architecture")
        .agg(F.count("*").alias("n"), F.grouping("strand").alias("_both"))
        .select(F.when(F.col("_both") == 1, "both").otherwise(F.col("strand")).alias("strand"), "architecture", "n")
        .orderBy("strand", F.col("n").desc(), "architecture")
    )


def merged_domains(parts: DataFrame) -> DataFrame:
    """Ranges of one domain name in one element, overlapping or abutting ones merged."""
    domains = parts.where(is_domain()).select("seq_id", "element_id", "name", "start", "end")
    return merge_intervals(domains, by=["seq_id", "element_id", "name"], gap=1)


def architecture_detail(parts: DataFrame) -> DataFrame:
    """``name{start-end},...`` per element, same-name overlaps merged first (A5)."""
    merged = merged_domains(parts)
    rows = F.sort_array(F.collect_list(F.struct("start", "end", "name")))
    text = F.transform(rows, lambda r: F.concat(r["name"], F.lit("{"), r["start"], F.lit("-"), r["end"], F.lit("}")))
    return merged.groupBy("element_id").agg(F.array_join(text, ",").alias("architecture"))


# --------------------------------------------------------------------------
# inverted-repeat superfamilies


def tir_evidence(elements: DataFrame, parts: DataFrame, tsd_residues: DataFrame, element_residues: DataFrame) -> DataFrame:
    """Per element the facts its superfamily is decided on.

    ``tsd_residues`` has the letters of the duplications two bases long,
    ``element_residues`` those of the elements.
    """
    tsd = parts.where(F.col("type") == "target_site_duplication").withColumn("_len", F.col("end") - F.col("start") + 1)
    lengths = tsd.groupBy("element_id").agg(
        F.bool_or(F.col("_len") == 8).alias("tsd_8"), F.bool_or(F.col("_len").between(8, 11)).alias("tsd_8_11")
    )
    ta = tsd_residues.groupBy("element_id").agg(F.bool_or(F.col("residues").rlike("(?i)ta")).alias("tsd_ta"))
    # only the ends are matched, however long the text: five letters and a line break behind them
    head, tail = F.left("residues", F.lit(4)), F.right("residues", F.lit(7))
    cact = element_residues.select("element_id", (head.rlike("(?i)^cact") | tail.rlike("(?i)cact(?:a|g)?$")).alias("cact_ends"))
    domains = parts.where(is_domain()).groupBy("element_id").agg(F.count("*").alias("domains"))
    out = elements
    for facts in (lengths, ta, cact, domains):
        out = out.join(facts, "element_id", "left")
    return out.fillna(False, ["tsd_8", "tsd_8_11", "tsd_ta", "cact_ends"]).fillna(0, ["domains"])


def tir_superfamily(t: DataFrame) -> DataFrame:
    """First rule that holds names the superfamily.

    In order: MITE, Tc1/Mariner, hAT, Mutator, CACTA, unclassified; an element
    taken by one rule is not seen by the next.
    """
    length = F.col("end") - F.col("start") + 1
    rule = (
        F.when((F.col("domains") == 0) & (length <= MAX_MITE), "MITE")
        .when(F.col("tsd_ta"), "Tc1-Mariner")
        .when(F.col("tsd_8"), "hAT")
        .when(F.col("tsd_8_11"), "Mutator")
        .when(F.col("cact_ends"), "CACTA")
        .otherwise("unclassified")
    )
    return t.withColumn("superfamily", rule)


def superfamily_totals(t: DataFrame, by: str = "superfamily") -> DataFrame:
    """Elements per superfamily and overall."""
    return t.rollup(by).agg(F.count("*").alias("n"), F.grouping(by).alias("_g")).select(
        F.when(F.col("_g") == 1, "total").otherwise(F.col(by)).alias(by), "n"
    )


# --------------------------------------------------------------------------
# summaries


def length_stats(t: DataFrame, by: str | Sequence[str], domains: str | None = None) -> DataFrame:
    """Count, shortest, longest and mean length per group, and how many have domains (A3)."""
    keys = [by] if isinstance(by, str) else list(by)
    size = F.col("end") - F.col("start") + 1
    extra = [] if domains is None else [F.sum(F.when(F.col(domains) > 0, 1).otherwise(0)).alias("with_domains")]
    return t.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        round_half_up(F.sum(size) / F.count("*"), 2).alias("mean_length"),
        *extra,
    )


def refine_report(
    gene_totals: DataFrame,
    strict: DataFrame,
    relaxed: DataFrame,
    combined: DataFrame,
    kept: DataFrame,
    rules: Sequence[DataFrame],
) -> DataFrame:
    """Ledger of a refinement run as (measure, n) rows.

    ``rules`` are the outputs of :func:`refine_stats` of both runs; ``kept`` is
    ``combined`` after the ambiguous-residue filter.
    """

    def one(t: DataFrame, measure: str) -> DataFrame:
        return t.agg(F.count("*").alias("n")).select(F.lit(measure).alias("measure"), "n")

    genes = gene_totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("found").alias("measure"), F.col("total").alias("n")),
                F.struct(F.lit("removed_by_genes").alias("measure"), F.col("removed").alias("n")),
                F.struct(F.lit("passed_genes").alias("measure"), F.col("filtered").alias("n")),
            )
        ).alias("r")
    ).select("r.*")
    removed = rules[0]
    for more in rules[1:]:
        removed = removed.unionByName(more)
    removed = removed.where(~F.col("rule").isin("passed", "total_num")).groupBy(F.col("rule").alias("measure")).agg(F.sum("n").alias("n"))
    out = genes.unionByName(removed)
    out = out.unionByName(one(strict, "strict")).unionByName(one(relaxed, "relaxed"))
    out = out.unionByName(one(combined.where(F.col("origin") == "best"), "best"))
    out = out.unionByName(one(kept, "combined"))
    n_removed = combined.select("id").join(kept.select("id"), "id", "left_anti")
    return out.unionByName(one(n_removed, "n_perc_filtered"))
