"""Solo repeats, ages and recombination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import reverse_complement
from ..operators import families as fam
from ..operators import hits as h
from ..operators.hierarchy import label_ends
from ..operators.intervals import drop_overlapping_previous, renumber
from ..operators import sequences as sq


def solo_repeats(
    hits: DataFrame,
    min_identity: float = 80.0,
    min_length: int = 80,
    query_lengths: DataFrame | None = None,
    min_coverage: float | None = None,
    families: DataFrame | None = None,
    top: int | None = None,
    ties: Sequence[Column] = (),
) -> DataFrame:
    """Terminal repeats that stand alone: matches of repeat models, thinned and numbered.

    ``families`` (element_id, family) with ``top`` restricts the search to the
    models of the largest families. Coverage of the model is tested when
    ``min_coverage`` is given.
    """
    if families is not None and top is not None:
        models = fam.top_families(families, top).select(F.col("element_id").alias("query"))
        hits = hits.join(models, "query", "left_semi")
    if min_coverage is not None and query_lengths is not None:
        good = h.filter_hits_by_coverage(hits, query_lengths, None, min_identity, min_length, min_coverage, side="query")
    else:
        good = h.filter_hits(hits, min_identity, min_length)
    placed = good.select(
        F.col("subject").alias("seq_id"), F.col("s_start").alias("start"), F.col("s_end").alias("end"), "query", "identity", "length", "bits"
    )
    order = [(F.col("end") - F.col("start")).desc(), F.col("identity").desc(), F.col("query"), F.col("bits").desc(), *ties]
    kept = drop_overlapping_previous(placed, order)
    return renumber(kept, "solo_LTR", out="id")


def paired_repeats(parts: DataFrame, chunks: DataFrame, kind: str = "long_terminal_repeat", size: int = sq.CHUNK_SIZE) -> DataFrame:
    """The two terminal repeats of each element side by side, ready to be aligned.

    Of inverted repeats the second one is turned round.
    """
    ends = label_ends(parts, kind)
    cut = sq.slice_sequences(ends, chunks, ["element_id", "side"], size)
    if kind == "terminal_inverted_repeat":
        turned = F.col("side").rlike("3prime|prime-r")
        cut = cut.withColumn("residues", F.when(turned, reverse_complement("residues")).otherwise(F.col("residues")))
    first = F.col("side").isin("5prime", "unk-prime-f")
    return cut.groupBy("element_id").agg(
        F.max(F.when(first, F.col("residues"))).alias("left"), F.max(F.when(~first, F.col("residues"))).alias("right")
    )


def element_ages(aligned: DataFrame, rate: float = 1e-8, key: str = "element_id") -> DataFrame:
    """Divergence, age and transition ratio of aligned repeat pairs."""
    identity = sq.pair_identity(aligned.select(key, "left", "right"))
    aged = sq.substitution_distance(identity.drop("divergence"), rate)
    same = F.col("columns") == F.col("equal")
    zero = lambda c: F.when(same, 0.0).otherwise(F.col(c)).alias(c)
    return aged.select(key, "identity", zero("divergence"), zero("age"), zero("ts_tv"))


def age_of_repeats(
    parts: DataFrame,
    chunks: DataFrame,
    families: DataFrame | None = None,
    exemplars: DataFrame | None = None,
    alignments: DataFrame | None = None,
    all_elements: bool = True,
    kind: str = "long_terminal_repeat",
    rate: float = 1e-8,
    size: int = sq.CHUNK_SIZE,
) -> DataFrame:
    """Ages from features in one call (C10): the two repeats of each element, aligned, and their distance.

    With ``families`` and ``exemplars``, and not ``all_elements``, only the
    exemplars of families are aged, and all elements of a superfamily without
    one (J13). ``alignments`` (element_id, left, right) are taken where they
    exist; the other pairs are compared place by place over the shorter one.
    """
    used = parts.where(F.col("type") == kind)
    if families is not None and exemplars is not None:
        named = fam.select_repeats(used.select("element_id").distinct(), exemplars, families, all_elements)
        used = used.join(named.select("element_id"), "element_id", "left_semi")
    pairs = paired_repeats(used, chunks, kind, size)
    n = F.least(F.length("left"), F.length("right"))
    cut = pairs.select("element_id", *[F.substring(F.col(c), F.lit(1), n).alias(c) for c in ("left", "right")]).where(n > 0)
    if alignments is not None:
        given = alignments.select("element_id", F.col("left").alias("_l"), F.col("right").alias("_r"))
        cut = cut.join(given, "element_id", "left").select(
            "element_id", F.coalesce("_l", "left").alias("left"), F.coalesce("_r", "right").alias("right")
        )
    return element_ages(cut, rate)


def recombination(
    aligned: DataFrame,
    gap: str = "-",
    max_members: int | None = None,
    max_length: int | None = None,
    min_gap: int = 10,
) -> dict[str, DataFrame]:
    """Gap statistics and the direct repeats around gaps (C11).

    ``aligned`` has ``seq_id``, ``family`` and ``residues``; single sequences are
    left out. Rows that are aligned already need no bound on their families;
    one is set only by the caller.
    """
    sized = aligned.withColumn("length", F.length("residues").cast("bigint"))
    used = fam.drop_small_groups(fam.cap_families(sized, max_members, max_length), "family", 2)
    runs = sq.gap_runs(used, gap)
    per_sequence = sq.gap_stats(runs, used.select("seq_id", "length")).join(used.select("seq_id", "family"), "seq_id")
    return {
        "per_sequence": per_sequence,
        "per_family": sq.gap_stats_by_family(per_sequence),
        "repeats": sq.flank_repeats(used, gap, min_gap, key=["seq_id", "family"]),
    }
