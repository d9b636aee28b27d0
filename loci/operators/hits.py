"""Operators on alignment-hit tables (one row per hit, see ``schema.HIT``)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import round_half_up
from ..session import discard, materialize
from .ordering import top_per_key

# Thresholds by use: (identity, length)
FRAGMENTS = (80.0, 100)
CLASSIFY = (80.0, 80)
MASKING = (80.0, 70)


def normalize_hits(t: DataFrame) -> DataFrame:
    """Strand from the order of the subject ends, then ends in order."""
    reversed_ = F.col("s_start") > F.col("s_end")
    return t.withColumns(
        {
            "strand": F.when(reversed_, "-").otherwise("+"),
            "s_start": F.least("s_start", "s_end"),
            "s_end": F.greatest("s_start", "s_end"),
        }
    )


def normalize_ends(t: DataFrame, start: str = "start", end: str = "end", strand: str = "strand") -> DataFrame:
    """Swap reversed ends and spell strands as ``+``/``-``."""
    word = F.lower(F.col(strand))
    sign = (
        F.when(word.isin("forward", "+"), "+")
        .when(word.isin("reverse", "-"), "-")
        .when(F.col(start) > F.col(end), "-")
        .otherwise("?")
    )
    return t.withColumns({start: F.least(start, end), end: F.greatest(start, end), strand: sign})


def order_hits(t: DataFrame, by: str = "score") -> DataFrame:
    """Sort by bit score, highest first, or by subject position."""
    if by == "score":
        return t.orderBy(F.col("bits").desc(), "query", "subject", "s_start", "s_end")
    return t.orderBy("subject", "s_start", "s_end", F.col("bits").desc(), "query")


def filter_hits(t: DataFrame, min_identity: float = 80.0, min_length: int = 80) -> DataFrame:
    """Identity and length threshold."""
    return t.where((F.col("identity") >= min_identity) & (F.col("length") >= min_length))


def filter_hits_by_coverage(
    t: DataFrame,
    query_lengths: DataFrame,
    subject_lengths: DataFrame | None = None,
    min_identity: float = 80.0,
    min_length: int = 80,
    coverage: float = 0.5,
    side: str = "shorter",
) -> DataFrame:
    """Hit covers a share of the shorter sequence (P4), or of the query (P5)."""
    kept = filter_hits(t, min_identity, min_length)
    kept = kept.join(query_lengths.select(F.col("id").alias("query"), F.col("length").alias("q_len")), "query")
    if side == "query":
        return kept.where(F.col("length") >= F.col("q_len") * coverage)
    if subject_lengths is None:
        subject_lengths = query_lengths
    kept = kept.join(subject_lengths.select(F.col("id").alias("subject"), F.col("length").alias("s_len")), "subject")
    return kept.where(F.col("length") >= F.least("q_len", "s_len") * coverage)


def filter_compatible(t: DataFrame, query_superfamily: str = "query_superfamily", subject_superfamily: str = "subject_superfamily") -> DataFrame:
    """No self hits; same superfamily, or unknown query with known subject."""
    q, s = F.col(query_superfamily), F.col(subject_superfamily)
    unknown = F.lower(q).contains("unknown") & ~F.lower(s).contains("unknown")
    return t.where((F.col("query") != F.col("subject")) & ((q == s) | unknown))


def hit_order() -> list[Column]:
    """Best first, and total, so that ties never depend on row order."""
    return [F.col("bits").desc(), F.col("identity").desc(), F.col("length").desc(), F.col("subject"), F.col("s_start"), F.col("s_end")]


def best_hit(t: DataFrame, by: str | Sequence[str] = "query", ties: Sequence[Column] = ()) -> DataFrame:
    """Best hit of each query by bit score."""
    return top_per_key(t, by, [*hit_order(), *ties])


def best_vote(t: DataFrame, key: str = "key", vote: str = "vote", evalue: str = "evalue") -> DataFrame:
    """Class with the lowest e-value per key and its ratio to the runner-up.

    A key with one hit is compared with 1000.
    """
    two = top_per_key(t.select(key, vote, evalue), key, [F.col(evalue), F.col(vote)], 2)
    w = Window.partitionBy(key).orderBy(evalue, vote)
    ranked = two.withColumns({"_r": F.row_number().over(w), "second": F.lead(evalue).over(w)})
    second = F.coalesce("second", F.lit(1000.0))
    margin = F.when(second == 0, F.lit(1.0)).otherwise(F.col(evalue) / second)
    return ranked.where(F.col("_r") == 1).select(key, vote, evalue, margin.alias("margin"))


def first_per(t: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key."""
    return top_per_key(t, key, [F.col(c) if isinstance(c, str) else c for c in order])


# Endings of repeat-library names that are cut, in this order, to get a family label.
LABEL_CUTS = [
    (r"I$|_I$|LTR$|_LTR$", ""),
    (r"_AC.*", ""),
    (r"-", "_"),
    (r"[0-9]+$", ""),
    (r"([A-Za-z0-9_]{3}_[A-Za-z0-9_]+?)_.*", "$1"),
]


def clean_label(c: Column | str) -> Column:
    """Family label of a library sequence name."""
    out = F.col(c) if isinstance(c, str) else c
    for pattern, to in LABEL_CUTS:
        out = F.regexp_replace(out, pattern, to)
    return out


def family_votes(hits: DataFrame, family: str = "family", subject: str = "subject") -> DataFrame:
    """Hits and bit-score sum per (family, hit family) (A10)."""
    return (
        hits.withColumn("hit_family", clean_label(subject))
        .groupBy(F.col(family).alias("family"), "hit_family")
        .agg(F.count("*").alias("hit_count"), round_half_up(F.sum("bits"), 2).alias("score_sum"))
    )


def transfer_map(votes: DataFrame) -> DataFrame:
    """Winning hit family per family: count, then score sum, then name."""
    order = [F.col("hit_count").desc(), F.col("score_sum").desc(), F.col("hit_family")]
    return top_per_key(votes, "family", order)


def transfer_rate(t: DataFrame, transferred: str = "transferred") -> DataFrame:
    """Elements, elements with a transferred label, and percent."""
    total = F.count("*")
    moved = F.coalesce(F.sum(F.col(transferred).cast("bigint")), F.lit(0))
    return t.agg(
        total.alias("total"),
        moved.alias("transferred"),
        round_half_up(100.0 * moved / F.when(total > 0, total), 2).alias("percent"),
    )


def greedy_pairs(t: DataFrame, score: str = "bits", a: str = "query", b: str = "subject") -> DataFrame:
    """Take pairs by descending score while both ends are free.

    A pair that is the best one of both its ends is taken by the sequential
    rule whatever comes before it, and a pair with one better neighbour only is
    taken exactly if that one is not. So each round follows these waits to
    their ends by pointer doubling, takes what they settle, and drops the edges
    that it touches: a chain of falling scores takes a number of joins in the
    logarithm of its length. No general bound on the rounds is known; in each
    the best pair left is settled at least. Equal scores are ordered by a
    digest of the pair, not by name.
    """
    edges = (
        t.where(F.col(a) != F.col(b))
        .groupBy(F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi"))
        .agg(F.max(F.struct(score, F.col(a).alias("_a"), F.col(b).alias("_b"))).alias("_e"))
        .select("_lo", "_hi", F.col(f"_e.{score}").alias("_score"), F.col("_e._a").alias("_a"), F.col("_e._b").alias("_b"))
        .withColumn("_tie", F.md5(F.concat_ws("|", "_lo", "_hi")))
    )
    edges = materialize(edges)
    taken: list[DataFrame] = []
    while not edges.isEmpty():
        settled = _settled(_waits(edges))
        chosen = materialize(settled.where(F.col("_odd") == 0).select("_lo", "_hi", "_score", "_a", "_b"))
        discard(settled)
        taken.append(chosen)
        if len(taken) == 8:  # few tables, however many rounds
            taken, old = [materialize(_union(taken))], taken
            discard(*old)
        used = chosen.select(F.explode(F.array("_lo", "_hi")).alias("_used"))
        left = edges.join(used, edges["_lo"] == used["_used"], "left_anti").join(used, edges["_hi"] == used["_used"], "left_anti")
        edges, old = materialize(left), edges
        discard(old)
    found = _union(taken) if taken else edges.select("_lo", "_hi", "_score", "_a", "_b")
    return found.select(F.col("_a").alias(a), F.col("_b").alias(b), F.col("_score").alias(score))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _waits(edges: DataFrame) -> DataFrame:
    """Edges with no better neighbour (``_up`` null) or with one (``_up``); Spark keeps two rows a node before the shuffle."""
    ends = edges.withColumn("_end", F.explode(F.array("_lo", "_hi")))
    best = top_per_key(ends, "_end", [F.col("_score").desc(), F.col("_tie"), F.col("_lo"), F.col("_hi")], k=2)
    order = Window.partitionBy("_end").orderBy(F.col("_score").desc(), "_tie", "_lo", "_hi")
    best = best.withColumn("_better", F.lag(F.struct("_lo", "_hi")).over(order))
    per_edge = best.groupBy("_lo", "_hi").agg(
        F.count("*").alias("_ends"),
        F.count("_better").alias("_waits"),
        F.max("_better").alias("_up"),
        *[F.first(c).alias(c) for c in ("_score", "_a", "_b")],
    )
    few = per_edge.where((F.col("_ends") == 2) & (F.col("_waits") <= 1))
    return materialize(few.withColumn("_odd", F.col("_waits").cast("int")).drop("_ends", "_waits"))


def _settled(state: DataFrame) -> DataFrame:
    """Edges whose waits end at one without a better neighbour; ``_odd`` is 0 for those that are taken."""
    while not state.where(F.col("_up").isNotNull()).isEmpty():
        ahead = state.select(F.struct("_lo", "_hi").alias("_up"), F.col("_up").alias("_next"), F.col("_odd").alias("_more"))
        waiting = state.where(F.col("_up").isNotNull()).join(ahead, "_up")  # one behind an open edge falls out here
        waiting = waiting.withColumns({"_up": F.col("_next"), "_odd": (F.col("_odd") + F.col("_more")) % 2}).drop("_next", "_more")
        state, old = materialize(state.where(F.col("_up").isNull()).unionByName(waiting)), state
        discard(old)
    return state
