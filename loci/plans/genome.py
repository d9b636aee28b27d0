"""Jobs over a whole genome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import families as fam
from ..operators import hits as h
from ..operators.intervals import flip_strand, slop
from ..operators.paths import segment_states
from ..operators.sequences import CHUNK_SIZE, slice_sequences, trim_terminal_gaps
from ..operators.summary import code_of
from ..schema import taxonomy
from ..session import materialize


def annotate_nonltr(
    forward: DataFrame,
    backward: DataFrame,
    lengths: DataFrame,
    chunks: DataFrame | Callable[[DataFrame], DataFrame],
    votes: DataFrame | None = None,
    flank: int = 0,
    min_length: int = 300,
    max_ambiguous: float = 0.30,
    size: int = CHUNK_SIZE,
    tile: int = 1 << 16,
) -> DataFrame:
    """Elements from the state paths of both strands, with clade, code and trimmed residues.

    ``votes`` (key = seq_start_end, vote, evalue) may overrule the clade of the
    path. ``chunks`` may be a function that gives the chunks near the elements.
    """
    plus = segment_states(forward, tile).withColumn("strand", F.lit("+"))
    minus = flip_strand(segment_states(backward, tile), lengths).withColumn("strand", F.lit("-"))
    found = plus.unionByName(minus).withColumn("element_id", F.concat_ws("_", "seq_id", "start", "end", "strand"))
    if votes is not None:
        best = h.best_vote(votes).select(F.col("key").alias("element_id"), F.col("vote").alias("_vote"), "margin")
        found = found.join(best, "element_id", "left").withColumn("clade", F.coalesce("_vote", "clade")).drop("_vote")
    found = code_of(slop(found.drop("length"), lengths, flank), "clade")
    found = materialize(found.withColumn("code", F.coalesce("code", F.lit("RIX"))))
    near = chunks(found) if callable(chunks) else chunks
    cut = slice_sequences(found, near, ["element_id"], size).select("element_id", "residues")
    return trim_terminal_gaps(found.hint("merge").join(cut, "element_id"), max_ambiguous, min_length)


def transfer_annotations(
    elements: DataFrame, hits: DataFrame, min_identity: float = 80.0, min_length: int = 80, coverage: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Names of a reference library moved to whole families.

    ``elements`` has ``element_id``, ``family`` and ``length``; returns them
    with ``reference`` (NULL when nothing was transferred), and the rate.
    """
    lengths = elements.select(F.col("element_id").alias("id"), "length")
    good = h.filter_hits_by_coverage(hits, lengths, None, min_identity, min_length, coverage, side="query")
    named = good.join(elements.select(F.col("element_id").alias("query"), "family"), "query")
    best = h.transfer_map(h.family_votes(named)).select("family", F.col("hit_family").alias("reference"))
    # a label is given to the elements of the family that were hit
    touched = good.select(F.col("query").alias("element_id")).distinct().withColumn("_hit", F.lit(True))
    out = elements.join(best, "family", "left").join(touched, "element_id", "left")
    out = out.withColumn("reference", F.when(F.col("_hit"), F.col("reference"))).drop("_hit")
    return out, h.transfer_rate(out.select(F.col("reference").isNotNull().alias("transferred")))


def global_summary(hits: DataFrame, members: DataFrame, ages: DataFrame) -> dict[str, DataFrame]:
    """Similarity inside families and ages with family sizes."""
    return {
        "similarity": fam.family_similarity(hits, members),
        "ages": fam.age_summary(ages, members, taxonomy(members.sparkSession)),
    }
