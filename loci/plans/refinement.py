"""From raw predictions to one clean set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import natural_key
from ..operators import hierarchy as hi
from ..operators.intervals import renumber
from ..operators.sequences import CHUNK_SIZE, filter_ambiguous
from ..session import materialize


def refine_predictions(
    strict: tuple[DataFrame, DataFrame],
    relaxed: tuple[DataFrame, DataFrame],
    chunks: DataFrame,
    genes: tuple[DataFrame, DataFrame] | None = None,
    max_ambiguous: float = 0.30,
    prefix: str = "LTR_retrotransposon",
    size: int = CHUNK_SIZE,
    bin: int = 4096,
    relaxed_alone: bool = False,
    **rules,
) -> tuple[DataFrame, DataFrame]:
    """Combine a strict and a relaxed run into one numbered set and its ledger.

    Each run is a pair (elements, parts); elements have ``similarity``. With
    ``genes`` = (flanks, hits) elements covered by genes on both flanks go
    first. With ``relaxed_alone`` the relaxed run goes on unrefined, which is
    what a user wants whose strict run found nothing; ids carry their run's name
    (``_strict``, ``_relaxed``) either way.
    """
    runs = {"strict": strict, "relaxed": relaxed}
    found = {}
    for kind, (elements, _) in runs.items():
        kept = elements if genes is None else hi.filter_gene_like(elements, *genes)
        found[kind] = kept
    totals = hi.gene_filter_totals(
        strict[0].select("element_id").unionByName(relaxed[0].select("element_id")),
        found["strict"].select("element_id").unionByName(found["relaxed"].select("element_id")),
    )
    if relaxed_alone:
        named = F.concat_ws("_", "element_id", F.lit("relaxed")).alias("id")
        out = found["relaxed"].select("seq_id", "start", "end", named, F.lit("relaxed").alias("origin"))
        numbered = renumber(out, prefix, ties=[natural_key("id"), "id"])
        return numbered, totals.select(F.explode(F.array(
            F.struct(F.lit("found").alias("measure"), F.col("total").alias("n")),
            F.struct(F.lit("passed_genes").alias("measure"), F.col("filtered").alias("n")),
        )).alias("r")).select("r.*")

    stats, scored = [], {}
    for kind, (_, parts) in runs.items():
        stats.append(hi.refine_stats(found[kind], parts, **rules))
        passed = hi.refine(found[kind], parts, **rules)
        score = hi.score_elements(parts).select("element_id", "score")
        rows = passed.join(score, "element_id", "left").select(
            "seq_id",
            "start",
            "end",
            F.concat_ws("_", "element_id", F.lit(kind)).alias("id"),
            F.coalesce("score", F.lit(0)).cast("bigint").alias("score"),
            "similarity",
        )
        # the combination reads both sets several times: their parts are gathered once
        scored[kind] = materialize(rows)
    combined = materialize(hi.combine_sets(scored["strict"], scored["relaxed"], bin))
    kept = filter_ambiguous(combined, chunks, ["id"], max_ambiguous, size)
    numbered = renumber(kept, prefix, ties=[natural_key("id"), "id"])
    report = hi.refine_report(totals, found["strict"], found["relaxed"], combined, kept, stats)
    return numbered, report


def filter_tir_predictions(
    elements: DataFrame, parts: DataFrame, genes: tuple[DataFrame, DataFrame] | None = None, coverage: float = 0.5
) -> DataFrame:
    """Inverted-repeat elements that are no gene copies, carry no retro domain and are not degenerate (C4)."""
    kept = elements if genes is None else hi.filter_gene_like(elements, *genes, coverage)
    kept = hi.exclude_by_child(kept, parts)
    return hi.drop_degenerate(kept, parts)
