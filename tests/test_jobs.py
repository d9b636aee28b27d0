"""Whole jobs on inputs that the registered queries do not have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loci import plans
from loci.operators import hits as h
from workload import q_jobs as jobs
from workload import views as v

SF = "/root/testdata/sf0.001"


def renamed(run, *order):
    """A run whose elements are numbered from 1 in an order of its own."""
    elements, parts = run
    own = elements.select("element_id", F.concat(F.lit("e"), F.row_number().over(Window.orderBy(*order))).alias("_new"))
    swap = lambda t: t.join(own, "element_id").withColumn("element_id", F.col("_new")).drop("_new")
    return swap(elements), swap(parts)


def test_equal_ids_in_both_runs_are_different_elements(spark):
    strict, relaxed = jobs.runs(spark, SF)
    ltr = F.col("type") == "LTR_retrotransposon"
    strict = renamed((strict[0].where(ltr), strict[1]), "seq_id", "start", "element_id")
    relaxed = renamed((relaxed[0].where(ltr), relaxed[1]), F.col("end").desc(), "element_id")
    chunks = jobs.chunks(spark, SF)
    out = plans.GenomeFlow(chunks, (strict, relaxed), size=jobs.SIZE, bin=64, k=jobs.K, min_share=jobs.SHARE)
    refined, _ = plans.refine_predictions(strict, relaxed, chunks, size=jobs.SIZE, bin=64)
    place = lambda t: sorted((r["seq_id"], r["start"], r["end"]) for r in t.select("seq_id", "start", "end").collect())
    got = place(out["ltr_elements"])
    assert got and got == place(refined)


def test_flow_has_no_dangling_parents_and_asks_for_its_inputs(spark):
    """Every Parent names an ID of the same table (LARDs, MITEs and TRIMs included); IDs are unique."""
    import pytest

    from workload import q_flow

    flow = q_flow.whole_flow(spark, SF)
    one = lambda k: F.try_element_at(F.try_element_at("attributes", F.lit(k)), F.lit(1))
    rows = flow["features"].select("type", one("ID").alias("id"), one("Parent").alias("parent")).collect()
    ids = [r["id"] for r in rows if r["id"]]
    assert len(ids) == len(set(ids))
    assert {r["parent"] for r in rows if r["parent"]} <= set(ids)
    assert {"LARD", "MITE", "TRIM_retrotransposon", "helitron", "solo_LTR"} <= {r["type"] for r in rows}
    with pytest.raises(KeyError):
        flow["recombination"]
    assert set(flow) >= {"library", "masked", "ages"}


def test_flow_steps_read_the_newest_mask(spark):
    """What an earlier step found is gone for the later ones: no two kinds of complete elements share most of their letters."""
    from workload import q_flow

    flow = q_flow.whole_flow(spark, SF)
    place = lambda t: [(r["seq_id"], r["start"], r["end"]) for r in t.select("seq_id", "start", "end").collect()]
    before: dict[str, set[int]] = {}
    for name in ("ltr_elements", "trim_elements", "helitrons", "tir_elements"):
        rows = place(flow[name])
        assert rows
        for seq, a, b in rows:
            covered = before.get(seq, set())
            assert sum(x in covered for x in range(a, b + 1)) <= 0.3 * (b - a + 1)
        for seq, a, b in rows:
            before.setdefault(seq, set()).update(range(a, b + 1))


def test_relaxed_alone_goes_on_unrefined(spark):
    strict, relaxed = jobs.runs(spark, SF)
    out, ledger = plans.refine_predictions((strict[0].limit(0), strict[1]), relaxed, jobs.chunks(spark, SF), size=jobs.SIZE, bin=64, relaxed_alone=True)
    assert out.count() == relaxed[0].count() and {r["origin"] for r in out.collect()} == {"relaxed"}
    assert {r["measure"] for r in ledger.collect()} == {"found", "passed_genes"}


def test_fragment_files_hold_the_same_fragments(spark, tmp_path):
    from loci.operators.sequences import sequence_lengths
    from loci.sources import read_features, read_sequences

    chunks = jobs.chunks(spark, SF)
    found = plans.fragment_residues(plans.find_fragments(h.normalize_hits(v.doc_hits(spark, SF))), chunks, jobs.SIZE)
    plans.write_fragments(found, sequence_lengths(chunks), f"{tmp_path}/records", f"{tmp_path}/rows")
    records = {r["seq_id"]: len(r["residues"]) for r in read_sequences(spark, f"{tmp_path}/records").collect()}
    rows = {r["attributes"]["ID"][0]: r["end"] - r["start"] + 1 for r in read_features(spark, f"{tmp_path}/rows").collect()}
    assert records and set(records) == set(rows)
