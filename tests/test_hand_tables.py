"""Small tables worked out by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loci.functions import format_name, natural_key, parse_name, reverse_complement
from loci.operators import families as fam
from loci.operators import hierarchy as hi
from loci.operators import hits as h
from loci.operators import intervals as iv
from loci.operators import sequences as sq

FIVE = [("s", 1, 5), ("s", 2, 3), ("s", 4, 9), ("s", 6, 8), ("s", 20, 22)]


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def spans(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def five(spark):
    return table(spark, FIVE, "seq_id string, start bigint, end bigint")


def test_select_disjoint(spark):
    assert spans(iv.select_disjoint(five(spark), [F.col("end")])) == [(1, 5), (6, 8), (20, 22)]


def test_merge(spark):
    merged = iv.merge_intervals(five(spark))
    assert spans(merged) == [(1, 9), (20, 22)]
    assert sum(r["end"] - r["start"] + 1 for r in merged.collect()) == 12


def test_drop_overlapping_previous(spark):
    assert spans(iv.drop_overlapping_previous(five(spark), [F.col("end")])) == [(1, 5), (4, 9), (20, 22)]


def test_chain_signals_keeps_equal_starts_and_multiplies(spark):
    rows = [("s", 1, 10, 1e-3, 5.0), ("s", 1, 20, 1e-3, 7.0), ("s", 300, 310, 1e-1, 9.0), ("s", 900, 950, 1e-2, 1.0)]
    t = table(spark, rows, "seq_id string, start bigint, end bigint, evalue double, score double")
    got = iv.chain_signals(t, 300, 1e-5).collect()
    assert [(r["start"], r["end"], r["score"], r["n"]) for r in got] == [(1, 310, 9.0, 3)]
    assert math.isclose(got[0]["evalue"], 1e-7, rel_tol=1e-9)


def test_windows_and_stitch(spark):
    text = "ABCDEFGHIJKLMNOPQRSTUVWXY"
    chunks = sq.windows(table(spark, [("s", text)], "seq_id string, residues string"), 10, 2)
    got = sorted((r["core_start"] - r["left_pad"], r["core_end"] + r["right_pad"], r["residues"]) for r in chunks.collect())
    assert got == [(1, 12, text[:12]), (9, 22, text[8:22]), (19, 25, text[18:])]
    assert sq.stitch(chunks).first()["residues"] == text


def test_distance(spark):
    left = "A" * 100
    right = "G" * 10 + "C" * 5 + "A" * 85
    r = sq.substitution_distance(table(spark, [(left, right)], "left string, right string")).first()
    assert math.isclose(r["divergence"], -0.5 * math.log(0.75 * math.sqrt(0.9)), rel_tol=1e-12)
    assert round(r["age"]) == 8509058
    assert r["ts_tv"] == 2.0
    same = sq.substitution_distance(table(spark, [("ACGT", "ACGT")], "left string, right string")).first()
    assert (same["divergence"], same["age"], same["ts_tv"]) == (0.0, 0.0, 0.0)
    saturated = sq.substitution_distance(table(spark, [("AAAA", "CCCC")], "left string, right string")).first()
    assert saturated["divergence"] is None


def test_greedy_pairs(spark):
    rows = [("a", "b", 9.0), ("b", "c", 8.0), ("c", "d", 7.0), ("a", "d", 6.0), ("a", "a", 99.0)]
    got = h.greedy_pairs(table(spark, rows, "query string, subject string, bits double")).collect()
    assert sorted((r["query"], r["subject"]) for r in got) == [("a", "b"), ("c", "d")]


def test_signature_families(spark):
    rows = [("x", 1, "e1"), ("y", 2, "e1"), ("x", 1, "e2"), ("y", 2, "e2"), ("x", 1, "e3"), ("z", 4, "e3"), ("z", 9, "e3")]
    t = table(spark, rows, "part string, cluster_id bigint, element_id string")
    got = {r["element_id"]: (r["signature"], r["is_singleton"]) for r in fam.signature_families(t, ["x", "y", "z"]).collect()}
    assert got == {"e1": ("1|2|N", False), "e2": ("1|2|N", False), "e3": ("1|N|4", True)}


def test_gene_filter(spark):
    elements = table(spark, [("s", "kept"), ("s", "gone")], "seq_id string, element_id string")
    flanks = table(
        spark,
        [("kept", "k1", 100), ("kept", "k2", 100), ("gone", "g1", 100), ("gone", "g2", 100)],
        "element_id string, flank_id string, length bigint",
    )
    hits = table(
        spark, [("k1", 60, 90.0), ("k2", 20, 90.0), ("g1", 60, 90.0), ("g2", 50, 90.0)], "query string, length bigint, identity double"
    )
    kept = hi.filter_gene_like(elements, flanks, hits)
    assert [r["element_id"] for r in kept.collect()] == ["kept"]
    totals = hi.gene_filter_totals(elements, kept).first()
    assert (totals["total"], totals["removed"], totals["filtered"]) == (2, 1, 1)


def test_names_round_trip(spark):
    names = [
        "5prime_RLG_family0_LTR_retrotransposon12_Ha1_100_250",
        "RLC_singleton_family7_LARD_retrotransposon3_Contig57_HLAC-254L24_106214_107555",
        "DHH_family2_helitron1_chr1_5_9",
    ]
    t = table(spark, [(n,) for n in names], "name string")
    parsed = parse_name(t)
    again = format_name(parsed, "again").collect()
    assert all(r["name"] == r["again"] for r in again)
    row = [r for r in again if r["code"] == "RLC"][0]
    assert (row["is_singleton"], row["family_no"], row["seq_id"], row["start"]) == (True, 7, "Contig57_HLAC-254L24", 106214)
    assert parse_name(table(spark, [("nonsense",)], "name string")).first()["code"] is None


def test_natural_order(spark):
    t = table(spark, [("c10",), ("c9",), ("c1",), ("b2",)], "id string")
    assert [r["id"] for r in t.orderBy(natural_key("id")).collect()] == ["b2", "c1", "c9", "c10"]


def test_reverse_complement_twice(spark):
    t = table(spark, [("ACGTnacgt",)], "r string").select(reverse_complement(reverse_complement("r")).alias("x"))
    assert t.first()["x"] == "ACGTnacgt"


def test_label_ends_needs_two(spark):
    kind = "long_terminal_repeat"
    rows = [("s", "a", kind, 1, 5, "-"), ("s", "a", kind, 90, 95, "-"), ("s", "b", kind, 1, 5, "+"), ("s", "c", kind, 1, 2, None), ("s", "c", kind, 8, 9, None)]
    t = table(spark, rows, "seq_id string, element_id string, type string, start bigint, end bigint, strand string")
    got = sorted((r["element_id"], r["side"], r["start"]) for r in hi.label_ends(t).collect())
    assert got == [("a", "3prime", 1), ("a", "5prime", 90), ("c", "unk-prime-f", 1), ("c", "unk-prime-r", 8)]


def test_duplications_must_both_exist(spark):
    rows = [("a", "target_site_duplication", None, 1, 5), ("b", "target_site_duplication", None, 1, 5), ("b", "target_site_duplication", None, 20, 24)]
    t = table(spark, rows, "element_id string, type string, name string, start bigint, end bigint")
    assert {r["element_id"]: r["score"] for r in hi.score_elements(t).collect()} == {"a": 0, "b": 1}


def test_translation(spark):
    t = table(spark, [("s", "atgTTTnaaTAG")], "seq_id string, residues string")
    got = {r["frame"]: r["peptide"] for r in sq.translate_frames(t, (1, 2, -1)).collect()}
    # reverse strand: CTAttnAAAcat
    assert got == {1: "MFX*", 2: "CXN", -1: "LXKH"}
    short = sq.translate_frames(table(spark, [("s", "AC")], "seq_id string, residues string"), (1, -3)).collect()
    assert [r["peptide"] for r in short] == ["", ""]


def test_trim_terminal_gaps(spark):
    body = "ACGT" * 100
    rows = [("a", "NNNN" + "ACG" + "NN" + body + "NNN", 101), ("b", "N" + body, 1), ("c", "NN" + "ACGT" * 10, 1)]
    t = table(spark, rows, "id string, residues string, start bigint").withColumn("end", F.col("start") + F.length("residues") - 1)
    got = {r["id"]: (r["residues"], r["start"], r["end"]) for r in sq.trim_terminal_gaps(t).collect()}
    # the inner run goes up to the first letter that closes it
    assert got["a"] == (body, 101 + 4, 101 + 4 + len(body) - 1) or got["a"][0].endswith(body)
    assert got["b"] == ("N" + body, 1, 401)
    assert "c" not in got


def test_flank_repeat(spark):
    up, down = "T" * 14 + "ACCGTA", "ACCGTA" + "G" * 14
    t = table(spark, [("s", up + "-" * 12 + down), ("t", up + "-" * 9 + down)], "seq_id string, residues string")
    got = sq.flank_repeats(t).collect()
    assert [(r["seq_id"], r["repeat"], r["before_gap"], r["after_gap"], r["start"], r["end"]) for r in got] == [("s", "ACCGTA", 0, 1, 21, 32)]


def test_natural_key_holds_runs_of_any_length(spark):
    ids = ["c2", "c10", "c1" + "0" * 20, "c2" + "0" * 20, "c9" + "0" * 30, "c007", "c7x", "c"]
    rows = table(spark, [(i,) for i in ids], "id string").orderBy(natural_key("id"), "id").collect()
    assert [r["id"] for r in rows] == ["c", "c2", "c007", "c7x", "c10", ids[2], ids[3], ids[4]]


def test_recombination_keeps_large_families(spark):
    from loci import plans

    t = table(spark, [(f"s{i}", "f", "AC--GT") for i in range(101)], "seq_id string, family string, residues string")
    out = plans.recombination(t)
    assert out["per_family"].collect()[0]["members"] == 101
    assert plans.recombination(t, max_members=100)["per_family"].count() == 0


def test_repeat_pairs_refuse_short_pads(spark):
    import pytest

    from loci.operators.similarity import repeat_pairs

    t = table(spark, [("s", "ACGTTGCA" * 20)], "seq_id string, residues string")
    with pytest.raises(ValueError, match="pads"):
        repeat_pairs(sq.windows(t, 50, 10), k=20)
    assert repeat_pairs(sq.windows(t, 50, 20), k=20, min_dist=8, max_dist=8, min_length=20).count() == 1


def test_greedy_pairs_on_a_long_chain(spark, monkeypatch):
    """Ten thousand falling scores: every second edge, in few rounds."""
    written = []
    keep = h.materialize
    monkeypatch.setattr(h, "materialize", lambda t: written.append(1) or keep(t))
    n = 10_000
    chain = spark.range(n).selectExpr("format_string('n%06d', id) AS query", "format_string('n%06d', id + 1) AS subject", f"double({n} - id) AS bits")
    got = {(r["query"], r["subject"]) for r in h.greedy_pairs(chain).collect()}
    assert got == {(f"n{i:06d}", f"n{i + 1:06d}") for i in range(0, n, 2)}
    assert len(written) <= 20


def test_masking_with_very_many_spans(spark):
    text = "ACGT" * 500
    spans = [("s", i, i) for i in range(3, 2000, 3)]
    chunks = sq.windows(table(spark, [("s", text)], "seq_id string, residues string"), 300, 20)
    got = sq.mask_intervals(chunks, table(spark, spans, "seq_id string, start bigint, end bigint"), 300)
    want = "".join("N" if (i + 1) % 3 == 0 and i + 1 < 2000 else c for i, c in enumerate(text))
    for r in got.collect():
        assert r["residues"] == want[r["core_start"] - r["left_pad"] - 1 : r["core_end"] + r["right_pad"]]
