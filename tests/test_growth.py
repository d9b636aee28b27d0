"""What a step shuffles or reads again does not grow faster than its input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loci.functions.columns import natural_key
from loci.functions.names import parse_name
from loci.operators import hierarchy as hi
from loci.operators import intervals as iv
from loci.operators import sequences as sq
from loci.operators.ordering import top_per_key
from loci.plans import flow
from loci.sources import features as ft
from workload import q_flow, views

CALL = "seq_id string, start long, end long, id string, score long, similarity double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nobody_visits_a_grid_without_homes(spark):
    t = spark.range(100).select(F.lit("s").alias("seq_id"), (F.col("id") * 10 + 1).alias("start"), (F.col("id") * 10 + 5).alias("end"))
    placed = iv._placed(t, "start", "end", 4096, 4)
    homes = iv._homes(t, 4096, 4)
    assert iv._touched(placed, "start", "end", 4096, 4, homes, left=True).count() == 100
    assert iv._touched(placed, "start", "end", 4096, 4, homes, left=False).count() == 200


def test_overlaps_of_all_sizes(spark):
    r = random.Random(5)
    rows = [("s", a, a + r.choice([0, 3, 40, 700, 9000, 90000]), str(i)) for i, a in enumerate(r.choices(range(1, 30000), k=150))]
    rows += [("s", None, 5, "x"), ("s", 5, None, "y"), (None, 1, 9, "z")]
    t = spark.createDataFrame(rows, "seq_id string, start long, end long, id string")
    got = sorted((x["id"], x["b_id"]) for x in iv.overlap_join(t, t, bin=64).collect())
    whole = rows[:-3]
    assert got == sorted((a[3], b[3]) for a in whole for b in whole if a[1] <= b[2] and b[1] <= a[2])


def test_natural_keys_are_not_shuffled(spark):
    t = spark.createDataFrame([("s", 1, 9, f"e{i}", 5, 80.0) for i in (10, 9, 1)], CALL)
    out = hi.best_of_overlap(t, t)
    assert {x["id"] for x in out.collect()} == {"e1", "e9", "e10"}
    text = plan(out)
    below = text[text.index("Exchange"):]
    assert all("regexp_extract_all" not in line for line in below.splitlines() if "WindowGroupLimit" in line and "Partial" in line)
    tied = spark.createDataFrame([("k", 1, "e10"), ("k", 1, "e9"), ("k", 2, "e1"), (None, 3, "e2")], "key string, n long, id string")
    first = top_per_key(tied, "key", [F.col("n")], ties=[natural_key("id")])
    assert sorted((str(x["key"]), x["id"]) for x in first.collect()) == [("None", "e2"), ("k", "e9")]


def test_combined_sets_with_repeated_and_missing_ids(spark):
    strict = spark.createDataFrame([("s", 1, 9, "a", 1, 80.0), ("s", 50, 60, "b", 1, 80.0), ("s", 50, 60, "b", 1, 80.0), ("s", 90, 95, None, 1, 80.0)], CALL)
    relaxed = spark.createDataFrame([("s", 3, 9, "c", 2, 70.0), ("s", 4, 9, "d", 2, 70.0), ("s", 200, 210, "e", 1, 70.0)], CALL)
    got = sorted((x["origin"], str(x["id"])) for x in hi.combine_sets(strict, relaxed).collect())
    assert got == [("best", "c"), ("relaxed", "e"), ("strict", "None"), ("strict", "b"), ("strict", "b")]


@pytest.mark.parametrize(("text", "found"), [("cactgg", True), ("CACTAxx", True), ("xxcactg", True), ("xxCACT\n", True), ("xcacta\r\n", True), ("xcactgx", False), ("", False), (None, False)])
def test_only_the_ends_of_an_element_are_matched(spark, text, found):
    e = spark.createDataFrame([("e", 1, 9)], "element_id string, start long, end long")
    p = spark.createDataFrame([], "element_id string, type string, start long, end long")
    ta = spark.createDataFrame([], "element_id string, residues string")
    whole = spark.createDataFrame([("e", text)], "element_id string, residues string")
    out = hi.tir_evidence(e, p, ta, whole)
    assert [x["cact_ends"] for x in out.collect()] == [found]
    assert "right(" in plan(out) or "substring(residues" in plan(out)


def test_attributes_are_not_parsed_by_filters(spark):
    lines = ["s\t.\trepeat_region\t1\t90\t.\t+\t.\tID=r1", "s\t.\thelitron\t1\t90\t.\t+\t.\tID=e1;Parent=r1", "s\t.\tprotein_match\t5\t9\t.\t+\t.\tParent=e1;name=a%2Cb,c+d;name=e", "s\t.\tprotein_match\t5\t9\t.\t+\t.\t."]
    t = spark.createDataFrame([(x, "f", i) for i, x in enumerate(lines)], "line string, file string, line_no long")
    features = ft.parse_features(t)
    assert [x["attributes"] for x in features.orderBy("line_no").collect()][2:] == [{"Parent": ["e1"], "name": ["a,b", "c+d", "e"]}, {}]
    parts = ft.region_tree(features)[2]
    assert [(x["element_id"], x["region_id"], x["name"]) for x in parts.collect()] == [("e1", "r1", "a,b")]
    filters = [x for x in parts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("map_from_entries" in x for x in filters)


def test_gap_runs_look_at_the_letters_once(spark):
    t = spark.createDataFrame([("a", "--AC-G--"), ("b", "----"), ("c", "ACGT"), ("d", None), ("e", "A-")], "seq_id string, residues string")
    out = sq.gap_runs(t)
    got = sorted((x["seq_id"], x["start"], x["end"]) for x in out.collect())
    assert got == [("a", 1, 2), ("a", 5, 5), ("a", 7, 8), ("b", 1, 4), ("e", 2, 2)]
    assert "array_compact" in plan(out) or "isnotnull" in plan(out).lower()
    assert "sequence(1" not in plan(out)


def test_a_name_is_matched_once_whatever_filters_follow(spark):
    rows = [("RLG_family3_helitron7_chr2_11_20",), ("nonsense",), (None,)]
    out = parse_name(spark.createDataFrame(rows, "name string")).where("seq_id IS NOT NULL AND start <= end")
    assert [(x["code"], x["family_no"], x["seq_id"], x["start"], x["end"]) for x in out.collect()] == [("RLG", 3, "chr2", 11, 20)]
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("regexp_replace" in x for x in lines) == 1
    assert not any("regexp_replace" in x for x in lines if "Filter" in x)


def test_runs_with_the_same_parts_shuffle_them_once(spark):
    """Parts go to the elements of their run, those without an id too; ids are made for elements only."""
    e = "seq_id string, start long, end long, strand string, element_id string, similarity double"
    relaxed = spark.createDataFrame([("s1", 1, 90, "+", "a", 90.0), ("s1", 201, 290, "-", None, 90.0), ("s1", 401, 490, "?", "c", 90.0)], e)
    strict = relaxed.where("element_id = 'a'")
    p = "seq_id string, element_id string, region_id string, type string, name string, start long, end long, strand string"
    rows = [("s1", i, "r", "protein_match", n, 5, 9, "+") for i, n in (("a", "rve"), (None, "gag"), ("c", "rve"), ("lost", "rve"))]
    parts = spark.createDataFrame(rows, p)
    chunks = sq.windows(spark.createDataFrame([("s1", "ACGT" * 200)], "seq_id string, residues string"), 1000, 50)
    elements, moved, _ = flow.refined_tree((strict, parts), (relaxed, parts), chunks, "x", 0.3, 1000, 64)
    got = {x["element_id"]: (x["start"], x["strand"], x["old_id"]) for x in elements.collect()}
    assert got == {"x1": (1, "+", "a_relaxed"), "x2": (201, "-", "relaxed"), "x3": (401, "?", "c_relaxed")}
    assert sorted((x["element_id"], x["name"]) for x in moved.collect()) == [("x1", "rve"), ("x2", "gag"), ("x3", "rve")]
    assert "concat_ws" not in moved._jdf.queryExecution().optimizedPlan().toString()


def test_inputs_of_the_flow_are_made_once(spark):
    """Steps read tables; no step joins or cuts its input again."""
    given = q_flow.new_flow(spark, "/root/testdata/sf0.001")
    for t in (given.chunks, given.ltrs[0][1], given.ltrs[1][0], given.helitrons, given.tirs[0], given.solo_hits, given.library_hits):
        made = t._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in made and "Generate" not in made and "Aggregate" not in made


@pytest.mark.parametrize("made", [lambda t: iv.merge_intervals(t, gap=1), lambda t: iv.chain_signals(t, max_evalue=1.0), lambda t: sq.mask_intervals(sq.windows(t.select("seq_id", F.repeat(F.lit("ACGT"), 200).alias("residues")).distinct(), 100, 5), t, 100)])
def test_tiles_are_not_put_together_to_one_task_a_core(spark, made):
    """Tiles come over all shuffle partitions, however small adaptive execution finds them; the other exchanges are left to it."""
    r = random.Random(7)
    rows = [(f"s{r.randrange(40)}", a, a + r.randrange(9), 1, 0.5) for a in r.choices(range(1, 700), k=400)]
    t = spark.createDataFrame(rows, "seq_id string, start long, end long, score long, evalue double")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        out = made(t)
        out.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    lines = plan(out).split("== Initial Plan ==")[0].splitlines()
    at = [i for i, x in enumerate(lines) if "_tile" in x and "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" in x]
    assert at and all(", 23)" in lines[i] for i in at)
    # nothing but the stage lies between the exchange and the sort that reads it
    assert not any("AQEShuffleRead" in lines[i - 2] for i in at), "\n".join(lines)


def test_bases_of_tables_dealt_over_tiles(spark):
    r = random.Random(11)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(1, 300)]), r.choice([None, *range(1, 300)])) for _ in range(300)]
    rows = rows + rows[:50]
    t = spark.createDataFrame(rows, "seq_id string, start long, end long").where("end IS NULL OR start <= end")
    whole = {s: {p for x, a, b in rows if x == s and a is not None and b is not None and a <= b for p in range(a, b + 1)} for s in ("a", "b")}
    for tile in (16, 1 << 16):
        merged = iv.merge_intervals(t.where("end IS NOT NULL"), gap=1, tile=tile).collect()
        assert {s: sum(x["end"] - x["start"] + 1 for x in merged if x["seq_id"] == s) for s in ("a", "b")} == {s: len(p) for s, p in whole.items()}


def test_spans_on_documents_are_dealt_over_all_partitions(spark, tmp_path):
    """Rows of one document meet in one task, of which there are as many as shuffle partitions and not one a core."""
    spark.createDataFrame([(i, "abcdefghij" * (i + 1)) for i in range(3)] + [(3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(k, k % 5 if k else None, 7, 1, float(k % 9 + 1), 10.0, "1995-01-09") for k in range(60)]
    t = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, day string")
    t.select("*", F.col("day").cast("timestamp").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = views.document_spans(spark, str(tmp_path))
    got = sorted((x["seq_id"], x["start"], x["end"]) for x in out.collect())
    length = {0: 10, 1: 20, 2: 30, 3: 0}
    want = []
    for k, part, *_ in lines:
        if part is not None:
            size = k % 9 + 1
            start = 1 + (9 * 2689 + k * 40503) % max(length[part % 4] - size + 1, 1)
            want.append((f"doc{part % 4}", start, start + size - 1))
    assert got == sorted(want)
    assert "Exchange hashpartitioning(seq_id" in plan(out) and "REPARTITION_BY_NUM" in plan(out)
