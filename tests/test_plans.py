"""Plans: equi-joins for ranges, no Python rows, pushed filters, limits before the shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loci.operators import hits as h
from loci.operators import intervals as iv
from workload import views as v

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_joins_have_equi_keys(spark):
    a = v.intervals(spark, SF).select("seq_id", "start", "end", "id")
    b = v.elements(spark, SF).select("seq_id", "start", "end", "element_id")
    for df in (iv.overlap_join(a, b), iv.contain_join(a, b)):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_best_hit_is_limited_before_the_shuffle(spark):
    text = plan(h.best_hit(h.normalize_hits(v.hits(spark, SF))))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_filters_and_columns_reach_the_scan(spark):
    t = v.table(spark, SF, "lineitem").select(F.col("l_extendedprice").alias("identity"), (F.col("l_orderkey")).alias("length"))
    text = plan(h.filter_hits(t, 100.0, 10))
    assert "GreaterThanOrEqual(l_extendedprice,100.0)" in text
    assert "l_comment" not in text and "l_shipdate" not in text


@pytest.mark.parametrize("made", [lambda t: iv.merge_intervals(t), lambda t: iv.chain_signals(t.withColumns({"evalue": F.col("tax"), "score": F.col("score")}))])
def test_tile_passes_shuffle_rows_twice(spark, made):
    """Rows go to their start and to their tile; behind that only summaries of tiles and folded islands move."""
    df = made(v.intervals(spark, SF).select("seq_id", "start", "end", "score", "tax"))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in final.splitlines() if " Exchange hashpartitioning(" in line]
    assert len(moved) <= 5 and final.count("FileScan") == 1
    assert sum("_tile" in line or "start" in line for line in moved) <= 3


def names():
    import __spark_entry__ as entry

    return sorted(set(entry.queries()) - set(entry.EXTRA))


@pytest.mark.parametrize("name", names())
def test_no_python_rows_and_no_cross_joins(spark, name):
    import __spark_entry__ as entry

    text = plan(entry.queries()[name](spark, SF))
    assert "Python" not in text and "Cartesian" not in text


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("S4", lambda r: (-r["bits"], r["query"], r["subject"], r["s_start"], r["s_end"])),
        ("T1", lambda r: (r["seq_id"], r["start"], -r["end"])),
        ("T2", lambda r: (r["subject"], r["s_start"], r["s_end"], -r["bits"], r["query"])),
    ],
)
def test_order_holds_across_written_files(spark, tmp_path, name, key):
    """Rows of the part files, one file after another, never fall back."""
    import glob

    import pyarrow.parquet as pq

    hits = h.normalize_hits(v.hits(spark, SF))
    spans = v.intervals(spark, SF).select("seq_id", "start", "end", "id")
    made = {"S4": lambda: h.order_hits(hits), "T1": lambda: iv.coordinate_sort(spans), "T2": lambda: h.order_hits(hits, "position")}[name]()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made.write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(glob.glob(f"{tmp_path}/out/part-*"))
    rows = [key(r) for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) > 1 and rows == sorted(rows)
