"""What grows with the input is neither broadcast nor written out where it can be made again."""

from __future__ import annotations

import random

import pytest

from loci.operators import paths, sequences, similarity
from loci.operators import intervals as iv

ELEMENTS = "element_id string, seq_id string, start long, end long"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def chunks(spark):
    t = spark.createDataFrame([("s1", "ACGTNNACGT" * 30), ("s2", "ACGT" * 10)], "seq_id string, residues string")
    return sequences.windows(t, 50, 5)


def test_pieces_of_many_chunks_are_not_broadcast(spark, chunks):
    e = spark.createDataFrame([("a", "s1", 3, 120), ("b", "s2", 5, 9)], ELEMENTS)
    for out in (sequences.slice_sequences(e, chunks, ["element_id"], 50), sequences.touched_chunks(e, chunks, 50), sequences.mask_intervals(chunks, e, 50)):
        assert "Broadcast" not in plan(out)


def test_an_interval_that_ends_before_it_starts_makes_no_rows(spark, chunks):
    e = spark.createDataFrame([("a", "s1", 3, 8), ("backwards", "s1", 5_000_000_000_000, 8)], ELEMENTS)
    got = sequences.slice_sequences(e, chunks, ["element_id"], 50).collect()
    assert [(r["element_id"], r["residues"]) for r in got] == [("a", "GTNNAC")]


def test_state_paths_and_tile_passes_are_not_broadcast(spark):
    path = spark.createDataFrame([("s", 1, 0), ("s", 5, 1), ("s", 8, 2), ("s", 9, 3)], "seq_id string, position long, state int")
    out = paths.segment_states(path)
    assert plan(out).count("BroadcastExchange") == 1  # the fixed table of clades
    assert [(r["start"], r["end"], r["kind"]) for r in out.collect()] == [(1, 9, "full")]
    spans = spark.createDataFrame([("s", 1, 4), ("s", 3, 9)], "seq_id string, start long, end long")
    assert "Broadcast" not in plan(iv.drop_overlapping_previous(spans, ["end"]))


def test_kmers_are_not_written(spark, monkeypatch):
    written = []
    keep = similarity.materialize

    def seen(df):
        written.append(dict(df.dtypes))
        return keep(df)

    monkeypatch.setattr(similarity, "materialize", seen)
    t = spark.createDataFrame([("a", "abcdefghij"), ("b", "abcdefghijk"), ("c", "zyxwvutsrq"), ("d", "ab"), ("e", None)], "id string, residues string")
    got = similarity.similar_pairs(t, 3, 0.8).collect()
    assert [(r["a"], r["b"], r["shared"]) for r in got] == [("a", "b", 8)]
    assert written and not any("array" in kind for columns in written for kind in columns.values())


@pytest.mark.parametrize("inverted", [False, True])
def test_kmers_of_short_and_long_sequences_give_the_same_repeats_without_being_shuffled(spark, monkeypatch, inverted):
    """Sequences of up to LONG letters meet as text; longer ones shuffle their k-mers."""
    r = random.Random(3)
    letters = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    twice = letters(30)
    other = twice[::-1].translate(str.maketrans("ACGT", "TGCA")) if inverted else twice
    rows = [("s1", letters(80) + twice + letters(90) + other + letters(40)), ("s2", letters(50)), ("s3", None)]
    cut = sequences.windows(spark.createDataFrame(rows, "seq_id string, residues string"), 64, 20)
    written = []
    keep = similarity.materialize

    def seen(df):
        out = keep(df)
        if "x" in df.columns:
            written.append((out.count(), plan(df)))
        return out

    monkeypatch.setattr(similarity, "materialize", seen)
    got = []
    for long in (similarity.LONG, 60):
        monkeypatch.setattr(similarity, "LONG", long)
        pairs = similarity.repeat_pairs(cut, k=12, min_dist=40, max_dist=400, inverted=inverted, min_length=20)
        got.append(sorted((p["seq_id"], p["left_start"], p["left_end"], p["right_start"], p["right_end"]) for p in pairs.collect()))
    assert got[0] == got[1] and any(s == "s1" and a <= 81 and b >= 110 and c <= 201 and d >= 230 for s, a, b, c, d in got[0])
    # of the k-mers that are found once, or on one strand only, nothing is written; one exchange, of chunks
    (n, near), _ = written
    assert n < 60, n
    assert near.count("Exchange hashpartitioning") == 1 and "REPARTITION" in near, near
