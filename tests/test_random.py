"""Random tables, some with a hot key, against plain Python."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loci.operators import hits as h
from loci.operators import intervals as iv
from loci.operators import similarity as sim
from loci.operators.ordering import number_rows
from loci.operators.paths import segment_states

DDL = "seq_id string, start bigint, end bigint, id bigint"


def intervals(seed, n, span, longest, hot=0.0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        seq = "hot" if r.random() < hot else f"s{r.randrange(4)}"
        start = r.randrange(1, span)
        rows.append((seq, start, start + (r.randrange(longest) if r.random() < 0.95 else r.randrange(longest * 40)), i))
    return rows


CASES = [(1, 200, 2000, 30, 0.0), (2, 300, 400, 60, 0.4), (3, 250, 30, 10, 0.9)]


@pytest.mark.parametrize("case", CASES)
def test_joins(spark, case):
    rows = intervals(*case)
    t = spark.createDataFrame(rows, DDL)
    pairs = [(a, b) for a, b in itertools.product(rows, rows) if a[0] == b[0]]
    got = sorted((r["id"], r["b_id"]) for r in iv.overlap_join(t, t, bin=4).select("id", "b_id").collect())
    assert got == sorted((a[3], b[3]) for a, b in pairs if a[1] <= b[2] and b[1] <= a[2])
    got = sorted((r["id"], r["r_id"]) for r in iv.contain_join(t, t, bin=4, levels=3).select("id", "r_id").collect())
    assert got == sorted((a[3], b[3]) for a, b in pairs if a[1] >= b[1] and a[2] <= b[2])


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("tile,limit", [(64, 2), (1 << 16, 1 << 16)])
def test_disjoint(spark, case, tile, limit):
    rows = intervals(*case)
    want = set()
    for _, group in itertools.groupby(sorted(rows, key=lambda x: (x[0], x[1], x[3])), key=lambda x: x[0]):
        end = 0
        for x in group:
            if x[1] > end:
                want.add(x)
                end = x[2]
    t = spark.createDataFrame(rows, DDL)
    got = iv.select_disjoint(t, [F.col("id")], tile=tile, fold_limit=limit)
    assert {tuple(r) for r in got.select("seq_id", "start", "end", "id").collect()} == want


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("tile", [16, 1 << 16])
def test_merge_covers_the_same_bases(spark, case, tile):
    rows = intervals(*case)
    merged = iv.merge_intervals(spark.createDataFrame(rows, DDL), tile=tile).collect()
    want = {(s, p) for s, a, b, _ in rows for p in range(a, b + 1)}
    got = [(r["seq_id"], p) for r in merged for p in range(r["start"], r["end"] + 1)]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r["n"] for r in merged) == len(rows)


@pytest.mark.parametrize("tile", [16, 1 << 16])
def test_previous_row_rule(spark, tile):
    rows = intervals(5, 300, 500, 40, 0.4)
    want = set()
    thin = {}
    for x in sorted(rows, key=lambda x: x[3]):
        thin.setdefault((x[0], x[1]), x)
    for _, group in itertools.groupby(sorted(thin.values()), key=lambda x: x[0]):
        before = None
        for x in group:
            if before is None or x[1] > before:
                want.add(x)
            before = x[2]
    got = iv.drop_overlapping_previous(spark.createDataFrame(rows, DDL), [F.col("id")], tile=tile)
    assert {tuple(r) for r in got.select("seq_id", "start", "end", "id").collect()} == want


def test_numbers_are_consecutive_with_a_hot_group(spark):
    rows = intervals(7, 500, 100, 5, 0.7)
    t = spark.createDataFrame(rows, DDL)
    got = number_rows(t, ["start", "id"], "no", within=["seq_id"], partitions=6).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["seq_id"], []).append((r["start"], r["id"], r["no"]))
    for group in by_seq.values():
        assert [x[2] for x in sorted(group)] == list(range(1, len(group) + 1))


def test_greedy_pairs_with_ties_match_the_sequential_rule(spark):
    import hashlib

    r = random.Random(3)
    edges = {}
    for _ in range(300):
        a, b = sorted(r.sample(range(60), 2))
        edges[(f"n{a:02d}", f"n{b:02d}")] = float(r.randrange(4))
    # a hub that a third of the edges touch
    for i in range(150):
        edges[("hub", f"n{i % 60:02d}")] = float(r.randrange(4))
    order = sorted(edges, key=lambda e: (-edges[e], hashlib.md5(f"{e[0]}|{e[1]}".encode()).hexdigest()))
    used, want = set(), set()
    for a, b in order:
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    t = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "query string, subject string, bits double")
    assert {(x["query"], x["subject"]) for x in h.greedy_pairs(t).collect()} == want


def test_clusters_match_union_find(spark):
    r = random.Random(4)
    n = 200
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 1000 + i) for i in range(100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {x["id"]: x["cluster"] for x in sim.cluster(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_similar_pairs_are_exact_when_a_third_shares_text(spark):
    r = random.Random(9)
    common = "".join(r.choice("abcdefgh") for _ in range(40))
    rows = []
    for i in range(60):
        own = "".join(r.choice("abcdefgh") for _ in range(r.randrange(10, 80)))
        rows.append((i, common + own if i % 3 == 0 else own))
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    rows += [(200, rows[1][1] + "x"), (201, ""), (202, "ab")]
    k, share = 4, 0.4
    sets = {i: {t[j : j + k] for j in range(len(t) - k + 1)} for i, t in rows}
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    reps = sorted(first.values())
    want = {
        (a, b)
        for a, b in itertools.combinations(reps, 2)
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= share
    }
    t = spark.createDataFrame(rows, "id bigint, residues string")
    got = {(x["a"], x["b"]) for x in sim.similar_pairs(t, k, share).collect()}
    assert got == want
    assert want
    clusters = {x["id"]: x["cluster"] for x in sim.cluster_sequences(t, k, share).collect()}
    assert all(clusters[100 + i] == clusters[0] for i in range(20))


@pytest.mark.parametrize("tile", [8, 1 << 16])
def test_state_segments_match_the_reading_machine(spark, tile):
    r = random.Random(11)
    rows = [(s, p, r.choice([0, 0, 1, 2, 3, 5, 6, 7, 31, 32])) for s in ("a", "b", "hot") for p in sorted(r.sample(range(1, 900), 400 if s == "hot" else 60))]
    names = [("Jockey", 3), ("I", 6), ("CR1", 9), ("Rex", 12), ("R1", 15), ("Tad1", 18), ("RTE", 21), ("L1", 24), ("RandI", 27), ("L2", 30), ("CRE", 31), ("R2", 32)]
    want = set()
    for s in ("a", "b", "hot"):
        state, first, count = 0, None, 0
        for _, pos, value in sorted((x for x in rows if x[0] == s), reverse=True):
            if value == 0:
                if state and (count == 3 or (count == 1 and state > 30)):
                    kind = "full"
                elif state and count == 1:
                    kind = "fragment"
                else:
                    kind = None
                if kind:
                    want.add((s, pos, first, kind, next(n for n, top in names if state <= top)))
                state = 0
            elif state == 0:
                state, first, count = value, pos, 1
            elif value == state - 1:
                state, count = value, count + 1
    t = spark.createDataFrame(rows, "seq_id string, position bigint, state int")
    got = {(x["seq_id"], x["start"], x["end"], x["kind"], x["clade"]) for x in segment_states(t, tile).collect()}
    assert got == want


def test_top_per_key_keeps_ties_out(spark):
    rows = [(f"k{i % 3}" if i % 2 else "hot", float(i % 7), i) for i in range(200)]
    t = spark.createDataFrame(rows, "query string, bits double, id bigint")
    from loci.operators.ordering import top_per_key

    got = {(x["query"], x["id"]) for x in top_per_key(t, "query", [F.col("bits").desc(), F.col("id")]).collect()}
    want = {}
    for q, b, i in rows:
        if q not in want or (-b, i) < want[q]:
            want[q] = (-b, i)
    assert got == {(q, i) for q, (_, i) in want.items()}


@pytest.mark.parametrize("size", [16, 50])
def test_repeat_pairs_in_tandem_and_random_text(spark, size):
    from loci.operators.sequences import windows

    r = random.Random(21)
    unit = "ACGTTGCA"
    texts = {
        "tandem": "GG" + unit * 12 + "TTT" + unit * 3,
        "random": "".join(r.choice("AC") for _ in range(120)),
        "same": "A" * 40,
        "tiny": "ACG",
    }
    k, lo, hi, shortest = 5, 3, 60, 7
    want = set()
    for name, t in texts.items():
        for d in range(lo, hi + 1):
            x = 0
            while x + d < len(t):
                n = 0
                while x + d + n < len(t) and t[x + n] == t[x + d + n]:
                    n += 1
                if n >= max(k, shortest):
                    want.add((name, x + 1, x + n, x + d + 1, x + d + n, n))
                x += n + 1
    chunks = windows(spark.createDataFrame(list(texts.items()), "seq_id string, residues string"), size, 8)
    got = sim.repeat_pairs(chunks, k, lo, hi, min_length=shortest)
    cols = ["seq_id", "left_start", "left_end", "right_start", "right_end", "length"]
    assert {tuple(x) for x in got.select(*cols).collect()} == want


def test_near_copies_make_few_candidates(spark, monkeypatch):
    """Copies with a change each are all similar to one another; clusters need a number of comparisons in line with them."""
    r = random.Random(7)
    n, base = 400, "".join(r.choice("acgt") for _ in range(600))
    rows = [(f"c{i}", base[:i] + "x" + base[i + 1 :]) for i in range(n)]
    far = ["".join(r.choice("acgt") for _ in range(600)) for _ in range(3)]
    rows += [(f"d{i}", x) for i, x in enumerate(far)] + [("e", far[0][:590])]
    t = spark.createDataFrame(rows, "id string, residues string")
    counts = []
    verified = sim._verified

    def counted(candidates, sets, share):
        counts.append(candidates.count())
        return verified(candidates, sets, share)

    monkeypatch.setattr(sim, "_verified", counted)
    got = {x["id"]: x["cluster"] for x in sim.cluster_sequences(t, 12, 0.8).collect()}
    assert {got[f"c{i}"] for i in range(n)} == {"c0"} and got["e"] == got["d0"] and len({got[f"d{i}"] for i in range(3)}) == 3
    assert sum(counts) < 12 * n


@pytest.mark.parametrize("share", [0.3, 0.6, 0.8])
@pytest.mark.parametrize("seed", range(3))
def test_linking_pairs_link_what_all_similar_pairs_link(spark, seed, share):
    r = random.Random(seed)
    roots = ["".join(r.choice("ab") for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(60):
        x = list(r.choice(roots))
        for _ in range(r.randrange(7)):
            x[r.randrange(60)] = r.choice("abc")
        rows.append((f"t{i:02}", "".join(x)))
    t = spark.createDataFrame(rows, "id string, residues string")
    grams = {i: {x[j : j + 6] for j in range(55)} for i, x in rows}
    like = [(a, b) for a, b in itertools.combinations(sorted(grams), 2) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= share]
    texts = dict(rows)
    got = {(p["a"], p["b"]) for p in sim.similar_pairs(t, 6, share).collect()}
    first = {x: min(i for i in texts if texts[i] == x) for x in texts.values()}
    assert got == {(a, b) for a, b in like if first[texts[a]] == a and first[texts[b]] == b and texts[a] != texts[b]}
    of = {i: i for i in grams}
    for a, b in like * 60:
        of[a] = of[b] = min(of[a], of[b])
    assert {x["id"]: x["cluster"] for x in sim.cluster_sequences(t, 6, share).collect()} == of
