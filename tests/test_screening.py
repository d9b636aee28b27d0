"""Texts that cannot have a similar one are left out before their k-mers are carried; no other text is."""

from __future__ import annotations

import random

import pytest

from loci.operators import screening, similarity

TEXT = "no long, residues string, part string"


def made(seed: int, letters: str = "ACGT") -> list[tuple]:
    """Texts of all lengths, near copies of some of them, and texts that share a half with another one."""
    r = random.Random(seed)
    new = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = [new(r.choice([3, 12, 40, 200, 900])) for _ in range(40)]
    for t in texts[:20]:
        at = r.randrange(len(t))
        texts.append(t[:at] + new(1) + t[at + 1 :])
    texts += [t[: len(t) // 2] + new(len(t) // 2) for t in texts[10:20]] + [t + new(len(t) // 2) for t in texts[:5]]
    return [(i, t, r.choice(["x", "x", None])) for i, t in enumerate(texts)]


def shares(rows: list[tuple], k: int) -> dict[tuple[int, int], float]:
    sets = {i: {t[j : j + k] for j in range(len(t) - k + 1)} for i, t, _ in rows}
    part = {i: p for i, _, p in rows}
    return {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and part[a] == part[b]}


@pytest.mark.parametrize("share", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("small", [False, True])
def test_no_text_with_a_partner_is_left_out(spark, monkeypatch, share, small):
    if small:  # many blocks and slices
        for name, value in (("BLOCK_LETTERS", 500), ("BLOCK_TEXTS", 3), ("SLICE", 300)):
            monkeypatch.setattr(screening, name, value)
    rows = made(7, "ACG😀é")
    t = spark.createDataFrame(rows, TEXT).repartition(3, "no")
    kept = {r["no"] for r in screening.can_match(t, 6, share, ["part"]).collect()}
    wanted = {i for pair, s in shares(rows, 6).items() if s >= share for i in pair}
    assert wanted <= kept
    alone = {i for i, t, _ in rows if len(t) >= 6} - {i for pair, s in shares(rows, 6).items() if s > 0 for i in pair}
    assert wanted and alone and not alone & kept


def test_kmers_of_texts_without_a_partner_are_not_carried(spark, monkeypatch):
    r = random.Random(1)
    new = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    twin = new(300)
    rows = [(f"lone{i}", new(300)) for i in range(50)] + [("a", twin), ("b", twin[:250]), ("copy", twin)]
    seen = []
    prefixes = similarity._prefixes
    monkeypatch.setattr(similarity, "_prefixes", lambda sets, share: (seen.append({x["id"] for x in sets.select("id").collect()}), prefixes(sets, share))[1])
    t = spark.createDataFrame(rows, "id string, residues string")
    assert [(p["a"], p["b"]) for p in similarity.similar_pairs(t, 16, 0.5).collect()] == [("a", "b")]
    groups = {x["id"]: x["cluster"] for x in similarity.cluster_sequences(t, 16, 0.5).collect()}
    assert {i for i, c in groups.items() if c == "a"} == {"a", "b", "copy"} and len(set(groups.values())) == 51
    assert seen == [{"a", "b"}, {"a", "b"}]


def test_no_texts(spark):
    assert screening.can_match(spark.createDataFrame([], TEXT), 6, 0.5).count() == 0
    assert screening.can_match(spark.createDataFrame([(1, "abc", "x"), (2, None, None)], TEXT), 6, 0.5).count() == 0


def test_lists_of_kmers_are_not_sent_to_the_pairs(spark):
    rows = made(3)
    t = spark.createDataFrame([(f"t{i}", x) for i, x, _ in rows], "id string, residues string")
    out = similarity.similar_pairs(t, 6, 0.3)
    assert "regexp_extract_all" not in out._jdf.queryExecution().executedPlan().toString()
    sets = {f"t{i}": {x[j : j + 6] for j in range(len(x) - 5)} for i, x, _ in rows}
    got = {(p["a"], p["b"]): (p["shared"], p["share"]) for p in out.collect()}
    first = {frozenset([x]): min(f"t{i}" for i, y, _ in rows if y == x) for _, x, _ in rows}
    ids = sorted(first.values())
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in ids for b in ids if a < b and sets[a] & sets[b]}
    assert got == {pair: s for pair, s in want.items() if s[1] >= 0.3}
