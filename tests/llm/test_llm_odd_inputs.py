"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

from __future__ import annotations

import pytest
from helpers import SF, sha

import corpus_pipeline
from loci.llm import bpe, decontaminate, exact_dedup, langid, licenses, line_dedup, lm, pii, simhash, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, mark string, word string, words string, at string, id string, n long, `_row` string, _id string, shard string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 20_000
TEXTS = [
    (1, "one line of ten words stands here for all to\nsee it"),
    (1, "one line of ten words stands here for all to\nsee it"),
    (2, "one line of ten words stands here for all to\nsee it"),
    (3, None),
    (None, "a text without an id, mail me@example.com"),
    (None, None),
    (4, ""),
    (5, " \t\n "),
    (6, LONG),
    (7, "ÉCOLE İstanbul ß 😀\n\n\n123 456"),
    (8, "under the MIT License"),
]


def odd(spark, rows=TEXTS):
    extra = ("x", 1, 0.5, "k", "m", "w", "ws", "at", "i", 2, "r", "_i", "s")
    return spark.createDataFrame([(i, t, "en" if t else None, *extra) for i, t in rows], SCHEMA)


def items(spark, rows=((1, "one line of ten words stands here for all to see"), (2, None), (3, "mit license"), (4, "..."))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


CASES = {
    "line_dedup": lambda s, d: line_dedup.line_dedup(d),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d),
    "exact_decisions": lambda s, d: exact_dedup.decisions(d, 3),
    "near_dedup": lambda s, d: simhash.near_dedup(d),
    "pii": lambda s, d: pii.scan(d),
    "pii_mask": lambda s, d: pii.mask(d),
    "lm": lambda s, d: lm.score(d),
    "langid": lambda s, d: langid.identify(d),
    "licenses": lambda s, d: licenses.scan(d),
    "urls": lambda s, d: urls.filter_urls(d, url_col="text"),
    "bpe": lambda s, d: bpe.encode(d),
    "bpe_digests": lambda s, d: bpe.digests(d),
    "contamination": lambda s, d: decontaminate.contamination(d, items(s)),
}


@pytest.mark.parametrize("name", CASES)
def test_one_row_per_document(spark, name):
    docs = odd(spark)
    out = CASES[name](spark, docs)
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    key = lambda i: (i is None, i or 0)
    if "doc_id" in out.columns:
        assert sorted((r.doc_id for r in rows), key=key) == sorted((i for i, _ in TEXTS), key=key)
    if "source" in out.columns:
        assert {r["source"] for r in rows} == {"x"}


@pytest.mark.parametrize("name", CASES)
def test_empty_table(spark, name):
    assert CASES[name](spark, odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_tables(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = odd(spark)
    out = run(spark, docs, SF)
    assert out.count() <= len(TEXTS)
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert run(spark, docs.limit(0), SF).count() == 0


def test_exact_groups(spark):
    got = exact_dedup.exact_dedup(odd(spark)).collect()
    one = [r for r in got if r.group_size == 3 and r.keep_id == 1]
    assert len(one) == 3 and sum(r.kept for r in one) == 1  # repeated rows: one of them
    empty = [r for r in got if r.text_sha256 == sha("")]
    assert len(empty) == 3 and {r.keep_id for r in empty} == {3} and sum(r.kept for r in empty) == 1
    assert [r.kept for r in got if r.text_sha256 == sha(" ")] == [True]


def test_near_groups(spark):
    got = simhash.near_dedup(odd(spark)).collect()
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {3}
    assert simhash.keep_one(odd(spark)).where("doc_id = 1").count() == 1


def test_near_groups_of_rows_that_share_an_id(spark):
    """Null and repeated ids do not tell rows apart: each text that is no near copy stays, once."""
    other = lambda n: " ".join(sha(f"{n} {i}")[:8] for i in range(40))
    unlike = [(None, other(0)), (None, other(1)), (None, other(2)), (5, other(3)), (5, other(4)), (5, other(5))]
    copies = [(None, other(3)), (7, other(4)), (None, other(6)), (2, other(6)), (None, other(0)), (5, other(5))]
    got = simhash.keep_one(odd(spark, [*unlike, *copies])).collect()
    want = [*unlike, (2, other(6))]
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t) for i, t in want)
    assert all(r.component_id == r.doc_id for r in got)
    assert len(corpus_pipeline.drop_near_copies(spark, odd(spark, unlike), SF).collect()) == len(unlike)


def test_line_copies_in_repeated_rows(spark):
    got = line_dedup.line_dedup(odd(spark)).where("doc_id <= 3").orderBy("doc_id", "n_removed").collect()
    assert [(r.doc_id, r.n_removed) for r in got] == [(1, 0), (1, 2), (2, 2), (3, 0)]
    assert [r.text for r in got][1:] == ["", "", None]


def test_line_copies_in_very_many_empty_lines(spark):
    """Windows of empty lines share their ends; what they cover is written out once."""
    n = 200_000
    blank, line = "\n" * n, "one line of ten words stands here for all to see"
    got = line_dedup.line_dedup(odd(spark, [(1, blank + line), (2, blank + line), (3, "\n" * 50_000 + line), (4, line + blank)])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_lines, r.n_removed, r.n_runs) for r in got] == [(1, n + 1, 0, 0), (2, n + 1, n + 1, 1), (3, 50_001, 50_001, 1), (4, n + 1, 1, 1)]
    assert [len(r.text) for r in got] == [n + len(line), 0, 0, n - 1]


def test_contaminated_words(spark):
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(odd(spark), items(spark)).collect()}
    assert (got[2, 12].n_hit, got[2, 12].n_items) == (11, 1) and got[8, 4].n_hit == 2
    assert (got[3, 0].n_hit, got[3, 0].contaminated) == (0, False)
    assert got[8, 4].items_sha256 == sha("3")
    none = decontaminate.contamination(odd(spark), items(spark, ((1, None), (2, "")))).collect()
    assert len(none) == len(TEXTS) and not any(r.contaminated for r in none)


@pytest.mark.parametrize("few_lengths", [True, False])
def test_shuffled_windows_give_the_same_and_carry_no_texts(spark, monkeypatch, few_lengths):
    bench = items(spark, ((1, "one line of ten words stands here for all to see"),)) if few_lengths else items(spark)
    as_rows = lambda df: sorted(map(str, df.collect()))
    run = lambda: (as_rows(decontaminate.contamination(odd(spark), bench)), as_rows(decontaminate.decontaminate(odd(spark), bench, "spans")))
    want = run()
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert run() == want
        node = decontaminate.hits(odd(spark), bench)._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "Join":
            node = node.children().apply(0)
        left = node.children().apply(0)
        while left.nodeName() != "Project":
            left = left.children().apply(0)
        assert "slice(" in left.simpleString(1000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spans_are_cut_out(spark):
    got = decontaminate.decontaminate(odd(spark), items(spark), remove="spans")
    assert {r.text for r in got.where("doc_id = 8").collect()} == {"under the "}
    assert got.count() == len(TEXTS)
    assert decontaminate.decontaminate(odd(spark), items(spark)).where("doc_id IN (1, 2, 8)").count() == 0


def test_languages(spark):
    got = langid.identify(odd(spark)).collect()
    assert all(r.rejected and r.lang_pred == "und" and r.score == 0 for r in got if not (r.text or "").strip())
    nothing_learned = langid.predict(odd(spark), {}).collect()
    assert {r.lang_pred for r in nothing_learned} == {"und"}


def test_lm_without_training_rows(spark):
    only_held = odd(spark).where("doc_id IS NULL")
    got = lm.score(only_held).collect()
    assert len(got) == 2 and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in got)


def test_urls_without_labels(spark):
    got = urls.filter_urls(odd(spark), rules=[], url_col="text").collect()
    assert {(r.rule, r.verdict) for r in got} == {(None, "allow")}


def test_round_trip(spark):
    got = bpe.decode(bpe.encode(odd(spark)).drop("decoded")).collect()
    assert all(r.decoded == (r.text or "") for r in got)
