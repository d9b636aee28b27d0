"""One query per operator over the whole of its table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, langid, licenses, line_dedup, lm, packing, periodic, pii, simhash, urls, whitening
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(documents(spark, sf_dir))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf_dir), items)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.by_component(whitening.whiten(vectors))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"), with_ids=False)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    looped = periodic.with_loops(documents(spark, sf_dir).select("doc_id", "text"))
    return periodic.digests(periodic.periodic_runs(looped))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_line_dedup,
        op2_exact_dedup,
        op3_simhash_dedup,
        op4_pii,
        op5_lm_scoring,
        op6_language_id,
        op7_licenses,
        op8_url_filter,
        op9_bpe,
        op10_decontaminate,
        op11_whitening,
        op12_packing,
        op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, l, list_transform(l, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS n FROM d WHERE text IS NOT NULL
), starts AS (
  SELECT doc_id, l, n, unnest(range(1, len(l) + 1)) AS i FROM w
), runs AS (
  SELECT doc_id, l, n, i, unnest(range(i, len(l) + 1)) AS j FROM starts
), named AS (
  SELECT doc_id, i, j, md5(array_to_string(l[i:j], chr(10))) AS name FROM runs WHERE list_sum(n[i:j]) >= 10
), firsts AS (
  SELECT name, min(struct_pack(d := doc_id, i := i)) AS f FROM named GROUP BY name HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS p FROM named JOIN firsts USING (name) WHERE struct_pack(d := doc_id, i := i) > f
), lists AS (
  SELECT doc_id, list(p ORDER BY p) AS p FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, i, l[i] AS line FROM starts ANTI JOIN gone ON starts.doc_id = gone.doc_id AND starts.i = gone.p) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(len(p), 0)::BIGINT AS n_removed,
       coalesce(len(list_filter(p, lambda x: NOT list_contains(p, x - 1))), 0)::BIGINT AS n_runs,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op2_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
""",
    "op10_decontaminate": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), place AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))
), hit AS (
  SELECT r, item_id, i, n FROM place JOIN win USING (n, t)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM hit GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""",
}
