"""Queries over alignment hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci.functions import compact_length
from loci.operators import families as fam
from loci.operators import hits as h
from loci.operators.intervals import lift_over

from . import views as v
from .registry import query


def norm(spark, sf):
    return h.normalize_hits(v.hits(spark, sf))


@query(
    "S3_normalize_hits",
    ["norm_hits"],
    "SELECT query, subject, identity, length, s_start, s_end, evalue, bits, strand, suppkey FROM norm_hits",
)
def _(spark, sf):
    return norm(spark, sf).select("query", "subject", "identity", "length", "s_start", "s_end", "evalue", "bits", "strand", "suppkey")


@query(
    "P13_normalize_ends",
    ["hits"],
    """SELECT query, subject, bits, least(s_start, s_end) AS "start", greatest(s_start, s_end) AS "end",
      CASE WHEN suppkey % 3 = 0 THEN '+' WHEN suppkey % 3 = 1 THEN '-' WHEN s_start > s_end THEN '-' ELSE '?' END AS strand FROM hits""",
)
def _(spark, sf):
    k = F.col("suppkey") % 3
    t = v.hits(spark, sf).select(
        "query",
        "subject",
        "bits",
        F.col("s_start").alias("start"),
        F.col("s_end").alias("end"),
        F.when(k == 0, "Forward").when(k == 1, "reverse").otherwise("?").alias("strand"),
    )
    return h.normalize_ends(t)


for _by in ("score", "position"):

    @query(f"{'S4' if _by == 'score' else 'T2'}_order_hits_by_{_by}", ["norm_hits"], "SELECT query, subject, s_start, s_end, bits FROM norm_hits")
    def _(spark, sf, by=_by):
        return h.order_hits(norm(spark, sf), by).select("query", "subject", "s_start", "s_end", "bits")


@query(
    "P3_filter_hits",
    ["norm_hits"],
    "SELECT query, subject, identity, length, bits FROM norm_hits WHERE identity >= 80 AND length >= 100",
)
def _(spark, sf):
    return h.filter_hits(norm(spark, sf), *h.FRAGMENTS).select("query", "subject", "identity", "length", "bits")


@query(
    "P4_shorter_side_coverage",
    ["norm_hits", "query_lengths", "subject_lengths"],
    """SELECT h.query, h.subject, h.length, h.bits, q.length AS q_len, s.length AS s_len FROM norm_hits h
    JOIN query_lengths q ON h.query = q.id JOIN subject_lengths s ON h.subject = s.id
    WHERE h.identity >= 80 AND h.length >= 80 AND h.length >= least(q.length, s.length) * 0.5""",
)
def _(spark, sf):
    kept = h.filter_hits_by_coverage(norm(spark, sf), v.query_lengths(spark, sf), v.subject_lengths(spark, sf))
    return kept.select("query", "subject", "length", "bits", "q_len", "s_len")


@query(
    "P5_query_coverage",
    ["norm_hits", "query_lengths"],
    """SELECT h.query, h.subject, h.length, h.bits, q.length AS q_len FROM norm_hits h JOIN query_lengths q ON h.query = q.id
    WHERE h.identity >= 80 AND h.length >= 80 AND h.length >= q.length * 0.5""",
)
def _(spark, sf):
    kept = h.filter_hits_by_coverage(norm(spark, sf), v.query_lengths(spark, sf), side="query")
    return kept.select("query", "subject", "length", "bits", "q_len")


def labelled(spark, sf):
    return (
        norm(spark, sf).join(v.query_superfamilies(spark, sf), "query").join(v.subject_superfamilies(spark, sf), "subject")
    )


COMPATIBLE_SQL = """query_superfamily = subject_superfamily OR
  (lower(query_superfamily) LIKE '%unknown%' AND lower(subject_superfamily) NOT LIKE '%unknown%')"""


@query(
    "P6_filter_compatible",
    ["norm_hits", "query_superfamilies", "subject_superfamilies"],
    f"""SELECT query, subject, bits, query_superfamily, subject_superfamily FROM norm_hits JOIN query_superfamilies USING (query)
    JOIN subject_superfamilies USING (subject) WHERE query <> subject AND ({COMPATIBLE_SQL})""",
)
def _(spark, sf):
    return h.filter_compatible(labelled(spark, sf)).select("query", "subject", "bits", "query_superfamily", "subject_superfamily")


BEST = "bits DESC, identity DESC, length DESC, subject, s_start, s_end, query, mismatches, suppkey"


@query(
    "W1_best_hit",
    ["norm_hits"],
    f"""SELECT query, subject, bits, identity, length FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {BEST}) AS rn
    FROM norm_hits WHERE identity >= 80 AND length >= 80) WHERE rn = 1""",
)
def _(spark, sf):
    kept = h.filter_hits(norm(spark, sf), *h.CLASSIFY)
    return h.best_hit(kept, ties=v.hit_key()).select("query", "subject", "bits", "identity", "length")


@query(
    "W9_best_vote",
    ["hits"],
    """, ranked AS (SELECT subject AS "key", query AS vote, bits AS evalue,
        row_number() OVER (PARTITION BY subject ORDER BY bits, query) AS rn,
        lead(bits) OVER (PARTITION BY subject ORDER BY bits, query) AS second FROM hits)
    SELECT "key", vote, evalue, evalue / coalesce(second, 1000.0::DOUBLE) AS margin FROM ranked WHERE rn = 1""",
)
def _(spark, sf):
    t = v.hits(spark, sf).select(F.col("subject").alias("key"), F.col("query").alias("vote"), F.col("bits").alias("evalue"))
    return h.best_vote(t)


@query(
    "W10_first_per",
    ["norm_hits"],
    """SELECT subject, query, s_start, s_end FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY s_start, s_end, query, bits) AS rn
    FROM norm_hits) WHERE rn = 1""",
)
def _(spark, sf):
    return h.first_per(norm(spark, sf), "subject", ["s_start", "s_end", "query", "bits"]).select("subject", "query", "s_start", "s_end")


def library_hits(spark, sf):
    """Hits named after a family on the query side and a library entry on the subject side."""
    n = F.regexp_replace("subject", "s", "").cast("bigint")
    entry = (
        F.when(n % 5 == 0, F.concat(F.lit("RLG_ji_AC2"), n))
        .when(n % 5 == 1, F.concat(F.lit("Copia-"), n % 40, F.lit("_LTR")))
        .when(n % 5 == 2, F.concat(F.lit("Gypsy"), n % 30, F.lit("-I")))
        .when(n % 5 == 3, F.concat(F.lit("DTC_ZM"), n % 20, F.lit("_consensus")))
        .otherwise(F.concat(F.lit("fam"), n % 10))
    )
    family = F.concat(F.lit("RLG_family"), F.col("suppkey"))
    return norm(spark, sf).select("query", family.alias("family"), entry.alias("subject"), "bits", "length", "identity")


LIBRARY_SQL = """, lib AS (SELECT query, 'RLG_family' || suppkey AS family, bits, length, identity,
      CASE n % 5 WHEN 0 THEN 'RLG_ji_AC2' || n WHEN 1 THEN 'Copia-' || (n % 40) || '_LTR' WHEN 2 THEN 'Gypsy' || (n % 30) || '-I'
        WHEN 3 THEN 'DTC_ZM' || (n % 20) || '_consensus' ELSE 'fam' || (n % 10) END AS subject
      FROM (SELECT *, CAST(replace(subject, 's', '') AS BIGINT) AS n FROM norm_hits)),
    cleaned AS (SELECT *, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(subject,
        'I$|_I$|LTR$|_LTR$', ''), '_AC.*', ''), '-', '_'), '[0-9]+$', ''), '([A-Za-z0-9_]{3}_[A-Za-z0-9_]+?)_.*', '\\1') AS hit_family FROM lib),
    votes AS (SELECT family, hit_family, count(*) AS hit_count,
        floor(sum(CAST(bits AS DECIMAL(18,2)))::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS score_sum FROM cleaned GROUP BY ALL)
"""


@query("A10_family_votes", ["norm_hits"], LIBRARY_SQL + "SELECT family, hit_family, hit_count, score_sum FROM votes")
def votes(spark, sf):
    return h.family_votes(library_hits(spark, sf))


@query(
    "W16_transfer_map",
    ["norm_hits"],
    LIBRARY_SQL
    + """SELECT family, hit_family, hit_count, score_sum FROM (SELECT *, row_number() OVER (PARTITION BY family
    ORDER BY hit_count DESC, score_sum DESC, hit_family) AS rn FROM votes) WHERE rn = 1""",
)
def _(spark, sf):
    return h.transfer_map(votes(spark, sf))


@query(
    "A14_transfer_rate",
    ["hits"],
    """SELECT count(*) AS total, sum(CASE WHEN length >= 100 THEN 1 ELSE 0 END)::BIGINT AS transferred,
    floor(100.0::DOUBLE * sum(CASE WHEN length >= 100 THEN 1 ELSE 0 END)::BIGINT / count(*) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS percent FROM hits""",
)
def _(spark, sf):
    return h.transfer_rate(v.hits(spark, sf).select((F.col("length") >= 100).alias("transferred")))


@query(
    "W15_exemplar",
    ["hits", "subject_superfamilies"],
    """, counted AS (SELECT brand AS family, subject AS element_id, count(*) AS hits FROM hits JOIN subject_superfamilies USING (subject) GROUP BY ALL)
    SELECT family, element_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY family
      ORDER BY hits DESC, CAST(substring(element_id, 2) AS BIGINT)) AS rn FROM counted) WHERE rn = 1""",
)
def _(spark, sf):
    brands = v.subject_superfamilies(spark, sf).select(F.col("subject").alias("element_id"), F.col("brand").alias("family"))
    return fam.exemplars_by_hits(v.hits(spark, sf).select(F.col("subject").alias("query")), brands)


@query(
    "G5_greedy_pairs",
    ["hits"],
    """, edges AS (SELECT query AS a, subject AS b, max(bits) AS score, md5(least(query, subject) || '|' || greatest(query, subject)) AS tie
        FROM hits WHERE identity >= 90 GROUP BY query, subject),
    rounds(a, b, score, tie, taken, k) AS (
      SELECT a, b, score, tie, false, 0 FROM edges
      UNION ALL
      SELECT a, b, score, tie, mutual, k + 1 FROM (
        SELECT *, max(CASE WHEN mutual THEN 1 ELSE 0 END) OVER (PARTITION BY a) AS ua,
          max(CASE WHEN mutual THEN 1 ELSE 0 END) OVER (PARTITION BY b) AS ub
        FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, tie) = 1
                AND row_number() OVER (PARTITION BY b ORDER BY score DESC, tie) = 1 AS mutual
              FROM rounds WHERE NOT taken))
      WHERE mutual OR (ua = 0 AND ub = 0))
    SELECT a AS query, b AS subject, score AS bits FROM rounds WHERE taken""",
    recursive=True,
)
def _(spark, sf):
    return h.greedy_pairs(v.hits(spark, sf).where(F.col("identity") >= 90).select("query", "subject", "bits"))


@query(
    "P12_lift_over",
    ["parts", "elements"],
    """SELECT part_id, e."start" + (p.off - 1) * 3 AS "start", e."start" + p.stop * 3 - 1 AS "end"
    FROM (SELECT x.part_id, x.element_id, x."start" - y."start" + 1 AS off, x."end" - y."start" + 1 AS stop
          FROM parts x JOIN elements y USING (element_id)) p JOIN elements e USING (element_id)""",
)
def _(spark, sf):
    e = v.elements(spark, sf).select("element_id", F.col("start").alias("e_start"))
    local = v.parts(spark, sf).join(e, "element_id").select(
        "part_id",
        "e_start",
        (F.col("start") - F.col("e_start") + 1).alias("start"),
        (F.col("end") - F.col("e_start") + 1).alias("end"),
    )
    return lift_over(local, scale=3).select("part_id", "start", "end")


@query(
    "F11_compact_length",
    ["hits"],
    "SELECT query, subject, bits, greatest(s_start, s_end) - least(s_start, s_end) + 1 AS length FROM hits",
)
def _(spark, sf):
    t = norm(spark, sf).withColumn("name", F.concat_ws("_", "subject", F.concat_ws("-", "s_start", "s_end")))
    return t.select("query", "subject", "bits", compact_length("name").alias("length"))
