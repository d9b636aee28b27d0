"""Interval queries: coordinates, range joins, merging, selecting, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci.functions import format_name, natural_key, parse_name, with_code
from loci.operators import intervals as iv
from loci.operators.hierarchy import length_stats
from loci.operators.ordering import natural_order
from loci.operators.summary import code_of, coverage_summary, with_taxonomy
from loci.schema import TAXONOMY, fixed_rows

from . import views as v
from .registry import query


def named_intervals(spark, sf):
    t = v.intervals(spark, sf)
    return t.select(
        F.when(F.col("linenumber") == 1, "5prime").when(F.col("linenumber") == 2, "3prime").alias("side"),
        "code",
        (F.col("linenumber") == 7).alias("is_singleton"),
        F.col("suppkey").alias("family_no"),
        F.lit("LTR_retrotransposon").alias("element_type"),
        F.col("orderkey").alias("element_no"),
        "seq_id",
        "start",
        "end",
        "id",
    )


NAME_SQL = """
  CASE WHEN linenumber=1 THEN '5prime_' WHEN linenumber=2 THEN '3prime_' ELSE '' END || code || '_' ||
  CASE WHEN linenumber=7 THEN 'singleton_' ELSE '' END || 'family' || suppkey || '_LTR_retrotransposon' || orderkey
  || '_' || seq_id || '_' || "start" || '_' || "end"
"""


@query("P2_format_name", ["intervals"], f"SELECT id, {NAME_SQL} AS name FROM intervals")
def _(spark, sf):
    return format_name(named_intervals(spark, sf)).select("id", "name")


@query(
    "P1_parse_name",
    ["intervals"],
    """SELECT id, CASE WHEN linenumber=1 THEN '5prime' WHEN linenumber=2 THEN '3prime' END AS side, code,
      linenumber=7 AS is_singleton, suppkey AS family_no, 'LTR_retrotransposon' AS element_type, orderkey AS element_no,
      seq_id, "start", "end" FROM intervals""",
)
def _(spark, sf):
    names = format_name(named_intervals(spark, sf)).select("id", "name")
    return parse_name(names).drop("name")


@query(
    "P10_flip_strand",
    ["intervals", "sequence_spans"],
    """SELECT id, seq_id, length - "end" AS "start", length - "start" AS "end" FROM intervals JOIN sequence_spans USING (seq_id)""",
)
def _(spark, sf):
    return iv.flip_strand(v.intervals(spark, sf), v.sequence_spans(spark, sf)).select("id", "seq_id", "start", "end")


@query(
    "P11_slop",
    ["intervals", "sequence_spans"],
    """SELECT id, seq_id, greatest("start" - 500, 1) AS "start", least("end" + 500, length) AS "end"
    FROM intervals JOIN sequence_spans USING (seq_id)""",
)
def _(spark, sf):
    return iv.slop(v.intervals(spark, sf), v.sequence_spans(spark, sf), 500).select("id", "seq_id", "start", "end")


@query(
    "P17_natural_key",
    ["intervals"],
    """, ids AS (SELECT DISTINCT seq_id FROM intervals)
    SELECT seq_id, row_number() OVER (ORDER BY CAST(substring(seq_id, 4) AS BIGINT)) AS place FROM ids""",
)
def _(spark, sf):
    from loci.operators.ordering import number_rows

    ids = v.intervals(spark, sf).select("seq_id").distinct()
    return number_rows(ids, [natural_key("seq_id")], "place")


@query("T4_natural_order", ["intervals"], "SELECT DISTINCT seq_id FROM intervals")
def _(spark, sf):
    return natural_order(v.intervals(spark, sf).select("seq_id").distinct())


@query("P20_with_code", ["intervals"], f"SELECT id, 'DTX_' || {NAME_SQL} AS name FROM intervals")
def _(spark, sf):
    return with_code(format_name(named_intervals(spark, sf)).select("id", "name"), "DTX")


@query(
    "J2_contain_join",
    ["parts", "elements"],
    """SELECT p.part_id, e.region_id FROM parts p JOIN elements e
    ON p.seq_id = e.seq_id AND p."start" >= e."start" AND p."end" <= e."end" """,
)
def _(spark, sf):
    regions = v.elements(spark, sf).select("seq_id", "start", "end", "region_id")
    children = v.parts(spark, sf).select("seq_id", "start", "end", "part_id")
    return iv.contain_join(children, regions).select("part_id", F.col("r_region_id").alias("region_id"))


@query(
    "J3_overlap_join",
    ["intervals", "strict_intervals"],
    """SELECT a.id AS id, b.id AS other, least(a."end", b."end") - greatest(a."start", b."start") + 1 AS shared
    FROM intervals a JOIN strict_intervals b ON a.seq_id = b.seq_id AND a."start" <= b."end" AND b."start" <= a."end" """,
)
def _(spark, sf):
    cols = ["seq_id", "start", "end", "id"]
    pairs = iv.overlap_join(v.intervals(spark, sf).select(*cols), v.strict_intervals(spark, sf).select(*cols))
    shared = F.least("end", "b_end") - F.greatest("start", "b_start") + 1
    return pairs.select("id", F.col("b_id").alias("other"), shared.alias("shared"))


@query(
    "J3_overlap_join_wide",
    ["elements"],
    """SELECT a.element_id AS id, b.element_id AS other FROM elements a JOIN elements b
    ON a.seq_id = b.seq_id AND a."start" <= b."end" AND b."start" <= a."end" AND a.element_id <> b.element_id""",
)
def _(spark, sf):
    e = v.elements(spark, sf).select("seq_id", "start", "end", "element_id")
    pairs = iv.overlap_join(e, e, bin=1024)
    return pairs.where(F.col("element_id") != F.col("b_element_id")).select(
        F.col("element_id").alias("id"), F.col("b_element_id").alias("other")
    )


@query(
    "W3_select_disjoint",
    ["intervals"],
    """, thin AS (SELECT * FROM (SELECT seq_id, "start", "end", id,
        row_number() OVER (PARTITION BY seq_id, "start" ORDER BY score DESC, id) AS rn FROM intervals) WHERE rn = 1),
    kept(seq_id, "start", "end", id) AS (
      SELECT seq_id, min("start"), arg_min("end", "start"), arg_min(id, "start") FROM thin GROUP BY seq_id
      UNION ALL
      SELECT t.seq_id, min(t."start"), arg_min(t."end", t."start"), arg_min(t.id, t."start")
      FROM kept k JOIN thin t ON t.seq_id = k.seq_id AND t."start" > k."end" GROUP BY t.seq_id)
    SELECT seq_id, "start", "end", id FROM kept""",
    recursive=True,
)
def _(spark, sf):
    t = v.intervals(spark, sf).select("seq_id", "start", "end", "score", "id")
    return iv.select_disjoint(t, [F.col("score").desc(), F.col("id")]).select("seq_id", "start", "end", "id")


MERGE_SQL = """, flagged AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY seq_id ORDER BY "start", "end", code
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS fresh FROM intervals),
    grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY seq_id ORDER BY "start", "end", code ROWS UNBOUNDED PRECEDING) AS g FROM flagged),
    merged AS (SELECT seq_id, min("start") AS "start", max("end") AS "end", count(*) AS n,
        arg_max(code, ("start", "end", code)) AS code FROM grouped GROUP BY seq_id, g)
"""


@query("W4_merge_intervals", ["intervals"], MERGE_SQL.format(gap=0) + 'SELECT seq_id, "start", "end", n, code FROM merged')
def _(spark, sf):
    return iv.merge_intervals(v.intervals(spark, sf), label="code")


@query("W4_merge_within_gap", ["intervals"], MERGE_SQL.format(gap=10) + 'SELECT seq_id, "start", "end", n, code FROM merged')
def _(spark, sf):
    return iv.merge_intervals(v.intervals(spark, sf), gap=10, label="code", tile=512)


@query(
    "W5_abutting_bases",
    ["intervals"],
    """SELECT seq_id, count(*) AS bases FROM (SELECT DISTINCT seq_id, unnest(range("start", "end" + 1)) AS pos FROM intervals)
    GROUP BY seq_id""",
)
def _(spark, sf):
    merged = iv.merge_intervals(v.intervals(spark, sf), gap=1)
    return merged.groupBy("seq_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


@query(
    "W6_drop_overlapping_previous",
    ["intervals"],
    """, thin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, "start"
        ORDER BY "end" - "start" DESC, similarity DESC, id) AS rn FROM intervals) WHERE rn = 1),
    seen AS (SELECT *, lag("end") OVER (PARTITION BY seq_id ORDER BY "start") AS before FROM thin)
    SELECT seq_id, "start", "end", id FROM seen WHERE before IS NULL OR "start" > before""",
)
def _(spark, sf):
    t = v.intervals(spark, sf).select("seq_id", "start", "end", "similarity", "id")
    ties = [(F.col("end") - F.col("start")).desc(), F.col("similarity").desc(), F.col("id")]
    return iv.drop_overlapping_previous(t, ties).select("seq_id", "start", "end", "id")


@query(
    "W7_chain_signals",
    ["intervals"],
    """, seen AS (SELECT *, lag("end") OVER w AS before FROM intervals WINDOW w AS (PARTITION BY seq_id ORDER BY "start", "end", score)),
    grouped AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" - before >= 40 THEN 1 ELSE 0 END)
        OVER (PARTITION BY seq_id ORDER BY "start", "end", score ROWS UNBOUNDED PRECEDING) AS g FROM seen)
    SELECT seq_id, min("start") AS "start", max_by("end", ("start", "end", score)) AS "end",
      max_by(score, ("start", "end", score)) AS score, count(*) AS n,
      round(sum(ln(greatest(tax, 1e-300))), 6) AS log_evalue
    FROM grouped GROUP BY seq_id, g HAVING sum(ln(greatest(tax, 1e-300))) <= ln(1e-5)""",
)
def _(spark, sf):
    t = v.intervals(spark, sf).withColumn("evalue", F.col("tax"))
    # the product itself underflows to 0 on long chains; its logarithm is what is compared
    out = iv.chain_signals(t, max_gap=40, max_evalue=1e-5, keep_log=True)
    return out.select("seq_id", "start", "end", "score", "n", F.round("log_evalue", 6).alias("log_evalue"))


@query(
    "W13_renumber",
    ["intervals"],
    """SELECT id, seq_id, "start", 'solo' || row_number() OVER (ORDER BY CAST(substring(seq_id, 4) AS BIGINT), "start", "end", id) AS new_id
    FROM intervals""",
)
def _(spark, sf):
    t = v.intervals(spark, sf).select("id", "seq_id", "start", "end")
    return iv.renumber(t, "solo", ties=["id"]).select("id", "seq_id", "start", "new_id")


@query(
    "W13_renumber_children",
    ["elements", "parts"],
    """, numbered AS (SELECT element_id, 'element_' || row_number() OVER (ORDER BY CAST(substring(seq_id, 4) AS BIGINT), "start", "end", element_id)
        AS new_id FROM elements)
    SELECT part_id, new_id AS parent FROM parts JOIN numbered USING (element_id)""",
)
def _(spark, sf):
    e = v.elements(spark, sf).select(F.col("element_id").alias("id"), "seq_id", "start", "end")
    children = v.parts(spark, sf).select("part_id", F.col("element_id").alias("parent"))
    _, moved = iv.renumber(e, "element_", ties=["id"], children=children)
    return moved.select("part_id", "parent")


TAXONOMY_SQL = "taxonomy(code, superfamily, class, \"order\", repeat_name) AS (VALUES " + ", ".join(
    "(" + ", ".join("'Unknown'" if x is None else f"'{x}'" for x in row) + ")" for row in fixed_rows(TAXONOMY)
) + ")"


@query(
    "J6_with_taxonomy",
    ["intervals"],
    f""", {TAXONOMY_SQL}
    SELECT id, i.code, coalesce(superfamily, 'Unknown') AS superfamily, coalesce(class, 'Unknown') AS class,
      coalesce("order", 'Unknown') AS "order", coalesce(repeat_name, 'Unknown') AS repeat_name
    FROM intervals i LEFT JOIN taxonomy t ON i.code = t.code""",
)
def _(spark, sf):
    return with_taxonomy(v.intervals(spark, sf).select("id", "code"))


@query(
    "J6_code_of_superfamily",
    ["intervals"],
    f""", {TAXONOMY_SQL}
    SELECT id, superfamily, max(t.code) AS code FROM (SELECT id, superfamily FROM intervals i JOIN taxonomy x ON i.code = x.code) s
    LEFT JOIN taxonomy t USING (superfamily) WHERE superfamily <> 'Unknown' GROUP BY id, superfamily""",
)
def _(spark, sf):
    named = with_taxonomy(v.intervals(spark, sf).select("id", "code")).where(F.col("superfamily") != "Unknown")
    return code_of(named.select("id", "superfamily"))


COVERAGE_SQL = MERGE_SQL.format(gap=0) + f""", {TAXONOMY_SQL},
    genome AS (SELECT sum(length) AS total FROM sequence_spans),
    named AS (SELECT coalesce(class, 'Unknown') AS class, coalesce("order", 'Unknown') AS ord, coalesce(repeat_name, 'Unknown') AS rn,
        "end" - "start" + 1 AS bases FROM merged m LEFT JOIN taxonomy t ON m.code = t.code),
    rolled AS (SELECT class, ord, rn, CAST(sum(bases) AS BIGINT) AS bases FROM named GROUP BY ROLLUP (class, ord, rn))
    SELECT coalesce(class, 'total') AS class, coalesce(ord, 'all') AS "order", coalesce(rn, 'all') AS repeat_name, bases,
      floor(100.0::DOUBLE * bases / (SELECT total FROM genome) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS percent FROM rolled"""


@query("A6_coverage_summary", ["intervals", "sequence_spans"], COVERAGE_SQL)
def coverage(spark, sf):
    merged = iv.merge_intervals(v.intervals(spark, sf), label="code")
    return coverage_summary(merged, v.sequence_spans(spark, sf))


@query(
    "A3_length_stats",
    ["intervals"],
    """SELECT code, count(*) AS n, min("end" - "start" + 1) AS min_length, max("end" - "start" + 1) AS max_length,
      floor(sum("end" - "start" + 1)::DOUBLE / count(*) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS mean_length,
      sum(CASE WHEN score > 3 THEN 1 ELSE 0 END)::BIGINT AS with_domains FROM intervals GROUP BY code""",
)
def _(spark, sf):
    t = v.intervals(spark, sf).withColumn("domains", F.col("score") - 3)
    return length_stats(t, "code", "domains")


@query(
    "T1_coordinate_sort",
    ["intervals", "elements"],
    """SELECT seq_id, "start", "end", id FROM intervals UNION ALL SELECT seq_id, "start", "end", element_id FROM elements""",
)
def _(spark, sf):
    a = v.intervals(spark, sf).select("seq_id", "start", "end", "id")
    b = v.elements(spark, sf).select("seq_id", "start", "end", F.col("element_id").alias("id"))
    return iv.coordinate_sort(a, b, ties=["id"])


@query(
    "U1_concatenate_libraries",
    ["intervals", "elements"],
    """SELECT id, seq_id, 'complete' AS kind FROM intervals WHERE score >= 4 UNION ALL
    SELECT id, seq_id, 'fragment' FROM intervals WHERE score < 4 UNION ALL SELECT element_id, seq_id, 'element' FROM elements""",
)
def _(spark, sf):
    from loci.operators.ordering import concatenate

    t = v.intervals(spark, sf).select("id", "seq_id", "score")
    whole = t.where(F.col("score") >= 4).select("id", "seq_id", F.lit("complete").alias("kind"))
    part = t.where(F.col("score") < 4).select("id", "seq_id", F.lit("fragment").alias("kind"))
    other = v.elements(spark, sf).select(F.col("element_id").alias("id"), "seq_id", F.lit("element").alias("kind"))
    return concatenate(whole, part, other)
