"""Queries over elements and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci.operators import hierarchy as hi
from loci.operators.summary import with_ontology
from loci.schema import DOMAIN_TERMS, ONTOLOGY, fixed_rows

from . import views as v
from .registry import query

TIR = "terminal_inverted_repeat_element"


@query(
    "J1_attach_parent",
    ["parts", "elements"],
    """SELECT part_id, p."start" - e."start" AS "offset", e."start" AS e_start, e."end" AS e_end, e.strand AS e_strand
    FROM parts p JOIN elements e ON p.seq_id = e.seq_id AND p.element_id = e.element_id""",
)
def _(spark, sf):
    t = hi.attach_parent(v.parts(spark, sf), v.elements(spark, sf))
    return t.select("part_id", (F.col("start") - F.col("e_start")).alias("offset"), "e_start", "e_end", "e_strand")


SCORE_SQL = """, tsd AS (SELECT element_id, count(*) AS tsds, arg_min("end" - "start", ("start", "end")) AS a, arg_max("end" - "start", ("start", "end")) AS b
      FROM parts WHERE type = 'target_site_duplication' GROUP BY element_id),
    flags AS (SELECT element_id, max(CASE WHEN type='primer_binding_site' THEN 1 ELSE 0 END) AS pbs,
      max(CASE WHEN type='RR_tract' THEN 1 ELSE 0 END) AS ppt, max(CASE WHEN type='inverted_repeat' THEN 1 ELSE 0 END) AS ir,
      CAST(sum(CASE WHEN type='protein_match' THEN 1 ELSE 0 END) AS BIGINT) AS domains FROM parts GROUP BY element_id),
    scored AS (SELECT element_id, pbs, ppt, ir, domains, CASE WHEN tsds >= 2 AND a = b THEN 1 ELSE 0 END AS tsd_equal,
      pbs + ppt + ir + domains + CASE WHEN tsds >= 2 AND a = b THEN 1 ELSE 0 END AS score FROM flags LEFT JOIN tsd USING (element_id))
"""


@query("A1_score_elements", ["parts"], SCORE_SQL + "SELECT * FROM scored")
def _(spark, sf):
    return hi.score_elements(v.parts(spark, sf))


RULES_SQL = """, doms AS (SELECT element_id, string_split(name, ';')[1] AS name FROM parts WHERE type = 'protein_match'),
    per AS (SELECT element_id, name, count(*) AS n FROM doms GROUP BY ALL),
    kinds AS (SELECT element_id, n, name, regexp_matches(name, '(?i)RVT_1|Chromo') AS g,
        NOT regexp_matches(name, '(?i)RVT_1|Chromo') AND regexp_matches(name, '(?i)RVT_2|UBN2') AS c FROM per),
    facts AS (SELECT element_id, bool_or(g) AS g, bool_or(c) AS c,
        bool_or(NOT g AND NOT c AND regexp_matches(name, '(?i)transpos(?:ase)?|mule|(?:dbd|dde)?_tnp_(?:hat)?|duf4216')) AS t,
        bool_or(n > 1 AND NOT regexp_matches(name, '(?i)chromo')) AS d FROM kinds GROUP BY element_id),
    ruled AS (SELECT e.*, CASE WHEN g AND c THEN 'compound_gyp_cop_filtered' WHEN t THEN 'class_II_filtered' WHEN d THEN 'dup_pdoms_filtered'
        WHEN e."end" - e."start" + 1 >= 25000 THEN 'length_filtered' WHEN g IS NULL THEN 'coding_domain_filtered' END AS rule
        FROM elements e LEFT JOIN facts f USING (element_id))
"""


@query("A2_refine", ["elements", "parts"], RULES_SQL + """SELECT element_id, seq_id, "start", "end" FROM ruled WHERE rule IS NULL""")
def _(spark, sf):
    kept = hi.refine(v.elements(spark, sf), v.parts(spark, sf), require_domains=True)
    return kept.select("element_id", "seq_id", "start", "end")


@query(
    "A2_refine_stats",
    ["elements", "parts"],
    RULES_SQL
    + """SELECT coalesce(rule, 'passed') AS rule, count(*) AS n FROM ruled GROUP BY ALL UNION ALL SELECT 'total_num', count(*) FROM ruled""",
)
def _(spark, sf):
    return hi.refine_stats(v.elements(spark, sf), v.parts(spark, sf), require_domains=True)


@query(
    "A4_architecture_counts",
    ["elements", "parts"],
    """, arch AS (SELECT element_id, string_agg(name, ',' ORDER BY "start", "end", name) AS architecture FROM parts
        WHERE type = 'protein_match' GROUP BY element_id),
    arches AS (SELECT strand, architecture FROM arch JOIN elements USING (element_id))
    SELECT strand, architecture, count(*) AS n FROM arches GROUP BY ALL UNION ALL SELECT 'both', architecture, count(*) FROM arches GROUP BY ALL""",
)
def _(spark, sf):
    return hi.architecture_counts(v.elements(spark, sf), v.parts(spark, sf))


MERGED_DOMAINS_SQL = """, dom AS (SELECT seq_id, element_id, name, "start", "end" FROM parts WHERE type = 'protein_match'),
    opened AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY element_id, name ORDER BY "start", "end"
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM dom),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY element_id, name ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM opened),
    md AS (SELECT seq_id, element_id, name, min("start") AS "start", max("end") AS "end" FROM numbered GROUP BY seq_id, element_id, name, g)
"""


@query(
    "A5_architecture_detail",
    ["parts"],
    MERGED_DOMAINS_SQL
    + """SELECT element_id, string_agg(name || '{' || "start" || '-' || "end" || '}', ',' ORDER BY "start", "end", name) AS architecture
    FROM md GROUP BY element_id""",
)
def _(spark, sf):
    return hi.architecture_detail(v.parts(spark, sf))


BEST_SQL = """, pairs AS (SELECT r.id AS rid, s.id AS sid, s."start" AS ss, r."start", r."end", r.seq_id, r.score, r.similarity,
        least(r."end", s."end") - greatest(r."start", s."start") + 1 AS shared
      FROM intervals r JOIN strict_intervals s ON r.seq_id = s.seq_id AND r."start" <= s."end" AND s."start" <= r."end"),
    assigned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY shared DESC, ss, natural_key(sid), sid) AS rn FROM pairs) WHERE rn = 1),
    grp AS (SELECT sid AS anchor, rid AS id, seq_id, "start", "end", score, similarity, 'relaxed' AS set FROM assigned
      UNION ALL SELECT id, id, seq_id, "start", "end", score, similarity, 'strict' FROM strict_intervals),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, similarity DESC, natural_key(id), id, set) AS rn
      FROM grp) WHERE rn = 1)
"""


def natural(sql: str) -> str:
    """Spell out the natural sort key, which the SQL side has no function for."""
    import re

    return re.sub(
        r"natural_key\((\w+)\)",
        r"list_transform(regexp_extract_all(\1, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(length(regexp_replace(x, '^0+([0-9])', '\\\\1'))::VARCHAR, 10, '0') || regexp_replace(x, '^0+([0-9])', '\\\\1') ELSE x END)",
        sql,
    )


def strict_and_relaxed(spark, sf):
    cols = ["seq_id", "start", "end", "id", "score", "similarity"]
    return v.strict_intervals(spark, sf).select(*cols), v.intervals(spark, sf).select(*cols)


@query(
    "W2_best_of_overlap",
    ["intervals", "strict_intervals"],
    natural(BEST_SQL + """SELECT anchor, id, seq_id, "start", "end", score, similarity, set FROM best"""),
)
def _(spark, sf):
    strict, relaxed = strict_and_relaxed(spark, sf)
    return hi.best_of_overlap(strict, relaxed)


@query(
    "U2_combine_sets",
    ["intervals", "strict_intervals"],
    natural(
        BEST_SQL
        + """, used AS (SELECT DISTINCT sid FROM assigned)
    SELECT seq_id, "start", "end", id, score, similarity, 'best' AS origin FROM best WHERE anchor IN (SELECT sid FROM used)
    UNION ALL SELECT seq_id, "start", "end", id, score, similarity, 'relaxed' FROM intervals WHERE id NOT IN (SELECT rid FROM assigned)
    UNION ALL SELECT seq_id, "start", "end", id, score, similarity, 'strict' FROM strict_intervals WHERE id NOT IN (SELECT sid FROM used)"""
    ),
)
def _(spark, sf):
    strict, relaxed = strict_and_relaxed(spark, sf)
    return hi.combine_sets(strict, relaxed)


@query(
    "W11_label_ends",
    ["parts"],
    """, ends AS (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY "start", "end", strand) AS rn,
        count(*) OVER (PARTITION BY element_id) AS n FROM parts WHERE type = 'long_terminal_repeat')
    SELECT seq_id, element_id, "start", "end", strand, CASE WHEN strand = '+' THEN CASE WHEN rn = 1 THEN '5prime' ELSE '3prime' END
      WHEN strand = '-' THEN CASE WHEN rn = 1 THEN '3prime' ELSE '5prime' END
      ELSE CASE WHEN rn = 1 THEN 'unk-prime-f' ELSE 'unk-prime-r' END END AS side FROM ends WHERE n = 2""",
)
def _(spark, sf):
    return hi.label_ends(v.parts(spark, sf))


@query(
    "P14_relabel",
    ["elements", "parts"],
    """, dom AS (SELECT DISTINCT element_id FROM parts WHERE type = 'protein_match')
    SELECT element_id, CASE WHEN hit THEN 'MITE' ELSE type END AS new_type,
      CASE WHEN hit THEN 'MITE' || orderkey ELSE element_id END AS new_id
    FROM (SELECT e.*, e.type = 'terminal_inverted_repeat_element' AND d.element_id IS NULL AND e."end" - e."start" + 1 <= 6000 AS hit
          FROM elements e LEFT JOIN dom d USING (element_id))""",
)
def relabelled(spark, sf):
    t = hi.relabel(v.elements(spark, sf), v.parts(spark, sf), TIR, "MITE", 6000)
    return t.select("element_id", "new_type", "new_id")


@query(
    "P14_relabel_lard",
    ["elements", "parts"],
    """, dom AS (SELECT DISTINCT element_id FROM parts WHERE type = 'protein_match')
    SELECT element_id, CASE WHEN hit THEN 'LARD' ELSE type END AS new_type, CASE WHEN hit THEN 'LARD' || orderkey ELSE element_id END AS new_id
    FROM (SELECT e.*, e.type = 'LTR_retrotransposon' AND d.element_id IS NULL AS hit FROM elements e LEFT JOIN dom d USING (element_id))""",
)
def _(spark, sf):
    t = hi.relabel(v.elements(spark, sf), v.parts(spark, sf), "LTR_retrotransposon", "LARD")
    return t.select("element_id", "new_type", "new_id")


@query(
    "P14_reparent",
    ["elements", "parts"],
    """, dom AS (SELECT DISTINCT element_id FROM parts WHERE type = 'protein_match'),
    named AS (SELECT e.element_id, CASE WHEN e.type = 'terminal_inverted_repeat_element' AND d.element_id IS NULL
        AND e."end" - e."start" + 1 <= 6000 THEN 'MITE' || orderkey ELSE e.element_id END AS new_id
        FROM elements e LEFT JOIN dom d USING (element_id))
    SELECT part_id, CASE WHEN type = 'target_site_duplication' THEN region_id ELSE new_id END AS parent FROM parts JOIN named USING (element_id)""",
)
def _(spark, sf):
    return hi.reparent(v.parts(spark, sf), relabelled(spark, sf)).select("part_id", "parent")


RETRO = "(?i)rve|rvt|rvp|gag|chromo|rnase|athila|zf-cchc|ubn2"


@query(
    "P15_exclude_by_child",
    ["elements", "parts"],
    f"""SELECT element_id FROM elements WHERE element_id NOT IN
    (SELECT element_id FROM parts WHERE type = 'protein_match' AND regexp_matches(name, '{RETRO}'))""",
)
def _(spark, sf):
    return hi.exclude_by_child(v.elements(spark, sf), v.parts(spark, sf)).select("element_id")


@query(
    "P16_drop_degenerate",
    ["elements", "parts"],
    """SELECT element_id FROM elements WHERE element_id NOT IN (SELECT p.element_id FROM parts p JOIN elements e USING (element_id)
    WHERE p.type = 'terminal_inverted_repeat' AND p."start" = e."start" AND p."end" = e."end" GROUP BY p.element_id HAVING count(*) = 2)""",
)
def _(spark, sf):
    return hi.drop_degenerate(v.elements(spark, sf), v.parts(spark, sf)).select("element_id")


for _keep in (False, True):

    @query(
        f"P18_filter_domains_{'allow' if _keep else 'deny'}",
        ["parts"],
        f"""SELECT part_id, name FROM parts WHERE type <> 'protein_match' OR
        {'' if _keep else 'NOT '}regexp_matches(name, '(?i)transpos(?:ase)?|mule|(?:dbd|dde)?_tnp_(?:hat)?|duf4216')""",
    )
    def _(spark, sf, keep=_keep):
        return hi.filter_domains(v.parts(spark, sf), keep=keep).select("part_id", "name")


@query(
    "F10_domain_superfamily",
    ["parts"],
    """SELECT element_id, count(*) AS domains, CASE WHEN bool_or(regexp_matches(name, '(?i)rvt_1|chromo')) THEN 'Gypsy'
      WHEN bool_or(regexp_matches(name, '(?i)rvt_2|ubn2')) THEN 'Copia' END AS superfamily
    FROM parts WHERE type = 'protein_match' GROUP BY element_id""",
)
def _(spark, sf):
    return hi.domain_flags(v.parts(spark, sf))


@query(
    "J7_with_ontology",
    ["parts"],
    ", so(type, so_term) AS (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in fixed_rows(ONTOLOGY))
    + "), go(name, go_term) AS (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in fixed_rows(DOMAIN_TERMS))
    + """) SELECT part_id, concat_ws(',', so_term, go_term) AS terms FROM parts p LEFT JOIN so ON p.type = so.type LEFT JOIN go ON p.name = go.name""",
)
def _(spark, sf):
    t = v.parts(spark, sf).withColumn("attributes", F.create_map(F.lit("name"), F.array("name")))
    terms = F.coalesce(F.array_join(F.try_element_at("attributes", F.lit("Ontology_term")), ","), F.lit(""))
    return with_ontology(t).select("part_id", terms.alias("terms"))


@query(
    "J8_without_used",
    ["elements", "parts"],
    """SELECT region_id FROM elements WHERE region_id NOT IN (SELECT region_id FROM parts WHERE type = 'primer_binding_site')""",
)
def _(spark, sf):
    used = v.parts(spark, sf).where(F.col("type") == "primer_binding_site")
    return hi.without(v.elements(spark, sf), used).select("region_id")


def flanks(spark, sf):
    """Two flanks per element; hits of the order stand for hits of its flanks."""
    e = v.elements(spark, sf)
    both = e.select("element_id", "orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    return both.select(
        "element_id",
        F.concat_ws("_", F.lit("f"), "orderkey", "side").alias("flank_id"),
        (F.lit(90) + F.col("orderkey") % 200).alias("length"),
    )


def flank_hits(spark, sf):
    side = F.col("mismatches") % 2
    return v.hits(spark, sf).select(
        F.concat_ws("_", F.lit("f"), F.regexp_replace("query", "q", ""), side).alias("query"), "length", "identity"
    )


GENE_SQL = """, flank AS (SELECT element_id, 'f_' || orderkey || '_' || side AS flank_id, 90 + orderkey % 200 AS length
        FROM elements, (VALUES (0), (1)) s(side)),
    fh AS (SELECT 'f_' || replace(query, 'q', '') || '_' || (mismatches % 2) AS flank_id, max(length) AS hit FROM hits WHERE identity >= 70 GROUP BY 1),
    verdict AS (SELECT element_id, bool_and(coalesce(hit / length::DOUBLE >= 0.5, false)) AS gone FROM flank LEFT JOIN fh USING (flank_id) GROUP BY 1)
"""


@query(
    "J9_filter_gene_like",
    ["elements", "hits"],
    GENE_SQL + """SELECT element_id, seq_id, "start" FROM elements JOIN verdict USING (element_id) WHERE NOT gone""",
)
def gene_kept(spark, sf):
    kept = hi.filter_gene_like(v.elements(spark, sf), flanks(spark, sf), flank_hits(spark, sf), 0.5, 70)
    return kept.select("element_id", "seq_id", "start")


@query(
    "J9_gene_filter_totals",
    ["elements", "hits"],
    GENE_SQL
    + """SELECT count(*) AS total, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone THEN 0 ELSE 1 END) AS BIGINT) AS filtered FROM verdict""",
)
def _(spark, sf):
    return hi.gene_filter_totals(v.elements(spark, sf), gene_kept(spark, sf))


FLANK = 60
DOC_FLANKS_SQL = f""", ordered AS (SELECT *, max("end") OVER (PARTITION BY seq_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM doc_elements),
    opened AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM ordered),
    stretches AS (SELECT seq_id, g, min("start") AS s, max("end") AS e FROM opened GROUP BY ALL),
    room AS (SELECT *, coalesce(lag(e) OVER w, 0) AS l, lead(s) OVER w AS r FROM stretches WINDOW w AS (PARTITION BY seq_id ORDER BY s)),
    sided AS (SELECT o.element_id, o.seq_id, 'left' AS side, greatest(l + 1, s - {FLANK}) AS "start", s - 1 AS "end" FROM opened o JOIN room USING (seq_id, g)
      UNION ALL SELECT o.element_id, o.seq_id, 'right', e + 1, least(coalesce(r, doc_length + 1) - 1, e + {FLANK}) FROM opened o JOIN room USING (seq_id, g) JOIN document_lengths USING (seq_id)),
    doc_flanks AS (SELECT element_id || '_' || side AS flank_id, element_id, seq_id, "start", "end", "end" - "start" + 1 AS length FROM sided WHERE "end" >= "start")
"""


def doc_flanks(spark, sf):
    lengths = v.document_lengths(spark, sf).withColumnRenamed("doc_length", "length")
    return hi.element_flanks(v.doc_elements(spark, sf), lengths, FLANK, tile=512)


@query("J9_element_flanks", ["doc_elements", "document_lengths"], DOC_FLANKS_SQL + "SELECT * FROM doc_flanks")
def _(spark, sf):
    return doc_flanks(spark, sf)


def tir_facts(spark, sf):
    """Element and duplication residues: the text of the document the element falls on."""
    e, p = v.elements(spark, sf), v.parts(spark, sf)
    docs = v.table(spark, sf, "documents").select((F.col("doc_id")).alias("d"), F.lower("text").alias("text"))
    n = v.table(spark, sf, "documents").agg(F.count("*")).scalar()
    on_doc = e.select("element_id", (F.col("orderkey") % n).alias("d"))
    # letters are changed before the text is shuffled, so once per document, and no text is moved behind its join
    changed = docs.select("d", F.translate("text", "eionur", "cacact").alias("residues"))
    residues = on_doc.hint("merge").join(changed, "d").select("element_id", "residues")
    two = p.where((F.col("type") == "target_site_duplication") & (F.col("end") - F.col("start") + 1 == 2))
    ta = two.select("element_id", "start").join(on_doc, "element_id").hint("merge").join(docs, "d").select(
        "element_id", F.substring(F.col("text"), (F.col("start") % F.greatest(F.length("text"), F.lit(1)) + 1).cast("int"), F.lit(2)).alias("residues")
    )
    return hi.tir_evidence(e, p, ta, residues)


TIR_SQL = """, docs AS (SELECT doc_id, lower(text) AS text FROM documents),
    size AS (SELECT count(*) AS n FROM documents),
    placed AS (SELECT element_id, orderkey % n AS doc_id FROM elements, size),
    on_doc AS (SELECT element_id, text FROM placed JOIN docs USING (doc_id)),
    tsd AS (SELECT element_id, "start", "end" - "start" + 1 AS len FROM parts WHERE type = 'target_site_duplication'),
    lens AS (SELECT element_id, bool_or(len = 8) AS t8, bool_or(len BETWEEN 8 AND 11) AS t811 FROM tsd GROUP BY 1),
    ta AS (SELECT element_id, bool_or(regexp_matches(substring(text, CAST("start" % greatest(length(text), 1) + 1 AS INTEGER), 2), '(?i)ta')) AS ta
        FROM tsd JOIN on_doc USING (element_id) WHERE len = 2 GROUP BY 1),
    cact AS (SELECT element_id, regexp_matches(translate(text, 'eionur', 'cacact'), '(?i)^cact(?:a|g)?|cact(?:a|g)?$') AS c FROM on_doc),
    dom AS (SELECT element_id, count(*) AS domains FROM parts WHERE type = 'protein_match' GROUP BY 1),
    evidence AS (SELECT e.element_id, e."end" - e."start" + 1 AS len, coalesce(t8, false) AS tsd_8, coalesce(t811, false) AS tsd_8_11,
        coalesce(ta, false) AS tsd_ta, coalesce(c, false) AS cact_ends, coalesce(domains, 0) AS domains
      FROM elements e LEFT JOIN lens USING (element_id) LEFT JOIN ta USING (element_id) LEFT JOIN cact USING (element_id) LEFT JOIN dom USING (element_id)),
    called AS (SELECT *, CASE WHEN domains = 0 AND len <= 600 THEN 'MITE' WHEN tsd_ta THEN 'Tc1-Mariner' WHEN tsd_8 THEN 'hAT'
        WHEN tsd_8_11 THEN 'Mutator' WHEN cact_ends THEN 'CACTA' ELSE 'unclassified' END AS superfamily FROM evidence)
"""


@query(
    "F7_tir_evidence",
    ["elements", "parts"],
    TIR_SQL + "SELECT element_id, tsd_8, tsd_8_11, tsd_ta, cact_ends, domains FROM evidence",
)
def _(spark, sf):
    return tir_facts(spark, sf).select("element_id", "tsd_8", "tsd_8_11", "tsd_ta", "cact_ends", "domains")


@query("U3_tir_superfamily", ["elements", "parts"], TIR_SQL + "SELECT element_id, superfamily FROM called")
def called(spark, sf):
    return hi.tir_superfamily(tir_facts(spark, sf)).select("element_id", "superfamily")


@query(
    "A13_superfamily_totals",
    ["elements", "parts"],
    TIR_SQL + "SELECT coalesce(superfamily, 'total') AS superfamily, count(*) AS n FROM called GROUP BY ROLLUP (superfamily)",
)
def _(spark, sf):
    return hi.superfamily_totals(called(spark, sf))
