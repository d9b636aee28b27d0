"""Queries over the ready-made jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci import plans
from loci.operators import hits as h
from loci.operators.sequences import windows

from . import views as v
from .q_families import SIMILARITY_SQL, pair_hits
from .q_hierarchy import BEST_SQL, DOC_FLANKS_SQL, MERGED_DOMAINS_SQL, RETRO, RULES_SQL, SCORE_SQL, doc_flanks, natural
from .q_intervals import MERGE_SQL, TAXONOMY_SQL
from .q_sequences import FLANK_REPEATS_SQL, GAP_MEASURES, GAP_STATS_SQL
from .registry import query

SIZE = 1000
K, SHARE = 12, 0.6


def chunks(spark, sf):
    return windows(v.sequences(spark, sf), SIZE, 50)


def runs(spark, sf):
    """Strict run: finished orders; relaxed run: all orders."""
    e, p = v.doc_elements(spark, sf), v.doc_features(spark, sf)
    strict = e.where(F.col("status") == "F")
    return (strict, p), (e, p)


def refined_sql(longest: int, share: str, elements: str = "doc_elements") -> str:
    """Elements left by the rules, the choice between the runs and the share of ambiguous letters."""
    left_out = f"(SELECT id FROM tested WHERE floor((length(r) - length(translate(r, 'Nn', '')))::DOUBLE / length(r) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE >= {share})"

    return (
        RULES_SQL.replace(" WHEN g IS NULL THEN 'coding_domain_filtered'", "").replace("FROM parts", "FROM doc_features").replace("FROM elements e", f"FROM {elements} e").replace("25000", str(longest))
        + SCORE_SQL.replace("FROM parts", "FROM doc_features")
        + """, all_scored AS (SELECT r.*, coalesce(score, 0) AS score FROM ruled r LEFT JOIN scored USING (element_id) WHERE rule IS NULL),
    intervals AS (SELECT element_id || '_relaxed' AS id, seq_id, "start", "end", score, similarity FROM all_scored),
    strict_intervals AS (SELECT element_id || '_strict' AS id, seq_id, "start", "end", score, similarity FROM all_scored WHERE status = 'F')
"""
        + BEST_SQL
        + f""", used AS (SELECT DISTINCT sid FROM assigned),
    combined AS (SELECT seq_id, "start", "end", id, 'best' AS origin FROM best WHERE anchor IN (SELECT sid FROM used)
      UNION ALL SELECT seq_id, "start", "end", id, 'relaxed' FROM intervals WHERE id NOT IN (SELECT rid FROM assigned)
      UNION ALL SELECT seq_id, "start", "end", id, 'strict' FROM strict_intervals WHERE id NOT IN (SELECT sid FROM used)),
    tested AS (SELECT id, substring(residues, "start", "end" - "start" + 1) AS r FROM combined c JOIN sequences s ON c.seq_id = s.seq_id WHERE "start" <= length(residues)),
    kept AS (SELECT * FROM combined WHERE id NOT IN {left_out})
"""
    )


REFINED_SQL = refined_sql(300, "0.12")


@query(
    "C1_refine_predictions",
    ["doc_elements", "doc_features", "sequences"],
    natural(
        REFINED_SQL
        + """SELECT id, seq_id, "start", "end", origin, 'LTR_retrotransposon' || row_number() OVER (ORDER BY CAST(substring(seq_id, 4) AS BIGINT), "start", "end",
        natural_key(id), id) AS new_id FROM kept"""
    ),
)
def _(spark, sf):
    strict, relaxed = runs(spark, sf)
    out, _ = plans.refine_predictions(strict, relaxed, chunks(spark, sf), max_ambiguous=0.12, size=SIZE, bin=64, max_length=300)
    return out.select("id", "seq_id", "start", "end", "origin", "new_id")


@query(
    "A17_refine_report",
    ["doc_elements", "doc_features", "sequences"],
    natural(
        REFINED_SQL
        + """, strict_ruled AS (SELECT * FROM ruled WHERE status = 'F'), both_ruled AS (SELECT rule FROM ruled UNION ALL SELECT rule FROM strict_ruled)
    SELECT 'found' AS measure, (SELECT count(*) FROM ruled) + (SELECT count(*) FROM strict_ruled) AS n
    UNION ALL SELECT 'removed_by_genes', 0
    UNION ALL SELECT 'passed_genes', (SELECT count(*) FROM ruled) + (SELECT count(*) FROM strict_ruled)
    UNION ALL SELECT rule, count(*) FROM both_ruled WHERE rule IS NOT NULL GROUP BY rule
    UNION ALL SELECT 'strict', count(*) FROM strict_ruled UNION ALL SELECT 'relaxed', count(*) FROM ruled
    UNION ALL SELECT 'best', count(*) FROM combined WHERE origin = 'best' UNION ALL SELECT 'combined', count(*) FROM kept
    UNION ALL SELECT 'n_perc_filtered', (SELECT count(*) FROM combined) - (SELECT count(*) FROM kept)"""
    ),
)
def _(spark, sf):
    strict, relaxed = runs(spark, sf)
    _, report = plans.refine_predictions(strict, relaxed, chunks(spark, sf), max_ambiguous=0.12, size=SIZE, bin=64, max_length=300)
    return report


# elements whose flanks are all covered to half their length by a gene hit
GENE_LIKE_SQL = """, covered AS (SELECT query AS flank_id, max(length) AS hit FROM flank_genes GROUP BY 1),
    gene_like AS (SELECT element_id FROM doc_flanks LEFT JOIN covered USING (flank_id) GROUP BY 1 HAVING bool_and(coalesce(hit / length::DOUBLE >= 0.5, false)))
"""


@query(
    "C1_refine_without_gene_copies",
    ["doc_elements", "doc_features", "sequences", "document_lengths", "flank_genes"],
    natural(
        DOC_FLANKS_SQL
        + GENE_LIKE_SQL
        + refined_sql(300, "0.12", "(SELECT * FROM doc_elements WHERE element_id NOT IN (SELECT element_id FROM gene_like))")
        + """SELECT id, seq_id, "start", "end", origin, 'LTR_retrotransposon' || row_number() OVER (ORDER BY CAST(substring(seq_id, 4) AS BIGINT), "start", "end",
        natural_key(id), id) AS new_id FROM kept"""
    ),
)
def _(spark, sf):
    strict, relaxed = runs(spark, sf)
    genes = (doc_flanks(spark, sf), v.flank_genes(spark, sf))
    out, _ = plans.refine_predictions(strict, relaxed, chunks(spark, sf), genes=genes, max_ambiguous=0.12, size=SIZE, bin=64, max_length=300)
    return out.select("id", "seq_id", "start", "end", "origin", "new_id")


def families_sql(kind: str) -> str:
    """From ``called`` (element_id, superfamily, ...) and ``own`` (parts) to families."""
    number = "(regexp_extract(element_id, '^(.*?)[0-9]+$', 1), CAST(regexp_extract(element_id, '([0-9]+)$', 1) AS BIGINT))"
    return (
        MERGED_DOMAINS_SQL.replace("FROM parts", "FROM own")
        + f""", ends AS (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY "start", "end", strand) AS rn,
        count(*) OVER (PARTITION BY element_id) AS n FROM own WHERE type = '{kind}'),
    pieces AS (SELECT 'full' AS part, seq_id, element_id, "start", "end" FROM called
      UNION ALL SELECT CASE WHEN strand = '+' THEN CASE WHEN rn = 1 THEN '5prime' ELSE '3prime' END WHEN strand = '-' THEN CASE WHEN rn = 1 THEN '3prime' ELSE '5prime' END
        ELSE CASE WHEN rn = 1 THEN 'unk-prime-f' ELSE 'unk-prime-r' END END, seq_id, element_id, "start", "end" FROM ends WHERE n = 2
      UNION ALL SELECT type, seq_id, element_id, "start", "end" FROM own WHERE type IN ('primer_binding_site', 'RR_tract')
      UNION ALL SELECT name, seq_id, element_id, "start", "end" FROM md),
    cut AS (SELECT DISTINCT part, element_id, "start", substring(residues, "start", "end" - "start" + 1) AS r FROM pieces p JOIN sequences s ON p.seq_id = s.seq_id
      WHERE "start" <= length(residues)),
    joined AS (SELECT part, element_id, string_agg(r, '' ORDER BY "start", r) AS residues FROM cut GROUP BY ALL),
    named AS (SELECT j.part || chr(9) || j.element_id AS id, j.part, superfamily, residues, count(*) OVER (PARTITION BY superfamily, j.part) AS n
      FROM joined j JOIN called USING (element_id)),
    texts AS (SELECT min(id) AS id, superfamily, part, residues FROM named WHERE n >= 2 GROUP BY superfamily, part, residues),
    sets AS (SELECT id, superfamily, part, unnest(list_distinct(flatten(list_transform(range(1, {K + 1}), lambda ph: regexp_extract_all(substring(residues, ph), '(?s).{{{K}}}'))))) AS kmer FROM texts),
    sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
    common AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.kmer = b.kmer AND a.superfamily = b.superfamily AND a.part = b.part AND a.id < b.id GROUP BY ALL),
    pairs AS (SELECT a, b FROM common JOIN sizes x ON a = x.id JOIN sizes y ON b = y.id WHERE shared::DOUBLE / (x.n + y.n - shared) >= {SHARE}),
    half AS (SELECT a, b FROM pairs UNION ALL SELECT t.id, m.id FROM named m JOIN texts t USING (superfamily, part, residues) WHERE m.n >= 2 AND t.id <> m.id),
    links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
    reach(id, other) AS (SELECT id, id FROM named WHERE n >= 2 UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
    clustered AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id),
    members AS (SELECT string_split(id, chr(9))[1] AS part, string_split(id, chr(9))[2] AS element_id, cluster FROM clustered
      WHERE cluster IN (SELECT cluster FROM clustered GROUP BY cluster HAVING count(*) >= 2)),
    signed AS (SELECT element_id, string_agg(part || '=' || cluster, '|' ORDER BY part || '=' || cluster) AS signature FROM members GROUP BY element_id),
    keyed AS (SELECT c.element_id, superfamily, coalesce(signature, c.element_id) AS signature FROM called c LEFT JOIN signed USING (element_id)),
    keyed_k AS (SELECT *, min({number}) OVER (PARTITION BY signature) AS k FROM keyed),
    fams AS (SELECT superfamily, k, count(*) AS n, min({number}) AS first FROM keyed_k GROUP BY superfamily, k),
    fam_no AS (SELECT *, row_number() OVER (PARTITION BY superfamily, n = 1 ORDER BY n DESC, first) - 1 AS no FROM fams)
    SELECT element_id, superfamily, CASE WHEN n = 1 THEN 'singleton_' ELSE '' END || 'family' || no AS family, n = 1 AS is_singleton
    FROM keyed_k JOIN fam_no USING (superfamily, k)"""
    )


TNP = "(?i)transpos(?:ase)?|mule|(?:dbd|dde)?_tnp_(?:hat)?|duf4216"


def ltr_inputs(spark, sf):
    e = v.doc_elements(spark, sf).where(F.col("type") == "LTR_retrotransposon")
    return e, v.doc_features(spark, sf)


def tir_inputs(spark, sf):
    e = v.doc_elements(spark, sf).where(F.col("type") == "terminal_inverted_repeat_element")
    return e, v.doc_features(spark, sf)


@query(
    "C2_classify_ltr",
    ["doc_elements", "doc_features", "sequences"],
    f""", own AS (SELECT p.* FROM doc_features p JOIN doc_elements e USING (element_id) WHERE e.type = 'LTR_retrotransposon'
        AND (p.type <> 'protein_match' OR NOT regexp_matches(p.name, '{TNP}'))),
    kinds AS (SELECT element_id, CASE WHEN bool_or(regexp_matches(name, '(?i)rvt_1|chromo')) THEN 'Gypsy'
        WHEN bool_or(regexp_matches(name, '(?i)rvt_2|ubn2')) THEN 'Copia' END AS sf FROM own WHERE type = 'protein_match' GROUP BY element_id),
    called AS (SELECT e.*, coalesce(sf, 'Unclassified') AS superfamily FROM doc_elements e LEFT JOIN kinds USING (element_id) WHERE type = 'LTR_retrotransposon')
    """
    + families_sql("long_terminal_repeat"),
    recursive=True,
)
def _(spark, sf):
    e, p = ltr_inputs(spark, sf)
    return plans.classify_ltr(e, p, chunks(spark, sf), k=K, min_share=SHARE, size=SIZE)["families"]


@query(
    "C3_classify_tir",
    ["doc_elements", "doc_features", "sequences"],
    f""", own AS (SELECT p.* FROM doc_features p JOIN doc_elements e USING (element_id) WHERE e.type = 'terminal_inverted_repeat_element'
        AND (p.type <> 'protein_match' OR regexp_matches(p.name, '{TNP}'))),
    tsd AS (SELECT *, "end" - "start" + 1 AS len FROM own WHERE type = 'target_site_duplication'),
    lens AS (SELECT element_id, bool_or(len = 8) AS t8, bool_or(len BETWEEN 8 AND 11) AS t811 FROM tsd GROUP BY 1),
    ta AS (SELECT element_id, bool_or(regexp_matches(substring(residues, "start", 2), '(?i)ta')) AS ta FROM tsd JOIN sequences USING (seq_id) WHERE len = 2 GROUP BY 1),
    facts AS (SELECT e.*, coalesce(t8, false) AS a, coalesce(t811, false) AS b, coalesce(ta, false) AS c,
        coalesce(regexp_matches(substring(residues, e."start", e."end" - e."start" + 1), '(?i)^cact(?:a|g)?|cact(?:a|g)?$'), false) AS d,
        e.element_id IN (SELECT element_id FROM own WHERE type = 'protein_match') AS dom
      FROM doc_elements e LEFT JOIN lens USING (element_id) LEFT JOIN ta USING (element_id) LEFT JOIN sequences s ON e.seq_id = s.seq_id
      WHERE type = 'terminal_inverted_repeat_element'),
    called AS (SELECT *, CASE WHEN NOT dom AND "end" - "start" + 1 <= 600 THEN 'MITE' WHEN c THEN 'Tc1-Mariner' WHEN a THEN 'hAT' WHEN b THEN 'Mutator'
        WHEN d THEN 'CACTA' ELSE 'unclassified' END AS superfamily FROM facts)
    """
    + families_sql("terminal_inverted_repeat"),
    recursive=True,
)
def _(spark, sf):
    e, p = tir_inputs(spark, sf)
    return plans.classify_tir(e, p, chunks(spark, sf), k=K, min_share=SHARE, size=SIZE)["families"]


@query(
    "C4_filter_tir_predictions",
    ["doc_elements", "doc_features"],
    f"""SELECT element_id, seq_id, "start", "end" FROM doc_elements WHERE type = 'terminal_inverted_repeat_element'
    AND element_id NOT IN (SELECT element_id FROM doc_features WHERE type = 'protein_match' AND regexp_matches(name, '{RETRO}'))
    AND element_id NOT IN (SELECT p.element_id FROM doc_features p JOIN doc_elements e USING (element_id)
      WHERE p.type = 'terminal_inverted_repeat' AND p."start" = e."start" AND p."end" = e."end" GROUP BY p.element_id HAVING count(*) = 2)""",
)
def _(spark, sf):
    return plans.filter_tir_predictions(*tir_inputs(spark, sf)).select("element_id", "seq_id", "start", "end")


@query(
    "C4_filter_tir_gene_copies",
    ["doc_elements", "doc_features", "document_lengths", "flank_genes"],
    DOC_FLANKS_SQL
    + GENE_LIKE_SQL
    + f"""SELECT element_id, seq_id, "start", "end" FROM doc_elements WHERE type = 'terminal_inverted_repeat_element' AND element_id NOT IN (SELECT element_id FROM gene_like)
    AND element_id NOT IN (SELECT element_id FROM doc_features WHERE type = 'protein_match' AND regexp_matches(name, '{RETRO}'))
    AND element_id NOT IN (SELECT p.element_id FROM doc_features p JOIN doc_elements e USING (element_id)
      WHERE p.type = 'terminal_inverted_repeat' AND p."start" = e."start" AND p."end" = e."end" GROUP BY p.element_id HAVING count(*) = 2)""",
)
def _(spark, sf):
    genes = (doc_flanks(spark, sf), v.flank_genes(spark, sf))
    return plans.filter_tir_predictions(*tir_inputs(spark, sf), genes=genes).select("element_id", "seq_id", "start", "end")


@query(
    "C5_pair_families",
    ["hits", "query_lengths", "subject_lengths"],
    """, lens AS (SELECT * FROM query_lengths UNION ALL SELECT * FROM subject_lengths),
    edges AS (SELECT query AS a, subject AS b, max(bits) AS score, md5(least(query, subject) || '|' || greatest(query, subject)) AS tie
        FROM hits h JOIN lens q ON h.query = q.id JOIN lens s ON h.subject = s.id
        WHERE identity >= 80 AND h.length >= 80 AND h.length >= least(q.length, s.length) * 0.5 GROUP BY query, subject),
    rounds(a, b, score, tie, taken) AS (
      SELECT a, b, score, tie, false FROM edges
      UNION ALL
      SELECT a, b, score, tie, mutual FROM (
        SELECT *, max(CASE WHEN mutual THEN 1 ELSE 0 END) OVER (PARTITION BY a) AS ua, max(CASE WHEN mutual THEN 1 ELSE 0 END) OVER (PARTITION BY b) AS ub
        FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, tie) = 1 AND row_number() OVER (PARTITION BY b ORDER BY score DESC, tie) = 1 AS mutual
              FROM rounds WHERE NOT taken))
      WHERE mutual OR (ua = 0 AND ub = 0)),
    owner AS (SELECT a AS element_id, b AS k FROM rounds WHERE taken UNION ALL SELECT b, b FROM rounds WHERE taken),
    keyed AS (SELECT id AS element_id, coalesce(k, id) AS k FROM lens LEFT JOIN owner ON id = element_id),
    fams AS (SELECT k, count(*) AS n, min((left(element_id, 1), CAST(substring(element_id, 2) AS BIGINT))) AS first FROM keyed GROUP BY k),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY n = 1 ORDER BY n DESC, first) - 1 AS no FROM fams)
    SELECT element_id, 'Helitron' AS superfamily, CASE WHEN n = 1 THEN 'singleton_' ELSE '' END || 'family' || no AS family, n = 1 AS is_singleton
    FROM keyed JOIN numbered USING (k)""",
    recursive=True,
)
def _(spark, sf):
    lengths = v.query_lengths(spark, sf).unionByName(v.subject_lengths(spark, sf))
    elements = lengths.select(F.col("id").alias("element_id"), "length", F.lit("Helitron").alias("superfamily"))
    return plans.pair_families(elements, v.hits(spark, sf))["families"]


@query(
    "C6_annotate_nonltr",
    ["doc_path", "sequences"],
    f""", {TAXONOMY_SQL}, both_paths AS (SELECT *, CASE WHEN position % 2 = 0 THEN '+' ELSE '-' END AS strand FROM doc_path),
    marked AS (SELECT *, max(CASE WHEN state = 0 THEN position END) OVER (PARTITION BY seq_id, strand ORDER BY position
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block FROM both_paths),
    nz AS (SELECT * FROM marked WHERE state <> 0 AND block IS NOT NULL),
    chain(seq_id, strand, block, first, p, s, k) AS (
      SELECT seq_id, strand, block, max(position), max(position), arg_max(state, position), 1 FROM nz GROUP BY seq_id, strand, block
      UNION ALL
      SELECT c.seq_id, c.strand, c.block, c.first, max(n.position), c.s - 1, c.k + 1 FROM chain c JOIN nz n
        ON n.seq_id = c.seq_id AND n.strand = c.strand AND n.block = c.block AND n.state = c.s - 1 AND n.position < c.p GROUP BY c.seq_id, c.strand, c.block, c.first, c.s, c.k),
    ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, strand, block ORDER BY k DESC) AS rn FROM chain) WHERE rn = 1 AND (k = 1 OR k = 3)),
    paths AS (SELECT seq_id, strand, block AS s, first AS e, CASE WHEN ends.s <= 3 THEN 'Jockey' ELSE 'CRE' END AS clade FROM ends),
    lens AS (SELECT seq_id, length(residues) AS len FROM sequences WHERE length(residues) > 0),
    placed AS (SELECT seq_id, s, e, clade, strand FROM paths WHERE strand = '+' UNION ALL SELECT seq_id, len - e, len - s, clade, strand FROM paths JOIN lens USING (seq_id) WHERE strand = '-'),
    clamped AS (SELECT seq_id, strand, clade, greatest(s - 5, 1) AS s, least(e + 5, len) AS e, seq_id || '_' || s || '_' || e || '_' || strand AS element_id FROM placed JOIN lens USING (seq_id)),
    cut AS (SELECT *, substring(residues, s, e - s + 1) AS r FROM clamped JOIN sequences USING (seq_id) WHERE e >= s AND s <= length(residues)),
    trim AS (SELECT *, length(regexp_extract(r, '(?i)^N+[ATCG]{{0,10}}?N+?')) AS h, length(regexp_extract(r, '(?i)N+?[ATCG]{{0,10}}?N+$')) AS t FROM cut),
    out AS (SELECT element_id, seq_id, s + h AS "start", e - t AS "end", strand, clade, substring(r, h + 1, greatest(length(r) - h - t, 0)) AS r FROM trim)
    SELECT element_id, seq_id, "start", "end", strand, clade, coalesce((SELECT max(code) FROM taxonomy x WHERE x.superfamily = clade), 'RIX') AS code, md5(r) AS digest
    FROM out WHERE length(r) >= 100 AND floor((length(r) - length(translate(r, 'Nn', '')))::DOUBLE / length(r) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE <= 0.3""",
    recursive=True,
)
def _(spark, sf):
    path = v.doc_path(spark, sf)
    cut = chunks(spark, sf)
    from loci.operators.sequences import sequence_lengths

    even = F.col("position") % 2 == 0
    out = plans.annotate_nonltr(path.where(even), path.where(~even), sequence_lengths(cut), cut, flank=5, min_length=100, size=SIZE)
    return out.select("element_id", "seq_id", "start", "end", "strand", "clade", "code", F.md5("residues").alias("digest"))


@query(
    "C7_mask_genome_coverage",
    ["doc_hits", "sequences"],
    """, intervals AS (SELECT subject AS seq_id, s_start AS "start", s_end AS "end", left(query, 3) AS code FROM doc_hits WHERE identity >= 80 AND length >= 70)
    """
    + MERGE_SQL.format(gap=0)
    + f""", {TAXONOMY_SQL}, genome AS (SELECT sum(length(residues)) AS total FROM sequences),
    named AS (SELECT coalesce(class, 'Unknown') AS class, coalesce("order", 'Unknown') AS ord, coalesce(repeat_name, 'Unknown') AS rn,
        "end" - "start" + 1 AS bases FROM merged m LEFT JOIN taxonomy t ON m.code = t.code),
    rolled AS (SELECT class, ord, rn, CAST(sum(bases) AS BIGINT) AS bases FROM named GROUP BY ROLLUP (class, ord, rn))
    SELECT coalesce(class, 'total') AS class, coalesce(ord, 'all') AS "order", coalesce(rn, 'all') AS repeat_name, bases,
      floor(100.0::DOUBLE * bases / (SELECT total FROM genome) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS percent FROM rolled""",
)
def _(spark, sf):
    _, coverage = plans.mask_genome(chunks(spark, sf), h.normalize_hits(v.doc_hits(spark, sf)), size=SIZE)
    return coverage


@query(
    "C7_mask_genome_sequences",
    ["doc_hits", "sequences"],
    """, letters AS (SELECT seq_id, unnest(string_split(residues, '')) AS letter, generate_subscripts(string_split(residues, ''), 1) AS pos FROM sequences WHERE length(residues) > 0),
    covered AS (SELECT DISTINCT subject AS seq_id, unnest(range(s_start, s_end + 1)) AS pos FROM doc_hits WHERE identity >= 80 AND length >= 70)
    SELECT l.seq_id, md5(string_agg(CASE WHEN c.pos IS NULL THEN letter ELSE 'N' END, '' ORDER BY l.pos)) AS digest
    FROM letters l LEFT JOIN covered c ON l.seq_id = c.seq_id AND l.pos = c.pos GROUP BY l.seq_id""",
)
def _(spark, sf):
    from loci.operators.sequences import stitch

    masked, _ = plans.mask_genome(chunks(spark, sf), h.normalize_hits(v.doc_hits(spark, sf)), size=SIZE)
    return stitch(masked).select("seq_id", F.md5("residues").alias("digest"))


FRAGMENTS_SQL = """, thin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, s_start ORDER BY bits DESC, query, s_end DESC, evalue, identity DESC) AS rn
        FROM doc_hits WHERE identity >= 80 AND length >= 100 AND s_end - s_start + 1 >= 100) WHERE rn = 1),
    kept(subject, s_start, s_end, query, strand) AS (
      SELECT subject, min(s_start), arg_min(s_end, s_start), arg_min(query, s_start), arg_min(strand, s_start) FROM thin GROUP BY subject
      UNION ALL
      SELECT t.subject, min(t.s_start), arg_min(t.s_end, t.s_start), arg_min(t.query, t.s_start), arg_min(t.strand, t.s_start)
      FROM kept k JOIN thin t ON t.subject = k.subject AND t.s_start > k.s_end GROUP BY t.subject)
, named AS (SELECT subject AS seq_id, s_start AS "start", s_end AS "end",
      query || '_fragment_' || subject || '-' || row_number() OVER (PARTITION BY subject ORDER BY s_start) AS id, strand FROM kept)
"""


@query("C8_find_fragments", ["doc_hits"], FRAGMENTS_SQL + """SELECT seq_id, "start", "end", id FROM named""", recursive=True)
def fragments(spark, sf):
    return plans.find_fragments(h.normalize_hits(v.doc_hits(spark, sf))).select("seq_id", "start", "end", "id")


@query(
    "C8_fragment_residues",
    ["doc_hits", "sequences"],
    FRAGMENTS_SQL
    + """SELECT id, md5(CASE WHEN strand = '-' THEN translate(reverse(r), 'ACGTacgt', 'TGCAtgca') ELSE r END) AS digest
    FROM (SELECT id, strand, substring(residues, "start", "end" - "start" + 1) AS r FROM named JOIN sequences USING (seq_id) WHERE "start" <= length(residues))""",
    recursive=True,
)
def _(spark, sf):
    found = plans.find_fragments(h.normalize_hits(v.doc_hits(spark, sf)))
    return plans.fragment_residues(found, chunks(spark, sf), SIZE).select("id", F.md5("residues").alias("digest"))


@query(
    "C9_solo_repeats",
    ["doc_hits"],
    """, thin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, s_start ORDER BY s_end - s_start DESC, identity DESC, query, bits DESC) AS rn
        FROM doc_hits WHERE identity >= 80 AND length >= 80) WHERE rn = 1),
    seen AS (SELECT *, lag(s_end) OVER (PARTITION BY subject ORDER BY s_start) AS before FROM thin)
    SELECT subject AS seq_id, s_start AS "start", s_end AS "end", query,
      'solo_LTR' || row_number() OVER (ORDER BY CAST(substring(subject, 4) AS BIGINT), s_start, s_end) AS id FROM seen WHERE before IS NULL OR s_start > before""",
)
def _(spark, sf):
    return plans.solo_repeats(h.normalize_hits(v.doc_hits(spark, sf))).select("seq_id", "start", "end", "query", "id")


@query(
    "C9_solo_repeats_of_top_families",
    ["doc_hits", "document_lengths"],
    """, models AS (SELECT DISTINCT query, left(query, 3) AS family FROM doc_hits),
    top AS (SELECT family FROM models GROUP BY family ORDER BY count(*) DESC, family LIMIT 3),
    thin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, s_start ORDER BY s_end - s_start DESC, identity DESC, query, bits DESC) AS rn
        FROM doc_hits WHERE identity >= 80 AND length >= 80 AND left(query, 3) IN (SELECT family FROM top)
          AND length >= (100 + length(query) * 10) * 0.6::DOUBLE) WHERE rn = 1),
    seen AS (SELECT *, lag(s_end) OVER (PARTITION BY subject ORDER BY s_start) AS before FROM thin)
    SELECT subject AS seq_id, s_start AS "start", s_end AS "end", query,
      'solo_LTR' || row_number() OVER (ORDER BY CAST(substring(subject, 4) AS BIGINT), s_start, s_end) AS id FROM seen WHERE before IS NULL OR s_start > before""",
)
def _(spark, sf):
    """Models of the three largest families only, each to be covered to six tenths."""
    hits = h.normalize_hits(v.doc_hits(spark, sf))
    models = hits.select(F.col("query").alias("element_id"), F.substring("query", 1, 3).alias("family")).distinct()
    lengths = models.select(F.col("element_id").alias("id"), (100 + F.length("element_id") * 10).alias("length"))
    found = plans.solo_repeats(hits, query_lengths=lengths, min_coverage=0.6, families=models, top=3)
    return found.select("seq_id", "start", "end", "query", "id")


@query(
    "C10_paired_repeats",
    ["doc_features", "sequences"],
    """, ends AS (SELECT *, row_number() OVER (PARTITION BY seq_id, element_id ORDER BY "start", "end", coalesce(strand, '?')) AS rn,
        count(*) OVER (PARTITION BY seq_id, element_id) AS n FROM doc_features WHERE type = 'long_terminal_repeat'),
    sides AS (SELECT element_id, CASE WHEN strand = '-' THEN rn = 2 ELSE rn = 1 END AS first, substring(residues, "start", "end" - "start" + 1) AS r
      FROM ends JOIN sequences USING (seq_id) WHERE n = 2 AND "start" <= length(residues))
    SELECT element_id, md5(max(CASE WHEN first THEN r END)) AS "left", md5(max(CASE WHEN NOT first THEN r END)) AS "right" FROM sides GROUP BY element_id""",
)
def _(spark, sf):
    pairs = plans.paired_repeats(v.doc_features(spark, sf), chunks(spark, sf), size=SIZE)
    return pairs.select("element_id", F.md5("left").alias("left"), F.md5("right").alias("right"))


@query(
    "C10_element_ages",
    ["aligned_pairs"],
    """, cols AS (SELECT pair_id, unnest(string_split("left", '')) AS a, unnest(string_split("right", '')) AS b FROM aligned_pairs WHERE length("left") > 0),
    ident AS (SELECT pair_id, 100.0::DOUBLE * sum(CASE WHEN a = b THEN 1 ELSE 0 END)::BIGINT / count(*) AS i, bool_and(a = b) AS same FROM cols GROUP BY pair_id),
    known AS (SELECT pair_id, a, b, (a IN ('A','G') AND b IN ('A','G')) OR (a IN ('C','T') AND b IN ('C','T')) AS near
      FROM (SELECT pair_id, translate(a, 'acgt', 'ACGT') AS a, translate(b, 'acgt', 'ACGT') AS b FROM cols) WHERE a IN ('A','C','G','T') AND b IN ('A','C','G','T')),
    sums AS (SELECT pair_id, count(*) AS n, sum(CASE WHEN a <> b AND near THEN 1 ELSE 0 END)::DOUBLE AS ts, sum(CASE WHEN a <> b AND NOT near THEN 1 ELSE 0 END)::DOUBLE AS tv FROM known GROUP BY pair_id),
    aged AS (SELECT *, CASE WHEN same OR ts + tv = 0 THEN 0.0::DOUBLE WHEN 1 - 2*(ts/n) - tv/n > 0 AND 1 - 2*(tv/n) > 0 THEN -0.5::DOUBLE * ln((1 - 2*(ts/n) - tv/n) * sqrt(1 - 2*(tv/n))) END AS d
      FROM sums JOIN ident USING (pair_id))
    SELECT pair_id, floor(i * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS identity, round(d, 6) AS divergence, round(d / 2e-8, 0) AS age FROM aged""",
)
def _(spark, sf):
    t = plans.element_ages(v.aligned_pairs(spark, sf), key="pair_id")
    return t.select("pair_id", "identity", F.round("divergence", 6).alias("divergence"), F.round("age", 0).alias("age"))


@query(
    "C11_recombination",
    ["sequences"],
    """, src AS (SELECT 'doc' || doc_id AS seq_id, lang || '_' || source AS family, text AS residues FROM documents),
    used AS (SELECT * FROM src WHERE family IN (SELECT family FROM src GROUP BY family HAVING count(*) >= 2)),
    letters AS (SELECT seq_id, family, unnest(string_split(residues, '')) AS letter, generate_subscripts(string_split(residues, ''), 1) AS pos FROM used),
    gaps AS (SELECT seq_id, family, pos, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM letters WHERE letter = 'e'),
    runs AS (SELECT seq_id, family, count(*) AS n FROM gaps GROUP BY seq_id, family, g)
    SELECT family, count(DISTINCT seq_id) AS members, CAST(sum(n) AS BIGINT) AS total_gap_length FROM runs GROUP BY family""",
)
def _(spark, sf):
    d = v.table(spark, sf, "documents")
    t = d.select(F.concat(F.lit("doc"), "doc_id").alias("seq_id"), F.concat_ws("_", "lang", "source").alias("family"), F.col("text").alias("residues"))
    return plans.recombination(t, gap="e")["per_family"].select("family", "members", "total_gap_length")


USED_SQL = """, src AS (SELECT 'doc' || doc_id AS seq_id, lang || '_' || source AS family, text AS residues FROM documents),
    used AS (SELECT * FROM src WHERE family IN (SELECT family FROM src GROUP BY family HAVING count(*) >= 2))
"""


def recombined(spark, sf):
    d = v.table(spark, sf, "documents")
    t = d.select(F.concat(F.lit("doc"), "doc_id").alias("seq_id"), F.concat_ws("_", "lang", "source").alias("family"), F.col("text").alias("residues"))
    return plans.recombination(t, gap="e", min_gap=2)


@query("C11_recombination_sequences", ["sequences"], GAP_STATS_SQL + USED_SQL + "SELECT f.*, family FROM full_stats f JOIN used USING (seq_id)")
def _(spark, sf):
    return recombined(spark, sf)["per_sequence"]


@query(
    "C11_recombination_families",
    ["sequences"],
    GAP_STATS_SQL
    + USED_SQL
    + """SELECT family, count(*) AS members, CAST(sum(sum_run) AS BIGINT) AS total_gap_length, """
    + ", ".join(f"round(avg({m}) + 1e-9, 4) AS {m}_mean, round(stddev_samp({m}) + 1e-9, 4) AS {m}_sd" for m in GAP_MEASURES)
    + " FROM full_stats JOIN used USING (seq_id) GROUP BY family",
)
def _(spark, sf):
    rounded = [F.round(F.col(f"{m}_{x}") + 1e-9, 4).alias(f"{m}_{x}") for m in GAP_MEASURES for x in ("mean", "sd")]
    return recombined(spark, sf)["per_family"].select("family", "members", "total_gap_length", *rounded)


@query("C11_recombination_repeats", ["sequences"], FLANK_REPEATS_SQL + USED_SQL + "SELECT r.*, family FROM flank_repeats r JOIN used USING (seq_id)")
def _(spark, sf):
    return recombined(spark, sf)["repeats"]


@query(
    "C12_transfer_annotations",
    ["norm_hits", "query_lengths"],
    """, lib AS (SELECT h.query, h.bits, CASE n % 5 WHEN 0 THEN 'RLG_ji_AC2' || n WHEN 1 THEN 'Copia-' || (n % 40) || '_LTR' WHEN 2 THEN 'Gypsy' || (n % 30) || '-I'
        WHEN 3 THEN 'DTC_ZM' || (n % 20) || '_consensus' ELSE 'fam' || (n % 10) END AS subject
      FROM (SELECT *, CAST(replace(subject, 's', '') AS BIGINT) AS n FROM norm_hits) h JOIN query_lengths q ON h.query = q.id
      WHERE identity >= 80 AND h.length >= 80 AND h.length >= q.length * 0.5),
    fam AS (SELECT 'q' || o_orderkey AS query, 'F' || o_custkey AS family FROM orders),
    cleaned AS (SELECT l.query, f.family, bits, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(subject,
        'I$|_I$|LTR$|_LTR$', ''), '_AC.*', ''), '-', '_'), '[0-9]+$', ''), '([A-Za-z0-9_]{3}_[A-Za-z0-9_]+?)_.*', '\\1') AS hf FROM lib l JOIN fam f ON l.query = f.query),
    votes AS (SELECT family, hf, count(*) AS c, sum(CAST(bits AS DECIMAL(18,2))) AS s FROM cleaned GROUP BY ALL),
    best AS (SELECT family, hf FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY c DESC, s DESC, hf) AS rn FROM votes) WHERE rn = 1)
    SELECT f.query AS element_id, CASE WHEN f.query IN (SELECT query FROM lib) THEN hf END AS reference FROM fam f LEFT JOIN best USING (family)""",
)
def _(spark, sf):
    from .q_hits import library_hits

    customers = v.table(spark, sf, "orders").select(F.concat(F.lit("q"), "o_orderkey").alias("element_id"), F.concat(F.lit("F"), "o_custkey").alias("family"))
    elements = customers.join(v.query_lengths(spark, sf).withColumnRenamed("id", "element_id"), "element_id")
    out, _ = plans.transfer_annotations(elements, library_hits(spark, sf).drop("family"))
    return out.select("element_id", "reference")


@query(
    "C13_global_summary",
    ["members"],
    """, sizes AS (SELECT superfamily AS type, family, count(*) AS family_size FROM members GROUP BY ALL)
    SELECT element_id, m.family, family_size, 'Gypsy' AS superfamily FROM members m JOIN sizes s ON m.superfamily = s.type AND m.family = s.family""",
)
def _(spark, sf):
    m = v.members(spark, sf).select("element_id", F.col("superfamily").alias("type"), "family", "length")
    ages = m.select("element_id", "type", "family", (F.col("length") / 1e6).alias("divergence"))
    out = plans.global_summary(pair_hits(spark, sf), m, ages)
    return out["ages"].select("element_id", "family", "family_size", "superfamily")


@query("C13_family_similarity", ["members"], SIMILARITY_SQL)
def _(spark, sf):
    m = v.members(spark, sf).select("element_id", F.col("superfamily").alias("type"), "family", "length")
    ages = m.select("element_id", "type", "family", (F.col("length") / 1e6).alias("divergence"))
    return plans.global_summary(pair_hits(spark, sf), m, ages)["similarity"]
