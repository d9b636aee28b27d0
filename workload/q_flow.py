"""The whole flow: one query per result, each with SQL that goes through the same steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci import plans
from loci.operators import hits as h
from loci.session import materialize

from . import views as v
from .q_hierarchy import RETRO, natural
from .q_intervals import MERGE_SQL, TAXONOMY_SQL
from .q_jobs import FRAGMENTS_SQL, K, SHARE, SIZE, TNP, chunks, families_sql, refined_sql
from .registry import query

VIEWS = ["doc_elements", "doc_features", "doc_hits", "doc_path", "sequences", "element_hits"]
LEAST_NONLTR = 100
FINAL = ("RLG", "DTA")


FLOWS: dict[tuple[str, str], plans.GenomeFlow] = {}


def whole_flow(spark, sf) -> plans.GenomeFlow:
    """The flow over one folder, once a session: its results share their steps."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in FLOWS:
        FLOWS.clear()
        FLOWS[key] = new_flow(spark, sf)
    return FLOWS[key]


def new_flow(spark, sf) -> plans.GenomeFlow:
    """Elements of the first priorities are LTR elements; the rest is dealt to the other kinds by order number.

    The steps read their input very often; joins and cuts that make it are done once.
    """
    e = materialize(v.doc_elements(spark, sf))
    parts = v.doc_features(spark, sf, materialize(v.doc_lines(spark, sf)))
    ltr, deal = F.col("type") == "LTR_retrotransposon", F.col("orderkey") % 5
    hits = materialize(h.normalize_hits(v.doc_hits(spark, sf)))
    even = F.col("position") % 2 == 0
    path = v.doc_path(spark, sf)

    def runs(kind):
        mine = e.where(kind)
        return (mine.where(F.col("status") == "F"), parts), (mine, parts)

    return plans.GenomeFlow(
        materialize(chunks(spark, sf)),
        ltrs=runs(ltr),
        trims=runs(~ltr & (deal == 0)),
        helitrons=e.where(~ltr & (deal == 1)),
        tirs=(e.where(~ltr & (deal > 1)), parts),
        nonltrs=(path.where(even), path.where(~even)),
        library_hits=hits.where(F.substring("query", 1, 3).isin(*FINAL)),
        fragment_hits=hits,
        solo_hits=hits,
        pair_hits=v.element_hits(spark, sf),
        min_nonltr=LEAST_NONLTR,
        size=SIZE,
        bin=64,
        k=K,
        min_share=SHARE,
    )


def masked_sql(name: str, spans: str, base: str = "sequences") -> str:
    """``name`` (seq_id, residues): ``base`` with the intervals of ``spans`` overwritten."""
    return f"""{name}_cut AS (SELECT DISTINCT seq_id, unnest(range("start", "end" + 1)) AS pos FROM ({spans})),
    {name}_letters AS (SELECT seq_id, unnest(string_split(residues, '')) AS letter, generate_subscripts(string_split(residues, ''), 1) AS pos FROM {base} WHERE length(residues) > 0),
    {name} AS (SELECT l.seq_id, string_agg(CASE WHEN c.pos IS NULL THEN letter ELSE 'N' END, '' ORDER BY l.pos) AS residues
      FROM {name}_letters l LEFT JOIN {name}_cut c ON l.seq_id = c.seq_id AND l.pos = c.pos GROUP BY l.seq_id)"""


def clean_sql(rows: str, text: str) -> str:
    """Rows (seq_id, start, end, ...) of which less than 30 in a hundred letters are masked."""
    return f"""SELECT c.* FROM (SELECT c.*, substring(residues, "start", "end" - "start" + 1) AS r FROM ({rows}) c LEFT JOIN {text} s ON c.seq_id = s.seq_id) c
      WHERE coalesce(length(r), 0) = 0 OR floor((length(r) - length(translate(r, 'Nn', '')))::DOUBLE / length(r) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE < 0.3"""


def numbered_sql(rows: str, prefix: str, old: str = "element_id", out: str = "element_id") -> str:
    """Rows with numbers in natural order of sequence, start and end; the old id stays as ``pred``."""
    return f"""SELECT * EXCLUDE ({old}), {old} AS pred, '{prefix}' || row_number() OVER (ORDER BY CAST(substring(seq_id, 4) AS BIGINT), "start", "end", natural_key({old}), {old}) AS {out} FROM ({rows})"""


def tree_sql(kind: str, where: str, text: str) -> str:
    refined = refined_sql(25000, "0.3", f"(SELECT * FROM doc_elements WHERE {where})").replace("JOIN sequences s", f"JOIN {text} s").lstrip(", \n")
    return f"""WITH {refined} SELECT n.element_id, n.old_id, n.seq_id, n."start", n."end", e.strand, '{kind}' AS type, e.element_id AS pred
      FROM ({numbered_sql("SELECT * FROM kept", kind, "id").replace("id AS pred", "id AS old_id")}) n JOIN doc_elements e ON e.element_id = regexp_extract(n.old_id, '^element[0-9]+')"""


def regions_sql(rows: str, prefix: str) -> str:
    return f"""SELECT *, '{prefix}' || row_number() OVER (ORDER BY CAST(substring(seq_id, 4) AS BIGINT), "start", "end", natural_key(element_id), element_id) AS region_id FROM ({rows})"""


def parts_sql(tree: str) -> str:
    return f"SELECT p.* EXCLUDE (element_id, region_id), t.element_id, t.region_id FROM doc_features p JOIN {tree} t ON p.element_id = t.pred"


def ages_sql(parts: str, text: str, kind: str) -> str:
    """Pairs of repeats cut to the shorter one, compared place by place."""
    second_turned = "CASE WHEN first THEN r ELSE translate(reverse(r), 'ACGTacgt', 'TGCAtgca') END" if kind == "terminal_inverted_repeat" else "r"
    return f"""WITH ends AS (SELECT *, row_number() OVER (PARTITION BY seq_id, element_id ORDER BY "start", "end", coalesce(strand, '?')) AS rn,
        count(*) OVER (PARTITION BY seq_id, element_id) AS n FROM {parts} WHERE type = '{kind}'),
    cut AS (SELECT element_id, CASE WHEN strand = '-' THEN rn = 2 ELSE rn = 1 END AS first, substring(residues, "start", "end" - "start" + 1) AS r
      FROM ends JOIN {text} s USING (seq_id) WHERE n = 2 AND "start" <= length(residues)),
    turned AS (SELECT element_id, first, {second_turned} AS r FROM cut),
    sided AS (SELECT element_id AS pair_id, max(CASE WHEN first THEN r END) AS l, max(CASE WHEN NOT first THEN r END) AS r FROM turned GROUP BY element_id),
    aligned_pairs AS (SELECT pair_id, substring(l, 1, least(length(l), length(r))) AS "left", substring(r, 1, least(length(l), length(r))) AS "right" FROM sided WHERE l IS NOT NULL AND r IS NOT NULL),
    cols AS (SELECT pair_id, unnest(string_split("left", '')) AS a, unnest(string_split("right", '')) AS b FROM aligned_pairs WHERE length("left") > 0),
    ident AS (SELECT pair_id, 100.0::DOUBLE * sum(CASE WHEN a = b THEN 1 ELSE 0 END)::BIGINT / count(*) AS i, bool_and(a = b) AS same FROM cols GROUP BY pair_id),
    known AS (SELECT pair_id, a, b, (a IN ('A','G') AND b IN ('A','G')) OR (a IN ('C','T') AND b IN ('C','T')) AS near
      FROM (SELECT pair_id, translate(a, 'acgt', 'ACGT') AS a, translate(b, 'acgt', 'ACGT') AS b FROM cols) WHERE a IN ('A','C','G','T') AND b IN ('A','C','G','T')),
    sums AS (SELECT pair_id, count(*) AS n, sum(CASE WHEN a <> b AND near THEN 1 ELSE 0 END)::DOUBLE AS ts, sum(CASE WHEN a <> b AND NOT near THEN 1 ELSE 0 END)::DOUBLE AS tv FROM known GROUP BY pair_id),
    aged AS (SELECT *, CASE WHEN same OR ts + tv = 0 THEN 0.0::DOUBLE WHEN 1 - 2*(ts/n) - tv/n > 0 AND 1 - 2*(tv/n) > 0 THEN -0.5::DOUBLE * ln((1 - 2*(ts/n) - tv/n) * sqrt(1 - 2*(tv/n))) END AS d
      FROM sums JOIN ident USING (pair_id))
    SELECT pair_id AS element_id, floor(i * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS identity, round(d, 6) AS divergence, round(d / 2e-8, 0) AS age FROM aged"""


def coded(families: str, default: str) -> str:
    return f"""SELECT f.*, coalesce((SELECT max(code) FROM taxonomy x WHERE x.superfamily <> 'Unknown' AND x.superfamily = replace(f.superfamily, '-', '/')), '{default}') AS code FROM {families} f"""


def library_sql(elements: str, families: str, text: str, default: str) -> str:
    return f"""SELECT code || '_' || family || '_' || e.element_id || '_' || e.seq_id || '_' || "start" || '_' || "end" AS name,
        substring(residues, "start", "end" - "start" + 1) AS residues
      FROM {elements} e JOIN ({coded(families, default)}) f ON e.element_id = f.element_id JOIN {text} s ON s.seq_id = e.seq_id WHERE "start" <= length(residues)"""


LTR_WHERE, TRIM_WHERE = "type = 'LTR_retrotransposon'", "type <> 'LTR_retrotransposon' AND orderkey % 5 = 0"
OTHER = "SELECT * FROM doc_elements WHERE type <> 'LTR_retrotransposon' AND orderkey % 5"
PLACE = 'SELECT seq_id, "start", "end" FROM'

LTR_CALLED = f""" own AS (SELECT * FROM ltr_parts WHERE type <> 'protein_match' OR NOT regexp_matches(name, '{TNP}')),
    kinds AS (SELECT element_id, CASE WHEN bool_or(regexp_matches(name, '(?i)rvt_1|chromo')) THEN 'Gypsy'
        WHEN bool_or(regexp_matches(name, '(?i)rvt_2|ubn2')) THEN 'Copia' END AS sf, true AS domain FROM own WHERE type = 'protein_match' GROUP BY element_id),
    called AS (SELECT e.* EXCLUDE (type), coalesce(sf, 'Unclassified') AS superfamily,
        CASE WHEN type = 'LTR_retrotransposon' AND sf IS NULL AND domain IS NULL THEN 'LARD' ELSE type END AS type FROM ltr_tree e LEFT JOIN kinds USING (element_id))"""

TIR_CALLED = f""" own AS (SELECT * FROM tir_parts WHERE type <> 'protein_match' OR regexp_matches(name, '{TNP}')),
    tsd AS (SELECT *, "end" - "start" + 1 AS len FROM own WHERE type = 'target_site_duplication'),
    lens AS (SELECT element_id, bool_or(len = 8) AS t8, bool_or(len BETWEEN 8 AND 11) AS t811 FROM tsd GROUP BY 1),
    ta AS (SELECT element_id, bool_or(regexp_matches(substring(residues, "start", 2), '(?i)ta')) AS ta FROM tsd JOIN near3 USING (seq_id) WHERE len = 2 GROUP BY 1),
    facts AS (SELECT e.*, coalesce(t8, false) AS a, coalesce(t811, false) AS b, coalesce(ta, false) AS c,
        coalesce(regexp_matches(substring(residues, e."start", e."end" - e."start" + 1), '(?i)^cact(?:a|g)?|cact(?:a|g)?$'), false) AS d,
        e.element_id IN (SELECT element_id FROM own WHERE type = 'protein_match') AS dom
      FROM tir_tree e LEFT JOIN lens USING (element_id) LEFT JOIN ta USING (element_id) LEFT JOIN masked3 s ON e.seq_id = s.seq_id),
    called AS (SELECT * EXCLUDE (type), CASE WHEN NOT dom AND "end" - "start" + 1 <= 600 THEN 'MITE' WHEN c THEN 'Tc1-Mariner' WHEN a THEN 'hAT' WHEN b THEN 'Mutator'
        WHEN d THEN 'CACTA' ELSE 'unclassified' END AS superfamily, CASE WHEN NOT dom AND "end" - "start" + 1 <= 600 THEN 'MITE' ELSE type END AS type FROM facts)"""

SINGLES = """SELECT element_id, clade AS superfamily, 'singleton_family' || (row_number() OVER (PARTITION BY clade ORDER BY CAST(regexp_extract(element_id, '([0-9]+)$', 1) AS BIGINT)) - 1) AS family,
      true AS is_singleton FROM nonltrs"""

NUMBER = "(regexp_extract(element_id, '^(.*?)[0-9]+$', 1), CAST(regexp_extract(element_id, '([0-9]+)$', 1) AS BIGINT))"

PAIRED = f"""WITH RECURSIVE lens AS (SELECT element_id AS id, "end" - "start" + 1 AS length FROM helitrons),
    named AS (SELECT q.element_id AS query, s.element_id AS subject, identity, h.length, bits FROM element_hits h JOIN helitrons q ON h.query = q.pred JOIN helitrons s ON h.subject = s.pred),
    edges AS (SELECT query AS a, subject AS b, max(bits) AS score, md5(least(query, subject) || '|' || greatest(query, subject)) AS tie
        FROM named h JOIN lens q ON h.query = q.id JOIN lens s ON h.subject = s.id
        WHERE query <> subject AND identity >= 80 AND h.length >= 80 AND h.length >= least(q.length, s.length) * 0.5 GROUP BY query, subject),
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
    fams AS (SELECT k, count(*) AS n, min({NUMBER}) AS first FROM keyed GROUP BY k),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY n = 1 ORDER BY n DESC, first) - 1 AS no FROM fams)
    SELECT element_id, 'Helitron' AS superfamily, CASE WHEN n = 1 THEN 'singleton_' ELSE '' END || 'family' || no AS family, n = 1 AS is_singleton FROM keyed JOIN numbered USING (k)"""

NONLTR = f"""WITH RECURSIVE both_paths AS (SELECT *, CASE WHEN position % 2 = 0 THEN '+' ELSE '-' END AS strand FROM doc_path),
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
    clamped AS (SELECT seq_id, strand, clade, greatest(s, 1) AS s, least(e, len) AS e, seq_id || '_' || s || '_' || e || '_' || strand AS element_id FROM placed JOIN lens USING (seq_id)),
    cut AS (SELECT *, substring(residues, s, e - s + 1) AS r FROM clamped JOIN masked4 USING (seq_id) WHERE e >= s AND s <= length(residues)),
    trim AS (SELECT *, length(regexp_extract(r, '(?i)^N+[ATCG]{{0,10}}?N+?')) AS h, length(regexp_extract(r, '(?i)N+?[ATCG]{{0,10}}?N+$')) AS t FROM cut),
    out AS (SELECT element_id, seq_id, s + h AS "start", e - t AS "end", strand, clade, substring(r, h + 1, greatest(length(r) - h - t, 0)) AS r FROM trim)
    SELECT element_id, seq_id, "start", "end", strand, clade FROM out
    WHERE length(r) >= {LEAST_NONLTR} AND floor((length(r) - length(translate(r, 'Nn', '')))::DOUBLE / length(r) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE <= 0.3"""

FLOW_SQL = f""", {TAXONOMY_SQL},
    ltrs AS ({tree_sql("LTR_retrotransposon", LTR_WHERE, "sequences")}),
    {masked_sql("masked1", f"{PLACE} ltrs")},
    trims AS ({tree_sql("TRIM_retrotransposon", TRIM_WHERE, "masked1")}),
    ltr_tree AS ({regions_sql("SELECT * FROM ltrs UNION ALL SELECT * FROM trims", "repeat_region")}),
    ltr_parts AS ({parts_sql("ltr_tree")}),
    ltr_called AS (WITH {LTR_CALLED} SELECT * FROM called),
    ltr_fams AS (WITH RECURSIVE {LTR_CALLED} {families_sql("long_terminal_repeat")}),
    ltr_ages AS ({ages_sql("ltr_parts", "sequences", "long_terminal_repeat")}),
    {masked_sql("masked2", f"{PLACE} ltr_tree")},
    helitrons AS ({numbered_sql(clean_sql(OTHER + " = 1", "masked2"), "helitron")}),
    {masked_sql("masked3", f"{PLACE} ltr_tree UNION ALL {PLACE} helitrons")},
    tirs AS ({clean_sql(f'''{OTHER} > 1
      AND element_id NOT IN (SELECT element_id FROM doc_features WHERE type = 'protein_match' AND regexp_matches(name, '{RETRO}'))
      AND element_id NOT IN (SELECT p.element_id FROM doc_features p JOIN doc_elements e USING (element_id)
        WHERE p.type = 'terminal_inverted_repeat' AND p."start" = e."start" AND p."end" = e."end" GROUP BY p.element_id HAVING count(*) = 2)''', "masked3")}),
    tir_tree AS ({regions_sql(numbered_sql("SELECT * EXCLUDE (region_id) FROM tirs", "terminal_inverted_repeat_element"), "inverted_repeat_region")}),
    tir_parts AS ({parts_sql("tir_tree")}),
    near3 AS (SELECT * FROM masked3),
    tir_called AS (WITH {TIR_CALLED} SELECT * FROM called),
    tir_fams AS (WITH RECURSIVE {TIR_CALLED} {families_sql("terminal_inverted_repeat").replace("JOIN sequences s", "JOIN masked3 s")}),
    tir_ages AS ({ages_sql("tir_parts", "sequences", "terminal_inverted_repeat")}),
    {masked_sql("masked4", f"{PLACE} ltr_tree UNION ALL {PLACE} helitrons UNION ALL {PLACE} tirs")},
    nonltrs AS ({numbered_sql(NONLTR, "non_LTR_retrotransposon")}),
    helitron_fams AS ({PAIRED}),
    nonltr_fams AS ({SINGLES}),
    all_fams AS (SELECT * FROM ltr_fams UNION ALL SELECT * FROM helitron_fams UNION ALL SELECT * FROM tir_fams UNION ALL SELECT * FROM nonltr_fams),
    library AS ({library_sql("ltr_tree", "ltr_fams", "sequences", "RLX")} UNION ALL {library_sql("helitrons", "helitron_fams", "sequences", "DHX")}
      UNION ALL {library_sql("tir_tree", "tir_fams", "masked3", "DTX")} UNION ALL {library_sql("nonltrs", "nonltr_fams", "masked4", "RIX")}),
    final_hits AS (SELECT subject AS seq_id, s_start AS "start", s_end AS "end", left(query, 3) AS code FROM doc_hits
      WHERE identity >= 80 AND length >= 70 AND left(query, 3) IN {FINAL}),
    {masked_sql("final_text", f"{PLACE} final_hits")},
    left_hits AS ({clean_sql('SELECT *, subject AS seq_id, s_start AS "start", s_end AS "end" FROM doc_hits', "final_text")}),
    fragments AS (WITH RECURSIVE {FRAGMENTS_SQL.replace("FROM doc_hits", "FROM left_hits").lstrip(", ")} SELECT * FROM named),
    solo_left AS ({clean_sql('SELECT *, subject AS seq_id, s_start AS "start", s_end AS "end" FROM doc_hits', "masked1")}),
    solos AS (WITH thin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, s_start ORDER BY s_end - s_start DESC, identity DESC, query, bits DESC) AS rn
        FROM solo_left WHERE identity >= 80 AND length >= 80) WHERE rn = 1),
      seen AS (SELECT *, lag(s_end) OVER (PARTITION BY subject ORDER BY s_start) AS before FROM thin)
      SELECT subject AS seq_id, s_start AS "start", s_end AS "end", query,
        'solo_LTR' || row_number() OVER (ORDER BY CAST(substring(subject, 4) AS BIGINT), s_start, s_end) AS id FROM seen WHERE before IS NULL OR s_start > before),
    renamed AS (SELECT *, CASE WHEN type IN ('LARD', 'MITE') THEN type || regexp_extract(element_id, '([0-9]+)$', 1) ELSE element_id END AS new_id
      FROM (SELECT element_id, region_id, seq_id, "start", "end", strand, type FROM ltr_called UNION ALL SELECT element_id, region_id, seq_id, "start", "end", strand, type FROM tir_called)),
    own_parts AS (SELECT * FROM ltr_parts WHERE type <> 'protein_match' OR NOT regexp_matches(name, '{TNP}')
      UNION ALL SELECT * FROM tir_parts WHERE type <> 'protein_match' OR regexp_matches(name, '{TNP}')),
    features AS (
      SELECT r.seq_id, type, "start", "end", strand, new_id AS id, region_id AS parent, f.family, NULL AS name FROM renamed r JOIN all_fams f ON r.element_id = f.element_id
      UNION ALL SELECT seq_id, 'repeat_region', "start", "end", strand, region_id, NULL, NULL, NULL FROM renamed
      UNION ALL SELECT p.seq_id, p.type, p."start", p."end", p.strand, NULL, CASE WHEN p.type = 'target_site_duplication' THEN p.region_id ELSE r.new_id END, NULL,
        CASE WHEN p.type = 'protein_match' THEN name END FROM own_parts p JOIN renamed r ON p.element_id = r.element_id
      UNION ALL SELECT seq_id, 'helitron', "start", "end", strand, h.element_id, NULL, family, NULL FROM helitrons h JOIN helitron_fams f ON h.element_id = f.element_id
      UNION ALL SELECT seq_id, 'non_LTR_retrotransposon', "start", "end", strand, h.element_id, NULL, family, NULL FROM nonltrs h JOIN nonltr_fams f ON h.element_id = f.element_id
      UNION ALL SELECT seq_id, 'solo_LTR', "start", "end", '?', id, NULL, NULL, NULL FROM solos
      UNION ALL SELECT seq_id, 'similarity', "start", "end", strand, id, NULL, NULL, NULL FROM fragments),
    aged AS (SELECT a.*, 'LTR_retrotransposon' AS type, code || '_' || family AS family FROM ltr_ages a JOIN ({coded("ltr_fams", "RLX")}) f ON a.element_id = f.element_id
      UNION ALL SELECT a.*, 'terminal_inverted_repeat_element', code || '_' || family FROM tir_ages a JOIN ({coded("tir_fams", "DTX")}) f ON a.element_id = f.element_id),
    family_sizes AS (SELECT 'LTR_retrotransposon' AS type, code || '_' || family AS family, count(*) AS family_size FROM ({coded("ltr_fams", "RLX")}) GROUP BY ALL
      UNION ALL SELECT 'terminal_inverted_repeat_element', code || '_' || family, count(*) FROM ({coded("tir_fams", "DTX")}) GROUP BY ALL)
"""


def flow_query(name: str, body: str):
    return query(name, VIEWS, natural(FLOW_SQL + body), recursive=True)


PLACES = ["element_id", "seq_id", "start", "end"]
PLACES_SQL = 'element_id, seq_id, "start", "end"'


@flow_query(
    "C14_annotate_genome",
    """, f AS (SELECT superfamily, family, count(*) AS n FROM all_fams GROUP BY ALL)
    SELECT superfamily, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS families, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS elements_in_families,
      CAST(sum(CASE WHEN n > 1 THEN 0 ELSE n END) AS BIGINT) AS singletons, CAST(sum(n) AS BIGINT) AS elements FROM f GROUP BY superfamily""",
)
def _(spark, sf):
    return whole_flow(spark, sf)["family_counts"]


@flow_query("C14_ltr_elements", 'SELECT old_id AS element_id, seq_id, "start", "end" FROM ltrs')
def _(spark, sf):
    return whole_flow(spark, sf)["ltr_elements"].select(F.col("old_id").alias("element_id"), "seq_id", "start", "end")


@flow_query("C14_trim_elements", f"SELECT old_id, {PLACES_SQL} FROM trims")
def _(spark, sf):
    return whole_flow(spark, sf)["trim_elements"].select("old_id", *PLACES)


@flow_query(
    "C14_trim_library",
    """SELECT name, md5(residues) AS digest FROM library WHERE name LIKE '%_TRIM_retrotransposon%'""",
)
def _(spark, sf):
    return whole_flow(spark, sf)["trim_library"].select("name", F.md5("residues").alias("digest"))


@flow_query("C14_ltr_ages", "SELECT element_id, identity, divergence, age FROM ltr_ages")
def _(spark, sf):
    t = whole_flow(spark, sf)["ltr_ages"]
    return t.select("element_id", "identity", F.round("divergence", 6).alias("divergence"), F.round("age", 0).alias("age"))


@flow_query("C14_solo_repeats", 'SELECT seq_id, "start", "end", query, id FROM solos')
def _(spark, sf):
    return whole_flow(spark, sf)["solo_repeats"].select("seq_id", "start", "end", "query", "id")


@flow_query("C14_helitrons", f"SELECT pred AS old_id, {PLACES_SQL}, family FROM helitrons JOIN helitron_fams USING (element_id)")
def _(spark, sf):
    flow = whole_flow(spark, sf)
    return flow["helitrons"].join(flow["helitron_families"], "element_id").select("old_id", *PLACES, "family")


@flow_query("C14_tir_elements", f"SELECT {PLACES_SQL} FROM tirs")
def _(spark, sf):
    return whole_flow(spark, sf)["tir_elements"].select(*PLACES)


@flow_query("C14_nonltrs", f"SELECT pred AS old_id, {PLACES_SQL}, strand, clade FROM nonltrs")
def _(spark, sf):
    return whole_flow(spark, sf)["nonltrs"].select("old_id", *PLACES, "strand", "clade")


@flow_query("C14_library", "SELECT name, md5(residues) AS digest FROM library UNION ALL SELECT id, md5(CASE WHEN strand = '-' THEN translate(reverse(r), 'ACGTacgt', 'TGCAtgca') ELSE r END) "
            """FROM (SELECT id, strand, substring(residues, "start", "end" - "start" + 1) AS r FROM fragments JOIN sequences USING (seq_id) WHERE "start" <= length(residues))""")  # fmt: skip
def _(spark, sf):
    return whole_flow(spark, sf)["full_library"].select("name", F.md5("residues").alias("digest"))


@flow_query(
    "C14_coverage",
    ", intervals AS (SELECT * FROM final_hits)"
    + MERGE_SQL.format(gap=0)
    + """, genome AS (SELECT sum(length(residues)) AS total FROM sequences),
    named AS (SELECT coalesce(class, 'Unknown') AS class, coalesce("order", 'Unknown') AS ord, coalesce(repeat_name, 'Unknown') AS rn,
        "end" - "start" + 1 AS bases FROM merged m LEFT JOIN taxonomy t ON m.code = t.code),
    rolled AS (SELECT class, ord, rn, CAST(sum(bases) AS BIGINT) AS bases FROM named GROUP BY ROLLUP (class, ord, rn))
    SELECT coalesce(class, 'total') AS class, coalesce(ord, 'all') AS "order", coalesce(rn, 'all') AS repeat_name, bases,
      floor(100.0::DOUBLE * bases / (SELECT total FROM genome) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS percent FROM rolled""",
)
def _(spark, sf):
    return whole_flow(spark, sf)["coverage"]


@flow_query("C14_masked", "SELECT seq_id, md5(residues) AS digest FROM final_text")
def _(spark, sf):
    from loci.operators.sequences import stitch

    return stitch(whole_flow(spark, sf)["masked"]).select("seq_id", F.md5("residues").alias("digest"))


@flow_query("C14_fragments", 'SELECT seq_id, "start", "end", id FROM fragments JOIN sequences USING (seq_id) WHERE "start" <= length(residues)')
def _(spark, sf):
    return whole_flow(spark, sf)["fragments"].select("seq_id", "start", "end", "id")


@flow_query("C14_features", """SELECT seq_id, type, "start", "end", coalesce(strand, '?') AS strand, id, parent, family, name FROM features""")
def _(spark, sf):
    one = lambda k: F.try_element_at(F.try_element_at("attributes", F.lit(k)), F.lit(1))
    names = {"id": "ID", "parent": "Parent", "family": "family", "name": "name"}
    return whole_flow(spark, sf)["features"].select("seq_id", "type", "start", "end", "strand", *[one(k).alias(c) for c, k in names.items()])


@flow_query(
    "C14_age_table",
    """SELECT element_id, type, a.family, family_size, divergence, age FROM aged a JOIN family_sizes USING (type, family)""",
)
def _(spark, sf):
    t = whole_flow(spark, sf)["ages"]
    return t.select("element_id", "type", "family", "family_size", F.round("divergence", 6).alias("divergence"), F.round("age", 0).alias("age"))
