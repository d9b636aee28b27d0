"""Queries over families, clusters, similar pairs and state paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci.operators import families as fam
from loci.operators import similarity as sim
from loci.operators.ordering import unique_names
from loci.operators.paths import segment_states
from loci.operators.sequences import windows
from loci.schema import taxonomy

from . import views as v
from .q_hierarchy import MERGED_DOMAINS_SQL
from .q_hits import COMPATIBLE_SQL, labelled
from .q_intervals import TAXONOMY_SQL
from .registry import query


@query(
    "A8_family_counts",
    ["members"],
    """, f AS (SELECT superfamily, family, count(*) AS n FROM members GROUP BY ALL)
    SELECT superfamily, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS families, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS elements_in_families,
      CAST(sum(CASE WHEN n > 1 THEN 0 ELSE n END) AS BIGINT) AS singletons, CAST(sum(n) AS BIGINT) AS elements FROM f GROUP BY superfamily""",
)
def _(spark, sf):
    return fam.family_counts(v.members(spark, sf))


PAIR_HITS_SQL = """, pair_hits AS (SELECT 's' || a.l_partkey AS query, 's' || b.l_partkey AS subject, round(100.0 - a.l_discount*500.0) AS identity,
      CAST(b.l_quantity AS BIGINT)*4 AS length FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey)
"""


def pair_hits(spark, sf):
    """Hits between parts: line items of one order hit each other."""
    li = v.table(spark, sf, "lineitem")
    a = li.select("l_orderkey", F.concat(F.lit("s"), "l_partkey").alias("query"), F.round(F.lit(100.0) - F.col("l_discount") * 500.0, 0).alias("identity"))
    b = li.select("l_orderkey", F.concat(F.lit("s"), "l_partkey").alias("subject"), (F.col("l_quantity").cast("bigint") * 4).alias("length"))
    return a.join(b, "l_orderkey").drop("l_orderkey")


SIMILARITY_SQL = (
    PAIR_HITS_SQL
    + """, inner_hits AS (SELECT m.family, h.* FROM pair_hits h JOIN members m ON h.query = m.element_id JOIN members n ON h.subject = n.element_id
        WHERE m.family = n.family AND h.length >= 80),
    means AS (SELECT family, sum(identity) / count(*) AS i, sum(length)::DOUBLE / count(*) AS l FROM inner_hits GROUP BY family),
    seen AS (SELECT family, count(DISTINCT e) AS c FROM (SELECT family, query AS e FROM inner_hits UNION ALL SELECT family, subject FROM inner_hits) GROUP BY family),
    sizes AS (SELECT family, count(*) AS n, sum(length)::DOUBLE / count(*) AS l FROM members GROUP BY family HAVING count(*) > 1)
    SELECT family, n AS family_size, c AS family_count_analyzed, floor(i * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS similarity_mean,
      floor(means.l * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS hit_length_mean, floor(sizes.l * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS element_length_mean
    FROM sizes JOIN means USING (family) JOIN seen USING (family)"""
)


@query("A9_family_similarity", ["members"], SIMILARITY_SQL)
def _(spark, sf):
    return fam.family_similarity(pair_hits(spark, sf), v.members(spark, sf))


@query(
    "A16_drop_small_groups",
    ["parts"],
    """SELECT part_id FROM parts JOIN (SELECT element_id, type FROM parts GROUP BY ALL HAVING count(*) >= 2) USING (element_id, type)""",
)
def _(spark, sf):
    return fam.drop_small_groups(v.parts(spark, sf), ["element_id", "type"]).select("part_id")


@query("A16_group_sizes", ["parts"], "SELECT type, name, count(*) AS n FROM parts GROUP BY ALL")
def _(spark, sf):
    return fam.group_sizes(v.parts(spark, sf), ["type", "name"])


@query(
    "P19_cap_families",
    ["members"],
    """SELECT element_id, family FROM members WHERE family IN (SELECT family FROM members GROUP BY family
    HAVING count(*) <= (SELECT count(*) / count(DISTINCT family) FROM members) AND max(length) <= 15000)""",
)
def _(spark, sf):
    """Families of average size at most: the bound follows the table, so it parts the families at every scale."""
    members = v.members(spark, sf)
    mean = members.agg(F.count("*") / F.count_distinct("family")).scalar()
    return fam.cap_families(members, mean, 15_000).select("element_id", "family")


SIGNATURES_SQL = """, smallest AS (SELECT element_id, part, min(cluster_id) AS c FROM cluster_members GROUP BY ALL),
    signed AS (SELECT element_id, coalesce(max(CASE WHEN part = 'full' THEN c::VARCHAR END), 'N') || '|' || coalesce(max(CASE WHEN part = 'ltr' THEN c::VARCHAR END), 'N')
        || '|' || coalesce(max(CASE WHEN part = 'rvt' THEN c::VARCHAR END), 'N') AS signature FROM smallest GROUP BY element_id),
    sizes AS (SELECT signature, count(*) AS family_size, arg_min(element_id, CAST(substring(element_id, 2) AS BIGINT)) AS family_key FROM signed GROUP BY signature),
    fams AS (SELECT element_id, signature, family_size, family_key, family_size = 1 AS is_singleton FROM signed JOIN sizes USING (signature))
"""


@query("G3_signature_families", ["cluster_members"], SIGNATURES_SQL + "SELECT * FROM fams")
def signature_families(spark, sf):
    return fam.signature_families(v.cluster_members(spark, sf), ["full", "ltr", "rvt"])


@query(
    "W12_number_families",
    ["cluster_members", "members"],
    SIGNATURES_SQL
    + """, per AS (SELECT superfamily, family_key, count(*) AS family_size, min(CAST(substring(element_id, 2) AS BIGINT)) AS k
        FROM fams JOIN members USING (element_id) GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY superfamily, family_size = 1 ORDER BY family_size DESC, k) - 1 AS family_no FROM per)
    SELECT superfamily, family_key, family_size, family_size = 1 AS is_singleton, family_no,
      CASE WHEN family_size = 1 THEN 'singleton_family' ELSE 'family' END || family_no AS family FROM numbered""",
)
def _(spark, sf):
    t = signature_families(spark, sf).join(v.members(spark, sf).select("element_id", "superfamily"), "element_id")
    return fam.number_families(t)


@query(
    "W14_top_families",
    ["members"],
    """, top AS (SELECT family FROM members GROUP BY family ORDER BY count(*) DESC, CAST(replace(family, 'RLG_family', '') AS BIGINT) LIMIT 20)
    SELECT element_id, family FROM members WHERE family IN (SELECT family FROM top)""",
)
def _(spark, sf):
    return fam.top_families(v.members(spark, sf), 20).select("element_id", "family")


@query(
    "G4_recruit",
    ["norm_hits", "query_superfamilies", "subject_superfamilies", "query_lengths", "subject_lengths", "members"],
    f""", usable AS (SELECT h.*, m.family FROM norm_hits h JOIN query_superfamilies USING (query) JOIN subject_superfamilies USING (subject)
        JOIN query_lengths q ON h.query = q.id JOIN subject_lengths s ON h.subject = s.id JOIN members m ON h.subject = m.element_id
        WHERE identity >= 80 AND h.length >= 80 AND h.length >= least(q.length, s.length) * 0.5 AND ({COMPATIBLE_SQL}))
    SELECT query AS element_id, family, subject, bits FROM (SELECT *, row_number() OVER (PARTITION BY query
      ORDER BY bits DESC, identity DESC, length DESC, subject, s_start, s_end) AS rn FROM usable) WHERE rn = 1""",
)
def _(spark, sf):
    lengths = v.query_lengths(spark, sf).unionByName(v.subject_lengths(spark, sf))
    singles = v.query_lengths(spark, sf).select(F.col("id").alias("element_id"))
    return fam.recruit(singles, v.members(spark, sf), labelled(spark, sf), lengths)


@query(
    "J10_age_summary",
    ["members"],
    f""", {TAXONOMY_SQL}, ages AS (SELECT m.element_id, m.superfamily AS type, m.family, p.p_retailprice / 10000 AS divergence, p.p_retailprice * 1000 AS age
        FROM members m JOIN part p ON m.element_id = 's' || p.p_partkey),
    sizes AS (SELECT superfamily AS type, family, count(*) AS family_size FROM members GROUP BY ALL)
    SELECT a.*, family_size, coalesce(t.superfamily, 'Unknown') AS superfamily FROM ages a JOIN sizes USING (type, family)
    LEFT JOIN taxonomy t ON regexp_extract(family, '^([A-Z]{{3}})_?', 1) = t.code""",
)
def _(spark, sf):
    m = v.members(spark, sf).select("element_id", F.col("superfamily").alias("type"), "family")
    prices = v.table(spark, sf, "part").select(F.concat(F.lit("s"), "p_partkey").alias("element_id"), "p_retailprice")
    ages = m.join(prices, "element_id").select(
        "element_id", "type", "family", (F.col("p_retailprice") / 10000).alias("divergence"), (F.col("p_retailprice") * 1000).alias("age")
    )
    return fam.age_summary(ages, m, taxonomy(spark))


@query(
    "J11_annotate_families",
    ["elements"],
    """SELECT element_id, CASE WHEN o_orderstatus <> 'P' THEN replace(o_orderpriority, ' ', '_') END AS family
    FROM elements JOIN orders ON orderkey = o_orderkey""",
)
def _(spark, sf):
    t = v.elements(spark, sf).withColumn("attributes", F.create_map(F.lit("ID"), F.array("element_id")))
    out = fam.annotate_families(t, order_families(spark, sf))
    return out.select("element_id", F.try_element_at("attributes", F.lit("family"))[0].alias("family"))


def order_families(spark, sf):
    """Families by priority; orders still in process have none."""
    o = v.table(spark, sf, "orders").where(F.col("o_orderstatus") != "P")
    return o.select(
        F.concat(F.lit("element"), "o_orderkey").alias("element_id"),
        F.replace("o_orderpriority", F.lit(" "), F.lit("_")).alias("family"),
        F.col("o_orderstatus").alias("superfamily"),
    )


@query(
    "J12_library_labels",
    [],
    """SELECT regexp_replace(p_name, '\\s+', '_', 'g') AS name, min(p_type) AS superfamily FROM part GROUP BY 1""",
)
def _(spark, sf):
    p = v.table(spark, sf, "part")
    return fam.library_labels(p.select(F.concat_ws("\t", "p_name", "p_type", "p_brand").alias("header")))


REPEATS_SQL = """, ends AS (SELECT *, count(*) OVER (PARTITION BY element_id) AS n FROM parts WHERE type = 'long_terminal_repeat'),
    fams AS (SELECT 'element' || o_orderkey AS element_id, replace(o_orderpriority, ' ', '_') AS family, o_orderstatus AS superfamily FROM orders WHERE o_orderstatus <> 'P'),
    ex AS (SELECT DISTINCT e.element_id FROM parts e JOIN orders o ON e.element_id = 'element' || o_orderkey WHERE type = 'primer_binding_site' AND o_orderstatus = 'F'),
    covered AS (SELECT DISTINCT superfamily FROM fams JOIN ex USING (element_id)),
    named AS (SELECT e.element_id, e."start", e."end", coalesce(family, 'Unclassified') AS family, coalesce(superfamily, 'Unclassified') AS superfamily
      FROM ends e LEFT JOIN fams f ON e.element_id = f.element_id WHERE n = 2)
"""


def repeats_and_exemplars(spark, sf):
    from loci.operators.hierarchy import label_ends

    p = v.parts(spark, sf)
    finished = order_families(spark, sf).where(F.col("superfamily") == "F").select("element_id")
    exemplars = p.where(F.col("type") == "primer_binding_site").join(finished, "element_id", "left_semi")
    return label_ends(p), exemplars


@query(
    "J13_select_repeats",
    ["parts"],
    REPEATS_SQL
    + """SELECT element_id, "start", "end", family FROM named WHERE element_id IN (SELECT element_id FROM ex) OR superfamily NOT IN (SELECT superfamily FROM covered)""",
)
def _(spark, sf):
    repeats, exemplars = repeats_and_exemplars(spark, sf)
    return fam.select_repeats(repeats, exemplars, order_families(spark, sf)).select("element_id", "start", "end", "family")


@query("J13_select_repeats_all", ["parts"], REPEATS_SQL + """SELECT element_id, "start", "end", family FROM named""")
def _(spark, sf):
    repeats, exemplars = repeats_and_exemplars(spark, sf)
    return fam.select_repeats(repeats, exemplars, order_families(spark, sf), all_elements=True).select(
        "element_id", "start", "end", "family"
    )


@query(
    "G6_element_parts",
    ["elements", "parts"],
    MERGED_DOMAINS_SQL
    + """, ends AS (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY "start", "end", strand) AS rn,
        count(*) OVER (PARTITION BY element_id) AS n FROM parts WHERE type = 'long_terminal_repeat')
    SELECT 'full' AS part, seq_id, element_id, "start", "end" FROM elements
    UNION ALL SELECT CASE WHEN strand = '+' THEN CASE WHEN rn = 1 THEN '5prime' ELSE '3prime' END WHEN strand = '-' THEN CASE WHEN rn = 1 THEN '3prime' ELSE '5prime' END
      ELSE CASE WHEN rn = 1 THEN 'unk-prime-f' ELSE 'unk-prime-r' END END, seq_id, element_id, "start", "end" FROM ends WHERE n = 2
    UNION ALL SELECT type, seq_id, element_id, "start", "end" FROM parts WHERE type IN ('primer_binding_site', 'RR_tract')
    UNION ALL SELECT name, seq_id, element_id, "start", "end" FROM md""",
)
def _(spark, sf):
    return fam.element_parts(v.elements(spark, sf), v.parts(spark, sf))


DOC_PARTS_SQL = """, doc_parts AS (SELECT 'doc' || (orderkey % (SELECT count(*) FROM documents)) AS seq_id, p.element_id, p.type, p.name,
      p."start" - e."start" + 1 AS "start", p."end" - e."start" + 1 AS "end" FROM parts p JOIN elements e USING (element_id))
"""


def doc_parts(spark, sf):
    """Parts moved to the document of their element, counted from its first letter."""
    n = v.table(spark, sf, "documents").agg(F.count("*")).scalar()
    e = v.elements(spark, sf).select("element_id", "orderkey", F.col("start").alias("es"))
    return v.parts(spark, sf).drop("seq_id").join(e, "element_id").select(
        F.concat(F.lit("doc"), F.col("orderkey") % n).alias("seq_id"),
        "element_id",
        "type",
        "name",
        (F.col("start") - F.col("es") + 1).alias("start"),
        (F.col("end") - F.col("es") + 1).alias("end"),
    )


@query(
    "G7_concat_domains",
    ["parts", "elements", "sequences"],
    DOC_PARTS_SQL
    + MERGED_DOMAINS_SQL.replace("FROM parts WHERE", "FROM doc_parts WHERE")
    + """SELECT md.seq_id, element_id, name, string_agg(substring(residues, "start", "end" - "start" + 1), '' ORDER BY "start") AS residues, count(*) AS ranges
    FROM md JOIN sequences s ON md.seq_id = s.seq_id WHERE "start" <= length(residues) GROUP BY ALL""",
)
def _(spark, sf):
    return fam.concat_domains(doc_parts(spark, sf), windows(v.sequences(spark, sf), 1000, 50), size=1000)


K, SHARE = 16, 0.5

PAIRS_SQL = f""", texts AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text),
    sets AS (SELECT id, unnest(list_distinct(flatten(list_transform(range(1, {K + 1}), lambda ph: regexp_extract_all(substring(text, ph), '(?s).{{{K}}}'))))) AS kmer FROM texts),
    sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY id),
    common AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.kmer = b.kmer AND a.id < b.id GROUP BY ALL),
    pairs AS (SELECT a, b, shared, shared::DOUBLE / (x.n + y.n - shared) AS share FROM common JOIN sizes x ON a = x.id JOIN sizes y ON b = y.id
      WHERE shared::DOUBLE / (x.n + y.n - shared) >= {SHARE})
"""


def texts(spark, sf):
    return v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("residues"))


@query("G1_similar_pairs", ["sequences"], PAIRS_SQL + "SELECT a, b, shared, share FROM pairs")
def _(spark, sf):
    return sim.similar_pairs(texts(spark, sf), K, SHARE)


@query(
    "G1_copies",
    [],
    "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS representative FROM documents",
)
def _(spark, sf):
    return sim.copies(texts(spark, sf))


@query(
    "G2_cluster_sequences",
    ["sequences"],
    PAIRS_SQL
    + """, links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
        UNION ALL SELECT id, doc_id FROM documents JOIN texts USING (text) UNION ALL SELECT doc_id, id FROM documents JOIN texts USING (text)),
    reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a)
    SELECT id, min(other) AS cluster FROM reach GROUP BY id""",
    recursive=True,
)
def _(spark, sf):
    return sim.cluster_sequences(texts(spark, sf), K, SHARE)


@query(
    "G8_repeat_pairs",
    ["sequences"],
    """, cut AS (SELECT seq_id, ph, unnest(regexp_extract_all(substring(residues, ph), '(?s).{20}')) AS s,
        generate_subscripts(regexp_extract_all(substring(residues, ph), '(?s).{20}'), 1) AS j FROM sequences, (SELECT unnest(range(1, 21)) AS ph)),
    seeds AS (SELECT seq_id, ph + (j - 1) * 20 AS x, s FROM cut),
    met AS (SELECT a.seq_id, b.x - a.x AS d, a.x FROM seeds a JOIN seeds b ON a.seq_id = b.seq_id AND a.s = b.s AND b.x - a.x BETWEEN 30 AND 4000),
    grouped AS (SELECT *, x - row_number() OVER (PARTITION BY seq_id, d ORDER BY x) AS g FROM met),
    runs AS (SELECT seq_id, d, min(x) AS s, max(x) AS e FROM grouped GROUP BY seq_id, d, g)
    SELECT seq_id, s AS left_start, e + 19 AS left_end, s + d AS right_start, e + d + 19 AS right_end, e - s + 20 AS length FROM runs WHERE e - s + 20 >= 30""",
)
def _(spark, sf):
    chunks = windows(v.sequences(spark, sf), 1000, 50)
    return sim.repeat_pairs(chunks, k=20, min_dist=30, max_dist=4000, min_length=30)


@query(
    "G8_repeat_pairs_inverted",
    ["sequences"],
    """, cut AS (SELECT seq_id, ph, unnest(regexp_extract_all(substring(residues, ph), '(?s).{6}')) AS s,
        generate_subscripts(regexp_extract_all(substring(residues, ph), '(?s).{6}'), 1) AS j FROM sequences, (SELECT unnest(range(1, 7)) AS ph)),
    seeds AS (SELECT seq_id, ph + (j - 1) * 6 AS x, s FROM cut),
    met AS (SELECT a.seq_id, a.x + b.x AS d, a.x FROM seeds a JOIN seeds b ON a.seq_id = b.seq_id
        AND a.s = translate(reverse(b.s), 'ACGTacgt', 'TGCAtgca') AND b.x - a.x BETWEEN 10 AND 300),
    grouped AS (SELECT *, x - row_number() OVER (PARTITION BY seq_id, d ORDER BY x) AS g FROM met),
    runs AS (SELECT seq_id, d, min(x) AS s, max(x) AS e FROM grouped GROUP BY seq_id, d, g)
    SELECT seq_id, s AS left_start, e + 5 AS left_end, d - e AS right_start, d - s + 5 AS right_end, e - s + 6 AS length FROM runs WHERE e - s + 6 >= 6""",
)
def _(spark, sf):
    chunks = windows(v.sequences(spark, sf), 1000, 50)
    return sim.repeat_pairs(chunks, k=6, min_dist=10, max_dist=300, inverted=True, min_length=6)


@query(
    "W8_state_segments",
    ["state_path"],
    """, marked AS (SELECT *, max(CASE WHEN state = 0 THEN position END) OVER (PARTITION BY seq_id ORDER BY position
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block FROM state_path),
    nz AS (SELECT * FROM marked WHERE state <> 0 AND block IS NOT NULL),
    chain(seq_id, block, first, p, s, k) AS (
      SELECT seq_id, block, max(position), max(position), arg_max(state, position), 1 FROM nz GROUP BY seq_id, block
      UNION ALL
      SELECT c.seq_id, c.block, c.first, max(n.position), c.s - 1, c.k + 1 FROM chain c JOIN nz n
        ON n.seq_id = c.seq_id AND n.block = c.block AND n.state = c.s - 1 AND n.position < c.p GROUP BY c.seq_id, c.block, c.first, c.s, c.k),
    ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, block ORDER BY k DESC) AS rn FROM chain) WHERE rn = 1)
    SELECT seq_id, block AS "start", first AS "end", first - block AS length, CASE WHEN k = 3 OR (k = 1 AND s > 30) THEN 'full' ELSE 'fragment' END AS kind,
      CASE WHEN s <= 3 THEN 'Jockey' ELSE 'CRE' END AS clade FROM ends WHERE k = 3 OR k = 1""",
    recursive=True,
)
def _(spark, sf):
    return segment_states(v.state_path(spark, sf), tile=3_600_000_000)


@query("U4_unique_names", ["hits"], "SELECT DISTINCT query AS name FROM hits")
def _(spark, sf):
    return unique_names(v.hits(spark, sf).select(F.col("query").alias("name")), "name")


@query(
    "T3_sort_domain_hits",
    ["parts"],
    """SELECT part_id, element_id, "start", "end" FROM parts WHERE type = 'protein_match'""",
)
def _(spark, sf):
    t = v.parts(spark, sf).where(F.col("type") == "protein_match")
    return t.orderBy("element_id", "start", "end", "part_id").select("part_id", "element_id", "start", "end")
