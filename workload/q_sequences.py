"""Queries over sequences, chunks and aligned pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci.functions import format_name, reverse_complement
from loci.operators import sequences as sq
from loci.schema import codon_table

from . import views as v
from .registry import query

SIZE, PAD = 1000, 50


def chunks(spark, sf, size=SIZE, pad=PAD):
    return sq.windows(v.sequences(spark, sf), size, pad)


@query(
    "F3_windows",
    ["sequences"],
    f""", w AS (SELECT seq_id, residues, length(residues) AS len, unnest(range(0, CAST(ceil(length(residues) / {SIZE}.0) AS BIGINT))) AS chunk_no
        FROM sequences WHERE length(residues) > 0),
    b AS (SELECT *, chunk_no*{SIZE} + 1 AS core_start, least((chunk_no + 1)*{SIZE}, len) AS core_end FROM w),
    p AS (SELECT *, least({PAD}, core_start - 1) AS left_pad, least({PAD}, len - core_end) AS right_pad FROM b)
    SELECT seq_id, chunk_no, core_start, core_end, left_pad, right_pad,
      md5(substring(residues, core_start - left_pad, core_end + right_pad - core_start + left_pad + 1)) AS digest FROM p""",
)
def _(spark, sf):
    return chunks(spark, sf).withColumn("digest", F.md5("residues")).drop("residues")


@query("F4_stitch", ["sequences"], "SELECT seq_id, md5(residues) AS digest FROM sequences WHERE length(residues) > 0")
def _(spark, sf):
    return sq.stitch(chunks(spark, sf)).select("seq_id", F.md5("residues").alias("digest"))


SLICE_SQL = """, cut AS (SELECT id, d.seq_id, "start", "end", substring(residues, "start", "end" - "start" + 1) AS residues
      FROM document_spans d JOIN sequences s ON d.seq_id = s.seq_id WHERE d."start" <= length(residues))
"""


@query("J4_slice", ["document_spans", "sequences"], SLICE_SQL + "SELECT id, residues FROM cut")
def _(spark, sf):
    return sq.slice_sequences(v.document_spans(spark, sf), chunks(spark, sf), ["id"], SIZE).select("id", "residues")


@query(
    "F2_substring_whole",
    ["document_spans", "sequences"],
    SLICE_SQL + "SELECT id, length(residues) AS length FROM cut",
)
def _(spark, sf):
    return sq.slice_sequences(v.document_spans(spark, sf), chunks(spark, sf, 64, 8), ["id"], 64).select(
        "id", F.length("residues").alias("length")
    )


@query(
    "J5_unmask",
    ["document_spans", "sequences"],
    """SELECT 'RLG_family1_LTR_retrotransposon1_' || d.seq_id || '_' || "start" || '_' || "end" AS name,
      max(CASE WHEN s.seq_id IS NOT NULL AND "start" <= length(s.residues) THEN substring(s.residues, "start", "end" - "start" + 1) ELSE 'NNN' END) AS residues
    FROM document_spans d LEFT JOIN sequences s ON d.seq_id = s.seq_id GROUP BY 1""",
)
def _(spark, sf):
    named = v.document_spans(spark, sf).select("seq_id", "start", "end").distinct().select(
        "*",
        F.lit(None).cast("string").alias("side"),
        F.lit("RLG").alias("code"),
        F.lit(False).alias("is_singleton"),
        F.lit(1).alias("family_no"),
        F.lit("LTR_retrotransposon").alias("element_type"),
        F.lit(1).alias("element_no"),
    )
    library = format_name(named).select("name", F.lit("NNN").alias("residues"))
    return sq.unmask(library, chunks(spark, sf), SIZE)


@query(
    "P7_filter_sequences",
    ["sequences"],
    """SELECT seq_id, length(residues) AS length FROM sequences WHERE length(residues) >= 1000
    AND floor((length(residues) - length(translate(residues, 'Nn', '')))::DOUBLE / length(residues) * 100.0::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE <= 8.0""",
)
def _(spark, sf):
    return sq.filter_sequences(v.sequences(spark, sf), 1000, 8.0).select("seq_id", F.length("residues").alias("length"))


FRACTION_SQL = (
    SLICE_SQL
    + """, frac AS (SELECT *, length(residues) - length(translate(residues, 'Nn', '')) AS ambiguous, length(residues) AS length FROM cut),
    rounded AS (SELECT id, seq_id, "start", "end", ambiguous, length, floor(ambiguous::DOUBLE / length * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS fraction FROM frac)
"""
)


@query(
    "P8_ambiguous_fraction",
    ["document_spans", "sequences"],
    FRACTION_SQL + "SELECT id, ambiguous, length, fraction FROM rounded",
)
def _(spark, sf):
    return sq.ambiguous_fraction(v.document_spans(spark, sf), chunks(spark, sf), ["id"], SIZE).select(
        "id", "ambiguous", "length", "fraction"
    )


@query(
    "P8_filter_ambiguous",
    ["document_spans", "sequences"],
    FRACTION_SQL + "SELECT id FROM document_spans WHERE id NOT IN (SELECT id FROM rounded WHERE fraction >= 0.12)",
)
def _(spark, sf):
    return sq.filter_ambiguous(v.document_spans(spark, sf), chunks(spark, sf), ["id"], 0.12, SIZE).select("id")


@query(
    "P9_trim_terminal_gaps",
    ["sequences"],
    """, src AS (SELECT seq_id, 101 AS "start", repeat('N', length(residues) % 4) || substring(residues, 1, 4) || repeat('n', length(residues) % 3) || residues
          || repeat('N', length(residues) % 5) || 'ACGT' || repeat('N', length(residues) % 2) AS residues FROM sequences),
    cut AS (SELECT *, length(regexp_extract(residues, '(?i)^N+[ATCG]{0,10}?N+?')) AS h, length(regexp_extract(residues, '(?i)N+?[ATCG]{0,10}?N+$')) AS t FROM src),
    out AS (SELECT seq_id, "start" + h AS "start", "start" + length(residues) - 1 - t AS "end",
        substring(residues, h + 1, greatest(length(residues) - h - t, 0)) AS residues FROM cut)
    SELECT seq_id, "start", "end", md5(residues) AS digest FROM out WHERE length(residues) >= 300
      AND floor((length(residues) - length(translate(residues, 'Nn', '')))::DOUBLE / length(residues) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE <= 0.3""",
)
def _(spark, sf):
    n, r = F.length("residues"), F.col("residues")
    gapped = F.concat(
        F.repeat(F.lit("N"), n % 4), F.substring(r, 1, 4), F.repeat(F.lit("n"), n % 3), r, F.repeat(F.lit("N"), n % 5), F.lit("ACGT"), F.repeat(F.lit("N"), n % 2)
    )
    t = v.sequences(spark, sf).select("seq_id", F.lit(101).cast("bigint").alias("start"), gapped.alias("residues"))
    t = t.withColumn("end", F.col("start") + F.length("residues") - 1)
    return sq.trim_terminal_gaps(t).select("seq_id", "start", "end", F.md5("residues").alias("digest"))


@query("A7_sequence_lengths", ["sequences"], "SELECT seq_id, length(residues) AS length FROM sequences WHERE length(residues) > 0")
def _(spark, sf):
    return sq.sequence_lengths(chunks(spark, sf))


@query("A7_genome_length", ["sequences"], "SELECT count(*) AS sequences, CAST(sum(length(residues)) AS BIGINT) AS genome_length FROM sequences")
def _(spark, sf):
    return sq.genome_length(sq.sequence_lengths(v.sequences(spark, sf)))


@query(
    "F1_reverse_complement",
    ["sequences"],
    "SELECT seq_id, md5(translate(reverse(residues), 'ACGTacgt', 'TGCAtgca')) AS digest FROM sequences",
)
def _(spark, sf):
    return v.sequences(spark, sf).select("seq_id", F.md5(reverse_complement("residues")).alias("digest"))


@query(
    "F5_mask_intervals",
    ["document_spans", "sequences"],
    """, letters AS (SELECT seq_id, unnest(string_split(residues, '')) AS letter, generate_subscripts(string_split(residues, ''), 1) AS pos FROM sequences),
    covered AS (SELECT DISTINCT seq_id, unnest(range("start", "end" + 1)) AS pos FROM document_spans)
    SELECT l.seq_id, md5(string_agg(CASE WHEN c.pos IS NULL THEN letter ELSE 'N' END, '' ORDER BY l.pos)) AS digest
    FROM letters l LEFT JOIN covered c ON l.seq_id = c.seq_id AND l.pos = c.pos GROUP BY l.seq_id""",
)
def _(spark, sf):
    masked = sq.mask_intervals(chunks(spark, sf), v.document_spans(spark, sf), SIZE)
    return sq.stitch(masked).select("seq_id", F.md5("residues").alias("digest"))


CODONS_SQL = "MAP {" + ", ".join(f"'{c}': '{p}'" for c, p in codon_table().items()) + "}"


@query(
    "F6_translate_frames",
    ["sequences"],
    f""", strands AS (SELECT seq_id, translate(residues, 'acgt', 'ACGT') AS f, translate(translate(reverse(residues), 'ACGTacgt', 'TGCAtgca'), 'acgt', 'ACGT') AS r FROM sequences),
    frames AS (SELECT seq_id, frame, substring(CASE WHEN frame > 0 THEN f ELSE r END, abs(frame)) AS s FROM strands, (VALUES (1), (2), (3), (-1), (-2), (-3)) v(frame))
    SELECT seq_id, frame, md5(array_to_string(list_transform(regexp_extract_all(s, '(?s)...'), lambda c: coalesce({CODONS_SQL}[c], 'X')), '')) AS digest,
      (length(s) // 3) AS length FROM frames""",
)
def _(spark, sf):
    t = sq.translate_frames(v.sequences(spark, sf))
    return t.select("seq_id", "frame", F.md5("peptide").alias("digest"), F.length("peptide").alias("length"))


RUNS_SQL = """, letters AS (SELECT seq_id, unnest(string_split(residues, '')) AS letter, generate_subscripts(string_split(residues, ''), 1) AS pos FROM sequences),
    gaps AS (SELECT seq_id, pos, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM letters WHERE letter = '{gap}'),
    runs AS (SELECT seq_id, count(*) AS run_length, min(pos) AS "start", max(pos) AS "end" FROM gaps GROUP BY seq_id, g)
"""


@query("W17_gap_runs", ["sequences"], RUNS_SQL.format(gap="e") + 'SELECT seq_id, run_length, "start", "end" FROM runs')
def _(spark, sf):
    return sq.gap_runs(v.sequences(spark, sf), gap="e")


GAP_STATS_SQL = (
    RUNS_SQL.format(gap="e")
    + """, stats AS (SELECT seq_id, CAST(sum(run_length) AS BIGINT) AS gap_letters, count(*) AS gap_runs, min(run_length) AS min_run, max(run_length) AS max_run FROM runs GROUP BY seq_id),
    full_stats AS (SELECT seq_id, gap_letters, gap_runs, floor(gap_letters::DOUBLE / length(residues) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS gap_share,
      floor(gap_letters::DOUBLE / gap_runs * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS mean_run, min_run, max_run, gap_letters AS sum_run FROM stats JOIN sequences USING (seq_id))
"""
)


@query("A11_gap_stats", ["sequences"], GAP_STATS_SQL + "SELECT * FROM full_stats")
def gap_stats(spark, sf):
    t = v.sequences(spark, sf)
    return sq.gap_stats(sq.gap_runs(t, gap="e"), sq.sequence_lengths(t))


GAP_MEASURES = ["gap_letters", "gap_runs", "gap_share", "mean_run", "min_run", "max_run"]


@query(
    "A12_gap_stats_by_family",
    ["sequences"],
    GAP_STATS_SQL
    + """, fam AS (SELECT 'doc' || doc_id AS seq_id, lang || '_' || source AS family FROM documents)
    SELECT family, count(*) AS members, CAST(sum(sum_run) AS BIGINT) AS total_gap_length, """
    + ", ".join(f"round(avg({m}) + 1e-9, 4) AS {m}_mean, round(stddev_samp({m}) + 1e-9, 4) AS {m}_sd" for m in GAP_MEASURES)
    + " FROM full_stats JOIN fam USING (seq_id) GROUP BY family",
)
def _(spark, sf):
    fam = v.table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("seq_id"), F.concat_ws("_", "lang", "source").alias("family")
    )
    t = sq.gap_stats_by_family(gap_stats(spark, sf).join(fam, "seq_id"))
    rounded = [F.round(F.col(f"{m}_{s}") + 1e-9, 4).alias(f"{m}_{s}") for m in GAP_MEASURES for s in ("mean", "sd")]
    return t.select("family", "members", "total_gap_length", *rounded)


FLANK_REPEATS_SQL = (
    RUNS_SQL.format(gap="e")
    + """, flank AS (SELECT r.*, substring(s.residues, r."start" - 20, 20) AS up, substring(s.residues, r."end" + 1, 20) AS down
      FROM runs r JOIN sequences s USING (seq_id) WHERE run_length >= 2 AND r."start" - 20 >= 1 AND r."end" + 20 <= length(s.residues)),
    cand AS (SELECT f.*, n, off, pos, substring(up, 21 - off - n, n) AS u, substring(down, pos, n) AS d FROM flank f,
      (SELECT unnest(range(3, 21)) AS n), (SELECT unnest([0, 1, 2]) AS off), (SELECT unnest([1, 2]) AS pos) WHERE 21 - off - n >= 1 AND pos + n - 1 <= 20),
    good AS (SELECT *, row_number() OVER (PARTITION BY seq_id, "start" ORDER BY n DESC, off, pos) AS rn FROM cand WHERE u = d AND NOT contains(u, 'e'))
    , flank_repeats AS (SELECT seq_id, run_length, "start", "end", u AS repeat, n AS repeat_length, off AS before_gap, pos AS after_gap FROM good WHERE rn = 1)
"""
)


@query("F8_flank_repeats", ["sequences"], FLANK_REPEATS_SQL + "SELECT * FROM flank_repeats")
def _(spark, sf):
    return sq.flank_repeats(v.sequences(spark, sf), gap="e", min_gap=2)


@query(
    "A15_pair_identity",
    ["aligned_pairs"],
    """, cols AS (SELECT pair_id, unnest(string_split("left", '')) AS a, unnest(string_split("right", '')) AS b FROM aligned_pairs WHERE length("left") > 0),
    sums AS (SELECT pair_id, count(*) AS "columns", CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS equal FROM cols GROUP BY pair_id)
    SELECT pair_id, "columns", equal, floor(100.0::DOUBLE * equal / "columns" * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS identity,
      floor((100.0::DOUBLE - 100.0::DOUBLE * equal / "columns") * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS divergence FROM sums""",
)
def _(spark, sf):
    return sq.pair_identity(v.aligned_pairs(spark, sf)).drop("left", "right")


@query(
    "A15_match_identity",
    ["aligned_pairs"],
    """, sized AS (SELECT pair_id, "left", "right", length("left") AS n, 1 + length("left") // 3 AS s FROM aligned_pairs),
    cols AS (SELECT pair_id, unnest(string_split("left", '')) AS a, unnest(string_split("right", '')) AS b FROM sized WHERE n > 0),
    sums AS (SELECT pair_id, CAST(sum(CASE WHEN a = b AND regexp_matches(a, '[A-Za-z]') THEN 1 ELSE 0 END) AS BIGINT) AS equal FROM cols GROUP BY pair_id)
    SELECT pair_id, coalesce(equal, 0) AS equal, CASE WHEN n > 0 THEN floor(100.0::DOUBLE * coalesce(equal, 0) / n * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END AS identity,
      CASE WHEN n > 0 THEN floor(100.0::DOUBLE * (n - s + 1) / n * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END AS coverage FROM sized LEFT JOIN sums USING (pair_id)""",
)
def _(spark, sf):
    """Match lines made from the aligned pairs: the letter where both are equal, a blank elsewhere."""
    t = v.aligned_pairs(spark, sf)
    line = F.array_join(F.zip_with(F.split("left", ""), F.split("right", ""), lambda a, b: F.when(a == b, a).otherwise(" ")), "")
    n = F.length("left").cast("bigint")
    hits = t.select("pair_id", line.alias("match"), n.alias("model_length"), (1 + F.floor(n / 3)).alias("start"), n.alias("end"))
    return sq.match_identity(hits).select("pair_id", "equal", "identity", "coverage")


AGES_SQL = """, cols AS (SELECT pair_id, unnest(string_split(translate("left", 'acgt', 'ACGT'), '')) AS a, unnest(string_split(translate("right", 'acgt', 'ACGT'), '')) AS b FROM aligned_pairs),
    known AS (SELECT pair_id, a, b, (a IN ('A','G') AND b IN ('A','G')) OR (a IN ('C','T') AND b IN ('C','T')) AS near FROM cols
      WHERE a IN ('A','C','G','T') AND b IN ('A','C','G','T')),
    sums AS (SELECT pair_id, count(*) AS sites, CAST(sum(CASE WHEN a <> b AND near THEN 1 ELSE 0 END) AS BIGINT) AS transitions,
      CAST(sum(CASE WHEN a <> b AND NOT near THEN 1 ELSE 0 END) AS BIGINT) AS transversions FROM known GROUP BY pair_id),
    pq AS (SELECT *, 1 - 2 * (transitions::DOUBLE / sites) - transversions::DOUBLE / sites AS x, 1 - 2 * (transversions::DOUBLE / sites) AS y FROM sums),
    aged AS (SELECT pair_id, sites, transitions, transversions,
      CASE WHEN transitions + transversions = 0 THEN 0.0::DOUBLE WHEN x > 0 AND y > 0 THEN -0.5::DOUBLE * ln(x * sqrt(y)) END AS divergence,
      CASE WHEN transitions + transversions = 0 THEN 0.0::DOUBLE WHEN transversions > 0 THEN transitions::DOUBLE / transversions END AS ts_tv FROM pq)
"""


@query(
    "F9_substitution_distance",
    ["aligned_pairs"],
    AGES_SQL
    + """SELECT pair_id, sites, transitions, transversions, round(divergence, 6) AS divergence, round(divergence / (2 * 1e-8), 0) AS age,
      round(ts_tv, 6) AS ts_tv FROM aged""",
)
def _(spark, sf):
    t = sq.substitution_distance(v.aligned_pairs(spark, sf))
    return t.select(
        "pair_id",
        "sites",
        "transitions",
        "transversions",
        F.round("divergence", 6).alias("divergence"),
        F.round("age", 0).alias("age"),
        F.round("ts_tv", 6).alias("ts_tv"),
    )
