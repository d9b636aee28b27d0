"""Views of genomic shape over the given tables, once in Spark and once in SQL.

The tables hold no genomics, so each operator runs on rows of the same shape
made from whole tables: intervals, hits, a tree of elements and parts, state
paths, sequences, families, aligned pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loci.operators.intervals import dealt


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _days(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1995-01-01").cast("date")).cast("bigint") + 1


def _big(c: str) -> Column:
    return F.col(c).cast("bigint")


CODES = [("A", "F", "RLG"), ("A", "O", "RLC"), ("N", "F", "DTA"), ("N", "O", "DHH"), ("R", "F", "RIL")]


def _code() -> Column:
    out = F
    for flag, status, code in CODES:
        out = out.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), code)
    return out.otherwise("ZZZ")


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """V1: one interval per line item on the sequence of its part."""
    start = _days("l_shipdate")
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("chr"), F.col("l_partkey")).alias("seq_id"),
        start.alias("start"),
        (start + _big("l_quantity") - 1).alias("end"),
        F.when(F.col("l_linestatus") == "F", "-").otherwise("+").alias("strand"),
        _code().alias("code"),
        F.col("l_linenumber").cast("bigint").alias("score"),
        F.round(F.lit(100.0) - F.col("l_discount") * 500.0, 0).alias("similarity"),
        F.col("l_tax").alias("tax"),
        F.concat_ws("_", F.lit("e"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _cents()).alias("id"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_linenumber").cast("bigint").alias("linenumber"),
    )


def strict_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals(spark, sf).where(F.col("similarity") <= 75)


def sequence_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Length of every sequence of V1: 2600 and a bit more per part size."""
    return table(spark, sf, "part").select(
        F.concat(F.lit("chr"), F.col("p_partkey")).alias("seq_id"), (F.lit(2500) + _big("p_size") * 3).alias("length")
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """V2: one hit per line item, order against part; subject ends reversed on status F."""
    first = _days("l_shipdate")
    last = first + _big("l_quantity") * 4 - 1
    reverse = F.col("l_linestatus") == "F"
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("q"), F.col("l_orderkey")).alias("query"),
        F.concat(F.lit("s"), F.col("l_partkey")).alias("subject"),
        F.round(F.lit(100.0) - F.col("l_discount") * 500.0, 0).alias("identity"),
        (_big("l_quantity") * 4).alias("length"),
        F.col("l_linenumber").cast("bigint").alias("mismatches"),
        F.lit(0).cast("bigint").alias("gap_opens"),
        F.lit(1).cast("bigint").alias("q_start"),
        (_big("l_quantity") * 4).alias("q_end"),
        F.when(reverse, last).otherwise(first).alias("s_start"),
        F.when(reverse, first).otherwise(last).alias("s_end"),
        F.col("l_tax").alias("evalue"),
        F.col("l_extendedprice").alias("bits"),
        F.col("l_suppkey").alias("suppkey"),
    )


def hit_key() -> list[Column]:
    """Columns that make the order of hits total beyond the library's own order."""
    return [F.col("query"), F.col("mismatches"), F.col("suppkey")]


def query_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat(F.lit("q"), F.col("o_orderkey")).alias("id"), (F.lit(60) + F.col("o_orderkey") % 240).alias("length")
    )


def subject_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.concat(F.lit("s"), F.col("p_partkey")).alias("id"), (F.lit(80) + _big("p_size") * 4).alias("length")
    )


def query_superfamilies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select(
        F.concat(F.lit("q"), F.col("o_orderkey")).alias("query"),
        F.when(k == 0, "Gypsy").when(k == 1, "Copia").when(k == 2, "hAT").otherwise("Unknown_LTR").alias("query_superfamily"),
    )


def subject_superfamilies(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("p_type")
    return table(spark, sf, "part").select(
        F.concat(F.lit("s"), F.col("p_partkey")).alias("subject"),
        F.when(t.isin("ECONOMY", "LARGE"), "Gypsy")
        .when(t == "STANDARD", "Copia")
        .when(t == "PROMO", "Unknown_LTR")
        .otherwise("hAT")
        .alias("subject_superfamily"),
        F.col("p_brand").alias("brand"),
    )


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """V3: one element per order, on the sequence of its customer."""
    start = _days("o_orderdate") * 100 + 1
    length = F.lit(100) + F.floor(F.col("o_totalprice") / 15).cast("bigint")
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("chr"), F.col("o_custkey")).alias("seq_id"),
        start.alias("start"),
        (start + length - 1).alias("end"),
        F.when(key % 3 == 0, "+").when(key % 3 == 1, "-").otherwise("?").alias("strand"),
        F.when(key % 2 == 0, "LTR_retrotransposon").otherwise("terminal_inverted_repeat_element").alias("type"),
        F.concat(F.lit("element"), key).alias("element_id"),
        F.concat(F.lit("repeat_region"), key).alias("region_id"),
        key.alias("orderkey"),
    )


# Part types by supplier and domain names by part, in the order of the remainder.
PART_TYPES = [
    "target_site_duplication",
    "long_terminal_repeat",
    "primer_binding_site",
    "RR_tract",
    "inverted_repeat",
    "terminal_inverted_repeat",
    "protein_match",
    "protein_match",
]
DOMAINS = [
    "RVT_1",
    "RVT_2",
    "Chromo",
    "rve",
    "gag_pol",
    "UBN2",
    "Transposase_21",
    "MuDR_mule",
    "RNase_H",
    "DUF4219",
    "Peptidase_A17;x",
    "SWIM",
]


def _pick(values: list[str], c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """V3: one part per line item inside the element of its order."""
    e = elements(spark, sf).select("orderkey", "seq_id", "element_id", "region_id", F.col("strand"), F.col("start").alias("es"), F.col("end").alias("ee"))
    li = table(spark, sf, "lineitem")
    kind = _pick(PART_TYPES, F.col("l_suppkey") + F.col("l_orderkey"))
    at = F.col("es") + (F.col("l_suppkey") * 37 + _big("l_linenumber") * 211 + F.col("l_partkey")) % 600
    size = F.when(kind == "target_site_duplication", 2 + _big("l_quantity") % 11).otherwise(_big("l_quantity") * 4)
    whole = (kind == "terminal_inverted_repeat") & (F.col("l_orderkey") % 5 == 0)
    return li.join(e, li["l_orderkey"] == e["orderkey"]).select(
        "seq_id",
        "element_id",
        "region_id",
        kind.alias("type"),
        _pick(DOMAINS, F.col("l_partkey")).alias("name"),
        F.when(whole, F.col("es")).otherwise(at).alias("start"),
        F.when(whole, F.col("ee")).otherwise(at + size - 1).alias("end"),
        "strand",
        F.concat_ws("_", F.lit("p"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _cents()).alias("part_id"),
    )


def state_path(spark: SparkSession, sf: str) -> DataFrame:
    """V4: one state per event along the path of its user."""
    kind = F.col("event_type")
    state = F.when(kind == "signup", 0).when(kind == "view", 3).when(kind == "click", 2).when(kind == "purchase", 1).otherwise(31)
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("seq_id"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("position"),
        state.alias("state"),
    )


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """V5: one sequence per document, whole text."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select(F.concat(F.lit("doc"), F.col("doc_id")).alias("seq_id"), F.col("text").alias("residues"))


def document_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of line items laid on whole documents (part key taken as document id, modulo their number)."""
    size = _big("l_quantity")
    start = _spread(_days("l_shipdate") * 2689 + F.col("l_orderkey") * 40503, size)
    return _on_documents(spark, sf, table(spark, sf, "lineitem"), "l_partkey", over_all=True).select(
        "seq_id",
        start.alias("start"),
        (start + size - 1).alias("end"),
        F.concat_ws("_", F.lit("e"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _cents()).alias("id"),
    )


def members(spark: SparkSession, sf: str) -> DataFrame:
    """V6: one family member per part."""
    return table(spark, sf, "part").select(
        F.concat(F.lit("s"), F.col("p_partkey")).alias("element_id"),
        F.concat(F.lit("RLG_"), F.replace("p_brand", F.lit("Brand#"), F.lit("family"))).alias("family"),
        F.col("p_type").alias("superfamily"),
        (_big("p_size") * 300).alias("length"),
    )


def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    """V6: up to three cluster assignments per part."""
    p = table(spark, sf, "part")
    element = F.concat(F.lit("s"), F.col("p_partkey")).alias("element_id")

    def one(part: str, cluster: Column, cond: Column) -> DataFrame:
        return p.where(cond).select(F.lit(part).alias("part"), cluster.cast("bigint").alias("cluster_id"), element)

    return (
        one("full", _big("p_size"), F.lit(True))
        .unionByName(one("ltr", F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.col("p_partkey") % 3 != 0))
        .unionByName(one("rvt", F.length("p_type"), F.col("p_partkey") % 5 != 0))
        .unionByName(one("rvt", F.length("p_name"), F.col("p_partkey") % 7 == 0))
    )


def aligned_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """V7: a conversation turn and the next one, both cut to the shorter."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    n = F.least(F.length("text"), F.length("next"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        F.concat_ws("_", F.lit("pair"), "conv_id", "turn").alias("pair_id"),
        F.substring(F.col("text"), F.lit(1), n).alias("left"),
        F.substring(F.col("next"), F.lit(1), n).alias("right"),
    )


def document_count(spark: SparkSession, sf: str) -> Column:
    """A property of the table, read as a scalar subquery."""
    return table(spark, sf, "documents").agg(F.count("*")).scalar()


def document_lengths(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.concat(F.lit("doc"), "doc_id").alias("seq_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("doc_length"))


def _on_documents(spark: SparkSession, sf: str, t: DataFrame, key: str, over_all: bool = False) -> DataFrame:
    """Rows with the document that ``key`` falls on and its length; ``over_all`` shuffle partitions if steps by document follow in the same stage."""
    placed = t.withColumn("seq_id", F.concat(F.lit("doc"), F.col(key) % document_count(spark, sf)))
    placed = dealt(placed, ["seq_id"]) if over_all else placed
    return placed.join(document_lengths(spark, sf), "seq_id")


def _spread(number: Column, size: Column) -> Column:
    """A start anywhere in the document that leaves room for ``size`` letters; 1 where there is none."""
    return 1 + number % F.greatest(F.col("doc_length") - size + 1, F.lit(1))


def doc_elements(spark: SparkSession, sf: str) -> DataFrame:
    """V3 on the documents: one short element per order, anywhere on a document."""
    key = F.col("o_orderkey")
    size = 20 + F.floor(F.col("o_totalprice") / 1500).cast("bigint")
    start = _spread(key * 40503, size)
    return _on_documents(spark, sf, table(spark, sf, "orders"), "o_orderkey").select(
        "seq_id",
        start.alias("start"),
        (start + size - 1).alias("end"),
        F.when(key % 3 == 0, "+").when(key % 3 == 1, "-").otherwise("?").alias("strand"),
        F.when(F.col("o_orderpriority") < "3", "LTR_retrotransposon").otherwise("terminal_inverted_repeat_element").alias("type"),
        F.concat(F.lit("element"), key).alias("element_id"),
        F.concat(F.lit("repeat_region"), key).alias("region_id"),
        key.alias("orderkey"),
        (80 + F.floor(F.col("o_totalprice")) % 20).cast("bigint").alias("similarity"),
        F.col("o_orderstatus").alias("status"),
    )


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the element of their order."""
    e = doc_elements(spark, sf).select("orderkey", "seq_id", "element_id", "region_id", "strand", F.col("start").alias("es"), F.col("end").alias("ee"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.join(e, li["l_orderkey"] == e["orderkey"])


def doc_features(spark: SparkSession, sf: str, joined: DataFrame | None = None) -> DataFrame:
    """V3 on the documents: one part per line item inside its element; ``joined`` are the rows of ``doc_lines``, kept somewhere."""
    joined = doc_lines(spark, sf) if joined is None else joined
    kind = _pick(PART_TYPES, F.col("l_suppkey") + F.col("l_orderkey"))
    at = F.col("es") + (F.col("l_suppkey") * 37 + _big("l_linenumber") * 211 + F.col("l_partkey")) % (F.col("ee") - F.col("es") - 10)
    size = F.when(kind == "target_site_duplication", 2 + _big("l_quantity") % 10).otherwise(_big("l_quantity") * 2)
    whole = (kind == "terminal_inverted_repeat") & (F.col("l_orderkey") % 5 == 0)
    return joined.select(
        "seq_id",
        "element_id",
        "region_id",
        kind.alias("type"),
        _pick(DOMAINS, F.col("l_partkey")).alias("name"),
        F.when(whole, F.col("es")).otherwise(at).cast("bigint").alias("start"),
        F.when(whole, F.col("ee")).otherwise(F.least(at + size - 1, F.col("ee"))).cast("bigint").alias("end"),
        "strand",
        F.concat_ws("_", F.lit("p"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _cents()).alias("part_id"),
    )


def doc_hits(spark: SparkSession, sf: str) -> DataFrame:
    """V2 on the documents: library entries with a code against the text of a document."""
    size = _big("l_quantity") * 4
    first = _spread(_days("l_shipdate") * 2689 + F.col("l_orderkey") * 40503, size)
    last = first + size - 1
    reverse = F.col("l_linestatus") == "F"
    return _on_documents(spark, sf, table(spark, sf, "lineitem"), "l_partkey").select(
        F.concat_ws("_", _code(), F.concat(F.lit("family"), F.col("l_suppkey"))).alias("query"),
        F.col("seq_id").alias("subject"),
        F.round(F.lit(100.0) - F.col("l_discount") * 500.0, 0).alias("identity"),
        (_big("l_quantity") * 4).alias("length"),
        F.when(reverse, last).otherwise(first).alias("s_start"),
        F.when(reverse, first).otherwise(last).alias("s_end"),
        F.col("l_tax").alias("evalue"),
        F.col("l_extendedprice").alias("bits"),
    )


def element_hits(spark: SparkSession, sf: str) -> DataFrame:
    """V2 between the elements on the documents: one hit per line item of every other order, to an order further on."""
    key = F.col("l_orderkey")
    return table(spark, sf, "lineitem").where(F.expr("l_orderkey DIV 5") % 2 == 0).select(
        F.concat(F.lit("element"), key).alias("query"),
        F.concat(F.lit("element"), key + 5 * (1 + 2 * (F.col("l_suppkey") % 3))).alias("subject"),
        F.round(F.lit(100.0) - F.col("l_discount") * 500.0, 0).alias("identity"),
        (_big("l_quantity") * 4).alias("length"),
        F.col("l_extendedprice").alias("bits"),
    )


def flank_genes(spark: SparkSession, sf: str) -> DataFrame:
    """V2 between gene models and the flanks of the elements: one hit per line item, to either side of its order's element."""
    side = F.when(F.col("l_suppkey") % 2 == 0, "left").otherwise("right")
    return table(spark, sf, "lineitem").select(
        F.concat_ws("_", F.concat(F.lit("element"), F.col("l_orderkey")), side).alias("query"),
        F.round(F.lit(100.0) - F.col("l_discount") * 500.0, 0).alias("identity"),
        _big("l_quantity").alias("length"),
    )


def doc_path(spark: SparkSession, sf: str) -> DataFrame:
    """V4 on the documents: the path of a user on the document of the same number."""
    events = table(spark, sf, "events")
    kind = F.col("event_type")
    state = F.when(kind == "signup", 0).when(kind == "view", 3).when(kind == "click", 2).when(kind == "purchase", 1).otherwise(31)
    return events.select(
        F.concat(F.lit("doc"), F.col("user_id") % document_count(spark, sf)).alias("seq_id"), (F.col("event_id") + 1).alias("position"), state.alias("state")
    )


_CODE_SQL = "CASE " + " ".join(
    f"WHEN l_returnflag='{f}' AND l_linestatus='{s}' THEN '{c}'" for f, s, c in CODES
) + " ELSE 'ZZZ' END"
_CENTS_SQL = "CAST(round(l_extendedprice*100) AS BIGINT)"
_ID_SQL = f"l_orderkey||'_'||l_linenumber||'_'||l_partkey||'_'||l_suppkey||'_'||{_CENTS_SQL}"


def _days_sql(c: str) -> str:
    return f"(date_diff('day', DATE '1995-01-01', CAST({c} AS DATE)) + 1)"


def _spread_sql(number: str, size: str) -> str:
    return f"(1 + ({number}) % greatest(doc_length - ({size}) + 1, 1))"


_LINE_PLACE = f"{_days_sql('l_shipdate')} * 2689 + l_orderkey * 40503"


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# name -> (views it needs, text)
VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "intervals": (
        [],
        f"""SELECT 'chr'||l_partkey AS seq_id, {_days_sql('l_shipdate')} AS "start",
      {_days_sql('l_shipdate')} + CAST(l_quantity AS BIGINT) - 1 AS "end",
      CASE WHEN l_linestatus='F' THEN '-' ELSE '+' END AS strand, {_CODE_SQL} AS code,
      CAST(l_linenumber AS BIGINT) AS score, round(100.0 - l_discount*500.0) AS similarity, l_tax AS tax,
      'e_'||{_ID_SQL} AS id, l_orderkey AS orderkey, l_suppkey AS suppkey, CAST(l_linenumber AS BIGINT) AS linenumber
    FROM lineitem""",
    ),
    "strict_intervals": (["intervals"], "SELECT * FROM intervals WHERE similarity <= 75"),
    "sequence_spans": ([], "SELECT 'chr'||p_partkey AS seq_id, 2500 + CAST(p_size AS BIGINT)*3 AS length FROM part"),
    "hits": (
        [],
        f"""SELECT 'q'||l_orderkey AS query, 's'||l_partkey AS subject, round(100.0 - l_discount*500.0) AS identity,
      CAST(l_quantity AS BIGINT)*4 AS length, CAST(l_linenumber AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS gap_opens,
      CAST(1 AS BIGINT) AS q_start, CAST(l_quantity AS BIGINT)*4 AS q_end,
      CASE WHEN l_linestatus='F' THEN {_days_sql('l_shipdate')} + CAST(l_quantity AS BIGINT)*4 - 1 ELSE {_days_sql('l_shipdate')} END AS s_start,
      CASE WHEN l_linestatus='F' THEN {_days_sql('l_shipdate')} ELSE {_days_sql('l_shipdate')} + CAST(l_quantity AS BIGINT)*4 - 1 END AS s_end,
      l_tax AS evalue, l_extendedprice AS bits, l_suppkey AS suppkey
    FROM lineitem""",
    ),
    "norm_hits": (
        ["hits"],
        """SELECT query, subject, identity, length, mismatches, gap_opens, q_start, q_end,
      least(s_start, s_end) AS s_start, greatest(s_start, s_end) AS s_end, evalue, bits,
      CASE WHEN s_start > s_end THEN '-' ELSE '+' END AS strand, suppkey FROM hits""",
    ),
    "query_lengths": ([], "SELECT 'q'||o_orderkey AS id, 60 + o_orderkey % 240 AS length FROM orders"),
    "subject_lengths": ([], "SELECT 's'||p_partkey AS id, 80 + CAST(p_size AS BIGINT)*4 AS length FROM part"),
    "query_superfamilies": (
        [],
        """SELECT 'q'||o_orderkey AS query, CASE o_orderkey % 4 WHEN 0 THEN 'Gypsy' WHEN 1 THEN 'Copia' WHEN 2 THEN 'hAT'
      ELSE 'Unknown_LTR' END AS query_superfamily FROM orders""",
    ),
    "subject_superfamilies": (
        [],
        """SELECT 's'||p_partkey AS subject, CASE WHEN p_type IN ('ECONOMY','LARGE') THEN 'Gypsy' WHEN p_type='STANDARD' THEN 'Copia'
      WHEN p_type='PROMO' THEN 'Unknown_LTR' ELSE 'hAT' END AS subject_superfamily, p_brand AS brand FROM part""",
    ),
    "elements": (
        [],
        f"""SELECT 'chr'||o_custkey AS seq_id, {_days_sql('o_orderdate')}*100 + 1 AS "start",
      {_days_sql('o_orderdate')}*100 + 100 + CAST(floor(o_totalprice/15) AS BIGINT) AS "end",
      CASE o_orderkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '?' END AS strand,
      CASE WHEN o_orderkey % 2 = 0 THEN 'LTR_retrotransposon' ELSE 'terminal_inverted_repeat_element' END AS type,
      'element'||o_orderkey AS element_id, 'repeat_region'||o_orderkey AS region_id, o_orderkey AS orderkey
    FROM orders""",
    ),
    "parts": (
        ["elements"],
        f"""SELECT seq_id, element_id, region_id, kind AS type, name,
      CASE WHEN kind='terminal_inverted_repeat' AND l_orderkey % 5 = 0 THEN es ELSE pos END AS "start",
      CASE WHEN kind='terminal_inverted_repeat' AND l_orderkey % 5 = 0 THEN ee ELSE pos + size - 1 END AS "end",
      strand, part_id
    FROM (SELECT *, CASE WHEN kind='target_site_duplication' THEN 2 + CAST(l_quantity AS BIGINT) % 11
                   ELSE CAST(l_quantity AS BIGINT)*4 END AS size
      FROM (SELECT e.seq_id, e.element_id, e.region_id, e.strand, e."start" AS es, e."end" AS ee, l_quantity, l_orderkey,
          ({_list_sql(PART_TYPES)})[CAST((l_suppkey + l_orderkey) % {len(PART_TYPES)} + 1 AS INTEGER)] AS kind,
          ({_list_sql(DOMAINS)})[CAST(l_partkey % {len(DOMAINS)} + 1 AS INTEGER)] AS name,
          e."start" + (l_suppkey*37 + CAST(l_linenumber AS BIGINT)*211 + l_partkey) % 600 AS pos,
          'p_'||{_ID_SQL} AS part_id
        FROM lineitem JOIN elements e ON l_orderkey = e.orderkey))""",
    ),
    "state_path": (
        [],
        """SELECT 'u'||user_id AS seq_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP)) AS position,
      CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 3 WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 ELSE 31 END AS state
    FROM events""",
    ),
    "sequences": ([], "SELECT 'doc'||doc_id AS seq_id, text AS residues FROM documents"),
    "document_lengths": (
        [],
        """SELECT 'doc'||doc_id AS seq_id, coalesce(length(text), 0) AS doc_length FROM documents""",
    ),
    "line_places": (
        ["document_lengths"],
        """SELECT * FROM (SELECT *, 'doc'||(l_partkey % (SELECT count(*) FROM documents)) AS seq_id FROM lineitem) JOIN document_lengths USING (seq_id)""",
    ),
    "order_places": (
        ["document_lengths"],
        """SELECT *, 20 + CAST(floor(o_totalprice/1500) AS BIGINT) AS size
    FROM (SELECT *, 'doc'||(o_orderkey % (SELECT count(*) FROM documents)) AS seq_id FROM orders) JOIN document_lengths USING (seq_id)""",
    ),
    "document_spans": (
        ["line_places"],
        f"""SELECT seq_id, "start", "start" + CAST(l_quantity AS BIGINT) - 1 AS "end", 'e_'||{_ID_SQL} AS id
    FROM (SELECT *, {_spread_sql(_LINE_PLACE, 'CAST(l_quantity AS BIGINT)')} AS "start" FROM line_places)""",
    ),
    "members": (
        [],
        """SELECT 's'||p_partkey AS element_id, 'RLG_'||replace(p_brand,'Brand#','family') AS family, p_type AS superfamily,
      CAST(p_size AS BIGINT)*300 AS length FROM part""",
    ),
    "cluster_members": (
        [],
        """SELECT 'full' AS part, CAST(p_size AS BIGINT) AS cluster_id, 's'||p_partkey AS element_id FROM part
    UNION ALL SELECT 'ltr', CAST(replace(p_brand,'Brand#','') AS BIGINT), 's'||p_partkey FROM part WHERE p_partkey % 3 <> 0
    UNION ALL SELECT 'rvt', length(p_type), 's'||p_partkey FROM part WHERE p_partkey % 5 <> 0
    UNION ALL SELECT 'rvt', length(p_name), 's'||p_partkey FROM part WHERE p_partkey % 7 = 0""",
    ),
    "doc_elements": (
        ["order_places"],
        f"""SELECT seq_id, "start", "start" + size - 1 AS "end",
      CASE o_orderkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '?' END AS strand,
      CASE WHEN o_orderpriority < '3' THEN 'LTR_retrotransposon' ELSE 'terminal_inverted_repeat_element' END AS type,
      'element'||o_orderkey AS element_id, 'repeat_region'||o_orderkey AS region_id, o_orderkey AS orderkey,
      80 + CAST(floor(o_totalprice) AS BIGINT) % 20 AS similarity, o_orderstatus AS status
    FROM (SELECT *, {_spread_sql('o_orderkey * 40503', 'size')} AS "start" FROM order_places)""",
    ),
    "doc_features": (
        ["doc_elements"],
        f"""SELECT seq_id, element_id, region_id, kind AS type, name,
      CASE WHEN kind='terminal_inverted_repeat' AND l_orderkey % 5 = 0 THEN es ELSE pos END AS "start",
      CASE WHEN kind='terminal_inverted_repeat' AND l_orderkey % 5 = 0 THEN ee ELSE least(pos + size - 1, ee) END AS "end", strand, part_id
    FROM (SELECT *, CASE WHEN kind='target_site_duplication' THEN 2 + CAST(l_quantity AS BIGINT) % 10 ELSE CAST(l_quantity AS BIGINT)*2 END AS size
      FROM (SELECT e.seq_id, e.element_id, e.region_id, e.strand, e."start" AS es, e."end" AS ee, l_quantity, l_orderkey,
          ({_list_sql(PART_TYPES)})[CAST((l_suppkey + l_orderkey) % {len(PART_TYPES)} + 1 AS INTEGER)] AS kind,
          ({_list_sql(DOMAINS)})[CAST(l_partkey % {len(DOMAINS)} + 1 AS INTEGER)] AS name,
          e."start" + (l_suppkey*37 + CAST(l_linenumber AS BIGINT)*211 + l_partkey) % (e."end" - e."start" - 10) AS pos,
          'p_'||{_ID_SQL} AS part_id
        FROM lineitem JOIN doc_elements e ON l_orderkey = e.orderkey))""",
    ),
    "doc_hits": (
        ["line_places"],
        f"""SELECT {_CODE_SQL} || '_family' || l_suppkey AS query, seq_id AS subject,
      round(100.0 - l_discount*500.0) AS identity, CAST(l_quantity AS BIGINT)*4 AS length, first AS s_start,
      first + CAST(l_quantity AS BIGINT)*4 - 1 AS s_end, CASE WHEN l_linestatus='F' THEN '-' ELSE '+' END AS strand,
      l_tax AS evalue, l_extendedprice AS bits
    FROM (SELECT *, {_spread_sql(_LINE_PLACE, 'CAST(l_quantity AS BIGINT) * 4')} AS first FROM line_places)""",
    ),
    "element_hits": (
        [],
        """SELECT 'element'||l_orderkey AS query, 'element'||(l_orderkey + 5*(1 + 2*(l_suppkey % 3))) AS subject, round(100.0 - l_discount*500.0) AS identity,
      CAST(l_quantity AS BIGINT)*4 AS length, l_extendedprice AS bits FROM lineitem WHERE (l_orderkey // 5) % 2 = 0""",
    ),
    "flank_genes": (
        [],
        """SELECT 'element'||l_orderkey||'_'||CASE WHEN l_suppkey % 2 = 0 THEN 'left' ELSE 'right' END AS query, round(100.0 - l_discount*500.0) AS identity,
      CAST(l_quantity AS BIGINT) AS length FROM lineitem""",
    ),
    "doc_path": (
        [],
        """SELECT 'doc'||(user_id % (SELECT count(*) FROM documents)) AS seq_id, event_id + 1 AS position,
      CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 3 WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 ELSE 31 END AS state FROM events""",
    ),
    "aligned_pairs": (
        [],
        """SELECT 'pair_'||a.conv_id||'_'||a.turn AS pair_id, substring(a.text, 1, least(length(a.text), length(b.text))) AS "left",
      substring(b.text, 1, least(length(a.text), length(b.text))) AS "right"
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    ),
}
