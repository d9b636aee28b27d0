"""Sources and sinks: tables are written in a file format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loci import sources as src
from loci.session import checkpoint_dir

from . import views as v
from .registry import query


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/loci-files-{uuid.uuid4().hex}"


def feature_rows(spark, sf):
    """Regions, elements and parts of V3 as feature rows."""
    none = F.lit(None)
    e, p = v.elements(spark, sf), v.parts(spark, sf)

    def rows(t, kind, attributes):
        return t.select(
            "seq_id",
            F.lit("x").alias("source"),
            kind.alias("type"),
            "start",
            "end",
            none.cast("double").alias("score"),
            "strand",
            none.cast("int").alias("phase"),
            attributes.alias("attributes"),
        )

    def attrs(**kv):
        return F.create_map(*[x for k, c in kv.items() for x in (F.lit(k), F.array(c))])

    regions = rows(e, F.lit("repeat_region"), attrs(ID=F.col("region_id")))
    whole = rows(e, F.col("type"), attrs(ID=F.col("element_id"), Parent=F.col("region_id"), note=F.concat(F.lit("a;b=1,+%"), F.col("orderkey"))))
    owner = F.when(F.col("type") == "target_site_duplication", F.col("region_id")).otherwise(F.col("element_id"))
    parts = rows(p, F.col("type"), attrs(Parent=owner, name=F.col("name")))
    return regions.unionByName(whole).unionByName(parts)


def written_features(spark, sf):
    path = scratch(spark)
    lengths = v.table(spark, sf, "customer").select(F.concat(F.lit("chr"), "c_custkey").alias("seq_id"), F.lit(400000).alias("length"))
    src.write_features(feature_rows(spark, sf), lengths, path)
    return path


@query(
    "S1_S5_feature_file",
    ["elements", "parts"],
    """SELECT seq_id, 'repeat_region' AS type, "start", "end", strand, region_id AS id, NULL AS parent, NULL AS name, NULL AS note FROM elements
    UNION ALL SELECT seq_id, type, "start", "end", strand, element_id, region_id, NULL, 'a;b=1,+%' || orderkey FROM elements
    UNION ALL SELECT seq_id, type, "start", "end", strand, NULL, CASE WHEN type = 'target_site_duplication' THEN region_id ELSE element_id END, name, NULL FROM parts""",
)
def _(spark, sf):
    def first(key):
        return F.try_element_at("attributes", F.lit(key))[0]

    t = src.read_features(spark, written_features(spark, sf))
    return t.select(
        "seq_id", "type", "start", "end", "strand", first("ID").alias("id"), first("Parent").alias("parent"), first("name").alias("name"), first("note").alias("note")
    )


@query("S1_sequence_regions", [], "SELECT 'chr'||c_custkey AS seq_id, 1 AS \"start\", 400000 AS \"end\" FROM customer")
def _(spark, sf):
    return src.read_sequence_regions(spark, written_features(spark, sf))


@query(
    "S1_region_tree",
    ["elements", "parts"],
    """SELECT p.seq_id, p.element_id, p.region_id, p.type, p."start", p."end" FROM parts p JOIN elements e USING (element_id)
    WHERE p."start" >= e."start" AND p."end" <= e."end" """,
)
def _(spark, sf):
    _, _, parts = src.region_tree(src.read_features(spark, written_features(spark, sf)))
    return parts.select("seq_id", "element_id", "region_id", "type", "start", "end")


def plain_sequences(spark, sf):
    return v.sequences(spark, sf).withColumn("residues", F.regexp_replace("residues", r"[\s>]", "-"))


@query(
    "S2_S6_sequence_file",
    ["sequences"],
    "SELECT seq_id, md5(regexp_replace(residues, '[\\s>]', '-', 'g')) AS digest FROM sequences",
)
def _(spark, sf):
    path = scratch(spark)
    src.write_sequences(plain_sequences(spark, sf), path)
    return src.read_sequences(spark, path).select("seq_id", F.md5("residues").alias("digest"))


@query(
    "S2_sequence_chunks",
    ["sequences"],
    """, w AS (SELECT seq_id, regexp_replace(residues, '[\\s>]', '-', 'g') AS residues, length(residues) AS len,
        unnest(range(0, CAST(ceil(length(residues) / 700.0) AS BIGINT))) AS chunk_no FROM sequences WHERE length(residues) > 0),
    b AS (SELECT *, chunk_no*700 + 1 AS core_start, least((chunk_no + 1)*700, len) AS core_end FROM w),
    p AS (SELECT *, least(40, core_start - 1) AS left_pad, least(40, len - core_end) AS right_pad FROM b)
    SELECT seq_id, chunk_no, core_start, core_end, left_pad, right_pad,
      md5(substring(residues, core_start - left_pad, core_end + right_pad - core_start + left_pad + 1)) AS digest FROM p""",
)
def _(spark, sf):
    path = scratch(spark)
    src.write_sequences(plain_sequences(spark, sf), path)
    chunks = src.read_sequence_chunks(spark, path, 700, 40)
    return chunks.withColumn("digest", F.md5("residues")).drop("residues")


@query(
    "S3_hit_file",
    ["norm_hits"],
    "SELECT query, subject, identity, length, s_start, s_end, bits, strand FROM norm_hits",
)
def _(spark, sf):
    from loci.schema import HIT_FILE

    path = scratch(spark)
    v.hits(spark, sf).select(*HIT_FILE.names).write.option("sep", "\t").csv(path)
    return src.read_hits(spark, path).select("query", "subject", "identity", "length", "s_start", "s_end", "bits", "strand")


@query("S7_report", ["members"], "SELECT element_id, family, length FROM members")
def _(spark, sf):
    path = scratch(spark)
    src.write_report(v.members(spark, sf).select("element_id", "family", "length"), path)
    return spark.read.schema("element_id string, family string, length bigint").option("sep", "\t").option("header", True).csv(path)


@query("S8_library", ["members"], "SELECT element_id, family, superfamily, length FROM members")
def _(spark, sf):
    path = scratch(spark)
    src.write_library(v.members(spark, sf), path)
    return spark.read.schema("element_id string, length bigint, superfamily string, family string").parquet(path)
