"""Exact dedup against immutable snapshots, screened by binary-fuse filters (operator 2).

A snapshot holds the distinct texts of one batch, bucketed by digest, and one
static filter per shard of digests. A new batch is grouped by itself first;
its distinct digests then pass the filters of the older snapshots, shard by
shard, and only those that a filter lets through meet the snapshot's buckets,
where whole texts are compared. Both sides of that comparison are bucketed
alike, so it shuffles no texts.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize
from . import fuse
from .common import SPACES, id_key, packed, text_or_empty

KEYS_PER_FILTER = 1 << 15  # bounds what one task holds: keys of one shard
FEWEST_SHARDS = 8
MOST_BUCKETS = 4096  # files of a snapshot; a layout, not a limit on what it holds

OUTPUTS = ["keep_id", "group_size", "kept", "text_sha256"]


@dataclass(frozen=True)
class Snapshot:
    """Distinct texts (digest, mark, norm, keep_id, size) and the filters over their digests."""

    texts: DataFrame
    filters: DataFrame
    shards: int
    rows: int


def normalised(text: Column | str) -> Column:
    """Each stretch of white space as one space; null as empty."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    return norm.select("id", "norm", F.sha2("norm", 256).alias("digest"), F.xxhash64("norm").alias("mark"))


def build_snapshot(rows: DataFrame, expected: int) -> Snapshot:
    """Group one batch by its whole texts and write it, with its filters.

    Grouping combines before the shuffle, so a text that a third of the rows
    share leaves each task once. ``expected`` rows set the layout only.
    """
    spark = rows.sparkSession
    shards = max(FEWEST_SHARDS, math.ceil(expected / KEYS_PER_FILTER))
    buckets = min(shards, MOST_BUCKETS)
    classes = rows.groupBy("digest", "mark", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("size"))
    name = f"snapshot_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    (
        classes.repartition(buckets, "digest")
        .write.bucketBy(buckets, "digest")
        .option("path", path)
        .format("parquet")
        .saveAsTable(name)
    )
    texts = spark.table(name)
    keys = texts.select(F.xxhash64("digest").alias("key"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [fuse.build(pdf["key"].to_numpy())]})

    filters = materialize(
        keys.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInPandas(build, "shard long, filter binary")
    )
    return Snapshot(texts, filters, shards, expected)


def screen(batch: Snapshot, older: Snapshot) -> DataFrame:
    """Digests of ``batch`` that the filters of ``older`` let through (all true members, one in 256 of the rest).

    A batch much larger than the snapshot is cut into parts, each with its own
    copy of the shard's filter, so that a task's share stays bounded.
    """
    parts = max(1, math.ceil(batch.rows / max(older.rows, older.shards)))
    incoming = batch.texts.select("digest", F.xxhash64("digest").alias("key")).select(
        "digest",
        "key",
        F.pmod("key", F.lit(older.shards)).alias("shard"),
        F.pmod(F.hash("digest"), F.lit(parts)).alias("part"),
    )
    copies = older.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def keep(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or filters.empty:
            return pd.DataFrame({"digest": pd.Series([], dtype=str)})
        return rows.loc[fuse.contains(filters["filter"].iloc[0], rows["key"].to_numpy()), ["digest"]]

    return incoming.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(keep, "digest string")


def confirmed(batch: Snapshot, older: Snapshot, positives: DataFrame) -> DataFrame:
    """Of the screened digests, those whose whole texts are the same in both, from their buckets."""
    new = batch.texts.join(positives.hint("shuffle_hash"), "digest", "left_semi").select("digest", "mark", F.col("norm").alias("new_norm"))
    old = older.texts.select("digest", F.col("norm").alias("old_norm"))
    # written as two comparisons so that it stays a check on the joined buckets and is no second join key
    same = (F.col("new_norm") <= F.col("old_norm")) & (F.col("new_norm") >= F.col("old_norm"))
    return new.hint("shuffle_hash").join(old, "digest").where(same).select("digest", "mark")


def exact_dedup(docs: DataFrame, generations: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    The table comes in ``generations`` batches, dealt by a hash of the id; each
    becomes a snapshot that later batches are screened against. The result does
    not depend on their number.

    Null texts count as empty and are one group. The smallest id of a group
    stays; a null id counts as larger than any. Of rows that share id and text
    one stays. An empty table gives an empty result. Other columns go through;
    columns named like the outputs are replaced.
    """
    slim = class_of_rows(docs.select(id_col, text_col), generations, id_col, text_col)
    # one row per id and digest: joined on both, so that no key is hotter than its id
    key = ["_id", "_no_id", "text_sha256"]
    per_key = slim.withColumns({**id_key("id"), "text_sha256": F.col("digest")}).groupBy(*key).agg(
        F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")
    )
    rows = packed(docs, OUTPUTS, **id_key(id_col), text_sha256=F.sha2(normalised(text_col), 256))
    joined = rows.join(per_key, key)
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))) == 1
    kept = F.col("_row").getField(id_col).eqNullSafe(F.col("keep_id")) & first
    return joined.select("_row", "keep_id", "group_size", kept.alias("kept"), "text_sha256").select("_row.*", *OUTPUTS)


def class_of_rows(docs: DataFrame, generations: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, digest, keep_id, group_size), texts left behind."""
    rows = digested(docs, id_col, text_col)
    n = docs.count()
    batch_no = F.pmod(F.xxhash64("id"), F.lit(generations))
    snapshots: list[Snapshot] = []
    links: list[DataFrame] = []
    for g in range(generations):
        batch = build_snapshot(rows.where(batch_no == g) if generations > 1 else rows, math.ceil(n / generations))
        for older in snapshots:
            links.append(confirmed(batch, older, screen(batch, older)))
        snapshots.append(batch)
    classes = snapshots[0].texts.select("digest", "mark", "keep_id", "size")
    for s in snapshots[1:]:
        classes = classes.unionByName(s.texts.select("digest", "mark", "keep_id", "size"))
    if links:
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        found = materialize(found.distinct())
        across = classes.join(found, ["digest", "mark"], "left_semi")
        inside = classes.where(F.col("size") > 1).join(found, ["digest", "mark"], "left_anti")
        classes = across.groupBy("digest", "mark").agg(F.min("keep_id").alias("keep_id"), F.sum("size").alias("size")).unionByName(inside)
    groups = materialize(classes.where(F.col("size") > 1))
    out = rows.select("id", "digest", "mark").join(groups, ["digest", "mark"], "left")
    single = F.col("size").isNull()
    return out.select(
        "id",
        "digest",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
    )


def decisions(docs: DataFrame, generations: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row, without its text."""
    slim = class_of_rows(docs.select(id_col, text_col), generations, id_col, text_col)
    first = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.lit(1))) == 1
    return slim.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
