"""State paths: labelled positions along a sequence, read from the last position to the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import clade_states
from .intervals import carry_over_tiles


def segment_states(t: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """Segments of a state path with their clade.

    Positions are read downwards. A state opens a segment, each later state one
    lower than the last accepted one extends it, other states are passed over,
    and state 0 closes it. A segment of three states, or of one above 30, is a
    full element; one of a single state is a fragment; the rest is dropped.
    ``start`` is the position of the closing 0, ``end`` that of the opening
    state; the last accepted state names the clade.

    Only the first four accepted states matter, so they are looked up one after
    the other with a maximum per block; a block is never gathered.
    """
    key = ["seq_id", "block"]
    tiled = t.withColumn("_tile", F.floor(F.col("position") / tile).cast("bigint"))
    zero = F.when(F.col("state") == 0, F.col("position"))
    tiled = carry_over_tiles(tiled, ["seq_id"], F.max(zero), "last")
    below = Window.partitionBy("seq_id", "_tile").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    near = F.max(zero).over(below)
    rows = (
        tiled.withColumn("block", F.coalesce(near, F.col("_carry")))
        .where((F.col("state") != 0) & F.col("block").isNotNull())
        .select("seq_id", "block", "position", "state")
    )
    first = rows.groupBy(*key).agg(F.max(F.struct("position", "state")).alias("_f"))
    found = first.select(*key, F.col("_f.position").alias("end"), F.col("_f.position").alias("_p"), F.col("_f.state").alias("_s"))
    found = found.withColumn("states", F.lit(1))
    for _ in range(3):
        onward = F.when((F.col("state") == F.col("_s") - 1) & (F.col("position") < F.col("_p")), F.col("position"))
        # blocks whose segment stands still come through with a NULL
        # the hint: rows and segments meet where they are, on one exchange of the rows for all rounds, and nothing is broadcast
        nxt = rows.hint("merge").join(found, key).groupBy(*key, "end", "_p", "_s", "states").agg(F.max(onward).alias("_q"))
        moved = F.col("_q").isNotNull()
        found = nxt.select(
            *key,
            "end",
            F.when(moved, F.col("_q")).otherwise(F.col("_p")).alias("_p"),
            F.when(moved, F.col("_s") - 1).otherwise(F.col("_s")).alias("_s"),
            (F.col("states") + moved.cast("int")).alias("states"),
        )
    full = (F.col("states") == 3) | ((F.col("states") == 1) & (F.col("_s") > 30))
    kind = F.when(full, "full").when(F.col("states") == 1, "fragment")
    # one row per state of the twelve clades
    clades = clade_states(t.sparkSession).select("clade", F.explode(F.sequence("low", "high")).alias("_s"))
    segments = found.withColumn("kind", kind).where(F.col("kind").isNotNull())
    named = segments.join(F.broadcast(clades), "_s", "left")
    return named.select(
        "seq_id",
        F.col("block").alias("start"),
        "end",
        (F.col("end") - F.col("block")).alias("length"),
        "kind",
        "clade",
    )
