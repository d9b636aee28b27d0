"""Orders, ranks and numbers that do not gather a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def top_per_key(t: DataFrame, key: str | Sequence[str], order: Sequence[Column], k: int = 1, ties: Sequence[Column] = ()) -> DataFrame:
    """First ``k`` rows of every key.

    Spark limits each map task to ``k`` rows per key before the shuffle
    (WindowGroupLimit), so a key holding a third of the table sends only ``k``
    rows per task. ``ties``, ascending, go on with the order where rows are
    equal under it: costly ones are then made for those rows alone, and are not
    shuffled.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    if not ties:
        return t.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
    first = t.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= k)
    first = first.withColumn("_left", F.count("*").over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy(*order, *[F.when(F.col("_left") > k, c) for c in ties])
    return first.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank", "_left")


def number_rows(
    t: DataFrame,
    order: Sequence[Column | str],
    name: str = "number",
    within: Sequence[str] = (),
    first: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Consecutive numbers in a global order, or in an order within groups.

    Rows are range-partitioned on the whole order, so even one huge group is
    cut over many tasks; rows before each piece are counted per piece and the
    numbers are local ranks plus that offset. The piece number is written out
    first: it must not change when a lost task is run again.
    """
    spark = t.sparkSession
    keys = {f"_o{i}": (F.col(c) if isinstance(c, str) else c) for i, c in enumerate(order)}
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = t.withColumns(keys)
    cut = keyed.repartitionByRange(n, *within, *keys).withColumn("_piece", F.spark_partition_id())
    fixed = materialize(cut)

    sizes = fixed.groupBy(*within, "_piece").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*within).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # one row per piece (and group): as many as there are partitions, not rows
    offsets = sizes.select(*within, "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*within, "_piece").orderBy(*keys)
    return (
        fixed.join(offsets, [*within, "_piece"])
        .withColumn(name, (F.col("_before") + F.row_number().over(local) + F.lit(first - 1)).cast("bigint"))
        .drop("_before", "_piece", *keys)
    )


def natural_order(t: DataFrame, col: str = "seq_id") -> DataFrame:
    """Rows sorted by an identifier with numbers read as numbers (T4)."""
    from ..functions.columns import natural_key

    return t.orderBy(natural_key(col), col)


def concatenate(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Libraries of all kinds as one (U1); a column one of them lacks is NULL there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def unique_names(t: DataFrame, *cols: str) -> DataFrame:
    """Each name once (U4)."""
    return t.dropDuplicates(list(cols))
