"""Joins, merges and ordered passes over closed, 1-based intervals.

Intervals are rows with ``seq_id``, ``start`` and ``end``. Ordered passes work
on *tiles*, fixed stretches of coordinates. A pass first reduces the table to
one row per (sequence, start) with partial aggregation, so a tile holds at most
``tile`` rows whatever the input, and then hands the state from tile to tile
through one summary row per tile. No window ever spans a whole sequence of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import number_rows

TILE = 1 << 16
FOLD_LIMIT = 1 << 10


def _by(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _tile(pos: Column | str, tile: int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor((pos - 1) / F.lit(tile)).cast("bigint")


# --------------------------------------------------------------------------
# carrying state over tiles


def carry_over_tiles(
    rows: DataFrame, by: Sequence[str], summary: Column, fold: str = "last", name: str = "_carry", descending: bool = False
) -> DataFrame:
    """Attach to each row what the earlier tiles of its group left behind.

    ``summary`` is aggregated per (group, ``_tile``); ``fold`` says how the
    summaries of earlier tiles combine: the ``max``, or the ``last`` non-null.
    """
    order = F.col("_tile").desc() if descending else F.col("_tile").asc()
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per_tile = rows.groupBy(*by, "_tile").agg(summary.alias("_s"))
    combined = F.max("_s") if fold == "max" else F.last("_s", ignorenulls=True)
    carried = per_tile.select(*by, "_tile", combined.over(earlier).alias(name))
    # summaries grow with the number of sequences: they are never broadcast
    return rows.hint("merge").join(carried, [*by, "_tile"])


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by ``keys`` over all shuffle partitions.

    Left to adaptive execution they come as one partition a core, up to its advisory size; each
    sort and aggregate of the stage then holds that partition, many times as large as its compressed bytes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _local_islands(points: DataFrame, by: Sequence[str], gap: int, tile: int, previous_only: bool) -> DataFrame:
    """Add ``_tile`` and ``_local``, the start of the row's island as its own tile sees it."""
    tiled = points.withColumn("_tile", _tile("start", tile))
    # what the join of summaries with rows asks for anyway; said here, it holds on both its sides
    tiled = dealt(tiled.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, "_tile"])), [*by, "_tile"])
    w = Window.partitionBy(*by, "_tile").orderBy("start")
    before = F.lag("end").over(w) if previous_only else F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = tiled.withColumn("_before", before)
    opened = opened.withColumn("_open", F.when(F.col("_before").isNull() | (F.col("start") - F.col("_before") > gap), F.col("start")))
    return opened.withColumn("_local", F.max("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_before", "_open")


def _joined_islands(local: DataFrame, by: Sequence[str], gap: int, previous_only: bool) -> DataFrame:
    """Add ``island``: the local island, or the one that reaches in from earlier tiles.

    ``local`` has rows or whole local islands (``_last_end``: the end of an
    island's last row). One summary a tile suffices: its first and last local
    island and where it ends. A local island joins what comes before it iff it
    starts within ``gap`` of the end handed on (with ``previous_only`` the
    tile's first island alone can); so the running end and the island still
    open are two running values over the summaries. Rows keep the partitions
    of their tiles.
    """
    end = _closing_end(local, by, previous_only)
    tiles = local.groupBy(*by, "_tile").agg(F.min("_local").alias("_first"), F.max("_local").alias("_last"), end.alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.last("_end").over(earlier) if previous_only else F.max("_end").over(earlier)

    def joins(start: Column) -> Column:
        near = F.col("_reach").isNotNull() & (start - F.col("_reach") <= gap)
        return near & (start == F.col("_first")) if previous_only else near

    tiles = tiles.withColumn("_reach", reach).withColumn("_opens", F.when(~joins(F.col("_last")), F.col("_last")))
    carried = tiles.select(*by, "_tile", "_first", "_reach", F.last("_opens", ignorenulls=True).over(earlier).alias("_open"))
    joined = local.join(carried, [*by, "_tile"])
    return joined.withColumn("island", F.when(joins(F.col("_local")), F.col("_open")).otherwise(F.col("_local"))).drop("_first", "_reach", "_open")


def _closing_end(local: DataFrame, by: Sequence[str], previous_only: bool) -> Column:
    """The end that is handed on: the furthest, or that of the last row.

    Taken out of a structure of all columns: both sides of the join of summaries
    with rows then read the same ones, so Spark scans and shuffles them once.
    """
    field, lead = ("_last_end", ["start", "_last_end"]) if previous_only else ("end", ["end"])
    rest = [c for c in local.columns if c not in {*by, "_tile", *lead}]
    return F.max(F.struct(*lead, *rest))[field]


def _islands(points: DataFrame, by: Sequence[str], gap: int, tile: int, previous_only: bool) -> DataFrame:
    """Add ``island`` (the start of its first row) to rows unique on (by, start).

    A row opens an island when it starts more than ``gap`` after the furthest
    earlier end (or, with ``previous_only``, after the end of the row before).
    """
    local = _local_islands(points, by, gap, tile, previous_only).withColumn("_last_end", F.col("end"))
    return _joined_islands(local, by, gap, previous_only).drop("_tile", "_local", "_last_end")


def _island_rows(points: DataFrame, by: Sequence[str], gap: int, tile: int, previous_only: bool, **folds: Column) -> DataFrame:
    """One row an island: ``start``, ``end`` (the furthest, or that of the last row) and ``folds``, aggregates that may be applied twice.

    Each tile folds its islands before anything crosses tiles.
    """
    local = _local_islands(points, by, gap, tile, previous_only)
    local = local.groupBy(*by, "_tile", "_local").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("end", "start").alias("_last_end"), *[f.alias(c) for c, f in folds.items()]
    )
    joined = _joined_islands(local, by, gap, previous_only)
    end = _closing_end(local, by, previous_only).alias("end")
    return joined.groupBy(*by, "island").agg(end, *[f.alias(c) for c, f in folds.items()]).withColumnRenamed("island", "start")


# --------------------------------------------------------------------------
# range joins


def _bins(start: Column, end: Column, size: Column | int) -> Column:
    return F.sequence(F.floor(start / size).cast("bigint"), F.floor(end / size).cast("bigint"))


def overlap_join(a: DataFrame, b: DataFrame, bin: int = 4096, levels: int = 4, by: Sequence[str] = ("seq_id",)) -> DataFrame:
    """All pairs of overlapping intervals on one sequence.

    Columns of ``b`` other than ``by`` come back with a ``b_`` prefix.

    Every interval has a home: the finest of ``levels`` grids (each 16 times as
    coarse as the one before) on which it covers at most two bins; the last
    grid takes the rest. A pair meets on the coarser of its two homes: one side
    is there at home, the other one comes up to it. Two intervals that are both
    only visiting a coarse grid never meet there, so long intervals cost a few
    rows and short ones are compared only nearby. Nobody comes up to a grid on
    which the other side has no home at all: which grids it has is read off its
    coordinates first. A pair is emitted in the bin of its larger start, so no
    ``distinct`` is needed.
    """
    right = b.select(*[F.col(c) if c in by else F.col(c).alias(f"b_{c}") for c in b.columns])
    left_homes, right_homes = _homes(a, bin, levels), _homes(b, bin, levels)
    left = _touched(_placed(a, "start", "end", bin, levels), "start", "end", bin, levels, right_homes, left=True)
    found = _touched(_placed(right, "b_start", "b_end", bin, levels), "b_start", "b_end", bin, levels, left_homes, left=False)
    size = _level_size(F.floor(F.col("_meet") / 2), bin, levels)
    pair = (
        (F.col("start") <= F.col("b_end"))
        & (F.col("b_start") <= F.col("end"))
        & (F.col("_bin") == F.floor(F.greatest("start", "b_start") / size).cast("bigint"))
    )
    joined = left.join(found, [*by, "_meet", "_bin"])
    return joined.where(pair).drop("_meet", "_bin")


def _home(start: Column, end: Column, bin: int, levels: int) -> Column:
    home = F.lit(levels - 1)
    for level in reversed(range(levels - 1)):
        home = F.when(end - start <= bin * 16**level, level).otherwise(home)
    return home


def _homes(t: DataFrame, bin: int, levels: int) -> Column:
    """One bit for each grid on which a row of ``t`` is at home, as a scalar subquery."""
    home = _home(F.col("start"), F.col("end"), bin, levels)
    bit = F.lit(0)
    for level in range(levels):
        bit = F.when(home == level, 1 << level).otherwise(bit)
    known = F.col("start").isNotNull() & F.col("end").isNotNull()
    return t.where(known).agg(F.coalesce(F.bit_or(bit), F.lit(0)).alias("homes")).scalar()


def _placed(t: DataFrame, start: str, end: str, bin: int, levels: int) -> DataFrame:
    return t.withColumn("_home", _home(F.col(start), F.col(end), bin, levels))


def _touched(t: DataFrame, start: str, end: str, bin: int, levels: int, other_homes: Column, left: bool) -> DataFrame:
    """One row per bin touched, as the host on the home grid and as a visitor on those of ``other_homes``.

    ``_meet`` is twice the grid, and one more where the right side is the host,
    so that host meets visitor. Two intervals with the same home meet once, with
    the left side as host.
    """
    own, other = (0, 1) if left else (1, 0)
    known = t.withColumn("_others", other_homes)
    meets = [F.col("_home") * 2 + own]
    for level in range(levels):
        up = F.col("_home") < level if left else F.col("_home") <= level
        meets.append(F.when(up & (F.col("_others").bitwiseAND(1 << level) != 0), level * 2 + other))
    up = known.withColumn("_meet", F.explode(F.array(*meets))).where(F.col("_meet").isNotNull()).drop("_home", "_others")
    return up.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), _level_size(F.floor(F.col("_meet") / 2), bin, levels))))


def _level_size(level: Column, bin: int, levels: int) -> Column:
    size = F.lit(bin * 16 ** (levels - 1)).cast("bigint")
    for i in reversed(range(levels - 1)):
        size = F.when(level == i, F.lit(bin * 16**i).cast("bigint")).otherwise(size)
    return size


def contain_join(children: DataFrame, regions: DataFrame, bin: int = 4096, levels: int = 4, by: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Children with each region that wholly contains them.

    A child looks only in the bin of its own start, because the region must
    cover that position; region columns come back with an ``r_`` prefix.
    """
    right = regions.select(*[F.col(c) if c in by else F.col(c).alias(f"r_{c}") for c in regions.columns])
    placed = _placed(right, "r_start", "r_end", bin, levels).withColumnRenamed("_home", "_level")
    size = _level_size(F.col("_level"), bin, levels)
    placed = placed.withColumn("_bin", F.explode(_bins(F.col("r_start"), F.col("r_end"), size)))
    probe = children.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    probe = probe.withColumn("_bin", F.floor(F.col("start") / _level_size(F.col("_level"), bin, levels)).cast("bigint"))
    inside = (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))
    return probe.join(placed, [*by, "_level", "_bin"]).where(inside).drop("_level", "_bin")


# --------------------------------------------------------------------------
# merging and selecting


def merge_intervals(
    t: DataFrame, by: str | Sequence[str] = "seq_id", gap: int = 0, label: str | None = None, tile: int = TILE
) -> DataFrame:
    """Unions of intervals that overlap or start within ``gap`` of the furthest end.

    Gives ``start``, ``end``, the number of intervals ``n`` and, when asked for,
    the label of the latest one. With closed coordinates no base is counted
    twice, so abutting unions need no shift.
    """
    keys = _by(by)
    last = F.struct("start", "end", *([label] if label else []))
    points = t.groupBy(*keys, "start").agg(
        F.max("end").alias("end"), F.count("*").alias("n"), *([F.max(last).alias("_last")] if label else [])
    )
    folds = {"n": F.sum("n"), **({"_last": F.max("_last")} if label else {})}
    out = _island_rows(points, keys, gap, tile, previous_only=False, **folds)
    return out.withColumn(label, F.col("_last")[label]).drop("_last") if label else out


def _first_per_start(t: DataFrame, by: Sequence[str], ties: Sequence[Column]) -> DataFrame:
    """One row per (by, start): the first one under ``ties``."""
    from .ordering import top_per_key

    return top_per_key(t, [*by, "start"], list(ties))


def select_disjoint(
    t: DataFrame,
    ties: Sequence[Column],
    by: str | Sequence[str] = "seq_id",
    tile: int = TILE,
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """In start order, keep a row iff it starts after the end of the last kept row.

    Rows with an equal start compete first (``ties``): a later one can never be
    kept. The table then falls apart into overlap islands, whose first row is
    always kept. Islands of at most ``fold_limit`` rows are folded in one
    expression; larger ones are solved by pointer doubling, with no bound on
    their size.
    """
    keys = _by(by)
    thin = materialize(_first_per_start(t, keys, ties))
    marked = materialize(_islands(thin.select(*keys, "start", "end"), keys, 0, tile, previous_only=False))
    large = marked.groupBy(*keys, "island").count().where(F.col("count") > fold_limit).drop("count")
    if large.isEmpty():
        kept = _fold_islands(marked, keys)
    else:
        small = marked.join(large, [*keys, "island"], "left_anti")
        big = materialize(marked.join(large, [*keys, "island"], "left_semi"))
        kept = _fold_islands(small, keys).unionByName(_jump_islands(big, keys, tile))
    return thin.join(kept, [*keys, "start"], "left_semi")


def _fold_islands(marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("start", "end")))
    folded = marked.groupBy(*keys, "island").agg(rows.alias("_rows"))
    start = F.struct(F.lit(-1).cast("bigint").alias("end"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, row: Column) -> Column:
        return F.when(
            row["start"] > acc["end"],
            F.struct(row["end"].alias("end"), F.concat(acc["kept"], F.array(row["start"])).alias("kept")),
        ).otherwise(acc)

    kept = F.aggregate("_rows", start, step)["kept"]
    return folded.select(*keys, F.explode(kept).alias("start"))


def _next_start(marked: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """For each row the first start behind its end, in the same island.

    Ends and starts are put on one line; the nearest start to the right is
    found inside the tile, or else carried in from the next tiles.
    """
    group = [*keys, "island"]
    ends = marked.select(*group, F.col("end").alias("_pos"), F.lit(None).cast("bigint").alias("_start")).distinct()
    starts = marked.select(*group, F.col("start").alias("_pos"), F.col("start").alias("_start"))
    line = ends.unionByName(starts).withColumn("_tile", _tile("_pos", tile))
    line = carry_over_tiles(line, group, F.min("_start"), "last", descending=True)
    # an end at x may only take starts > x: starts at x sort before the end at x when read backwards
    w = Window.partitionBy(*group, "_tile").orderBy(F.col("_pos").desc(), F.col("_start").asc_nulls_first())
    near = F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = line.withColumn("next", F.coalesce(near, F.col("_carry"))).where(F.col("_start").isNull())
    return marked.join(found.select(*group, F.col("_pos").alias("end"), "next"), [*group, "end"], "left")


def _jump_islands(marked: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Rows on the path first -> next -> ... of each island, by pointer doubling."""
    group = [*keys, "island"]
    jump = materialize(_next_start(marked, keys, tile).select(*group, "start", "next").where(F.col("next").isNotNull()))
    reached = marked.where(F.col("start") == F.col("island")).select(*group, "start")
    while True:
        # every pointer spans 2^k steps: the reached set doubles per round
        further = reached.join(jump, [*group, "start"]).select(*group, F.col("next").alias("start"))
        reached = materialize(reached.unionByName(further))
        onward = jump.select(*group, F.col("start").alias("next"), F.col("next").alias("_after"))
        jump = materialize(
            jump.join(onward, [*group, "next"]).select(*group, "start", F.col("_after").alias("next"))
        )
        if jump.isEmpty():
            return reached.select(*keys, "start")


def drop_overlapping_previous(
    t: DataFrame, ties: Sequence[Column], by: str | Sequence[str] = "seq_id", tile: int = TILE
) -> DataFrame:
    """Keep a row iff it starts after the end of the row just before it, kept or not."""
    keys = _by(by)
    thin = _first_per_start(t, keys, ties).withColumn("_tile", _tile("start", tile))
    thin = carry_over_tiles(thin, keys, F.max_by("end", "start"), "last")
    w = Window.partitionBy(*keys, "_tile").orderBy("start")
    before = F.coalesce(F.lag("end").over(w), F.col("_carry"))
    return thin.withColumn("_before", before).where(
        F.col("_before").isNull() | (F.col("start") > F.col("_before"))
    ).drop("_before", "_carry", "_tile")


def chain_signals(
    t: DataFrame, max_gap: int = 300, max_evalue: float = 1e-5, by: str | Sequence[str] = "seq_id", tile: int = TILE,
    keep_log: bool = False,
) -> DataFrame:
    """Join rows that start less than ``max_gap`` after the end of the row before.

    A signal ends with its last row, carries that row's score and the product
    of all e-values; it is kept when the product is at most ``max_evalue``. The
    product is a sum of logarithms with zero floored at 1e-300; ``keep_log``
    returns the sum too, since long products underflow. Rows with an equal
    start always chain, so they are aggregated before any ordering.
    """
    keys = _by(by)
    log_e = F.ln(F.greatest(F.col("evalue"), F.lit(1e-300)))
    points = t.groupBy(*keys, "start").agg(
        F.max("end").alias("end"),
        F.count("*").alias("n"),
        F.sum(log_e).alias("log_evalue"),
        F.max(F.struct("end", "score")).alias("_last"),
    )
    points = points.withColumn("_l", F.struct("start", "end", F.col("_last")["score"].alias("score"))).drop("_last")
    folds = {"_l": F.max("_l"), "n": F.sum("n"), "log_evalue": F.sum("log_evalue")}
    out = _island_rows(points, keys, max_gap - 1, tile, previous_only=True, **folds)
    kept = (
        out.select(
            *keys,
            "start",
            "end",
            F.col("_l")["score"].alias("score"),
            "n",
            F.exp("log_evalue").alias("evalue"),
            "log_evalue",
        )
        .where(F.col("log_evalue") <= F.ln(F.lit(max_evalue)))
    )
    return kept if keep_log else kept.drop("log_evalue")


# --------------------------------------------------------------------------
# coordinates


def flip_strand(t: DataFrame, lengths: DataFrame) -> DataFrame:
    """Coordinates counted from the other end of the sequence (P10): (len - end, len - start)."""
    return (
        t.join(lengths.select("seq_id", F.col("length").alias("_len")), "seq_id")
        .withColumns({"start": F.col("_len") - F.col("end"), "end": F.col("_len") - F.col("start")})
        .drop("_len")
    )


def slop(t: DataFrame, lengths: DataFrame, k: int = 2000) -> DataFrame:
    """Extend by ``k`` on both sides, clamped to the sequence."""
    return (
        t.join(lengths.select("seq_id", F.col("length").alias("_len")), "seq_id")
        .withColumns(
            {
                "start": F.greatest(F.col("start") - k, F.lit(1)).cast("bigint"),
                "end": F.least(F.col("end") + k, F.col("_len")).cast("bigint"),
            }
        )
        .drop("_len")
    )


def lift_over(t: DataFrame, scale: int = 1, parent_start: str = "e_start") -> DataFrame:
    """Part offsets inside an element -> coordinates on the sequence.

    ``scale=3`` reads the offsets as peptide positions.
    """
    base = F.col(parent_start)
    return t.withColumns(
        {
            "start": base + (F.col("start") - 1) * scale,
            "end": base + F.col("end") * scale - 1,
        }
    )


def renumber(
    t: DataFrame,
    prefix: str,
    ties: Sequence[Column | str] = (),
    children: DataFrame | None = None,
    id_col: str = "id",
    out: str = "new_id",
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Number elements from 1 by natural sequence order and start.

    With ``children`` (rows carrying ``parent``) they are returned as well,
    pointing at the new identifiers.
    """
    from ..functions.columns import natural_key

    numbered = number_rows(t, [natural_key("seq_id"), "seq_id", "start", "end", *ties], name="_number")
    numbered = numbered.withColumn(out, F.concat(F.lit(prefix), F.col("_number"))).drop("_number")
    if children is None:
        return numbered
    renamed = numbered.select(F.col(id_col).alias("parent"), F.col(out).alias("_p"))
    moved = children.join(renamed, "parent", "left").withColumn("parent", F.coalesce("_p", "parent")).drop("_p")
    return numbered, moved


def coordinate_sort(*tables: DataFrame, ties: Sequence[Column | str] = ()) -> DataFrame:
    """Several feature tables as one, in coordinate order."""
    merged = tables[0]
    for other in tables[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged.orderBy("seq_id", "start", F.col("end").desc(), *ties)
