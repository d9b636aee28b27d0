"""SimHash near-dedup with pivot distance tables (operator 3).

Fingerprints at ``MAX_BITS`` or fewer differing bits are linked, exactly:
of six blocks of a fingerprint at least two are untouched by four changes, so
every linked pair meets under one of fifteen pairs of blocks. Each fingerprint
carries a table of its Hamming distances to fixed reference fingerprints. By
the triangle inequality two linked fingerprints differ by at most ``MAX_BITS``
in every one of them: a crowded meeting place is cut by those distances before
any pair is formed, pairs are discarded by their largest coordinate
difference, and the rest are verified bit by bit.

Pivot distances alone cannot find the pairs: for near-random fingerprints one
distance keeps over half of all pairs, so an index on them would either visit
most pairs or repeat each row thousands of times. The blocks bring pairs
together; the tables discard them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import id_key, packed, text_or_empty
from .components import components

WORDS = 4
SEED = 42
MAX_BITS = 4
N_BLOCKS = 6  # two more than MAX_BITS
N_PIVOTS = 16
CROWD = 512  # a meeting place of more fingerprints is cut into tiles of so many
CELLS = 16 * CROWD  # one of more is cut into cells of pivot distances first, which repeats a row four times

OUTPUTS = ["fingerprint", "component_id"]


def _pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), seed=SEED) for i in range(N_PIVOTS)], np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of one text: bit set where over half of its shingles have it."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z changes, only ASCII space splits
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()]
    size = min(words, len(parts))
    ends = (ends - 1).tolist()[size - 1 :]
    digest = xxhash.xxh64_intdigest
    n, counts = len(ends), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text goes in pieces; counts add up
        piece = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])]
        counts += _bit_counts(np.array(piece, np.uint64))
    bits = np.packbits(2 * counts > n)
    return int.from_bytes(bits.tobytes(), "big")


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of ``h`` have each bit, most significant bit first."""
    rest = -len(h) % 255
    bits = np.unpackbits(np.concatenate([h, np.zeros(rest, np.uint64)]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, **more: Column
) -> DataFrame:
    """Rows (id, fp) and ``more`` columns of ``docs``; fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["id", "fp", *names])

    names = list(more)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), *[c.alias(n) for n, c in more.items()])
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in ["id", *names]]
    return rows.mapInArrow(run, ", ".join([kinds[0], "fp long", *kinds[1:]]))


def _block_bounds() -> list[tuple[int, int]]:
    cuts = [round(i * 64 / N_BLOCKS) for i in range(N_BLOCKS + 1)]
    return list(zip(cuts, cuts[1:]))


def linked(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that join up all fingerprints (column fp, distinct) within MAX_BITS of one another.

    Within a meeting place the edges form a forest with the same components as
    all its linked pairs, so their number is linear in the rows. No pair is
    skipped: a place of over CELLS rows is cut by the distances to two pivots,
    and what still has over CROWD rows is cut into tiles that all meet.
    """
    bounds = _block_bounds()
    masks = [((1 << (b - a)) - 1) << a for a, b in bounds]
    pairs = list(combinations(range(N_BLOCKS), 2))
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = [
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(masks[a] | masks[b]))).alias("key"))
        for i, (a, b) in enumerate(pairs)
    ]
    met = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    sizes = met.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    met = met.join(sizes, ["t", "key"])

    # the largest places: cells of width MAX_BITS + 1 on the first pivots; a row joins its own cell and the one below,
    # so two rows within MAX_BITS share a cell on every pivot
    pivots = _pivots()[:2]
    cells = [
        F.floor(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(int(p))))) / (MAX_BITS + 1)).cast("int") for p in pivots
    ]
    both = [F.array(c, c - 1) for c in cells]
    crowded = F.col("n") > CROWD
    here = F.array(F.struct(F.lit(-9).alias("c0"), F.lit(-9).alias("c1")))
    nearby = F.flatten(F.transform(both[0], lambda x: F.transform(both[1], lambda y: F.struct(x.alias("c0"), y.alias("c1")))))
    met = met.select("fp", "t", "key", F.explode(F.when(F.col("n") > CELLS, nearby).otherwise(here)).alias("c"), crowded.alias("crowded"))
    met = met.select("fp", "t", "key", "c.c0", "c.c1", "crowded")

    place = ["t", "key", "c0", "c1"]
    full = met.where("crowded").groupBy(*place).agg(F.count("*").alias("m"))
    tiles = F.ceil(F.col("m") / CROWD).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    hot = (
        met.where("crowded")
        .join(full.where(F.col("m") > 1).withColumn("g", tiles), place)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("fp", *place, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    cool = met.where(~F.col("crowded")).select("fp", *place, F.lit(0).alias("i"), F.lit(0).alias("j"))
    placed = cool.unionByName(hot).withColumn("place", F.xxhash64(*place, "i", "j")).select("place", "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(_edges, "a long, b long").distinct()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the places in sorted rows; a place that a batch cuts waits for its rest."""
    pivots = _pivots()
    place, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    for b in batches:
        place = np.concatenate([place, b.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        done = int(np.searchsorted(place == place[-1], True)) if len(place) else 0
        if done:
            yield _edge_batch(place[:done], fp[:done], pivots)
            place, fp = place[done:], fp[done:]
    if len(place):
        yield _edge_batch(place, fp, pivots)


def _edge_batch(place: np.ndarray, fp: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
    table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    sizes = np.diff(np.r_[starts, len(place)])
    group = np.repeat(np.arange(len(starts)), sizes)
    small = 64
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.flatnonzero(sizes[group] <= small)
    top = int(sizes[sizes <= small].max(initial=1))
    for shift in range(1, top):  # all pairs of the small places, one shift of the rows at a time
        a = rows[rows + shift < len(place)]
        a = a[group[a] == group[a + shift]]
        if not a.size:
            break
        found.append(_verified(a, a + shift, fp, table))
    for g in np.flatnonzero(sizes > small):
        at = np.arange(starts[g], starts[g] + sizes[g])
        found.extend(_forest(at, fp, table))
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])


def _verified(a: np.ndarray, b: np.ndarray, fp: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs left by the pivot table, then by their bits."""
    near = np.abs(table[a] - table[b]).max(axis=1) <= MAX_BITS
    a, b = a[near], b[near]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
    return a[near], b[near]


def _forest(at: np.ndarray, fp: np.ndarray, table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges joining all linked rows of one crowded place, at most one a row: a search that visits each row once.

    A row is compared with those not reached yet, so dense clusters shrink the
    remainder fast and are never paired up.
    """
    left, found = at, []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = np.abs(table[left] - table[x]).max(axis=1) <= MAX_BITS
            near[near] = np.bitwise_count(fp[left[near]] ^ fp[x]) <= MAX_BITS
            new = left[near]
            if new.size:
                found.append((np.full(new.size, x), new))
                queue.extend(new.tolist())
                left = left[~near]
    return found


def near_classes(rows: DataFrame, low: Column | str = "id") -> DataFrame:
    """Rows (id, fp, ...) with component_id, the smallest ``low`` (an id) that a row's fingerprint reaches."""
    nodes = rows.groupBy("fp").agg(F.min(low).alias("low"))
    roots = components(linked(nodes.select("fp")))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = labelled.join(lowest, "root").select("fp", "component_id")
    return rows.join(classes, "fp")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row (id, fingerprint, component_id) per row of ``docs``.

    Exact copies share a fingerprint and are one node, however many they are.
    Null and empty texts have fingerprint zero and link like any other; ids
    may repeat; a null id is never the smallest unless its component has no
    other. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, words))
    return near_classes(rows).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest id.

    Ids may repeat or be null: a row is told by its id and its text, of rows
    that share an id the one with the smallest digest of its text stays, and of
    rows that share both any one. A null id counts as larger than any other.
    Other columns go through; columns named like the outputs are replaced.
    """
    mark = F.unhex(F.md5(text_or_empty(text_col).cast("binary")))
    rows = materialize(fingerprints(docs, id_col, text_col, mark=mark))
    # components are told apart by their first row: several may have the same smallest id
    low = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    near = near_classes(rows, low).withColumnRenamed("component_id", "first")
    chosen = near.where(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")))
    key = ["_id", "_no_id", "_mark"]
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("id").alias("component_id")
    kept = chosen.select(*[c.alias(n) for n, c in id_key("id").items()], F.col("mark").alias("_mark"), *shown).dropDuplicates(key)
    joined = packed(docs, OUTPUTS, **id_key(id_col), _mark=mark).join(kept, key)
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    return joined.withColumn("_n", first).where("_n = 1").select("_row.*", *OUTPUTS)
