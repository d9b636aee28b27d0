"""Periodic runs of words by internal pattern matching (operator 13).

A run is a maximal stretch whose words repeat with a smallest period q at least
four times. For m, the power of two from q on, such a run contains an aligned
block of m words and, q words before or after it, an occurrence of the same
block; being as long as its period, the block stands nowhere else in between.
So each aligned block asks for its nearest occurrences on both sides: a range
successor query over its interval of the suffix array, answered by a wavelet
tree. Those occurrences that are m words away at most are the start of an
arithmetic progression, and its difference is a candidate period, which is
extended over equal words as far as it holds.

Texts are rows of their own, so nothing is shuffled. A task works on batches of
whole texts with arrays; codes of words are distinct between the texts of a batch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, packed, text_or_empty

#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS = 6
LEAST_POWERS = 4
#: Words of a batch; a longer text is a batch of its own.
BATCH = 1 << 16
#: Words whose codes a task remembers at most.
REMEMBERED = 400_000

OUTPUTS = ["runs", "collapsed"]


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of a batch, and its aligned blocks that occur more than once.

    ``ends`` has the end of each word's text; no suffix goes beyond. Prefix
    doubling sorts again only suffixes that still have equals. A level's equals
    are an interval that later levels permute but never leave; so a block's
    interval is known when its length is reached: (length, starts, from, to).
    """
    n = len(codes)
    sa = np.argsort(codes, kind="stable")
    rank, slots, first = np.empty(n, dtype=np.int64), np.arange(n), None
    sorted_keys, members = codes[sa], sa
    starts = np.zeros(n, dtype=np.int64)
    starts[ends[:-1][ends[:-1] != ends[1:]]] = 1
    text_start = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    length, blocks = 1, []
    while True:
        new = np.ones(len(members), dtype=bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(members)))
        low = np.repeat(slots[first], sizes)
        rank[members] = low
        often = np.repeat(sizes > 1, sizes)
        if not often.any():
            return sa, blocks
        members, slots, low, high = members[often], slots[often], low[often], (low + np.repeat(sizes, sizes))[often]
        if length > 1:
            whole = ((members - text_start[members]) % length == 0) & (members + length <= ends[members])
            if whole.any():
                blocks.append((length, members[whole], low[whole], high[whole]))
        after = members + length
        inside = after < ends[members]
        follow = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = low * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        sorted_keys, members = key[order], members[order]
        sa[slots] = members
        length *= 2


class WaveletTree:
    """Ranges of an array of numbers below ``bound``: how many are smaller, and the k-th smallest, for many queries at once."""

    def __init__(self, values: np.ndarray, bound: int):
        self.bits = max(1, (bound - 1).bit_length())
        self.levels = []
        rest = values.astype(np.int32)
        for bit in range(self.bits - 1, -1, -1):
            one = (rest >> bit & 1).astype(bool)
            zeros = np.zeros(len(rest) + 1, dtype=np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append(zeros)
            rest = np.concatenate([rest[~one], rest[one]])

    def smaller(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        count = np.zeros(len(low), dtype=np.int32)
        for level, zeros in enumerate(self.levels):
            a, b = zeros[low], zeros[high]
            one = (than >> (self.bits - 1 - level) & 1).astype(bool)
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return count

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        value = np.zeros(len(low), dtype=np.int32)
        for level, zeros in enumerate(self.levels):
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            value |= one.astype(np.int32) << (self.bits - 1 - level)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return value


def candidate_periods(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, periods): from a position on, at least a block of words is repeated a period later."""
    sa, blocks = suffix_array(codes, ends)
    if not blocks:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    lengths = np.concatenate([np.full(len(s), m) for m, s, _, _ in blocks])
    start, low, high = (np.concatenate([b[i] for b in blocks]).astype(np.int32) for i in (1, 2, 3))
    tree = WaveletTree(sa, len(sa))
    before = tree.smaller(low, high, start)
    positions, periods = [], []
    for step in (1, -1):  # range successor and predecessor of the block itself
        k = before + step
        some = (k >= 0) & (k < high - low)
        there = tree.kth(low[some], high[some], k[some])
        distance = np.abs(there - start[some])
        near = distance <= lengths[some]
        positions.append(np.minimum(there, start[some])[near])
        periods.append(distance[near])
    return np.concatenate(positions).astype(np.int64), np.concatenate(periods).astype(np.int64)


def batch_runs(codes: np.ndarray, sizes: list[int]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text of a batch, by start, then period; codes differ between texts."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if len(codes) == 0:
        return out
    positions, periods = candidate_periods(codes, np.repeat(bounds[1:], sizes))
    text = np.searchsorted(bounds, positions, "right") - 1
    order = np.lexsort((positions, periods, text))
    positions, periods, text = positions[order], periods[order], text[order]
    change = np.ones(len(order), dtype=bool)
    change[1:] = (text[1:] != text[:-1]) | (periods[1:] != periods[:-1])
    heads = np.append(np.flatnonzero(change), len(order))
    for h, t in zip(heads[:-1], heads[1:]):
        d, q = int(text[h]), int(periods[h])
        words = codes[bounds[d] : bounds[d + 1]]
        unlike = np.concatenate([[-1], np.flatnonzero(words[:-q] != words[q:]), [len(words) - q]])
        gap = np.unique(np.searchsorted(unlike, positions[h:t] - bounds[d], "left"))
        first, length = unlike[gap - 1] + 1, unlike[gap] - unlike[gap - 1] - 1 + q
        for a, n in zip(first.tolist(), length.tolist()):
            if n >= max(LEAST_WORDS, LEAST_POWERS * q):
                out[d].append((a, n, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


class Words(defaultdict):
    """A number for each word."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__


def scan_texts(texts: Iterator[str], table: Words) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """(runs, text without the repeats of runs) of each text, in order."""

    def flush(held: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
        if len(table) > REMEMBERED:
            table.clear()
        sizes = [len(w) for w in held]
        flat = np.fromiter((table[w] for words in held for w in words), dtype=np.int64, count=sum(sizes))
        codes = np.repeat(np.arange(len(held)), sizes) * len(table) + flat
        for words, runs in zip(held, batch_runs(codes, sizes)):
            if runs:
                keep = np.ones(len(words), dtype=bool)
                for start, length, period in runs:
                    keep[start + period : start + length] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            yield runs, b" ".join(words).decode()

    held, total = [], 0
    for text in texts:
        words = text.encode().split()  # bytes are split at ASCII white space only
        if held and total + len(words) > BATCH:
            yield from flush(held)
            held, total = [], 0
        held.append(words)
        total += len(words)
    yield from flush(held)


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with runs (array of start, length, period, in words, by start, then period) and collapsed.

    collapsed is the text's words, joined by one space, without those that
    stand after the first period of any run. Null and empty texts have no words,
    no runs, and an empty collapsed. Every row is judged by itself. Other
    columns go through; columns named like the outputs are replaced.
    """

    @F.pandas_udf("start array<long>, length array<long>, period array<long>, collapsed string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = Words()
        for texts in batches:
            rows = []
            for runs, collapsed in scan_texts(iter(texts), table):
                rows.append((*(([r[i] for r in runs]) for i in range(3)), collapsed))
            yield pd.DataFrame(rows, columns=["start", "length", "period", "collapsed"])

    found = packed(docs, OUTPUTS, found=run(text_or_empty(F.col(f"`{text_col}`"))))
    return found.select("_row.*", F.arrays_zip("found.start", "found.length", "found.period").alias("runs"), F.col("found.collapsed").alias("collapsed"))


def id_hash(doc_id: Column) -> Column:
    """crc32 of the decimal id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) where every tenth document, by hash, goes round in its own words from a place on.

    With h the hash of the id, g = h DIV 10 and n words: word i from a = g % n on
    becomes word a + (i - a) % p, p = 1 + (n - a) DIV (3 + g % 8).
    """
    text = text_or_empty(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias("_text"), id_hash(F.col(f"`{id_col}`")).alias("_h"))
    looped = F.col("_h") % 10 == 0
    rows = rows.withColumn("_words", F.when(looped, F.filter(F.split("_text", SPACES), lambda w: w != "")))
    n, g = F.size("_words"), F.expr("_h DIV 10")
    rows = rows.withColumn("_n", F.when(looped & (n > 0), n)).withColumn("_a", (g % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", F.expr("CAST(1 + (_n - _a) DIV (3 + (_h DIV 10) % 8) AS INT)"))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    turned = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_words", place(i)))
    return rows.select(id_col, F.when(F.col("_n").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("_text")).alias("text"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what ``periodic_runs`` gives.

    The run named is the longest; ties: smallest start, then period.
    """
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), longest.alias("b"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select(
        id_col,
        "n_runs",
        (-F.col("b.back")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.q")).alias("period"),
        F.expr("1000 * b.length DIV -b.q").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
