"""Packing documents into sequences by order-preserving dynamic programming (operator 12).

The documents of a partition, in its order, are one stream of ids. Cuts may
fall at document ends (free), sentence ends, and inside long stretches without
either; each window between two cuts is a sequence. The cheapest cuts minimise
padding plus penalties. As padding falls by one with every id, the best
previous cut of all positions comes from one monotone queue; windows of exactly
a power of two, which need no padding, are further transitions. The last window
of the stream may fall apart into powers of two.

No row is shuffled: every partition packs what it reads, a block of ids at a
time. A cut chosen in one block is final up to the block's last window, whose
ids go on into the next block.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .bpe import byte_letters
from .common import text_or_empty

VOCABULARY = "word_bpe_49k.json"
SIZE = 4096
#: Stands behind every document.
END_ID = 2

# Costs in ids of padding: a cut at a sentence end, a cut within a sentence, a sequence.
SENTENCE_CUT = 1
INNER_CUT = 8
SEQUENCE_COST = 4

#: A cut is offered at least every so many ids.
STRIDE = 32
#: Shortest window that may stand alone as a power of two before the stream's end.
LEAST_POWER = 256
#: Ids planned at once.
BLOCK = 1 << 20
#: Words a worker remembers; with more than that it keeps those of the texts at hand only.
REMEMBERED = 600_000
#: Letters of the texts whose new words are looked up together.
TOGETHER = 1 << 20
#: Numbers of sequences that one partition can give.
NUMBERS = 1 << 40

# Letters whose lower case and normal form concern one character alone, between marks that cannot start a contraction.
PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-į]+)([!-/:-@\[-`{-~]*)")

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Words:
    """Ids of each word as packed 32-bit numbers, looked up in the tokenizer once.

    The tokenizer removes white space and looks at nothing across it, so a
    text's ids are those of its words. A word of plain Latin letters between
    punctuation marks falls into these three parts, each of which goes to the
    tokenizer's merges at once; all other new words go through all its steps.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.known.get(part)
        if ids is None:
            raw = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            ids = self.known[part] = np.array([t.id for t in self.model.tokenize(raw)], dtype="<u4").tobytes()
        return ids

    def _learn(self, words: set[str]) -> None:
        """Remember ``words``; what was known before goes if there are too many."""
        known = self.known
        if len(known) + len(words) > REMEMBERED:
            known.clear()
        hard = []
        for word in words:
            parts = PLAIN.fullmatch(word)
            if parts is None or "<|" in word:
                hard.append(word)
                continue
            lead, core, tail = parts.groups()
            ids = self._part(core.lower())
            if lead or tail:
                ids = (self._part(lead) if lead else b"") + ids + (self._part(tail) if tail else b"")
            known[word] = ids
        for i in range(0, len(hard), 4096):
            some = hard[i : i + 4096]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[word] = np.array(found.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end id behind them."""
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*parts).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                new = set().union(*parts)
            self._learn(new)
        get, end = self.known.__getitem__, END_ID.to_bytes(4, "little")
        return [np.frombuffer(b"".join(map(get, p)) + end, dtype="<u4") for p in parts]


def sentence_ends(spec: str) -> np.ndarray:
    """For each id, whether its token ends with a full stop, question or exclamation mark."""
    vocab: dict[str, int] = json.loads(spec)["model"]["vocab"]
    marks = {c: b for b, c in byte_letters().items()}
    out = np.zeros(max(vocab.values()) + 1, dtype=bool)
    for token, i in vocab.items():
        raw = bytes(marks[c] for c in token.removesuffix("</w>") if c in marks)
        out[i] = raw.decode("utf-8", "ignore").endswith((".", "!", "?", "。", "！", "？"))
    return out


def candidates(doc_ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of possible cuts; a position counts the ids before it, the first is 0 and the last the end."""
    total = int(doc_ends[-1])
    at = np.unique(np.concatenate([[0], doc_ends, sentences]))
    at = at[at <= total]
    wide = np.flatnonzero(np.diff(at) > STRIDE)
    more = [np.arange(at[i] + STRIDE, at[i + 1], STRIDE) for i in wide]
    every = np.sort(np.concatenate([at, *more]))
    cost = np.full(len(every), INNER_CUT)
    cost[np.searchsorted(every, sentences[sentences <= total])] = SENTENCE_CUT
    cost[np.searchsorted(every, doc_ends)] = 0
    cost[0] = 0
    return every, cost


def _powers(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def tail_cost(length: int, size: int) -> tuple[int, bool]:
    """Cheapest way to end a stream with ``length`` ids, and whether as powers of two."""
    parts = length.bit_count()
    apart = parts * SEQUENCE_COST + (parts - 1) * INNER_CUT
    padded = size - length + SEQUENCE_COST
    return (apart, True) if apart < padded else (padded, False)


def plan(at: np.ndarray, penalty: np.ndarray, size: int = SIZE, final: bool = True) -> list[int]:
    """Positions that end the windows of least total cost, in order; those of the last window fall apart if that is cheaper.

    ``at`` starts with 0 and rises by ``size`` at most. Unless ``final``, the
    last window is open and costs nothing.
    """
    pos, pen = at.tolist(), penalty.tolist()
    m = len(pos) - 1
    exact: list[tuple[int, ...]] = [()] * (m + 1)
    place = np.full(pos[-1] + 1, -1, dtype=np.int64)
    place[at] = np.arange(len(at))
    power = LEAST_POWER
    while power < size:
        ends = np.flatnonzero(at >= power)
        back = place[at[ends] - power]
        for j, i in zip(ends[back >= 0].tolist(), back[back >= 0].tolist()):
            exact[j] += (i,)
        power *= 2
    best, came, keys = [0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    queue, head, tail = [0] * (m + 1), 0, 0  # indices whose key, best + pos, rises: the first is the best start of a padded window
    for j in range(1, m):
        p = pos[j]
        while pos[queue[head]] < p - size:
            head += 1
        i = queue[head]
        least = keys[i] + size - p
        for e in exact[j]:
            if best[e] < least:
                least, i = best[e], e
        least += pen[j] + SEQUENCE_COST
        best[j], came[j] = least, i
        keys[j] = key = least + p
        while tail >= head and keys[queue[tail]] >= key:
            tail -= 1
        tail += 1
        queue[tail] = j
    first = bisect_left(pos, pos[m] - size)
    if final:
        i = min(range(first, m), key=lambda i: best[i] + tail_cost(pos[m] - pos[i], size)[0])
    else:
        i = min(range(first, m), key=best.__getitem__)
    out, last = [], i
    while i:
        out.append(pos[i])
        i = came[i]
    out.reverse()
    length = pos[m] - pos[last]
    parts = _powers(length) if final and tail_cost(length, size)[1] else [length]
    start = pos[last]
    for part in parts:
        start += part
        out.append(start)
    return out


class Packer:
    """Pieces of a stream of documents; memory holds a block, or one document where that is longer."""

    def __init__(self, ends: np.ndarray, size: int, first_number: int):
        self.ends, self.size, self.number = ends, size, first_number
        self.waiting: list[list] = []  # [key, ids, ids taken]
        self.held = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        self.waiting.append([key, ids, 0])
        self.held += len(ids)
        if self.held >= max(BLOCK, 4 * self.size):
            yield from self._flush(final=False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._flush(final=True)

    def _flush(self, final: bool) -> Iterator[tuple]:
        flat = np.concatenate([ids[taken:] for _, ids, taken in self.waiting])
        doc_ends = np.cumsum([len(ids) - taken for _, ids, taken in self.waiting])
        sentences = np.flatnonzero(self.ends[np.minimum(flat, len(self.ends) - 1)]) + 1
        cuts = plan(*candidates(doc_ends, sentences), self.size, final)
        if not final:
            cuts.pop()
        raw, doc, start = memoryview(flat.tobytes()), 0, 0
        for cut in cuts:
            offset = 0
            while start < cut:
                key, ids, taken = self.waiting[doc]
                n = min(cut, int(doc_ends[doc])) - start
                yield key, taken, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(ids), self.number, offset, ids[taken : taken + n]
                self.waiting[doc][2] += n
                offset += n
                start += n
                doc += self.waiting[doc][2] == len(ids)
            self.number += 1
        self.waiting = self.waiting[doc:]
        self.held = len(flat) - start


def pack(docs: DataFrame, size: int = SIZE, with_ids: bool = True, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Sequences follow the order of the rows in each partition and never cross
    partitions; their ids rise in that order. Null and empty texts are the end
    id alone. Repeated rows and rows without an id are documents of their own.
    Columns other than the id do not go through. An empty table gives no pieces.
    """
    if size < LEAST_POWER or size & (size - 1):
        raise ValueError(f"size must be a power of two from {LEAST_POWER} on")
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"spec": f.read()})  # a file of fixed size
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = StructType([StructField("key", rows.schema["key"].dataType), *StructType.fromDDL(PIECES + (", ids array<int>" if with_ids else "")).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "words" not in held:  # beside the broadcast value, so that a worker's later tasks know the words of earlier ones
            held.update(words=Words(held["spec"]), ends=sentence_ends(held["spec"]))
        packer = Packer(held["ends"], size, TaskContext.get().partitionId() * NUMBERS)
        kind = None

        def made(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            if with_ids:
                lengths = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(lengths, np.concatenate(columns[7]).astype(np.int32)))
            return pa.record_batch(arrays, names=["key", *names, *(["ids"] if with_ids else [])])

        def pieces() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
                at = 0
                while at < len(sizes):
                    to = max(at + 1, int(np.searchsorted(sizes, TOGETHER + (sizes[at - 1] if at else 0), "right")))
                    some = batch.slice(at, to - at)
                    for key, ids in zip(some.column(0).to_pylist(), held["words"].encode(some.column(1).to_pylist())):
                        yield from packer.add(key, ids)
                    at = to
            yield from packer.finish()

        some = []
        for piece in pieces():
            some.append(piece)
            if len(some) >= 4096:
                yield made(some)
                some = []
        if some:
            yield made(some)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def sequences(pieces: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_pad): the training sequences of ``pack``'s pieces, padded to ``size`` unless a power of two long.

    A sequence has ``size`` ids at most, so a group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(size - n)
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("ids"), pad.cast("long").alias("n_pad"))


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """One row: n_sequences, n_tokens, n_padding and n_cuts (ends of sequences inside a document)."""
    each = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.max(F.struct("offset", (F.col("start") + F.col("length") < F.col("doc_tokens")).alias("cut"))).alias("last")
    )
    n = F.col("n")
    pad = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(size - n)
    return each.agg(
        F.count("*").alias("n_sequences"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(pad), F.lit(0)).alias("n_padding"),
        F.coalesce(F.sum(F.col("last.cut").cast("long")), F.lit(0)).alias("n_cuts"),
    )
