"""LM scoring with a hierarchical Pitman-Yor model (operator 5).

Four kinds of restaurants share parents. Every document is a context of its
own, whose restaurant fills while the document is read, one table for each of
its words, and orders new tables from the restaurant of the preceding word's
ending: there is one for every two bytes that a word can end with, and one for
the start of a text. These have the training tokens as customers. Their tables
are the customers of the restaurant of the corpus, which orders from a spelling
model; that has one restaurant for every context of ORDER bytes, whose tables
are customers of the context shorter by one byte, down to the empty context
over a uniform choice of bytes. Seating is sampled by Gibbs sweeps, all
customers of one dish at a time, each in turn opening a table or joining one;
predictive probabilities are averaged over the sweeps after burn-in.

Words meet counts by chunks of documents, cut where the documents are read. Each
chunk asks for its own distinct pairs of a word and an ending before it, dealt
into shards of the vocabulary, and keeps its documents as places in these pairs.
It gets back the probability of each pair, so texts are read once and never
shuffled, and no vocabulary is held whole anywhere.
A word is one row with the counts and tables of its endings, 65536 at most;
customers and tables of all words after an ending are two vectors of that
length, the only state of these restaurants that is sent around. The spelling
model goes to the driver and is broadcast. It has contexts of ORDER bytes at
every size of the input, so its memory grows with the number of different
spellings.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .common import id_remainder, text_or_empty

LETTERS_PER_CHUNK = 6_000_000  # text that one task holds, besides a single longer document
CHUNKS_PER_SHARD = 2  # of the vocabulary
SWEEPS, BURN_IN = 4, 2
WORD_STRENGTH = 10.0
ENDINGS, ENDING_STRENGTH = 1 << 16, 20.0  # of preceding words: their last two bytes
SPELL_DISCOUNT, SPELL_STRENGTH = 0.5, 2.0
DOCUMENT_DISCOUNT, DOCUMENT_STRENGTH = 0.6, 300.0
ORDER = 4  # bytes of the longest spelling contexts
JUMPS, BLOCK = 48, 1 << 16  # openings of a dish that are jumped to; customers seated at once after them
SMOOTH = 0.1  # of the base score
END = b""  # the end of a text, counted as a token; no word is empty


def tokens(text: str) -> list[bytes]:
    """Words, A-Z in lower case; the end is not among them."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on seed and step only, so that a task run again draws the same."""
    z = seed.astype(np.uint64) + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, seed: np.ndarray, step: int) -> np.ndarray:
    """Tables that each dish gets when its customers sit down one after another.

    A customer opens a table with odds ``pull`` (strength and tables of the
    restaurant times the dish's parent probability) against the customers
    seated less ``discount`` a table. The chance falls from customer to
    customer, so the next opening is drawn by thinning a geometric jump. A dish
    that is not done after JUMPS opens tables often, and the rest of its
    customers sit down in blocks. Both are exact at every size.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    seated = np.ones(at.size)
    n, a, key = customers[at].astype(float), pull[at], seed[at]
    t = np.ones(at.size)
    step *= 1 << 20
    for _ in range(JUMPS):
        if not at.size:
            break
        p = a / (seated - discount * t + a)
        jump = np.floor(np.log(uniform(key, step)) / np.log1p(-np.minimum(p, 1 - 1e-12))) + 1
        arrive = seated + jump
        inside = arrive <= n
        chance = (seated - discount * t + a) / (arrive - 1 - discount * t + a)
        opened = inside & (uniform(key, step + 1) < chance)
        t = t + opened
        tables[at[opened]] = t[opened].astype(np.int64)
        at, n, a, key, t, seated = at[inside], n[inside], a[inside], key[inside], t[inside], arrive[inside]
        step += 2
    for i, *dish in zip(at, n, a, t, seated, key):
        tables[i] = _seat_rest(*dish, discount, step)
    return tables


def _seat_rest(n: float, a: float, t: float, seated: float, key: np.uint64, d: float, step: int) -> int:
    """Tables of one dish when all its customers have sat down.

    Who opens a table of a block depends on the openings before, which only make
    later ones likelier. Starting from none and counting anew until the count
    stands still gives what seating one by one gives with the same numbers.
    """
    while seated < n:
        before = seated + np.arange(min(BLOCK, int(n - seated)))
        drawn = uniform(key ^ (before.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), step)
        opened, tables = -1, np.full(len(before), t)
        while True:
            opens = drawn < a / (before - d * tables + a)
            if opens.sum() == opened:
                break
            opened = opens.sum()
            tables = t + np.cumsum(opens) - opens
        t, seated = t + opened, seated + len(before)
    return int(t)


class Spelling:
    """Restaurants of all spelling contexts; a code is the bytes of a context and the byte after it."""

    def __init__(self, codes: np.ndarray, order: int):
        self.order = order
        self.codes = [np.empty(0, np.int64)] * (order + 1)
        self.codes[order] = np.sort(codes.astype(np.int64))
        self.parent: list[np.ndarray] = [np.empty(0, np.int64)] * (order + 1)
        for k in range(order, 0, -1):
            self.codes[k - 1], self.parent[k] = np.unique(self.codes[k] & ((1 << 8 * k) - 1), return_inverse=True)
        found = [np.unique(c >> 8, return_inverse=True) for c in self.codes]
        self.contexts, self.context = [f[0] for f in found], [f[1] for f in found]
        # before the first sweep: one table a dish, bytes alike
        self.p = [np.full(len(c), 1 / 256) for c in self.codes]
        self.tables = [np.bincount(c).astype(float) for c in self.context]
        self.back = [np.ones(len(c)) for c in self.contexts]

    def sweep(self, customers: np.ndarray, step: int) -> None:
        """Seat everyone anew from the longest contexts to the empty one, then predict the other way round.

        ``customers`` of the longest contexts, in the order of their codes.
        """
        d, s = SPELL_DISCOUNT, SPELL_STRENGTH
        seats = []
        for k in range(self.order, -1, -1):
            above = self.p[k - 1][self.parent[k]] if k else np.full(len(self.codes[0]), 1 / 256)
            seeds = (self.codes[k].astype(np.uint64) + np.uint64(k << 56)) * np.uint64(0x2545F4914F6CDD1D)
            t = seat(customers, (s + d * self.tables[k][self.context[k]]) * above, d, seeds, 8 * step + k)
            seats.append((k, customers, t))
            if k:
                customers = np.bincount(self.parent[k], weights=t, minlength=len(self.codes[k - 1])).astype(np.int64)
        for k, c, t in reversed(seats):
            of = self.context[k]
            n = np.bincount(of, weights=c, minlength=len(self.contexts[k]))
            self.tables[k] = np.bincount(of, weights=t, minlength=len(self.contexts[k]))
            self.back[k] = (s + d * self.tables[k]) / (s + n)
            above = self.p[k - 1][self.parent[k]] if k else 1 / 256
            self.p[k] = (c - d * t) / (s + n)[of] + self.back[k][of] * above

    def state(self) -> dict:
        """What predictions need, as it is now, in plain arrays: broadcasts travel without this module."""
        return {"order": self.order, "codes": self.codes, "contexts": self.contexts, "p": list(self.p), "back": list(self.back)}

    @classmethod
    def restored(cls, state: dict) -> Spelling:
        out = cls.__new__(cls)
        vars(out).update(state)
        return out

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of codes, and which are known; the same in all samples."""
        return _lookup(self.codes[self.order], codes)

    def of(self, codes: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Probability of the last byte of each code after its context; one not seen takes the share of shorter ones."""
        k = self.order
        p = np.where(known, self.p[k][at] if len(self.p[k]) else 0.0, 0.0)
        if not known.all():
            p[~known] = self._unseen(codes[~known])
        return p

    def _unseen(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1 / 256)
        for k in range(self.order + 1):
            part = codes & ((1 << 8 * (k + 1)) - 1)
            at, known = _lookup(self.codes[k], part)
            inside, context = _lookup(self.contexts[k], part >> 8)
            if len(self.codes[k]):
                p = np.where(known, self.p[k][at], np.where(context, self.back[k][inside] * p, p))
        return p

    def words(self, spelled: list[bytes]) -> np.ndarray:
        """log10 probability of each word, its end included."""
        codes, lengths = codes_of(spelled, self.order)
        if not len(lengths):
            return np.zeros(0)
        return _per_word(self.of(codes, *self.find(codes)), lengths)


def _per_word(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.log10(p), np.cumsum(lengths) - lengths)


def _lookup(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def codes_of(spelled: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of every byte of the words and of their ends, and how many each word has.

    Spaces stand before a word and one after it; no word holds a space.
    """
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
    if not len(spelled):
        return np.zeros(0, np.int64), lengths
    edge = b" " * order
    raw = np.frombuffer(b"".join(edge + w + b" " for w in spelled), np.uint8).astype(np.int64)
    n = len(raw) - order
    codes = np.zeros(n, np.int64)
    for i in range(order + 1):
        codes = (codes << 8) | raw[i : i + n]
    first = np.cumsum(lengths + order) - lengths - order  # of each word's code
    at = np.repeat(first - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
    return codes[at], lengths


@dataclass
class Model:
    """Sampled sweeps of the restaurants; what they say of single words stays distributed.

    A sample is the spelling state, the weight of new tables of the corpus, for
    each ending the weight of its new tables, customers and strength of the
    corpus, and the sweep; ``seated`` has each ending's customers and strength.
    """

    samples: list[tuple[dict, float, np.ndarray, float, int]]
    discounts: tuple[float, float]  # of the endings and of the corpus
    seated: np.ndarray
    tokens: int
    distinct: int

    def unseen(self, words: list[bytes]) -> np.ndarray:
        """Probability in the corpus of words that have no customer, a row a sample."""
        if not words:
            return np.zeros((len(self.samples), 0))
        first = Spelling.restored(self.samples[0][0])
        codes, lengths = codes_of(words, first.order)
        found = first.find(codes)
        spelled = [Spelling.restored(state).of(codes, *found) for state, *_ in self.samples]
        return np.array([w * 10.0 ** _per_word(p, lengths) for p, (_, w, *_) in zip(spelled, self.samples)])


def seeds_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def endings(words: list[bytes]) -> np.ndarray:
    """The last two bytes of each word as a number; 0 for the end of a text, behind which the next one starts."""
    return np.fromiter((int.from_bytes(w[-2:], "big") for w in words), np.int64, len(words))


def squeezed(raw: np.ndarray | bytes) -> bytes:
    """What chunks and shards exchange, compressed: most counts and sizes are small."""
    return zstandard.compress(raw if isinstance(raw, bytes) else raw.tobytes(), 3)


def _released(column: pa.ChunkedArray | pd.Series, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(x), kind) for x in (column.to_pylist() if isinstance(column, pa.ChunkedArray) else column)]


@dataclass
class Read:
    """Texts as numbers of words, in an order that depends on the words alone."""

    words: list[bytes]  # by shard, then by spelling
    first: np.ndarray  # place of each shard's first word, and the number of words
    pairs: np.ndarray  # word * ENDINGS + ending before it, distinct, in order
    at: np.ndarray  # word of each token
    pair: np.ndarray  # place of each token's pair
    lengths: np.ndarray  # tokens of each text

    @classmethod
    def of(cls, texts: list[str], shards: int) -> Read:
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        at, lengths = [], []
        for text in texts:
            before = len(at)
            at.extend(map(ids.__getitem__, tokens(text)))
            at.append(ids[END])
            lengths.append(len(at) - before)
        words = list(ids)
        shard = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(shard[order], kind="stable")]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words, number = [words[i] for i in order], place[np.array(at, np.int64)]
        before = np.r_[0, endings(words)[number[:-1]]]
        pairs, pair = np.unique(number * ENDINGS + before, return_inverse=True)
        first = np.searchsorted(shard[order], np.arange(shards + 1))
        return cls(words, first, pairs, number, pair, np.array(lengths, np.int64))


def chunked(docs: DataFrame, id_col: str, text_col: str, held_out: int, modulus: int) -> tuple[DataFrame, int]:
    """Rows (id, text, held_out), and the number of shards of the vocabulary."""
    text = text_or_empty(text_col)
    letters = docs.agg(F.sum(F.length(text))).first()[0] or 0
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), (id_remainder(id_col, modulus) == held_out).alias("held_out"))
    return rows, max(1, math.ceil(letters / (LETTERS_PER_CHUNK * CHUNKS_PER_SHARD)))


ASKED = ["shard", "chunk", "words", "sizes", "endings", "n"]
KEPT = ["chunk", "ids", "held_out", "lengths", "pair", "sizes"]


def chunk_words(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of two kinds, for each chunk, which is what a task reads until it has LETTERS_PER_CHUNK.

    What it asks of a shard: its distinct words in order, joined by spaces, for
    each the number of endings before it, these endings, and the training count
    of each pair. And, without a shard, its documents: ids, which are held out,
    tokens of each, the place of each token's pair, and the sizes of all words.
    """
    limit, kind = LETTERS_PER_CHUNK, rows.schema["id"].dataType.simpleString()

    def batch(columns: dict[str, list], ids: pa.Array) -> pa.RecordBatch:
        size = len(columns["chunk"])
        kinds = {"shard": pa.int32(), "chunk": pa.int64(), "ids": pa.list_(ids.type)}
        names = ["shard", "chunk", "words", "sizes", "endings", "n", "ids", "held_out", "lengths", "pair"]
        made = [columns[x] if x == "ids" and x in columns else pa.array(columns.get(x, [None] * size), kinds.get(x, pa.binary())) for x in names]
        return pa.RecordBatch.from_arrays(made, names)

    def read(chunk: int, docs: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(docs).combine_chunks()
        ids = pa.concat_arrays(table.column("id").chunks)
        held_out = table.column("held_out").to_numpy().astype(bool)
        got = Read.of(table.column("text").to_pylist(), shards)
        n = np.bincount(got.pair[np.repeat(~held_out, got.lengths)], minlength=len(got.pairs)).astype(np.int32)
        ending, word = (got.pairs % ENDINGS).astype(np.uint16), got.pairs // ENDINGS
        sizes = np.bincount(word, minlength=len(got.words)).astype(np.int32)
        cut = np.searchsorted(word, got.first)
        asked = [(s, a, b, x, y) for s, (a, b, x, y) in enumerate(zip(got.first, got.first[1:], cut, cut[1:])) if b > a]
        yield batch({
            "shard": [s for s, *_ in asked], "chunk": [chunk] * len(asked),
            "words": [squeezed(b" ".join(got.words[a:b])) for _, a, b, _, _ in asked],
            "sizes": [squeezed(sizes[a:b]) for _, a, b, _, _ in asked],
            "endings": [squeezed(ending[x:y]) for *_, x, y in asked],
            "n": [squeezed(n[x:y]) for *_, x, y in asked],
        }, ids)
        yield batch({
            "chunk": [chunk], "sizes": [squeezed(sizes)], "ids": pa.ListArray.from_arrays([0, len(ids)], ids),
            "held_out": [squeezed(held_out)], "lengths": [squeezed(got.lengths)], "pair": [squeezed(got.pair.astype(np.int32))],
        }, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, letters, docs = TaskContext.get().partitionId() << 32, 0, []
        for b in batches:
            first = 0
            for i, size in enumerate(pc.utf8_length(b.column("text")).to_pylist()):
                letters += size
                if letters >= limit:
                    yield from read(chunk, [*docs, b.slice(first, i + 1 - first)])
                    chunk, letters, docs, first = chunk + 1, 0, [], i + 1
            if first < b.num_rows:
                docs.append(b.slice(first))
        if docs:
            yield from read(chunk, docs)

    columns = f"ids array<{kind}>, held_out binary, lengths binary, pair binary"
    asked = "shard int, chunk long, words binary, sizes binary, endings binary, n binary"
    return rows.select("id", "text", "held_out").mapInArrow(run, f"{asked}, {columns}")


def asked_of_shards(chunks: DataFrame) -> DataFrame:
    return chunks.where("shard IS NOT NULL").select(*ASKED)


def _joined(column: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


class Asked:
    """All that chunks ask of one shard: its words, the distinct pairs with their training counts, and who asked."""

    def __init__(self, pdf: pd.DataFrame):
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        self.of_word = [np.fromiter(map(ids.__getitem__, zstandard.decompress(w).split(b" ")), np.int64) for w in pdf["words"]]
        sizes, ending, n = (_released(pdf[x], kind) for x, kind in (("sizes", np.int32), ("endings", np.uint16), ("n", np.int32)))
        code = np.repeat(np.concatenate(self.of_word), np.concatenate(sizes)) * ENDINGS + np.concatenate(ending)
        self.ids, self.words = ids, list(ids)
        self.pairs, of_pair = np.unique(code, return_inverse=True)
        self.n = np.bincount(of_pair, weights=np.concatenate(n), minlength=len(self.pairs)).astype(np.int64)
        self.word = self.pairs // ENDINGS
        self.c = np.bincount(self.word, weights=self.n, minlength=len(self.words)).astype(np.int64)
        self.of_pair = np.split(of_pair, np.cumsum([len(x) for x in n])[:-1])


VOCABULARY = "shard int, word binary, c long, endings binary, k binary, tables binary, customers long, t long, sum binary, p binary"


def vocabulary(chunks: DataFrame) -> DataFrame:
    """Words of the training rows: count, the endings before them with their counts, each pair with one table, and
    these tables as customers at one table of the corpus; nothing sampled yet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = Asked(pdf)
        seen = got.n > 0
        pairs, n, word = got.pairs[seen], got.n[seen], got.word[seen]
        own, first, size = np.unique(word, return_index=True, return_counts=True)
        ending, ones = (pairs % ENDINGS).astype(np.uint16), np.ones(len(pairs), np.int32)
        cut = list(zip(first, first + size))
        return pd.DataFrame({
            "shard": int(pdf["shard"].iloc[0]), "word": [got.words[w] for w in own], "c": got.c[own],
            "endings": [ending[a:b].tobytes() for a, b in cut], "k": [n[a:b].tobytes() for a, b in cut],
            "tables": [ones[a:b].tobytes() for a, b in cut], "customers": size, "t": 1,
            "sum": [bytes(4 * (b - a)) for a, b in cut], "p": b"",
        })

    return asked_of_shards(chunks).groupBy("shard").applyInPandas(run, VOCABULARY)


def answered(chunks: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """(chunk, shard, c, p): count of each word and log10 probability of each pair, in the order in which a chunk asked."""
    shared = chunks.sparkSession.sparkContext.broadcast(vars(model))

    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"chunk": [], "shard": [], "c": [], "p": []})
        model, got = Model(**shared.value), Asked(pdf)
        size = len(model.samples)
        own = np.fromiter(map(got.ids.__getitem__, known["word"]), np.int64, len(known))
        parent = np.zeros((size, len(got.words)))
        parent[:, own] = _joined(known["p"], np.float64).reshape(-1, size).T
        new = np.flatnonzero(got.c == 0)
        parent[:, new] = model.unseen([got.words[i] for i in new])
        # pairs with customers are those of the vocabulary
        code = np.repeat(own, known["customers_of"].to_numpy(np.int64)) * ENDINGS + _joined(known["endings"], np.uint16)
        tables = np.zeros(len(got.pairs))
        tables[np.searchsorted(got.pairs, code)] = _joined(known["sum"], np.int32)
        ending = got.pairs % ENDINGS
        p = (size * got.n - model.discounts[0] * tables) / model.seated[ending]
        for (_, _, back, *_), above in zip(model.samples, parent):
            p += back[ending] * above[got.word]
        log_p = np.log10(np.maximum(p / size, 1e-300)).astype(np.float32)
        return pd.DataFrame({
            "chunk": pdf["chunk"], "shard": pdf["shard"],
            "c": [squeezed(got.c[w]) for w in got.of_word], "p": [squeezed(log_p[x]) for x in got.of_pair],
        })

    known = words.select("shard", "word", "endings", "sum", "p", (F.octet_length("endings") / 2).cast("long").alias("customers_of"))
    wanted = asked_of_shards(chunks).groupBy("shard")
    return wanted.cogroup(known.groupBy("shard")).applyInPandas(run, "chunk long, shard int, c binary, p binary")


def _customers(words: DataFrame, order: int) -> DataFrame:
    """(code, n): customers of the longest spelling contexts, each word counted once a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, lengths = codes_of(b.column(0).to_pylist(), order)
            own, at = np.unique(codes, return_inverse=True)
            n = np.bincount(at, weights=np.repeat(b.column(1).to_numpy(zero_copy_only=False), lengths), minlength=len(own))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int64))], ["code", "n"])

    return words.select("word", "t").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _by_ending(words: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Customers and tables of every ending, ENDINGS rows at most, and how many pairs have one and two customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t, few = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64), np.zeros((2, ENDINGS), np.int64)
        for b in batches:
            at, k, own = (_joined(b.column(i).to_pylist(), kind) for i, kind in enumerate((np.uint16, np.int64, np.int32)))
            n += np.bincount(at, weights=k, minlength=ENDINGS).astype(np.int64)
            t += np.bincount(at, weights=own, minlength=ENDINGS).astype(np.int64)
            few += [np.bincount(at[k == i], minlength=ENDINGS) for i in (1, 2)]
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (np.arange(ENDINGS), n, t, *few)], ["ending", "n", "t", "one", "two"])

    parts = words.select("endings", "k", "tables").mapInArrow(run, "ending long, n long, t long, one long, two long")
    found = parts.groupBy("ending").agg(*[F.sum(c).alias(c) for c in ("n", "t", "one", "two")]).toArrow()
    at, n, t, one, two = (found.column(c).to_numpy().astype(np.int64) for c in ("ending", "n", "t", "one", "two"))
    customers, tables = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    customers[at], tables[at] = n, t
    return customers, tables, int(one.sum()), int(two.sum())


def _discount(once: int, twice: int) -> float:
    """The usual estimate from dishes with one customer and with two."""
    return min(0.95, max(0.05, (once + 1) / (once + 2 * twice + 2)))


def fit(words: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> tuple[Model, DataFrame]:
    """Sample the seating of a vocabulary; the model and the vocabulary with what was sampled, in the shared folder."""
    spark = words.sparkSession
    words = materialize(words)
    once, twice = F.count(F.when(F.col("customers") == 1, 1)), F.count(F.when(F.col("customers") == 2, 1))
    n, v, m, n1, n2 = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum("customers"), F.lit(0)), once, twice).first()
    seated, tables, k1, k2 = _by_ending(words)
    seated = seated + ENDING_STRENGTH
    d1, d0 = _discount(k1, k2), _discount(n1, n2)
    codes = materialize(_customers(words, ORDER))
    spelling, samples = None, []
    total = v  # tables of the corpus; m are its customers
    for step in range(sweeps):
        found = (_customers(words, ORDER) if step else codes).orderBy("code").toArrow()
        spelling = spelling or Spelling(found.column("code").to_numpy(), ORDER)
        spelling.sweep(found.column("n").to_numpy(), step)
        pull1 = ENDING_STRENGTH + d1 * tables
        shared = spark.sparkContext.broadcast((spelling.state(), pull1))
        pull0, customers0 = WORD_STRENGTH + d0 * total, WORD_STRENGTH + m

        def sweep(batches: Iterator[pa.RecordBatch], shared=shared, pull0=pull0, customers0=customers0, step=step, kept=step >= burn_in) -> Iterator[pa.RecordBatch]:
            state, pull1 = shared.value
            spelling = Spelling.restored(state)
            for b in batches:
                if not b.num_rows:
                    continue
                word = b.column("word").to_pylist()
                at, k = _joined(b.column("endings").to_pylist(), np.uint16), _joined(b.column("k").to_pylist(), np.int64)
                size = np.fromiter(map(len, b.column("endings").to_pylist()), np.int64, len(word)) // 2
                c, t = (b.column(x).to_numpy(zero_copy_only=False) for x in ("customers", "t"))
                spelled, seeds = 10.0 ** spelling.words(word), seeds_of(word)
                parent = (c - d0 * t + pull0 * spelled) / customers0
                own = (np.repeat(seeds, size) ^ at) * np.uint64(0x2545F4914F6CDD1D)
                tables = seat(k, pull1[at] * np.repeat(parent, size), d1, own, 2000 + step).astype(np.int32)
                first = np.cumsum(size) - size
                c = np.add.reduceat(tables.astype(np.int64), first)
                t = seat(c, pull0 * spelled, d0, seeds, 1000 + step)
                cut, raw = list(zip(4 * first, 4 * (first + size))), tables.tobytes()
                done = {"tables": pa.array([raw[x:y] for x, y in cut], pa.binary()), "customers": pa.array(c), "t": pa.array(t)}
                if kept:  # customers at tables and the spelling, until the sums over all words are known
                    both = np.column_stack([c - d0 * t, spelled])
                    done["p"] = pa.array([old + x.tobytes() for old, x in zip(b.column("p").to_pylist(), both)], pa.binary())
                    raw = (_joined(b.column("sum").to_pylist(), np.int32) + tables).tobytes()
                    done["sum"] = pa.array([raw[x:y] for x, y in cut], pa.binary())
                yield pa.RecordBatch.from_arrays([done.get(x, b.column(x)) for x in b.schema.names], b.schema.names)

        before, words = words, materialize(words.mapInArrow(sweep, VOCABULARY))
        discard(before)
        _, tables, _, _ = _by_ending(words)
        total, m = words.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("customers"), F.lit(0))).first()
        if step >= burn_in:
            customers0 = WORD_STRENGTH + m
            samples.append((spelling.state(), (WORD_STRENGTH + d0 * total) / customers0, (ENDING_STRENGTH + d1 * tables) / seated, customers0, step))
        shared.destroy()
    discard(codes)
    weights, customers = np.array([[s[1] for s in samples], [s[3] for s in samples]], float)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            both = _joined(b.column("p").to_pylist(), np.float64).reshape(b.num_rows, -1, 2)
            p = both[:, :, 0] / customers + weights * both[:, :, 1]
            done = {"p": pa.array([x.tobytes() for x in p], pa.binary())}
            yield pa.RecordBatch.from_arrays([done.get(x, b.column(x)) for x in b.schema.names], b.schema.names)

    return Model(samples, (d1, d0), seated, n, v), words.mapInArrow(finish, VOCABULARY)


def in_document(at: np.ndarray, lengths: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Predictive probability of each token in its document's restaurant, given the tokens before it.

    ``at`` numbers the words of all documents' tokens in order, ``parent`` has
    their probabilities behind the words before them. Each word seen has one table.
    """
    d, s = DOCUMENT_DISCOUNT, DOCUMENT_STRENGTH
    document = np.repeat(np.arange(len(lengths)), lengths)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    seated = np.arange(len(at)) - start
    order = np.lexsort((at, document))  # stable: tokens of one word in one document stay in order
    new = np.r_[True, (at[order][1:] != at[order][:-1]) | (document[order][1:] != document[order][:-1])]
    begin = np.flatnonzero(new)
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    opened = np.cumsum(rank == 0) - (rank == 0)
    tables = opened - opened[start]
    return (np.where(rank > 0, rank - d, 0.0) + (s + d * tables) * parent) / (s + seated)


def score(docs: DataFrame, held_out: int = 0, modulus: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows whose id remainder is not ``held_out``. Scores are
    log10 probabilities of whole texts, perplexity being
    10 ** (-score / n_tokens). A null text counts as empty and has the end as
    its one token; a null id counts as the empty text; repeated rows count each
    time. Where no row is for training, N and V are 0, words are scored by a
    spelling model without customers and the base by its smoothing alone.
    """
    rows, shards = chunked(docs, id_col, text_col, held_out, modulus)
    chunks = materialize(chunk_words(rows, shards))
    model, words = fit(vocabulary(chunks))
    found = answered(chunks, words, model)
    n, v = model.tokens, model.distinct

    def run(kept: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("shard")  # as the words are
        c, log_p = (np.concatenate(_released(found.column(x), kind)) for x, kind in (("c", np.int64), ("p", np.float32)))
        held_out, lengths, pair, sizes = (
            _released(kept.column(x), kind)[0] for x, kind in (("held_out", bool), ("lengths", np.int64), ("pair", np.int32), ("sizes", np.int32))
        )
        at = np.repeat(np.arange(len(sizes)), sizes)[pair]
        log_base = np.log10((c + SMOOTH) / (n + SMOOTH * (v + 1)))
        first = np.cumsum(lengths) - lengths
        own = np.log10(in_document(at, lengths, 10.0 ** log_p.astype(np.float64)[pair]))
        each = [kept.column("ids").chunk(0).flatten(), held_out, lengths, np.add.reduceat((c[at] > 0).astype(np.int64), first)]
        each += [np.full(len(lengths), n, np.int64), np.add.reduceat(log_base[at], first), np.add.reduceat(own, first)]
        return pa.table([pa.array(x) for x in each], names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    kept = chunks.where("shard IS NULL").select(*KEPT)
    return kept.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)
