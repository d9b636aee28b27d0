"""BPE encoding and decoding (operator 9).

Merges of one word come from a priority queue of ranks over a doubly linked
list of symbols; entries whose symbols have changed meanwhile are skipped.
Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_or_empty

VOCABULARY = "byte_bpe_50k.json"
#: Words a task remembers at most; beyond that it forgets all and goes on.
REMEMBERED = 400_000

OUTPUTS = ["n_tokens", "ids", "decoded"]

# The pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Tokenizer:
    """Byte-level BPE from a vocabulary file."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        bytes_of = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: bytes(bytes_of[c] for c in s) for s, i in vocab.items() if s not in self.added}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.whole = {s: i for i, s in self.strings.items()}
        self.words = regex.compile(PATTERN)
        # longest first, as the leftmost-longest match of added tokens asks
        names = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.known: dict[str, list[int]] = {}

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: always the pair of lowest rank, leftmost first."""
        ids = [self.first[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m is not None:
                queue.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, new, left, right = pop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: a neighbour merge has used one of the two
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                m = merges.get((new, ids[k]))
                if m is not None:
                    push(queue, (m[0], i, m[1], new, ids[k]))
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], new))
                if m is not None:
                    push(queue, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        parts = self.split.split(text) if self.split else [text]
        for n, part in enumerate(parts):
            if n % 2:
                out.append(self.added[part])
                continue
            for word in self.words.findall(part):
                ids = known.get(word)
                if ids is None:
                    ids = self.merge(word.encode("utf-8", "replace"))
                    if len(word) < 64:  # long words are rare and would fill the memory
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _tokenizers(docs: DataFrame, path: str | None):
    """The vocabulary as a broadcast: a file of fixed size, read once by the driver.

    A worker keeps the tokenizer beside the broadcast value, so that its later
    tasks find the words of earlier ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"spec": load(path or vocabulary_path())})

    def get() -> Tokenizer:
        held = shared.value
        if "tokenizer" not in held:
            held["tokenizer"] = Tokenizer(held["spec"])
        return held["tokenizer"]

    return get


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids (array of int) and decoded (the ids' text).

    Null and empty texts give no ids. The name of an added token in a text is
    that token. Other columns go through; columns named like the outputs are
    replaced.
    """
    get = _tokenizers(docs, path)

    @F.pandas_udf("n_tokens long, ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = get()
        for texts in batches:
            ids = [t.encode(x) for x in texts]
            yield pd.DataFrame({"n_tokens": [len(x) for x in ids], "ids": ids, "decoded": [t.decode(x) for x in ids]})

    return packed(docs, OUTPUTS, found=run(text_or_empty(text_col))).select("_row.*", *[F.col(f"found.{c}").alias(c) for c in OUTPUTS])


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``rows`` with decoded, the text of their ids; null ids give an empty text."""
    get = _tokenizers(rows, path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = get()
        for ids in batches:
            yield pd.Series([t.decode(list(x)) if x is not None else "" for x in ids], dtype=object)

    return rows.withColumn("decoded", run(F.col(ids_col)))


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row; ids and texts stay in the workers."""
    get = _tokenizers(docs, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = get()
        for texts in batches:
            rows = []
            for x in texts:
                ids = t.encode(x)
                decoded = t.decode(ids)
                rows.append((len(ids), _sha(",".join(map(str, ids))), _sha(decoded)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias(id_col), run(text_or_empty(text_col)).alias("_bpe")).select(id_col, "_bpe.*")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
