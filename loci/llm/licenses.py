"""License scans by template matching (operator 7).

A template is license wording with two kinds of markup: optional regions,
which a text may leave out, and replaceable regions, which stand for any words
up to a number. Each template is compiled once to an automaton over words; a
text gets its label where the automaton accepts, so that all mandatory words
stand there exactly and in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_or_empty
from .license_texts import TEMPLATES

OUTPUTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates that a catalogue has at most; every task holds their automata.
MOST_TEMPLATES = 5000

#: A byte that belongs to no word as a space; the two halves of UTF-8 beyond ASCII belong to words.
_SEPARATORS = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words of lower-cased letters, digits and characters beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split()


class Automaton:
    """States are places in the wording; a step consumes one word."""

    def __init__(self, template: str):
        self.word: list[bytes | None] = []  # wanted by the state; None takes any word
        self.skip: list[list[int]] = []  # states reachable without a word
        opened: list[int] = []
        mandatory: set[bytes] = set()
        for token in re.findall(r"<<[^>]*>>|[^\s<]+", template):
            if token == "<<opt>>":
                opened.append(self._state(None))
                self.word[-1] = b""  # takes no word: passes on only
                self.skip[-1].append(len(self.word))
            elif token == "<</opt>>":
                self.skip[opened.pop()].append(len(self.word))
            elif token.startswith("<<any;"):
                first = len(self.word)
                n = int(token[6:-2])
                for _ in range(n):
                    self._state(None)
                for i in range(n):
                    self.skip[first + i].append(first + n)
            else:
                for w in words(token):
                    self._state(w)
                    if not opened:
                        mandatory.add(w)
        if opened:
            raise ValueError(f"a region of this template is not closed: {template}")
        self.end = len(self.word)
        self.skip.append([])
        self.closed = [self._closure(i) for i in range(self.end + 1)]
        self.start = self.closed[0]
        self.mandatory = frozenset(mandatory)  # a text that lacks one of them needs no run

    def _state(self, word: bytes | None) -> int:
        self.word.append(word)
        self.skip.append([])
        return len(self.word) - 1

    def _closure(self, i: int) -> frozenset[int]:
        seen, todo = {i}, [i]
        while todo:
            for j in self.skip[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return frozenset(seen)

    def accepts(self, text: list[bytes]) -> bool:
        """Whether the wording stands anywhere in ``text``."""
        active: set[int] = set()
        for w in text:
            reached: set[int] = set()
            for s in active | self.start:
                if s < self.end:
                    wanted = self.word[s]
                    if wanted is None or wanted == w:
                        reached |= self.closed[s + 1]
            if self.end in reached:
                return True
            active = reached
        return False


class Scanner:
    def __init__(self, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None):
        self.phrases = [(words(p), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.templates = [(Automaton(t), name) for name, t in (TEMPLATES if templates is None else templates)]

    def scan(self, text: str | None) -> tuple:
        found = words(text)
        known = set(found)
        places, base, labels = [], set(), set()
        for phrase, label in self.phrases:
            if not known.issuperset(phrase):
                continue
            at = -1
            while True:
                try:
                    at = found.index(phrase[0], at + 1)
                except ValueError:
                    break
                if found[at : at + len(phrase)] == phrase:
                    places.append(at)
                    base.add(label)
        for automaton, label in self.templates:
            if label not in labels and known.issuperset(automaton.mandatory) and automaton.accepts(found):
                labels.add(label)
        score = 1.0 if labels else 0.5 if base else 0.0
        first, last = (min(places), max(places)) if places else (None, None)
        join = lambda x: ",".join(sorted(x))
        return len(found), len(places), first, last, join(base), join(base | labels), score


def templates_of(table: DataFrame, most: int = MOST_TEMPLATES) -> list[tuple[str, str]]:
    """The catalogue of a table with columns label and template, in order; rows with a null are left out.

    A catalogue is read by the driver and sent to all tasks, so one of more than ``most`` rows is an error.
    """
    rows = table.select("label", "template").dropna().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a catalogue has at most {most} templates")
    return sorted((r["label"], r["template"]) for r in rows)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is 1 where a template is accepted, 0.5 where only a phrase stands, 0
    elsewhere. Null and empty texts have no words and no labels. Other columns
    go through; columns named like the outputs are replaced.
    """
    kinds = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    @F.pandas_udf(kinds)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates)
        for texts in batches:
            out = pd.DataFrame([scanner.scan(t) for t in texts], columns=OUTPUTS)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return packed(docs, OUTPUTS, found=run(text_or_empty(text_col))).select("_row.*", *[F.col(f"found.{c}").alias(c) for c in OUTPUTS])
