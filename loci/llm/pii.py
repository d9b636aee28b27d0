"""Personal data in plain and in disguised form (operator 4).

A chain of transducers rewrites a text and keeps, for every letter it writes,
the stretch of the source that it stands for: lookalike letters become ASCII,
spelled digits become digits, "at" and "dot" disguises become signs. The same
patterns then run over the rewritten text, and what they find is mapped back
to spans of the source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_or_empty

KINDS = ("email", "ip", "card", "phone")
OUTPUTS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

Span = tuple[int, int, int]  # start, kind, end

# Possessive repeats and a start at the first digit of a run keep every pattern linear; what they match is the same.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def find(text: str) -> list[Span]:
    """Spans of the four kinds, leftmost and without overlap within a kind; matches that fail their test are dropped."""
    out: list[Span] = []
    if "@" in text:
        free = at = 0
        while (at := text.find("@", at)) >= 0:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at) if start < at else None
            if m:
                out.append((start, 0, m.end()))
                free = m.end()
            at = max(at + 1, m.end() if m else 0)
    for m in IP.finditer(text):
        if all(_small(p) for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


@dataclass
class Tape:
    """Rewritten text; letter i stands for source[start[i]:end[i]]."""

    text: str
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, text: str) -> Tape:
        at = np.arange(len(text) + 1)
        return cls(text, at[:-1], at[1:])

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str]) -> Tape:
        """Every match replaced; each letter written stands for all that the match stood for."""
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m)
            a, b = m.span()
            if new == m[0] or a == b:
                continue
            parts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        if not parts:
            return self
        parts.append(self.text[at:])
        starts.append(self.start[at:])
        ends.append(self.end[at:])
        return Tape("".join(parts), np.concatenate(starts), np.concatenate(ends))


# Letters of other scripts that look like the ASCII letters below them.
LOOKALIKE = str.maketrans(
    "АВЕКМНОРСТХЅІЈаеорсухѕіјԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοⅼ․。．＠",
    "ABEKMHOPCTXSIJaeopcyxsijdhABEZHIKMNOPTYXol...@",
)
# The full-width forms follow ASCII at a fixed distance; digits of mathematical alphabets come in five rows of ten.
LOOKALIKE |= {0xFEE0 + c: c for c in range(0x21, 0x7F)} | {0x1D7CE + i: ord("0") + i % 10 for i in range(50)}
ODD_LETTER = re.compile("[" + "".join(map(chr, sorted(LOOKALIKE))) + "]")
ODD_LETTERS = frozenset(map(chr, LOOKALIKE))
INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]+")

# Names of digits.
DIGITS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_D = "(?:" + "|".join(DIGITS) + ")"
_SEP = r"[\s,_-]{1,3}"
SPELLED = re.compile(rf"(?i)\b(?:plus{_SEP})?{_D}(?:{_SEP}(?:(?:dot|point|dash){_SEP})?{_D}){{2,}}\b")
ONE_NAME = re.compile(rf"(?i)\b(?:plus|dot|point|dash|{_D})\b")
NAMES = {**DIGITS, "plus": "+", "dot": ".", "point": ".", "dash": "-"}

_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
BRACKETED = re.compile(rf"(?i)(?<=[A-Za-z0-9]){_OPEN}(at|dot){_CLOSE}(?=[A-Za-z0-9])")
# "at" between words counts where a dot, spelled or plain, follows in the host
WORDED = re.compile(r"(?i)(?<=[A-Za-z0-9])\s{1,3}at\s{1,3}(?=[A-Za-z0-9-]{1,63}(?:\s{1,3}dot\s{1,3}|\.)[A-Za-z0-9-])")
WORDED_DOT = re.compile(r"(?i)(@[A-Za-z0-9.-]{1,253}?)\s{1,3}dot\s{1,3}(?=[A-Za-z0-9-])")


#: Letters of UTF-8 bytes in lower case, all else as spaces: for a quick look at which words a text has.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_DIGIT_NAMES = {d.encode() for d in DIGITS}


def deobfuscate(text: str) -> Tape | None:
    """The rewritten text, or None where nothing is disguised."""
    tape = Tape.of(text)
    first = tape
    if not text.isascii():
        tape = tape.rewrite(INVISIBLE, lambda m: "")
    if not text.isascii() and not ODD_LETTERS.isdisjoint(text):
        tape = tape.rewrite(ODD_LETTER, lambda m: m[0].translate(LOOKALIKE))
    words = tape.text.encode("utf-8", "replace").lower().translate(_LETTERS).split()
    known = set(words)
    if not known.isdisjoint(_DIGIT_NAMES) and sum(w in _DIGIT_NAMES for w in words) > 2:
        tape = tape.rewrite(SPELLED, _spelled)
    if b"at" in known or b"dot" in known:
        tape = tape.rewrite(BRACKETED, lambda m: "@" if m[1].lower() == "at" else ".")
    if b"at" in known:
        tape = tape.rewrite(WORDED, lambda m: "@")
    while b"dot" in known:  # one further dot of each host a time
        longer = tape.rewrite(WORDED_DOT, lambda m: m[1] + ".")
        if longer is tape:
            break
        tape = longer
    return None if tape is first else tape


def _spelled(m: re.Match) -> str:
    return "".join(NAMES[n.lower()] for n in ONE_NAME.findall(m[0]))


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans found in the rewritten text only; one may widen a base span of its kind but none lies inside one."""
    tape = deobfuscate(text)
    if tape is None:
        return []
    out = []
    for a, kind, b in find(tape.text):
        start, end = int(tape.start[a]), int(tape.end[b - 1])
        if text[start:end] != tape.text[a:b] and not any(k == kind and s <= start and end <= e for s, k, e in base):
            out.append((start, kind, end))
    return out


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def inspect(text: str | None) -> tuple:
    text = text or ""
    base = find(text)
    n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
    spans = sorted({*base, *disguised(text, base)})
    return *n, hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(spans)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with counts of base spans per kind, base_sha256 and spans (base and disguised, kind:start:end).

    Offsets count code points and ends are exclusive. Null and empty texts
    have no spans. Other columns go through; columns named like the outputs
    are replaced.
    """

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([inspect(t) for t in texts], columns=OUTPUTS)

    return packed(docs, OUTPUTS, found=run(text_or_empty(text_col))).select("_row.*", *[F.col(f"found.{c}").alias(c) for c in OUTPUTS])


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col``, plain or disguised, replaced by its kind in brackets; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(masked, na_action="ignore")

    return docs.withColumn(text_col, run(F.col(text_col).cast("string")))


def masked(text: str) -> str:
    out, at, base = [], 0, find(text)
    for start, kind, end in sorted({*base, *disguised(text, base)}):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
