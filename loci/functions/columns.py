"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def natural_key(c: Column | str) -> Column:
    """Sort key under which runs of digits compare as numbers.

    A run of digits goes without leading zeros and behind its length, so runs
    of any length compare rightly. Pieces are joined by the lowest letter, so
    that a piece that is the start of another one sorts before it, and the key
    is one string to compare.
    """
    pieces = F.regexp_extract_all(_col(c), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def keyed(p: Column) -> Column:
        # plain comparisons and trims: a pattern would be matched again for every piece
        bare = F.ltrim(p, F.lit("0"))
        digits = F.when(bare == "", "0").otherwise(bare)
        return F.when((p >= "0") & (p < ":"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(pieces, keyed), "\u0001")


def reverse_complement(c: Column | str) -> Column:
    return F.translate(F.reverse(_col(c)), "ACGTacgt", "TGCAtgca")


def round_half_up(c: Column | str, digits: int) -> Column:
    """Half-up rounding in plain double arithmetic, so other engines give the same bits."""
    scale = float(10**digits)
    return F.floor(_col(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def characters(c: Column | str) -> Column:
    return F.split(_col(c), "")


def ambiguous_share(c: Column | str, letters: str = "Nn", digits: int | None = 2) -> Column:
    """Share of ambiguous letters in a residue string; NULL for an empty one."""
    text = _col(c)
    size = F.length(text)
    share = (size - F.length(F.translate(text, letters, ""))) / F.when(size > 0, size)
    return share if digits is None else round_half_up(share, digits)
