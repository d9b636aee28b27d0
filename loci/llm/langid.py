"""Language ID by compression with per-language zstandard dictionaries (operator 6).

A raw-content dictionary of each language's own text makes that language's
words cheap to encode. A text gets the language whose dictionary gives the
smallest encoding. Where the margin is narrow, as for a few words, which alone
are no longer than their encoding, the text is encoded again behind some of
the dictionary's own text, which costs next to nothing, at two levels; if the
margin stays narrow the text is rejected. Equal sizes go to the language with
more labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_remainder, packed

#: The dictionaries are fitted on at most this many texts a language, and this much of each.
TEXTS_PER_LANGUAGE = 64
LETTERS_PER_TEXT = 2048
BLOCK = 4096  # bytes encoded at once: later blocks lean on the dictionary as the first does
LEVEL, STRONG_LEVEL = 5, 19
NARROW = 0.02  # second look
LEAD = 256  # bytes of the dictionary in front of a text at the second look
REJECT = 0.001  # share of the second smallest size

OUTPUTS = ["lang_pred", "score", "rejected"]
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower case, each stretch of non-letters as one space."""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content per language, the most frequent first, from a bounded sample of labelled rows.

    The sample is those rows with letters whose hashed id is smallest; Spark
    limits each task to its share before the shuffle. What comes to the driver
    is bounded by the number of languages times the two parameters above.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit(6)).alias("at"),
        F.substring(text_col, 1, LETTERS_PER_TEXT).alias("text"),
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))
    sample = rows.withColumn("n", rank).where(F.col("n") <= TEXTS_PER_LANGUAGE).collect()
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    content: dict[str, bytes] = {r["lang"]: b"" for r in counts}
    for r in sorted(sample, key=lambda r: (r["lang"], -r["n"])):
        content[r["lang"]] += letters(r["text"]) + b" "
    return content


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.leads = [content[n][-LEAD:] for n in self.langs]
        self.coders = {level: [self._coder(content[n], level) for n in self.langs] for level in (LEVEL, STRONG_LEVEL)}

    @staticmethod
    def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        table = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        table.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=table, write_content_size=False, write_checksum=False)

    def behind_leads(self, data: bytes) -> list[int]:
        """Bytes that ``data`` adds to each language's lead, at both levels together."""
        out = [0] * len(self.langs)
        for coders in self.coders.values():
            for i, (c, lead) in enumerate(zip(coders, self.leads)):
                blocks = (data[k : k + BLOCK] for k in range(0, len(data), BLOCK))
                own = len(c.compress(lead))
                out[i] += sum(len(c.compress(lead + b + b" ")) - own for b in blocks)
        return out

    def sizes(self, data: bytes, level: int) -> list[int]:
        return [sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in self.coders[level]]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, margin as a share of the second smallest size, rejected)."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = letters(text) or text.encode("utf-8", "replace")
        sizes = self.sizes(data, LEVEL)
        best, score = self._best(sizes)
        if score < NARROW and len(self.langs) > 1:
            best, score = self._best(self.behind_leads(data))
        return self.langs[best], score, score < REJECT

    @staticmethod
    def _best(sizes: list[int]) -> tuple[int, float]:
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return order[0], 1.0
        return order[0], (sizes[order[1]] - sizes[order[0]]) / max(1, sizes[order[1]])


def predict(docs: DataFrame, content: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected.

    A null text, one without a letter, or any text when no language was
    learned is ``und`` with score 0 and rejected. Other columns go through;
    columns named like the outputs are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([classifier.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return packed(docs, OUTPUTS, found=run(F.col(text_col).cast("string"))).select("_row.*", *[F.col(f"found.{c}").alias(c) for c in OUTPUTS])


def identify(docs: DataFrame, held_out: int = 1, modulus: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows whose id remainder is not ``held_out`` and predict for all rows."""
    content = fit(docs.where(id_remainder(id_col, modulus) != held_out), id_col, text_col, lang_col)
    return predict(docs, content, text_col).withColumn("held_out", id_remainder(id_col, modulus) == held_out)
