"""Benchmark decontamination by a broadcast hash set of n-grams (operator 10).

DataFrame functions only. Windows of the benchmark items are few and their
number is counted before they are broadcast; every word position of a text
looks its window up by a 64-bit hash, and hits are verified word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, text_or_empty, words_of

WINDOW = 10
#: Windows that are broadcast at most (some hundred bytes each); a larger benchmark is joined by shuffling.
MOST_BROADCAST = 500_000

#: In a text as it is, capitals belong to words too: what stands before the first, and one with what follows it.
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
HEAD = f"^[{_GAP}]*"
WORD_AND_REST = f"[^{_GAP}]+[{_GAP}]*"


def benchmark_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows (length, words, items): ``size`` words in a row, or a whole item of fewer."""
    words = items.select(F.col(id_col).alias("item"), words_of(text_or_empty(text_col)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - length + 1))
    each = words.select("item", "w", length.alias("length"), at.alias("at"))
    each = each.select("item", "length", F.slice("w", F.col("at"), F.col("length")).alias("words"))
    return each.groupBy("length", "words").agg(F.collect_set("item").alias("items"))


def _key(length: int, word) -> Column:
    return F.xxhash64(F.lit(length), *[word(i) for i in range(length)])


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per (id, text hash): copies, n_words, spans (start, end of words, end exclusive) and items with hits.

    Rows that share id and text are one here, with their number in ``copies``.
    Each text is read once: a row for its start always meets, rows for windows
    only where they hit, and just those are shuffled.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(items, size)
    counted = windows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``size`` rows
    lengths = sorted(r["length"] for r in counted)
    key = F.lit(None).cast("long")
    for n in lengths:
        key = F.when(F.col("length") == n, _key(n, lambda i: F.col("words")[i])).otherwise(key)
    keyed = windows.select(key.alias("key"), "length", "words", "items")
    start = spark.range(1).select(
        _key(0, None).alias("key"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("words"),
        F.array().cast(keyed.schema["items"].dataType).alias("items"),
    )
    keyed = keyed.unionByName(start)
    few = sum(r["n"] for r in counted) <= MOST_BROADCAST
    if few:
        keyed = F.broadcast(keyed)

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), words_of(text).alias("w"))
    rows = rows.select("id", "mark", "w", F.size("w").alias("n_words"), F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    own = [(0, F.when(F.col("at") < 0, _key(0, None)))]
    own += [
        (n, F.when((F.col("at") >= 0) & (F.col("at") + n <= F.col("n_words")), _key(n, lambda i: F.get("w", F.col("at") + i))))
        for n in lengths
    ]
    if len(lengths) == 1:  # the usual case: one key a row
        rows = rows.withColumn("own_key", F.coalesce(own[0][1], own[1][1]))
    else:
        rows = rows.withColumn("own_key", F.explode(F.array(*[k for _, k in own])))
    rows, first = rows.where(F.col("own_key").isNotNull()), F.greatest("at", F.lit(0)) + 1
    if not few:  # every position is shuffled: with the words of its window, not all of its text
        own = F.slice("w", first, max(lengths)).alias("own")
        rows, first = rows.select("id", "mark", own, "n_words", "at", "own_key").withColumnRenamed("own", "w"), F.lit(1)
    met = rows.join(keyed, F.col("own_key") == F.col("key"))
    # two comparisons keep this a check after the hash lookup instead of a second key made for every row
    mine, theirs = F.concat_ws(" ", F.slice("w", first, F.col("length"))), F.concat_ws(" ", "words")
    met = met.where((mine <= theirs) & (mine >= theirs))
    span = F.when(F.col("length") > 0, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end")))
    return (
        met.select("id", "mark", "n_words", "length", "items", span.alias("span"))
        .groupBy("id", "mark", "n_words")
        .agg(
            F.count(F.when(F.col("length") == 0, 1)).alias("copies"),
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        more = F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; items without words are no windows;
    repeated rows each give a row; empty tables give no rows, or no hits.
    """
    found = hits(docs, items, size, id_col, text_col)
    names = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, remove: str = "documents", size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without contaminated rows (``remove="documents"``), or without their hit words (``"spans"``).

    A hit word goes with the separators after it. Columns go through as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    found = hits(docs, items, size, id_col, text_col).where(F.size("spans") > 0).select(F.col("id").alias("_id"), "mark", "spans")
    rows = packed(docs, [], id=F.col(id_col), own_mark=F.xxhash64(text_or_empty(text_col)), text=F.col(text_col))
    same = rows["id"].eqNullSafe(found["_id"]) & (rows["own_mark"] == found["mark"])
    if remove == "documents":
        return rows.select("_row", "id", "own_mark").join(found, same, "left_anti").select("_row.*")
    joined = rows.join(found, same, "left")
    pieces = F.regexp_extract_all("text", F.lit(WORD_AND_REST), F.lit(0))
    left = F.filter(pieces, lambda p, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    head = F.regexp_extract("text", HEAD, 0)
    cleaned = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(head, F.concat_ws("", left)))
    return joined.select(F.col("_row").withField(f"`{text_col}`", cleaned).alias("_row")).select("_row.*")
