"""Line dedup by a suffix array over line sequences (operator 1).

DataFrame functions only. Every document is a sequence of line ids. Distributed
prefix doubling sorts all suffixes by their first 1, 2, 4, ... lines: a level's
rank of a position is the place of its next 2**k lines among all such stretches
that occur more than once. Positions of equal rank are an interval of suffixes
with a common prefix of at least 2**k lines; a position whose rank is alone
leaves, as no longer stretch at it can repeat.

A run of any length is named by two overlapping ranks of one level, so the
first occurrence of each run follows from one grouping. A repeated run is
deleted where it is not the first, if it has at least ``min_words`` words. It
is enough to test the shortest such runs from each line on and up to each line:
they cover exactly what all longer repeated runs cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import id_key, packed, text_or_empty

MIN_WORDS = 10
OUTPUTS = ["n_lines", "n_removed", "n_runs"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def ranked(keys: DataFrame, *order: str) -> DataFrame:
    """Distinct ``keys`` with a number that rises in their order.

    A global sort numbers its pieces by their place; written at once, so that a
    task run again cannot number them anew.
    """
    return materialize(keys.orderBy(*order).withColumn("number", F.monotonically_increasing_id()))


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that occur more than once: (doc, at, rank, words, run, before, last).

    doc is (id, hash of the text), so that repeated rows are one document.
    ``run`` numbers the stretches of neighbouring repeated lines of a document,
    ``before`` counts the words of the stretch before the line, ``last`` marks
    the stretch's end. Counting combines before the shuffle, and lines that
    occur once, most of them, go no further.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark")).alias("doc"), F.posexplode(_lines(text)).alias("at", "line"))
    rows = rows.select("doc", "at", F.unhex(F.md5("line")).alias("name"), F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    often = rows.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("name")
    active = rows.join(ranked(often, "name"), "name").withColumnRenamed("number", "rank")

    order = Window.partitionBy("doc").orderBy("at")
    active = active.withColumn("prior", F.lag("at").over(order)).where(F.col("prior").isNull() | (F.col("prior") < F.col("at")))
    opens = F.when(F.col("prior") == F.col("at") - 1, 0).otherwise(1)
    active = active.withColumn("run", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = Window.partitionBy("doc", "run").orderBy("at")
    return materialize(
        active.select(
            "doc",
            "at",
            "rank",
            "words",
            "run",
            F.coalesce(F.sum("words").over(stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.lead("at").over(stretch).isNull().alias("last"),
        )
    )


def windows(active: DataFrame, min_words: int) -> DataFrame:
    """Stretches (doc, start, end; end exclusive) of repeated lines, shortest from their start on or up to their end."""
    tail = F.struct((F.col("at") + 1).alias("at"), (F.col("before") + F.col("words")).alias("before"), F.lit(True).alias("past"))
    own = F.struct("at", "before", F.lit(False).alias("past"))
    ends = active.select("doc", "run", F.explode(F.when(F.col("last"), F.array(own, tail)).otherwise(F.array(own))).alias("e"))
    ends = ends.select("doc", "run", "e.*")
    # both read from one side on, so that a frame only grows and a long text takes linear time
    stretch, frame = Window.partitionBy("doc", "run"), (Window.unboundedPreceding, -min_words)
    ends = ends.select(
        "doc",
        "at",
        F.when(~F.col("past"), F.min("at").over(stretch.orderBy(F.desc("before")).rangeBetween(*frame))).alias("to"),
        F.max("at").over(stretch.orderBy("before").rangeBetween(*frame)).alias("since"),
    )
    onward = F.struct(F.col("at").alias("start"), F.col("to").alias("end"))
    back = F.struct(F.col("since").alias("start"), F.col("at").alias("end"))
    both = ends.select("doc", F.explode(F.array(onward, back)).alias("w")).select("doc", "w.*")
    return both.where(F.col("start").isNotNull() & F.col("end").isNotNull()).distinct()


def doubled(level: DataFrame, step: int) -> DataFrame:
    """Ranks of stretches of 2 * ``step`` lines, from those of ``step`` lines; only stretches that repeat."""
    later = level.select("doc", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
    pairs = materialize(level.select("doc", "at", "rank").join(later, ["doc", "at"]))
    often = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    names = ranked(often.select("rank", "next"), "rank", "next").select("rank", "next", F.col("number").alias("new"))
    return materialize(pairs.join(names, ["rank", "next"]).select("doc", "at", F.col("new").alias("rank")))


def suffix_ranks(active: DataFrame, most: int | None = None) -> list[DataFrame]:
    """Levels (doc, at, rank) for stretches of 1, 2, 4, ... lines, up to ``most`` lines or until none repeats."""
    levels = [active.select("doc", "at", "rank")]
    step = 1
    while most is None or 2 * step <= most:
        level = doubled(levels[-1], step)
        if level.isEmpty():
            break
        levels.append(level)
        step *= 2
    return levels


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, start, end) of stretches with at least ``min_words`` words that stand earlier too: in a document of
    smaller id, or further up."""
    active = positions(docs, id_col, text_col)
    wanted = materialize(windows(active, min_words).withColumn("length", F.col("end") - F.col("start")))
    longest = wanted.agg(F.max("length")).first()[0] or 0
    found = None
    for k, level in enumerate(suffix_ranks(active, longest)):
        size = 1 << k
        here = wanted.where((F.col("length") >= size) & (F.col("length") < 2 * size))
        head = level.select("doc", F.col("at").alias("start"), F.col("rank").alias("a"))
        tail = level.select("doc", (F.col("at") + size).alias("end"), F.col("rank").alias("b"))
        named = here.join(head, ["doc", "start"]).join(tail, ["doc", "end"])
        found = named if found is None else found.unionByName(named)
    found = materialize(found.select("doc", "start", "end", "length", "a", "b"))
    place = F.struct("doc", "start")
    first = found.groupBy("length", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    first = materialize(first)  # a stage of its own: the join can then split a run that very many documents share
    return found.join(first, ["length", "a", "b"]).where(place > F.col("first")).select("doc", "start", "end")


def merged(spans: DataFrame) -> DataFrame:
    """(doc, start, end) of the unions of spans that overlap or touch: together no longer than their document."""
    order = Window.partitionBy("doc").orderBy("start")
    spans = spans.groupBy("doc", "start").agg(F.max("end").alias("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_open", F.when(reach.isNull() | (F.col("start") > reach), F.col("start")))
    opened = opened.withColumn("_open", F.max("_open").over(order))
    return opened.groupBy("doc", F.col("_open").alias("start")).agg(F.max("end").alias("end"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated runs of lines, with n_lines, n_removed and n_runs (removed stretches).

    Lines end at a newline and are equal when all their characters are. The
    first occurrence in the order of ids, then of lines, stays; null ids come
    first. Of rows that share id and text, all but one count as later copies. A
    null text stays null with no lines; an empty one has one empty line; runs
    of fewer words stay wherever they are. Other columns go through; columns
    named like the outputs are replaced.
    """
    spans = merged(later_copies(docs, min_words, id_col, text_col))
    gone = spans.groupBy("doc").agg(F.flatten(F.collect_list(F.sequence("start", F.col("end") - 1))).alias("_gone"))
    key = ["_id", "_no_id", "_mark"]
    gone = gone.withColumns({**id_key("doc.id"), "_mark": F.col("doc.mark")}).select(*key, "_gone")
    joined = packed(docs, OUTPUTS, **id_key(id_col), _mark=F.xxhash64(text_or_empty(text_col))).join(gone, key, "left")
    text = F.col("_row").getField(text_col).cast("string")
    copy = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))) > 1
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    joined = joined.select("_row", text.alias("text"), "_gone", F.coalesce(_lines(text), F.array()).alias("lines"), (copy & (words >= min_words)).alias("whole"))
    every = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    marked = F.when(F.col("whole"), every).otherwise(F.coalesce("_gone", F.array().cast("array<int>")))
    joined = joined.select("_row", "text", "lines", every.alias("every"), F.array_sort(marked).alias("gone"))
    stays = F.transform(F.array_except("every", "gone"), lambda i: F.get("lines", i))
    cleaned = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(stays, "\n"))
    runs = F.size(F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) < x - 1)))
    return joined.select(
        F.col("_row").withField(f"`{text_col}`", cleaned).alias("_row"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        runs.cast("long").alias("n_runs"),
    ).select("_row.*", *OUTPUTS)
