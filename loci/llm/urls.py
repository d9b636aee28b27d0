"""URL filters: host and path rules, and gradient-boosted trees on lexical features (operator 8).

Rules judge the URLs that they fit. Those are the labelled URLs: the trees are
fitted on a bounded sample of them and judge the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .common import UPPER, packed

#: (verdict, host, path); a rule fits its host and all subdomains where the path starts alike.
Rule = tuple[str, str, str]
RULES: list[Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

#: Labelled URLs that the trees are fitted on, at most.
MOST_LABELLED = 20_000
#: Suffixes (some 50 bytes each) that are broadcast at most.
MOST_BROADCAST = 100_000
TREES, DEPTH, SEED = 20, 3, 7

OUTPUTS = ["host", "path", "rule", "verdict", "p_block"]
FEATURES = ["length", "host_length", "depth", "labels", "digits", "hyphens", "entropy", "parameters", "suffix_rate", "suffix_log_n"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path without query and fragment; both empty for a null or a text without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judged(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``rows`` with rule and its verdict, null where none fits; the longest fitting rule wins, the first of equals."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("by_rule", verdict)


def lexical(rows: DataFrame) -> DataFrame:
    """Features of _url, host and path; everything is a JVM expression on one row."""
    url = F.col("_url")
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    kinds = F.array_distinct(F.split(url, ""))
    share = F.transform(kinds, lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    bits = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return rows.withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "digits": count("[0-9]") / n,
        "hyphens": count("-"),
        "entropy": bits,
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "suffix": F.substring_index("host", ".", -1),
    })


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict (block or allow) and p_block, the trees' probability.

    Null and odd URLs have empty host and path and are judged like any other.
    Where the rules label URLs of one kind only, or none, there is nothing to
    learn and p_block is that kind, or 0. Repeated rows each get the same
    verdict. Other columns go through; columns named like the outputs are
    replaced.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = host_and_path(url)
    rows = judged(packed(pages, OUTPUTS, _url=url, host=host, path=path), rules)

    labelled = rows.where(F.col("by_rule").isNotNull()).select("_url", "host", "path", "by_rule").distinct()
    labelled = lexical(labelled).withColumn("label", (F.col("by_rule") == "block").cast("double"))
    # counts of a suffix are summed before they are shuffled
    suffixes = labelled.groupBy("suffix").agg(F.sum("label").alias("_blocked"), F.count("*").alias("_seen"))
    suffixes = materialize(suffixes)
    if suffixes.count() <= MOST_BROADCAST:  # else a shuffle, whose large suffixes Spark splits
        suffixes = F.broadcast(suffixes)
    seen, blocked = F.coalesce("_seen", F.lit(0)), F.coalesce("_blocked", F.lit(0.0))

    sample = labelled.orderBy(F.xxhash64("_url")).limit(MOST_LABELLED).join(suffixes, "suffix")
    # a labelled URL's suffix figures leave out the URL itself
    sample = sample.withColumns({"suffix_rate": (blocked - F.col("label") + 1.0) / (seen + 1.0), "suffix_log_n": F.log2(seen.cast("double"))})
    sample = materialize(sample)  # MOST_LABELLED rows, which every pass of the fit reads
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two rows at most
    if len(classes) < 2:
        judged_rows = rows.withColumn("p_block", F.lit(1.0 if 1.0 in classes else 0.0))
    else:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
        trees = GBTClassifier(featuresCol="_features", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
        model = trees.fit(assembler.transform(sample).select("_features", "label"))
        full = lexical(rows).join(suffixes, "suffix", "left").withColumns(
            {"suffix_rate": (blocked + 1.0) / (seen + 2.0), "suffix_log_n": F.log2(seen + 1.0)}
        )
        judged_rows = model.transform(assembler.transform(full)).withColumn("p_block", vector_to_array("probability")[1])
    discard(sample)
    verdict = F.coalesce("by_rule", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return judged_rows.withColumn("verdict", verdict).select("_row.*", *OUTPUTS)
