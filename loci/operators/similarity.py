"""Similar pairs of sequences and the clusters they link."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import reverse_complement
from ..session import discard, materialize
from .intervals import carry_over_tiles, merge_intervals
from .screening import can_match, shared_kmers


def kmers(c: Column | str, k: int, within: Sequence[str] = ()) -> Column:
    """Distinct k-mers of a text as 64-bit digests.

    The text is cut into non-overlapping pieces once per phase, so the work is
    linear in its length. With ``within`` the digests cover those columns too:
    texts of different groups then share nothing.
    """
    text = F.col(c) if isinstance(c, str) else c
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(k)),
            lambda phase: F.regexp_extract_all(F.substring(text, phase, F.length(text)), F.lit("(?s).{%d}" % k), F.lit(0)),
        )
    )
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p, *within)))


def copies(t: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Each id with the smallest id among rows of the same text (and group).

    Only digests are shuffled, and only a minimum is kept per digest.
    """
    marked = t.select("id", F.sha2("residues", 256).alias("_digest"), *within)
    first = marked.groupBy("_digest", *within).agg(F.min("id").alias("representative"))
    return marked.join(first, ["_digest", *within]).select("id", "representative")


def _sets(t: DataFrame, k: int, within: Sequence[str], min_share: float) -> DataFrame:
    """Distinct texts that may have a similar one, with their k-mers: (no, id, residues, k, kmers).

    Numbers are shorter to carry than ids; written, so that they stay. K-mers
    take eight times the room of their text: texts are written, and k-mers made
    where they are read. Texts most of whose k-mers are found nowhere else go
    before k-mers are carried at all (:func:`can_match`).
    """
    same = copies(t, within)
    reps = same.where(F.col("id") == F.col("representative")).select("id")
    texts = t.where(F.length("residues") >= k).select("id", "residues", *within)
    written = materialize(texts.hint("merge").join(reps, "id", "left_semi").withColumn("no", F.monotonically_increasing_id()))
    some = materialize(can_match(written, k, min_share, within))
    kept = materialize(written.join(some, "no", "left_semi"))
    discard(written, some)
    return kept.select("no", "id", "residues", F.lit(k).alias("k"), kmers("residues", k, within).alias("kmers"))


def _prefixes(sets: DataFrame, min_share: float) -> DataFrame:
    """The rarest k-mers of each text (kmer, no, n, place): two texts above the threshold agree on one of them.

    ``place`` counts a text's k-mers from the rarest on. K-mers found in a
    single text take their places but are not carried along; frequent ones,
    which would make large groups, come last and so stay out. All k-mers are
    shuffled once, to be counted where they then go on.
    """
    tokens = sets.select("no", F.size("kmers").alias("n"), F.explode("kmers").alias("kmer"))
    carried = tokens.withColumn("df", F.count("*").over(Window.partitionBy("kmer"))).where(F.col("df") > 1)
    of_text = Window.partitionBy("no")
    ranked = carried.withColumn("place", F.col("n") - F.count("*").over(of_text) + F.row_number().over(of_text.orderBy("df", "kmer")))
    # n - ceil(share * n) + 1 rarest k-mers; the small term guards the ceiling against rounding
    depth = F.col("n") - F.ceil(F.col("n") * min_share - 1e-9) + 1
    return ranked.where(F.col("place") <= depth).select("kmer", "no", "n", "place")


def _candidates(left: DataFrame, right: DataFrame, min_share: float, condition: Column) -> DataFrame:
    """Pairs (a, b) of ``left`` and ``right`` prefixes that length and position do not rule out.

    With c k-mers met in the prefixes, the last at places i and j, a pair has
    c + min(n_a - i, n_b - j) in common at most; it needs share / (1 + share)
    of n_a + n_b.
    """
    side = lambda t, x: t.select("kmer", *[F.col(c).alias(f"{x}{c}") for c in t.columns if c != "kmer"])
    return _counted(side(left, "a_").join(side(right, "b_"), "kmer").where(condition), min_share)


def _counted(met: DataFrame, min_share: float) -> DataFrame:
    """Pairs (a, b) out of prefixes that met (``a_no``, ``b_no``, ``a_n`` ...)."""
    near = met.where(F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * min_share - 1e-9)
    pairs = near.groupBy(F.col("a_no").alias("a"), F.col("b_no").alias("b"), "a_n", "b_n").agg(
        F.count("*").alias("c"), F.max("a_place").alias("i"), F.max("b_place").alias("j")
    )
    most = F.col("c") + F.least(F.col("a_n") - F.col("i"), F.col("b_n") - F.col("j"))
    needed = (F.col("a_n") + F.col("b_n")) * (min_share / (1 + min_share))
    return pairs.where(most >= needed - 1e-6).select("a", "b")


def _verified(candidates: DataFrame, sets: DataFrame, min_share: float) -> DataFrame:
    """Candidates whose share reaches the threshold, with ``shared`` and ``share``.

    A text goes to each of its pairs, and k-mers are made there: lists of them would take eight times the room.
    """
    pairs = materialize(candidates)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct()
    own = sets.hint("merge").join(wanted, "no", "left_semi").select("no", "residues", "k")
    left = own.select(F.col("no").alias("a"), F.col("residues").alias("_ta"), "k")
    right = own.select(F.col("no").alias("b"), F.col("residues").alias("_tb"))
    # no estimate knows how long the texts are: they are never broadcast
    met = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    counted = shared_kmers(met.select("a", "b", "_ta", "_tb", "k"))
    share = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return counted.select("a", "b", "shared", share.alias("share")).where(F.col("share") >= min_share)


def _named(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of numbers as pairs of ids, the smaller one first."""
    a = sets.select(F.col("no").alias("a"), F.col("id").alias("_a"))
    b = sets.select(F.col("no").alias("b"), F.col("id").alias("_b"))
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), *rest)


def similar_pairs(t: DataFrame, k: int = 16, min_share: float = 0.8, within: Sequence[str] = ()) -> DataFrame:
    """Pairs of different texts whose k-mer sets have a Jaccard share of at least ``min_share`` (G1).

    ``t`` has ``id`` and ``residues``; identical texts are represented by their
    smallest id (see :func:`copies`). The result is exact: the rarest k-mers of
    each text are joined, and candidates that pass the filters of length and
    position are counted. ``within`` names columns both sides must agree on.
    All pairs are the result here, so near copies of one text make a square of
    them; clusters need fewer (:func:`linking_pairs`).
    """
    sets = _sets(t, k, within, min_share)
    prefix = materialize(_prefixes(sets, min_share))
    return _named(_verified(_candidates(prefix, prefix, min_share, F.col("a_no") < F.col("b_no")), sets, min_share), sets)


def linking_pairs(t: DataFrame, k: int = 16, min_share: float = 0.8, within: Sequence[str] = ()) -> DataFrame:
    """Enough of the similar pairs (a, b) to link the same clusters as all of them.

    First every text of a prefix group is compared with the group's smallest
    one alone: n texts make n candidates, and near copies become one cluster.
    Only pairs of a group that lie in different clusters then are still open;
    they are all compared, so no link is lost.
    """
    sets = _sets(t, k, within, min_share)
    of_kmer = Window.partitionBy("kmer")
    centre = {"_centre": F.min(F.struct("n", "no", "place")).over(of_kmer), "_texts": F.count("*").over(of_kmer)}
    # a k-mer in one prefix only brings nothing together; its rows and their centre are on one side of one shuffle
    prefix = materialize(
        _prefixes(sets, min_share)
        .withColumns(centre)
        .where(F.col("_texts") > 1)
        .select("kmer", "no", "n", "place", *[F.col(f"_centre.{c}").alias(f"a_{c}") for c in ("no", "n", "place")])
    )
    met = prefix.withColumnsRenamed({"no": "b_no", "n": "b_n", "place": "b_place"}).where(F.col("a_no") != F.col("b_no"))
    stars = materialize(_verified(_counted(met, min_share), sets, min_share).select("a", "b"))

    # two rounds of smallest labels reach from every text over its centre to the centre's texts: parts of clusters suffice here
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    once = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("of"))
    twice = both.join(once.withColumnRenamed("a", "b"), "b").groupBy(F.col("a").alias("no")).agg(F.min("of").alias("of"))
    placed = prefix.select("kmer", "no", "n", "place").join(twice, "no", "left").withColumn("of", F.coalesce("of", "no"))
    mixed = placed.withColumns({"_lo": F.min("of").over(of_kmer), "_hi": F.max("of").over(of_kmer)})
    still = materialize(mixed.where(F.col("_lo") < F.col("_hi")).drop("_lo", "_hi"))
    across = _candidates(still, still, min_share, (F.col("a_no") < F.col("b_no")) & (F.col("a_of") != F.col("b_of")))
    return _named(stars.unionByName(_verified(across, sets, min_share).select("a", "b")), sets)


def link_copies(t: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One link from each copy to the representative of its text: all that linkage needs."""
    return copies(t, within).where(F.col("id") != F.col("representative")).select(F.col("representative").alias("a"), F.col("id").alias("b"))


def cluster(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Single-linkage clusters of linked ids (G2), named by their smallest id.

    Alternates the published large-star and small-star steps until the edges
    stand still. Every step is a minimum per node and one join; the state is
    written out each round.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(
        pairs.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    seen = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("_m"))
        large = both.join(lowest, "a").where(b > a).select(b.alias("a"), F.col("_m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(lowest, "a").where(b != F.col("_m")).select(b.alias("a"), F.col("_m").alias("b"))
        edges = materialize(small.unionByName(lowest.withColumnRenamed("_m", "b")).distinct())
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    found = edges.select(a.alias("id"), b.alias("cluster"))
    found = found.unionByName(found.select(F.col("cluster").alias("id"), "cluster").distinct())
    if nodes is None:
        return found
    return nodes.select("id").join(found, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return (row["n"], row["s"])


def cluster_sequences(t: DataFrame, k: int = 16, min_share: float = 0.8, within: Sequence[str] = ()) -> DataFrame:
    """Clusters of a sequence table: similar pairs, copies, linkage (G1 + G2)."""
    links = linking_pairs(t, k, min_share, within).unionByName(link_copies(t, within))
    return cluster(links, t.select("id"))


LONG = 1 << 22  # letters of a sequence whose k-mers are compared in more than one task
LETTERS_PER_TASK = 1 << 21


def _seeds(chunks: DataFrame, ends: DataFrame, k: int, inverted: bool, min_dist: int) -> DataFrame:
    """Positions ``x`` of k-mers that occur again in their sequence, with the letters around them.

    ``h`` is the digest of the k-mer; ``inverted`` seeds have that of the other
    strand as ``g`` instead of letters, and k-mers found on one strand only go.
    The pads of the chunks must be at least ``k`` long. K-mers take far more
    room than letters: the chunks of a sequence are brought together first, and
    its k-mers compared where they are made. Those of sequences of more than
    LONG letters are shuffled.
    """
    letters, longest = ends.agg(F.sum("_end"), F.max("_end")).first()
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(letters or 0) // LETTERS_PER_TASK))
    own = ["before", "behind"] if not inverted else ["g"]
    of_kmer = Window.partitionBy("seq_id", "c")

    def again(over: Callable[[Column], Column]) -> Column:
        """The k-mer comes twice, ``min_dist`` apart, and (``inverted``) on both strands."""
        found = over(F.max("x")) - over(F.min("x")) >= min_dist
        if inverted:
            found = found & over(F.max(F.col("h") <= F.col("g"))) & over(F.max(F.col("h") >= F.col("g")))
        return found

    def part(of: Column) -> DataFrame:
        return chunks.hint("merge").join(ends.where(of), "seq_id", "left_semi") if (longest or 0) > LONG else chunks.where("seq_id IS NOT NULL")

    near = _all_seeds(part(F.col("_end") <= LONG).repartition(tasks, "seq_id"), k, inverted)
    found = near.withColumn("_again", again(lambda c: c.over(of_kmer))).where("_again").select("seq_id", "x", "h", *own)
    if (longest or 0) > LONG:
        far = _all_seeds(part(F.col("_end") > LONG), k, inverted)
        twice = far.groupBy("seq_id", "c").agg(again(lambda c: c).alias("_again")).where("_again").select("seq_id", "c")
        found = found.unionByName(far.hint("merge").join(twice, ["seq_id", "c"]).select("seq_id", "x", "h", *own))
    return materialize(found)


def _all_seeds(chunks: DataFrame, k: int, inverted: bool) -> DataFrame:
    """Every position with its k-mer: a k-mer and its other strand share one name ``c``, the smaller digest."""
    first = F.when(F.col("left_pad") > 0, F.substring(F.col("residues"), F.col("left_pad"), F.lit(1))).otherwise(F.lit("\u0002"))
    core_length = F.col("core_end") - F.col("core_start") + 1
    rest = F.substring(F.col("residues"), F.col("left_pad") + 1, core_length + F.least(F.col("right_pad"), F.lit(k)))
    last = F.when(F.col("right_pad") < k, F.lit("\u0003")).otherwise(F.lit(""))
    text = F.concat(first, rest, last)
    # an empty match at every place, looking ahead over a letter, the k-mer and a letter
    views = F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % (k + 2)), F.lit(1))
    at = chunks.select("seq_id", "core_start", F.posexplode(views).alias("j", "w"))
    mer = F.substring("w", 2, k)
    seed = at.select(
        "seq_id",
        (F.col("core_start") + F.col("j")).alias("x"),
        F.xxhash64(mer).alias("h"),
        F.xxhash64(reverse_complement(mer) if inverted else mer).alias("g"),
        F.left("w", F.lit(1)).alias("before"),
        F.right("w", F.lit(1)).alias("behind"),
    )
    return seed.withColumn("c", F.least("h", "g"))


def _pairs(left: DataFrame, right: DataFrame, key: list[str], min_dist: int, max_dist: int) -> DataFrame:
    """Equal seeds at a distance within bounds; a bin of positions is part of the key."""
    span = F.lit(max(max_dist, 1))
    a = left.withColumn("_bin", F.explode(F.array(F.floor(F.col("x") / span), F.floor(F.col("x") / span) + 1)))
    b = right.withColumn("_bin", F.floor(F.col("y") / span))
    # seeds are small as files and large as rows: they are never broadcast
    return a.hint("merge").join(b, ["seq_id", "h", "_bin", *key]).where((F.col("y") - F.col("x")).between(min_dist, max_dist))


def _borders(seed: DataFrame, side: str, min_dist: int, max_dist: int) -> DataFrame:
    """Pairs of equal seeds whose letters on one side differ: where a stretch begins or ends.

    Pairs that agree there lie inside a stretch and are never formed: a seed
    joins only those with another letter, and the letters of a group are few.
    """
    span = F.lit(max(max_dist, 1))
    letters = (
        seed.select("seq_id", "h", F.floor(F.col("x") / span).alias("_bin"), F.col(side).alias("q"))
        .distinct()
        .withColumn("_bin", F.explode(F.array(F.col("_bin"), F.col("_bin") - 1)))
        .distinct()
    )
    left = seed.select("seq_id", "h", "x", F.col(side).alias("p"), F.floor(F.col("x") / span).alias("_bin"))
    wanted = left.hint("merge").join(letters, ["seq_id", "h", "_bin"]).where(F.col("p") != F.col("q")).select("seq_id", "h", "x", "q")
    right = seed.select("seq_id", "h", F.col("x").alias("y"), F.col(side).alias("q"))
    met = _pairs(wanted, right, ["q"], min_dist, max_dist)
    return met.select("seq_id", (F.col("y") - F.col("x")).alias("diagonal"), "x")


def _stretches(seed: DataFrame, min_dist: int, max_dist: int, tile: int = 1 << 16) -> DataFrame:
    """Maximal stretches of direct repeats: each begin with the next end on its diagonal."""
    none = F.lit(None).cast("bigint")
    begins = _borders(seed, "before", min_dist, max_dist).withColumn("_end", none)
    ends = _borders(seed, "behind", min_dist, max_dist).withColumn("_end", F.col("x"))
    key = ["seq_id", "diagonal"]
    line = begins.unionByName(ends).withColumn("_tile", F.floor(F.col("x") / tile).cast("bigint"))
    line = carry_over_tiles(line, key, F.min("_end"), "last", descending=True)
    # read backwards; at one place the end comes before the begin
    w = Window.partitionBy(*key, "_tile").orderBy(F.col("x").desc(), F.col("_end").desc_nulls_last())
    near = F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    closed = line.withColumn("end", F.coalesce(near, F.col("_carry"))).where(F.col("_end").isNull())
    return closed.select(*key, F.col("x").alias("start"), "end")


def repeat_pairs(
    chunks: DataFrame,
    k: int = 20,
    min_dist: int = 1000,
    max_dist: int = 15000,
    inverted: bool = False,
    min_length: int = 100,
    max_gap: int = 0,
) -> DataFrame:
    """Pairs of equal stretches of one sequence at a distance within bounds.

    Seeds are k-mers found twice within the distance. Direct repeats are built
    from the pairs at the two ends of a stretch alone, so a long or tandem
    repeat costs no more rows than it has stretches. On the other strand the
    distance changes along a stretch; there the seeds are paired inside bins of
    ``max_dist`` positions and merged. Stretches of one diagonal within
    ``max_gap`` are merged. Distances are between the starts of the seeds.
    """
    ends = materialize(chunks.groupBy("seq_id").agg(F.max("core_end").alias("_end")))
    pads = chunks.select("seq_id", "core_start", "core_end", "left_pad", "right_pad")
    # inside a sequence every chunk must see the k-mers that begin in it whole, and the letter before them
    cut = F.col("right_pad") < F.least(F.lit(k), F.col("_end") - F.col("core_end"))
    cut |= (F.col("left_pad") < 1) & (F.col("core_start") > 1)
    if not pads.join(ends, "seq_id").where(cut).isEmpty():
        raise ValueError(f"pads between chunks must have at least k = {k} letters")
    seed = _seeds(chunks, ends, k, inverted, min_dist)
    key = ["seq_id", "diagonal"]
    if inverted:
        first = seed.select("seq_id", "x", "h")
        second = seed.select("seq_id", F.col("x").alias("y"), F.col("g").alias("h"))
        met = _pairs(first, second, [], min_dist, max_dist)
        runs = met.select("seq_id", (F.col("x") + F.col("y")).alias("diagonal"), F.col("x").alias("start"), F.col("x").alias("end"))
        runs = merge_intervals(runs, by=key, gap=1 + max_gap)
    else:
        runs = _stretches(seed, min_dist, max_dist)
        if max_gap > 0:
            runs = merge_intervals(runs, by=key, gap=1 + max_gap)
    length = F.col("end") - F.col("start") + k
    other = F.col("diagonal") - F.col("end") if inverted else F.col("start") + F.col("diagonal")
    return runs.where(length >= min_length).select(
        "seq_id",
        F.col("start").alias("left_start"),
        (F.col("end") + (k - 1)).alias("left_end"),
        other.alias("right_start"),
        (other + length - 1).alias("right_end"),
        length.alias("length"),
    )
