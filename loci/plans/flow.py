"""The whole annotation of a genome as a graph of steps (C14)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import natural_key
from ..functions.names import format_name
from ..operators import families as fam
from ..operators import hierarchy as hi
from ..operators.intervals import coordinate_sort, merge_intervals, renumber
from ..operators.ordering import concatenate
from ..operators.sequences import (
    CHUNK_SIZE,
    filter_ambiguous,
    mask_intervals,
    sequence_lengths,
    slice_sequences,
    touched_chunks,
    unmask,
)
from ..operators.summary import code_of
from ..schema import taxonomy
from ..session import materialize
from .classification import classify_ltr, classify_tir, feature_rows, pair_families
from .evolution import age_of_repeats, recombination, solo_repeats
from .genome import annotate_nonltr
from .masking import find_fragments, fragment_residues, mask_genome
from .refinement import filter_tir_predictions, refine_predictions

Run = tuple[DataFrame, DataFrame]


class Masked:
    """A genome and the intervals masked in it so far.

    Only the intervals are written between steps. Residues are masked where a
    step reads them: in the chunks that its rows touch.
    """

    def __init__(self, chunks: DataFrame, size: int, spans: DataFrame | None = None):
        self.chunks, self.size, self.spans = chunks, size, spans

    def plus(self, *tables: DataFrame) -> Masked:
        places = [t.select("seq_id", "start", "end") for t in ([self.spans] if self.spans is not None else []) + list(tables)]
        return Masked(self.chunks, self.size, materialize(merge_intervals(reduce(DataFrame.unionByName, places), gap=1)))

    def near(self, rows: DataFrame) -> DataFrame:
        """Masked chunks that ``rows`` touch."""
        found = touched_chunks(rows, self.chunks, self.size)
        return found if self.spans is None else mask_intervals(found, self.spans, self.size)

    def clean(self, rows: DataFrame, key: Sequence[str], share: float) -> DataFrame:
        """``rows`` whose share of masked or ambiguous letters is below ``share``."""
        return filter_ambiguous(rows, self.near(rows), key, share, self.size)


def renumber_tree(elements: DataFrame, parts: DataFrame, prefix: str, old: str = "old_id", ties: Sequence[Column | str] = ()) -> Run:
    """Elements numbered by natural sequence order and start, and the new ids passed on to their parts.

    ``elements`` has the id of the prediction in ``element_id``; it stays as
    ``old``. A part without an element goes.
    """
    named = materialize(renumber(elements, prefix, ties=[natural_key("element_id"), "element_id", *ties], id_col="element_id", out="_new"))
    names = named.select("element_id", "_new")
    moved = parts.join(names, "element_id").withColumn("element_id", F.col("_new")).drop("_new")
    return named.withColumnRenamed("element_id", old).withColumnRenamed("_new", "element_id"), moved


def renumber_regions(elements: DataFrame, parts: DataFrame, prefix: str = "repeat_region") -> Run:
    """One region an element, numbered over all kinds of elements, in elements and parts alike."""
    named = materialize(renumber(elements.drop("region_id"), prefix, ties=[natural_key("element_id"), "element_id"], id_col="element_id", out="region_id"))
    return named, parts.drop("region_id").join(named.select("element_id", "region_id"), "element_id")


def refined_tree(
    strict: Run, relaxed: Run, chunks: DataFrame, prefix: str, max_ambiguous: float, size: int, bin: int, **refining
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements and parts of the two runs combined and renumbered, and the ledger."""
    refined, ledger = refine_predictions(strict, relaxed, chunks, max_ambiguous=max_ambiguous, prefix=prefix, size=size, bin=bin, **refining)
    # the runs number their elements apart: an id means something with the name of its run only
    runs = {"strict": strict, "relaxed": relaxed}
    known = [
        t.select(F.concat_ws("_", "element_id", F.lit(run)).alias("id"), "strand", F.col("element_id").alias("_own"), F.lit(run).alias("_run"))
        for run, (t, _) in runs.items()
    ]
    refined = materialize(refined.withColumnsRenamed({"new_id": "element_id"}).join(reduce(DataFrame.unionByName, known), "id"))
    elements = refined.select("seq_id", "start", "end", "strand", F.lit(prefix).alias("type"), "element_id", F.col("id").alias("old_id"))

    def moved(run: str, parts: DataFrame) -> DataFrame:
        """Parts keep the ids of their run until the join, so runs with the same parts shuffle them once."""
        names = refined.where(F.col("_run") == run).select("_own", F.col("element_id").alias("_new"))
        rest = [c for c in parts.columns if c != "element_id"]
        return parts.join(names, F.col("element_id").eqNullSafe(F.col("_own"))).select(F.col("_new").alias("element_id"), *rest)

    moved = reduce(DataFrame.unionByName, [moved(run, parts) for run, (_, parts) in runs.items()])
    return elements, moved, ledger


def library_rows(
    elements: DataFrame, families: DataFrame, chunks: DataFrame, default: str, size: int = CHUNK_SIZE
) -> DataFrame:
    """Residues of elements under their full names (name, residues): code, family, element, place.

    ``families`` has element_id, superfamily and family. A superfamily without
    a code takes ``default``.
    """
    named = elements.select("seq_id", "element_id", "start", "end").join(families.select("element_id", "superfamily", "family"), "element_id")
    named = code_of(named.withColumn("superfamily", F.replace("superfamily", F.lit("-"), F.lit("/"))))
    named = named.withColumns(
        {
            "side": F.lit(None).cast("string"),
            "code": F.coalesce("code", F.lit(default)),
            "is_singleton": F.col("family").startswith("singleton_"),
            "family_no": F.regexp_extract("family", "([0-9]+)$", 1),
            "element_type": F.regexp_extract("element_id", "^(.*?)[0-9]+$", 1),
            "element_no": F.regexp_extract("element_id", "([0-9]+)$", 1),
        }
    )
    named = materialize(format_name(named, "name").select("name", "element_id", "seq_id", "start", "end"))
    cut = slice_sequences(named, chunks, ["name"], size)
    return cut.select("name", "residues")


class GenomeFlow(Mapping[str, DataFrame]):
    """Results of the whole flow by name; a step runs when a result of it is first asked for.

    In order: LTR elements are refined and mask the genome; TRIMs are refined on
    what is left; both are classified together and mask; LTR ages, solo repeats
    and recombination follow; helitrons, inverted-repeat elements and non-LTR
    elements are each cleaned by the newest mask, put into families and mask in
    turn; the complete library masks the genome as given; fragments are looked
    for in what is left; libraries, features, similarity and ages are combined.
    """

    def __init__(
        self,
        chunks: DataFrame,
        ltrs: tuple[Run, Run],
        trims: tuple[Run, Run] | None = None,
        helitrons: DataFrame | None = None,
        tirs: Run | None = None,
        nonltrs: Run | None = None,
        votes: DataFrame | None = None,
        library_hits: DataFrame | None = None,
        fragment_hits: DataFrame | None = None,
        solo_hits: DataFrame | None = None,
        pair_hits: DataFrame | None = None,
        member_hits: DataFrame | None = None,
        alignments: DataFrame | None = None,
        aligned_families: DataFrame | None = None,
        step_hits: Mapping[str, DataFrame] | None = None,
        max_ambiguous: float = 0.30,
        min_nonltr: int = 300,
        rate: float = 1e-8,
        size: int = CHUNK_SIZE,
        bin: int = 4096,
        **clustering,
    ):
        self.chunks, self.ltrs, self.trims, self.helitrons, self.tirs, self.nonltrs = chunks, ltrs, trims, helitrons, tirs, nonltrs
        self.votes, self.library_hits, self.fragment_hits, self.solo_hits = votes, library_hits, fragment_hits, solo_hits
        self.pair_hits, self.member_hits, self.alignments, self.aligned_families = pair_hits, member_hits, alignments, aligned_families
        self.step_hits = dict(step_hits or {})
        self.max_ambiguous, self.min_nonltr, self.rate, self.size, self.bin, self.clustering = max_ambiguous, min_nonltr, rate, size, bin, clustering
        self._done: dict[str, object] = {}

    # ---- the graph

    def _step(self, make: Callable):
        name = make.__name__
        if name not in self._done:
            self._done[name] = make()
        return self._done[name]

    def _outputs(self) -> dict[str, Callable[[], DataFrame | None]]:
        step, part = self._step, lambda make, key: lambda: (self._step(make) or {}).get(key)
        return {
            "ltr_elements": part(self._ltrs, "elements"),
            "ledger": part(self._ltrs, "ledger"),
            "trim_elements": part(self._trims, "elements"),
            "trim_ledger": part(self._trims, "ledger"),
            "trim_library": lambda: step(self._trim_library),
            "ltr_families": part(self._classified_ltrs, "families"),
            "ltr_features": part(self._classified_ltrs, "features"),
            "ltr_ages": lambda: step(self._ltr_ages),
            "solo_repeats": lambda: step(self._solo),
            "recombination": part(self._recombination, "per_family"),
            "recombination_repeats": part(self._recombination, "repeats"),
            "helitrons": part(self._helitrons, "elements"),
            "helitron_families": part(self._helitrons, "families"),
            "tir_elements": lambda: step(self._clean_tirs),
            "tir_families": part(self._classified_tirs, "families"),
            "tir_features": part(self._classified_tirs, "features"),
            "tir_ages": lambda: step(self._tir_ages),
            "nonltrs": part(self._nonltrs, "elements"),
            "nonltr_families": part(self._nonltrs, "families"),
            "families": lambda: step(self._families),
            "family_counts": lambda: fam.family_counts(step(self._families)),
            "library": lambda: step(self._library),
            "masked": lambda: step(self._final)[0] if step(self._final) else None,
            "coverage": lambda: step(self._final)[1] if step(self._final) else None,
            "fragments": lambda: step(self._fragments),
            "full_library": lambda: step(self._full_library),
            "features": lambda: step(self._features),
            "similarity": lambda: step(self._similarity),
            "ages": lambda: step(self._ages),
        }

    def __getitem__(self, name: str) -> DataFrame:
        found = self._outputs()[name]()
        if found is None:
            raise KeyError(f"{name}: the input of this step is not given")
        return found

    def __iter__(self) -> Iterator[str]:
        """Names of all results; those whose input is not given raise when asked for."""
        return iter(self._outputs())

    def __len__(self) -> int:
        return len(self._outputs())

    def _hits_of(self, step: str) -> list[DataFrame]:
        """Where the library of a step matches the genome: further places to mask."""
        hits = self.step_hits.get(step)
        return [] if hits is None else [hits.select(F.col("subject").alias("seq_id"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))]

    # ---- LTR elements and TRIMs

    def _genome(self) -> Masked:
        return Masked(self.chunks, self.size)

    def _refined(self, runs: tuple[Run, Run], genome: Masked, prefix: str) -> dict[str, DataFrame]:
        places = runs[0][0].select("seq_id", "start", "end").unionByName(runs[1][0].select("seq_id", "start", "end"))
        elements, parts, ledger = refined_tree(*runs, genome.near(places), prefix, self.max_ambiguous, self.size, self.bin)
        return {"elements": materialize(elements), "parts": parts, "ledger": ledger}

    def _ltrs(self) -> dict[str, DataFrame]:
        return self._refined(self.ltrs, self._genome(), "LTR_retrotransposon")

    def _after_ltrs(self) -> Masked:
        return self._genome().plus(self._step(self._ltrs)["elements"], *self._hits_of("ltrs"))

    def _trims(self) -> dict[str, DataFrame] | None:
        return None if self.trims is None else self._refined(self.trims, self._step(self._after_ltrs), "TRIM_retrotransposon")

    def _ltrs_and_trims(self) -> Run:
        """Both as one tree, with regions numbered over both."""
        runs = [r for r in (self._step(self._ltrs), self._step(self._trims)) if r]
        elements = reduce(DataFrame.unionByName, [r["elements"] for r in runs])
        parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r["parts"] for r in runs])
        elements, parts = renumber_regions(elements, parts)
        return elements, materialize(parts)

    def _classified_ltrs(self) -> dict[str, DataFrame]:
        return classify_ltr(*self._step(self._ltrs_and_trims), self.chunks, size=self.size, hits=self.member_hits, **self.clustering)

    def _trim_library(self) -> DataFrame | None:
        """TRIMs under their names: found with masked letters, given back those of the genome."""
        if self._step(self._trims) is None:
            return None
        elements, families = self._step(self._trims)["elements"], self._step(self._classified_ltrs)["families"]
        found = library_rows(elements, families, self._step(self._after_ltrs).near(elements), "RLX", self.size)
        return unmask(found, touched_chunks(elements, self.chunks, self.size), self.size)

    def _ltr_ages(self) -> DataFrame:
        _, parts = self._step(self._ltrs_and_trims)
        return age_of_repeats(parts, self.chunks, alignments=self.alignments, rate=self.rate, size=self.size)

    def _after_trims(self) -> Masked:
        return self._step(self._after_ltrs).plus(self._step(self._ltrs_and_trims)[0], *self._hits_of("classified"))

    def _solo(self) -> DataFrame | None:
        if self.solo_hits is None:
            return None
        hits = self.solo_hits.withColumns({"seq_id": F.col("subject"), "start": F.col("s_start"), "end": F.col("s_end")})
        key = ["query", "identity", "bits"]
        left = self._step(self._after_ltrs).clean(hits, key, self.max_ambiguous)
        return solo_repeats(left.drop("seq_id", "start", "end"))

    def _recombination(self) -> dict[str, DataFrame] | None:
        return None if self.aligned_families is None else recombination(self.aligned_families)

    # ---- the other kinds

    def _paired(self, elements: DataFrame, superfamily: Column) -> DataFrame:
        lengths = elements.select("element_id", (F.col("end") - F.col("start") + 1).alias("length"), superfamily.alias("superfamily"), "old_id")
        return pair_families(lengths.drop("old_id"), self._renamed_hits(lengths))["families"]

    def _renamed_hits(self, named: DataFrame) -> DataFrame | None:
        """Hits between elements, under their new ids; others go."""
        if self.pair_hits is None:
            return None
        names = named.select("old_id", "element_id")
        sides = self.pair_hits
        for side in ("query", "subject"):
            sides = sides.join(names.withColumnsRenamed({"old_id": side, "element_id": "_new"}), side).withColumn(side, F.col("_new")).drop("_new")
        return sides

    def _numbered(self, elements: DataFrame, prefix: str) -> DataFrame:
        named = renumber(elements, prefix, ties=[natural_key("element_id"), "element_id"], id_col="element_id", out="_new")
        return materialize(named.withColumnsRenamed({"element_id": "old_id", "_new": "element_id"}))

    def _helitrons(self) -> dict[str, DataFrame] | None:
        if self.helitrons is None:
            return None
        left = self._step(self._after_trims).clean(self.helitrons, ["element_id"], self.max_ambiguous)
        elements = self._numbered(left.select("seq_id", "start", "end", "strand", "element_id"), "helitron")
        return {"elements": elements, "families": self._paired(elements, F.lit("Helitron"))}

    def _after_helitrons(self) -> Masked:
        found = self._step(self._helitrons)
        genome = self._step(self._after_trims)
        return genome if found is None else genome.plus(found["elements"], *self._hits_of("helitrons"))

    def _clean_tirs(self) -> DataFrame | None:
        if self.tirs is None:
            return None
        kept = filter_tir_predictions(*self.tirs)
        return materialize(self._step(self._after_helitrons).clean(kept, ["element_id"], self.max_ambiguous))

    def _tir_tree(self) -> Run:
        tree = renumber_tree(self._step(self._clean_tirs), self.tirs[1], "terminal_inverted_repeat_element")
        elements, parts = renumber_regions(*tree, "inverted_repeat_region")
        return elements, materialize(parts)

    def _classified_tirs(self) -> dict[str, DataFrame] | None:
        if self.tirs is None:
            return None
        elements, parts = self._step(self._tir_tree)
        return classify_tir(elements, parts, self._step(self._after_helitrons).near(elements), size=self.size, hits=self.member_hits, **self.clustering)

    def _tir_ages(self) -> DataFrame | None:
        if self.tirs is None:
            return None
        _, parts = self._step(self._tir_tree)
        return age_of_repeats(parts, self.chunks, alignments=self.alignments, kind="terminal_inverted_repeat", rate=self.rate, size=self.size)

    def _after_tirs(self) -> Masked:
        found = self._step(self._clean_tirs)
        genome = self._step(self._after_helitrons)
        return genome if found is None else genome.plus(found, *self._hits_of("tirs"))

    def _nonltrs(self) -> dict[str, DataFrame] | None:
        if self.nonltrs is None:
            return None
        genome = self._step(self._after_tirs)
        found = annotate_nonltr(
            *self.nonltrs, sequence_lengths(self.chunks), genome.near, votes=self.votes, min_length=self.min_nonltr, max_ambiguous=self.max_ambiguous, size=self.size
        )
        elements = self._numbered(found.drop("residues"), "non_LTR_retrotransposon")
        return {"elements": elements, "families": self._paired(elements, F.col("clade"))}

    # ---- everything together

    def _families(self) -> DataFrame:
        steps = [self._classified_ltrs, self._helitrons, self._classified_tirs, self._nonltrs]
        found = [r["families"] for r in map(self._step, steps) if r]
        return materialize(concatenate(*found))

    def _library(self) -> DataFrame:
        """Complete elements: LTR elements, TRIMs and helitrons with the letters of the genome, the others as found."""
        ltrs, _ = self._step(self._ltrs_and_trims)
        out = [library_rows(ltrs, self._step(self._classified_ltrs)["families"], touched_chunks(ltrs, self.chunks, self.size), "RLX", self.size)]
        if self.helitrons is not None:
            found = self._step(self._helitrons)
            masked = library_rows(found["elements"], found["families"], self._step(self._after_trims).near(found["elements"]), "DHX", self.size)
            out.append(unmask(masked, touched_chunks(found["elements"], self.chunks, self.size), self.size))
        if self.tirs is not None:
            elements, _ = self._step(self._tir_tree)
            out.append(library_rows(elements, self._step(self._classified_tirs)["families"], self._step(self._after_helitrons).near(elements), "DTX", self.size))
        if self.nonltrs is not None:
            found = self._step(self._nonltrs)
            out.append(library_rows(found["elements"], found["families"], self._step(self._after_tirs).near(found["elements"]), "RIX", self.size))
        return materialize(concatenate(*out))

    def _final(self) -> tuple[DataFrame, DataFrame] | None:
        """The genome as given, masked by the hits of the library."""
        return None if self.library_hits is None else mask_genome(self.chunks, self.library_hits, size=self.size)

    def _final_mask(self) -> Masked:
        found = mask_genome(self.chunks, self.library_hits, size=self.size, spans_only=True)
        return self._genome().plus(found)

    def _fragments(self) -> DataFrame | None:
        if self.fragment_hits is None:
            return None
        hits = self.fragment_hits.withColumns({"seq_id": F.col("subject"), "start": F.col("s_start"), "end": F.col("s_end")})
        if self.library_hits is not None:
            hits = self._step(self._final_mask).clean(hits, ["query", "identity", "bits", "evalue"], self.max_ambiguous)
        return materialize(fragment_residues(find_fragments(hits.drop("seq_id", "start", "end")), self.chunks, self.size))

    def _full_library(self) -> DataFrame:
        """Complete elements and fragments."""
        fragments = self._step(self._fragments)
        library = self._step(self._library)
        return library if fragments is None else concatenate(library, fragments.select(F.col("id").alias("name"), "residues"))

    def _features(self) -> DataFrame:
        """All features in coordinate order, each part below its element and each element below its region."""
        tables = [self._step(self._classified_ltrs)["features"]]
        if self.tirs is not None:
            tables.append(self._step(self._classified_tirs)["features"])
        for made, kind in ((self._step(self._helitrons), "helitron"), (self._step(self._nonltrs), "non_LTR_retrotransposon")):
            if made:
                tables.append(feature_rows(made["elements"].withColumn("type", F.lit(kind)), None, made["families"]))
        for rows, kind in ((self._step(self._solo), "solo_LTR"), (self._step(self._fragments), "similarity")):
            if rows is not None:
                named = rows.withColumnsRenamed({"id": "element_id"}).withColumn("type", F.lit(kind))
                named = named if "strand" in named.columns else named.withColumn("strand", F.lit("?"))
                tables.append(feature_rows(named, None, None))
        ids = F.coalesce(F.try_element_at("attributes", F.lit("ID")), F.array())
        return coordinate_sort(*tables, ties=["type", ids])

    def _similarity(self) -> DataFrame | None:
        if self.member_hits is None:
            return None
        lengths = self._step(self._library).select(F.col("name").alias("element_id"), F.length("residues").cast("bigint").alias("length"))
        family = F.regexp_extract("element_id", "^([A-Z]{3}_(?:singleton_)?family[0-9]+)_", 1)
        return fam.family_similarity(self.member_hits, lengths.withColumn("family", family))

    def _ages(self) -> DataFrame:
        """Ages of LTR and inverted-repeat elements with their families."""
        kinds = [(self._step(self._ltr_ages), self._step(self._classified_ltrs)["families"], "LTR_retrotransposon", "RLX")]
        if self.tirs is not None:
            kinds.append((self._step(self._tir_ages), self._step(self._classified_tirs)["families"], "terminal_inverted_repeat_element", "DTX"))
        members, ages = [], []
        for found, families, kind, default in kinds:
            coded = code_of(families.withColumn("superfamily", F.replace("superfamily", F.lit("-"), F.lit("/"))))
            named = materialize(coded.select("element_id", F.lit(kind).alias("type"), F.concat_ws("_", F.coalesce("code", F.lit(default)), "family").alias("family")))
            members.append(named)
            ages.append(found.join(named, "element_id"))
        return fam.age_summary(concatenate(*ages), concatenate(*members), taxonomy(self.chunks.sparkSession))
