"""Ready-made annotation jobs: functions from tables to tables, composed of the operators."""

from .classification import assign_families, classify_ltr, classify_tir, pair_families
from .evolution import age_of_repeats, element_ages, paired_repeats, recombination, solo_repeats
from .flow import GenomeFlow
from .genome import annotate_nonltr, global_summary, transfer_annotations
from .masking import find_fragments, fragment_residues, mask_genome, write_fragments
from .refinement import filter_tir_predictions, refine_predictions

__all__ = [
    "GenomeFlow",
    "age_of_repeats",
    "annotate_nonltr",
    "assign_families",
    "classify_ltr",
    "classify_tir",
    "element_ages",
    "filter_tir_predictions",
    "find_fragments",
    "fragment_residues",
    "global_summary",
    "mask_genome",
    "pair_families",
    "paired_repeats",
    "recombination",
    "refine_predictions",
    "solo_repeats",
    "transfer_annotations",
    "write_fragments",
]
