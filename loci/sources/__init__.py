from .features import read_features, read_sequence_regions, region_tree, write_features
from .hits import read_hits
from .reports import write_library, write_report
from .sequences import read_sequence_chunks, read_sequences, write_sequences

__all__ = [
    "read_features",
    "read_hits",
    "read_sequence_chunks",
    "read_sequence_regions",
    "read_sequences",
    "region_tree",
    "write_features",
    "write_library",
    "write_report",
    "write_sequences",
]
