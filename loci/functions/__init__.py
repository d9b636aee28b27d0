from .columns import ambiguous_share, natural_key, reverse_complement, round_half_up
from .names import compact_length, format_name, parse_name, with_code

__all__ = [
    "ambiguous_share",
    "compact_length",
    "format_name",
    "natural_key",
    "parse_name",
    "reverse_complement",
    "round_half_up",
    "with_code",
]
