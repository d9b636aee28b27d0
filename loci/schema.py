"""Row shapes and the small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "lists": T.MapType(T.StringType(), T.ArrayType(T.StringType())),
}


def _struct(columns: str) -> T.StructType:
    """Columns as ``name type, ...``; needs no session, so that the module can be imported without one."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FEATURE = _struct(
    "seq_id string, source string, type string, start bigint, end bigint, score double, strand string, "
    "phase int, attributes lists, file string, line_no bigint"
)
SEQUENCE = _struct("seq_id string, description string, residues string")
CHUNK = _struct(
    "seq_id string, chunk_no bigint, core_start bigint, core_end bigint, left_pad bigint, right_pad bigint, residues string"
)
HIT_FILE = _struct(
    "query string, subject string, identity double, length bigint, mismatches bigint, gap_opens bigint, "
    "q_start bigint, q_end bigint, s_start bigint, s_end bigint, evalue double, bits double"
)
HIT = T.StructType([*HIT_FILE.fields, T.StructField("strand", T.StringType())])
CLUSTER_MEMBER = _struct("part string, cluster_id string, element_id string")
FAMILY = _struct("superfamily string, family string, element_id string, is_singleton boolean")

# Classification codes (code | superfamily | class | order | name).
# A dash marks a code that one of the two published maps leaves out.
TAXONOMY = """
RYD|DIRS|-|-|-
RLD|-|Class I|DIRS|DIRS
RYN|Ngaro|Class I|DIRS|Ngaro
RYX|Unknown_DIRS|Class I|DIRS|Unknown DIRS
RYV|VIPER|Class I|DIRS|VIPER
RII|I|Class I|LINE|I
RIJ|Jockey|Class I|LINE|Jockey
RIL|L1|Class I|LINE|L1
RIM|L2|-|-|-
RIR|R2|Class I|LINE|R2
RIT|RTE|Class I|LINE|RTE
RIX|Unknown_LINE|Class I|LINE|Unknown LINE
RIC|Rex|Class I|LINE|CR1
RIS|R1|Class I|LINE|R1
RIA|RandI|Class I|LINE|RandI
RIE|CRE|Class I|LINE|Rex
RID|Tad1|Class I|LINE|Tad1
RLB|Bel/Pao|Class I|LTR|Bel/Pao
RLC|Copia|Class I|LTR|Copia
RLE|ERV|Class I|LTR|ERV
RLG|Gypsy|Class I|LTR|Gypsy
RLR|Retrovirus|Class I|LTR|Retrovirus
RLT|TRIM|Class I|LTR|TRIM
RLX|Unknown_LTR|Class I|LTR|Unknown LTR
PPP|Penelope|-|-|-
RPP|-|Class I|Penelope|Penelope
RPX|Unknown_PLE|Class I|Penelope|Unknown PLE
RSS|5S|Class I|SINE|5S
RSL|7SL|Class I|SINE|7SL
RST|SINE2/tRNA|Class I|SINE|tRNA
RSX|Unknown_SINE|Class I|SINE|Unknown SINE
RXX|Unknown_retrotransposon|Class I|SINE|Unknown retrotransposon
DYC|Crypton|Class II|Crypton|Crypton
DYX|Unknown_Crypton|Class II|Crypton|Unknown Crypton
DTC|CACTA|Class II|TIR|CACTA
DTA|hAT|Class II|TIR|hAT
DTE|Merlin|Class II|TIR|Merlin
DTM|Mutator|Class II|TIR|Mutator
DTP|P|Class II|TIR|P
DTH|PIF/Harbinger|Class II|TIR|PIF/Harbinger
DTB|PiggyBac|Class II|TIR|PiggyBac
DTT|Tc1/Mariner|Class II|TIR|Tc1/Mariner
DTR|Transib|Class II|TIR|Transib
DTX|Unknown_TIR|Class II|TIR|Unknown TIR
DXX|Unknown_DNA_transposon|Class II|TIR|Unknown DNA transposon
DHH|Helitron|Class II|Helitron|Helitron
DHX|Unknown_Helitron|Class II|Helitron|Unknown Helitron
DMM|Maverick|Class II|Maverick|Maverick
DMX|Unknown_Maverick|Class II|Maverick|Unknown Maverick
"""

# Feature type -> sequence ontology term, domain name -> gene ontology term.
ONTOLOGY = """
LTR_retrotransposon|SO:0000186
LARD|SO:0002260
TRIM|SO:0002261
non_LTR_retrotransposon|SO:0000189
U_box|SO:0001788
RR_tract|SO:0000435
long_terminal_repeat|SO:0000286
inverted_repeat|SO:0000294
primer_binding_site|SO:0005850
protein_match|SO:0000349
terminal_inverted_repeat_element|SO:0000208
terminal_inverted_repeat|SO:0000481
MITE|SO:0000338
DNA_transposon|SO:0000182
helitron|SO:0000544
"""
DOMAIN_TERMS = """
RVT_1|GO:0003964
"""

# Lowest and highest state number of each clade in a state path.
CLADE_STATES = """
Jockey|1|3
I|4|6
CR1|7|9
Rex|10|12
R1|13|15
Tad1|16|18
RTE|19|21
L1|22|24
RandI|25|27
L2|28|30
CRE|31|31
R2|32|32
"""

# The standard genetic code, bases in the order T, C, A, G.
CODON_BASES = "TCAG"
CODON_PEPTIDES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def fixed_rows(text: str) -> list[list[str | None]]:
    return [[None if v == "-" else v for v in line.split("|")] for line in text.split("\n") if line]


def _inline(spark: SparkSession, rows: list[list[str | None]], columns: list[str]) -> DataFrame:
    def literal(v: str | None) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"`{c}`" for c in columns)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def taxonomy(spark: SparkSession) -> DataFrame:
    """One row per code; a class, order or name left out is ``Unknown``."""
    raw = _inline(spark, fixed_rows(TAXONOMY), ["code", "superfamily", "class", "order", "name"])
    return raw.fillna("Unknown", ["superfamily", "class", "order", "name"])


def ontology(spark: SparkSession) -> DataFrame:
    return _inline(spark, fixed_rows(ONTOLOGY), ["type", "so_term"])


def domain_terms(spark: SparkSession) -> DataFrame:
    return _inline(spark, fixed_rows(DOMAIN_TERMS), ["domain", "go_term"])


def clade_states(spark: SparkSession) -> DataFrame:
    return _inline(spark, fixed_rows(CLADE_STATES), ["clade", "low", "high"]).selectExpr(
        "clade", "CAST(low AS INT) AS low", "CAST(high AS INT) AS high"
    )


def codon_table() -> dict[str, str]:
    b = CODON_BASES
    codons = [x + y + z for x in b for y in b for z in b]
    return dict(zip(codons, CODON_PEPTIDES))
