"""Alphabets, genetic codes, model list and parameter counts, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: alphabets, gap marks, bounds and start values -------------
RY = "RY"
DNA = "ACGT"
RNA = "ACGU"
AA = "ARNDCQEGHILKMFPSTWYV"
RY2 = ["RR", "RY", "YY", "YR"]
GAPS = "-X.?"
MIN_DATA = 0.15
MIN_PROB = 1e-3
MIN_OMEGA, START_OMEGA, START_KAPPA = 0.05, 0.4, 2.5
MAX_BRANCH, SHORT_BRANCH = 10.0, 5e-5
MIN_ALPHA, MAX_ALPHA, START_ALPHA = 0.05, 100.0, 0.25
MAX_PARAMETER = 100.0
START_INVARIANT, START_GARBAGE = 0.2, 0.1
OMEGA_STARTS = [0.05, 0.1, 0.2, 0.4, 0.75]

# Standard code over ACGT x ACGT x ACGT, * = stop; other codes as changes to it.
STANDARD_CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
CODE_CHANGES = {
    0: {},
    1: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTA": "T", "CTC": "T", "CTG": "T", "CTT": "T"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    7: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    8: {"TGA": "C"},
    9: {"CTG": "S"},
    10: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    11: {"TAG": "Q"},
}
# What each row of the table above really is.
CODE_NAMES = {
    0: "Universal",
    1: "Vertebrate mt",
    2: "Vertebrate mt",
    3: "Yeast mt",
    4: "Mould mt",
    5: "Invertebrate mt",
    6: "Ciliate nuclear",
    7: "Echinoderm mt",
    8: "Euplotid nuclear",
    9: "Alternative yeast nuclear",
    10: "Ascidian mt",
    11: "Blepharisma nuclear",
}

NT_MODELS = ["JC", "FEL", "K2P", "HKY", "REV"]
AA_MODELS = [
    "EQU", "BLOSUM62", "DAY", "HIVb", "HIVw", "JTT", "LG", "VT", "WAG",
    "cpREV", "mtArt", "mtMam", "mtREV", "rtREV",
]
CODON_MODELS = {"EQU": "F0", "F1X4": "F1X4", "F3X4": "F3X4", "F64": "F64"}

# Free parameters counted without the gamma shape.
NT_K = {"JC": 0, "FEL": 3, "K2P": 1, "HKY": 4, "REV": 8}
CODON_K = {"EQU": 2, "F1X4": 6, "F3X4": 11}
# ---- end of fixed values -----------------------------------------------------

CODONS = [a + b + c for a in DNA for b in DNA for c in DNA]


def code_rows(codes=range(12)):
    for code in codes:
        for idx, codon in enumerate(CODONS):
            letter = CODE_CHANGES[code].get(codon, STANDARD_CODE[idx])
            yield code, codon, idx, (None if letter == "*" else AA.index(letter)), (
                None if letter == "*" else letter
            )


def sense_codons(code: int) -> list[str]:
    return [codon for _, codon, _, aa, _ in code_rows([code]) if aa is not None]


def genetic_code(spark: SparkSession, codes=range(12)) -> DataFrame:
    """code, codon, codon_idx, aa (index, NULL = stop), aa_ch and sense (index among sense codons)."""
    rows = []
    for code in codes:
        k = 0
        for r in code_rows([code]):
            rows.append(r + ((k if r[3] is not None else None),))
            k += r[3] is not None
    return F.broadcast(
        spark.createDataFrame(rows, "code int, codon string, codon_idx int, aa int, aa_ch string, sense int")
    )


def alphabet(data_type: str) -> list[str]:
    if data_type == "RNASTEM":
        return [a + b for a in RNA for b in RNA]
    if data_type == "COD":
        return CODONS
    if data_type == "COD_RED":
        return sense_codons(0)
    single = {"RY": RY, "DNA": DNA, "RNA": RNA, "AA": AA, "GAP": GAPS}
    if data_type in single:
        return list(single[data_type])
    if data_type == "RY2":
        return RY2
    base = single[data_type[:-1]]
    return [a + b for a in base for b in base]


DATA_TYPES = ["RY", "RY2", "DNA", "DNA2", "AA", "AA2", "COD", "COD_RED", "RNA", "RNASTEM", "GAP"]


def states(spark: SparkSession, data_types=DATA_TYPES) -> DataFrame:
    rows = [(t, i, s) for t in data_types for i, s in enumerate(alphabet(t))]
    return F.broadcast(spark.createDataFrame(rows, "data_type string, idx int, symbol string"))


def model_rows(code: int = 0) -> list[tuple]:
    """One row per model and rate form: data type, equilibrium form, k, switch section and name."""
    n_sense = len(sense_codons(code))
    df = n_sense - 20
    rows = []

    def add(name, data_type, core, eqm, k, section, switch):
        for gamma in (False, True):
            rows.append((len(rows), name + ("+4dG" if gamma else ""), data_type, core, eqm, gamma,
                         k + gamma, section, switch))

    add("RY", "RY", "RY", "OBS", 3, None, None)
    for m in NT_MODELS:
        add(m, "DNA", m, "EQU" if m in ("JC", "K2P") else "OBS", NT_K[m], None, None)
    for m in AA_MODELS:
        add(m, "AA", m, "EQU" if m == "EQU" else "MODEL", df, "amino acid", m.lower())
        add(m + "+F", "AA", m, "OBS", 19 + df, "amino acid", m.lower())
    for eqm, switch in CODON_MODELS.items():
        add(f"CodonM0.{code}.{eqm}", "CodonReduced", "M0", eqm, CODON_K.get(eqm, 2 + n_sense),
            "codon", switch.lower())
    return rows


MODEL_FIELDS = ["model_no", "name", "data_type", "core", "eqm", "gamma", "k", "section", "switch"]


def model_array(code: int = 0):
    """The catalogue as one array literal, to expand a row per alignment without a join."""
    types = ["int", "string", "string", "string", "string", "boolean", "int", "string", "string"]

    def cell(v, t):
        text = "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()
        return f"cast({text} as {t})"

    rows = [
        "named_struct(" + ",".join(f"'{n}',{cell(v, t)}" for n, v, t in zip(MODEL_FIELDS, row, types)) + ")"
        for row in model_rows(code)
    ]
    return F.expr("array(" + ",".join(rows) + ")")
