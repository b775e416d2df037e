"""Column functions on residues, codons, texts and model names. All but the counts of letters in whole texts run inside codegen."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from aligngrid import catalog


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_gap(ch) -> Column:
    return _col(ch).isin(*catalog.GAPS)


def to_ry(ch) -> Column:
    return F.translate(_col(ch), "AGCT", "RRYY")


def state_index(ch, alphabet: str) -> Column:
    """0-based index in a one-character alphabet; NULL for gaps and anything else."""
    at = F.instr(F.lit(alphabet), _col(ch))
    return F.when(at > 0, at - 1)


def is_transition(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.concat(F.least(a, b), F.greatest(a, b)).isin("AG", "CT")


def _base(codon, k) -> Column:
    return F.substring(_col(codon), k + 1, 1)


def codon_diff(c1, c2) -> Column:
    return sum(
        (F.when(_base(c1, k) != _base(c2, k), 1).otherwise(0) for k in range(3)), F.lit(0)
    )


def codon_transition(c1, c2) -> Column:
    """One differing position, and it is a transition."""
    some = F.lit(False)
    for k in range(3):
        some = some | is_transition(_base(c1, k), _base(c2, k))
    return (codon_diff(c1, c2) == 1) & some


def count_in(text, letters: str) -> Column:
    """How many characters of `text` belong to `letters` (either case)."""
    text = _col(text)
    both = letters.upper() + letters.lower()
    return F.length(text) - F.length(F.translate(text, both, ""))


@lru_cache(None)
def _letter_counts(alphabet: str):
    """Column function: n (characters but N) and k (those of the alphabet, either case, but N) of a text. The bytes of a batch are
    classed through one table; a letter costs no look-up of its own."""
    table = np.zeros(256, np.uint8)
    table[:128], table[192:] = 1, 1  # first bytes of a character
    for c in alphabet.upper() + alphabet.lower():
        table[ord(c)] = 3
    for c in "Nn":
        table[ord(c)] = 0

    @F.arrow_udf("struct<n: bigint, k: bigint>")
    def counts(text: pa.Array) -> pa.Array:
        at = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)
        at = at[text.offset:text.offset + len(text) + 1].astype(np.int64)
        held = text.buffers()[2]
        found = np.zeros(at[-1] - at[0] + 1, np.uint8)  # one more, so that a last text without bytes has a place
        if held is not None:
            found[:-1] = table[np.frombuffer(held, np.uint8)[at[0]:at[-1]]]
        some, start = at[1:] > at[:-1], at[:-1] - at[0]
        out = [np.where(some, np.add.reduceat(bit, start, dtype=np.int64), 0) for bit in (found & 1, found >> 1)] if len(text) else [
            np.zeros(0, np.int64)] * 2
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "k"])

    return counts


def type_score(text, alphabet: str) -> Column:
    """Share of characters, N left out, that belong to the alphabet; -1 when none is left."""
    found = _letter_counts(alphabet)(_col(text))
    return F.when(found["n"] > 0, found["k"] / found["n"]).otherwise(F.lit(-1.0))


def guess_type(text) -> Column:
    dna, aa = type_score(text, catalog.DNA), type_score(text, catalog.AA)
    return (
        F.when(dna < 0, "NONE")
        .when((dna * 1.1 > aa) & (dna > catalog.MIN_DATA), "DNA")
        .when((aa > catalog.MIN_DATA) & (aa > dna), "AA")
        .otherwise("NONE")
    )


def valid_type(text, alphabet: str, allow_gaps: bool = False) -> Column:
    letters = alphabet + (catalog.GAPS if allow_gaps else "")
    return count_in(text, letters) >= F.length(_col(text))


def strip_white(text) -> Column:
    return F.translate(_col(text), " \t\n\r\f\v", "")


def tokens(text, delim: str = " \t\n\r\f\v") -> Column:
    return F.filter(F.split(F.translate(_col(text), delim, delim[0] * len(delim)), delim[0]), lambda t: t != "")


def wildcard(text, pattern: str) -> Column:
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return _col(text).like(like.replace("*", "%").replace("?", "_"))


def normalise(x, total, n, to: float = 1.0) -> Column:
    """Scale a value so that its vector (sum `total`, length `n`) adds to `to`."""
    return F.when(_col(total) > 0, _col(x) * to / _col(total)).otherwise(F.lit(1.0) / _col(n))


def model_name_parts(name) -> dict[str, Column]:
    """core, plus_f, invariant, garbage, gamma categories, tree_hmm, code, eqm and what is left over."""
    name = _col(name)
    gamma = F.regexp_extract(name, r"\+(\d*)dG", 1)
    has_gamma = name.rlike(r"\+\d*dG")
    n_cat = F.when(~has_gamma, 0).when(gamma == "", 4).otherwise(F.coalesce(gamma.try_cast("int"), F.lit(0)))
    bare = F.regexp_replace(name, r"\+(\d*dG|I|gC|F|TreeHMM)(?=\+|$)", "")
    core = F.regexp_extract(bare, r"^([A-Za-z0-9]+)", 1)
    codon = F.regexp_extract(bare, r"^[A-Za-z0-9]+\.(\d+)\.(EQU|F1X4|F3X4|F64)$", 1)
    rest = F.regexp_replace(bare, r"^[A-Za-z0-9]+(\.\d+\.(EQU|F1X4|F3X4|F64))?$", "")
    return {
        "core": core,
        "plus_f": name.rlike(r"\+F(\+|$)"),
        "invariant": name.rlike(r"\+I(\+|$)"),
        "garbage": name.rlike(r"\+gC(\+|$)"),
        "tree_hmm": name.rlike(r"\+TreeHMM(\+|$)"),
        "n_cat": n_cat,
        "code": F.when(codon != "", codon.cast("int")),
        "eqm": F.nullif(F.regexp_extract(bare, r"\.(EQU|F1X4|F3X4|F64)$", 1), F.lit("")),
        "valid": (rest == "") & (~has_gamma | n_cat.between(2, 10))
        & (F.coalesce(codon.try_cast("int"), F.lit(0)) <= 11),
    }
