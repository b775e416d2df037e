"""Cleaning and filtering of alignments in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.functions import scalar as S
from aligngrid.operators import recode


def clean_codons(codons: DataFrame, code: int = 0) -> DataFrame:
    """A codon with any other letter than ACGT, or a stop, becomes '---'."""
    return recode.with_code(codons, code).withColumn(
        "codon", F.when(F.col("aa").isNull(), "---").otherwise(F.col("codon"))
    )


def dense_sequences(sites: DataFrame, share: float = catalog.MIN_DATA) -> DataFrame:
    """family, seq_id of sequences with at least `share` real data."""
    real = F.avg(F.when(S.is_gap("ch"), 0.0).otherwise(1.0))
    return sites.groupBy("family", "seq_id").agg(real.alias("real")).filter(F.col("real") >= share).drop("real")


def remove_sparse(sites: DataFrame, share: float = catalog.MIN_DATA) -> DataFrame:
    return sites.join(dense_sequences(sites, share), ["family", "seq_id"], "left_semi")


def clean(sites: DataFrame, code: int = 0, share: float = catalog.MIN_DATA) -> DataFrame:
    """Codons cleaned and sparse sequences removed: family, seq_id, cpos, codon, aa, aa_ch, sense.

    The share of real data is counted on whole codons, so one pass over codons does both.
    """
    return clean_made(recode.make_codons(sites), code, share)


def clean_made(codons: DataFrame, code: int = 0, share: float = catalog.MIN_DATA, in_place: bool = False) -> DataFrame:
    """`clean` of codons (family, seq_id, cpos, codon) that are cut already, as by `recode.codons_of`.

    in_place: a partition holds its families whole and their sequences are short, so that they are judged where they are.
    """
    codons = clean_codons(codons, code)
    real = F.avg(F.when(F.col("codon") == "---", 0.0).otherwise(1.0))
    if in_place:
        own = codons.filter("family is not null and seq_id is not null").withColumn(
            "real", real.over(Window.partitionBy("family", "seq_id")))
        return own.filter(F.col("real") >= share).select("family", "seq_id", *[c for c in codons.columns if c not in ("family", "seq_id")])
    keep = codons.groupBy("family", "seq_id").agg(real.alias("real")).filter(F.col("real") >= share)
    return codons.join(keep, ["family", "seq_id"], "left_semi")


def _columns(sites: DataFrame, having) -> DataFrame:
    """Columns that pass an aggregate test; min and max are enough, no set is built."""
    return sites.groupBy("family", "pos").agg(having.alias("ok")).filter("ok").select("family", "pos")


def _real(ch="ch"):
    return F.when(~S.is_gap(ch), F.col(ch))


def remove_all_gap(sites: DataFrame) -> DataFrame:
    """Drop all-gap columns and close the ranks."""
    keep = recode.dense_positions(_columns(sites, F.max(_real()).isNotNull()))
    return sites.join(keep, ["family", "pos"]).select("family", "seq_id", F.col("new_pos").alias("pos"), "ch")


def remove_invariant(sites: DataFrame) -> DataFrame:
    """Drop columns with at most one state and close the ranks."""
    varies = F.coalesce(F.min(_real()) < F.max(_real()), F.lit(False))
    keep = recode.dense_positions(_columns(sites, varies))
    return sites.join(keep, ["family", "pos"]).select("family", "seq_id", F.col("new_pos").alias("pos"), "ch")


def no_change(patterns: DataFrame, alphabet: str = catalog.DNA) -> DataFrame:
    """Per pattern: the sole state, or -1. Letters are tested on the pattern text, no explode."""
    hits = [F.when(F.instr("pattern", c) > 0, F.lit(i)) for i, c in enumerate(alphabet)]
    found = F.array_compact(F.array(*hits))
    return patterns.withColumn(
        "no_change", F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise(F.lit(-1))
    )


def gap_mask(sites: DataFrame) -> DataFrame:
    return sites.select("family", "seq_id", "pos", S.is_gap("ch").alias("is_gap"))


def apply_gap_mask(sites: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells that are gaps in the mask become gaps here."""
    return sites.join(mask, ["family", "seq_id", "pos"], "left").select(
        "family", "seq_id", "pos",
        F.when(F.coalesce("is_gap", F.lit(False)), "-").otherwise(F.col("ch")).alias("ch"),
    )


def parsimony_mask(patterns: DataFrame, alphabet: str = catalog.DNA) -> DataFrame:
    """Variable patterns get weight n, the others 0."""
    kinds = sum((F.when(F.instr("pattern", c) > 0, 1).otherwise(0) for c in alphabet), F.lit(0))
    return patterns.withColumn("weight", F.when(kinds > 1, F.col("n")).otherwise(F.lit(0).cast("bigint")))
