"""Alignments, trees and tables derived from the `documents` table.

A document is one sequence of 40 codons. Its words are cut into 40 equal
slices, so every word of the text is used, and the digest of slice c decides
codon c. 16 documents form a family; the family's first document is the
ancestor the others are changed from.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_CODONS = 40
FAMILY = 16
#: Documents of a partition: a document is 120 sites, so a task has a quarter of a million. Of trees a partition holds those of
#: 2,048 families.
DOCUMENTS, TREE_DOCUMENTS = 2048, 1 << 15


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_family(spark: SparkSession, sf_dir: str, rows: DataFrame, most: int) -> DataFrame:
    """Rows of documents dealt out by family, in a partition for every `most` documents there are: what is made of a family later
    is many times as large, and stays where it is."""
    n = documents(spark, sf_dir).count()
    return rows.repartition(max(1, math.ceil(n / most)), "family")


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, seq_id, h: one 32-bit number per slice, NULL where the slice holds no word."""
    d = documents(spark, sf_dir).select("doc_id", F.split("text", " ").alias("w"))
    n = F.size("w")

    def slice_digest(c):
        lo = F.floor(c * n / N_CODONS).cast("int")
        hi = F.floor((c + 1) * n / N_CODONS).cast("int")
        words = F.array_join(F.slice("w", lo + 1, hi - lo), " ")
        return F.when(hi > lo, F.conv(F.substring(F.md5(words), 1, 8), 16, 10).cast("bigint"))

    return d.select(
        F.expr(f"doc_id div {FAMILY}").alias("family"),
        (F.col("doc_id") % FAMILY).alias("seq_id"),
        F.transform(F.sequence(F.lit(0), F.lit(N_CODONS - 1)), slice_digest).alias("h"),
    )


def codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, seq_id, cpos, codon: made in the row of the document, no site rows and no shuffle of them; in partitions by family."""
    h = digests(spark, sf_dir)
    lead = h.filter("seq_id = 0").select("family", F.col("h").alias("lead"))
    # dealt out after the join, which would pick a number of partitions itself
    made = by_family(spark, sf_dir, h.join(lead, "family"), DOCUMENTS).select(
        "family", "seq_id", F.posexplode(F.arrays_zip(F.col("h"), F.col("lead"))).alias("cpos", "z")
    ).select("family", "seq_id", "cpos", F.col("z.h").alias("o"),
             F.coalesce("z.lead", F.lit(0)).alias("a"))

    def base(k):
        r = F.expr(f"(o div {1000 ** k}) % 1000")
        at = (F.expr(f"a div {4 ** k}") + F.when(r < 120, 1 + r % 3).otherwise(0)) % 4
        return (
            F.when(F.col("o").isNull() | (F.col("o") % 101 < 5), "-")
            .when(F.expr(f"(o div 3 + {k * 31}) % 997 = 0"), "N")
            .otherwise(F.substring(F.lit("ACGT"), (at + 1).cast("int"), F.lit(1)))
        )

    return made.select("family", "seq_id", "cpos", F.concat(base(0), base(1), base(2)).alias("codon"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, seq_id, pos, ch in long form."""
    from aligngrid.operators.recode import codon_sites

    return codon_sites(codons(spark, sf_dir))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aligngrid.operators.recode import join_sites

    return join_sites(sites(spark, sf_dir)).select(
        "family", "seq_id", F.concat(F.lit("s"), F.col("seq_id")).alias("name"), "seq"
    )


def family_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select(F.expr(f"doc_id div {FAMILY}").alias("family"))
    return by_family(spark, sf_dir, d, TREE_DOCUMENTS).groupBy("family").agg(F.count("*").alias("n"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two heap-shaped rooted trees a family: tree_id, family, node, parent, length, leaf_seq."""
    n = family_sizes(spark, sf_dir)
    nodes = n.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("tree_id"),
        "family", "n",
    ).select("tree_id", "family", "n", F.explode(F.expr("sequence(1, 2 * n - 2)")).alias("node"))
    leaf = F.col("node") - (F.col("n") - 1)
    return nodes.select(
        "tree_id", "family",
        F.col("node").cast("bigint").alias("node"),
        F.expr("(node - 1) div 2").alias("parent"),
        (((F.col("node") * 37 + F.col("family") * 11) % 90 + 10) / 1000.0).alias("length"),
        F.when(leaf >= 0, (leaf + 2 * F.col("tree_id")) % F.col("n")).alias("leaf_seq"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer scores with ties, one per tree branch."""
    return edges(spark, sf_dir).select(
        "tree_id", "family", "node", ((F.col("node") * 53 + F.col("family")) % 17).alias("score")
    )


def radical(spark: SparkSession) -> DataFrame:
    """0/1 class of each amino-acid pair, symmetric."""
    rows = [
        (a, b, (max(a, b) * 7 + min(a, b) * 3) % 2) for a in range(20) for b in range(20) if a != b
    ]
    return F.broadcast(spark.createDataFrame(rows, "aa1 int, aa2 int, kind int"))
