"""Several alignments of one study."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(genes: DataFrame) -> DataFrame:
    """manifest, n_genes, max_seq, max_site. genes: manifest, gene, n_seq, n_site."""
    return genes.groupBy("manifest").agg(
        F.count("*").alias("n_genes"), F.max("n_seq").alias("max_seq"), F.max("n_site").alias("max_site"))


def gene_pairs(genes: DataFrame, tree) -> DataFrame:
    """a, b: tree keys of each pair of genes of one manifest. The matrix of a study is the answer wanted,
    and a study lists its genes in one file."""
    a = genes.select("manifest", F.col("gene").alias("g1"), tree.alias("a"))
    b = genes.select("manifest", F.col("gene").alias("g2"), tree.alias("b"))
    return a.join(b, "manifest").filter("g1 < g2")
