"""Alignment files and manifests in, alignment text out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aligngrid.functions import scalar as S
from aligngrid.operators.recode import listagg
from aligngrid.sources.lines import read_lines


def parse_alignments(lines: DataFrame) -> DataFrame:
    """path, idx, line -> path, seq_id, name, seq, n_seq, n_site (line 0 is the header 'n m').

    Three layouts: name and sequence on one line; the same interleaved, names in the first
    block only; the name on a line of its own. Which one follows from the first line after
    the header. Sequences of another length than the header says raise an error.
    """
    head = lines.filter("idx = 0").select(
        "path", F.split(F.trim("line"), r"\s+").alias("h")).select(
        "path", F.col("h")[0].cast("bigint").alias("n_seq"), F.col("h")[1].cast("bigint").alias("n_site"))
    facts = lines.filter("idx > 0").groupBy("path").agg(
        F.count("*").alias("n_line"), F.min_by("line", "idx").alias("first")).select(
        "path", "n_line", (F.size(S.tokens("first")) > 1).alias("inline"))
    body = lines.filter("idx > 0").join(head.join(facts, "path"), "path")
    b = F.col("idx") - 1
    per = F.greatest(F.lit(1), F.expr("n_line div n_seq"))
    body = body.withColumn("seq_id", F.when(F.col("inline"), b % F.col("n_seq")).otherwise(F.floor(b / per))).withColumn(
        "part", F.when(F.col("inline"), F.floor(b / F.col("n_seq"))).otherwise(b % per))
    first_word = F.regexp_extract(F.trim("line"), r"^(\S+)", 1)
    name = F.when(F.col("part") == 0, first_word)
    text = F.when(F.col("part") > 0, F.col("line")).when(
        F.col("inline"), F.regexp_replace(F.trim("line"), r"^\S+", "")).otherwise(F.lit(""))
    cells = body.select("path", "n_seq", "n_site", "seq_id", "part", name.alias("name"), F.upper(S.strip_white(text)).alias("piece"))
    out = cells.groupBy("path", "n_seq", "n_site", "seq_id").agg(F.max("name").alias("name"), listagg("piece", "part").alias("seq"))
    bad = F.concat(F.lit("wrong sequence length in "), "path", F.lit(": "), "name")
    return out.withColumn("seq", F.when(F.length("seq") == F.col("n_site"), F.col("seq")).otherwise(F.raise_error(bad)))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """A directory of alignments, one per file; `family` is the file path."""
    return parse_alignments(read_lines(spark, path)).withColumnRenamed("path", "family")


def data_type(seqs: DataFrame, keys=("family",)) -> DataFrame:
    """Guessed type of an alignment: DNA or AA by the scores of all its text, NONE if neither."""
    kept = F.translate("seq", "Nn", "")
    sums = seqs.groupBy(*keys).agg(
        F.sum(F.length(kept)).alias("n"), F.sum(S.count_in(kept, "ACGT")).alias("dna"),
        F.sum(S.count_in(kept, "ARNDCQEGHILKMFPSTWYV")).alias("aa"))
    dna, aa = F.col("dna") / F.col("n"), F.col("aa") / F.col("n")
    return sums.select(*keys, F.when(F.col("n") == 0, "NONE").when((dna * 1.1 > aa) & (dna > 0.15), "DNA").when(
        (aa > 0.15) & (aa > dna), "AA").otherwise("NONE").alias("data_type"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """manifest, gene_no, gene: first line holds MULTIGENE, '#' lines are skipped, one path a line."""
    lines = read_lines(spark, path)
    heads = lines.filter("idx = 0").select("path", F.contains("line", F.lit("MULTIGENE")).alias("ok"))
    rows = lines.filter("idx > 0 and not startswith(line, '#')").join(heads, "path")
    gene = F.when(~F.col("ok"), F.raise_error(F.concat(F.lit("no MULTIGENE line in "), "path"))).when(
        F.size(S.tokens("line")) > 1, F.raise_error(F.concat(F.lit("more than one word on a line of "), "path"))
    ).otherwise(F.trim("line"))
    w = Window.partitionBy("path").orderBy("idx")  # a manifest lists files
    return rows.select(F.col("path").alias("manifest"), (F.row_number().over(w) - 1).alias("gene_no"), gene.alias("gene"))


def manifest_types(manifest: DataFrame, types: DataFrame) -> DataFrame:
    """manifest, n_genes, one_type. types: gene, data_type."""
    return manifest.join(types, "gene").groupBy("manifest").agg(
        F.count("*").alias("n_genes"), (F.count_distinct("data_type") == 1).alias("one_type"))


def sequential_lines(seqs: DataFrame) -> DataFrame:
    """family, ord, line: header 'n  m', then 'name <tab>sequence' with blank lines between."""
    sizes = seqs.groupBy("family").agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("m"))
    head = sizes.select("family", F.lit(-1).cast("bigint").alias("ord"), F.concat(
        F.col("n").cast("string"), F.lit("  "), F.col("m").cast("string"), F.lit("\n")).alias("line"))
    return head.unionByName(seqs.select("family", F.col("seq_id").alias("ord"), F.concat("name", F.lit(" \t"), "seq", F.lit("\n")).alias("line")))


def write_sequential(seqs: DataFrame, path: str) -> None:
    """One folder per family, one sequential file in each; refuses to overwrite."""
    sequential_lines(seqs).repartition("family").sortWithinPartitions("family", "ord").select("family", "line").write.partitionBy(
        "family").mode("errorifexists").text(path)
