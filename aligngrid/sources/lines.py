"""Text files as numbered lines, without reading a file as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, idx, line: non-blank lines of every file, numbered from 0 in file order.

    A file is read in splits. Lines are numbered inside a split (rows of a split keep
    their order), and splits are shifted by the counts before them, so a huge file is
    never sorted by one task.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.rtrim(F.translate("value", "\r", "")).alias("line"))
    rows = raw.filter("trim(line) <> ''")
    inside = rows.withColumn("at", F.row_number().over(Window.partitionBy("path", "block").orderBy("id")) - 1)
    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("path", "block").count().select(
        "path", "block", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    return inside.join(shift, ["path", "block"]).select("path", (F.col("before") + F.col("at")).alias("idx"), "line")


#: Ends a file in a bundle; not allowed inside one.
END_OF_FILE = "\x1e"


def write_bundles(files: DataFrame, path: str) -> None:
    """Write small files (path, text), as many to a bundle as `files` has rows in a partition: very many files of their own cost a
    round with the store each. In a bundle a file is its path, a line feed, its text and END_OF_FILE."""
    files.select(F.concat("path", F.lit("\n"), "text")).write.option("lineSep", END_OF_FILE).text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file in the bundles below `path`."""
    raw = spark.read.option("lineSep", END_OF_FILE).option("recursiveFileLookup", True).text(path)
    return raw.select(F.substring_index("value", "\n", 1).alias("path"), F.expr("substring(value, instr(value, '\n') + 1)").alias("text"))


def lines_of(files: DataFrame) -> DataFrame:
    """path, idx, line of small files (path, text), numbered as by `read_lines`."""
    bare = F.transform(F.split("text", "\n"), lambda x: F.rtrim(F.translate(x, "\r", "")))
    return files.select("path", F.posexplode(F.filter(bare, lambda x: F.trim(x) != "")).alias("idx", "line")).select(
        "path", F.col("idx").cast("bigint").alias("idx"), "line")
