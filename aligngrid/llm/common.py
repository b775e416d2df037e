"""Helpers of the operators: reading, text blocks for Python tasks, words of many texts, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligngrid.session import cut, ship, store  # noqa: F401

#: A word is a run of anything but ASCII white space (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS, _ARROW = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a few numbers that may be sent to every task.
SENT_ROWS = 300_000
#: Bytes of text that one numpy block holds; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterable[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold about `size` bytes of the column `text` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(pc.binary_length(col.cast(pa.binary())).fill_null(0), dtype=np.int64)
        block_of = np.cumsum(lengths) // size
        starts = np.flatnonzero(np.diff(block_of, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of the word at each place of the joined texts, and the words of each text."""
    split = [t.split() for t in texts]  # bytes.split() cuts at ASCII white space only
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for ws in split for w in ws]
    ids = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    return list(ids), np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat)), counts


def python_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """`mapInArrow` with this package on the workers.

    Rows hold whole texts, so unless the session has its own setting, batches are of ARROW_ROWS rows and not of Spark's 10,000.
    """
    ship(df.sparkSession)
    if df.sparkSession.conf.get(_ARROW, "10000") == "10000":
        df.sparkSession.conf.set(_ARROW, str(ARROW_ROWS))
    return df.mapInArrow(fn, schema)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that `df` does not have (names are told apart without their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A written or checkpointed table of numbers, to be sent to every task if it has at most `rows` rows; larger ones are joined
    by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a long, b long): (node, root), root the least node of the component.

    Star contraction: each round every node links its larger neighbours to its least one, then its smaller ones, until
    no edge changes; a chain of n nodes takes about log n rounds. A node with very many neighbours is only grouped by
    `min`, which combines before the shuffle, and joined (skewed joins are split by Spark), never collected.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(bounded(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        if least.where("n > 1").isEmpty():  # every node hangs on one smaller node
            down = least.select(F.col("u").alias("m"), F.col("m").alias("lower"))
            if least.join(bounded(down.select("m")), "m", "left_semi").isEmpty():
                return least.select(F.col("u").alias("node"), F.col("m").alias("root")).union(
                    least.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
        small = large.join(bounded(least), "u")
        e = cut(small.select("u", F.col("m").alias("v"))
                .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components still change after {max_rounds} rounds")
