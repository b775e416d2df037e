"""Bootstrap of alignment columns by integer arithmetic, repeatable on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligngrid.session import cut, spread

#: Sites of a partition; each is drawn once in every replicate.
COLUMNS = 1 << 14
#: Drawn columns of a partition.
DRAWS = 1 << 16
#: Cells of an alignment that a row holds.
HELD = 1 << 16
DIGITS = 15  # hexadecimal digits of a draw: 60 bits, so the remainder is even over any alignment


def draws(columns: DataFrame, n_rep: int, seed: int = 12345) -> DataFrame:
    """family, rep, draw, pos: for each of the N sites of an alignment, the site drawn in its place.

    columns: family, pos with pos = 0..N-1; other positions raise. Rows are made in place; only N is looked up. A
    draw is a digest of family, replicate, draw and seed, so replicates are independent at any length.
    """
    dense = (F.min("pos") == 0) & (F.max("pos") + 1 == F.count("*"))
    sizes = columns.groupBy("family").agg(F.when(dense, F.count("*")).otherwise(
        F.raise_error(F.lit("positions must run from 0 without gaps")).cast("bigint")).alias("n"))
    rows = columns.select("family", F.col("pos").cast("bigint").alias("draw")).join(sizes, "family").select(
        "family", "draw", "n", F.explode(F.array(*[F.lit(r).cast("bigint") for r in range(n_rep)])).alias("rep"))
    return rows.select("family", "rep", "draw", _drawn("family", "rep", "draw", "n", seed).alias("pos"))


def _drawn(family, rep, draw, n, seed: int):
    """The site that is drawn: columns or their names in, a column out."""
    family, rep, draw, n = (F.col(c) if isinstance(c, str) else c for c in (family, rep, draw, n))
    text = F.concat_ws("-", family.cast("string"), rep.cast("string"), draw.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint") % n


def bootstrap(site_pattern: DataFrame, n_rep: int, seed: int = 12345) -> DataFrame:
    """family, rep, pattern_id, n, n_original. site_pattern: family, pos, pattern_id."""
    site_pattern = spread(site_pattern, COLUMNS, "family")
    original = site_pattern.groupBy("family", "pattern_id").agg(F.count("*").alias("n_original"))
    # how often a site was drawn, then per pattern: both aggregates are partial before the shuffle
    hit = draws(site_pattern.select("family", "pos"), n_rep, seed).groupBy("family", "rep", "pos").agg(F.count("*").alias("c"))
    return hit.join(site_pattern, ["family", "pos"]).groupBy("family", "rep", "pattern_id").agg(
        F.sum("c").alias("n")).join(original, ["family", "pattern_id"])


def bootstrap_cells(cells: DataFrame, n_rep: int, seed: int = 12345) -> DataFrame:
    """family, rep, seq_id, pos, state: whole resampled alignments. cells: family, seq_id, pos, state, best cut, as they are read twice.

    Alignments of at most HELD cells are dealt out once, by family, and their replicates are made where they lie, so what follows by
    family and replicate needs no shuffle either. Of larger ones a column travels as one row with its cells, to the partition of its
    replicate, and is taken apart there.
    """
    sizes = cells.filter("family is not null").groupBy("family").agg(F.count("*").alias("cells"), F.countDistinct("pos").alias("n"))
    n_cols, largest = sizes.agg(F.sum("n"), F.max("cells")).head()
    if (largest or 0) <= HELD:
        return _made_in_place(cells, n_cols or 0, n_rep, seed)
    sizes = cut(sizes)
    small = cells.join(sizes.filter(F.col("cells") <= HELD), "family", "left_semi")
    large = cells.join(sizes.filter(F.col("cells") > HELD), "family", "left_semi")
    return _made_in_place(small, n_cols, n_rep, seed).unionByName(_made_by_columns(large, n_rep, seed))


def _columns_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy("family", "pos").agg(F.collect_list(F.struct("seq_id", "state")).alias("z"))


def _made_in_place(cells: DataFrame, n_cols: int, n_rep: int, seed: int) -> DataFrame:
    """`bootstrap_cells` of alignments that a row holds."""
    dealt = cells.filter("family is not null").repartition(max(1, math.ceil(n_cols * n_rep / DRAWS)), "family")
    whole = _columns_of(dealt).groupBy("family").agg(F.sort_array(F.collect_list(F.struct("pos", "z"))).alias("c"))
    dense = (F.get("c.pos", F.lit(0)) == 0) & (F.element_at("c.pos", -1) + 1 == F.size("c"))
    n = F.when(dense, F.size("c").cast("bigint")).otherwise(
        F.raise_error(F.lit("positions must run from 0 without gaps")).cast("bigint"))
    rows = whole.select("family", "c", n.alias("n"), F.explode(F.array(*[F.lit(r).cast("bigint") for r in range(n_rep)])).alias("rep"))
    drawn = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1),
                        lambda k: F.get("c.z", _drawn("family", "rep", k, "n", seed).cast("int")))
    return rows.select("family", "rep", F.posexplode(drawn).alias("draw", "z")).select(
        "family", "rep", F.col("draw").cast("bigint").alias("pos"), F.inline("z")).select("family", "rep", "seq_id", "pos", "state")


def _made_by_columns(cells: DataFrame, n_rep: int, seed: int) -> DataFrame:
    cols = cut(_columns_of(cells))
    n_cols = cols.count()
    d = draws(spread(cols.select("family", "pos"), COLUMNS, "family"), n_rep, seed)
    drawn = d.join(cols, ["family", "pos"]).select("family", "rep", "draw", "z").repartition(
        max(1, math.ceil(n_cols * n_rep / DRAWS)), "family", "rep")
    return drawn.select("family", "rep", F.col("draw").alias("pos"), F.inline("z")).select(
        "family", "rep", "seq_id", "pos", "state")
