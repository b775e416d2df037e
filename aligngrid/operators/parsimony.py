"""Fitch parsimony, 64 sites to a row.

Each leaf carries one bit mask per state for a block of 64 sites; and and or of the children's masks are the Fitch
intersection and union for 64 sites at once. A row is a tree and the masks of some blocks, worked on in one pass. Trees of more
than `SMALL_NODES` nodes go level by level: a level joins children to parents, and only masks whose parent is still to come are
carried on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aligngrid import catalog
from aligngrid.operators import treekit
from aligngrid.operators.trees import _by_size, _tree_keys, _tree_rows, closure
from aligngrid.session import cut

#: Nodes of a tree that a task holds whole, and blocks of 64 sites that go with it.
SMALL_NODES, BLOCKS = 20_000, 64
_CHANGES = T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("block", T.LongType()),
                                     T.StructField("chg", T.LongType())]))


def heights(edges: DataFrame, clos: DataFrame) -> DataFrame:
    """keys, node, height above the leaves, for inner nodes."""
    keys = _tree_keys(edges)
    return clos.filter("leaf_seq is not null and hops > 0").groupBy(*keys, F.col("anc").alias("node")).agg(
        F.max("hops").alias("height"))


def _masks(sites: DataFrame, alphabet: str) -> DataFrame:
    """family, leaf_seq, block, one mask per state; a gap belongs to every state."""
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    gap = F.instr(F.lit(alphabet), F.col("ch")) == 0
    return sites.groupBy("family", F.col("seq_id").alias("leaf_seq"), F.expr("pos div 64").alias("block")).agg(
        *[F.coalesce(F.bit_or(F.when((F.col("ch") == c) | gap, bit)), F.lit(0).cast("bigint")).alias(f"m_{c}") for c in alphabet],
        F.bit_or(bit).alias("e"))


def changes(sites: DataFrame, edges: DataFrame, clos: DataFrame | None = None, alphabet: str = catalog.DNA) -> DataFrame:
    """keys, node, block, chg: sites of the block that change at the node. Trees must be binary."""
    keys = _tree_keys(edges)
    ms = [f"m_{c}" for c in alphabet]
    masks = _masks(sites, alphabet)
    small, large = _by_size(edges, keys, F.count(F.lit(1)), SMALL_NODES)

    @F.pandas_udf(_CHANGES)
    def counted(node: pd.Series, parent: pd.Series, leaf: pd.Series, who: pd.Series, block: pd.Series, e: pd.Series,
                *m: pd.Series) -> pd.Series:
        none = lambda t: None if t is None or t != t else int(t)
        return pd.Series([
            [dict(zip(("node", "block", "chg"), x)) for x in treekit.fitch(n, p, [none(t) for t in lf], w, b, states, s)]
            for n, p, lf, w, b, s, *states in zip(node, parent, leaf, who, block, e, *m)])

    held = masks.groupBy("family", F.expr(f"block div {BLOCKS}").alias("part")).agg(
        F.collect_list(F.struct("leaf_seq", "block", "e", *ms)).alias("x"))
    rows = _tree_rows(small, keys).join(held, "family").repartition(*keys, "part")
    out = rows.select(*keys, F.inline(counted("z.node", "z.parent", "z.leaf_seq", "x.leaf_seq", "x.block", "x.e", *[f"x.{m}" for m in ms])))
    if large is not None:
        out = out.unionByName(_changes_by_level(masks, large, closure(large) if clos is None else clos, ms))
    return out


def _changes_by_level(masks: DataFrame, edges: DataFrame, clos: DataFrame, ms: list[str]) -> DataFrame:
    keys = _tree_keys(edges)
    h = heights(edges, clos)
    e = cut(edges.join(h.select(*keys, F.col("node").alias("parent"), F.col("height").alias("due")), [*keys, "parent"]).select(
        *keys, "node", "parent", "leaf_seq", "due"))
    top = h.agg(F.max("height")).head()[0] or 0
    cols = [*keys, "parent", "due", "block", *ms, "e"]
    tips = cut(e.filter("leaf_seq is not null").join(masks, ["family", "leaf_seq"]).select(*cols))
    inner, open_, out = e.filter("leaf_seq is null").select(*keys, "node", "parent", "due"), None, None
    for level in range(1, top + 1):
        kids = tips.filter(F.col("due") == level)
        if open_ is not None:
            kids = kids.unionByName(open_.filter(F.col("due") == level))
        up = kids.groupBy(*keys, F.col("parent").alias("node"), "block").agg(
            *[F.bit_and(m).alias("i" + m) for m in ms], *[F.bit_or(m).alias("u" + m) for m in ms], F.bit_or("e").alias("e"))
        some = F.col("i" + ms[0])
        for m in ms[1:]:
            some = some.bitwiseOR(F.col("i" + m))
        up = cut(up.select(
            *keys, "node", "block", F.bitwise_not(some).bitwiseAND(F.col("e")).alias("chg"), "e",
            *[F.col("i" + m).bitwiseOR(F.bitwise_not(some).bitwiseAND(F.col("u" + m))).alias(m) for m in ms]))
        out = up.select(*keys, "node", "block", "chg") if out is None else out.unionByName(up.select(*keys, "node", "block", "chg"))
        waiting = up.join(inner, [*keys, "node"]).select(*cols)
        open_ = cut(waiting if open_ is None else waiting.unionByName(open_.filter(F.col("due") > level)))
    return out


def score(chg: DataFrame) -> DataFrame:
    return chg.groupBy(*_tree_keys(chg)).agg(F.sum(F.bit_count("chg")).alias("score"))


def site_scores(chg: DataFrame) -> DataFrame:
    """keys, pos, score: 64 counters a block, expanded only after they are summed."""
    keys = _tree_keys(chg)
    sums = chg.groupBy(*keys, "block").agg(*[
        F.sum(F.shiftrightunsigned("chg", k).bitwiseAND(F.lit(1))).alias(f"c{k}") for k in range(64)])
    return sums.select(*keys, "block", F.posexplode(F.array(*[F.col(f"c{k}") for k in range(64)])).alias("k", "score")).select(
        *keys, (F.col("block") * 64 + F.col("k")).alias("pos"), "score")


def pattern_scores(site: DataFrame, patterns: DataFrame, penalise_gaps: bool = False) -> DataFrame:
    """keys, pattern_id, n, score x n; with the option, n more per gap cell.

    The pattern's first site stands for it, so scores join on (family, pos).
    """
    keys = _tree_keys(site)
    gaps = F.length("pattern") - F.length(F.translate("pattern", catalog.GAPS, ""))
    rows = site.join(patterns.select("family", F.col("pattern_id").alias("pos"), "pattern", "n"), ["family", "pos"])
    per = F.col("score") + (gaps if penalise_gaps else F.lit(0))
    return rows.select(*keys, F.col("pos").alias("pattern_id"), "n", (per * F.col("n")).alias("score"))


def slowest(scores: DataFrame, count) -> DataFrame:
    """Whole score classes from the slowest up, while the sites before them are at most `count`.

    Sites per class are summed first; the running sum then sees one row per class.
    `count` is a number or a column of `scores`' family rows.
    """
    from pyspark.sql import Window

    keys = _tree_keys(scores)
    count = F.lit(count) if isinstance(count, (int, float)) else count
    classes = scores.filter("score > 0").groupBy(*keys, "score").agg(F.sum("n").alias("sites"))
    w = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ok = classes.withColumn("before", F.coalesce(F.sum("sites").over(w), F.lit(0))).filter(F.col("before") <= count)
    return scores.join(ok.select(*keys, "score"), [*keys, "score"], "left_semi")


def slowest_share(scores: DataFrame, share: float) -> DataFrame:
    """The same with a share of each alignment's sites."""
    from pyspark.sql import Window

    keys = _tree_keys(scores)
    totals = scores.groupBy(*keys).agg(F.floor(F.sum("n") * F.lit(share)).alias("limit"))
    classes = scores.filter("score > 0").groupBy(*keys, "score").agg(F.sum("n").alias("sites"))
    w = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ok = classes.withColumn("before", F.coalesce(F.sum("sites").over(w), F.lit(0))).join(totals, keys).filter("before <= limit")
    return scores.join(ok.select(*keys, "score"), [*keys, "score"], "left_semi")


def limited(scores: DataFrame, most: int) -> DataFrame:
    return scores.filter(F.col("score").between(1, most))
