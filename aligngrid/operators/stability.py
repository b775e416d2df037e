"""How well tree distances fit observed ones, per sequence, branch and node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligngrid.operators.trees import _tree_keys

TINY = 2.2e-16


def pair_scores(tree: DataFrame, observed: DataFrame) -> DataFrame:
    """keys, i < j, lca, x = ((t - o) / o)^2; pairs with t = 0 or o = 0 are skipped."""
    keys = _tree_keys(tree)
    o = observed.select("family", "i", "j", F.col("d").alias("o")).filter(F.col("o") > TINY)
    return tree.filter(F.col("d") > TINY).join(o, ["family", "i", "j"]).select(
        *keys, "i", "j", "lca", F.pow((F.col("d") - F.col("o")) / F.col("o"), 2).alias("x"))


def _ends(scores: DataFrame) -> DataFrame:
    keys = _tree_keys(scores)
    return scores.select(*keys, "x", F.explode(F.array("i", "j")).alias("seq_id"))


def by_sequence(scores: DataFrame) -> DataFrame:
    return _ends(scores).groupBy(*_tree_keys(scores), "seq_id").agg(
        F.sqrt(F.avg("x")).alias("score"), F.count("*").alias("n"))


def by_branch(scores: DataFrame, clos: DataFrame) -> DataFrame:
    """Pairs split by a branch, without listing them per branch.

    Over the leaves below a branch, the row sums of x count each split pair once and
    each pair that meets inside the subtree twice; the latter are known per meeting
    node. So a branch needs (row sums below) - 2 (sums of nodes below): linear in the
    closure instead of pairs x branches.
    """
    keys = _tree_keys(scores)
    rows = _ends(scores).groupBy(*keys, "seq_id").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    met = scores.groupBy(*keys, F.col("lca").alias("node")).agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    up = clos.select(*keys, "node", "anc", F.col("leaf_seq").alias("seq_id"))
    plus = up.filter("seq_id is not null").join(rows, [*keys, "seq_id"]).select(*keys, "anc", "x", "n")
    minus = up.join(met, [*keys, "node"]).select(*keys, "anc", (-2 * F.col("x")).alias("x"), (-2 * F.col("n")).alias("n"))
    total = plus.unionByName(minus).groupBy(*keys, F.col("anc").alias("node")).agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return total.filter("n > 0").select(
        *keys, "node", F.sqrt(F.greatest(F.lit(0.0), F.col("x") / F.col("n"))).alias("score"), "n")


def by_node(branch: DataFrame, edges: DataFrame) -> DataFrame:
    """Inner node: mean over the branches that touch it."""
    keys = _tree_keys(branch)
    e = edges.select(*keys, "node", "parent", "leaf_seq")
    touch = branch.select(*keys, "node", "score").join(e, [*keys, "node"])
    up = touch.select(*keys, F.col("parent").alias("node"), "score")
    own = touch.filter("leaf_seq is null").select(*keys, "node", "score")
    return up.unionByName(own).groupBy(*keys, "node").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
