"""Likelihood over codon positions with shared or own parameters and trees.

`model_of` and `tree_of` give the parameter set and the tree set of each position; a position that is left out adds its
likelihood from frequencies alone. Positions of the same two sets are one part of the alignment, with patterns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.operators import aggregate as A
from aligngrid.operators import likelihood as L
from aligngrid.session import cut


def _set_of(which: dict[int, int], pos=None):
    pos = F.expr("pos % 3") if pos is None else pos
    return F.coalesce(*[F.when(pos == p, F.lit(c)) for p, c in which.items()])


def _with_missing(out: DataFrame, missing: DataFrame | None) -> DataFrame:
    """Adds `missing` (family, lnl_missing) to lnl."""
    if missing is None:
        return out
    return out.join(missing, "family", "left").withColumn("lnl", F.col("lnl") + F.coalesce("lnl_missing", F.lit(0.0))).select(
        *out.columns)


def codon_partition(site: DataFrame, site_pattern: DataFrame, model_of: dict[int, int], missing: DataFrame | None = None) -> DataFrame:
    """keys, lnl: each site takes the value its position's class gives its pattern.

    site: keys (family, and tree_id if there), class, pattern_id, lnl. model_of: codon position -> class; positions left out
    of it add `missing` (family, lnl_missing), their likelihood from frequencies alone.
    """
    # sites per (pattern, class) first: the join then sees patterns, not sites
    counts = site_pattern.withColumn("class", _set_of(model_of)).filter("class is not null").groupBy(
        "family", "pattern_id", "class").agg(F.count("*").alias("n"))
    keys = [c for c in ("tree_id", "family") if c in site.columns]
    out = counts.join(site, ["family", "pattern_id", "class"]).groupBy(*keys).agg(F.sum(F.col("n") * F.col("lnl")).alias("lnl"))
    return _with_missing(out, missing)


def shared_frequencies(freq: DataFrame, model_of: dict[int, int]) -> DataFrame:
    """family, model_set, pi_A..: the mean over the positions that share a set. freq: family, pos, pi_A.."""
    cols = [c for c in freq.columns if c.startswith("pi_")]
    return freq.withColumn("model_set", _set_of(model_of, F.col("pos"))).filter("model_set is not null").groupBy(
        "family", "model_set").agg(*[F.avg(c).alias(c) for c in cols])


def own_likelihood(sites: DataFrame, edges: DataFrame, params: DataFrame, model_of: dict[int, int], tree_of: dict[int, int],
                   missing: DataFrame | None = None, classes=L.ONE, cols: DataFrame | None = None,
                   sequences: DataFrame | None = None) -> DataFrame:
    """tree_id, family, lnl: sum over the positions, each under the parameters and the tree of its sets.

    sites: family, seq_id, pos, ch (nucleotides). edges: tree_id, tree_set, family, node, parent, length, leaf_seq. params: family,
    model_set, pi_A.., kappa. model_of and tree_of name the same positions; the others add `missing`. classes: as in
    `site_likelihood`, mixed by their weights. cols, sequences: columns and sequences of the sites, if the caller has them.
    """
    if set(model_of) != set(tree_of):
        raise ValueError("a position has both a parameter set and a tree set or neither")
    part = lambda *more: F.struct("family", "model_set", "tree_set", *more).alias("family")
    sets = sorted({(model_of[p], tree_of[p]) for p in model_of})
    pairs = F.array(*[F.struct(F.lit(m).alias("model_set"), F.lit(t).alias("tree_set")) for m, t in sets])
    cols = A.columns(sites) if cols is None else cols
    own = cols.withColumn("model_set", _set_of(model_of)).withColumn("tree_set", _set_of(tree_of)).filter("model_set is not null")
    patterns = cut(A.patterns_of(own, "model_set", "tree_set").select(part(), "pattern", "n", "pattern_id"), merge=False)
    sequences = sites.select("family", "seq_id").distinct() if sequences is None else sequences
    sequences = sequences.select("*", F.inline(pairs)).select(part(), "seq_id")
    given = params.join(params.select("family").distinct().select("*", F.inline(pairs)), ["family", "model_set"]).select(
        part(), *[f"pi_{b}" for b in catalog.DNA], "kappa")
    tree = edges.join(edges.select("family").distinct().select("*", F.inline(pairs)), ["family", "tree_set"]).select(
        "tree_id", part(), "node", "parent", "length", "leaf_seq")
    site = L.site_likelihood(patterns, tree, sequences, given, catalog.DNA, classes)
    if len(classes) > 1:
        weights = F.broadcast(sites.sparkSession.createDataFrame([(c, w) for c, _, w in classes], "class int, weight double"))
        site = L.mixture(site, weights)
    out = L.total(site, patterns).groupBy("tree_id", F.col("family.family").alias("family")).agg(F.sum("lnl").alias("lnl"))
    return _with_missing(out, missing)
