"""Pruning likelihoods with given parameters, in blocks of site patterns.

A row is one block of patterns under one tree: the letters of all sequences in the block, the tree as arrays and the parameters
meet once, and all rate classes of the block are pruned in one pass (`kernel`). Nothing is written or shuffled between the
levels of a tree. Blocks hold a bounded number of cells, so a long alignment is spread over many tasks.

A tree of more than `TREE_NODES` nodes is not held in a task: it is pruned level by level, as joins and products inside codegen
(`partials_by_level`). There only the vectors whose parent is still to come are carried to the next level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from aligngrid import catalog
from aligngrid.operators import kernel
from aligngrid.operators import models as M
from aligngrid.operators import trees as Tr
from aligngrid.operators.parsimony import heights
from aligngrid.operators.recode import listagg
from aligngrid.session import cut, ship

KEYS = ["tree_id", "family"]
ONE = ((0, 1.0, 1.0),)
#: Nodes of a tree that a task holds; patterns of a block and cells (sequences x patterns) of it, one pattern at least.
TREE_NODES, PATTERNS, CELLS = 20_000, 512, 1 << 18
#: Blocks whose results a task holds; rows of results that it gives out at a time, a node's at least.
SLICE, ROWS_OUT = 64, 1 << 16
#: Blocks of a partition, and numbers (nodes x classes x patterns x states) that are pruned together.
TASK_BLOCKS, GROUP = 256, 1 << 19


def pattern_blocks(patterns: DataFrame) -> DataFrame:
    """family, block, ids, text: the patterns of some first sites end to end, in the order of their ids."""
    most = F.greatest(F.lit(1), F.least(F.lit(PATTERNS), F.expr(f"{CELLS} div greatest(length(pattern), 1)")))
    return patterns.withColumn("block", F.floor(F.col("pattern_id") / most)).groupBy("family", "block").agg(
        listagg("pattern", "pattern_id").alias("text"), F.sort_array(F.collect_list("pattern_id")).alias("ids"))


def tree_rows(edges: DataFrame) -> DataFrame:
    """tree_id, family, nodes, parents, lengths, ranks: a row a tree."""
    z = F.collect_list(F.struct("node", "parent", "length", "leaf_seq", "leaf_rank"))
    return edges.groupBy(*KEYS).agg(z.alias("z")).select(
        *KEYS, F.col("z.node").alias("nodes"), F.col("z.parent").alias("parents"), F.col("z.length").alias("lengths"),
        F.transform("z", lambda x: F.when(x["leaf_seq"].isNull(), -1).otherwise(F.coalesce(x["leaf_rank"], F.lit(-2)))).alias("ranks"))


def with_ranks(edges: DataFrame, sequences: DataFrame) -> DataFrame:
    """Adds leaf_rank: place of the sequence in the pattern text. sequences: family, seq_id."""
    w = Window.partitionBy("family").orderBy("seq_id")  # one row per sequence
    ranks = sequences.select("family", "seq_id").distinct().withColumn("leaf_rank", F.row_number().over(w) - 1)
    return edges.join(ranks.withColumnRenamed("seq_id", "leaf_seq"), ["family", "leaf_seq"], "left")


def _rows(patterns: DataFrame, ranked: DataFrame, params: DataFrame, states: str) -> DataFrame:
    """Blocks under their trees with their parameters, dealt out by tree, family and block in partitions of about `TASK_BLOCKS`: the
    rows are small beside the work and the results, so partitions by bytes would not grow with them."""
    pi = F.array(*[F.col(f"pi_{s}") for s in states])
    blocks = cut(pattern_blocks(patterns))
    trees = cut(tree_rows(ranked))
    n_blocks, n_families = blocks.agg(F.count("*"), F.countDistinct("family")).head()
    n = trees.count() * n_blocks / max(1, n_families)
    rows = trees.join(params.select("family", pi.alias("pi"), "kappa"), "family").join(blocks, "family")
    return rows.repartition(max(1, math.ceil(n / TASK_BLOCKS)), *KEYS, "block").select(
        *KEYS, "nodes", "parents", "lengths", "ranks", "pi", "kappa", "text", "ids")


class _Group:
    """Rows of a batch whose blocks are pruned together.

    rows: their places in the batch; sizes, ids: number and ids of the patterns of each (ids: rows x patterns); forest, eigen and
    lengths: arguments of the pruning; nodes: ids of the forest's places, the roots last.
    """

    def __init__(self, states: str, rows: np.ndarray, cells: list):
        nodes, parents, lengths, ranks, pi, kappa, text, ids = ([column[r] for r in rows] for column in cells)
        k = len(states)
        table = np.full(256, k, np.int64)
        table[np.frombuffer(states.encode("ascii"), np.uint8)] = np.arange(k)
        self.rows, self.sizes = rows, np.array([len(x) for x in ids])
        wide = int(self.sizes.max())
        self.ids = np.zeros((len(rows), wide), np.int64)
        shown = [table[np.frombuffer(t.encode("ascii"), np.uint8)].reshape(n, -1).T for t, n in zip(text, self.sizes)]
        first = np.cumsum([0] + [len(x) for x in shown])
        cols = np.full((first[-1] + 1, wide), k, np.int64)  # the last row is of a sequence without data
        for r, (x, own) in enumerate(zip(shown, ids)):
            self.ids[r, :len(own)] = own
            cols[first[r]:first[r + 1], :len(own)] = x
        tree = np.repeat(np.arange(len(rows)), [len(x) for x in nodes])
        up, roots = kernel.forest_places(tree, np.concatenate(nodes), np.concatenate(parents))
        rank = np.concatenate(ranks)
        leaf = np.where(rank >= 0, rank + first[tree], np.where(rank == -2, first[-1], -1))
        self.forest = kernel.Forest(tree, up, leaf, cols, k)
        self.nodes, self.trees = np.append(np.concatenate(nodes), roots), np.append(tree, np.arange(len(rows)))
        s = np.ones((len(rows), k, k))
        if states == "ACGT":
            for a, b in ((0, 2), (1, 3)):
                s[:, a, b] = s[:, b, a] = kappa
        self.pi = np.array(pi, float)
        self.eigen = kernel.decompositions(s, self.pi)
        length = np.concatenate(lengths).astype(float)
        self.lengths = np.minimum(np.where(length < 0, np.nan, length), catalog.MAX_BRANCH)


def _groups(part: pa.RecordBatch, states: str, n_classes: int) -> Iterator[_Group]:
    """The rows of a batch (keys first) in groups of at most `GROUP` numbers, a row at least; rows of similar numbers of patterns together."""
    cells = [_cells(part.column(k)) for k in range(len(KEYS), part.num_columns)]
    n_nodes, sizes = [len(x) + 1 for x in cells[0]], [len(x) for x in cells[-1]]
    rows, held = [], 0
    for r in np.argsort(sizes, kind="stable"):
        # rows come with growing sizes: those of the group are padded to that of this one
        held += n_nodes[r]
        if rows and held * sizes[r] * n_classes * len(states) > GROUP:
            yield _Group(states, np.array(rows), cells)
            rows, held = [], n_nodes[r]
        rows.append(r)
    if rows:
        yield _Group(states, np.array(rows), cells)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, SLICE at a time: what is made of a block is much larger than its row."""
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            yield batch.slice(low, SLICE)


def _cells(column: pa.Array) -> list:
    """Values of a column, lists as arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _large(edges: DataFrame) -> DataFrame | None:
    """Keys of the trees that no task holds whole."""
    large = edges.groupBy(*KEYS).count().filter(F.col("count") > TREE_NODES).select(*KEYS)
    return None if large.isEmpty() else cut(large)


def site_likelihood(patterns: DataFrame, edges: DataFrame, sequences: DataFrame, params: DataFrame, states: str, classes=ONE) -> DataFrame:
    """tree_id, family, class, pattern_id, lnl of every pattern in every rate class.

    patterns: family, pattern, pattern_id (sequence k of the sorted seq_id is letter k of the text). edges: tree_id, family, node,
    parent, length, leaf_seq. sequences: family, seq_id. params: family, pi_<state>.., kappa. classes: (class, rate, weight).
    `family` may be a struct, so that parts of an alignment have trees and parameters of their own.
    """
    rates = [float(r) for _, r, _ in classes]
    ranked = with_ranks(edges, sequences)
    large = _large(edges)
    held = ranked if large is None else ranked.join(large, KEYS, "left_anti")

    names = np.array([c for c, _, _ in classes], np.int32)
    rows = _rows(patterns, held, params, states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            for g in _groups(part, states, len(rates)):
                for _, v, scale in g.forest.upwards(g.eigen, g.lengths[:, None] * np.array(rates)):
                    pass  # the roots come last, in the order of the trees
                lnl = np.log(np.maximum(np.einsum("rk,rcmk->rcm", g.pi, v), 1e-300)) + scale[:, None, :]
                r, c, m = np.nonzero(np.broadcast_to((np.arange(lnl.shape[2]) < g.sizes[:, None])[:, None], lnl.shape))
                place = pa.array(g.rows[r])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(place), part.column(1).take(place), pa.array(names[c]),
                     pa.array(g.ids[r, m]).cast(id_type), pa.array(lnl[r, c, m])],
                    names=[*KEYS, "class", "pattern_id", "lnl"])

    id_type = to_arrow_type(rows.schema["ids"].dataType.elementType)
    ship(edges.sparkSession)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in KEYS)
    out = rows.mapInArrow(run, f"{kinds}, class int, pattern_id {rows.schema['ids'].dataType.elementType.simpleString()}, lnl double")
    if large is not None:
        own = edges.join(large, KEYS, "left_semi")
        parts = partials_by_level(patterns, with_ranks(with_classes(own, classes), sequences), Tr.closure(own), params, states)
        out = out.unionByName(sitewise(parts, own, params, states))
    return out


def partials(patterns: DataFrame, edges: DataFrame, sequences: DataFrame, params: DataFrame, states: str, classes=ONE) -> DataFrame:
    """tree_id, family, class, node, pattern_id, l_<state>.., scale: likelihood of the data below each node.

    Inputs as in `site_likelihood` (family a number). Values are multiplied by powers of ten once all of a vector is below 0.1;
    `scale` counts the powers.
    """
    rates = [float(r) for _, r, _ in classes]
    names = np.array([c for c, _, _ in classes], np.int32)
    ranked = with_ranks(edges, sequences)
    large = _large(edges)
    held = ranked if large is None else ranked.join(large, KEYS, "left_anti")
    rows = _rows(patterns, held, params, states)
    kinds = [rows.schema[k].dataType.simpleString() for k in KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shows = np.concatenate([np.eye(len(states)), np.ones((1, len(states)))])
        for part in _slices(batches):
            for g in _groups(part, states, len(rates)):
                most = max(1, ROWS_OUT // (g.ids.shape[1] * len(rates)))
                tips = np.flatnonzero(g.forest.leaf >= 0)
                for low in range(0, len(tips), most):
                    some = tips[low:low + most]
                    v = shows[g.forest.cols[g.forest.leaf[some]]][:, None]
                    v = np.broadcast_to(v, (v.shape[0], len(rates), *v.shape[2:]))
                    yield joined(part, g, some, v, np.zeros((len(some), v.shape[2])))
                for places, v, scale in g.forest.upwards(g.eigen, g.lengths[:, None] * np.array(rates)):
                    for low in range(0, len(places), most):
                        yield joined(part, g, places[low:low + most], v[low:low + most], scale[low:low + most])

    def joined(part: pa.RecordBatch, g: _Group, places, v, scale) -> pa.RecordBatch:
        tree = g.trees[places]
        with np.errstate(divide="ignore"):
            top = np.log10(v.max(axis=3)) + scale[:, None, :] / np.log(10.0)
        power = np.where(top < -1, np.floor(-top), 0.0)
        # a vector of zeros has no power
        power = np.where(np.isfinite(power), power, 0.0)
        values = v * np.exp(scale[:, None, :] + power * np.log(10.0))[..., None]
        n, c, m = np.nonzero(np.broadcast_to((np.arange(v.shape[2]) < g.sizes[tree][:, None])[:, None], v.shape[:3]))
        values, place = values[n, c, m], pa.array(g.rows[tree[n]])
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(place), part.column(1).take(place), pa.array(names[c]), pa.array(g.nodes[places[n]]),
             pa.array(g.ids[tree[n], m]), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(states))),
             pa.array(power[n, c, m].astype(np.int32))], names=out_names)

    out_names = [*KEYS, "class", "node", "pattern_id", *[f"l_{s}" for s in states], "scale"]
    schema = ", ".join([*(f"{k} {t}" for k, t in zip(KEYS, kinds)), "class int, node bigint, pattern_id bigint",
                        *[f"l_{s} double" for s in states], "scale int"])
    ship(edges.sparkSession)
    out = rows.mapInArrow(run, schema)
    if large is not None:
        own = edges.join(large, KEYS, "left_semi")
        out = out.unionByName(partials_by_level(
            patterns, with_ranks(with_classes(own, classes), sequences), Tr.closure(own), params, states).select(*out.columns))
    return out


# ---- level by level, for trees that no task holds whole -------------------------------------

CLASS_KEYS = [*KEYS, "class"]


def with_classes(edges: DataFrame, classes=ONE) -> DataFrame:
    """Each edge once per rate class, its length times the class rate. classes: (class, rate, weight)."""
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(float(r)).alias("rate"), F.lit(float(w)).alias("weight")) for c, r, w in classes])
    return edges.select("*", F.inline(cells)).withColumn("length", F.col("length") * F.col("rate"))


def partials_by_level(patterns: DataFrame, edges: DataFrame, clos: DataFrame, params: DataFrame, states: str) -> DataFrame:
    """`partials` of edges with class and leaf_rank (`with_classes`, `with_ranks`) and their closure.

    A level takes the vectors that are due at it: leaves are read from the patterns when their parent is made, inner ones wait
    in `open` until theirs is.
    """
    ls = [f"l_{s}" for s in states]
    pi = {s: F.col(f"pi_{s}") for s in states}
    h = heights(edges.filter(F.col("class") == edges.agg(F.min("class")).head()[0]), clos)
    e = edges.join(h.withColumnRenamed("node", "parent").withColumnRenamed("height", "due"), [*KEYS, "parent"]).join(params, "family")
    e = cut(e.select(*CLASS_KEYS, "node", "parent", "length", "leaf_seq", "leaf_rank", "due", *[f"pi_{s}" for s in states], "kappa"))
    top = e.agg(F.max("due")).head()[0] or 0
    ch = F.substring("pattern", F.col("leaf_rank") + 1, F.lit(1))
    gap = F.coalesce(F.instr(F.lit(states), ch) == 0, F.lit(True))  # a sequence without data is all gap
    vec = {s: F.col(f"l_{s}") for s in states}
    tips = e.filter("leaf_seq is not null").join(patterns.select("family", "pattern", "pattern_id"), "family").select(
        *e.columns, "pattern_id", *[F.when(gap | (ch == s), 1.0).otherwise(0.0).alias(f"l_{s}") for s in states], F.lit(0).alias("scale"))
    inner = e.filter("leaf_seq is null").select(*CLASS_KEYS, "node", "parent", "length", "due", *[f"pi_{s}" for s in states], "kappa")
    cols = [*CLASS_KEYS, "node", "pattern_id", *ls, "scale"]
    out, open_ = tips.select(*cols), None
    for level in range(1, top + 1):
        kids = tips.filter(F.col("due") == level).select(*inner.columns, "pattern_id", *ls, "scale")
        if open_ is not None:
            kids = kids.unionByName(open_.filter(F.col("due") == level).select(*kids.columns))
        msg = (M.hky_message(vec, F.col("length"), pi, F.col("kappa")) if states == "ACGT"
               else M.f81_message(vec, F.col("length"), pi))
        up = kids.select(*CLASS_KEYS, F.col("parent").alias("node"), "pattern_id", "scale",
                         *[F.greatest(msg[s], F.lit(0.0)).alias(f"l_{s}") for s in states])
        # products as sums of logarithms: a node of very many children does not underflow
        up = up.groupBy(*CLASS_KEYS, "node", "pattern_id").agg(
            *[F.sum(F.log10(F.greatest(F.col(c), F.lit(1e-300)))).alias(c) for c in ls], F.sum("scale").cast("int").alias("scale"))
        most = F.greatest(*[F.col(c) for c in ls])
        powers = F.when(most < -1, F.floor(-most)).otherwise(0).cast("int")
        up = up.withColumn("k", powers).select(
            *CLASS_KEYS, "node", "pattern_id", *[F.pow(F.lit(10.0), F.col(c) + F.col("k")).alias(c) for c in ls],
            (F.col("scale") + F.col("k")).cast("int").alias("scale"))
        up = cut(up)
        out = out.unionByName(up.select(*cols))
        waiting = up.join(inner, [*CLASS_KEYS, "node"])
        open_ = cut(waiting if open_ is None else waiting.unionByName(
            open_.filter(F.col("due") > level).select(*waiting.columns)))
    return out


def sitewise(parts: DataFrame, edges: DataFrame, params: DataFrame, states: str) -> DataFrame:
    """tree_id, family, class, pattern_id, lnl: log of sum pi_i L_i at the root."""
    top = Tr.roots(edges.select(*KEYS, "node", "parent").distinct())
    value = sum((F.col(f"pi_{s}") * F.col(f"l_{s}") for s in states), F.lit(0.0))
    return parts.join(top, [*KEYS, "node"], "left_semi").join(params, "family").select(
        *CLASS_KEYS, "pattern_id", (F.log(value) - F.col("scale") * F.log(F.lit(10.0))).alias("lnl"))


# ---- sums over classes and patterns --------------------------------------------------------


def mixture(site: DataFrame, classes: DataFrame) -> DataFrame:
    """Mix classes per pattern by log-sum-exp. classes: class, weight (or per family)."""
    keys = [c for c in site.columns if c not in ("class", "lnl")]
    on = [c for c in ("family", "class") if c in classes.columns]
    rows = site.join(classes.select(*on, "weight"), on)
    term = F.log("weight") + F.col("lnl")
    top = rows.groupBy(*keys).agg(F.max(term).alias("m"), F.collect_list(term).alias("t"))  # few classes
    return top.select(*keys, (F.col("m") + F.log(F.aggregate(
        F.col("t"), F.lit(0.0), lambda s, x: s + F.exp(x - F.col("m"))))).alias("lnl"))


def total(site: DataFrame, patterns: DataFrame) -> DataFrame:
    """Sum of pattern counts times log-likelihoods."""
    keys = [c for c in site.columns if c in ("tree_id", "family", "model")]
    return site.join(patterns.select("family", "pattern_id", "n"), ["family", "pattern_id"]).groupBy(*keys).agg(
        F.sum(F.col("n") * F.col("lnl")).alias("lnl"))
