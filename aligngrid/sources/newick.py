"""Newick text to edge tables and back, as window and sort jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aligngrid.operators.recode import listagg
from aligngrid.operators.trees import _tree_keys

DEFAULT_LENGTH = 0.1


def parse_trees(trees: DataFrame) -> DataFrame:
    """keys, newick -> keys, node, parent, length, label, name. The root is not listed.

    Tokens are exploded; a node is a leaf name or a closing bracket, and its parent is the
    next closing bracket one level up, found by a window over the tokens of that level.
    """
    keys = _tree_keys(trees)
    token = r"([(),;]|:[^,:;()#\s]+|#[0-9.]+|[^(),:;#\s]+)"
    t = trees.select(*keys, F.posexplode(F.regexp_extract_all("newick", F.lit(token), 1)).alias("pos", "tok"))
    w = Window.partitionBy(*keys).orderBy("pos")
    step = F.when(F.col("tok") == "(", 1).when(F.col("tok") == ")", -1).otherwise(0)
    t = t.withColumn("depth", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    for k in (1, 2, 3):
        t = t.withColumn(f"n{k}", F.lead("tok", k).over(w))
    t = t.withColumn("prev", F.lag("tok").over(w))
    close = F.col("tok") == ")"
    word = ~F.col("tok").isin("(", ")", ",", ";") & ~F.col("tok").startswith(":") & ~F.col("tok").startswith("#")
    leaf = word & (F.coalesce("prev", F.lit("(")) != ")")
    nodes = t.filter(close | leaf).withColumn("is_close", close)

    def attached(mark):
        """Value of the first following token with this mark, before the next node or comma."""
        out = F.lit(None).cast("string")
        open_ = F.lit(True)
        for k in (1, 2, 3):
            c = F.col(f"n{k}")
            out = F.coalesce(out, F.when(open_ & c.startswith(mark), F.substring(c, F.lit(2), F.length(c))))
            open_ = open_ & ~F.coalesce(c, F.lit(";")).isin("(", ")", ",", ";")
        return out

    nodes = nodes.withColumn("length", F.coalesce(attached(":").try_cast("double"), F.lit(DEFAULT_LENGTH))).withColumn(
        "label", F.coalesce(attached("#").try_cast("int"), F.lit(0)))
    own = nodes.select(*keys, "pos", F.col("depth").alias("level"), F.lit(None).cast("int").alias("mark"), "tok", "is_close", "length", "label")
    marks = nodes.filter("is_close").select(
        *keys, "pos", (F.col("depth") + 1).alias("level"), F.col("pos").alias("mark"), F.lit(None).cast("string").alias("tok"),
        F.lit(None).cast("boolean").alias("is_close"), F.lit(None).cast("double").alias("length"), F.lit(None).cast("int").alias("label"))
    after = Window.partitionBy(*keys, "level").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    both = own.unionByName(marks).withColumn("parent", F.first("mark", ignorenulls=True).over(after))
    return both.filter("is_close is not null and parent is not null").select(
        *keys, F.col("pos").cast("bigint").alias("node"), F.col("parent").cast("bigint").alias("parent"), "length", "label",
        F.when(~F.col("is_close"), F.col("tok")).alias("name"))


def with_leaf_seq(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Leaf names to sequence ids. names: family, name, seq_id."""
    return edges.join(names.select("family", "name", F.col("seq_id").alias("leaf_seq")), ["family", "name"], "left")


def rooted(edges: DataFrame) -> DataFrame:
    """keys, is_rooted: two branches at the top instead of three."""
    from aligngrid.operators.trees import roots

    keys = _tree_keys(edges)
    top = roots(edges).withColumnRenamed("node", "parent")
    return edges.join(top, [*keys, "parent"]).groupBy(*keys).agg((F.count("*") == 2).alias("is_rooted"))


def leaf_names(trees: DataFrame) -> DataFrame:
    """keys, names, n_open, brackets_ok: leaf names in order; n - 2 brackets are wanted, but for two leaves."""
    keys = _tree_keys(trees)
    names = F.regexp_extract_all("newick", F.lit(r"[(,]([A-Za-z0-9][^:,()]*)"), 1)
    n_open = F.length("newick") - F.length(F.replace("newick", F.lit("("), F.lit("")))
    return trees.select(*keys, names.alias("names"), n_open.alias("n_open")).withColumn(
        "brackets_ok", (F.col("n_open") + 2 == F.size("names")) | (F.size("names") == 2))


def render(edges: DataFrame, clos: DataFrame, names: DataFrame | None = None, places: int = 6, support: DataFrame | None = None) -> DataFrame:
    """keys, newick. Each node gets its path of child ranks as a sort key; brackets open at the
    path and close after everything below it, so one ordered aggregate per tree writes the text.

    names: family, seq_id, name (numbers from 1 otherwise). support: keys, node, value, written as #v.
    """
    keys = _tree_keys(edges)
    w = Window.partitionBy(*keys, "parent").orderBy("node")  # children of one node
    e = edges.withColumn("rank", F.row_number().over(w) - 1)
    if names is not None:
        e = e.join(names.select("family", F.col("seq_id").alias("leaf_seq"), "name"), ["family", "leaf_seq"], "left")
    else:
        e = e.withColumn("name", (F.col("leaf_seq") + 1).cast("string"))
    tail = F.concat(F.lit(":"), F.format_string(f"%.{places}f", "length"))
    if support is not None:
        e = e.join(support.select(*keys, "node", "value"), [*keys, "node"], "left")
        tail = F.concat(tail, F.coalesce(F.concat(F.lit("#"), F.col("value").cast("string")), F.lit("")))
    e = e.withColumn("tail", tail)
    step = e.select(*keys, F.col("node").alias("anc"), "rank")
    paths = clos.select(*keys, "node", "anc", "hops").join(step, [*keys, "anc"]).withColumn(
        "digit", F.lpad(F.col("rank").cast("string"), 10, "0")).groupBy(*keys, "node").agg(
        listagg("digit", "hops desc").alias("path"))
    rows = e.join(paths, [*keys, "node"])
    sep = F.when(F.col("rank") > 0, ",").otherwise("")
    leaf = F.col("leaf_seq").isNotNull()
    parts = F.when(leaf, F.array(F.struct(F.col("path").alias("at"), F.concat(sep, "name", "tail").alias("text")))).otherwise(F.array(
        F.struct(F.col("path").alias("at"), F.concat(sep, F.lit("(")).alias("text")),
        F.struct(F.concat("path", F.lit("~")).alias("at"), F.concat(F.lit(")"), "tail").alias("text"))))
    return rows.select(*keys, F.inline(parts)).groupBy(*keys).agg(listagg("text", "at").alias("body")).select(
        *keys, F.concat(F.lit("("), "body", F.lit(");")).alias("newick"))
