"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share the whole size by their weights; what lies above `max_copies` times a source's size is shared
again by weight among the others until none is above. Inside a source a document's expected copies are proportional to
its preference. Their whole part is certain. The fraction is an inclusion probability p: with u a uniform number
hashed from the document, the rank is the odds of u divided by the odds of p, and the least ranks are taken until the
size that is left of the target is reached.

A source is never gathered or sorted in one task: ranks lie in (0, 1), sizes are summed in bins of the rank (combined
before the shuffle), the bin that holds the cut is divided again, and only the rows of the last, tiny bin are looked at in
order. Documents then compare their own rank with the cut of their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aligngrid.llm.common import WORD, cut, fresh, store, table

#: The weights of the sources in code point order, repeating, and how often a document may be taken.
WEIGHTS, MAX_COPIES = (5.0, 2.0, 1.0), 3
BINS = 1024
#: More sources than this are joined by a shuffle, not sent to every task.
BROADCAST_SOURCES = 20_000


def _number_of(seed: int, *cols: Column) -> Column:
    """A uniform number in (0, 1) from columns."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("\x01", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\x00"))
                                                                         for c in cols])), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, place): places by code point from 0, null last.

    Sorted in ranges; the place is the number of sources in earlier ranges and the place within the range.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = cut(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("inside", inside).join(F.broadcast(offsets.select("part", "before")), "part").select(
        "source", "source_size", (F.col("before") + F.col("inside") - 1).alias("place"))


def targets(sources: DataFrame, weight: Column, max_copies: float) -> DataFrame:
    """`sources` (source, source_size, ...) with `target`: shares of the whole size by weight, none above max_copies times
    the source's size. Each round is one small aggregate; a round without a new full source ends it."""
    s = cut(sources.withColumn("weight", weight.cast("double")).withColumn("room", F.col("source_size") * max_copies))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("room") <= F.col("weight") * level
        left = s.agg(F.sum(F.when(full, F.col("room")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (left[0] or 0.0)) / left[1] if left[1] else float("inf")
        if not left[1] or new <= level * (1 + 1e-12):
            break
        level = new
    target = F.least(F.col("room"), F.col("weight") * F.lit(level)) if level < float("inf") else F.col("room")
    return s.withColumn("target", target.cast("double")).drop("weight", "room")


def _scale(docs: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """`sources` with `scale`: documents take min(cap, scale * preference) copies each and reach the target together.

    Rounds as in `targets`, on sums for each source.
    """
    per = F.col("size") * F.col("preference")
    now = cut(sources.withColumn("scale", F.lit(0.0)))
    while True:
        full = F.col("scale") * F.col("preference") >= cap
        sums = joined(docs, now.select("source", "scale")).groupBy("source").agg(
            F.sum(F.when(full, cap * F.col("size")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(per)).alias("open"))
        new = F.when(F.col("open") > 0, (F.col("target") - F.col("taken")) / F.col("open")).otherwise(F.col("scale"))
        step = cut(now.join(sums, now.source.eqNullSafe(sums.source)).select(
            now["*"], F.greatest(new, F.col("scale")).alias("new"))
            .withColumn("moved", F.col("new") > F.col("scale") * (1 + 1e-9)))
        moved = step.where("moved").limit(1).count()
        now = step.select("source", "source_size", "place", "target", F.col("new").alias("scale"))
        if not moved:
            return now


def joined(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents beside the row of their source (null equals null)."""
    named = sources.withColumnRenamed("source", "_source")
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    return docs.join(named, docs.source.eqNullSafe(F.col("_source"))).drop("_source")


def _told_apart(df: DataFrame, key: list[str], number: str) -> DataFrame:
    """`df` with `number`, 0, 1, ... for rows that are equal in `key`, in the order of a digest of all their columns.

    Only rows that share a key with another row are stored and sorted, in ranges of key and digest: a key of any number of rows
    is counted a range at a time.
    """
    names = [f"_k{i}" for i in range(len(key))]
    shared = cut(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        *[F.col(k).alias(n) for k, n in zip(key, names)]))
    if shared.isEmpty():
        return df.withColumn(number, F.lit(0).cast("long"))
    same = F.lit(True)
    for k, n in zip(key, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    if shared.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        shared = F.broadcast(shared)
    digest, row, block, before = (fresh(x, df) for x in ("_digest", "_row", "_block", "_before"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = df.join(shared, same, "left_semi").withColumn(digest, F.xxhash64(*df.columns))
    many = store(many.withColumn(row, F.monotonically_increasing_id()), "equal-keys")
    many = store(many.repartitionByRange(parts, *key, digest, row).withColumn(block, F.spark_partition_id()), "equal-keys")
    ranges = many.groupBy(*key, block).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range that a key reaches into
    earlier = F.sum("_n").over(Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col(block).alias("_b"),
                           F.coalesce(earlier, F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(*key, block).orderBy(digest, row)) - 1
    numbered = many.withColumn(number, inside).join(ranges, same & (F.col(block) == F.col("_b")))
    numbered = numbered.withColumn(number, (F.col(number) + F.col(before)).cast("long"))
    alone = df.join(shared, same, "left_anti").withColumn(number, F.lit(0).cast("long"))
    return alone.unionByName(numbered.select(*alone.columns))


def _cuts(open_docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, cut_rank, cut_id, cut_number): the last document that is taken, in the order of rank, id and number.

    open_docs: source, doc_id, number, size, rank in (0, 1). sources: source, left, the size to reach. The sum of the sizes up to
    the cut is as near to `left` as whole documents allow.
    """
    state = sources.select("source", "left", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    for _ in range(3):
        at = joined(open_docs, state).where("rank >= low and rank < high")
        bins = at.groupBy("source", "left", "low", "high", F.least(F.lit(BINS - 1.0), F.floor(
            (F.col("rank") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).alias("bin")).agg(
            F.sum("size").alias("size"))
        order = Window.partitionBy("source").orderBy("bin")  # at most BINS rows a source
        run = F.sum("size").over(order)
        hit = bins.withColumn("until", run).where("until >= left").groupBy("source", "left", "low", "high").agg(
            F.min(F.struct("bin", F.col("until") - F.col("size"))).alias("first"))
        width = (F.col("high") - F.col("low")) / BINS
        state = cut(hit.select(
            "source", (F.col("left") - F.col("first.col2")).alias("left"),
            (F.col("low") + F.col("first.bin") * width).alias("low"),
            (F.col("low") + (F.col("first.bin") + 1) * width).alias("high")))
    last = joined(open_docs, state).where("rank >= low and rank < high")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "number").rowsBetween(
        Window.unboundedPreceding, 0))
    near = last.withColumn("until", run).groupBy("source").agg(
        F.min_by(F.struct("rank", "doc_id", "number"), F.struct(F.abs(F.col("until") - F.col("left")), F.col("until"))).alias("cut"),
        F.min(F.abs(F.col("until") - F.col("left"))).alias("off"), F.first("left").alias("left"),
        F.first("low").alias("low"))
    # Taking none of the last bin may be nearer than taking its first.
    return near.select("source", F.when(F.col("off") <= F.col("left"), F.col("cut.rank")).otherwise(F.col("low"))
                       .alias("cut_rank"),
                       *[F.when(F.col("off") <= F.col("left"), F.col(f"cut.{x}")).alias(f"cut_{y}")
                         for x, y in (("doc_id", "id"), ("number", "number"))])


def pareto_mix(df: DataFrame, size: Column, *, id_col: str = "doc_id", source: str = "source",
               preference: Column | None = None, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES,
               seed: int = 17) -> DataFrame:
    """`df` with `mix_size`, `mix_source_size`, `mix_target` and `mix_copies`: how often the mix takes each row.

    size: the size of a row (null: 0). preference: expected copies of a row relative to others of its source (default: alike;
    null or negative: 0). weights: of the sources in code point order, repeating; null is the last source.

    The copies of a row never exceed `max_copies`; the sizes that a source gives reach its target but for one document.
    A rerun takes the same rows. Rows that share source, id and size are numbered and drawn one by one. Rows of size 0 are never taken. An empty table gives an empty result; columns named as the new ones are
    replaced.
    """
    own = df.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    like = F.lit(1.0) if preference is None else F.greatest(F.coalesce(preference.cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = own.withColumn("mix_size", F.coalesce(size.cast("long"), F.lit(0)))
    number = fresh("_number", sized)
    sized = _told_apart(sized, [source, id_col, "mix_size"], number)
    docs = store(sized.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"),
                              F.col("mix_size").alias("size"), like.alias("preference"), F.col(number).alias("number")), "sizes")
    wheel = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                         (F.col("place") % len(weights) + 1).cast("int"))
    sources = targets(ranked_sources(docs), wheel, max_copies)
    sources = _scale(docs, sources, max_copies)
    plan = joined(docs, sources)

    def decided(size, like, source, ident, number, scale):
        """Expected and certain copies, and the rank of the fraction."""
        expected = F.when((size > 0) & (like > 0), F.least(F.lit(float(max_copies)), scale * like)).otherwise(0.0)
        sure = F.floor(expected + 1e-9)
        p = F.least(F.greatest(expected - sure, F.lit(0.0)), F.lit(1 - 1e-9))
        u = F.when(number == 0, _number_of(seed, source, ident)).otherwise(_number_of(seed, source, ident, number))
        odds = (u / (1 - u)) / (p / (1 - p))
        return expected, sure, F.when(p > 1e-9, odds / (1 + odds))

    _, sure, rank = decided(F.col("size"), F.col("preference"), F.col("source"), F.col("doc_id"), F.col("number"), F.col("scale"))
    chosen = store(plan.select("doc_id", "number", "source", "size", sure.alias("sure"), rank.alias("rank")), "ranks")
    given = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("sure")).alias("given"))
    left = sources.join(given, sources.source.eqNullSafe(given.source)).select(
        sources.source, (F.col("target") - F.col("given")).alias("left"))
    cuts = _cuts(chosen.where("rank is not null").select("source", "doc_id", "number", "size", "rank"),
                 left.where("left > 0"))
    facts = sources.join(cuts.withColumnRenamed("source", "_s"), sources.source.eqNullSafe(F.col("_s")), "left").select(
        sources.source, "source_size", "target", "scale", "cut_rank", "cut_id", "cut_number")
    facts = cut(facts)
    if facts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        facts = F.broadcast(facts)
    # What the plan says of a source is one column beside the own ones, under a name that they do not have.
    fact, name, liking = (fresh(x, own) for x in ("_fact", "_name", "_liking"))
    facts = facts.select(F.col("source").alias(name), F.struct(
        "source_size", "target", "scale", "cut_rank", "cut_id", "cut_number").alias(fact))
    full = sized.withColumn(liking, like).join(facts, F.col(source).cast("string").eqNullSafe(F.col(name)))
    of = lambda x: F.col(fact)[x]
    _, sure, rank = decided(F.col("mix_size"), F.col(liking), F.col(source).cast("string"), F.col(id_col), F.col(number), of("scale"))
    # Equal ranks are taken in the order of id (null first) and number.
    has, last = F.col(id_col).isNotNull(), of("cut_id").isNotNull()
    before = (~has & last) | (F.col(id_col) < of("cut_id")) | (F.col(id_col).eqNullSafe(of("cut_id")) & (F.col(number) <= of("cut_number")))
    more = F.coalesce((rank < of("cut_rank")) | ((rank == of("cut_rank")) & F.coalesce(before, F.lit(False))), F.lit(False))
    return full.select(
        *own.columns, "mix_size", of("source_size").alias("mix_source_size"), of("target").alias("mix_target"),
        (sure + more.cast("int")).cast("long").alias("mix_copies"))


def take(df: DataFrame, size: Column, **how) -> DataFrame:
    """The mix itself: every row of `df` as often as `pareto_mix` takes it."""
    mixed = pareto_mix(df, size, **how).where("mix_copies > 0")
    copy = fresh("_copy", mixed)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*df.columns)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document; longer ones are preferred by the square root of their size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = docs.select("doc_id", "source", n_words().alias("size"))
    out = pareto_mix(docs, F.col("size"), preference=F.sqrt("size"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                      F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
                      F.col("mix_copies").alias("copies"), "source")


QUERIES = {"op1_pareto_mix": op1_pareto_mix}
