"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

The fingerprint of a text is a vector of longs, the sum of the vectors of its elements, modulo powers of two:

* 8 lanes modulo 2^32, filled by the hash of each paragraph (a \\n-split line). They depend on the multiset of paragraphs
  only, so texts whose paragraphs stand in another order are equal, and two texts are otherwise equal by a chance of 2^-256.
* 120 lanes modulo 2^20, three to a long, filled by one hashed bit for each piece of a paragraph (up to 6 words).
  Read as +1 and -1 they are a random projection of the multiset of pieces, so the cosine of two vectors estimates the
  share of pieces that two texts have in common.
* the number of paragraphs and of pieces.

Sums can be taken back: `combined` adds the fingerprints of two texts (that is, of the texts joined by a line break) or removes
one from the other, without the texts.

Elements are exploded beside the row they come from and summed before anything is shuffled; one long text is one row of
sums however many elements it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aligngrid.llm.common import cut, store, table

#: Fixed values of the layout.
EQUAL_SEEDS, LIKE_SEEDS = (11, 12, 13, 14), (21, 22)
PIECE = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){1,6}"
LANE, PER_LONG = 20, 3
LOW32, LANES = (1 << 32) - 1, sum(1 << (LANE * i) for i in range(PER_LONG))
N_EQUAL, N_LIKE = 2 * len(EQUAL_SEEDS), LANE * len(LIKE_SEEDS)
MISSING = -(1 << 63)


def elements(text: Column) -> Column:
    """array<struct<piece boolean, value string>>: the paragraphs and their pieces."""
    wrap = lambda piece: lambda x: F.struct(F.lit(piece).alias("piece"), x.alias("value"))
    return F.concat(F.transform(F.split(text, "\n", -1), wrap(False)),
                    F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), wrap(True)))


def sums(piece: Column, value: Column) -> list[Column]:
    """Aggregates that add up the vectors of elements; `vector` puts them together."""
    hashed = lambda seed: F.xxhash64(F.lit(seed), value)
    out = []
    for seed in EQUAL_SEEDS:
        whole = F.when(~piece, hashed(seed))
        out += [F.sum(whole.bitwiseAND(F.lit(LOW32))), F.sum(F.shiftrightunsigned(whole, 32))]
    for seed in LIKE_SEEDS:
        part = F.when(piece, hashed(seed))
        out += [F.sum(F.shiftrightunsigned(part, i).bitwiseAND(F.lit(LANES))) for i in range(LANE)]
    out += [F.count(F.when(~piece, 1)), F.count(F.when(piece, 1))]
    return [F.coalesce(c, F.lit(0)).alias(f"_v{i}") for i, c in enumerate(out)]


def _wrapped(x: Column, i: Column) -> Column:
    """A sum or difference of lanes, back in range. Lanes that share a long keep to themselves."""
    like = F.lit(0)
    for lane in range(PER_LONG):
        shift = LANE * lane
        like = like.bitwiseOR(F.shiftleft(F.shiftright(x, shift).bitwiseAND(F.lit((1 << LANE) - 1)), shift))
    return F.when(i < N_EQUAL, x.bitwiseAND(F.lit(LOW32))).when(i < N_EQUAL + N_LIKE, like).otherwise(x)


def vector() -> Column:
    """array<bigint> of the columns that `sums` names."""
    n = N_EQUAL + N_LIKE + 2
    return F.transform(F.array(*[F.col(f"_v{i}") for i in range(n)]), _wrapped)


def fingerprints(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """`keys` and one array<bigint> column for each {name: text column}; one row for each distinct value of the keys.

    Rows with equal keys are summed (as if their texts were joined by line breaks). Null is an empty text: one empty paragraph.
    """
    def tag(i: int):
        return lambda x: F.struct(F.lit(i).alias("text"), x["piece"].alias("piece"), x["value"].alias("value"))

    tagged = F.concat(*[F.transform(elements(F.coalesce(F.col(t), F.lit(""))), tag(i)) for i, t in enumerate(texts.values())])
    each = df.select(*keys, F.explode(tagged).alias("e"))
    added = each.groupBy(*keys, F.col("e.text").alias("_text")).agg(*sums(F.col("e.piece"), F.col("e.value")))
    rows = added.select(*keys, "_text", vector().alias("_v"))
    if len(texts) == 1:
        return rows.select(*keys, F.col("_v").alias(next(iter(texts))))
    return rows.groupBy(*keys).agg(*[F.first(F.when(F.col("_text") == i, F.col("_v")), ignorenulls=True).alias(name)
                                     for i, name in enumerate(texts)])


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint with the elements of b added to (sign 1) or removed from (sign -1) those of a."""
    def lanes(x, y):  # three lanes added at once: the borrow or carry of one must not reach the next
        out = F.lit(0)
        for lane in range(PER_LONG):
            part = lambda v, s=LANE * lane: F.shiftright(v, s).bitwiseAND(F.lit((1 << LANE) - 1))
            out = out.bitwiseOR(F.shiftleft((part(x) + sign * part(y)).bitwiseAND(F.lit((1 << LANE) - 1)), LANE * lane))
        return out

    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.transform(both, lambda z, i: F.when((i >= N_EQUAL) & (i < N_EQUAL + N_LIKE), lanes(z["a"], z["b"])).when(
        i < N_EQUAL, (z["a"] + sign * z["b"]).bitwiseAND(F.lit(LOW32))).otherwise(z["a"] + sign * z["b"]))


def as_text(v: Column) -> Column:
    """The fingerprint as lowercase hexadecimal digits, 16 for each long."""
    return F.lower(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated cosine of the multisets of pieces; 1 for equal fingerprints."""
    n = N_EQUAL + N_LIKE + 2
    na, nb = F.element_at(a, n), F.element_at(b, n)
    like = lambda v: F.slice(v, N_EQUAL + 1, N_LIKE)

    def signed(x, total):
        return [2 * F.shiftright(x, LANE * i).bitwiseAND(F.lit((1 << LANE) - 1)) - total for i in range(PER_LONG)]

    def dot(x, nx, y, ny):
        terms = F.zip_with(like(x), like(y), lambda p, q: sum(
            ((u * w).cast("double") for u, w in zip(signed(p, nx), signed(q, ny))), F.lit(0.0)))
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    norm = F.sqrt(dot(a, na, a, na) * dot(b, nb, b, nb))
    return F.when(a == b, 1.0).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, na, b, nb) / norm))
                                    ).otherwise(0.0)


def _neighbours(keys: DataFrame) -> DataFrame:
    """`keys` (id, h, n) with the key after each (`next_id`, `next_h`) and the one before and its n (`prev_*`), in a ring.

    Sorted in ranges; only the first and the last key of each range are looked at together.
    """
    dealt = cut(keys.repartitionByRange("id", "h").withColumn("part", F.spark_partition_id()))
    here = F.struct("id", "h", "n")
    inside = Window.partitionBy("part").orderBy("id", "h")
    ends = dealt.groupBy("part").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    ring, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding,
                                                                           Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("after"),
                       F.coalesce(F.lag("last").over(ring), F.last("last").over(whole)).alias("before"))
    near = dealt.select("*", F.lead(here).over(inside).alias("next"), F.lag(here).over(inside).alias("prev")).join(
        F.broadcast(ends), "part")
    after, before = F.coalesce("next", "after"), F.coalesce("prev", "before")
    return near.select("id", "h", "n", after["id"].alias("next_id"), after["h"].alias("next_h"),
                       before["id"].alias("prev_id"), before["h"].alias("prev_h"), before["n"].alias("prev_n"))


def distinct_texts(df: DataFrame) -> DataFrame:
    """(id, h, text, rows): one row for each distinct pair of id and text of documents (doc_id, text), `rows` the number of its
    repeats. A missing id is MISSING, a missing text empty."""
    docs = df.select(F.coalesce(F.col("doc_id"), F.lit(MISSING)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("rows"))


def with_edits(df: DataFrame) -> DataFrame:
    """Documents (doc_id, text) beside their edited texts: id, h, rows, n, next_id, next_h, next_rows, text, edited.

    Rows as in `distinct_texts`. Ids ascend, null first; texts of one id follow in the order of their hash. A lone document is
    its own next one. Texts and heads come from one shuffle of the texts, so both carry the number of rows.
    """
    docs = df.select(F.coalesce(F.col("doc_id"), F.lit(MISSING)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("h"), "text")
    keys = docs.groupBy("id", "h").agg(F.first(F.char_length("text").cast("long")).alias("n"))
    near = store(_neighbours(keys), "neighbours")
    texts = distinct_texts(df)
    heads = texts.join(near.select("id", "h", "prev_id", "prev_h", "prev_n"), ["id", "h"]).select(
        F.col("prev_id").alias("id"), F.col("prev_h").alias("h"), F.col("rows").alias("next_rows"),
        F.expr("substring(text, 1, cast(prev_n div 4 AS int))").alias("head"))
    both = texts.join(near.select("id", "h", "n", "next_id", "next_h"), ["id", "h"]).join(heads, ["id", "h"])
    stay = F.expr("substring(text, 1, cast(n - n div 4 AS int))")
    return both.select("id", "h", "rows", "n", "next_id", "next_h", "next_rows", "text", F.concat(stay, "head").alias("edited"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how like they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_edits(docs).withColumn("sha", F.sha2("edited", 256))
    made = fingerprints(rows, ["id", "h", "rows", "n", "next_id", "next_h", "next_rows", "sha"], {"own": "text", "other": "edited"})
    after = fingerprints(distinct_texts(docs), ["id", "h", "rows"], {"next": "text"})
    after = after.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("rows").alias("next_rows"), "next")
    out = made.join(after, ["next_id", "next_h", "next_rows"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(
        F.when(F.col("id") != MISSING, F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"))


QUERIES = {"op2_fingerprint": op2_fingerprint}
