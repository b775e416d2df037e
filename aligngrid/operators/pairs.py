"""Sequence pairs: differences, distances, fit of distances to trees.

Sequences are packed 64 sites to a row as bit planes (one long per bit of the
state, one for "has a state"). A pair of sequences then meets once per 64 sites,
and differences are bit counts inside whole-stage codegen. The pair table itself
is the distance matrix, so its size is the size of the answer; a hot family is
spread over (family, block) keys and AQE splits what is still skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.functions import scalar as S


def bit_planes(cells: DataFrame, n_bits: int, keys=("family", "seq_id")) -> DataFrame:
    """cells: keys, pos, state (NULL = gap) -> keys, block, e (sites), v (states), p0.. planes."""
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    plane = lambda cond: F.coalesce(F.bit_or(F.when(cond, bit)), F.lit(0).cast("bigint"))
    return cells.groupBy(*keys, F.expr("pos div 64").alias("block")).agg(
        F.bit_or(bit).alias("e"), plane(F.col("state").isNotNull()).alias("v"),
        *[plane(F.expr(f"(state & {1 << b}) <> 0")).alias(f"p{b}") for b in range(n_bits)],
    )


def dna_cells(sites: DataFrame) -> DataFrame:
    return sites.select("family", "seq_id", "pos", S.state_index("ch", catalog.DNA).alias("state"))


def aa_cells(codons: DataFrame) -> DataFrame:
    """Translated codons: the amino-acid index is already in the codon table."""
    return codons.select("family", "seq_id", F.col("cpos").alias("pos"), F.col("aa").alias("state"))


#: Sequences of an alignment whose pairs are made in one task.
FEW = 1_000


def few_sequences(cells: DataFrame, keys=("family",)) -> bool:
    """Whether no alignment has more than FEW sequences, for `in_place`. Reads the cells once."""
    n = cells.groupBy(*keys).agg(F.countDistinct("seq_id").alias("n")).agg(F.max("n")).head()[0]
    return (n or 0) <= FEW


def met(rows: DataFrame, keys, cols: list[str], in_place: bool = False) -> DataFrame:
    """keys, block, i < j, a_.. and b_..: the columns of every two sequences of a block. rows: keys, block, seq_id, cols.

    in_place: the sequences of a block come together in a row and their pairs are made there, one by one; rows dealt out by any of the
    keys stay where they are. For few sequences (`few_sequences`); else by a join, whose large keys are split.
    """
    if in_place:
        known = rows.filter(" and ".join(f"{k} is not null" for k in (*keys, "block")))  # as by the join
        held = known.groupBy(*keys, "block").agg(F.collect_list(F.struct("seq_id", *cols)).alias("s"))
        one = held.select(*keys, "block", "s", F.explode("s").alias("a"))
        pair = one.select(*keys, "block", "a", F.explode(F.filter("s", lambda x: x["seq_id"] > F.col("a.seq_id"))).alias("b"))
        return pair.select(*keys, "block", F.col("a.seq_id").alias("i"), F.col("b.seq_id").alias("j"),
                           *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in cols])
    a = rows.select(*keys, "block", F.col("seq_id").alias("i"), *[F.col(c).alias("a_" + c) for c in cols])
    b = rows.select(*keys, "block", F.col("seq_id").alias("j"), *[F.col(c).alias("b_" + c) for c in cols])
    return a.join(b, [*keys, "block"]).filter("i < j")


def pair_counts(cells: DataFrame, n_bits: int, keys=("family",), in_place: bool = False) -> DataFrame:
    """keys, i < j, n_sites, n_both (states in both), n_diff, n_gap_diff, n_ts.

    n_ts counts state pairs that differ in bit 1 only: with A C G T = 0 1 2 3, the transitions. in_place: see `met`.
    """
    planes = bit_planes(cells, n_bits, (*keys, "seq_id"))
    xor = [F.expr(f"a_p{k} ^ b_p{k}") for k in range(n_bits)]
    both = F.expr("a_v & b_v")
    differ = xor[0]
    for x in xor[1:]:
        differ = differ.bitwiseOR(x)
    ts = xor[1].bitwiseAND(F.bitwise_not(xor[0])) if n_bits == 2 else F.lit(0).cast("bigint")
    pair = met(planes, keys, ["e", "v", *[f"p{b}" for b in range(n_bits)]], in_place)
    return pair.groupBy(*keys, "i", "j").agg(
        F.sum(F.bit_count("a_e")).alias("n_sites"), F.sum(F.bit_count(both)).alias("n_both"),
        F.sum(F.bit_count(differ.bitwiseAND(both))).alias("n_diff"),
        F.sum(F.bit_count(F.expr("a_v ^ b_v"))).alias("n_gap_diff"),
        F.sum(F.bit_count(ts.bitwiseAND(both))).alias("n_ts"),
    )


def prop_diff(ignore_gaps: bool = True):
    if ignore_gaps:
        return F.try_divide("n_diff", "n_both")
    return (F.col("n_diff") + F.col("n_gap_diff")) / F.col("n_sites")


def formula_distance(p, n_states: int, plain: bool = False):
    """-b ln(1 - p/b), b = (n-1)/n; below 0 -> 0, not a number -> 20. `plain`: -ln(1 - p)."""
    b = 1.0 if plain else (n_states - 1) / n_states
    inside = 1 - p / b
    return F.when(p.isNull() | (inside <= 0), 20.0).otherwise(F.greatest(F.lit(0.0), -b * F.log(inside)))


def formula_variance(p, n, n_states: int):
    b = (n_states - 1) / n_states
    return F.when(1 - p / b > 0, p * (1 - p) / (n * F.pow(1 - p / b, 2)))


def poisson(pairs: DataFrame, n_states: int, plain: bool = False) -> DataFrame:
    p = prop_diff()
    keys = [c for c in pairs.columns if c in ("family", "rep", "i", "j")]
    return pairs.select(
        *keys, formula_distance(p, n_states, plain).alias("d"),
        formula_variance(p, F.col("n_both"), n_states).alias("var"),
    )


def _k2p_lnl(t, kappa):
    """Log-likelihood of a pair's counts at distance t; unit mean rate."""
    beta = 1.0 / (kappa + 2.0)
    e1, e2 = F.exp(-4.0 * beta * t), F.exp(-2.0 * (kappa + 1.0) * beta * t)
    same, ts, tv = 0.25 + 0.25 * e1 + 0.5 * e2, 0.25 + 0.25 * e1 - 0.5 * e2, 0.25 - 0.25 * e1
    n_id, n_ts = F.col("n_both") - F.col("n_diff"), F.col("n_ts")
    n_tv = F.col("n_diff") - F.col("n_ts")
    term = lambda n, p: F.when(n > 0, n * F.log(p)).otherwise(F.lit(0.0))
    return term(n_id, same) + term(n_ts, ts) + term(n_tv, tv)


def ml_distance(pairs: DataFrame, kappa: float = catalog.START_KAPPA, rounds: int = 5) -> DataFrame:
    """Distance that maximises the K2P likelihood at a fixed kappa.

    A grid of 21 points is searched inside the row and narrowed around its best
    point `rounds` times: no explode, no shuffle.
    """
    out = pairs.withColumn("lo", F.lit(1e-5)).withColumn("hi", F.lit(catalog.MAX_BRANCH))
    for _ in range(rounds):
        grid = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / 20.0)
        best = F.array_max(F.transform(grid, lambda t: F.struct(_k2p_lnl(t, kappa).alias("l"), t.alias("t"))))
        step = (F.col("hi") - F.col("lo")) / 20.0
        out = out.withColumn("best", best["t"]).withColumn("step", step)
        out = out.withColumn("lo", F.greatest(F.lit(1e-5), F.col("best") - F.col("step"))).withColumn(
            "hi", F.least(F.lit(catalog.MAX_BRANCH), F.col("best") + F.col("step")))
    return out.withColumn("t", F.when(F.col("n_both") > 0, F.col("best")).otherwise(20.0)).drop("lo", "hi", "best", "step")


def _k2p_bend(t, kappa):
    """Second derivative of `_k2p_lnl`: sum of n (p'' / p - (p' / p)^2)."""
    beta = 1.0 / (kappa + 2.0)
    a, b = 4.0 * beta, 2.0 * (kappa + 1.0) * beta
    e1, e2 = F.exp(-a * t), F.exp(-b * t)
    n_tv = F.col("n_diff") - F.col("n_ts")

    def term(n, base, x, y):
        p, d1, d2 = base + x * e1 + y * e2, -a * x * e1 - b * y * e2, a * a * x * e1 + b * b * y * e2
        return F.when(n > 0, n * (d2 / p - (d1 / p) * (d1 / p))).otherwise(F.lit(0.0))

    return (term(F.col("n_both") - F.col("n_diff"), 0.25, 0.25, 0.5) + term(F.col("n_ts"), 0.25, 0.25, -0.5)
            + term(n_tv, 0.25, -0.25, 0.0))


def distance_se(pairs: DataFrame, kappa: float = catalog.START_KAPPA, least: float = 2e-4, flat: float = 1e-4) -> DataFrame:
    """Standard error from the curvature of the log-likelihood at distance t; a flat curve gives NULL."""
    bend = -_k2p_bend(F.greatest(F.col("t"), F.lit(least)), kappa)
    return pairs.withColumn("se", F.when(bend > flat, F.sqrt(1.0 / bend)))


def matrix(dist: DataFrame, value: str = "d") -> DataFrame:
    """Full symmetric matrix with a zero diagonal, written out of one pass over the pairs."""
    both = dist.select(
        "family", F.inline(F.array(
            F.struct(F.col("i"), F.col("j"), F.col(value).alias("d")),
            F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias("d")),
        ))
    )
    ends = both.select("family", "i").distinct()
    return both.unionByName(ends.select("family", "i", F.col("i").alias("j"), F.lit(0.0).alias("d")))


def rmsd(observed: DataFrame, expected: DataFrame, keys=("family",)) -> DataFrame:
    """Sum over the full matrix of ((o - e) / o)^2, o = 0 skipped. Pairs i < j count twice."""
    o = observed.select("family", "i", "j", F.col("d").alias("o")).filter("o > 2.2e-16")
    return o.join(expected.withColumnRenamed("d", "e"), ["family", "i", "j"]).groupBy(*keys).agg(
        (2 * F.sum(F.pow((F.col("o") - F.col("e")) / F.col("o"), 2))).alias("rmsd")
    )


def frobenius(a, b):
    """Distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def frobenius_cells(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Distance of matrices in long form (keys, i, j, x)."""
    return a.join(b.withColumnRenamed("x", "y"), [*keys, "i", "j"]).groupBy(*keys).agg(
        F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("norm")
    )


def model_grid(families: DataFrame, code: int = 0, off: DataFrame | None = None) -> DataFrame:
    """families (family, n_seq) x the fixed catalogue, less models switched off (section, switch,
    per family if the column is there) and gamma forms of non-RY models where there are two sequences.
    """
    grid = families.select("*", F.inline(catalog.model_array(code)))
    if off is not None:
        keys = [c for c in ("family", "section", "switch") if c in off.columns]
        grid = grid.join(off, keys, "left_anti")
    return grid.filter("not (gamma and n_seq <= 2 and data_type <> 'RY')")
