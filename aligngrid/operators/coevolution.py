"""Two positions that evolve together: pair equilibrium, pair rates, back to one position.

The number of states is fixed by the alphabet (20 x 20), so the joins inside one
key are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_eqm(freq: DataFrame, affinity: DataFrame, psi: float) -> DataFrame:
    """family, i, j, pi proportional to pi_i pi_j exp(psi r_ij). affinity: aa1, aa2, kind (0 where absent)."""
    a = freq.select("family", F.col("state").alias("i"), F.col("pi").alias("pi_i"))
    b = freq.select("family", F.col("state").alias("j"), F.col("pi").alias("pi_j"))
    r = affinity.select(F.col("aa1").alias("i"), F.col("aa2").alias("j"), "kind")
    raw = a.join(b, "family").join(r, ["i", "j"], "left").select(
        "family", "i", "j", (F.col("pi_i") * F.col("pi_j") * F.exp(psi * F.coalesce("kind", F.lit(0)))).alias("x"))
    total = raw.groupBy("family").agg(F.sum("x").alias("total"))
    return raw.join(total, "family").select("family", "i", "j", (F.col("x") / F.col("total")).alias("pi"))


def pair_q(pi: DataFrame, exchange: DataFrame | None = None) -> DataFrame:
    """family, i, j, i2, j2, q: one position changes; exchangeability x equilibrium of the target pair.

    exchange: i, i2, s of single positions; 1 where not given.
    """
    to = pi.select("family", F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("pi").alias("q"))
    src = pi.select("family", "i", "j")
    first = src.join(to.withColumn("j", F.col("j2")), ["family", "j"]).filter("i <> i2")
    second = src.join(to.withColumn("i", F.col("i2")), ["family", "i"]).filter("j <> j2")
    cols = ["family", "i", "j", "i2", "j2", "q"]
    out = first.select(cols).unionByName(second.select(cols))
    if exchange is None:
        return out
    a = F.when(F.col("i") != F.col("i2"), F.col("i")).otherwise(F.col("j"))
    b = F.when(F.col("i") != F.col("i2"), F.col("i2")).otherwise(F.col("j2"))
    return out.withColumn("a", a).withColumn("b", b).join(
        exchange.select(F.col("i").alias("a"), F.col("i2").alias("b"), "s"), ["a", "b"]
    ).withColumn("q", F.col("q") * F.col("s")).select(cols)


def aggregate_first(q: DataFrame, pi: DataFrame) -> DataFrame:
    """Rates of the first position alone: flows summed over the second, per mass of the state left."""
    flow = q.filter("i <> i2").join(pi, ["family", "i", "j"]).groupBy("family", "i", "i2").agg(
        F.sum(F.col("pi") * F.col("q")).alias("flow"))
    mass = pi.groupBy("family", "i").agg(F.sum("pi").alias("mass"))
    return flow.join(mass, ["family", "i"]).select("family", "i", "i2", (F.col("flow") / F.col("mass")).alias("q"))
