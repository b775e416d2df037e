"""Rate matrices as long tables (keys, i, j, q), their scaling and checks, P(t), rate classes."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aligngrid import catalog
from aligngrid.functions import scalar as S
from aligngrid.session import ship


# ---- exchangeabilities and Q --------------------------------------------------

def exchange_counts(cells: DataFrame, keys=("family",)) -> DataFrame:
    """keys, i < j, n: sequence pairs that differ as (i, j), summed over columns.

    A column's state counts give the pairs as products, so sequences are never paired.
    cells: keys, pos, state.
    """
    counts = cells.filter("state is not null").groupBy(*keys, "pos", "state").agg(F.count("*").alias("c"))
    a = counts.select(*keys, "pos", F.col("state").alias("i"), F.col("c").alias("ci"))
    b = counts.select(*keys, "pos", F.col("state").alias("j"), F.col("c").alias("cj"))
    # at most (states)^2 / 2 rows a column
    return a.join(b, [*keys, "pos"]).filter("i < j").groupBy(*keys, "i", "j").agg(
        F.sum(F.col("ci") * F.col("cj")).alias("n"))


def dna_exchange(kappa: DataFrame, rev: DataFrame | None = None) -> DataFrame:
    """family, model, i < j, s for JC, FEL (1), K2P, HKY (kappa at transitions) and REV (given, last rate 1)."""
    pairs = [(i, j, int((i, j) in ((0, 2), (1, 3)))) for i in range(4) for j in range(i + 1, 4)]
    cells = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(i).alias("i"), F.lit(j).alias("j"),
                 (F.col("kappa") if ts and m in ("K2P", "HKY") else F.lit(1.0)).cast("double").alias("s"))
        for m in ("JC", "FEL", "K2P", "HKY") for i, j, ts in pairs])
    out = kappa.select("family", F.inline(cells))
    if rev is None:
        return out
    w = Window.partitionBy("family")  # six rows
    last = F.max(F.when((F.col("i") == 2) & (F.col("j") == 3), F.col("s"))).over(w)
    return out.unionByName(rev.withColumn("s", F.col("s") / last).withColumn("model", F.lit("REV")).select(out.columns))


def q_matrix(exchange: DataFrame, freq: DataFrame, keys) -> DataFrame:
    """q_ij = s_ij pi_j both ways, diagonal = minus the row sum. exchange: keys, i < j, s; freq: keys, state, pi."""
    both = exchange.select(*keys, F.inline(F.array(
        F.struct("i", "j", "s"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "s"))))
    off = both.join(freq.select(*keys, F.col("state").alias("j"), "pi"), [*keys, "j"]).select(
        *keys, "i", "j", (F.col("s") * F.col("pi")).alias("q"))
    return with_diagonal(off, keys)


def with_diagonal(off: DataFrame, keys) -> DataFrame:
    diag = off.groupBy(*keys, "i").agg((-F.sum("q")).alias("q")).select(*keys, "i", F.col("i").alias("j"), "q")
    return off.unionByName(diag)


@lru_cache(None)
def codon_steps(code: int = 0, single: bool = True):
    """Pairs of sense codons (i, j, transition, amino acids): one differing base, or all pairs."""
    sense = catalog.sense_codons(code)
    aa = {c: a for _, c, _, a, _ in catalog.code_rows([code])}
    out = []
    for i, x in enumerate(sense):
        for j, y in enumerate(sense):
            d = [(a, b) for a, b in zip(x, y) if a != b]
            if i != j and (len(d) == 1 or not single):
                ts = len(d) == 1 and "".join(sorted(d[0])) in ("AG", "CT")
                out.append((i, j, int(ts), aa[x], aa[y], len(d)))
    return out


def codon_step_table(spark, code: int = 0, single: bool = True) -> DataFrame:
    return F.broadcast(spark.createDataFrame(
        codon_steps(code, single), "i int, j int, ts int, aa1 int, aa2 int, diff int"))


def q_codon(pi: DataFrame, params: DataFrame, code: int = 0, radical: DataFrame | None = None) -> DataFrame:
    """Codon M0: one changed base; x kappa at transitions; x omega if amino acids differ; x pi_j.

    pi: keys, sense, pi. params: family, kappa, omega; with a `radical` table
    (aa1, aa2, kind) also omega_r for kind 1.
    """
    keys = [c for c in pi.columns if c in ("family", "eqm")]
    steps = codon_step_table(pi.sparkSession, code)
    rows = pi.withColumnRenamed("sense", "j").join(steps, "j").join(params, "family")
    omega = F.col("omega")
    if radical is not None:
        rows = rows.join(radical, ["aa1", "aa2"], "left")
        omega = F.when(F.col("kind") == 1, F.col("omega_r")).otherwise(F.col("omega"))
    q = (F.when(F.col("ts") == 1, F.col("kappa")).otherwise(1.0)
         * F.when(F.col("aa1") != F.col("aa2"), omega).otherwise(1.0) * F.col("pi"))
    return with_diagonal(rows.select(*keys, "i", "j", q.alias("q")), keys)


def q_codon_empirical(exchange: DataFrame, pi: DataFrame, keys, restricted: bool, code: int = 0) -> DataFrame:
    """Given codon exchangeabilities (keys, i < j, s); `restricted` keeps one-base changes only."""
    if restricted:
        steps = codon_step_table(pi.sparkSession, code).select("i", "j")
        exchange = exchange.join(steps, ["i", "j"], "left_semi")
    return q_matrix(exchange, pi, keys)


def scale(q: DataFrame, freq: DataFrame, keys, rate: float = 1.0) -> DataFrame:
    """Q with mean rate -sum pi_i q_ii = rate."""
    mean = q.filter("i = j").join(freq.select(*keys, F.col("state").alias("i"), "pi"), [*keys, "i"]).groupBy(*keys).agg(
        (-F.sum(F.col("pi") * F.col("q"))).alias("mean"))
    return q.join(mean, list(keys)).select(*keys, "i", "j", (F.col("q") * rate / F.col("mean")).alias("q"))


def mean_rate(q: DataFrame, freq: DataFrame, keys) -> DataFrame:
    return q.filter("i = j").join(freq.select(*keys, F.col("state").alias("i"), "pi"), [*keys, "i"]).groupBy(*keys).agg(
        (-F.sum(F.col("pi") * F.col("q"))).alias("rate"))


def reversible(q: DataFrame, freq: DataFrame, keys, tol: float = 1e-6) -> DataFrame:
    """Detailed balance pi_i q_ij = pi_j q_ji and zero row sums."""
    flow = q.join(freq.select(*keys, F.col("state").alias("i"), "pi"), [*keys, "i"]).select(
        *keys, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"),
        F.when(F.col("i") < F.col("j"), 1).otherwise(-1).alias("sign"), (F.col("pi") * F.col("q")).alias("f"), "i", "j", "q")
    balance = flow.filter("i <> j").groupBy(*keys, "a", "b").agg(F.abs(F.sum(F.col("sign") * F.col("f"))).alias("gap")).groupBy(*keys).agg(
        F.max("gap").alias("gap"))
    rows = q.groupBy(*keys, "i").agg(F.abs(F.sum("q")).alias("rs")).groupBy(*keys).agg(F.max("rs").alias("rs"))
    return balance.join(rows, list(keys)).select(
        *keys, (F.col("gap") < tol).alias("balanced"), (F.col("rs") < tol).alias("rows_zero"))


# ---- P(t) -----------------------------------------------------------------------

def hky_decay(t, pi: dict, kappa):
    """(e1, eR, eY) of the closed form at distance t, unit mean rate."""
    pr, py = pi["A"] + pi["G"], pi["C"] + pi["T"]
    beta = 1.0 / (2.0 * pr * py + 2.0 * kappa * (pi["A"] * pi["G"] + pi["C"] * pi["T"]))
    return (F.exp(-beta * t), F.exp(-beta * t * (1 + pr * (kappa - 1))), F.exp(-beta * t * (1 + py * (kappa - 1))))


def hky_message(vec: dict, t, pi: dict, kappa) -> dict:
    """P(t) times a vector over A C G T, in closed form: JC, FEL, K2P and HKY by choice of pi and kappa."""
    e1, er, ey = hky_decay(t, pi, kappa)
    mean = sum((pi[b] * vec[b] for b in "ACGT"), F.lit(0.0))
    out = {}
    for b in "ACGT":
        group, eg = ("AG", er) if b in "AG" else ("CT", ey)
        share = sum((pi[c] * vec[c] for c in group), F.lit(0.0)) / sum((pi[c] for c in group), F.lit(0.0))
        out[b] = mean * (1 - e1) + e1 * share + eg * (vec[b] - share)
    return out


def f81_message(vec: dict, t, pi: dict) -> dict:
    """The same for equal exchangeabilities over any alphabet (RY, EQU)."""
    beta = 1.0 / (1.0 - sum((p * p for p in pi.values()), F.lit(0.0)))
    e = F.exp(-beta * t)
    mean = sum((pi[b] * vec[b] for b in pi), F.lit(0.0))
    return {b: mean + e * (vec[b] - mean) for b in pi}


def pt_closed(rows: DataFrame, keys) -> DataFrame:
    """keys, t, i, j, p from pi_A.. and kappa columns; identity for t < 5e-5, pi rows for t > 10."""
    pi = {b: F.col(f"pi_{b}") for b in "ACGT"}
    cells = []
    for j, b in enumerate("ACGT"):
        unit = {c: F.lit(1.0 if c == b else 0.0) for c in "ACGT"}
        col = hky_message(unit, F.col("t"), pi, F.col("kappa"))
        for i, a in enumerate("ACGT"):
            p = F.when(F.col("t") < catalog.SHORT_BRANCH, F.lit(1.0 if i == j else 0.0)).when(
                F.col("t") > catalog.MAX_BRANCH, pi[b]).otherwise(col[a])
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), p.alias("p")))
    return rows.select(*keys, "t", F.inline(F.array(*cells)))


def pt_eigen(q: DataFrame, freq: DataFrame, times: DataFrame, keys) -> DataFrame:
    """keys, t, i, p (row of P(t)) for any reversible Q, by one eigendecomposition per key.

    The cells of one Q (states^2, fixed by the data type) and the distinct t of its key (one per branch) meet in one row
    as arrays, so Q is sent and decomposed once.
    """
    qa = q.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "j", "q"))).alias("cells"))
    pa = freq.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("state", "pi"))).alias("f"))
    ready = qa.join(pa, list(keys)).select(*keys, "cells", F.col("f.pi").alias("pi"))
    rows = ready.join(times.groupBy(*keys).agg(F.sort_array(F.collect_set("t")).alias("t")), list(keys))
    ship(q.sparkSession)
    made = _pt_rows("cells.i", "cells.j", "cells.q", "pi", "t").alias("p")
    out = rows.select(*keys, "t", made).select(*keys, F.explode(F.arrays_zip("t", "p")).alias("z"))
    n = F.sqrt(F.size("z.p")).cast("int")  # P(t) row by row
    return out.select(*keys, F.col("z.t").alias("t"), F.posexplode(F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col("z.p"), i * n + 1, n))).alias("i", "p"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _pt_rows(i: pd.Series, j: pd.Series, q: pd.Series, pi: pd.Series, t: pd.Series) -> pd.Series:
    out = []
    for a, b, v, p, times in zip(i, j, q, pi, t):
        m = np.zeros((len(p), len(p)))
        m[a, b] = v
        out.append(list(transitions(m, np.asarray(p), np.asarray(times)).reshape(len(times), -1)))
    return pd.Series(out)


def transitions(q: np.ndarray, pi: np.ndarray, times: np.ndarray) -> np.ndarray:
    """P(t) of each time, from one decomposition."""
    root = np.sqrt(np.maximum(pi, 1e-300))
    sym = root[:, None] * q / root[None, :]
    lam, u = np.linalg.eigh((sym + sym.T) / 2)
    p = ((u / root[:, None]) * np.exp(lam * times[:, None])[:, None, :]) @ (u * root[:, None]).T
    p[times < catalog.SHORT_BRANCH] = np.eye(len(pi))
    p[times > catalog.MAX_BRANCH] = pi
    return np.maximum(p, 0.0)


def change_counts(q: DataFrame, freq: DataFrame, times: DataFrame, kinds: DataFrame, n_states: int, keys) -> DataFrame:
    """keys, t, kind, changes: expected changes of each kind after time t, sum of pi_i P_ij(t) over its pairs (i, j).

    q: keys, i, j, q (reversible); freq: keys, state, pi (missing states have none); times: keys, t; kinds: i, j, kind, a fixed
    table of pairs of states. A t of 0 or less stands for Q itself. Q is decomposed once a key and P(t) is folded in the row
    that makes it, so a row leaves with a number for each t and kind.
    """
    pairs = kinds.select("i", "j", "kind").filter("kind is not null").distinct().collect()  # n_states^2 at most
    names = sorted({r.kind for r in pairs})
    masks = np.zeros((len(names), n_states, n_states))
    for r in pairs:
        masks[names.index(r.kind), r.i, r.j] = 1.0

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def folded(i: pd.Series, j: pd.Series, v: pd.Series, state: pd.Series, pi: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for a, b, x, at, p, times_ in zip(i, j, v, state, pi, t):
            m, full, times_ = np.zeros((n_states, n_states)), np.zeros(n_states), np.asarray(times_)
            m[a, b] = x
            full[at] = p
            flow = np.where((times_ > 0)[:, None, None], transitions(m, full, times_), m) * full[:, None]
            out.append(np.einsum("tij,kij->tk", flow, masks).ravel())
        return pd.Series(out)

    ship(q.sparkSession)
    cells = q.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "q")).alias("c"))
    pi = freq.groupBy(*keys).agg(F.collect_list(F.struct("state", "pi")).alias("f"))
    rows = cells.join(pi, list(keys)).join(times.groupBy(*keys).agg(F.sort_array(F.collect_set("t")).alias("t")), list(keys))
    made = rows.select(*keys, "t", folded("c.i", "c.j", "c.q", "f.state", "f.pi", "t").alias("x"))
    each = made.select(*keys, F.posexplode("t").alias("o", "t"), "x")
    kind = F.array(*[F.struct(F.lit(n).alias("kind"), F.get("x", F.col("o") * len(names) + k).alias("changes")) for k, n in enumerate(names)])
    return each.select(*keys, "t", F.inline(kind))


# ---- rate classes ---------------------------------------------------------------

SERIES, STEPS = 500, 80


def _gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma of arrays, by its power series: all terms are positive, and SERIES of them are enough for
    x up to about a + 200. From the term 2 x on each is less than half of the one before it."""
    n = min(SERIES, int(2 * x.max(initial=0.0)) + 64)
    terms = np.cumprod(x[..., None] / (a[..., None] + np.arange(1, n)), axis=-1).sum(axis=-1)
    front = np.array([math.exp(-v + s * math.log(v) - math.lgamma(s + 1)) if v > 0 else 0.0 for s, v in zip(a.ravel(), x.ravel())])
    return np.minimum(front.reshape(a.shape) * (1.0 + terms), 1.0)


def gamma_rate_table(alpha: np.ndarray, k: int = 4) -> np.ndarray:
    """Means of k equal-weight classes of gammas with mean 1, a row for each alpha; all 1 beyond the upper bound of alpha.

    The borders of all classes of all rows are found together, by Newton's method on the logarithms: the log of the distribution is
    concave in log x, so steps from below stay below and grow towards the border.
    """
    given = np.asarray(alpha, float)
    a = np.repeat(np.clip(given, catalog.MIN_ALPHA, catalog.MAX_ALPHA)[:, None], k - 1, axis=1)
    share = np.broadcast_to(np.arange(1, k) / k, a.shape)
    lg = np.array([math.lgamma(s + 1) for s in a.ravel()]).reshape(a.shape)
    at = (np.log(share) + lg) / a  # below the border: the first factor of the series alone
    for _ in range(STEPS):
        cdf = np.maximum(_gamma_cdf(a, np.exp(at)), 1e-300)
        step = np.log(share / cdf) * cdf / (a * np.exp(a * at - np.exp(at) - lg))
        at = at + step
        if np.abs(step).max(initial=0.0) < 1e-14:
            break
    part = _gamma_cdf(a + 1, np.exp(at))
    bounds = np.concatenate([np.zeros((len(a), 1)), part, np.ones((len(a), 1))], axis=1)
    rates = np.maximum(1e-12, k * np.diff(bounds, axis=1))
    return np.where((given >= catalog.MAX_ALPHA)[:, None], 1.0, rates)


@lru_cache(4096)
def gamma_rates(alpha: float, k: int = 4) -> tuple:
    """A row of `gamma_rate_table`."""
    return tuple(gamma_rate_table(np.array([alpha]), k)[0].tolist())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def gamma_rates_column(alpha: pd.Series, k: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(alpha), index=alpha.index, dtype=object)
    for n in k.unique():
        rows = (k == n).to_numpy()
        for place, row in zip(alpha.index[rows], gamma_rate_table(alpha[rows].to_numpy(), int(n)).tolist()):
            out.at[place] = row
    return out


def gamma_classes(params: DataFrame, k: int = 4) -> DataFrame:
    """params: keys, alpha -> keys, alpha, class, rate, weight."""
    keys = [c for c in params.columns if c != "alpha"]
    ship(params.sparkSession)
    return params.select(
        *keys, "alpha", F.posexplode(gamma_rates_column("alpha", F.lit(k))).alias("class", "rate")
    ).withColumn("weight", F.lit(1.0 / k))


def rescale_classes(classes: DataFrame, keys, rate: float = 1.0) -> DataFrame:
    """Class rates divided so that their weighted mean is `rate` (a handful of classes per key)."""
    w = Window.partitionBy(*keys)
    mean = F.sum(F.col("rate") * F.col("weight")).over(w) / F.sum("weight").over(w)
    return classes.withColumn("rate", F.col("rate") * rate / mean)


def invariant_likelihood(patterns: DataFrame, freq: DataFrame, alphabet: str = catalog.DNA) -> DataFrame:
    """Per pattern: pi of the sole state, 0 for variable patterns. patterns carries no_change."""
    f = freq.select("family", F.col("state").alias("no_change"), "pi")
    return patterns.join(f, ["family", "no_change"], "left").withColumn(
        "l_invariant", F.coalesce("pi", F.lit(0.0))).drop("pi")


def garbage_likelihood(patterns: DataFrame, freq: DataFrame, alphabet: str = catalog.DNA) -> DataFrame:
    """Per pattern: log of the product of pi over the column; letters are counted on the text."""
    wide = freq.groupBy("family").agg(*[
        F.max(F.when(F.col("state") == i, F.log("pi"))).alias(f"lp{i}") for i in range(len(alphabet))])
    total = sum((S.count_in("pattern", c) * F.coalesce(F.col(f"lp{i}"), F.lit(0.0)) for i, c in enumerate(alphabet)), F.lit(0.0))
    return patterns.join(wide, "family").select(*patterns.columns, total.alias("ln_garbage"))
