"""Registered queries: parsimony, likelihood by levels, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.functions import scalar as S
from aligngrid.operators import aggregate as A
from aligngrid.operators import likelihood as L
from aligngrid.operators import models as M
from aligngrid.operators import pairs as P
from aligngrid.operators import parsimony as Ps
from aligngrid.operators import rank as R
from aligngrid.operators import recode
from aligngrid.operators import trees as T
from aligngrid.plans import fixtures as X
from aligngrid.plans.counting import clean_sites
from aligngrid.plans.pairing import aa_distances, dna_pairs
from aligngrid.plans.recoding import cleaned, rnd
from aligngrid.plans.registry import query
from aligngrid.session import cut
from oracle.common import r, with_

# ---- parsimony --------------------------------------------------------------------

DEPTH = "floor(log2(node + 1))::int"


def fitch_sql():
    out = f"""
e2 as (select *, {DEPTH} depth from edges),
fl as (select e.tree_id, e.family, e.node, e.depth, p.pos,
  coalesce(case ch when 'A' then 1 when 'C' then 2 when 'G' then 4 when 'T' then 8 when '-' then 15 end, 15) st
  from e2 e join (select distinct family, pos from ksites) p on p.family = e.family
  left join ksites s on s.family = e.family and s.seq_id = e.leaf_seq and s.pos = p.pos where leaf_seq is not null)"""
    prev = None
    for d in range(4, 0, -1):
        kids = f"select tree_id, family, node, pos, st from fl where depth = {d}"
        if prev:
            kids += f" union all select tree_id, family, node, pos, st from {prev}"
        out += f""",
f{d - 1} as (select tree_id, family, (node - 1) // 2 node, pos, case when bit_and(st) = 0 then bit_or(st) else bit_and(st) end st,
  (bit_and(st) = 0)::int chg from ({kids}) group by 1, 2, 3, 4)"""
        prev = f"f{d - 1}"
    return out + """,
ss as (select tree_id, family, pos, sum(chg)::bigint score from (""" + " union all ".join(
        f"select tree_id, family, pos, chg from f{d}" for d in range(4)) + """) group by 1, 2, 3),
pid as (select family, pattern, count(*) n, min(pos) pattern_id from cols group by 1, 2),
ps as (select tree_id, s.family, pattern_id, n, score * n score,
  (score + length(pattern) - length(replace(pattern, '-', ''))) * n pen from ss s join pid on pid.family = s.family and pattern_id = pos)"""


def site_scores(spark, sf):
    return Ps.changes(clean_sites(spark, sf), X.edges(spark, sf))


@query("ps_score", with_("patterns edges", "select tree_id, family, sum(score)::bigint score from ss group by 1, 2", fitch_sql()))
def ps_score(spark, sf):
    return Ps.score(site_scores(spark, sf))


def _pattern_scores(spark, sf, gaps):
    pats = A.patterns(clean_sites(spark, sf))
    return Ps.pattern_scores(Ps.site_scores(site_scores(spark, sf)), pats, gaps)


@query("ps_sitewise", with_("patterns edges", """
select tree_id, family, pattern_id, n, score, pen::bigint penalised from ps""", fitch_sql()))
def ps_sitewise(spark, sf):
    pats = A.patterns(clean_sites(spark, sf))
    site = cut(Ps.site_scores(site_scores(spark, sf)))
    plain = Ps.pattern_scores(site, pats)
    pen = Ps.pattern_scores(site, pats, True).select("tree_id", "family", "pattern_id", F.col("score").alias("penalised"))
    return plain.join(pen, ["tree_id", "family", "pattern_id"])


@query("ps_slowest", with_("patterns edges", """
select p.tree_id, p.family, pattern_id, n, p.pen score from ps p join (
 select tree_id, family, pen, coalesce(sum(sites) over (partition by tree_id, family order by pen rows between unbounded preceding and 1 preceding), 0) bef,
   floor(0.4 * tot) lim from (select tree_id, family, pen, sum(n) sites from ps where pen > 0 group by 1, 2, 3)
   join (select tree_id, family, sum(n) tot from ps group by 1, 2) using (tree_id, family)) c
 on c.tree_id = p.tree_id and c.family = p.family and c.pen = p.pen and bef <= lim""", fitch_sql()))
def ps_slowest(spark, sf):
    return Ps.slowest_share(cut(_pattern_scores(spark, sf, True)), 0.4)


@query("ps_limit", with_("patterns edges", "select tree_id, family, pattern_id, n, pen score from ps where pen between 1 and 6", fitch_sql()))
def ps_limit(spark, sf):
    return Ps.limited(_pattern_scores(spark, sf, True), 6)


# ---- likelihood with given parameters ------------------------------------------------

GAMMA = tuple((c, float(f"{x:.6f}"), 0.25) for c, x in enumerate(M.gamma_rates(0.5)))
ONE = ((0, 1.0, 1.0),)
STRETCHED = ((0, 1.01, 1.0),)


class Prepared:
    """Cleaned sites, both fixture trees and nucleotide patterns, stored once for all models of a query."""

    def __init__(self, spark, sf, rooted=True):
        codons = cut(cleaned(spark, sf), merge=False)
        self.sites = recode.codon_sites(codons)
        e = X.edges(spark, sf)
        self.edges = e if rooted else cut(T.unroot(e))
        self.sequences = cut(codons.select("family", "seq_id").distinct(), merge=False)
        self.columns = cut(A.codon_columns(codons), merge=False)
        self.dna = cut(A.patterns_of(self.columns), merge=False)


def setup(prep, states):
    """Patterns and parameters for JC or RY."""
    if states == "RY":
        # columns equal as nucleotides stay equal as R/Y: merge the nucleotide patterns
        pats = prep.dna.groupBy("family", S.to_ry("pattern").alias("pattern")).agg(
            F.sum("n").alias("n"), F.min("pattern_id").alias("pattern_id"))
        r_, y_ = S.count_in("pattern", "R"), S.count_in("pattern", "Y")
        n = pats.groupBy("family").agg(F.sum(r_ * F.col("n")).alias("r"), F.sum(y_ * F.col("n")).alias("y"))
        params = n.select("family", (F.col("r") / (F.col("r") + F.col("y"))).alias("pi_R"),
                          (F.col("y") / (F.col("r") + F.col("y"))).alias("pi_Y"), F.lit(1.0).alias("kappa"))
    else:
        pats = prep.dna
        params = pats.select("family").distinct().select(
            "family", *[F.lit(0.25).alias(f"pi_{b}") for b in "ACGT"], F.lit(1.0).alias("kappa"))
    return pats, params


def site_lnl(prep, states, classes=ONE):
    pats, params = setup(prep, states)
    return pats, L.site_likelihood(pats, prep.edges, prep.sequences, params, states, classes)


def prune_sql(states="ACGT", classes=ONE, tag="", source="ksites", edges="edges", kappa=None, pi=None):
    """CTEs ending in site<tag>(tree_id, family, class, pattern_id, n, lnl) for JC or RY; pi and kappa: a table (family, p0.., kappa)
    of HKY parameters instead."""
    k = range(len(states))
    col = "ch" if states == "ACGT" else "translate(ch, 'AGCT', 'RRYY')"
    if pi is not None:
        own = f"pi as ({pi})"
    elif states == "ACGT":
        own = "pi as (select distinct family, 0.25 p0, 0.25 p1, 0.25 p2, 0.25 p3 from kept)"
    else:
        own = ("pi as (select family, count(*) filter (ch in ('A','G')) / count(*) p0,"
               " count(*) filter (ch in ('C','T')) / count(*) p1 from ksites where ch <> '-' group by 1)")
    cl = ",".join(f"({c},{rt!r}::double,{w!r}::double)" for c, rt, w in classes)
    mean = " + ".join(f"p{i} * v{i}" for i in k)
    if pi is None:
        beta = "1 - (" + " + ".join(f"p{i} * p{i}" for i in k) + ")"
        message = {i: f"({mean}) + exp(-len / ({beta})) * (v{i} - ({mean}))" for i in k}
    else:
        beta = "1.0 / (2 * (p0 + p2) * (p1 + p3) + 2 * kappa * (p0 * p2 + p1 * p3))"
        message = {}
        for i in k:
            x, y = (0, 2) if i in (0, 2) else (1, 3)
            share = f"(p{x} * v{x} + p{y} * v{y}) / (p{x} + p{y})"
            grown = f"exp(-len * ({beta}) * (1 + (p{x} + p{y}) * (kappa - 1)))"
            message[i] = f"({mean}) * (1 - exp(-len * ({beta}))) + exp(-len * ({beta})) * ({share}) + {grown} * (v{i} - {share})"
    out = f"""
{own.replace('pi as', f'pi{tag} as', 1)},
pc{tag} as (select family, pos, string_agg({col}, '' order by seq_id) pattern from {source} group by 1, 2),
pt{tag} as (select family, pattern, count(*) n, min(pos) pattern_id from pc{tag} group by 1, 2),
cl{tag} as (select * from (values {cl}) t(class, rate, weight)),
rk{tag} as (select family, seq_id, row_number() over (partition by family order by seq_id) rk from kept),
ee{tag} as (select e.tree_id, e.family, class, node, {DEPTH} depth, length * rate len, leaf_seq, rk, p.* exclude (family)
  from {edges} e cross join cl{tag} join pi{tag} p on p.family = e.family
  left join rk{tag} on rk{tag}.family = e.family and rk{tag}.seq_id = leaf_seq),
lf{tag} as (select e.tree_id, e.family, class, node, depth, pattern_id, """ + ", ".join(
        f"case when rk is null or substr(pattern, rk::int, 1) in ('-', '{s}') then 1.0 else 0.0 end::double v{i}" for i, s in enumerate(states)
    ) + f""" from ee{tag} e join pt{tag} using (family) where leaf_seq is not null)"""
    prev = None
    for d in range(4, 0, -1):
        kids = f"select tree_id, family, class, node, pattern_id, {', '.join(f'v{i}' for i in k)} from lf{tag} where depth = {d}"
        if prev:
            kids += f" union all select tree_id, family, class, node, pattern_id, {', '.join(f'v{i}' for i in k)} from {prev}"
        out += f""",
l{d - 1}{tag} as (select x.tree_id, x.family, x.class, (x.node - 1) // 2 node, pattern_id, """ + ", ".join(
            f"product({message[i]}) v{i}" for i in k
        ) + f""" from ({kids}) x join ee{tag} e on e.tree_id = x.tree_id and e.family = x.family and e.class = x.class and e.node = x.node
  group by 1, 2, 3, 4, 5)"""
        prev = f"l{d - 1}{tag}"
    out += f""",
site{tag} as (select l.tree_id, l.family, class, l.pattern_id, n, ln({mean}) lnl from l0{tag} l join pi{tag} using (family)
  join pt{tag} on pt{tag}.family = l.family and pt{tag}.pattern_id = l.pattern_id)"""
    return out.strip()


VALS = ["v0", "v1", "v2", "v3"]


@query("lnl_partials", with_("clean edges", "select tree_id, family, node, pattern_id, " + ", ".join(
    f"case when v{i} > 0 then {r(f'ln(v{i})', 4)} end ln_{s}" for i, s in enumerate("ACGT"))
    + " from (" + " union all ".join(f"select tree_id, family, node, pattern_id, v0, v1, v2, v3 from {t}" for t in ("lf", "l3", "l2", "l1", "l0"))
    + ") where true", prune_sql()))
def lnl_partials(spark, sf):
    prep = Prepared(spark, sf)
    pats, params = setup(prep, "ACGT")
    parts = L.partials(pats, prep.edges, prep.sequences, params, "ACGT")
    ten = F.log(F.lit(10.0))
    return parts.select("tree_id", "family", "node", "pattern_id", *[
        F.when(F.col(f"l_{s}") > 0, rnd(F.log(f"l_{s}") - F.col("scale") * ten, 4)).alias(f"ln_{s}") for s in "ACGT"])


@query("lnl_sitewise", with_("clean edges", """
select 'JC' model, tree_id, family, pattern_id, """ + r("lnl", 4) + """ lnl from sitej
union all select 'RY', tree_id, family, pattern_id, """ + r("lnl", 4) + " from sitey", prune_sql(tag="j") + ",\n" + prune_sql("RY", tag="y")))
def lnl_sitewise(spark, sf):
    out, prep = None, Prepared(spark, sf)
    for name, states in (("JC", "ACGT"), ("RY", "RY")):
        site = site_lnl(prep, states)[1].select(
            F.lit(name).alias("model"), "tree_id", "family", "pattern_id", rnd(F.col("lnl"), 4).alias("lnl"))
        out = site if out is None else out.unionByName(site)
    return out


@query("lnl_mixture", with_("clean edges", """
select tree_id, family, pattern_id, """ + r("ln(sum(weight * exp(lnl)))", 4) + """ lnl from site join cl using (class) group by 1, 2, 3""",
    prune_sql(classes=GAMMA)))
def lnl_mixture(spark, sf):
    site = site_lnl(Prepared(spark, sf), "ACGT", GAMMA)[1]
    weights = spark.createDataFrame([(c, w) for c, _, w in GAMMA], "class int, weight double")
    return L.mixture(site, F.broadcast(weights)).select("tree_id", "family", "pattern_id", rnd(F.col("lnl"), 4).alias("lnl"))


def totals_sql(states, classes, tag):
    return ("select tree_id, family, sum(n * lnl) lnl from (select tree_id, family, pattern_id, n, ln(sum(weight * exp(lnl))) lnl"
            f" from site{tag} join cl{tag} using (class) group by 1, 2, 3, 4) group by 1, 2")


ALL4 = ",\n".join([prune_sql("RY", ONE, "a"), prune_sql("RY", GAMMA, "b"), prune_sql("ACGT", ONE, "c"), prune_sql("ACGT", GAMMA, "d")])
FITS = ALL4 + """,
tl as (select tree_id, family, sum(length) tree_length from edges group by 1, 2),
fits as (""" + " union all ".join(
    f"select tree_id, family, '{n}' \"name\", '{t}' data_type, lnl ori_lnl, {k} k from ({totals_sql(s, c, g)})"
    for n, t, s, c, g, k in (("RY", "RY", "RY", ONE, "a", 3), ("RY+4dG", "RY", "RY", GAMMA, "b", 4),
                             ("JC", "DNA", "ACGT", ONE, "c", 0), ("JC+4dG", "DNA", "ACGT", GAMMA, "d", 1))) + """),
adj as (select family, 'RY' data_type, sum(n * ln(n / nc)) adjust from (
 select *, sum(n) over (partition by family, ch in ('A','G')) nc from (
  select family, ch, count(*) n from ksites where ch <> '-' group by 1, 2)) group by 1),
res as (select tree_id, family, "name", data_type, tree_length, ori_lnl, case when adjust is null then 'NA' else 'EMPIRICAL' end correction,
  ori_lnl + coalesce(adjust, 0) lnl, k n_par, 2 * (k - (ori_lnl + coalesce(adjust, 0))) aic from fits
  join tl using (tree_id, family) left join adj using (family, data_type)),
del as (select *, aic - min(aic) over (partition by tree_id, family) delta_aic from res)"""


def given_fits(spark, sf, prep=None):
    """RY, RY+4dG, JC and JC+4dG on the given trees: tree_id, family, name, data_type, tree_length, ori_lnl, k."""
    length = T.tree_length(X.edges(spark, sf))
    out, prep = None, prep or Prepared(spark, sf)
    for core, data_type, states, k in (("RY", "RY", "RY", 3), ("JC", "DNA", "ACGT", 0)):
        # both rate forms share one pass: class 4 is the single rate, 0..3 the gamma classes
        pats, site = site_lnl(prep, states, GAMMA + ((4, 1.0, 1.0),))
        site = cut(site, merge=False)
        weights = F.broadcast(spark.createDataFrame([(c, w) for c, _, w in GAMMA], "class int, weight double"))
        for name, rows, kk in (
            (core, site.filter("class = 4").drop("class"), k),
            (core + "+4dG", L.mixture(site.filter("class < 4"), weights), k + 1),
        ):
            one = L.total(rows, pats).select(
                "tree_id", "family", F.lit(name).alias("name"), F.lit(data_type).alias("data_type"), F.col("lnl").alias("ori_lnl"),
                F.lit(kk).alias("k"))
            out = one if out is None else out.unionByName(one)
    return out.join(length, ["tree_id", "family"])


def results(spark, sf, numbers=False):
    prep = Prepared(spark, sf)
    adj = A.adjust_ry(prep.sites).select("family", F.lit("RY").alias("data_type"), F.col("empirical").alias("adjust"))
    fits = given_fits(spark, sf, prep)
    return R.results(numbered(fits) if numbers else fits, adj)


def numbered(fits):
    """Fits with the catalogue number of their model."""
    numbers = F.create_map(*[F.lit(x) for row in catalog.model_rows() for x in (row[1], row[0])])
    return fits.withColumn("model_no", numbers[F.col("name")])


def rounded(df):
    return df.select(*[rnd(F.col(c), 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


COLS = ", ".join(["tree_id", "family", '"name"', "data_type", "correction", "n_par"] + [f"{r(c, 4)} {c}" for c in ("tree_length", "ori_lnl", "lnl", "aic")])


@query("lnl_total", with_("clean edges", "select tree_id, family, \"name\", data_type, k, " + r("ori_lnl", 4) + " ori_lnl, " + r("tree_length", 4)
    + " tree_length from fits join tl using (tree_id, family)", FITS))
def lnl_total(spark, sf):
    return rounded(given_fits(spark, sf))


@query("rk_aic", with_("clean edges", f"select {COLS} from res", FITS))
def rk_aic(spark, sf):
    return rounded(results(spark, sf))


@query("rk_delta", with_("clean edges", f"select {COLS}, {r('delta_aic', 4)} delta_aic from del", FITS))
def rk_delta(spark, sf):
    return rounded(R.delta(results(spark, sf)))


@query("rk_best", with_("clean edges", f"""
select 'all' per, {COLS}, {r('delta_aic', 4)} delta_aic from del where true
 qualify row_number() over (partition by tree_id, family order by aic, "name") = 1
union all select 'type', {COLS}, {r('delta_aic', 4)} delta_aic from del where true
 qualify row_number() over (partition by tree_id, family, data_type order by aic, "name") = 1""", FITS))
def rk_best(spark, sf):
    res = cut(R.delta(results(spark, sf)))
    both = R.best(res, ("tree_id", "family")).withColumn("per", F.lit("all")).unionByName(
        R.best(res, ("tree_id", "family", "data_type")).withColumn("per", F.lit("type")))
    return rounded(both)


@query("rk_bounds", with_("pairs", """
select family, bool_or(d <= 1e-6 or d >= 20 - 1e-6) at_bound from (select family,
 case when n_both = 0 or 1 - n_diff / n_both / 0.75 <= 0 then 20.0 else greatest(0, -0.75 * ln(1 - n_diff / n_both / 0.75)) end d from pairs) group by 1"""))
def rk_bounds(spark, sf):
    d = P.poisson(dna_pairs(spark, sf), 4)
    return R.on_bound(d.select("family", F.col("d").alias("value"), F.lit(0.0).alias("lo"), F.lit(20.0).alias("hi")))


@query("rk_top_trees", with_("edges", """
select family, rank, score from (select family, (node * 53 + family) % 17 score,
 row_number() over (partition by family order by (node * 53 + family) % 17 desc) rank from edges) where rank <= 5"""))
def rk_top_trees(spark, sf):
    return R.top_trees(X.marks(spark, sf), 5, seed=7).select("family", "rank", "score")


@query("rk_consistency", with_("clean edges", "select tree_id, family, " + r("a.lnl", 3) + f""" lnl, abs(a.lnl - b.lnl) <= 1e-3 same,
 abs(a.lnl - c.lnl) <= 1e-3 same_stretched from ({totals_sql('ACGT', ONE, 'c')}) a
 join (select tree_id, family, lnl from ({totals_sql('ACGT', ONE, 'c')})) b using (tree_id, family)
 join ({totals_sql('ACGT', STRETCHED, 'z')}) c using (tree_id, family)""",
    prune_sql("ACGT", ONE, "c") + ",\n" + prune_sql("ACGT", STRETCHED, "z")))
def rk_consistency(spark, sf):
    """The likelihood must not depend on where a reversible model's tree is rooted; longer branches must show."""
    keys = ["tree_id", "family"]
    prep = Prepared(spark, sf)
    both = [L.total(rows.drop("class"), pats).select(*keys, "lnl") for pats, rows in (
        site_lnl(prep, "ACGT"), site_lnl(Prepared(spark, sf, rooted=False), "ACGT"), site_lnl(prep, "ACGT", STRETCHED))]
    one = R.consistent(both[0], both[1], keys).select(*keys, "lnl", "same")
    longer = R.consistent(both[0], both[2], keys).select(*keys, F.col("same").alias("same_stretched"))
    return one.join(longer, keys).select(*keys, rnd(F.col("lnl"), 3).alias("lnl"), "same", "same_stretched")


@query("st_union_models", with_("clean edges", "select tree_id, family, data_type, count(*) n, " + r("min(ori_lnl)", 4) + " lowest from fits group by 1, 2, 3", FITS))
def st_union_models(spark, sf):
    fits = cut(given_fits(spark, sf))
    ry, nt = fits.filter("data_type = 'RY'"), fits.filter("data_type = 'DNA'")
    return ry.unionByName(nt).groupBy("tree_id", "family", "data_type").agg(
        F.count("*").alias("n"), rnd(F.min("ori_lnl"), 4).alias("lowest"))


@query("st_leaf_sets", with_("splits clean", """
select family, a.node, array_to_string([x for x in a.under if list_contains(b.under, x)], ',') shared,
 array_to_string([x for x in a.under if not list_contains(b.under, x)], ',') only_a,
 array_to_string(list_sort(list_distinct(list_concat(a.under, b.under))), ',') either,
 len([x for x in a.under if not list_contains(b.under, x)]) = 0 a_in_b
from un a join un b using (family, node) where a.tree_id = 0 and b.tree_id = 1"""))
def st_leaf_sets(spark, sf):
    b = T.below(T.closure(X.edges(spark, sf))).join(
        X.edges(spark, sf).select("tree_id", "family", "node"), ["tree_id", "family", "node"], "left_semi")
    sets = b.groupBy("tree_id", "family", "node").agg(F.sort_array(F.collect_list("leaf_seq")).alias("s"))
    one = sets.filter("tree_id = 0").select("family", "node", F.col("s").alias("a"))
    two = sets.filter("tree_id = 1").select("family", "node", F.col("s").alias("b"))
    text = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x.cast("string")), ",")
    return one.join(two, ["family", "node"]).select(
        "family", "node", text(F.array_intersect("a", "b")).alias("shared"), text(F.array_except("a", "b")).alias("only_a"),
        text(F.array_union("a", "b")).alias("either"), (F.size(F.array_except("a", "b")) == 0).alias("a_in_b"))


# ---- codon-position partition ---------------------------------------------------------

RATES3 = ((0, 0.6, 1.0), (1, 0.4, 1.0), (2, 2.0, 1.0))
# position -> parameter set, tree set: the third position has a model of its own, the second a tree of its own
MODEL_OF, TREE_OF = {0: 0, 1: 0, 2: 2}, {0: 0, 1: 1, 2: 0}
LONGER = {0: 1.0, 1: 0.5}  # branches of the tree sets


def position_frequencies(sites):
    """family, pos, pi_A..: base frequencies of each codon position."""
    n = sites.filter(F.col("ch").isin(*catalog.DNA)).groupBy("family", F.expr("pos % 3").alias("pos")).agg(
        *[F.count_if(F.col("ch") == b).alias(f"n_{b}") for b in catalog.DNA], F.count("*").alias("n"))
    return n.select("family", "pos", *[(F.col(f"n_{b}") / F.col("n")).alias(f"pi_{b}") for b in catalog.DNA])


def _parts_sql():
    """Each position as an alignment of its own (family * 3 + position) under its set's frequencies, kappa and tree."""
    average = ", ".join(f"avg(p{i}) p{i}" for i in range(4))
    pos = ", ".join(f"count(*) filter (ch = '{b}') / count(*) p{i}" for i, b in enumerate("ACGT"))
    model = "case k " + " ".join(f"when {p} then {m}" for p, m in MODEL_OF.items()) + " end"
    grown = "case p " + " ".join(f"when {p} then {LONGER[t]}" for p, t in TREE_OF.items()) + " end"
    return f"""
fq as (select family, pos % 3 k, {pos} from ksites where ch <> '-' group by 1, 2),
fm as (select family, {model} m, {average} from fq group by 1, 2),
ks3 as (select family * 3 + pos % 3 family, seq_id, pos, ch from ksites),
ed3 as (select tree_id, family * 3 + p family, node, parent, "length" * {grown} "length", leaf_seq from edges cross join (select unnest(range(0, 3)) p))"""


def _own_sql():
    """`prune_sql` over the positions as alignments."""
    model = "case k " + " ".join(f"when {p} then {m}" for p, m in MODEL_OF.items()) + " end"
    pi = (f"select f.family * 3 + k family, m.p0, m.p1, m.p2, m.p3, 1.0 + m.m kappa from fq f join fm m on m.family = f.family and m.m = {model}")
    return prune_sql(tag="o", source="ks3", edges="ed3", pi=pi).replace("from kept)", "from (select k.family * 3 + p family, seq_id from kept k cross join (select unnest(range(0, 3)) p)))")


@query("lnl_codon_sites", with_("clean edges", """
select a.tree_id, family, """ + r("a.lnl", 4) + " own_rates, " + r("b.lnl + m.lnl", 4) + " third_left_out, " + r("o.lnl", 4) + " own_models, "
    + r("p.lnl + m.lnl", 4) + """ own_left_out from
 (select tree_id, x.family, sum(lnl) lnl from pc x join pt using (family, pattern) join site s on s.family = x.family and s.pattern_id = pt.pattern_id
   and s.class = x.pos % 3 group by 1, 2) a
 join (select tree_id, x.family, sum(lnl) lnl from pc x join pt using (family, pattern) join site s on s.family = x.family and s.pattern_id = pt.pattern_id
   and s.class = x.pos % 3 where x.pos % 3 < 2 group by 1, 2) b using (tree_id, family)
 join (select tree_id, family // 3 family, sum(n * lnl) lnl from siteo group by 1, 2) o using (tree_id, family)
 join (select tree_id, family // 3 family, sum(n * lnl) lnl from siteo where family % 3 < 2 group by 1, 2) p using (tree_id, family)
 join (select family, sum(n * ln(n / nc)) lnl from (select *, sum(n) over (partition by family) nc from (
   select family, ch, count(*) n from ksites where ch <> '-' and pos % 3 = 2 group by 1, 2)) group by 1) m using (family)""",
    prune_sql(classes=RATES3) + "," + _parts_sql() + ",\n" + _own_sql()))
def lnl_codon_sites(spark, sf):
    from aligngrid.operators import partition as Pa

    prep = Prepared(spark, sf)
    sites, keys = prep.sites, ["tree_id", "family"]
    pats, site = site_lnl(prep, "ACGT", RATES3)
    site = cut(site, merge=False)
    of_site = cut(A.site_pattern(prep.columns, pats), merge=False)
    missing = cut(A.adjust_missing(sites.filter("pos % 3 = 2")), merge=False)
    own = Pa.codon_partition(site, of_site, {0: 0, 1: 1, 2: 2}).withColumnRenamed("lnl", "own_rates")
    left = Pa.codon_partition(site, of_site, {0: 0, 1: 1}, missing).withColumnRenamed("lnl", "third_left_out")
    # a model and a tree for each set of positions
    freq = cut(position_frequencies(sites), merge=False)
    kappas = F.create_map(*[F.lit(x) for m in sorted(set(MODEL_OF.values())) for x in (m, 1.0 + m)])
    grown = F.create_map(*[F.lit(x) for t, z in LONGER.items() for x in (t, z)])
    edges = prep.edges.withColumn("tree_set", F.explode(F.array(*map(F.lit, LONGER)))).withColumn(
        "length", F.col("length") * grown[F.col("tree_set")])
    parts = []
    for model_of, tree_of in ((MODEL_OF, TREE_OF), ({0: 0, 1: 0}, {0: 0, 1: 1})):
        params = Pa.shared_frequencies(freq, model_of).withColumn("kappa", kappas[F.col("model_set")])
        parts.append(Pa.own_likelihood(sites, edges, params, model_of, tree_of, missing if len(model_of) < 3 else None,
                                       cols=prep.columns, sequences=prep.sequences))
    return own.join(left, keys).join(parts[0].withColumnRenamed("lnl", "own_models"), keys).join(
        parts[1].withColumnRenamed("lnl", "own_left_out"), keys).select(
        *keys, *[rnd(F.col(c), 4).alias(c) for c in ("own_rates", "third_left_out", "own_models", "own_left_out")])
