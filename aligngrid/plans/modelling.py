"""Registered queries: rate matrices, P(t), rate classes, sums over Q."""

from __future__ import annotations

from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.operators import aggregate as A
from aligngrid.operators import clean
from aligngrid.operators import models as M
from aligngrid.operators import pairs as P
from aligngrid.operators import recode
from aligngrid.plans import fixtures as X
from aligngrid.plans.counting import EQM, F1, clean_sites
from aligngrid.plans.recoding import cleaned, patterns, rnd
from aligngrid.plans.registry import query
from oracle.common import r, with_

OMEGA, OMEGA_R = 0.4, 0.2


def kappa(spark, sf):
    return A.kappa_from_columns(clean_sites(spark, sf))


def base_freq(sites):
    """family, state, pi over the four bases."""
    n = A.nucleotide_counts(sites)
    total = sum((F.col(f"n_{b}") for b in "ACGT"), F.lit(0))
    return n.select("family", F.inline(F.array(*[
        F.struct(F.lit(i).alias("state"), (F.col(f"n_{b}") / total).alias("pi")) for i, b in enumerate("ACGT")])))


def aa_freq(codons):
    """family, state, pi over 20 amino acids, observed, with one added to each count."""
    n = codons.filter("aa is not null").groupBy("family").agg(*[F.count_if(F.col("aa") == i).alias(f"n{i}") for i in range(20)])
    total = sum((F.col(f"n{i}") for i in range(20)), F.lit(20))
    return n.select("family", F.inline(F.array(*[
        F.struct(F.lit(i).alias("state"), ((F.col(f"n{i}") + 1) / total).alias("pi")) for i in range(20)])))


def estimated(cells, families, n_states):
    """Exchangeabilities from the data: pairs that differ as (i, j), plus one."""
    every = families.select("family", F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n_states) for j in range(i + 1, n_states)])))
    return every.join(M.exchange_counts(cells), ["family", "i", "j"], "left").select(
        "family", "i", "j", (F.coalesce("n", F.lit(0)) + 1).cast("double").alias("s"))


def dna_q(spark, sf):
    """family, model, i, j, q for the five nucleotide models, and their frequencies."""
    sites = clean_sites(spark, sf)
    k = kappa(spark, sf)
    cells = P.dna_cells(sites)
    ex = M.dna_exchange(k, estimated(cells, k.select("family"), 4))
    obs = base_freq(sites)
    models = F.array(*[F.lit(m) for m in catalog.NT_MODELS])
    freq = obs.select("family", F.explode(models).alias("model"), "state", "pi").withColumn(
        "pi", F.when(F.col("model").isin("JC", "K2P"), 0.25).otherwise(F.col("pi")))
    return M.q_matrix(ex, freq, ["family", "model"]), freq


KAPPA = """
kap as (select family, case when sum(n_diff - n_ts) > 0 then 2 * sum(n_ts) / sum(n_diff - n_ts) else 2.5 end kappa from pairs group by 1),
bi as (select * from (values (0,'A'),(1,'C'),(2,'G'),(3,'T')) t(s, b)),
obs as (select k.family, s state, count(x.pos) / sum(count(x.pos)) over (partition by k.family) pi from kap k cross join bi
  left join ksites x on x.family = k.family and x.ch = b group by 1, 2)"""
DNAQ = KAPPA + """,
ex as (select a.family, x.s i, y.s j, count(*) n from ksites a join ksites b on a.family = b.family and a.pos = b.pos and a.seq_id < b.seq_id
  join bi x on x.b = least(a.ch, b.ch) join bi y on y.b = greatest(a.ch, b.ch) where a.ch <> b.ch group by 1, 2, 3),
mo as (select * from (values ('JC'),('FEL'),('K2P'),('HKY'),('REV')) t(model)),
sx as (select k.family, model, x.s i, y.s j, case when model in ('K2P','HKY') and (x.s, y.s) in ((0,2),(1,3)) then kappa
   when model = 'REV' then (coalesce(n, 0) + 1) / (select coalesce(max(n), 0) + 1 from ex e where e.family = k.family and e.i = 2 and e.j = 3)
   else 1.0 end s from kap k cross join mo cross join bi x join bi y on x.s < y.s
   left join ex on ex.family = k.family and ex.i = x.s and ex.j = y.s),
fr as (select family, model, state, case when model in ('JC','K2P') then 0.25 else pi end pi from obs cross join mo),
off as (select u.family, u.model, u.i, u.j, s * pi q from (select family, model, i, j, s from sx union all select family, model, j, i, s from sx) u
  join fr on fr.family = u.family and fr.model = u.model and fr.state = u.j),
q as (select * from off union all select family, model, i, i, -sum(q) from off group by 1, 2, 3),
rate as (select q.family, q.model, -sum(pi * q) rate from q join fr on fr.family = q.family and fr.model = q.model and state = i where i = j group by 1, 2)"""


@query("md_q_dna", with_("pairs", "select family, model, i, j, " + r("q") + " q from q", DNAQ))
def md_q_dna(spark, sf):
    return dna_q(spark, sf)[0].withColumn("q", rnd(F.col("q")))


@query("md_scale", with_("pairs", "select family, model, i, j, " + r("q / rate") + " q, " + r("rate") + " rate from q join rate using (family, model)", DNAQ))
def md_scale(spark, sf):
    q, freq = dna_q(spark, sf)
    keys = ["family", "model"]
    return M.scale(q, freq, keys).join(M.mean_rate(q, freq, keys), keys).select(
        *keys, "i", "j", rnd(F.col("q")).alias("q"), rnd(F.col("rate")).alias("rate"))


SKEWED = """,
qq as (select * from q union all select family, 'skewed', i, j, case when i = 0 and j = 1 then 2 * q else q end from q where model = 'REV'),
fq as (select * from fr union all select family, 'skewed', state, pi from fr where model = 'REV'),
gap as (select a.family, a.model, max(abs(fa.pi * a.q - fb.pi * b.q)) gap from qq a
  join qq b on b.family = a.family and b.model = a.model and b.i = a.j and b.j = a.i
  join fq fa on fa.family = a.family and fa.model = a.model and fa.state = a.i
  join fq fb on fb.family = a.family and fb.model = a.model and fb.state = a.j where a.i < a.j group by 1, 2),
row_sum as (select family, model, max(abs(s)) s from (select family, model, i, sum(q) s from qq group by 1, 2, 3) group by 1, 2)"""


@query("md_reversible", with_("pairs", "select family, model, gap < 1e-6 balanced, s < 1e-6 rows_zero from gap join row_sum using (family, model)",
    DNAQ + SKEWED))
def md_reversible(spark, sf):
    """The five models are reversible; one of them with a single rate doubled is not."""
    q, freq = dna_q(spark, sf)
    rev = q.filter("model = 'REV'").withColumn("model", F.lit("skewed"))
    skewed = rev.withColumn("q", F.when((F.col("i") == 0) & (F.col("j") == 1), 2 * F.col("q")).otherwise(F.col("q")))
    freqs = freq.unionByName(freq.filter("model = 'REV'").withColumn("model", F.lit("skewed")))
    return M.reversible(q.unionByName(skewed.select(*q.columns)), freqs, ["family", "model"])


AAF = """
ai as (select unnest(range(0, 20)) s),
nf as (select f.family, s state, (count(k.aa) + 1) / sum(count(k.aa) + 1) over (partition by f.family) pi
  from (select distinct family from kept) f cross join ai left join kcodons k on k.family = f.family and k.aa = s group by 1, 2)"""
AAQ = AAF + """,
ex as (select a.family, least(a.aa, b.aa) i, greatest(a.aa, b.aa) j, count(*) n from kcodons a join kcodons b
  on a.family = b.family and a.cpos = b.cpos and a.seq_id < b.seq_id where a.aa <> b.aa group by 1, 2, 3),
sx as (select f.family, m.model, x.s i, y.s j, case when m.model = 'EQU' then 1.0 else coalesce(n, 0) + 1 end::double s
  from (select distinct family from kept) f cross join (values ('EQU'),('EST'),('EST+F')) m(model) cross join ai x join ai y on x.s < y.s
  left join ex on ex.family = f.family and ex.i = x.s and ex.j = y.s),
off as (select u.family, u.model, u.i, u.j, s * case when u.model = 'EST+F' then pi else 0.05 end q
  from (select family, model, i, j, s from sx union all select family, model, j, i, s from sx) u
  join nf on nf.family = u.family and nf.state = u.j)"""


@query("md_q_aa", with_("clean", """
select family, model, i, j, """ + r("q", 4) + " q from off union all select family, model, i, i, " + r("-sum(q)", 4) + " from off group by 1, 2, 3", AAQ))
def md_q_aa(spark, sf):
    codons = cleaned(spark, sf)
    obs = aa_freq(codons)
    est = estimated(P.aa_cells(codons), obs.select("family").distinct(), 20)
    kinds = F.array(*map(F.lit, ("EQU", "EST", "EST+F")))
    ex = est.select("family", F.explode(kinds).alias("model"), "i", "j", "s").withColumn(
        "s", F.when(F.col("model") == "EQU", 1.0).otherwise(F.col("s")))
    freq = obs.select("family", F.explode(kinds).alias("model"), "state", "pi").withColumn(
        "pi", F.when(F.col("model") == "EST+F", F.col("pi")).otherwise(0.05))
    return M.q_matrix(ex, freq, ["family", "model"]).withColumn("q", rnd(F.col("q"), 4))


def codon_pi(spark, sf):
    """family, eqm, sense, pi for the four frequency forms."""
    return A.codon_eqm(cleaned(spark, sf)).select("family", "eqm", "sense", "pi")


def codon_params(spark, sf):
    return kappa(spark, sf).select("family", "kappa", F.lit(OMEGA).alias("omega"), F.lit(OMEGA_R).alias("omega_r"))


STEPS = ",\nsteps as (select * from (values " + ",".join(str(s) for s in M.codon_steps()) + ") t(i, j, ts, aa1, aa2, diff))"


def codon_q_sql(omega):
    return KAPPA + "," + EQM + STEPS + f""",
off as (select k.family, eqm, i, j, aa1, aa2, case when ts = 1 then kappa else 1.0 end * case when aa1 <> aa2 then {omega} else 1.0 end * pi q
  from steps join eqm e on e.sense = j join kap k on k.family = e.family),
q as (select family, eqm, i, j, q from off union all select family, eqm, i, i, -sum(q) from off group by 1, 2, 3)"""


def codon_q(spark, sf, radical=None):
    return M.q_codon(codon_pi(spark, sf), codon_params(spark, sf), radical=radical)


@query("md_q_codon", with_("pairs clean", "select family, eqm, i, j, " + r("q") + " q from q", codon_q_sql(str(OMEGA))))
def md_q_codon(spark, sf):
    return codon_q(spark, sf).withColumn("q", rnd(F.col("q")))


KIND = "(greatest(aa1, aa2) * 7 + least(aa1, aa2) * 3) % 2"


@query("md_q_drdc", with_("pairs clean", "select family, eqm, i, j, " + r("q") + " q from q",
    codon_q_sql(f"case when {KIND} = 1 then {OMEGA_R} else {OMEGA} end")))
def md_q_drdc(spark, sf):
    return codon_q(spark, sf, X.radical(spark)).withColumn("q", rnd(F.col("q")))


@query("md_q_codon_emp", with_("clean", """
select family, kind, i, j, """ + r("q", 4) + " q from off union all select family, kind, i, i, " + r("-sum(q)", 4) + " from off group by 1, 2, 3",
    EQM + STEPS + """,
ex as (select a.family, least(a.sense, b.sense) i, greatest(a.sense, b.sense) j, count(*) n from kcodons a join kcodons b
  on a.family = b.family and a.cpos = b.cpos and a.seq_id < b.seq_id where a.sense <> b.sense group by 1, 2, 3),
both2 as (select family, i, j, n from ex union all select family, j, i, n from ex),
off as (select x.family, 'unrestricted' kind, i, j, x.n * freq q from both2 x join f64 f on f.family = x.family and f.sense = x.j
  union all select x.family, 'restricted', x.i, x.j, x.n * freq from both2 x join steps s on s.i = x.i and s.j = x.j
  join f64 f on f.family = x.family and f.sense = x.j)"""))
def md_q_codon_emp(spark, sf):
    codons = cleaned(spark, sf)
    cells = codons.select("family", "seq_id", F.col("cpos").alias("pos"), F.col("sense").alias("state"))
    ex = M.exchange_counts(cells).select("family", "i", "j", F.col("n").cast("double").alias("s"))
    pi = A.codon_f64(codons).select("family", F.col("sense").alias("state"), F.col("freq").alias("pi"))
    out = None
    for kind, restricted in (("unrestricted", False), ("restricted", True)):
        q = M.q_codon_empirical(ex, pi, ["family"], restricted).withColumn("kind", F.lit(kind))
        out = q if out is None else out.unionByName(q)
    return out.withColumn("q", rnd(F.col("q"), 4))


@query("md_pt", with_("pairs edges", "select form, tree_id, family, node, i, j, " + r("""case when t < 5e-5 then (i = j)::int when t > 10 then pj
  else pj * (1 - e1) + (case when gi = gj then pj / pg * e1 + ((i = j)::int - pj / pg) * eg else 0 end) end""") + """ p from (
 select *, exp(-beta * t) e1, exp(-beta * t * (1 + pg * (kappa - 1))) eg from (
  select form, tree_id, e.family, node, length t, x.s i, y.s j, x.s % 2 gi, y.s % 2 gj, f.pi pj, kappa,
   (select sum(pi) from obs o where o.family = e.family and o.state % 2 = x.s % 2) pg,
   1.0 / (2 * w.pr * w.py + 2 * kappa * (w.pag + w.pct)) beta
  from edges e cross join (values ('closed'), ('eigen')) v(form) cross join bi x cross join bi y join obs f on f.family = e.family and f.state = y.s join kap k on k.family = e.family
  join (select family, sum(case when state % 2 = 0 then pi else 0 end) pr, sum(case when state % 2 = 1 then pi else 0 end) py,
    product(case when state % 2 = 0 then pi else 1 end) pag, product(case when state % 2 = 1 then pi else 1 end) pct from obs group by 1) w
   on w.family = e.family))""", KAPPA))
def md_pt(spark, sf):
    n = A.nucleotide_counts(clean_sites(spark, sf))
    total = sum((F.col(f"n_{b}") for b in "ACGT"), F.lit(0))
    params = n.select("family", *[(F.col(f"n_{b}") / total).alias(f"pi_{b}") for b in "ACGT"]).join(kappa(spark, sf), "family")
    keys = ["tree_id", "family", "node"]
    t = X.edges(spark, sf).select(*keys, F.col("length").alias("t"))
    closed = M.pt_closed(t.join(params, "family"), keys).withColumn("form", F.lit("closed"))
    # the same from one decomposition a family, for any reversible Q
    q, freq = (x.filter("model = 'HKY'").drop("model") for x in dna_q(spark, sf))
    rows = M.pt_eigen(M.scale(q, freq, ["family"]), freq, t.select("family", "t").distinct(), ["family"])
    eigen = rows.join(t, ["family", "t"]).select(*keys, "i", F.posexplode("p").alias("j", "p")).withColumn("form", F.lit("eigen"))
    return closed.select("form", *keys, "i", "j", "p").unionByName(eigen.select("form", *keys, "i", "j", "p")).withColumn("p", rnd(F.col("p")))


def _gamma_sql(cuts=3, halvings=60, terms=200):
    """CTEs ending in gr(family, alpha, class, rate): class borders by halving, P(a, x) as its power series."""
    def below(a, x):
        each = f"[exp(k * ln({x}) - lgamma({a} + 1.0 + k) + lgamma({a} + 1.0)) for k in range(0, {terms})]"
        return f"least(1.0, exp(-({x}) + {a} * ln({x}) - lgamma({a} + 1.0)) * list_sum({each}))"

    return f""",
al as (select family, least(greatest(kappa / 4, 0.05), 100.0) alpha from kap),
hv as (select family, alpha, c, 0 step, -400.0::double lo, ln(alpha + 12 * sqrt(alpha) + 40)::double hi from al cross join (select unnest(range(1, {cuts + 1})) c)
  union all select family, alpha, c, step + 1, case when p < c / {cuts + 1}.0 then (lo + hi) / 2 else lo end,
   case when p < c / {cuts + 1}.0 then hi else (lo + hi) / 2 end
  from (select *, {below('alpha', 'exp((lo + hi) / 2)')} p from hv where step < {halvings})),
bd as (select family, alpha, c, {below('(alpha + 1.0)', 'exp((lo + hi) / 2)')} p from hv where step = {halvings}
  union all select family, alpha, 0, 0.0 from al union all select family, alpha, {cuts + 1}, 1.0 from al),
gr as (select family, alpha, c::int "class", case when alpha >= 100 then 1.0 else greatest(1e-12, {cuts + 1} * (lead(p) over (partition by family order by c) - p)) end rate
  from bd qualify c < {cuts + 1})"""


@query("md_gamma", with_("pairs", 'select family, alpha, "class", ' + r("rate") + " rate, 0.25 weight from gr", KAPPA + _gamma_sql()))
def md_gamma(spark, sf):
    # one alpha per family, from its start value of kappa
    alpha = kappa(spark, sf).select("family", F.least(F.greatest(F.col("kappa") / 4, F.lit(0.05)), F.lit(100.0)).alias("alpha"))
    return M.gamma_classes(alpha).withColumn("rate", rnd(F.col("rate")))


@query("md_invariant", with_("patterns pairs", """
select p.family, pattern, n, """ + r("coalesce(pi, 0)") + """ l_invariant from (select *, case when contains(pattern,'A')::int + contains(pattern,'C')::int
 + contains(pattern,'G')::int + contains(pattern,'T')::int = 1 then strpos('ACGT', left(replace(pattern, '-', ''), 1)) - 1 else -1 end nc from patterns) p
left join obs on obs.family = p.family and obs.state = nc""", KAPPA))
def md_invariant(spark, sf):
    freq = base_freq(clean_sites(spark, sf))
    p = M.invariant_likelihood(clean.no_change(patterns(spark, sf)), freq)
    return p.select("family", "pattern", "n", rnd(F.col("l_invariant")).alias("l_invariant"))


@query("md_garbage", with_("patterns pairs", """
select p.family, pattern, n, """ + r("sum((length(pattern) - length(replace(pattern, b, ''))) * ln(pi))") + """ ln_garbage
from patterns p cross join bi join obs on obs.family = p.family and obs.state = s group by 1, 2, 3""", KAPPA))
def md_garbage(spark, sf):
    p = M.garbage_likelihood(patterns(spark, sf), base_freq(clean_sites(spark, sf)))
    return p.select("family", "pattern", "n", rnd(F.col("ln_garbage")).alias("ln_garbage"))


@query("md_mean_rate", with_("patterns", """
select family, class, """ + r("rate / (sum(rate * weight) over (partition by family) / sum(weight) over (partition by family))") + """ rate, weight from (
 select family, pos % 3 class, avg((contains(pattern,'A')::int + contains(pattern,'C')::int + contains(pattern,'G')::int
  + contains(pattern,'T')::int > 1)::int) rate, count(*) weight from cols group by 1, 2)"""))
def md_mean_rate(spark, sf):
    # one class per codon position: rate = share of variable columns, weight = number of columns
    cols = A.columns(clean_sites(spark, sf))
    kinds = sum((F.when(F.instr("pattern", c) > 0, 1).otherwise(0) for c in "ACGT"), F.lit(0))
    classes = cols.groupBy("family", F.expr("pos % 3").alias("class")).agg(
        F.avg(F.when(kinds > 1, 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("weight"))
    return M.rescale_classes(classes, ["family"]).withColumn("rate", rnd(F.col("rate")))


SUMS = codon_q_sql(str(OMEGA)) + """,
flow as (select o.family, o.eqm, o.i, o.j, aa1, aa2, e.pi * q f from off o
  join eqm e on e.family = o.family and e.sense = o.i and e.eqm = o.eqm)"""


def flows(spark, sf):
    """family, eqm, i, j, aa1, aa2, flow = pi_i q_ij of codon changes."""
    pi = codon_pi(spark, sf).select("family", "eqm", F.col("sense").alias("i"), "pi")
    steps = M.codon_step_table(spark).select("i", "j", "aa1", "aa2")
    return codon_q(spark, sf).join(steps, ["i", "j"]).join(pi, ["family", "eqm", "i"]).select(
        "family", "eqm", "i", "j", "aa1", "aa2", (F.col("pi") * F.col("q")).alias("flow"))


@query("lnl_syn_nonsyn", with_("pairs clean", "select family, eqm, " + r("sum(case when aa1 = aa2 then f else 0 end)") + " syn, "
    + r("sum(case when aa1 <> aa2 then f else 0 end)") + " nonsyn from flow group by 1, 2", SUMS))
def lnl_syn_nonsyn(spark, sf):
    same = F.col("aa1") == F.col("aa2")
    return flows(spark, sf).groupBy("family", "eqm").agg(
        rnd(F.sum(F.when(same, F.col("flow")).otherwise(0.0))).alias("syn"),
        rnd(F.sum(F.when(~same, F.col("flow")).otherwise(0.0))).alias("nonsyn"))


def kinds_of_pairs(spark, code=0):
    """i, j, kind: conservative or radical, for all pairs of sense codons of unlike amino acids."""
    return M.codon_step_table(spark, code, single=False).filter("aa1 <> aa2").join(X.radical(spark), ["aa1", "aa2"]).select("i", "j", "kind")


CHANGE_TERMS = 18


def _changes_sql():
    """Flows pi_i (Q^m)_ij of the unit-rate Q, summed by kind: a Taylor sum in t for every branch."""
    out = SUMS + """,
rate as (select family, eqm, sum(f) rate from flow group by 1, 2),
qu as materialized (select family, eqm, i, j, q / rate q from q join rate using (family, eqm)),
aas as (select sense i, aa from gcode where sense is not null),
fl0 as (select family, eqm, sense i, sense j, pi v from eqm)"""
    sums, fact = [], 1
    for m in range(1, CHANGE_TERMS + 1):
        out += f""",
fl{m} as materialized (select a.family, a.eqm, a.i, b.j, sum(a.v * b.q) v from fl{m - 1} a join qu b
  on b.family = a.family and b.eqm = a.eqm and b.i = a.j group by 1, 2, 3, 4)"""
        fact *= m
        sums.append(f"select {m} m, family, eqm, {KIND} kind, sum(v) / {fact}.0 v from fl{m} join a1 on a1.i = fl{m}.i"
                    f" join a2 on a2.j = fl{m}.j where aa1 <> aa2 group by 1, 2, 3, 4")
    return out + """,
a1 as (select i, aa aa1 from aas), a2 as (select i j, aa aa2 from aas),
mom as (""" + " union all ".join(sums) + ")"


@query("lnl_aa_changes", with_("pairs clean edges", f"""
select family, eqm, null::int tree_id, null::bigint node, {KIND} kind, """ + r("sum(f)") + """ changes from flow where aa1 <> aa2 group by all
union all select e.family, eqm, tree_id, node, kind, """ + r('sum(v * pow("length", m))') + " from mom join edges e using (family) group by all",
    _changes_sql()))
def lnl_aa_changes(spark, sf):
    now = flows(spark, sf).join(X.radical(spark), ["aa1", "aa2"]).groupBy("family", "eqm", "kind").agg(F.sum("flow").alias("changes"))
    now = now.withColumn("tree_id", F.lit(None).cast("int")).withColumn("node", F.lit(None).cast("bigint"))
    keys = ["family", "eqm"]
    freq = codon_pi(spark, sf).withColumnRenamed("sense", "state")
    q = M.scale(codon_q(spark, sf), freq, keys)
    branches = X.edges(spark, sf).select("tree_id", "family", "node", F.col("length").alias("t"))
    forms = F.explode(F.array(*map(F.lit, A.FORMS)))
    times = branches.select("family", "t").distinct().withColumn("eqm", forms)
    after = M.change_counts(q, freq, times, kinds_of_pairs(spark), len(catalog.sense_codons(0)), keys)
    after = after.join(branches, ["family", "t"]).select("family", "eqm", "kind", "changes", "tree_id", "node")
    return now.unionByName(after).select(
        "family", "eqm", "tree_id", "node", F.col("kind").cast("bigint").alias("kind"), rnd(F.col("changes")).alias("changes"))


PSI = 0.5
COEVO = AAF + f""",
pe as (select a.family, a.state i, b.state j, a.pi * b.pi * exp({PSI} * case when a.state = b.state then 0
  else (greatest(a.state, b.state) * 7 + least(a.state, b.state) * 3) % 2 end) x from nf a join nf b using (family)),
pn as (select family, i, j, x / sum(x) over (partition by family) pi from pe)"""


def coevo_eqm(spark, sf):
    from aligngrid.operators.coevolution import pair_eqm

    return pair_eqm(aa_freq(cleaned(spark, sf)), X.radical(spark), PSI)


@query("lnl_coevo_eqm", with_("clean", "select family, i, j, " + r("pi", 8) + " pi from pn", COEVO))
def lnl_coevo_eqm(spark, sf):
    return coevo_eqm(spark, sf).withColumn("pi", rnd(F.col("pi"), 8))


@query("lnl_coevo_q", with_("clean", """
select family, i, i2, """ + r("f / m") + " q from (select a.family, a.i, b.i i2, sum(a.pi * b.pi) f from pn a join pn b"
    " on a.family = b.family and a.j = b.j and a.i <> b.i group by 1, 2, 3)"
    " join (select family, i, sum(pi) m from pn group by 1, 2) using (family, i)", COEVO))
def lnl_coevo_q(spark, sf):
    from aligngrid.operators.coevolution import aggregate_first, pair_q

    pi = coevo_eqm(spark, sf)
    return aggregate_first(pair_q(pi), pi).withColumn("q", rnd(F.col("q")))
