"""Registered queries: patterns, frequencies, adjustments."""

from __future__ import annotations

from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.operators import aggregate as A
from aligngrid.operators import pairs as P
from aligngrid.operators import recode
from aligngrid.plans import fixtures as X
from aligngrid.plans.recoding import cleaned, patterns, rnd
from aligngrid.plans.registry import query
from oracle.common import r, with_


def clean_sites(spark, sf):
    return recode.codon_sites(cleaned(spark, sf))


@query("ag_patterns", with_("patterns", """
select family, pattern, pos, n, pattern_id from cols join (select family, pattern, count(*) n, min(pos) pattern_id from cols group by 1, 2)
 using (family, pattern)"""))
def ag_patterns(spark, sf):
    """A row for each site: its pattern, the pattern's number of sites and its first site."""
    cols = A.columns(clean_sites(spark, sf))
    return cols.join(A.patterns(clean_sites(spark, sf)), ["family", "pattern"]).select("family", "pattern", "pos", "n", "pattern_id")


@query("ag_state_freq", with_("sites", """
select family, seq_id, ch state, count(*) n, """ + r("count(*) / sum(count(*)) over (partition by family, seq_id)") + """ freq
from sites where ch in ('A','C','G','T') group by 1, 2, 3
union all select family, null, ch, count(*), """ + r("count(*) / sum(count(*)) over (partition by family)") + """
from sites where ch in ('A','C','G','T') group by 1, 3"""))
def ag_state_freq(spark, sf):
    sites = X.sites(spark, sf)
    per_seq = A.state_freq(sites, ("family", "seq_id"))
    overall = A.state_freq(sites).withColumn("seq_id", F.lit(None).cast("bigint"))
    return per_seq.unionByName(overall).select("family", "seq_id", "state", "n", rnd(F.col("freq")).alias("freq"))


@query("ag_msa_chars", with_("clean", """
select family, sum(length(replace(codon, '-', '')))::bigint n_dna, sum(length(replace(codon, '-', '')))::bigint n_ry,
 count(aa) n_aa, count(sense) n_codon, true agree from kcodons group by 1"""))
def ag_msa_chars(spark, sf):
    return A.msa_chars(cleaned(spark, sf))


F1 = """
gaps as (select family, sum((codon = '---')::int) g from kcodons group by 1),
b as (select family, pos % 3 k, ch, count(*) n from ksites where ch <> '-' group by 1, 2, 3),
every as (select g.family, k, ch, coalesce(n, 0) n, g.g from gaps g cross join (values (0),(1),(2)) p(k)
  cross join (values ('A'),('C'),('G'),('T')) c(ch) left join b using (family, k, ch)),
f1 as (select family, ch, (sum(n) + 0.75 * max(g)) / sum(sum(n) + 0.75 * max(g)) over (partition by family) freq from every group by 1, 2),
f3 as (select family, k, ch, (n + 0.25 * g) / sum(n + 0.25 * g) over (partition by family, k) freq from every),
f64 as (select family, codon, sense, aa, count(*) n, count(*) / sum(count(*)) over (partition by family) freq
  from kcodons where sense is not null group by 1, 2, 3, 4)"""
EQM = F1 + """,
sense as (select codon, sense, aa from gcode where sense is not null),
fams as (select family from gaps),
raw as (select family, 'EQU' eqm, sense, codon, 1.0 / 61 x from fams cross join sense
  union all select a.family, 'F1X4', sense, codon, a.freq * b.freq * c.freq from sense s
    join f1 a on a.ch = s.codon[1] join f1 b on b.family = a.family and b.ch = s.codon[2]
    join f1 c on c.family = a.family and c.ch = s.codon[3]
  union all select a.family, 'F3X4', sense, codon, a.freq * b.freq * c.freq from sense s
    join f3 a on a.k = 0 and a.ch = s.codon[1] join f3 b on b.family = a.family and b.k = 1 and b.ch = s.codon[2]
    join f3 c on c.family = a.family and c.k = 2 and c.ch = s.codon[3]
  union all select family, 'F64', sense, codon, freq from f64),
eqm as (select family, eqm, sense, codon, x / sum(x) over (partition by family, eqm) pi from raw)"""


@query("ag_codon_f1x4", with_("clean", "select family, ch base, " + r("freq") + " freq from f1", F1))
def ag_codon_f1x4(spark, sf):
    return A.codon_f1x4(cleaned(spark, sf)).withColumn("freq", rnd(F.col("freq")))


@query("ag_codon_f3x4", with_("clean", "select family, k codon_pos, ch base, " + r("freq") + " freq from f3", F1))
def ag_codon_f3x4(spark, sf):
    return A.codon_f3x4(cleaned(spark, sf)).withColumn("freq", rnd(F.col("freq")))


@query("ag_codon_f64", with_("clean", """
select family, codon, sense, aa, n, """ + r("freq") + """ freq, 0 is_stop from f64
union all select family, codons.codon, null, null, count(*), null, 1 from codons join gcode on gcode.codon = codons.codon
where gcode.aa is null group by 1, 2""", F1))
def ag_codon_f64(spark, sf):
    good = A.codon_f64(cleaned(spark, sf)).withColumn("freq", rnd(F.col("freq"))).withColumn("is_stop", F.lit(0))
    raw = X.codons(spark, sf)
    return good.unionByName(A.stop_codons(raw).withColumn("is_stop", F.lit(1)), allowMissingColumns=True)


@query("ag_codon_eqm", with_("clean", "select family, eqm, sense, codon, " + r("pi", 8) + " pi from eqm", EQM))
def ag_codon_eqm(spark, sf):
    return A.codon_eqm(cleaned(spark, sf)).withColumn("pi", rnd(F.col("pi"), 8))


@query("ag_enforce_aa", with_("clean", """
select e.family, codon, s.aa, """ + r("coalesce(pi / sum(pi) over (partition by e.family, s.aa) * a.p, 0)", 8) + """ pi
from eqm e join sense s using (codon) left join (select family, aa, sum(freq) p from f64 group by 1, 2) a
 on a.family = e.family and a.aa = s.aa where eqm = 'F1X4'""", EQM))
def ag_enforce_aa(spark, sf):
    codons = cleaned(spark, sf)
    pi = A.codon_eqm(codons).filter("eqm = 'F1X4'").select("family", "codon", "pi")
    aa = A.codon_f64(codons).groupBy("family", "aa").agg(F.sum("freq").alias("aa_pi"))
    return A.enforce_aa(pi, aa).withColumn("pi", rnd(F.col("pi"), 8))


@query("ag_adj_aa", with_("clean", """
select family, """ + r("sum(n * ln(n / na))", 4) + " empirical, 41 df, " + r("-sum(n * ln(fold))", 4) + """ equal
from (select *, sum(n) over (partition by family, aa) na from f64)
join (select aa, count(*) fold from gcode where aa is not null group by 1) using (aa) group by 1""", F1))
def ag_adj_aa(spark, sf):
    return A.adjust_aa(cleaned(spark, sf)).withColumn("empirical", rnd(F.col("empirical"), 4)).withColumn(
        "equal", rnd(F.col("equal"), 4))


@query("ag_adj_ry", with_("clean", """
select family, """ + r("sum(n * ln(n / nc))", 4) + """ empirical, 2 df from (
 select *, sum(n) over (partition by family, ch in ('A','G')) nc from (
  select family, ch, count(*) n from ksites where ch <> '-' group by 1, 2)) group by 1"""))
def ag_adj_ry(spark, sf):
    return A.adjust_ry(clean_sites(spark, sf)).withColumn("empirical", rnd(F.col("empirical"), 4))


@query("ag_adj_missing", with_("clean", """
select family, """ + r("sum(n * ln(n / nc))", 4) + """ lnl_missing from (
 select *, sum(n) over (partition by family) nc from (
  select family, ch, count(*) n from ksites where ch <> '-' group by 1, 2)) group by 1"""))
def ag_adj_missing(spark, sf):
    return A.adjust_missing(clean_sites(spark, sf)).withColumn("lnl_missing", rnd(F.col("lnl_missing"), 4))


@query("ag_multinomial", with_("patterns", """
select family, """ + r("sum(n * ln(n / tot))", 4) + """ lnl from (
 select *, sum(n) over (partition by family) tot from patterns) group by 1"""))
def ag_multinomial(spark, sf):
    return A.multinomial(patterns(spark, sf)).withColumn("lnl", rnd(F.col("lnl"), 4))


@query("ag_pattern_dist", with_("clean", """
select f.family, f.i, p.pattern, count(x.pos) n from
 (select distinct a.family, a.seq_id i from ksites a join kept b on b.family = a.family and b.seq_id = a.seq_id + 1) f
 cross join (select a.ch || b.ch pattern from (values ('A'),('C'),('G'),('T')) a(ch), (values ('A'),('C'),('G'),('T')) b(ch)) p
 left join (select a.family, a.seq_id i, a.pos, a.ch || b.ch pattern from ksites a
   join ksites b on a.family = b.family and a.pos = b.pos and b.seq_id = a.seq_id + 1) x
 on x.family = f.family and x.i = f.i and x.pattern = p.pattern group by 1, 2, 3"""))
def ag_pattern_dist(spark, sf):
    # each sequence with its neighbour is a two-sequence alignment
    sites = clean_sites(spark, sf)
    nxt = sites.select("family", (F.col("seq_id") - 1).alias("seq_id"), "pos", F.col("ch").alias("ch2"))
    pats = sites.join(nxt, ["family", "seq_id", "pos"]).groupBy(
        "family", F.col("seq_id").alias("i"), F.concat("ch", "ch2").alias("pattern")).agg(F.count("*").alias("n"))
    return A.pattern_dist(pats, 2, ("family", "i"))


@query("ag_guess_kappa", with_("pairs", """
select family, """ + r("case when sum(n_diff - n_ts) > 0 then 2 * sum(n_ts) / sum(n_diff - n_ts) else 2.5 end") + " kappa from pairs group by 1"))
def ag_guess_kappa(spark, sf):
    return A.kappa_from_columns(clean_sites(spark, sf)).withColumn("kappa", rnd(F.col("kappa")))


@query("ag_summary", with_("patterns", """
select * from (select family, sum(n)::bigint n_sites, count(*) n_patterns, count(distinct replace(pattern, '-', '')) n_patterns_nogap,
   """ + ", ".join(f"sum(case when k = {k} then n else 0 end)::bigint sites_{k}" for k in range(1, 5)) + """
 from (select *, contains(pattern,'A')::int + contains(pattern,'C')::int + contains(pattern,'G')::int + contains(pattern,'T')::int k
       from patterns) group by 1)
join (select family, count(*) n_seq, """ + ", ".join(
    f"{r(f'avg(n_{b} / tot)')} mean_{b}, {r(f'stddev_samp(n_{b} / tot)')} sd_{b}" for b in catalog.DNA) + """
 from (select family, seq_id, count(*) filter (ch <> '-') tot, """ + ", ".join(
    f"count(*) filter (ch = '{b}') n_{b}" for b in catalog.DNA) + " from ksites group by 1, 2) group by 1) using (family)"))
def ag_summary(spark, sf):
    sites = clean_sites(spark, sf)
    out = A.summary(sites, A.patterns(sites))
    return out.select(*[rnd(F.col(c)).alias(c) if c[:3] in ("mea", "sd_") else F.col(c) for c in out.columns])


@query("ag_add_column", with_("patterns", "select family, pattern, n from patterns"))
def ag_add_column(spark, sf):
    # patterns of the first two codon positions, then every third-position column added
    cols = A.columns(clean_sites(spark, sf))
    first = cols.filter("pos % 3 < 2").groupBy("family", "pattern").agg(F.count("*").alias("n"))
    third = cols.filter("pos % 3 = 2").select("family", "pattern", F.lit(1).cast("bigint").alias("n"))
    return A.add_columns(first, third)
