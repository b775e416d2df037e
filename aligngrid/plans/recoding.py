"""Registered queries: alphabets, recoding, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.functions import scalar as S
from aligngrid.operators import aggregate, clean, recode
from aligngrid.plans import fixtures as X
from aligngrid.plans.registry import query
from oracle.common import r, with_


def rnd(c, places=6):
    """Rounded; the nudge sends exact halves the same way on both sides."""
    return F.round(c + F.lit(10.0 ** -(places + 4)), places) + F.lit(0.0)


def cleaned(spark, sf):
    return clean.clean_made(X.codons(spark, sf), in_place=True)


@query("sc_alphabet", with_("seqs codons", """
select family, t.data_type, t.idx, t.symbol, count(*) n from (
  select family, 'DNA' data_type, ch symbol from sites
  union all select family, 'RY', translate(ch, 'AGCT', 'RRYY') from sites
  union all select family, 'COD', codon from codons
  union all select family, 'GAP', ch from sites) u
join states t using (data_type, symbol) group by all""", "states as (select * from (values "
    + ",".join(f"('{t}',{i},'{s}')" for t in ("DNA", "RY", "COD", "GAP") for i, s in enumerate(catalog.alphabet(t)))
    + ") v(data_type, idx, symbol))"))
def sc_alphabet(spark, sf):
    sites = X.sites(spark, sf)

    def as_type(df, t, c):
        return df.select("family", F.lit(t).alias("data_type"), c.alias("symbol"))

    cells = (
        as_type(sites, "DNA", F.col("ch"))
        .unionByName(as_type(sites, "RY", S.to_ry("ch")))
        .unionByName(as_type(recode.make_codons(sites), "COD", F.col("codon")))
        .unionByName(as_type(sites, "GAP", F.col("ch")))
    )
    return cells.join(catalog.states(spark), ["data_type", "symbol"]).groupBy(
        "family", "data_type", "idx", "symbol"
    ).agg(F.count("*").alias("n"))


@query("sc_is_gap", with_("sites", """
select family, seq_id, sum((ch in ('-','X','.','?'))::int)::bigint n_gap, count(*) n from sites group by 1, 2"""))
def sc_is_gap(spark, sf):
    return X.sites(spark, sf).groupBy("family", "seq_id").agg(
        F.count_if(S.is_gap("ch")).alias("n_gap"), F.count("*").alias("n")
    )


NEXT = """nxt as (select a.family, a.seq_id, a.cpos, a.codon c1, b.codon c2 from codons a
  join codons b on a.family = b.family and a.cpos = b.cpos and b.seq_id = a.seq_id + 1),
parts as (select *, (c1[1] <> c2[1])::int + (c1[2] <> c2[2])::int + (c1[3] <> c2[3])::int d from nxt)"""


def next_codons(spark, sf):
    c = X.codons(spark, sf)
    b = c.select("family", (F.col("seq_id") - 1).alias("seq_id"), "cpos", F.col("codon").alias("c2"))
    return c.withColumnRenamed("codon", "c1").join(b, ["family", "seq_id", "cpos"])


@query("sc_transition", with_("codons", """
select family, seq_id,
 sum((least(c1[1],c2[1]) || greatest(c1[1],c2[1]) in ('AG','CT'))::int)::bigint ts_first,
 sum((d = 1 and (least(c1[1],c2[1]) || greatest(c1[1],c2[1]) in ('AG','CT')
   or least(c1[2],c2[2]) || greatest(c1[2],c2[2]) in ('AG','CT')
   or least(c1[3],c2[3]) || greatest(c1[3],c2[3]) in ('AG','CT')))::int)::bigint ts_codon
from parts group by 1, 2""", NEXT))
def sc_transition(spark, sf):
    return next_codons(spark, sf).groupBy("family", "seq_id").agg(
        F.count_if(S.is_transition(F.substring("c1", 1, 1), F.substring("c2", 1, 1))).alias("ts_first"),
        F.count_if(S.codon_transition("c1", "c2")).alias("ts_codon"),
    )


@query("sc_codon_diff", with_("codons", "select family, seq_id, d::bigint diff, count(*) n from parts group by 1,2,3", NEXT))
def sc_codon_diff(spark, sf):
    return next_codons(spark, sf).groupBy(
        "family", "seq_id", S.codon_diff("c1", "c2").cast("bigint").alias("diff")
    ).agg(F.count("*").alias("n"))


@query("sc_guess_type", """
with t as (select doc_id, translate(text, 'Nn', '') x from documents),
s as (select doc_id,
  case when length(x) > 0 then (length(x) - length(translate(x, 'ACGTacgt', ''))) / length(x) else -1.0 end dna,
  case when length(x) > 0 then (length(x) - length(translate(x, 'ARNDCQEGHILKMFPSTWYVarndcqeghilkmfpstwyv', ''))) / length(x) else -1.0 end aa
  from t)
select doc_id, """ + r("dna") + " dna, " + r("aa") + """ aa,
 case when dna < 0 then 'NONE' when dna * 1.1 > aa and dna > 0.15 then 'DNA'
      when aa > 0.15 and aa > dna then 'AA' else 'NONE' end guess from s""")
def sc_guess_type(spark, sf):
    d = X.documents(spark, sf)
    return d.select(
        "doc_id", rnd(S.type_score("text", catalog.DNA)).alias("dna"),
        rnd(S.type_score("text", catalog.AA)).alias("aa"), S.guess_type("text").alias("guess"),
    )


@query("sc_valid_type", with_("seqs", """
select family, seq_id, not regexp_matches(seq, '[^ACGT]') dna, not regexp_matches(seq, '[^-ACGTX.?]') dna_gaps,
 not regexp_matches(seq, '[^-ARNDCQEGHILKMFPSTWYVX.?]') aa_gaps from seqs"""))
def sc_valid_type(spark, sf):
    return X.seqs(spark, sf).select(
        "family", "seq_id", S.valid_type("seq", catalog.DNA).alias("dna"),
        S.valid_type("seq", catalog.DNA, True).alias("dna_gaps"),
        S.valid_type("seq", catalog.AA, True).alias("aa_gaps"),
    )


@query("sc_ry", with_("seqs", "select family, seq_id, translate(seq, 'AGCT', 'RRYY') seq from seqs"))
def sc_ry(spark, sf):
    return recode.join_sites(recode.recode_ry(X.sites(spark, sf)))


@query("sc_translate", with_("codes codons", """
select family, seq_id, k.code, string_agg(coalesce(g.aa_ch, '-'), '' order by cpos) seq
from codons cross join (select distinct code from gcode) k
left join gcode g on g.code = k.code and g.codon = codons.codon group by 1, 2, 3"""))
def sc_translate(spark, sf):
    # All codes at once: the codons a code reads differently are few, so the table carries one letter per code.
    codes = catalog.genetic_code(spark).groupBy("codon").agg(
        F.sort_array(F.collect_list(F.struct("code", F.coalesce("aa_ch", F.lit("-")).alias("aa_ch")))).alias("t"))
    gaps = F.array(*[F.struct(F.lit(c).alias("code"), F.lit("-").alias("aa_ch")) for c in range(12)])
    cells = X.codons(spark, sf).join(F.broadcast(codes), "codon", "left").select(
        "family", "seq_id", F.col("cpos").alias("pos"), F.explode(F.coalesce("t", gaps)).alias("z"))
    return recode.join_sites(
        cells.select("family", "seq_id", "pos", "z.code", F.col("z.aa_ch").alias("ch")), ("family", "seq_id", "code"))


@query("sc_codon_make", with_("codons", "select family, seq_id, cpos, codon from codons"))
def sc_codon_make(spark, sf):
    return X.codons(spark, sf)


@query("sc_codon_reduce", with_("code codons", """
select family, seq_id, cpos, sense, case when sense is null then '---' else codons.codon end codon
from codons left join gcode on gcode.codon = codons.codon"""))
def sc_codon_reduce(spark, sf):
    reduced = recode.reduce_codons(X.codons(spark, sf))
    return recode.expand_codons(reduced.drop("codon")).select("family", "seq_id", "cpos", "sense", "codon")


@query("sc_codon_positions", with_("sites", """
select family, seq_id, string_agg(ch, '' order by pos) seq from sites where pos % 3 in (0, 1) group by 1, 2"""))
def sc_codon_positions(spark, sf):
    return recode.join_sites(recode.codon_positions(X.sites(spark, sf), (0, 1)))


@query("sc_pairs_alphabet", with_("sites", """
select a.family, a.pos pos1, b.pos pos2, a.ch || b.ch state, count(*) n from sites a
join sites b on a.family = b.family and a.seq_id = b.seq_id and b.pos in (a.pos + 1, 119 - a.pos) and b.pos > a.pos
group by all"""))
def sc_pairs_alphabet(spark, sf):
    sites = X.sites(spark, sf)
    cols = sites.select("family", F.col("pos").alias("pos1")).distinct()
    pairs = cols.select("family", "pos1", F.explode(F.array_distinct(
        F.array(F.col("pos1") + 1, 119 - F.col("pos1")))).alias("pos2")).filter("pos2 > pos1 and pos2 < 120")
    return recode.pair_columns(sites, pairs).groupBy("family", "pos1", "pos2", "state").agg(F.count("*").alias("n"))


@query("sc_profile_path", with_("sites", """
select family, seq_id, step, case when left(step,1)='M' then 'match' else 'delete' end part,
 case when step in ('MM','DD') then 'R' else 'Y' end ch, count(*) n from (
 select family, seq_id, (case when ch in ('A','C','G','T') then 'M' else 'D' end) ||
  lead(case when ch in ('A','C','G','T') then 'M' else 'D' end) over (partition by family, seq_id order by pos) step
 from sites) where step is not null group by all"""))
def sc_profile_path(spark, sf):
    path = recode.profile_path(X.sites(spark, sf))
    both = recode.match_set(path).withColumn("part", F.lit("match")).unionByName(
        recode.delete_set(path).withColumn("part", F.lit("delete")))
    return both.groupBy("family", "seq_id", "step", "part", "ch").agg(F.count("*").alias("n"))


@query("sc_normalise", with_("sites", "select family, seq_id, ch, "
    + r("case when tot > 0 then n / tot else 0.25 end") + " p from t", """
c as (select family, seq_id, b.ch, count(s.pos) n from (select distinct family, seq_id from sites) f
  cross join (values ('A'),('C'),('G'),('T')) b(ch) left join sites s using (family, seq_id, ch) group by 1,2,3),
t as (select *, sum(n) over (partition by family, seq_id) tot from c)"""))
def sc_normalise(spark, sf):
    # One row per sequence holds the four counts, so the sum needs no window.
    counts = X.sites(spark, sf).groupBy("family", "seq_id").agg(
        *[F.count_if(F.col("ch") == b).alias(b) for b in catalog.DNA])
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    cells = F.array(*[F.struct(F.lit(b).alias("ch"), S.normalise(b, total, F.lit(4)).alias("p")) for b in catalog.DNA])
    return counts.select("family", "seq_id", F.explode(cells).alias("z")).select(
        "family", "seq_id", "z.ch", rnd(F.col("z.p")).alias("p"))


@query("sc_text", """
select doc_id, length(replace(text, 'the', 'th')) n_replaced, text like '%tion%a_e%' wild,
 len([x for x in string_split(translate(text, chr(9)||chr(10)||chr(13)||chr(12)||chr(11), '     '), ' ') if x <> '']) n_tokens,
 length(translate(text, ' '||chr(9)||chr(10)||chr(13)||chr(12)||chr(11), '')) n_stripped from documents""")
def sc_text(spark, sf):
    return X.documents(spark, sf).select(
        "doc_id",
        F.length(F.replace("text", F.lit("the"), F.lit("th"))).cast("bigint").alias("n_replaced"),
        S.wildcard("text", "*tion*a?e*").alias("wild"),
        F.size(S.tokens("text")).cast("bigint").alias("n_tokens"),
        F.length(S.strip_white("text")).cast("bigint").alias("n_stripped"),
    )


NAMES = ("WAG HKY+dG LG+F+I+4dG JC+12dG CodonM0.0.F3X4+4dG REV+gC+dG WAG+TreeHMM CodonM0.14.F64 HKY+Q "
         "EQU+F").split()
PARSED = [
    # name, core, plus_f, invariant, garbage, tree_hmm, n_cat, code, eqm, valid
    ("WAG", "WAG", 0, 0, 0, 0, 0, None, None, 1), ("HKY+dG", "HKY", 0, 0, 0, 0, 4, None, None, 1),
    ("LG+F+I+4dG", "LG", 1, 1, 0, 0, 4, None, None, 1), ("JC+12dG", "JC", 0, 0, 0, 0, 12, None, None, 0),
    ("CodonM0.0.F3X4+4dG", "CodonM0", 0, 0, 0, 0, 4, 0, "F3X4", 1), ("REV+gC+dG", "REV", 0, 0, 1, 0, 4, None, None, 1),
    ("WAG+TreeHMM", "WAG", 0, 0, 0, 1, 0, None, None, 1), ("CodonM0.14.F64", "CodonM0", 0, 0, 0, 0, 0, 14, "F64", 0),
    ("HKY+Q", "HKY", 0, 0, 0, 0, 0, None, None, 0), ("EQU+F", "EQU", 1, 0, 0, 0, 0, None, None, 1),
]


@query("sc_model_name", "select doc_id, p.* from documents join (values " + ",".join(
    f"({i},'{n}','{c}',{bool(f)},{bool(i_)},{bool(g)},{bool(h)},{k},{'NULL' if cd is None else cd},"
    f"{'NULL' if e is None else repr(e)},{bool(v)})" for i, (n, c, f, i_, g, h, k, cd, e, v) in enumerate(PARSED)
) + ") p(i, name, core, plus_f, invariant, garbage, tree_hmm, n_cat, code, eqm, valid) on p.i = doc_id % 10")
def sc_model_name(spark, sf):
    names = F.array(*map(F.lit, NAMES))
    d = X.documents(spark, sf).select("doc_id", (F.col("doc_id") % 10).alias("i"))
    d = d.withColumn("name", F.element_at(names, (F.col("i") + 1).cast("int")))
    return d.select("doc_id", "i", "name", *[c.alias(k) for k, c in S.model_name_parts("name").items()])


@query("fl_codon_clean", with_("clean", """
select family, seq_id, string_agg(codon, '' order by cpos) seq from cleaned group by 1, 2"""))
def fl_codon_clean(spark, sf):
    codons = clean.clean_codons(X.codons(spark, sf))
    return recode.join_sites(codons.withColumnRenamed("cpos", "pos"), ch="codon")


@query("fl_sparse", with_("clean", "select family, seq_id from kept"))
def fl_sparse(spark, sf):
    codons = clean.clean_codons(X.codons(spark, sf))
    return clean.dense_sequences(recode.codon_sites(codons))


@query("fl_all_gap", with_("clean", """
select family, seq_id, string_agg(ch, '' order by pos) seq from ksites
join (select family, pos from ksites group by 1, 2 having max((ch <> '-')::int) = 1) using (family, pos) group by 1, 2"""))
def fl_all_gap(spark, sf):
    return recode.join_sites(clean.remove_all_gap(recode.codon_sites(cleaned(spark, sf))))


@query("fl_invariant", with_("clean", """
select family, seq_id, string_agg(ch, '' order by pos) seq from ksites
join (select family, pos from ksites group by 1, 2 having count(distinct case when ch <> '-' then ch end) > 1)
using (family, pos) group by 1, 2"""))
def fl_invariant(spark, sf):
    return recode.join_sites(clean.remove_invariant(recode.codon_sites(cleaned(spark, sf))))


def patterns(spark, sf):
    return aggregate.patterns(recode.codon_sites(cleaned(spark, sf)))


@query("fl_no_change", with_("patterns", """
select family, pattern, n, case when k = 1 then strpos('ACGT', sole) - 1 else -1 end no_change from (
 select *, contains(pattern,'A')::int + contains(pattern,'C')::int + contains(pattern,'G')::int + contains(pattern,'T')::int k,
  left(replace(pattern, '-', ''), 1) sole from patterns)"""))
def fl_no_change(spark, sf):
    return clean.no_change(patterns(spark, sf)).select("family", "pattern", "n", "no_change")


@query("fl_gap_mask", with_("clean", """
select s.family, s.seq_id, string_agg(case when c.ch = '-' then '-' else s.ch end, '' order by s.pos) seq
from sites s join csites c using (family, seq_id, pos) group by 1, 2"""))
def fl_gap_mask(spark, sf):
    sites = X.sites(spark, sf)
    mask = clean.gap_mask(recode.codon_sites(clean.clean_codons(recode.make_codons(sites))))
    return recode.join_sites(clean.apply_gap_mask(sites, mask))


@query("fl_parsimony_mask", with_("patterns", """
select family, pattern, case when contains(pattern,'A')::int + contains(pattern,'C')::int + contains(pattern,'G')::int
 + contains(pattern,'T')::int > 1 then n else 0 end weight from patterns"""))
def fl_parsimony_mask(spark, sf):
    return clean.parsimony_mask(patterns(spark, sf)).select("family", "pattern", "weight")
