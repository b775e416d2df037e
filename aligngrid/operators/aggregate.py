"""Patterns, frequencies and likelihood adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.functions import scalar as S
from aligngrid.operators.recode import listagg

BASES = list(catalog.DNA)


def columns(sites: DataFrame, ch: str = "ch") -> DataFrame:
    """family, pos, pattern: the column as one text, sequences in order of id."""
    return sites.groupBy("family", "pos").agg(listagg(ch, "seq_id").alias("pattern"))


def codon_columns(codons: DataFrame) -> DataFrame:
    """`columns` of the sites of whole codons (family, seq_id, cpos, codon): a row a codon is shuffled, not one a site."""
    cols = codons.groupBy("family", "cpos").agg(*[listagg(f"substring(codon, {k + 1}, 1)", "seq_id").alias(f"d{k}") for k in range(3)])
    return cols.select("family", F.inline(F.array(*[
        F.struct((F.col("cpos") * 3 + k).alias("pos"), F.col(f"d{k}").alias("pattern")) for k in range(3)])))


def patterns(sites: DataFrame, ch: str = "ch") -> DataFrame:
    """Distinct columns with counts; pattern_id is the first site that shows the pattern."""
    return patterns_of(columns(sites, ch))


def patterns_of(cols: DataFrame, *keys: str) -> DataFrame:
    """`patterns` of columns that are made already; keys: more keys of an alignment than its family."""
    return cols.groupBy("family", *keys, "pattern").agg(F.count("*").alias("n"), F.min("pos").alias("pattern_id"))


def site_pattern(cols: DataFrame, pats: DataFrame) -> DataFrame:
    """family, pos, pattern_id."""
    return cols.join(pats.select("family", "pattern", "pattern_id"), ["family", "pattern"]).select(
        "family", "pos", "pattern_id"
    )


def add_columns(pats: DataFrame, new: DataFrame) -> DataFrame:
    """Add columns with counts (family, pattern, n); equal patterns are merged."""
    return (
        pats.select("family", "pattern", "n").unionByName(new.select("family", "pattern", "n"))
        .groupBy("family", "pattern").agg(F.sum("n").alias("n"))
    )


def state_freq(sites: DataFrame, keys=("family",), alphabet: str = catalog.DNA) -> DataFrame:
    """State counts and frequencies per key, gaps not counted: one partial aggregate, no window."""
    counts = sites.groupBy(*keys).agg(*[F.count_if(F.col("ch") == c).alias(f"n_{c}") for c in alphabet])
    total = sum((F.col(f"n_{c}") for c in alphabet), F.lit(0))
    cells = F.array(*[F.struct(F.lit(c).alias("state"), F.col(f"n_{c}").alias("n")) for c in alphabet])
    return (
        counts.select(*keys, total.alias("total"), F.explode(cells).alias("z"))
        .select(*keys, "z.state", "z.n", (F.col("z.n") / F.col("total")).alias("freq"))
        .filter("n > 0")
    )


def msa_chars(codons: DataFrame) -> DataFrame:
    """Residues in use per recode, on cleaned codons; they must agree as DNA = RY = 3 AA = 3 codon."""
    letters = sum((S.count_in("codon", b) for b in BASES), F.lit(0))
    ry = S.count_in(S.to_ry("codon"), catalog.RY)
    out = codons.groupBy("family").agg(
        F.sum(letters).cast("bigint").alias("n_dna"), F.sum(ry).cast("bigint").alias("n_ry"),
        F.count("aa").alias("n_aa"), F.count("sense").alias("n_codon"),
    )
    return out.withColumn(
        "agree", F.expr("n_dna = n_ry and n_dna = 3 * n_aa and n_dna = 3 * n_codon")
    )


def base_counts(codons: DataFrame) -> DataFrame:
    """One row a family: n_<codon position><base>, n_gap (gap codons), n_codons."""
    cells = [
        F.count_if(F.substring("codon", k + 1, 1) == b).alias(f"n_{k}{b}") for k in range(3) for b in BASES
    ]
    return codons.groupBy("family").agg(
        *cells, F.count_if(F.col("codon") == "---").alias("n_gap"), F.count("*").alias("n_codons")
    )


def _f1x4_count(b):
    return sum((F.col(f"n_{k}{b}") for k in range(3)), 0.75 * F.col("n_gap"))


def codon_f1x4(codons: DataFrame) -> DataFrame:
    """family, base, freq: pooled positions; a gap codon adds 0.75 to each base."""
    return _f1x4(base_counts(codons))


def _f1x4(counts: DataFrame) -> DataFrame:
    total = sum((_f1x4_count(b) for b in BASES), F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(b).alias("base"), (_f1x4_count(b) / total).alias("freq")) for b in BASES])
    return counts.select("family", F.inline(cells))


def _f3x4_freq(k, b):
    total = sum((F.col(f"n_{k}{x}") + 0.25 * F.col("n_gap") for x in BASES), F.lit(0.0))
    return (F.col(f"n_{k}{b}") + 0.25 * F.col("n_gap")) / total


def codon_f3x4(codons: DataFrame) -> DataFrame:
    """family, codon_pos, base, freq; a gap codon adds 0.25 to each cell."""
    cells = F.array(*[
        F.struct(F.lit(k).alias("codon_pos"), F.lit(b).alias("base"), _f3x4_freq(k, b).alias("freq"))
        for k in range(3) for b in BASES
    ])
    return base_counts(codons).select("family", F.inline(cells))


def codon_counts(codons: DataFrame) -> DataFrame:
    """family, codon, sense, aa, n over sense codons."""
    return codons.filter("sense is not null").groupBy("family", "codon", "sense", "aa").agg(F.count("*").alias("n"))


def stop_codons(codons: DataFrame, code: int = 0) -> DataFrame:
    """Stop codons with mass: an error for the 64-state frequencies, returned as rows."""
    table = catalog.genetic_code(codons.sparkSession, [code]).filter("aa is null").select("codon")
    return codons.join(table, "codon", "left_semi").groupBy("family", "codon").agg(F.count("*").alias("n"))


def codon_f64(codons: DataFrame) -> DataFrame:
    """family, codon, sense, aa, n, freq. At most 64 rows a family reach the window."""
    w = Window.partitionBy("family")
    return codon_counts(codons).withColumn("freq", F.col("n") / F.sum("n").over(w))


FORMS = ["EQU", "F1X4", "F3X4", "F64"]


def codon_eqm(codons: DataFrame, code: int = 0) -> DataFrame:
    """family, eqm, sense, codon, pi for the four frequency forms.

    The base frequencies stay in one row a family; each row is expanded to the
    sense codons of the code, so the sums run inside the row and nothing shuffles
    after the first aggregate.
    """
    sense = catalog.sense_codons(code)
    counts = base_counts(codons)
    pooled = {b: f"(n_0{b} + n_1{b} + n_2{b} + 0.75D * n_gap)" for b in BASES}
    f1 = {b: f"{pooled[b]} / ({' + '.join(pooled.values())})" for b in BASES}
    cell = {(k, b): f"(n_{k}{b} + 0.25D * n_gap)" for k in range(3) for b in BASES}
    f3 = {(k, b): f"{cell[k, b]} / ({' + '.join(cell[k, x] for x in BASES)})" for k in range(3) for b in BASES}
    row = counts.selectExpr("family", *[f"{f1[b]} as a{b}" for b in BASES], *[f"{f3[k, b]} as b{k}{b}" for k, b in cell])
    raw1 = "array(" + ",".join(f"a{c[0]} * a{c[1]} * a{c[2]}" for c in sense) + ") as r1"
    raw3 = "array(" + ",".join(f"b0{c[0]} * b1{c[1]} * b2{c[2]}" for c in sense) + ") as r3"
    row = row.selectExpr("family", raw1, raw3)

    def scaled(c):
        total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        return F.transform(c, lambda x: x / total)

    equ = F.array_repeat(F.lit(1.0 / len(sense)), len(sense))
    names = F.expr("array(" + ",".join(f"'{c}'" for c in sense) + ")")
    forms = F.array(*[
        F.struct(F.lit(n).alias("eqm"), v.alias("pi"))
        for n, v in (("EQU", equ), ("F1X4", scaled(F.col("r1"))), ("F3X4", scaled(F.col("r3"))))
    ])
    made = row.select("family", F.inline(forms)).select("family", "eqm", F.posexplode("pi").alias("sense", "pi"))
    made = made.select("family", "eqm", "sense", F.element_at(names, F.col("sense") + 1).alias("codon"), "pi")
    f64 = codon_f64(codons).select("family", F.lit("F64").alias("eqm"), "sense", "codon", F.col("freq").alias("pi"))
    return made.unionByName(f64)


def enforce_aa(codon_freq: DataFrame, aa_freq: DataFrame, code: int = 0) -> DataFrame:
    """Rescale codon frequencies (family, codon, pi) to given amino-acid sums (family, aa, aa_pi)."""
    table = catalog.genetic_code(codon_freq.sparkSession, [code]).select("codon", "aa")
    w = Window.partitionBy("family", "aa")  # at most 6 codons
    return (
        codon_freq.join(table, "codon").withColumn("share", F.col("pi") / F.sum("pi").over(w))
        .join(aa_freq, ["family", "aa"], "left")
        .select("family", "codon", "aa", F.coalesce(F.col("share") * F.col("aa_pi"), F.lit(0.0)).alias("pi"))
    )


def adjust_aa(codons: DataFrame, code: int = 0) -> DataFrame:
    """Amino acid -> codon: sum n ln(n / n_aa), df = sense codons - 20, and the equal form."""
    w = Window.partitionBy("family", "aa")
    counts = codon_counts(codons).withColumn("n_aa", F.sum("n").over(w))
    fold = (
        catalog.genetic_code(codons.sparkSession, [code]).filter("aa is not null").groupBy("aa")
        .agg(F.count("*").alias("fold"))
    )
    df = len(catalog.sense_codons(code)) - 20
    return counts.join(F.broadcast(fold), "aa").groupBy("family").agg(
        F.sum(F.col("n") * F.log(F.col("n") / F.col("n_aa"))).alias("empirical"),
        (-F.sum(F.col("n") * F.log("fold"))).alias("equal"),
    ).select("family", "empirical", F.lit(df).alias("df"), "equal")


def _log_share(n, total):
    return F.when(n > 0, n * F.log(n / total)).otherwise(F.lit(0.0))


def nucleotide_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy("family").agg(*[F.count_if(F.col("ch") == b).alias(f"n_{b}") for b in BASES])


def adjust_ry(sites: DataFrame) -> DataFrame:
    """R/Y -> nucleotide: sum n ln(n / n_class), df 2."""
    n = {b: F.col(f"n_{b}") for b in BASES}
    r, y = n["A"] + n["G"], n["C"] + n["T"]
    value = sum((_log_share(n[b], r if b in "AG" else y) for b in BASES), F.lit(0.0))
    return nucleotide_counts(sites).select("family", value.alias("empirical"), F.lit(2).alias("df"))


def adjust_missing(sites: DataFrame) -> DataFrame:
    """Log probability of the nucleotides from their frequencies alone."""
    n = {b: F.col(f"n_{b}") for b in BASES}
    value = sum((_log_share(n[b], sum(n.values(), F.lit(0))) for b in BASES), F.lit(0.0))
    return nucleotide_counts(sites).select("family", value.alias("lnl_missing"))


def multinomial(pats: DataFrame) -> DataFrame:
    """sum n ln(n / N) = sum n ln n - N ln N: one aggregate, no window."""
    return pats.groupBy("family").agg(
        (F.sum(F.col("n") * F.log("n")) - F.sum("n") * F.log(F.sum("n"))).alias("lnl")
    )


def pattern_dist(pats: DataFrame, n_seq: int, keys=("family",), alphabet: str = catalog.DNA) -> DataFrame:
    """Counts of all len(alphabet)**n_seq patterns, zeros kept; at most four sequences."""
    if n_seq > 4:
        raise ValueError("all patterns are listed for at most 4 sequences")
    space = [""]
    for _ in range(n_seq):
        space = [p + c for p in space for c in alphabet]
    every = pats.select(*keys).distinct().withColumn("pattern", F.explode(F.array(*map(F.lit, space))))
    return every.join(pats, [*keys, "pattern"], "left").select(
        *keys, "pattern", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def kappa_from_columns(sites: DataFrame) -> DataFrame:
    """family, kappa: `guess_kappa` from the counts of the bases in each column, without any pair of sequences.

    In a column with n_A, n_C, n_G, n_T bases n_A n_G + n_C n_T pairs differ by a transition and
    (n_A + n_G)(n_C + n_T) by a transversion.
    """
    n = sites.groupBy("family", "pos").agg(*[F.count_if(F.col("ch") == b).alias(f"n_{b}") for b in BASES])
    a, c, g, t = (F.col(f"n_{b}") for b in "ACGT")
    return n.groupBy("family").agg(F.sum(a * g + c * t).alias("ts"), F.sum((a + g) * (c + t)).alias("tv")).select(
        "family", F.when(F.col("tv") > 0, 2 * F.col("ts") / F.col("tv")).otherwise(catalog.START_KAPPA).alias("kappa"))


def guess_kappa(pairs: DataFrame) -> DataFrame:
    """2 ts / tv over all sequence pairs; the start value where there is no transversion."""
    return pairs.groupBy("family").agg(F.sum("n_ts").alias("ts"), F.sum(F.col("n_diff") - F.col("n_ts")).alias("tv")).select(
        "family", F.when(F.col("tv") > 0, 2 * F.col("ts") / F.col("tv")).otherwise(catalog.START_KAPPA).alias("kappa")
    )


def summary(sites: DataFrame, pats: DataFrame, alphabet: str = catalog.DNA) -> DataFrame:
    """Sequences, length, patterns, sites by number of states, mean and SD of per-sequence frequencies."""
    kinds = sum((F.when(F.instr("pattern", c) > 0, 1).otherwise(0) for c in alphabet), F.lit(0))
    bare = F.replace("pattern", F.lit("-"), F.lit(""))
    by_site = pats.select("family", "n", kinds.alias("kinds"), bare.alias("bare"))
    site_side = by_site.groupBy("family", "bare", "kinds").agg(F.sum("n").alias("n"), F.count("*").alias("np")).groupBy(
        "family"
    ).agg(
        F.sum("n").alias("n_sites"), F.sum("np").alias("n_patterns"), F.count("*").alias("n_patterns_nogap"),
        *[F.sum(F.when(F.col("kinds") == k, F.col("n")).otherwise(0)).alias(f"sites_{k}") for k in range(1, len(alphabet) + 1)],
    )
    per_seq = sites.groupBy("family", "seq_id").agg(
        F.count_if(F.instr(F.lit(alphabet), F.col("ch")) > 0).alias("tot"),
        *[F.count_if(F.col("ch") == c).alias(f"n_{c}") for c in alphabet],
    )
    seq_side = per_seq.groupBy("family").agg(
        F.count("*").alias("n_seq"),
        *[F.avg(F.try_divide(f"n_{c}", "tot")).alias(f"mean_{c}") for c in alphabet],
        *[F.stddev_samp(F.try_divide(f"n_{c}", "tot")).alias(f"sd_{c}") for c in alphabet],
    )
    return site_side.join(seq_side, "family")
