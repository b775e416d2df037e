"""Recoding of alignments in long form (family, seq_id, pos, ch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.functions import scalar as S

# Sites of one sequence or family are handled in blocks of this length, so that
# one long alignment spreads over many tasks.
BLOCK = 4096


def listagg(value: str, order: str, sep: str = ""):
    return F.expr(f"listagg({value}, '{sep}') within group (order by {order})")


def join_sites(sites: DataFrame, keys=("family", "seq_id"), ch: str = "ch") -> DataFrame:
    """Sites to one text per sequence: joined inside blocks first, blocks then."""
    blocks = (
        sites.groupBy(*keys, F.expr(f"pos div {BLOCK}").alias("block")).agg(listagg(ch, "pos").alias("part"))
    )
    return blocks.groupBy(*keys).agg(listagg("part", "block").alias("seq"))


def split_seqs(seqs: DataFrame) -> DataFrame:
    """Texts to sites."""
    keep = [c for c in seqs.columns if c not in ("seq", "name")]
    return seqs.select(*keep, F.posexplode(F.split("seq", "")).alias("pos", "ch")).filter("ch <> ''")


def recode_ry(sites: DataFrame) -> DataFrame:
    return sites.withColumn("ch", S.to_ry("ch"))


def make_codons(sites: DataFrame) -> DataFrame:
    """Three sites to one codon: family, seq_id, cpos, codon."""
    return sites.groupBy("family", "seq_id", F.expr("pos div 3").alias("cpos")).agg(
        listagg("ch", "pos").alias("codon")
    )


def codons_of(seqs: DataFrame) -> DataFrame:
    """Texts (family, seq_id, seq) to codons: family, seq_id, cpos, codon, cut inside the row; a last part of one or two
    sites is kept as it is."""
    n = F.ceil(F.length("seq") / 3).cast("int")
    cut_out = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.substring(F.col("seq"), c * 3 + 1, F.lit(3)))
    return seqs.filter(F.length("seq") > 0).select("family", "seq_id", F.posexplode(cut_out).alias("cpos", "codon"))


def codon_sites(codons: DataFrame) -> DataFrame:
    """Codons back to sites."""
    return codons.select(
        "family", "seq_id", "cpos", "codon", F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    ).select(
        "family", "seq_id", (F.col("cpos") * 3 + F.col("k")).alias("pos"),
        F.substring("codon", F.col("k") + 1, F.lit(1)).alias("ch"),
    )


def with_code(codons: DataFrame, code: int = 0) -> DataFrame:
    """Adds codon_idx, aa, aa_ch, sense; NULL for stops and gaps (768-row broadcast table)."""
    table = catalog.genetic_code(codons.sparkSession, [code]).drop("code")
    return codons.join(table, "codon", "left")


def translate(codons: DataFrame, code: int = 0) -> DataFrame:
    return with_code(codons, code).select(
        "family", "seq_id", F.col("cpos").alias("pos"), F.coalesce("aa_ch", F.lit("-")).alias("ch")
    )


def reduce_codons(codons: DataFrame, code: int = 0) -> DataFrame:
    """Sense codons renumbered 0..n-1; stops and gaps get NULL."""
    return with_code(codons, code).select("family", "seq_id", "cpos", "codon", "sense")


def expand_codons(states: DataFrame, code: int = 0) -> DataFrame:
    """Sense state back to its codon."""
    table = catalog.genetic_code(states.sparkSession, [code]).filter("sense is not null").select("sense", "codon")
    return states.join(table, "sense", "left").withColumn("codon", F.coalesce("codon", F.lit("---")))


def codon_positions(sites: DataFrame, keep=(0, 1, 2)) -> DataFrame:
    """Keep some codon positions; columns renumbered by arithmetic, no window."""
    keep = sorted(keep)
    rank = F.coalesce(*[F.when(F.expr("pos % 3") == k, F.lit(i)) for i, k in enumerate(keep)])
    return sites.filter(F.expr("pos % 3").isin(keep)).withColumn(
        "pos", F.expr("pos div 3") * len(keep) + rank
    )


def pair_columns(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two columns as one pair-state column, for a table of column pairs (family, pos1, pos2)."""
    a = sites.select("family", "seq_id", F.col("pos").alias("pos1"), F.col("ch").alias("ch1"))
    b = sites.select("family", "seq_id", F.col("pos").alias("pos2"), F.col("ch").alias("ch2"))
    return (
        pairs.join(a, ["family", "pos1"]).join(b, ["family", "seq_id", "pos2"])
        .select("family", "seq_id", "pos1", "pos2", F.concat("ch1", "ch2").alias("state"))
    )


def profile_path(sites: DataFrame, alphabet: str = catalog.DNA) -> DataFrame:
    """Adjacent match/delete steps MM, MD, DM, DD.

    The next site is looked up inside blocks; the first site of a block is also
    sent to the block before it, so no window spans a whole sequence.
    """
    at = F.expr(f"pos div {BLOCK}")
    halo = F.when(F.expr(f"pos % {BLOCK} = 0 and pos > 0"), F.array(at, at - 1)).otherwise(F.array(at))
    rows = sites.select(
        "family", "seq_id", "pos", F.when(S.state_index("ch", alphabet).isNotNull(), "M").otherwise("D").alias("md"),
        F.explode(halo).alias("block"),
    )
    w = Window.partitionBy("family", "seq_id", "block").orderBy("pos")
    return (
        rows.withColumn("nxt", F.lead("md").over(w))
        .filter((at == F.col("block")) & F.col("nxt").isNotNull())
        .select("family", "seq_id", "pos", F.concat("md", "nxt").alias("step"))
    )


def match_set(path: DataFrame) -> DataFrame:
    """Steps that start in a match, recoded R (to match) and Y (to delete)."""
    return path.filter("step like 'M%'").withColumn("ch", F.when(F.col("step") == "MM", "R").otherwise("Y"))


def delete_set(path: DataFrame) -> DataFrame:
    """Steps that start in a delete, recoded R (to delete) and Y (to match)."""
    return path.filter("step like 'D%'").withColumn("ch", F.when(F.col("step") == "DD", "R").otherwise("Y"))


def dense_positions(columns: DataFrame) -> DataFrame:
    """Number the given (family, pos) rows 0..m-1 by position: counts per block, offsets over blocks."""
    block = F.expr(f"pos div {BLOCK}")
    rows = columns.withColumn("block", block)
    w = Window.partitionBy("family").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("family", "block").count().select(
        "family", "block", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("family", "block").orderBy("pos")
    return (
        rows.withColumn("rank", F.row_number().over(inside) - 1)
        .join(offsets, ["family", "block"])
        .select("family", "pos", (F.col("before") + F.col("rank")).alias("new_pos"))
    )
