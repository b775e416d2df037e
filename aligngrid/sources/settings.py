"""Model switches, saved model files and matrix files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aligngrid.functions import scalar as S
from aligngrid.operators.recode import listagg
from aligngrid.sources.lines import lines_of, read_bundles, read_lines


def parse_switches(lines: DataFrame) -> DataFrame:
    """keys, layer, idx, line -> keys, layer, section, name, value (lower-cased section and name).

    A line that is no section, comment or assignment raises an error. A name given twice
    takes its last value. A file of switches is a handful of lines.
    """
    keys = [c for c in lines.columns if c not in ("layer", "idx", "line")]
    text = F.trim(F.regexp_replace("line", r"(^|\s);.*$", ""))
    rows = lines.withColumn("t", text).filter("t <> '' and not startswith(t, '#') and not startswith(t, ';')")
    w = Window.partitionBy(*keys, "layer").orderBy("idx")
    section = F.regexp_extract("t", r"^\[([^\]]*)\]$", 1)
    is_section = F.col("t").rlike(r"^\[[^\]]*\]$")
    rows = rows.withColumn("section", F.last(F.when(is_section, F.lower(section)), ignorenulls=True).over(w)).filter(~is_section)
    name = F.lower(F.trim(F.regexp_extract("t", r"^([^=:]+)[=:]", 1)))
    value = F.trim(F.regexp_extract("t", r"^[^=:]+[=:](.*)$", 1))
    ok = F.col("t").rlike(r"^[^=:]+[=:]")
    rows = rows.select(*keys, "layer", "section", "idx", F.when(ok, name).otherwise(
        F.raise_error(F.concat(F.lit("cannot read switch line: "), "t"))).alias("name"), value.alias("value"))
    return rows.groupBy(*keys, "layer", "section", "name").agg(F.max_by("value", "idx").alias("value"))


def read_switches(spark: SparkSession, home: str | None, cwd: str | None, key=None, bundled: bool = False) -> DataFrame:
    """`parse_switches` of the files of both layers. key: a column of `path` that tells apart the settings of many runs. bundled: the
    files are in bundles (`lines.write_bundles`)."""
    out = None
    for layer, path in (("home", home), ("cwd", cwd)):
        if path is not None:
            lines = lines_of(read_bundles(spark, path)) if bundled else read_lines(spark, path)
            one = lines.select(*([key] if key is not None else []), F.lit(layer).alias("layer"), "idx", "line")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no file of switches is given")
    return parse_switches(out)


def on_off(value):
    v = F.lower(value)
    return F.when(v.isin("true", "yes", "on", "1"), True).when(v.isin("false", "no", "off", "0"), False)


def resolve_switches(switches: DataFrame) -> DataFrame:
    """keys, section, switch, is_on: the working directory overrides home; unreadable or missing = next layer, then on."""
    keys = [c for c in switches.columns if c not in ("layer", "section", "name", "value")]
    on = [*keys, "section", "name"]
    v = switches.withColumn("on", on_off(F.col("value")))
    home = v.filter("layer = 'home'").select(*on, F.col("on").alias("home"))
    cwd = v.filter("layer = 'cwd'").select(*on, F.col("on").alias("cwd"))
    return home.join(cwd, on, "full_outer").select(
        *keys, "section", F.col("name").alias("switch"), F.coalesce("cwd", "home", F.lit(True)).alias("is_on"))


def read_models(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Saved model files: records end with ';' -> model_id (path), record, key, name, value. bundled: as in `read_switches`."""
    if bundled:
        raw = read_bundles(spark, path).select(F.col("path").alias("model_id"), F.explode(F.split("text", ";")).alias("value"))
        raw = raw.select("model_id", F.monotonically_increasing_id().alias("id"), "value")
    else:
        raw = spark.read.option("lineSep", ";").option("recursiveFileLookup", True).text(path).select(
            F.col("_metadata.file_path").alias("model_id"), F.monotonically_increasing_id().alias("id"), "value")
    return parse_models(raw.select("model_id", "id", F.trim(F.translate("value", "\r\n", "  ")).alias("t")))


def parse_models(records: DataFrame) -> DataFrame:
    """model_id, id, t -> model_id, key, name, value: Model, DataType, Data, Parameter (named), Tree."""
    par = F.regexp_extract("t", r"^Parameter\[\d+\]:?\s*(.*?)\s*=", 1)
    key = F.regexp_extract("t", r"^(Model|DataType|Data|Parameter|Tree|Current_random_seed)(\[\d+\])?:", 1)
    value = F.when(key == "Parameter", F.regexp_extract("t", r"=\s*(\S+)\s*$", 1)).otherwise(
        F.trim(F.regexp_extract("t", r"^[A-Za-z_]+:\s*(.*)$", 1)))
    return records.filter("t <> '' and not startswith(t, '#')").select(
        "model_id", key.alias("key"), F.when(key == "Parameter", par).alias("name"), value.alias("value")).filter("key <> ''")


def model_parameters(parsed: DataFrame) -> DataFrame:
    """model_id, model, name, value of all parameters."""
    head = parsed.filter("key = 'Model'").select("model_id", F.col("value").alias("model"))
    return parsed.filter("key = 'Parameter'").join(head, "model_id").select(
        "model_id", "model", "name", F.col("value").cast("double").alias("value"))


def unknown_parameters(parameters: DataFrame, known: DataFrame) -> DataFrame:
    """Parameters of a file that the model does not have (known: model, name)."""
    return parameters.join(known, ["model", "name"], "left_anti")


def read_matrices(spark: SparkSession, path: str, n_states: int = 20) -> DataFrame:
    """Matrix files in the published form -> model (file name), s, pi.

    A file holds the lower triangle by rows (n (n-1) / 2 numbers), then n frequencies;
    what follows the last number wanted is ignored. A file is a few hundred numbers.
    """
    return matrices_from_lines(read_lines(spark, path), n_states)


def matrices_from_lines(lines: DataFrame, n_states: int = 20) -> DataFrame:
    """path, idx, line -> model (last part of the path without ending), s, pi."""
    n = n_states * (n_states - 1) // 2
    lines = lines.filter(F.col("line").rlike(r"^\s*[-+0-9.]"))
    text = lines.groupBy("path").agg(listagg("line", "idx", " ").alias("t"))
    numbers = F.filter(F.transform(S.tokens("t"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    name = F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z]+)?$", 1)
    rows = text.select(name.alias("model"), numbers.alias("x"))
    size = F.when(F.size("x") >= n + n_states, F.slice("x", 1, n)).otherwise(
        F.raise_error(F.concat(F.lit("too few numbers in matrix "), "model")))
    pi = F.slice("x", n + 1, n_states)
    return rows.select("model", size.alias("s"), F.transform(pi, lambda p: p / F.aggregate(
        pi, F.lit(0.0), lambda a, b: a + b)).alias("pi"))


def exchangeability(matrices: DataFrame, n_states: int = 20) -> DataFrame:
    """model, i < j, s in long form."""
    cells = F.array(*[F.struct(F.lit(j).alias("i"), F.lit(i).alias("j")) for i in range(n_states) for j in range(i)])
    return matrices.select("model", F.explode(F.arrays_zip(cells.alias("c"), F.col("s"))).alias("z")).select(
        "model", "z.c.i", "z.c.j", "z.s")


def matrix_lines(exchange: DataFrame, freq: DataFrame, keys=("model",)) -> DataFrame:
    """keys, ord, line: a matrix file's text from long tables (i < j, s) and (state, pi)."""
    low = exchange.groupBy(*keys, F.col("j").alias("ord")).agg(listagg("cast(s as string)", "i", " ").alias("line"))
    last = freq.groupBy(*keys).agg(listagg("cast(pi as string)", "state", " ").alias("line")).withColumn("ord", F.lit((1 << 31) - 1))
    return low.unionByName(last.select(low.columns))
