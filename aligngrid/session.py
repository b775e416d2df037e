"""Session helpers: shared folder, lineage cuts and stored tables."""

from __future__ import annotations

import math
import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def make_session(cpus: str | int = "*", memory: str = "12g", shuffle_partitions: int | None = None,
                 shared: str | None = None):
    """A local session; shared: the folder for lineage cuts and stored tables."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 2))
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared) if shared else SparkSession.builder
    return (
        builder.master(f"local[{cpus}]")
        .appName("aligngrid")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: `spark.checkpoint.dir` of the session.

    Only a local session may run without the setting; it gets a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="aligngrid-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package (once per application)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = pathlib.Path(__file__).resolve().parent
        base = tempfile.mkdtemp(prefix="aligngrid-py-")
        spark.sparkContext.addPyFile(
            shutil.make_archive(f"{base}/aligngrid", "zip", root_dir=root.parent, base_dir=root.name))
        _shipped.add(app)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, merge: bool = True) -> DataFrame:
    """Materialise `df` in the shared folder and drop its lineage.

    merge: unions and joins add up partitions from round to round, so no more than the session's shuffle partitions
    are kept; not for a table that is just read, whose reading it would narrow.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    if merge:
        df = df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt out by `keys` in partitions of about `rows` rows.

    For small rows that many are made of in the same task: a shuffle's partitions are sized by the bytes that come in, so the work of a
    task would grow with the input. The rows are counted, so `df` is best a table that is just read or cut.
    """
    return df.repartition(max(1, math.ceil(df.count() / rows)), *keys)


def store(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back (columnar, prunable); codec: the session's if none is given."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
