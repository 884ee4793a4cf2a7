"""Session helpers: shared folder, lineage cuts, shipping the package to executors."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` if the session names one.

    Only a single-machine session (``local[...]``) without that setting gets a temporary folder, which becomes its
    checkpoint folder and goes when Python ends. On a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if current.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder all executors share (master {sc.master})")
        made = tempfile.mkdtemp(prefix="lamina-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir("file://" + made)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def pin(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and forget how it was made.

    Partition order, and row order inside a partition, stay as they were. The copy
    outlives any executor, unlike a local checkpoint. :func:`release` removes all copies.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pin_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`pin` and the number of rows, counted while they are written."""
    seen = Observation()
    out = pin(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


_tables: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: like :func:`pin`, with a size the optimizer knows, but without its row order."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`written` and the number of rows, counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def release(spark: SparkSession) -> None:
    """Delete all tables this application has pinned or written; results that read them must have been written before."""
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    conf, new = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for t in _tables:
        path = new(t)
        path.getFileSystem(conf).delete(path, True)
    _tables.clear()
    if not made.isEmpty():
        path = new(made.get())
        fs = path.getFileSystem(conf)
        for f in fs.listStatus(path) if fs.exists(path) else []:
            fs.delete(f.getPath(), True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lamina-{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per Spark application, through the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_lamina_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("lamina") / p.relative_to(root))
    uri = scratch_path(spark, "package") + "/lamina_pkg.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(uri)
    sc._lamina_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
