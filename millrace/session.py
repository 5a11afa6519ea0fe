"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine is designed for; a cluster may override every one of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword settings use __ for a dot."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in spark.checkpoint.dir, else the one set for
    checkpoints; only where all run on one machine, as in local tests, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-shared-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where its files make fewer partitions than there are, as one small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


#: Rows, about, that one task of a shuffle holds where dealt() makes it.
ROWS_AT_ONCE = 1 << 18


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df, of about n rows, shuffled by keys into tasks of about ROWS_AT_ONCE. Spark joins partitions by their bytes after compression,
    of which small rows take few, so its tasks would hold more rows the more there are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_AT_ONCE)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and drop its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each Spark context, so that Python tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="millrace-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._millrace_shipped = True


def stash(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared checkpoint folder and reads it back: like cut(), but
    columnar and compressed, for wide intermediate tables. sweep() removes these tables."""
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc._millrace_paths = [*getattr(sc, "_millrace_paths", []), path]
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Deletes the tables that stash() wrote in this session; results that were not yet saved are lost."""
    sc = spark.sparkContext
    paths = getattr(sc, "_millrace_paths", [])
    for p in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    sc._millrace_paths = []
    return len(paths)
