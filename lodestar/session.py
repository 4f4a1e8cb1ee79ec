"""Session helpers: shipping the package to the workers and staging tables on shared storage."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Also has unions not claim their inputs' partitioning: with that, Spark 4.1 zips inputs that adaptive execution has
    coalesced differently ("Can't zip RDDs with unequal numbers of partitions").
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestar-ship-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, f"lodestar_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; an own one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = tempfile.mkdtemp(prefix="lodestar-shared-")
            atexit.register(shutil.rmtree, base, True)
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestar-staging/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet on the shared folder and read it back: cuts lineage, survives lost executors."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stage``, in buckets by ``key`` (as many as there are shuffle partitions): grouping by it, or with another such table, needs no shuffle.

    The table's files are below the shared folder; its name stays in the session's catalog.
    """
    table = f"lodestar_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(task_count(df.sparkSession), key).option("path", staging_path(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)


def clear_staging(spark: SparkSession) -> None:
    """Delete every staged table of this shared folder; call it when no result that reads them is in use."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestar-staging")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt out anew if it has fewer partitions than there are cores (a small file, or one row group); larger ones stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def task_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def signature(scan: DataFrame) -> str:
    """A text that changes when the files of ``scan`` do: a hash of their paths, sizes and times, from listings of their folders."""
    jvm, conf = scan.sparkSession.sparkContext._jvm, scan.sparkSession.sparkContext._jsc.hadoopConfiguration()
    files = scan.inputFiles()
    seen = []
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        seen += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in path.getFileSystem(conf).listStatus(path)]
    return hashlib.sha256("\n".join([*sorted(files), *sorted(seen)]).encode()).hexdigest()
