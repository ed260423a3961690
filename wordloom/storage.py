"""Shared storage: tables written between the rounds of a job.

Everything lies in one folder of the application under ``spark.checkpoint.dir`` and goes when its JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, an own one, in local
    mode only: on a cluster a folder of one machine is no shared one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """A path as Hadoop has it, and its file system."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's folder."""
    root = f"{shared_dir(spark)}/wordloom-{spark.sparkContext.applicationId}"
    folder, store = _folder(spark, root)
    if not store.exists(folder):
        store.mkdirs(folder)
        store.deleteOnExit(folder)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete what was written there."""
    folder, store = _folder(spark, path)
    store.delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder, store = _folder(spark, path)
    return store.exists(folder)


def write(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` and read it back."""
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str = "table", compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors."""
    return write(df, scratch_path(df.sparkSession, label), compression)


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join, both sides of which are to be shuffled and sorted, never broadcast. Spark takes a stored table to be
    as large as its files; rows of short, alike strings are ten and more times that in the driver's memory."""
    return df.hint("merge")


def clustered(df: DataFrame, label: str, *columns: str, onto: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in buckets of ``columns``, sorted by them, or append it to such a table (``onto``); gives the
    table and its name. Joins on these columns find it dealt out: only their other side is shuffled. It has as many
    buckets as a shuffle has partitions, else Spark would deal it out anew."""
    spark = df.sparkSession
    n = int(onto.split("_")[-2] if onto else spark.conf.get("spark.sql.shuffle.partitions"))
    name = onto or f"wordloom_{label}_{n}_{uuid.uuid4().hex}"
    writer = df.repartition(n, *columns).write.bucketBy(n, *columns).sortBy(*columns).format("parquet").option("compression", "zstd")
    if onto is None:
        writer.option("path", scratch_path(spark, label)).saveAsTable(name)
    else:
        writer.mode("append").saveAsTable(name)
    return spark.table(name), name


#: Names of a table's snapshots: whole ones, and what was added to the last whole one.
_WHOLE, _ADDED = "whole", "added"
#: Whole snapshots that are kept: the last, and one before it for those who still read it.
KEPT = 2


def _snapshots(spark: SparkSession, path: str, begun: bool = False) -> list[str]:
    """Names of the complete snapshots of a table, oldest first; ``begun``: also of those that never were completed."""
    folder, store = _folder(spark, path)
    if not store.exists(folder):
        return []
    names = sorted(x.getPath().getName() for x in store.listStatus(folder) if x.isDirectory())
    named = [n for n in names if n.split("-")[-1] in (_WHOLE, _ADDED)]
    return named if begun else [n for n in named if store.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0])]


def published(spark: SparkSession, path: str) -> list[str]:
    """The folders that make up a table now: its last whole snapshot and all that was added since. None if there is none."""
    names = _snapshots(spark, path)
    last = max((i for i, n in enumerate(names) if n.endswith(_WHOLE)), default=None)
    return [] if last is None else [f"{path}/{n}" for n in names[last:]]


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """A table as it was published last."""
    return spark.read.parquet(*published(spark, path))


def publish(df: DataFrame, path: str, add: bool = False) -> None:
    """Write ``df`` as the new snapshot of a table, or as an addition to it.

    A snapshot counts from the moment its last task is committed. Until then, and if the write fails, readers have the
    one before; a whole snapshot doesn't touch the files of another, so ``df`` may be made of what it replaces."""
    spark = df.sparkSession
    names = _snapshots(spark, path)
    number = int(names[-1].split("-")[0]) + 1 if names else 1
    name = f"{number:08d}-{uuid.uuid4().hex[:8]}-{_ADDED if add and names else _WHOLE}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/{name}")
    whole = [n for n in _snapshots(spark, path) if n.endswith(_WHOLE)]
    if len(whole) > KEPT:
        for old in (n for n in _snapshots(spark, path, begun=True) if n < whole[-KEPT]):
            drop(spark, f"{path}/{old}")
