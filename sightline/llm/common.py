"""What the operators of this subpackage share: the shared folder, checkpoints, documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (tests in one
    process) a temporary folder of the driver serves and is set for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="sightline-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder as Parquet and read again: cut from its lineage like a
    checkpoint, but compressed."""
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, marked for broadcasting if it has so many rows at most; beyond, joins shuffle.
    For rows of a few numbers that are checkpointed or stored."""
    return F.broadcast(df) if df.count() <= rows else df


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand at most so many rows at once to Python for the rest of the session: whole documents
    are long, and Spark holds a batch several times while it passes it on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of a query when it ends, for the rest of the session: else
    they lie on the executors' disks until the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def released(work):
    """``work`` over a task's batches, after which freed memory goes back to the system: Python
    workers live on between tasks and would keep it."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    """Freed memory goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def filesystem(uri: str):
    """The pyarrow filesystem and the path there of a URI, for files that tasks read and write."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text read as an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def smallest_hashes(df: DataFrame, hashed, rows: int, *ties: str, buckets: int = 4096) -> DataFrame:
    """The ``rows`` rows with the smallest hash, all if there are fewer. A histogram of the
    hashes says which of them come into the sort, so that tasks don't each send that many."""
    top = 1 << 20
    part = F.pmod(hashed, F.lit(top))
    bucket = F.floor(part * buckets / top).cast("long")
    total, last = 0, -1
    for row in df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).orderBy("bucket").collect():
        total, last = total + row["n"], row["bucket"]
        if total >= rows:
            break
    return df.filter(bucket <= last).orderBy(part, hashed, *ties).limit(rows)
