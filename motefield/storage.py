"""Where intermediate tables are written so that long plans survive lost executors.

A cluster names a folder that all executors share in ``spark.checkpoint.dir``. Where that
setting is missing, a folder of this machine is used if driver and executors are one process
(tests, a laptop); elsewhere it is an error, since executors would not see each other's files.

Tables stay until they are deleted, since a lazy result may still read them. A job that writes
its result wraps operators and write in ``temporary``, which deletes them behind it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and has no other machine.
LOCAL_ROOT = "/tmp/checkpoints/motefield"

#: Folders of the tables that this process has written and not deleted, in order.
_WRITTEN: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session, or ``LOCAL_ROOT`` in local mode where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master}")
    return LOCAL_ROOT


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows rereads files that every executor sees, so an
    executor lost later costs only its running tasks. An empty frame keeps its schema.
    A join of two such tables shuffles both and nothing else, so adaptive execution can
    deal a hot key's rows over several tasks, which it can't where an aggregate on the key
    shares the join's shuffle.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/motefield-{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches to Python workers hold ``most`` bytes, unless they hold less already.

    For plans whose rows are wide: a worker then needs a few times ``most``, not a few times
    the default of 64 MB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(filter(str.isdigit, spark.conf.get(name, "67108864"))) or 0)
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def folders(df: DataFrame) -> set[str]:
    """Names of the materialized tables that ``df`` reads."""
    return {part for name in df.inputFiles() for part in name.split("/") if part.startswith("motefield-")}


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    names = folders(df)
    for path in [p for p in _WRITTEN if p.rsplit("/", 1)[1] in names]:
        _delete(df.sparkSession, path)
        _WRITTEN.remove(path)


@contextmanager
def temporary(spark: SparkSession, keep: str | None = None) -> Iterator[None]:
    """Deletes what is materialized inside, but for tables of the tag ``keep``. Results that
    read the rest must have been written before the end."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before and not (keep and f"/motefield-{keep}-" in p)]:
            _delete(spark, path)
            _WRITTEN.remove(path)
