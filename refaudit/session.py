"""Session helpers shared by all operators: reading, checkpoints, explain checks."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, as a lazily scanned DataFrame."""
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Only in local mode (tests), where none is set, a temporary folder of the machine is used and
    removed at the end; elsewhere that is an error, as other machines could not read it.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="refaudit-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    A reliable checkpoint survives the loss of executors, unlike a cached or locally
    checkpointed result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the files of shuffles dropped whose plans nothing refers to; else that waits until the
    driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def atomic_write(path: str, text: str, encoding: str = "utf-8", newline: str = "\n") -> None:
    """Write a single file through a synced temporary one beside it, then rename."""
    target = os.path.abspath(path)
    body = text.replace("\r\n", "\n").replace("\n", newline).encode(encoding)
    handle, temporary = tempfile.mkstemp(prefix=".part-", dir=os.path.dirname(target))
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, target)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
