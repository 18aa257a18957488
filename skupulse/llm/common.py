"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "_skupulse_store_"   # prefix of what worker processes keep between tasks
# The six ASCII white-space characters that separate words in every contract.
SPACE = "\\x20\\x09-\\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a
    local session without that setting (tests) gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = os.path.join(tempfile.gettempdir(), "skupulse-checkpoints")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let go of what frames that are gone have left: Spark's cleaner removes
    shuffles, broadcasts and checkpoints once the driver's JVM has collected the
    objects that stand for them, and the heap shrinks to what is still held.  Long
    iterations otherwise keep all of it until the heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_remainder(col, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def hash_share(df: DataFrame, rows: int, total: int, *cols) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of ``cols``: the same
    rows in every run.  Only for samples that fit a model."""
    if total <= rows:
        return df
    bound = int(rows / total * 1_000_003)
    return df.where(F.pmod(F.xxhash64(*cols), F.lit(1_000_003)) < bound)


def release_stores() -> None:
    """Free what an earlier operator's tasks left in this worker process."""
    for name in [k for k in vars(sys) if k.startswith(STORE)]:
        del vars(sys)[name]


def slices(batches, rows: int = 2_048):
    """Arrow batches in parts of at most ``rows`` rows, so that what a task
    holds beside a batch stays small."""
    for batch in batches:
        for first in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(first, rows)


def frugal(run):
    """A function over Arrow batches that, once its task has ended, hands the
    memory it no longer uses back to the system: worker processes live on, and
    several of them share an executor's memory."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc only
            if trim is not None:
                trim(0)
    return wrapped
