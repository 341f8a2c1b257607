"""What the corpus operators share: reading tables, shared folders and bounded worker caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used where the session names no spark.checkpoint.dir and runs on one machine, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints/fathomlake"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session may do without, a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or DEFAULT_SHARED).rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """One folder for all tables that this application saves."""
    return f"{shared_dir(spark)}/fathomlake-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes what this application has saved; results that were not written elsewhere can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that nothing before it is computed again.

    The table outlives the lazy result that reads it; clear() removes all of an application's.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes the shuffle files of a saved table once the plan that made them is gone."""
    spark.sparkContext._jvm.System.gc()


#: Rows of texts that go to a Python worker at once, where the session keeps Spark's own 10,000: these can be 100 MB in each worker.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Sets the rows of an Arrow batch to BATCH_ROWS, unless the session has a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of whatever columns the table has, null texts as empty ones."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def mapped(docs: DataFrame, run, columns: str) -> DataFrame:
    """mapInPandas over (doc_id, text): doc_id travels as a string, as pandas would turn nullable longs into doubles."""
    kind = docs.schema["doc_id"].dataType
    out = texts(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, f"doc_id string, {columns}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


class BoundedCache(dict):
    """A worker's cache; when full it keeps what the batch at hand has in it and drops the rest, so its memory is bounded whatever the vocabulary."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def missing(self, keys: set) -> list:
        """Those of `keys` that are to be computed; the cache has room for them afterwards."""
        new = [k for k in keys if k not in self]
        if len(self) + len(new) > self.limit:
            kept = [(k, self[k]) for k in keys if k in self]
            self.clear()
            self.update(kept)
        return new


#: What this worker keeps from task to task; each operator's module adds its own.
WORKER_CACHES: list[dict] = []


def release() -> None:
    """Frees what operators that ran before have left in this worker, and gives the memory back to the system.

    Called at the start of a task whose operator needs no such cache, as a worker serves one operator after another.
    """
    if any(WORKER_CACHES):
        for cache in WORKER_CACHES:
            cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # elsewhere than with glibc there is nothing to trim
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def sliced(batches: Iterator[pd.DataFrame], chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """The batches in pieces of about so many characters of text (a longer text is a piece by itself), to bound memory."""
    for batch in batches:
        at = (batch["text"].str.len().cumsum() // chars).to_numpy()
        cuts = [0, *((at[1:] != at[:-1]).nonzero()[0] + 1), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.iloc[a:b].reset_index(drop=True)
