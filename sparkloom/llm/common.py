"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a Python worker remembers for each purpose: several caches outlive their tasks, so together they must stay small.
REMEMBERED = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session (tests) that names none gets a temporary folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` once in the shared folder and cuts its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: its lineage ends, and Spark knows its bytes.

    The table goes when the application ends.
    """
    path = path or f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    goes_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def goes_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that are read no more, and has shuffles of frames that are gone deleted."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()


def rebuilt(df: DataFrame) -> DataFrame:
    """``df`` cut, and built anew from its rows: a checkpoint keeps its plan's estimate of size, which joins multiply from round to round."""
    spark, held = df.sparkSession, cut(df)
    return DataFrame(spark._jsparkSession.createDataFrame(held._jdf.javaRDD(), held._jdf.schema()), spark)


def thin(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` rows as counted by the caller, in no more partitions than they fill.

    Every partition of a cut is a file, and on local disks Hadoop starts a process for each.
    """
    return df.coalesce(max(1, -(-rows // 100_000)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with a number after it where ``df`` has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(2, len(taken) + 3))) if x.lower() not in taken)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Sessions that leave Arrow batches at Spark's default (10,000 rows) get ``rows``.

    A batch is held several times over by the JVM and its Python workers, and texts can be long.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Gives a Python worker's free memory back at the end of a task: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def settle() -> None:
    """The same on the driver, after it has passed a table on."""
    gc.collect()
    trim()


def narrow_text(df: DataFrame, *cols: str) -> DataFrame:
    """Only the columns an operator reads, so that clashing extra columns never matter."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def as_batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from values and types by name."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()], names=list(columns)
    )
