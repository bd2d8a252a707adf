"""Written intermediates and shared scratch space.

Both live in the folder the cluster names in ``spark.checkpoint.dir``: shared storage that
every executor reaches, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows, and most bytes of files, of a written table that is broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A folder of our own is made only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="fleetmill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote. One that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet below the shared folder once and returns a reader of the files.

    What reads it scans the columns it needs, and filters reach the files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame) -> DataFrame:
    """``df``, with one row per key, written out as the side of a join that is looked up.

    It is broadcast if its rows and the size of its files are small. If not, both sides of the join
    come from a shuffle of their own, which is what adaptive execution needs to split a key that
    holds much of the other side: it cannot do so while this side is still the output of an
    aggregation or of another join on the same key.
    """
    written = materialize(df)
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size <= BROADCAST_BYTES and written.count() <= BROADCAST_ROWS
    return F.broadcast(written) if small else written


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
