"""What the operators share: written tables, and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmill.session import scratch_path

#: Most rows of an Arrow batch that are worked on at once.
SLICE_ROWS = 1_000
#: Most characters of the texts worked on at once; a single longer text is worked on alone.
SLICE_CHARS = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written as Parquet below the shared folder and read back: its lineage ends here."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded rows and, but for single long texts, bounded characters."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for i, length in enumerate(lengths):
            if i > start and (i - start >= SLICE_ROWS or size + length > SLICE_CHARS):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += length
        if len(lengths) > start:
            yield batch.slice(start)


def in_tasks(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """``mapInArrow``, after which a task's memory goes back to the system.

    Python workers outlive their tasks. What one has freed and not returned, or holds for tasks that
    do not come any more, would count on top of what the next stages need.
    """
    stage = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold_for(stage)
        yield from work(batches)
        give_back()

    return df.mapInArrow(run, schema)


#: What this worker holds from one task to the next, and the stage of :func:`in_tasks` that it is for.
_held: dict[tuple, Any] = {}
_held_for = ""


def held(make: Callable[..., Any], *args: Any) -> Any:
    """``make(*args)``, made once in a worker for all tasks of a stage of :func:`in_tasks`."""
    key = (make, *args)
    if key not in _held:
        _held[key] = make(*args)
    return _held[key]


def _hold_for(stage: str) -> None:
    """Drops what was held for another stage."""
    global _held_for
    if _held_for != stage:
        _held.clear()
        _held_for = stage
        give_back()


def give_back() -> None:
    """Freed memory that Arrow and the C library hold for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the least node reachable.

    Alternating large-star and small-star steps. Each step sends every edge of a node to the
    node's least neighbour; the edges end as stars around the roots. The least neighbours are
    written, so that the join with them reads two shuffles and adaptive execution can split a node
    with very many edges.
    """
    stars = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(stars)
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large_star")
        least = _to_least(large)
        small = least.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.where("b = m").select("a", F.col("m").alias("b")))
        # Every node sends itself and its smaller neighbours to the least of them.
        small = small.union(least.where("b <> m").select("a", F.col("m").alias("b")))
        before, stars = stars, written(small.where("a <> b").distinct(), "small_star")
        now = _state(stars)
        drop_written(before)
        drop_written(large)
        if now == state:
            break
        state = now
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _to_least(edges: DataFrame) -> DataFrame:
    """Every edge ``(a, b)`` with ``m``, the least of ``a`` and all that ``a`` is joined to."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("low")), "least")
    return edges.join(least, "a").select("a", "b", F.least("a", "low").alias("m"))


def _state(edges: DataFrame) -> tuple:
    """One row that tells two sets of edges apart."""
    return tuple(
        edges.agg(
            F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(b as decimal(38,0)))")
        ).first()
    )
