"""Embedding near duplicates by a pivot-permutation index (operator 10).

A vector is described by which of a fixed set of reference vectors, the pivots, lie nearest to it,
in order. Inverted lists hold, for each pair of pivots, the vectors that have both among their
nearest: vectors that share two pivots or more meet in a list. They are then compared exactly, in the
list of the two first pivots they share, so that each pair is compared once. Equal vectors are one
class from the start. A list gives, for each vector, how many links it has there and one link to the
least vector it is connected with, however many there are.

The order of the pivots does not tell members of one dense group apart. Around the densest places of
a sample lie cells. A vector in a cell is compared with all vectors that can be linked with it by the
angles to the centre, block against block, so it misses no link; it is in no inverted list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.llm.common import components, written
from fleetmill.llm.simhash import Forest

#: Nearest pivots that describe a vector.
NEAREST = 6
#: Fewest and most pivots. There are about as many as the root of the number of vectors, so that
#: lists stay short, up to a number that always fits a task.
FEWEST_PIVOTS, MOST_PIVOTS = 48, 1_024
#: Vectors of a list that are compared in one go; longer lists are cut into chunks and every two
#: chunks are compared.
CHUNK = 512
#: Vectors by least hash among which pivots and centres of cells are looked for.
SAMPLE = 4_096
#: Reach of a cell, in angles of the least cosine, and the part of the sample, and fewest vectors of
#: it, that make a cell. So there are at most 128 cells.
CELL_REACH, CELL_SHARE, FEWEST_IN_CELL = 1.4, 128, 8
#: Chunks of a cell: about so many, of at least and at most so many vectors and at most so many
#: numbers; and rows of a strip in which two chunks are compared.
CELL_CHUNKS, LEAST_CHUNK, MOST_CHUNK, MOST_NUMBERS, STRIP = 16, 1_024, 8_192, 1 << 23, 512


def is_usable(vector: Column) -> Column:
    """Whether a vector has a direction: no nulls, only finite numbers, not all of them zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def choose_pivots(
    classes: DataFrame, least_cosine: float = 0.95, number: int | None = None
) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Pivots and centres of cells by dimension, unit vectors of a sample by least hash.

    Each pivot is the one farthest from those before it. Beyond the fewest, none is linked with
    another. ``number`` sets how many there are.
    """
    pivots, cells = {}, {}
    sizes = classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()
    for dim, n in sizes:
        rows = classes.where(F.size("vector") == dim)
        rows = rows.select(F.col("vector").cast("array<double>").alias("vector"))
        rows = rows.orderBy(F.xxhash64("vector")).limit(max(SAMPLE, number or 0)).toArrow()
        sample = _unit(_matrix(rows.column("vector").combine_chunks()))
        wanted = number or min(MOST_PIVOTS, max(FEWEST_PIVOTS, int(n**0.5)))
        pivots[dim] = _apart(sample, wanted, number or FEWEST_PIVOTS, least_cosine)
        cells[dim] = _dense(sample, least_cosine)
    return pivots, cells


def _apart(sample: np.ndarray, wanted: int, fewest: int, least_cosine: float) -> np.ndarray:
    chosen, nearest = [0], sample @ sample[0]
    nearest[0] = np.inf
    while len(chosen) < min(wanted, len(sample)):
        k = int(nearest.argmin())
        if len(chosen) >= fewest and nearest[k] >= least_cosine:
            break
        chosen.append(k)
        nearest = np.maximum(nearest, sample @ sample[k])
        nearest[k] = np.inf
    return sample[chosen]


def _reach(least_cosine: float) -> tuple[float, float]:
    """Cosines up to which a vector is in a cell, and up to which it can be linked with one that is."""
    angle = np.arccos(np.clip(least_cosine, -1, 1))
    own, linked = CELL_REACH * angle, (CELL_REACH + 1) * angle
    return float(np.cos(min(own, np.pi))), float(np.cos(min(linked, np.pi))) - 1e-6


def _dense(sample: np.ndarray, least_cosine: float) -> np.ndarray:
    """Centres of cells, the one with most vectors of the sample first."""
    n, reach = len(sample), _reach(least_cosine)[0]
    strips = [sample[k : k + STRIP] @ sample.T >= reach for k in range(0, n, STRIP)]
    near = np.concatenate(strips)
    counts, free, chosen = near.sum(axis=1), np.ones(n, bool), []
    while counts.max() >= max(FEWEST_IN_CELL, n // CELL_SHARE):
        chosen.append(int(counts.argmax()))
        taken = np.flatnonzero(near[chosen[-1]] & free)
        free[taken] = False
        counts = counts - near[:, taken].sum(axis=1)
    return sample[chosen]


def _homes(unit: np.ndarray, centres: np.ndarray, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell each vector is in, -1 for none, and whether it can be linked with one in each cell."""
    own, linked = _reach(least_cosine)
    if not len(centres):
        return np.full(len(unit), -1), np.zeros((len(unit), 0), bool)
    cosines = unit @ centres.T
    home = cosines.argmax(axis=1)
    return np.where(cosines.max(axis=1) >= own, home, -1), cosines >= linked


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that very small and very large numbers keep their direction.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def inverted_lists(
    classes: DataFrame,
    pivots: dict[int, np.ndarray],
    cells: dict[int, np.ndarray],
    least_cosine: float,
) -> DataFrame:
    """``(dim, p, q, near, cid, n, vector)``: each class in the list of every two of its pivots.

    Classes in cells are in no list.
    """
    schema = "dim int, p int, q int, near array<int>, cid bigint, n bigint, vector array<double>"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(x) for x in batch.column("vector")])
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                unit, own = _unit(_matrix(part.column("vector"))), pivots[dim]
                outside = _homes(unit, cells[dim], least_cosine)[0] < 0
                rows, part, unit = rows[outside], part.filter(pa.array(outside)), unit[outside]
                nearest = min(NEAREST, len(own))
                near = np.sort(np.argsort(-(unit @ own.T), axis=1, kind="stable")[:, :nearest])
                if nearest < 2 or not len(rows):  # a single class has no other to meet
                    continue
                for a, b in combinations(range(nearest), 2):
                    columns = [
                        pa.array(np.full(len(rows), dim, np.int32)),
                        pa.array(near[:, a].astype(np.int32)),
                        pa.array(near[:, b].astype(np.int32)),
                        pa.array(list(near.astype(np.int32))),
                        part.column("cid"),
                        part.column("n"),
                        pa.array(list(unit)),
                    ]
                    names = ["dim", "p", "q", "near", "cid", "n", "vector"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return classes.select("cid", "n", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
        post, schema
    )


def in_cells(classes: DataFrame, cells: dict[int, np.ndarray], least_cosine: float) -> DataFrame:
    """``(dim, cell, core, cid, n, vector)``: classes in cells, and those that can be linked with them.

    Of two cells that hold one class each of a pair, the first has the pair.
    """
    schema = "dim int, cell int, core boolean, cid bigint, n bigint, vector array<double>"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(x) for x in batch.column("vector")])
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                unit = _unit(_matrix(part.column("vector")))
                home, linked = _homes(unit, cells[dim], least_cosine)
                for cell in range(len(cells[dim])):
                    core = home == cell
                    rows = np.flatnonzero(core | (linked[:, cell] & ((home < 0) | (home > cell))))
                    if not len(rows):
                        continue
                    columns = [
                        pa.array(np.full(len(rows), dim, np.int32)),
                        pa.array(np.full(len(rows), cell, np.int32)),
                        pa.array(core[rows]),
                        part.column("cid").take(pa.array(rows)),
                        part.column("n").take(pa.array(rows)),
                        pa.array(list(unit[rows])),
                    ]
                    names = ["dim", "cell", "core", "cid", "n", "vector"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return classes.select("cid", "n", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(
        post, schema
    )


def compare_cells(rows: DataFrame, least_cosine: float, chunk: int | None = None) -> DataFrame:
    """``(cid, root, links)`` of all pairs in a cell of which one is of the cell itself."""
    key = ["dim", "cell"]
    sizes = written(rows.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "cells")
    rows = rows.join(sizes, key)
    length = f"greatest({LEAST_CHUNK}, ceil(size / {CELL_CHUNKS}))"
    length = f"least({MOST_CHUNK}, greatest(1, {MOST_NUMBERS} div dim), {length})"
    rows = rows.withColumn("chunks", F.expr(f"cast(ceil(size / {chunk or length}) as int)"))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(cid), chunks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    block = [*key, "i", "j"]
    rows = rows.select(*block, "own", "core", "cid", "n", "vector").repartition(*block)
    rows = rows.sortWithinPartitions(*block, "own", "cid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, block):
            links, edges = _verify_cell(rows, least_cosine)
            found = np.flatnonzero(links | (edges != np.arange(len(links))))
            cid = rows.column("cid").to_numpy()
            columns = [pa.array(x) for x in (cid[found], cid[edges[found]], links[found])]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "root", "links"])

    return rows.mapInArrow(verify, "cid bigint, root bigint, links bigint")


def _verify_cell(rows: pa.Table, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    n = rows.num_rows
    vectors = _matrix(rows.column("vector").combine_chunks())
    own, core = (rows.column(k).to_numpy() for k in ("own", "core"))
    size = rows.column("n").to_numpy().astype(np.float64)
    across = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    # Two chunks: the rows of the first, then those of the second.
    cut = int(np.searchsorted(own, own[-1])) if across else n
    links, forest = np.zeros(n), Forest(n)
    for a in range(0, cut, STRIP):
        upper = slice(a, min(a + STRIP, cut))
        for b in range(cut if across else a, n, STRIP):
            lower = slice(b, b + STRIP)
            hits = vectors[upper] @ vectors[lower].T >= least_cosine
            hits &= core[upper, None] | core[lower]
            if not across and a == b:
                hits = np.triu(hits, 1)
            if not hits.any():
                continue
            links[upper] += hits @ size[lower]
            links[lower] += size[upper] @ hits
            i, j = np.nonzero(hits & (forest.roots[upper, None] != forest.roots[lower]))
            forest.join(i + a, j + b)
    return links.astype(np.int64), forest.roots


def compare(lists: DataFrame, least_cosine: float, chunk: int = CHUNK) -> DataFrame:
    """``(cid, root, links)``: vectors linked within a list, how many they link with, and to whom."""
    key = ["dim", "p", "q"]
    sizes = written(lists.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1"), "lists")
    rows = lists.join(sizes, key)
    rows = rows.withColumn("chunks", F.expr(f"cast(ceil(size / {chunk}) as int)"))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(cid), chunks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    block = [*key, "i", "j"]
    rows = rows.select(*block, "own", "near", "cid", "n", "vector").repartition(*block)
    rows = rows.sortWithinPartitions(*block, "cid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, block):
            links, edges = _verify(rows, least_cosine)
            found = np.flatnonzero(links | (edges != np.arange(len(links))))
            cid = rows.column("cid").to_numpy()
            columns = [pa.array(x) for x in (cid[found], cid[edges[found]], links[found])]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "root", "links"])

    return rows.mapInArrow(verify, "cid bigint, root bigint, links bigint")


def _verify(rows: pa.Table, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    n = rows.num_rows
    vectors = _matrix(rows.column("vector").combine_chunks())
    near = np.array(rows.column("near").combine_chunks().flatten(), np.int64).reshape(n, -1)
    own, size = rows.column("own").to_numpy(), rows.column("n").to_numpy()
    p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
    across = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    i, j = np.nonzero(np.triu(vectors @ vectors.T >= least_cosine, 1))
    if across:
        apart = own[i] != own[j]
        i, j = i[apart], j[apart]
    # Pivots before q that are shared: the pair belongs here if p is the only one.
    earlier = (near[i][:, :, None] == near[j][:, None, :]) & (near[i] < q)[:, :, None]
    here = (earlier.sum(axis=(1, 2)) == 1) & (near[i] == p).any(axis=1)
    i, j = i[here], j[here]
    links = np.bincount(i, size[j], n).astype(np.int64) + np.bincount(j, size[i], n).astype(np.int64)
    forest = Forest(n)
    forest.join(i, j)
    return links, forest.roots


def _blocks(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each block. A block has two chunks at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in key], axis=1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
            part = batch.slice(start, end - start)
            if held and any(held[-1].column(k)[-1] != part.column(k)[0] for k in key):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(
    vectors: DataFrame, least_cosine: float = 0.95, pivots: int | None = None
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors``.

    Vectors that are null, empty, zero, or hold nulls or numbers that are not finite link with
    nothing and are components of their own, and so are vectors of different lengths to each other.
    Equal vectors link with each other whatever their number, rows that repeat an id too. A null id
    names no component: it has that of the others in it, null if there are none, and is not kept. No
    vectors, no rows. Other columns are not read.
    """
    own = vectors.select(
        vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["embedding"].alias("vector")
    )
    usable = own.where(is_usable(F.col("vector")))
    classes = usable.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # Numbers are written with the rows, so they stay the same.
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    chosen, cells = choose_pivots(classes, least_cosine, pivots)
    found = compare(inverted_lists(classes, chosen, cells, least_cosine), least_cosine)
    dense = compare_cells(in_cells(classes, cells, least_cosine), least_cosine)
    found = written(found.unionByName(dense), "linked")
    edges = found.select(F.col("cid").alias("a"), F.col("root").alias("b"))
    roots = written(components(edges), "components")
    links = written(found.groupBy("cid").agg(F.sum("links").alias("links")), "links")
    joined = classes.join(roots, classes.cid == roots.node, "left").drop("node")
    joined = joined.withColumn("root", F.coalesce("root", "cid")).join(links, "cid", "left")
    joined = written(joined, "rooted")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(
        joined.join(written(least, "least"), "root").select(
            F.col("vector").alias("v"),
            F.xxhash64("vector").alias("h"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            "component_id",
        ),
        "named",
    )
    own = own.withColumn("own_hash", F.when(is_usable(F.col("vector")), F.xxhash64("vector")))
    out = own.join(named, (own.own_hash == named.h) & (own.vector == named.v), "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
