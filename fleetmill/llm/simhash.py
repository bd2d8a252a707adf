"""SimHash near duplicates by bit-sliced comparison (operator 4).

Fingerprints are made where documents are read. Distinct fingerprints are then dealt to buckets so
that any two within the radius meet in one: of ``radius + 1`` blocks of bits at least one is equal,
or of more blocks all but ``radius``. In a bucket, bit planes are stored vertically, 64 fingerprints
to a word; the differences from a fingerprint are added plane by plane into carry-save counters for
64 fingerprints at once, and words in which all have passed the radius are abandoned. A bucket gives
at most one link per fingerprint, to the least it is connected with there, however many it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.llm.common import components, drop_written, in_tasks, slices, written

SHINGLE, SEED = 3, 42
#: Fingerprints of a bucket that are compared in one go. Larger buckets are cut into chunks and
#: every two chunks are compared.
CHUNK = 512
#: Most fingerprints for which as many blocks of bits are used; beyond, more blocks.
FEWEST_BLOCKS, MORE_BLOCKS = 1 << 24, 1 << 32
#: Rows compared at once.
_ROWS = 8_192


def fingerprint(text: str) -> int:
    """64 bits: each is set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, ASCII space
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in shingles], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(votes, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` holds the 64 bits as a signed number."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            fps = [fingerprint(x or "") for x in batch.column(text_col).to_pylist()]
            columns = [batch.column(id_col), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "fp"])

    ids = docs[id_col].cast("bigint").alias(id_col)
    return in_tasks(docs.select(ids, text_col), take, f"{id_col} bigint, fp bigint")


def bit_sliced_links(
    fps: np.ndarray, last: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``i < j < last[i]`` within ``radius`` differing bits, in several parts."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    # Blocks are runs of bits and equal within a bucket, so planes are taken across blocks.
    order = [b + 8 * k for b in range(8) for k in range(8)]
    ones, full = np.uint64(1), ~np.uint64(0)
    row = np.arange(n)
    word = (row + 1) // 64
    row = row[word * 64 < last]
    while len(row):
        at = word[row]
        low = np.maximum(row + 1 - at * 64, 0).astype(np.uint64)
        high = np.minimum(last[row] - at * 64, 64)
        outside = (ones << low) - ones
        short = high < 64
        outside[short] |= full << high[short].astype(np.uint64)
        yield from _compare(fps, planes, order, row, at, outside, radius)
        word[row] += 1
        row = row[word[row] * 64 < last[row]]


def _compare(fps, planes, order, row, at, over, radius):
    # Counters to 2 ** width - 1; ``over`` collects what has passed the radius.
    width = radius.bit_length() if (radius + 1) & radius else radius.bit_length()
    own = fps[row]
    counters = [np.zeros(len(row), np.uint64) for _ in range(width)]
    for step, b in enumerate(order):
        bit = (own >> np.uint64(b)) & np.uint64(1)
        carry = planes[b][at] ^ (np.uint64(0) - bit)
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = over | carry
        if (radius + 1) & radius:  # the counters go beyond the radius before they overflow
            over = over | _above(counters, radius)
        if step % 4 == 3:
            alive = over != ~np.uint64(0)
            if not alive.any():
                return
            if alive.mean() < 0.75:
                row, at, own, over = row[alive], at[alive], own[alive], over[alive]
                counters = [c[alive] for c in counters]
    hits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, lane = np.nonzero(hits)
    if len(i):
        yield row[i], at[i] * 64 + lane


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over ``radius``: a bitwise comparison from the highest counter down."""
    above, equal = np.uint64(0), ~np.uint64(0)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above, equal = above | (equal & counters[k]), equal & ~counters[k]
    return above


class Forest:
    """Union of numbers 0..n-1 by arrays of pairs; ``roots`` has the least of each set."""

    def __init__(self, n: int):
        self.roots = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.roots[i], self.roots[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.roots, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.roots, again := self.roots[self.roots]):
                self.roots = again


def bucket_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Keys of which two fingerprints within ``radius`` share one at least."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[k] for k in chosen)
        mask -= (mask >> 63) << 64
        bits = fp.bitwiseAND(F.lit(mask).cast("bigint"))
        keys.append(F.struct(F.lit(n).alias("block"), bits.alias("bits")))
    return F.array(*keys)


def links(fps: DataFrame, radius: int = 3, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)`` of a spanning forest of all links within buckets. ``fps (fp)`` is distinct.

    More blocks give smaller buckets and more of them. All numbers of blocks find every link.
    """
    if blocks is None:
        n = fps.count()
        blocks = radius + 1 + (n > FEWEST_BLOCKS) + (n > MORE_BLOCKS)
    rows = fps.select("fp", F.explode(bucket_keys(F.col("fp"), radius, blocks)).alias("key"))
    rows = rows.select("fp", "key.block", "key.bits")
    sizes = rows.groupBy("block", "bits").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes, "buckets")
    rows = rows.join(sizes, ["block", "bits"])
    # A bucket of one chunk is compared in itself; of more, every two chunks are a pair.
    rows = rows.withColumn("chunks", F.expr(f"cast(ceil(n / {chunk}) as int)"))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(fp), chunks) as int)"))
    rows = rows.withColumn(
        "other",
        F.explode(
            F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
                F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("own"))
            )
        ),
    )
    pair = ["block", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    rows = rows.select(*pair, "fp")
    rows = rows.repartition("block", "bits", "i", "j")
    rows = rows.sortWithinPartitions("block", "bits", "i", "j", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, own in _whole_buckets(batches):
            begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            ends = np.append(begins[1:], len(own))
            last = np.repeat(ends, ends - begins)
            forest = Forest(len(own))
            for i, j in bit_sliced_links(own.view(np.uint64), last, radius):
                forest.join(i, j)
            found = np.flatnonzero(forest.roots != np.arange(len(own)))
            columns = [pa.array(own[found]), pa.array(own[forest.roots[found]])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return in_tasks(rows, compare, "a bigint, b bigint")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and fingerprints in runs of about ``_ROWS`` rows that cut no bucket."""
    held: list[np.ndarray] = []
    for batch in batches:
        whole = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
        for start in range(0, len(whole), _ROWS):
            held.append(whole[start : start + _ROWS])
            rows = np.concatenate(held)
            cut = int(np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1)).max(initial=-1)) + 1
            if cut:
                yield rows[:cut, :4], np.ascontiguousarray(rows[:cut, 4])
            held = [rows[cut:]]
    rows = np.concatenate(held) if held else np.empty((0, 5), np.int64)
    if len(rows):
        yield rows[:, :4], np.ascontiguousarray(rows[:, 4])


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 3
) -> DataFrame:
    """``(id, fingerprint, component_id)``, one row per row of ``docs``.

    Documents are joined if their fingerprints differ in at most ``radius`` bits, and what is
    reachable is one component, called by its least id. Null and empty texts, and texts without
    words, have the fingerprint zero and are linked like any other. Repeated rows stay repeated. A
    null id stays null and names no component, so a component of null ids only is null. No
    documents, no rows. Other columns are not read.
    """
    own = written(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    edges = written(links(classes.select("fp"), radius), "links")
    roots = written(components(edges), "components")
    drop_written(edges)
    joined = classes.join(roots, classes.fp == roots.node, "left").drop("node")
    joined = written(joined.withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = written(
        joined.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id")),
        "least",
    )
    named = written(joined.join(least, "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
