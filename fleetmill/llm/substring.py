"""Substring deduplication by an FM-index per shard (operator 9).

A window is twenty consecutive words. Each window has an anchor: of its thirteen 8-word grams the one
with the least hash, the leftmost if equal. Neighbouring windows share anchors, equal windows have
equal ones; so only windows whose anchor comes again can be equal to another. Such windows, as
segments of all neighbours with one anchor, are dealt to shards by the anchor. A shard indexes the
distinct segments, streams them through the index, and says of each window whether it is the first of
its kind. First windows go back to their documents, where all other windows dealt out are removed.

What is dealt out is short in both hot cases. A passage in very many documents gives a segment once
for each slice of documents, not for each document. Of an anchor with very many different segments
around it, single windows are dealt out by a hash of all their words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmill.llm.common import drop_written, in_tasks, slices, written
from fleetmill.llm.fm_index import DEPTH, earliest_places

#: Words of a window and of an anchor.
WINDOW, GRAM = DEPTH, 8
#: Words of the segments in a shard, about.
SHARD_WORDS = 600_000
#: An anchor's windows are dealt out singly if it has more than this share of all segments, and more
#: than the first, at most the second number: so an anchor in one task is bounded at every size.
HEAVY_SHARE, HEAVY_SEGMENTS, MOST_SEGMENTS = 1_000, 256, 4_096
#: Heavy anchors that are broadcast to split the segments; more are joined by a shuffle.
TOLD_ANCHORS = 100_000

#: What a null document id is ordered as, and the least tie of such a row: after all others.
_LAST, _LAST_TIE = (1 << 63) - 1, 1 << 62
#: Repeated document ids that are broadcast to tell their rows apart; more are joined by a shuffle.
TOLD_IDS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd constant that spreads bits
_HIGH = np.uint64(0xFFFFFFFF00000000)
_SPACE = 0x20
#: Which bytes are in words, and a number for each byte from which a word's hash is made.
_LETTERS = ~np.isin(np.arange(256), [_SPACE, *range(0x09, 0x0E)])
_VALUES = np.array([xxhash.xxh64_intdigest(bytes([k])) for k in range(256)], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, one text's after the other's, and where each text's begin; null: none."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets.astype(np.int64) - offsets[0]
    letter = _LETTERS[data]
    # Words begin after space or with a text.
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    cuts = offsets[offsets < len(data)]
    begins[cuts] = letter[cuts]
    kept = np.flatnonzero(letter)
    begins_at = np.flatnonzero(begins)
    starts = np.flatnonzero(begins[kept])
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    sizes = np.diff(np.append(starts, len(kept)))
    powers = np.cumprod(np.full(int(sizes.max()), _MIX))
    values = _VALUES[data[kept]]
    values *= powers[np.arange(len(kept)) - np.repeat(starts, sizes)]
    hashes = np.add.reduceat(values, starts)
    hashes ^= hashes >> np.uint64(32)
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(29)
    return hashes, np.searchsorted(begins_at, offsets)


def anchors(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of every anchor: its text's number, its hash, and its first and its last window."""
    hashes, offsets = word_hashes(texts)
    if len(hashes) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none, none
    grams = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams *= _MIX
        grams += hashes[k : k + len(grams)]
    grams ^= grams >> np.uint64(32)
    grams *= _MIX
    grams ^= grams >> np.uint64(29)
    # Half of a hash over its place: the least of thirteen is the leftmost of the least hashes.
    least = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    for reach in (1, 2, 4, WINDOW - GRAM - 7):
        least = np.minimum(least[:-reach], least[reach:])
    # Windows that lie within one text. Those of two texts have no anchor in common.
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    windows = np.flatnonzero(text[: len(least)] == text[WINDOW - 1 :])
    if not len(windows):
        return windows, windows.view(np.uint64), windows, windows
    at = (least[windows] & ~_HIGH).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(windows)) - 1
    text = text[windows[first]]
    return text, grams[at[first]], windows[first] - offsets[text], windows[last] - offsets[text]


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """``(d, tie, anchor, first, last)`` of every anchor that comes twice or more among all documents.

    Within a slice of documents an anchor that comes again needs no other's word for it: its places
    go on as they are, and it is told to the others once. ``first`` and ``last`` are the windows of the
    anchor, so nobody has to look for anchors again.
    """
    schema = "route bigint, anchor bigint, d bigint, tie bigint, first int, last int, known boolean"

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, grams, first, last = anchors(batch.column("text"))
            if not len(text):
                continue
            first, last = first.astype(np.int32), last.astype(np.int32)
            ids, ties = (batch.column(k).to_numpy()[text] for k in ("d", "tie"))
            kinds, kind, counts = np.unique(grams, return_inverse=True, return_counts=True)
            again = counts[kind] > 1
            once, told = ~again, kinds[counts > 1].view(np.int64)
            # Known places are dealt evenly; one row without a place tells of each anchor.
            spread = (ids[again] ^ ties[again]) * 31 + first[again]
            own = grams.view(np.int64)
            columns = [
                np.concatenate([own[once], spread, told]),
                np.concatenate([own[once], own[again], told]),
                np.concatenate([ids[once], ids[again], np.zeros(len(told), np.int64)]),
                np.concatenate([ties[once], ties[again], np.zeros(len(told), np.int64)]),
                np.concatenate([first[once], first[again], np.full(len(told), -1, np.int32)]),
                np.concatenate([last[once], last[again], np.full(len(told), -1, np.int32)]),
                np.repeat([False, True, False], [once.sum(), len(spread), len(told)]),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in columns],
                ["route", "anchor", "d", "tie", "first", "last", "known"],
            )

    rows = in_tasks(docs.select("d", "tie", "text"), take, schema).repartition("route")
    rows = rows.sortWithinPartitions("known", "anchor").drop("route")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of rows in order, those that have the anchor of the row before or after. The last row of
        # a batch waits for the next batch.
        waiting = None
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            before_last = None
            if waiting is not None:
                before_last = waiting[1]
                own = [np.concatenate([a, b]) for a, b in zip(waiting[0], own, strict=True)]
            if not len(own[0]):
                continue
            anchor, d, tie, first, last, known = own
            same = (anchor[1:] == anchor[:-1]) & ~known[1:] & ~known[:-1]
            after = np.append(same, False)
            before = np.append(before_last is not None and bool(before_last), same)
            # A row that tells of an anchor counts as two.
            found = (after | before | known) & (first >= 0)
            found[-1] = False
            yield _places(*(x[found] for x in (d, tie, anchor, first, last)))
            waiting = [x[-1:] for x in own], before[-1]
        if waiting is not None:
            (anchor, d, tie, first, last, known), before = waiting
            if first[0] >= 0 and (known[0] or before):
                yield _places(d, tie, anchor, first, last)

    return in_tasks(rows, pair, "d bigint, tie bigint, anchor bigint, first int, last int")


def _places(*columns: np.ndarray) -> pa.RecordBatch:
    names = ["d", "tie", "anchor", "first", "last"]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def segments(dealt: DataFrame) -> DataFrame:
    """``(anchor, d, tie, first, words)`` of repeated anchors; equal segments of a slice once, the first.

    ``dealt`` has documents with their compressed words, one space between them, and the places of
    their repeated anchors.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "packed"):
            least: dict[bytes, tuple] = {}
            columns = [batch.column(k).to_pylist() for k in ("d", "tie", "packed")]
            lists = batch.column("places")
            edges = lists.offsets.to_numpy()
            own = [x.to_numpy() for x in lists.values.flatten()]
            for d, tie, packed, a, b in zip(*columns, edges[:-1], edges[1:], strict=True):
                text = inflate(packed)
                anchor, first, last = (x[a:b] for x in own)
                spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == _SPACE)
                begins = np.append(0, spaces + 1)[first].tolist()
                ends = np.append(spaces, len(text))[last + (WINDOW - 1)].tolist()
                for route, start, begin, end in zip(
                    anchor.tolist(), first.tolist(), begins, ends, strict=True
                ):
                    segment = text[begin:end]
                    if segment not in least or least[segment][1:] > (d, tie, start):
                        least[segment] = route, d, tie, start
            yield _segments(least)

    return in_tasks(dealt.select("d", "tie", "packed", "places"), take, _SEGMENTS)


_SEGMENTS = "anchor bigint, d bigint, tie bigint, first int, words binary"


def _segments(least: dict[bytes, tuple]) -> pa.RecordBatch:
    anchor, d, tie, first = zip(*least.values(), strict=True) if least else ((), (), (), ())
    columns = [
        pa.array(anchor, pa.int64()),
        pa.array(d, pa.int64()),
        pa.array(tie, pa.int64()),
        pa.array(first, pa.int32()),
        pa.array(list(least), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "d", "tie", "first", "words"])


def single_windows(found: DataFrame) -> DataFrame:
    """Segments cut into windows, each with a hash of its words in place of its anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least: dict[bytes, tuple] = {}
            for d, tie, first, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                words = text.split(b" ")
                for k in range(len(words) - WINDOW + 1):
                    part = b" ".join(words[k : k + WINDOW])
                    if part not in least or least[part][1:] > (d, tie, first + k):
                        route = xxhash.xxh64_intdigest(part) - (1 << 63)
                        least[part] = route, d, tie, first + k
            yield _segments(least)

    return in_tasks(found, cut, _SEGMENTS)


def without_heavy(found: DataFrame, total: int) -> DataFrame:
    """``found``, a written table of ``total`` segments, those of heavy anchors as single windows."""
    bound = min(MOST_SEGMENTS, max(HEAVY_SEGMENTS, total // HEAVY_SHARE))
    many = found.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > bound)
    heavy = written(many.select("anchor"), "heavy")
    number = heavy.count()
    if not number:
        return found
    told = F.broadcast(heavy) if number <= TOLD_ANCHORS else heavy
    light = found.join(told, "anchor", "left_anti")
    return light.unionByName(single_windows(found.join(told, "anchor", "left_semi")))


def first_windows(dealt: DataFrame) -> DataFrame:
    """``(d, tie, begin, end)``: runs of windows that are the first of their kind, for each shard.

    A partition of ``dealt (anchor, d, tie, first, words)`` is a shard.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, tuple] = {}
        for batch in batches:
            for d, tie, first, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if text not in least or least[text] > (d, tie, first):
                    least[text] = d, tie, first
        if not least:
            return
        ordered = sorted(least, key=least.__getitem__)
        number: dict[bytes, int] = defaultdict(count(1).__next__)
        words = b" ".join(ordered).split(b" ")
        numbers = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        sizes = np.array([x.count(b" ") + 1 for x in ordered], np.int64)
        rows = []
        found = earliest_places(numbers, sizes, len(number) + 1)
        for text, firsts in zip(ordered, found, strict=True):
            d, tie, start = least[text]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], firsts, [False]]).astype(np.int8)))
            rows += [(d, tie, start + a, start + b) for a, b in edges.reshape(-1, 2).tolist()]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = pa.int64(), pa.int64(), pa.int32(), pa.int32()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["d", "tie", "begin", "end"]
        )

    return in_tasks(dealt, search, "d bigint, tie bigint, begin int, end int")


def _packed(docs: DataFrame, only_words: bool = False) -> DataFrame:
    """``docs`` with the text, or its words and one space between them, compressed to be shuffled."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.drop("text").dtypes) + ", packed binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
            if only_words:
                texts = [b" ".join(x.split()) for x in texts]
            names = [n for n in batch.schema.names if n != "text"]
            columns = [batch.column(n) for n in names]
            columns.append(pa.array(list(map(deflate, texts)), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*names, "packed"])

    text_last = docs.select(*(c for c in docs.columns if c != "text"), "text")
    return in_tasks(text_last, pack, schema)


def _with_keys(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``d`` and ``tie``, which order them and tell them apart, and if ids repeat.

    Rows without an id are numbered and written with their numbers, so these stay the same. Of rows
    that repeat an id the tie is a hash of the text: equal rows have one key.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("again")).where("again is not null")
    again = ids.groupBy("again").agg(F.count("*").alias("n")).where("n > 1").select("again")
    again = written(again, "repeated_ids")
    number = again.count()
    own = docs.withColumn("d", F.col("doc_id").cast("bigint"))
    # A cast can fail, so the new column decides.
    named, nameless = own.where("d is not null"), own.where("d is null")
    if number:
        told = F.broadcast(again) if number <= TOLD_IDS else again
        named = named.join(told, named["d"] == told["again"], "left")
        tie = F.shiftright(F.xxhash64("text"), 2)
        named = named.withColumn("tie", F.when(F.col("again").isNotNull(), tie).otherwise(0))
        named = named.drop("again")
    else:
        named = named.withColumn("tie", F.lit(0).cast("bigint"))
    nameless = nameless.withColumn("d", F.lit(_LAST))
    nameless = nameless.withColumn("tie", F.lit(_LAST_TIE) + F.monotonically_increasing_id())
    nameless = written(nameless, "without_id")
    return (named if nameless.isEmpty() else named.unionByName(nameless)), bool(number)


def deduplicated(docs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``docs``, texts without the words covered by a window that starts earlier somewhere else.

    Earlier is a smaller ``doc_id``, or an earlier start in the same document; windows are judged on
    the texts as they come. Adds ``kept_words`` (binary: kept words, one space between them),
    ``n_words`` and ``n_removed``; a column of the name of these is replaced. The text of a document
    that loses words becomes its kept words, others stay as they are, null ones too. ``columns``
    are those returned, all if not given; others are not made.

    Null and short texts have no windows and lose nothing. Null ids come after all others; each is a
    document of its own, in the order the rows are read. Rows that repeat an id and text are one
    place: they do not remove each other's windows. Rows that repeat an id with other texts are
    documents of their own, in the order of a hash of the text. No documents, no rows.
    """
    added = ["kept_words", "n_words", "n_removed"]
    own = docs.select(*(c for c in docs.columns if c not in added))
    own, repeated = _with_keys(own)
    key = ["d", "tie"]
    # Equal rows of an id say the same: each place is kept once, however many they are.
    collect = F.collect_set if repeated else F.collect_list
    places = written(repeated_anchors(own), "anchors")
    grouped = places.groupBy(*key).agg(collect(F.struct("anchor", "first", "last")).alias("places"))
    found = written(segments(_packed(own.select(*key, "text"), True).join(grouped, key)), "segments")
    total = found.count()
    # A segment has about 27 words.
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 27 // SHARD_WORDS + 1)
    dealt = without_heavy(found, total).repartition(shards, "anchor")
    firsts = written(first_windows(dealt), "first_windows")
    drop_written(found)
    # Windows of repeated anchors go, but for those that are the first of their kind.
    again = places.select(*key, F.col("first").alias("begin"), (F.col("last") + 1).alias("end"))
    told = again.withColumn("stays", F.lit(False)).union(firsts.withColumn("stays", F.lit(True)))
    told = told.groupBy(*key).agg(collect(F.struct("begin", "end", "stays")).alias("told"))
    return _without(_packed(own).join(told, key, "left").drop(*key), docs, columns)


def _without(joined: DataFrame, docs: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    added = {"kept_words": "binary", "n_words": "bigint", "n_removed": "bigint"}
    types = dict(docs.dtypes) | added
    names = list(columns or [*(c for c in docs.columns if c not in added), *added])
    schema = ", ".join(f"`{n}` {types[n]}" for n in names)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "packed"):
            texts, kept_words, sizes, removed = [], [], [], []
            told = batch.column("told")
            own_runs = [x.to_numpy(zero_copy_only=False) for x in told.values.flatten()]
            edges = told.offsets.to_numpy()
            packed = batch.column("packed").to_pylist()
            for packed_text, a, b in zip(packed, edges[:-1], edges[1:], strict=True):
                text = inflate(packed_text)
                words = text.split()  # of bytes: at ASCII space
                sizes.append(len(words))
                removed.append(0)
                if b > a:
                    gone = _gone(len(words), *(x[a:b] for x in own_runs))
                    removed[-1] = int(gone.sum())
                    if removed[-1]:
                        words = compress(words, (~gone).tolist())
                kept_words.append(b" ".join(words))
                if "text" in names:
                    whole = kept_words[-1] if removed[-1] else text
                    texts.append(whole.decode("utf-8", "surrogatepass"))
            new = {
                "kept_words": pa.array(kept_words, pa.binary()),
                "n_words": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
            }
            if "text" in names:
                new["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [new[n] if n in new else batch.column(n) for n in names], names
            )

    return in_tasks(joined, remove, schema)


def _gone(n: int, begin: np.ndarray, end: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """Words covered by runs of windows, but for the windows of runs that stay."""
    again = _covered(n, begin[~stays], end[~stays]) & ~_covered(n, begin[stays], end[stays])
    starts = np.flatnonzero(again)
    return _covered(n, starts, starts + WINDOW)


def _covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1]) > 0


def word_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, one row per row of ``docs``."""
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    found = deduplicated(own, ["doc_id", "n_words", "n_removed", "kept_words"])
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256")
    )
