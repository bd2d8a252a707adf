"""Benchmark passages in documents by multi-pattern search after Wu and Manber (operator 13).

Texts become words in lower case with one space between, so that a window of ten words of a benchmark
item is a plain string of bytes. The strings are put into classes by length, so that a short one does
not shorten the steps of the others. For the strings of a class, of ``m`` bytes at least, a shift table
says of each block of bytes how far a search may move on if it reads that block at the end of ``m``
bytes: as far as the block's last place in the first ``m`` bytes of any string, and past the block
where none has it. Where the shift is zero, the block may end the first ``m`` bytes of a string; these
bytes select the strings that start with them, and the rest is compared.

Texts are searched many places at a time: a text is cut into stretches that start together, and each
moves on by its own shift. Hashes only ever let too much through; what counts is the comparison.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmill.llm.common import slices, written

#: Words of a window. An item of fewer is one window.
WINDOW = 10
#: Bytes of a block, and the least bytes of strings that are searched by shifts.
BLOCK = 8
#: Most windows, with their items, and most bytes of them searched for at once; more take turns.
BLOCK_WINDOWS, BLOCK_BYTES = 60_000, 16_000_000
#: Bytes of a stretch of text, about.
STRETCH = 2_048
#: What an item without an id is called.
NAMELESS = "-"

_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd constant that spreads bits

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words, A to Z in lower case. Of bytes only ASCII ones separate, and lower case is ASCII's."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Patterns:
    """Shift tables and suffix buckets of a set of byte strings, for each class of lengths."""

    def __init__(self, strings: list[bytes]):
        classes = defaultdict(list)
        for number, string in enumerate(strings):
            classes[max(len(string), BLOCK).bit_length()].append(number)
        self._strings = strings
        self._classes = [self._tables(numbers) for _, numbers in sorted(classes.items())]

    def _tables(self, numbers: list[int]) -> tuple:
        chosen = [self._strings[k] for k in numbers]
        m = min(map(len, chosen))
        buckets = defaultdict(list)
        for number, string in zip(numbers, chosen, strict=True):
            buckets[string[:m]].append(number)
        if m < BLOCK:
            return m, None, 0, buckets
        starts = np.frombuffer(b"".join(x[:m] for x in buckets), np.uint8).reshape(-1, m)
        bits = int(np.clip(np.ceil(np.log2(8 * starts.size)), 12, 24))
        most = m - BLOCK + 1
        shifts = np.full(1 << bits, min(most, 255), np.uint8)
        for end in range(BLOCK, m + 1):  # the last place of a block comes last: the least shift
            block = np.ascontiguousarray(starts[:, end - BLOCK : end]).view("<u8").ravel()
            shifts[_slot(block, bits)] = min(m - end, 255)
        return m, shifts, bits, buckets

    def find(self, text: bytes) -> tuple[list[int], list[int]]:
        """All occurrences in ``text``: where they start, and of which string."""
        at, which = [], []
        for m, shifts, bits, buckets in self._classes:
            for start in _candidates(text, m, shifts, bits):
                for number in buckets.get(text[start : start + m], ()):
                    if text.startswith(self._strings[number], start):
                        at.append(start)
                        which.append(number)
        return at, which


def _slot(block: np.ndarray, bits: int) -> np.ndarray:
    return (block * _MIX) >> np.uint64(64 - bits)


def _candidates(text: bytes, m: int, shifts: np.ndarray | None, bits: int) -> list[int]:
    """Places at which the first ``m`` bytes of a string may start."""
    if shifts is None:  # shorter than a block: strings start and end at spaces
        return np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20).tolist()
    if len(text) < m:
        return []
    # A block at every byte, without a copy.
    blocks = np.ndarray(len(text) - BLOCK + 1, "<u8", text, 0, (1,))
    first, last = m - BLOCK, len(blocks)
    place = np.arange(first, last, STRETCH)
    end = np.append(place[1:], last)
    found = []
    while len(place):
        shift = shifts[_slot(blocks[place], bits)]
        hit = shift == 0
        found.append(place[hit])
        place = place + np.maximum(shift, 1)
        going = place < end
        if not going.all():
            place, end = place[going], end[going]
    return (np.sort(np.concatenate(found)) - first).tolist() if found else []


def windows(items: DataFrame) -> DataFrame:
    """``(window, item)``, each pair once: the windows of all items, as they are searched for."""
    schema = "window binary, item string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for name, text in zip(*(batch.column(c).to_pylist() for c in ("item", "text")), strict=True):
                words = words_of(text)
                found = {
                    b" " + b" ".join(words[k : k + WINDOW]) + b" "
                    for k in range(max(1, len(words) - WINDOW + 1))
                    if words
                }
                columns = [pa.array(list(found), pa.binary()), pa.array([name] * len(found), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["window", "item"])

    named = F.coalesce(items["item_id"].cast("string"), F.lit(NAMELESS)).alias("item")
    return items.select(named, items["text"]).mapInArrow(cut, schema).distinct()


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` and ``items``; columns of these names are replaced.

    ``hits`` are pairs of a first and a last hit word, apart from each other and in order, and
    ``items`` the names of items with a window in the document. Rows stay as many as they are.

    What tasks search for at once is bounded: more windows are dealt into blocks by a hash, and the
    documents go through one block after the other, written in between.
    """
    pairs = written(windows(items), "windows")
    size = pairs.agg(F.count("*").alias("n"), F.sum(F.octet_length("window")).alias("bytes")).first()
    blocks = max(size["n"] // BLOCK_WINDOWS, (size["bytes"] or 0) // BLOCK_BYTES) + 1
    block = F.pmod(F.xxhash64("window", "item"), F.lit(blocks))
    added = {"n_words": "bigint", "hits": "array<int>", "items": "array<string>"}
    own = docs.select(*(c for c in docs.columns if c not in added))
    found = own.select("*", *(F.lit(None).cast(t).alias(c) for c, t in added.items()))
    for number in range(blocks):
        chosen = pairs.where(block == number) if blocks > 1 else pairs
        found = _searched(found if not number else written(found, "searched"), chosen)
    return found


def _searched(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One block of windows, bounded in number and bytes, searched for in all documents."""
    names = defaultdict(list)
    table = pairs.toArrow()
    for window, item in zip(table.column("window").to_pylist(), table.column("item").to_pylist(), strict=True):
        names[window].append(item)
    strings = sorted(names)
    items = [sorted(names[x]) for x in strings]
    lengths = [x.count(b" ") - 1 for x in strings]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(strings)
        for batch in slices(batches, "text"):
            texts = [words_of(x) for x in batch.column("text").to_pylist()]
            joined = [b" " + b" ".join(x) + b" " for x in texts]
            begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in joined])])
            # A line feed is in no window, so none reaches over two texts.
            at, which = patterns.find(b"\n".join(joined))
            by_text = defaultdict(list)
            for start, number, text in zip(at, which, np.searchsorted(begins, at, "right") - 1, strict=True):
                by_text[int(text)].append((start - int(begins[text]), number))
            hits, said = [], []
            before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for k, (old_hits, old_items) in enumerate(before):
                mine = by_text.get(k)
                if mine:
                    spaces = np.flatnonzero(np.frombuffer(joined[k], np.uint8) == 0x20)
                    first = np.searchsorted(spaces, [x for x, _ in mine]).tolist()
                    runs = [(w, w + lengths[n] - 1) for w, (_, n) in zip(first, mine, strict=True)]
                    old = old_hits or []
                    hits.append(_merged(runs + list(zip(old[::2], old[1::2], strict=True))))
                    said.append(sorted({*(old_items or []), *(i for n in {n for _, n in mine} for i in items[n])}))
                else:
                    hits.append(old_hits or [])
                    said.append(old_items or [])
            new = {
                "n_words": pa.array([len(x) for x in texts], pa.int64()),
                "hits": pa.array(hits, pa.list_(pa.int32())),
                "items": pa.array(said, pa.list_(pa.string())),
            }
            kept = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in kept], kept)

    return docs.mapInArrow(search, docs.schema)


def _merged(runs: list[tuple[int, int]]) -> list[int]:
    """Runs of words, overlapping and neighbouring ones as one, as firsts and lasts in turn."""
    out: list[int] = []
    for first, last in sorted(runs):
        if out and first <= out[-1] + 1:
            out[-1] = max(out[-1], last)
        else:
            out += [first, last]
    return out


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row per row of ``docs``.

    Null texts and texts without a word have no words and are clean. Items without a word are in no
    document; items without an id count as one, called ``-``, and so do items that repeat an id.
    Without items every document is clean. Repeated rows and rows without an id stay.
    """
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    found = occurrences(own, items)
    # Of every pair the last word counts up to itself, the first one takes back what is before it.
    counts = F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x + 1).cast("bigint"))
    n_hit = F.aggregate(counts, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS_SQL = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
CONTAMINATION_SQL = f"""
    WITH own AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
    items AS (SELECT coalesce(item_id::VARCHAR, '{NAMELESS}') AS item, {_WORDS_SQL} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS size,
            array_to_string(w[k:k + {WINDOW - 1}], ' ') AS said
        FROM items, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS x(k) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT size FROM windows),
    placed AS (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS said
        FROM own, sizes, unnest(range(1, len(w) - size + 2)) AS x(k)),
    found AS (SELECT r, k, p.size, item FROM placed p JOIN windows USING (said, size)),
    hit AS (SELECT r, count(DISTINCT k + j) AS n_hit
        FROM (SELECT DISTINCT r, k, size FROM found) f, unnest(range(0, size)) AS x(j) GROUP BY r),
    named AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
        coalesce(len(items), 0)::BIGINT AS n_items,
        sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
    FROM own LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""
