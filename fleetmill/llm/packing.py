"""Best-fit packing planned over a histogram of lengths (operator 3).

Documents are tokenized where they are read. What is planned over is not documents but how many
pieces there are of each length, at most ``capacity`` numbers whatever the input: best-fit in
descending order of length, where bins with the same contents are one group with a count. The plan
says, for the k-th piece of a length, its sequence and its place there; pieces get their k by rank
within their length and take the planned slots.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from fleetmill.llm.common import held, in_tasks, slices, written
from fleetmill.llm.tokens import PartEncoder, quiet_threads, runs

#: Pieces of one length that are ranked together, and the most such groups of a length.
GROUP_PIECES, MOST_GROUPS = 256, 1 << 16

_SEPARATOR = "<|endoftext|>"
# A stop after a letter or digit begins a new match, so a space before it changes no id; after
# these characters it does not.
_STOP_WITHIN = re.compile(r"[^\w \n][.,]|_[.,]")
# Lower-case words of letters that no normaliser changes.
_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class WordBpe:
    """Ids by a ``tokenizers`` file that drops white space and merges within words."""

    def __init__(self, path: str):
        quiet_threads()
        self._tokenizer = Tokenizer.from_file(path)
        self._end = self._tokenizer.token_to_id(_SEPARATOR)
        # The same model for words that need no normalising.
        self._of_words = Tokenizer(self._tokenizer.model)
        self._of_words.normalizer = normalizers.Sequence([])
        self._of_words.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.CharDelimiterSplit(" "),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._encoder = PartEncoder(self._encode_new)

    def _encode_new(self, parts: list[str]) -> list[bytes]:
        """Many parts are encoded as one text with a special token after each."""
        words = [x for x in parts if _WORD.fullmatch(x)]
        plain = [x for x in parts if "<|" not in x and not _WORD.fullmatch(x)]
        found = {}
        for kind, tokenizer, separator in (
            (words, self._of_words, " "),
            (plain, self._tokenizer, _SEPARATOR),
        ):
            together = runs(kind)
            ids_of = self._ids(tokenizer, [separator.join(x) for x in together])
            for run, ids in zip(together, ids_of, strict=True):
                if kind is words:
                    cuts = np.flatnonzero(self._ends_word[ids]) + 1
                    starts = np.append(0, cuts[:-1])
                else:
                    cuts = np.flatnonzero(np.append(ids, self._end) == self._end)
                    starts = np.append(0, cuts[:-1] + 1)
                data, at = ids.tobytes(), zip(run, (4 * starts).tolist(), (4 * cuts).tolist(), strict=True)
                found.update((x, data[a:b]) for x, a, b in at)
        special = [x for x in parts if "<|" in x]
        ids_of = self._ids(self._tokenizer, special)
        found.update((x, y.tobytes()) for x, y in zip(special, ids_of, strict=True))
        return [found[x] for x in parts]

    @staticmethod
    def _ids(tokenizer: Tokenizer, texts: list[str]) -> list[np.ndarray]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        return self._encoder([_parts(text) for text in texts])


def _is_latin(text: str) -> bool:
    """Lower-casing of these characters is the tokenizer's own; texts of others are left to it."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _parts(text: str) -> list[str]:
    """Parts whose ids, one after the other, are those of the text; few of them differ."""
    if "<|" not in text and _is_latin(text):
        text = text.lower()
        if not _STOP_WITHIN.search(text):
            text = text.replace(".", " .").replace(",", " ,")
    return text.split(" ")


def pieces_of(
    docs: DataFrame, path: str, capacity: int, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of every text followed by id 0.

    Only texts of more than ``capacity`` ids are cut, every ``capacity`` ids.
    """
    schema = f"{id_col} bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(WordBpe, path)
        for batch in slices(batches, text_col):
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            rows = []
            for doc_id, ids in zip(
                batch.column(id_col).to_pylist(), bpe.encode_texts(texts), strict=True
            ):
                ids += bytes(4)
                for start in range(0, len(ids) // 4, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append(
                        (doc_id, start // capacity, start, len(part) // 4, zlib.crc32(part))
                    )
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            columns = [
                pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    own = docs.select(docs[id_col].cast("bigint").alias(id_col), text_col)
    return in_tasks(own, cut, schema)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: slots as ``(length, rank, bin, copies, offset)``.

    The slots of a row are those of ranks from ``rank`` on among the pieces of that length, up to
    the next row's: ``copies`` for each bin from ``bin`` on, the first of them at ``offset``.

    A group is bins with the same contents. Each step uses up a length or a group, so there are at
    most about twice as many groups as lengths, however many pieces there are.
    """
    open_bins: dict[int, list[tuple[int, tuple]]] = {}  # room left -> groups (bins, contents)
    rooms: list[int] = []
    closed: list[tuple[int, tuple]] = []

    def put(room: int, bins: int, contents: tuple) -> None:
        if not room:
            closed.append((bins, contents))
            return
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((bins, contents))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, contents = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, bins, contents = capacity, left, ()
            each = min(room // length, left)
            filled = min(bins, left // each)
            if room < capacity or contents:
                rest = bins - filled
                if rest:
                    put(room, rest, contents)
            put(room - each * length, filled, (*contents, (length, each)))
            left -= each * filled
    for room in rooms:
        closed += open_bins[room]
    used = dict.fromkeys(counts, 0)
    slots, first = [], 0
    for bins, contents in closed:
        offset = 0
        for length, copies in contents:
            slots.append((length, used[length], first, copies, offset))
            used[length] += copies * bins
            offset += copies * length
        first += bins
    return slots


def pack(pieces: DataFrame, capacity: int, *, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with an id, ``piece`` and ``length``.

    ``pieces`` must be a written table: it is read three times. Ranks are taken within small groups
    of a length, dealt by a hash of id and piece, and raised by the sizes of the groups before; so
    a length that holds most pieces is spread over many tasks. Rows that repeat id and piece are
    different pieces; among them the order, which shows nowhere else, is arbitrary.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan_bins(counts, capacity)
    spark = pieces.sparkSession
    # At most ``capacity`` rows; as an Arrow table they need no Python workers of their own.
    lengths = pa.array(list(counts), pa.int64())
    of_length = pa.array([min(MOST_GROUPS, -(-c // GROUP_PIECES)) for c in counts.values()], pa.int64())
    groups = spark.createDataFrame(pa.table({"length": lengths, "groups": of_length}))
    dealt = pieces.join(F.broadcast(groups), "length").withColumn(
        "group", F.expr(f"pmod(xxhash64({id_col}, piece), groups)")
    )
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    own = Window.partitionBy("length", "group").orderBy(id_col, "piece")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1)
    ranked = ranked.join(written(offsets, "packing"), ["length", "group"]).withColumn(
        "rank", F.col("own") + F.col("before")
    )
    return _take_slots(ranked.drop("group", "groups", "own", "before"), slots)


def _take_slots(ranked: DataFrame, slots: list[tuple[int, int, int, int, int]]) -> DataFrame:
    by_length: dict[int, np.ndarray] = {}
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    for length in np.unique(table[:, 0]):
        by_length[int(length)] = table[table[:, 0] == length, 1:]
    names = [x for x in ranked.columns if x != "rank"]
    schema = ", ".join(f"{n} {t}" for n, t in ranked.dtypes if n != "rank")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            bins, places = np.zeros_like(ranks), np.zeros_like(ranks)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                rank, first, copies, offset = by_length[int(length)].T
                slot = np.searchsorted(rank, ranks[rows], "right") - 1
                step = ranks[rows] - rank[slot]
                bins[rows] = first[slot] + step // copies[slot]
                places[rows] = offset[slot] + step % copies[slot] * length
            columns = [batch.column(n) for n in names] + [pa.array(bins), pa.array(places)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return in_tasks(ranked, take, schema + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` tokens.

    A null text counts as empty and is one piece, the final id 0. Repeated rows are packed each by
    itself; a null document id stays null. No documents, no rows. Other columns are not read.
    """
    pieces = written(pieces_of(docs, path, capacity), "pieces")
    return pack(pieces, capacity)
