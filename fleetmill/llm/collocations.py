"""Phrase mining over a prefix-free parse (operator 12).

A text is parsed into chunks. A chunk begins at three words whose hash is a multiple of a number and
ends with the next three words of that kind, which begin the next chunk: neighbours overlap by three
words, and equal passages are parsed alike wherever they stand. The distinct chunks with their
numbers are the dictionary; all counting is done on it, so a passage that comes a thousand times is
gone through once. A phrase of up to four words that begins in a chunk before its last three words
lies in it as a whole. It is counted there, times the chunk's number, and nowhere else.

Phrases are counted by length. One of ``k`` words can only be frequent if its first and its last
``k - 1`` words are; a bitmap of hashes, of bounded size, keeps most of the others out of the shuffle.
It lets some through, which the count then sorts out, and drops none that is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetmill.llm.common import drop_written, slices, written
from fleetmill.session import lookup

#: Words of the longest phrase, and how many words chunks overlap by.
LONGEST = 4
OVERLAP = LONGEST - 1
#: About one place in so many begins a chunk. A chunk of more words is cut at that many.
CHUNK_WORDS, MOST_WORDS = 32, 4_096
#: Phrases that come less often are no candidates.
LEAST_COUNT = 30
#: Phrases reported of each language.
REPORTED = 2_000
#: Bits of the map of frequent phrases: sixteen for each phrase, at most so many in all (8 MB).
MAP_BITS = 1 << 26
#: Bytes of chunks that phrases are counted in at once.
SLICE_BYTES = 16_000_000
#: Parts of a language that are ranked by themselves before the whole is.
RANK_PARTS = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd constant that spreads bits
#: Between pieces stands a word that no piece can hold.
_STOP = b"."
_UPPER, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\x0b\x0c\r"
#: What ends every text, and is all of one without words or stops.
_BLANK = b" ." * OVERLAP
_TABLE = bytes.maketrans(_UPPER + _STOPS + b"\t", _UPPER.lower() + _STOP * len(_STOPS) + b" ")


def _prepared(text: str) -> bytes:
    """The words of all pieces with spaces and stops between them, and stops at the end."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    return raw.replace(_STOP, b" . ").strip() + _BLANK


class _Hashes:
    """Hashes of words, kept for words that come again."""

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self._known) > 400_000:
            self._known.clear()
        known = self._known
        found = list(map(known.get, words))
        if None in found:
            digest = xxhash.xxh64_intdigest
            for k, value in enumerate(found):
                if value is None:
                    found[k] = known[words[k]] = digest(words[k])
        return np.array(found, np.uint64)


def _mixed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    mixed = (first ^ (first >> np.uint64(29))) * _MIX + then
    return mixed ^ (mixed >> np.uint64(32))


def chunk_starts(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts of these words, one after the other, which begin at ``begins``.

    No chunk begins in the last ``OVERLAP`` words of a text.
    """
    ends = np.append(begins[1:], len(hashes)) - OVERLAP
    window = hashes[: len(hashes) - OVERLAP]
    for k in range(1, OVERLAP):
        window = _mixed(window, hashes[k : len(hashes) - OVERLAP + k])
    marked = window % np.uint64(CHUNK_WORDS) == 0
    marked[begins] = True
    for k in range(OVERLAP):
        marked[ends[:-1] + k] = False
    starts = np.flatnonzero(marked)
    after = np.append(starts[1:], len(hashes))
    last = ends[np.searchsorted(begins, starts, "right") - 1]
    gaps = np.minimum(after, last) - starts
    long = gaps > MOST_WORDS
    if long.any():
        more = [np.arange(s, s + g, MOST_WORDS) for s, g in zip(starts[long], gaps[long], strict=True)]
        starts = np.unique(np.concatenate([starts, *more]))
    return starts


def parse(docs: DataFrame) -> DataFrame:
    """``(lang, chunk, n)``: the dictionary of the texts of each language, with how often each comes.

    Texts end with as many stops as chunks overlap, so every phrase has one chunk to be counted in.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches, "text"):
            batch = batch.filter(pc.fill_null(pc.greater(pc.binary_length(batch.column("text")), 0), False))
            if not batch.num_rows:
                continue
            texts = [_prepared(x) for x in batch.column("text").to_pylist()]
            full = [x != _BLANK for x in texts]  # a text of spaces has no words, not an empty one
            if not any(full):
                continue
            batch, texts = batch.filter(pa.array(full)), list(compress(texts, full))
            split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
            begins = split.offsets.to_numpy()[:-1]
            words = split.values.view(pa.binary()).dictionary_encode()
            ids = words.indices.to_numpy()
            starts = chunk_starts(hashes(words.dictionary.to_pylist())[ids], begins)
            text = np.searchsorted(begins, starts, "right") - 1
            ends = np.append(starts[1:], len(ids)) + OVERLAP
            ends = np.minimum(ends, np.append(begins[1:], len(ids))[text])
            chunks = _joined(words, starts, ends - starts)
            found = pa.table({"lang": batch.column("lang").take(pa.array(text)), "chunk": chunks})
            found = found.group_by(["lang", "chunk"]).aggregate([([], "count_all")])
            yield from found.rename_columns(["lang", "chunk", "n"]).to_batches()

    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang")
    found = docs.select(lang, docs["text"]).mapInArrow(take, "lang string, chunk binary, n bigint")
    return found.groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


def _joined(words: pa.DictionaryArray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of words, with spaces between."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    own = words.dictionary.take(words.indices.take(pa.array(at)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), own), b" ")


def phrase_counts(chunks: DataFrame, size: int, frequent: np.ndarray | None) -> DataFrame:
    """``(lang, phrase, n)`` of the phrases of ``size`` words.

    With ``frequent``, the map of :func:`bitmap` for one word less, only of phrases whose first and
    last words may be frequent.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        # Some 100,000 chunks at a time, so that phrases that come again are told together.
        for table in _gathered(batches):
            langs = table.column("lang").combine_chunks().dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = table.filter(pc.equal(langs.indices, k))
                found = _counted(lang, own, size, frequent, hashes)
                if found is not None:
                    yield found

    found = chunks.mapInArrow(take, "lang string, phrase binary, n bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of about ``SLICE_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _counted(
    lang: str, chunks: pa.Table, size: int, frequent: np.ndarray | None, hashes: _Hashes
) -> pa.RecordBatch | None:
    """Phrases of chunks of one language. One that would leave its chunk begins nowhere."""
    split = pc.split_pattern(chunks.column("chunk").combine_chunks(), b" ")
    words = split.values.dictionary_encode()
    ids, ends = words.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()[1:]
    number = words.dictionary.to_pylist()
    kept = ids != (number.index(_STOP) if _STOP in number else -1)
    starts = kept.copy()
    for k in range(1, size):
        starts[: len(ids) - k] &= kept[k:]
        starts[len(ids) - k :] = False
    # The last words of a chunk begin no phrase: the next chunk has them.
    for k in range(1, OVERLAP + 1):
        starts[ends - k] = False
    at = np.flatnonzero(starts)
    if frequent is not None:
        of_words = hashes(number)[ids]
        for k in (0, 1):
            at = at[_in_map(frequent, _phrase_hashes(lang, of_words, at + k, size - 1))]
    if not len(at):
        return None
    weights = np.repeat(chunks.column("n").to_numpy(), np.diff(split.offsets.to_numpy()))
    kind, kinds = ids[at], len(number)
    for k in range(1, size):  # numbers of phrases, of one more word each time, made dense again
        kind, found = pd.factorize(kind * len(number) + ids[at + k])
        kinds = len(found)
    totals = np.zeros(kinds, np.int64)
    np.add.at(totals, kind, weights[at])
    place = np.full(kinds, -1)
    place[kind] = at
    place, totals = place[place >= 0], totals[place >= 0]
    phrases = _joined(words, place, np.full(len(place), size))
    columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(place), np.int64))), phrases, pa.array(totals)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])


def _phrase_hashes(lang: str, of_words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    found = np.full(len(at), xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")), np.uint64)
    for k in range(size):
        found = _mixed(found, of_words[at + k])
    return found


def _in_map(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    at = found & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def bitmap(phrases: DataFrame) -> np.ndarray:
    """A bit for the hash of each of ``phrases (lang, phrase)``, 64 in a number.

    The driver gets numbers, not phrases: at most ``MAP_BITS`` bits however many phrases there are.
    """
    n = max(phrases.count(), 1)
    # One whole number at least: it is looked up by as many bits as its numbers have.
    size = min(MAP_BITS, max(64, 1 << int(16 * n - 1).bit_length()))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            places = np.zeros(batch.num_rows, np.uint64)
            for k, (lang, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase")), strict=True)):
                of_words = hashes(text.split(b" "))
                places[k] = _phrase_hashes(lang, of_words, np.zeros(1, np.int64), len(of_words))[0]
            places = np.unique(places & np.uint64(size - 1))
            words, begin = np.unique(places >> np.uint64(6), return_index=True)
            bits = np.uint64(1) << (places & np.uint64(63))
            masks = np.bitwise_or.reduceat(bits, begin) if len(begin) else bits
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(masks.view(np.int64))], ["at", "bits"])

    marked = phrases.mapInArrow(take, "at bigint, bits bigint").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits"))
    table = marked.toArrow()
    found = np.zeros(size // 64, np.uint64)
    found[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return found


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, size, n)`` of all phrases that come ``LEAST_COUNT`` times, and words per language."""
    chunks = written(parse(docs), "chunks")
    words = written(phrase_counts(chunks, 1, None), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    level = written(words.where(F.col("n") >= LEAST_COUNT), "frequent")
    found = level.withColumn("size", F.lit(1))
    totals = written(totals, "totals")
    drop_written(words)
    for size in range(2, LONGEST + 1):
        counted = phrase_counts(chunks, size, bitmap(level))
        level = written(counted.where(F.col("n") >= LEAST_COUNT), "frequent")
        found = found.unionByName(level.withColumn("size", F.lit(size)))
    drop_written(chunks)
    return found, totals


def _part(first: int, words: int):
    return F.array_join(F.slice("words", first, words), " ")


def collocations(docs: DataFrame) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the strongest phrases of each language.

    A phrase is two to four words of one piece of a text. It is cut where the score, how often its
    words come together against how often both parts come, is least. Phrases nearly always part of
    a longer one are left out.

    A missing language is ``und``; null and empty texts have no words. Repeated rows count each time.
    Equal scores are ordered by count, then by the bytes of the phrase. No documents, no rows.
    """
    found, totals = frequent_phrases(docs)
    phrases = written(found.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    counts = phrases.select("lang", "phrase", "n")

    split = candidates.withColumn("words", F.split("phrase", " "))
    cuts = split.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("first"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    # Parts of a candidate are as frequent as it is: each is in the table, once.
    known = lookup(counts)
    for part, name in (("first", "l"), ("rest", "r")):
        told = known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
        cuts = cuts.join(told, ["lang", part])
    together = F.col("a").cast("decimal(38,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    either = (F.col("l").cast("decimal(20,0)") + F.col("r")).cast("decimal(21,0)")
    score = F.call_function("div", together.cast("decimal(38,0)"), either)
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))

    # What each candidate holds, with the count of the most frequent candidate around it.
    longer = split.where("size > 2").select("lang", "words", "size", "a")
    inside = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("many"))
    inside = inside.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("many") + 1)).alias("at"))
    inside = inside.groupBy("lang", F.array_join(F.slice("words", F.col("at"), F.col("many")), " ").alias("phrase"))
    around = inside.agg(F.max("a").alias("most"))
    absorbed = F.coalesce(F.col("most").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(38,0)") * 80, F.lit(False))
    kept = scored.join(around, ["lang", "phrase"], "left").where(~absorbed)
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part")
    in_part = Window.partitionBy("lang", "part").orderBy(*order)
    best = kept.select("*", part).withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= REPORTED)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    best = best.withColumn("rank", rank).where(F.col("rank") <= REPORTED)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_PHRASES_SQL = " UNION ALL ".join(
    f"SELECT lang, unnest(list_transform(range(1, len(w) - {size - 2}), "
    f"lambda k: array_to_string(w[k:k + {size - 1}], ' '))) AS phrase, {size} AS size FROM pieces"
    for size in range(1, LONGEST + 1)
)
COLLOCATIONS_SQL = rf"""
    WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM
        (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)),
    f AS (SELECT lang, phrase, size, count(*) AS n FROM ({_PHRASES_SQL}) GROUP BY ALL),
    totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    candidates AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w
        FROM f WHERE size > 1 AND n >= {LEAST_COUNT}),
    cuts AS (SELECT c.lang, c.phrase, a, k, l.n AS l, r.n AS r,
            ((2000000::HUGEINT * a) // (l.n + r.n))::BIGINT AS score
        FROM (SELECT *, array_to_string(w[:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
            FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)) c
        JOIN f l ON l.lang = c.lang AND l.phrase = p AND l.size = k
        JOIN f r ON r.lang = c.lang AND r.phrase = q AND r.size = c.size - k),
    scored AS (SELECT * FROM cuts
        QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    around AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS most
        FROM (SELECT *, unnest(range(1, size - j + 2)) AS i
            FROM (SELECT *, unnest(range(2, size)) AS j FROM candidates WHERE size > 2))
        GROUP BY ALL),
    kept AS (SELECT s.* FROM scored s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase
        WHERE coalesce(100 * most < 80 * a, true))
    SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang
        ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN totals USING (lang)
    WHERE rank <= {REPORTED}"""
