"""An FM-index over words: backward search on a wavelet matrix, for many patterns at once.

Suffixes are sorted by their first ``DEPTH`` words only, which is enough for intervals of patterns of
at most so many words. Bits are packed 64 to a word with a running count for each, about 1.5 bits
for every bit kept.
"""

from __future__ import annotations

import numpy as np

#: Words of the longest pattern.
DEPTH = 20


class WaveletMatrix:
    """How often a symbol stands before a place, by one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self._levels = []
        row, every = symbols.astype(np.int32), np.arange(kinds, dtype=np.int32)
        for bit in reversed(range(max(1, int(kinds - 1).bit_length()))):
            ones = (row >> bit & 1).astype(bool)
            padded = np.zeros((len(row) // 64 + 1) * 64, np.uint8)
            padded[: len(row)] = ones
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int32)
            self._levels.append((bit, words, before, len(row) - int(ones.sum())))
            row = np.concatenate([row[~ones], row[ones]])
            ones = (every >> bit & 1).astype(bool)
            every = np.concatenate([every[~ones], every[ones]])
        # Symbols stand below the last level as their kinds do, each as often as it comes.
        counts = np.bincount(symbols, minlength=kinds)[every]
        self._starts = np.empty(kinds, np.int64)
        self._starts[every] = np.cumsum(counts) - counts

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, words, before, zeros in self._levels:
            at = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[at] + np.bitwise_count(words[at] & mask)
            place = np.where(symbol >> bit & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._descend(symbol, place) - self._starts[symbol]


class FmIndex:
    """Index of a text of numbered words; number 0 separates and stands in no pattern."""

    def __init__(self, text: np.ndarray, kinds: int):
        n = len(text)
        padded = np.concatenate([text, np.zeros(DEPTH, text.dtype)]).astype(np.int64)
        ranks = {1: padded}
        for size in (1, 2, 4, 8):
            whole = ranks[size]
            pairs = whole[:-size] * (whole.max() + 1) + whole[size:]
            ranks[2 * size] = np.unique(pairs, return_inverse=True)[1]
        # The first twenty words: sixteen, then four.
        four = ranks[4][16 : 16 + n]
        self.order = np.lexsort((four, ranks[16][:n]))
        pad = np.concatenate([ranks[2], np.zeros(DEPTH, np.int64)])
        same = np.diff(ranks[16][self.order]) == 0
        first_19 = same & (np.diff(pad[self.order + 16]) == 0)
        first_19 &= np.diff(padded[self.order + 18]) == 0
        first_20 = same & (np.diff(four[self.order]) == 0)
        self._begin, self._end = _runs(first_19, n)
        begin = np.flatnonzero(np.append(True, ~first_20))
        least = np.minimum.reduceat(self.order, begin) if n else begin
        #: For each place in suffix order, the first place in the text with the same twenty words.
        self.earliest = np.repeat(least, np.diff(np.append(begin, n)))
        self._wavelet = WaveletMatrix(text[self.order - 1], kinds)
        self._smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))[:-1]])

    def extend(self, words: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals of the patterns with one more word before, all of which the text has.

        An interval of one place keeps one place, so its end needs no rank of its own.
        """
        base, many = self._smaller[words], np.flatnonzero(high - low > 1)
        both = self._wavelet.rank(
            np.concatenate([words, words[many]]), np.concatenate([low, high[many]])
        )
        low = base + both[: len(words)]
        high = low + 1
        high[many] = base[many] + both[len(words) :]
        return low, high

    def shorten(self, low: np.ndarray, high: np.ndarray):
        """Intervals of patterns of twenty words without their last."""
        return self._begin[low], self._end[high - 1]


def _runs(same_as_before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the begin and end of its run of places that are alike."""
    begin = np.flatnonzero(np.append(True, ~same_as_before)) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(begin, n))
    return np.repeat(begin, sizes), np.repeat(begin + sizes, sizes)


def earliest_places(words: np.ndarray, sizes: np.ndarray, kinds: int) -> list[np.ndarray]:
    """For each segment, for each window of twenty words, whether it is the first such window.

    ``words`` are the numbered words of all segments, ``sizes`` how many each has; segments are in the
    order in which first is meant. They are indexed as one text and then streamed from their ends,
    all at once: after twenty words, each word adds one before and drops one after, and the interval
    holds every place of the window.
    """
    text = np.zeros(len(words) + len(sizes), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = words
    index = FmIndex(text, kinds)
    first = np.zeros(len(text), bool)
    lanes = np.argsort(-sizes, kind="stable")
    ordered = -sizes[lanes]
    low, high = np.zeros(len(lanes), np.int64), np.full(len(lanes), len(text))
    for step in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(ordered, -step, "left"))  # lanes of more words than that
        lanes, low, high = lanes[:n], low[:n], high[:n]
        if step >= DEPTH:
            low, high = index.shorten(low, high)
        at = starts[lanes] + sizes[lanes] - 1 - step
        low, high = index.extend(text[at], low, high)
        if step >= DEPTH - 1:
            first[at] = index.earliest[low] == at
    ends = starts + np.maximum(0, sizes - DEPTH + 1)
    return [first[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
