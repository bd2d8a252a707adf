"""Substring dedup: words and anchors of many texts at once, the search in the index, and the columns made."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fleetmill.llm import fm_index, substring
from tests.llm.test_texts import plain_removal

ODD = [
    None,
    "",
    " \t\n",
    " a\x0bb\x1cc\x85d e\x1f 　f\x00g ",
    "one",
    "\r\nend ",
    "\U0001f600 é" * 9,
    "",
]


def test_words_of_many_texts_are_those_of_each():
    texts = pa.array([*ODD, "x y " * 30, None])
    for part in (texts, texts[1:], texts[3:5], texts[2:3], texts[:0]):
        hashes, begins = substring.word_hashes(part)
        words = [(x or "").encode().split() for x in part.to_pylist()]
        assert np.diff(begins).tolist() == [len(x) for x in words] and begins[-1] == len(hashes)
        flat = [w for x in words for w in x]
        pairs = set(zip(flat, hashes.tolist(), strict=True))
        assert len(pairs) == len(set(flat)) == len({h for _, h in pairs})


def test_anchors_of_many_texts_are_those_of_each():
    rng = random.Random(3)
    sizes = [0, 19, 20, 21, 300, 5, 15, 20, 700]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in sizes]
    number, grams, first, last = substring.anchors(pa.array([*texts, None]))
    for k, (text, n) in enumerate(zip(texts, sizes, strict=True)):
        own = number == k
        alone = substring.anchors(pa.array([text]))
        for x, y in zip((grams, first, last), alone[1:], strict=True):
            assert x[own].tolist() == y.tolist()
        # Every window of the text has one anchor.
        windows = [w for a, b in zip(first[own], last[own], strict=True) for w in range(a, b + 1)]
        assert windows == list(range(max(0, n - 19)))
    assert set(number.tolist()) == {2, 3, 4, 7, 8}


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz"])
def test_search_finds_first_windows_and_ranks_single_places_once(monkeypatch, letters):
    rng = random.Random(4)
    base = [rng.choice(letters) for _ in range(300)]
    segments = []
    for _ in range(150):
        a = rng.randint(0, 260)
        own = [str(rng.random()) for _ in range(rng.randint(0, 4))]
        segments.append([*own, *base[a : a + rng.randint(20, 45)]])
    segments.append(["w"] * 60)
    ranked = []
    rank = fm_index.WaveletMatrix.rank

    def counted(self, symbol, place):
        ranked.append(len(place))
        return rank(self, symbol, place)

    monkeypatch.setattr(fm_index.WaveletMatrix, "rank", counted)
    kinds = {w: k + 1 for k, w in enumerate(sorted({w for x in segments for w in x}))}
    words = np.array([kinds[w] for x in segments for w in x])
    found = fm_index.earliest_places(words, np.array([len(x) for x in segments]), len(kinds) + 1)
    seen = set()
    for segment, firsts in zip(segments, found, strict=True):
        windows = [tuple(segment[k : k + 20]) for k in range(max(0, len(segment) - 19))]
        expected = []
        for window in windows:
            expected.append(window not in seen)
            seen.add(window)
        assert firsts.tolist() == expected
    # Both ends of an interval of one place are known from one rank.
    assert sum(ranked) < 2 * len(words)
    assert fm_index.earliest_places(np.empty(0, int), np.empty(0, int), 1) == []


def test_windows_do_not_reach_into_the_next_text_and_only_asked_columns_are_made(spark):
    rng = random.Random(6)
    passage = [f"é{rng.random()}" for _ in range(30)]
    whole = " ".join(passage)
    rows = [(k, x) for k, x in enumerate(ODD)]
    # The passage cut over two neighbouring texts is no window of either.
    rows += [(20, " ".join(passage[:15])), (21, " ".join(passage[15:])), (22, whole)]
    rows += [(23, "\t" + "\x0c\n".join(passage) + " own\x1cword "), (24, "w " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = substring.word_digests(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()}
    assert got == plain_removal(rows)
    assert got[22][1] == 0 and got[23][1] == 30
    asked = substring.deduplicated(docs, ["doc_id", "text"])
    assert asked.columns == ["doc_id", "text"]
    texts = dict(asked.collect())
    assert [texts[k] or "" for k in range(len(ODD))] == [x or "" for x in ODD]
    assert texts[22] == whole and texts[23] == "own\x1cword"
