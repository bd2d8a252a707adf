"""Phrase mining against plain counting, and odd input."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetmill.llm import collocations

DOCS = "doc_id long, text string, lang string, words string, n long"


def pieces(text):
    lower = {c: c + 32 for c in range(65, 91)}
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
        yield re.findall("[^\x20\x09]+", piece)


def plain(docs, least):
    counts = {}
    for text, lang in docs:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for words in pieces(text):
            for size in range(1, 5):
                own.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, own in counts.items():
        total = sum(n for p, n in own.items() if len(p) == 1)
        candidates = {p: n for p, n in own.items() if len(p) > 1 and n >= least}
        most = Counter()
        for p, n in candidates.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    most[p[k : k + size]] = max(most[p[k : k + size]], n)
        rows = []
        for p, a in candidates.items():
            cuts = [(2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if 100 * most[p] < 80 * a:
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:2000], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def mined(spark, docs):
    rows = [(k, *x, "x", 1) for k, x in enumerate(docs)]
    found = collocations.collocations(spark.createDataFrame(rows, DOCS))
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_phrases_equal_those_of_plain_counting(spark, monkeypatch, seed):
    monkeypatch.setattr(collocations, "LEAST_COUNT", 5)
    rng = random.Random(seed)
    vocabulary = ["New", "york", "the", "Of", "é", "ÜBER", "日本", "x", "x1", "\x00", "a-b", "\x1c"]
    fixed = ["new york city hall", "of the x", "a-b a-b a-b"]

    def text():
        words = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        return "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "!?", "\x0b"]) for w in words)

    docs = [(text(), rng.choice(["en", "fr", None, ""])) for _ in range(150)]
    docs += [docs[3]] * 40 + [(None, "en"), ("", None), ("...", "de"), ("one", "it"), (None, "es")]
    docs += [("a " * 10_000, "en"), ("la le " * 1_000 + "x", "fr")]
    assert mined(spark, docs) == plain(docs, 5)


def test_top_of_a_language_with_many_phrases(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_COUNT", 1)
    rng = random.Random(7)
    docs = [(" ".join(f"w{rng.randint(0, 400)}" for _ in range(40)), "en") for _ in range(150)]
    found = mined(spark, docs)
    assert len(found) == 2_000
    assert found == plain(docs, 1)


def test_texts_of_spaces_have_no_words(spark):
    docs = [("a b", "en")] * 30 + [(" ", "en"), ("\t \t", "en"), ("  ", "fr"), (" . ", "fr"), ("\n", "de")]
    assert mined(spark, docs) == plain(docs, 30) == [("en", 1, "a b", 30, 30, 30, 60, 1_000_000)]


def test_languages_with_a_single_frequent_word(spark):
    # Of one or two frequent words, the map has fewer bits than one of its numbers.
    for k in range(12):
        docs = [(f"w{k} " * 9, "en")] * 12
        assert mined(spark, docs) == plain(docs, 30) != []


def test_no_documents(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en")]) == []


def test_chunks_begin_in_every_text_and_not_in_its_last_words():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 200) + collocations.OVERLAP for _ in range(rng.randint(1, 8))]
        words = [rng.choice([b"a", b"b", b"c", b"."]) for _ in range(sum(sizes))]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        starts = collocations.chunk_starts(collocations._Hashes()(words), begins)
        assert set(begins) <= set(starts.tolist()) and (np.diff(starts) > 0).all()
        text = np.searchsorted(begins, starts, "right") - 1
        assert (starts < (begins + sizes)[text] - collocations.OVERLAP).all()
