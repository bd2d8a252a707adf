"""Benchmark decontamination against a plain search over words, and odd input."""

import hashlib
import random
import re

import pytest

from fleetmill.llm import decontaminate

DOCS = "doc_id long, text string, hits string, items int"
ITEMS = "item_id long, text string, words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return WORD.findall((text or "").translate(lower))


def plain(docs, items):
    wanted = {}
    for item_id, text in items:
        own = words(text)
        for k in range(max(1, len(own) - 9) if own else 0):
            wanted.setdefault(tuple(own[k : k + 10]), set()).add("-" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for size in {len(w) for w in wanted}:
            for k in range(len(own) - size + 1):
                found = wanted.get(tuple(own[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    names |= found
        said = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(names), said, bool(hit)))
    return sorted(out, key=repr)


def rows(spark, docs, items):
    found = decontaminate.contamination(
        spark.createDataFrame([(*x, "x", 1) for x in docs], DOCS),
        spark.createDataFrame([(*x, "x") for x in items], ITEMS),
    )
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("few", [10**6, 50])
def test_hits_equal_those_of_a_plain_search(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", few)
    rng = random.Random(few)
    vocabulary = ["a", "B", "the", "é", "Über", "日本", "word" * 9, "x1", "İ", "of"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 40]))) for i in range(60)]
    items += [(3, text(12)), (None, text(11)), (None, text(10)), (70, None), (71, "..."), (72, "")]
    docs = [(i, text(rng.randint(0, 120))) for i in range(150)]
    for i in range(60):  # passages inside other text, as they are and in capitals
        item = rng.choice(items)[1] or ""
        docs.append((200 + i, f"{text(20)} {item.upper()} {text(9)}{item}"))
    docs += [(None, docs[170][1]), (170, docs[170][1]), (None, None), (999, ""), (998, "a " * 60_000)]
    assert rows(spark, docs, items) == plain(docs, items)


def test_a_passage_in_very_many_items_and_documents(spark):
    rng = random.Random(5)
    passage = " ".join(f"w{k}" for k in range(14))
    items = [(i, f"own{i} {passage}") for i in range(400)]
    docs = [(i, f"{passage} {rng.random()}") for i in range(300)] + [(900, passage * 3_000)]
    assert rows(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    items, docs = [(1, "one two three")], [(1, "zero one two three"), (2, None)]
    assert rows(spark, [], items) == []
    assert rows(spark, docs, []) == plain(docs, [])
    assert rows(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("seed", range(20))
def test_shifts_pass_over_no_occurrence(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab c") for _ in range(20_000))
    starts = [rng.randrange(19_000) for _ in range(60)]
    strings = sorted({text[s : s + rng.randint(1, 90)] for s in starts} | {b"abcabcabcabcabcabc"})
    strings = [x for x in strings if len(x) >= 16 or x.startswith(b" ")]
    found = set(zip(*decontaminate.Patterns(strings).find(text), strict=True))
    assert found == {
        (m.start(), k) for k, x in enumerate(strings) for m in re.finditer(b"(?=" + re.escape(x) + b")", text)
    }
