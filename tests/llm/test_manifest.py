"""The Merkle manifest and its proofs against a plain version, and odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from fleetmill.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree int, part string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """All levels of the tree above ``nodes``."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def siblings(levels, at):
    found = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        found.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return found


def plain(rows):
    def leaf(row, text):
        return digest("".join(map(field, (*row[:4], text))))

    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append((own, climb([leaf(r, r[4]) for r in own])))
    top = climb([levels[-1][0] for _, levels in trees])
    out = []
    for number, (own, levels) in enumerate(trees):
        for at, row in enumerate(own):
            path = siblings(levels, at) + siblings(top, number)
            text, folded = row[4], levels[0][at]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                lower = {c: c + 32 for c in range(65, 91)}
                folded = leaf(row, text.translate(lower))
            for before, after in path:
                folded = digest("".join([*before, folded, *after]))
            proof = digest("".join("".join(a + b) for a, b in path))
            root = top[-1][0]
            out.append((row[0], levels[0][at], levels[-1][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "sizes", [[1], [1, 1], [16, 17], [300, 1, 2, 15, 16], [1] * 40, [5000, 33]], ids=str
)
def test_proofs_equal_those_of_a_plain_tree(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "PARTITION_LEAVES", 100)
    rng = random.Random(len(sizes))
    rows = []
    for k, size in enumerate(sizes):
        name = None if k == 2 else f"é{k}" if k % 2 else f"Z{k}"
        for i in range(size):
            text = rng.choice([None, "", "Ab Éa", "plain", "X" * rng.randint(1, 9)])
            rows.append((i * 7 + k, name, rng.choice(["en", None]), rng.choice([3, None]), text, 1, "x"))
    rng.shuffle(rows)
    found = merkle.proof_digests(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_rows_without_ids_repeated_and_very_long_ones(spark):
    rows = [(None, "s", None, None, None, 1, "x")] * 3 + [(None,) * 7, (5, None, "en", 1, "Q" * 300_000, 2, None)]
    rows += [(7, "s", "en", 1, "Same", 1, "x")] * 40 + [(7, "s", "en", 1, "other", 1, "x")]
    found = merkle.proof_digests(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_no_rows_no_proofs(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.build(empty).root is None
    assert merkle.proof_digests(empty).collect() == []


def test_multiproof_is_the_least_that_derives_the_root():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 5000))
        leaves = np.unique(rng.integers(0, n, rng.integers(1, 40)))
        missing = merkle.multiproof(leaves, n)
        known, size = set(leaves.tolist()), n
        for level in missing:
            needed = {k for r in {x // 16 for x in known} for k in range(r * 16, min(r * 16 + 16, size))}
            assert set(level.tolist()) == needed - known  # neither a node too few nor one too many
            known, size = {x // 16 for x in known}, -(-size // 16)
        assert size == 1 and known == {0}
    assert merkle.multiproof(np.arange(5000), 5000)[0].size == 0
