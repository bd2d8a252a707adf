"""PII, SimHash, substring dedup, quality and toxicity against plain versions, and odd input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from fleetmill.llm import pii, quality, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, d int"


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", 0, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, repeated rows, empty and very long texts."""
    texts = [None, "", " \n\t", "a", "x y", "word " * 50_000, "z" * 200_000, "1 " * 30_000]
    rows = [(i, t, None, None, None, "x", 1) for i, t in enumerate(texts)]
    rows += [(5, texts[5], None, None, None, "x", 1), (None, "a b c", "en", None, 1, "y", 2)]
    rows += [(None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def stands(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in match.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    return {
        k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if stands(k, m.group())]
        for k, p in BASE.items()
    }


def test_base_spans_equal_plain_regular_expressions(spark):
    rng = random.Random(3)
    kinds = ["a@b.c -_", "0123 -", "1.25+() -", "ab@.9\U0001f600 ", "25.01+", "+1 234-"]
    texts = ["", "é" * 9 + " a@b.cc"]
    for _ in range(2_000):
        kind = rng.choice(kinds)
        texts.append("".join(rng.choice(kind) for _ in range(rng.randint(0, 60))))
    cards = [x for x in ("".join(rng.choices("0123456789", k=16)) for _ in range(500)) if luhn(x)]
    words = [*cards, "1.2.3.4", "256.1.1.1", "+49 (0)30 1234567", "x@y.zz", "a@b.c@d.e"]
    texts += [" ".join(rng.choices(words, k=6)) for _ in range(300)]
    for row in pii.span_digests(docs(spark, texts)).collect():
        spans = base_spans(texts[row.doc_id])
        assert [row[f"n_{k}"] for k in BASE] == [len(spans[k]) for k in BASE]
        said = ",".join(sum(spans.values(), []))
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), texts[row.doc_id]


def test_checksums_and_context_decide_on_further_kinds(spark):
    texts = [
        "iban DE89 3704 0044 0532 0130 00.",
        "iban DE89 3704 0044 0532 0130 01.",
        "my ssn 123-45-6789",
        "part 123-45-6789",
    ]
    found = [r.spans for r in pii.span_digests(docs(spark, texts)).orderBy("doc_id").collect()]
    assert found == ["iban:5:32", "", "ssn:7:18", ""]


def test_account_numbers_before_capitals_and_digits(spark):
    number = "DE89 3704 0044 0532 0130 00"
    plain = number.replace(" ", "")
    ends = [" EUR 50", " 50 EUR", " In Berlin", " BIC COBADEFFXXX", ".", "\n7", ""]
    texts = [number + x for x in ends] + [plain + x for x in ends]
    texts += [f"AB12 {number}", f"{plain} {plain}", plain + "1", plain + "x", f"NO93 8601 1117 947 NO {plain}"]
    found = [r.spans for r in pii.span_digests(docs(spark, texts)).orderBy("doc_id").collect()]
    assert [re.findall("iban:[0-9:]+", x) for x in found] == [
        *[["iban:0:27"]] * 7,
        *[["iban:0:22"]] * 7,
        ["iban:5:32"],
        ["iban:0:22", "iban:23:45"],
        [],
        [],
        ["iban:0:18", "iban:22:44"],
    ]


def test_redaction_covers_overlapping_spans_once(spark):
    texts = ["call +49 30 12345678 or a.b@c.de!", None, "4111111111111111", "nothing"]
    clean = pii.redact(docs(spark, texts))
    assert clean.columns == docs(spark, texts).columns
    found = [r.text for r in clean.orderBy("doc_id").collect()]
    assert found == ["call [PHONE] or [EMAIL]!", None, "[CARD]", "nothing"]


# --- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    """Least id by row, for rows (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_equal_all_pairs(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)] for _ in range(25)]
    texts = []
    for _ in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = "Ünique"
        texts.append(" \x0b".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    texts += [None, "", "A b", "a B", "one two three", "\x1cx y"]
    fps = [plain_fingerprint(t) for t in texts]
    found = simhash.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.fingerprint for r in found] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in found] == plain_components(fps)


def test_fingerprint_hash_is_the_one_of_spark(spark):
    row = spark.sql("SELECT hex(xxhash64('a b ü')) AS h").first()
    assert int(row.h, 16) == xxhash.xxh64_intdigest("a b ü".encode(), 42)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    fps = []
    for _ in range(300):
        x = int(rng.choice(base))
        for b in rng.integers(0, 64, rng.integers(0, radius + 4)):
            x ^= 1 << int(b)
        fps.append(x)
    last = np.repeat([130, 131, 300], [130, 1, 169])
    parts = simhash.bit_sliced_links(np.array(fps, np.uint64), last, radius)
    found = sorted((int(a), int(b)) for i, j in parts for a, b in zip(i, j, strict=True))
    close = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= radius
    assert found == [(a, b) for a in range(300) for b in range(a + 1, last[a]) if close(a, b)]


@pytest.mark.parametrize("blocks, chunk", [(4, 512), (5, 512), (6, 512), (4, 7)])
def test_links_for_any_blocks_and_chunks(spark, blocks, chunk):
    rng = np.random.default_rng(5)
    fps = set()
    for x in rng.integers(0, 2**64, 12, dtype=np.uint64).tolist():
        for _ in range(12):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, blocks, chunk)
    number = {x: k for k, x in enumerate(signed)}
    forest = simhash.Forest(len(fps))
    pairs = np.array([(number[e.a], number[e.b]) for e in edges.collect()]).reshape(-1, 2)
    forest.join(pairs[:, 0], pairs[:, 1])
    assert forest.roots.tolist() == plain_components(fps)


# --- substring dedup


def plain_removal(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


@pytest.mark.parametrize(("heavy", "told"), [(256, 100), (2, 100), (2, 0)])
def test_removed_words_equal_all_windows(spark, monkeypatch, heavy, told):
    monkeypatch.setattr(substring, "HEAVY_SEGMENTS", heavy)
    monkeypatch.setattr(substring, "TOLD_ANCHORS", told)
    rng = random.Random(2)
    base = [rng.choice("abcd") for _ in range(400)]
    rows = []
    for i in range(200):
        words = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 390)
            fresh = [str(rng.random()) for _ in range(rng.randint(1, 20))]
            words += base[a : a + rng.randint(1, 60)] if rng.random() < 0.7 else fresh
        rows.append((i * 7 % 200, " \n".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "x " * 500), (1003, "y z " * 100)]
    found = substring.word_digests(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()}
    assert got == plain_removal(rows)


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    rng = random.Random(5)
    passage = [f"p{rng.random()}" for _ in range(40)]
    own = lambda n: [f"o{rng.random()}" for _ in range(n)]
    late = " ".join(own(60) + passage)
    texts = [None, "", "a b", late, late, " ".join(passage), " ".join(own(10) + passage + own(3))]
    found = substring.word_digests(
        spark.createDataFrame([(None, x) for x in texts], "doc_id long, text string").coalesce(1)
    ).collect()
    assert sorted((r.n_words, r.n_removed) for r in found) == sorted(
        [(0, 0), (0, 0), (2, 0), (100, 0), (100, 100), (40, 40), (53, 40)]
    )
    # One of the texts of an id keeps the passage; equal rows are one.
    rows = [(7, x) for x in (*texts, late)] + [(None, " ".join(passage)), (9, late)]
    found = substring.word_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {k: [(r.n_words, r.n_removed) for r in found if r.doc_id == k] for k in (None, 7, 9)}
    assert of[None] == [(40, 40)] and of[9] == [(100, 100)]
    long = [x for x in of[7] if x[0] >= 40]
    assert sum(n == 100 for n, _ in long) == 3 and len({x for x in long if x[0] == 100}) == 1
    assert sum(removed == 0 for removed in {n: gone for n, gone in long}.values()) == 1


# --- quality


def test_repeated_words_equal_all_windows():
    rng = random.Random(1)
    for _ in range(1_500):
        words = rng.choices([b"a", b"b", b"c"][: rng.randint(1, 3)], k=rng.randint(0, 60))
        windows = [tuple(words[i : i + 8]) for i in range(max(0, len(words) - 7))]
        counts = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
        assert quality.repeated_words(words) == len(covered)


def test_outliers_of_a_group_are_rejected_and_others_kept(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    texts = []
    for i in range(400):
        own = rng.choices(words, k=rng.randint(60, 90))
        texts.append(" ".join(w + "###" if i % 40 == 0 else w for w in own) + ".")
    texts += ["too short", None]
    rows = {r.doc_id: r for r in quality.judge(docs(spark, texts)).collect()}
    assert [i for i in range(400) if not rows[i].kept] == list(range(0, 400, 40))
    assert rows[400].base_failed and rows[401].base_failed and not rows[401].kept
    assert rows[0].n_symbols == 3 * rows[0].n_words


def plain_base(text):
    """The contract's columns, by its words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(max(0, len(words) - 7)))
    covered = {
        i + k for i in range(max(0, len(words) - 7)) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)
    }
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, again, len(covered), failed


def test_base_columns_equal_plain_ones(spark):
    rng = random.Random(12)
    pieces = ["a", "b", "cd", "é", "\u2003", "\U0001f600", "#", "|x", "\n", "\n\n", "\t", "\x0b", "\x1c", " ", ". "]
    texts = [None, "", "\n \n", "a\r\na\r\n"]
    for _ in range(400):
        part = "".join(x + rng.choice(" \n") for x in rng.choices(pieces, k=rng.randint(0, 60)))
        texts.append(part * rng.choice([1, 1, 2]))
    found = {r.doc_id: tuple(r)[1:7] for r in quality.judge(docs(spark, texts)).collect()}
    assert found == {i: plain_base(t) for i, t in enumerate(texts)}


def vectors(spark, groups):
    rows = [(g, i, *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    columns = ", ".join(f"x{i} double" for i in range(7))
    return spark.createDataFrame(rows, f"grp string, doc_id long, {columns}")


def found_estimates(spark, groups):
    rows = quality.estimates(vectors(spark, groups)).collect()
    return {r.grp: (np.array(r["mean"]), np.array(r["inverse"]).reshape(7, 7)) for r in rows}


def plain_steps(x, mean, inverse):
    """Concentration steps with sorted halves: the determinant and the distances they end with."""
    last = np.inf
    while True:
        d2 = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
        near = x[np.argsort(d2)[: (len(x) + 1) // 2]]
        cov = np.cov(near, rowvar=False, bias=True) + 1e-2 * np.eye(7)
        det = np.linalg.slogdet(cov)[1]
        if det >= last - 1e-4:
            return last, d2
        last, mean, inverse = det, near.mean(0), np.linalg.inv(cov)


def plain_mcd(x, begun):
    """The least determinant, and the estimate of the rows within the quantile of that."""
    det, d2 = min((plain_steps(x, m, i) for m, i in begun), key=lambda e: e[0])
    scale = max(np.sort(d2)[(len(x) + 1) // 2 - 1] / 6.346, 1)
    near = x[d2 <= 16.013 * scale]
    cov = np.cov(near, rowvar=False, bias=True) * 1.045 + 1e-2 * np.eye(7)
    return det, near.mean(0), np.linalg.inv(cov)


def mixed_groups():
    rng = np.random.default_rng(3)
    for good, bad in [(90, 0), (150, 60), (700, 330)]:
        clean = rng.normal(size=(good, 7)) @ rng.normal(size=(7, 7))
        yield good, np.concatenate([clean, rng.normal(size=(bad, 7)) + 30])


def test_estimates_equal_those_of_sorted_halves(spark):
    groups = {f"g{n}": x for n, x in mixed_groups()}
    found = found_estimates(spark, groups)
    for good, x in mixed_groups():
        own = quality.distances(x, *found[f"g{good}"])
        assert own[good:].min(initial=np.inf) > own[:good].max()
        if len(x) <= quality.SAMPLE:  # starts are then made of all rows
            _, mean, inverse = plain_mcd(x, [e[1:] for e in quality.starts(x)])
            assert np.allclose(own, quality.distances(x, mean, inverse), rtol=0.02, atol=0.05)


def test_starts_end_near_the_least_determinant_of_many():
    rng = np.random.default_rng(5)
    for _, x in mixed_groups():
        tries = [x[rng.permutation(len(x))[:8]] for _ in range(500)]
        tries = [(t.mean(0), np.linalg.inv(np.cov(t, rowvar=False) + 1e-2 * np.eye(7))) for t in tries]
        least = min(plain_steps(x, *t)[0] for t in tries)
        assert quality.starts(x)[0][0] < least + 0.3


def test_nearer_outliers_do_not_mask_farther_ones(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1_000, 7))
    x[700:950, 0] += 24
    x[950:, 0] += 45
    [(mean, inverse)] = found_estimates(spark, {"g": x}).values()
    d2 = quality.distances(x, mean, inverse)
    assert d2[:700].max() < 100 and d2[700:950].min() > 300 and d2[950:].min() > 100 * 7


def test_rows_that_are_all_alike_and_ties_have_an_estimate(spark):
    groups = {"same": np.ones((80, 7)), "two": np.repeat([[0.0] * 7, [9.0] * 7], [60, 40], axis=0)}
    found = found_estimates(spark, groups)
    assert np.allclose(found["same"][0], 1) and np.allclose(found["two"][0], 0)
    assert quality.distances(groups["two"], *found["two"])[60:].min() > 100 * 7


def test_bounded_groups_take_no_jobs_per_step_and_end_alike(spark, monkeypatch):
    rng = np.random.default_rng(5)
    groups = {f"g{n}": rng.normal(size=(n, 7)) * rng.uniform(0.5, 2, 7) for n in (60, 501, 1_500)}
    groups["g1500"][:300] += 8

    def found():
        rows = quality.estimates(vectors(spark, groups)).collect()
        return {r.grp: np.concatenate([r["mean"], r["inverse"]]) for r in rows}

    with monkeypatch.context() as patch:
        patch.setattr(quality, "WHOLE_ROWS", 500)  # of the three groups, two are taken in steps
        apart = found()

    def refuse(*_):
        raise AssertionError("a job per step")

    monkeypatch.setattr(quality, "_edges", refuse)
    whole = found()
    assert set(whole) == set(apart) == set(groups)
    for name, own in whole.items():
        assert np.allclose(own, apart[name], rtol=1e-9, atol=1e-9)


def ordinary(rng, n, words):
    return [" ".join(rng.choices(words, k=rng.randint(60, 90))) + "." for _ in range(n)]


def test_copied_junk_and_small_groups_are_judged(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    junk = " ".join(w + "###" for w in rng.choices(words, k=70))
    groups = [("en", "hot", 260, 140), ("en", "tail", 12, 1), ("xx", "few", 9, 1), (None, None, 9, 1)]
    rows, bad = [], set()
    for lang, source, good, copies in groups:
        for text in ordinary(rng, good, words) + [junk] * copies:
            bad |= {len(rows)} if text == junk else set()
            rows.append((len(rows), text, lang, source))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = quality.judge(table).collect()
    assert {r.doc_id for r in found if not r.kept} == bad


# --- toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    bad = ["stupid", "clownish", "clowning", "scum"]
    texts, labels = [], []
    for i in range(1_200):
        toxic = i % 6 == 0
        own = rng.choices(words, k=40) + (rng.choices(bad, k=3) if toxic else [])
        texts.append(" ".join(rng.sample(own, len(own))))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.scored(docs(spark, texts), table).where("held_out").collect()
    assert len(found) > 100
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in found) / len(found) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_of_held_out_rows_teach_nothing(spark):
    texts = ["good words here"] * 50 + ["scum scum"] * 50
    held = [i for i in range(100) if toxicity_fold(i) == 0]
    table = spark.createDataFrame([(i, int(i >= 50)) for i in held], "doc_id long, toxic int")
    assert toxicity.fit(docs(spark, texts), table).weights == {}


def toxicity_fold(doc_id):
    from zlib import crc32

    return crc32(str(doc_id).encode()) % 5


# --- odd input


OPERATORS = {
    "pii": lambda d: pii.span_digests(d),
    "redact": lambda d: pii.redact(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "substring": lambda d: substring.word_digests(d),
    "quality": lambda d: quality.judge(d),
    "toxicity": lambda d: toxicity.scored(
        d, d.sparkSession.createDataFrame([(1, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    ),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_each_give_a_row(odd, name):
    assert OPERATORS[name](odd).count() == 11


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_rows_that_repeat_an_id_do_not_remove_each_other(odd):
    found = substring.word_digests(odd).where("doc_id = 5").collect()
    assert len(found) == 2 and found[0] == found[1]
    # Within the text, every window but the first starts later than an equal one.
    assert found[0].n_words == 50_000 and found[0].n_removed == 49_999
