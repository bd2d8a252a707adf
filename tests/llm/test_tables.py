"""Tokenizers, packing, WARC, embeddings, chat formatting and the pipeline."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from fleetmill.llm import byte_bpe, chat, embeddings, packing, pii, queries, simhash, warc
from fleetmill.llm.common import components

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path(queries.WORD_BPE)
RANKS = public_tokenizers.path(queries.BYTE_BPE)
ALPHABET = " \n\t\x1c\x85\xa0 'saéIİΣ日本語1²٣-_.,\U0001f600é  tre<|>"


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(n)]


def test_word_ids_equal_those_of_whole_texts():
    whole = Tokenizer.from_file(WORDS)
    texts = random_texts(5_000, 1) + ["a<|endoftext|> b", "<|startoftext|>x", "A., b.c d,", ""]
    found = packing.WordBpe(WORDS).encode_texts(texts)
    for text, ids in zip(texts, found, strict=True):
        plain = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == plain, repr(text)


def test_byte_ids_equal_those_of_the_rank_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    whole = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    texts = random_texts(5_000, 2) + ["", "a" * 5_000, " " * 999 + "x", "aaa aa aaaa"]
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, bpe.encode_texts(texts), strict=True):
        assert ids.tolist() == whole.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text
    ids = bpe.encode("\U0001f600é x")
    assert "�" in bpe.decode(ids[:1]) or len(ids) == 2
    offsets = bpe.offsets(ids)
    assert offsets[0, 0] == 0 and offsets[-1, 1] == 4 and (offsets[1:, 0] <= offsets[:-1, 1]).all()


def test_token_digests(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in byte_bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert found[1].decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert found[None].n_tokens == found[2].n_tokens == 0
    more = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).where("doc_id = 1").first()
    assert bytes(more.decoded) == b"a b" and len(more.offsets) == 2 * len(more.ids)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_gapless_and_as_good_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    counts = {int(x): int(rng.integers(1, 50)) for x in rng.integers(1, capacity + 1, rng.integers(1, 20))}
    by_length, bins = {}, {}
    for length, *slot in packing.plan_bins(counts, capacity):
        by_length.setdefault(length, []).append(slot)
    for length, slots in by_length.items():
        slots.sort()
        ends = [x[0] for x in slots[1:]] + [counts[length]]
        for (rank, first, copies, offset), end in zip(slots, ends, strict=True):
            for k in range(end - rank):
                bins.setdefault(first + k // copies, []).append((offset + k % copies * length, length))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for places in bins.values():
        places.sort()
        assert [p for p, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
        assert sum(n for _, n in places) <= capacity
    rooms = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fitting = [r for r in rooms if r[0] >= length]
        if fitting:
            min(fitting)[0] -= length
        else:
            rooms.append([capacity - length])
    assert len(bins) <= len(rooms)


def test_packed_documents(spark):
    texts = ["word " * 5_000, None, "", "a b c", "a b c", *random_texts(300, 3)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, "a b c", 1), (None, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    found = packing.pack_documents(docs, WORDS).collect()
    whole = Tokenizer.from_file(WORDS)
    expected = []
    for doc_id, text, _ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            expected.append((doc_id, start // 2048, start, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: tuple(-1 if y is None else y for y in x)
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [p for p, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 2048
    assert len(sequences) == -(-sum(x[3] for x in expected) // 2048)
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = "é\r\n\r\nWARC/1.1\r\n" * 500
    rows = [(1, "u", None), (2, None, ""), (3, "u", html), (4, "a b\n", html), (4, "u", html), (None, "", "k")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, path int")
    index, folder = warc.archive(pages, folder=str(tmp_path / "w"))
    found = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(index).collect()}
    size = len(html.encode())
    assert found == {
        (1, "revisit", 2, 0),
        (2, "response", None, 0),
        (3, "revisit", 4, size),
        (4, "response", None, size),
        (None, "response", None, 1),
    }
    one = index.where("page_id = 3").first()
    with open(one.path, "rb") as file:
        file.seek(one.offset)
        member = zlib.decompress(file.read(one.length), 31)
    assert member.startswith(b"WARC/1.1\r\nWARC-Type: revisit") and member.endswith(b"\r\n\r\n")
    assert [h["X-Page-ID"] for h, _ in warc.inflate(one.path)].count("3") == 1
    short = warc.round_trip(pages, least_bytes=10).where("payload_bytes < 10")
    assert {r.record_type for r in short.collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0
    digest = base64.b32encode(hashlib.sha1(b"k").digest()).decode()
    assert digest in {r.payload_digest for r in index.collect()}


def test_embedding_links_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = np.repeat(rng.normal(size=(120, 48)), 5, 0)
    x = base + rng.normal(size=base.shape) * 0.2
    x[1::50] = x[0]
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    exact = close.sum(axis=1)
    got = np.array([found[i].n_links for i in range(len(x))])
    assert (got <= exact).all() and got.sum() >= 0.97 * exact.sum()
    assert found[1].component_id == 0 and not found[1].kept and found[0].kept


def grouped_vectors(n, share, seed, noise=0.027):
    """Random unit vectors of 64 numbers, a share of them about one: cosines of about 0.955 there."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    hot = int(n * share)
    vectors[:hot] = vectors[0] + rng.normal(size=(hot, 64)) * noise
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@pytest.mark.parametrize("chunk", [None, 100])
def test_no_link_of_a_dense_group_is_lost(spark, monkeypatch, chunk):
    vectors = grouped_vectors(3_000, 1 / 3, 7)
    if chunk:
        monkeypatch.setattr(embeddings, "LEAST_CHUNK", chunk)
        monkeypatch.setattr(embeddings, "MOST_CHUNK", chunk)
    rows = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"
    )
    found = {r.vec_id: r for r in embeddings.near_duplicates(rows).collect()}
    linked = vectors @ vectors.T >= 0.95
    assert [found[i].n_links for i in range(3_000)] == (linked.sum(axis=1) - 1).tolist()
    assert len({found[i].component_id for i in range(1_000)}) < 50


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 1e-3]), (4, None), (5, []), (6, [0.0, 0.0])]
    rows += [(7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 0.0, 0.0]), (None, None)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, cid int")
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table).collect()]
    assert len(found) == len(rows)
    assert (1, 3, 1, True) in found and (None, 3, 1, False) in found and (None, 0, None, False) in found
    assert found.count((2, 3, 1, False)) == 2
    for alone in (4, 5, 6, 7, 8, 9, 10):
        assert (alone, 0, alone, True) in found
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 400)
    edges = list(zip(ids[:200], ids[1:200])) + [(ids[200], x) for x in ids[201:]] + [(7_777_777, 7_777_777)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {x: min(ids[:200]) for x in ids[:200]} | {x: min(ids[200:]) for x in ids[200:]}


def test_preferences(spark):
    turn = lambda role, text: {"role": role, "text": text}
    a = [turn("user", "hi"), turn("assistant", "one"), turn("user", "more")]
    b = [turn("user", "hi"), turn("assistant", "two")]
    rows = [(1, a, b), (2, a, a), (3, a, None), (4, a[:1], a)]
    kind = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame(rows, f"conv_id long, chosen {kind}, rejected {kind}")
    found = {r.conv_id: r for r in chat.preferences(pairs).collect()}
    assert found[1].prompt == "<|user|>\nhi<|end|>\n" and found[1].n_shared == 1
    assert found[1].rejected == "<|assistant|>\ntwo<|end|>\n"
    begin, end = map(int, found[1].chosen_learned.split(":"))
    assert found[1].chosen[begin:end] == "one<|end|>\n"
    assert found[2].chosen == found[2].rejected == "" and found[2].n_shared == 3
    assert found[3].prompt == "" and found[3].rejected_learned == ""
    assert found[4].chosen == ""


def test_conversations_against_sql(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "ab"), (1, 2, "user", "z"), (2, 0, None, None)]
    rows += [(3, 0, "assistant", ""), (None, None, "user", "x"), (4, 1, "assistant", "é" * 9), (4, 0, "user", "u")]
    turns = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    found = queries.chat.preferences(chat.with_cut_answer(chat.conversations(turns)))
    with duckdb.connect() as db:
        db.register("conversations", turns.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        expected = db.execute(chat.PREFERENCES_SQL).fetchall()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before, state = state, stage(spark, state, SMALL)
        if name != "best-fit packing":
            assert state.columns == docs.columns
        if name == "simhash near-dedup":
            found = simhash.near_duplicates(before).collect()
            kept = {r.doc_id for r in state.collect()}
            assert kept == {r.component_id for r in found}
        if name == "pii":
            assert not pii.span_digests(state).where("n_email + n_card + n_ip > 0").count()
    assert state.where("offset + length > 2048").count() == 0
    assert corpus_pipeline.run(spark, SMALL).count() == state.count()


def test_stages_take_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", None, 0)]
    odd = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SMALL).count() == 0, name
        assert stage(spark, odd, SMALL).count() >= 2, name
