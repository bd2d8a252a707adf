"""Byte-level BPE encoding and decoding by the ``tokenizers`` library (operator 8).

A rank file lists byte strings by rank. Two neighbouring parts are merged if what they make has a
rank, the lowest rank first. For the ``tokenizers`` library every byte becomes a printable
character and every way to cut a listed string into two listed strings becomes a merge, in the
order of the ranks. Tests compare the ids with those of ``tiktoken``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from fleetmill.llm.common import slices
from fleetmill.llm.tokens import PartEncoder, quiet_threads, runs

# A single space between two other characters always begins a match of the pattern.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ByteBpe:
    """Encodes and decodes with the ranks of a ``.tiktoken`` file."""

    def __init__(self, path: str, pattern: str):
        quiet_threads()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        chars = byte_characters()
        name = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        merges = [
            (name[token[:i]], name[token[i:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges)
        self._tokenizer = Tokenizer(model)
        self._tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        byte_of = {c: b for b, c in enumerate(chars)}
        shown = {rank: name[token] for token, rank in ranks.items()}
        self._bytes = {rank: bytes(map(byte_of.__getitem__, s)) for rank, s in shown.items()}
        self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for rank, token in self._bytes.items():
            self._sizes[rank] = len(token)
        self._encoder = PartEncoder(self._encode_new)

    def _encode_new(self, parts: list[str]) -> list[bytes]:
        """Parts that follow each other are a text; their ids end where their bytes end."""
        together = runs(parts)
        found = self._tokenizer.encode_batch_fast(["".join(x) for x in together])
        out = []
        for run, ids in zip(together, (np.array(x.ids, "<u4") for x in found), strict=True):
            ends = np.cumsum([len(x.encode()) for x in run])
            cuts = np.searchsorted(np.cumsum(self._sizes[ids]), ends) + 1
            out += [ids[a:b].tobytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        # A leading part has no space before it, so it is told apart and encoded by itself.
        firsts, rests = [], []
        for text in texts:
            first, *rest = _CUT.split(text)
            firsts.append(first)
            rests.append([" " + x for x in rest])
        heads = self._tokenizer.encode_batch_fast(firsts)
        return [
            np.concatenate([np.array(head.ids, "<u4"), np.frombuffer(ids, "<u4")])
            for head, ids in zip(heads, self._encoder(rests), strict=True)
        ]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_texts([text])[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text. A character cut by the ends of ``ids`` becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """First and end character of each token; tokens that share a character both have it."""
        data = np.frombuffer(self.decode_bytes(ids), np.uint8)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        ends = np.cumsum(self._sizes[ids])
        starts = ends - self._sizes[ids]
        inside = (np.append(data, 0)[starts] & 0xC0) == 0x80
        return np.stack([begins[starts] - inside, begins[ends]], axis=1)


@cache
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, ids, offsets, decoded)`` of every text, one row per row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers, ``offsets`` pairs of 32-bit integers,
    ``decoded`` the bytes that the ids stand for. A null or empty text has no ids. Repeated rows
    and null document ids stay as they are; other columns are not read.
    """
    schema = f"{id_col} bigint, ids binary, offsets binary, decoded binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in slices(batches, text_col):
            ids = bpe.encode_texts([x or "" for x in batch.column(text_col).to_pylist()])
            columns = [
                batch.column(id_col),
                pa.array([x.tobytes() for x in ids], pa.binary()),
                pa.array([bpe.offsets(x).astype("<u4").tobytes() for x in ids], pa.binary()),
                pa.array([bpe.decode_bytes(x) for x in ids], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "offsets", "decoded"])

    return docs.select(docs[id_col].cast("bigint").alias(id_col), text_col).mapInArrow(
        encode, schema
    )


def token_digests(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: as above, digested where it is made."""
    schema = f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in slices(batches, text_col):
            ids = bpe.encode_texts([x or "" for x in batch.column(text_col).to_pylist()])
            columns = [
                batch.column(id_col),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array(
                    [hashlib.sha256(bpe.decode_bytes(x)).hexdigest() for x in ids], pa.string()
                ),
            ]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[id_col].cast("bigint").alias(id_col), text_col).mapInArrow(
        digest, schema
    )
