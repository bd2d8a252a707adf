"""Token ids of many texts, with the ids of words that come again kept.

Both vocabularies cut a text at spaces before they merge, so the ids of a text are the ids of its
space-delimited parts, one after the other. A part is encoded once and then looked up.
"""

from __future__ import annotations

import os
from collections.abc import Callable

#: Most parts kept; then all are dropped. Parts of more characters than the second are not kept.
CACHE_PARTS, CACHE_CHARS = 600_000, 64


class PartEncoder:
    """Little-endian 32-bit ids of texts given in parts. ``encode_new`` gives those of new parts."""

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]]):
        self._encode_new = encode_new
        self._kept: dict[str, bytes] = {}

    def __call__(self, texts: list[list[str]]) -> list[bytes]:
        if len(self._kept) > CACHE_PARTS:
            self._kept.clear()
        kept = self._kept
        found = [list(map(kept.get, parts)) for parts in texts]
        lacking = [k for k, ids in enumerate(found) if None in ids]
        new = list(
            dict.fromkeys(
                part
                for k in lacking
                for part, ids in zip(texts[k], found[k], strict=True)
                if ids is None
            )
        )
        if new:
            own = dict(zip(new, self._encode_new(new), strict=True))
            for k in lacking:
                found[k] = [
                    own[part] if ids is None else ids
                    for part, ids in zip(texts[k], found[k], strict=True)
                ]
            kept.update(x for x in own.items() if len(x[0]) <= CACHE_CHARS)
        return [b"".join(ids) for ids in found]


def runs(parts: list[str], chars: int = 20_000) -> list[list[str]]:
    """The parts in runs of about so many characters."""
    out, size = [], chars
    for part in parts:
        if size >= chars:
            out.append([])
            size = 0
        out[-1].append(part)
        size += len(part)
    return out


def quiet_threads() -> None:
    """One thread per task: Spark deals out the cores. To be called before a tokenizer is made."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
