"""Byte-level BPE of whole texts by units whose ids don't depend on what stands around them.

A text is cut before single spaces between other characters. The vocabulary's pre-tokenizer never
joins across such a cut, so the ids of a text are those of its units laid end to end, and a unit
that occurs often is encoded once. Units of common characters go to tiktoken, which holds the same
vocabulary and is faster; units with any other character go to the tokenizers library itself, as
the two libraries' Unicode tables may differ there. A text of common characters alone goes to
tiktoken as it is, which takes less time than to look its units up.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: The special token of this vocabulary; its string inside a text counts as that token.
SPECIAL = {"<|endoftext|>": 50256}
_ODD_SPACE = re.compile(r"\s (?:\s|\Z)")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Latin letters with marks and general punctuation, for which both libraries were compared code point by code point.
_RARE = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


def units(text: str) -> list[str]:
    """Pieces of the text, in order; joined they are the text."""
    if _ODD_SPACE.search(text):
        return _SAFE_CUT.split(text)
    first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    return [first, *out] if first else out


@lru_cache(maxsize=2)
def _libraries(vocabulary: str, ranks: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=SPECIAL)
    return fast, Tokenizer.from_file(public_tokenizers.path(vocabulary))


class UnitCodec:
    """Ids of units, kept for the most recent ``most`` distinct ones."""

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS, most: int = 200_000):
        self.fast, self.whole = _libraries(vocabulary, ranks)
        self.most, self.known = most, {}

    def encode(self, unit: str) -> list[int]:
        if _RARE.search(unit):
            return self.whole.encode(unit, add_special_tokens=False).ids
        return self.fast.encode(unit, allowed_special="all")

    def packed(self, text: str, end: bytes = b"") -> np.ndarray:
        """The ids of a text, then those in ``end``, as little-endian unsigned 32-bit integers."""
        if not _RARE.search(text):
            ids = self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            return np.frombuffer(ids.tobytes() + end, dtype="<u4")
        known, parts = self.known, []
        for unit in units(text):
            if (ids := known.get(unit)) is None:
                ids = np.array(self.encode(unit), dtype="<u4").tobytes()
                if len(known) >= self.most:
                    known.clear()
                if len(unit) < 64:
                    known[unit] = ids
            parts.append(ids)
        return np.frombuffer(b"".join([*parts, end]), dtype="<u4")
