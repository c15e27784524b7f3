"""Token ids of whole texts under a public byte-level vocabulary.

The vocabulary is read from its tokenizer file on the driver and travels to the tasks as text (1.6 MB).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

PIECE = 1 << 20          # characters tokenised at a time
# Fixed value: how the public vocabulary's training text was split into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _byte_of() -> dict[str, int]:
    """Bytes by the characters that stand for them: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as the tokenizer file gives them without special tokens added; in a text their strings are special."""

    def __init__(self, content: str):
        import tiktoken

        described = json.loads(content)
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        self._special = special
        self._encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.dtype = np.uint16 if max([*ranks.values(), *special.values()]) < 1 << 16 else np.uint32

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """A long text's ids in turn; it is cut where a space follows a letter, which no token crosses."""
        at = 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and not (text[end] == " " and text[end - 1].isalpha()):
                end += 1
            part = text[at:end]
            if any(token in part for token in self._special):
                ids = self._encoding.encode(part, allowed_special="all")
            else:
                ids = self._encoding.encode_ordinary(part)
            yield np.array(ids, dtype=self.dtype)
            at = end

    def ids(self, text: str) -> np.ndarray:
        parts = list(self.pieces(text))
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, self.dtype), *parts])
