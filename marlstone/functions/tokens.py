"""Tokenizers of public vocabulary files: byte-pair ranks, library files of merges, sentence pieces.

A file's kind follows from its extension. Workers load a file once a process from bytes that the driver read, so only the
driver needs the path.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Fixed value: the published pattern that splits text before byte-pair merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = {".tiktoken": "ranks", ".json": "merges", ".model": "pieces"}


@dataclass(frozen=True)
class Vocabulary:
    kind: str
    raw: bytes

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        kind = KINDS.get(Path(path).suffix)
        if kind is None:
            raise ValueError(f"unknown kind of vocabulary: {path!r}; known are {sorted(KINDS)}")
        return cls(kind, Path(path).read_bytes())


class Tokenizer:
    """Token ids of a text, and where in the text each token begins."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN) -> None:
        self.kind = vocabulary.kind
        if self.kind == "ranks":
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.raw.splitlines())}
            self._own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        elif self.kind == "merges":
            from tokenizers import Tokenizer as Library

            self._own = Library.from_str(vocabulary.raw.decode())
            self._own.encode_special_tokens = True
        else:
            import sentencepiece

            self._own = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.raw)

    def encode(self, text: str) -> list[int]:
        if self.kind == "ranks":
            return self._own.encode_ordinary(text)
        return self._own.encode(text, add_special_tokens=False).ids if self.kind == "merges" else self._own.encode(text)

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def starts(self, text: str) -> list[int]:
        """Letter at which each token begins, in order; tokens within a letter begin at it."""
        if self.kind == "ranks":
            return self._own.decode_with_offsets(self._own.encode_ordinary(text))[1]
        if self.kind == "merges":
            return [a for a, _ in self._own.encode(text, add_special_tokens=False).offsets]
        # places of this library are bytes
        raw = np.frombuffer(text.encode(), np.uint8)
        letters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return [int(letters[p.begin]) for p in self._own.encode(text, return_type="proto").pieces]


@lru_cache(maxsize=4)
def tokenizer(vocabulary: Vocabulary) -> Tokenizer:
    """The tokenizer of a vocabulary, made once a process."""
    return Tokenizer(vocabulary)


class Letters:
    """Lengths of parts of a text in letters."""

    def size(self, a: int, b: int) -> int:
        return b - a

    def reach(self, a: int, most: int) -> int:
        """Where a part of ``most`` that begins at ``a`` ends."""
        return a + most


class Tokens(Letters):
    """Lengths of parts of a text in tokens of the whole text."""

    def __init__(self, text: str, tok: Tokenizer) -> None:
        self._at, self._n = sorted(tok.starts(text)), len(text)

    def size(self, a: int, b: int) -> int:
        return bisect_left(self._at, b) - bisect_left(self._at, a)

    def reach(self, a: int, most: int) -> int:
        i = bisect_left(self._at, a) + most
        return max(a + 1, self._at[i]) if i < len(self._at) else self._n

