"""Shared plumbing: names, hashes of words, and expressions that are evaluated once."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators.graph import components
from arbora.tables import CHECKPOINT_KEY, Scratch, materialize, new_path, remove, shared_dir

__all__ = [
    "CHECKPOINT_KEY", "Scratch", "components", "computed", "fresh", "gram_hashes", "let", "materialize", "new_path", "remove", "shared_dir", "word_hashes",
]


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores in front until no column of ``frames`` has it, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class WordHashes(dict):
    """64-bit hashes of words (bytes); emptied when it is full."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), dtype=np.uint64)


word_hashes = WordHashes()


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every ``k`` words in a row, from the hashes of the words."""
    out = np.full(max(0, len(words) - k + 1), k, dtype=np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, held apart from what follows.

    The optimizer substitutes a projection's expressions into later filters and lambdas, where they would be evaluated
    again for each use or even each element; it does not do so through a generator.
    """
    made = F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.select(*keep, made)
