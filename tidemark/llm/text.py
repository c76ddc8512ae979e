"""Words as all operators here see them."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACED = "[^\\x20\\x09-\\x0D]+"  # runs without ASCII white space; the same as bytes.split() on UTF-8

_ALPHANUMERIC = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_count(column: str) -> Column:
    """Number of white-space separated words, 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(SPACED)), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound; the same in every process."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit hash spread over all others."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return mixed(out + np.uint64(n))


def spaced_words(text: str | None) -> list[bytes]:
    """White-space separated words, A to Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def alphanumeric_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII, A to Z lower-cased, as UTF-8."""
    return _ALPHANUMERIC.findall(text.encode().lower()) if text else []
