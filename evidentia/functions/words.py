"""Words and runs of words, as column expressions and over flat numpy arrays."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: an unbroken run of letters and digits.
WORD = r"[\p{L}\p{N}]+"

#: White space in any script, for a character class of either regular-expression dialect.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

#: The same for Python's ``re``.
WORD_RE = re.compile(r"[^\W_]+")

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    """Lower-case words of a text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers, so that equal inputs only give equal outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of each ``n`` successive ``codes`` (uint64), a polynomial in an odd ``base``, then scattered."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    b = np.uint64(base | 1)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= b
            out += codes[k : k + len(out)]
        return mix(out + _MIX)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` successive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x
