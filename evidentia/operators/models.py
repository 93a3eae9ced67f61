"""What a language model or an encoder decides, as interfaces with deterministic stand-ins.

The stand-ins make pipelines run and test offline; they claim no quality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.words import WORD_RE


class Encoder(Protocol):
    dim: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class Arbiter(Protocol):
    def choose(self, text: str, candidates: Sequence[dict]) -> int:
        """Number of the candidate the text belongs to, or -1 for none."""


class Judge(Protocol):
    def score(self, idea: str, leaves: Sequence[str]) -> int:
        """Whole number from 0 to 10."""


class Extractor(Protocol):
    def extract(self, section: str, prompt: str) -> Sequence[str]:
        """Drafts of a section."""


class Combiner(Protocol):
    def combine(self, a: str, b: str) -> tuple[str, str] | None:
        """Text and applicability of what two ideas make together; None if they make nothing."""


class JoiningCombiner:
    """Both texts in a row; texts of which one begins with the other make nothing."""

    def combine(self, a: str, b: str) -> tuple[str, str] | None:
        return None if a.startswith(b) or b.startswith(a) else (f"{a} / {b}", f"where both apply ({len(a)}, {len(b)})")


class SentenceExtractor:
    """The sentences of a section that hold a number."""

    def extract(self, section: str, prompt: str) -> list[str]:
        return [s.strip() for s in section.replace("!", ".").split(". ") if any(c.isdigit() for c in s)]


class HashingEncoder:
    """Unit vectors of signed word hashes."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in WORD_RE.findall((text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        out[:, 0] += (size[:, 0] == 0).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class OverlapArbiter:
    """Links to the first candidate whose text shares at least ``least`` of all words."""

    def __init__(self, least: float = 0.5):
        self.least = least

    def choose(self, text: str, candidates: Sequence[dict]) -> int:
        mine = set(WORD_RE.findall(text.lower()))
        for n, c in enumerate(candidates):
            other = set(WORD_RE.findall((c.get("text") or "").lower()))
            if mine and other and len(mine & other) >= self.least * len(mine | other):
                return n
        return -1


class CountingJudge:
    """Trust by the number of leaves, up to 10."""

    def score(self, idea: str, leaves: Sequence[str]) -> int:
        return min(10, len(leaves))


def encoded(text: Column, encoder: Encoder) -> Column:
    """Vectors of a text column through an iterator UDF, so that an encoder is loaded once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(encoder.encode([t or "" for t in b])), index=b.index)

    return run(text)


def generalised(text: Column, rewrite: Callable[[str], str]) -> Column:
    """A text rewritten by a pluggable step."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: None if t is None else rewrite(t))

    return run(text)
