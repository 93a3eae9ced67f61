"""Encoding with a public byte-level BPE vocabulary by dynamic programming over prefixes.

For each prefix of a piece of bytes exactly one token can end its encoding. ``PrefixEncoder``
stores that token per prefix. A token may follow another only if merging their bytes in rank
order would leave the border between them; with that test the table is filled from left to
right, the encoding is read back from its end, and appending bytes only extends the table.

Results: an empty and a null text both give an empty list. Texts of any length are encoded
whole; strings that look like special tokens are ordinary text. Other columns of the input are
not looked at. Equal rows are encoded alike, each on its own.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie unless a path is given.
TOKENIZER_DIR = "/opt/tokenizers"

#: Fixed value: the public pattern that cuts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters a branch of PIECES can look at from its start on; white space also looks at the two characters beyond its end.
LOOK = 3

#: Pieces whose ids a Python worker remembers before it starts afresh (about 60 MB).
REMEMBERED = 300_000

_CUT = regex.compile(PIECES)

# Latin texts hold a few letters, numbers and spaces that can be listed, so the standard engine, which is faster, can cut them.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_NOT_LATIN = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def cut(text: str) -> list[str]:
    """The pieces of a text, by ``PIECES``."""
    return (_CUT if _NOT_LATIN.search(text) else _LATIN_CUT).findall(text)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixEncoder:
    """Encodes pieces of bytes; ``tokens`` maps bytes to ids, ``merges`` lists pairs in rank order."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = tokens
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # id -> rank, left part, right part
        for at, (left, right) in enumerate(merges):
            a, b, whole = tokens[left], tokens[right], tokens[left + right]
            self.rank[a, b] = at
            self.made.setdefault(whole, (at, a, b))
        self.length = {i: len(t) for t, i in tokens.items()}
        self.tails: dict[bytes, int] = {}  # every tail of a token -> the token it is, or -1
        for t, i in tokens.items():
            if len(t) == 1 or i in self.made:
                for at in range(1, len(t)):
                    self.tails.setdefault(t[at:], -1)
                self.tails[t] = i
        self._fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_json(cls, raw: str) -> PrefixEncoder:
        """``raw``: content of a vocabulary file with ``model.vocab`` and ``model.merges``."""
        model, letters = json.loads(raw)["model"], byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        special = {t["content"] for t in json.loads(raw).get("added_tokens", [])}
        return cls({as_bytes(t): i for t, i in vocab.items() if t not in special}, [(as_bytes(a), as_bytes(b)) for a, b in pairs])

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` in rank order keeps the border between them."""
        known = self._fits.get((a, b))
        if known is not None:
            return known
        # The tokens that touch the border, from whole back to single bytes. Undo the later
        # merge first; a pair across the border must not be mergeable before either side grew.
        x, y, bound, ok = a, b, float("inf"), True
        while True:
            across = self.rank.get((x, y))
            if across is not None and across < bound:
                ok = False
                break
            left, right = self.made.get(x), self.made.get(y)
            if left is None and right is None:
                break
            # At equal rank the pair on the left merges first, so it is undone last.
            if right is None or (left is not None and left[0] > right[0]):
                bound, x = left[0], left[2]
            else:
                # A merge across the border lies left of this one and wins a draw of ranks.
                bound, y = right[0] + 1, right[1]
        if len(self._fits) > 4 * REMEMBERED:
            self._fits.clear()
        self._fits[a, b] = ok
        return ok

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (the token that ends each prefix of ``data``) from its present length on."""
        tails, fits = self.tails, self.fits
        for end in range(len(last), len(data)):
            found, begin = [], end
            while begin >= 0:
                token = tails.get(data[begin : end + 1])
                if token is None:
                    break
                if token >= 0:
                    found.append((begin, token))
                begin -= 1
            for begin, token in reversed(found):
                if not begin or fits(last[begin - 1], token):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte of the text is not in the vocabulary")
        return last

    def read(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= self.length[last[end - 1]]
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ids.get(data)
        if whole is not None and (len(data) == 1 or whole in self.made):
            return [whole]
        return self.read(self.extend(data, []))

    def encode(self, text: str | None) -> list[int]:
        return [i for p in cut(text or "") for i in self.encode_piece(p.encode())]


class LiveText:
    """A text with the prefix tables of its pieces, for exact appends and edits."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.recut = 0  # bytes whose table entry was computed by the last change
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` by ``new``; only pieces near the edit are cut again."""
        old, ends = self.text, [*self.starts[1:], len(self.text)]
        text = old[:start] + new + old[end:]
        keep = 0
        while keep < len(self.starts) and ends[keep] + 1 < start and self.starts[keep] + LOOK <= start:
            keep += 1
        at = self.starts[keep] if keep < len(self.starts) else (len(old) if not self.starts else ends[-1])
        at = min(at, start)
        shift, old_at = len(new) - (end - start), {s: k for k, s in enumerate(self.starts)}
        starts, tables, rest, self.recut = self.starts[:keep], self.tables[:keep], len(self.starts), 0
        pos = at
        while pos < len(text):
            k = old_at.get(pos - shift)
            if k is not None and pos - shift >= end:
                rest = k  # from an old border on, the same text is cut in the same way
                break
            piece = _CUT.match(text, pos)
            data, begun = piece.group().encode(), []
            k = old_at.get(pos)
            if k is not None and pos < start:
                same = min(ends[k], start, piece.end())
                begun = self.tables[k][: len(old[pos:same].encode())]
            self.recut += len(data) - len(begun)
            starts.append(pos)
            tables.append(self.encoder.extend(data, list(begun)))
            pos = piece.end()
        else:
            rest = len(self.starts)
        self.starts = starts + [s + shift for s in self.starts[rest:]]
        self.tables = tables + self.tables[rest:]
        self.text = text

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.encoder.read(t)]


class _Pieces(dict):
    """Ids of the pieces met so far in this worker."""

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encoder.encode_piece(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_WORKER: dict[int, _Pieces] = {}


def encode_column(df: DataFrame, key: str, text: str, out: str = "ids", vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and the token ids of ``text`` of every row of ``df``, as ``array<int>``.

    Narrow: one scan of two columns, no shuffle. The vocabulary file (a fixed size, below 2 MB)
    is read on the driver and broadcast.
    """
    spark = df.sparkSession
    with open(os.path.join(folder, vocabulary), encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    mark = hash((folder, vocabulary, len(shipped.value)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _WORKER:
            _WORKER[mark] = _Pieces(PrefixEncoder.from_json(shipped.value))
        pieces = _WORKER[mark]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                flat: list[int] = []
                offsets = [0]
                for t in part.column(1).to_pylist():
                    if t:
                        for p in cut(t):
                            flat += pieces[p]
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(encode, f"`{key}` {kind}, `{out}` array<int>")
