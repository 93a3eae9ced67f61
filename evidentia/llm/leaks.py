"""Evaluation texts leaking into a corpus: MinHash containment search, partitioned by size.

A shingle is a run of ``n`` words. Its MinHash (the *anchor*) is the least hash among the short runs
of ``n // 2`` words inside it (five, for ten), so equal shingles have equal anchors wherever they
stand and neighbours mostly share one: a text has about two anchors per ``n / 2`` shingles.

Items are grouped into size classes by their number of distinct shingles. In a class whose items
have at least ``l`` shingles, and for a wanted containment ``t``, a document must hold
``ceil(t * l)`` of them. An item's sketch is its anchors in the order of their hashes, without those
at the end that stand for fewer shingles in all than that: whatever shingles a document holds, one
of their anchors is in the sketch, so the search loses nothing, however long the document, and the
sketch is shorter the more is wanted. A document whose own anchors hit a sketch is a candidate; it
is verified by exact shingle containment.

Sketches and shingles of the items are built on the driver and broadcast if the items' text is at
most ``ITEM_BYTES`` and what is built, a few arrays, at most ``SKETCH_BYTES``; the words of the shingles
are then compared themselves. Larger test collections are joined with the corpus on anchors, and
verified by joins on 128 bits of the words' hashes, with the same result.

Results: one row per (document, item) with the distinct shingles both hold. Null, empty and
short texts (fewer than ``n`` words) hold no shingle and never appear; repeated rows of a key
count once, as one text each; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.words import WORD_RE, run_hashes, sliding_min, words
from evidentia.scratch import materialise

BASE, BASE_2, BASE_3 = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93

#: Largest text of all items, and largest arrays built from it, that are held on the driver and broadcast.
ITEM_BYTES, SKETCH_BYTES = 8 << 20, 64 << 20


def size_class(shingles: int) -> int:
    """Classes 1, 2, 3-4, 5-8, 9-16 and so on, named by their upper bound."""
    return 1 << max(0, shingles - 1).bit_length()


def wanted(shingles: int, containment: float) -> int:
    """Shingles of an item of this size that a document must hold, at least: the same number for its whole class."""
    bound = size_class(shingles)
    return max(1, math.ceil(containment * (bound // 2 + 1 if bound > 1 else 1)))


def sketch(anchors: np.ndarray, containment: float) -> np.ndarray:
    """The anchors an item keeps. ``anchors``: one per distinct shingle."""
    names, stands_for = np.unique(anchors, return_counts=True)
    left_out = np.cumsum(stands_for[::-1])[::-1] < wanted(len(anchors), containment)
    return names[~left_out]


def shingle_anchors(codes: np.ndarray, n: int) -> np.ndarray:
    """Anchor of each run of ``n`` successive codes."""
    short = max(1, n // 2)
    return sliding_min(run_hashes(codes, short, BASE), n - short + 1)


def _expand(bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists stored end to end: for each wanted list its position in ``at`` and the places of its entries."""
    n = bounds[at + 1] - bounds[at]
    which = np.repeat(np.arange(len(at)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[at], n)


def _lists(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, bounds and values of the lists that sorted pairs form."""
    names, first = np.unique(keys, return_index=True)
    return names, np.append(first, len(keys)), values


class ItemSketches:
    """What the executors need: word codes, sketches, and shingles for the exact check, as flat arrays."""

    def __init__(self, items: list[tuple[int, str]], n: int, containment: float):
        self.n, self.containment = n, containment
        self.codes: dict[str, int] = {}
        self.keys: list = []
        at_key: dict = {}
        flat, owner = [], []
        for key, text in items:
            found = [self.codes.setdefault(w, len(self.codes) + 1) for w in WORD_RE.findall((text or "").lower())]
            if len(found) >= n:
                item = at_key.setdefault(key, len(at_key))
                if item == len(self.keys):
                    self.keys.append(key)
                flat += [*found, 0]
                owner += [item] * (len(found) + 1)
        self.flat, owner = np.array(flat, np.uint64), np.array(owner, np.int64)
        starts = np.flatnonzero(self._inside(self.flat)) if len(flat) >= n else np.zeros(0, np.int64)
        # A base under which different shingles have different hashes, so that a hash names one shingle.
        for self.base in range(BASE_2, BASE_2 + 2000, 2):
            hashes = run_hashes(self.flat, n, self.base)[starts]
            self.hashes, first, same = np.unique(hashes, return_index=True, return_inverse=True)
            self.place = starts[first]
            if all(np.array_equal(self.flat[starts + k], self.flat[self.place[same] + k]) for k in range(n)):
                break
        pairs = np.unique(np.stack([same, owner[starts]], 1), axis=0).reshape(-1, 2) if len(starts) else np.zeros((0, 2), np.int64)
        _, self.item_bounds, self.items = _lists(pairs[:, 0], pairs[:, 1])
        self.sizes = np.bincount(pairs[:, 1], minlength=len(self.keys))
        anchors = shingle_anchors(self.flat, n)[self.place[pairs[:, 0]]] if len(pairs) else np.zeros(0, np.uint64)
        by_item = np.argsort(pairs[:, 1], kind="stable")
        kept = [(sketch(a, containment), i) for i, a in enumerate(np.split(anchors[by_item], np.cumsum(self.sizes)[:-1])) if len(a)]
        names = np.concatenate([a for a, _ in kept]) if kept else np.zeros(0, np.uint64)
        whose = np.concatenate([np.full(len(a), i) for a, i in kept]) if kept else np.zeros(0, np.int64)
        order = np.argsort(names, kind="stable")
        self.anchors, self.anchor_bounds, self.anchor_items = _lists(names[order], whose[order])

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in vars(self).values() if isinstance(a, np.ndarray)) + 120 * len(self.codes)

    def _inside(self, codes: np.ndarray) -> np.ndarray:
        """Whether each run of ``n`` codes has no 0, that is, consists of words of items and lies in one text."""
        unknown = np.concatenate([[0], np.cumsum(codes == 0)])
        return unknown[self.n :] == unknown[: -self.n]

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position of the text, item, distinct shingles of the item in it, of every verified hit."""
        get, flat, starts, n = self.codes.get, [], [], self.n
        nothing = (np.zeros(0, np.int64),) * 3
        for t in texts:
            starts.append(len(flat))
            if t:
                flat += [get(w, 0) for w in WORD_RE.findall(t.lower())]
            flat.append(0)  # no shingle reaches over the end of a text
        codes = np.array(flat, np.uint64)
        if len(codes) < n or not len(self.anchors):
            return nothing
        at = np.flatnonzero(self._inside(codes))
        if not len(at):
            return nothing
        doc = np.searchsorted(np.array(starts), at, side="right") - 1
        # Candidates: documents whose anchors are in an item's sketch.
        anchors = shingle_anchors(codes, n)[at]
        near = np.minimum(np.searchsorted(self.anchors, anchors), len(self.anchors) - 1)
        hit = self.anchors[near] == anchors
        which, places = _expand(self.anchor_bounds, near[hit])
        if not len(which):
            return nothing
        many = len(self.keys)
        candidates = np.unique(doc[hit][which] * many + self.anchor_items[places])
        # Verified: distinct shingles of a candidate document, compared word by word with those of the items.
        told = np.isin(doc, np.unique(candidates // many))
        at, doc = at[told], doc[told]
        hashes = run_hashes(codes, n, self.base)[at]
        found = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[found] == hashes
        for k in range(n):
            same &= codes[at + k] == self.flat[self.place[found] + k]
        held = np.unique(np.stack([doc[same], found[same]], 1), axis=0).reshape(-1, 2)
        which, places = _expand(self.item_bounds, held[:, 1])
        pair, shared = np.unique(held[which, 0] * many + self.items[places], return_counts=True)
        good = np.isin(pair, candidates) & (shared >= np.maximum(1, self.containment * self.sizes[pair % many]))
        return pair[good] // many, pair[good] % many, shared[good]


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", doc_text: str = "text", item_text: str = "text", n: int = 10, containment: float = 0.0, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_key, item_key, shared``: documents that hold at least ``containment`` of an item's shingles, and one at least."""
    items = items.select(F.col(item_key).alias("item_key"), F.col(item_text).alias("item_text"))
    docs = docs.select(F.col(doc_key).alias("doc_key"), F.col(doc_text).alias("doc_text"))
    kinds = docs.schema["doc_key"].dataType.simpleString(), items.schema["item_key"].dataType.simpleString()
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    sketches = ItemSketches([(r.item_key, r.item_text) for r in items.collect()], n, containment) if size <= item_bytes else None
    if sketches is not None and sketches.nbytes <= SKETCH_BYTES:
        found = _by_broadcast(docs, sketches, kinds)
    else:
        found = _by_join(docs, items, kinds, n, containment)
    return found.groupBy("doc_key", "item_key").agg(F.max("shared").alias("shared")).select(F.col("doc_key").alias(doc_key), F.col("item_key").alias(item_key), F.col("shared").cast("long"))


def _by_broadcast(docs: DataFrame, sketches: ItemSketches, kinds: tuple[str, str]) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(sketches)
    item_kind = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = shipped.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                at, item, shared = sketches.search(part.column(1).to_pylist())
                if len(at):
                    names = pa.array([sketches.keys[i] for i in item.tolist()], type=item_kind)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), names, pa.array(shared, pa.int64())], names=["doc_key", "item_key", "shared"])

    return docs.mapInArrow(scan, f"doc_key {kinds[0]}, item_key {kinds[1]}, shared bigint")


def _coded(df: DataFrame, key: str, text: str, n: int, *more: str) -> DataFrame:
    w = df.select(key, words(F.col(text)).alias("w"), *more).where(F.size("w") >= n)
    return w.select(key, F.transform("w", lambda x: F.xxhash64(x)).alias("codes"), *more)


def _by_join(docs: DataFrame, items: DataFrame, kinds: tuple[str, str], n: int, containment: float) -> DataFrame:
    """The same search for test collections too large to broadcast: equi-joins on anchors, then on shingles' hashes."""

    def each(batches: Iterator[pa.RecordBatch], cut) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            whole = b.column(2).to_pylist() if b.num_columns > 2 else None
            for i, codes in enumerate(b.column(1)):
                made = cut(codes.values.to_numpy(zero_copy_only=False).view(np.uint64), whole and whole[i])
                rows.append(np.full(len(made), i))
                out.append(made)
            if out:
                found = np.concatenate(out)
                columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (found.T if found.ndim > 1 else [found])]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), *columns], names=["key", "h", "h2"][: 1 + len(columns)])

    pairs = lambda c: np.unique(np.stack([run_hashes(c, n, BASE_2), run_hashes(c, n, BASE_3)], 1), axis=0)
    shingles = lambda batches: each(batches, lambda c, _: pairs(c))
    anchors = lambda batches: each(batches, lambda c, _: np.unique(shingle_anchors(c, n)))

    def sketched(c: np.ndarray, alone: bool | None) -> np.ndarray:
        _, first = np.unique(np.stack([run_hashes(c, n, BASE_2), run_hashes(c, n, BASE_3)], 1), axis=0, return_index=True)
        # A key with several texts keeps every anchor: what its texts hold together is not known here.
        return sketch(shingle_anchors(c, n)[first], containment if alone else 0.0)

    texts = items.where(F.col("item_key").isNotNull()).distinct()
    texts = texts.join(texts.groupBy("item_key").agg((F.count("*") == 1).alias("alone")), "item_key")
    of_docs, of_items = _coded(docs, "doc_key", "doc_text", n), _coded(texts, "item_key", "item_text", n, "alone")
    doc_row, item_row = f"key {kinds[0]}, h bigint", f"key {kinds[1]}, h bigint"
    kept = of_items.mapInArrow(lambda b: each(b, sketched), item_row).distinct().withColumnRenamed("key", "item_key")
    near = of_docs.mapInArrow(anchors, doc_row).withColumnRenamed("key", "doc_key")
    candidates = materialise(near.join(kept, "h").select("doc_key", "item_key").distinct(), "leak-candidates")
    held = materialise(of_items.select("item_key", "codes").mapInArrow(shingles, item_row + ", h2 bigint").distinct().withColumnRenamed("key", "item_key"), "leak-items")
    told = of_docs.join(candidates.select("doc_key").distinct(), "doc_key", "left_semi").mapInArrow(shingles, doc_row + ", h2 bigint").distinct().withColumnRenamed("key", "doc_key")
    both = told.join(held, ["h", "h2"]).join(candidates, ["doc_key", "item_key"], "left_semi").groupBy("doc_key", "item_key").agg(F.count("*").alias("shared"))
    sizes = held.groupBy("item_key").agg(F.count("*").alias("size"))
    return both.join(sizes, "item_key").where(F.col("shared") >= F.greatest(F.lit(1), F.lit(containment) * F.col("size"))).select("doc_key", "item_key", "shared")
