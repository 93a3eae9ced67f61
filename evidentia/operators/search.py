"""Lexical and vector retrieval and their fusion, for a batch of queries at a time.

Queries are a small DataFrame ``query_id, query, qvec``. The index side is never collected: both
arms send the queries, of checked number, to the scan of the index, score whole Arrow batches there
and keep the best k of each task, so that what is shuffled depends on k and not on the index.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.vectors import dot
from evidentia.scratch import materialise

#: Constant of reciprocal rank fusion, and the two of BM25.
RRF_K, K1, B = 60, 1.2, 0.75

#: Most queries that are sent to the scans at a time, cells scored at once.
QUERY_BATCH, SCORE_CELLS = 10_000, 4 << 20

#: Classes of cosines that quantiles are counted in, and steps of six decimals told apart on either side of 0.
CLASSES, STEPS = 2048, 1_010_000

#: A term is scored as a column of a matrix if more than this share of all (query, text) have it on both sides.
COMMON = 0.002

#: Queries whose counts travel together.
PACK = 64

TERM = r"[\p{L}\p{N}_]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``term, key, tf, len``."""
    t = docs.select(key, terms(F.col(text)).alias("t")).where(F.size("t") > 0)
    rows = t.select(key, F.size("t").alias("len"), F.explode("t").alias("term"))
    return rows.groupBy("term", key, "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int = 50) -> DataFrame:
    """``query_id, key, bm25, bm25_rank``: the ``k`` best texts of each query.

    Up to ``QUERY_BATCH`` queries are sent to the scan at a time, as lists of the queries of each term: whole
    Arrow batches of texts are scored with them, and each task passes on its best ``k`` per query. More
    queries are asked block by block. Texts without a term of a query are no hits.
    """
    asked = queries.select("query_id", F.array_distinct(terms(F.col("query"))).alias("t")).where(F.size("t") > 0)
    best = W.partitionBy("query_id").orderBy(F.desc("bm25"), key)
    found = []
    for some in _blocks(asked, "t"):
        top = _lexical(docs, queries, some, key, text, k).withColumn("bm25_rank", F.row_number().over(best)).where(F.col("bm25_rank") <= k)
        found.append(top if len(some) < QUERY_BATCH and not found else materialise(top, "lexical"))
    return reduce(DataFrame.unionByName, found)


def _lexical(docs: DataFrame, queries: DataFrame, some: pd.DataFrame, key: str, text: str, k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in some.t for t in ts}))}
    scan = docs.where(F.col(text).isNotNull()).select(key, terms(F.col(text)).alias("t"))
    # One pass counts the texts with each term of the queries and, under the empty term, all texts and their lengths.
    words = docs.sparkSession.createDataFrame([("", -1), *vocabulary.items()], "term string, i int")
    each = scan.select(F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("t"))).alias("term"))
    rows_of = {r.i: r for r in each.join(F.broadcast(words), "term").groupBy("i").agg(F.count("*").alias("df"), F.sum("len").alias("len")).collect()}  # one row per term of the queries
    n = rows_of[-1].df if -1 in rows_of else 0
    mean = rows_of[-1].len / n if n and rows_of[-1].len else 1.0
    df = [rows_of[i].df if i in rows_of else 0 for i in range(len(vocabulary))]
    idf = np.array([max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) if d else 0.0 for d in df])
    # The queries of each term, end to end; of terms that many texts and queries have, as a matrix.
    term = np.array([vocabulary[t] for ts in some.t for t in ts], np.int64)
    asks = np.repeat(np.arange(len(some)), [len(ts) for ts in some.t]) if len(some) else term
    in_queries = np.bincount(term, minlength=len(vocabulary))
    common = np.flatnonzero(np.array(df, float) * in_queries > COMMON * n * len(some))
    column = np.full(len(vocabulary), -1)
    column[common] = np.arange(len(common))
    often = column[term] >= 0
    has = np.zeros((len(some), len(common)), np.float32)
    has[asks[often], column[term[often]]] = 1
    term, asks = term[~often], asks[~often]
    asks = asks[np.argsort(term, kind="stable")].astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
    names = some.query_id.to_numpy()
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}, bm25 double"
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, idf, column, has, asks, bounds, names))
    step = max(16, SCORE_CELLS // max(1, len(some)))

    def score(batches):
        vocabulary, idf, column, has, asks, bounds, names = shipped.value
        found = _Best(len(names), k, 0.0)
        for whole in batches:
            for lo in range(0, len(whole) if len(names) else 0, step):
                b = whole.iloc[lo : lo + step]
                # The texts' terms that occur in queries, with their weights, then all queries of each.
                at = [[vocabulary[t] for t in ts if t in vocabulary] for ts in b.t]
                length = np.array([len(ts) for ts in b.t], float)
                doc = np.repeat(np.arange(len(b)), np.array([len(x) for x in at], np.int64))
                cell, tf = np.unique(doc * len(vocabulary) + np.fromiter((i for x in at for i in x), np.int64, len(doc)), return_counts=True)
                doc, i = cell // len(vocabulary), cell % len(vocabulary)
                value = idf[i] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
                often = column[i] >= 0
                weight = np.zeros((has.shape[1], len(b)))
                weight[column[i[often]], doc[often]] = value[often]
                rare = np.zeros((len(names), len(b)))
                flat = rare.reshape(-1)
                # The queries of rarer terms, some terms at a time.
                doc, i, value = doc[~often], i[~often], value[~often]
                many = bounds[i + 1] - bounds[i]
                past = np.cumsum(many)
                at = 0
                while at < len(i):
                    end = max(at + 1, int(np.searchsorted(past, (past[at - 1] if at else 0) + SCORE_CELLS, side="right")))
                    m = many[at:end]
                    which = np.arange(int(m.sum())) + np.repeat(bounds[i[at:end]] - (np.cumsum(m) - m), m)
                    np.add.at(flat, asks[which].astype(np.int64) * len(b) + np.repeat(doc[at:end], m), np.repeat(value[at:end], m))
                    at = end
                # Single precision tells what can't be among the best; the rest is scored in double precision.
                scores = has @ weight.astype(np.float32) + rare
                exact = lambda q, j, rare=rare, weight=weight.T: rare[q, j] + np.einsum("ij,ij->i", has[q], weight[j])
                found.add(scores, b[key].to_numpy(), exact, (has.shape[1] + 8) * 6e-8 * float(scores.max(initial=0.0)))
        yield from found.rows(names, key, "bm25")

    return _few(scan).mapInPandas(score, kinds)


class _Best:
    """The ``k`` greatest scores above a bound of each query so far; ties go to smaller keys."""

    def __init__(self, queries: int, k: int, above: float = -np.inf):
        self.k, self.above, self.queries = k, above, queries
        #: A score below its query's floor can't be among the k greatest.
        self.floor = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, keys: np.ndarray, exact: Callable, slack: float, first: int = 0) -> None:
        """``scores``: (query, key), of the queries from ``first`` on, each at most ``slack`` from the one that
        ``exact(query numbers from first on, key numbers)`` gives; that one is rounded to six decimals and counts."""
        low = self.floor[first : first + len(scores), None]
        if scores.shape[1] > self.k and np.isneginf(low).any():
            low = np.maximum(low, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k] - slack - 1e-6)
        at, who = np.nonzero(scores >= np.maximum(low, self.above) - slack - 1e-6)
        value = np.concatenate([exact(at[lo : lo + 4096], who[lo : lo + 4096]) for lo in range(0, len(at), 4096)] or [np.zeros(0)]).round(6)
        good = (value >= low[at, 0]) & (value > self.above)
        self.parts.append((at[good] + first, value[good], keys[who[good]]))
        self.waiting += int(good.sum())
        if self.waiting > max(1 << 16, self.queries * self.k):
            self._settle()

    def _settle(self) -> None:
        q, s, keys = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        order = order[np.lexsort((-s[order], q[order]))]
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q = order[place < self.k], q[place < self.k]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.floor[q[last]] = s[order[last]]
        self.parts, self.waiting = [(q, s[order], keys[order])], 0

    def rows(self, queries: np.ndarray, key: str, name: str) -> Iterator[pd.DataFrame]:
        if self.parts:
            self._settle()
            q, s, keys = self.parts[0]
            yield pd.DataFrame({"query_id": queries[q], key: keys, name: s + 0.0})


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` in two partitions per core at most: each passes on its best, so what is shuffled does not grow with the files."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


def cosine(vectors: DataFrame, queries: DataFrame, key: str, vec: str) -> DataFrame:
    """``query_id, key, cosine`` of every (query, vector) of equal length; unit vectors assumed.

    Up to ``QUERY_BATCH`` queries are sent to the vectors; more are joined with them by length.
    """
    asked = queries.select("query_id", "qvec")
    q = F.broadcast(asked) if asked.limit(QUERY_BATCH + 1).count() <= QUERY_BATCH else asked
    near = F.round(dot(F.col(vec), F.col("qvec")), 6)
    return vectors.where(F.col(vec).isNotNull()).select(key, vec).join(q, F.size(vec) == F.size("qvec")).select("query_id", key, near.alias("cosine"))


def cosine_quantiles(vectors: DataFrame, queries: DataFrame, vec: str, shares: Sequence[float]) -> DataFrame:
    """``query_id, q, top``: quantiles (between two values, in proportion) and maximum of each query's cosines to six decimals.

    Exact in two scans. The first counts each query's cosines in ``CLASSES`` classes that a sample's cosines fill about
    equally; the second lists only those in the classes that hold a wanted place.
    """
    parts = [_quantiles(vectors, queries, asked, vec, shares) for asked in _blocks(queries)]
    return reduce(DataFrame.unionByName, parts)


def _steps(scores: np.ndarray) -> np.ndarray:
    scores *= 1e6
    return np.rint(scores, out=scores).astype(np.int64)


def _quantiles(vectors: DataFrame, queries: DataFrame, asked: pd.DataFrame, vec: str, shares: Sequence[float]) -> DataFrame:
    spark, names = vectors.sparkSession, asked.query_id.to_numpy()
    few = vectors.where(F.col(vec).isNotNull()).select(vec).limit(256).toPandas()[vec]
    few = [v for v in few if len(asked) and len(v) == len(asked.qvec[0])]
    some = np.stack(asked.qvec[:: max(1, len(asked) // 1000)].to_numpy()).astype(np.float64) if few else np.zeros((0, 0))
    near = _steps(some @ np.stack(few).astype(np.float64).T).ravel() if few else np.zeros(0, np.int64)
    edges = np.unique(np.quantile(near, np.linspace(0, 1, CLASSES)).astype(np.int64)) if len(near) else np.zeros(1, np.int64)
    # Class of each step; what lies beyond the table's ends counts as there.
    class_of = np.searchsorted(edges, np.arange(-STEPS, STEPS + 1), side="right").astype(np.int32)
    classes = len(edges) + 1
    shipped = spark.sparkContext.broadcast(class_of)

    def classed(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = _steps(q @ x.T)
        return steps, shipped.value[np.clip(steps, -STEPS, STEPS) + STEPS]

    def count(pairs: Iterator, names: np.ndarray) -> Iterator[pd.DataFrame]:
        n, top = np.zeros((len(names), classes), np.int32), np.full(len(names), -(1 << 62))
        for q, x, _, lo in pairs:
            steps, at = classed(q, x)
            m = len(q)
            n[lo : lo + m] += np.bincount((at + (np.arange(m) * classes)[:, None]).ravel(), minlength=m * classes).reshape(m, classes)
            top[lo : lo + m] = np.maximum(top[lo : lo + m], steps.max(1))
        for lo in range(0, len(names), PACK):
            yield pd.DataFrame({"pack": [lo], "n": [zlib.compress(n[lo : lo + PACK].tobytes(), 1)], "top": [top[lo : lo + PACK].tobytes()]})

    def places(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per query of a pack the classes that hold a wanted place, the cosines before each and in all, and the greatest."""
        lo, out = int(pdf.pack.iloc[0]), []
        n = sum(np.frombuffer(zlib.decompress(x), np.int32).reshape(-1, classes).astype(np.int64) for x in pdf.n)
        top = np.max([np.frombuffer(x, np.int64) for x in pdf.top], axis=0)
        for i, row in enumerate(n):
            past, every = np.cumsum(row), int(row.sum())
            at = [f(p * (every - 1)) for p in shares for f in (math.floor, math.ceil)] if every else []
            for c in sorted({int(c) for c in np.searchsorted(past, at, side="right")}):
                out.append((lo + i, c, int(past[c] - row[c]), every, int(top[i])))
        return pd.DataFrame(out, columns=["i", "class", "before", "every", "top"])

    counted = _scanned(vectors, queries, asked, None, vec, count, "pack long, n binary, top binary", named=False)
    chosen = materialise(counted.groupBy("pack").applyInPandas(places, "i long, class long, before long, every long, top long"), "chosen")
    mine = chosen.select("i", "class").toPandas()
    mask = np.zeros((len(names), classes), bool)
    mask[mine["i"].to_numpy(np.int64), mine["class"].to_numpy(np.int64)] = True
    sought = spark.sparkContext.broadcast(np.packbits(mask))

    def list_those(pairs: Iterator, names: np.ndarray) -> Iterator[pd.DataFrame]:
        mask = np.unpackbits(sought.value, count=len(names) * classes).astype(bool).reshape(-1, classes)
        for asked, x, _, lo in pairs:
            steps, at = classed(asked, x)
            q, v = np.nonzero(np.take_along_axis(mask[lo : lo + len(asked)], at, 1))
            found, first, n = np.unique((q << 32) + steps[q, v] + (1 << 31), return_index=True, return_counts=True)
            q, v = q[first], v[first]
            yield pd.DataFrame({"query_id": names[lo + q], "i": lo + q, "class": at[q, v], "step": steps[q, v], "n": n})

    listed = _scanned(vectors, queries, asked, None, vec, list_those, "i long, class long, step long, n long").groupBy("query_id", "i", "class", "step").agg(F.sum("n").alias("n"))
    up = W.partitionBy("i", "class").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = listed.join(chosen, ["i", "class"]).withColumn("past", F.col("before") + F.sum("n").over(up))
    ends = []
    for p in shares:
        at = F.lit(float(p)) * (F.col("every") - 1)
        holds = [(F.col("past") - F.col("n") <= f(at)) & (f(at) < F.col("past")) for f in (F.floor, F.ceil)]
        ends.append([*(F.max(F.when(h, F.col("step"))) / 1e6 for h in holds), F.max(at - F.floor(at))])
    between = F.array(*(F.when(low == high, low).otherwise((1 - part) * low + part * high) for low, high, part in ends))
    return placed.groupBy("query_id", "i").agg(between.alias("q"), (F.max("top") / 1e6).alias("top")).drop("i")


def _blocks(queries: DataFrame, column: str = "qvec") -> Iterator[pd.DataFrame]:
    """The queries that have a ``column``, at most ``QUERY_BATCH`` at a time; one empty block if there are none."""
    every = queries.select("query_id", column).where(F.col(column).isNotNull())
    asked = every.limit(QUERY_BATCH + 1).toPandas()
    if len(asked) <= QUERY_BATCH:
        yield asked
        return
    rest = every.toLocalIterator()
    while block := list(islice(rest, QUERY_BATCH)):
        yield pd.DataFrame(block, columns=["query_id", column])


def cosine_topk(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int = 50) -> DataFrame:
    """``query_id, key, cosine, vec_rank``. At most ``QUERY_BATCH`` queries are sent to the scan, where one matrix
    product per Arrow batch scores them; each task passes on its best ``k`` per query, ties going to smaller keys, and
    the merge ranks them. More queries than that are asked block by block, each block's
    hits being written before the next is read, so that the driver holds one block. Query ids are distinct.
    """
    best = W.partitionBy("query_id").orderBy(F.desc("cosine"), key)
    found = []
    for asked in _blocks(queries):
        top = _nearest(vectors, queries, asked, key, vec, k)
        top = top.withColumn("vec_rank", F.row_number().over(best)).where(F.col("vec_rank") <= k)
        # Of several blocks each is settled before the next is read.
        found.append(top if len(asked) < QUERY_BATCH and not found else materialise(top, "nearest"))
    return reduce(DataFrame.unionByName, found)


def _nearest(vectors: DataFrame, queries: DataFrame, asked: pd.DataFrame, key: str, vec: str, k: int) -> DataFrame:
    def use(pairs: Iterator, names: np.ndarray) -> Iterator[pd.DataFrame]:
        found = _Best(len(names), k)
        for q, x, ids, first in pairs:
            # Single precision tells what can't be among the best; the rest is scored in double precision.
            size = float(np.sqrt((q * q).sum(1).max() * (x * x).sum(1).max()))
            fast = size < 1e30
            near = q.astype(np.float32) @ x.T.astype(np.float32) if fast else q @ x.T
            found.add(near, ids, lambda i, j, q=q, x=x: np.einsum("ij,ij->i", q[i], x[j]), (q.shape[1] + 8) * 6e-8 * size if fast else 0.0, first)
        yield from found.rows(names, key, "cosine")

    return _scanned(vectors, queries, asked, key, vec, use, f"{key} {vectors.schema[key].dataType.simpleString()}, cosine double")


def _scanned(vectors: DataFrame, queries: DataFrame, asked: pd.DataFrame, key: str | None, vec: str, use: Callable, more: str, named: bool = True) -> DataFrame:
    """``query_id`` and ``more`` columns: ``use((query vectors, vectors, keys, number of the first query), query ids)`` of each task, by Arrow batch and some queries at a time."""
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(key) if key else F.lit(0).alias("_key"), vec)
    names = asked.query_id.to_numpy()
    q = np.stack(asked.qvec.to_numpy()).astype(np.float64) if len(asked) else np.zeros((0, 0))
    shipped = vectors.sparkSession.sparkContext.broadcast((names, q))

    def pairs(batches: Iterator[pd.DataFrame], q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        for b in batches:
            b = b[b[vec].map(len) == q.shape[1]]
            if not len(b):
                continue
            x, ids = np.stack(b[vec].to_numpy()).astype(np.float64), b.iloc[:, 0].to_numpy()
            step = max(16, SCORE_CELLS // len(b))
            for lo in range(0, len(q), step):
                yield q[lo : lo + step], x, ids, lo

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shipped.value
        yield from use(pairs(batches, q), names)

    return _few(rows).mapInPandas(scan, f"query_id {queries.schema['query_id'].dataType.simpleString()}, {more}" if named else more)


def rrf(lexical: DataFrame, vector: DataFrame, key: str, k: int = 50) -> DataFrame:
    """``query_id, key, score, bm25_rank, vec_rank, rank``: sum of 1 / (60 + rank) over the arms."""
    both = lexical.select("query_id", key, "bm25_rank").join(vector.select("query_id", key, "vec_rank"), ["query_id", key], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + RRF_K), F.lit(0.0))
    scored = both.withColumn("score", F.round(part("bm25_rank") + part("vec_rank"), 6))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def minmax_fuse(hits: DataFrame) -> DataFrame:
    """Half of each arm's rank scaled to 0..1; the last rank and an absent one both count 0."""
    per_query = W.partitionBy("query_id")

    def arm(c: str) -> Column:
        n = F.max(c).over(per_query)
        return F.when(F.col(c).isNull(), 0.0).when(n <= 1, 1.0).otherwise((n - F.col(c)) / (n - 1))

    return hits.withColumn("fused", F.round(0.5 * arm("bm25_rank") + 0.5 * arm("vec_rank"), 6))


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, key: str, text: str, vec: str, k: int = 50) -> DataFrame:
    return rrf(bm25(docs, queries, key, text, k), cosine_topk(vectors, queries, key, vec, k), key, k)


def dial(vectors: DataFrame, qvec: list[float], key: str, vec: str) -> DataFrame:
    """``key, cosine, angle``: the true similarity, and a direction in the plane of most residual variance.

    The plane comes from the d x d covariance of the residuals, summed in one pass over the scan
    (its size depends on the dimension only) and decomposed on the driver; the largest coordinate
    of each axis is made positive.
    """
    q = np.asarray(qvec, float)
    d = len(q)
    rows = vectors.where(F.size(vec) == d).select(key, vec)

    def sums(batches):
        total, outer, n = np.zeros(d), np.zeros((d, d)), 0
        for b in batches:
            if len(b):
                x = np.stack(b[vec].to_numpy()).astype(float)
                x -= np.outer(x @ q, q)
                total, outer, n = total + x.sum(0), outer + x.T @ x, n + len(x)
        yield pd.DataFrame({"n": [n], "s": [total.tolist()], "o": [outer.ravel().tolist()]})

    parts = rows.mapInPandas(sums, "n long, s array<double>, o array<double>")
    # One addition per matrix entry, merged in the cluster: d * (d + 1) numbers reach the driver.
    flat = parts.select("n", F.posexplode(F.concat("s", "o")).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas().sort_values("at")
    if flat.empty or not flat.n.iloc[0]:
        return rows.select(key, F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("double").alias("angle"))
    n, v = int(flat.n.iloc[0]), flat.v.to_numpy()
    mean = v[:d] / n
    _, axes = np.linalg.eigh(v[d:].reshape(d, d) / n - np.outer(mean, mean))
    plane = axes[:, ::-1][:, :2].T
    plane *= np.where(np.take_along_axis(plane, np.abs(plane).argmax(1)[:, None], 1) < 0, -1, 1)

    def place(batches):
        for b in batches:
            x = np.stack(b[vec].to_numpy()).astype(float) if len(b) else np.zeros((0, d))
            c = x @ q
            at = (x - np.outer(c, q) - mean) @ plane.T
            yield pd.DataFrame({key: b[key], "cosine": c.round(4), "angle": np.arctan2(at[:, 1], at[:, 0]).round(4)})

    return rows.mapInPandas(place, f"{key} {rows.schema[key].dataType.simpleString()}, cosine double, angle double")
