"""Most similar vectors for every vector: inverted lists, product-quantised residuals, exact reranking.

Fit, on a sample of at most ``FIT_ROWS`` rows: coarse centroids, and for the residuals ``PARTS``
codebooks of ``CODES`` entries. There is one centroid per ``LIST_ROWS`` rows up to ``MAX_LISTS``,
beyond that one per ``4 * LIST_ROWS`` rows up to one per eight rows of the sample, and then one per
``BLOCK_ROWS / 2`` rows up to one per four. Neighbouring
lists are put together into blocks of about ``BLOCK_ROWS`` rows by bisection of the centroids; a
list larger than a block is spread over several. What is broadcast is bounded by these constants.

Index: every row goes to its own list's block, once, with its code. A list of more than twice
``LIST_ROWS`` rows is cut there into sublists by k-means over its own rows, so that what a query
scans does not grow with the table. Search: every row is also a query for the lists whose centroids
are nearly as near as the nearest one (``MARGIN``: by how much rows of one group differ in that), at least
``SURE`` and at most ``PROBES``; those in its own block cost no transfer, and a copy of the vector, in half precision where
that loses nothing, travels to the nearest ``FAR`` blocks that hold such a list. A block to which many queries will travel, by the
sample, is written several times, and each of its copies takes a share of them. In a block, a query
scans the ``SCAN`` nearest sublists of the lists it probes and all that are nearly as near as the nearest: asymmetric distance tables (query parts
against codebooks) score the codes, the best ``RERANK`` (ties by smaller key) are scored again with
the exact cosine, and the best k of all blocks are kept.

The work per row is flat up to ``FIT_ROWS / 4`` lists of a block each (about 130 million rows);
beyond that lists are spread over blocks, and a query visits them all.

A vector that stands more than k + 1 times (by 128 bits of its hash) is searched once: the further
copies take the neighbours of the first one, so a vector that a third of all rows share makes no
large list.

Results: rows whose vector is null, of another length, all zero, or holds a null or non-finite
value, have no neighbours and are nobody's. Similarity is the cosine rounded to 9 decimals, ties
go to the smaller key. With fewer than k other vectors a row has fewer neighbours. An empty table
gives an empty result; other columns are not looked at. Keys must be unique ``bigint``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.words import mix
from evidentia.scratch import materialise, release

#: Rows the index is fitted on, at most; every row is indexed. ``FIRST_ROWS`` of them suffice up to 1250 lists.
FIT_ROWS, FIRST_ROWS = 65_536, 20_000
#: Rows per list aimed at, lists of that size at most; sublists a query scans in a block, at least.
LIST_ROWS, MAX_LISTS, SCAN = 200, 2048, 8
#: Rows per block, and visiting queries per copy of a block.
BLOCK_ROWS, VISITS = 8192, 32_768
#: Most lists searched per query, nearest lists searched in any case, and if in the query's blocks; most blocks a query is sent to.
PROBES, SURE, NEAREST, FAR = 32, 2, 4, 6
#: A list or sublist is nearly as near as the nearest if it is less near by this at most, over the root of the dimension.
MARGIN = 1.0
#: Parts a residual is cut into, entries of each part's codebook.
PARTS, CODES = 96, 64
#: Candidates scored exactly per query and block.
RERANK = 128


def _wanted_lists(rows: int) -> int:
    return min(rows // LIST_ROWS, max(MAX_LISTS, min(rows // (4 * LIST_ROWS), FIT_ROWS // 8), 2 * rows // BLOCK_ROWS))


def _sample_rows(rows: int) -> int:
    return min(FIT_ROWS, max(FIRST_ROWS, 16 * _wanted_lists(rows)))


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    """Lloyd's k-means; with ``unit`` on the sphere."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        half = 0 if unit else 0.5 * (c * c).sum(1)
        near = np.concatenate([(x[lo : lo + 1024] @ c.T - half).argmax(1) for lo in range(0, len(x), 1024)])
        order = np.argsort(near, kind="stable")
        at, first = np.unique(near[order], return_index=True)
        new = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
        c[at] = new
        lost = np.setdiff1d(np.arange(k), at)
        c[lost] = x[rng.choice(len(x), len(lost))]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _blocks(c: np.ndarray, weight: np.ndarray, most: float, rng: np.random.Generator) -> np.ndarray:
    """Block of each centroid: bisect along the main direction until a block weighs at most ``most``."""
    out, made, todo = np.zeros(len(c), np.int64), 0, [np.arange(len(c))]
    while todo:
        idx = todo.pop()
        if len(idx) == 1 or weight[idx].sum() <= most:
            out[idx] = made
            made += 1
            continue
        w = weight[idx] + 1e-9
        x = c[idx] - np.average(c[idx], axis=0, weights=w)
        d = rng.standard_normal(c.shape[1])
        for _ in range(8):
            d = x.T @ ((x @ d) * w)
            d /= np.linalg.norm(d) + 1e-30
        order = np.argsort(x @ d, kind="stable")
        mass = np.cumsum(w[order])
        cut = int(np.clip(np.searchsorted(mass, mass[-1] / 2), 1, len(idx) - 1))
        todo += [idx[order[:cut]], idx[order[cut:]]]
    return out


class VectorIndex:
    """Centroids, blocks and codebooks; small and of bounded size."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        unit = (sample / np.linalg.norm(sample.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)
        lists = int(np.clip(_wanted_lists(rows), 1, len(unit) if rows <= MAX_LISTS * LIST_ROWS else max(1, len(unit) // 4)))
        self.centroids = _means(unit, lists, 8 if lists <= MAX_LISTS else 4, rng, True)
        self.margin = MARGIN / np.sqrt(unit.shape[1])
        near, close = (np.concatenate(z) for z in zip(*(self.probes(unit[lo : lo + 512]) for lo in range(0, len(unit), 512)), strict=True))
        home = near[:, 0]
        weight = np.bincount(home, minlength=lists) * (rows / len(unit))
        self.block = _blocks(self.centroids, weight, BLOCK_ROWS, rng)
        self.spread = np.maximum(1, np.ceil(weight / BLOCK_ROWS)).astype(np.int64)
        # A list spread over several blocks is alone in its block; the further ones get new numbers.
        self.extra = int(self.block.max()) + 1 + np.concatenate([[0], np.cumsum(self.spread - 1)[:-1]])
        blocks = int(self.block.max()) + 1 + int((self.spread - 1).sum())
        # Queries that will visit each block, by the sample; a block of many is written in several copies.
        visits = np.zeros(blocks)
        for probed, n in zip(near, close, strict=True):
            for b in [*dict.fromkeys(self.block[probed[:n]].tolist())][1:FAR]:
                visits[b] += rows / len(unit)
        self.copies = np.maximum(1, np.ceil(visits / VISITS)).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.copies)[:-1]])
        #: Copies of blocks in all; each is one task of the search.
        self.blocks = int(self.copies.sum())
        self.step = -(-unit.shape[1] // PARTS)
        # Residuals of so many rows suffice for the codebooks.
        rest = self._parts(unit[:FIRST_ROWS] - self.centroids[home[:FIRST_ROWS]])
        codes = min(CODES, rest.shape[1])
        self.books = np.stack([_means(np.ascontiguousarray(p), codes, 5, rng, False) for p in rest])

    def _parts(self, x: np.ndarray) -> np.ndarray:
        """(part, row, value); the last part is filled up with zeros."""
        x = np.pad(x, ((0, 0), (0, self.step * PARTS - x.shape[1])))
        return np.ascontiguousarray(x.reshape(len(x), PARTS, self.step).transpose(1, 0, 2))

    def probes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest lists of each row, nearest first, and how many of them are nearly as near as the first or searched in any case."""
        sims = unit @ self.centroids.T
        k = min(PROBES, sims.shape[1])
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(sims, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(top, order, 1), np.maximum((sims >= sims.max(1, keepdims=True) - self.margin).sum(1), min(SURE, k))

    def encode(self, unit: np.ndarray, home: np.ndarray) -> np.ndarray:
        rest = self._parts(unit - self.centroids[home])
        return np.stack([(p @ b.T - 0.5 * (b * b).sum(1)).argmax(1) for p, b in zip(rest, self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables (part, code, query): the share of the cosine that each code adds."""
        return self.books @ self._parts(unit).transpose(0, 2, 1)

    def places(self, lists: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Block of each row whose own list is given; ``salt`` spreads the rows of large lists."""
        which = salt % self.spread[lists]
        return np.where(which == 0, self.block[lists], self.extra[lists] + which - 1)

    def all_places(self, one: int) -> list[int]:
        return [int(self.block[one]), *range(int(self.extra[one]), int(self.extra[one] + self.spread[one] - 1))]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    start, end = column.offsets[0].as_py(), column.offsets[-1].as_py()
    return column.values.slice(start, end - start).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32, copy=False)


def _proper(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with finite, non-zero vectors, and the vectors."""
    x = _vectors(column, dim)  # nulls arrive as NaN
    good = np.isfinite(x).all(1) & x.any(1)
    return np.flatnonzero(good), x[good]


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector in half precision if that is the same vector, else in single."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    same = (half == x).all(1)
    return [h.tobytes() if s else v.tobytes() for h, v, s in zip(half, x, same, strict=True)]


def _unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    half = np.array([len(v) == 2 * dim for v in raw], bool)
    x = np.empty((len(raw), dim), np.float32)
    for kind, which in ((np.float16, half), (np.float32, ~half)):
        x[which] = np.frombuffer(b"".join([raw[i] for i in np.flatnonzero(which)]), kind).reshape(-1, dim)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(df: DataFrame, key: str = "row_id", vec: str = "vec", dim: int = 384, k: int = 5) -> DataFrame:
    """``key, other, similarity, rank``: the k most similar rows of every row."""
    spark = df.sparkSession
    sc = spark.sparkContext
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec")).where((F.size("vec") == dim) & F.col("id").isNotNull())
    schema = f"`{key}` bigint, other bigint, similarity double, rank int"

    total = df.count()
    share = min(1.0, _sample_rows(total) / max(1, total))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vec").limit(FIT_ROWS).toArrow()
    sample = _proper(chosen["vec"].combine_chunks(), dim)[1] if chosen.num_rows else np.empty((0, dim), np.float32)
    if not len(sample):
        # None of the sampled rows is proper; take any proper ones.
        few = rows.where(F.exists("vec", lambda v: v != 0)).select("vec").limit(FIT_ROWS).toArrow()
        sample = _proper(few["vec"].combine_chunks(), dim)[1] if few.num_rows else sample
    if not len(sample):
        return spark.createDataFrame([], schema)
    index = VectorIndex(sample, total)
    shipped = sc.broadcast(index)

    # Vectors that stand more than k + 1 times: only the k + 1 smallest keys take part in the search.
    marks = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]
    crowds = rows.select(*marks).groupBy("h1", "h2").count().where(F.col("count") > k + 1).select("h1", "h2")
    crowds = materialise(crowds, "vector-crowds")
    crowded = crowds.limit(1).count() > 0
    if crowded:
        in_order = W.partitionBy("h1", "h2").orderBy("id")
        first = rows.select("id", *marks).join(crowds, ["h1", "h2"], "left_semi").withColumn("rn", F.row_number().over(in_order)).where(F.col("rn") <= k + 1)
        first = materialise(first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vector-firsts")
        # Broadcast while small (a row is under 100 bytes); beyond that the join is shuffled.
        side = F.broadcast(first) if first.count() <= 200_000 else first
        marked = rows.select("*", *marks).join(side, ["h1", "h2"], "left")
        further = marked.where(~F.array_contains("ids", F.col("id"))).select("id", F.col("ids")[0].alias("rep"))
        rows = marked.where(F.col("ids").isNull() | F.array_contains("ids", F.col("id"))).select("id", "vec")
    else:
        release(crowds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                good, x = _proper(part.column(1), dim)
                if not len(good):
                    continue
                ids = part.column(0).to_numpy()[good]
                unit = _unit(x)
                lists, close = index.probes(unit)
                home = lists[:, 0]
                salt = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(33)).astype(np.int64)
                at = index.places(home, salt)
                codes = index.encode(unit, home)
                out: list[tuple] = []
                for i in range(len(ids)):
                    wanted: dict[int, list[int]] = {int(at[i]): []}
                    met: set[int] = set()  # blocks of the lists so far; the parts of a spread one count once
                    for n, one in enumerate(lists[i, : max(NEAREST, close[i])].tolist()):
                        if n < close[i] and len(met) < FAR:
                            met.add(int(index.block[one]))
                        for b in index.all_places(one) if index.spread[one] > 1 else (int(index.block[one]),):
                            if b in wanted or int(index.block[one]) in met:
                                wanted.setdefault(b, []).append(one)
                    code = codes[i].tobytes()
                    for b, probed in wanted.items():
                        mine = int(salt[i] % index.copies[b])
                        if b == at[i]:
                            # A row stands in every copy of its block and asks in one.
                            for c in range(index.copies[b]):
                                out.append((int(index.base[b]) + c, ids[i], int(home[i]), probed if c == mine else [], i, code))
                        else:
                            out.append((int(index.base[b]) + mine, ids[i], -1, probed, i, None))
                block, key_, own_list, probed, src, code = zip(*out, strict=True)
                packed = _packed(x)
                vecs = pa.array([packed[i] for i in src], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(key_, pa.int64()), pa.array(own_list, pa.int32()), pa.array(probed, pa.list_(pa.int32())), vecs, pa.array(code, pa.binary())], names=["block", "id", "list", "probes", "vec", "code"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One block per partition, of bounded size.
        came = list(batches)
        if came:
            whole = pa.Table.from_batches(came)
            for b in pc.unique(whole["block"]):
                yield from _search_block(shipped.value, whole.filter(pc.equal(whole["block"], b)).combine_chunks(), dim, k).to_batches(65536)

    placed = rows.mapInArrow(place, "block bigint, id bigint, list int, probes array<int>, vec binary, code binary")
    found = placed.repartitionById(index.blocks, F.col("block").cast("int")).mapInArrow(search, "id bigint, other bigint, similarity double")
    best = W.partitionBy("id").orderBy(F.desc("similarity"), "other")
    if crowded:
        found = materialise(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "vector-found")
        reps = further.select("rep").distinct()
        theirs = found.join(F.broadcast(reps) if first.count() <= 200_000 else reps, found.id == F.col("rep"), "left_semi")
        theirs = theirs.unionByName(reps.select(F.col("rep").alias("id"), F.col("rep").alias("other"), F.lit(1.0).alias("similarity")))
        few = theirs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy(F.col("id").alias("rep")).agg(F.collect_list(F.struct("other", "similarity")).alias("near"))
        side = F.broadcast(few) if first.count() <= 200_000 else few
        inherited = further.join(side, "rep").select("id", F.inline("near"))
        found = found.unionByName(inherited)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(key), "other", "similarity", "rank")


def _sublists(unit: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` cut into sublists of about ``LIST_ROWS`` by k-means on the vectors, order kept."""
    if len(rows) <= 2 * LIST_ROWS:
        return [rows]
    rng, k = np.random.default_rng(len(rows)), -(-len(rows) // LIST_ROWS)
    x = unit[rows]
    some = x if len(rows) <= 16 * k else x[rng.choice(len(rows), 16 * k, replace=False)]
    near = (x @ _means(some, k, 4, rng, True).T).argmax(1)
    order = np.argsort(near, kind="stable")
    return np.split(rows[order], np.flatnonzero(np.diff(near[order])) + 1)


def _asked(unit: np.ndarray, heads: np.ndarray, owner: np.ndarray, probes: list[list[int]], margin: float) -> dict[int, list[tuple[int, int]]]:
    """Per sublist the (query, slot) that scan it: the ``SCAN`` nearest sublists of the lists a query probes, and those nearly as near as the nearest."""
    of_list: dict[int, list[int]] = {}
    for n, one in enumerate(owner.tolist()):
        of_list.setdefault(one, []).append(n)
    asks: dict[int, list[tuple[int, int]]] = {}
    for q, wanted in enumerate(probes):
        subs = [n for one in wanted for n in of_list.get(one, ())]
        if len(subs) > SCAN:
            near = heads[subs] @ unit[q]
            last = min(np.partition(near, -SCAN)[-SCAN], near.max() - margin)
            subs = [subs[i] for i in np.flatnonzero(near >= last)]
        for slot, n in enumerate(subs):
            asks.setdefault(n, []).append((q, slot))
    return asks


def _keep(sums: np.ndarray, rows: np.ndarray, most: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` best of each row; among those that tie at the last place, the ones with the least ``order``."""
    if sums.shape[1] <= most:
        return sums, rows
    top = np.argpartition(-sums, most - 1, axis=1)[:, :most]
    last = np.take_along_axis(sums, top, 1).min(1)
    for i in np.flatnonzero(((sums >= last[:, None]).sum(1) > most) & (last > -np.inf)):
        better, tied = np.flatnonzero(sums[i] > last[i]), np.flatnonzero(sums[i] == last[i])
        tied = tied[np.argsort(order[rows[i, tied]], kind="stable")]
        top[i] = np.concatenate([better, tied[: most - len(better)]])
    return np.take_along_axis(sums, top, 1), np.take_along_axis(rows, top, 1)


def _search_block(index: VectorIndex, table: pa.Table, dim: int, k: int) -> pa.Table:
    """Neighbours, inside one block, of all queries that came to it."""
    raw = table["vec"].combine_chunks() if isinstance(table["vec"], pa.ChunkedArray) else table["vec"]
    x = _unpacked(raw.to_pylist(), dim)
    ids, lists = table["id"].to_numpy(), table["list"].to_numpy()
    unit = _unit(x)
    kept = np.flatnonzero(lists >= 0)
    kept = kept[np.argsort(lists[kept], kind="stable")]
    given = table["code"].to_pylist()
    subs = [s for part in np.split(kept, np.flatnonzero(np.diff(lists[kept])) + 1) if len(part) for s in _sublists(unit, part)]
    owner = np.array([lists[s[0]] for s in subs], np.int64)
    many = np.bincount(owner, minlength=1)[owner] > 1 if len(subs) else np.zeros(0, bool)
    heads = np.stack([unit[s].mean(0) if m else index.centroids[o] for s, m, o in zip(subs, many, owner, strict=True)]) if subs else np.zeros((0, dim))
    heads = heads / np.maximum(np.linalg.norm(heads, axis=1, keepdims=True), 1e-12)
    probes = table["probes"].to_pylist()
    asks = _asked(unit, heads, owner, probes, index.margin)
    slots = 1 + max((slot for queries in asks.values() for _, slot in queries), default=-1)
    if not slots:
        return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
    asking = np.flatnonzero([len(p) > 0 for p in probes])
    row_of = np.full(len(ids), -1)
    row_of[asking] = np.arange(len(asking))
    # Per query the best codes so far of all sublists it scans.
    score = np.full((len(asking), RERANK), -np.inf, np.float32)
    which = np.zeros((len(asking), RERANK), np.int32)
    for n, queries in asks.items():
        members = subs[n]
        for qlo in range(0, len(queries), 512):
            q = np.array([a for a, _ in queries[qlo : qlo + 512]])
            tables = index.tables(unit[q])
            base = unit[q] @ index.centroids[owner[n]]
            for dlo in range(0, len(members), 4096):
                part = members[dlo : dlo + 4096]
                codes = np.frombuffer(b"".join([given[i] for i in part.tolist()]), np.uint8).reshape(-1, PARTS)
                sums = np.zeros((len(part), len(q)), np.float32)
                for m in range(PARTS):
                    sums += tables[m].take(codes[:, m], axis=0)
                # Rounded, so that equal directions tie.
                sums = (np.ascontiguousarray(sums.T) + base[:, None]).round(5)
                sums[ids[q][:, None] == ids[part][None, :]] = -np.inf
                rows = np.broadcast_to(part.astype(np.int32), sums.shape)
                if sums.shape[1] > RERANK:
                    sums, rows = _keep(sums, rows, RERANK, ids)
                at = row_of[q]
                sums, rows = _keep(np.concatenate([score[at], sums], 1), np.concatenate([which[at], rows], 1), RERANK, ids)
                score[at], which[at] = sums, rows
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(asking), 64):
        s, w, me = score[lo : lo + 64], which[lo : lo + 64], asking[lo : lo + 64]
        near = (unit[w] @ unit[me][:, :, None])[:, :, 0].round(6)
        near[s == -np.inf] = -np.inf
        # Single precision chooses k + 4 (it errs by about 1e-7, so it is rounded); double precision ranks them.
        near, w = _keep(near, w, k + 4, ids)
        u, v = x[me].astype(np.float64), x[w].astype(np.float64)
        size = np.sqrt((u * u).sum(1))[:, None] * np.sqrt((v * v).sum(2))
        exact = np.where(near == -np.inf, -np.inf, np.round((v @ u[:, :, None])[:, :, 0] / size, 9))
        order = np.argsort(ids[w], axis=1, kind="stable")
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(exact, order, 1), axis=1, kind="stable"), 1)[:, :k]
        exact, w = np.take_along_axis(exact, order, 1), np.take_along_axis(w, order, 1)
        q, c = np.nonzero(exact > -np.inf)
        out.append((ids[me[q]], ids[w[q, c]], exact[q, c]))
    q, c, sim = (np.concatenate(z) for z in zip(*out, strict=True))
    return pa.table({"id": pa.array(q, pa.int64()), "other": pa.array(c, pa.int64()), "similarity": pa.array(sim)})


def neighbour_pairs(found: DataFrame, key: str = "row_id") -> DataFrame:
    """``row_a, row_b``: pairs of which at least one is among the other's nearest."""
    return found.select(F.least(key, "other").alias("row_a"), F.greatest(key, "other").alias("row_b")).distinct()
