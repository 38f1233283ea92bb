"""Nearest neighbours by inner product with an inverted multi-index: two codebooks, one for each half of a vector."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takewise.llm import text as tx


@dataclass(frozen=True)
class Index:
    """rows: (vec_id, vector, cell) of every usable vector; counts: how many lie in each pair of centroids."""

    rows: DataFrame
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    visit: float

    @property
    def split(self) -> int:
        return self.first.shape[1]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part: null, empty, zero and non-finite vectors don't, nor rows without vec_id."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))


def codebook(points: np.ndarray, size: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of points by Lloyd's rounds."""
    points = np.asarray(points, float)
    pick = np.random.default_rng(seed).permutation(len(points))[: min(size, len(points))]
    centres = points[pick].copy()
    for _ in range(rounds):
        nearest = assign(points, centres)
        many = np.bincount(nearest, minlength=len(centres))
        sums = np.stack([np.bincount(nearest, points[:, j], len(centres)) for j in range(points.shape[1])], 1) if points.shape[1] else np.zeros(centres.shape)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
    return centres


def assign(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - 0.5 * (centres**2).sum(1), axis=1)


def traverse(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in order of the summed score of their two centroids, until they hold as many vectors as wanted.

    left and right are a query's scores against both codebooks. A heap holds the border of what was taken: after the
    pair at places (i, j) of the two sorted lists come (i + 1, j), if (i + 1, j - 1) is taken or j is 0, and (i, j + 1).
    """
    one, two = np.argsort(-left, kind="stable").tolist(), np.argsort(-right, kind="stable").tolist()
    a, b, width = left.tolist(), right.tolist(), len(right)
    heap, reach, cells, held = [(-a[one[0]] - b[two[0]], 0, 0)], [0] * len(one), [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = one[i] * width + two[j]
        cells.append(cell)
        held += counts[cell]
        reach[i] = j + 1
        if i + 1 < len(one) and reach[i + 1] == j:
            heapq.heappush(heap, (-a[one[i + 1]] - b[two[j]], i + 1, j))
        if j + 1 < len(two) and (i == 0 or reach[i - 1] > j + 1):
            heapq.heappush(heap, (-a[one[i]] - b[two[j + 1]], i, j + 1))
    return cells


def _share(sample: np.ndarray, first: np.ndarray, second: np.ndarray, k: int, recall: float, queries: int = 200) -> float:
    """The share of all vectors that a traversal must see for the wanted recall, from the sample's own neighbours."""
    if len(sample) <= 2 * k:
        return 1.0
    split = first.shape[1]
    cell = assign(sample[:, :split], first) * len(second) + assign(sample[:, split:], second)
    counts = np.bincount(cell, minlength=len(first) * len(second))
    need = []
    for at in np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int):
        q = sample[at]
        scores = sample @ q
        scores[at] = -np.inf
        best = np.argpartition(-scores, k)[:k]
        order = traverse(first @ q[:split], second @ q[split:], counts, float("inf"))
        seen = np.empty(len(counts))
        seen[order] = np.cumsum(counts[order])
        need.append(seen[cell[best]])
    return float(min(1.0, np.quantile(np.concatenate(need), recall) / len(sample)))


def build(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int | None = None, sample: int = 20_000, k: int = 20, recall: float = 0.96) -> Index:
    """The index of all usable vectors.

    Codebooks of size centroids (by default so many that a pair of them has some 50 vectors, 8 to 1,024, which is the most),
    and the share of the vectors that a search visits so that it finds recall of the k nearest, are fitted on about sample vectors chosen by a hash of vec_id. Each vector is indexed. The dimension is
    that of most vectors; others take no part. The driver gets the sample and the number of vectors per cell alone.
    """
    rows = usable(vectors, vec_id, embedding)
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("many"), "n").limit(1).collect()
    if not sizes:
        return Index(rows.withColumn("cell", F.lit(0)), np.zeros((1, 0)), np.zeros((1, 0)), np.zeros(1, np.int64), 1.0)
    n, many = sizes[0].n, sizes[0].many
    rows = rows.where(F.size("vector") == n)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / many) * (1 << 30))))
    got = sorted((r.vec_id, tuple(r.vector)) for r in chosen.collect())
    points = np.array([v for _, v in got], float).reshape(-1, n) if got else np.zeros((1, n))
    split, size = n // 2, min(1024, size or max(8, int((many / 50) ** 0.5)))
    first, second = codebook(points[:, :split], size), codebook(points[:, split:], size)
    visit = _share(points, first, second, k, recall)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            cell = assign(x[:, :split], first) * len(second) + assign(x[:, split:], second)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cell.astype(np.int32))], names=["vec_id", "vector", "cell"])

    rows = rows.mapInArrow(cells, "vec_id long, vector array<double>, cell int")
    counts = np.zeros(len(first) * len(second), np.int64)
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("many")).collect():
        counts[r.cell] = r.many
    return Index(rows, first, second, counts, visit)


def _shards(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each cell and its number of shards: neighbouring cells share one, a large cell has several.

    Shards have block vectors at most, and about equally many.
    """
    total = int(counts.sum())
    most = max(1, -(-total // max(1, -(-total // block))))
    start, pieces, shard, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, many in enumerate(counts.tolist()):
        if held and held + many > most:
            shard, held = shard + 1, 0
        start[cell] = shard
        if many > most:
            pieces[cell] = -(-many // most)
            shard, held = shard + pieces[cell], 0
        else:
            held += many
    return start, pieces


def _best(query: np.ndarray, asked: np.ndarray, wanted: np.ndarray, ids: np.ndarray, x: np.ndarray, cuts: list[int], k: int) -> list[list[dict]]:
    """The k nearest for each query of those vectors whose cell it wants: wanted has a column per cell, cuts bound cells."""
    scores = np.full((len(query), len(ids)), -np.inf)
    for c, (a, b) in enumerate(zip(cuts, cuts[1:])):
        hit = np.flatnonzero(wanted[:, c])
        scores[hit, a:b] = query[hit] @ x[a:b].T
    scores[asked[:, None] == ids[None, :]] = -np.inf
    least, out = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)], []
    for i, low in enumerate(least.tolist()):
        near = np.flatnonzero(scores[i] >= low - 1e-9 * (1 + abs(low))) if low > -np.inf else np.flatnonzero(scores[i] > -np.inf)
        exact = (x[near] * query[i]).sum(1)  # one order of adding for all, so equal vectors have equal scores
        best = np.lexsort((ids[near], -exact))[:k]
        out.append([{"far": -s, "vec_id": v} for s, v in zip(exact[best].tolist(), ids[near[best]].tolist())])
    return out


def search(index: Index, queries: DataFrame, k: int = 20, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (vec_id, vector): the k nearest of all indexed rows but the query's own.

    The nearest have the largest inner products in double precision, equal ones the smaller vec_id. A query visits the
    cells that traverse gives, and all their vectors are scored, so any number of equal vectors is ranked exactly. Cells
    are dealt to shards of about block vectors, a hot cell to several. Each vector goes to its shard once and each query
    to the shards it visits; a shard's vectors come first in its sorted partition and are held, its queries stream past
    them. A query without other vectors has no rows.
    """
    first, second, counts, split = index.first, index.second, index.counts, index.split
    start, pieces = _shards(counts, block)
    wanted = index.visit * counts.sum()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            row, shard, visited = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, v in enumerate(vectors):
                cells = np.array(traverse(first @ v[:split], second @ v[split:], counts, wanted))
                cells = np.sort(cells[counts[cells] > 0])
                many = pieces[cells]
                own = np.repeat(start[cells] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                row.append(np.full(len(own), i))
                shard.append(own)
                visited.append(np.repeat(cells, many))
            row, shard, visited = (np.concatenate(x) for x in (row, shard, visited))
            order = np.lexsort((visited, shard, row))
            row, shard, visited = row[order], shard[order], visited[order]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1]))[: len(row)])
            cells = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(visited, pa.int32()))
            at = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([pa.array(shard[new]), pa.array(np.ones(len(new), np.int32)), batch.column("vec_id").take(at), batch.column("vector").take(at), cells], names=names)

    names = ["shard", "asks", "id", "vector", "cells"]
    schema = "shard long, asks int, id long, vector array<double>, cells array<int>"
    full = np.flatnonzero(counts)
    table = pa.table({"cell": pa.array(full, pa.int32()), "start": pa.array(start[full], pa.int64()), "pieces": pa.array(pieces[full], pa.int64())})
    places = F.broadcast(queries.sparkSession.createDataFrame(table))  # codebooks have 1,024 centroids at most, so these are 2^20 rows of 20 bytes
    shard = F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("pieces"))
    held = index.rows.join(places, "cell").select(shard.cast("long").alias("shard"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "vector", F.array("cell").alias("cells"))
    parts = tx.partitions(queries)
    asked = queries.repartition(parts, "vec_id").mapInArrow(place, schema)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, ready = None, [], None
        for batch in batches:
            shards, asks = (batch.column(c).to_numpy() for c in ("shard", "asks"))
            cuts = np.append(np.flatnonzero(np.append(True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1]))), len(shards)).tolist()
            out: list[tuple[int, list[dict]]] = []
            salt: list[int] = []
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                ids, x = part.column("id").to_numpy(), part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if shards[a] != now:
                    now, kept, ready = shards[a], [], None
                if not asks[a]:
                    kept.append((ids, x, part.column("cells").flatten().to_numpy()))
                    continue
                if not kept:
                    continue
                if ready is None:
                    own, rows, cells = (np.concatenate(y) for y in zip(*kept))
                    order = np.lexsort((own, cells))
                    own, rows, cells = own[order], rows[order], cells[order]
                    bounds = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))
                    ready = own, rows, cells[bounds[:-1]], bounds.tolist()
                own, rows, cells, bounds = ready
                lists = part.column("cells")
                visited, who = lists.flatten().to_numpy(), np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                at = np.minimum(np.searchsorted(cells, visited), len(cells) - 1)
                hit = cells[at] == visited
                mask = np.zeros((b - a, len(cells)), bool)
                mask[who[hit], at[hit]] = True
                for c in range(0, b - a, 512):
                    some = slice(c, c + 512)
                    out += zip(ids[some].tolist(), _best(x[some], ids[some], mask[some], own, rows, bounds, k))
                salt += [int(shards[a]) % 32] * (b - a)
            kind = pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int64()), pa.array(salt, pa.int64()), pa.array([found for _, found in out], kind)], names=["query_id", "salt", "best"])

    both = held.union(asked).repartition(2 * parts, "shard").sortWithinPartitions("shard", "asks")
    best = both.mapInArrow(rank, "query_id long, salt long, best array<struct<far:double,vec_id:long>>")
    for keys in (["query_id", "salt"], ["query_id"]):  # in two steps, so that no list holds the results of all shards
        best = best.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "one")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.far")).alias("score"))


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of the rows whose vec_id every divides, among all rows. An empty table gives an empty result.

    Of rows that share a vec_id one asks; all are candidates of other queries, none of them of its own.
    """
    index = build(vectors, vec_id, embedding, k=k)
    queries = index.rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("vec_id", "vector")
    return search(index, queries, k)
