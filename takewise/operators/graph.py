"""Connected components of large graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takewise.session import checkpoint

#: Edges that a task takes at a time.
EDGES = 1 << 18


def _needed(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Places of edges that connect all that the edges u to v connect: a forest. Each component hangs on a smaller one that
    an edge leads to, until no edge leads from one to another."""
    name, at, kept = np.arange(nodes), np.arange(len(u)), []
    while True:
        one, two = name[u[at]], name[v[at]]
        apart = one != two
        at, low, high = at[apart], np.minimum(one, two)[apart], np.maximum(one, two)[apart]
        if not len(at):
            return np.sort(np.concatenate(kept)) if kept else at
        high, first = np.unique(high, return_index=True)
        kept.append(at[first])
        up = np.arange(nodes)
        up[high] = low[first]
        while (up[up] != up).any():
            up = up[up]
        name = up[name]


def thinned(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b): of the edges in each task those that connect the same nodes, fewer than there are nodes, and one of each edge
    from a node to itself. Edges that repeat what others say, however many, are neither shuffled nor written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fewer(parts: list[pa.Table]) -> pa.Table:
            table = pa.concat_tables(parts).combine_chunks()
            both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks], table.column(0).type).combine_chunks().dictionary_encode()
            codes, n = both.indices.to_numpy(zero_copy_only=False), table.num_rows
            u, v = codes[:n], codes[n:]
            own = np.flatnonzero(u == v)
            return table.take(pa.array(np.concatenate([_needed(u, v, len(both.dictionary)), own[np.unique(u[own], return_index=True)[1]]])))

        held, rows, least = [], 0, EDGES
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= least:
                held = [fewer(held)]
                rows = held[0].num_rows
                least = EDGES + 2 * rows
        if rows:
            yield from fewer(held).to_batches(max_chunksize=1 << 16)

    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return known.mapInArrow(run, known.schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al., 2014): every node hangs its larger neighbours, then its smaller
    ones, on the least node it knows of, until nothing changes. Minima are pre-aggregated, so a node with very many
    neighbours is no task of its own. Each round is written to the shared checkpoint folder. Null ends are left out. Edges
    are thinned before they travel.
    """
    edges = thinned(edges.where(F.col(a) != F.col(b)), a, b)
    high, low = F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")
    links = checkpoint(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high, low).distinct())
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state.n == 0 or state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v")).distinct()
        seen = state
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpoint(small.union(least).distinct())


def update_components(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """labels (node, component) with further edges: equal to the components over all edges so far.

    Each end of a new edge stands for its component, or itself if it has none. The edges between components, no more than
    the new ones, are connected by themselves; the least name of those that grow together is the name of all. Old edges
    are not looked at again. Ends that are null are left out; labels must hold each node once.
    """
    ends = thinned(edges, a, b).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    old = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    drawn = checkpoint(ends.join(old("a"), "a", "left").join(old("b"), "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y")))
    grown = checkpoint(connected_components(drawn, "x", "y").select(F.col("node").alias("was"), F.col("component").alias("now")))
    fresh = drawn.select(F.col("a").alias("node"), F.col("x").alias("component")).union(drawn.select("b", "y")).distinct()
    fresh = fresh.join(labels.select("node"), "node", "left_anti")
    named = labels.select("node", "component").unionByName(fresh)
    return named.join(grown, named["component"] == grown["was"], "left").select("node", F.coalesce("now", "component").alias("component"))
