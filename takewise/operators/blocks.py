"""Which blocks of riffs have to meet: blocks by ranges of tempo, a summary of each, and a join of summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takewise.operators import scoring as sc
from takewise.session import checkpoint

#: Riffs of a block at most: some 25 MB with contours of 200 points; two blocks are a group, whose size nothing else decides.
RIFFS = 8_000
#: Groups that have a task of their own; beyond, some share one.
TASKS = 8_192
#: Rows of a batch of results.
ROWS = 1 << 16
#: Ranges of tempo at most; the plan holds their ends.
CUTS = 512
_CAPS = ("intervals", *sc.VECTORS)
_SUMMARY = "block int, n long, low double, high double, low_uniformity double, high_uniformity double, bare boolean, " + ", ".join(f"{c}_center array<double>, {c}_near double" for c in _CAPS)


def _place() -> Column:
    """The tempo, with so little of a hash of riff_id that riffs of one tempo have places of their own."""
    return F.col("tempo").cast("double") * (1 + F.pmod(F.xxhash64("riff_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) * 1e-9)


def quantiles(*sides: DataFrame) -> list[tuple[int, list[float]]]:
    """Of each side the riffs of known tempo and the ends of CUTS equal shares of their places; one pass over two columns."""
    rows = [side.where("tempo > 0").select(F.lit(k).alias("side"), _place().alias("place")) for k, side in enumerate(sides)]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    ends = F.percentile_approx("place", [i / CUTS for i in range(1, CUTS)], 20 * CUTS)
    told = {r.side: (r.n, list(r.ends)) for r in both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), ends.alias("ends")).collect()}
    return [told.get(k, (0, [])) for k in range(len(sides))]


def count(rows: list[int], cores: int, riffs: int = RIFFS) -> list[int]:
    """Blocks of either side: as few as riffs in each allow, but enough for pairs of them to keep every core at work."""
    few = [max(1, -(-n // riffs)) for n in rows]
    for _ in range(64):
        if few[0] * few[1] >= 6 * cores or max(n / k for n, k in zip(rows, few)) <= 64:
            break
        few[int(rows[1] / few[1] >= rows[0] / few[0])] *= 2
    return few


def blocked(riffs: DataFrame, blocks: int, ends: list[float] | None = None) -> DataFrame:
    """riffs of known tempo with their block: ranges of tempo, those of one tempo split by a hash of riff_id, so that all blocks
    have about as many. Beyond CUTS blocks each range is split by that hash. Riffs of unknown tempo pass no test."""
    ends = quantiles(riffs)[0][1] if ends is None else ends
    ranges, parts = min(blocks, CUTS), -(-blocks // CUTS)
    chosen = sorted({ends[i * CUTS // ranges - 1] for i in range(1, ranges)}) if ends else []
    below = F.filter(F.array(*[F.lit(e) for e in chosen]), lambda e: e < _place()) if chosen else F.array()
    return riffs.where("tempo > 0").withColumn("block", (F.size(below) * parts + F.pmod(F.xxhash64("riff_id", F.lit(1)), F.lit(parts))).cast("int"))


def summaries(blocked: DataFrame) -> DataFrame:
    """A row per block: riffs, ranges of tempo and uniformity, whether one has no intervals, and for each vector the middle
    direction of its block with the least cosine to it (over vectors that aren't next to zero; null if all are)."""

    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], kinds.get(f.split()[1], pa.list_(pa.float64()))) for f in _SUMMARY.split(", ")])

    def run(own: pa.Table) -> pa.Table:
        side = sc.Side(own)
        row = {"block": own.column("block")[0].as_py(), "n": own.num_rows, "low": side.tempo.min(), "high": side.tempo.max(), "low_uniformity": side.uniformity.min(), "high_uniformity": side.uniformity.max(), "bare": bool((side.matrix["intervals"][1] == 0).any())}
        for c in _CAPS:
            x = side.matrix[c][0]
            size = np.sqrt((x * x).sum(1))
            unit = x[size >= 1e-10] / size[size >= 1e-10, None]
            middle = unit.sum(0)
            length = float(np.sqrt((middle * middle).sum()))
            row[f"{c}_center"] = (middle / length).tolist() if length > 1e-10 else None
            row[f"{c}_near"] = float((unit @ middle).min() / length) if length > 1e-10 else (None if not len(unit) else -1.0)
        return pa.Table.from_pylist([row], schema)

    vectors = [F.col(c).cast("array<double>").alias(c) for c in _CAPS]
    return blocked.select("block", F.col("tempo").cast("double").alias("tempo"), F.col("uniformity").cast("double").alias("uniformity"), *vectors).groupBy("block").applyInArrow(run, _SUMMARY)


def _reach(what: str) -> Column:
    """No two vectors of the blocks a and b have a greater cosine: the angle between the middles less both radii. 0 if one
    block has only vectors next to zero, 1 where a block has no middle."""
    one, two = F.col(f"a.{what}_center"), F.col(f"b.{what}_center")
    near = [F.col(f"{s}.{what}_near") for s in "ab"]
    dot = F.aggregate(F.zip_with(one, two, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    angle = lambda x: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    least = F.greatest(F.lit(0.0), angle(dot) - angle(near[0]) - angle(near[1]) - 1e-6)
    bound = F.when(one.isNull() | two.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(F.least(F.lit(np.pi), least))))
    return F.when(near[0].isNull() | near[1].isNull(), 0.0).otherwise(bound)


def _tempo_reach() -> Column:
    """No two tempos of the blocks a and b are more alike."""
    low, high = F.col("a.low") / F.col("b.high"), F.col("a.high") / F.col("b.low")
    alike = lambda r: F.greatest(*[F.least(x, 1 / x) for x in (r, r / 2, r * 2)])
    among = [(low <= x * (1 + 1e-9)) & (high >= x * (1 - 1e-9)) for x in (0.5, 1.0, 2.0)]
    best = F.greatest(alike(low), alike(high)) + 1e-9
    return F.when(among[0] | among[1] | among[2] | (best >= 0.85), 1.0).otherwise(best)


def pairs(new: DataFrame, library: DataFrame, least: float, intervals: bool = True) -> DataFrame:
    """(block_a, block_b) of the summaries new and library of which some riffs may match with least or more.

    Summaries meet by the bands of a logarithmic scale of tempo that their ranges touch, and those next to these, as
    tempos that pass are 0.3 of each other at least. Then the bounds of the interval test and of the score decide.
    """
    step = float(np.log(1 / 0.3))
    band = lambda c: F.floor(F.log(c) / step).cast("int")
    one = new.select(F.struct(*new.columns).alias("a"), F.explode(F.sequence(band("low") - 1, band("high") + 1)).alias("band"))
    two = library.select(F.struct(*library.columns).alias("b"), F.explode(F.sequence(band("low"), band("high"))).alias("band"))
    met = one.join(two, "band")
    tempo = _tempo_reach()
    keep = tempo >= sc.TEMPO_LEAST
    if intervals:
        keep = keep & (F.col("a.bare") | F.col("b.bare") | (_reach("intervals") >= sc.INTERVAL_LEAST))
        reach = {k: _reach(k) for k in sc.VECTORS} | {"contour": F.lit(1.0), "tempo": tempo}
        bound = {label: sum((F.lit(w) * reach[k] for k, w in weights.items()), F.lit(0.0)) for label, weights in sc.WEIGHTS.items()}
        may = {
            "blast": (F.col("a.high_uniformity") > sc.BLAST_ABOVE) & (F.col("b.high_uniformity") > sc.BLAST_ABOVE),
            "groove": (F.col("a.low_uniformity") < sc.GROOVE_BELOW) & (F.col("b.low_uniformity") < sc.GROOVE_BELOW),
            "balanced": F.lit(True),
        }
        keep = keep & (F.greatest(*[F.when(may[k], bound[k]).otherwise(0.0) for k in bound]) >= least - sc.SLACK)
    return met.where(keep).select(F.col("a.block").alias("block_a"), F.col("b.block").alias("block_b")).distinct()


def meet(new: DataFrame, library: DataFrame, columns: list[str], run: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], schema: str, least: float, intervals: bool = True, blocks: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """run(block of new, block of library) for each pair of blocks that can hold a match, one pair in a task.

    Riffs travel, once for each block that theirs has to meet; pairs of riffs don't. What run yields is sent on at once,
    so a task holds two blocks and one part of their results, however many there are. columns: those that run needs.
    """
    told = quantiles(new, library)
    counted = count([n for n, _ in told], library.sparkSession.sparkContext.defaultParallelism)
    many = [n or k for n, k in zip(blocks, counted)]
    sides = [blocked(side, n, ends) for side, n, (_, ends) in zip((new, library), many, told)]
    met = checkpoint(pairs(summaries(sides[0]), summaries(sides[1]), least, intervals))
    # ranges of tempo beyond CUTS are split further, which makes blocks some more than asked for
    tasks = min(TASKS, -(-many[0] // CUTS) * CUTS * many[1] if many[0] > CUTS else many[0] * many[1])
    met = met.withColumn("task", F.pmod(F.col("block_a") * F.lit(many[1]) + F.col("block_b"), F.lit(tasks)).cast("int"))
    dealt = [side.select(F.col("block").alias(key), F.lit(of).alias("side"), *columns).join(met, key).select("task", "block_a", "block_b", "side", *columns) for of, (side, key) in enumerate(zip(sides, ("block_a", "block_b")))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        a, b = (rows.filter(pc.equal(rows.column("side"), of)).select(columns) for of in (0, 1))
        del rows
        if a.num_rows and b.num_rows:
            for found in run(a, b):
                yield from found.to_batches(max_chunksize=ROWS)

    return dealt[0].union(dealt[1]).repartitionById(tasks, "task").groupBy("task", "block_a", "block_b").applyInArrow(each, schema)
