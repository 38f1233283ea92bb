"""Songs cut into riffs where the sound changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by() -> WindowSpec:
    return Window.partitionBy("recording_id")


def ordered() -> WindowSpec:
    return by().orderBy("frame_idx")


def novelty(frames: DataFrame, features: list[str], half: int = 32) -> DataFrame:
    """(recording_id, frame_idx, novelty): how much the frames after differ from those before, 1 at the greatest change.

    A checkerboard of ones laid on the similarity matrix of unit vectors sums to the squared distance of the sums of
    half vectors before and after the frame, so windows of sums do it without the matrix. 0 within half of the ends.
    """
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in features), F.lit(0.0)))
    unit = frames.withColumn("__norm", F.when(norm < 1e-10, 1.0).otherwise(norm)).withColumn("__n", F.count(F.lit(1)).over(by()))
    before, after = ordered().rowsBetween(-half, -1), ordered().rowsBetween(0, half - 1)
    steps = [F.sum(F.col(c) / F.col("__norm")).over(before) - F.sum(F.col(c) / F.col("__norm")).over(after) for c in features]
    inside = (F.col("frame_idx") >= half) & (F.col("frame_idx") < F.col("__n") - half)
    raw = unit.withColumn("raw", F.when(inside, sum((s * s for s in steps), F.lit(0.0))).otherwise(0.0))
    peak = F.max("raw").over(by())
    return raw.select("recording_id", "frame_idx", F.when(peak > 0, F.col("raw") / peak).otherwise(F.col("raw")).alias("novelty"))


def novelty_peaks(curve: DataFrame, height: float = 0.3, distance: int = 172) -> DataFrame:
    """(recording_id, frame_idx, novelty) of peaks that high, no two nearer than distance; of near ones the higher stays.

    A plateau counts by its middle. Candidates are found by windows; only they go to the suppression.
    """
    change = F.when(F.lag("novelty").over(ordered()) == F.col("novelty"), 0).otherwise(1)
    runs = curve.withColumn("__new", change).withColumn("__run", F.sum("__new").over(ordered())).groupBy("recording_id", "__run").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"), F.first("novelty").alias("novelty"))
    order = by().orderBy("a")
    top = runs.withColumn("before", F.lag("novelty").over(order)).withColumn("after", F.lead("novelty").over(order))
    top = top.where((F.col("novelty") > F.col("before")) & (F.col("novelty") > F.col("after")) & (F.col("novelty") >= height)).select("recording_id", F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias("frame_idx"), "novelty")

    def suppress(peaks: pd.DataFrame) -> pd.DataFrame:
        peaks = peaks.sort_values("frame_idx")
        at, high = peaks["frame_idx"].to_numpy(), peaks["novelty"].to_numpy()
        keep = pd.Series(True, index=range(len(at)))
        for i in sorted(range(len(at)), key=lambda i: (high[i], i), reverse=True):
            if keep[i]:
                near = (abs(at - at[i]) < distance) & (at != at[i])
                keep[near] = False
        return peaks[keep.to_numpy()]

    return top.groupBy("recording_id").applyInPandas(suppress, f"recording_id {curve.schema['recording_id'].dataType.simpleString()}, frame_idx long, novelty double")


def assemble_riffs(bounds: DataFrame, least: float = 3, most: float = 60) -> DataFrame:
    """(recording_id, riff_index, start_sec, end_sec) of bounds (recording_id, duration_sec, peaks array<double>).

    A part shorter than least goes on into the next one unless it is the last; one longer than most is cut in equal parts.
    """
    points = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.coalesce("peaks", F.array().cast("array<double>")), F.array(F.col("duration_sec")))))
    rows = bounds.withColumn("points", F.when(F.col("duration_sec") < least, F.array(F.lit(0.0), F.col("duration_sec"))).otherwise(points))
    n = F.size("points")
    start = F.struct(F.lit(0.0).alias("from"), F.array().cast("array<struct<a:double,b:double>>").alias("parts"))

    def fold(state, i):
        to = F.element_at(F.col("points"), i)
        part = F.struct(state["from"].alias("a"), to.alias("b"))
        short = (to - state["from"] < least) & (i < n)
        return F.when(short, state).otherwise(F.struct(to.alias("from"), F.concat(state["parts"], F.array(part)).alias("parts")))

    parts = F.aggregate(F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>")), start, fold, lambda s: s["parts"])
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.struct(F.lit(0.0).alias("a"), F.col("duration_sec").alias("b"))))
    count = lambda p: F.greatest(F.lit(1), F.when(p["b"] - p["a"] > most, F.ceil((p["b"] - p["a"]) / most)).otherwise(1)).cast("int")
    cut = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), count(p) - 1), lambda j: F.struct(F.round(p["a"] + j * (p["b"] - p["a"]) / count(p), 3).alias("start_sec"), F.round(p["a"] + (j + 1) * (p["b"] - p["a"]) / count(p), 3).alias("end_sec")))))
    return rows.select("recording_id", F.posexplode(cut).alias("riff_index", "r")).select("recording_id", "riff_index", "r.start_sec", "r.end_sec")
