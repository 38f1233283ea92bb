"""Pitch contours of riffs: smoothed curves, which of them to trust, and their standard form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takewise.functions import arrays


def _edges(values: np.ndarray, size: int) -> np.ndarray:
    """values continued by reflection, as far as a filter of this size reaches; the filter's middle is at size // 2."""
    return np.pad(values, (size // 2, size - size // 2 - 1), mode="symmetric")


def median_filtered(values: np.ndarray, size: int) -> np.ndarray:
    return np.median(np.lib.stride_tricks.sliding_window_view(_edges(values, size), size), axis=1)


def mean_filtered(values: np.ndarray, size: int) -> np.ndarray:
    sums = np.cumsum(np.append(0.0, _edges(values, size)))
    return (sums[size:] - sums[:-size]) / size


def contour_curves(frames: DataFrame, keys: list[str], median: int = 15, mean: int = 25) -> DataFrame:
    """(keys, centroid_curve, rolloff_curve): the centroid by a median and then a mean filter, the rolloff by the mean alone."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame_idx")
        curves = {"centroid_curve": [mean_filtered(median_filtered(part["centroid"].to_numpy(float), median), mean)], "rolloff_curve": [mean_filtered(part["rolloff"].to_numpy(float), mean)]}
        return pd.DataFrame({k: [part[k].iloc[0]] for k in keys} | curves)

    head = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.groupBy(*keys).applyInPandas(run, f"{head}, centroid_curve array<double>, rolloff_curve array<double>")


def pitch_track_curve(f0: DataFrame, keys: list[str], confident: float = 0.5, voiced: float = 0.3) -> DataFrame:
    """(keys, frame_idx, midi) of tracks that are confident and voiced enough; gaps are filled linearly, ends held."""
    w = Window.partitionBy(*keys)
    order = w.orderBy("frame_idx")
    note = F.when(F.col("f0_hz").isNotNull(), 12 * (F.log2("f0_hz") - F.log2(F.lit(440.0))) + 69)
    t = f0.withColumn("note", note).withColumn("c", F.avg("voiced_prob").over(w)).withColumn("v", F.count("f0_hz").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    t = t.where((F.col("c") >= confident) & (F.col("v") >= voiced * F.col("n")) & (F.col("v") > 0))
    known = F.when(F.col("note").isNotNull(), F.struct("frame_idx", "note"))
    t = t.withColumn("lo", F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.first(known, True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    span = F.col("hi.frame_idx") - F.col("lo.frame_idx")
    line = F.col("lo.note") + (F.col("hi.note") - F.col("lo.note")) * (F.col("frame_idx") - F.col("lo.frame_idx")) / span
    filled = F.when(F.col("lo").isNull(), F.col("hi.note")).when(F.col("hi").isNull() | (span == 0), F.col("lo.note")).otherwise(line)
    return t.select(*keys, "frame_idx", filled.alias("midi"))


def pitch_curves(track: DataFrame, keys: list[str], size: int = 15) -> DataFrame:
    """(keys, curve) of filled tracks, by a mean filter."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame_idx")
        return pd.DataFrame({k: [part[k].iloc[0]] for k in keys} | {"curve": [mean_filtered(part["midi"].to_numpy(float), size)]})

    head = ", ".join(f"{k} {track.schema[k].dataType.simpleString()}" for k in keys)
    return track.groupBy(*keys).applyInPandas(run, f"{head}, curve array<double>")


def contour_quality(curve: Column) -> Column:
    return arrays.smoothness(curve)


def select_contour(rows: DataFrame) -> DataFrame:
    """rows (pitch, centroid, rolloff array<double>, duration_sec) with curve and method: the pitch track if there is one,
    else the better of the other two, none for a riff under a second or without values."""
    better = contour_quality(F.col("centroid")) >= contour_quality(F.col("rolloff"))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    none = (F.col("duration_sec") < 1) | ~(some("pitch") | some("centroid") | some("rolloff"))
    method = F.when(none, "none").when(some("pitch"), "pyin").when(some("centroid") & (~some("rolloff") | better), "centroid").otherwise("rolloff")
    rows = rows.withColumn("method", method)
    curve = F.when(F.col("method") == "pyin", F.col("pitch")).when(F.col("method") == "centroid", F.col("centroid")).when(F.col("method") == "rolloff", F.col("rolloff")).otherwise(F.array().cast("array<double>"))
    return rows.withColumn("curve", curve)


def standard_form(curve: Column, n: int = 200) -> Column:
    """struct(contour, intervals): n points, mean 0 and deviation 1, rounded; and their steps in five sizes."""
    return arrays.let(arrays.znorm(arrays.resampled(curve, n)), lambda z: F.struct(arrays.rounded(z).alias("contour"), arrays.quantised(z).alias("intervals")))
