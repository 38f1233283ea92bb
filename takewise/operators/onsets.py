"""Onsets and beats from the strength of onsets in frames: the input tables of trimming and rhythm."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takewise.operators.frames import HOP

#: Frames a second of sound at 22,050 Hz.
RATE = 22050 / HOP
#: Seconds that an onset tops before it, seconds around it whose mean it exceeds, and by how much, as a share of the range.
TOPS, AROUND, DELTA = 0.03, 0.1, 0.07


def _strength(column: str) -> Column:
    """Null and NaN are no strength."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def pick_onsets(frames: DataFrame, keys: list[str], column: str = "onset", rate: float = RATE) -> DataFrame:
    """(keys, idx, frame_idx, t_sec) of onsets in frames (keys, frame_idx, column), a row per frame.

    Strengths are scaled to 0 to 1 per key. An onset is as high as any frame shortly before it, exceeds the mean around
    it by DELTA and comes later than a wait after the onset before. Frames that pass the first two tests form chains whose
    members are no further apart than the wait; where a chain begins nothing before it counts, so the fold that applies
    the wait sees one chain at a time. Even strengths have no onset, and a key without onsets has no rows.
    """
    by = Window.partitionBy(*keys)
    order = by.orderBy("frame_idx")
    ahead, around, wait = int(TOPS * rate), int(AROUND * rate), int(TOPS * rate)
    x = frames.select(*keys, F.col("frame_idx").cast("long").alias("frame_idx"), _strength(column).alias("x"))
    x = x.withColumn("__low", F.min("x").over(by)).withColumn("__high", F.max("x").over(by))
    x = x.withColumn("x", F.when(F.col("__high") > F.col("__low"), (F.col("x") - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.0))
    x = x.withColumn("__top", F.max("x").over(order.rowsBetween(-ahead, 0))).withColumn("__mean", F.avg("x").over(order.rowsBetween(-around, around)))
    found = x.where((F.col("x") >= F.col("__top")) & (F.col("x") >= F.col("__mean") + DELTA))
    far = F.col("frame_idx") - F.lag("frame_idx").over(order) > wait
    chains = found.withColumn("__far", far.cast("int")).withColumn("__chain", F.sum(F.coalesce("__far", F.lit(0))).over(order))
    chains = chains.groupBy(*keys, "__chain").agg(F.array_sort(F.collect_list("frame_idx")).alias("__at"))
    later = lambda kept, at: F.coalesce(at - F.try_element_at(kept, F.lit(-1)) > wait, F.lit(True))
    kept = F.aggregate("__at", F.array().cast("array<bigint>"), lambda kept, at: F.when(later(kept, at), F.concat(kept, F.array(at))).otherwise(kept))
    onsets = chains.select(*keys, F.explode(kept).alias("frame_idx"))
    return onsets.select(*keys, (F.row_number().over(order) - 1).cast("long").alias("idx"), "frame_idx", (F.col("frame_idx") / rate).alias("t_sec"))


def beat_period(x: np.ndarray, rate: float = RATE, bpm: float = 120.0, octaves: float = 1.0, slowest: float = 30.0, fastest: float = 300.0) -> int:
    """Frames between beats: the lag at which strengths are most like themselves, weighted by a log-normal prior around bpm.

    0 if no lag within the bounds has a positive likeness.
    """
    lags = np.arange(max(1, int(np.ceil(60 * rate / fastest))), min(len(x) - 1, int(60 * rate / slowest)) + 1)
    if not len(lags):
        return 0
    d = x - x.mean()
    like = np.array([d[k:] @ d[:-k] for k in lags])
    best = int(np.argmax(like * np.exp(-0.5 * (np.log2(60 * rate / lags / bpm) / octaves) ** 2)))
    return int(lags[best]) if like[best] > 1e-12 else 0


def beat_scores(local: np.ndarray, period: int, tightness: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """The best sum of a series of beats that ends at each frame, and the beat before it (-1: none).

    A series gains the local score of its beats and loses tightness times the squared logarithm of each gap over period;
    gaps are half a period to two.
    """
    reach = np.arange(max(1, round(period / 2)), 2 * period + 1)
    cost = tightness * np.log(reach / period) ** 2
    total, link = local.astype(float), np.full(len(local), -1)
    for t in range(int(reach[0]), len(local)):
        n = min(len(reach), t - int(reach[0]) + 1)
        gain = total[t - reach[:n]] - cost[:n]
        best = int(np.argmax(gain))
        if gain[best] > 0:
            total[t], link[t] = local[t] + gain[best], t - reach[best]
    return total, link


def beats_of(x: np.ndarray, period: int, tightness: float = 100.0) -> np.ndarray:
    """Positions of beats in strengths x by dynamic programming (Ellis, 2007), weak ones at the ends left out.

    The series ends at the last top of the scores that is over half their median, which may be a weak frame less than
    half a period behind a strong one; the strong one is then passed over and the weak one left out.
    """
    spread = x.std(ddof=1) if len(x) > 1 else 0.0
    if period < 1 or not spread > 0:
        return np.empty(0, np.int64)
    bump = np.exp(-0.5 * (np.arange(-period, period + 1) * 32 / period) ** 2)
    local = np.convolve(x / spread, bump)[period : period + len(x)]
    total, link = beat_scores(local, period, tightness)
    edge = np.concatenate([[-np.inf], total, [-np.inf]])
    tops = np.flatnonzero((total > edge[:-2]) & (total >= edge[2:]))
    tops = tops[2 * total[tops] > np.median(total[tops])] if len(tops) else tops
    if not len(tops):
        return np.empty(0, np.int64)
    at = [int(tops[-1])]
    while link[at[-1]] >= 0:
        at.append(int(link[at[-1]]))
    beats = np.array(at[::-1])
    smooth = np.convolve(local[beats], np.hanning(7)[1:-1])[2 : 2 + len(beats)]
    strong = np.flatnonzero(smooth > 0.5 * np.sqrt(np.mean(smooth**2)))
    return beats[strong[0] : strong[-1] + 1] if len(strong) else beats[:0]


def _per_key(frames: DataFrame, keys: list[str], column: str, fields: str, rows) -> DataFrame:
    """rows(frame numbers, strengths) as columns, for each key."""
    names = [f.split()[0] for f in fields.split(", ")]
    schema = ", ".join([*[f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys], fields])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame_idx", kind="stable")
        got = pd.DataFrame(dict(zip(names, rows(part["frame_idx"].to_numpy(), part["x"].to_numpy(float)))))
        for i, k in enumerate(keys):
            got.insert(i, k, pd.Series([key[i]] * len(got), dtype=object))
        return got

    return frames.select(*keys, F.col("frame_idx").cast("long").alias("frame_idx"), _strength(column).alias("x")).groupBy(*keys).applyInPandas(run, schema)


def beat_periods(frames: DataFrame, keys: list[str], column: str = "onset", rate: float = RATE) -> DataFrame:
    """(keys, period, tempo): frames between beats and beats a minute, one digit; both 0 where none can be told."""

    def rows(_: np.ndarray, x: np.ndarray) -> list[list]:
        period = beat_period(x, rate)
        return [[period], [round(60 * rate / period, 1) if period else 0.0]]

    return _per_key(frames, keys, column, "period int, tempo double", rows)


def track_beats(frames: DataFrame, keys: list[str], column: str = "onset", rate: float = RATE) -> DataFrame:
    """(keys, idx, frame_idx, t_sec) of beats in frames (keys, frame_idx, column), a row per frame.

    The keys are those of a riff, which is a minute at most, so a group is some 2,600 rows. A riff without a period or
    with even strengths has no rows.
    """

    def rows(frame: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        at = frame[beats_of(x, beat_period(x, rate))]
        return [np.arange(len(at)), at, at / rate]

    return _per_key(frames, keys, column, "idx long, frame_idx long, t_sec double", rows)
