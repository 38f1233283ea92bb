"""Onsets and beats against plain versions, and from sound to trimming and rhythm."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from takewise.operators import frames as fr
from takewise.operators import onsets, rhythm, trim

SCHEMA = "recording_id string, frame_idx long, onset double"


def plain_onsets(x: list[float]) -> list[int]:
    """One frame after another: the highest of two, over the mean of nine by 0.07 of the range, two after the last."""
    low, high = min(x), max(x)
    y = [(v - low) / (high - low) if high > low else 0.0 for v in x]
    got: list[int] = []
    for n, v in enumerate(y):
        near = y[max(0, n - 4) : n + 5]
        if v == max(y[max(0, n - 1) : n + 1]) and v >= sum(near) / len(near) + 0.07 and not (got and n - got[-1] <= 1):
            got.append(n)
    return got


def strengths() -> dict[str, list[float]]:
    rng = np.random.default_rng(3)
    got = {f"r{k}": rng.gamma(0.5, 1.0, 120 + k).tolist() for k in range(4)}
    got["steps"] = [float(v // 3) for v in range(40)] + [0.0] * 20 + [float(v) for v in range(30)]  # ties and chains
    got["two values"] = rng.integers(0, 2, 90).astype(float).tolist()
    return got | {"even": [2.0] * 50, "one": [1.0], "low": [0.0] * 30 + [-5.0] + [0.0] * 30}


def test_onsets_one_after_another(spark):
    data = strengths()
    rows = [(k, i, v) for k, x in data.items() for i, v in enumerate(x)]
    got = onsets.pick_onsets(spark.createDataFrame(rows, SCHEMA).repartition(5), ["recording_id"]).collect()
    for k, x in data.items():
        own = sorted((r.idx, r.frame_idx, r.t_sec) for r in got if r.recording_id == k)
        want = plain_onsets(x)
        assert [f for _, f, _ in own] == want, k
        assert [i for i, _, _ in own] == list(range(len(want)))
        assert all(t == pytest.approx(f * 512 / 22050) for _, f, t in own)
    assert len({r.recording_id for r in got}) >= 6


def test_onsets_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert onsets.pick_onsets(none, ["recording_id"]).count() == 0
    assert onsets.track_beats(none, ["recording_id"]).count() == 0
    missing = spark.createDataFrame([("a", i, None if i % 2 else math.nan) for i in range(40)], SCHEMA)
    assert onsets.pick_onsets(missing, ["recording_id"]).count() == 0
    assert onsets.track_beats(missing, ["recording_id"]).count() == 0
    assert [(r.period, r.tempo) for r in onsets.beat_periods(missing, ["recording_id"]).collect()] == [(0, 0.0)]


@pytest.mark.parametrize("period", [2, 3, 4])
def test_scores_are_those_of_the_best_series(period):
    """All series of beats of 11 frames, each weighed by itself."""
    rng = np.random.default_rng(period)
    for _ in range(4):
        local = rng.normal(0.5, 1.0, 11)
        best = np.full(11, -np.inf)
        for many in range(1, 12):
            for at in itertools.combinations(range(11), many):
                gaps = np.diff(at)
                if all(max(1, round(period / 2)) <= g <= 2 * period for g in gaps):
                    best[at[-1]] = max(best[at[-1]], local[list(at)].sum() - 2.0 * (np.log(gaps / period) ** 2).sum())
        total, link = onsets.beat_scores(local, period, 2.0)
        assert np.allclose(total, best)
        for t in range(11):
            series = [t]
            while link[series[-1]] >= 0:
                series.append(link[series[-1]])
            gaps = -np.diff(series)
            assert local[series].sum() - 2.0 * (np.log(gaps / period) ** 2).sum() == pytest.approx(total[t])


def test_beats_bridge_a_missing_one():
    x = np.random.default_rng(1).random(400) * 0.1
    x[7:400:20] = 3.0
    x[207] = 0.0
    assert onsets.beat_period(x) == 20
    every = list(range(7, 400, 20))
    assert onsets.beats_of(x, 20).tolist() == every[:-1]  # the weak top at the end is reached past the last beat
    assert onsets.beats_of(x[:390], 20).tolist() == every
    x[:100] = 0.0  # silence before the music has no beats
    assert onsets.beats_of(x[:390], 20).tolist()[0] >= 87


def test_from_sound_to_trimming_and_rhythm(spark):
    """Clicks every 22 hops, cut into chunks: onsets and beats lie as far apart, and the operators behind take them."""
    x = np.random.default_rng(5).normal(0, 1e-4, 1000 * fr.HOP).astype(np.float32)
    for at in range(30 * fr.HOP, len(x) - 400, 22 * fr.HOP):
        x[at : at + 400] += np.float32(0.5) * np.sin(np.arange(400) * 0.3).astype(np.float32)
    chunk, halo = 250 * fr.HOP, fr.WINDOW - fr.HOP
    parts = [("a", 22050, s, x[s : s + chunk + halo].tolist(), x[max(0, s - fr.HOP) : s].tolist()) for s in range(0, len(x), chunk)]
    audio = spark.createDataFrame(parts, "recording_id string, sr int, first long, samples array<float>, before array<float>")
    frames = fr.frame_features(audio).cache()
    picked = onsets.pick_onsets(frames, ["recording_id"]).cache()
    strong = {r.frame_idx for r in picked.collect()}
    first = min(f for f in strong if f > 20)
    assert {f for f in range(first, 950, 22)} <= strong
    length = spark.createDataFrame([("a", len(x) / 22050)], "recording_id string, duration_sec double")
    clicks = picked.where((F.col("frame_idx") - first) % 22 == 0).withColumn("idx", F.floor((F.col("frame_idx") - first) / 22))
    cut = trim.rhythmic_regularity(clicks, length, least_sec=5).first()
    assert cut.confidence == pytest.approx(0.85)  # all gaps are equal, so any click may be the start
    assert (cut.start_sec * 22050 / 512 - first) % 22 == pytest.approx(0, abs=1e-6)
    beats = onsets.track_beats(frames, ["recording_id"]).cache()
    at = [r.frame_idx for r in beats.orderBy("idx").collect()]
    assert len(at) > 35 and all(abs(b - a - 22) <= 1 for a, b in zip(at, at[1:]))
    assert rhythm.tempo_from_beats(beats, ["recording_id"]).first().tempo == pytest.approx(117.5)
    assigned = rhythm.assign_beats(frames.select("recording_id", "t_sec", "onset"), beats.select("recording_id", "idx", "t_sec"), ["recording_id"])
    assert rhythm.beat_pattern(assigned, ["recording_id"], "onset").first().uniformity < 0.5
    assert len(rhythm.ioi_histogram(picked, ["recording_id"]).first().groove) == 39
    for df in (frames, picked, beats):
        df.unpersist()
