"""Samples to frames: loudness, spectra and their percussive part."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takewise.session import checkpoint
from takewise.sources.audio import LEAD

HOP, WINDOW = LEAD, 2048
_SCHEMA = "recording_id string, frame_idx long, t_sec double, rms double, flatness double, onset double, centroid double, rolloff double, contrast array<double>"


#: Points of an impulse response, well within which the filters die out.
_RESPONSE = 4096


def _impulse(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The impulse response of a filter of second order."""
    h, y1, y2 = np.zeros(_RESPONSE), 0.0, 0.0
    for i in range(_RESPONSE):
        y = (b[i] if i < 3 else 0.0) - a[1] * y1 - a[2] * y2
        h[i], y2, y1 = y, y1, y
    return h


@lru_cache(maxsize=64)
def _response(sr: int, n: int) -> np.ndarray:
    """What the transform of n samples is multiplied by to pass both filters of ITU-R BS.1770: worked out once a rate and length."""
    out = np.ones(n // 2 + 1, complex)
    for kind, f, gain, q in (("shelf", 1681.974450955533, 3.999843853973347, 0.7071752369554196), ("high", 38.13547087602444, 0.0, 0.5003270373238773)):
        k = np.tan(np.pi * f / sr)
        a0 = 1 + k / q + k * k
        a = np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
        if kind == "shelf":
            vh = 10 ** (gain / 20)
            vb = vh**0.4996667741545416
            b = np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a0
        else:
            b = np.array([1.0, -2.0, 1.0])
        out = out * np.fft.rfft(_impulse(b, a), n)
    return out


def k_weighted(x: np.ndarray, sr: int) -> np.ndarray:
    """The two filters of ITU-R BS.1770: a shelf for the head and a high pass, for any sampling rate."""
    least = len(x) + 2 * _RESPONSE
    n = min(m << max(0, int(np.ceil(np.log2(least / m)))) for m in (4, 5, 6))  # lengths that transform fast
    return np.fft.irfft(np.fft.rfft(x, n) * _response(sr, n), n)[: len(x)]


def loudness_gain(audio: DataFrame, target: float = -14.0) -> DataFrame:
    """(recording_id, loudness, gain): integrated loudness in LUFS and the factor that brings it to target.

    Blocks of 0.4 s, three quarters overlapping, pass a gate at -70 and one 10 below the mean of what passed; a silent
    recording has null loudness and gain 1. audio's chunks must run 0.4 s or more into the next one. Samples are read
    once and don't travel: of a block in two chunks the power in the later one counts, and blocks alone are shuffled and
    written to the shared checkpoint folder.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rate, first, samples = (part.column(c) for c in ("sr", "first", "samples"))
            at, chunk, power, row = [], [], [], []
            for i in range(part.num_rows):
                sr, begin = rate[i].as_py(), first[i].as_py()
                x, step = k_weighted(samples[i].values.to_numpy(zero_copy_only=False).astype(float), sr), int(0.1 * sr)
                starts = range((-begin) % step, len(x) - 4 * step + 1, step)
                at += [begin + s for s in starts] or [None]
                power += [float(np.mean(x[s : s + 4 * step] ** 2)) for s in starts] or [None]
                row += [i] * max(1, len(starts))
            yield pa.RecordBatch.from_arrays([part.column("recording_id").take(pa.array(row, pa.int64())), pa.array(at, pa.int64()), first.take(pa.array(row, pa.int64())).cast(pa.int64()), pa.array(power, pa.float64())], ["recording_id", "at", "first", "power"])

    kind = audio.schema["recording_id"].dataType.simpleString()
    found = audio.select("recording_id", "sr", "first", "samples").mapInArrow(run, f"recording_id {kind}, at long, first long, power double")
    power = checkpoint(found.groupBy("recording_id", "at").agg(F.max_by("power", "first").alias("power")))
    level = lambda p: -0.691 + 10 * F.log10(p)
    loud = power.where("power > 0").where(level(F.col("power")) > -70)
    gate = loud.groupBy("recording_id").agg((level(F.avg("power")) - 10).alias("gate"))
    got = loud.join(gate, "recording_id").where(level(F.col("power")) > F.col("gate")).groupBy("recording_id").agg(level(F.avg("power")).alias("loudness"))
    return power.select("recording_id").distinct().join(got, "recording_id", "left").select("recording_id", "loudness", F.coalesce(F.pow(F.lit(10.0), (F.lit(target) - F.col("loudness")) / 20), F.lit(1.0)).alias("gain"))


def apply_gain(audio: DataFrame, gains: DataFrame) -> DataFrame:
    """Samples times the gain, clipped to -1 to 1."""
    louder = lambda c: F.transform(c, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * F.col("gain"))).cast("float"))
    return audio.join(gains.select("recording_id", "gain"), "recording_id").select(*[louder(c).alias(c) if c in ("samples", "before") else F.col(c) for c in audio.columns])


def spectra(x: np.ndarray) -> np.ndarray:
    """Magnitudes of the windows of x that start a hop apart."""
    if len(x) < WINDOW:
        x = np.pad(x, (0, WINDOW - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(WINDOW + 1)[:-1], axis=1))


def _level(s: np.ndarray) -> np.ndarray:
    """10 log10 of the power, from -100 on; logarithms are taken of what exceeds that."""
    power = np.square(s)
    out, heard = np.full(s.shape, 10 * np.log10(1e-10)), ~(power <= 1e-10)
    out[heard] = 10 * np.log10(power[heard])
    return out


def _onset(s: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Onset strength of each spectrum, the first one against before or itself."""
    level = _level(s)
    return np.maximum(0, np.diff(np.concatenate([level[:1] if before is None else _level(before[None, :]), level]), axis=0)).mean(1)


def _middle(s: np.ndarray, sr: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and half-energy rolloff of each spectrum."""
    freq, total = np.fft.rfftfreq(WINDOW, 1 / sr), s.sum(1)
    centroid = np.where(total > 0, (s * freq).sum(1) / np.where(total > 0, total, 1), 0.0)
    return centroid, freq[np.minimum((np.cumsum(s, axis=1) < 0.5 * total[:, None]).sum(1), len(freq) - 1)]


def features(s: np.ndarray, sr: int, before: np.ndarray | None = None) -> dict[str, np.ndarray | list]:
    """Flatness, onset strength, centroid, half-energy rolloff and contrast of seven bands for each spectrum."""
    freq, power = np.fft.rfftfreq(WINDOW, 1 / sr), s**2
    onset, (centroid, rolloff) = _onset(s, before), _middle(s, sr)
    flatness = np.exp(np.mean(np.log(np.maximum(power, 1e-10)), axis=1)) / np.maximum(np.mean(np.maximum(power, 1e-10), axis=1), 1e-10)
    edges, bands = [0, *(200 * 2**k for k in range(6)), sr / 2 + 1], []
    for lo, hi in zip(edges, edges[1:]):
        band = np.sort(s[:, (freq >= lo) & (freq < hi)], axis=1)
        k = max(1, int(0.02 * band.shape[1]))
        bands.append(10 * np.log10(np.maximum(1e-10, band[:, -k:].mean(1))) - 10 * np.log10(np.maximum(1e-10, band[:, :k].mean(1))) if band.shape[1] else np.zeros(len(s)))
    return {"flatness": flatness, "onset": onset, "centroid": centroid, "rolloff": rolloff, "contrast": list(np.stack(bands, 1))}


def frame_features(audio: DataFrame) -> DataFrame:
    """A row per frame of HOP samples, from chunks that run WINDOW - HOP samples into the next; a map without a shuffle.

    A chunk's first frame is compared with the one before it, of which the chunk carries what it needs in before, so no
    value depends on where chunks begin. A recording shorter than a window is one frame, filled with zeros; a last chunk shorter than that has none of its own.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, rate, begin, samples, lead = (part.column(c) for c in ("recording_id", "sr", "first", "samples", "before"))
            for i in range(part.num_rows):
                x, sr, at = samples[i].values.to_numpy(zero_copy_only=False).astype(float), rate[i].as_py(), begin[i].as_py()
                if at and len(x) < WINDOW:
                    continue
                s, first = spectra(x), at // HOP
                before = spectra(np.concatenate([lead[i].values.to_numpy(zero_copy_only=False).astype(float), x[: WINDOW - HOP]]))[0] if at else None
                windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, max(0, WINDOW - len(x)))), WINDOW)[::HOP]
                index = np.arange(first, first + len(s))
                made = {"frame_idx": index, "t_sec": index * HOP / sr, "rms": np.sqrt((windows**2).mean(1)), **features(s, sr, before)}
                bands = np.stack(made.pop("contrast"))
                contrast = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1]), pa.int32()), pa.array(bands.ravel()))
                names = [f.split()[0] for f in _SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(s), i))).cast(pa.string()), *[pa.array(made[n]) for n in names[1:-1]], contrast], names)

    return audio.select("recording_id", "sr", "first", "samples", "before").mapInArrow(run, _SCHEMA)


#: Values of the windows of which medians are found at once.
_CELLS = 1 << 17


def _median(s: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Medians of the windows of size values around each, s mirrored at its ends: of an odd number the one in the middle,
    some rows of windows at a time."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (size // 2, size - size // 2 - 1)
    wide = np.pad(s, pad, mode="symmetric")
    if size % 2 == 0 or not np.isfinite(s).all():
        return np.median(np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis), axis=-1)
    windows = np.lib.stride_tricks.sliding_window_view(wide if axis else np.ascontiguousarray(wide.T), size, axis=1)
    out, step = np.empty(windows.shape[:2]), max(1, _CELLS // (windows.shape[1] * size))
    for at in range(0, len(windows), step):
        out[at : at + step] = np.partition(windows[at : at + step], size // 2, axis=-1)[..., size // 2]
    return out if axis else out.T


def hpss_features(riffs: DataFrame, margin: float = 3.0, size: int = 31) -> DataFrame:
    """(recording_id, riff_index, frame_idx, onset_perc, centroid, rolloff) of riffs (recording_id, riff_index, sr, samples),
    a row each; samples don't travel.

    The harmonic part of a spectrum is what medians along time exceed those along frequency by margin, the percussive
    part the other way round; each part's features come from its masked spectrum. A riff is a minute at most.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, index, rate, samples = (part.column(c) for c in ("recording_id", "riff_index", "sr", "samples"))
            for i in range(part.num_rows):
                s = spectra(samples[i].values.to_numpy(zero_copy_only=False).astype(float))
                harmonic, percussive = _median(s, size, 0), _median(s, size, 1)
                centroid, rolloff = _middle(s * (harmonic > margin * percussive), rate[i].as_py())
                at = pa.array(np.full(len(s), i))
                yield pa.RecordBatch.from_arrays([ids.take(at).cast(pa.string()), index.take(at).cast(pa.int32()), pa.array(np.arange(len(s))), pa.array(_onset(s * (percussive > margin * harmonic))), pa.array(centroid), pa.array(rolloff)], ["recording_id", "riff_index", "frame_idx", "onset_perc", "centroid", "rolloff"])

    return riffs.select("recording_id", "riff_index", "sr", "samples").mapInArrow(run, "recording_id string, riff_index int, frame_idx long, onset_perc double, centroid double, rolloff double")
