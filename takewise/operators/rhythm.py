"""Rhythm of riffs: beat-aligned patterns, tempo, fallbacks and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takewise.functions import arrays

EMPTY = "array<double>"


def assign_beats(frames: DataFrame, beats: DataFrame, keys: list[str]) -> DataFrame:
    """frames (keys, t_sec, ...) with beat_idx, the beat each lies on; frames before the first or from the last beat on are dropped.

    The last beat before a frame is carried along by one window over both tables, not found by a join on ranges.
    """
    last = beats.groupBy(*keys).agg(F.max("t_sec").alias("__end"))
    both = frames.withColumn("__beat", F.lit(None).cast("long")).unionByName(beats.select(*keys, "t_sec", F.col("idx").cast("long").alias("__beat")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("t_sec", F.col("__beat").isNull())
    got = both.withColumn("beat_idx", F.last("__beat", True).over(order)).where("__beat IS NULL AND beat_idx IS NOT NULL")
    return got.join(last, keys).where(F.col("t_sec") < F.col("__end")).drop("__beat", "__end")


def beat_pattern(assigned: DataFrame, keys: list[str], column: str, slots: int = 16) -> DataFrame:
    """(keys, pattern, uniformity): the mean of the beats' shapes of slots points, each relative to its peak, and how even it is."""
    beats = assigned.groupBy(*keys, "beat_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_sec", F.col(column).cast("double").alias("x")))), lambda s: s["x"]).alias("v"))
    shape = arrays.let(arrays.resampled(F.col("v"), slots), lambda r: F.transform(r, lambda x: F.when(F.array_max(r) > 1e-8, x / F.array_max(r)).otherwise(x)))
    points = beats.select(*keys, F.posexplode(shape).alias("slot", "x")).groupBy(*keys, "slot").agg(F.avg("x").alias("x"))
    whole = points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "x"))), lambda s: s["x"]).alias("p"))
    even = F.when(arrays.mean(F.col("p")) > 1e-8, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - arrays.spread(F.col("p")) / arrays.mean(F.col("p"))))).otherwise(0.5)
    return whole.select(*keys, arrays.rounded(F.col("p")).alias("pattern"), F.round(even, 4).alias("uniformity"))


def tempo_from_beats(beats: DataFrame, keys: list[str]) -> DataFrame:
    """Beats a minute by the median gap, one digit; 0 for fewer than two beats."""
    gap = F.lead("t_sec").over(Window.partitionBy(*keys).orderBy("idx")) - F.col("t_sec")
    return beats.withColumn("gap", gap).groupBy(*keys).agg(F.percentile("gap", 0.5).alias("m")).select(*keys, F.when(F.col("m") > 0, F.round(60 / F.col("m"), 1)).otherwise(0.0).alias("tempo"))


def spectral_mean(frames: DataFrame, keys: list[str], column: str = "contrast") -> DataFrame:
    points = frames.select(*keys, F.posexplode(column).alias("band", "x")).groupBy(*keys, "band").agg(F.round(F.avg("x"), 4).alias("x"))
    return points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "x"))), lambda s: s["x"]).alias("spectral"))


def ioi_histogram(onsets: DataFrame, keys: list[str], bins: int = 39, width: float = 0.05) -> DataFrame:
    """(keys, groove): the density of gaps between onsets in bins from 0 on, the last one closed; for three onsets or more."""
    w = Window.partitionBy(*keys)
    gaps = onsets.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("gap", F.lead("t_sec").over(w.orderBy("idx")) - F.col("t_sec")).where("n > 2 AND gap IS NOT NULL")
    at = F.when(F.col("gap") <= bins * width, F.least(F.floor(F.col("gap") / width), F.lit(bins - 1))).cast("int")
    held = gaps.withColumn("bin", F.when(at.between(0, bins - 1), at)).groupBy(*keys).agg(*[F.count(F.when(F.col("bin") == b, 1)).alias(f"b{b}") for b in range(bins)], F.count("bin").alias("many"))
    return held.select(*keys, F.array(*[F.when(F.col("many") > 0, F.round(F.col(f"b{b}") / (F.col("many") * width), 4)).otherwise(F.lit(0.0)) for b in range(bins)]).alias("groove"))


def onset_autocorr(values: Column, lags: int = 40) -> Column:
    """The autocorrelation of onset strengths at the first lags, relative to lag 0; empty for four values or fewer."""

    def at(lag: Column) -> Column:
        return F.aggregate(F.zip_with(F.slice(values, F.lit(1), F.size(values) - lag), F.slice(values, lag + 1, F.size(values) - lag), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    scaled = arrays.let(at(F.lit(0)), lambda zero: F.transform(F.sequence(F.lit(0), F.least(F.lit(lags), F.size(values)) - 1), lambda k: F.round(F.when(zero > 0, at(k) / zero).otherwise(at(k)), 4)))
    return F.when(F.size(values) > 4, scaled).otherwise(F.array().cast(EMPTY))


def choose_fingerprint(riffs: DataFrame, aligned: DataFrame, fallback: DataFrame, keys: list[str], least_beats: int = 4, least_sec: float = 1) -> DataFrame:
    """riffs (keys, n_beats, duration_sec) with fingerprint columns and degraded.

    aligned and fallback hold (keys, groove, drums, spectral, tempo, onset_uniformity). Fewer than least_beats beats take
    the fallback, with uniformity 0.5; a riff under least_sec has an empty fingerprint.
    """
    fields = ["groove", "drums", "spectral", "tempo", "onset_uniformity"]
    side = lambda df, p: df.select(*keys, *[F.col(f).alias(f"{p}_{f}") for f in fields])
    j = riffs.join(side(aligned, "a"), keys, "left").join(side(fallback, "b"), keys, "left")
    short, few = F.col("duration_sec") < least_sec, F.coalesce("n_beats", F.lit(0)) < least_beats
    empty = F.array().cast(EMPTY)
    out = {f: F.when(short, empty).when(few, F.coalesce(f"b_{f}", empty)).otherwise(F.coalesce(f"a_{f}", empty)) for f in fields[:3]}
    out["tempo"] = F.when(short, 0.0).when(few, F.coalesce("b_tempo", F.lit(0.0))).otherwise(F.coalesce("a_tempo", F.lit(0.0)))
    out["onset_uniformity"] = F.when(short | few, 0.5).otherwise(F.coalesce("a_onset_uniformity", F.lit(0.5)))
    return j.select(*[c for c in riffs.columns], *[v.alias(k) for k, v in out.items()], (few & ~short).alias("degraded"))


def processing_flags(riffs: DataFrame, no_beat_model: bool = False, reprocess: bool = False) -> DataFrame:
    """(recording_id, processing_flags): the distinct shortcomings of a recording's riffs in order of text.

    riffs: recording_id, riff_index, degraded, method, groove. Reprocessing doesn't report an empty groove.
    """
    name = lambda what: F.concat(F.lit("riff_"), F.col("riff_index").cast("string"), F.lit(f":{what}"))
    found = [F.when(F.col("degraded"), name("fallback_fingerprint")), F.when(F.col("method") == "none", name("no_contour"))]
    if not reprocess:
        found.append(F.when(F.coalesce(F.size("groove"), F.lit(0)) < 1, name("empty_groove")))
    if no_beat_model:
        found.append(F.lit("no_madmom:librosa_beat_tracking"))
    flags = riffs.select("recording_id", F.explode_outer(F.array_compact(F.array(*found))).alias("flag"))
    return flags.groupBy("recording_id").agg(F.array_sort(F.collect_set("flag")).alias("processing_flags"))


def overall_tempo(riffs: DataFrame) -> DataFrame:
    """The mean of a recording's known tempos, one digit; null if none is known."""
    return riffs.groupBy("recording_id").agg(F.round(F.avg(F.when(F.col("tempo") > 0, F.col("tempo"))), 1).alias("tempo"))
