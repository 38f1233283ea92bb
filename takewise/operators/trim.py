"""Where the music starts and ends in a recording, from its frames and onsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by() -> WindowSpec:
    return Window.partitionBy("recording_id")


def ordered() -> WindowSpec:
    return by().orderBy("frame_idx")


CANDIDATE = ["recording_id", "start_sec", "end_sec", "confidence", "method"]
#: The order of the detectors, which decides between equals.
DETECTORS = ["energy_wall", "rhythmic_regularity", "pitched_content"]


def smooth_same(frames: DataFrame, column: str, k: int, out: str = "smooth") -> DataFrame:
    """A moving mean of k frames, the missing ones at the ends being 0; null in a recording of fewer than k frames."""
    window = ordered().rowsBetween(-(k // 2), k - k // 2 - 1)
    return frames.withColumn(out, F.when(F.count(F.lit(1)).over(by()) >= k, F.sum(column).over(window) / k))


def energy_wall(frames: DataFrame, k: int, frame_sec: float, least_sec: float = 15, column: str = "rms") -> DataFrame:
    """A start at the first rise of the first half that is over three times the median rise; the end at a fifth of the peak."""
    s = smooth_same(frames, column, k).where(F.col("smooth").isNotNull())
    s = s.withColumn("rise", F.lead("smooth").over(ordered()) - F.col("smooth")).withColumn("n", F.count(F.lit(1)).over(by()))
    limits = s.groupBy("recording_id").agg((3 * F.percentile(F.when(F.col("rise") > 0, F.col("rise")), 0.5)).alias("limit"), F.max("smooth").alias("peak"))
    s = s.join(limits, "recording_id")
    early = (F.col("rise") > F.col("limit")) & (F.col("frame_idx") < F.floor((F.col("n") - 1) / 2))
    first = F.min(F.when(early, F.struct("frame_idx", "rise")))
    got = s.where("n >= 10").groupBy("recording_id").agg(first.alias("a"), F.max(F.when(F.col("smooth") > 0.2 * F.col("peak"), F.col("frame_idx"))).alias("b"), F.first("limit").alias("limit"))
    got = got.select("recording_id", (F.col("a.frame_idx") * frame_sec).alias("start_sec"), (F.col("b") * frame_sec).alias("end_sec"), F.least(F.lit(1.0), F.col("a.rise") / (2 * F.col("limit")) * 0.9 + 0.1).alias("confidence"), F.lit("energy_wall").alias("method"))
    return got.where(F.col("end_sec") - F.col("start_sec") >= least_sec)


def rhythmic_regularity(onsets: DataFrame, durations: DataFrame, least_sec: float = 15, window: int = 8) -> DataFrame:
    """A start where eight onsets in a row are most regular; the end behind the last eight that still are."""
    order = by().orderBy("idx")
    g = onsets.withColumn("gap", F.lead("t_sec").over(order) - F.col("t_sec")).withColumn("n", F.count(F.lit(1)).over(by()))
    ahead = order.rowsBetween(0, window - 2)
    g = g.withColumn("mean", F.avg("gap").over(ahead)).withColumn("cv", F.stddev_pop("gap").over(ahead) / F.col("mean")).withColumn("after", F.lead("t_sec", window).over(order))
    usable = F.col("mean") >= 0.1
    start = F.min(F.when(usable & (F.col("idx") < F.col("n") - window), F.struct("cv", "idx", "t_sec")))
    end = F.max(F.when(usable & (F.col("idx") >= 1) & (F.col("idx") < F.col("n") - window) & (F.col("cv") < 0.5), F.struct("idx", "after")))
    got = g.where(F.col("n") >= window).groupBy("recording_id").agg(start.alias("a"), end.alias("b")).join(durations, "recording_id").where(F.col("a.cv") <= 0.4)
    got = got.select("recording_id", F.col("a.t_sec").alias("start_sec"), F.coalesce("b.after", "duration_sec").alias("end_sec"), ((1 - F.col("a.cv")) * 0.85).alias("confidence"), F.lit("rhythmic_regularity").alias("method"))
    return got.where(F.col("end_sec") - F.col("start_sec") >= least_sec)


def pitched_content(frames: DataFrame, k: int, frame_sec: float, run_frames: int, least_sec: float = 15, column: str = "flatness") -> DataFrame:
    """From the first to the last long run of frames whose smoothed flatness is below 0.7 of its median."""
    s = smooth_same(frames, column, k).where(F.col("smooth").isNotNull())
    middle = s.groupBy("recording_id").agg((0.7 * F.percentile("smooth", 0.5)).alias("limit"))
    s = s.join(middle, "recording_id").withColumn("tonal", F.col("smooth") < F.col("limit"))
    tonal = s.where("tonal").withColumn("island", F.col("frame_idx") - F.row_number().over(ordered()))
    runs = tonal.groupBy("recording_id", "island").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b")).where(F.col("b") - F.col("a") + 1 >= run_frames)
    ends = runs.groupBy("recording_id").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    inside = tonal.join(ends, "recording_id").where("frame_idx >= a AND frame_idx < b").groupBy("recording_id").agg(F.count(F.lit(1)).alias("many"))
    got = ends.join(inside, "recording_id", "left").select("recording_id", (F.col("a") * frame_sec).alias("start_sec"), (F.col("b") * frame_sec).alias("end_sec"), (0.8 * F.coalesce("many", F.lit(0)) / F.greatest(F.lit(1), F.col("b") - F.col("a"))).alias("confidence"), F.lit("pitched_content").alias("method"))
    return got.where(F.col("end_sec") - F.col("start_sec") >= least_sec)


def select_boundary(candidates: DataFrame, durations: DataFrame, viable: float = 0.3, early_sec: float = 5) -> DataFrame:
    """One boundary per recording: the whole of it without candidates; the earliest if another starts much later, else the surest."""
    rank = F.array_position(F.array(*map(F.lit, DETECTORS)), F.col("method"))
    c = candidates.withColumn("rank", rank).withColumn("ok", (F.col("confidence") >= viable).cast("int"))
    c = c.withColumn("some", F.max("ok").over(by())).where("ok = some")  # all, if none is viable
    whole = [F.col(x) for x in CANDIDATE[1:]]
    got = c.groupBy("recording_id").agg(
        F.min_by(F.struct(*whole), F.struct("start_sec", "rank")).alias("first"),
        F.min_by(F.struct(*whole), F.struct(-F.col("confidence"), F.col("start_sec"), F.col("rank"))).alias("sure"),
        (F.max("start_sec") - F.min("start_sec") > early_sec).alias("early"),
    )
    pick = F.when(F.col("early"), F.col("first")).otherwise(F.col("sure"))
    return durations.join(got.select("recording_id", pick.alias("p")), "recording_id", "left").select("recording_id", F.coalesce("p.start_sec", F.lit(0.0)).alias("start_sec"), F.coalesce("p.end_sec", "duration_sec").alias("end_sec"), F.coalesce("p.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("p.method", F.lit("none")).alias("method"))


def split_segments(trims: DataFrame, totals: DataFrame) -> DataFrame:
    """What to cut out: the song, and what lies before and after it if that is over a second; all within the file."""
    t = trims.join(totals, "recording_id")
    start = F.greatest(F.lit(0.0), F.least("start_sec", "total_sec"))
    end = F.greatest(start, F.least("end_sec", "total_sec"))
    part = lambda name, a, b: F.struct(F.lit(name).alias("part"), a.cast("double").alias("from_sec"), b.cast("double").alias("to_sec"))
    parts = F.array(part("pre", F.lit(0.0), start), part("song", start, end), part("post", end, F.col("total_sec")))
    got = t.select("recording_id", F.inline(parts)).where("part = 'song' OR to_sec - from_sec > 1")
    return got.withColumn("name", F.concat(F.col("recording_id").cast("string"), F.lit("_"), F.col("part"), F.lit(".opus")))
