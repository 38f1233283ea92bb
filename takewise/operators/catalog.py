"""Lists and lookups over songs, recordings, sets, riffs and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the user sees for a state, and the states of work in progress in order.
BADGES = {"uploading": "Uploading…", "normalizing": "Normalizing…", "trimming": "Trimming…", "analyzing": "Analyzing…", "grouped": "✓ Grouped", "ungrouped": "Unsorted", "reprocess": "Reprocessing…", "ready": "✓ Ready"}
IN_WORK = [("song", "uploading"), ("song", "normalizing"), ("song", "trimming"), ("song", "analyzing"), ("set", "uploading"), ("set", "normalizing")]
SONG_ONLY = ["song_id", "path_flac", "path_song", "cut_start_sec", "cut_end_sec", "trim_confidence", "trim_method"]
STATES = {"song": ["uploading", "normalizing", "trimming", "analyzing", "grouped", "ungrouped", "reprocess"], "set": ["uploading", "normalizing", "ready"]}


def by_id(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; none when it is missing."""
    return table.where(F.col(key) == F.lit(value))


def list_by_state(recordings: DataFrame, kind: str, state: str, newest_first: bool = False) -> DataFrame:
    order = F.desc("creation_time") if newest_first else F.asc("creation_time")
    return recordings.where((F.col("kind") == kind) & (F.col("state") == state)).orderBy(order, "recording_id")


def list_ungrouped(recordings: DataFrame) -> DataFrame:
    return list_by_state(recordings, "song", "ungrouped", newest_first=True)


def list_ready_sets(recordings: DataFrame) -> DataFrame:
    return list_by_state(recordings, "set", "ready", newest_first=True)


def list_processing(recordings: DataFrame) -> DataFrame:
    """Recordings in work with stage, the place of their state in the order of the list."""
    place = F.lit(None).cast("int")
    for i, (kind, state) in reversed(list(enumerate(IN_WORK))):
        place = F.when((F.col("kind") == kind) & (F.col("state") == state), i).otherwise(place)
    return recordings.withColumn("stage", place).where(F.col("stage").isNotNull()).orderBy("stage", "creation_time", "recording_id")


def list_flagged(recordings: DataFrame) -> DataFrame:
    return recordings.where(F.coalesce(F.size("processing_flags"), F.lit(0)) > 0)


def songs_with_takes(songs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Every song with takes, an array of its recordings, newest first; empty for a song without."""
    takes = recordings.where(F.col("song_id").isNotNull()).groupBy("song_id").agg(F.collect_list(F.struct((-F.unix_micros("creation_time")).alias("o"), "recording_id", "filename")).alias("t"))
    listed = F.transform(F.array_sort("t"), lambda x: F.struct(x["recording_id"].alias("recording_id"), x["filename"].alias("filename")))
    joined = songs.join(takes, "song_id", "left")
    return joined.withColumn("takes", F.coalesce(listed, F.array().cast("array<struct<recording_id:bigint,filename:string>>"))).drop("t")


def song_with_takes(songs: DataFrame, recordings: DataFrame, song_id: str) -> DataFrame:
    return songs_with_takes(songs.where(F.col("song_id") == song_id), recordings.where(F.col("song_id") == song_id))


def dashboard_songs(songs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Per song: number of takes, date of the latest and its audio (the cut song, else the whole file)."""
    own = recordings.where("kind = 'song' AND song_id IS NOT NULL")
    latest = F.max_by(F.struct(F.coalesce("path_song", "path_flac").alias("audio"), F.col("creation_time").alias("at")), F.struct("creation_time", "recording_id"))
    takes = own.groupBy("song_id").agg(F.count(F.lit(1)).alias("take_count"), latest.alias("last"))
    return songs.join(takes, "song_id", "left").select("song_id", "title", F.coalesce("take_count", F.lit(0)).alias("take_count"), F.date_format("last.at", "MMM d").alias("latest_date"), F.col("last.audio").alias("latest_audio"))


def processing_banner(recordings: DataFrame) -> DataFrame:
    """One row with the text of the banner; none when nothing is in work."""
    n = list_processing(recordings).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return n.select("n", F.concat(F.lit("Analyzing... "), F.col("n").cast("string"), F.when(F.col("n") == 1, " recording remaining").otherwise(" recordings remaining")).alias("text"))


def take_numbers(recordings: DataFrame) -> DataFrame:
    """Takes of each song, numbered from 1 for the newest."""
    order = Window.partitionBy("song_id").orderBy(F.desc("creation_time"), F.desc("recording_id"))
    return recordings.where("kind = 'song' AND song_id IS NOT NULL").withColumn("take_number", F.row_number().over(order))


def trim_review(recordings: DataFrame) -> DataFrame:
    """What a reviewer of a cut sees: the band of its confidence, whether there is one, was undone, and what lies before it."""
    confidence = F.coalesce("trim_confidence", F.lit(0.0))
    band = F.when(confidence < 0.6, "low").when(confidence < 0.85, "medium").otherwise("high")
    has = F.col("cut_start_sec").isNotNull() & F.col("cut_end_sec").isNotNull()
    undone = ~has & F.col("saved_cut_start_sec").isNotNull() & F.col("saved_cut_end_sec").isNotNull()
    return recordings.where("kind = 'song'").select("recording_id", band.alias("band"), has.alias("has_trim"), undone.alias("trim_undone"), F.floor(F.coalesce("cut_start_sec", F.lit(0.0)) + 0.5).cast("long").alias("pre_seconds"), ((band == "low") & has).alias("auto_expand"))


def minutes(seconds: Column) -> Column:
    """m:ss with rounded seconds, so that :60 can occur; empty for nothing."""
    rest = F.floor(seconds % 60 + 0.5).cast("long").cast("string")
    return F.when(seconds.isNull() | (seconds == 0), "").otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.when(F.length(rest) < 2, F.concat(F.lit("0"), rest)).otherwise(rest)))


def recording_cards(recordings: DataFrame) -> DataFrame:
    processing = F.col("state").isin(*[s for _, s in IN_WORK])
    name = F.regexp_replace("filename", r"^(.*?)\.wav(.*)$", "$1$2")
    return recordings.select("recording_id", processing.alias("processing"), F.coalesce("path_song", "path_flac").alias("audio"), minutes(F.col("duration_sec")).alias("duration"), F.floor(F.col("tempo") + 0.5).cast("long").alias("bpm"), F.concat(name, F.lit(".flac")).alias("download_name"))


def state_badge(state: Column) -> Column:
    out = state
    for key, label in BADGES.items():
        out = F.when(state == key, label).otherwise(out)
    return out


def validate_recordings(recordings: DataFrame) -> DataFrame:
    """(recording_id, reason) for each rule of the two kinds of recordings that a row breaks."""
    reasons = [F.when(~F.col("kind").isin("song", "set") | F.col("kind").isNull(), "unknown kind")]
    for kind, states in STATES.items():
        reasons.append(F.when((F.col("kind") == kind) & (F.col("state").isNull() | ~F.col("state").isin(*states)), f"state not legal for a {kind}"))
    present = [F.col(c).isNotNull() for c in SONG_ONLY if c in recordings.columns]
    some = present[0]
    for p in present[1:]:
        some = some | p
    reasons.append(F.when((F.col("kind") == "set") & some, "song field on a set"))
    reasons.append(F.when((F.col("kind") == "song") & F.col("set_id").isNotNull(), "set field on a song"))
    return recordings.select("recording_id", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def matches_for_riff(matches: DataFrame, riff_id) -> DataFrame:
    """Matches in which a riff stands first, then those in which it stands second; side tells which."""
    a = matches.where(F.col("riff_a_id") == riff_id).withColumn("side", F.lit("a"))
    return a.unionByName(matches.where(F.col("riff_b_id") == riff_id).withColumn("side", F.lit("b")))


def active_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.where(~F.coalesce("dismissed", F.lit(False)))


def warning(warnings: DataFrame, key: str) -> DataFrame:
    return warnings.where(F.col("key") == key).limit(1)


def set_detail(sets: DataFrame, recordings: DataFrame, markers: DataFrame) -> DataFrame:
    """Each set with its recordings and its markers in order of time."""
    held = recordings.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("uploaded_at", "recording_id"))).alias("recordings"))
    marks = markers.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("start_sec", "label"))).alias("markers"))
    return sets.join(held, "set_id", "left").join(marks, "set_id", "left")


def set_numbering(sets: DataFrame) -> DataFrame:
    """The name of each set: its UTC date, with a number by time where a date has several."""
    day = F.to_date("recorded_at")
    w = Window.partitionBy(day)
    k = F.row_number().over(w.orderBy("recorded_at", "set_id"))
    name = F.date_format("recorded_at", "yyyy-MM-dd")
    return sets.select("set_id", F.when(F.count(F.lit(1)).over(w) > 1, F.concat(name, F.lit(" — Set "), k.cast("string"))).otherwise(name).alias("name"))
