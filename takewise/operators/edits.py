"""Edits in batch: an old table and a table of edits, in order of seq, make the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takewise.session import checkpoint

SET_KEEPS = ["recording_id", "creation_time", "filename", "file_hash", "uploaded_at"]


def _last(edits: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key with the columns of its last edit."""
    return edits.groupBy(key).agg(F.max_by(F.struct(*columns), "seq").alias("__e"))


def _changed(table: DataFrame, change: DataFrame, key: str, **new: Column) -> DataFrame:
    """table left-joined with a small change table (key, __e); the columns in new are computed where there is a change."""
    joined = table.join(change, key, "left")
    hit = F.col("__e").isNotNull()
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])


def update_state(recordings: DataFrame, patches: DataFrame) -> DataFrame:
    """Each field that patches supply takes its last value that isn't null; other fields stay."""
    fields = [c for c in patches.columns if c not in ("recording_id", "seq")]
    last = patches.groupBy("recording_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}") for c in fields])
    joined = recordings.join(last, "recording_id", "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in recordings.columns])


def classify_as_set(recordings: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recordings, errors): recordings that edits (recording_id, seq, duration_sec) name become sets and lose all song fields."""
    errors = edits.join(recordings, "recording_id", "left_anti").select("recording_id", F.lit("unknown recording").alias("error"))
    gone = {c: F.lit(None).cast(recordings.schema[c].dataType) for c in recordings.columns if c not in SET_KEEPS}
    new = gone | {"kind": F.lit("set"), "state": F.lit("normalizing"), "duration_sec": F.col("__e.duration_sec")}
    return _changed(recordings, _last(edits, "recording_id", "duration_sec"), "recording_id", **new), errors


def assign_to_song(recordings: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recordings, corrections, errors) of edits (recording_id, seq, song_id, at).

    The last assignment holds. A correction is logged for every edit of a recording that had a song or was ungrouped;
    the song before a second edit is that of the first. Sets and unknown recordings are errors.
    """
    known = recordings.select("recording_id", "kind", F.col("song_id").alias("old_song"), F.col("state").alias("old_state"))
    joined = edits.join(known, "recording_id", "left")
    errors = joined.where("kind IS NULL OR kind <> 'song'").select("recording_id", F.when(F.col("kind").isNull(), "unknown recording").otherwise("not a song").alias("error"))
    good = joined.where("kind = 'song'")
    order = Window.partitionBy("recording_id").orderBy("seq")
    before = F.coalesce(F.lag("song_id").over(order), F.col("old_song"))
    first = F.row_number().over(order) == 1
    logged = good.withColumn("from_song_id", before).withColumn("first", first).where(F.col("from_song_id").isNotNull() | (F.col("first") & (F.col("old_state") == "ungrouped")))
    corrections = logged.select("recording_id", "from_song_id", F.col("song_id").alias("to_song_id"), F.col("at").alias("corrected_at"))
    out = _changed(recordings, _last(good, "recording_id", "song_id"), "recording_id", state=F.lit("grouped"), song_id=F.col("__e.song_id"))
    return out, corrections, errors


def undo_trim(recordings: DataFrame, ids: DataFrame) -> DataFrame:
    """Cut points move to the saved ones, and cut and method are cleared."""
    change = ids.select("recording_id").distinct().withColumn("__e", F.struct(F.lit(1)))
    null = F.lit(None)
    return _changed(recordings, change, "recording_id", saved_cut_start_sec=F.col("cut_start_sec"), saved_cut_end_sec=F.col("cut_end_sec"), cut_start_sec=null.cast("double"), cut_end_sec=null.cast("double"), trim_method=null.cast("string"))


def restore_trim(recordings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recordings, errors): saved cut points come back, the method doesn't; both must be there."""
    ids = ids.select("recording_id").distinct()
    good = recordings.where("saved_cut_start_sec IS NOT NULL AND saved_cut_end_sec IS NOT NULL").join(ids, "recording_id", "left_semi").select("recording_id")
    errors = ids.join(good, "recording_id", "left_anti").withColumn("error", F.lit("nothing saved"))
    null = F.lit(None).cast("double")
    out = _changed(recordings, good.withColumn("__e", F.struct(F.lit(1))), "recording_id", cut_start_sec=F.col("saved_cut_start_sec"), cut_end_sec=F.col("saved_cut_end_sec"), saved_cut_start_sec=null, saved_cut_end_sec=null)
    return out, errors


def schedule_reprocess(recordings: DataFrame, riffs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recordings, riffs, errors): songs with a whole file go to reprocess and lose their riffs; matches are left as they are."""
    ids = ids.select("recording_id").distinct()
    good = recordings.where("kind = 'song' AND path_flac IS NOT NULL").join(ids, "recording_id", "left_semi").select("recording_id")
    errors = ids.join(good, "recording_id", "left_anti").withColumn("error", F.lit("no song with a whole file"))
    out = _changed(recordings, good.withColumn("__e", F.struct(F.lit(1))), "recording_id", state=F.lit("reprocess"))
    return out, riffs.join(good, "recording_id", "left_anti"), errors


def schedule_reprocess_flagged(recordings: DataFrame, riffs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recordings, riffs, count): all recordings with flags and a whole file, of any kind."""
    good = recordings.where((F.coalesce(F.size("processing_flags"), F.lit(0)) > 0) & F.col("path_flac").isNotNull()).select("recording_id")
    out = _changed(recordings, good.withColumn("__e", F.struct(F.lit(1))), "recording_id", state=F.lit("reprocess"))
    return out, riffs.join(good, "recording_id", "left_anti"), good.agg(F.count(F.lit(1)).alias("n"))


def set_processing_flags(recordings: DataFrame, edits: DataFrame) -> DataFrame:
    """The last array holds; an empty one clears the flags."""
    return _changed(recordings, _last(edits, "recording_id", "processing_flags"), "recording_id", processing_flags=F.col("__e.processing_flags"))


def create_songs(songs: DataFrame, new: DataFrame) -> DataFrame:
    return songs.unionByName(new, allowMissingColumns=True)


def rename(table: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Titles of songs or sets by the last edit (key, seq, title) that isn't blank, without outer blanks."""
    wanted = edits.withColumn("title", F.trim("title")).where("title <> ''")
    return _changed(table, _last(wanted, key, "title"), key, title=F.col("__e.title"))


def merge_songs(recordings: DataFrame, songs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recordings, songs): recordings of from_id go to into_id and from_id is deleted, edit by edit in order of seq.

    What went into a song goes on with the next later merge of that song; a merge that came before doesn't touch it. So
    each edit has at most one follower, of a later seq, and there are no cycles: A into B, then B into A, leaves all in
    A, though both songs are deleted. The chains are halved until all end, as many times as the logarithm of the longest.
    """
    steps = edits.where("from_id <> into_id AND seq IS NOT NULL").groupBy("from_id", "seq").agg(F.min("into_id").alias("into_id"))
    at = steps.select(F.col("from_id").alias("song"), "seq", F.lit(0).alias("side"), "from_id", "into_id")
    to = steps.select(F.col("into_id").alias("song"), "seq", F.lit(1).alias("side"), "from_id", "into_id")
    later = Window.partitionBy("song").orderBy("seq", "side").rowsBetween(1, Window.unboundedFollowing)
    follower = F.first(F.when(F.col("side") == 0, F.struct("from_id", "seq")), ignorenulls=True).over(later)
    chain = checkpoint(at.union(to).withColumn("next", follower).where("side = 1").select("from_id", "seq", "into_id", "next"))
    while chain.where("next IS NOT NULL").limit(1).count():
        b = chain.select(F.struct("from_id", "seq").alias("next"), F.col("into_id").alias("far"), F.col("next").alias("beyond"))
        chain = checkpoint(chain.join(b, "next", "left").select("from_id", "seq", F.coalesce("far", "into_id").alias("into_id"), F.col("beyond").alias("next")))
    first = chain.groupBy("from_id").agg(F.min_by("into_id", "seq").alias("into_id"))
    out = recordings.join(first, recordings.song_id == first.from_id, "left").select(*[F.coalesce("into_id", "song_id").alias(c) if c == "song_id" else F.col(c) for c in recordings.columns])
    return out, songs.join(first, songs.song_id == first.from_id, "left_anti")


def dissolve_songs(recordings: DataFrame, songs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recordings, songs): the songs go, their recordings are ungrouped."""
    change = ids.select("song_id").distinct().withColumn("__e", F.struct(F.lit(1)))
    out = _changed(recordings, change, "song_id", state=F.lit("ungrouped"))
    out = out.join(change.withColumnRenamed("song_id", "__gone").drop("__e"), F.col("song_id") == F.col("__gone"), "left")
    out = out.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == "song_id" else F.col(c) for c in recordings.columns])
    return out, songs.join(change, "song_id", "left_anti")


def assign_to_set(recordings: DataFrame, sets: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recordings, new sets) of edits (recording_id, seq, recorded_at): the set of the UTC day, the earliest if there are
    several; for a day without one a set is made, named by the date."""
    day = F.date_trunc("day", "recorded_at")
    known = sets.groupBy(day.alias("day")).agg(F.min_by("set_id", F.struct("recorded_at", "set_id")).alias("set_id"))
    last = edits.groupBy("recording_id").agg(F.max_by("recorded_at", "seq").alias("recorded_at"))
    days = last.groupBy(day.alias("day")).agg(F.min("recorded_at").alias("recorded_at")).join(known, "day", "left")
    title = F.date_format("recorded_at", "MMMM d, yyyy")
    days = days.withColumn("made", F.col("set_id").isNull()).withColumn("set_id", F.coalesce(F.col("set_id").cast("string"), F.concat(F.lit("set-"), F.date_format("day", "yyyy-MM-dd"))))
    made = days.where("made").select("set_id", title.alias("title"), F.lit(None).cast("string").alias("notes"), "recorded_at")
    change = last.withColumn("day", day).join(days.select("day", "set_id"), "day").select("recording_id", F.struct("set_id").alias("__e"))
    return _changed(recordings, change, "recording_id", state=F.lit("ready"), set_id=F.col("__e.set_id")), made


def store(table: DataFrame, new: DataFrame) -> DataFrame:
    """Riffs or matches are appended; rows stored again are not told apart."""
    return table.unionByName(new)


def store_again(new: DataFrame, stored: Column) -> DataFrame:
    """store(new.where(stored), new), where the table is those of new that were stored before: new is made once, not twice."""
    return new.select("*", F.explode(F.array_repeat(F.lit(True), F.when(stored, 2).otherwise(1))).alias("__again")).drop("__again")


def upsert_warnings(warnings: DataFrame, edits: DataFrame) -> DataFrame:
    """By key the last message and time, no longer dismissed; unknown keys are added."""
    last = _last(edits, "key", "message", "created_at")
    joined = warnings.join(last, "key", "full")
    hit = F.col("__e").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"__e.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("key", pick("message"), pick("created_at"), F.when(hit, False).otherwise(F.col("dismissed")).alias("dismissed"))


def dismiss_warnings(warnings: DataFrame, keys: DataFrame) -> DataFrame:
    return _changed(warnings, keys.select("key").distinct().withColumn("__e", F.struct(F.lit(1))), "key", dismissed=F.lit(True))


def reclassify(recordings: DataFrame, edits: DataFrame) -> DataFrame:
    """(recording_id, seq, kind): a song becomes a ready set without song fields, a set a song to reprocess without set fields."""
    to = F.col("__e.kind")
    song_fields = ["song_id", "path_song", "cut_start_sec", "cut_end_sec", "saved_cut_start_sec", "saved_cut_end_sec", "trim_confidence", "trim_method", "tempo"]
    new = {c: F.when(to != "set", F.col(c)) for c in song_fields if c in recordings.columns}
    new |= {"kind": to, "state": F.when(to == "set", "ready").otherwise("reprocess"), "set_id": F.when(to == "set", F.col("set_id"))}
    moved = _last(edits, "recording_id", "kind").join(recordings.select("recording_id", F.col("kind").alias("__was")), "recording_id").where("__e.kind <> __was").drop("__was")
    return _changed(recordings, moved, "recording_id", **new)
