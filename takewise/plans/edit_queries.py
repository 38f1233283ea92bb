"""Queries that apply edits to the whole catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from takewise.operators import edits as e
from takewise.plans import adapters as ad
from takewise.plans.sql import over


def _q(then):
    def run(spark, sf_dir):
        r = ad.recordings(spark, sf_dir)
        return then(r, ad.songs(spark, sf_dir), ad.riffs(spark, sf_dir))

    return run


def _ids(r, n):
    return r.where(F.col("recording_id") % n == 0).select("recording_id")


def patched(r):
    i = F.col("recording_id")
    one = r.where(i % 4 == 0).select("recording_id", F.lit(1).alias("seq"), F.lit("trimming").alias("state"), F.lit(99.5).alias("tempo"))
    two = r.where(i % 8 == 0).select("recording_id", F.lit(2).alias("seq"), F.lit("analyzing").alias("state"), F.lit(None).cast("double").alias("tempo"))
    return one.union(two)


def _assignments(r):
    i = F.col("recording_id")
    rows = [(3, 1, "a"), (6, 2, "b")]
    parts = [r.where(i % n == 0).select("recording_id", F.lit(seq).alias("seq"), F.lit(f"song-{s}").alias("song_id"), F.lit("2025-01-01").cast("timestamp").alias("at")) for n, seq, s in rows]
    return parts[0].union(parts[1])


def _merges(r):
    rows = [("src1", "src2", 1), ("src2", "src3", 2), ("src5", "src6", 3)]
    return r.sparkSession.createDataFrame(rows, "from_id string, into_id string, seq int")


def _set_edits(r):
    return r.where("kind = 'set'").select("recording_id", F.lit(1).alias("seq"), "uploaded_at").withColumnRenamed("uploaded_at", "recorded_at")


def _known_sets(r):
    return r.where("recording_id % 300 = 0").select(F.concat(F.lit("known-"), F.col("recording_id").cast("string")).alias("set_id"), F.col("uploaded_at").alias("recorded_at"))


def _warn(r):
    return r.groupBy(F.concat(F.lit("w"), (F.col("recording_id") % 40).cast("string")).alias("key")).agg(F.concat(F.lit("m"), F.max("recording_id").cast("string")).alias("message"), F.max("uploaded_at").alias("created_at")).withColumn("dismissed", F.length("key") > 2)


def _warn_edits(r):
    return r.where("recording_id % 7 = 0").select(F.concat(F.lit("w"), (F.col("recording_id") % 60).cast("string")).alias("key"), F.col("recording_id").alias("seq"), F.concat(F.lit("new"), F.col("recording_id").cast("string")).alias("message"), F.col("uploaded_at").alias("created_at"))


QUERIES = {
    "e1_update_state": _q(lambda r, s, f: e.update_state(r, patched(r)).select("recording_id", "state", "tempo")),
    "e2_classify_as_set": _q(lambda r, s, f: e.classify_as_set(r, r.where("kind = 'set'").select("recording_id", F.lit(1).alias("seq"), (F.col("duration_sec") + 1).alias("duration_sec")))[0].select("recording_id", "kind", "state", "filename", "duration_sec", "path_flac", "tempo")),
    "e2_errors": _q(lambda r, s, f: e.classify_as_set(r, r.select((F.col("recording_id") + 900).alias("recording_id"), F.lit(1).alias("seq"), "duration_sec"))[1]),
    "e3_assign_to_song": _q(lambda r, s, f: e.assign_to_song(r, _assignments(r))[0].select("recording_id", "state", "song_id")),
    "e3_corrections": _q(lambda r, s, f: e.assign_to_song(r, _assignments(r))[1]),
    "e3_errors": _q(lambda r, s, f: e.assign_to_song(r, _assignments(r))[2]),
    "e4_undo_trim": _q(lambda r, s, f: e.undo_trim(r, _ids(r, 5)).select("recording_id", "cut_start_sec", "cut_end_sec", "saved_cut_start_sec", "saved_cut_end_sec", "trim_method")),
    "e4_restore_trim": _q(lambda r, s, f: e.restore_trim(r, _ids(r, 2))[0].select("recording_id", "cut_start_sec", "cut_end_sec", "saved_cut_start_sec", "trim_method")),
    "e4_restore_errors": _q(lambda r, s, f: e.restore_trim(r, _ids(r, 2))[1]),
    "e5_reprocess": _q(lambda r, s, f: e.schedule_reprocess(r, f, _ids(r, 3))[0].select("recording_id", "state")),
    "e5_riffs_left": _q(lambda r, s, f: e.schedule_reprocess(r, f, _ids(r, 3))[1].select("riff_id", "recording_id")),
    "e6_reprocess_flagged": _q(lambda r, s, f: e.schedule_reprocess_flagged(r, f)[0].select("recording_id", "state")),
    "e6_count": _q(lambda r, s, f: e.schedule_reprocess_flagged(r, f)[2]),
    "e7_flags": _q(lambda r, s, f: e.set_processing_flags(r, r.where("recording_id % 18 = 0").select("recording_id", F.lit(1).alias("seq"), F.array().cast("array<string>").alias("processing_flags"))).select("recording_id", F.array_join("processing_flags", ",").alias("flags"))),
    "e8_songs": _q(lambda r, s, f: e.rename(e.create_songs(s, s.select(F.concat(F.lit("new-"), F.col("song_id")).alias("song_id"), F.lit("New").alias("title"))), s.select("song_id", F.lit(1).alias("seq"), F.when(F.col("song_id") < "src3", F.lit("  ")).otherwise(F.concat(F.lit("  Renamed "), F.col("song_id"), F.lit(" "))).alias("title")), "song_id").select("song_id", "title")),
    "e9_merge_songs": _q(lambda r, s, f: e.merge_songs(r, s, _merges(r))[0].select("recording_id", "song_id")),
    "e9_songs_left": _q(lambda r, s, f: e.merge_songs(r, s, _merges(r))[1].select("song_id")),
    "e10_dissolve": _q(lambda r, s, f: e.dissolve_songs(r, s, s.where("song_id >= 'src5'"))[0].select("recording_id", "song_id", "state")),
    "e11_assign_to_set": _q(lambda r, s, f: e.assign_to_set(r, _known_sets(r), _set_edits(r))[0].select("recording_id", "set_id", "state")),
    "e11_new_sets": _q(lambda r, s, f: e.assign_to_set(r, _known_sets(r), _set_edits(r))[1].select("set_id", "title", "recorded_at")),
    "e12_rename_sets": _q(lambda r, s, f: e.rename(_known_sets(r).withColumn("title", F.lit("old")), _known_sets(r).where("set_id > 'known-5'").select("set_id", F.lit(1).alias("seq"), F.lit(" x ").alias("title")), "set_id").select("set_id", "title")),
    "e13_store_riffs": _q(lambda r, s, f: e.store(f, f.where("recording_id % 2 = 0")).select("riff_id", "recording_id", "tempo")),
    "e14_upsert_warnings": _q(lambda r, s, f: e.upsert_warnings(_warn(r), _warn_edits(r))),
    "e14_dismiss": _q(lambda r, s, f: e.dismiss_warnings(_warn(r), _warn(r).where("key like '%3'"))),
    "e15_reclassify": _q(lambda r, s, f: e.reclassify(r, r.where("recording_id % 10 = 0").select("recording_id", F.lit(1).alias("seq"), F.when(F.col("recording_id") % 20 == 0, "set").otherwise("song").alias("kind"))).select("recording_id", "kind", "state", "tempo", "path_flac")),
}

_A = "a AS (SELECT recording_id, 1 AS seq, 'song-a' AS s FROM recordings WHERE recording_id % 3 = 0 UNION ALL SELECT recording_id, 2, 'song-b' FROM recordings WHERE recording_id % 6 = 0), j AS (SELECT a.*, r.kind, r.state, coalesce(lag(s) OVER (PARTITION BY a.recording_id ORDER BY seq), r.song_id) AS f FROM a JOIN recordings r USING (recording_id))"
_FLAC = "kind = 'song' AND path_flac IS NOT NULL"
_KNOWN = "k AS (SELECT 'known-' || recording_id AS set_id, uploaded_at AS recorded_at FROM recordings WHERE recording_id % 300 = 0), kd AS (SELECT date_trunc('day', recorded_at) AS d, arg_min(set_id, recorded_at) AS set_id FROM k GROUP BY 1), x AS (SELECT recording_id, date_trunc('day', uploaded_at) AS d, uploaded_at FROM recordings WHERE kind = 'set')"
_W = "w AS (SELECT 'w' || recording_id % 40 AS key, 'm' || max(recording_id) AS message, max(uploaded_at) AS created_at, len('w' || recording_id % 40) > 2 AS dismissed FROM recordings GROUP BY recording_id % 40)"
_NEWW = "n AS (SELECT 'w' || recording_id % 60 AS key, 'new' || max(recording_id) AS message, max(uploaded_at) AS created_at FROM recordings WHERE recording_id % 7 = 0 GROUP BY recording_id % 60)"
_TO = "CASE WHEN recording_id % 20 = 0 THEN 'set' ELSE 'song' END"

ORACLE_SQL = {
    "e1_update_state": over("recordings", "SELECT recording_id, CASE WHEN recording_id % 8 = 0 THEN 'analyzing' WHEN recording_id % 4 = 0 THEN 'trimming' ELSE state END AS state, CASE WHEN recording_id % 4 = 0 THEN 99.5 ELSE tempo END::DOUBLE AS tempo FROM recordings"),
    "e2_classify_as_set": over("recordings", "SELECT recording_id, kind, CASE WHEN kind = 'set' THEN 'normalizing' ELSE state END AS state, filename, CASE WHEN kind = 'set' THEN duration_sec + 1 ELSE duration_sec END AS duration_sec, path_flac, tempo FROM recordings"),
    "e2_errors": over("recordings", "SELECT recording_id + 900 AS recording_id, 'unknown recording' AS error FROM recordings WHERE recording_id + 900 NOT IN (SELECT recording_id FROM recordings)"),
    "e3_assign_to_song": over("recordings", "SELECT recording_id, CASE WHEN kind = 'song' AND recording_id % 3 = 0 THEN 'grouped' ELSE state END AS state, CASE WHEN kind = 'song' AND recording_id % 6 = 0 THEN 'song-b' WHEN kind = 'song' AND recording_id % 3 = 0 THEN 'song-a' ELSE song_id END AS song_id FROM recordings"),
    "e3_corrections": over("recordings", f"AND WITH {_A} SELECT recording_id, f AS from_song_id, s AS to_song_id, TIMESTAMP '2025-01-01' AS corrected_at FROM j WHERE kind = 'song' AND (f IS NOT NULL OR (seq = 1 AND state = 'ungrouped'))"),
    "e3_errors": over("recordings", f"AND WITH {_A} SELECT recording_id, 'not a song' AS error FROM j WHERE kind <> 'song'"),
    "e4_undo_trim": over("recordings", "SELECT recording_id, CASE WHEN recording_id % 5 <> 0 THEN cut_start_sec END AS cut_start_sec, CASE WHEN recording_id % 5 <> 0 THEN cut_end_sec END AS cut_end_sec, CASE WHEN recording_id % 5 = 0 THEN cut_start_sec ELSE saved_cut_start_sec END AS saved_cut_start_sec, CASE WHEN recording_id % 5 = 0 THEN cut_end_sec ELSE saved_cut_end_sec END AS saved_cut_end_sec, CASE WHEN recording_id % 5 <> 0 THEN trim_method END AS trim_method FROM recordings"),
    "e4_restore_trim": over("recordings", "AND WITH x AS (SELECT *, recording_id % 2 = 0 AND saved_cut_start_sec IS NOT NULL AND saved_cut_end_sec IS NOT NULL AS hit FROM recordings) SELECT recording_id, CASE WHEN hit THEN saved_cut_start_sec ELSE cut_start_sec END AS cut_start_sec, CASE WHEN hit THEN saved_cut_end_sec ELSE cut_end_sec END AS cut_end_sec, CASE WHEN NOT hit THEN saved_cut_start_sec END AS saved_cut_start_sec, trim_method FROM x"),
    "e4_restore_errors": over("recordings", "SELECT recording_id, 'nothing saved' AS error FROM recordings WHERE recording_id % 2 = 0 AND (saved_cut_start_sec IS NULL OR saved_cut_end_sec IS NULL)"),
    "e5_reprocess": over("recordings", f"SELECT recording_id, CASE WHEN {_FLAC} AND recording_id % 3 = 0 THEN 'reprocess' ELSE state END AS state FROM recordings"),
    "e5_riffs_left": over("recordings riffs", f"SELECT riff_id, recording_id FROM riffs WHERE recording_id NOT IN (SELECT recording_id FROM recordings WHERE {_FLAC} AND recording_id % 3 = 0)"),
    "e6_reprocess_flagged": over("recordings", "SELECT recording_id, CASE WHEN path_flac IS NOT NULL AND recording_id % 9 = 0 THEN 'reprocess' ELSE state END AS state FROM recordings"),
    "e6_count": over("recordings", "SELECT count(*) AS n FROM recordings WHERE path_flac IS NOT NULL AND recording_id % 9 = 0"),
    "e7_flags": over("recordings", "SELECT recording_id, CASE WHEN recording_id % 18 = 0 THEN '' ELSE array_to_string(processing_flags, ',') END AS flags FROM recordings"),
    "e8_songs": over("songs", "SELECT song_id, CASE WHEN song_id < 'src3' THEN title ELSE 'Renamed ' || song_id END AS title FROM songs UNION ALL SELECT 'new-' || song_id, 'New' FROM songs"),
    "e9_merge_songs": over("recordings", "SELECT recording_id, CASE WHEN song_id IN ('src1', 'src2') THEN 'src3' WHEN song_id = 'src5' THEN 'src6' ELSE song_id END AS song_id FROM recordings"),
    "e9_songs_left": over("songs", "SELECT song_id FROM songs WHERE song_id NOT IN ('src1', 'src2', 'src5')"),
    "e10_dissolve": over("recordings", "SELECT recording_id, CASE WHEN song_id >= 'src5' THEN NULL ELSE song_id END AS song_id, CASE WHEN song_id >= 'src5' THEN 'ungrouped' ELSE state END AS state FROM recordings"),
    "e11_assign_to_set": over("recordings", f"AND WITH {_KNOWN} SELECT r.recording_id, CASE WHEN x.d IS NOT NULL THEN coalesce(kd.set_id, 'set-' || strftime(x.d, '%Y-%m-%d')) END AS set_id, CASE WHEN x.d IS NOT NULL THEN 'ready' ELSE r.state END AS state FROM recordings r LEFT JOIN x USING (recording_id) LEFT JOIN kd ON kd.d = x.d"),
    "e11_new_sets": over("recordings", f"AND WITH {_KNOWN} SELECT 'set-' || strftime(x.d, '%Y-%m-%d') AS set_id, strftime(min(uploaded_at), '%B %-d, %Y') AS title, min(uploaded_at) AS recorded_at FROM x WHERE x.d NOT IN (SELECT d FROM kd) GROUP BY x.d"),
    "e12_rename_sets": over("recordings", f"AND WITH {_KNOWN} SELECT set_id, CASE WHEN set_id > 'known-5' THEN 'x' ELSE 'old' END AS title FROM k"),
    "e13_store_riffs": over("riffs", "SELECT riff_id, recording_id, tempo FROM riffs UNION ALL SELECT riff_id, recording_id, tempo FROM riffs WHERE recording_id % 2 = 0"),
    "e14_upsert_warnings": over("recordings", f"AND WITH {_W}, {_NEWW} SELECT coalesce(w.key, n.key) AS key, coalesce(n.message, w.message) AS message, coalesce(n.created_at, w.created_at) AS created_at, CASE WHEN n.key IS NOT NULL THEN false ELSE w.dismissed END AS dismissed FROM w FULL JOIN n ON w.key = n.key"),
    "e14_dismiss": over("recordings", f"AND WITH {_W} SELECT key, message, created_at, dismissed OR key LIKE '%3' AS dismissed FROM w"),
    "e15_reclassify": over("recordings", f"AND WITH x AS (SELECT *, recording_id % 10 = 0 AND kind <> {_TO} AS hit, {_TO} AS t FROM recordings) SELECT recording_id, CASE WHEN hit THEN t ELSE kind END AS kind, CASE WHEN hit THEN CASE t WHEN 'set' THEN 'ready' ELSE 'reprocess' END ELSE state END AS state, CASE WHEN hit AND t = 'set' THEN NULL ELSE tempo END AS tempo, path_flac FROM x"),
}
