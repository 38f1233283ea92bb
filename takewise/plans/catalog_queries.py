"""Queries over the catalogue and over new files."""

from __future__ import annotations

from pyspark.sql import functions as F

from takewise.operators import catalog as c
from takewise.operators import ingest as i
from takewise.plans import adapters as ad
from takewise.plans.sql import over

NOW = "2025-01-01 00:00:00"
_SHORT = ("recording_id", "kind", "state", "filename", "creation_time")


def _recordings(then):
    return lambda spark, sf_dir: then(ad.recordings(spark, sf_dir))


def _files(then):
    return lambda spark, sf_dir: then(ad.files(spark, sf_dir))


def _uploads(files):
    return files.select("file_hash", F.substring("path", 7, 100).alias("filename"), "arrival_seq")


def _journal(files):
    return files.where("arrival_seq % 3 = 0").select("file_hash").distinct().withColumn("uploaded_at", F.lit("2024-06-01 00:00:00").cast("timestamp"))


def _sets(spark, sf_dir):
    got = ad.table(spark, sf_dir, "orders")
    return got.select(F.col("o_orderkey").alias("set_id"), F.col("o_orderdate").alias("recorded_at"), F.col("o_orderpriority").alias("title"))


def _set_detail(spark, sf_dir):
    sets = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("set_id"), F.col("o_orderdate").alias("recorded_at"))
    recordings = ad.table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("set_id"), F.col("doc_id").alias("recording_id"), F.timestamp_seconds(F.lit(1704067200) - F.col("doc_id")).alias("uploaded_at"))
    markers = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_quantity").alias("start_sec"), F.concat(F.col("l_linenumber").cast("string"), F.col("l_returnflag")).alias("label"))
    got = c.set_detail(sets, recordings, markers)
    ids = F.array_join(F.transform("recordings", lambda x: x["recording_id"].cast("string")), ",")
    marks = F.array_join(F.transform("markers", lambda x: x["label"]), ",")
    return got.select("set_id", "recorded_at", ids.alias("recording_ids"), marks.alias("marker_labels"))


def _warnings(spark, sf_dir):
    got = ad.table(spark, sf_dir, "events")
    return got.select(F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string")).alias("key"), F.col("ts").alias("created_at"), (F.col("event_id") % 3 == 0).alias("dismissed"), F.col("event_id").alias("n"))


def _takes(spark, sf_dir):
    got = c.songs_with_takes(ad.songs(spark, sf_dir), ad.recordings(spark, sf_dir))
    return got.select("song_id", "title", F.size("takes").cast("long").alias("n_takes"), F.array_join(F.transform("takes", lambda x: x["recording_id"].cast("string")), ",").alias("takes"))


QUERIES = {
    "i1_new_files": _files(lambda f: i.new_files(f, _journal(f)).select("file_hash", "path", "bytes")),
    "i2_staging_budget": _files(lambda f: i.staging_budget(i.new_files(f, _journal(f)), 6000)),
    "i3_stage": _files(lambda f: i.stage(i.new_files(f, _journal(f)))),
    "i4_created": _files(lambda f: i.create_recordings(_uploads(f), f.where("arrival_seq % 5 = 0"), NOW)[0]),
    "i4_duplicates": _files(lambda f: i.create_recordings(_uploads(f), f.where("arrival_seq % 5 = 0"), NOW)[1]),
    "i5_journal": _files(lambda f: i.journal_update(_journal(f), f.select("file_hash", F.when(F.col("arrival_seq") % 4 == 0, "accepted").when(F.col("arrival_seq") % 4 == 1, "duplicate").otherwise("failed").alias("status")), NOW)),
    "i6_kind": _recordings(lambda r: i.classify_kind(r.drop("kind")).select("recording_id", "kind")),
    "q1_recording": _recordings(lambda r: c.by_id(r, "recording_id", 7).select(*_SHORT)),
    "q2_ungrouped": _recordings(lambda r: c.list_ungrouped(r).select(*_SHORT)),
    "q3_reprocess_queue": _recordings(lambda r: c.list_by_state(r, "song", "reprocess").select(*_SHORT)),
    "q4_processing": _recordings(lambda r: c.list_processing(r).select(*_SHORT, "stage")),
    "q5_ready_sets": _recordings(lambda r: c.list_ready_sets(r).select(*_SHORT)),
    "q6_flagged": _recordings(lambda r: c.list_flagged(r).select("recording_id", F.array_join("processing_flags", ",").alias("flags"))),
    "q7_songs_with_takes": _takes,
    "q8_song": lambda s, d: c.song_with_takes(ad.songs(s, d), ad.recordings(s, d), "src3").select("song_id", F.array_join(F.transform("takes", lambda x: x["filename"]), ",").alias("takes")),
    "q9_sets": lambda s, d: _sets(s, d).orderBy(F.desc("recorded_at"), "set_id"),
    "q10_riffs_of": lambda s, d: c.by_id(ad.riffs(s, d), "recording_id", 3).select("riff_id", "recording_id", "riff_index", "tempo"),
    "q12_active_warnings": lambda s, d: c.active_warnings(_warnings(s, d)).select("key", "created_at", "n"),
    "q12_warning": lambda s, d: c.warning(_warnings(s, d), "click_1").select("key"),
    "q13_dashboard": lambda s, d: c.dashboard_songs(ad.songs(s, d), ad.recordings(s, d)),
    "q14_banner": _recordings(c.processing_banner),
    "q15_take_numbers": _recordings(lambda r: c.take_numbers(r).select("recording_id", "song_id", F.col("take_number").cast("long").alias("take_number"))),
    "q16_trim_review": _recordings(c.trim_review),
    "q17_cards": _recordings(c.recording_cards),
    "q18_badges": _recordings(lambda r: r.select("recording_id", c.state_badge(F.col("state")).alias("badge"))),
    "q19_violations": _recordings(lambda r: c.validate_recordings(r.withColumn("state", F.when(F.col("recording_id") % 13 == 0, "ready").otherwise(F.col("state"))).withColumn("set_id", F.when(F.col("recording_id") % 17 == 0, "s")))),
    "q20_set_detail": _set_detail,
    "q21_set_numbering": lambda s, d: c.set_numbering(_sets(s, d)),
}

_S = "recording_id, kind, state, filename, creation_time"
_NEW = "fresh AS (SELECT * FROM files WHERE file_hash NOT IN (SELECT file_hash FROM files WHERE arrival_seq % 3 = 0))"
_UP = "up AS (SELECT file_hash, substr(path, 7) AS filename, arrival_seq, arrival_seq = min(arrival_seq) OVER (PARTITION BY file_hash) AND file_hash NOT IN (SELECT file_hash FROM files WHERE arrival_seq % 5 = 0) AS fresh FROM files)"
_STAGE = "CASE WHEN kind = 'song' THEN list_position(['uploading','normalizing','trimming','analyzing'], state) - 1 ELSE list_position(['uploading','normalizing'], state) + 3 END::INTEGER"
_AUDIO = "coalesce(path_song, path_flac)"
_SETS = "sets AS (SELECT o_orderkey AS set_id, o_orderdate AS recorded_at, o_orderpriority AS title FROM orders)"
_WARN = "WITH w AS (SELECT event_type || '_' || user_id AS key, ts AS created_at, event_id % 3 = 0 AS dismissed, event_id AS n FROM events)"

ORACLE_SQL = {
    "i1_new_files": over("files", f"AND WITH {_NEW} SELECT file_hash, path, bytes FROM fresh"),
    "i2_staging_budget": over("files", f"AND WITH {_NEW}, n AS (SELECT floor(sum(bytes) / 1048576)::BIGINT AS needed_mb FROM fresh) SELECT needed_mb, 6000 < needed_mb + 5000 AS low FROM n"),
    "i3_stage": over("files", f"AND WITH {_NEW} SELECT file_hash, min(path) AS path, file_hash || '.wav' AS staged_name, arg_min(bytes, path) AS bytes FROM fresh GROUP BY file_hash"),
    "i4_created": over("files", f"AND WITH {_UP} SELECT file_hash, filename, arrival_seq, 'song' AS kind, 'uploading' AS state, TIMESTAMP '{NOW}' AS uploaded_at FROM up WHERE fresh"),
    "i4_duplicates": over("files", f"AND WITH {_UP} SELECT file_hash, filename, arrival_seq FROM up WHERE NOT fresh"),
    "i5_journal": over("files", f"SELECT file_hash, CASE WHEN bool_or(arrival_seq % 4 < 2) THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-06-01' END AS uploaded_at FROM files GROUP BY file_hash HAVING bool_or(arrival_seq % 4 < 2) OR bool_or(arrival_seq % 3 = 0)"),
    "i6_kind": over("recordings", "SELECT recording_id, kind FROM recordings"),
    "q1_recording": over("recordings", f"SELECT {_S} FROM recordings WHERE recording_id = 7"),
    "q2_ungrouped": over("recordings", f"SELECT {_S} FROM recordings WHERE kind = 'song' AND state = 'ungrouped'"),
    "q3_reprocess_queue": over("recordings", f"SELECT {_S} FROM recordings WHERE kind = 'song' AND state = 'reprocess'"),
    "q4_processing": over("recordings", f"AND WITH x AS (SELECT {_S}, {_STAGE} AS stage FROM recordings) SELECT * FROM x WHERE stage IS NOT NULL AND stage >= 0"),
    "q5_ready_sets": over("recordings", f"SELECT {_S} FROM recordings WHERE kind = 'set' AND state = 'ready'"),
    "q6_flagged": over("recordings", "SELECT recording_id, array_to_string(processing_flags, ',') AS flags FROM recordings WHERE len(processing_flags) > 0"),
    "q7_songs_with_takes": over("recordings songs", "SELECT s.song_id, s.title, count(r.recording_id) AS n_takes, coalesce(string_agg(r.recording_id::VARCHAR, ',' ORDER BY r.creation_time DESC), '') AS takes FROM songs s LEFT JOIN recordings r ON r.song_id = s.song_id GROUP BY ALL"),
    "q8_song": over("recordings songs", "SELECT s.song_id, coalesce(string_agg(r.filename, ',' ORDER BY r.creation_time DESC), '') AS takes FROM songs s LEFT JOIN recordings r ON r.song_id = s.song_id WHERE s.song_id = 'src3' GROUP BY ALL"),
    "q9_sets": f"WITH {_SETS} SELECT * FROM sets",
    "q10_riffs_of": over("riffs", "SELECT riff_id, recording_id, riff_index, tempo FROM riffs WHERE recording_id = 3"),
    "q12_active_warnings": f"{_WARN} SELECT key, created_at, n FROM w WHERE NOT dismissed",
    "q12_warning": f"{_WARN} SELECT key FROM w WHERE key = 'click_1' LIMIT 1",
    "q13_dashboard": over("recordings songs", f"SELECT s.song_id, s.title, count(r.recording_id) AS take_count, strftime(max(r.creation_time), '%b %-d') AS latest_date, (max_by(struct_pack(a := {_AUDIO}), r.recording_id) FILTER (r.recording_id IS NOT NULL)).a AS latest_audio FROM songs s LEFT JOIN recordings r ON r.song_id = s.song_id AND r.kind = 'song' GROUP BY ALL"),
    "q14_banner": over("recordings", f"AND WITH x AS (SELECT count(*) AS n FROM recordings WHERE {_STAGE} >= 0) SELECT n, 'Analyzing... ' || n || CASE WHEN n = 1 THEN ' recording remaining' ELSE ' recordings remaining' END AS text FROM x WHERE n > 0"),
    "q15_take_numbers": over("recordings", "SELECT recording_id, song_id, row_number() OVER (PARTITION BY song_id ORDER BY creation_time DESC) AS take_number FROM recordings WHERE kind = 'song' AND song_id IS NOT NULL"),
    "q16_trim_review": over("recordings", "AND WITH x AS (SELECT *, CASE WHEN coalesce(trim_confidence, 0) < 0.6 THEN 'low' WHEN coalesce(trim_confidence, 0) < 0.85 THEN 'medium' ELSE 'high' END AS band, cut_start_sec IS NOT NULL AND cut_end_sec IS NOT NULL AS has_trim FROM recordings WHERE kind = 'song') SELECT recording_id, band, has_trim, NOT has_trim AND saved_cut_start_sec IS NOT NULL AND saved_cut_end_sec IS NOT NULL AS trim_undone, floor(coalesce(cut_start_sec, 0) + 0.5)::BIGINT AS pre_seconds, band = 'low' AND has_trim AS auto_expand FROM x"),
    "q17_cards": over("recordings", f"AND WITH x AS (SELECT *, floor(duration_sec % 60 + 0.5)::BIGINT::VARCHAR AS s FROM recordings) SELECT recording_id, state IN ('uploading','normalizing','trimming','analyzing') AS processing, {_AUDIO} AS audio, CASE WHEN duration_sec IS NULL OR duration_sec = 0 THEN '' ELSE floor(duration_sec / 60)::BIGINT || ':' || CASE WHEN len(s) < 2 THEN '0' || s ELSE s END END AS duration, floor(tempo + 0.5)::BIGINT AS bpm, replace(filename, '.wav', '') || '.flac' AS download_name FROM x"),
    "q18_badges": over("recordings", "SELECT recording_id, CASE state WHEN 'uploading' THEN 'Uploading…' WHEN 'normalizing' THEN 'Normalizing…' WHEN 'trimming' THEN 'Trimming…' WHEN 'analyzing' THEN 'Analyzing…' WHEN 'grouped' THEN '✓ Grouped' WHEN 'ungrouped' THEN 'Unsorted' WHEN 'reprocess' THEN 'Reprocessing…' WHEN 'ready' THEN '✓ Ready' ELSE state END AS badge FROM recordings"),
    "q19_violations": over("recordings", "SELECT recording_id, 'state not legal for a song' AS reason FROM recordings WHERE kind = 'song' AND recording_id % 13 = 0 UNION ALL SELECT recording_id, 'set field on a song' FROM recordings WHERE kind = 'song' AND recording_id % 17 = 0"),
    "q20_set_detail": """WITH r AS (SELECT doc_id % 50 AS set_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id DESC) AS ids FROM documents GROUP BY 1),
m AS (SELECT l_orderkey AS set_id, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_quantity, l_linenumber || l_returnflag) AS labels FROM lineitem GROUP BY 1)
SELECT o_orderkey AS set_id, o_orderdate AS recorded_at, ids AS recording_ids, labels AS marker_labels FROM orders LEFT JOIN r ON r.set_id = o_orderkey LEFT JOIN m ON m.set_id = o_orderkey""",
    "q21_set_numbering": f"WITH {_SETS} SELECT set_id, strftime(recorded_at, '%Y-%m-%d') || CASE WHEN count(*) OVER (PARTITION BY recorded_at::DATE) > 1 THEN ' — Set ' || row_number() OVER (PARTITION BY recorded_at::DATE ORDER BY recorded_at, set_id) ELSE '' END AS name FROM sets",
}
