"""Queries over files and streams: the test tables are written to the shared folder first, then read as the library reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takewise.operators import edits
from takewise.operators import frames as fr
from takewise.plans import adapters as ad
from takewise.plans.edit_queries import ORACLE_SQL as EDIT_SQL
from takewise.plans.edit_queries import patched
from takewise.plans.matching_queries import ORACLE_SQL as MATCHING_SQL
from takewise.plans.sql import over
from takewise.session import checkpoint, new_folder
from takewise.sources import audio, tables, versioned, wav
from takewise.streaming import library, stateful

#: A chunk of sound and how far it runs into the next one, in samples: 32 events and 3.
CHUNK, HALO = 32 * fr.HOP, fr.WINDOW - fr.HOP


def _manifests(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a manifest per supplier, one file each; suppliers of a nation have one hash, every tenth is broken.

    The files lie side by side: a folder each would make every listing of them a listing per file.
    """
    key = F.col("s_suppkey")
    name = F.lpad(key.cast("string"), 9, "0")
    fields = F.struct(name.alias("recordingId"), F.concat(F.lit("/card/"), name).alias("filePath"), F.concat(name, F.lit(".wav")).alias("filename"), F.sha2(F.col("s_nationkey").cast("string"), 256).alias("fileHash"))
    folder = new_folder(spark)
    content = F.when(key % 10 == 0, "{ broken").otherwise(F.to_json(fields)).cast("binary")
    rows = ad.table(spark, sf_dir, "supplier").select(F.concat(F.lit("file=n"), name, F.lit(".json")).alias("name"), content.alias("content"))
    wav.save_files(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name"), folder)
    return folder


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_manifests(spark, _manifests(spark, sf_dir))[0].select("recording_id", "file_path", "filename", "file_hash")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = tables.read_manifests(spark, _manifests(spark, sf_dir))[1]
    return bad.select(F.regexp_extract("source", r"file=n(\d+)", 1).alias("file"))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouped songs, from a layout in which only their part is read."""
    folder = new_folder(spark)
    tables.write_table(ad.recordings(spark, sf_dir), folder, ["kind", "state"])
    return spark.read.parquet(folder).where("kind = 'song' AND state = 'grouped'").select("recording_id", "filename", "song_id", "duration_sec")


def _sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound per user as the bytes of a file of 16 bits and one channel: each event's value, every other one negative, for a hop."""
    byte = lambda x, k: F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    number = lambda x: F.concat(*[byte(x, k) for k in range(4)])
    level = F.least(F.round(F.col("rms") * 32).cast("int"), F.lit(32767))
    sample = F.pmod(F.when(F.col("frame_idx") % 2 == 1, -level).otherwise(level), F.lit(65536))
    levels = ad.frames(spark, sf_dir).select("recording_id", F.struct("frame_idx", sample.alias("sample")).alias("s"))
    # levels are small, what is made of them is not: a number of parts that isn't cut down by their size
    levels = levels.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "recording_id").groupBy("recording_id").agg(F.array_sort(F.collect_list("s")).alias("levels"))
    held = F.transform("levels", lambda x: F.repeat(F.concat(byte(x["sample"], 0), byte(x["sample"], 1)), fr.HOP))  # after the shuffle, which has numbers alone
    data = levels.select("recording_id", F.array_join(held, "").alias("data"))
    size = (F.length("data") / 2).cast("int")
    head = F.lit("57415645666D7420100000000100010022560000" "44AC00000200100064617461")
    return data.select("recording_id", F.unhex(F.concat(F.lit("52494646"), number(size + 36), head, number(size), F.col("data"))).alias("content"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.decode_pcm(_sounds(spark, sf_dir), "recording_id", chunk=CHUNK, halo=HALO)


def _levels(chunks: DataFrame) -> DataFrame:
    """Chunks with the level of each hop instead of their samples."""
    at = F.sequence(F.lit(1), F.size("samples"), F.lit(fr.HOP))
    levels = F.array_join(F.transform(at, lambda i: F.round(F.element_at("samples", i) * 32768).cast("int").cast("string")), ",")
    return chunks.select(F.col("recording_id").cast("long").alias("recording_id"), "sr", "chunk_idx", "first", F.size("samples").cast("long").alias("n"), levels.alias("levels"))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(_chunks(spark, sf_dir))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.frame_features(_chunks(spark, sf_dir)).withColumn("recording_id", F.col("recording_id").cast("long"))


def _shown(frames: DataFrame, *columns: str) -> DataFrame:
    return frames.select("recording_id", "frame_idx", *[F.round(c, 6).alias(c) for c in columns])


def _loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = audio.decode_pcm(_sounds(spark, sf_dir), "recording_id", chunk=CHUNK, halo=CHUNK)
    return fr.loudness_gain(sound).select("recording_id", F.round("loudness", 3).alias("loudness"), F.round("gain", 3).alias("gain"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk as a riff."""
    riffs = _chunks(spark, sf_dir).select("recording_id", F.col("chunk_idx").alias("riff_index"), "sr", "samples")
    got = fr.hpss_features(riffs)
    return got.select("recording_id", "riff_index", "frame_idx", *[F.round(c, 3).alias(c) for c in ("onset_perc", "centroid", "rolloff")])


def _once(spark: SparkSession, stream: DataFrame, each, out: str) -> DataFrame:
    """What each made of the stream's batches, when all that is there is read."""
    library.run(stream, each, new_folder(spark)).awaitTermination()
    return spark.read.parquet(out)


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark)
    stream = library.stream_manifests(spark, _manifests(spark, sf_dir))
    return _once(spark, stream, library.dedup_into(out), out).select("recording_id", "file_path", "filename", "file_hash")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's riffs arrive as a stream and meet the library."""
    riffs, inbox, out = ad.riffs(spark, sf_dir), new_folder(spark), new_folder(spark)
    ad.batch(riffs).write.parquet(inbox)
    columns = ["riff_a_id", "riff_b_id", "score", "groove", "drums", "contour", "spectral", "tempo", "weights"]
    return _once(spark, spark.readStream.schema(riffs.schema).parquet(inbox), library.match_into(lambda s: ad.riffs(s, sf_dir), out, columns=columns), out).select(*columns)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each user, from events that arrive in several batches; the last version of the table counts."""
    events = ad.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("recording_id"), F.col("event_type").alias("state"), F.col("event_id").cast("long").alias("seq"))
    inbox, out = new_folder(spark), new_folder(spark)
    events.repartition(6, "seq").write.parquet(inbox)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(inbox)
    last = _once(spark, stream, library.states_into(out), out).groupBy("recording_id").agg(F.max_by(F.struct("state", "seq"), "version").alias("l"))
    return last.select("recording_id", "l.state", "l.seq")


def _sound_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sounds as files in the shared folder, listed."""
    folder = new_folder(spark)
    wav.save_files(_sounds(spark, sf_dir).select(F.concat("recording_id", F.lit(".wav")).alias("name"), "content"), folder)
    return wav.list_audio(spark, folder)


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan hashes all files; a second one, with the first as its journal and a third of it lost, those alone."""
    folder = new_folder(spark)
    wav.save_files(_sounds(spark, sf_dir).select(F.concat("recording_id", F.lit(".wav")).alias("name"), "content"), folder)
    nothing = spark.createDataFrame([], "path string, bytes long, modified timestamp")
    first = checkpoint(wav.scan_new(spark, folder, nothing))
    known = first.where(F.regexp_extract("filename", r"(\d+)", 1).cast("long") % 3 != 0)
    second = wav.scan_new(spark, folder, known)
    return first.withColumn("scan", F.lit(1)).unionByName(second.withColumn("scan", F.lit(2))).select("scan", "filename", "suffix", "bytes", "file_hash")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _decoded, from files of which each chunk is read by itself."""
    files = _sound_files(spark, sf_dir).withColumn("recording_id", F.regexp_extract("filename", r"(\d+)", 1))
    return _levels(wav.read_ranges(files, "recording_id", chunk=CHUNK, halo=HALO))


def _first_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes that the state store lets through, in two runs of one stream: the second finds the files of the first too."""
    own = stateful.with_rocksdb(spark)
    inbox, memory, out = _manifests(spark, sf_dir), new_folder(spark), new_folder(spark)

    def each(batch: DataFrame, number: int) -> None:
        batch.select("file_hash").write.mode("overwrite").parquet(f"{out}/batch={number}")

    for _ in range(2):
        library.run(stateful.first_manifests(stateful.stream_dated_manifests(own, inbox)), each, memory).awaitTermination()
    return spark.read.parquet(out).select("file_hash")


def _counted_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings per latest state, from the changes that a stateful operator sends on in several batches."""
    own = stateful.with_rocksdb(spark)
    events = ad.table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("recording_id"), F.col("event_type").alias("state"), F.col("event_id").cast("long").alias("seq"))
    inbox, out = new_folder(spark), new_folder(spark)
    events.repartition(6, "seq").write.parquet(inbox)
    stream = own.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(inbox)
    library.run(stateful.state_changes(stream), stateful.counts_into(out), new_folder(spark), mode="update").awaitTermination()
    return stateful.current_counts(spark, out)


def _pairs_kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of each pair of recordings, kept up while the riffs arrive in four batches; ids are text."""
    riffs = ad.riffs(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) if c in ("riff_id", "recording_id") else F.col(c) for c in ad.riffs(spark, sf_dir).columns])
    inbox, best = new_folder(spark), new_folder(spark)
    riffs.repartition(4, "riff_id").write.parquet(inbox)
    stream = spark.readStream.schema(riffs.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    library.run(stream, library.riff_pairs_into(lambda s: s.read.parquet(inbox), best), new_folder(spark)).awaitTermination()
    got = library.best_pairs(spark, best)
    lo, hi = F.col("rec_lo").cast("long"), F.col("rec_hi").cast("long")
    return got.select(F.least(lo, hi).alias("rec_lo"), F.greatest(lo, hi).alias("rec_hi"), "score", "groove", "drums", "contour", "spectral", "tempo", "weights", F.col("riff_a_id").cast("long").alias("riff_a_id"), F.col("riff_b_id").cast("long").alias("riff_b_id"))


def _patched_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e1_update_state on a table by kind and state, of which only the partitions with patched recordings are rewritten."""
    recordings = ad.recordings(spark, sf_dir)
    patches = patched(recordings)
    table = versioned.VersionedTable(spark, new_folder(spark), ["kind", "state"])
    table.create(recordings)
    table.edit(patches, "recording_id", lambda rows: edits.update_state(rows, patches))
    return table.read().select("recording_id", "state", "tempo")


QUERIES = {
    "s1_scan": _scanned,
    "s5_ranges": _ranges,
    "x2_dedup_state_store": _first_by_state,
    "x4_stateful_counts": _counted_by_state,
    "p1_pairs_kept_up": _pairs_kept_up,
    "e1_by_partition": _patched_by_partition,
    "s2_manifests": _good,
    "s2_broken_manifests": _broken,
    "s4_layout": _layout,
    "s5_decoded": _decoded,
    "f1_loudness": _loudness,
    "f2_frames": lambda s, d: _shown(_frames(s, d), "t_sec", "rms"),
    "f2_spectra": lambda s, d: _shown(_frames(s, d), "flatness", "onset", "centroid", "rolloff"),
    "f3_percussive_split": _split,
    "x2_dedup_stream": _deduped,
    "x3_match_stream": _matched,
    "x4_state_stream": _states,
}

_NAME = "lpad(s_suppkey::VARCHAR, 9, '0')"
_MANIFEST = f"SELECT {_NAME} AS recording_id, '/card/' || {_NAME} AS file_path, {_NAME} || '.wav' AS filename, sha256(s_nationkey::VARCHAR) AS file_hash FROM supplier WHERE s_suppkey % 10 <> 0"
_LEVELS = "lv AS (SELECT recording_id, frame_idx, CASE WHEN frame_idx % 2 = 1 THEN -1 ELSE 1 END * least(round(rms * 32)::INTEGER, 32767) AS v FROM frames)"

_BYTE = "(printf('%02X', v & 255) || printf('%02X', (v >> 8) & 255))"
_LONG = "(printf('%02X', {0} & 255) || printf('%02X', ({0} >> 8) & 255) || printf('%02X', ({0} >> 16) & 255) || printf('%02X', ({0} >> 24) & 255))"

ORACLE_SQL = {
    "s1_scan": over("frames", f"""AND WITH {_LEVELS}, d AS (SELECT recording_id, string_agg(repeat({_BYTE}, 512), '' ORDER BY frame_idx) AS data, (count(*) * 1024)::INTEGER AS n FROM lv GROUP BY 1),
f AS (SELECT *, '52494646' || {_LONG.format("(n + 36)")} || '57415645666D7420100000000100010022560000' || '44AC00000200100064617461' || {_LONG.format("n")} || data AS content FROM d)
SELECT scan, recording_id || '.wav' AS filename, '.wav' AS suffix, (length(content) // 2)::BIGINT AS bytes, sha256(unhex(content)) AS file_hash FROM f, (SELECT unnest([1, 2])::INTEGER AS scan) WHERE scan = 1 OR recording_id % 3 = 0"""),
    "x2_dedup_state_store": "SELECT DISTINCT sha256(s_nationkey::VARCHAR) AS file_hash FROM supplier WHERE s_suppkey % 10 <> 0",
    "x4_stateful_counts": "SELECT state, count(*) AS n FROM (SELECT arg_max(event_type, event_id) AS state FROM events GROUP BY user_id) GROUP BY 1",
    "p1_pairs_kept_up": MATCHING_SQL["pairs_best_library"],
    "e1_by_partition": EDIT_SQL["e1_update_state"],
    "s2_manifests": _MANIFEST,
    "s2_broken_manifests": f"SELECT {_NAME} AS file FROM supplier WHERE s_suppkey % 10 = 0",
    "s4_layout": over("recordings", "SELECT recording_id, filename, song_id, duration_sec FROM recordings WHERE kind = 'song' AND state = 'grouped'"),
    "s5_decoded": over("frames", f"""AND WITH {_LEVELS}, l AS (SELECT recording_id, list(v ORDER BY frame_idx) AS l FROM lv GROUP BY 1), c AS (SELECT recording_id, l, unnest(range(0, (len(l) + 31) // 32)) AS c FROM l),
e AS (SELECT recording_id, c, l[c * 32 + 1:c * 32 + 35] AS l FROM c)
SELECT recording_id, 22050 AS sr, c::INTEGER AS chunk_idx, c * 16384 AS first, len(l) * 512 AS n, array_to_string(list_transform(l, lambda x: x::VARCHAR), ',') AS levels FROM e"""),
    "f2_frames": over("frames", f"""AND WITH {_LEVELS}, w AS (SELECT recording_id, frame_idx, count(*) OVER w AS n, sum((v / 32768.0::DOUBLE) ** 2) OVER w AS s FROM lv WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT recording_id, frame_idx, round(frame_idx * 512 / 22050.0::DOUBLE, 6) AS t_sec, round(sqrt(s / 4), 6) AS rms FROM w WHERE n = 4"""),
    # A window is four hops of one level each, so its transform is the sum of the levels times that of the window's quarters.
    "f2_spectra": over("frames", f"""AND WITH {_LEVELS}, v AS (SELECT recording_id, frame_idx, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n, lag(v) OVER w / 32768.0::DOUBLE AS z, v / 32768.0::DOUBLE AS a, lead(v) OVER w / 32768.0::DOUBLE AS b, lead(v, 2) OVER w / 32768.0::DOUBLE AS c, lead(v, 3) OVER w / 32768.0::DOUBLE AS d
  FROM lv WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx)),
q AS (SELECT k, i // 512 AS quarter, sum((0.5 - 0.5 * cos(2 * pi() * i / 2048)) * cos(2 * pi() * (k * i % 2048) / 2048)) AS re, sum((0.5 - 0.5 * cos(2 * pi() * i / 2048)) * sin(2 * pi() * (k * i % 2048) / 2048)) AS im FROM range(0, 1025) x(k), range(0, 2048) y(i) GROUP BY 1, 2),
t AS (SELECT k, list(re ORDER BY quarter) AS r, list(im ORDER BY quarter) AS m FROM q GROUP BY 1),
p AS MATERIALIZED (SELECT recording_id, frame_idx, k, k * 22050 / 2048.0::DOUBLE AS f, (a * r[1] + b * r[2] + c * r[3] + d * r[4]) ** 2 + (a * m[1] + b * m[2] + c * m[3] + d * m[4]) ** 2 AS p, (z * r[1] + a * r[2] + b * r[3] + c * r[4]) ** 2 + (z * m[1] + a * m[2] + b * m[3] + c * m[4]) ** 2 AS before FROM v, t WHERE n = 4),
s AS (SELECT *, sum(sqrt(p)) OVER (PARTITION BY recording_id, frame_idx ORDER BY k ROWS UNBOUNDED PRECEDING) AS reach, sum(sqrt(p)) OVER (PARTITION BY recording_id, frame_idx) AS total FROM p)
SELECT recording_id, frame_idx, round(exp(avg(ln(greatest(p, 1e-10)))) / greatest(avg(greatest(p, 1e-10)), 1e-10), 6) AS flatness, round(avg(CASE WHEN before IS NULL THEN 0 ELSE greatest(0, 10 * log10(greatest(1e-10, p)) - 10 * log10(greatest(1e-10, before))) END), 6) AS onset,
  round(CASE WHEN any_value(total) > 0 THEN sum(sqrt(p) * f) / sum(sqrt(p)) ELSE 0 END, 6) AS centroid, round(least(count(*) FILTER (reach < 0.5 * total), 1024) * 22050 / 2048.0::DOUBLE, 6) AS rolloff FROM s GROUP BY ALL"""),
    "x2_dedup_stream": f"{_MANIFEST} QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1",
    "x3_match_stream": MATCHING_SQL["m9_matches_batch"],
    "x4_state_stream": "SELECT user_id AS recording_id, arg_max(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY 1",
}
ORACLE_SQL["s5_ranges"] = ORACLE_SQL["s5_decoded"]
