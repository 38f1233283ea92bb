"""Hand-worked cases and properties."""

import json
import pathlib
import random
import shutil
import struct
import subprocess
import sys
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from takewise.functions import arrays
from takewise.operators import catalog, contour, edits, frames, graph, ingest, matching, pairs, report, rhythm, segment, trim
from takewise.plans import registry
from takewise.sources import audio, tables
from takewise.streaming import library


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def array(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("a,b,want", [(100, 200, 1.0), (100, 100, 1.0), (100, 0, 0.5), (100, 70, 100 / 140), (60, 190, 120 / 190)])
def test_tempo(spark, a, b, want):
    assert abs(value(spark, matching.tempo_similarity(F.lit(float(a)), F.lit(float(b)))) - want) < 1e-9


@pytest.mark.parametrize("a,b,want", [(0.8, 0.9, "blast"), (0.7, 0.9, "balanced"), (0.3, 0.39, "groove"), (0.4, 0.1, "balanced"), (None, 0.9, "balanced")])
def test_weights(spark, a, b, want):
    assert value(spark, matching.weight_label(F.lit(a).cast("double"), F.lit(b))) == want
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in matching.WEIGHTS.values())


def plain_warp(a, b):
    row = [0.0] * (len(b) + 1)
    for x in a:
        row = [np.inf] + [(x - b[j]) ** 2 + min(row[j + 1], row[j]) for j in range(len(b))]
    return max(0.0, 1 - min(row[1:]) / min(len(a), len(b)) / 2)


def test_warp(spark):
    r = random.Random(1)
    for n, m in ((3, 5), (5, 3), (4, 4), (1, 1)):
        a, b = [r.random() for _ in range(n)], [r.random() for _ in range(m)]
        want = plain_warp(a, b)
        assert abs(value(spark, arrays.warped(array(a), array(b))) - want) < 1e-9
        assert abs(matching.warp_batch(np.array([a]), np.array([b]))[0] - want) < 1e-9
    assert matching.warp_batch(np.zeros((1, 0)), np.zeros((1, 3)))[0] == 0


def test_tempo_test_is_a_ratio_of_three_tenths():
    r = np.random.default_rng(1)
    a, b = r.uniform(40, 260, 20000), r.uniform(40, 260, 20000)
    best = np.maximum.reduce([np.minimum(p, q) / np.maximum(p, q) for p, q in ((a, b), (a, 2 * b), (2 * a, b))])
    assert ((best >= 0.6) == (np.minimum(a, b) / np.maximum(a, b) >= 0.3)).all()


def test_blocks_make_no_difference(spark):
    riffs = registry.matching_queries.ad.riffs(spark, "/root/testdata/sf0.001").where("riff_id < 80")
    one = {tuple(r) for r in matching.find_matches(riffs, riffs, 0.3, 1, 1).collect()}
    assert one and one == {tuple(r) for r in matching.find_matches(riffs, riffs, 0.3, 3, 5).collect()}
    by_expressions = {(r.riff_a_id, r.riff_b_id, r.score) for r in matching.compare(matching.candidate_pairs(riffs, riffs).where(matching.interval_test(F.col("a.intervals"), F.col("b.intervals")))).where("score >= 0.3").collect()}
    assert by_expressions == {(r[0], r[1], r[6]) for r in one}


def test_curves(spark):
    x = [1.0, 4.0, 2.0, 8.0, 5.0]
    assert np.allclose(value(spark, arrays.resampled(array(x), 9)), np.interp(np.linspace(0, 5, 9), np.arange(5), x))
    z = value(spark, arrays.znorm(array(x)))
    assert np.allclose(z, value(spark, arrays.znorm(array([3 * v + 7 for v in x])))) and np.allclose(z, (np.array(x) - 4) / np.std(x))
    assert value(spark, arrays.znorm(array([2, 2]))) == [0.0, 0.0]
    d = np.diff(x)
    want = [int(np.sign(v)) * (2 if abs(v) > np.std(d) else 1 if abs(v) > 0.25 * np.std(d) else 0) for v in d]
    assert value(spark, arrays.quantised(array(x))) == want
    assert value(spark, arrays.cosine(array([1, 0]), array([1]))) == 1.0 and value(spark, arrays.cosine(F.array().cast("array<double>"), array([1]))) == 0.0
    assert np.allclose(contour.mean_filtered(np.array(x), 3), [2, 7 / 3, 14 / 3, 5, 6]) and np.allclose(contour.median_filtered(np.array(x), 3), [1, 2, 4, 5, 5])


def test_novelty_is_the_checkerboard(spark):
    r, h = np.random.default_rng(2), 4
    f = r.normal(size=(30, 2))
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(f)]
    got = segment.novelty(spark.createDataFrame(rows, "recording_id long, frame_idx long, a double, b double"), ["a", "b"], h).orderBy("frame_idx").collect()
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    s, board = u @ u.T, np.kron(np.array([[1, -1], [-1, 1]]), np.ones((h, h)))
    want = np.array([(s[i - h : i + h, i - h : i + h] * board).sum() if h <= i < 30 - h else 0 for i in range(30)])
    assert np.allclose([x.novelty for x in got], np.maximum(want, 0) / want.max())


def test_peaks(spark):
    curve = [0, 0.5, 0.2, 0.9, 0.9, 0.9, 0.1, 0.4, 0.3, 0.2, 1.0, 0]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(curve)], "recording_id long, frame_idx long, novelty double")
    assert sorted(r.frame_idx for r in segment.novelty_peaks(df, 0.3, 3).collect()) == [1, 4, 7, 10]
    assert sorted(r.frame_idx for r in segment.novelty_peaks(df, 0.3, 4).collect()) == [4, 10]


@pytest.mark.parametrize("duration,peaks,want", [(2.0, [1.0], [(0, 2)]), (20.0, [2.0, 9.0, 19.0], [(0, 9), (9, 19), (19, 20)]), (130.0, [], [(0, 43.333), (43.333, 86.667), (86.667, 130)]), (10.0, None, [(0, 10)])])
def test_riffs(spark, duration, peaks, want):
    df = spark.createDataFrame([(1, duration, peaks)], "recording_id long, duration_sec double, peaks array<double>")
    assert [(r.start_sec, r.end_sec) for r in segment.assemble_riffs(df).orderBy("riff_index").collect()] == want


def test_boundary(spark):
    schema = "recording_id long, start_sec double, end_sec double, confidence double, method string"
    rows = [(1, 2, 90, 0.5, "energy_wall"), (1, 9, 80, 0.9, "pitched_content"), (2, 2, 90, 0.5, "energy_wall"), (2, 4, 80, 0.7, "pitched_content"), (3, 1, 50, 0.2, "energy_wall"), (3, 9, 60, 0.8, "pitched_content"), (4, 1, 50, 0.1, "energy_wall")]
    c = spark.createDataFrame([tuple(float(x) if isinstance(x, int) and i else x for i, x in enumerate(r)) for r in rows], schema)
    durations = spark.createDataFrame([(i, 100.0) for i in range(1, 6)], "recording_id long, duration_sec double")
    got = {r.recording_id: (r.start_sec, r.method) for r in trim.select_boundary(c, durations).collect()}
    assert got == {1: (2, "energy_wall"), 2: (4, "pitched_content"), 3: (9, "pitched_content"), 4: (1, "energy_wall"), 5: (0, "none")}


def test_rhythm(spark):
    beats = spark.createDataFrame([(1, i, float(i)) for i in range(3)], "recording_id long, idx long, t_sec double")
    points = spark.createDataFrame([(1, t, s) for t, s in ((-0.5, 9.0), (0.1, 1.0), (0.9, 3.0), (1.0, 2.0), (2.0, 7.0))], "recording_id long, t_sec double, strength double")
    assigned = rhythm.assign_beats(points, beats, ["recording_id"])
    assert sorted((r.t_sec, r.beat_idx) for r in assigned.collect()) == [(0.1, 0), (0.9, 0), (1.0, 1)]
    got = rhythm.beat_pattern(assigned, ["recording_id"], "strength", 4).first()
    shapes = [np.interp(np.linspace(0, len(v), 4), np.arange(len(v)), v) for v in ([1.0, 3.0], [2.0])]
    mean = np.mean([s / s.max() for s in shapes], axis=0)
    assert np.allclose(got.pattern, mean, atol=1e-4) and abs(got.uniformity - (1 - mean.std() / mean.mean())) < 1e-4
    onsets = spark.createDataFrame([(1, i, t) for i, t in enumerate((0.0, 0.12, 0.24, 2.19))], "recording_id long, idx long, t_sec double")
    h = np.histogram(np.diff([0.0, 0.12, 0.24, 2.19]), np.arange(0, 2.0, 0.05), density=True)[0]
    assert np.allclose(rhythm.ioi_histogram(onsets, ["recording_id"]).first().groove, h, atol=1e-3)


def test_catalogue(spark):
    assert value(spark, catalog.minutes(F.lit(119.7))) == "1:60" and value(spark, catalog.minutes(F.lit(0.0))) == "" and value(spark, catalog.minutes(F.lit(65.0))) == "1:05"
    sets = spark.createDataFrame([("a", "2026-04-07 10:00:00"), ("b", "2026-04-07 12:00:00"), ("c", "2026-04-08 12:00:00")], "set_id string, t string").withColumn("recorded_at", F.col("t").cast("timestamp"))
    assert {r.set_id: r.name for r in catalog.set_numbering(sets).collect()} == {"a": "2026-04-07 — Set 1", "b": "2026-04-07 — Set 2", "c": "2026-04-08"}


def test_merge_chain_and_components(spark):
    recordings = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "recording_id long, song_id string")
    songs = spark.createDataFrame([(f"s{i}",) for i in range(5)], "song_id string")
    rows = spark.createDataFrame([(f"s{i}", f"s{i + 1}", i) for i in range(4)], "from_id string, into_id string, seq int")
    out, left = edits.merge_songs(recordings, songs, rows)
    assert {r.song_id for r in out.collect()} == {"s4"} and [r.song_id for r in left.collect()] == ["s4"]
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 40), (40, 50), (60, 60), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 40: 30, 50: 30}


def test_undo_then_restore(spark):
    schema = "recording_id long, cut_start_sec double, cut_end_sec double, saved_cut_start_sec double, saved_cut_end_sec double, trim_method string"
    r = spark.createDataFrame([(1, 2.0, 9.0, None, None, "energy_wall")], schema)
    ids = r.select("recording_id")
    back, errors = edits.restore_trim(edits.undo_trim(r, ids), ids)
    assert tuple(back.first()) == (1, 2.0, 9.0, None, None, None) and errors.count() == 0


def test_ingest_twice_adds_nothing(spark):
    uploads = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "y", 3)], "filename string, file_hash string, arrival_seq long")
    created, duplicates = ingest.create_recordings(uploads, uploads.limit(0), "2025-01-01")
    assert sorted(r.filename for r in created.collect()) == ["a", "c"] and [r.filename for r in duplicates.collect()] == ["b"]
    assert ingest.create_recordings(uploads, created, "2025-01-01")[0].count() == 0


def test_few_pairs_are_judged_by_rhythm(spark):
    rows = [(1, 2, 0.9, 0.8, 0.8), (1, 3, 0.9, 0.6, 0.8), (2, 3, 0.9, 0.4, 0.8)]
    df = spark.createDataFrame(rows, "rec_lo long, rec_hi long, score double, groove double, drums double")
    banded = pairs.evidence_band(df)
    assert [r.band for r in banded.orderBy("rec_lo", "rec_hi").collect()] == ["strong", "ambiguous", "different"]
    groups = pairs.group_by_similarity(banded, spark.createDataFrame([(i,) for i in (1, 2, 3)], "recording_id long"))
    assert {r.recording_id: r.group_id for r in groups.collect()} == {1: 1, 2: 1, 3: 3}


def write_wav(path, samples, rate=22050, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.repeat(samples, channels) * 32767).astype("<i2").tobytes())


def test_audio(spark, tmp_path):
    t = np.arange(22050 * 2) / 22050
    write_wav(tmp_path / "a.wav", 0.5 * np.sin(2 * np.pi * 1000 * t))
    write_wav(tmp_path / "b.WAV", np.zeros(22050 * 2), channels=2)
    write_wav(tmp_path / "c.Wav", np.zeros(100))
    (tmp_path / "d").mkdir()
    write_wav(tmp_path / "d" / "e.wav", 0.5 * np.sin(2 * np.pi * 1000 * t))
    files = audio.scan_audio(spark, str(tmp_path))
    assert sorted(r.filename for r in files.collect()) == ["a.wav", "b.WAV", "e.wav"] and files.select("file_hash").distinct().count() == 2
    sound = audio.decode_pcm(files, "filename", chunk=11264, halo=9216)
    got = frames.frame_features(sound.where("recording_id = 'a.wav'")).where("frame_idx BETWEEN 4 AND 60").collect()
    assert all(abs(r.centroid - 1000) < 30 and abs(r.rolloff - 1000) < 15 and abs(r.rms - 0.3535) < 0.01 for r in got)
    loud = {r.recording_id: r for r in frames.loudness_gain(sound).collect()}
    assert loud["b.WAV"].loudness is None and loud["b.WAV"].gain == 1.0
    assert abs(loud["a.wav"].loudness - -9.03) < 0.15 and abs(loud["a.wav"].gain - 10 ** ((-14 - loud["a.wav"].loudness) / 20)) < 1e-9
    assert max(abs(v) for r in frames.apply_gain(sound, frames.loudness_gain(sound)).collect() for v in r.samples) <= 1
    riffs = sound.where("recording_id = 'a.wav' AND chunk_idx = 0").select("recording_id", F.lit(0).alias("riff_index"), "sr", "samples")
    split = frames.hpss_features(riffs).where("frame_idx BETWEEN 3 AND 30").collect()
    assert all(abs(r.centroid - 1000) < 30 for r in split)


def test_frames_do_not_depend_on_chunks(spark):
    """The windows of whole recordings, whatever the chunks, also where the last chunk is shorter than a window."""
    x = np.random.default_rng(3).normal(0, 0.1, 512 * 35 + 100)
    head = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHHI", 16, 1, 1, 22050, 44100, 2, 16, 0)[:20] + b"data"
    data = (x * 32767).astype("<i2").tobytes()
    files = spark.createDataFrame([("long", head + struct.pack("<I", len(data)) + data), ("short", head + struct.pack("<I", 200) + data[:200]), ("no sound", b"text")], "k string, content binary")
    got = {}
    for chunk in (512 * 4, 512 * 8, 1 << 18):
        rows = frames.frame_features(audio.decode_pcm(files, "k", chunk=chunk, halo=1536)).where("recording_id = 'long'").orderBy("frame_idx").collect()
        got[chunk] = [(r.frame_idx, round(r.rms, 9), round(r.t_sec, 9), *[round(v, 4) for v in (r.flatness, r.onset, r.centroid, r.rolloff, *r.contrast)]) for r in rows]
        assert rows[0].onset == 0 and all(r.onset > 0 for r in rows[1:])
    whole = np.frombuffer(data, "<i2") / 32768
    want = [np.sqrt((whole[i : i + 2048] ** 2).mean()) for i in range(0, len(whole) - 2047, 512)]
    assert len({tuple(v) for v in got.values()}) == 1
    assert [r[0] for r in got[2048]] == list(range(len(want))) and np.allclose([r[1] for r in got[2048]], want, atol=1e-6)


def manifest(folder, name, **fields):
    (folder / name).write_text(json.dumps(fields, indent=2) if fields else "{ broken")


def test_streams(spark, tmp_path):
    inbox, table, states = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "states")
    inbox.mkdir()
    manifest(inbox, "1.json", recordingId="r1", filePath="/a", filename="a.wav", fileHash="h1")
    manifest(inbox, "2.json")
    good, bad = tables.read_manifests(spark, str(inbox))
    assert [r.recording_id for r in good.collect()] == ["r1"] and bad.count() == 1

    def once():
        library.run(library.stream_manifests(spark, str(inbox)), library.dedup_into(table), str(tmp_path / "c")).awaitTermination()
        return sorted((r.recording_id, r.file_hash) for r in spark.read.parquet(table).collect())

    assert once() == [("r1", "h1")]
    manifest(inbox, "3.json", recordingId="r2", filePath="/b", filename="b.wav", fileHash="h1")
    manifest(inbox, "4.json", recordingId="r3", filePath="/c", filename="c.wav", fileHash="h2")
    assert once() == [("r1", "h1"), ("r3", "h2")] and once() == [("r1", "h1"), ("r3", "h2")]

    events = tmp_path / "events"
    for wave_, rows in enumerate(([(1, "uploading", 1), (2, "uploading", 2)], [(1, "grouped", 5), (2, "trimming", 4)])):
        spark.createDataFrame(rows, "recording_id long, state string, seq long").coalesce(1).write.mode("append").parquet(str(events))
        stream = spark.readStream.schema("recording_id long, state string, seq long").parquet(str(events))
        library.run(stream, library.states_into(states), str(tmp_path / "s")).awaitTermination()
    got = library.state_counts(spark.read.parquet(f"{states}/version=1"))
    assert {r.state: r.n for r in got.collect()} == {"grouped": 1, "trimming": 1}


def test_stream_match(spark, tmp_path):
    riffs = registry.matching_queries.ad.riffs(spark, "/root/testdata/sf0.001").where("riff_id < 60")
    riffs.write.parquet(str(tmp_path / "riffs"))
    stream = spark.readStream.schema(riffs.schema).parquet(str(tmp_path / "riffs"))
    library.run(stream, library.match_into(lambda s: s.read.parquet(str(tmp_path / "riffs")), str(tmp_path / "m")), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "m")).count() == matching.find_matches(riffs, riffs).count()


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "song", "grouped"), (2, "set", "ready")], "recording_id long, kind string, state string")
    tables.write_table(df, str(tmp_path / "t"), ["kind", "state"])
    assert spark.read.parquet(str(tmp_path / "t")).where("kind = 'set'").count() == 1
    tables.write_bucketed(df, "tests_bucketed", buckets=4)
    assert spark.table("tests_bucketed").count() == 2
    spark.sql("DROP TABLE tests_bucketed")
    lines = ['{"riff_id":"a","recording_id":"r","riff_index":0,"fingerprint":{"groove":[1.0],"tempo":120},"contour":[0.5,0.7]}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    r = tables.read_riffs(spark, str(tmp_path / "r.json")).first()
    assert (r.contour, r.intervals, r.groove, r.drums, r.tempo) == ([0.5, 0.7], [], [1.0], [], 120.0)


def test_similarity_groups_follow_the_bands(spark):
    """The groups are the components of what the query of P9 calls strong, by brute force."""
    folder, queries = "/root/testdata/sf0.001", registry.queries()
    got = {r.recording_id: r.group_id for r in queries["p10_similarity_groups"](spark, folder).collect()}
    want = {r: r for r in got}
    for r in queries["p9_evidence_band"](spark, folder).where("band = 'strong'").collect():
        low, high = sorted((want[r.rec_lo], want[r.rec_hi]))
        want = {k: low if v == high else v for k, v in want.items()}
    assert got == want and len(set(got.values())) < 10


def test_merges_go_in_order_of_seq(spark):
    schema = "from_id string, into_id string, seq int"

    def merged(rows):
        recordings = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None)], "recording_id long, song_id string")
        songs = spark.createDataFrame([("A",), ("B",), ("C",)], "song_id string")
        out, left = edits.merge_songs(recordings, songs, spark.createDataFrame(rows, schema))
        return {r.recording_id: r.song_id for r in out.collect()}, {r.song_id for r in left.collect()}

    def one_by_one(rows):
        at, left = {1: "A", 2: "B", 3: "C", 4: None}, {"A", "B", "C"}
        for source, target, _ in sorted(rows, key=lambda r: r[2]):
            if source != target:
                at, left = {k: target if v == source else v for k, v in at.items()}, left - {source}
        return at, left

    cases = [[("A", "B", 1), ("B", "A", 2)], [("B", "C", 1), ("A", "B", 2)], [("A", "B", 1), ("B", "C", 2), ("C", "A", 3), ("A", "B", 4)], [("A", "A", 1)], []]
    for rows in cases:
        assert merged(rows) == one_by_one(rows)


def test_scores_are_rounded_as_binary_values(spark):
    values = [0.5035, 0.5045, 0.0625, 0.0, 1.0, 0.9995, 0.1235]
    rows = [(i, i + 100, v, v, v, v, v, v, "blast") for i, v in enumerate(values)]
    found = spark.createDataFrame(rows, "rec_lo long, rec_hi long, score double, groove double, drums double, contour double, spectral double, tempo double, weights string")
    names = spark.createDataFrame([], "recording_id long, filename string")
    got = {r.rec_lo: r.block for r in report.similarity_section(found, names).collect()}
    assert all(f"Overall: {v:.3f}\n" in got[i] and f"Drums: {v:.3f} " in got[i] for i, v in enumerate(values))


def test_the_later_batch_holds(spark):
    recordings = spark.createDataFrame([("1", "song", "ungrouped", None)], "recording_id string, kind string, state string, song_id string")
    songs = spark.createDataFrame([], "song_id string, title string, notes string")
    groups = spark.createDataFrame([("9", 0, "nine", "", None, ["1"]), ("10", 0, "ten", "", None, ["1"])], "batch_id string, place int, title string, notes string, existing_song_id string, recording_ids array<string>")
    assert report.apply_grouping(groups, recordings, songs, "2025-01-01")[0].first().song_id == "song-10-0"


def test_without_the_corpus_operators(tmp_path):
    """The entry points and the library's queries work in a copy that lacks the operators and the pipeline, or the operators alone."""
    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "takewise", tmp_path / "takewise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pairs_best' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    (tmp_path / "corpus_pipeline.py").write_text("import takewise.llm\n")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_loudness_reads_samples_once(spark):
    """Each chunk passes once, and the filter's beginnings at chunks don't show in the result."""
    x = 0.3 * np.sin(2 * np.pi * 700 * np.arange(22050 * 3) / 22050)
    seen = spark.sparkContext.accumulator(0)

    def chunks(size):
        rows = [("a", 22050, i, at, x[at : at + size + 11025].tolist(), []) for i, at in enumerate(range(0, len(x), size))]
        rows += [("short", 22050, 0, 0, x[:100].tolist(), []), ("silent", 22050, 0, 0, [0.0] * 22050, [])]

        def count(parts):
            for part in parts:
                seen.add(len(part))
                yield part

        return spark.createDataFrame(rows, audio.CHUNK).mapInPandas(count, audio.CHUNK), len(rows)

    got = {}
    for size in (22050, 33000):
        sound, n = chunks(size)
        before = seen.value
        got[size] = {r.recording_id: (r.loudness, r.gain) for r in frames.loudness_gain(sound).collect()}
        assert seen.value - before == n
        assert got[size]["short"] == got[size]["silent"] == (None, 1.0)
    assert abs(got[22050]["a"][0] - got[33000]["a"][0]) < 0.05
