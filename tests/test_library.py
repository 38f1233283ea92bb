"""Blocks and bounds of matching, ids of any type, files read by ranges, streams with state, and tables that are edited in part."""

import glob
import json
import math
import os
import random
import resource
import struct
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from takewise.operators import blocks, edits, graph, matching, pairs, rollup, scoring, segment
from takewise.plans import file_queries, matching_queries, report_queries
from takewise.sources import audio, tables, versioned, wav
from takewise.streaming import library, stateful

RIFF = "riff_id string, recording_id string, riff_order long, tempo double, uniformity double, groove array<double>, drums array<double>, spectral array<double>, contour array<double>, intervals array<int>"


def made_riffs(n, seed=1, kinds=4, hot=False):
    """Riffs of a few kinds, each with tempos, intervals and vectors of its own."""
    r = np.random.default_rng(seed)
    middle = [(r.uniform(40, 260), r.integers(-2, 3, 30), r.random((3, 8))) for _ in range(kinds)]
    out = []
    for i in range(n):
        tempo, steps, vectors = middle[i % kinds]
        steps = np.where(r.random(30) < 0.1, r.integers(-2, 3, 30), steps)
        curve = np.cumsum(np.r_[0, steps]) + r.normal(0, 0.2, 31)
        tempo = 120.0 if hot and i % 3 else tempo * r.uniform(0.97, 1.03)
        lists = [(v + r.normal(0, 0.05, 8)).tolist() for v in vectors]
        row = [f"r{i}", f"rec{i // 3}", i, float(tempo), float(r.random()), *lists, curve.tolist(), steps.tolist()]
        if i % 17 == 0:
            row[9] = [] if i % 2 else None
        if i % 23 == 0:
            row[3], row[8] = None if i % 2 else 0.0, None
        if i % 29 == 0:
            row[5], row[4] = [0.0] * 8, None
        out.append(tuple(row))
    return out


def plain_matches(new, library, least):
    out = set()
    cos = lambda a, b: 0.0 if not a or not b or np.linalg.norm(a) < 1e-10 or np.linalg.norm(b) < 1e-10 else max(0.0, float(np.dot(a, b)) / float(np.linalg.norm(a) * np.linalg.norm(b)))
    for a in new:
        for b in library:
            if a[0] == b[0] or a[1] == b[1] or not a[3] or not b[3]:
                continue
            tempo = max(min(x, y) / max(x, y) for x, y in ((a[3], b[3]), (a[3], 2 * b[3]), (2 * a[3], b[3])))
            if tempo < 0.6 or a[9] and b[9] and cos(a[9], b[9]) < 0.15:
                continue
            ua, ub = (0.5 if u is None else u for u in (a[4], b[4]))
            label = "blast" if ua > 0.7 and ub > 0.7 else "groove" if ua < 0.4 and ub < 0.4 else "balanced"
            sims = {"tempo": 1.0 if tempo >= 0.85 else tempo, "groove": cos(a[5], b[5]), "drums": cos(a[6], b[6]), "spectral": cos(a[7], b[7]), "contour": 0.0}
            if a[8] and b[8]:
                row = [0.0] * (len(b[8]) + 1)
                for x in a[8]:
                    row = [np.inf] + [(x - b[8][j]) ** 2 + min(row[j + 1], row[j]) for j in range(len(b[8]))]
                sims["contour"] = max(0.0, 1 - min(row[1:]) / min(len(a[8]), len(b[8])) / 2)
            score = np.floor(sum(w * sims[k] for k, w in scoring.WEIGHTS[label].items()) * 1e4 + 0.5) / 1e4
            if score >= least:
                out.add((a[0], b[0], float(score), label))
    return out


@pytest.mark.parametrize("least", [0.3, 0.8])
@pytest.mark.parametrize("cut", [(1, 1), (6, 9)])
def test_matches_of_text_ids(spark, least, cut):
    rows = made_riffs(120)
    riffs = spark.createDataFrame(rows, RIFF)
    new = riffs.where("riff_order % 5 = 0")
    got = {(r.riff_a_id, r.riff_b_id, r.score, r.weights) for r in matching.find_matches(new, riffs, least, *cut).collect()}
    assert got == plain_matches(rows[::5], rows, least) and len(got) > 50


def test_hot_tempo_and_skipped_blocks(spark):
    """One tempo in two thirds of all riffs is cut into blocks like any other; blocks that cannot match don't meet."""
    riffs = spark.createDataFrame(made_riffs(400, 2, hot=True), RIFF)
    assert blocks.blocked(riffs, 2000).select("block").distinct().count() > 300  # more blocks than ranges
    cut = blocks.blocked(riffs, 8)
    assert max(r["count"] for r in cut.groupBy("block").count().collect()) <= 2 * 400 / 8
    apart = spark.createDataFrame(made_riffs(400, 3, kinds=6), RIFF).withColumn("tempo", F.when(F.col("riff_order") % 2 == 0, 40.0).otherwise(200.0) + F.col("riff_order") / 1000)
    sides = [blocks.summaries(blocks.blocked(apart, 8)) for _ in range(2)]
    met = {(r.block_a, r.block_b) for r in blocks.pairs(*sides, 0.3).collect()}
    assert met == {(a, b) for a in range(8) for b in range(8) if (a < 4) == (b < 4)}
    one, many = ({(r.riff_a_id, r.riff_b_id, r.score) for r in matching.find_matches(apart, apart, 0.5, n, n).collect()} for n in (1, 8))
    assert one == many and one


def test_bounds_of_blocks_hold(spark):
    """No pair that matches is in blocks that the summaries keep apart, however high the score asked for."""
    rows = made_riffs(300, 5, kinds=12)
    riffs = spark.createDataFrame(rows, RIFF).where("size(intervals) > 0").withColumn("tempo", F.col("riff_order") % 12 * 20 + 45.0)
    cut = blocks.blocked(riffs, 12)
    summaries = blocks.summaries(cut)
    block = {r.riff_id: r.block for r in cut.collect()}
    for least in (0.3, 0.7, 0.9, 0.97):
        met = {(r.block_a, r.block_b) for r in blocks.pairs(summaries, summaries, least).collect()}
        found = matching.find_matches(riffs, riffs, least, 1, 1).collect()
        assert {(block[r.riff_a_id], block[r.riff_b_id]) for r in found} <= met
    assert len(met) < 144


def test_warping_stops_early():
    r = np.random.default_rng(4)
    a, b = r.normal(size=(300, 40)), r.normal(size=(300, 35)) + r.normal(0, 1.5, (300, 1))
    whole = scoring.warp_batch(a, b)
    least = np.quantile(whole, r.random(300))
    told = scoring.Warps()
    got = scoring.warp_batch(a, b, 2 * 35 * (1 - least), told)
    near = whole >= least
    assert np.allclose(got[near], whole[near]) and (got[~near] <= whole[~near] + 1e-12).all()
    assert told.enveloped > 0 and told.abandoned > 0 and told.rows < told.possible == 300 * 40


def test_tests_without_pair_rows(spark):
    rows = made_riffs(90)
    riffs = spark.createDataFrame(rows, RIFF)
    by_rows = {(r.a, r.b) for r in matching.candidate_pairs(riffs, riffs).where(matching.interval_test(F.coalesce("a.intervals", F.array().cast("array<int>")), F.coalesce("b.intervals", F.array().cast("array<int>")))).select(F.col("a.riff_id").alias("a"), F.col("b.riff_id").alias("b")).collect()}
    assert {(r.riff_a_id, r.riff_b_id) for r in matching.tested_pairs(riffs, riffs).collect()} == by_rows
    assert matching.match_stats(riffs, riffs, matching.find_matches(riffs, riffs)).first().compared == len(by_rows)


def test_tempos_round_as_in_sql(spark, monkeypatch):
    """Next to a half F.round and DuckDB differ."""
    near = [0.7072174999999999, 0.7072444999999999, 0.7072714999999999, 0.7073294999999999]
    rows = [(50 * i, 10 * i, i, t) for i, t in enumerate(near, 1)] + [(1, 1, 0, 1.0)]
    monkeypatch.setattr(matching_queries.ad, "riffs", lambda *_: spark.createDataFrame(rows, "riff_id long, recording_id long, riff_order long, tempo double"))
    got = {r.riff_a_id: r.similarity for r in matching_queries.tempo_candidates(spark, "").where("riff_b_id = 1").collect()}
    assert got == {50 * i: duckdb.execute("SELECT round(?::DOUBLE, 6)", [t]).fetchall()[0][0] for i, t in enumerate(near, 1)}


def test_tempos_of_full_blocks_meet_in_bounded_memory():
    """Two blocks as large as they get are compared tile by tile."""
    n = blocks.RIFFS
    ids = np.arange(n)
    sides = [scoring.Side(pa.table({"riff_id": ids + k * n, "recording_id": (ids + k * n) // 5, "tempo": 100 + ids % 50 / 7})) for k in range(2)]
    tracemalloc.start()
    found = sum(len(i) for i, _, _ in scoring.tested(*sides, False))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * n and most < 40e6


def test_text_ids_from_file_to_groups(spark, tmp_path):
    """Riffs as the library stores them, with ids as text, through matching, pairs, groups, peaks and states."""
    lines = []
    for id_, recording, order, tempo, uniformity, groove, drums, spectral, contour, intervals in made_riffs(60):
        lines.append(json.dumps({"riff_id": id_, "recording_id": recording, "riff_index": order % 3, "start_sec": 0.0, "end_sec": 1.0, "fingerprint": {"groove": groove, "drums": drums, "spectral": spectral, "tempo": tempo, "onsetUniformity": uniformity}, "contour": {"contour": contour, "intervals": intervals}}))
    (tmp_path / "riffs.json").write_text("\n".join(lines))
    riffs = tables.read_riffs(spark, str(tmp_path / "riffs.json"))
    matches = matching.find_matches(riffs, riffs)
    assert {(r.riff_a_id, r.riff_b_id, r.score, r.weights) for r in matches.collect()} == plain_matches(made_riffs(60), made_riffs(60), 0.3)
    best = pairs.best_pair_matches(matches)
    assert dict(best.dtypes)["rec_lo"] == "string" and best.count() > 10
    groups = pairs.group_by_similarity(pairs.evidence_band(best), riffs)
    assert groups.count() == 20 and dict(groups.dtypes)["group_id"] == "string"
    curve = spark.createDataFrame([("rec0", i, v) for i, v in enumerate([0.0, 1.0, 0.0, 0.5, 0.0])], "recording_id string, frame_idx long, novelty double")
    assert [(r.recording_id, r.frame_idx) for r in segment.novelty_peaks(curve, 0.3, 5).collect()] == [("rec0", 1)]


def write(path, data, tag, bits, channels, rate, extensible=False):
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, bits, 0, tag) + b"\0" * 14
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    path.write_bytes(b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks)


def written(folder):
    """(name, samples) of files in every code that is read, and some that aren't."""
    r = np.random.default_rng(6)
    x = r.uniform(-0.9, 0.9, (5000, 2))
    packed = lambda v, n: b"".join(int(s).to_bytes(4, "little", signed=True)[:n] for s in v.ravel())
    whole = {16: np.round(x * 32767), 24: np.round(x * 8388607), 32: np.round(x * 2147483647)}
    write(folder / "f32.wav", x.astype("<f4").tobytes(), 3, 32, 2, 44100)
    write(folder / "f64.wav", x.astype("<f8").tobytes(), 3, 64, 2, 44100, True)
    write(folder / "u8.wav", np.round(x * 127 + 128).astype(np.uint8).tobytes(), 1, 8, 2, 48000)
    write(folder / "i16.wav", packed(whole[16], 2), 1, 16, 2, 22050)
    write(folder / "i24.wav", packed(whole[24], 3), 1, 24, 2, 44100, True)
    write(folder / "i32.wav", packed(whole[32], 4), 1, 32, 2, 96000)
    write(folder / "none.wav", b"", 1, 16, 1, 22050)
    write(folder / "law.wav", b"\x55" * 400, 6, 8, 1, 8000)
    (folder / "text.wav").write_bytes(b"no sound at all")
    (folder / "cut.wav").write_bytes((folder / "i16.wav").read_bytes()[:1001])
    return x.mean(1)


def test_codes_of_samples(spark, tmp_path):
    x = written(tmp_path)
    for name, near in (("f32", 1e-6), ("f64", 1e-12), ("u8", 0.012), ("i16", 5e-5), ("i24", 2e-7), ("i32", 1e-9)):
        rate, got = audio.pcm((tmp_path / f"{name}.wav").read_bytes())
        assert np.abs(got - x).max() < near, name
    assert audio.pcm((tmp_path / "law.wav").read_bytes()) is None and audio.pcm(b"text") is None
    silence = tmp_path / "silence.wav"
    write(silence, b"\x80" * 100, 1, 8, 1, 8000)
    assert not audio.pcm(silence.read_bytes())[1].any()


@pytest.mark.parametrize("target,chunk", [(22050, 1024), (None, 2048), (22050, 1 << 18), (32000, 512)])
def test_ranges_are_the_whole_file(spark, tmp_path, target, chunk):
    written(tmp_path)
    key = lambda df: {(r.recording_id, r.chunk_idx): r for r in df.collect()}
    whole = key(audio.decode_pcm(audio.scan_audio(spark, str(tmp_path)), "filename", target, chunk, 700))
    parts = key(wav.read_ranges(wav.list_audio(spark, str(tmp_path)), "filename", target, chunk, 700))
    assert parts.keys() == whole.keys() and len({k for k, _ in whole}) == 8
    for k, r in whole.items():
        assert (parts[k].sr, parts[k].first) == (r.sr, r.first)
        assert np.allclose(parts[k].samples, r.samples, atol=1e-6) and np.allclose(parts[k].before, r.before, atol=1e-6), k


def test_second_scan_reads_nothing(spark, tmp_path, monkeypatch):
    written(tmp_path)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "more.WAV").write_bytes(b"x" * 100)
    (tmp_path / "other.Wav").write_bytes(b"x")
    journal = spark.createDataFrame([], "path string, bytes long, modified timestamp, file_hash string")
    first = wav.scan_new(spark, str(tmp_path), journal).collect()
    assert {(r.filename, r.file_hash) for r in first} == {(r.filename, r.file_hash) for r in audio.scan_audio(spark, str(tmp_path)).collect()} and len(first) == 11
    journal = spark.createDataFrame(first)
    assert wav.unseen(wav.list_audio(spark, str(tmp_path)), journal).count() == 0
    (tmp_path / "law.wav").write_bytes(b"changed")
    again = wav.scan_new(spark, str(tmp_path), journal).collect()
    assert [(r.filename, r.bytes) for r in again] == [("law.wav", 7)]


def test_states_are_not_forgotten(spark, tmp_path):
    each = library.states_into(str(tmp_path / "s"))
    frame = lambda rows: spark.createDataFrame(rows, "recording_id string, state string, seq long")
    each(frame([("a", "uploading", 1), ("b", "uploading", 2)]), 0)
    each(frame([("a", "grouped", 5)]), 3)  # batches between may have been empty
    assert {(r.recording_id, r.state) for r in spark.read.parquet(str(tmp_path / "s/version=3")).collect()} == {("a", "grouped"), ("b", "uploading")}
    each(frame([("a", "trimming", 4)]), 3)
    with pytest.raises(ValueError):  # the checkpoint was lost and the stream starts over
        each(frame([("c", "uploading", 9)]), 0)
    with pytest.raises(ValueError):
        library.states_into(str(tmp_path / "t"))(frame([("c", "uploading", 9)]), 5)


def test_stateful_counts_after_any_batching(spark, tmp_path):
    """Events out of order, ties and restarts, ids as text: the counts are those of the latest states."""
    own = stateful.with_rocksdb(spark)
    r = random.Random(3)
    events = [(f"rec{r.randrange(9)}", r.choice(["uploading", "trimming", "grouped"]), r.randrange(30)) for _ in range(120)] + [("none", "grouped", None)]
    schema = "recording_id string, state string, seq long"
    for k, part in enumerate((events[:40], events[40:45], events[45:])):
        spark.createDataFrame(part, schema).repartition(k + 1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        library.run(stateful.state_changes(stream), stateful.counts_into(str(tmp_path / "out")), str(tmp_path / "c"), mode="update").awaitTermination()
        want = library.state_counts(library.latest_states(spark.read.schema(schema).parquet(str(tmp_path / "in"))))
        assert {(x.state, x.n) for x in stateful.current_counts(spark, str(tmp_path / "out")).collect()} == {(x.state, x.n) for x in want.collect()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != own.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_first_manifests_survive_a_restart(spark, tmp_path):
    own = stateful.with_rocksdb(spark)
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()

    def once(*hashes):
        for i, h in enumerate(hashes):
            (inbox / f"{len(list(inbox.iterdir()))}.json").write_text(json.dumps({"recordingId": f"r{i}", "filePath": "/a", "filename": "a.wav", "fileHash": h}))
        stream = stateful.first_manifests(stateful.stream_dated_manifests(own, str(inbox)))
        library.run(stream, lambda b, n: b.select("file_hash").write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "c")).awaitTermination()
        return sorted(r.file_hash for r in spark.read.parquet(str(out)).collect())

    assert once("h1", "h2", "h1") == ["h1", "h2"]
    assert once("h2", "h3") == ["h1", "h2", "h3"] and once() == ["h1", "h2", "h3"]


def test_pairs_are_kept_up(spark, tmp_path):
    """After merges and batches done twice the pairs are those of all matches at once."""
    riffs = spark.createDataFrame(made_riffs(60), RIFF)
    matches = matching.find_matches(riffs, riffs).cache()
    each = library.best_pairs_into(str(tmp_path / "p"), every=2)
    for n in (0, 1, 1, 2, 3, 4, 4):
        each(matches.where(F.pmod(F.xxhash64("riff_a_id"), F.lit(5)) == n), n)
    got, want = ({tuple(r) for r in df.collect()} for df in (library.best_pairs(spark, str(tmp_path / "p")), pairs.best_pair_matches(matches)))
    assert got == want and tables.versions(spark, str(tmp_path / "p/merged")) == [1, 3]


def test_components_grow(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [("n1", None), ("n2", "n2")]
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string")
    want = {(x.node, x.component) for x in graph.connected_components(frame(edges)).collect()}
    for cuts in ((0, 15, 16, 47), (0, 40, 47)):
        labels = spark.createDataFrame([], "node string, component string")
        for a, b in zip(cuts, cuts[1:]):
            labels = graph.update_components(labels, frame(edges[a:b]))
        got = {(x.node, x.component) for x in labels.collect()}
        assert {x for x in got if x[0] != "n2" or x in want} == want or got == want | {("n2", "n2")}


def test_edits_rewrite_touched_parts(spark, tmp_path):
    rows = [(i, "song" if i % 5 else "set", ["grouped", "ungrouped", "ready"][i % 3], float(i)) for i in range(90)]
    recordings = spark.createDataFrame(rows, "recording_id long, kind string, state string, tempo double")
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), ["kind", "state"], most=2)
    table.create(recordings)
    files = lambda: set(glob.glob(f"{tmp_path}/t/data/**/*.parquet", recursive=True))
    before = files()
    patches = spark.createDataFrame([(3, 1, "ready", None), (6, 2, None, 7.5), (999, 3, "ready", 1.0)], "recording_id long, seq int, state string, tempo double")
    want = edits.update_state(recordings, patches)
    plain = lambda df: sorted((r.recording_id, r.kind, r.state, r.tempo) for r in df.collect())
    assert table.edit(patches, "recording_id", lambda part: edits.update_state(part, patches)) == 1
    assert plain(table.read()) == plain(want) and plain(table.read(0)) == plain(recordings)
    assert before <= files() and {f.split("/data/")[1].split("/written")[0] for f in files() - before} == {"kind=song/state=grouped", "kind=song/state=ready"}
    for i in (9, 12, 18, 21):
        one = spark.createDataFrame([(i, 1, "ready", None)], patches.schema)
        want = edits.update_state(want, one)
        table.edit(one, "recording_id", lambda part, one=one: edits.update_state(part, one))
        assert plain(table.read()) == plain(want)
    assert max(r["count"] for r in table._list(table.version).groupBy("kind", "state").count().collect()) <= 4
    nobody = spark.createDataFrame([(5000, 1, "ready", None)], patches.schema)
    table.edit(nobody, "recording_id", lambda part: edits.update_state(part, nobody))
    assert plain(table.read()) == plain(want)
    with pytest.raises(ValueError):
        table.create(recordings)


def test_manifests_lie_side_by_side(spark):
    """Listing them is one request, not one a file; the names stay those of the suppliers."""
    folder = file_queries._manifests(spark, "/root/testdata/sf0.001")
    root = folder.removeprefix("file:")
    found = sorted(n for n in os.listdir(root) if not n.startswith("."))
    want = sorted(f"file=n{r.s_suppkey:09d}.json" for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").collect())
    assert found == want and all(os.path.isfile(f"{root}/{n}") for n in found)


def test_results_of_a_pair_of_blocks_pass_through(spark):
    """A task sends its results on as they come and doesn't hold them: here 480 MB of one pair of blocks."""
    riffs = spark.createDataFrame(made_riffs(20), RIFF)

    def run(a, b):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        for _ in range(60):
            yield pa.table({"n": np.arange(1 << 20), "grown": np.full(1 << 20, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)})

    got = blocks.meet(riffs, riffs, riffs.columns, run, "n long, grown long", 0.0, blocks=(1, 1)).agg(F.count("*").alias("n"), F.max("grown").alias("grown")).first()
    assert got.n == 60 << 20 and got.grown < 150_000  # kilobytes


def test_pairs_of_blocks_have_tasks_of_their_own(spark):
    """No task has to work off several pairs of blocks while others are idle, and no shuffle follows."""
    riffs = spark.createDataFrame(made_riffs(200), RIFF)
    got = matching.find_matches(riffs, riffs, 0.3, 3, 5)
    assert got.rdd.getNumPartitions() == 15 and (got.groupBy(F.spark_partition_id()).count().count()) > 5


def test_counts_need_no_warping(spark, monkeypatch):
    """Matched pairs are counted, and bounded ones, without the curves where these don't matter."""
    rows = made_riffs(90)
    riffs = spark.createDataFrame(rows, RIFF)
    for least in (0.3, 0.8):
        given = matching.match_stats(riffs, riffs, matching.find_matches(riffs, riffs, least)).first()
        assert matching.match_stats(riffs, riffs, least=least).first() == given and given.matched
    whole, counted = (matching.warp_counts(riffs, riffs, 0.8, warping=w).first() for w in (True, False))
    assert (whole.compared, whole.bounded) == (counted.compared, counted.bounded) and whole.bounded and counted.rows is None
    sides = [scoring.Side(matching._side(riffs, *matching._VALUES).toArrow()) for _ in range(2)]
    told = scoring.Warps()
    assert scoring.matched(*sides, 0.2, told) == given.compared >= 10 * told.possible / 31
    alone = {(r.riff_a_id, r.riff_b_id, r.score) for r in matching.matches_of_riff(riffs, riffs, "r7").collect()}
    assert alone == {(a, b, s) for a, b, s, _ in plain_matches(rows, rows, 0.3) if "r7" in (a, b)} and alone


def test_sounds_keep_their_parts(spark):
    """Levels are so small that their parts would be put together; the sounds made of them are not."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert file_queries._sounds(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pairs_carry_no_vectors():
    """What is made for a pair are the columns asked for; the vectors of its riffs aren't copied for it."""
    side = pa.table({"riff_id": pa.array(range(60)), "recording_id": pa.array(range(60)), "riff_order": pa.array(range(60)), "contour": pa.array([[0.5] * 5000] * 60)})
    i, j = (x.ravel() for x in np.indices((60, 60)))
    pool = pa.system_memory_pool()
    before, old = pool.max_memory(), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        got = matching._joined(side, side, i, j, ["riff_a_id", "riff_b_id"])
    finally:
        pa.set_memory_pool(old)
    assert sorted(got) == ["riff_a_id", "riff_b_id"] and got["riff_b_id"].to_pylist() == j.tolist()
    assert pool.max_memory() - before < 2**20


def test_columns_asked_for(spark):
    riffs = spark.createDataFrame(made_riffs(60), RIFF)
    got = matching.find_matches(riffs, riffs, 0.5, columns=["riff_b_id", "riff_a_id", "weights"])
    assert got.columns == ["riff_b_id", "riff_a_id", "weights"]
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in matching.find_matches(riffs, riffs, 0.5).select(*got.columns).collect()}


@pytest.mark.parametrize("least", [0.3, 0.8])
@pytest.mark.parametrize("scale", [1.0, 3e7])
def test_single_precision_rounds_as_double(spark, monkeypatch, least, scale):
    """Scores and contours warped in single precision have the digits of double precision, where warping stops early too."""
    riffs = spark.createDataFrame(made_riffs(300, 7), RIFF).withColumn("contour", F.transform("contour", lambda x: x * scale))
    side = scoring.Side(matching._side(riffs, *matching._VALUES).toArrow())
    told = lambda: {(int(a), int(b)): (float(s), float(c)) for i, j, _, sims, score in scoring.scored(side, side, least, scoring.Warps()) for a, b, s, c in zip(i, j, score, scoring.rounded(sims["contour"]))}
    got = told()
    monkeypatch.setattr(scoring, "SINGLE", -1.0)
    side.kept.clear()
    assert got == told() and len(got) > 1000


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_best_pairs_and_overlaps_without_matches(spark, monkeypatch, least):
    """Pairs of recordings straight from riffs are those of all matches, with ties, text ids, and riffs of no recording."""
    rows = made_riffs(150, 3)
    rows += [(f"again{i}", f"rec{60 + i // 2}", 200 + i % 3, *r[3:]) for i, r in enumerate(rows[:40])]  # copies, some of equal order
    rows += [("lost", None, 300, *rows[1][3:])]
    riffs = spark.createDataFrame(rows, RIFF)
    for new in (riffs, riffs.where("riff_order % 4 = 0"), riffs.where("riff_order < 0")):
        matches = matching.find_matches(new, riffs, least, 1, 1)
        got, want = ({tuple(r) for r in df.collect()} for df in (rollup.best_pairs(new, riffs, least), pairs.best_pair_matches(matches)))
        assert got == want
        got, want = ({tuple(r) for r in df.collect()} for df in (rollup.overlaps(new, riffs, riffs, least), pairs.riff_overlap(matches, riffs)))
        assert got == want
    new = riffs.where("riff_order % 4 = 0")
    want = {tuple(r) for r in rollup.best_pairs(new, riffs, least).collect()}
    monkeypatch.setattr(blocks, "RIFFS", 8)  # a recording has more than an eighth of a block
    assert want and {tuple(r) for r in rollup.best_pairs(new, riffs, least).collect()} == want


@pytest.mark.parametrize("query", [matching_queries.pairs_library, matching_queries.pairs_best, matching_queries.pairs_overlap, report_queries.QUERIES["p4_similarity_blocks"]])
def test_no_match_is_shuffled(spark, query):
    """What is asked of two recordings is found where their riffs meet: nothing is aggregated over matches."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("FlatMapGroupsInArrow")[0].split("MapInArrow")[0]
    assert "FlatMapGroupsInArrow" in plan and "max(" not in above and "count(distinct" not in above.lower()


def test_stored_matches_are_found_once(spark):
    new = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, None), (4, 0.7)], "id long, score double")
    assert sorted(map(tuple, edits.store_again(new, F.col("score") >= 0.7).collect()), key=repr) == sorted(map(tuple, edits.store(new.where("score >= 0.7"), new).collect()), key=repr)
    plan = matching_queries.matches_stored(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
