"""What grows with the square of the input stays out of shuffles and files, and results are the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from takewise.operators import blocks, frames, graph, matching, pairs, report, rollup, scoring
from takewise.plans import matching_queries, report_queries
from takewise.sources import tables
from takewise.streaming import library
from test_library import RIFF, made_riffs, plain_matches

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_samples_of_riffs_do_not_travel(spark):
    r = np.random.default_rng(8)
    riffs = spark.createDataFrame([("a", 0, 22050, r.normal(0, 0.1, 9000).tolist()), ("a", 1, 22050, np.repeat(r.normal(0, 0.3, 9), 512).tolist())], "recording_id string, riff_index int, sr int, samples array<float>")
    got = frames.hpss_features(riffs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan
    assert {(x.riff_index, x.frame_idx) for x in got.collect()} == {(0, i) for i in range(14)} | {(1, i) for i in range(6)}


@pytest.mark.parametrize("size", [31, 5, 1, 30])
def test_medians_are_those_of_numpy(size):
    s = np.abs(np.random.default_rng(size).normal(0, 1, (20, 150)).round(1))
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size - size // 2 - 1)
        want = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(s, pad, mode="symmetric"), size, axis=axis), axis=-1)
        assert np.array_equal(frames._median(s, size, axis), want)


def test_pairs_of_a_stream_of_riffs(spark, tmp_path):
    """Batches of riffs leave one row a pair of recordings, and no matches; those are the pairs of all matches at once."""
    riffs = spark.createDataFrame(made_riffs(60), RIFF).withColumn("batch", F.pmod(F.xxhash64("riff_id"), F.lit(3))).cache()
    path = str(tmp_path / "p")
    each = library.riff_pairs_into(lambda s: riffs.drop("batch"), path, every=2)
    for n in (0, 1, 1, 2):
        each(riffs.where(F.col("batch") == n).drop("batch"), n)
    want = rows(pairs.best_pair_matches(matching.find_matches(riffs, riffs)))
    assert rows(library.best_pairs(spark, path)) == want and want
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == ["merged", "parts"] and tables.versions(spark, f"{path}/merged") == [1]
    part = spark.read.parquet(f"{path}/parts/batch=0")
    assert part.count() == part.select("rec_lo", "rec_hi").distinct().count()


def test_riffs_go_only_where_new_ones_are(spark, monkeypatch):
    """The library's recordings that have no new riff don't meet each other, and rows that are new and the library's go once."""
    monkeypatch.setattr(blocks, "RIFFS", 60)
    riffs = matching._side(spark.createDataFrame([r for r in made_riffs(900, 5) if r[3]], RIFF), *matching._VALUES).cache()
    n, new = riffs.count(), riffs.where("pmod(xxhash64(recording_id), 10) = 0")
    dealt, tasks = rollup._dealt(new, riffs)
    counts = {r.side: r.n for r in dealt.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts[1] < 8 * n and counts[0] < 40 * new.count()
    assert dealt.select("task").distinct().count() <= tasks
    assert dealt.where("mixed AND side = 1").join(new.select("recording_id").distinct(), "recording_id").count() == 0
    whole, _ = rollup._dealt(riffs, riffs)
    assert whole.where("side = 1").count() == 0
    for a in (new, riffs):
        assert rows(rollup.best_pairs(a, riffs)) == rows(pairs.best_pair_matches(matching.find_matches(a, riffs, 0.3, 1, 1)))


def test_columns_of_best_pairs(spark, monkeypatch):
    riffs = spark.createDataFrame(made_riffs(90, 9), RIFF).withColumn("names", F.array(F.concat(F.lit("n"), "recording_id")))
    new = riffs.where("riff_order % 4 = 0")
    columns = ["score", "rec_hi", "order_b", "rec_lo", "order_a"]
    got = rollup.best_pairs(new, riffs, 0.5, columns, carried="names")
    assert got.columns == [*columns, "names_lo", "names_hi"]
    want = {(r.m.score, r.rec_hi, -r.m.before_b, r.rec_lo, -r.m.before_a, f"n{r.rec_lo}", f"n{r.rec_hi}") for r in pairs.ranked(matching.find_matches(new, riffs, 0.5)).collect()}
    assert {(*r[:5], *r.names_lo, *r.names_hi) for r in got.collect()} == want and want
    monkeypatch.setattr(blocks, "RIFFS", 8)  # a recording has more than an eighth of a block
    assert {(*r[:5], *r.names_lo, *r.names_hi) for r in rollup.best_pairs(new, riffs, 0.5, columns, carried="names").collect()} == want


def test_bands_shuffle_no_pairs(spark):
    made = spark.createDataFrame([(i, i + 1 + i % 3, round(0.3 + (i * 37 % 100) / 200, 4), 0.5, 0.5) for i in range(200)], "rec_lo long, rec_hi long, score double, groove double, drums double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the size of what pairs are joined with isn't known beforehand
    try:
        plan = pairs.evidence_band(made)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan.split("BroadcastExchange")[0]
    scores = sorted(r.score for r in made.collect())
    low, high = np.quantile(scores, [0.25, 0.75])
    assert all(r.band == ("strong" if r.score >= high else "different" if r.score <= low else "ambiguous") for r in pairs.evidence_band(made).collect())
    assert pairs.evidence_band(made.where("false")).count() == 0


@pytest.mark.parametrize("most", [1 << 18, 7])
def test_edges_are_thinned(spark, monkeypatch, most):
    """Of the edges in a task a forest is left, and one of each edge from a node to itself."""
    monkeypatch.setattr(graph, "EDGES", most)
    r = np.random.default_rng(3)
    nodes = [f"n{i:02}" for i in range(60)]
    edges = [(nodes[x], nodes[y]) for x, y in zip(r.integers(0, 50, 3000), r.integers(0, 50, 3000)) if x % 5 == y % 5 and x != y] + [("n58", "n58")] * 5 + [("n01", None)]
    got = graph.thinned(spark.createDataFrame(edges, "a string, b string").coalesce(1)).collect()
    assert len(got) == 45 + 1 and {tuple(x) for x in got} <= set(edges)
    found = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(got, "a string, b string")).collect()}
    assert found == {f"n{i:02}": f"n0{i % 5}" for i in range(50)}


def test_names_join_no_pairs(spark):
    plan = report_queries.QUERIES["p4_similarity_blocks"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapGroupsInArrow")[0]
    riffs = spark.createDataFrame(made_riffs(40), RIFF)
    names = spark.createDataFrame([("rec1", "x.wav"), ("rec2", "y.wav"), ("rec2", "z.wav"), ("rec3", None)], "recording_id string, filename string")
    named = report.with_names(riffs, names)
    got = report.similarity_section(rollup.best_pairs(named, named, carried="names"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, report.similarity_section(rollup.best_pairs(riffs, riffs), names).collect()))


def test_groups_write_no_pairs_as_rows(spark, monkeypatch):
    """Pairs are found once, and stored by columns."""
    said = []
    monkeypatch.setattr(matching_queries, "stored", lambda df, f=matching_queries.stored: said.append(df.columns) or f(df))
    for name in ("pairs_band", "pairs_groups", "pairs_groups_kept_up"):
        got = getattr(matching_queries, name)(spark, FOLDER)
        assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert said == [["rec_lo", "rec_hi", "score", "groove", "drums"]] * 3


def test_one_riff_with_many():
    r = np.random.default_rng(6)
    a, b = r.normal(size=(1, 40)).astype(np.float32), r.normal(size=(100, 35)).astype(np.float32)
    again = np.repeat(a, 100, 0)
    whole = scoring._distances(again, b, None, scoring.Warps())
    assert np.array_equal(scoring._distances(a, b, None, scoring.Warps()), whole)
    most = np.quantile(whole, r.random(100))
    told = [scoring.Warps(), scoring.Warps()]
    got = [scoring._distances(x, b, most, t) for x, t in zip((a, again), told)]
    assert np.array_equal(*got) and told[0] == told[1] and np.isinf(got[0]).sum() == told[0].enveloped + told[0].abandoned > 0
    assert np.array_equal(got[0][whole <= most], whole[whole <= most])
    i = np.r_[np.zeros(3), np.ones(2000), [2] * 5, np.arange(700)].astype(int)
    parts = scoring._parts(i)
    assert np.concatenate([np.arange(len(i))[p] for p in parts]).tolist() == list(range(len(i)))
    assert any(len(set(i[p])) == 1 and len(i[p]) > scoring.PAIRS for p in parts) and max(len(i[p]) for p in parts) <= 2 * scoring.PAIRS


def test_stream_writes_what_is_asked_for(spark, tmp_path):
    riffs = spark.createDataFrame(made_riffs(40), RIFF)
    library.match_into(lambda s: riffs, str(tmp_path / "m"), columns=["riff_b_id", "score"])(riffs, 0)
    got = spark.read.parquet(str(tmp_path / "m/batch=0"))
    assert got.columns == ["riff_b_id", "score"] and sorted(map(tuple, got.collect())) == sorted((b, s) for _, b, s, _ in plain_matches(made_riffs(40), made_riffs(40), 0.3))
