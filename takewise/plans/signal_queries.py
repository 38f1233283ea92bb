"""Queries over frames, onsets and beats."""

from __future__ import annotations

from pyspark.sql import functions as F

from takewise.functions import arrays
from takewise.operators import contour, onsets, rhythm, segment, trim
from takewise.plans import adapters as ad
from takewise.plans.sql import over

R6 = lambda c: F.round(c, 6).alias(c)


def _frames(then):
    return lambda s, d: then(ad.frames(s, d))


def _hours(then):
    return lambda s, d: then(ad.hours(s, d))


def _durations(h):
    return h.groupBy("recording_id").agg((F.max("t_sec") + 1).alias("duration_sec"))


def _shown(c):
    return c.select("recording_id", R6("start_sec"), R6("end_sec"), R6("confidence"), "method")


def _candidates(s, d):
    f, h = ad.frames(s, d), ad.hours(s, d)
    return trim.energy_wall(f, 3, 1.0).unionByName(trim.rhythmic_regularity(h, _durations(h))).unionByName(trim.pitched_content(f, 3, 1.0, 2)), _durations(h)


def _boundary(s, d):
    return _shown(trim.select_boundary(*_candidates(s, d)))


def _segments(s, d):
    c, durations = _candidates(s, d)
    got = trim.split_segments(trim.select_boundary(c, durations), durations.withColumnRenamed("duration_sec", "total_sec"))
    return got.select("recording_id", "part", R6("from_sec"), R6("to_sec"), "name")


def _bounds(f):
    peaks = f.where("frame_idx % 7 = 3 AND rms > 50").groupBy("recording_id").agg(F.collect_list(F.col("frame_idx") * 2.5).alias("peaks"))
    return f.groupBy("recording_id").agg((F.count(F.lit(1)) * 3.0).alias("duration_sec")).join(peaks, "recording_id", "left")


def _peaks(f):
    return segment.novelty_peaks(segment.novelty(f, ["c0", "c1"], 4), 0.3, 8)


def _riffs_of_peaks(f):
    """Riffs between the peaks that novelty finds, a second a frame."""
    peaks = _peaks(f).groupBy("recording_id").agg(F.collect_list(F.col("frame_idx").cast("double")).alias("peaks"))
    bounds = f.groupBy("recording_id").agg(F.count(F.lit(1)).cast("double").alias("duration_sec"))
    return segment.assemble_riffs(bounds.join(peaks, "recording_id", "left"))


def _curves(f, *sizes):
    got = contour.contour_curves(f.select("recording_id", "frame_idx", F.col("rms").alias("centroid"), F.col("flatness").alias("rolloff")), ["recording_id"], *sizes)
    return got.select("recording_id", _points("centroid_curve").alias("centroid"), _points("rolloff_curve").alias("rolloff"))


def _standard(s, d, curve, *n):
    got = ad.riffs(s, d).select("riff_id", contour.standard_form(F.col(curve), *n).alias("f"))
    return got.select("riff_id", _points("f.contour").alias("contour"), F.array_join(F.col("f.intervals").cast("array<string>"), ",").alias("intervals"))


def _pattern(h, *slots):
    got = rhythm.beat_pattern(rhythm.assign_beats(_off(h), _beats(h), ["recording_id"]), ["recording_id"], "strength", *slots)
    return got.select("recording_id", _points("pattern").alias("pattern"), "uniformity")


def _beats(h):
    return h.where("idx % 4 = 0").select("recording_id", F.floor(F.col("idx") / 4).cast("long").alias("idx"), "t_sec")


def _off(h):
    return h.where("idx % 4 <> 0")


def _picked(f):
    return onsets.pick_onsets(f, ["recording_id"], "rms")


def _f0(h):
    return h.select("recording_id", F.col("idx").alias("frame_idx"), F.when(F.col("idx") % 3 != 0, 100 + F.col("strength")).alias("f0_hz"), (0.4 + (F.col("recording_id") % 5) * 0.1).alias("voiced_prob"))


def _riff_rows(s, d):
    r = ad.riffs(s, d)
    method = F.when(F.col("riff_id") % 7 == 0, "none").otherwise("centroid")
    groove = F.when(F.col("riff_id") % 11 == 0, F.array().cast("array<double>")).otherwise(F.col("groove"))
    return r.select("recording_id", "riff_index", (F.col("riff_id") % 3 == 0).alias("degraded"), method.alias("method"), groove.alias("groove"))


def _fingerprints(s, d):
    r = ad.riffs(s, d)
    fields = ("riff_id", "groove", "drums", "spectral", "tempo", F.col("uniformity").alias("onset_uniformity"))
    own = r.select("riff_id", (F.col("riff_id") % 6).alias("n_beats"), (F.col("riff_id") % 8 / 4).alias("duration_sec"))
    got = rhythm.choose_fingerprint(own, r.select(*fields), r.withColumn("tempo", F.col("tempo") + 1).withColumn("groove", F.col("drums")).select(*fields), ["riff_id"])
    return got.select("riff_id", F.size("groove").cast("long").alias("n"), R6("tempo"), R6("onset_uniformity"), *[_points(c).alias(c) for c in ("groove", "drums", "spectral")], "degraded")


def _selected(s, d):
    r = ad.riffs(s, d)
    rolloff = F.when(F.col("riff_id") % 3 == 0, F.array_sort("contour")).otherwise(F.slice("contour", 1, 40))
    got = contour.select_contour(r.select("riff_id", F.when(F.col("riff_id") % 4 == 0, F.col("groove")).alias("pitch"), F.col("contour").alias("centroid"), rolloff.alias("rolloff"), (F.col("riff_id") % 9 / 2).alias("duration_sec")))
    return got.select("riff_id", "method", F.size("curve").cast("long").alias("n"), _points("curve").alias("points"))


def _points(column):
    return F.array_join(F.transform(column, lambda x: F.round(x * 10000).cast("long").cast("string")), ",")


QUERIES = {
    "t1_smooth": _frames(lambda f: trim.smooth_same(f, "rms", 4).select("recording_id", "frame_idx", R6("smooth"))),
    "t2_energy_wall": _frames(lambda f: _shown(trim.energy_wall(f, 3, 1.0))),
    "t3_regularity": _hours(lambda h: _shown(trim.rhythmic_regularity(h, _durations(h)))),
    "t4_pitched_content": _frames(lambda f: _shown(trim.pitched_content(f, 3, 1.0, 2))),
    "t5_boundary": _boundary,
    "t6_segments": _segments,
    "r1_novelty": _frames(lambda f: segment.novelty(f, ["c0", "c1"], 4).select("recording_id", "frame_idx", R6("novelty"))),
    "r1_novelty_wide": _frames(lambda f: segment.novelty(f, ["c0", "c1"]).select("recording_id", "frame_idx", R6("novelty"))),
    "r2_peaks": _frames(lambda f: _peaks(f).select("recording_id", "frame_idx", R6("novelty"))),
    "r2_peaks_wide": _frames(lambda f: segment.novelty_peaks(segment.novelty(f, ["c0", "c1"], 4)).select("recording_id", "frame_idx", R6("novelty"))),
    "r3_riffs": _frames(lambda f: segment.assemble_riffs(_bounds(f))),
    "r3_riffs_of_peaks": _frames(_riffs_of_peaks),
    "c1_curves": _frames(lambda f: _curves(f, 5, 4)),
    "c1_curves_wide": _frames(lambda f: _curves(f)),
    "c2_pitch_track": _hours(lambda h: contour.pitch_track_curve(_f0(h), ["recording_id"]).select("recording_id", "frame_idx", R6("midi"))),
    "c2_pitch_curves": _hours(lambda h: contour.pitch_curves(contour.pitch_track_curve(_f0(h), ["recording_id"]), ["recording_id"]).select("recording_id", F.size("curve").cast("long").alias("n"), _points("curve").alias("points"))),
    "c3_quality": lambda s, d: ad.riffs(s, d).select("riff_id", F.round(contour.contour_quality(F.col("contour")), 6).alias("quality")),
    "c4_selected": _selected,
    "c5_resampled": lambda s, d: ad.riffs(s, d).select("riff_id", _points(arrays.resampled(F.col("groove"), 10)).alias("points")),
    "c6_c7_standard_form": lambda s, d: _standard(s, d, "groove", 16),
    "c6_c7_standard_form_200": lambda s, d: _standard(s, d, "contour"),
    "g1_beats": _hours(lambda h: rhythm.assign_beats(_off(h), _beats(h), ["recording_id"]).select("recording_id", "idx", "beat_idx")),
    "g2_pattern": _hours(lambda h: _pattern(h, 4)),
    "g2_pattern_16": _hours(lambda h: _pattern(h)),
    "g3_tempo": _hours(lambda h: rhythm.tempo_from_beats(_beats(h), ["recording_id"])),
    "g4_spectral_mean": _frames(lambda f: rhythm.spectral_mean(f.withColumn("contrast", F.array("c0", "c1")), ["recording_id"]).select("recording_id", F.col("spectral")[0].alias("s0"), F.col("spectral")[1].alias("s1"))),
    "g5_histogram": _hours(lambda h: rhythm.ioi_histogram(h, ["recording_id"], 39, 0.05).select("recording_id", _points("groove").alias("groove"))),
    "o1_onsets": _frames(lambda f: _picked(f).select("recording_id", "idx", "frame_idx", R6("t_sec"))),
    "o1_onset_gaps": _frames(lambda f: rhythm.ioi_histogram(_picked(f), ["recording_id"]).select("recording_id", _points("groove").alias("groove"))),
    "o2_beat_periods": _frames(lambda f: onsets.beat_periods(f, ["recording_id"], "rms")),
    "o2_beats": _frames(lambda f: onsets.track_beats(f, ["recording_id"], "rms").select("recording_id", "idx", "frame_idx", R6("t_sec"))),
    "g6_autocorr": lambda s, d: ad.riffs(s, d).select("riff_id", _points(rhythm.onset_autocorr(F.col("groove"), 5)).alias("drums")),
    "g7_fingerprint": _fingerprints,
    "g8_flags": lambda s, d: rhythm.processing_flags(_riff_rows(s, d), True).select("recording_id", F.array_join("processing_flags", ",").alias("flags")),
    "g9_overall_tempo": lambda s, d: rhythm.overall_tempo(ad.riffs(s, d)),
}

_SM = "s AS (SELECT recording_id, frame_idx, CASE WHEN count(*) OVER (PARTITION BY recording_id) >= 3 THEN sum({c}) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 END AS smooth FROM frames)"
_ENERGY = (
    _SM.format(c="rms").replace("s AS", "es AS", 1)
    + """, ed AS (SELECT *, lead(smooth) OVER (PARTITION BY recording_id ORDER BY frame_idx) - smooth AS rise, count(*) OVER (PARTITION BY recording_id) AS n FROM es WHERE smooth IS NOT NULL),
el AS (SELECT recording_id, 3 * quantile_cont(rise, 0.5) FILTER (rise > 0) AS lim, max(smooth) AS peak FROM ed GROUP BY 1),
eg AS (SELECT recording_id, arg_min(rise, frame_idx) FILTER (rise > lim AND frame_idx < (n - 1) // 2) AS r, min(frame_idx) FILTER (rise > lim AND frame_idx < (n - 1) // 2) AS a, max(frame_idx) FILTER (smooth > 0.2 * peak) AS b, first(lim) AS lim FROM ed JOIN el USING (recording_id) WHERE n >= 10 GROUP BY 1),
energy AS (SELECT recording_id, a * 1.0::DOUBLE AS start_sec, b * 1.0::DOUBLE AS end_sec, least(1.0, r / (2 * lim) * 0.9 + 0.1)::DOUBLE AS confidence, 'energy_wall' AS method FROM eg WHERE b - a >= 15)"""
)
_DUR = "dur AS (SELECT recording_id, max(t_sec) + 1 AS duration_sec FROM hours GROUP BY 1)"
_REG = (
    _DUR
    + """, g0 AS (SELECT *, lead(t_sec) OVER w - t_sec AS gap, count(*) OVER (PARTITION BY recording_id) AS n, lead(t_sec, 8) OVER w AS nxt FROM hours WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
g1 AS (SELECT *, avg(gap) OVER a AS mu, stddev_pop(gap) OVER a / avg(gap) OVER a AS cv FROM g0 WINDOW a AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
g2 AS (SELECT recording_id, min(struct_pack(cv := cv, idx := idx, t := t_sec)) FILTER (mu >= 0.1 AND idx < n - 8) AS a, max(struct_pack(idx := idx, nxt := nxt)) FILTER (mu >= 0.1 AND idx >= 1 AND idx < n - 8 AND cv < 0.5) AS b FROM g1 WHERE n >= 8 GROUP BY 1),
regular AS (SELECT recording_id, a.t AS start_sec, coalesce(b.nxt, duration_sec) AS end_sec, (1 - a.cv) * 0.85 AS confidence, 'rhythmic_regularity' AS method FROM g2 JOIN dur USING (recording_id) WHERE a.cv <= 0.4 AND coalesce(b.nxt, duration_sec) - a.t >= 15)"""
)
_PITCH = (
    _SM.format(c="flatness").replace("s AS", "ps AS", 1)
    + """, pm AS (SELECT recording_id, 0.7 * quantile_cont(smooth, 0.5) AS lim FROM ps WHERE smooth IS NOT NULL GROUP BY 1),
pt AS (SELECT ps.*, frame_idx - row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS island FROM ps JOIN pm USING (recording_id) WHERE smooth < lim),
pr AS (SELECT recording_id, min(frame_idx) AS a, max(frame_idx) AS b FROM pt GROUP BY recording_id, island HAVING max(frame_idx) - min(frame_idx) + 1 >= 2),
pe AS (SELECT recording_id, min(a) AS a, max(b) AS b FROM pr GROUP BY 1),
pitched AS (SELECT recording_id, a * 1.0::DOUBLE AS start_sec, b * 1.0::DOUBLE AS end_sec, 0.8 * (SELECT count(*) FROM pt WHERE pt.recording_id = pe.recording_id AND frame_idx >= a AND frame_idx < b) / greatest(1, b - a) AS confidence, 'pitched_content' AS method FROM pe WHERE b - a >= 15)"""
)
_ALL = f"""{_ENERGY}, {_REG}, {_PITCH}, ca AS (SELECT *, 1 AS k FROM energy UNION ALL SELECT *, 2 FROM regular UNION ALL SELECT *, 3 FROM pitched),
cv AS (SELECT *, max(confidence >= 0.3) OVER (PARTITION BY recording_id) AS anyv FROM ca),
cw AS (SELECT *, max(start_sec) OVER (PARTITION BY recording_id) - min(start_sec) OVER (PARTITION BY recording_id) > 5 AS early FROM cv WHERE (confidence >= 0.3) = anyv),
cx AS (SELECT * FROM cw QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY CASE WHEN early THEN 0 ELSE -confidence END, start_sec, k) = 1),
chosen AS (SELECT dur.recording_id, coalesce(start_sec, 0) AS start_sec, coalesce(end_sec, duration_sec) AS end_sec, coalesce(confidence, 0) AS confidence, coalesce(method, 'none') AS method, duration_sec FROM dur LEFT JOIN cx USING (recording_id))"""
_OUT = "SELECT recording_id, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, round(confidence, 6) AS confidence, method FROM "


def _nov(half):
    return f"""n0 AS (SELECT *, sqrt(c0 * c0 + c1 * c1) AS nm, count(*) OVER (PARTITION BY recording_id) AS n FROM frames),
n1 AS (SELECT recording_id, frame_idx, n, c0 / CASE WHEN nm < 1e-10 THEN 1 ELSE nm END AS u, c1 / CASE WHEN nm < 1e-10 THEN 1 ELSE nm END AS v FROM n0),
n2 AS (SELECT recording_id, frame_idx, CASE WHEN frame_idx >= {half} AND frame_idx < n - {half} THEN (sum(u) OVER b - sum(u) OVER a) ** 2 + (sum(v) OVER b - sum(v) OVER a) ** 2 ELSE 0 END AS raw FROM n1
  WINDOW b AS (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN {half} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND {half - 1} FOLLOWING)),
nov AS (SELECT recording_id, frame_idx, CASE WHEN max(raw) OVER (PARTITION BY recording_id) > 0 THEN raw / max(raw) OVER (PARTITION BY recording_id) ELSE raw END AS novelty FROM n2)"""


def _found_peaks(distance):
    return f"""k0 AS (SELECT *, CASE WHEN lag(novelty) OVER w = novelty THEN 0 ELSE 1 END AS fresh FROM nov WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx)),
k1 AS (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS run FROM k0),
k2 AS (SELECT recording_id, min(frame_idx) AS a, max(frame_idx) AS b, first(novelty) AS novelty FROM k1 GROUP BY recording_id, run),
k3 AS (SELECT *, lag(novelty) OVER w AS before, lead(novelty) OVER w AS after FROM k2 WINDOW w AS (PARTITION BY recording_id ORDER BY a)),
k4 AS (SELECT recording_id, (a + b) // 2 AS frame_idx, novelty FROM k3 WHERE novelty > before AND novelty > after AND novelty >= 0.3),
k5 AS (SELECT recording_id, list([frame_idx] ORDER BY novelty DESC, frame_idx DESC) AS l FROM k4 GROUP BY 1),
k6 AS (SELECT recording_id, list_reduce(l, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: abs(y - x[1]) < {distance})) > 0 THEN kept ELSE list_append(kept, x[1]) END, []::BIGINT[]) AS kept FROM k5),
peaks AS (SELECT k4.* FROM k4 JOIN k6 USING (recording_id) WHERE list_contains(kept, frame_idx))"""


#: Riffs of bounds (recording_id, d, p): starts of parts by a fold over the points, then parts over a minute in equal pieces.
_CUT = """q0 AS (SELECT recording_id, d, CASE WHEN d < 3 THEN [0.0, d] ELSE list_sort(list_distinct(list_concat([0.0::DOUBLE, d], coalesce(p, []::DOUBLE[])))) END AS pts FROM bounds),
q1 AS (SELECT recording_id, list_reduce(list_transform(pts[2:], lambda x: [x]), lambda s, x: CASE WHEN x[1] - s[len(s)] < 3 AND x[1] < pts[len(pts)] THEN s ELSE list_append(s, x[1]) END, [0.0::DOUBLE]) AS e FROM q0),
q2 AS (SELECT recording_id, unnest(range(1, len(e))) AS i, e FROM q1), q3 AS (SELECT recording_id, i, e[i] AS a, e[i + 1] AS b, greatest(1, ceil((e[i + 1] - e[i]) / 60))::BIGINT AS c FROM q2),
q4 AS (SELECT recording_id, i, a, b, c, unnest(range(0, c)) AS j FROM q3)
SELECT recording_id, (row_number() OVER (PARTITION BY recording_id ORDER BY i, j) - 1)::INTEGER AS riff_index, round(a + j * (b - a) / c, 3) AS start_sec, round(a + (j + 1) * (b - a) / c, 3) AS end_sec FROM q4"""


def _filtered(column, size, what):
    """A list that slides over a column (a list), continued by reflection."""
    at = f"((i + o) % (2 * len({column})) + 2 * len({column})) % (2 * len({column}))"
    return f"list_transform(range(0, len({column})), lambda i: {what}(list_transform(range({-(size // 2)}, {size - size // 2}), lambda o: {column}[CASE WHEN {at} < len({column}) THEN {at} ELSE 2 * len({column}) - 1 - {at} END + 1])))"


def _curves_sql(median, mean):
    return over("frames", f"""AND WITH l AS (SELECT recording_id, list(rms ORDER BY frame_idx) AS x, list(flatness ORDER BY frame_idx) AS y FROM frames GROUP BY 1),
m AS (SELECT recording_id, {_filtered("x", median, "list_median")} AS x, y FROM l), r AS (SELECT recording_id, {_filtered("x", mean, "list_avg")} AS x, {_filtered("y", mean, "list_avg")} AS y FROM m)
SELECT recording_id, {_PTS("x")} AS centroid, {_PTS("y")} AS rolloff FROM r""")


def _standard_sql(curve, n):
    return over("riffs", f"""AND WITH a AS (SELECT riff_id, {_RES(curve, n)} AS v FROM riffs), b AS (SELECT *, list_sum(v) / {n} AS mu FROM a),
c AS (SELECT *, sqrt(list_sum(list_transform(v, lambda q: (q - mu) * (q - mu))) / {n}) AS sd FROM b), d AS (SELECT riff_id, list_transform(v, lambda q: CASE WHEN sd > 1e-8 THEN (q - mu) / sd ELSE 0 END) AS z FROM c),
e AS (SELECT *, list_transform(range(1, {n}), lambda i: z[i + 1] - z[i]) AS t FROM d), g AS (SELECT *, sqrt(list_sum(list_transform(t, lambda q: (q - list_sum(t) / {n - 1}) * (q - list_sum(t) / {n - 1}))) / {n - 1}) AS w FROM e)
SELECT riff_id, {_PTS("list_transform(z, lambda y: round(y, 4))")} AS contour, array_to_string(list_transform(t, lambda q: CASE WHEN q > w THEN 2 WHEN q > 0.25 * w THEN 1 WHEN q < -w THEN -2 WHEN q < -0.25 * w THEN -1 ELSE 0 END::VARCHAR), ',') AS intervals FROM g""")


def _pattern_sql(n):
    return over("hours", f"""AND WITH {_BEAT}, l AS (SELECT recording_id, beat_idx, list(strength ORDER BY t_sec) AS groove FROM asg GROUP BY 1, 2),
r AS (SELECT recording_id, beat_idx, {_RES('groove', n)} AS v FROM l), n AS (SELECT recording_id, list_transform(v, lambda q: CASE WHEN list_max(v) > 1e-8 THEN q / list_max(v) ELSE q END) AS v FROM r),
m AS (SELECT recording_id, [{', '.join(f'avg(v[{k + 1}])' for k in range(n))}] AS p FROM n GROUP BY 1), u AS (SELECT recording_id, p, list_sum(p) / {n} AS mu FROM m)
SELECT recording_id, {_PTS("list_transform(p, lambda y: round(y, 4))")} AS pattern, round(CASE WHEN mu > 1e-8 THEN greatest(0, least(1, 1 - sqrt(list_sum(list_transform(p, lambda q: (q - mu) * (q - mu))) / {n}) / mu)) ELSE 0.5 END, 4) AS uniformity FROM u""")


_PTS = lambda v: f"array_to_string(list_transform({v}, lambda q: round(q * 10000)::BIGINT::VARCHAR), ',')"
_RES = lambda v, n: f"list_transform(range(0, {n}), lambda k: CASE WHEN k * len({v}) / ({n} - 1.0::DOUBLE) >= len({v}) - 1 THEN {v}[len({v})] ELSE {v}[(k * len({v}) // ({n} - 1)) + 1] + ({v}[(k * len({v}) // ({n} - 1)) + 2] - {v}[(k * len({v}) // ({n} - 1)) + 1]) * (k * len({v}) / ({n} - 1.0::DOUBLE) - (k * len({v}) // ({n} - 1))) END)"
_LAGS = lambda d: f"list_transform(range(0, 20), lambda k: list_sum(list_transform(range(1, len({d}) - k + 1), lambda i: {d}[i] * {d}[i + k])))"
_BEAT = "bt AS (SELECT recording_id, idx // 4 AS b, t_sec, lead(t_sec) OVER (PARTITION BY recording_id ORDER BY idx) AS nxt FROM hours WHERE idx % 4 = 0), asg AS (SELECT h.recording_id, h.idx, b AS beat_idx, h.t_sec, h.strength FROM hours h JOIN bt ON bt.recording_id = h.recording_id AND h.t_sec >= bt.t_sec AND h.t_sec < bt.nxt WHERE h.idx % 4 <> 0)"

#: How densely gaps x (recording_id, gap, n) lie in each of 39 bins.
_DENSITY = f"""y AS (SELECT recording_id, CASE WHEN gap <= 39 * 0.05::DOUBLE THEN least(floor(gap / 0.05::DOUBLE), 38)::INTEGER END AS b FROM x WHERE n > 2 AND gap IS NOT NULL),
z AS (SELECT recording_id, list(b) FILTER (b IS NOT NULL) AS l, count(b) AS m FROM y GROUP BY 1)
SELECT recording_id, {_PTS("list_transform(range(0, 39), lambda k: CASE WHEN m > 0 THEN round(len(list_filter(l, lambda q: q = k)) / (m * 0.05::DOUBLE), 4) ELSE 0 END)")} AS groove FROM z"""
#: Onsets of frames: o4 has a list of frame numbers per recording.
_ONSETS = """o0 AS (SELECT recording_id, frame_idx, rms, min(rms) OVER p AS lo, max(rms) OVER p AS hi FROM frames WINDOW p AS (PARTITION BY recording_id)),
o1 AS (SELECT recording_id, frame_idx, CASE WHEN hi > lo THEN (rms - lo) / (hi - lo) ELSE 0 END AS x FROM o0),
o2 AS (SELECT *, max(x) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS top, avg(x) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mu FROM o1 WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx)),
o3 AS (SELECT recording_id, list([frame_idx] ORDER BY frame_idx) AS l FROM o2 WHERE x >= top AND x >= mu + 0.07::DOUBLE GROUP BY 1),
o4 AS (SELECT recording_id, list_reduce(l, lambda s, x: CASE WHEN x[1] - s[len(s)] > 1 THEN list_append(s, x[1]) ELSE s END) AS k FROM o3),
picked AS (SELECT recording_id, unnest(range(0, len(k))) AS idx, unnest(k) AS frame_idx FROM o4)"""

_PITCHED = """f AS (SELECT recording_id, idx, CASE WHEN idx % 3 <> 0 THEN 12 * (log2(100 + strength) - log2(440.0::DOUBLE)) + 69 END AS note, avg(0.4 + (recording_id % 5) * 0.1::DOUBLE) OVER (PARTITION BY recording_id) AS c,
  count(CASE WHEN idx % 3 <> 0 THEN 1 END) OVER (PARTITION BY recording_id) AS v, count(*) OVER (PARTITION BY recording_id) AS n FROM hours),
k AS (SELECT *, last_value(note IGNORE NULLS) OVER a AS ln, last_value(CASE WHEN note IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS li, first_value(note IGNORE NULLS) OVER b AS hn, first_value(CASE WHEN note IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS hi FROM f WHERE round(c, 9) >= 0.5 AND v >= 0.3 * n AND v > 0
  WINDOW a AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

ORACLE_SQL = {
    "c2_pitch_track": over("hours", f"AND WITH {_PITCHED} SELECT recording_id, idx AS frame_idx, round(CASE WHEN ln IS NULL THEN hn WHEN hn IS NULL OR hi = li THEN ln ELSE ln + (hn - ln) * (idx - li) / (hi - li) END, 6) AS midi FROM k"),
    "c2_pitch_curves": over("hours", f"""AND WITH {_PITCHED}, l AS (SELECT recording_id, list(CASE WHEN ln IS NULL THEN hn WHEN hn IS NULL OR hi = li THEN ln ELSE ln + (hn - ln) * (idx - li) / (hi - li) END ORDER BY idx) AS x FROM k GROUP BY 1),
m AS (SELECT recording_id, {_filtered("x", 15, "list_avg")} AS x FROM l) SELECT recording_id, len(x) AS n, {_PTS("x")} AS points FROM m"""),
    "c4_selected": over("riffs", f"""AND WITH q AS (SELECT *, CASE WHEN riff_id % 3 = 0 THEN list_sort(contour) ELSE contour[1:40] END AS rolloff FROM riffs),
d AS (SELECT *, list_transform(range(1, len(contour)), lambda i: contour[i + 1] - contour[i]) AS dc, list_transform(range(1, len(rolloff)), lambda i: rolloff[i + 1] - rolloff[i]) AS dr FROM q),
a AS (SELECT *, {_LAGS("dc")} AS ac, {_LAGS("dr")} AS ar FROM d),
m AS (SELECT *, CASE WHEN riff_id % 9 / 2 < 1 THEN 'none' WHEN riff_id % 4 = 0 THEN 'pyin' WHEN greatest(0, list_sum(ac[2:20]) / ac[1]) >= greatest(0, list_sum(ar[2:20]) / ar[1]) THEN 'centroid' ELSE 'rolloff' END AS method FROM a),
c AS (SELECT riff_id, method, CASE method WHEN 'pyin' THEN groove WHEN 'centroid' THEN contour WHEN 'rolloff' THEN rolloff ELSE [] END AS curve FROM m)
SELECT riff_id, method, len(curve) AS n, CASE WHEN len(curve) = 0 THEN '' ELSE {_PTS("curve")} END AS points FROM c"""),
    "c6_c7_standard_form": _standard_sql("groove", 16),
    "c6_c7_standard_form_200": _standard_sql("contour", 200),
    "g2_pattern": _pattern_sql(4),
    "g2_pattern_16": _pattern_sql(16),
    "c1_curves": _curves_sql(5, 4),
    "c1_curves_wide": _curves_sql(15, 25),
    "r2_peaks": over("frames", f"AND WITH {_nov(4)}, {_found_peaks(8)} SELECT recording_id, frame_idx, round(novelty, 6) AS novelty FROM peaks"),
    "r2_peaks_wide": over("frames", f"AND WITH {_nov(4)}, {_found_peaks(172)} SELECT recording_id, frame_idx, round(novelty, 6) AS novelty FROM peaks"),
    "r3_riffs": over("frames", f"AND WITH bounds AS (SELECT recording_id, count(*) * 3.0::DOUBLE AS d, list(frame_idx * 2.5::DOUBLE) FILTER (frame_idx % 7 = 3 AND rms > 50) AS p FROM frames GROUP BY 1), {_CUT}"),
    "r3_riffs_of_peaks": over("frames", f"AND WITH {_nov(4)}, {_found_peaks(8)}, pl AS (SELECT recording_id, list(frame_idx::DOUBLE) AS p FROM peaks GROUP BY 1), bounds AS (SELECT recording_id, count(*)::DOUBLE AS d, any_value(p) AS p FROM frames LEFT JOIN pl USING (recording_id) GROUP BY 1), {_CUT}"),
    "o1_onsets": over("frames", f"AND WITH {_ONSETS} SELECT recording_id, idx, frame_idx, round(frame_idx * 512 / 22050.0::DOUBLE, 6) AS t_sec FROM picked"),
    "o1_onset_gaps": over("frames", f"AND WITH {_ONSETS}, x AS (SELECT recording_id, (lead(frame_idx) OVER (PARTITION BY recording_id ORDER BY idx) - frame_idx) * 512 / 22050.0::DOUBLE AS gap, count(*) OVER (PARTITION BY recording_id) AS n FROM picked), {_DENSITY}"),
    "o2_beat_periods": over("frames", """AND WITH l AS (SELECT recording_id, list(rms ORDER BY frame_idx) AS x FROM frames GROUP BY 1), d AS (SELECT recording_id, list_transform(x, lambda q: q - list_avg(x)) AS d FROM l),
k AS (SELECT recording_id, d, unnest(range(9, least(len(d) - 1, 86) + 1)) AS k FROM d), a AS (SELECT recording_id, k, list_sum(list_transform(range(1, len(d) - k + 1), lambda i: d[i] * d[i + k])) AS a FROM k),
b AS (SELECT recording_id, arg_max(k, a * exp(-0.5 * log2(60 * 22050 / 512.0::DOUBLE / k / 120) ** 2)) FILTER (a > 1e-12) AS p FROM a GROUP BY 1)
SELECT recording_id, coalesce(p, 0)::INTEGER AS period, CASE WHEN p > 0 THEN round(60 * 22050 / 512.0::DOUBLE / p, 1) ELSE 0 END AS tempo FROM l LEFT JOIN b USING (recording_id)"""),
    "g5_histogram": over("hours", f"""AND WITH x AS (SELECT recording_id, lead(t_sec) OVER (PARTITION BY recording_id ORDER BY idx) - t_sec AS gap, count(*) OVER (PARTITION BY recording_id) AS n FROM hours), {_DENSITY}"""),
    "t1_smooth": over("frames", "SELECT recording_id, frame_idx, round(CASE WHEN count(*) OVER (PARTITION BY recording_id) >= 4 THEN sum(rms) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 END, 6) AS smooth FROM frames"),
    "t2_energy_wall": over("frames", f"AND WITH {_ENERGY} {_OUT} energy"),
    "t3_regularity": over("hours", f"AND WITH {_REG} {_OUT} regular"),
    "t4_pitched_content": over("frames", f"AND WITH {_PITCH} {_OUT} pitched"),
    "t5_boundary": over("frames hours", f"AND WITH {_ALL} {_OUT} chosen"),
    "t6_segments": over("frames hours", f"AND WITH {_ALL}, x AS (SELECT recording_id, least(start_sec, duration_sec) AS a, least(end_sec, duration_sec) AS b, duration_sec AS t FROM chosen), y AS (SELECT recording_id, 'pre' AS part, 0.0::DOUBLE AS f, a AS u FROM x UNION ALL SELECT recording_id, 'song', a, greatest(a, b) FROM x UNION ALL SELECT recording_id, 'post', greatest(a, b), t FROM x) SELECT recording_id, part, round(f, 6) AS from_sec, round(u, 6) AS to_sec, recording_id || '_' || part || '.opus' AS name FROM y WHERE part = 'song' OR u - f > 1"),
    "r1_novelty": over("frames", f"AND WITH {_nov(4)} SELECT recording_id, frame_idx, round(novelty, 6) AS novelty FROM nov"),
    "r1_novelty_wide": over("frames", f"AND WITH {_nov(32)} SELECT recording_id, frame_idx, round(novelty, 6) AS novelty FROM nov"),
    "c3_quality": over("riffs", "AND WITH q AS (SELECT riff_id, list_transform(range(1, len(contour)), lambda i: contour[i + 1] - contour[i]) AS d FROM riffs), p AS (SELECT riff_id, list_transform(range(0, 20), lambda k: list_sum(list_transform(range(1, len(d) - k + 1), lambda i: d[i] * d[i + k]))) AS a FROM q) SELECT riff_id, round(greatest(0, list_sum(a[2:20]) / a[1] / 19), 6) AS quality FROM p"),
    "c5_resampled": over("riffs", f"SELECT riff_id, {_PTS(_RES('groove', 10))} AS points FROM riffs"),
    "g1_beats": over("hours", f"AND WITH {_BEAT} SELECT recording_id, idx, beat_idx FROM asg"),
    "g3_tempo": over("hours", "AND WITH x AS (SELECT recording_id, lead(t_sec) OVER (PARTITION BY recording_id ORDER BY idx) - t_sec AS gap FROM hours WHERE idx % 4 = 0) SELECT recording_id, CASE WHEN quantile_cont(gap, 0.5) > 0 THEN round(60 / quantile_cont(gap, 0.5), 1) ELSE 0.0 END AS tempo FROM x GROUP BY 1"),
    "g4_spectral_mean": over("frames", "SELECT recording_id, round(avg(c0), 4) AS s0, round(avg(c1), 4) AS s1 FROM frames GROUP BY 1"),
    "g6_autocorr": over("riffs", f"AND WITH x AS (SELECT riff_id, groove, list_sum(list_transform(groove, lambda q: q * q)) AS z FROM riffs) SELECT riff_id, {_PTS('list_transform(range(0, 5), lambda k: round(list_sum(list_transform(range(1, 17 - k), lambda i: groove[i] * groove[i + k])) / z, 4))')} AS drums FROM x"),
    "g8_flags": over("riffs", "AND WITH x AS (SELECT recording_id, unnest(list_filter(['no_madmom:librosa_beat_tracking', CASE WHEN riff_id % 3 = 0 THEN 'riff_' || riff_index || ':fallback_fingerprint' END, CASE WHEN riff_id % 7 = 0 THEN 'riff_' || riff_index || ':no_contour' END, CASE WHEN riff_id % 11 = 0 THEN 'riff_' || riff_index || ':empty_groove' END], lambda q: q IS NOT NULL)) AS f FROM riffs) SELECT recording_id, string_agg(DISTINCT f, ',' ORDER BY f) AS flags FROM x GROUP BY 1"),
    "g9_overall_tempo": over("riffs", "SELECT recording_id, round(avg(CASE WHEN tempo > 0 THEN tempo END), 1) AS tempo FROM riffs GROUP BY 1"),
    "g7_fingerprint": over("riffs", f"""AND WITH x AS (SELECT *, riff_id % 8 / 4 < 1 AS short, riff_id % 6 < 4 AS few FROM riffs)
SELECT riff_id, CASE WHEN short THEN 0 ELSE 16 END::BIGINT AS n, round(CASE WHEN short THEN 0 WHEN few THEN tempo + 1 ELSE tempo END, 6) AS tempo, round(CASE WHEN short OR few THEN 0.5 ELSE uniformity END, 6)::DOUBLE AS onset_uniformity,
  CASE WHEN short THEN '' WHEN few THEN {_PTS("drums")} ELSE {_PTS("groove")} END AS groove, CASE WHEN short THEN '' ELSE {_PTS("drums")} END AS drums, CASE WHEN short THEN '' ELSE {_PTS("spectral")} END AS spectral, few AND NOT short AS degraded FROM x"""),
}
