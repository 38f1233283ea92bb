"""Riffs against riffs: candidates, cheap tests first, then a weighted similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takewise.functions.arrays import cosine, warped
from takewise.operators import blocks, scoring
from takewise.operators.scoring import BLAST_ABOVE, GROOVE_BELOW, INTERVAL_LEAST, SCORE_LEAST, TEMPO_LEAST, WEIGHTS
from takewise.operators.scoring import warp_batch as warp_batch

_VALUES = ["tempo", "uniformity", "groove", "drums", "spectral", "contour", "intervals"]
_SIMILARITIES = ["groove", "drums", "contour", "spectral", "tempo"]


def split_batch(riffs: DataFrame, recordings: DataFrame) -> DataFrame:
    """The riffs of the recordings (recording_id) in a batch; the library is all riffs."""
    return riffs.join(recordings.select("recording_id").distinct(), "recording_id", "left_semi")


def tempo_similarity(a: Column, b: Column, near: float = 0.85) -> Column:
    """The best ratio of two tempos, one of them perhaps doubled; from near on it is 1, with an unknown tempo 0.5."""
    ratio = [F.least(x, y) / F.greatest(x, y) for x, y in ((a, b), (a, 2 * b), (2 * a, b))]
    best = F.greatest(*ratio)
    return F.when((a <= 0) | (b <= 0) | a.isNull() | b.isNull(), 0.5).when(best >= near, 1.0).otherwise(best)


def weight_label(a: Column, b: Column) -> Column:
    """Which weights two onset uniformities call for; a missing one counts as 0.5."""
    a, b = F.coalesce(a, F.lit(0.5)), F.coalesce(b, F.lit(0.5))
    return F.when((a > BLAST_ABOVE) & (b > BLAST_ABOVE), "blast").when((a < GROOVE_BELOW) & (b < GROOVE_BELOW), "groove").otherwise("balanced")


def weight(label: Column, what: str) -> Column:
    out = F.lit(None).cast("double")
    for name, values in WEIGHTS.items():
        out = F.when(label == name, F.lit(values[what])).otherwise(out)
    return out


def candidate_pairs(new: DataFrame, library: DataFrame) -> DataFrame:
    """new against library as (a, b) structs: different riffs of different recordings, tempos that can pass.

    Two tempos are similar enough exactly if their ratio is 0.3 at least, so new riffs meet only the neighbouring bands
    of a logarithmic scale: an equi-join on the band. Riffs of unknown tempo pass no test and are left out.
    """
    step = float(np.log(1 / 0.3))
    known = F.col("tempo") > 0
    band = F.floor(F.log("tempo") / step).cast("int")
    left = new.where(known).select(F.struct(*new.columns).alias("a"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    right = library.where(known).select(F.struct(*library.columns).alias("b"), band.alias("band"))
    pairs = left.join(right, "band").where((F.col("a.riff_id") != F.col("b.riff_id")) & (F.col("a.recording_id") != F.col("b.recording_id")))
    return pairs.where(tempo_similarity(F.col("a.tempo"), F.col("b.tempo")) >= TEMPO_LEAST).select("a", "b")


def interval_test(a: Column, b: Column) -> Column:
    """Steps alike enough for warping; passed if one of the two has none."""
    return (F.size(a) < 1) | (F.size(b) < 1) | (cosine(a.cast("array<double>"), b.cast("array<double>")) >= INTERVAL_LEAST)


def compare(pairs: DataFrame) -> DataFrame:
    """(a, b) pairs with the five similarities and the score, in Spark's expressions alone; for small data."""
    sims = {what: cosine(F.col(f"a.{what}"), F.col(f"b.{what}")) for what in ("groove", "drums", "spectral")}
    sims["contour"] = warped(F.col("a.contour"), F.col("b.contour"))
    sims["tempo"] = tempo_similarity(F.coalesce("a.tempo", F.lit(0.0)), F.coalesce("b.tempo", F.lit(0.0)))
    label = weight_label(F.col("a.uniformity"), F.col("b.uniformity"))
    out = pairs.select(F.col("a.riff_id").alias("riff_a_id"), F.col("b.riff_id").alias("riff_b_id"), label.alias("weights"), *[v.alias(k) for k, v in sims.items()])
    score = sum((weight(F.col("weights"), k) * F.col(k) for k in ("contour", "groove", "drums", "spectral", "tempo")), F.lit(0.0))
    return out.withColumn("score", F.round(score, 4)).select("riff_a_id", "riff_b_id", "score", *[F.round(k, 4).alias(k) for k in sims], "weights")


def _side(riffs: DataFrame, *names: str, more: Sequence[str] = ()) -> DataFrame:
    """riffs with the columns that matching reads, and more; without riff_order those of equal score are ordered by a hash of
    riff_id."""
    order = F.col("riff_order") if "riff_order" in riffs.columns else F.xxhash64("riff_id").alias("riff_order")
    lists = [F.col(c).cast("array<double>").alias(c) if c not in ("tempo", "uniformity") else F.col(c).cast("double").alias(c) for c in names]
    return riffs.select("riff_id", "recording_id", order, *lists, *more)


def match_schema(riffs: DataFrame) -> str:
    """The columns of matches, with ids and order of the types that riffs has."""
    kind = lambda name: riffs.schema[name].dataType.simpleString() if name in riffs.columns else "bigint"
    ids = [f"{new} {kind(old)}" for new, old in (("riff_a_id", "riff_id"), ("riff_b_id", "riff_id"), ("recording_a", "recording_id"), ("recording_b", "recording_id"), ("order_a", "riff_order"), ("order_b", "riff_order"))]
    return ", ".join([*ids, "score double", *[f"{c} double" for c in _SIMILARITIES], "weights string"])


def _joined(new: pa.Table, library: pa.Table, i: np.ndarray, j: np.ndarray, asked: list[str]) -> dict[str, pa.ChunkedArray]:
    names = (("riff_{}_id", "riff_id"), ("recording_{}", "recording_id"), ("order_{}", "riff_order"))
    sides = (("a", new, pa.array(i)), ("b", library, pa.array(j)))
    # column by column: to take rows would copy their vectors for each pair
    return {to.format(s): t.column(name).take(at) for to, name in names for s, t, at in sides if to.format(s) in asked}


def find_matches(new: DataFrame, library: DataFrame, least: float = SCORE_LEAST, new_blocks: int | None = None, library_blocks: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Every pair of a new riff with a riff of another recording that scores least or more (rounded to four digits).

    Both sides are cut into blocks by ranges of tempo, of some thousands of riffs each however large the library and
    whatever recording or tempo is common. Summaries of the blocks meet first; pairs of blocks that cannot hold a match
    are dropped, the others are scored in a task each: the tests, the cheap similarities, and warping only where these
    leave the score open, given up once it can no longer be reached. Ids may be of any type. Two new riffs are compared
    both ways round, since the similarity is not symmetric. Null vectors count as empty. columns: those that are asked for; others are not
    made.
    """

    def run(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        for i, j, label, sims, score in scoring.scored(scoring.Side(a), scoring.Side(b), least, scoring.Warps()):
            made = _joined(a, b, i, j, names) | {"score": pa.array(score)} | {k: pa.array(scoring.rounded(sims[k])) for k in _SIMILARITIES if k in names}
            if "weights" in names:
                made["weights"] = pa.array(scoring.LABELS).take(pa.array(label))
            yield pa.table({n: made[n] for n in names})

    kinds = {c.split()[0]: c for c in match_schema(new).split(", ")}
    names = list(columns or kinds)
    schema = ", ".join(kinds[n] for n in names)
    sides = [_side(side, *_VALUES) for side in (new, library)]
    return blocks.meet(*sides, sides[0].columns, run, schema, least, blocks=(new_blocks, library_blocks))


def tested_pairs(new: DataFrame, library: DataFrame, intervals: bool = True) -> DataFrame:
    """(riff_a_id, riff_b_id, similarity) of the pairs that pass the tests of tempo and, if asked, of intervals, with the
    similarity of their tempos: as candidate_pairs and interval_test, but vectors meet by blocks and no pair carries any."""
    kinds = match_schema(new).split(", ")[:2]
    schema = ", ".join([*kinds, "similarity double"])

    def run(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        for i, j, tempo in scoring.tested(scoring.Side(a), scoring.Side(b), intervals):
            ids = _joined(a, b, i, j, ["riff_a_id", "riff_b_id"])
            yield pa.table({"riff_a_id": ids["riff_a_id"], "riff_b_id": ids["riff_b_id"], "similarity": pa.array(tempo)})

    sides = [_side(side, *(_VALUES if intervals else ["tempo"])) for side in (new, library)]
    if not intervals:  # summaries ask for these columns, of which the tempo alone counts here
        sides = [s.select("*", F.lit(0.5).alias("uniformity"), *[F.array().cast("array<double>").alias(c) for c in ("groove", "drums", "spectral", "intervals")]) for s in sides]
    columns = ["riff_id", "recording_id", "riff_order", "tempo", *(["intervals"] if intervals else [])]
    return blocks.meet(*sides, columns, run, schema, 0.0, intervals)


def warp_counts(new: DataFrame, library: DataFrame, least: float = SCORE_LEAST, warping: bool = True) -> DataFrame:
    """One row: pairs that pass the tests (compared), of these the ones that are never warped since the cheap similarities rule
    them out (bounded) or an envelope does (enveloped), those given up on the way (abandoned), and the rows of cells
    computed of all that were possible; as find_matches with least does it. The first two need no warping: without it the
    others are null."""
    names = ["compared", "bounded", *(["enveloped", "abandoned", "rows", "possible"] if warping else [])]

    def run(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        sides, told = (scoring.Side(a), scoring.Side(b)), scoring.Warps()
        if warping:
            for _ in scoring.scored(*sides, least, told):
                pass
        else:
            told = scoring.bounded(*sides, least)
        yield pa.table({n: pa.array([getattr(told, n)], pa.int64()) for n in names})

    sides = [_side(side, *_VALUES) for side in (new, library)]
    got = blocks.meet(*sides, sides[0].columns, run, ", ".join(f"{n} long" for n in names), least)
    rest = [F.lit(None).cast("long").alias(n) for n in ("enveloped", "abandoned", "rows", "possible") if n not in names]
    return got.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], *rest)


def match_stats(new: DataFrame, library: DataFrame, matches: DataFrame | None = None, least: float = SCORE_LEAST) -> DataFrame:
    """One row: pairs of different recordings, those that the cheap tests skip, those compared and those matched.

    Without matches those of least or more are counted in the same pass, and only pairs of which the cheap similarities
    leave it open are warped."""
    sizes = lambda df: df.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))
    total = new.agg(F.count(F.lit(1)).alias("a")).join(library.agg(F.count(F.lit(1)).alias("b")))
    own = sizes(new).join(sizes(library).withColumnRenamed("n", "m"), "recording_id").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("same"))
    given = matches is not None

    def run(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        sides, told = (scoring.Side(a), scoring.Side(b)), scoring.Warps()
        matched = 0 if given else scoring.matched(*sides, least, told)
        compared = sum(len(i) for i, _, _ in scoring.tested(*sides)) if given else told.compared
        yield pa.table({"compared": pa.array([compared], pa.int64()), "matched": pa.array([matched], pa.int64())})

    # least 0: every pair that passes the tests is counted, whatever its score
    met = blocks.meet(_side(new, *_VALUES), _side(library, *_VALUES), ["riff_id", "recording_id", *_VALUES], run, "compared long, matched long", 0.0)
    counts = met.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("compared", "matched")])
    if given:
        counts = counts.drop("matched").join(matches.agg(F.count(F.lit(1)).alias("matched")))
    out = total.join(own).join(counts)  # one row each
    pairs = F.col("a") * F.col("b") - F.col("same")
    return out.select(pairs.alias("pairs"), (pairs - F.col("compared")).alias("skipped"), "compared", "matched", F.when(pairs > 0, F.round(100.0 * (pairs - F.col("compared")) / pairs, 1)).otherwise(0.0).alias("percent_skipped"))


def matches_of_riff(new: DataFrame, library: DataFrame, riff_id, least: float = SCORE_LEAST) -> DataFrame:
    """Of what find_matches gives the matches with a riff on either side, without matching the others: it meets the library as
    a new riff, if it is one, and the new ones meet it as one of the library."""
    only = lambda side: side.where(F.col("riff_id") == riff_id)
    return find_matches(only(new), library, least).unionByName(find_matches(new, only(library), least))


def library_health(riffs: DataFrame, slow: int = 1000, near: int = 500) -> DataFrame:
    """One row: the number of riffs and whether brute-force matching is skipped (below two), fine, near its limit or slow."""
    n = F.count(F.lit(1))
    return riffs.agg(n.alias("n_riffs"), F.when(n < 2, "skipped").when(n > slow, "slow").when(n > near, "approaching").otherwise("fine").alias("health"))
