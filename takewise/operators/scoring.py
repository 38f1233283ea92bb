"""Numpy work on blocks of riffs: tests, similarities, and warping that stops where it cannot matter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The weights of the five similarities, for fast uniform playing, for grooves, and for the rest.
WEIGHTS = {
    "blast": {"contour": 0.55, "groove": 0.10, "drums": 0.10, "spectral": 0.05, "tempo": 0.20},
    "groove": {"contour": 0.15, "groove": 0.35, "drums": 0.20, "spectral": 0.10, "tempo": 0.20},
    "balanced": {"contour": 0.30, "groove": 0.25, "drums": 0.15, "spectral": 0.10, "tempo": 0.20},
}
BLAST_ABOVE, GROOVE_BELOW = 0.7, 0.4
TEMPO_LEAST, INTERVAL_LEAST, SCORE_LEAST = 0.6, 0.15, 0.3
LONGEST = 500
VECTORS = ("groove", "drums", "spectral")

#: Cells of the new riffs by the library's that are held at once, pairs that are warped at once, and rows between two
#: looks at which of these can still reach the score.
CELLS, PAIRS, ROWS = 1 << 18, 512, 8
#: Pairs of one new riff, next to each other, that are warped by themselves; its values are then numbers, not vectors.
ALONE = 160
#: Share of the pairs still warped below which those given up are taken out; each time copies what is left.
LEFT = 0.75
#: What rounding and floating point may add to a score or take from it.
SLACK = 5.1e-5
#: Rounding of single precision, and the largest values of a curve whose squares it takes.
UNIT, SINGLE = 2.0**-24, 1e6
LABELS = list(WEIGHTS)
_TABLE = {k: np.array([w[k] for w in WEIGHTS.values()]) for k in WEIGHTS["blast"]}


def padded(lists: pa.ChunkedArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, lengths) of lists of numbers, filled with zeros; null lists are empty, null numbers 0."""
    parts = lists.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(parts.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), width or 0)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out, lengths


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _wide(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Both with as many columns, the narrower filled with zeros."""
    width = max(a.shape[1], b.shape[1])
    return [x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b)]


def _cosines(dot: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Cosines from products and lengths; no less than 0, and 0 with a vector next to zero."""
    usable = (one >= 1e-10) & (two >= 1e-10)
    return np.where(usable, np.maximum(0, dot / np.where(usable, one * two, 1)), 0)


def rounded(x: np.ndarray) -> np.ndarray:
    """To four digits, halves up as in SQL."""
    return np.floor(x * 1e4 + 0.5) / 1e4


def tempo_similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = (np.where(t > 0, t, 1.0) for t in (a, b))
    best = np.maximum.reduce([np.minimum(p, q) / np.maximum(p, q) for p, q in ((x, y), (x, 2 * y), (2 * x, y))])
    return np.where((a > 0) & (b > 0), np.where(best >= 0.85, 1.0, best), 0.5)


def labels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which weights two uniformities call for, as places in LABELS."""
    return np.where((a > BLAST_ABOVE) & (b > BLAST_ABOVE), 0, np.where((a < GROOVE_BELOW) & (b < GROOVE_BELOW), 1, 2)).astype(np.int8)


@dataclass
class Warps:
    """How warping went: pairs that passed the tests, those whose other similarities already rule the score out, those that
    an envelope of the other curve rules out, those given up on the way, and the rows of cells computed and possible."""

    compared: int = 0
    bounded: int = 0
    enveloped: int = 0
    abandoned: int = 0
    rows: int = 0
    possible: int = 0


def _columns(x: np.ndarray) -> np.ndarray:
    """x, with columns of zeros up to a multiple of 16, so that no row begins across a line of the cache."""
    out = np.zeros((len(x), -(-x.shape[1] // 16) * 16), x.dtype)
    out[:, : x.shape[1]] = x
    return out


def _distances(a: np.ndarray, b: np.ndarray, most: np.ndarray | None, told: Warps) -> np.ndarray:
    """The distances that warp_batch makes similarities of, in the precision of a and b; infinite where given up. One row
    of a stands for as many as b has."""
    (pairs, m), n = b.shape, a.shape[1]
    one = len(a) == 1
    out, live = np.full(pairs, np.inf), np.arange(pairs)
    told.possible += pairs * n
    if most is not None:
        off = np.maximum(0, np.maximum(a - b.max(1)[:, None], b.min(1)[:, None] - a)) ** 2
        ahead = np.concatenate([np.cumsum(off[:, ::-1], axis=1)[:, ::-1], np.zeros((pairs, 1), off.dtype)], axis=1)
        fits = ahead[:, 0] <= most
        told.enveloped += int((~fits).sum())
        live, a, b, ahead, most = live[fits], a if one else a[fits], b[fits], ahead[fits], most[fits]
    # a pair to a column, so that each step is a few passes over memory that lies together
    a, b = a[0] if one else _columns(a.T), _columns(b.T)
    row, cell, least = (np.zeros((k, b.shape[1]), b.dtype) for k in (m + 1, m, m))
    fits = np.ones(len(live), bool)
    for i in range(n):
        told.rows += len(live)
        np.subtract(b, a[i], out=cell)
        np.multiply(cell, cell, out=cell)
        np.minimum(row[1:], row[:-1], out=least)
        np.add(cell, least, out=row[1:])
        row[0] = np.inf
        if most is not None and i % ROWS == ROWS - 1 and i < n - 1:
            fits = row[1:].min(0)[: len(live)] + ahead[:, i + 1] <= most
            if np.count_nonzero(fits) < LEFT * len(fits):
                told.abandoned += int((~fits).sum())
                kept = np.flatnonzero(fits)
                live, ahead, most, a, b, row = live[kept], ahead[kept], most[kept], a if one else _columns(a[:, kept]), _columns(b[:, kept]), _columns(row[:, kept])
                cell, least = (np.zeros(b.shape, b.dtype) for _ in range(2))
                fits = np.ones(len(kept), bool)
                if not len(live):
                    return out
    told.abandoned += int((~fits).sum())
    if len(live):
        out[live[fits]] = row[1:].min(0)[: len(live)][fits]
    return out


def _parts(i: np.ndarray) -> list[slice]:
    """Pairs of new riffs i that are warped at once: those of one riff by themselves if they are many, others PAIRS at a time."""
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(i)]
    out, at = [], 0
    for low, high in [(int(x), int(y)) for x, y in zip(starts, ends) if y - x >= ALONE] + [(len(i), len(i))]:
        out += [slice(k, min(k + PAIRS, low)) for k in range(at, low, PAIRS)]
        many = -(-(high - low) // (2 * PAIRS))  # as large as each other, and larger: they need less memory a pair
        out += [slice(low + (high - low) * k // many, low + (high - low) * (k + 1) // many) for k in range(many)]
        at = high
    return out


def warp_batch(a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None, told: Warps | None = None) -> np.ndarray:
    """functions.arrays.warped for many pairs of curves of equal lengths: rows of a with rows of b.

    most: for each pair the distance beyond which its similarity doesn't matter; such a pair may come out as 0. The
    distance is at least the sum, over the values of a, of the squared distance to the range of b; and the least cell of
    a row, with that sum over the rows to come, never exceeds it. What exceeds most is given up.
    """
    if not a.shape[1] or not b.shape[1]:
        return np.zeros(len(a))
    return np.maximum(0, 1 - _distances(a, b, most, told or Warps()) / min(a.shape[1], b.shape[1]) / 2)


def _error(distance: np.ndarray, n: int, largest: float) -> np.ndarray:
    """By how much single precision may miss a distance over n values, none beyond largest: rounded values, squares and sums."""
    return 1.1 * UNIT * ((n + 4) * distance + 4 * largest * np.sqrt(n * distance))


class Side:
    """A block of riffs as matrices."""

    def __init__(self, riffs: pa.Table):
        self.riffs = riffs
        number = lambda name, missing: pc.fill_null(riffs.column(name).cast(pa.float64()), missing).combine_chunks().to_numpy(zero_copy_only=False)
        self.tempo = number("tempo", 0.0)
        self.uniformity = number("uniformity", 0.5) if "uniformity" in riffs.column_names else None
        self.matrix = {k: padded(riffs.column(k)) for k in ("intervals", *VECTORS, "contour") if k in riffs.column_names}
        self.norms = {k: _norms(x) for k, (x, _) in self.matrix.items()}
        self.kept: dict = {}

    def curves(self) -> tuple[np.ndarray, np.ndarray]:
        """Contours and their lengths; one of more than LONGEST points is resampled to as many."""
        if "curves" not in self.kept:
            curve, lengths = self.matrix["contour"]
            long = np.flatnonzero(lengths > LONGEST)
            out = curve[:, :LONGEST].copy() if curve.shape[1] > LONGEST else curve
            for i in long:
                out[i] = np.interp(np.linspace(0, lengths[i], LONGEST), np.arange(lengths[i]), curve[i, : lengths[i]])
            self.kept["curves"] = out, np.minimum(lengths, LONGEST)
        return self.kept["curves"]

    def single(self) -> tuple[np.ndarray, float]:
        """The curves in single precision, and their largest value."""
        if "single" not in self.kept:
            curve = self.curves()[0]
            largest = float(np.abs(curve).max(initial=0))
            self.kept["single"] = (curve.astype(np.float32) if largest <= SINGLE else curve), largest
        return self.kept["single"]

    def steps(self) -> np.ndarray:
        """Intervals of length 1 in single precision; zeros where there are none."""
        if "steps" not in self.kept:
            norm = self.norms["intervals"]
            self.kept["steps"] = (self.matrix["intervals"][0] / np.where(norm >= 1e-10, norm, np.inf)[:, None]).astype(np.float32)
        return self.kept["steps"]


def _codes(a: pa.Table, b: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of any type as numbers that are equal where the ids are."""
    both = pa.chunked_array([*a.column(name).chunks, *b.column(name).chunks], a.column(name).type).combine_chunks()
    codes = pc.fill_null(both.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return codes[: a.num_rows], codes[a.num_rows :]


def _alike(new: Side, library: Side, own: slice) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the new riffs own, counted from its start, and the library's whose steps are alike, or of which one has none.

    Single precision decides but where it is too close to tell."""
    one, two = _wide(new.steps()[own], library.steps())
    alike = one @ two.T
    alike[new.matrix["intervals"][1][own] == 0] = 2
    alike[:, library.matrix["intervals"][1] == 0] = 2
    near = (one.shape[1] + 8) * 2 * UNIT
    flat = np.flatnonzero(alike.ravel() >= INTERVAL_LEAST - near)
    i, j = np.divmod(flat, alike.shape[1])
    close = np.flatnonzero(alike.ravel()[flat] < INTERVAL_LEAST + near)
    if len(close):
        x, y = i[close] + own.start, j[close]
        a, b = _wide(new.matrix["intervals"][0][x], library.matrix["intervals"][0][y])
        keep = np.ones(len(flat), bool)
        keep[close] = _cosines((a * b).sum(1), new.norms["intervals"][x], library.norms["intervals"][y]) >= INTERVAL_LEAST
        i, j = i[keep], j[keep]
    return i, j


def tested(new: Side, library: Side, intervals: bool = True):
    """(i, j, tempo similarity) of the pairs that pass the tests, some new riffs at a time: different riffs of different
    recordings, tempos alike, and, if both have intervals, steps alike. Both sides must hold rows."""
    ids, recordings = (_codes(new.riffs, library.riffs, c) for c in ("riff_id", "recording_id"))
    step = max(1, CELLS // max(1, library.riffs.num_rows))
    for at in range(0, new.riffs.num_rows, step):
        own = slice(at, at + step)
        if intervals:
            i, j = _alike(new, library, own)
            i = i + at
            apart = np.flatnonzero((ids[0][i] != ids[1][j]) & (recordings[0][i] != recordings[1][j]))
            i, j = i[apart], j[apart]
            tempo = tempo_similarities(new.tempo[i], library.tempo[j])
            keep = np.flatnonzero(tempo >= TEMPO_LEAST)
            yield i[keep], j[keep], tempo[keep]
        else:
            tempo = tempo_similarities(new.tempo[own, None], library.tempo[None, :])
            i, j = np.nonzero((ids[0][own, None] != ids[1][None, :]) & (recordings[0][own, None] != recordings[1][None, :]) & (tempo >= TEMPO_LEAST))
            yield i + at, j, tempo[i, j]


def opened(new: Side, library: Side, least: float, told: Warps, chosen=None):
    """(i, j, label, similarities, rest, share) of the pairs that pass the tests and whose cheap similarities, with the best
    contour, reach least: rest is the score without the contour, share the contour's weight. chosen(i, j), if given, says
    which of the pairs that pass the tests are asked for."""
    for i, j, tempo in tested(new, library):
        if chosen is not None:
            keep = np.flatnonzero(chosen(i, j))
            i, j, tempo = i[keep], j[keep], tempo[keep]
        told.compared += len(i)
        label = labels(new.uniformity[i], library.uniformity[j])
        # products for the rows at hand alone: a tile of new riffs with the whole block
        low = int(i[0]) if len(i) else 0
        high = int(i[-1]) + 1 if len(i) else 0
        sims = {}
        for k in VECTORS:
            a, b = _wide(new.matrix[k][0][low:high], library.matrix[k][0])
            sims[k] = _cosines((a @ b.T)[i - low, j], new.norms[k][i], library.norms[k][j])
        sims["tempo"] = tempo
        rest = sum(_TABLE[k][label] * sims[k] for k in sims)
        share = _TABLE["contour"][label]
        open_ = np.flatnonzero(rest + share >= least - SLACK)
        told.bounded += len(i) - len(open_)
        yield i[open_], j[open_], label[open_], {k: v[open_] for k, v in sims.items()}, rest[open_], share[open_]


def bounded(new: Side, library: Side, least: float) -> Warps:
    """How many pairs are compared and how many need no warping, which only the cheap similarities decide: nothing is warped."""
    told = Warps()
    for _ in opened(new, library, least, told):
        pass
    return told


def _summed(label: np.ndarray, sims: dict, contour: np.ndarray) -> np.ndarray:
    return sum(_TABLE[k][label] * (contour if k == "contour" else sims[k]) for k in ("contour", "groove", "drums", "spectral", "tempo"))


def scores(new: Side, library: Side, i: np.ndarray, j: np.ndarray, label: np.ndarray, sims: dict, rest: np.ndarray, share: np.ndarray, least: float | np.ndarray, told: Warps) -> np.ndarray:
    """The rounded scores of pairs, with their contours put among sims; least may differ by pair, and what doesn't reach it
    may come out lower.

    Curves are warped in single precision, and once more in double where its error might change a rounded digit of the
    contour or the score, so both are those of double precision."""
    contour, miss = np.zeros(len(i)), np.zeros(len(i))
    (long, n), (wide, m) = ((side.curves()[0], side.curves()[1][k]) for side, k in ((new, i), (library, j)))
    (a32, most_a), (b32, most_b) = new.single(), library.single()
    largest, least = max(most_a, most_b), np.broadcast_to(least, len(i))
    exact = a32.dtype == b32.dtype == np.float64 or not largest <= SINGLE
    size = n * (LONGEST + 1) + m
    for key in np.unique(size):
        a, b = divmod(int(key), LONGEST + 1)
        if not a or not b:
            continue
        where, one, two = np.flatnonzero(size == key), (long if exact else a32)[:, :a], (wide if exact else b32)[:, :b]
        for own in _parts(i[where]):
            part = where[own]
            alone = i[part[0]] == i[part[-1]] and bool((i[part] == i[part[0]]).all())
            most = 2.0 * min(a, b) * (1 - (least[part] - SLACK - rest[part]) / share[part])
            most = np.where(rest[part] >= least[part] - SLACK, np.inf, most)  # no distance rules these out
            if np.isinf(most).all():
                most = None
            elif not exact:
                most = most + 2 * _error(np.maximum(most, 0), a, largest)
            distance = _distances(one[i[part[:1]] if alone else i[part]], two[j[part]], most, told)
            contour[part] = np.maximum(0, 1 - distance / min(a, b) / 2)
            if not exact:
                miss[part] = np.where(np.isinf(distance), 0, _error(distance, a, largest)) / min(a, b) / 2
    if not exact:
        score = _summed(label, sims, contour)
        near = [np.floor((x + by * d) * 1e4 + 0.5) for x, d in ((contour, miss), (score, _TABLE["contour"][label] * miss)) for by in (-1, 1)]
        doubtful = np.flatnonzero((near[0] != near[1]) | (near[2] != near[3]))
        for key in np.unique(size[doubtful]):
            a, b = divmod(int(key), LONGEST + 1)
            where = doubtful[size[doubtful] == key]
            for at in range(0, len(where), PAIRS):
                part = where[at : at + PAIRS]
                contour[part] = warp_batch(long[i[part], :a], wide[j[part], :b])
    sims["contour"] = contour
    return rounded(_summed(label, sims, contour))


def scored(new: Side, library: Side, least: float, told: Warps):
    """(i, j, label, similarities, score) of the pairs that score least or more, rounded to four digits."""
    for i, j, label, sims, rest, share in opened(new, library, least, told):
        score = scores(new, library, i, j, label, sims, rest, share, least, told)
        hit = np.flatnonzero(score >= least)
        yield i[hit], j[hit], label[hit], {k: v[hit] for k, v in sims.items()}, score[hit]


def matches(new: Side, library: Side, i: np.ndarray, j: np.ndarray, label: np.ndarray, sims: dict, rest: np.ndarray, share: np.ndarray, least: float, told: Warps) -> np.ndarray:
    """Which pairs score least or more; warping takes no score away, so only those that need it to reach least are warped."""
    sure = rest >= least + SLACK
    unsure = np.flatnonzero(~sure)
    sure[unsure] = scores(new, library, i[unsure], j[unsure], label[unsure], {k: v[unsure] for k, v in sims.items()}, rest[unsure], share[unsure], least, told) >= least
    return sure


def matched(new: Side, library: Side, least: float, told: Warps) -> int:
    """The number of pairs that scored gives."""
    return sum(int(matches(new, library, *pairs, least, told).sum()) for pairs in opened(new, library, least, told))
