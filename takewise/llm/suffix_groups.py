"""Byte strings that documents repeat, found by suffix arrays that are built group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from takewise.llm import superkmers
from takewise.llm import text as tx


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of all suffixes in order, in linear time.

    Suffixes are grouped by their Lyndon prefixes, the longest prefixes that are smaller than all their own suffixes. At
    first a group holds the suffixes with one first symbol. Groups are gone through in descending order; each suffix of
    a group points to the last suffix before it in a lower group, found by following the pointers of those between. What
    is pointed to k times has this group's prefix k times after its own, and moves to a new group just above its old
    one. At the end the suffixes of a group differ only in what follows their Lyndon prefix, so one pass in ascending
    order places each where its follower's turn says; nothing is renamed and no smaller problem is solved.
    """
    n = len(symbols)
    group, members, length, above, below = [0] * n, [], [], [], []
    number: dict[int, int] = {}
    for symbol in sorted(set(symbols)):
        number[symbol] = len(members)
        members.append([])
        length.append(1)
        above.append(len(members))
        below.append(len(members) - 2)
    for i, symbol in enumerate(symbols):
        g = number[symbol]
        group[i] = g
        members[g].append(i)
    done, pointer, order = [False] * len(members), [-1] * n, []
    g = len(members) - 1
    if g >= 0:
        above[g] = -1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        order.append(g)
        done[g] = True
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            step = length[g]
            moved: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                moved.setdefault((k, group[j]), []).append(j)
            for (k, old), which in sorted(moved.items(), key=lambda x: -x[0][0]):
                which.sort()
                new = len(members)
                members.append(which)
                length.append(length[old] + k * step)
                done.append(False)
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                below[up] = new
                for j in which:
                    group[j] = new
        g = below[g]
    slot, at = [0] * len(members), 0
    for g in reversed(order):
        slot[g] = at
        at += len(members[g])
    out = [-1] * n
    for turn in range(-1, n):
        x = n if turn < 0 else out[turn]
        j = x - 1
        while j >= 0 and j + length[group[j]] == x:
            g = group[j]
            out[slot[g]] = j
            slot[g] += 1
            j = pointer[j]
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at starts, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """suffix_array of many texts at once: each in its own part of the result, counted from its own start.

    The texts take their steps together: in one step each of them goes through its highest group that is left, and in
    one turn of the last pass each places the suffixes before one suffix. A group is a run of slots, named by the first;
    what moves up goes to the last slots of its group. The work is that of the single construction, in passes over all
    members of the groups of a step. Texts of like length are best put together, as there are as many turns as the
    longest has symbols.
    """
    n, sizes = len(symbols), np.asarray(sizes, np.int64)
    base = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    member = np.lexsort((symbols, text))  # the suffix in each slot
    slot = np.empty(n, np.int64)
    slot[member] = np.arange(n)
    same = np.zeros(n, bool)
    same[1:] = (symbols[member[1:]] == symbols[member[:-1]]) & (text[1:] == text[:-1])
    first = np.flatnonzero(~same)
    size, length = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the group that starts at a slot
    size[first] = np.diff(np.append(first, n))
    group = np.full(n + 1, -1, np.int64)  # the last place stands for what is before a text, below all groups
    group[member] = np.repeat(first, size[first])
    pointer = np.full(n + 1, -1, np.int64)
    moving = np.zeros(n, bool)
    left = np.flatnonzero(sizes > 0)
    edge, current = base + sizes, np.zeros(len(sizes), np.int64)
    while len(left):
        low = group[member[edge[left] - 1]]
        current[left] = low
        many = edge[left] - low
        own = member[_spread(low, many)]
        least = np.repeat(low, many)
        j = np.where(own == base[text[own]], -1, own - 1)
        pointer[own] = j
        open_ = np.flatnonzero(group[j] >= least)
        while len(open_):  # suffixes of the group itself are skipped by what their own pointers have found so far
            step = pointer[j[open_]]
            j[open_] = step
            pointer[own[open_]] = step
            open_ = open_[group[step] >= least[open_]]
        edge[left] = low
        left = left[low > base[left]]
        j = np.sort(j[j >= 0])
        if not len(j):
            continue
        new = np.append(True, j[1:] != j[:-1])
        pointed, times = j[new], np.diff(np.append(np.flatnonzero(new), len(j)))
        old = group[pointed]
        order = np.lexsort((times, old))
        pointed, times, old = pointed[order], times[order], old[order]
        head = np.append(True, old[1:] != old[:-1])
        which, count = old[head], np.diff(np.append(np.flatnonzero(head), len(old)))
        tail = _spread(which + size[which] - count, count)
        moving[pointed] = True
        there = member[tail]
        stay = there[~moving[there]]
        vacant = slot[pointed]
        vacant = vacant[vacant < np.repeat(which + size[which] - count, count)]
        moving[pointed] = False
        member[vacant], slot[stay] = stay, vacant
        member[tail], slot[pointed] = pointed, tail
        grown = length[old] + times * length[current[text[pointed]]]
        head[1:] |= times[1:] != times[:-1]
        start = tail[head]
        part = np.diff(np.append(np.flatnonzero(head), len(tail)))
        size[which] -= count
        size[start], length[start] = part, grown[head]
        group[pointed] = np.repeat(start, part)

    reach = np.append(length[group[:n]], 0)
    free, out = np.arange(n), np.full(n, -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    running, turn = order[: int((sizes > 0).sum())], -1
    until = np.sort(sizes)
    while len(running):
        x = base[running] + (sizes[running] if turn < 0 else out[base[running] + turn])
        j = np.where(x > base[running], x - 1, -1)
        while len(j):
            hit = (j >= 0) & (j + reach[j] == x)
            j, x = j[hit], x[hit]
            g = group[j]
            place = free[g]
            out[place] = j - base[text[j]]
            free[g] = place + 1
            j = pointer[j]
        turn += 1
        running = running[: len(sizes) - int(np.searchsorted(until, turn, side="right"))]
    return out


def _gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """The hash of each run of gram bytes, by doubling."""
    if len(values) < gram:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = {1: tx.mixed(values.astype(np.uint64) + np.uint64(1))}
        size = 1
        while 2 * size <= gram:
            last = power[size]
            power[2 * size] = tx.mixed(last[: len(last) - size] * np.uint64(0x9E3779B97F4A7C15) + last[size:]) if 2 * size in (8, 64) else last[: len(last) - size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + last[size:]
            size *= 2
        n, got, at = len(values) - gram + 1, None, 0
        for bit in sorted(power, reverse=True):
            if gram & bit:
                part = power[bit][at : at + n]
                got = part if got is None else got * np.uint64(0xC2B2AE3D27D4EB4F) + part
                at += bit
        return tx.mixed(got)


def _byte_hashes(gram: int):
    def hashes(text: bytes) -> np.ndarray:
        values = np.frombuffer(text, np.uint8)
        if len(values) <= superkmers._CHUNK:
            return _gram_hashes(values, gram)
        parts = [_gram_hashes(values[a : a + superkmers._CHUNK + gram - 1], gram) for a in range(0, len(values) - gram + 1, superkmers._CHUNK)]
        return np.concatenate(parts)

    return lambda: hashes


def _orders(symbols: np.ndarray, sizes: np.ndarray, together: int = 1 << 20) -> np.ndarray:
    """suffix_arrays of texts of any lengths, about together symbols at a time; a text that is long among them goes alone."""
    out, base = np.empty(len(symbols), np.int64), np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    at, ends = 0, np.append(0, np.cumsum(sizes[order]))
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + together, side="right")) - 1)
        longest = int(sizes[order[at]])
        if ends[to] - ends[at] < 60 * longest:
            to = at + 1
            a = base[order[at]]
            out[a : a + longest] = suffix_array(symbols[a : a + longest].tolist())
        else:
            part = order[at:to]
            where = _spread(base[part], sizes[part])
            out[where] = suffix_arrays(symbols[where], sizes[part])
        at = to
    return out


def _suffix_labels(window: int):
    def labels(strings: list[bytes], keys: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The windows of all strings by number; equal windows have equal numbers. Strings of a minimiser stand together.

        The different strings of a minimiser make one text, each ended by a symbol below all bytes. In the order of its
        suffixes equal windows are side by side, so each window is compared with the one before it.
        """
        raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        size = many + window  # with the end
        base = np.cumsum(size) - size
        symbols = raw.astype(np.int32) + 1
        symbols[base + size - 1] = 0
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.add.reduceat(size, head)
        place = _orders(symbols, sizes) + np.repeat(np.cumsum(sizes) - sizes, sizes)
        begins = _spread(base, many)
        valid = np.zeros(len(symbols), bool)
        valid[begins] = True
        place = place[valid[place]]
        hashes = np.zeros(len(symbols), np.uint64)
        hashes[: len(symbols) - window + 1] = _gram_hashes(raw, window)
        again = np.flatnonzero(hashes[place[1:]] == hashes[place[:-1]])
        rows = np.lib.stride_tricks.sliding_window_view(raw, window)
        new = np.ones(len(place), bool)
        for at in range(0, len(again), 1 << 14):
            part = again[at : at + (1 << 14)]
            new[part + 1] = (rows[place[part]] != rows[place[part + 1]]).any(1)
        mark = np.empty(len(symbols), np.int64)
        mark[place] = np.cumsum(new)
        return mark[begins]

    return labels


def byte_units(window: int = 100, gram: int = 32) -> superkmers.Units:
    return superkmers.Units(window, gram, lambda text: text, _byte_hashes(gram), lambda text, a, n: text[a : a + n], _suffix_labels(window))


def remove_repeats(docs: DataFrame, window: int = 100, gram: int = 32) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept binary) of each document's UTF-8 bytes.

    Each byte is removed that a string of window bytes covers which also starts earlier (a smaller doc_id, or the same
    document and an earlier start); strings are judged on the input and don't cross documents. spans are the maximal
    removed runs. A null text is empty; one shorter than window loses nothing. Equal rows are the same document and give
    equal rows; different texts of one doc_id are documents in order of their SHA-256; rows without doc_id lose nothing.
    A very long text is cut in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, parts in zip(tx.binary(batch, "text"), batch.column("runs")):
                spans = superkmers.covered(parts.as_py(), window, len(text))
                edges = [0, *[x for span in spans for x in span], len(text)]
                rows.append((len(text), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return superkmers.repeated(docs, byte_units(window, gram)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
