"""Prefix tries and repairs of conversations against plain Python, on fixtures with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from takewise.llm import dawg, prefix_tries, repair
from takewise.llm.double_array import DoubleArray

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long, words string, signature string, audit string, mark int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fixture():
    r = random.Random(4)
    said = ["Hello there.", "Yes!", "no stop", "", "  \n", "Why?", "One two three. ", "x " * 3000 + ".", "日本語。", None]
    out = []
    for c in range(160):
        start = r.randrange(3)
        for turn in range(r.randrange(1, 7)):
            role = "system" if turn == 0 and start == 0 else r.choice(["user", "assistant", "user", "assistant", "tool", "", None])
            text = said[0] if turn == 0 and r.random() < 0.6 else r.choice(said)
            out.append((c, turn + (turn > 2), role, text))
    out += [(200, None, "user", "Null first."), (200, None, "assistant", "Null too."), (200, 1, "user", "b."), (200, 1, "user", "a."), (200, 1, "user", "a.")]
    out += [(c, t, "user" if t % 2 == 0 else "assistant", f"Copy {t}.") for c in range(300, 380) for t in range(4)]
    out += [(400, t, "user" if t % 2 == 0 else "assistant", f"Long {t}.") for t in range(500)]
    out += [(None, 0, "user", "Nobody's."), (None, None, None, None)]
    return [(*row, "p", 1, "w", "s", "a", 2) for row in out]


ROWS = fixture()


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(random.Random(1).sample(ROWS, len(ROWS)), SCHEMA).repartition(3)


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain_nodes():
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in ROWS:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, key(role, text), text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    nodes = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = turns.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append((c, d == len(path)))
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in nodes:
        if node:
            children[node[:-1]] += 1
    for node, members in nodes.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(members) - 1) * len(WORDS.findall(node[-1][1])) if node else 0
    first = {node: min(c for c, _ in m) for node, m in nodes.items()}
    ends = {node: hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in m if e)).encode()).hexdigest() for node, m in nodes.items()}
    return sorted((first[x], len(x), first[x[:-1]] if x else None, len(m), children[x], leaves[x], saved[x], ends[x]) for x, m in nodes.items())


@pytest.mark.parametrize("nodes", [200_000, 40])
def test_prefix_nodes(talks, monkeypatch, nodes):
    """In one round, and in several with tries of a few nodes each."""
    monkeypatch.setattr(prefix_tries, "NODES", nodes)
    got = prefix_tries.prefix_nodes(prefix_tries.rebuilt(prefix_tries.sequences(talks))).collect()
    assert sorted(tuple(r) for r in got) == plain_nodes()


def test_prefix_nodes_few_long_paths(spark, monkeypatch):
    """Paths longer than a trie is meant to be end in one round all the same."""
    monkeypatch.setattr(prefix_tries, "NODES", 10)
    df = spark.createDataFrame([(c, t, "user", f"{t if t < 30 else (c, t)}") for c in range(3) for t in range(60)], "conv_id long, turn long, role string, text string")
    got = prefix_tries.prefix_nodes(prefix_tries.sequences(df)).collect()
    assert len(got) == 31 + 90 and {r.n_leaves for r in got if r.depth <= 30} == {3}


def test_prefix_nodes_none(spark):
    assert prefix_tries.prefix_nodes(prefix_tries.sequences(spark.createDataFrame([], SCHEMA))).count() == 0


def test_listed_in_pieces(spark):
    members = spark.range(2000).select(F.lit(b"a").alias("path_id"), F.col("id").alias("conv_id"))
    got = prefix_tries.listed(members.repartition(5), most=100).collect()
    assert len(got) == 1 and bytes(got[0].ended) == hashlib.sha256(",".join(map(str, range(2000))).encode()).digest()


def test_double_array():
    """All sequences are found where they were put, no place is used twice, and what was not put is an error."""
    r = np.random.default_rng(2)
    for most in (3, 50, 4000):
        held = sorted({tuple(r.integers(1, most + 1, r.integers(0, 9)).tolist()) for _ in range(1500)})
        codes, lengths = np.array([c for s in held for c in s], np.int64), np.array([len(s) for s in held])
        trie = DoubleArray(codes, lengths)
        places = trie.walk(codes, lengths)
        by_place = defaultdict(set)
        at = 0
        for s in held:
            for d in range(len(s) + 1):
                by_place[int(places[at + d])].add(s[:d])
            at += len(s) + 1
        assert all(len(x) == 1 for x in by_place.values()) and len(by_place) == len({s[:d] for s in held for d in range(len(s) + 1)})
        with pytest.raises(KeyError):
            trie.walk(np.array([most + 1]), np.array([1]))


def damaged_rows():
    out = defaultdict(list)
    for conv, turn, role, text, *_ in ROWS:
        out[conv] += []
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            out[conv] += [(turn is not None, turn or 0, role, key(role, text), text, turn)] * (2 if kind == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def plain_repair(rows, insert=5):
    """By a table over the rows from the end, holding whole audits and whole results."""
    seen, marks, faults, illegal = set(), [], [0, 0, 0], 0
    for row in rows:
        role, text = row[2], row[4]
        blank, twice = not WORDS.search(text), (role, text) in seen
        seen.add((role, text))
        cut = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        for i, fault in enumerate((blank, twice, cut)):
            if fault:
                faults[i] += 1
                break
        marks.append((blank or twice, cut))
    for a, b in zip(rows, rows[1:]):
        illegal += a[2][:1] + b[2][:1] not in ("su", "ua", "au")
    turns = {r[5] for r in rows if r[5] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ()), "a": (0, "", ()), "u": None, "s": None}

    def insertions(best):
        for _ in range(6):
            for state in best:
                for to in legal[state].replace("s", ""):
                    if best[to] is not None:
                        way = (best[to][0] + insert, "I" + best[to][1], (names[to] + ":", *best[to][2]))
                        best[state] = way if best[state] is None or way[:2] < best[state][:2] else best[state]
        return best

    best = insertions(best)
    for row, (gone, cut) in zip(reversed(rows), reversed(marks)):
        now = {}
        for state in best:
            ways = [(best[state][0] + 2, "D" + best[state][1], best[state][2])]
            for to in legal[state]:
                after = best[to]
                if not gone and row[2][:1] == to:
                    ways.append((after[0] + 5 * cut, "K" + after[1], (f"{row[2]}:{row[4]}", *after[2])))
                if not gone and to != "s":
                    ways.append((after[0] + 5 * cut + 1, "R" + after[1], (f"{names[to]}:{row[4]}", *after[2])))
            now[state] = min(ways, key=lambda w: w[:2])
        best = insertions(now)
    cost, audit, lines = best[""]
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repair(talks):
    want = {c: plain_repair(rows) for c, rows in damaged_rows().items()}
    got = repair.repair(talks, repair.damaged(talks)).collect()
    assert len(got) == len(want)
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == want
    assert set("".join(x[6] for x in want.values())) == {"K", "D", "R"}  # at 5 an insertion never pays; see below


def test_repaired_rows(talks):
    """The rows that come out follow the grammar, and those without a fault stay as they are."""
    rows = repair.damaged(talks)
    got = defaultdict(list)
    for r in repair.repaired(rows, repair.audits(rows, talks)).collect():
        got[r.conv_id].append((r.position, r.role))
    assert all(re.fullmatch("s?(ua)+", "".join(role[0] for _, role in sorted(v))) for v in got.values())
    assert all([p for p, _ in sorted(v)] == list(range(len(v))) for v in got.values())


def test_repair_none(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("insert", [1, 2, 5])
def test_automaton_small_signatures(insert):
    """Every signature of up to four symbols against a search over all edits; suffixes are nodes once."""
    automaton = dawg.SuffixAutomaton(dawg.Costs(insert=insert))
    signatures = ["".join(s) for n in range(5) for s in itertools.product("sSuaAox", repeat=n)]
    ordered = sorted(signatures, key=lambda s: s[::-1])
    for s in ordered:
        rows = [(True, i, {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], b"", "" if c == "x" else f"{i}" if c.isupper() else f"{i}.", i) for i, c in enumerate(s)]
        assert automaton.best(s) == plain_repair(rows, insert)[5:7], s
    assert len(automaton.symbol) == len(signatures)
