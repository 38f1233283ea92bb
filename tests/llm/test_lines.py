"""Line dedup against plain Python: at once, in batches, and after deletions; the filter by itself."""

import hashlib
import random
import tempfile
from collections import defaultdict

import numpy as np
import pytest

from takewise.llm import cuckoo, lines

SCHEMA = "doc_id long, text string, source string, key string, keys string, shard int, sign int, first long, docs string"


def fixture():
    r = random.Random(8)
    known = [f"A shared line number {i}." for i in range(40)] + ["short", "exactly10c", "ünïcödé ze", "\t  Padded line here \r", "padded LINE here"]
    out = [(1, None), (2, ""), (3, "\n"), (4, "   \n\t"), (5, "line\n" * 4000 + known[0])]
    for i in range(6, 160):
        own = [r.choice(known) if r.random() < 0.4 else f"only in {i} line {k}" for k in range(r.randrange(1, 12))]
        out.append((i * 3, "\n".join(own + own[:1])))
    out += [(1000 + i, "A line in a third of all documents.\nand its own {i}") for i in range(80)]
    out += [(30, "A second row of a document.\n" + known[1]), (30, "A second row of a document."), (None, known[0]), (None, known[0] + "\nno id")]
    return [(*row, "s", "k", "x", 1, 2, 3, "d") for row in out]


ROWS = fixture()


def plain(rows, index=None):
    """What is left of rows, given those in the index."""
    holders = defaultdict(set)
    for doc, text, *_ in rows if index is None else index:
        if doc is not None:
            for line in (text or "").split("\n"):
                holders[line.strip(" \t\n\x0b\x0c\r").lower()].add(doc)
    out = []
    for doc, text, *_ in rows:
        every = (text or "").split("\n")
        key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
        left = [x for x in every if doc is None or len(key(x)) < 10 or doc == min(holders[key(x)], default=doc)]
        out.append((-1 if doc is None else doc, len(every), len(every) - len(left), "\n".join(left)))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect())


def test_dedup_lines(spark):
    df = spark.createDataFrame(random.Random(1).sample(ROWS, len(ROWS)), SCHEMA).repartition(3)
    got = found(lines.dedup_lines(df))
    assert got == plain(ROWS) and sum(x[2] for x in got) > 300
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_batches_and_deletions(spark, monkeypatch):
    """Any order of insertions and deletions leaves what the documents that are there call for; all can be taken back."""
    index = lines.LineIndex(spark, tempfile.mkdtemp(prefix="spark-") + "/lines", shards=3)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    parts = [ROWS[2::3], ROWS[0::3], ROWS[1::3]]
    for n, part in enumerate(parts):
        index.insert(frame(part), n)
    assert found(index.apply(frame(ROWS))) == plain(ROWS)
    gone = [row for row in ROWS if row[0] is not None and row[0] % 2 == 0]
    left = [row for row in ROWS if row not in gone]
    index.delete(frame(gone), 3)
    index.delete(frame(gone), 3)  # the last batch again
    assert found(index.apply(frame(left))) == plain(left)
    index.insert(frame(gone), 4)
    assert found(lines.LineIndex(spark, index.folder).apply(frame(ROWS))) == plain(ROWS)
    index.delete(frame(ROWS), 5)
    assert index.repeats().count() == 0
    held = spark.read.parquet(f"{index.folder}/shards/batch=5").where("slots IS NOT NULL").collect()
    assert sum(len(cuckoo.CuckooFilter(bytes(r.slots))) for r in held) == 0
    with pytest.raises(ValueError):
        index.insert(frame(gone), 2)
    with pytest.raises(Exception, match="not been inserted"):
        index.delete(frame(gone), 6)


def test_false_alarms_are_added_later(spark, monkeypatch):
    """With fingerprints of three values nearly every key looks known; results are the same, and so are deletions."""
    places = cuckoo.places
    monkeypatch.setattr(lines, "places", lambda keys: (places(keys)[0] % np.uint16(3) + np.uint16(1), places(keys)[1] % np.uint32(7)))
    index = lines.LineIndex(spark, tempfile.mkdtemp(prefix="spark-") + "/lines", shards=2)
    rows = [(i, f"line number {i} of its own\nshared by everybody", "s", "k", "x", 1, 2, 3, "d") for i in range(12)]
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    index.insert(frame(rows[:6]), 0)
    index.insert(frame(rows[6:]), 1)
    index.delete(frame(rows[:1]), 2)
    assert found(index.apply(frame(rows[1:]))) == plain(rows[1:])
    index.delete(frame(rows[1:]), 3)
    assert index.repeats().count() == 0


def test_cuckoo_filter():
    keys = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest()[:16] for i in range(60_000)), np.uint8).reshape(-1, 16)
    mark, bucket = cuckoo.places(keys)
    held = cuckoo.CuckooFilter()
    for at in range(0, 30_000, 7_000):
        held.add(mark[at : min(at + 7_000, 30_000)], bucket[at : min(at + 7_000, 30_000)])
    assert len(held) == 30_000 and held.contains(mark[:30_000], bucket[:30_000]).all()
    assert held.contains(mark[30_000:], bucket[30_000:]).mean() < 0.003
    held = cuckoo.CuckooFilter(held.to_bytes())
    held.remove(mark[:20_000], bucket[:20_000])
    assert len(held) == 10_000 and held.contains(mark[20_000:30_000], bucket[20_000:30_000]).all()
    assert held.contains(mark[:20_000], bucket[:20_000]).mean() < 0.003
    with pytest.raises(ValueError):
        held.remove(mark[:20_000], bucket[:20_000])


def test_cuckoo_filter_equal_fingerprints():
    """Keys that can't be told apart take a place each, and go one by one."""
    held = cuckoo.CuckooFilter()
    same = (np.full(30, 5, np.uint16), np.full(30, 9, np.uint32))
    held.add(*same)
    assert len(held) == 30
    held.remove(*(x[:29] for x in same))
    assert len(held) == 1 and held.contains(*(x[:1] for x in same)).all()
