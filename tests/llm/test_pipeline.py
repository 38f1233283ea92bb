"""The pipeline's stages, each against what its operator or brute force says."""

import zlib

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from takewise.llm import weak_labels

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().split()


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    first = docs
    kept = {r.doc_id for r in weak_labels.classify(docs).collect() if r.kept}
    good = stages[0](spark, docs, FOLDER)
    rows = {r.doc_id: r.text for r in good.collect()}
    assert set(rows) == kept and good.columns == docs.columns

    sets = {d: {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} if (w := words(t.lower() if t.isascii() else t.encode().lower().decode())) else set() for d, t in rows.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    unique = stages[1](spark, good, FOLDER)
    left = {r.doc_id: r.text for r in unique.collect()}
    assert set(left) == {d for d in sets if root(d) == d} and unique.columns == docs.columns

    seen, want = set(), {}
    for d in sorted(left):
        w = words(left[d])
        hit = [False] * len(w)
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                hit[i : i + 20] = [True] * 20
            seen.add(tuple(w[i : i + 20]))
        want[d] = [x for x, h in zip(w, hit) if not h]
    stripped = stages[2](spark, unique, FOLDER)
    assert {r.doc_id: words(r.text) for r in stripped.collect()} == want and stripped.columns == docs.columns
    hidden = stages[3](spark, stripped, FOLDER)
    assert hidden.columns == first.columns and hidden.count() == len(want)
    texts = {r.doc_id: r.text for r in hidden.collect()}

    model, at = Tokenizer.from_file(path("word_bpe_49k.json")), {}
    for r in stages[4](spark, hidden, FOLDER).collect():
        ids = [*model.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 2048 and sorted(s)[0][0] == 0 for s in at.values())
    assert corpus_pipeline.run(spark, FOLDER).count() == sum(map(len, at.values()))


EDGES = "doc_id long, text string, source string, n_chars long, kept string, found string, bucket int, component_id string, n_private string"


def edge_rows():
    passage = " ".join(f"word{i} of" for i in range(60))
    texts = [(None, passage), (1, None), (2, ""), (3, passage), (3, passage), (4, passage), (5, "Mail a.b@example.com, born 1990-01-31. " * 2000), (6, " \n\t")]
    return [(d, t, None if d == 2 else "s", None if t is None else len(t), "k", "f", 1, "c", "p") for d, t in texts]


def test_stages_on_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame(edge_rows(), EDGES)
    quality, near, substrings, private, packed = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    good = quality(spark, docs, FOLDER)
    assert good.columns == docs.columns and not {1, 2, 6} & set(ids(good))
    unique = near(spark, docs, FOLDER)
    assert unique.columns == docs.columns and ids(unique) == [1, 2, 3, 3, 5, 6, None]
    stripped = substrings(spark, unique, FOLDER)
    left = {r.doc_id: r.text for r in stripped.collect()}
    assert stripped.columns == docs.columns and ids(stripped) == [1, 2, 3, 3, 5, 6, None]
    assert left[None] == left[3] == edge_rows()[0][1] and left[1] is None and len(left[5].split()) < 30
    hidden = private(spark, docs, FOLDER)
    shown = {r.doc_id: r for r in hidden.collect()}
    assert hidden.columns == docs.columns and "a.b@" not in shown[5].text and shown[5].n_chars == len(shown[5].text) and shown[5].n_private == "p" and shown[1].text is None
    pieces = packed(spark, docs, FOLDER).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 2, 3, 4, 5, 6} and all(r.length == 1 for r in pieces if r.doc_id in (1, 2))


def test_stages_on_an_empty_table(spark):
    none = spark.createDataFrame([], EDGES)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, none, FOLDER)
        assert got.columns == none.columns and got.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, FOLDER).count() == 0
