"""Near-duplicate documents by circulant MinHash: two permutations make all coordinates of a signature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takewise.llm import text as tx
from takewise.operators.graph import connected_components
from takewise.session import checkpoint

#: Documents of a bucket that are compared in one piece; a larger bucket is a grid of such pieces.
PIECE = 256
#: Pieces for which the set of one document is made at once.
LOT = 64


@dataclass(frozen=True)
class Settings:
    """Shingles of words; links from percent similar; bands of rows coordinates each."""

    words: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 5
    seed: int = 11


class Circulant:
    """Signatures of sets of 64-bit hashes. A hash has one of 2 ** 32 slots; the first permutation scatters the slots, and
    coordinate k is the least value that the second one, shifted by k, gives to a slot of the set (Li and Li, 2021). Both
    are rules, not tables, so there are slots enough for texts of any length."""

    def __init__(self, settings: Settings):
        self.s = settings
        rng = np.random.default_rng(settings.seed)
        self.odd = (rng.integers(0, 1 << 32, 4, dtype=np.uint32) | np.uint32(1)).tolist()

    def scatter(self, slots: np.ndarray) -> np.ndarray:
        return self._moved(slots.copy(), self.odd[0], self.odd[1], np.empty_like(slots))

    def second(self, slots: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
        """In place: slots get their values."""
        return self._moved(slots, self.odd[2], self.odd[3], np.empty_like(slots) if spare is None else spare)

    @staticmethod
    def _moved(x: np.ndarray, one: int, two: int, spare: np.ndarray) -> np.ndarray:
        for shift, odd in ((16, one), (15, two)):
            np.right_shift(x, np.uint32(shift), out=spare)
            np.bitwise_xor(x, spare, out=x)
            np.multiply(x, np.uint32(odd), out=x)
        np.right_shift(x, np.uint32(16), out=spare)
        return np.bitwise_xor(x, spare, out=x)

    def coordinates(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of coordinates for each set; no set is empty."""
        count = self.s.bands * self.s.rows
        out, at = np.empty((len(sets), count), np.uint32), 0
        while at < len(sets):
            end, held = at, 0
            while end < len(sets) and (end == at or held + len(sets[end]) <= 1 << 15):
                held += len(sets[end])
                end += 1
            slots = self.scatter((np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32))
            starts = np.append(0, np.cumsum([len(x) for x in sets[at : end - 1]])).astype(np.int64)
            values, spare = np.empty_like(slots), np.empty_like(slots)
            for k in range(count):
                np.add(slots, np.uint32(k), out=values)
                out[at:end, k] = np.minimum.reduceat(self.second(values, spare), starts)
            at = end
        return out

    def bands(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of band keys for each set; no set is empty."""
        s, out = self.s, self.coordinates(sets)
        keys = np.zeros((len(sets), s.bands), np.uint64) + np.arange(1, s.bands + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for r in range(s.rows):
                keys = tx.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + out[:, r :: s.rows])
        return keys.view(np.int64)


def _sets(texts: list[bytes], hashes: tx.WordHashes, width: int) -> list[np.ndarray]:
    return [tx.shingle_hashes(hashes(t.lower().split()), width) for t in texts]


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands): the size, digest and band keys of each document's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, circulant = tx.WordHashes(), Circulant(settings)
        for ids, texts in tx.blocks(batches):
            sets = _sets(texts, hashes, settings.words)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
            some = [i for i, x in enumerate(sets) if len(x)]
            keys = circulant.bands([sets[i] for i in some])
            lengths = np.zeros(len(sets), np.int64)
            lengths[some] = settings.bands
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), bands], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def _with_sets(docs: DataFrame, roles: DataFrame, settings: Settings, lot: Column) -> DataFrame:
    """roles (doc_id, ...) with the set of their documents; the roles of a document in one lot make its set once."""
    others = [f for f in roles.schema if f.name != "doc_id"]
    packed = roles.groupBy("doc_id", lot.alias("lot")).agg(F.collect_list(F.struct(*[f.name for f in others])).alias("roles")).drop("lot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = tx.WordHashes()
        for batch in batches:
            texts = tx.binary(batch, "text")
            for at in range(0, len(texts), 256):
                sets = _sets(texts[at : at + 256], hashes, settings.words)
                raw = pa.array([x.tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 256), batch.column("roles").slice(at, 256), raw], names=["doc_id", "roles", "shingles"])

    kind = packed.schema["roles"].dataType.simpleString()
    made = docs.join(packed, "doc_id").mapInArrow(run, f"doc_id long, roles {kind}, shingles binary")
    return made.select("doc_id", "shingles", F.inline("roles"))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _star(percent: int):
    """Each document of a group against its centre."""

    def run(table: pa.Table) -> pa.Table:
        docs, centres = table.column("doc_id").to_pylist(), table.column("centre").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        middle: dict[int, list[np.ndarray]] = {}
        for d, c, s in zip(docs, centres, sets):
            if d == c:
                middle.setdefault(c, []).append(s)
        return _links([(c, d) for d, c, s in zip(docs, centres, sets) if d != c and any(_similar(m, s, percent) for m in middle[c])])

    return run


def _common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sets with others, by products of 0/1 matrices over a part of the shingles at a time."""
    every, where = np.unique(np.concatenate(sets + others), return_inverse=True)
    cuts = np.cumsum([len(x) for x in sets + others])[:-1]
    where = np.split(where, cuts)
    out = np.zeros((len(sets), len(others)), np.float32)
    for at in range(0, len(every), 4096):
        parts = []
        for some in (where[: len(sets)], where[len(sets) :]):
            m = np.zeros((len(some), 4096), np.float32)
            for i, w in enumerate(some):
                a, b = np.searchsorted(w, (at, at + 4096))
                m[i, w[a:b] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _cross(percent: int):
    """Links between documents of one bucket that are not known to be connected yet; one for each pair of labels is enough."""

    def run(table: pa.Table) -> pa.Table:
        rows: dict[tuple, list[tuple]] = {}
        columns = [table.column(c).to_pylist() for c in ("key", "i", "j", "side", "doc_id", "label", "shingles")]
        for key, i, j, side, doc, label, raw in zip(*columns):
            rows.setdefault((key, i, j), []).append((side, doc, label, np.frombuffer(raw, np.uint64)))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for (_, i, j), held in rows.items():
            held.sort(key=lambda r: (r[0], r[1]))
            one = [r for r in held if r[0] == 0]
            two = one if i == j else [r for r in held if r[0] == 1]
            if len(one) * len(two) > 64:
                common = _common([r[3] for r in one], [r[3] for r in two])
                size = [np.array([len(r[3]) for r in x], np.float64) for x in (one, two)]
                label = [np.array([r[2] for r in x]) for x in (one, two)]
                linked = (100 * common >= percent * (size[0][:, None] + size[1][None, :] - common)) & (label[0][:, None] != label[1][None, :])
                for x, y in zip(*np.nonzero(linked)):
                    found.setdefault((min(one[x][2], two[y][2]), max(one[x][2], two[y][2])), (one[x][1], two[y][1]))
            else:
                for x, a in enumerate(one):
                    for b in two[x + 1 :] if i == j else two:
                        pair = (min(a[2], b[2]), max(a[2], b[2]))
                        if a[2] != b[2] and pair not in found and _similar(a[3], b[3], percent):
                            found[pair] = (a[1], b[1])
        return _links(list(found.values()))

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    Documents are linked whose sets of shingles (words with A-Z in lower case) are similar by settings.percent at least,
    as a comparison of the full sets of 64-bit hashes confirms; component_id is the smallest doc_id reachable. Documents
    with equal sets are one class, which is compared once. Classes that share a band of their signatures are a bucket:

    1. Each class is compared with the first class of its buckets, which mostly connects a group of copies.
    2. In buckets that still hold several components, all classes of different components are compared, a large
       bucket as a grid of pieces.

    Two sets as similar as 0.8 share no band with probability (1 - 0.8 ** rows) ** bands if coordinates are independent,
    7 in a million by default; a test measures how often bands agree. A document with fewer words than a shingle has
    one; a null, empty or blank text has none and is linked with nothing. A very long text is cut whole, in one task.
    Rows that repeat a doc_id are one document, which has the links of all its texts, and give a row each; rows without
    doc_id are linked with nothing: they are kept, and their component_id is null.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = checkpoint(signatures(docs, settings))
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    banded = some.join(classes, ["h1", "h2", "doc_id"], "left_semi").select("doc_id", F.explode("bands").alias("key")).distinct()
    first = banded.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count(F.lit(1)).alias("many")).where("many > 1")
    members = checkpoint(banded.join(first, "key"))
    size = 8 * (some.agg(F.avg("n_shingles").alias("n")).first().n or 0)

    def groups(rows: int) -> int:
        """So many that a group of sets has some 4 MB."""
        return max(tx.partitions(docs), int(rows * size) >> 22)

    pairs = members.where("doc_id != centre").groupBy("doc_id").agg(F.min("centre").alias("centre"))
    pairs = checkpoint(pairs)
    salts = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("many")).select("centre", F.ceil(F.col("many") / PIECE).cast("int").alias("salts"))
    ray = pairs.join(salts, "centre").select("doc_id", "centre", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))
    hub = salts.select(F.col("centre").alias("doc_id"), "centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = F.pmod(F.xxhash64("centre", "salt"), F.lit(groups(pairs.count()))).alias("dealt")
    lot = F.floor(F.col("salt") / LOT)
    links = checkpoint(_with_sets(docs, ray.union(hub), settings, lot).withColumn("dealt", dealt).groupBy("dealt").applyInArrow(_star(settings.percent), "a long, b long"))

    labels = connected_components(links)
    labelled = members.join(labels, members.doc_id == labels.node, "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    labelled = checkpoint(labelled)
    open_ = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.col("doc_id") + 1)).alias("y"), F.count(F.lit(1)).alias("many")).where("a != b")
    open_ = open_.groupBy("x", "y", "many").agg(F.min("key").alias("key"))  # the same bucket, met in several bands, once
    side = F.ceil(F.col("many") / PIECE).cast("int")
    cells = labelled.join(open_.select("key", side.alias("side")), "key").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("side")).cast("int"))
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    cells = cells.select("doc_id", "key", "label", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("i") > F.col("j")).cast("int").alias("side"))
    cells = checkpoint(cells)
    dealt = F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups(cells.count()))).alias("dealt")
    lot = F.floor((F.col("i") + F.col("j")) / LOT)
    more = _with_sets(docs, cells, settings, lot).withColumn("dealt", dealt).groupBy("dealt").applyInArrow(_cross(settings.percent), "a long, b long")

    final = connected_components(links.union(more))
    by_class = classes.join(final, classes.doc_id == final.node, "left").select("h1", "h2", F.coalesce("component", "doc_id").alias("component"))
    linked = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    out = signed.join(by_class, ["h1", "h2"], "left").select("doc_id", "n_shingles", linked.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
