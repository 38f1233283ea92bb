"""A quality classifier without given labels: heuristic labellers vote, EM weighs them, a linear scorer learns the result.

Abusive language is judged the same way by labellers and a scorer of its own, since an abusive text may be well written.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takewise.llm import text as tx

#: Frequent short words of English, French, German and Spanish, as fixed values.
FUNCTION_WORDS = frozenset(
    b"""a an and are as at be by for from had has have he her his in is it its not of on or she that the their this to was were which with you
    au aux avec ce dans de des du elle en est et il la le les par pas pour que qui se son sur un une
    als auf aus das dem den der die du ein eine er es im ist mit nicht sich sie und von wir zu
    al con del el ella los las lo no o para por se si su una y""".split()
)

#: Insults of the same languages in small letters: names people are called, and epithets.
NAMES = frozenset(
    """arsehole asshole bastard bitch buffoon clown coward creep cretin cunt dickhead dimwit douchebag dumbass dunce faggot fool fuckwit garbage halfwit idiot idiots
    imbecile jackass jerk loser losers lowlife moron morons motherfucker nigger parasite prick psycho pussy retard scum scumbag slut thug trash twat vermin wanker whore wimp
    abruti abrutie batard bouffon bâtard connard connards connasse crétin débile enculé enfoiré imbécile ordure pouffiasse pourriture putain pute racaille salaud salope
    abschaum arschloch bastard depp drecksau dummkopf fotze hurensohn hure miststück schlampe schwachkopf schwuchtel spast trottel versager vollidiot wichser
    basura bastardo cabrón capullo cretino escoria estúpido gilipollas hijoputa idiota imbécil maricón pendejo perdedor puta puto subnormal zorra""".encode().split()
)
EPITHETS = frozenset(
    """brainless contemptible despicable disgusting dumb fucking gutless idiotic loathsome moronic pathetic repulsive retarded shitty spineless stupid vile worthless
    dégoûtant dégoûtante lamentable minable méprisable pathétique répugnant répugnante stupide
    armselig bescheuert dumm ekelhaft erbärmlich jämmerlich verdammt wertlos widerlich widerwärtig
    asqueroso asquerosa despreciable estúpida patético patética repugnante""".encode().split()
)
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")

_SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_LONG = [(re.compile(rb"a{3,}"), b"aa"), (re.compile(rb"A{3,}"), b"AA"), (re.compile(rb"0{3,}"), b"00")]
_MARKS = b"#*$%&|<>=~^_{}[]\\"


#: First bytes of characters of other scripts in UTF-8: all from Greek on, but general punctuation.
_OTHER_SCRIPTS = bytes([*range(0xCE, 0xE2), *range(0xE3, 0xF5)])
_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def foreign(text: bytes) -> bool:
    """Whether most letters of a text belong to another script than the Latin one."""
    if text.isascii():
        return False
    other = len(text) - len(text.translate(None, _OTHER_SCRIPTS))
    return other > len(text) - len(text.translate(None, _ASCII_LETTERS))


def counts(text: bytes) -> dict[str, float]:
    """What the labellers look at, from a whole text. In another script than the Latin one words and sentences are not
    told by blanks, function words and ASCII stops, so nothing is said that depends on them."""
    words = text.split()
    n = len(words)
    if not n:
        return {"n": 0}
    if foreign(text):
        return {"n": n, "marks": sum(map(text.count, [bytes([m]) for m in _MARKS])) / max(1, len(text) // 3), "stutter": sum(a == b for a, b in zip(words, words[1:])) / n}
    kinds = Counter(words)
    letters = text.translate(_SHAPE)
    upper, lower = letters.count(b"A"), letters.count(b"a")
    return {
        "n": n,
        "marks": sum(map(text.count, [bytes([m]) for m in _MARKS])) / n,
        "bare": sum(v for w, v in kinds.items() if not w.translate(_SHAPE, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) / n,
        "upper": upper / max(1, upper + lower),
        "shouts": text.count(b"!") / n,
        "stutter": sum(a == b for a, b in zip(words, words[1:])) / n,
        "distinct": len(kinds) / n,
        "function": sum(v for w, v in kinds.items() if w.lower().strip(b".,;:!?") in FUNCTION_WORDS) / n,
        "stops": (text.count(b".") + text.count(b",") + text.count(b"?")) / n,
        "length": len(text) / n,
    }


#: Labellers as (name, what they look at, bad from, bad to, good from, good to, words that a vote against needs).
LABELLERS = [
    ("marks", "marks", 0.5, 1e9, 0, 0.05, 4),
    ("bare", "bare", 0.2, 1e9, 0, 0.02, 4),
    ("capitals", "upper", 0.5, 1e9, 0, 0.2, 4),
    ("shouting", "shouts", 0.3, 1e9, 0, 0.05, 4),
    ("stuttering", "stutter", 0.2, 1e9, 0, 0.02, 8),
    ("variety", "distinct", 0, 0.1, 0.3, 1e9, 20),
    ("function_words", "function", -1, 0.02, 0.06, 1e9, 20),
    ("sentences", "stops", -1, 0.01, 0.02, 0.6, 20),
    ("word_length", "length", 25, 1e9, 3, 12, 4),
    ("size", "n", 0, 0, 12, 1e9, 0),
]


def spoken(text: bytes) -> dict[bytes, int]:
    """How often each word of letters occurs, in small letters; what is stuck to a word doesn't matter."""
    return Counter(_LETTERS.findall(text.lower()))


def abuse(words: dict[bytes, int]) -> dict[str, float]:
    """What the labellers of abuse look at, from all words of a text."""
    n = sum(words.values())
    if not n:
        return {"n": 0}
    names, epithets = NAMES & words.keys(), EPITHETS & words.keys()
    a, b = sum(words[w] for w in names), sum(words[w] for w in epithets)
    return {"n": n, "insults": (a + b) / n, "names": a / n, "epithets": b / n, "kinds": len(names) + len(epithets)}


#: Labellers of abuse, in the form of LABELLERS: shares of insults among the words, and different insults.
ABUSE = [
    ("insults", "insults", 0.005, 2, 0, 0.002, 1),
    ("names", "names", 0.005, 2, 0, 0.002, 1),
    ("epithets", "epithets", 0.005, 2, 0, 0.002, 1),
    ("kinds", "kinds", 2, 1e9, 0, 1, 1),
]


def votes(text: bytes) -> str:
    """A letter for each labeller: b (bad), g (good) or - (none). An empty text has no votes."""
    return _votes(counts(text), LABELLERS)


def _votes(seen: dict[str, float], labellers: list[tuple]) -> str:
    out = []
    for _, what, bad_from, bad_to, good_from, good_to, least in labellers:
        value = seen.get(what)
        if value is None:
            out.append("-")
        elif bad_from <= value < bad_to:
            out.append("b" if seen["n"] >= least else "-")
        else:
            out.append("g" if good_from <= value < good_to else "-")
    return "".join(out)


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each pattern of votes, each labeller's rates of b and g for bad and good, the share of good.

    Expectation-maximisation over the patterns weighted by their counts. It starts from the belief that a document is
    good unless a labeller is against it, and prior counts keep a labeller from turning against its own meaning.
    """
    if not patterns:
        return {}, np.zeros((0, 2, 2)), 0.5
    keys = sorted(patterns)
    seen = np.array([["bg-".index(c) for c in k] for k in keys])
    weight = np.array([patterns[k] for k in keys], float)
    marks = np.eye(3)[seen][:, :, :2]  # pattern, labeller, vote: no vote says nothing
    good = np.where((seen == 0).any(1), 0.1, 0.95)
    believed = np.array([[2.0, 2.0], [0.1, 5.0]]) * max(1.0, 0.001 * weight.sum())
    for _ in range(rounds):
        share = (weight @ good + 1) / (weight.sum() + 2)
        mass = np.stack([weight * (1 - good), weight * good])
        rates = np.einsum("cp,plv->lcv", mass, marks) + believed
        rates /= rates.sum(2, keepdims=True)
        log = np.einsum("plv,lcv->pc", marks, np.log(rates)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return dict(zip(keys, good.tolist())), rates, float(share)


class Hashing:
    """The shapes of a text's words (letters, capitals and digits by kind, runs cut short) and function words, hashed."""

    def __init__(self, size: int):
        self.size, self.table = size, {}

    def slot(self, token: bytes) -> int:
        if token not in self.table:
            if len(self.table) > 100_000:
                self.table = {}
            self.table[token] = xxhash.xxh3_64_intdigest(token) % (self.size - 1)
        return self.table[token]

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        shape = text.translate(_SHAPE)
        for pattern, short in _LONG:
            shape = pattern.sub(short, shape)
        found: Counter = Counter()
        words = text.split()
        for token, k in Counter(shape.split()).items():
            found[self.slot(token[:24])] += k
        for token, k in Counter(words).items():
            if len(token) <= 4 and token.lower() in FUNCTION_WORDS:
                found[self.slot(b"w:" + token.lower())] += k
        same = sum(a == b for a, b in zip(words, words[1:]))
        if same:
            found[self.slot(b"same")] += same
        index = np.fromiter(found.keys(), np.int64, len(found))
        value = np.sqrt(np.fromiter(found.values(), float, len(found)) / max(1, len(words)))
        return np.append(index, self.size - 1), np.append(value, 1.0)  # the last slot is the constant


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    posteriors: dict[str, float]
    rates: np.ndarray
    share: float
    #: For abuse: the weight of each word, the constant, and the posterior of a clean text for each pattern of votes.
    words: dict[bytes, float] = field(default_factory=dict)
    constant: float = 0.0
    clean: dict[str, float] = field(default_factory=dict)

    def toxicity(self, text: bytes) -> float:
        """How likely a text is abusive: what the labellers or the scorer of words say, whichever is more."""
        words = spoken(text)
        if not self.words or not words:
            return 0.0
        n, known = sum(words.values()), self.words.keys() & words.keys()
        at = self.constant + sum(self.words[w] * _presence(words[w], n) for w in sorted(known))
        return max(float(1 / (1 + np.exp(np.clip(at, -30, 30)))), 1 - self.clean.get(_votes(abuse(words), ABUSE), 1.0))


def _presence(many: int, n: int) -> float:
    """A word that is a hundredth of a text is present in full; one of a long text counts less."""
    return min(1.0, (100 * many / n) ** 0.5)


def train(x: np.ndarray, target: np.ndarray, rounds: int) -> np.ndarray:
    """Weights of a logistic regression on posteriors; the bad, who are few, weigh as much as the good."""
    size = x.shape[1]
    balance = np.where(target < 0.5, 0.5 / max(1e-3, float((target < 0.5).mean() if len(x) else 1)), 1.0).clip(1, 20).astype(np.float32)
    w, m, v = np.zeros(size, np.float32), np.zeros(size, np.float32), np.zeros(size, np.float32)
    for step in range(1, rounds + 1):
        if not len(x):
            break
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        slope = x.T @ (balance * (p - target)) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w.astype(float)


def sampled(docs: DataFrame, sample: int, total: int) -> DataFrame:
    """The sample different rows (doc_id, text) of least hash, of total; rows that are repeated count once, so no doc_id, null
    or common, brings in more. Hashes decide first, so only the texts of the sample are shuffled."""
    rows = tx.only(docs, "doc_id", "text").withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    share = 2 * sample / max(1, total)
    while True:
        near = rows.where(F.col("place") < F.lit(int(min(1.0, share) * (1 << 40))))
        told = near.select("place").distinct().orderBy("place").limit(sample).agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).first()
        if told.n >= sample or share >= 1:
            return near.where(F.col("place") <= F.lit(told.last)).dropDuplicates(["place"]).drop("place")
        share *= 16  # most rows are repeated: the different ones lie further apart


def fit(docs: DataFrame, sample: int = 8_000, size: int = 2048, rounds: int = 200, vocabulary: int = 2_000) -> Model:
    """The scorer for docs (doc_id, text).

    All documents vote; what goes to the driver is the number of documents of each pattern of votes, of which there are
    3 to the power of the labellers at most. The scorer is a logistic regression on the posteriors of sample documents at
    most, chosen by a hash of doc_id and text: sample is the bound on what training reads. Abuse has labellers, posteriors and
    a regression of its own over the insults and the vocabulary words found in most documents of the same sample.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tx.binary(batch, "text")
            yield pa.RecordBatch.from_arrays([pa.array([votes(t) for t in texts], pa.string()), pa.array([_votes(abuse(spoken(t)), ABUSE) for t in texts], pa.string())], names=["votes", "abuse"])

    voted = tx.only(docs, "text").mapInArrow(vote, "votes string, abuse string").groupBy("votes", "abuse").agg(F.count(F.lit(1)).alias("many"))
    patterns, abusive = Counter(), Counter()
    for r in voted.collect():
        patterns[r.votes] += r.many
        abusive[r.abuse] += r.many
    posteriors, rates, share = estimate(patterns)
    clean = estimate(abusive)[0]
    total = sum(patterns.values())
    if not total:
        return Model(np.zeros(size), posteriors, rates, share)

    limit = min(1.0, sample / total)
    chosen = sampled(docs, sample, total)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(w for t in tx.binary(batch, "text") for w in spoken(t))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "many"])

    often = chosen.select("text").mapInArrow(words, "word binary, many long").groupBy("word").agg(F.sum("many").alias("many")).where(F.col("many") >= max(3.0, 0.005 * limit * total))
    common = [bytes(r.word) for r in often.orderBy(F.desc("many"), "word").limit(vocabulary).collect()]
    place = {w: i for i, w in enumerate(sorted(NAMES | EPITHETS | set(common)))}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(size)
        for batch in batches:
            texts = tx.binary(batch, "text")
            got, said = [hashing(t) for t in texts], [spoken(t) for t in texts]
            known = [sorted((place[w], _presence(k, sum(c.values()))) for w, k in c.items() if w in place) for c in said]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([i for i, _ in got], pa.list_(pa.int32())),
                    pa.array([v for _, v in got], pa.list_(pa.float64())),
                    pa.array([posteriors[votes(t)] for t in texts], pa.float64()),
                    pa.array([[i for i, _ in k] for k in known], pa.list_(pa.int32())),
                    pa.array([[v for _, v in k] for k in known], pa.list_(pa.float64())),
                    pa.array([clean[_votes(abuse(c), ABUSE)] for c in said], pa.float64()),
                ],
                names=["doc_id", "index", "value", "good", "word", "presence", "clean"],
            )

    kinds = "doc_id long, index array<int>, value array<double>, good double, word array<int>, presence array<double>, clean double"
    rows = sorted(chosen.mapInArrow(features, kinds).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.good))
    x = np.zeros((len(rows), size), np.float32)
    for i, r in enumerate(rows):
        x[i, r["index"]] += r["value"]
    w = train(x, np.array([r.good for r in rows], np.float32), rounds)
    x = np.zeros((len(rows), len(place) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r.word] = r.presence
    said = train(x, np.array([r.clean for r in rows], np.float32), rounds).tolist()
    return Model(w, posteriors, rates, share, dict(zip(place, said)), said[-1], clean)


def probability(model: Model, index: np.ndarray, value: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(model.weights[index] @ value, -30, 30))))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, posterior, toxicity, good, toxic, kept): the scorer's probability of good, the labellers' one, that of
    abuse, and the decisions: good by the score, toxic by the toxicity, kept if good and not toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(len(model.weights))
        for batch in batches:
            texts = tx.binary(batch, "text")
            posterior = [model.posteriors.get(votes(t), model.share) for t in texts]
            p = np.array([q if foreign(t) else probability(model, *hashing(t)) for t, q in zip(texts, posterior)], float)
            abusive = [model.toxicity(t) for t in texts]
            good, toxic = [bool(a >= threshold and t.strip()) for a, t in zip(p, texts)], [b >= 0.5 for b in abusive]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array(posterior, pa.float64()), pa.array(abusive, pa.float64()), *[pa.array(x, pa.bool_()) for x in (good, toxic, [a and not b for a, b in zip(good, toxic)])]],
                names=["doc_id", "score", "posterior", "toxicity", "good", "toxic", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, posterior double, toxicity double, good boolean, toxic boolean, kept boolean")


def keep_good(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = 8_000, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that classify keeps, with all their columns; a map without a shuffle once the scorer is fitted. A row
    with a null text goes, one with a null doc_id is judged by its text."""
    model = fit(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(len(model.weights))
        for batch in batches:
            texts = tx.binary(batch, text)
            said = [model.posteriors.get(votes(t), model.share) if foreign(t) else probability(model, *hashing(t)) for t in texts]
            good = [bool(t.strip()) and p >= threshold and model.toxicity(t) < 0.5 for t, p in zip(texts, said)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 8_000, threshold: float = 0.5) -> DataFrame:
    """Each row's score, posterior and toxicity, whether it is good, whether it is toxic, and whether it is kept: good and not
    toxic. Quality and abuse are judged apart: a well written insult is good and toxic.

    A null, empty or blank text is not good. A row is judged by its text alone, so repeated rows and ties get equal
    verdicts; a null doc_id is passed on; an empty table gives an empty result. Other columns play no part. A very long
    text is read whole, in one task. A text in another script than the Latin one, of which the scorer has seen nothing,
    is scored by the posterior of its votes, in which labellers that know Latin texts alone abstain.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return score(docs, fit(docs, sample), threshold)
