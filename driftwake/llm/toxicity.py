"""Toxicity by weak supervision.

Many voters look at a document: lexicons of insults in four languages, patterns of abuse, and keyword lists mined from labelled
texts (words and beginnings of words that stand in toxic texts far more often than in others, dealt to LEARNT voters). A voter of words votes
0, 1 or 2: no word of the text is on its list, some are, or more than one and OFTEN of all; a pattern is found not at all, once, or again. A generative label model explains the votes of all documents by a hidden label: the label's
share, each voter's table of votes given the label, and correlations between voters, as a forest in which a voter also depends on one
other (the greatest conditional mutual information, edges over LEAST_SHARED nats). It is fitted by expectation maximisation over the
table of distinct vote patterns with their counts; known labels are one more voter, whose accuracy is estimated too. A linear
classifier over words and their beginnings then learns the posterior labels of a bounded sample (SAMPLE_ROWS documents each of label 1, of
label 0 and without label, SAMPLE_BYTES in all, in the order of a hash of the id; rows weigh what they stand for), and scores every document.

Labels are learnt only from rows that are not held out; patterns count votes of all documents, whose labels are not looked at.

Edge cases: null and empty texts get the score of no words; if the labels to learn from lack a class, every score is the share of
label 1 among them (0.0 where there are none); of several labels of one id the greatest counts; null ids or labels teach nothing;
repeated documents are scored as often as they come; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.llm.common import cut, in_batches, release, table
from driftwake.llm.quality import held_out

THRESHOLD = 0.3
SAMPLE_ROWS = 4000  # of each kind
SAMPLE_BYTES = 96 << 20
LEARNT = 16
KEYWORDS = 4000
FEATURES = 30_000
LEAST_SHARED = 0.002
EM_ROUNDS = 8
STEPS = 200
STEMS = (4, 5, 6, 7)
OFTEN = 0.015  # of a text's distinct words
CACHED = 200_000

#: General insults, by language; each list is a voter.
LEXICONS = {
    "en": "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin fool fools foolish loser losers scum scumbag trash garbage filth filthy vermin pathetic worthless useless disgusting disgrace clown clowns jerk jerks creep coward liar lunatic psycho freak bastard bastards asshole bitch crap shit bullshit fuck fucking damn suck sucks hate ugly pig pigs rat rats",
    "de": "idiot idioten idiotisch dumm dummkopf dumme blöd blödmann trottel depp vollidiot versager abschaum dreck drecksack müll wertlos nutzlos ekelhaft widerlich erbärmlich schwachkopf arschloch scheiße scheiss verdammt feigling lügner schwein schweine ratte hasse hässlich",
    "fr": "idiot idiote idiots imbécile imbéciles crétin crétins stupide débile con conne connard connards abruti abrutis minable pathétique dégoûtant répugnant ordure ordures déchet raclure vermine salaud salope merde putain nul nulle lâche menteur porc porcs rat haine moche",
    "es": "idiota idiotas imbécil imbéciles estúpido estúpida tonto tonta cretino inútil inútiles patético patética asqueroso asquerosa repugnante basura escoria perdedor perdedores payaso payasos cabrón gilipollas mierda maldito cobarde mentiroso cerdo cerdos rata odio feo",
}
PATTERNS = (
    r"\b[A-Z]{3,}(?:[ ,]+[A-Z]{2,}){2,}",  # shouting
    r"[!?]{3,}",
    r"\b(?:you|u|du|ihr|tu|vous|eres|sois)\s+(?:are |re |all |bist |seid |es |êtes |un |une |una |ein |eine |a |an |so |such )*(?:idiot|moron|stupid|loser|trash|scum|clown|dumm|con|imb[eé]cile|tonto|est[uú]pid|basura|payaso)",
    r"\b(?:shut up|get lost|go to hell|drop dead|kill yourself|halt (?:den mund|die klappe)|verpiss|ta gueule|ferme[- ]la|va te faire|c[aá]llate|vete al|v[eé]te a la)\b",
    r"\b[a-z]{1,3}[*@#$]{2,}[a-z]{0,3}\b",  # masked words
)
VOTERS = len(LEXICONS) + len(PATTERNS) + LEARNT + 1  # the last: all lists together
assert 2 * VOTERS < 63
WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    """The word, and its beginnings, marked."""
    return [word, *(f"^{word[:n]}" for n in STEMS if len(word) > n)]


def g_test(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """How surely a feature, in pos of n_pos and neg of n_neg documents, tells the two apart; negative if it speaks for neg."""
    seen, total = pos + neg, n_pos + n_neg
    out = np.zeros(len(pos))
    for have, of in ((pos, n_pos), (neg, n_neg)):
        for x, e in ((have, seen * of / total), (of - have, (total - seen) * of / total)):
            out += np.where(x > 0, 2 * x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0)
    return np.where(pos * n_neg >= neg * n_pos, out, -out)


class Bags:
    """Texts as sets of numbered features; how many words of a text have each."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[str, int] = {}
        of: dict[str, np.ndarray] = {}
        number = self.number
        ids, counts, rows = [], [], []
        for i, t in enumerate(texts):
            own = [of[w] if w in of else of.setdefault(w, np.array([number.setdefault(f, len(number)) for f in features(w)], np.int32)) for w in words(t)]
            if own:
                f, n = np.unique(np.concatenate(own), return_counts=True)
                ids.append(f)
                counts.append(n)
                rows.append(np.full(len(f), i))
        some = bool(ids)
        self.ids, self.counts, self.rows = (np.concatenate(x) if some else np.empty(0, np.int64) for x in (ids, counts, rows))

    def frequency(self, weights: np.ndarray) -> np.ndarray:
        """Of each feature the weight of texts that hold it."""
        return np.bincount(self.ids, weights[self.rows], len(self.number))


class Voters:
    def __init__(self, keywords: list[str]):
        self.of: dict[str, int] = {}  # word or ^beginning -> voters, as bits
        for i, text in enumerate(LEXICONS.values()):
            for w in text.split():
                self.of[w] = self.of.get(w, 0) | 1 << i
        first = len(LEXICONS) + len(PATTERNS)
        for f in keywords:  # what begins alike goes to one voter
            self.of[f] = self.of.get(f, 0) | 1 << (first + zlib.crc32(f.removeprefix("^")[: STEMS[0]].encode()) % LEARNT)
        self.begins = {f[1:]: v for f, v in self.of.items() if f[0] == "^"}
        self.patterns = [re.compile(p) for p in PATTERNS]
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def bits(self, word: str) -> int:
        out, begins = self.of.get(word, 0), self.begins.get
        for n in STEMS:
            if len(word) <= n:
                break
            out |= begins(word[:n], 0)
        if len(self.known) > CACHED:
            self.known.clear()
        self.known[word] = out
        return out

    def votes(self, text: str | None) -> np.ndarray:
        out, known, own = np.zeros(VOTERS, np.int64), self.known, words(text)
        for w in own:
            b = known.get(w)
            if b is None:
                b = self.bits(w)
            while b:
                low = b & -b
                out[low.bit_length() - 1] += 1
                out[-1] += 1
                b ^= low
        often = (out > 1) & (out >= OFTEN * len(own))
        out = (out > 0) + often.astype(np.int64)
        for i, p in enumerate(self.patterns, len(LEXICONS)):
            found = p.search(text) if text else None
            if found:
                out[i] = 2 if p.search(text, found.end()) else 1
        return out


SHIFT = 2 * np.arange(VOTERS, dtype=np.int64)


def one_hot(packed: np.ndarray) -> np.ndarray:
    votes = (packed[:, None] >> SHIFT) & 3
    return (votes[:, :, None] == np.arange(3)).reshape(len(votes), -1).astype(np.float64)


@dataclass
class LabelModel:
    share: float  # of label 1
    gold: float  # accuracy of known labels
    parent: list[int]  # of each voter, -1 at a root
    tables: np.ndarray  # log P(vote | label, parent's vote): [voter, label, parent's vote, vote]

    def posterior(self, packed: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """Of label 1; gold: -1 where no label is known."""
        votes = (packed[:, None] >> SHIFT) & 3
        odds = np.full(len(votes), np.log(self.share / (1 - self.share)))
        for j, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            odds += self.tables[j, 1, given, votes[:, j]] - self.tables[j, 0, given, votes[:, j]]
        said = np.log(self.gold / (1 - self.gold))
        odds += np.where(gold == 1, said, np.where(gold == 0, -said, 0.0))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def from_sums(sums: np.ndarray, parent: list[int], gold: float) -> LabelModel:
    """sums[label]: how often two votes come together, one-hot by one-hot."""
    tables = np.zeros((VOTERS, 2, 3, 3))
    mass = sums[:, :3, :3].sum((1, 2))
    for j, p in enumerate(parent):
        for y in (0, 1):
            t = sums[y, 3 * p : 3 * p + 3, 3 * j : 3 * j + 3] if p >= 0 else np.tile(np.diag(sums[y, 3 * j : 3 * j + 3, 3 * j : 3 * j + 3]), (3, 1))
            alone = np.diag(sums[y, 3 * j : 3 * j + 3, 3 * j : 3 * j + 3]) + 0.5
            t = t + 2 * alone / alone.sum()  # rare votes of the parent lean on the voter's own rates
            tables[j, y] = np.log(t / t.sum(1, keepdims=True))
    share = float(np.clip(mass[1] / max(mass.sum(), 1e-9), 1e-4, 1 - 1e-4))
    return LabelModel(share, float(np.clip(gold, 0.8, 0.995)), parent, tables)


def forest(sums: np.ndarray) -> list[int]:
    """The greatest spanning forest of voters by mutual information given the label."""
    n = sums[:, :3, :3].sum()
    info = np.zeros((VOTERS, VOTERS))
    for y in (0, 1):
        mass = max(sums[y, :3, :3].sum(), 1e-9)
        alone = np.diag(sums[y]) / mass
        both = sums[y] / mass
        part = np.where(both > 0, both * np.log(np.maximum(both, 1e-300) / np.maximum(np.outer(alone, alone), 1e-300)), 0)
        info += part.reshape(VOTERS, 3, VOTERS, 3).sum((1, 3)) * mass / max(n, 1e-9)
    np.fill_diagonal(info, 0)
    parent, left = [-1] * VOTERS, set(range(VOTERS))
    while left:
        root = min(left)
        inside = {root}
        left.discard(root)
        while left:
            v, u, w = max(((info[u, w], u, w) for u in inside for w in left), key=lambda x: (x[0], -x[1], -x[2]))
            if v <= max(LEAST_SHARED, 8 / max(n, 1)):  # chance gives some 2 / n
                break
            parent[w] = u
            inside.add(w)
            left.discard(w)
    return parent


def expected(patterns: DataFrame, model: LabelModel | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the table of patterns: votes together, for each label, and right and all known labels. Without a
    model known labels are taken as they are, and other rows wait."""
    shared = patterns.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, said, m = np.zeros((2, 3 * VOTERS, 3 * VOTERS)), np.zeros(2), shared.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                packed, gold, n = (b.column(i).slice(at, 4096).to_numpy() for i in range(3))
                q = m.posterior(packed, gold) if m else np.maximum(gold, 0).astype(float)
                w = n * (1.0 if m else gold >= 0)
                x = one_hot(packed)
                sums[1] += (x * (w * q)[:, None]).T @ x
                sums[0] += (x * (w * (1 - q))[:, None]).T @ x
                said += ((n * np.where(gold == 1, q, np.where(gold == 0, 1 - q, 0))).sum(), (n * (gold >= 0)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([said.tobytes()], pa.binary())], names=["sums", "said"])

    sums, said = np.zeros((2, 3 * VOTERS, 3 * VOTERS)), np.zeros(2)
    for r in patterns.coalesce(max(8, patterns.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "sums binary, said binary").collect():
        sums += np.frombuffer(r["sums"]).reshape(sums.shape)
        said += np.frombuffer(r["said"])
    return sums, said


def label_model(patterns: DataFrame) -> LabelModel:
    """patterns: votes (packed), gold (-1, 0, 1), n."""
    sums, _ = expected(patterns, None)
    accuracy = 0.95
    for _ in range(2):  # correlations as known labels show them, then as all rows do
        parent = forest(sums)
        model = from_sums(sums, parent, accuracy)
        for _ in range(EM_ROUNDS):
            sums, said = expected(patterns, model)
            accuracy = said[0] / max(said[1], 1)
            model = from_sums(sums, parent, accuracy)
    return model


@dataclass
class Linear:
    weights: dict[str, float] | None
    bias: float

    def scorer(self):
        if self.weights is None:
            return lambda text: self.bias
        known: dict[str, float] = {}
        weights, bias = self.weights, self.bias
        begins = {f[1:]: v for f, v in weights.items() if f[0] == "^"}

        def score(text: str | None) -> float:
            x = bias
            for w in words(text):
                g = known.get(w)
                if g is None:
                    if len(known) > CACHED:
                        known.clear()
                    g = known[w] = weights.get(w, 0.0) + sum(begins.get(w[:n], 0.0) for n in STEMS if n < len(w))
                x += g
            return 1 / (1 + float(np.exp(-max(-60.0, min(60.0, x)))))

        return score


def mine(rows: list[tuple]) -> list[str]:
    """Keywords of label 1, from (text, label) with labels 0 and 1."""
    bags = Bags([t for t, _ in rows])
    y = np.array([label for _, label in rows], float)
    pos, neg = bags.frequency(y), bags.frequency(1 - y)
    g = g_test(pos, neg, y.sum(), (1 - y).sum())
    rate = pos / max(y.sum(), 1) > 4 * neg / max((1 - y).sum(), 1)
    names = list(bags.number)
    good = [i for i in np.argsort(-g, kind="stable")[:KEYWORDS].tolist() if g[i] > 20 and rate[i] and pos[i] >= 3]
    return [names[i] for i in good]


def learn(texts: list[str | None], q: np.ndarray, weight: np.ndarray) -> Linear:
    """Logistic regression on soft labels q, by accelerated proximal gradient with absolute penalty."""
    bags = Bags(texts)
    if not len(bags.ids):
        return Linear(None, float((q * weight).sum() / weight.sum()))
    # certain features: weights of rows only scale, so that the test stays one of documents
    w = weight * len(weight) / weight.sum()
    pos, neg = bags.frequency(q), bags.frequency(1 - q)
    g = np.abs(g_test(pos, neg, q.sum(), (1 - q).sum()))
    chosen = np.argsort(-g, kind="stable")[:FEATURES]
    chosen = chosen[g[chosen] > 8]
    place = np.full(len(bags.number), -1)
    place[chosen] = np.arange(len(chosen))
    own = place[bags.ids] >= 0
    col, row, val = place[bags.ids[own]], bags.rows[own], np.minimum(bags.counts[own], 3).astype(float)
    n, d = len(q), len(chosen)
    # steps by the curvature of each coordinate, held down by how many features a row has
    size = np.bincount(row, val, n)
    rate = 4 * w.sum() / np.maximum(np.bincount(col, w[row] * val * size[row], d), 1e-9)
    b = float(np.log(np.clip((q * w).sum(), 1e-6, None) / np.clip(((1 - q) * w).sum(), 1e-6, None)))
    x, ahead, t = np.zeros(d), np.zeros(d), 1.0
    for _ in range(STEPS):
        z = np.bincount(row, ahead[col] * val, n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        wrong = w * (p - q) / w.sum()
        b -= 2.0 * float(wrong.sum())
        step = ahead - rate * np.bincount(col, wrong[row] * val, d)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * 2e-5, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + (before - 1) / t * (new - x)
        x = new
    names = list(bags.number)
    return Linear({names[i]: float(v) for i, v in zip(chosen.tolist(), x.tolist()) if v}, b)


def sampled(docs: DataFrame, gold: DataFrame) -> tuple[DataFrame | None, dict[int, float]]:
    """id, text and kind (label 0 or 1, -1 without one) of the sample, in one partition; how many rows one of a kind stands for."""
    spark = docs.sparkSession
    kinds = {r["y"]: r["n"] for r in gold.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (kinds.get(0) and kinds.get(1)):
        return None, kinds
    order = (F.xxhash64("id"), "id")
    open_ = docs.filter(~held_out(F.col("id")) & F.col("id").isNotNull()).select("id").join(gold.select("id"), "id", "left_anti")
    picked = [gold.filter(F.col("y") == y).orderBy(*order).limit(SAMPLE_ROWS).select("id", "y") for y in (0, 1)]
    picked.append(open_.orderBy(*order).limit(SAMPLE_ROWS).select("id", F.lit(-1).alias("y")))
    ids = cut(picked[0].unionByName(picked[1]).unionByName(picked[2]).distinct())
    sizes = docs.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.xxhash64("id").alias("h"))
    chosen, room, taken = [], SAMPLE_BYTES, Counter()
    for r in sorted(sizes.collect(), key=lambda r: (r["h"], r["id"])):  # at most 3 * SAMPLE_ROWS
        if r["n"] <= room:
            chosen.append((r["id"], r["y"]))
            room -= r["n"]
            taken[r["y"]] += 1
    kinds[-1] = docs.count() - sum(kinds.values())
    release(ids)
    if not (taken[0] and taken[1]):
        return None, kinds
    few = F.broadcast(spark.createDataFrame(chosen, "id long, y int"))
    return cut(docs.join(few, "id").select("id", "text", "y").repartition(1).sortWithinPartitions("id", "text")), {y: max(1.0, kinds[y] / n) for y, n in taken.items()}


def in_one_task(sample: DataFrame, work) -> bytes:
    """work on the sample's rows, whose size is bounded, in a task; what it makes, pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(rows))], pa.binary())], names=["out"])

    return in_batches(sample).mapInArrow(run, "out binary").head()["out"]


@dataclass
class Fitted:
    voters: Voters | None
    labels: LabelModel | None
    linear: Linear


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label) != 0).cast("int")).alias("y"))
    gold = cut(known.join(docs.select("id").distinct(), "id", "left_semi"))
    sample, kinds = sampled(docs, gold)
    if sample is None:
        release(gold)
        total = sum(kinds.get(y, 0) for y in (0, 1))
        return Fitted(None, None, Linear(None, kinds.get(1, 0) / total if total else 0.0))
    voters = Voters(pickle.loads(in_one_task(sample, lambda rows: mine([r for r in rows if r[1] >= 0]))))
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            packed = np.array([v.votes(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, VOTERS) << SHIFT
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed.sum(1), pa.int64())], names=["id", "votes"])

    told = in_batches(docs).mapInArrow(vote, "id long, votes long")
    patterns = cut(told.join(gold, "id", "left").groupBy("votes", F.coalesce("y", F.lit(-1)).cast("long").alias("gold")).agg(F.count("*").alias("n")))
    model = label_model(patterns)

    def train(rows: list[tuple]) -> Linear:
        v, y = shared.value, np.array([y for _, y in rows], np.int64)
        packed = (np.array([v.votes(t) for t, _ in rows], np.int64) << SHIFT).sum(1)
        return learn([t for t, _ in rows], model.posterior(packed, y), np.array([kinds[int(i)] for i in y]))

    linear = pickle.loads(in_one_task(sample, train))
    release(gold, sample, patterns)
    return Fitted(voters, model, linear)


def score(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in b.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    rows = in_batches(docs.select(id_col, text_col))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, score double")


def op12_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model.linear).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
