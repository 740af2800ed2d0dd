"""Language-model scoring: a causal self-attention model over subword ids, trained and run in numpy.

Texts are A-Z lower-cased words and an end; the model sees the subword ids of each word. Its vocabulary is the most
frequent VOCABULARY - 2 ids of all training documents, the end, and one id for all others, which share its
probability by their counts. It has one head of attention over a window of BEFORE + STRIDE positions, a residual, and
a softmax in two levels (class of the token, then token), so a text's score is a sum of log-probabilities that add up to
one over all texts. Windows overlap: each scores its last STRIDE tokens, with at least BEFORE tokens of context where
the text has them, so each token is scored once. A batch of windows is one masked product, and as positions
are added to embeddings, keys, values and queries of all ids are tables made once.

What is counted is counted over all training documents: words for the base score, subword ids for the vocabulary
and the shares of rare ids. Classes and weights are fitted on all of them too, whole texts of any length: partitions
train on their own texts and their weights are averaged.

Words with high counts (HEAD at most, so what is broadcast is bounded) are looked up where the text is read; all others
meet their counts in a join. Both together give every word its exact count.

Edge cases: a null text is empty (only the end is scored); a null doc_id is held out; repeated documents are scored
as often as they come, and counted so; with no training document every count is zero and the model is uniform; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.llm.common import cut, in_batches, table
from driftwake.llm.packing import encoder

BEFORE, STRIDE = 8, 16
WIDTH = BEFORE + STRIDE
DIMENSIONS = 16
CLASSES, SLOTS = 32, 64
VOCABULARY = CLASSES * SLOTS
END, RARE = 0, 1
IDS = 50_256
STEPS, EPOCHS, BATCH, RATE = 1800, 8, 256, 0.02  # as many epochs as make STEPS, EPOCHS at most
MANY = 4  # batches in one, once a partition has STEPS batches to go: fewer, larger products
HEAD = 500_000
CACHED = 400_000
WINDOWS = 16_384  # held, in a task, for training
PART_CHARS = 2 << 20  # of texts that are scored together
FLUSH = 400_000
END_WORD = (0, 0)  # the end's name among words' names


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def name(word: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(word)
    a, b = x >> 64, x & (1 << 64) - 1
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(True))


# ---- the model


@dataclass
class Model:
    """token_of: subword id -> vocabulary; rare: log10 share of each id within RARE; slot order is class by class."""

    token_of: np.ndarray
    rare: np.ndarray
    place: np.ndarray  # vocabulary -> class * SLOTS + slot
    weights: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        w = self.weights
        scale = np.float32(1 / math.sqrt(DIMENSIONS))
        self.tables = {c: w["e"] @ w[c] * (scale if c == "q" else 1) for c in "qkv"}
        self.places = {c: w["p"] @ w[c] * (scale if c == "q" else 1) for c in "qkv"}

    def hidden(self, seen: np.ndarray, first: bool) -> np.ndarray:
        """seen (windows, WIDTH) -> (windows, STRIDE, DIMENSIONS)."""
        q = self.tables["q"][seen[:, BEFORE:]] + self.places["q"][BEFORE:]
        k = self.tables["k"][seen] + self.places["k"]
        v = self.tables["v"][seen] + self.places["v"]
        a = q @ k.transpose(0, 2, 1)
        a += MASKS[int(first)]
        np.minimum(a, np.float32(30), out=a)
        np.exp(a, out=a)
        o = a @ v
        o /= a.sum(axis=2, keepdims=True)
        o += self.weights["e"][seen[:, BEFORE:]]
        o += self.weights["p"][BEFORE:]
        return o

    def log(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """ln of the probability of each target after h (n, DIMENSIONS)."""
        w, at = self.weights, self.place[target]
        cls = (at // SLOTS).astype(np.uint8)
        z = h @ w["c"]
        z += w["cb"]
        np.clip(z, -30, 30, out=z)
        out = z[np.arange(len(z)), cls]
        np.exp(z, out=z)
        out -= np.log(z.sum(axis=1))
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        hs, slot = h[order], (at % SLOTS)[order]
        inner = np.empty(len(h), h.dtype)
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                z = hs[a:b] @ w["u"][c]
                z += w["ub"][c]
                np.clip(z, -30, 30, out=z)
                inner[a:b] = z[np.arange(b - a), slot[a:b]]
                np.exp(z, out=z)
                inner[a:b] -= np.log(z.sum(axis=1))
        out[order] += inner
        return out

    def score(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text; tokens: all texts' one after another, ends included."""
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        seen = np.empty(len(tokens), tokens.dtype)
        seen[1:] = tokens[:-1]
        seen[starts] = END
        n = -(-sizes // STRIDE)
        doc = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin, stop = starts[doc] + nth * STRIDE, (starts + sizes)[doc]
        total = np.zeros(len(sizes))
        for first in (True, False):
            own = np.flatnonzero((nth == 0) == first)
            for a in range(0, len(own), 2048):
                i = own[a : a + 2048]
                at = begin[i, None] + np.arange(-BEFORE, STRIDE)
                h = self.hidden(seen[np.clip(at, 0, len(tokens) - 1)], first)
                at = at[:, BEFORE:]
                inside = at < stop[i, None]
                p = self.log(h[inside], tokens[at[inside]])
                total += np.bincount(np.broadcast_to(doc[i, None], at.shape)[inside], weights=p, minlength=len(sizes))
        return total / math.log(10)


def families(pairs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """pairs (token, next token) counted -> vocabulary -> class * SLOTS + slot: halved again and again along the
    strongest direction of what stands before and after each token, so that a class holds tokens of like use."""
    near = np.sqrt(np.concatenate((pairs.T, pairs), axis=1, dtype=np.float32))
    near /= np.linalg.norm(near, axis=1, keepdims=True) + 1e-6
    basis = near.T @ (near @ rng.standard_normal((2 * VOCABULARY, 32)).astype(np.float32))
    points = near @ np.linalg.qr(basis)[0]
    groups = [np.arange(VOCABULARY)]
    while len(groups) < CLASSES:
        halves = []
        for g in groups:
            x = points[g] - points[g].mean(axis=0)
            line = x @ np.linalg.svd(x, full_matrices=False)[2][0]
            order = g[np.argsort(line, kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    place = np.empty(VOCABULARY, np.int32)
    place[np.concatenate(groups)] = np.arange(VOCABULARY)
    return place


def untrained(counts: np.ndarray, rng: np.random.Generator) -> tuple[Model, np.ndarray]:
    """The model before any text is seen, and the prior of each token; counts: of each id over all training documents."""
    often = np.argsort(-counts, kind="stable")[: VOCABULARY - 2]
    often = often[counts[often] > 0]
    token_of = np.full(IDS + 1, RARE, np.uint16)
    token_of[often] = np.arange(2, 2 + len(often))
    token_of[IDS] = END
    rest = np.ones(IDS + 1, bool)
    rest[often] = rest[IDS] = False
    share = np.where(rest[:IDS], counts[:IDS] + 0.1, 0)
    rare = np.zeros(IDS + 1)
    rare[:IDS] = np.where(rest[:IDS], np.log10(np.maximum(share, 1e-300) / share.sum()), 0)
    d = DIMENSIONS
    f = lambda *s, by=0.1: (rng.standard_normal(s) * by).astype(np.float32)
    w = {"e": f(VOCABULARY, d, by=0.3), "p": f(WIDTH, d), "q": f(d, d, by=0.25), "k": f(d, d, by=0.25), "v": f(d, d, by=0.25), "c": f(d, CLASSES), "cb": np.zeros(CLASSES, np.float32), "u": f(CLASSES, d, SLOTS), "ub": np.zeros((CLASSES, SLOTS), np.float32)}
    prior = np.full(VOCABULARY, 0.5)
    prior[2 : 2 + len(often)] += counts[often]
    prior[END] += counts[IDS]
    prior[RARE] += counts[:IDS][rest[:IDS]].sum()
    return Model(token_of, rare, np.arange(VOCABULARY, dtype=np.int32), w), prior


def placed(model: Model, prior: np.ndarray, place: np.ndarray) -> Model:
    """The model with its classes; the prior of each token is where the output starts."""
    by_place = np.empty(VOCABULARY)
    by_place[place] = prior
    by_place = by_place.reshape(CLASSES, SLOTS)
    model.weights["cb"] = np.log(by_place.sum(axis=1) / by_place.sum()).astype(np.float32)
    model.weights["ub"] = np.log(by_place / by_place.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(model.token_of, model.rare, place, model.weights)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """seen, target, weight, first: windows as score() cuts them, those that end a text filled with its end and left
    out of the loss. texts: tokens, each text whole."""
    tokens, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = END
    n = -(-sizes // STRIDE)
    doc = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = (starts[doc] + nth * STRIDE)[:, None] + np.arange(-BEFORE, STRIDE)
    inside = (at >= starts[doc, None]) & (at < (starts + sizes)[doc, None])
    at = np.clip(at, 0, len(tokens) - 1)
    return np.where(inside, before[at], END), np.where(inside, tokens[at], END)[:, BEFORE:], inside[:, BEFORE:], nth == 0


@dataclass
class Fit:
    """Weights on their way: Adam's two moments beside them, and the steps so far of those planned."""

    w: dict[str, np.ndarray]
    place: np.ndarray
    steps: float
    m1: dict[str, np.ndarray] | None = None
    m2: dict[str, np.ndarray] | None = None
    step: float = 0

    def __post_init__(self) -> None:
        self.m1 = self.m1 or {k: np.zeros_like(x) for k, x in self.w.items()}
        self.m2 = self.m2 or {k: np.zeros_like(x) for k, x in self.w.items()}

    def learn(self, cut_: tuple[np.ndarray, ...], rng: np.random.Generator) -> None:
        """One pass over all of some windows."""
        order = rng.permutation(len(cut_[0]))
        w, m1, m2 = self.w, self.m1, self.m2
        batch = BATCH * (MANY if self.steps > STEPS else 1)
        for a in range(0, len(order), batch):
            i = order[a : a + batch]
            grads = gradients(w, self.place, *(x[i] for x in cut_))
            self.step += len(i) / BATCH if batch > BATCH else 1
            rate = RATE * max(0.01, 1 - self.step / (self.steps + 1)) * min(1, self.step / 50) * min(1, len(i) / batch * 2)
            for k, g in grads.items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                w[k] -= (rate / (1 - 0.9**self.step)) * m1[k] / (np.sqrt(m2[k] / (1 - 0.99**self.step)) + 1e-6)

    def flat(self) -> np.ndarray:
        return np.concatenate([x[k].ravel() for x in (self.w, self.m1, self.m2) for k in sorted(x)])

    def filled(self, flat: np.ndarray, step: float) -> Fit:
        """Another with these numbers."""
        out, at = [{}, {}, {}], 0
        for x in out:
            for k in sorted(self.w):
                x[k] = flat[at : at + self.w[k].size].reshape(self.w[k].shape).astype(np.float32)
                at += self.w[k].size
        return Fit(out[0], self.place, self.steps, out[1], out[2], step)


def epochs_of(n: int) -> int:
    """As many as make STEPS of n windows, EPOCHS at most."""
    return min(EPOCHS, -(-STEPS // -(-n // BATCH)))


def train(texts: list[np.ndarray], counts: np.ndarray, seed: int = 1) -> Model:
    """In memory what train_all does over partitions. texts: subword ids (IDS for the end) of each training text."""
    rng = np.random.default_rng(seed)
    model, prior = untrained(counts, rng)
    if not texts:
        model.weights["c"][:] = model.weights["u"][:] = 0
        return Model(model.token_of, model.rare, model.place, model.weights)
    texts = [model.token_of[t] for t in texts]
    model = placed(model, prior, families(followers(texts), rng))
    cut_ = windows(texts)
    epochs = epochs_of(len(cut_[0]))
    fit = Fit(model.weights, model.place, epochs * -(-len(cut_[0]) // BATCH))
    for _ in range(epochs):
        fit.learn(cut_, rng)
    return Model(model.token_of, model.rare, model.place, fit.w)


def followers(texts: list[np.ndarray]) -> np.ndarray:
    """(token, next token) -> how often; an end stands before each text."""
    tokens = np.concatenate([np.zeros(1, np.uint16), *texts]).astype(np.int64)
    return np.bincount(tokens[:-1] * VOCABULARY + tokens[1:], minlength=VOCABULARY**2).reshape(VOCABULARY, VOCABULARY)


def encoded(batches: Iterator[pa.RecordBatch], token_of: np.ndarray, path: str) -> Iterator[list[np.ndarray]]:
    """Tokens of all texts (first column), whole, a list at a time; a list has WINDOWS windows or one text more. Words are
    numbered as they come; a list's texts are laid out from the words' tokens at once."""
    encode = encoder(path).encode_ordinary
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__  # a new word gets the next number
    flat, where = np.empty(0, np.uint16), np.empty((0, 2), np.int64)
    held: list[list[int]] = []
    n = 0

    def laid() -> list[np.ndarray]:
        nonlocal flat, where
        if len(known) > len(where):
            parts = [subwords(encode, w) for w in islice(known, len(where), None)]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum()))
            where = np.concatenate((where, np.stack([np.cumsum(sizes) - sizes + len(flat), sizes], axis=1)))
            flat = np.concatenate((flat, token_of[ids].astype(np.uint16)))
        counts = np.array([len(x) for x in held], np.int64)
        code = np.fromiter(chain.from_iterable(held), np.int64, int(counts.sum()))
        tokens, ends = tokens_of(code, counts, flat, where)
        return np.split(tokens, np.cumsum(ends)[:-1])

    for b in batches:
        for text in b.column(0):
            w = words(text.as_py())
            held.append(list(map(known.__getitem__, w)))
            n += 1 + len(w) * 2 // STRIDE  # about
            if n >= WINDOWS:
                yield laid()
                held, n = [], 0
                if len(known) > CACHED:
                    known.clear()
                    flat, where = np.empty(0, np.uint16), np.empty((0, 2), np.int64)
    if held:
        yield laid()


def tokens_of(code: np.ndarray, counts: np.ndarray, flat: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts of words by number (counts words each), an end after each text; and how many each has."""
    doc = np.repeat(np.arange(len(counts)), counts)
    begins, length = where[code].T if len(code) else np.empty((2, 0), np.int64)
    ends = np.bincount(doc, weights=length, minlength=len(counts)).astype(np.int64) + 1
    tokens = np.full(int(ends.sum()), END, np.uint16)
    target = np.cumsum(length) - length + doc  # each text before has left room for its end
    put = np.arange(int(length.sum())) + np.repeat(doc, length)
    tokens[put] = flat[put + np.repeat(begins - target, length)]
    return tokens, ends


def train_all(learnt: DataFrame, counts: np.ndarray, path: str, seed: int = 1) -> Model:
    """learnt(doc_id, text): every text, whole, is trained on. Each partition takes its own texts from common weights, and
    the weights (with their moments) are averaged by windows. The first epoch does so after 1, 2, 4 ... of 64 parts
    of the texts, so that partitions don't part early."""
    rng = np.random.default_rng(seed)
    model, prior = untrained(counts, rng)
    if not counts[IDS]:
        return train([], counts, seed)
    spark, token_of = learnt.sparkSession, model.token_of

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((VOCABULARY, VOCABULARY), np.int64)
        for texts in encoded(batches, token_of, path):
            total += followers(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    found = learnt.select("text").mapInArrow(follow, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(VOCABULARY**2)
    pairs[found.column("at").to_numpy()] = found.column("n").to_numpy()  # VOCABULARY**2 rows at most
    model = placed(model, prior, families(pairs.reshape(VOCABULARY, VOCABULARY), rng))
    n = -(-int(counts.sum()) // STRIDE)  # windows, nearly
    epochs, parts = epochs_of(n), max(1, learnt.rdd.getNumPartitions())
    fit = Fit(model.weights, model.place, max(1, epochs * n / BATCH / parts))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(64))
    turns = [(0, 1), *((1 << i, 2 << i) for i in range(6)), *[(0, 64)] * (epochs - 1)]
    for turn, (a, b) in enumerate(turns):
        shared = spark.sparkContext.broadcast(fit)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            now, seen = shared.value.filled(shared.value.flat(), shared.value.step), 0
            order = np.random.default_rng((seed, turn, TaskContext.get().partitionId()))
            for texts in encoded(batches, token_of, path):
                cut_ = windows(texts)
                now.learn(cut_, order)
                seen += len(cut_[0])
            if seen:
                yield averaged([(seen, now.step, now.flat().tobytes())])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    sums = row if sums is None else mean(sums, row)
            if sums:
                yield averaged([sums])

        own = learnt.filter((part >= a) & (part < b)).select("text").mapInArrow(run, FITTED)
        if parts > 64:  # what comes to the driver doesn't grow with the partitions
            own = own.repartition(16).mapInArrow(merge, FITTED)
        sums = None
        for row in own.collect():
            sums = tuple(row) if sums is None else mean(sums, tuple(row))
        if sums:
            fit = fit.filled(np.frombuffer(sums[2], np.float32), sums[1])
        shared.unpersist()
    return Model(model.token_of, model.rare, model.place, fit.w)


FITTED = "n long, step double, flat binary"


def averaged(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.float64(), pa.binary()))], names=["n", "step", "flat"])


def mean(a: tuple, b: tuple) -> tuple:
    """Of two (windows, steps, numbers), by windows."""
    n = a[0] + b[0]
    x, y = (np.frombuffer(r[2], np.float32).astype(np.float64) * (r[0] / n) for r in (a, b))
    return n, (a[1] * a[0] + b[1] * b[0]) / n, (x + y).astype(np.float32).tobytes()


def gradients(w: dict, place: np.ndarray, seen: np.ndarray, target: np.ndarray, weight: np.ndarray, first: np.ndarray) -> dict:
    """Of the mean loss of a batch of windows."""
    masks, d = MASKS, DIMENSIONS
    scale = np.float32(1 / math.sqrt(d))
    size = len(seen)
    x = w["e"][seen] + w["p"]
    rows, xq = x.reshape(-1, d), np.ascontiguousarray(x[:, BEFORE:])
    rows_q = xq.reshape(-1, d)
    q, k, v = (rows_q @ w["q"] * scale).reshape(size, STRIDE, d), (rows @ w["k"]).reshape(size, WIDTH, d), (rows @ w["v"]).reshape(size, WIDTH, d)
    a = q @ k.transpose(0, 2, 1)
    a += masks[first.astype(np.int8)]
    np.exp(np.minimum(a, np.float32(30), out=a), out=a)
    a /= a.sum(axis=2, keepdims=True)
    h3 = xq + a @ v
    whole = bool(weight.all())
    h, n = (h3.reshape(-1, d) if whole else h3[weight]), np.float32(weight.sum())
    at = place[target.ravel() if whole else target[weight]]
    cls, slot = at // SLOTS, at % SLOTS
    g = {}
    z = softmax(h @ w["c"] + w["cb"])
    z[np.arange(len(z)), cls] -= 1
    z /= n
    g["c"], g["cb"] = h.T @ z, z.sum(axis=0)
    dh = z @ w["c"].T
    order = np.argsort(cls, kind="stable")
    edges = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    hs, slots, back = h[order], slot[order], np.empty_like(h)
    g["u"], g["ub"] = np.zeros_like(w["u"]), np.zeros_like(w["ub"])
    count = np.arange(max(1, max(b - a for a, b in zip(edges, edges[1:]))))
    for c in range(CLASSES):
        i, j = edges[c], edges[c + 1]
        if i < j:
            z = softmax(hs[i:j] @ w["u"][c] + w["ub"][c])
            z[count[: j - i], slots[i:j]] -= 1
            z /= n
            g["u"][c], g["ub"][c] = hs[i:j].T @ z, z.sum(axis=0)
            back[i:j] = z @ w["u"][c].T
    dh[order] += back
    if whole:
        do = dh.reshape(size, STRIDE, d)
    else:
        do = np.zeros_like(h3)
        do[weight] = dh
    dv = a.transpose(0, 2, 1) @ do
    ds = do @ v.transpose(0, 2, 1)
    ds -= (ds * a).sum(axis=2, keepdims=True)
    ds *= a
    dq, dk, dv = (ds @ k * scale).reshape(-1, d), (ds.transpose(0, 2, 1) @ q).reshape(-1, d), dv.reshape(-1, d)
    g["q"], g["k"], g["v"] = rows_q.T @ dq, rows.T @ dk, rows.T @ dv
    dx = (dk @ w["k"].T + dv @ w["v"].T).reshape(size, WIDTH, d)
    dx[:, BEFORE:] += do + (dq @ w["q"].T).reshape(size, STRIDE, d)
    g["p"] = dx.sum(axis=0)
    cells = (seen.ravel().astype(np.int64) * d)[:, None] + np.arange(d)
    g["e"] = np.bincount(cells.ravel(), weights=dx.ravel(), minlength=VOCABULARY * d).astype(np.float32).reshape(VOCABULARY, d)
    return g


def softmax(z: np.ndarray) -> np.ndarray:
    np.clip(z, -30, 30, out=z)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def attention_masks() -> np.ndarray:
    """What a window's positions may see: of a later window, and (1) of a text's first, which has nothing before it."""
    ahead = np.arange(WIDTH)[None, :] > np.arange(BEFORE, WIDTH)[:, None]
    later = np.where(ahead, np.float32(-1e4), np.float32(0))
    first = later.copy()
    first[:, :BEFORE] = -1e4
    return np.stack((later, first))


MASKS = attention_masks()


# ---- the corpus


def subwords(encode, word: bytes) -> list[int]:
    return encode(" " + word.decode())


COUNTS = "kind int, k1 long, k2 long, n long"


def counts(docs: DataFrame, path: str) -> DataFrame:
    """docs(text) -> kind (0 word, 1 subword id), k1, k2 (its name), n: over all of docs."""

    def rows(seen: Counter, ends: int, encode) -> pa.RecordBatch:
        digest = xxhash.xxh3_128_digest
        names = np.frombuffer(b"".join([digest(w) for w in seen]), ">i8").astype(np.int64).reshape(-1, 2)
        times = np.fromiter(seen.values(), np.int64, len(seen))
        parts = [encode(" " + w.decode()) for w in seen]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum()))
        ids = np.bincount(flat, weights=np.repeat(times, sizes), minlength=IDS + 1).astype(np.int64)
        ids[IDS] = ends
        used = np.flatnonzero(ids)
        kind = np.repeat(np.array([0, 1], np.int32), [len(names) + 1, len(used)])
        k1 = np.concatenate((names[:, 0], [END_WORD[0]], used))
        k2 = np.concatenate((names[:, 1], [END_WORD[1]], np.zeros(len(used), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, k1, k2, np.concatenate((times, [ends], ids[used])))], names=["kind", "k1", "k2", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, ends = encoder(path).encode_ordinary, Counter(), 0
        for b in batches:
            for text in b.column(0):
                seen.update(words(text.as_py()))
                ends += 1
                if len(seen) > FLUSH:  # a task's memory is bounded; sums meet in the aggregation
                    yield rows(seen, ends, encode)
                    seen, ends = Counter(), 0
        if ends:
            yield rows(seen, ends, encode)

    return docs.select("text").mapInArrow(run, COUNTS).groupBy("kind", "k1", "k2").agg(F.sum("n").alias("n"))


def head(told: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count of the head, and its names and counts in order: as many counts, from the top, as make
    at most HEAD words. Only a histogram over geometric classes of counts, and then the head, come to the driver."""
    size = F.floor(F.log2("n") * 8)
    left, least = HEAD, None
    for r in sorted(told.groupBy(size.alias("s")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect(), key=lambda r: -r["s"]):
        left -= r["words"]
        if left < 0:
            break
        least = r["n"]
    if least is None:
        none = np.empty(0, np.int64)
        return 1 << 62, none, none, none
    got = told.filter(F.col("n") >= least).select("k1", "k2", "n").toArrow()
    k1, k2, n = (got.column(c).to_numpy() for c in ("k1", "k2", "n"))
    order = np.lexsort((k2, k1))
    return least, k1[order], k2[order], n[order]


class Scorer:
    """Texts -> base score of head words, words not in the head, and the model's score."""

    def __init__(self, model: Model, path: str, top: tuple, total: int, distinct: int):
        self.model, self.encode = model, encoder(path).encode_ordinary
        _, self.k1, self.k2, self.n = top
        self.below = math.log10(total + 0.1 * (distinct + 1))
        self.cache: defaultdict = defaultdict()
        self.cache.default_factory = self.cache.__len__  # a new word gets the next number
        self.clear()

    def clear(self) -> None:
        """Known words, by number: their tokens laid end to end, where and how many, log10 within RARE, the base
        score and whether the head has it, name."""
        self.cache.clear()
        self.flat = np.empty(0, np.uint16)
        self.where = np.empty((0, 2), np.int64)
        self.facts = np.empty((0, 3))
        self.names = np.empty((0, 2), np.int64)

    def learn(self, new: list[bytes]) -> None:
        encode, digest = self.encode, xxhash.xxh3_128_digest
        names = np.frombuffer(b"".join([digest(w) for w in new]), ">i8").astype(np.int64).reshape(-1, 2)
        parts = [encode(" " + w.decode()) for w in new]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        count = np.zeros(len(new))
        if len(self.k1):
            at = np.searchsorted(self.k1, names[:, 0])  # equal first halves of 128-bit names are next to each other
            for _ in range(2):
                ok = at < len(self.k1)
                i = np.minimum(at, len(self.k1) - 1)
                hit = ok & (self.k1[i] == names[:, 0]) & (self.k2[i] == names[:, 1])
                count[hit] = self.n[i[hit]]
                at = at + 1
        rare = np.add.reduceat(self.model.rare[ids], starts)
        self.where = np.concatenate((self.where, np.stack([starts + len(self.flat), sizes], axis=1)))
        self.flat = np.concatenate((self.flat, self.model.token_of[ids]))
        self.facts = np.concatenate((self.facts, np.stack([rare, np.where(count > 0, np.log10(count + 0.1) - self.below, 0), count > 0], axis=1)))
        self.names = np.concatenate((self.names, names))

    def score(self, texts: list[str | None]) -> tuple:
        if len(self.cache) > CACHED:
            self.clear()
        cache, found, sizes = self.cache, [], []
        known = len(cache)
        for t in texts:
            w = words(t)
            found += map(cache.__getitem__, w)
            sizes.append(len(w))
        if len(cache) > known:
            self.learn(list(islice(cache, known, None)))
        code, sizes = np.array(found, np.int64), np.array(sizes, np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        facts, per = self.facts, lambda x: np.bincount(doc, weights=x, minlength=len(texts))
        inside = facts[code, 2] > 0
        base, known_n, rare = per(facts[code, 1]), per(inside), per(facts[code, 0])
        tokens, ends = tokens_of(code, sizes, self.flat, self.where)
        score = self.model.score(tokens, ends) + rare
        out = np.flatnonzero(~inside)
        key, times = np.unique(doc[out] * len(cache) + code[out], return_counts=True)
        at, word = np.divmod(key, max(1, len(cache)))
        return sizes + 1, known_n.astype(np.int64), base, score, at, self.names[word], times


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base long_, score double, tail array<struct<k1:long,k2:long,n:long>>".replace("long_", "double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    learnt = base.filter(~F.col("held_out"))
    told = cut(counts(learnt, path))
    of_words, of_ids = told.filter("kind = 0"), told.filter("kind = 1")
    total, distinct = (x or 0 for x in of_words.agg(F.sum("n"), F.count("*")).head())
    ids = np.zeros(IDS + 1, np.int64)
    for r in of_ids.collect():  # one row a subword id
        ids[r["k1"]] = r["n"]
    top = head(of_words)
    model = train_all(learnt, ids, path)
    ends = float(ids[IDS])  # the end's count is the training documents'
    below = math.log10(total + 0.1 * (distinct + 1))
    end_score, end_known = math.log10(ends + 0.1) - below, int(ends > 0)
    shared = spark.sparkContext.broadcast((model, top, total, distinct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value[0], path, *shared.value[1:])
        row = TaskContext.get().partitionId() << 36
        names = pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64())])
        for b in batches:
            sizes = np.cumsum(b.column(2).nbytes * np.ones(b.num_rows) / max(1, b.num_rows)) // PART_CHARS
            for part in np.unique(sizes):
                rows = np.flatnonzero(sizes == part)
                piece = b.slice(rows[0], len(rows))
                n, known, base, score, at, tail, times = scorer.score(piece.column(2).to_pylist())
                inner = pa.StructArray.from_arrays([pa.array(tail[:, 0]), pa.array(tail[:, 1]), pa.array(times.astype(np.int64))], fields=list(names))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(rows) + 1)).astype(np.int32)), inner)
                number = pa.array(np.arange(row, row + len(rows)))
                row += len(rows)
                yield pa.RecordBatch.from_arrays([number, piece.column(0), piece.column(1), pa.array(n), pa.array(known + end_known), pa.array(base + end_score), pa.array(score), lists], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"])

    scored = cut(base.mapInArrow(run, SCORED))  # rows are numbered once
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.k1", "t.k2", F.col("t.n").alias("times"))
    counted = tail.join(of_words.filter(F.col("n") < top[0]), ["k1", "k2"], "left").withColumn("c", F.coalesce("n", F.lit(0)))
    more = counted.groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.col("c") + 0.1) - below)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op6_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
