import numpy as np

from driftwake.llm import lm
from tests.llm import cases


def test_windows_take_every_token_once():
    texts = [np.arange(1, n + 1, dtype=np.uint16) for n in (1, 16, 17, 100)]
    seen, target, weight, first = lm.windows(texts)
    assert target[weight].tolist() == np.concatenate(texts).tolist() and first.sum() == 4
    assert seen[first, : lm.BEFORE + 1].max() == lm.END and seen[-1, 0] == texts[3][96 - lm.BEFORE - 1]


def test_weights_learn_from_every_text(spark, monkeypatch):
    """More than 3,000 documents, and one of more than 6 MB: all tokens reach the weights in each epoch."""
    long = "rare pair " * 640_000
    rows = [(i, "ab cd ef", "", "", 1) for i in range(4000)] + [(5000, long, "", "", 1)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    encode = lm.encoder(lm.vocabulary_path()).encode_ordinary
    counts = np.zeros(lm.IDS + 1, np.int64)
    for text, n in (("ab cd ef", 4000), (long[:10], 640_000)):
        for w in lm.words(text):
            for i in lm.subwords(encode, w):
                counts[i] += n
    counts[lm.IDS] = 4001
    pairs = []
    monkeypatch.setattr(lm, "families", lambda p, rng, f=lm.families: pairs.append(p.sum()) or f(p, rng))
    monkeypatch.setattr(lm, "STEPS", 1)  # one epoch
    model = lm.train_all(docs, counts, lm.vocabulary_path())
    assert pairs == [counts.sum()]
    said = lambda n: model.token_of[[i for w in lm.words("rare pair " * n) for i in lm.subwords(encode, w)]]
    one, four = (model.score(said(n), np.array([len(said(n))]))[0] for n in (1, 4))
    assert four - one > -0.5  # without the long text's order, six tokens of about a half each: -1.8
