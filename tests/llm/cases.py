"""Small documents with what operators must not stumble over, and an empty table of the same kind."""

import random

#: Columns that clash with names operators use within.
CLASH = ["w", "h", "key", "n", "k1", "line", "pos", "score", "row", "fp", "root", "node", "rank", "slot", "_kept", "_r0", "n_lines"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, lexicon: int = 400) -> str:
    rng = random.Random(seed)
    parts = ["ka", "lo", "mi", "ter", "un", "ves", "ñor", "éta", "sh", "Ing"]
    word = lambda i: "".join(random.Random(i * 7919 + j).choice(parts) for j in range(1 + i % 4))
    words = [word(rng.randrange(lexicon)) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


def texts():
    long = prose(99, 9000)
    out = [None, "", " ", "\n\n", "one", "One two", "tie tie tie", prose(1, 60), prose(1, 60), prose(2, 300), prose(3, 40).upper(), long, long + " end", "x" * 30000, "İSTANBUL ſtraße K", "a b　c \x00 d\x7fe"]
    return out + [prose(i, 30 + i) for i in range(10, 30)]


def rows():
    out = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts())]
    out += [(None, prose(1, 60), None, None, None), (None, None, None, None, None), out[7], out[7], (out[9][0], "another text of the same id", "en", "s", 5)]
    return out


def frame(spark, data=None, clash=True, schema=SCHEMA):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, schema).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def empty(spark, schema=SCHEMA):
    return frame(spark, [], schema=schema)
