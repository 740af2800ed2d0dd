"""Line dedup: of lines that are equal or one word apart, the earliest stays.

Lines stand in the order of (doc_id, hash of the text, line number). A line goes if an earlier one is equal, or, with
at least MIN_WORDS words (one edit in five leaves a similarity of 0.8), within an edit distance of one word: one word put
in, left out or changed. Near lines are found by a deletion-neighbourhood join: a line's variants are it and it without
each one word; equal variants, as hashed keys, bring lines together, and the edit distance is verified.

Emitting all variants of all lines would be many times the input. Two lines one edit apart agree in all words before
or after the edit, so each line first leaves hashes of its halves (three, as lengths may differ by one), and only lines
that share a half with another emit variants, of the side that isn't shared. That loses no pair. No pairs of a
group are formed: lines with one variant at one place are all near each other, so a group needs its earliest line alone, which
each member is verified against.

Edge cases: lines of white space alone stay; a null text stays null; null doc_ids come first; repeated rows (equal id and
text) are one document and come back as often as they came; a text that loses every line is empty; an empty table
gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.llm.common import cut, in_batches, joined_to_one, release, table, written

MIN_WORDS = 5
BLANK = " \t\r\x0b\x0c"
#: Lines that may have near ones are told from others at the scan by a bitmap of fixed size.
BUCKETS = 1 << 20


def long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def name(line: bytes) -> tuple[int, int]:
    import xxhash

    x = xxhash.xxh3_128_intdigest(line)
    return long(x >> 64), long(x & (1 << 64) - 1)


LINES = "doc_id long, h long, no int, k1 long, k2 long, front long, back long, other long, other_front boolean"
LINE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def line_table(docs: DataFrame) -> DataFrame:
    """docs(doc_id, h, text) -> a row a line that isn't blank: its place, its name (128 bits) and hashes of its halves.

    front: the first n//2 of n words. back: the rest. other: for lines one word shorter, the back without its first
    word (n odd) or the front without its last (n even)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            out: list[list] = [[] for _ in LINE_TYPES]
            add = [c.append for c in out]
            for doc_id, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for no, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    if not line.strip():
                        continue
                    front = back = other = other_front = None
                    w = line.split(b" ")
                    n = len(w)
                    if n >= MIN_WORDS - 1:
                        m = n // 2
                        front, back, other_front = long(digest(b" ".join(w[:m]), 1)), long(digest(b" ".join(w[m:]), 2)), n % 2 == 0
                        other = long(digest(b" ".join(w[: m - 1]), 1) if other_front else digest(b" ".join(w[m + 1 :]), 2))
                    for put, x in zip(add, (doc_id, h, no, *name(line), front, back, other, other_front)):
                        put(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, LINE_TYPES)], names=[c.split()[0] for c in LINES.split(", ")])

    return in_batches(docs).mapInArrow(run, LINES)


def firsts(lines: DataFrame) -> DataFrame:
    """k1, k2, pos: where each distinct line stands first."""
    return lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h", "no")).alias("pos"))


def marked(numbers: DataFrame, of: str) -> np.ndarray:
    """A bitmap of the buckets of a column: BUCKETS bits, whatever the table."""
    bits = np.zeros(BUCKETS, bool)
    bits[[r[0] for r in numbers.select(F.pmod(F.col(of), F.lit(BUCKETS))).distinct().collect()]] = True
    return bits


def candidates(lines: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """k1, k2, front, back: distinct lines that share a half with another, and which.

    Shared halves are found first, on two numbers a row. Rows go to the join with them only if their bucket is
    marked: at most BUCKETS numbers are broadcast, and where all are marked, all rows go."""
    halves = lines.filter("front IS NOT NULL").select("k1", "k2", F.explode(F.array(
        F.struct(F.col("front").alias("half"), F.lit(True).alias("front")),
        F.struct(F.col("back").alias("half"), F.lit(False).alias("front")),
        F.struct(F.col("other").alias("half"), F.col("other_front").alias("front")),
    )).alias("x")).select("k1", "k2", "x.half", "x.front")
    shared = cut(halves.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a <> b").select("half"))
    spent.append(shared)
    buckets = F.broadcast(shared.select(F.pmod("half", F.lit(BUCKETS)).alias("bucket")).distinct())  # BUCKETS rows at most
    perhaps = halves.withColumn("bucket", F.pmod("half", F.lit(BUCKETS))).join(buckets, "bucket", "left_semi").drop("bucket")
    return perhaps.join(shared, "half", "left_semi").groupBy("k1", "k2").agg(F.max("front").alias("front"), F.max(~F.col("front")).alias("back"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (k1, k2, ...) with pos and line: where each stands first, and its text, from a second scan. Lines are
    taken to the join if their bucket is wanted, as above."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marked(wanted, "k1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).tolist()
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for no, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    if line.strip():
                        k1, k2 = name(line)
                        if bits[k1 % BUCKETS]:
                            for c, x in zip(out, (doc_id, h, no, k1, k2, line)):
                                c.append(x)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "h", "no", "k1", "k2", "line"])

    found = docs.mapInArrow(run, "doc_id long, h long, no int, k1 long, k2 long, line binary")
    named = found.select("k1", "k2", F.struct("doc_id", "h", "no").alias("pos"), "line")
    first = named.groupBy("k1", "k2").agg(F.min("pos").alias("pos"), F.first("line").alias("line"))  # lines of a name are equal
    return first.join(wanted, ["k1", "k2"])


def variants(texts: DataFrame) -> DataFrame:
    """key, place (-1: the line itself or any deletion; else the deleted word), own (is the line itself), k1, k2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            keys, places, own, first, second = (c.append for c in out)
            for k1, k2, front, back, line in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "front", "back", "line"))):
                w = line.split(b" ")
                n, at, rows = len(w), 0, [(digest(line), -1, True)]
                for p, word in enumerate(w):
                    if (front and p >= n // 2 - 1) or (back and p <= n // 2):
                        v = line[:at] + line[at + len(word) + 1 :] if p < n - 1 else line[: at - 1]
                        rows += [(digest(v), -1, False), (digest(v, p + 1), p, False)]
                    at += len(word) + 1
                for key, p, o in rows:
                    keys(long(key)), places(p), own(o), first(k1), second(k2)
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["key", "place", "own", "k1", "k2"])

    return texts.select("k1", "k2", "front", "back", "line").mapInArrow(run, "key long, place int, own boolean, k1 long, k2 long")


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Is the edit distance, in words, at most one?"""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return i + j >= max(len(a), len(b)) - 1


def near_later(texts: DataFrame, spent: list[DataFrame], min_words: int = MIN_WORDS) -> DataFrame:
    """texts(k1, k2, pos, front, back, line) -> (k1, k2) of lines one edit from an earlier one; spent gets what was cut for it."""
    rows = variants(texts)
    met = rows.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a <> b").select("key")
    rows = cut(rows.join(met, "key", "left_semi").join(texts.select("k1", "k2", "pos"), ["k1", "k2"]))
    first = rows.groupBy("key", "place").agg(F.min(F.when(F.col("own"), F.col("pos"))).alias("own_pos"), F.min(F.when(~F.col("own"), F.col("pos"))).alias("cut_pos"), F.count("*").alias("n"))
    partner = F.when((F.col("place") < 0) & ~F.col("own"), F.col("own_pos")).otherwise(F.col("cut_pos"))
    pairs = cut(joined_to_one(rows, first, ["key", "place"], "n", rows.count()).withColumn("partner", partner).filter("partner < pos").select("k1", "k2", "partner").distinct())
    spent += [rows, pairs]
    asked = pairs.groupBy("partner").agg(F.count("*").alias("n"))
    earlier = texts.select(F.col("pos").alias("partner"), F.col("line").alias("earlier")).join(asked, "partner")
    told = joined_to_one(texts.select("k1", "k2", "line").join(pairs, ["k1", "k2"]), earlier, ["partner"], "n", pairs.count())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = x.split(b" "), y.split(b" ")
                good.append(min(len(x), len(y)) >= min_words - 1 and max(len(x), len(y)) >= min_words and within_one(x, y))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return told.select("k1", "k2", "line", "earlier").mapInArrow(verify, "k1 long, k2 long").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", told: tuple[str, ...] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text_col less its repeated and near-repeated lines, and two columns more, named by told: lines of the text
    and lines dropped. (Columns of docs with these names are replaced; with an empty told, none is and none is added.)"""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    lines, delete = written(line_table(base))
    spent: list[DataFrame] = []
    try:
        wanted = cut(candidates(lines, spent))
        texts = cut(texts_of(base, wanted))
        release(wanted, *spent)
        spent = []
        gone = cut(near_later(texts, spent))
        release(texts, *spent)
        spent = [gone]
        stay = firsts(lines).join(gone, ["k1", "k2"], "left_anti")
        kept = cut(stay.groupBy(F.col("pos.doc_id").alias("id"), F.col("pos.h").alias("h")).agg(F.collect_list("pos.no").alias("kept")))
    finally:
        delete()
        release(*spent)
    # columns of docs travel in a struct, where their names meet none of ours
    whole = docs.select(F.struct(*(c for c in docs.columns if c not in told)).alias("doc")).withColumn("key", F.xxhash64(F.col("doc")[text_col]))
    joined = whole.join(kept, (F.col("h") == F.col("key")) & F.col("id").eqNullSafe(F.col("doc")[id_col].cast("long")), "left")
    # line numbers that stay, in order: the blank ones and the kept; lines are taken by number, so a text takes linear time
    joined = joined.withColumn("parts", F.split(F.col("doc")[text_col], "\n"))
    parts = F.col("parts")
    numbered = F.transform(parts, lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) == "", i))
    stay = F.array_sort(F.concat(F.filter(numbered, F.isnotnull), F.coalesce("kept", F.array().cast("array<int>"))))
    joined = joined.withColumn("rest", F.transform(stay, lambda i: F.get(parts, i)))
    sizes = [c.alias(n) for n, c in zip(told, (F.coalesce(F.size(parts), F.lit(0)), F.coalesce(F.size(parts) - F.size("rest"), F.lit(0))))]
    return joined.select(*((F.array_join("rest", "\n") if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns if c not in told), *sizes)


def op10_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(1, len(s) + 1)) AS no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
r AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '' AS blank, row_number() OVER (ORDER BY doc_id, no) AS pos FROM l),
f AS (SELECT line, min(pos) AS pos FROM r WHERE NOT blank GROUP BY line),
w AS (SELECT pos, string_split(line, ' ') AS w FROM f),
v AS (
  SELECT pos, n, p, array_to_string(list_concat(w[1 : p - 1], w[p + 1 :]), ' ') AS v
  FROM (SELECT pos, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS p FROM w WHERE len(w) >= 4)),
near AS (
  SELECT b.pos FROM v a JOIN v b ON a.v = b.v AND a.p = b.p AND a.pos < b.pos AND b.n >= 5
  UNION SELECT v.pos FROM v JOIN f ON f.line = v.v AND f.pos < v.pos AND v.n >= 5
  UNION SELECT f.pos FROM v JOIN f ON f.line = v.v AND v.pos < f.pos AND v.n >= 5),
k AS (
  SELECT r.doc_id, r.no, r.line, r.blank OR (r.pos = f.pos AND f.pos NOT IN (SELECT pos FROM near)) AS kept
  FROM r LEFT JOIN f ON NOT r.blank AND f.line = r.line),
t AS (
  SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (NOT kept) AS INTEGER) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (kept), '') AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN t USING (doc_id)
"""
