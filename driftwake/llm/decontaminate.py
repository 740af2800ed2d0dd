"""Benchmark decontamination: a prefix-filtered set join, with DataFrame operations only.

Items are cut into windows of WINDOW consecutive words (a shorter item is one window). A window occurs in a document
only if all its shingles do, so the necessary prefix of its shingles, ordered from the rarest in all documents, is the
rarest alone. Documents' shingles are joined with these. The place of the shingle fixes where the window would start;
starts before the text or windows past its end fall to the positional and length bounds, and what is left is compared
word by word, inside the join.

One pass over the documents counts the shingles of the benchmark, one joins. A row for the end of each document passes the
join too and carries its number of words, so no document is lost and none is read again. What is broadcast is checked to
be at most BROADCAST_ROWS rows. Beyond that keys and places alone are shuffled, what meets is gathered by document, and a
second join with the documents verifies it; their words are counted apart.

Edge cases: a null text has no words (n_words 0, nothing hit); an item without words has no window; a null item_id
is named `null`; repeated items count once; repeated documents give a row each; empty tables give no rows, or documents
of which none is contaminated; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.llm.common import ascii_lower, cut, table

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # words are what this parts, after lower-casing
EDGES = "".join(chr(i) for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122))
WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Split, as it takes a tenth of the time of finding all matches; trimmed first, so that no word is empty."""
    t = F.btrim(ascii_lower(text), F.lit(EDGES))
    return F.when(F.octet_length(t) > 0, F.split(t, BETWEEN)).otherwise(F.array().cast("array<string>"))


def key(words_: Column, at: Column, size: int) -> Column:
    """Of the shingle of `size` words at a place, from 0."""
    return F.xxhash64(*(F.get(words_, at + i) for i in range(size)))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """win (words), items (ids as strings): one row a distinct window."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    w = w.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at"))
    w = w.select("item", F.slice("w", F.col("at"), F.lit(size)).alias("win"))
    return w.groupBy("win").agg(F.collect_set("item").alias("items"))


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (hash of the text), w."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words(F.col(text_col)).alias("w"))


def keyed(doc: DataFrame, sizes: list[int], *columns: str) -> DataFrame:
    """columns of doc, at, key: a row for each shingle of each of the sizes (SHINGLE sizes at most)."""
    each = [F.when(F.col("at") + n <= F.size("w"), key(F.col("w"), F.col("at"), n)) for n in sizes]
    at = doc.select(*columns, *([] if "w" in columns else ["w"]), F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    if len(each) == 1:
        return at.withColumn("key", each[0]).select(*columns, "at", "key")
    return at.select(*columns, "at", F.explode(F.array(*each)).alias("key"))


def prefixes(doc: DataFrame, wins: DataFrame, n: int, sizes: list[int]) -> DataFrame:
    """wins with the key and the place in the window of its rarest shingle; shingles are of SHINGLE words, in windows of
    fewer words of all of them."""
    def of(size: int) -> DataFrame:
        own = wins.filter(F.size("win") == size) if size < SHINGLE else wins.filter(F.size("win") >= size)
        return own.select("win", "items", F.explode(F.sequence(F.lit(0), F.size("win") - size)).alias("off")).withColumn("key", key(F.col("win"), F.col("off"), size))

    parts = reduce(DataFrame.unionByName, map(of, sizes))
    asked = parts.select("key").distinct()
    # only keys leave the scan: the words themselves need not pass the join
    found = keyed(doc, sizes).select("key").filter("key IS NOT NULL")
    counts = found.join(bounded(asked, n * WINDOW), "key").groupBy("key").agg(F.count("*").alias("n"))
    rarest = parts.join(counts, "key", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off")).alias("r"), F.first("items").alias("items"))
    return rarest.select(F.col("r.key").alias("key"), F.col("r.off").alias("off"), F.size("win").alias("len"), "win", "items")


def occurs(w: Column, start: Column, length: Column, win: Column) -> Column:
    return (start >= 0) & (start + length <= F.size(w)) & (F.slice(w, F.greatest(start, F.lit(0)) + 1, length) == win)


def met_by_broadcast(doc: DataFrame, index: DataFrame, sizes: list[int]) -> DataFrame:
    """id, h, n_words, copies, spans, sets of each (id, text)."""
    end = index.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("off"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items"))
    at = keyed(doc, sizes or [1], "id", "h", "w")
    ended = F.col("at") == F.size("w")
    if len(sizes) > 1:  # one row of a text's end is enough
        at = at.filter(F.col("key").isNotNull()).unionByName(doc.select("id", "h", "w", F.size("w").alias("at"), F.lit(None).cast("long").alias("key")))
    at = at.withColumn("key", F.when(ended, F.lit(0).cast("long")).otherwise(F.col("key")))
    start, length = F.col("at") - F.col("off"), F.col("len")
    hits = at.join(F.broadcast(index.unionByName(end)), "key").filter(F.when(length == 0, ended).otherwise(~ended & occurs(F.col("w"), start, length, F.col("win"))))
    hits = hits.select("id", "h", F.when(length == 0, F.col("at")).alias("n"), F.when(length > 0, F.struct(start.alias("a"), length.alias("n"))).alias("span"), F.when(length > 0, F.col("items")).alias("items"))
    return hits.groupBy("id", "h").agg(F.max("n").alias("n_words"), F.count("n").alias("copies"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("sets"))


def met_by_shuffle(doc: DataFrame, index: DataFrame, sizes: list[int]) -> DataFrame:
    """As above, for any number of windows. Texts are verified once, however many copies there are."""
    one = doc.groupBy("id", "h").agg(F.count("*").alias("copies"), F.first("w").alias("w"))  # texts of a hash are equal
    at = keyed(doc, sizes, "id", "h").filter("key IS NOT NULL").distinct()
    found = at.join(index, "key").filter(F.col("at") >= F.col("off"))
    found = found.select("id", "h", F.struct((F.col("at") - F.col("off")).alias("a"), F.col("len").alias("n"), "win", "items").alias("x")).groupBy("id", "h").agg(F.collect_list("x").alias("xs"))
    found = found.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "xs")
    both = one.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    good = F.filter(F.coalesce("xs", F.array().cast(found.schema["xs"].dataType)), lambda x: occurs(F.col("w"), x["a"], x["n"], x["win"]))
    both = both.withColumn("good", good)
    spans = F.array_distinct(F.transform("good", lambda x: F.struct(x["a"].alias("a"), x["n"].alias("n"))))
    return both.select("id", "h", F.size("w").alias("n_words"), "copies", spans.alias("spans"), F.array_distinct(F.transform("good", lambda x: x["items"])).alias("sets"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated, text_hash (xxhash64 of the text)."""
    wins = cut(windows_of(items, item_col, item_text, size))
    n, lengths = wins.agg(F.count("*"), F.array_sort(F.collect_set(F.least(F.size("win"), F.lit(SHINGLE))))).head()
    doc = documents(docs, id_col, text_col)
    index = cut(prefixes(doc, wins, n, lengths)) if n else wins.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("off"), F.lit(0).alias("len"), "win", "items").limit(0)
    per = (met_by_broadcast if n <= BROADCAST_ROWS else met_by_shuffle)(doc, index, list(lengths))
    # overlapping windows share words: each place counts once
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["a"] + s["n"] - 1)))))
    named = F.array_sort(F.array_distinct(F.flatten("sets")))
    out = per.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), named.alias("named"), F.col("h").alias("text_hash"), "copies")
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select(id_col, "n_words", "n_hit", F.size("named").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "named"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "text_hash")


def op1_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
n AS (
  SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS win, least(10, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM n),
p AS (
  SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, k WHERE len(w) >= k)),
o AS (SELECT p.doc_id, p.s, p.k, n.item_id FROM p JOIN n ON p.win = n.win AND p.k = n.k),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS place FROM o) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
