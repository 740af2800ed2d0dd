"""The operators bound to the parquet tables, each beside SQL that says the same in other words.

Keys of QUERIES carry the operator's id in the survey. SNAPSHOTS: a later version of a table is derived from it by
arithmetic on keys, so that both sides of a comparison come from one scan's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.functions import text as T
from driftwake.operators import changes, graph, mining, ranking, resolve, spans

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a (spark, read) function under its name; read(name) gives a table."""
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


C = F.col


def mod(c: str, n: int):
    return F.pmod(C(c), F.lit(n))


@query("""
WITH a AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v
  FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 13 = 0),
j AS (SELECT b.o_orderkey AS bk, a.o_orderkey AS ak, b.o_orderstatus AS bs, a.s, b.o_totalprice AS bv, a.v FROM orders b FULL JOIN a ON a.o_orderkey = b.o_orderkey)
SELECT * FROM (SELECT coalesce(bk, ak) AS o_orderkey, CASE WHEN ak IS NULL THEN 'removed' WHEN bk IS NULL THEN 'added'
  WHEN bs IS DISTINCT FROM s THEN 'signature' WHEN bv IS DISTINCT FROM v THEN 'value' END AS kind FROM j) WHERE kind IS NOT NULL
""")
def j1_snapshot_diff(spark, read):
    o = read("orders")
    after = o.filter(mod("o_orderkey", 11) != 0).select("o_orderkey", F.when(mod("o_orderkey", 5) == 0, "X").otherwise(C("o_orderstatus")).alias("o_orderstatus"), F.when(mod("o_orderkey", 7) == 0, C("o_totalprice") + 1).otherwise(C("o_totalprice")).alias("o_totalprice"))
    new = o.filter(mod("o_orderkey", 13) == 0).select((C("o_orderkey") + 1000000000).alias("o_orderkey"), "o_orderstatus", "o_totalprice")
    return changes.snapshot_diff(o, after.unionByName(new), "o_orderkey", [("signature", "o_orderstatus"), ("value", "o_totalprice")])


PAYLOAD = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("""
WITH g AS (SELECT * FROM part WHERE p_partkey % 10 IN (3, 4)),
n AS (SELECT p_partkey + 1000000 AS k, * FROM part WHERE p_partkey % 10 IN (3, 4) UNION ALL SELECT p_partkey + 2000000, * FROM part WHERE p_partkey % 10 = 4),
m AS (SELECT g.p_partkey AS o, n.k AS w FROM g JOIN n ON g.p_name = n.p_name AND g.p_brand = n.p_brand AND g.p_type = n.p_type AND g.p_size = n.p_size AND g.p_retailprice = n.p_retailprice)
SELECT o AS old_key, w AS new_key FROM m WHERE o IN (SELECT o FROM m GROUP BY o HAVING count(*) = 1) AND w IN (SELECT w FROM m GROUP BY w HAVING count(*) = 1)
""")
def j2_rename_pairs(spark, read):
    p = read("part").select("p_partkey", *PAYLOAD)
    gone = p.filter(mod("p_partkey", 10).isin(3, 4))
    twice = gone.filter(mod("p_partkey", 10) == 4).withColumn("p_partkey", C("p_partkey") + 2000000)
    new = gone.withColumn("p_partkey", C("p_partkey") + 1000000).unionByName(twice)
    return changes.unique_pairs(gone, new, PAYLOAD, "p_partkey").select("old_key", "new_key")


@query("""
WITH s AS (SELECT p_partkey, p_brand, p_type, string_split(p_name, ' ')[1] AS stem, p_partkey % 40 AS v FROM part),
g AS (SELECT p_brand, p_type, stem, count(*) AS n, min(p_partkey) AS k FROM s WHERE v = 1 GROUP BY ALL),
n AS (SELECT p_brand, p_type, stem, count(*) AS n, min(p_partkey) AS k FROM s WHERE v BETWEEN 2 AND 9 GROUP BY ALL)
SELECT g.k AS old_key, n.k AS new_key FROM g JOIN n USING (p_brand, p_type, stem) WHERE g.n = 1 AND n.n = 1
""")
def j3_overload_pairs(spark, read):
    p = read("part").select("p_partkey", "p_brand", "p_type", F.split("p_name", " ")[0].alias("stem"))
    v = mod("p_partkey", 40)
    return changes.unique_pairs(p.filter(v == 1), p.filter(v.between(2, 9)), ["p_brand", "p_type", "stem"], "p_partkey").select("old_key", "new_key")


@query("""
WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 IN (0, 1) GROUP BY 1),
m AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), t AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1)
SELECT o_custkey, n AS orders FROM f WHERE n > 5 AND o_custkey NOT IN (SELECT o_custkey FROM m WHERE n > 5) AND o_custkey NOT IN (SELECT o_custkey FROM t WHERE n > 5)
""")
def u1_new_only_combo(spark, read):
    o = read("orders").select("o_custkey", mod("o_orderkey", 3).alias("part"))
    found = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("orders")).filter("orders > 5")
    return changes.only_in(found(o.filter("part < 2")), found(o.filter("part = 0")), found(o.filter("part = 1")), on=["o_custkey"])


@query("""
WITH m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 17 <> 0),
t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 2 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 19 <> 0
  UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM customer WHERE c_custkey % 23 = 0),
j AS (SELECT c_custkey AS bk, c_acctbal AS bv, m.k AS mk, m.v AS mv, t.k AS tk, t.v AS tv, coalesce(c_custkey, t.k) AS k FROM customer LEFT JOIN m ON m.k = c_custkey FULL JOIN t ON t.k = c_custkey),
d AS (SELECT *, (mk IS NULL) <> (bk IS NULL) OR mv IS DISTINCT FROM bv AS i, (tk IS NULL) <> (bk IS NULL) OR tv IS DISTINCT FROM bv AS o, (mk IS NULL) <> (tk IS NULL) OR mv IS DISTINCT FROM tv AS x FROM j)
SELECT k AS c_custkey, CASE WHEN o AND NOT i THEN tv ELSE mv END AS c_acctbal, CASE WHEN o AND NOT i THEN 'theirs' ELSE 'mine' END AS source, i AND o AND x AS conflict
FROM d WHERE CASE WHEN o AND NOT i THEN tk IS NOT NULL ELSE mk IS NOT NULL END
""")
def u3_three_way_overlay(spark, read):
    c = read("customer").select("c_custkey", "c_acctbal")
    plus = lambda n, x: F.when(mod("c_custkey", n) == 0, C("c_acctbal") + x).otherwise(C("c_acctbal")).alias("c_acctbal")
    mine = c.filter(mod("c_custkey", 17) != 0).select("c_custkey", plus(5, 1))
    theirs = c.filter(mod("c_custkey", 19) != 0).select("c_custkey", plus(7, 2)).unionByName(c.filter(mod("c_custkey", 23) == 0).withColumn("c_custkey", C("c_custkey") + 1000000))
    return changes.overlay(c, mine, theirs, "c_custkey", "c_acctbal")


@query("SELECT l_partkey, min(l_suppkey) AS owner, count(DISTINCT l_suppkey) AS writers, count(DISTINCT l_suppkey) > 1 AS overlap FROM lineitem GROUP BY 1")
def w2_first_writer(spark, read):
    return changes.first_writer(read("lineitem"), "l_partkey", "l_suppkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def w1_last_wins(spark, read):
    o = read("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return changes.last_wins(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("""
WITH s AS (SELECT user_id, ts - INTERVAL 1 HOUR AS a, ts + INTERVAL 1 HOUR AS z FROM events WHERE event_type = 'signup' AND event_id % 5 = 0)
SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND e.ts BETWEEN a AND z)
""")
def j5_span_semi(spark, read):
    e = read("events").select("event_id", "user_id", "ts", "event_type")
    s = e.filter((C("event_type") == "signup") & (mod("event_id", 5) == 0)).select("user_id", (C("ts") - F.expr("INTERVAL 1 HOUR")).alias("start"), (C("ts") + F.expr("INTERVAL 1 HOUR")).alias("end"))
    return spans.in_spans(e, s, "user_id", "ts").select("event_id")


@query("""
WITH f AS (SELECT user_id, min(event_id) AS k FROM events GROUP BY 1),
s AS (SELECT user_id, name, greatest(k - w, 0) AS a, k + w AS z FROM f, (VALUES ('day', 4000), ('six', 1000), ('hour', 200)) AS v(name, w))
SELECT event_id, span FROM (SELECT e.event_id, s.name AS span, row_number() OVER (PARTITION BY e.event_id ORDER BY z - a NULLS LAST, a, name) AS n
  FROM events e LEFT JOIN s ON s.user_id = e.user_id AND e.event_id BETWEEN a AND z) WHERE n = 1
""")
def j6_innermost(spark, read):
    e = read("events").select("event_id", "user_id")
    widths = spark.createDataFrame([("day", 4000), ("six", 1000), ("hour", 200)], "name string, w long")
    s = e.groupBy("user_id").agg(F.min("event_id").alias("k")).crossJoin(F.broadcast(widths)).select("user_id", "name", F.greatest(C("k") - C("w"), F.lit(0)).alias("start"), (C("k") + C("w")).alias("end"))
    return spans.innermost(e, s, "user_id", "event_id", "event_id", C("end") - C("start"), block=1000)


@query("""
SELECT c_custkey, coalesce(s_name, n_name, r_name) AS target, CASE WHEN s_name IS NOT NULL THEN 'supplier' WHEN n_name IS NOT NULL THEN 'nation' WHEN r_name IS NOT NULL THEN 'region' END AS via
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_custkey % 50 LEFT JOIN region ON r_regionkey = c_custkey % 10
""")
def j7_resolve_coalesce(spark, read):
    names = [(t, read(t).select(C(k).alias("_key"), C(v).alias("_value")), key) for t, k, v, key in (("supplier", "s_suppkey", "s_name", C("c_custkey")), ("nation", "n_nationkey", "n_name", mod("c_custkey", 50)), ("region", "r_regionkey", "r_name", mod("c_custkey", 10)))]
    return resolve.first_match(read("customer").select("c_custkey"), names)


@query("""
WITH m AS (SELECT p_brand || '.' || p_size AS name, p_partkey AS k FROM part), o AS (SELECT name, min(k) AS guess FROM m GROUP BY 1 HAVING count(*) = 1)
SELECT m.k AS p_partkey, CASE WHEN m.name IN ('Brand#1.1', 'Brand#2.2', 'Brand#3.3') THEN NULL ELSE o.guess END AS guess FROM m LEFT JOIN o USING (name)
""")
def j8_unique_guess(spark, read):
    m = read("part").select("p_partkey", F.concat_ws(".", "p_brand", C("p_size").cast("string")).alias("name"))
    return resolve.unique_guess(m, m, "name", "p_partkey", ["Brand#1.1", "Brand#2.2", "Brand#3.3"]).select("p_partkey", "guess")


CALL = ["a", "b", "c", "k1", "k2", "z"]


@query("""
WITH c AS (SELECT o_orderkey AS k, CAST(o_orderkey % 5 AS INTEGER) AS n, list_filter(['a', 'b', 'c', 'k1', 'k2', 'z'], lambda x: (o_orderkey // CAST(list_extract([1, 2, 4, 8, 16, 32], list_position(['a', 'b', 'c', 'k1', 'k2', 'z'], x)) AS BIGINT)) % 2 = 1) AS w FROM orders),
p AS (SELECT *, list_concat(CASE WHEN n < 1 THEN ['a'] ELSE [] END, CASE WHEN n < 2 AND NOT list_contains(w, 'b') THEN ['b'] ELSE [] END, CASE WHEN NOT list_contains(w, 'k1') THEN ['k1'] ELSE [] END) AS miss,
  list_filter(w, lambda x: x IN ('a', 'z')) AS odd FROM c)
SELECT k AS o_orderkey, array_to_string(list_filter([CASE WHEN n > 3 THEN 'takes at most 3 positional argument(s), the call passes ' || n END,
  CASE WHEN len(miss) > 0 THEN 'requires ' || array_to_string(miss, ', ') || ', which the call does not pass' END,
  CASE WHEN len(odd) > 0 THEN 'has no parameter named ' || array_to_string(odd, ', ') END], lambda x: x IS NOT NULL), '; ') AS problems FROM p
""")
def p12_contract_check(spark, read):
    words = F.array(*(F.lit(w) for w in CALL))
    bits = F.filter(words, lambda x: F.pmod(F.floor(C("o_orderkey") / F.pow(F.lit(2), F.array_position(words, x) - 1)), F.lit(2)) == 1)
    lit = lambda *w: F.array(*(F.lit(x) for x in w))
    p = resolve.contract_problems(lit("a", "b", "c"), F.lit(1), F.lit(1), F.lit(False), lit("k1", "k2"), lit("k1"), F.lit(False), mod("o_orderkey", 5).cast("int"), bits)
    return read("orders").select("o_orderkey", F.concat_ws("; ", p).alias("problems"))


EDGES = """e AS (SELECT o_orderkey % 1500 AS src, o_custkey AS dst, max(CASE WHEN o_orderstatus = 'O' THEN 0.9 ELSE 0.85 END * CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 1.0 END) AS w FROM orders GROUP BY 1, 2)"""


def order_edges(read) -> DataFrame:
    w = F.when(C("o_orderstatus") == "O", 0.9).otherwise(0.85) * F.when(C("o_orderpriority") == "1-URGENT", 0.5).otherwise(1.0)
    return read("orders").select(mod("o_orderkey", 1500).alias("src"), C("o_custkey").alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.max("w").alias("weight"))


def hops_sql() -> str:
    steps = ["h0 AS (SELECT c_custkey AS node, 0.95::DOUBLE AS s FROM customer WHERE c_custkey % 300 = 1)"]
    steps += [f"h{i} AS (SELECT e.src AS node, max(s * w::DOUBLE) AS s FROM h{i - 1} JOIN e ON e.dst = h{i - 1}.node WHERE s * w::DOUBLE >= 0.1 AND e.src % 300 <> 1 GROUP BY 1)" for i in range(1, 7)]
    union = " UNION ALL ".join(f"SELECT node, {i} AS hops, s FROM h{i}" for i in range(1, 7))
    return f"WITH {EDGES}, {', '.join(steps)}, a AS ({union}) SELECT node, min(hops) AS hops, round(max(s), 6) AS score FROM a JOIN (SELECT node, max(s) AS s FROM a GROUP BY 1) USING (node, s) GROUP BY node"


@query(hops_sql())
def g1_blast_radius(spark, read):
    seeds = read("customer").filter(mod("c_custkey", 300) == 1).select(C("c_custkey").alias("node"), F.lit(0.95).alias("score"))
    return graph.propagate(order_edges(read), seeds).select("node", "hops", F.round("score", 6).alias("score"))


@query(f"""
WITH RECURSIVE {EDGES}, f(node, d) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey % 300 = 1 UNION SELECT e.dst, f.d + 1 FROM f JOIN e ON e.src = f.node WHERE f.d < 1),
b(node, d) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey % 300 = 1 UNION SELECT e.src, b.d + 1 FROM b JOIN e ON e.dst = b.node WHERE b.d < 2)
SELECT node, min(d) AS hops FROM (SELECT * FROM f UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY 2, 1 LIMIT 300
""")
def g2_subgraph(spark, read):
    from driftwake.plans import tools

    e, start = graph.cut(order_edges(read)), read("customer").filter(mod("c_custkey", 300) == 1).select(C("c_custkey").alias("node"))
    return tools.subgraph(e, start)


@query("""
WITH RECURSIVE s AS (SELECT user_id || event_type || (event_id % 7) AS src, lead(user_id || event_type || (event_id % 7)) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM events),
e AS (SELECT DISTINCT src, dst FROM s WHERE dst IS NOT NULL AND src <> dst), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT x.a AS node, min(y.a) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1
""")
def g4_cycles(spark, read):
    from pyspark.sql import Window

    e = read("events").select("user_id", "event_id", F.concat(C("user_id").cast("string"), "event_type", mod("event_id", 7).cast("string")).alias("src"))
    steps = e.select("src", F.lead("src").over(Window.partitionBy("user_id").orderBy("event_id")).alias("dst")).filter("dst IS NOT NULL")
    return graph.cycles(steps)


@query(f"""
WITH RECURSIVE {EDGES}, b(node) AS (SELECT c_custkey FROM customer WHERE c_custkey % 300 = 1 UNION SELECT e.src FROM b JOIN e ON e.dst = b.node) SELECT node FROM b
""")
def g7_reach(spark, read):
    start = read("customer").filter(mod("c_custkey", 300) == 1).select(C("c_custkey").alias("node"))
    return graph.reach(graph.cut(order_edges(read)), start, backward=True).select("node")


def labels_sql(rounds: int = 30) -> str:
    steps = ["l0 AS (SELECT DISTINCT s AS node, s AS label FROM u)"]
    steps += [f"l{i} AS (SELECT node, label FROM (SELECT u.s AS node, l.label, row_number() OVER (PARTITION BY u.s ORDER BY sum(u.w) DESC, l.label) AS n FROM u JOIN l{i - 1} l ON l.node = u.d GROUP BY u.s, l.label) WHERE n = 1)" for i in range(1, rounds + 1)]
    return f"WITH e AS (SELECT o_custkey AS s, o_orderkey % 1500 AS d, CAST(count(*) AS BIGINT) AS w FROM orders GROUP BY 1, 2), u AS (SELECT s, d, CAST(sum(w) AS BIGINT) AS w FROM (SELECT s, d, w FROM e UNION ALL SELECT d, s, w FROM e) WHERE s <> d GROUP BY 1, 2), {', '.join(steps)} SELECT node, label FROM l{rounds}"


@query(labels_sql())
def g10_communities(spark, read):
    e = read("orders").groupBy(C("o_custkey").alias("src"), mod("o_orderkey", 1500).alias("dst")).agg(F.count("*").alias("weight"))
    return graph.communities(e)


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS b, l_suppkey AS i FROM lineitem), k AS (SELECT b FROM s GROUP BY 1 HAVING count(*) <= 25), t AS (SELECT s.* FROM s JOIN k USING (b)),
n AS (SELECT i, count(*) AS total FROM t GROUP BY 1), p AS (SELECT x.i AS item, y.i AS partner, count(*) AS together FROM t x JOIN t y ON x.b = y.b AND x.i <> y.i GROUP BY 1, 2)
SELECT item, partner, together, total, round(together / total, 6) AS confidence FROM p JOIN n ON n.i = p.item WHERE together >= 4 AND together / total >= 0.06
""")
def a4_cochange(spark, read):
    found = mining.baskets(read("lineitem"), "l_orderkey", "l_suppkey", support=4, confidence=0.06)
    return found.withColumn("confidence", F.round("confidence", 6))


SEVERITY = "CASE event_type WHEN 'error' THEN CASE WHEN value > 95 THEN 'critical' ELSE 'high' END WHEN 'purchase' THEN CASE WHEN value > 90 THEN 'medium' ELSE 'low' END ELSE 'low' END"


@query(f"""
WITH f AS (SELECT user_id % 50 AS u, CAST(ts AS DATE) AS d, {SEVERITY} AS s, event_id % 3 = 0 AS b FROM events)
SELECT u AS user_bucket, CAST(d AS VARCHAR) AS day, CASE WHEN bool_or(b AND s IN ('critical', 'high')) THEN 'block' WHEN bool_or(s IN ('critical', 'high', 'medium')) THEN 'review' ELSE 'ok' END AS verdict FROM f GROUP BY 1, 2
""")
def a1_verdict(spark, read):
    f = read("events").select(mod("user_id", 50).alias("user_bucket"), C("ts").cast("date").cast("string").alias("day"), F.expr(SEVERITY).alias("severity"), (mod("event_id", 3) == 0).alias("blocking"))
    return ranking.verdict(f, ["user_bucket", "day"])


@query(f"WITH f AS (SELECT user_id, {SEVERITY} AS s FROM events) SELECT user_id, " + ", ".join(f"count(*) FILTER (s = '{s}') AS {s}" for s in ranking.SEVERITIES) + " FROM f GROUP BY 1")
def a2_severity_counts(spark, read):
    return ranking.severity_counts(read("events").select("user_id", F.expr(SEVERITY).alias("severity")), ["user_id"])


@query("""
WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_-]*')) AS word FROM documents),
d AS (SELECT word, count(*) AS definitions FROM (SELECT regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_-]*')[1] AS word FROM documents) WHERE word IS NOT NULL GROUP BY 1),
m AS (SELECT word, count(*) AS mentions FROM w GROUP BY 1)
SELECT word, coalesce(mentions, 0) AS mentions, definitions FROM d LEFT JOIN m USING (word) WHERE coalesce(mentions, 0) <= definitions
""")
def a5_unmentioned(spark, read):
    words = graph.over_cores(read("documents").select("text")).select(T.tokens(C("text")).alias("w"))
    return mining.unmentioned(words.select(F.explode("w").alias("word")), words.select(F.get("w", F.lit(0)).alias("word")).filter("word IS NOT NULL"), "word")


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 30)),
h AS (SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS h, count(*) AS n FROM s GROUP BY 1), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS c, n FROM h),
k AS (SELECT s.doc_id, s.g FROM s JOIN c ON c.doc_id = s.doc_id AND c.c = s.doc_id), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM k x JOIN k y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, round(p.c / (x.n + y.n - p.c), 6) AS similarity FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE p.c / (x.n + y.n - p.c) >= 0.82
UNION ALL SELECT c AS a, doc_id AS b, 1.0::DOUBLE FROM c WHERE c <> doc_id
""")
def f8_near_duplicates(spark, read):
    """Definitions of at least 30 tokens, by Jaccard similarity of their shingles of 4 tokens: pairs of classes of equal sets, and
    of each other member its class."""
    w = graph.over_cores(read("documents").select("doc_id", "text")).select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    s = w.select("doc_id", F.when(F.size("w") >= 30, T.shingles(C("w"), 4)).alias("s"))
    classes, links = mining.similar_classes(s, "doc_id", "s", 0.82, 0.6)
    members = classes.filter(C("key") != C("class")).select(C("class").alias("a"), C("key").alias("b"), F.lit(1.0).alias("similarity"))
    return links.withColumn("similarity", F.round("similarity", 6)).unionByName(members)


SCAN = {"number": "[0-9]{4,}", "address": "[a-z]+@[a-z]+", "license": "(?i)licen[sc]e", "shout": "[A-Z]{3,}"}


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule, count(*) AS lines FROM l WHERE regexp_matches(line, '{v}') GROUP BY 1" for k, v in SCAN.items()))
def f12_line_scan(spark, read):
    lines = graph.over_cores(read("documents").select("doc_id", "text")).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hit = F.filter(F.array(*(F.when(C("line").rlike(v), F.lit(k)) for k, v in SCAN.items())), lambda x: x.isNotNull())
    return lines.select("doc_id", F.explode(hit).alias("rule")).groupBy("doc_id", "rule").agg(F.count("*").alias("lines"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_-]*')) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 3")
def f4_tokens(spark, read):
    return read("documents").select(F.explode(T.tokens(C("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_name, '[A-Z]?[a-z]+|[0-9]+'), lambda w: lower(w)), ' ') AS words FROM customer")
def f5_name_words(spark, read):
    return read("customer").select("c_custkey", F.concat_ws(" ", T.name_words(C("c_name"))).alias("words"))


@query("""
WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
f AS (SELECT doc_id, no, 'r' || (length(line) % 3) AS rule FROM l WHERE length(line) > 40), m AS (SELECT doc_id, no, 'r' || (no % 3) AS rule, length(line) % 2 = 0 AS comment FROM l WHERE length(line) % 5 = 0)
SELECT doc_id, no, rule FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.rule = f.rule AND (m.no = f.no OR (m.comment AND m.no = f.no - 1)))
""")
def p7_suppressed(spark, read):
    from driftwake.plans import check

    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).select("doc_id", (C("no") + 1).cast("long").alias("no"), F.char_length("line").alias("n"))
    found = lines.filter("n > 40").select("doc_id", "no", F.concat(F.lit("r"), mod("n", 3).cast("string")).alias("rule"))
    marks = lines.filter(mod("n", 5) == 0).select("doc_id", "no", F.concat(F.lit("r"), mod("no", 3).cast("string")).alias("rule"), (mod("n", 2) == 0).alias("alone"))
    return check.unsuppressed(found, marks, "doc_id", "no", "rule")


@query("SELECT source, min(n_chars % 4) AS worst, max(n_chars % 97) AS score, string_agg(DISTINCT lang, ',' ORDER BY lang) AS items FROM documents GROUP BY 1")
def a6_files_to_check(spark, read):
    d = read("documents").select("source", "lang", mod("n_chars", 4).alias("rank"), mod("n_chars", 97).alias("points"))
    return ranking.files_to_check(d, "source", "rank", "points", "lang").withColumn("items", F.concat_ws(",", "items"))


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2),
u AS (SELECT c_nationkey, c_mktsegment AS usual FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, f) AS r FROM c) WHERE r = 1)
SELECT c_custkey, c_mktsegment, usual FROM customer JOIN u USING (c_nationkey) WHERE c_mktsegment <> usual
""")
def a10_layout_majority(spark, read):
    return mining.majority(read("customer"), ["c_nationkey"], "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment", "usual")


HALF = "2024-01-16"


@query(f"""
WITH s AS (SELECT user_id, event_type || (event_id % 3) AS v, ts < TIMESTAMP '{HALF}' AS old FROM events),
b AS (SELECT DISTINCT user_id, v FROM s WHERE old), a AS (SELECT DISTINCT user_id, v FROM s WHERE NOT old),
l AS (SELECT user_id, min(v) AS lost, count(*) AS n FROM b ANTI JOIN a USING (user_id, v) GROUP BY 1), g AS (SELECT user_id, min(v) AS gained, count(*) AS n FROM a ANTI JOIN b USING (user_id, v) GROUP BY 1)
SELECT user_id, lost, gained FROM l JOIN g USING (user_id) WHERE l.n = 1 AND g.n = 1 AND user_id IN (SELECT user_id FROM a) AND user_id IN (SELECT user_id FROM b)
""")
def j24_env_compare(spark, read):
    e = read("events").select("user_id", "ts", F.concat("event_type", mod("event_id", 3).cast("string")).alias("v"))
    old = C("ts") < F.lit(HALF).cast("timestamp_ntz")
    return mining.lost_and_gained(e.filter(old), e.filter(~old), "user_id", "v")


@query(f"""
WITH s AS (SELECT user_id, event_type, CAST(extract(hour FROM ts) AS INTEGER) AS hour, event_id % 2 AS v, ts < TIMESTAMP '{HALF}' AS old FROM events),
b AS (SELECT user_id, event_type, hour, min(v) AS old FROM s WHERE old GROUP BY 1, 2, 3 HAVING count(DISTINCT v) = 1), a AS (SELECT user_id, event_type, hour, min(v) AS new FROM s WHERE NOT old GROUP BY 1, 2, 3 HAVING count(DISTINCT v) = 1)
SELECT user_id, event_type, hour, b.old, new FROM b JOIN a USING (user_id, event_type, hour) WHERE b.old <> new
""")
def a11_variants(spark, read):
    e = read("events").select("user_id", "event_type", F.hour("ts").alias("hour"), "ts", mod("event_id", 2).alias("v"))
    old = C("ts") < F.lit(HALF).cast("timestamp_ntz")
    return mining.single_variant_change(e.filter(old), e.filter(~old), ["user_id", "event_type", "hour"], "v")


@query("""
WITH m AS (SELECT DISTINCT event_type AS t FROM events), c AS (SELECT DISTINCT user_id || '/' || (extract(day FROM ts) - 1) // 7 AS holder, event_type AS t FROM events)
SELECT holder, 'view' AS missing FROM c WHERE t <> 'view' GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM m WHERE t <> 'view') AND holder NOT IN (SELECT holder FROM c WHERE t = 'view')
""")
def j26_coverage(spark, read):
    """Users' weeks that have seen every other type of event, and no view."""
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("string")
    e = read("events").select(F.concat(C("user_id").cast("string"), F.lit("/"), week).alias("holder"), "event_type")
    found = mining.uncovered(e.select("event_type").distinct(), e, "holder", "event_type", C("event_type") == "view")
    return found.withColumn("missing", F.concat_ws(",", "missing"))


@query("""
WITH b AS (SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), a AS (SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn % 3 <> 2)
SELECT conv_id, turn, b.n AS next_before, a.n AS next_after FROM b JOIN a USING (conv_id, turn) WHERE b.n IS DISTINCT FROM a.n
""")
def w4_successor_change(spark, read):
    c = read("conversations").select("conv_id", "turn", "role")
    return spans.successor_changes(c, c.filter(mod("turn", 3) != 2), "conv_id", "turn", "role")


@query("""
WITH e AS (SELECT conv_id, min(turn) AS a, max(turn) AS z FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS members FROM conversations JOIN e USING (conv_id) WHERE turn BETWEEN a AND z GROUP BY 1
""")
def w5_range_members(spark, read):
    user = C("role") == "user"
    return spans.range_members(read("conversations"), "conv_id", "turn", user, user, "role").withColumn("members", F.concat_ws(",", "members"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events")
def w6_rate_limit_window(spark, read):
    return spans.trailing_count(read("events").select("event_id", "user_id", "ts"), "user_id", "ts", 86400).select("event_id", "in_window")


@query("""
WITH n AS (SELECT doc_id AS n FROM documents ANTI JOIN labels USING (doc_id))
SELECT min(n) AS first, max(n) AS last FROM (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM n) GROUP BY g
""")
def w7_islands(spark, read):
    return spans.islands(read("documents").join(read("labels"), "doc_id", "left_anti").select(C("doc_id").alias("n")), "n")


@query("""
WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS size FROM lineitem GROUP BY 1, 2), s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY l_suppkey ORDER BY size DESC, l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM g)
SELECT l_suppkey, l_returnflag, size, CAST(least(size, greatest(300 - spent, 3)) AS BIGINT) AS shown FROM s
""")
def w9_budget(spark, read):
    g = read("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("size"))
    return spans.within_budget(g, "size", [F.desc("size"), C("l_returnflag")], 300, 3, ["l_suppkey"])


@query(f"SELECT DISTINCT user_id, event_type, props FROM events WHERE ts >= TIMESTAMP '{HALF}' AND (user_id, event_type, props) NOT IN (SELECT (user_id, event_type, props) FROM events WHERE ts < TIMESTAMP '{HALF}')")
def u5_new_not_old(spark, read):
    e = read("events").select("user_id", "event_type", "props", "ts")
    old = C("ts") < F.lit(HALF).cast("timestamp_ntz")
    on = ["user_id", "event_type", "props"]
    return changes.only_in(e.filter(~old).select(*on).distinct(), e.filter(old), on=on)


@query("""
SELECT o_custkey, o_orderkey, place, greatest(n - 3, 0) AS omitted FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE place <= 3
""")
def topk_omitted(spark, read):
    o = read("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.top_with_omitted(o, ["o_custkey"], [F.desc("o_totalprice"), C("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place", "omitted")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name")
def j21_team_pairs(spark, read):
    from driftwake.plans import team

    return team.pairs(read("nation"), "n_name")


@query(f"""
WITH RECURSIVE {EDGES}, b(node, d) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey % 300 = 1 UNION SELECT e.src, b.d + 1 FROM b JOIN e ON e.dst = b.node WHERE b.d < 3),
n AS (SELECT node, min(d) AS d FROM b GROUP BY 1)
SELECT c_nationkey, count(*) AS definitions, min(d) AS nearest FROM n JOIN customer ON c_custkey = node WHERE d > 0 GROUP BY 1
""")
def a17_reach_rollup(spark, read):
    start = read("customer").filter(mod("c_custkey", 300) == 1).select(C("c_custkey").alias("node"))
    got = graph.reach(graph.cut(order_edges(read)), start, 3, backward=True).filter("hops > 0")
    return got.join(read("customer"), C("c_custkey") == C("node")).groupBy("c_nationkey").agg(F.count("*").alias("definitions"), F.min("hops").alias("nearest"))


@query("SELECT 'd/' || doc_id AS path FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def u2_changed_paths(spark, read):
    from driftwake.sources import files

    d = read("documents").select("doc_id", F.concat(F.lit("d/"), C("doc_id").cast("string")).alias("path"), "text")
    after = d.filter(mod("doc_id", 11) != 0).select(F.lit("after").alias("snapshot"), "path", F.when(mod("doc_id", 7) == 0, F.concat("text", F.lit("x"))).when(mod("doc_id", 5) == 0, F.regexp_replace("text", "\n", "\r\n")).otherwise(C("text")).alias("text"))
    return files.changed_paths(d.select(F.lit("before").alias("snapshot"), "path", "text").unionByName(after), "before", "after")


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'src/' ELSE '' END || CASE p_partkey % 5 WHEN 1 THEN 'tests/' WHEN 2 THEN '.cache/' ELSE '' END || replace(p_name, ' ', '/') || CASE p_partkey % 4 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '_test.py' ELSE '.py' END AS path FROM part)
SELECT p_partkey, replace(regexp_replace(regexp_replace(regexp_replace(path, '^src/', ''), '\\.py$', ''), '(^|/)__init__$', ''), '/', '.') AS module,
  regexp_matches(path, '(^|/)tests?/') OR regexp_matches(path, '_test\\.py$') AS test_path, regexp_matches(path, '_test\\.py$') AS test_file, contains(path, '.cache/') AS skipped FROM p
""")
def p1_paths(spark, read):
    """P1, P3, P4, P5 over made-up paths."""
    n = lambda k: mod("p_partkey", k)
    path = F.concat(F.when(n(3) == 0, "src/").otherwise(""), F.when(n(5) == 1, "tests/").when(n(5) == 2, ".cache/").otherwise(""), F.translate("p_name", " ", "/"), F.when(n(4) == 0, "/__init__.py").when(n(4) == 1, "_test.py").otherwise(".py"))
    return read("part").select("p_partkey", T.module_name(path).alias("module"), T.is_test_path(path).alias("test_path"), T.is_test_file(path).alias("test_file"), T.in_skipped_dir(path).alias("skipped"))


@query("SELECT doc_id, substr(sha256(replace(text, chr(13) || chr(10), chr(10))), 1, 16) AS hash FROM documents")
def f2_content_hash(spark, read):
    return read("documents").select("doc_id", T.content_hash(C("text")).alias("hash"))


@query("""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 40 THEN rtrim(substr(s, 1, 39)) || '…' ELSE s END AS short FROM t
""")
def p16_shortened(spark, read):
    return read("documents").select("doc_id", T.shortened(C("text"), 40).alias("short"))
