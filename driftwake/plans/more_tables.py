"""More operators bound to the parquet tables, each beside SQL that says the same in other words (see tables.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwake.functions import text as T
from driftwake.operators import changes, contracts, layouts, nodes, roles
from driftwake.plans import tools, worklist
from driftwake.plans.tables import EDGES, mod, order_edges, query
from driftwake.sources import lines
from driftwake.values import EDGE_WEIGHTS

C = F.col


def text(c: str):
    return C(c).cast("string")


def cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---- names, texts, notation


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'tests/' WHEN 2 THEN 'lib/' ELSE '' END || CASE p_partkey % 4 WHEN 0 THEN 'test_' ELSE '' END || replace(p_name, ' ', '_') || CASE p_partkey % 3 WHEN 0 THEN '_test.py' ELSE '.py' END AS path FROM part)
SELECT p_partkey, p_partkey % 5 = 1 OR p_partkey % 4 = 0 OR p_partkey % 3 = 0 AS test FROM p
""")
def p6_test_source(spark, read):
    n = lambda k: mod("p_partkey", k)
    path = F.concat(F.when(n(5) == 1, "tests/").when(n(5) == 2, "lib/").otherwise(""), F.when(n(4) == 0, "test_").otherwise(""), F.translate("p_name", " ", "_"), F.when(n(3) == 0, "_test.py").otherwise(".py"))
    return read("part").select("p_partkey", tools.is_test_source(path).alias("test"))


@query("""
WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
f AS (SELECT 'r' || (length(line) % 3) AS rule, 'd/' || doc_id AS path, no AS line, 'm' || (length(line) % 7) AS message, doc_id FROM l WHERE length(line) > 40),
m AS (SELECT 'd/' || doc_id AS path, no AS line, CASE WHEN no % 11 = 0 THEN '' ELSE 'r' || (no % 3) END AS rule, length(line) % 2 = 0 AS alone FROM l WHERE length(line) % 5 = 0)
SELECT rule, path, line, message, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.path = f.path AND (m.rule = '' OR m.rule = f.rule) AND (m.line = f.line OR (m.alone AND m.line = f.line - 1))) THEN 'mark'
  WHEN path LIKE 'd/1%' THEN 'ignored path' WHEN doc_id % 13 = 0 THEN 'accepted' ELSE 'kept' END AS reason FROM f
""")
def p8_suppressed(spark, read):
    rows = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "row")).select("doc_id", cat("d/", C("doc_id")).alias("path"), (C("no") + 1).cast("long").alias("line"), F.char_length("row").alias("n"))
    found = rows.filter("n > 40").select(cat("r", mod("n", 3)).alias("rule"), "path", "line", cat("m", mod("n", 7)).alias("message"), "doc_id")
    marks = rows.filter(mod("n", 5) == 0).select("path", "line", F.when(mod("line", 11) == 0, "").otherwise(cat("r", mod("line", 3))).alias("rule"), (mod("n", 2) == 0).alias("alone"))
    accepted = found.filter(mod("doc_id", 13) == 0).select(T.short_hash("rule", "path", "message").alias("fingerprint")).distinct()
    kept, gone = tools.suppressed(found.drop("doc_id"), marks, ["d/1*"], accepted)
    return kept.withColumn("reason", F.lit("kept")).unionByName(gone)


@query("SELECT doc_id FROM documents WHERE lang NOT IN ('en', 'de') AND source <> 'src0' AND NOT (lang = 'fr' AND doc_id % 10 = 7)")
def p9_settings(spark, read):
    path = F.concat_ws("/", "lang", "source", F.concat(text("doc_id"), F.lit(".py")))
    return read("documents").filter(~T.excluded(path, ["en/*", "de/", "*/src0", "fr/*7.py"])).select("doc_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus <> 'X' THEN 'signature' ELSE 'value' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus || ' -> X' ELSE (o_orderkey % 9) || ' -> ' || (o_orderkey % 9 + 1) END AS detail
FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0
""")
def p11_details(spark, read):
    """Live changes, and what each says."""
    o = read("orders").select("o_orderkey", C("o_orderstatus").alias("signature"), text("o_orderkey").alias("body"), mod("o_orderkey", 9).cast("string").alias("value"))
    a = o.select("o_orderkey", F.when(mod("o_orderkey", 5) == 0, "X").otherwise(C("signature")).alias("signature"), "body", F.when(mod("o_orderkey", 7) == 0, (C("value").cast("int") + 1).cast("string")).otherwise(C("value")).alias("value"))
    found = changes.live(changes.snapshot_diff(o, a.filter(mod("o_orderkey", 11) != 99), "o_orderkey", [("signature", "signature"), ("value", "value")], ["signature", "value"]))
    return tools.details(found.withColumn("old_name", F.lit(None).cast("string"))).select("o_orderkey", "kind", "detail")


VARIANTS = [("abc", 2, "", "k", "", "c1k2"), ("abc", 3, "", "k", "", "c1k2"), ("ab", 2, "", "k", "", "k2"), ("axc", 2, "", "k", "", "c1k2"), ("abc", 2, "", "k", "k", "c1"), ("bac", 2, "", "k", "", "c1k2"), ("abc", 2, "", "k", "", "c9k2"), ("ab", 2, "", "kc", "", "c1k2")]


def contract(positional, required, only, keywords, needed, defaults):
    letters = lambda s: F.array(*map(F.lit, s)).cast("array<string>")
    pairs = [F.lit(x) for x in defaults]
    return F.struct(letters(positional).alias("positional"), F.lit(required).alias("required"), letters(only).alias("positional_only"), letters(keywords).alias("keyword_only"), letters(needed).alias("keyword_required"), F.lit(False).alias("varargs"), F.lit(False).alias("varkw"), F.create_map(*pairs).alias("defaults"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderkey % 5 AS p, o_custkey % 2 = 1 AS kc, o_custkey % 3 = 0 AS kk, o_custkey % 5 = 0 AS kb, o_orderkey % 8 AS v FROM orders)
SELECT o_orderkey, CAST(CASE v WHEN 0 THEN 0 WHEN 1 THEN CAST(p < 1 OR (p < 2 AND NOT kb) OR (p < 3 AND NOT kc) AS INTEGER) WHEN 2 THEN CAST(kc OR p >= 3 AS INTEGER) WHEN 3 THEN CAST(kb AS INTEGER) WHEN 4 THEN CAST(NOT kk AS INTEGER)
  WHEN 5 THEN 2 * CAST(p >= 1 AS INTEGER) WHEN 6 THEN CAST(p < 3 AND NOT kc AS INTEGER) ELSE CAST(p >= 3 AS INTEGER) END AS INTEGER) AS hits,
  CASE v WHEN 0 THEN '' WHEN 1 THEN 'fewer-positional' WHEN 2 THEN 'uses-slot-or-keyword' WHEN 3 THEN 'uses-keyword' WHEN 4 THEN 'omits-keyword' WHEN 5 THEN 'reaches-slot,reaches-slot' WHEN 6 THEN 'omits' ELSE 'reaches-slot' END AS tests FROM c
""")
def p14_arity_breaks(spark, read):
    """Eight changes of a contract, and which calls each hits."""
    new = F.element_at(F.array(*(contract(*v) for v in VARIANTS)), (mod("o_orderkey", 8) + 1).cast("int"))
    keys = F.array_compact(F.array(F.when(mod("o_custkey", 2) == 1, "c"), F.when(mod("o_custkey", 3) == 0, "k"), F.when(mod("o_custkey", 5) == 0, "b")))
    told = read("orders").select("o_orderkey", mod("o_orderkey", 5).cast("int").alias("p"), keys.alias("keys"), contracts.arity_breaks(contract(*VARIANTS[0]), new).alias("breaks"))
    hit = F.filter("breaks", lambda b: contracts.affects(b, C("p"), C("keys"), F.lit(False), F.lit(False), F.lit(0)))
    return told.select("o_orderkey", F.size(hit).alias("hits"), F.concat_ws(",", F.transform("breaks", lambda b: b["test"])).alias("tests"))


@query("""
SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 3 = 0 THEN 'takes 1 arguments, was 2' END, CASE WHEN p_partkey % 3 = 1 THEN 'argument 1: ' || p_brand || ' to X' END, CASE WHEN p_partkey % 5 = 0 THEN 'returns long, was int' END,
  CASE WHEN p_partkey % 2 = 0 THEN 'no longer takes any number of arguments' END, CASE WHEN p_partkey % 7 = 0 THEN 'became static' END, CASE WHEN p_partkey % 4 = 0 THEN 'throws B; throws C' END) AS breaks FROM part
""")
def p15_typed_breaks(spark, read):
    n = lambda k: mod("p_partkey", k)
    made = lambda types, returns, variadic, static, throws: F.struct(types.alias("types"), returns.alias("returns"), variadic.alias("variadic"), static.alias("static"), throws.alias("throws"))
    lit = lambda *w: F.array(*map(F.lit, w))
    both = F.array("p_brand", "p_type")
    old = made(both, F.lit("int"), n(2) == 0, F.lit(False), lit("A"))
    new = made(F.when(n(3) == 0, F.array("p_brand")).when(n(3) == 1, F.array(F.lit("X"), C("p_type"))).otherwise(both), F.when(n(5) == 0, "long").otherwise("int"), F.lit(False), n(7) == 0, F.when(n(4) == 0, lit("C", "A", "B")).otherwise(lit("A")))
    return read("part").select("p_partkey", F.concat_ws("; ", contracts.typed_breaks(old, new)).alias("breaks"))


@query("SELECT p_partkey, p_size % 7 + 1 + p_partkey % 2 AS whole, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 4 + 1 END AS fraction FROM part")
def f13_picture(spark, read):
    pic = cat("S9(", mod("p_size", 7) + 1, ")", F.when(mod("p_partkey", 2) == 1, F.lit("9")).otherwise(F.lit("")), F.when(mod("p_partkey", 3) == 0, F.lit("")).otherwise(cat("V9(", mod("p_size", 4) + 1, ")")))
    d = T.picture_digits(pic)
    return read("part").select("p_partkey", d["whole"].cast("long").alias("whole"), d["fraction"].cast("int").alias("fraction"))


@query("SELECT p_partkey, 'O(' || CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 > 0 THEN '' WHEN p_partkey % 4 = 0 THEN '1' WHEN p_partkey % 4 = 1 THEN 'n' ELSE 'n^' || (p_partkey % 4) END || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' ' END || 'log n' ELSE CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' ' END || 'log^2 n' END || ')' AS cost FROM part")
def f14_big_o(spark, read):
    return read("part").select("p_partkey", T.big_o(mod("p_partkey", 4).cast("int"), mod("p_partkey", 3).cast("int")).alias("cost"))


@query("""
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' ELSE (s // 86400) || ' d ago' END AS ago, CASE WHEN event_id % 4 < 2 THEN array_to_string(range(event_id % 4 + 1), ', ') ELSE '0, 1 and ' || (event_id % 4 - 1) || ' more' END AS items
FROM (SELECT event_id, event_id * event_id % 200000 AS s FROM events)
""")
def f15_words(spark, read):
    s = F.pmod(C("event_id") * C("event_id"), F.lit(200000))
    items = F.transform(F.sequence(F.lit(0).cast("long"), mod("event_id", 4)), lambda x: x.cast("string"))
    return read("events").select("event_id", tools.ago(s).alias("ago"), tools.listing(items, 2).alias("items"))


@query("""
WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
SELECT name, 'd/' || doc_id AS path, CAST(no AS INTEGER) AS line FROM l JOIN (VALUES ('The'), ('la'), ('token'), ('a')) AS n(name) ON regexp_matches(l.line, '(^|[^A-Za-z0-9_])' || name || '($|[^A-Za-z0-9_])')
""")
def f6_mentions(spark, read):
    names = spark.createDataFrame([("The",), ("la",), ("token",), ("a",)], "name string")
    return lines.mentions(read("documents").select(cat("d/", C("doc_id")).alias("path"), "text"), names)


@query("SELECT 'f/' || s_suppkey || '.py' AS path, 'x = \"' || repeat(' ', length(s_name)) || '\" ' || repeat(' ', 2 + length(CAST(s_nationkey AS VARCHAR))) || chr(10) || 'y = 1' AS text FROM supplier")
def f11_masked(spark, read):
    files = read("supplier").select(cat("f/", C("s_suppkey"), ".py").alias("path"), cat('x = "', C("s_name"), '" # ', C("s_nationkey"), "\ny = 1").alias("text"))
    return lines.masked(files).select("path", "text")


CODE = {"py": "import imp\nx = datetime.utcnow()\n# gets(x)", "c": "gets(s);\nregister int i;", "java": "new Integer(3);\nnew Vector<X>();", "js": 'new Buffer(3);\nvar s = "escape(x)";', "f90": "common /blk/ a\n  PAUSE", "cbl": "       ALTER P1 TO P2.\n      *ALTER A TO B"}
MARKERS = {"py": [("py-removed-module", 1), ("py-utcnow", 2)], "c": [("c-gets", 1), ("c-register", 2)], "java": [("java-boxing-constructor", 1), ("java-legacy-collection", 2)], "js": [("js-new-buffer", 1)], "f90": [("f-common", 1), ("f-pause", 2)], "cbl": [("cobol-alter", 1)]}


@query("SELECT 's' || s_suppkey || '.' || suffix AS path, CAST(line AS INTEGER) AS line, rule FROM supplier JOIN (VALUES " + ", ".join(f"({i}, '{k}', {n}, '{r}')" for i, k in enumerate(CODE) for r, n in MARKERS[k]) + ") AS v(i, suffix, line, rule) ON s_suppkey % 6 = i")
def f12_legacy_scan(spark, read):
    """old constructs of six languages, not in comments or texts."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (mod("s_suppkey", 6) + 1).cast("int"))
    files = read("supplier").select(cat("s", C("s_suppkey"), ".", pick(CODE)).alias("path"), pick(CODE.values()).alias("text"))
    return lines.scan(files).select("path", "line", "rule")


HIDDEN = {"py": "m = import_module(name)\neval('1')", "c": "p = dlsym(h, n);\n(*fp)(x);", "java": 'Class.forName(n);\nx.invoke(y);', "js": "require(n);\nt[k](1);", "f90": "external f\nprocedure(g), pointer :: h", "cbl": "           CALL WS-PROG.\n           CALL 'FIXED'."}
HIDING = {"py": [("py-import-by-name", 1), ("py-eval", 2)], "c": [("c-dlsym", 1), ("c-fn-pointer-call", 2)], "java": [("java-for-name", 1), ("java-reflect-invoke", 2)], "js": [("js-require-by-name", 1), ("js-index-call", 2)], "f90": [("f-external-dummy", 1), ("f-procedure-pointer", 2)], "cbl": [("cobol-call-by-name", 1)]}


@query("SELECT 's' || s_suppkey || '.' || suffix AS path, CAST(line AS INTEGER) AS line, rule FROM supplier JOIN (VALUES " + ", ".join(f"({i}, '{k}', {n}, '{r}')" for i, k in enumerate(HIDDEN) for r, n in HIDING[k]) + ") AS v(i, suffix, line, rule) ON s_suppkey % 6 = i")
def f12_hidden_calls(spark, read):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (mod("s_suppkey", 6) + 1).cast("int"))
    files = read("supplier").select(cat("s", C("s_suppkey"), ".", pick(HIDDEN)).alias("path"), pick(HIDDEN.values()).alias("text"))
    return lines.hidden_calls(files)


@query("""
WITH d AS (SELECT 'tests/test_' || doc_id || '.py' AS path, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_-]*') AS w FROM documents WHERE doc_id % 3 <> 0), a(word, context, tier) AS (VALUES ('The', '', 1), ('la', 'de', 0), ('token', '', 0), ('and', 'The', 1)),
h AS (SELECT path, word, tier FROM d, a WHERE list_contains(w, word) AND (context = '' OR list_contains(w, context)))
SELECT path, CAST(min(tier) AS INTEGER) AS tier, string_agg(DISTINCT word, ',' ORDER BY word) AS names FROM h GROUP BY 1
""")
def a7_tests_to_run(spark, read):
    from driftwake.plans import brief

    files = read("documents").select(F.when(mod("doc_id", 3) == 0, cat("lib/m", C("doc_id"), ".py")).otherwise(cat("tests/test_", C("doc_id"), ".py")).alias("path"), "text")
    wanted = spark.createDataFrame([("The", "", 1), ("la", "de", 0), ("token", "", 0), ("and", "The", 1)], "word string, context string, tier int")
    return brief.tests_to_run(files, wanted).withColumn("names", F.concat_ws(",", "names"))


@query("SELECT 's' || s_suppkey AS path, CASE s_suppkey % 3 WHEN 1 THEN 'replace' ELSE 'delete' END AS op, CAST(CASE s_suppkey % 3 WHEN 1 THEN 3 ELSE 2 END AS INTEGER) AS first, CAST(CASE s_suppkey % 3 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS last FROM supplier WHERE s_suppkey % 3 <> 0")
def f10_changed_lines(spark, read):
    s, n = read("supplier"), mod("s_suppkey", 3)
    before = s.select(cat("s", C("s_suppkey")).alias("path"), cat("one\ntwo\n", C("s_name"), "\nfour").alias("text"))
    after = s.select(cat("s", C("s_suppkey")).alias("path"), F.when(n == 0, cat("one\ntwo\n", C("s_name"), "\nfour")).when(n == 1, F.lit("one\ntwo\nother\nfour")).otherwise(cat("one\n", C("s_name"), "\nfour")).alias("text"))
    return lines.changed_lines(before, after)


@query("SELECT 's' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.f90' ELSE '.cbl' END AS path, CAST(2 AS INTEGER) AS line, CAST(CASE s_suppkey % 3 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS first, CAST(3 AS INTEGER) AS last FROM supplier")
def j40_statements(spark, read):
    n = mod("s_suppkey", 3)
    path = F.concat(cat("s", C("s_suppkey")), F.when(n == 0, ".py").when(n == 1, ".f90").otherwise(".cbl"))
    code = F.when(n == 0, "a = 1\nf(b,\n  c)\nd = 2").when(n == 1, "call f(a, &\n  b, &\n  c)\nx = 1").otherwise("     MOVE A TO X.\n     MOVE A\n       TO B.\n     STOP RUN.")
    files = read("supplier").select(path.alias("path"), code.alias("text"))
    return lines.statements(files, files.select("path", F.lit(2).alias("line")))


# ---- references, hierarchies, flags


@query("""
WITH g AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN p_partkey - 1 END AS parent, CASE WHEN p_partkey % 4 = 1 THEN 'm' ELSE 'f' END AS kind, p_name AS name, CASE WHEN p_partkey % 8 = 0 THEN p_brand || (p_partkey // 16) END AS symbol, CASE WHEN p_partkey % 4 = 0 THEN p_type || p_size END AS body, p_size < 5 AS trivial FROM part WHERE p_partkey % 4 < 2),
n AS (SELECT id + 1000000 AS id, parent + 1000000 AS parent, kind, CASE WHEN kind = 'f' AND id % 16 <> 4 THEN name || 'x' ELSE name END AS name, symbol, body, trivial FROM g),
s1 AS (SELECT a.id AS old, b.id AS new FROM (SELECT kind, symbol, min(id) AS id FROM g WHERE symbol IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) a JOIN (SELECT kind, symbol, min(id) AS id FROM n WHERE symbol IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) b USING (kind, symbol)),
g2 AS (SELECT * FROM g WHERE id NOT IN (SELECT old FROM s1)), n2 AS (SELECT * FROM n WHERE id NOT IN (SELECT new FROM s1)),
s2 AS (SELECT a.id AS old, b.id AS new FROM (SELECT kind, name, body, min(id) AS id FROM g2 WHERE body IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1) a JOIN (SELECT kind, name, body, min(id) AS id FROM n2 WHERE body IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1) b USING (kind, name, body)),
g3 AS (SELECT * FROM g2 WHERE id NOT IN (SELECT old FROM s2)), n3 AS (SELECT * FROM n2 WHERE id NOT IN (SELECT new FROM s2)),
s3 AS (SELECT a.id AS old, b.id AS new FROM (SELECT kind, body, min(id) AS id FROM g3 WHERE body IS NOT NULL AND NOT trivial GROUP BY 1, 2 HAVING count(*) = 1) a JOIN (SELECT kind, body, min(id) AS id FROM n3 WHERE body IS NOT NULL AND NOT trivial GROUP BY 1, 2 HAVING count(*) = 1) b USING (kind, body)),
s AS (SELECT old, new, 1 AS stage FROM s1 UNION ALL SELECT old, new, 2 FROM s2 UNION ALL SELECT old, new, 3 FROM s3)
SELECT old, new, CAST(stage AS INTEGER) AS stage FROM s UNION ALL SELECT a.id, b.id, 4 FROM g a JOIN s ON s.old = a.parent JOIN n b ON b.parent = s.new AND b.kind = a.kind AND b.name = a.name
""")
def j4_moves(spark, read):
    k = C("p_partkey")
    member = mod("p_partkey", 4) == 1
    gone = read("part").filter(mod("p_partkey", 4) < 2).select(k.alias("id"), F.when(member, k - 1).alias("parent"), F.when(member, "m").otherwise("f").alias("kind"), C("p_name").alias("name"), F.when(mod("p_partkey", 8) == 0, cat(C("p_brand"), F.floor(k / 16))).alias("symbol"), F.when(~member, cat(C("p_type"), C("p_size"))).alias("body"), (C("p_size") < 5).alias("trivial"))
    new = gone.select((C("id") + 1000000).alias("id"), (C("parent") + 1000000).alias("parent"), "kind", F.when((C("kind") == "f") & (mod("id", 16) != 4), F.concat("name", F.lit("x"))).otherwise(C("name")).alias("name"), "symbol", "body", "trivial")
    return nodes.moves(gone, new)


@query("""
WITH b AS (SELECT c_custkey AS id, c_nationkey AS parent, 'n' || (c_custkey % 50) AS name, c_mktsegment AS body FROM customer), r AS (SELECT id, name FROM b WHERE id % 5 = 0),
a AS (SELECT id, parent, name, CASE WHEN id % 3 = 0 THEN body || 'x' ELSE body END AS body, 'n' || (id % 10) || ' n' || (id % 7 * 5) AS text FROM b WHERE id % 5 <> 0),
e AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 1500 AS dst, CAST(o_orderkey % 97 AS INTEGER) AS line FROM orders)
SELECT DISTINCT e.src, e.dst, e.line FROM e JOIN r ON r.id = e.dst JOIN a ON a.id = e.src JOIN b ON b.id = e.src
WHERE e.src <> e.dst AND a.parent NOT IN (SELECT id FROM r) AND NOT EXISTS (SELECT 1 FROM a x WHERE x.parent = a.parent AND x.name = r.name) AND (a.body = b.body OR list_contains(string_split(a.text, ' '), r.name))
""")
def j14_surviving(spark, read):
    b = read("customer").select(C("c_custkey").alias("id"), C("c_nationkey").cast("long").alias("parent"), cat("n", mod("c_custkey", 50)).alias("name"), C("c_mktsegment").alias("body"), F.lit("").alias("text"))
    a = b.filter(mod("id", 5) != 0).select("id", "parent", "name", F.when(mod("id", 3) == 0, F.concat("body", F.lit("x"))).otherwise(C("body")).alias("body"), cat("n", mod("id", 10), " n", mod("id", 7) * 5).alias("text"))
    e = read("orders").select(C("o_custkey").alias("src"), mod("o_orderkey", 1500).alias("dst"), mod("o_orderkey", 97).cast("int").alias("line"))
    return nodes.surviving_references(e, b.filter(mod("id", 5) == 0).select("id", "name"), b, a)


SITES = "SELECT DISTINCT l_suppkey AS src, l_suppkey * 10 AS start, l_suppkey * 10 + l_linenumber AS line, l_partkey AS col, 'f' || (l_partkey % 7) || '(' || l_returnflag || ')' AS dst FROM lineitem"


@query(f"WITH o AS ({SITES}), n AS (SELECT src, start + 5 AS start, line + 5 AS line, col, CASE WHEN col % 3 = 0 THEN replace(dst, '(A)', '(Z)') WHEN col % 3 = 1 THEN 'g' || dst ELSE dst END AS dst FROM o) SELECT DISTINCT o.src, n.line, o.dst AS was, n.dst AS now FROM o JOIN n ON o.src = n.src AND o.line - o.start = n.line - n.start AND o.col = n.col WHERE o.dst <> n.dst AND split_part(o.dst, '(', 1) = split_part(n.dst, '(', 1)")
def j15_rebound(spark, read):
    o = read("lineitem").select(C("l_suppkey").alias("src"), (C("l_suppkey") * 10).alias("start"), (C("l_suppkey") * 10 + C("l_linenumber")).alias("line"), C("l_partkey").alias("col"), cat("f", mod("l_partkey", 7), "(", C("l_returnflag"), ")").alias("dst")).distinct()
    n = o.select("src", (C("start") + 5).alias("start"), (C("line") + 5).alias("line"), "col", F.when(mod("col", 3) == 0, F.replace(C("dst"), F.lit("(A)"), F.lit("(Z)"))).when(mod("col", 3) == 1, F.concat(F.lit("g"), "dst")).otherwise(C("dst")).alias("dst"))
    return contracts.rebound_calls(o, n).distinct()


@query("SELECT p_partkey AS src, s_suppkey AS dst, 's' || (p_partkey % 40) AS symbol, CAST(least(p_partkey % 10 / 10, 0.8) AS DOUBLE) AS confidence FROM part JOIN supplier ON p_partkey % 40 = s_suppkey % 40 WHERE (p_partkey % 2 = 0) <> (s_suppkey % 3 = 0)")
def j16_linked(spark, read):
    lang = lambda c: F.when(c, "java").otherwise("c")
    i = read("part").select(cat("s", mod("p_partkey", 40)).alias("symbol"), C("p_partkey").alias("node"), lang(mod("p_partkey", 2) == 0).alias("lang"), (mod("p_partkey", 10) / 10).alias("confidence"))
    e = read("supplier").select(cat("s", mod("s_suppkey", 40)).alias("symbol"), C("s_suppkey").alias("node"), lang(mod("s_suppkey", 3) == 0).alias("lang"))
    return contracts.linked_by_symbol(i, e)


@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS callee, l_linenumber AS position, l_partkey AS routine FROM lineitem), d AS (SELECT s_suppkey AS callee, CAST(s_suppkey % 7 + 1 AS INTEGER) AS position, 'd' || (s_suppkey % 5) AS name FROM supplier),
c AS (SELECT DISTINCT o_custkey % 100 + 1 AS src, 'd' || (o_orderkey % 5) AS name, CAST(o_orderkey % 50 AS INTEGER) AS line FROM orders)
SELECT DISTINCT c.src, routine AS dst, line FROM p JOIN d USING (callee, position) JOIN c ON c.src = callee AND c.name = d.name WHERE c.src <> routine
""")
def j17_through_arguments(spark, read):
    p = read("lineitem").select(C("l_suppkey").alias("callee"), C("l_linenumber").alias("position"), C("l_partkey").alias("routine"))
    d = read("supplier").select(C("s_suppkey").alias("callee"), (mod("s_suppkey", 7) + 1).cast("int").alias("position"), cat("d", mod("s_suppkey", 5)).alias("name"))
    c = read("orders").select((mod("o_custkey", 100) + 1).alias("src"), cat("d", mod("o_orderkey", 5)).alias("name"), mod("o_orderkey", 50).cast("int").alias("line"))
    return contracts.through_arguments(p.distinct(), d, c.distinct())


@query("SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst, 'reads' AS kind, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END AS INTEGER) AS line FROM lineitem WHERE l_returnflag = 'R'")
def j18_copied(spark, read):
    i = read("lineitem").select(C("l_orderkey").alias("src"), C("l_suppkey").alias("dst"), F.when(C("l_returnflag") == "R", "copy").otherwise("import").alias("kind"), F.when(mod("l_linenumber", 3) != 0, C("l_linenumber")).alias("line"))
    return nodes.copied_as_reads(i)


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS site, l_suppkey % 25 AS callee, l_linenumber AS position, max(l_returnflag) OVER w AS type, CAST(max(l_quantity) OVER w AS INTEGER) AS size FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_suppkey % 25, l_linenumber)),
p AS (SELECT n_nationkey AS callee, q AS position, substr('ANR', CAST((n_nationkey + q) % 3 + 1 AS INTEGER), 1) AS type, CAST(n_nationkey * q % 30 AS INTEGER) AS size FROM nation, range(1, 8) r(q) WHERE q <= 4 + n_nationkey % 4), o AS (SELECT callee, position, type, size // 2 AS size FROM p),
n1 AS (SELECT site, callee, 'passes ' || max(position) || ' of ' || any_value(t) AS reason FROM a JOIN (SELECT callee, max(position) AS t FROM p GROUP BY 1) USING (callee) GROUP BY 1, 2 HAVING max(position) <> any_value(t)
  UNION ALL SELECT site, callee, 'argument ' || position || ': ' || CASE WHEN a.type <> p.type THEN a.type || ' for ' || p.type ELSE a.size || ' bytes for ' || p.size END FROM a JOIN p USING (callee, position) WHERE a.type <> p.type OR a.size < p.size),
o1 AS (SELECT site, callee, 'passes ' || max(position) || ' of ' || any_value(t) AS reason FROM a JOIN (SELECT callee, max(position) AS t FROM o GROUP BY 1) USING (callee) WHERE site % 2 = 0 GROUP BY 1, 2 HAVING max(position) <> any_value(t)
  UNION ALL SELECT site, callee, 'argument ' || position || ': ' || CASE WHEN a.type <> o.type THEN a.type || ' for ' || o.type ELSE a.size || ' bytes for ' || o.size END FROM a JOIN o USING (callee, position) WHERE site % 2 = 0 AND (a.type <> o.type OR a.size < o.size))
SELECT site, callee, reason FROM n1 ANTI JOIN o1 USING (site, callee, reason)
""")
def j28_arguments(spark, read):
    """Calls whose arguments do not fit, and did."""
    a = read("lineitem").groupBy(C("l_orderkey").alias("site"), mod("l_suppkey", 25).alias("callee"), C("l_linenumber").alias("position")).agg(F.max("l_returnflag").alias("type"), F.max("l_quantity").cast("int").alias("size"))
    n = read("nation").select(C("n_nationkey").cast("long").alias("callee"), F.explode(F.sequence(F.lit(1), (4 + mod("n_nationkey", 4)).cast("int"))).alias("position"))
    p = n.select("callee", "position", F.substring(F.lit("ANR"), (F.pmod(C("callee") + C("position"), F.lit(3)) + 1).cast("int"), F.lit(1)).alias("type"), F.pmod(C("callee") * C("position"), F.lit(30)).cast("int").alias("size"))
    return contracts.argument_mismatches(a, p, a.filter(mod("site", 2) == 0), p.withColumn("size", F.floor(C("size") / 2).cast("int")))


@query("""
WITH b AS (SELECT c_custkey AS id, c_custkey // 10 AS parent, c_mktsegment AS signature, c_nationkey AS value FROM customer WHERE c_custkey % 13 <> 0),
a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END AS signature, CASE WHEN c_custkey % 6 = 0 THEN -1 ELSE c_nationkey END AS value FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey // 10 % 5 <> 0)
SELECT id, 'removed' AS change FROM b WHERE id NOT IN (SELECT id FROM a) AND parent NOT IN (SELECT id FROM b WHERE id NOT IN (SELECT id FROM a))
UNION ALL SELECT id, 'added' FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT a.id, 'signature' FROM a JOIN b USING (id) WHERE a.signature <> b.signature UNION ALL SELECT a.id, 'value' FROM a JOIN b USING (id) WHERE a.value <> b.value
""")
def j30_node_changes(spark, read):
    k = C("c_custkey")
    side = read("customer").select(k.alias("id"), F.floor(k / 10).alias("parent"), F.lit("class").alias("kind"), C("c_mktsegment").alias("signature"), F.lit("").alias("decorators"), C("c_nationkey").alias("value"), F.lit("").alias("body"), F.lit("").alias("doc"))
    after = side.filter((mod("id", 5) != 0) & (mod("parent", 5) != 0)).withColumn("signature", F.when(mod("id", 4) == 0, "X").otherwise(C("signature"))).withColumn("value", F.when(mod("id", 6) == 0, -1).otherwise(C("value")))
    return nodes.node_changes(side.filter(mod("id", 13) != 0), after)


@query("""
WITH f AS (SELECT CAST(c_nationkey AS BIGINT) AS cls, 'f' || (c_custkey % 9) AS name, min(c_custkey) AS ord, count(*) % 2 = 0 AS d FROM customer GROUP BY 1, 2),
x AS (SELECT cls, 0 AS depth, ord, name, d FROM f UNION ALL SELECT n_nationkey, 1, ord, name, d FROM nation JOIN f ON f.cls = n_nationkey % 5 WHERE n_nationkey >= 5),
p AS (SELECT cls, name, depth, ord, first_value(d) OVER (PARTITION BY cls, name ORDER BY depth) AS has, row_number() OVER (PARTITION BY cls, name ORDER BY depth DESC) AS n FROM x)
SELECT cls, string_agg(name, ',' ORDER BY depth DESC, ord) AS positional, CAST(count(*) FILTER (NOT has) AS INTEGER) AS required FROM p WHERE n = 1 GROUP BY 1
""")
def j31_constructors(spark, read):
    f = read("customer").groupBy(C("c_nationkey").cast("long").alias("cls"), cat("f", mod("c_custkey", 9)).alias("name")).agg(F.min("c_custkey").alias("ord"), (F.count("*") % 2 == 0).alias("has_default"))
    b = read("nation").filter("n_nationkey >= 5").select(C("n_nationkey").cast("long").alias("cls"), mod("n_nationkey", 5).cast("long").alias("base"), F.lit(1).alias("depth"))
    return contracts.constructor_contracts(f, b).withColumn("positional", F.concat_ws(",", "positional"))


SUBTYPES = "SELECT n_nationkey % 5 AS base, n_nationkey AS cls FROM nation WHERE n_nationkey >= 5"


@query(f"""
WITH s AS ({SUBTYPES}), m AS (SELECT c_nationkey AS cls, 'm' || (c_custkey % 11) AS method, bool_or(c_mktsegment = 'BUILDING') AS abstract FROM customer GROUP BY 1, 2)
SELECT s.cls, method FROM s, (SELECT 'm' || x AS method FROM range(11) r(x)) WHERE s.cls % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.method = method AND NOT abstract AND (m.cls = s.cls OR m.cls = s.base)) AND s.base <> 2
""".replace("m.method = method", "m.method = r2.method").replace("FROM range(11) r(x)) WHERE", "FROM range(11) r(x)) r2 WHERE").replace("SELECT s.cls, method", "SELECT DISTINCT s.cls, r2.method"))
def j32_implementations(spark, read):
    s = read("nation").filter("n_nationkey >= 5").select(mod("n_nationkey", 5).alias("base"), C("n_nationkey").alias("cls"))
    m = read("customer").groupBy(C("c_nationkey").alias("cls"), cat("m", mod("c_custkey", 11)).alias("method")).agg(F.bool_or(C("c_mktsegment") == "BUILDING").alias("abstract"))
    new = spark.range(5).filter("id <> 2").select(C("id").cast("int").alias("base"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda x: F.concat(F.lit("m"), x.cast("string")))).alias("method"))
    classes = read("nation").select(C("n_nationkey").alias("cls"), (mod("n_nationkey", 4) == 0).alias("abstract"))
    return nodes.missing_implementations(new, s, classes, m)


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS u, l_partkey AS id, CASE l_returnflag WHEN 'R' THEN 'overrides' WHEN 'A' THEN 'instantiates' ELSE 'calls' END AS how FROM lineitem)
SELECT DISTINCT id, CASE WHEN id % 6 = 0 AND how = 'overrides' THEN 'became final' WHEN id % 10 = 0 AND how = 'instantiates' THEN 'became abstract' ELSE 'changed between static and not' END AS reason, u AS user
FROM e WHERE (id % 6 = 0 AND how = 'overrides') OR (id % 10 = 0 AND how = 'instantiates') OR (id % 7 = 0 AND how = 'calls')
""")
def j33_flips(spark, read):
    n = lambda k: mod("p_partkey", k) == 0
    b = read("part").select(C("p_partkey").alias("id"), n(12).alias("x")).select("id", F.lit(False).alias("final"), F.lit(False).alias("abstract"), (mod("id", 2) == 0).alias("static"))
    a = read("part").select(C("p_partkey").alias("id"), n(6).alias("final"), n(10).alias("abstract"), ((mod("p_partkey", 2) == 0) != n(7)).alias("static"))
    e = read("lineitem").select(C("l_orderkey").alias("src"), C("l_partkey").alias("dst"), F.when(C("l_returnflag") == "R", "overrides").when(C("l_returnflag") == "A", "instantiates").otherwise("calls").alias("kind"))
    return nodes.flag_flips(b, a, e)


@query(f"""
WITH s AS ({SUBTYPES}), n AS (SELECT c_custkey AS id, c_nationkey AS owner, c_nationkey % 5 AS top, c_nationkey % 3 AS package, c_custkey % 4 AS was, least(c_custkey % 4, c_custkey % 3) AS now FROM customer),
e AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 1500 AS dst FROM orders)
SELECT DISTINCT t.id, f.id AS user FROM e JOIN n t ON t.id = dst JOIN n f ON f.id = src WHERE t.now < t.was
  AND CASE t.now WHEN 0 THEN t.top <> f.top WHEN 1 THEN t.package <> f.package ELSE t.package <> f.package AND NOT EXISTS (SELECT 1 FROM s WHERE s.base = t.owner AND s.cls = f.owner) END
""")
def j34_narrowed(spark, read):
    word = lambda c: F.element_at(F.array(*map(F.lit, nodes.LEVELS)), (c + 1).cast("int"))
    side = lambda v: read("customer").select(C("c_custkey").alias("id"), C("c_nationkey").alias("owner"), mod("c_nationkey", 5).alias("top"), mod("c_nationkey", 3).alias("package"), word(v).alias("visibility"))
    s = read("nation").filter("n_nationkey >= 5").select(mod("n_nationkey", 5).alias("base"), C("n_nationkey").alias("cls"))
    e = read("orders").select(C("o_custkey").alias("src"), mod("o_orderkey", 1500).alias("dst")).distinct()
    return nodes.narrowed(side(mod("c_custkey", 4)), side(F.least(mod("c_custkey", 4), mod("c_custkey", 3))), e, s)


@query("SELECT n_nationkey AS cls, CAST(n_regionkey AS INTEGER) AS base FROM nation WHERE n_nationkey % 2 = 0")
def j35_permits(spark, read):
    n = read("nation").select(C("n_nationkey").alias("cls"), C("n_regionkey").alias("base"))
    permits = lambda df: df.groupBy("base").agg(F.collect_list("cls").alias("permits"))
    return nodes.no_longer_permitted(permits(n), permits(n.filter(mod("cls", 2) == 1)), n)


@query("SELECT p_partkey AS method, p_partkey + 1 AS was FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 5 <> 0")
def j36_lost_overrides(spark, read):
    p = read("part").select(C("p_partkey").alias("method"), (C("p_partkey") + 1).alias("base_method"))
    return nodes.lost_overrides(p.filter(mod("method", 2) == 0), p.filter((mod("method", 2) == 0) & (mod("method", 3) != 0)), p.filter(mod("method", 5) != 0).select("method"))


@query("""
SELECT DISTINCT 'o' || (l_partkey % 50) AS owner, l_partkey AS field, 'f' || (l_suppkey % 20) AS path, CAST(l_orderkey % 90 AS INTEGER) AS line FROM lineitem
WHERE l_suppkey % 20 % 4 <> 0 AND (l_partkey % 6 = 0 OR (l_partkey % 7 = 0 AND l_linenumber % 2 = 0))
""")
def j37_field_users(spark, read):
    f = read("part").select(cat("o", mod("p_partkey", 50)).alias("owner"), C("p_partkey").alias("field"), C("p_type").alias("type"), C("p_partkey").alias("pos"))
    a = f.withColumn("type", F.when(mod("field", 6) == 0, "X").otherwise(C("type"))).withColumn("pos", F.when(mod("field", 7) == 0, C("pos") + 1).otherwise(C("pos")))
    u = read("lineitem").select(cat("o", mod("l_partkey", 50)).alias("owner"), C("l_partkey").alias("field"), cat("f", mod("l_suppkey", 20)).alias("path"), mod("l_orderkey", 90).cast("int").alias("line"), (mod("l_linenumber", 2) == 0).alias("by_place"))
    return nodes.users_of_changed_fields(f, a, u, spark.range(5).select(cat("f", C("id") * 4).alias("path")))


@query("""
WITH d AS (SELECT p_size AS name, min(p_brand) AS s FROM part GROUP BY 1 HAVING count(*) <= 40) SELECT p_size AS name, 'p' || p_partkey AS path, p_brand AS declared, s AS defined FROM part JOIN d ON name = p_size WHERE p_brand <> s
""".replace("HAVING count(*) <= 40", ""))
def j37_prototypes(spark, read):
    p = read("part").select(C("p_size").alias("name"), cat("p", C("p_partkey")).alias("path"), C("p_brand").alias("signature"))
    return nodes.prototype_mismatches(p, p.groupBy("name").agg(F.min("signature").alias("signature")))


@query("""
WITH e AS (SELECT 'f' || (l_suppkey % 50) AS path, CAST(l_orderkey % 200 AS INTEGER) AS line, l_partkey AS uses, min(struct_pack(who := l_suppkey, how := CASE WHEN l_returnflag = 'A' THEN 'calls (a guess)' ELSE 'calls' END)) AS u FROM lineitem WHERE l_partkey % 9 = 0 AND l_partkey % 2 = 0 GROUP BY 1, 2, 3)
SELECT path, line, u.who, uses, u.how FROM e WHERE NOT (line % 20 BETWEEN 0 AND 5 AND line >= 20)
""")
def j38_unchanged_uses(spark, read):
    e = read("lineitem").select(C("l_suppkey").alias("src"), C("l_partkey").alias("dst"), F.lit("calls").alias("kind"), cat("f", mod("l_suppkey", 50)).alias("path"), mod("l_orderkey", 200).cast("int").alias("line"), (C("l_returnflag") == "A").alias("guess"))
    p = read("part").select(C("p_partkey").alias("name"))
    cover = spark.range(50).select(cat("f", C("id")).alias("path"), F.explode(F.sequence(F.lit(20), F.lit(180), F.lit(20))).alias("first")).withColumn("last", C("first") + 5)
    return worklist.unchanged_uses(p.filter(mod("name", 9) == 0), e, p.filter(mod("name", 2) == 0), cover)


@query("""
WITH f AS (SELECT DISTINCT source || '/sub/F' || (doc_id % 30) || '.H' AS target, 'f' || (doc_id % 30) || '.h' AS base FROM documents), i AS (SELECT source || '/a' || doc_id AS path, CAST(doc_id % 9 AS INTEGER) AS line, 'f' || (doc_id % 40) || '.h' AS base, source FROM documents)
SELECT path, line, target FROM (SELECT path, line, target, row_number() OVER (PARTITION BY path, line ORDER BY NOT starts_with(target, source), length(target), target) AS n FROM i JOIN f USING (base)) WHERE n = 1
""")
def j39_includes(spark, read):
    d = read("documents")
    i = d.select(cat(C("source"), "/a", C("doc_id")).alias("path"), mod("doc_id", 9).cast("int").alias("line"), cat("inc\\f", mod("doc_id", 40), ".h").alias("named"))
    return worklist.include_targets(i, d.select(cat(C("source"), "/sub/F", mod("doc_id", 30), ".H").alias("path")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 100 >= 60 THEN 'c' WHEN c_custkey % 100 BETWEEN 30 AND 50 THEN 'b' ELSE 'a' END AS name FROM customer")
def j41_cursor(spark, read):
    d = read("nation").select(C("n_nationkey").alias("path"), F.explode(F.array(F.struct(F.lit("a").alias("name"), F.lit(0).alias("line"), F.lit(None).cast("int").alias("end_line")), F.struct(F.lit("b").alias("name"), F.lit(30).alias("line"), F.lit(50).alias("end_line")), F.struct(F.lit("c").alias("name"), F.lit(60).alias("line"), F.lit(None).cast("int").alias("end_line")))).alias("d")).select("path", "d.*")
    return tools.cursor_definition(d, read("customer").select(C("c_custkey").alias("id"), C("c_nationkey").alias("path"), mod("c_custkey", 100).cast("int").alias("line")))


# ---- layouts, ranges, moves


@query("""
WITH b AS (SELECT p_brand AS owner, p_partkey AS f, p_partkey // 40 AS off, p_size AS size FROM part), a AS (SELECT owner, CASE WHEN f % 20 = 3 THEN f + 1000000 ELSE f END AS f, CASE WHEN f % 7 = 0 THEN off + 4 ELSE off END AS off, CASE WHEN f % 11 = 0 THEN size + 1 ELSE size END AS size FROM b WHERE f % 13 <> 0),
j AS (SELECT coalesce(b.owner, a.owner) AS owner, coalesce(b.f, a.f) AS f, CASE WHEN a.f IS NULL THEN 'removed' WHEN b.f IS NULL THEN 'added' WHEN a.off <> b.off THEN 'offset' WHEN a.size <> b.size THEN 'size' END AS change, coalesce(a.off, b.off) AS o, coalesce(a.size, b.size) AS z FROM b FULL JOIN a ON a.owner = b.owner AND a.f = b.f),
r AS (SELECT owner, o, z, min(f) AS f FROM j WHERE change = 'removed' GROUP BY 1, 2, 3 HAVING count(*) = 1), n AS (SELECT owner, o, z, min(f) AS f FROM j WHERE change = 'added' GROUP BY 1, 2, 3 HAVING count(*) = 1),
same AS (SELECT r.owner, r.f AS x, n.f AS y FROM r JOIN n USING (owner, o, z))
SELECT owner, 'F' || f AS field, change FROM j WHERE change IS NOT NULL AND (owner, f) NOT IN (SELECT (owner, x) FROM same) AND (owner, f) NOT IN (SELECT (owner, y) FROM same)
""")
def r_copybook_layout_changed(spark, read):
    """copybook-layout-changed and struct-layout-change."""
    k = C("p_partkey")
    b = read("part").select(C("p_brand").alias("owner"), k.alias("f"), F.floor(k / 40).alias("offset"), C("p_size").alias("size"))
    a = b.filter(mod("f", 13) != 0).select("owner", F.when(mod("f", 20) == 3, C("f") + 1000000).otherwise(C("f")).alias("f"), F.when(mod("f", 7) == 0, C("offset") + 4).otherwise(C("offset")).alias("offset"), F.when(mod("f", 11) == 0, C("size") + 1).otherwise(C("size")).alias("size"))
    named = lambda df: df.withColumn("field", cat("F", C("f")))
    return layouts.layout_changes(named(b), named(a), ("offset", "size"))


@query("SELECT owner, CASE WHEN f % 13 = 0 THEN 'removed' WHEN f % 7 = 0 THEN 'offset' ELSE 'type' END AS change, 'F' || f AS field FROM (SELECT p_brand AS owner, p_partkey AS f FROM part) WHERE f % 13 = 0 OR f % 7 = 0 OR f % 11 = 0")
def r_struct_layout_change(spark, read):
    """struct-layout-change: fields that went, moved or have another type; in C a renamed field is another one."""
    k = C("p_partkey")
    b = read("part").select(C("p_brand").alias("owner"), cat("F", k).alias("field"), k.alias("f"), k.alias("offset"), C("p_type").alias("type"))
    a = b.filter(mod("f", 13) != 0).withColumn("offset", F.when(mod("f", 7) == 0, C("offset") + 4).otherwise(C("offset"))).withColumn("type", F.when(mod("f", 11) == 0, "X").otherwise(C("type")))
    return layouts.layout_changes(b, a, ("offset", "type"), rename_is_fine=False)


@query("SELECT p_brand AS owner, p_partkey AS member, p_size AS was, p_size + 1 AS now FROM part WHERE p_partkey % 9 = 0")
def r_enum_values_shifted(spark, read):
    b = read("part").select(C("p_brand").alias("owner"), C("p_partkey").alias("member"), C("p_size").alias("value"))
    return layouts.shifted_values(b, b.withColumn("value", F.when(mod("member", 9) == 0, C("value") + 1).otherwise(C("value"))))


WEEKS = "SELECT DISTINCT event_type AS m, user_id || '/' || (extract(day FROM ts) - 1) // 7 AS h, user_id % 3 = 0 AS d FROM events"


def weeks(read):
    holder = cat(C("user_id"), "/", F.floor((F.dayofmonth("ts") - 1) / 7))
    return read("events").select(F.lit("E").alias("owner"), holder.alias("holder"), C("event_type").alias("member"), (mod("user_id", 3) == 0).alias("has_default")).distinct()


@query(f"WITH c AS ({WEEKS}), o AS (SELECT DISTINCT m FROM c WHERE m NOT IN ('view', 'error')) SELECT 'E' AS owner, h AS holder, CASE WHEN bool_or(m = 'view') THEN 'error' WHEN bool_or(m = 'error') THEN 'view' ELSE 'error,view' END AS missing FROM c WHERE NOT d GROUP BY h HAVING count(*) FILTER (m IN (SELECT m FROM o)) = (SELECT count(*) FROM o) AND NOT (bool_or(m = 'view') AND bool_or(m = 'error'))")
def r_unhandled_new_member(spark, read):
    s = weeks(read)
    members = s.select("owner", "member").distinct()
    return layouts.unhandled_new_members(members.filter("member NOT IN ('view', 'error')"), members, s).withColumn("missing", F.concat_ws(",", "missing"))


@query(f"""
WITH c AS ({WEEKS}), t AS (SELECT DISTINCT m FROM c), h AS (SELECT DISTINCT h FROM c WHERE NOT d AND m <> 'view')
SELECT 'E' AS owner, h AS holder, 'view' AS missing FROM h WHERE ascii(right(h, 1)) % 2 = 1 AND h IN (SELECT h FROM c WHERE m = 'view' AND NOT d)
""")
def r_non_exhaustive_match(spark, read):
    """Weeks that lose their views: what they already missed is no news."""
    s = weeks(read)
    edited = s.select("holder").distinct().filter(F.ascii(F.right("holder", F.lit(1))) % 2 == 1)
    return layouts.non_exhaustive(s.select("owner", "member").distinct(), s, s.filter("member <> 'view'"), edited).withColumn("missing", F.concat_ws(",", "missing"))


PICS = "SELECT p_partkey AS f, p_size % 7 + 1 AS w0, p_size % 3 AS d0, (p_size + p_partkey) % 9 + 1 AS w1, p_size % 3 AS d1, p_partkey % 5 = 0 AS t FROM part"


@query(f"""
WITH p AS ({PICS}), m AS (SELECT l_orderkey || '/' || l_linenumber AS stmt, l_partkey AS src, l_suppkey * 3 + 1 AS dst FROM lineitem), o AS (SELECT DISTINCT m.* FROM m JOIN (SELECT stmt FROM m GROUP BY 1 HAVING count(DISTINCT src) = 1) USING (stmt) WHERE src % 4 <> 0)
SELECT stmt, src, dst, lost, lost_before FROM (SELECT stmt, src, dst, CAST(CASE WHEN a.t = b.t THEN greatest(a.w1 - b.w1, 0) + CASE WHEN a.t THEN 0 ELSE greatest(a.d1 - b.d1, 0) END ELSE 0 END AS INTEGER) AS lost,
  CAST(CASE WHEN a.t = b.t THEN greatest(a.w0 - b.w0, 0) + CASE WHEN a.t THEN 0 ELSE greatest(a.d0 - b.d0, 0) END ELSE 0 END AS INTEGER) AS lost_before FROM o JOIN p a ON a.f = src JOIN p b ON b.f = dst) WHERE lost > lost_before
""")
def j27_capacity(spark, read):
    """J27, move-truncates, through picture_digits."""
    whole = lambda n, d: F.when(mod("p_partkey", 5) == 0, cat("X(", n, ")")).otherwise(F.concat(cat("S9(", n, ")"), F.when(d > 0, cat("V9(", d, ")")).otherwise("")))
    side = lambda n: read("part").select(C("p_partkey").alias("field"), whole(n, mod("p_size", 3)).alias("pic"))
    m = read("lineitem").select(cat(C("l_orderkey"), "/", C("l_linenumber")).alias("stmt"), C("l_partkey").alias("src"), (C("l_suppkey") * 3 + 1).alias("dst"))
    return layouts.truncating_moves(m, m.filter(mod("src", 4) != 0), side(mod("p_size", 7) + 1), side(F.pmod(C("p_size") + C("p_partkey"), F.lit(9)) + 1))


@query("""
WITH e AS (SELECT conv_id, min(turn) AS a, max(turn) AS z FROM conversations WHERE role = 'user' AND turn % 3 <> 2 GROUP BY 1 HAVING min(turn) < max(turn))
SELECT conv_id AS range, string_agg('t' || turn, ',' ORDER BY turn) AS lost FROM conversations JOIN e USING (conv_id) WHERE turn BETWEEN a AND z AND turn % 3 = 2 GROUP BY 1
""")
def r_perform_thru_range_changed(spark, read):
    c = read("conversations").select(C("conv_id").alias("program"), C("turn").alias("ord"), cat("t", C("turn")).alias("name"), "role")
    after = c.filter(mod("ord", 3) != 2)
    r = after.filter("role = 'user'").groupBy("program").agg(F.min_by("name", "ord").alias("first"), F.max_by("name", "ord").alias("last"), F.min("ord").alias("a"), F.max("ord").alias("z")).filter("a < z").select(C("program").alias("range"), "program", "first", "last")
    order = lambda x: F.array_sort(x)
    return layouts.range_changes(c, after, r).select("range", F.concat_ws(",", order(F.col("lost"))).alias("lost"))


@query("""
WITH b AS (SELECT conv_id AS program, turn, 't' || turn AS name FROM conversations WHERE turn % 4 <> 1), a AS (SELECT conv_id AS program, turn, 't' || turn AS name, turn % 8 = 1 AS skip FROM conversations WHERE turn % 4 <> 3),
x AS (SELECT program, name, turn, lead(name) OVER (PARTITION BY program ORDER BY turn) AS was FROM b), y AS (SELECT a.program, a.name, (SELECT s.name FROM a s WHERE s.program = a.program AND s.turn > a.turn AND NOT s.skip ORDER BY s.turn LIMIT 1) AS now FROM a)
SELECT program, name, was, now FROM x JOIN y USING (program, name) WHERE was IS DISTINCT FROM now AND turn % 5 <> 0
""")
def r_fall_through_changed(spark, read):
    """Paragraphs that came in between and are empty are passed through."""
    c = read("conversations").select(C("conv_id").alias("program"), C("turn").alias("ord"), cat("t", C("turn")).alias("name"), (mod("turn", 8) == 1).alias("empty"), (mod("turn", 5) == 0).alias("leaves"))
    return layouts.fall_through_changes(c.filter(mod("ord", 4) != 1), c.filter(mod("ord", 4) != 3))


@query("""
WITH b AS (SELECT DISTINCT user_id % 100 AS p, event_type || event_id % 9 AS t FROM events WHERE ts < TIMESTAMP '2024-01-16'), a AS (SELECT DISTINCT user_id % 100 AS p, event_type || event_id % 9 AS t FROM events WHERE ts >= TIMESTAMP '2024-01-16')
SELECT p AS program, string_agg(t, ',' ORDER BY t) AS tags FROM a WHERE p IN (SELECT p FROM b) AND (p, t) NOT IN (SELECT (p, t) FROM b) GROUP BY 1
""")
def r_legacy_construct_introduced(spark, read):
    e = read("events").select(mod("user_id", 100).alias("program"), cat(C("event_type"), mod("event_id", 9)).alias("tag"), (C("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("old"))
    return layouts.introduced(e.filter("old").select("program", "tag"), e.filter("NOT old").select("program", "tag")).withColumn("tags", F.concat_ws(",", "tags"))


FIRST = "SELECT user_id AS routine, event_type || event_id % 5 AS name, min(event_id) AS e FROM events {} GROUP BY 1, 2"


@query(f"WITH n AS ({FIRST.format('')}), o AS ({FIRST.format('WHERE event_id % 3 = 0')}) SELECT routine, name FROM n WHERE e % 2 = 0 AND routine % 4 <> 0 AND (routine, name) NOT IN (SELECT (routine, name) FROM o WHERE e % 2 = 0 AND routine % 4 <> 0)")
def r_reads_unset_local(spark, read):
    """reads-unset-local and intent-out-read-before-write, new ones only."""
    a = read("events").select(C("user_id").alias("routine"), cat(C("event_type"), mod("event_id", 5)).alias("name"), C("event_id").alias("ord"), C("event_id").alias("line"), (mod("event_id", 2) == 1).alias("writes"))
    declared = a.filter(mod("routine", 4) != 0).select("routine", "name").distinct()
    hazards = lambda x: layouts.read_before_write(x, declared)
    return layouts.new_findings(hazards(a.filter(mod("ord", 3) == 0)), hazards(a), ["routine", "name"]).select("routine", "name")


@query("SELECT user_id AS function, event_id AS ord FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS above FROM events) WHERE above IN ('error', 'purchase') AND event_id % 7 <> 0")
def r_unreachable_statement(spark, read):
    kind = F.when(C("event_type") == "error", "goto").when(C("event_type") == "purchase", "return").otherwise("expr")
    s = read("events").select(C("user_id").alias("function"), mod("event_id", 3).alias("block"), C("event_id").alias("ord"), C("event_id").alias("line"), kind.alias("kind"), F.when(mod("event_id", 7) == 0, "l").alias("label"))
    return layouts.unreachable_statements(s).select("function", "ord")


MAJOR = "c AS (SELECT b, l, count(*) AS n, min(u) AS f FROM {0} GROUP BY 1, 2), x AS (SELECT b, l AS usual FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, f) AS r FROM c) WHERE r = 1)"


@query("""
WITH a AS (SELECT c_nationkey AS b, c_mktsegment AS l, c_custkey AS u FROM customer), o AS (SELECT b, l, u FROM a WHERE u % 3 <> 0),
ca AS (SELECT b, l, count(*) AS n, min(u) AS f FROM a GROUP BY 1, 2), xa AS (SELECT b, l AS usual FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, f) AS r FROM ca) WHERE r = 1),
co AS (SELECT b, l, count(*) AS n, min(u) AS f FROM o GROUP BY 1, 2), xo AS (SELECT b, l AS usual FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, f) AS r FROM co) WHERE r = 1)
SELECT b AS block, u AS unit, l AS layout, usual FROM a JOIN xa USING (b) WHERE l <> usual AND (b, u) NOT IN (SELECT (b, u) FROM o JOIN xo USING (b) WHERE l <> usual)
""")
def r_common_layout_mismatch(spark, read):
    a = read("customer").select(C("c_nationkey").alias("block"), C("c_custkey").alias("unit"), C("c_mktsegment").alias("layout"))
    return layouts.layout_mismatches(a.filter(mod("unit", 3) != 0), a).select("block", "unit", "layout", "usual")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey // 3 > 0), r(node, d) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 200 = 7 UNION ALL SELECT e.src, d + 1 FROM r JOIN e ON e.dst = r.node)
SELECT node AS program, CAST(min(d) AS INTEGER) AS hops FROM r WHERE d > 0 AND node % 2 = 0 GROUP BY 1
""")
def g8_copiers(spark, read):
    k = C("p_partkey")
    e = read("part").select(k.alias("src"), F.floor(k / 3).alias("dst")).filter("dst > 0")
    return layouts.copiers(e, read("part").filter(mod("p_partkey", 200) == 7).select(k.alias("node")), read("part").filter(mod("p_partkey", 2) == 0).select(k.alias("node")))


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS cls, p_partkey // 3 AS base FROM part WHERE p_partkey // 3 > 0), r(node, d) AS (SELECT 2::BIGINT, 0 UNION ALL SELECT e.cls, d + 1 FROM r JOIN e ON e.base = r.node)
SELECT node, CAST(min(d) AS INTEGER) AS hops FROM r WHERE d > 0 GROUP BY 1
""")
def g9_hierarchy(spark, read):
    k = C("p_partkey")
    return layouts.hierarchy(read("part").select(k.alias("cls"), F.floor(k / 3).alias("base")).filter("base > 0"), spark.createDataFrame([(2,)], "node long"))


# ---- maps, lists, counts


@query("SELECT CASE p_partkey % 5 WHEN 0 THEN 'java' WHEN 1 THEN 'fortran' WHEN 2 THEN 'cpp' ELSE 'python' END AS language, count(*) AS files FROM part GROUP BY 1")
def a8_coverage(spark, read):
    n = mod("p_partkey", 5)
    return worklist.coverage(read("part").select(cat("x", C("p_partkey"), F.when(n == 0, F.lit(".java")).when(n == 1, F.lit(".F90")).when(n == 2, F.lit(".hpp")).when(n == 3, F.lit(".py")).otherwise(F.lit(".txt"))).alias("path")))


@query("SELECT node, count(*) AS degree FROM (SELECT o_custkey AS node FROM orders UNION ALL SELECT o_orderkey % 1500 FROM orders) GROUP BY 1")
def a9_degree(spark, read):
    return nodes.degrees(read("orders").select(C("o_custkey").alias("src"), mod("o_orderkey", 1500).alias("dst")))


@query("""
WITH g AS (SELECT event_type AS why, count(*) AS n FROM events GROUP BY 1), s AS (SELECT why, n, least(n, greatest(40 - coalesce(sum(least(n, 40)) OVER (ORDER BY n DESC, why ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3)) AS k FROM g),
r AS (SELECT event_type AS why, 'u' || user_id AS path, event_id AS line, row_number() OVER (PARTITION BY event_type ORDER BY 'u' || user_id, event_id) AS i FROM events)
SELECT why, n AS count, string_agg(path || ':' || line, ' ' ORDER BY i) AS places FROM r JOIN s USING (why) WHERE i <= k GROUP BY 1, 2
""")
def a13_ruled_out(spark, read):
    s = read("events").select(C("event_type").alias("why"), cat("u", C("user_id")).alias("path"), C("event_id").alias("line"))
    return worklist.ruled_out(s)[0].select("why", "count", F.concat_ws(" ", "where").alias("places"))


@query("SELECT 'node' AS what, c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'edge', o_orderpriority, count(*) FROM orders GROUP BY 2")
def a14_stats(spark, read):
    return nodes.graph_stats(read("customer").select(C("c_mktsegment").alias("kind")), read("orders").select(C("o_orderpriority").alias("kind")))


@query("""
WITH m AS (SELECT 'f' || (l_suppkey % 30) AS path, l_linenumber % 4 AS k FROM lineitem), u AS (SELECT 'f' || (o_custkey % 60) AS dst, count(DISTINCT 'f' || (o_orderkey % 17)) FILTER ('f' || (o_custkey % 60) <> 'f' || (o_orderkey % 17)) AS d FROM orders GROUP BY 1)
SELECT path, count(*) AS markers, coalesce(any_value(d), 0) AS dependents, round((4 * count(*) FILTER (k = 0) + 3 * count(*) FILTER (k = 1) + 2 * count(*) FILTER (k = 2) + count(*) FILTER (k = 3)) * sqrt(1 + coalesce(any_value(d), 0)), 4) AS priority FROM m LEFT JOIN u ON u.dst = path GROUP BY 1
""")
def a15_legacy_summary(spark, read):
    level = F.element_at(F.array(*map(F.lit, ("removed", "unsafe", "deprecated", "obsolescent"))), (mod("l_linenumber", 4) + 1).cast("int"))
    m = read("lineitem").select(cat("f", mod("l_suppkey", 30)).alias("path"), level.alias("level"))
    u = read("orders").select(cat("f", mod("o_orderkey", 17)).alias("src_path"), cat("f", mod("o_custkey", 60)).alias("dst_path"))
    return lines.legacy_summary(m, u).select("path", "markers", "dependents", F.round("priority", 4).alias("priority"))


@query("""
WITH s AS (SELECT s_nationkey AS i, CASE WHEN s_suppkey % 6 = 0 THEN 1 ELSE 0 END AS m, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS x FROM supplier), p AS (SELECT i, CASE WHEN sum(m) > 0 THEN 'MISSED' WHEN sum(x) > 0 THEN 'NOISY' ELSE 'CAUGHT' END AS status FROM s GROUP BY 1)
SELECT i AS incident, status, count(*) OVER (PARTITION BY status) AS of_status FROM p
""")
def a16_scoreboard(spark, read):
    lit = lambda *w: F.array(*map(F.lit, w))
    n = lambda k: mod("s_suppkey", k) == 0
    found = F.array_compact(F.array(F.lit("a"), F.when(~n(6), F.lit("b")), F.when(n(5), F.lit("z"))))
    return tools.scoreboard(read("supplier").select(C("s_nationkey").alias("incident"), lit("a", "b").alias("expected"), lit("z").alias("unexpected"), found.alias("found")))


@query(f"""
WITH {EDGES}, n AS (SELECT c_custkey AS id, c_custkey % 300 = 1 AS ch, c_custkey % 450 = 2 AS fi, CASE WHEN c_custkey % 40 = 3 THEN 0.5 ELSE 0 END AS sc, CAST(c_custkey % 3 + 1 AS INTEGER) AS hops FROM customer),
l AS (SELECT id, CAST(CASE WHEN sc > 0 AND NOT ch THEN hops ELSE 0 END AS INTEGER) AS column FROM n WHERE ch OR fi OR sc > 0),
u AS (SELECT dst AS id, count(*) AS k FROM e WHERE src <> dst AND src IN (SELECT id FROM l WHERE "column" = 0) AND dst IN (SELECT id FROM n) AND dst NOT IN (SELECT id FROM l) GROUP BY 1 ORDER BY k DESC, id LIMIT 4)
SELECT id, "column" FROM l UNION ALL SELECT id, -1 FROM u
""".replace(" AS column FROM n", ' AS "column" FROM n'))
def g3_columns(spark, read):
    n = lambda k, r: mod("c_custkey", k) == r
    v = read("customer").select(C("c_custkey").alias("id"), n(300, 1).alias("change"), n(450, 2).alias("finding"), F.when(n(40, 3), 0.5).otherwise(0.0).alias("score"), (mod("c_custkey", 3) + 1).cast("int").alias("hops"))
    return tools.flow_columns(v, order_edges(read))


@query(f"""
WITH {EDGES}, n AS (SELECT c_custkey AS id, c_custkey % 300 = 1 AS core FROM customer), r AS (SELECT src AS id FROM e WHERE dst IN (SELECT id FROM n WHERE core) UNION SELECT dst FROM e WHERE src IN (SELECT id FROM n WHERE core)),
d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), t AS (SELECT n.id, CASE WHEN core THEN 0 WHEN n.id IN (SELECT id FROM r) THEN 1 ELSE 2 END AS tier, coalesce(k, 0) AS k FROM n LEFT JOIN d ON d.id = n.id)
SELECT id FROM t ORDER BY tier, CASE WHEN tier = 2 THEN -k ELSE 0 END, id LIMIT 400
""")
def g14_pruned(spark, read):
    return tools.pruned(read("customer").select(C("c_custkey").alias("id"), (mod("c_custkey", 300) == 1).alias("core")), order_edges(read), 400, whole=True)


@query("WITH w(kind, f, r) AS (VALUES " + ", ".join(f"('{k}', {f}, {r})" for k, f, r in EDGE_WEIGHTS) + ") SELECT event_id, coalesce(CAST(f AS DOUBLE), 0) AS forward, coalesce(CAST(r AS DOUBLE), 0) AS reverse FROM events LEFT JOIN w ON kind = CASE event_id % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'reads' ELSE 'other' END")
def g15_weights(spark, read):
    w = spark.createDataFrame(list(EDGE_WEIGHTS), "kind string, forward double, reverse double")
    kind = F.when(mod("event_id", 3) == 0, "calls").when(mod("event_id", 3) == 1, "reads").otherwise("other")
    return nodes.weighted(read("events").select("event_id", kind.alias("kind")), w).select("event_id", "forward", "reverse")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey) AS n FROM lineitem) WHERE n = 1")
def u8_first_of_each(spark, read):
    return nodes.first_of_each(read("lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_extendedprice"), C("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id % 50 AS part, string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '-' || z END, ',' ORDER BY a) AS lines FROM (SELECT doc_id % 50 AS doc_id, min(n) AS a, max(n) AS z FROM (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id % 50 ORDER BY n) AS g FROM (SELECT DISTINCT doc_id % 50 AS doc_id, n_chars % 400 AS n FROM documents)) GROUP BY doc_id, g) GROUP BY 1")
def w7_ranges(spark, read):
    d = read("documents").select(mod("doc_id", 50).alias("part"), mod("n_chars", 400).alias("n")).distinct()
    return worklist.ranges(d, "part", "n")


WORDS = ("api", "db_client", "Utils", "my_cache", "run.py", "plain", "settings", "_core_", "service_a", "handlers", "tests", "x")
SAID = ("interface", "data_access", "util", "state", "entrypoint", None, "config", "domain", "orchestration", "interface", "test", None)


@query(f"""
WITH h(i, hint) AS (VALUES {", ".join(f"({i}, {'NULL' if s is None else repr(s)})" for i, s in enumerate(SAID))}),
p AS (SELECT p_partkey AS k, hint, p_partkey % 12 = 10 AS tests, p_size % 11 = 0 AS guard, CASE p_partkey % 7 WHEN 1 THEN 'redis' WHEN 2 THEN 'socket' WHEN 3 THEN 'argparse' END AS imp, p_size % 13 = 0 AS dec, p_size % 2 AS st,
  p_size % 3 = 0 AS ret, p_size % 4 = 0 AS mut, p_size % 5 < 3 AS par, p_partkey % 5 = 0 AS rg, p_partkey % 17 = 0 AS op, p_partkey % 19 = 0 AS ex, p_partkey % 3 AS calls FROM part JOIN h ON p_partkey % 12 = i),
a AS (SELECT *, CASE WHEN guard THEN 'entrypoint' ELSE hint END AS s FROM p), b AS (SELECT *, CASE WHEN imp = 'redis' AND (s IS NULL OR s IN ('domain', 'util', 'orchestration')) THEN 'data_access' ELSE s END AS s1 FROM a),
c AS (SELECT *, CASE WHEN imp = 'socket' AND (s1 IS NULL OR s1 IN ('domain', 'util')) THEN 'io_boundary' ELSE s1 END AS s2 FROM b),
m AS (SELECT *, CASE WHEN tests THEN 'test' WHEN dec THEN 'interface' WHEN s2 IS NULL AND imp = 'argparse' THEN 'config' ELSE coalesce(s2, CASE WHEN st > 0 THEN 'domain' ELSE 'unknown' END) END AS module FROM c),
f AS (SELECT *, CASE WHEN dec THEN 'interface' ELSE module END AS f1 FROM m),
g AS (SELECT *, CASE WHEN ex THEN 'entrypoint' WHEN (op OR imp IS NOT DISTINCT FROM 'socket') AND f1 IN ('domain', 'util', 'unknown', 'orchestration') THEN 'io_boundary' ELSE f1 END AS layer FROM f)
SELECT k AS p_partkey, module, layer, CASE WHEN mut AND ret THEN 'accessor' WHEN mut THEN 'consumer' WHEN ret AND par AND NOT rg THEN 'transformer' WHEN ret AND layer IN ('data_access', 'io_boundary') THEN 'source' WHEN ret THEN 'transformer'
  WHEN layer IN ('data_access', 'io_boundary') THEN 'sink' WHEN calls > 0 AND st = 0 THEN 'control' ELSE 'consumer' END AS role FROM g
""")
def f17_roles(spark, read):
    """Layers and roles by evidence, a module and a function a part."""
    n = lambda c, k: mod(c, k) == 0
    word = F.element_at(F.array(*map(F.lit, WORDS)), (mod("p_partkey", 12) + 1).cast("int"))
    strings = lambda *c: F.array_compact(F.array(*c)).cast("array<string>")
    root = F.when(mod("p_partkey", 7) == 1, "redis").when(mod("p_partkey", 7) == 2, "socket").when(mod("p_partkey", 7) == 3, "argparse")
    s = read("part").select(
        "p_partkey", F.array(F.lit("app"), word).alias("parts"), F.array(F.lit("app"), word).alias("path"), strings(root).alias("imported"), strings(F.when(n("p_size", 13), "web.Route")).alias("decorators"), n("p_size", 11).alias("main_guard"),
        n("p_partkey", 17).alias("opens"), n("p_partkey", 19).alias("exits"), n("p_size", 3).alias("returns"), (mod("p_size", 5) < 3).alias("params"), F.lit(None).cast("boolean").alias("writes_global"), n("p_partkey", 5).alias("reads_global"),
        n("p_size", 4).alias("mutates"), mod("p_partkey", 3).alias("calls"), mod("p_size", 2).alias("statements"),
    )
    told = s.withColumn("module", roles.module_label()["layer"])
    label = roles.callable_label(C("module"))
    return told.select("p_partkey", "module", label["layer"].alias("layer"), label["role"].alias("role"))
