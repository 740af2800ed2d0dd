"""Readers and rules of other languages over texts made from the parquet tables, each beside SQL that works out from the rows, not from
the texts, what must come of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwake.operators import copybooks, graph, records
from driftwake.plans import check
from driftwake.plans.tables import mod, query
from driftwake.rules import registry
from driftwake.sources import facts, lines

C = F.col


def cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def joined(rows: DataFrame, by: list[str], order: str, text, sep: str = "\n") -> DataFrame:
    """by, body: texts of a group's rows in order."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(C(order).alias("o"), text.alias("t")))).alias("x")).select(*by, F.array_join(F.transform("x", lambda r: r["t"]), sep).alias("body"))


def file(df: DataFrame, path, text, snapshot: str = "after") -> DataFrame:
    return df.select(F.lit(snapshot).alias("snapshot"), path.alias("path"), text.alias("text"))


# ---- C

TYPES = ("char", "t2", "int", "unsigned long", "double", "char *")
HEAD = "#define TWO 2\ntypedef short t2;\n"
TYPED = "p_size % 6 AS k, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS n"


def headers(part: DataFrame, size, snapshot: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod(size, F.lit(6)) + 1).cast("int"))
    row = cat("  ", kind, " f", C("p_partkey"), F.when(F.pmod(size, F.lit(3)) == 0, "[TWO]").otherwise(""), ";")
    body = joined(part.withColumn("r", mod("p_partkey", 200)), ["r"], "p_partkey", row)
    return file(body, cat("h/r", C("r"), ".h"), cat(HEAD, "struct r", C("r"), " {\n", C("body"), "\n};\n"), snapshot)


@query(f"""
WITH RECURSIVE f AS (SELECT p_partkey % 200 AS r, p_partkey AS p, row_number() OVER (PARTITION BY p_partkey % 200 ORDER BY p_partkey) AS i, [1, 2, 4, 8, 8, 8][p_size % 6 + 1] AS w, {TYPED} FROM part),
o AS (SELECT r, p, i, 0::BIGINT AS pos, w * n AS size, w FROM f WHERE i = 1 UNION ALL
  SELECT f.r, f.p, f.i, ((o.pos + o.size + f.w - 1) // f.w) * f.w, f.w * f.n, f.w FROM o JOIN f ON f.r = o.r AND f.i = o.i + 1),
t AS (SELECT r, max(pos + size) AS e, max(w) AS a FROM o GROUP BY 1)
SELECT 'struct r' || r AS name, 'f' || p AS field, CAST(pos AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size, CAST(((e + a - 1) // a) * a AS BIGINT) AS whole FROM o JOIN t USING (r)
""")
def c_layout(spark, read):
    """Layouts of records in headers: types, typedefs, arrays of a macro's length."""
    known = graph.cut(facts.facts(headers(read("part"), C("p_size"), "after")))
    values = records.constants(facts.table(known, "constant").select("snapshot", "owner", "name", "expr", "plus").distinct(), ["snapshot"])
    out = records.sized(facts.table(known, "record"), facts.table(known, "alias"), values, ["snapshot"])
    each = out.select("name", F.explode("fields").alias("f"), C("size").alias("whole"))
    return each.select("name", "f.field", F.floor(C("f.offset") / 8).alias("offset"), F.floor(C("f.size") / 8).alias("size"), "whole")


@query(f"""
WITH b AS (SELECT p_partkey % 200 AS r FROM part WHERE p_partkey % 97 = 0), l AS (SELECT DISTINCT r FROM b)
SELECT 'h/r' || r || '.h' AS path, CAST(3 AS INTEGER) AS line, 'high' AS severity FROM l
""")
def c_struct_layout_change(spark, read):
    """The rule, from text to finding: a field of another type in every 97th part."""
    p = read("part")
    new = F.when(mod("p_partkey", 97) == 0, C("p_size") + 1).otherwise(C("p_size"))
    both = headers(p, C("p_size"), "before").unionByName(headers(p, new, "after"))
    return check.check(both, rules={"struct-layout-change": registry.RULES["struct-layout-change"]}).findings.select("path", "line", "severity")


def enums(orders: DataFrame, shift, snapshot: str) -> DataFrame:
    said = F.when(mod("o_orderkey", 4) == 0, cat(" = ", mod("o_orderkey", 1000), " + BASE")).when(mod("o_orderkey", 9) == 0, cat(" = (1 << ", mod("o_orderkey", 20), ") | 1")).otherwise("")
    row = cat("  M", C("o_orderkey"), F.when(shift, cat(" = ", mod("o_orderkey", 50), " + 7")).otherwise(said))
    body = joined(orders, ["o_custkey"], "o_orderkey", row, ",\n")
    return file(body, cat("e/", C("o_custkey"), ".h"), cat("#define BASE (2 * 8)\nenum e", C("o_custkey"), " {\n", C("body"), "\n};\n"), snapshot)


VALUES = """SELECT c, m, coalesce(last_value(v IGNORE NULLS) OVER w + i - last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w, i - 1) AS value, i
FROM (SELECT o_custkey AS c, o_orderkey AS m, {} AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WINDOW w AS (PARTITION BY c ORDER BY i)"""
EXPLICIT = "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 1000 + 16 WHEN o_orderkey % 9 = 0 THEN (1::BIGINT << (o_orderkey % 20)::INTEGER) | 1 END"


@query(f"SELECT 'enum e' || c AS owner, 'M' || m AS name, CAST(value AS BIGINT) AS value FROM ({VALUES.format(EXPLICIT)})")
def c_enum_values(spark, read):
    """Values of enumerators, said or counted on from the last that is, by way of a macro."""
    known = graph.cut(facts.facts(enums(read("orders"), F.lit(False), "after")))
    values = records.constants(facts.table(known, "constant").select("snapshot", "owner", "name", "expr", "plus").distinct(), ["snapshot"])
    return values.filter("owner IS NOT NULL").select("owner", "name", "value")


@query(f"""
WITH b AS ({VALUES.format(EXPLICIT)}), a AS ({VALUES.format("CASE WHEN o_orderkey % 101 = 0 THEN o_orderkey % 50 + 7 ELSE " + EXPLICIT + " END")})
SELECT DISTINCT 'e/' || b.c || '.h' AS path, CAST(3 AS INTEGER) AS line, 'high' AS severity FROM b JOIN a USING (c, m) WHERE a.value <> b.value
""")
def c_enum_values_shifted(spark, read):
    """The rule, from text to finding: every 101st member says another value."""
    o = read("orders")
    both = enums(o, F.lit(False), "before").unionByName(enums(o, mod("o_orderkey", 101) == 0, "after"))
    return check.check(both, rules={"enum-values-shifted": registry.RULES["enum-values-shifted"]}).findings.select("path", "line", "severity")


@query("""
WITH s AS (SELECT user_id AS u, event_id AS e, event_type IN ('error', 'purchase') AS jump, event_id % 7 = 0 AS label FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY e) AS i, count(*) OVER (PARTITION BY u) AS total, sum(CASE WHEN label THEN 1 ELSE 0 END) OVER (PARTITION BY u) AS labels, sum(CASE WHEN label THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY e) AS g FROM s),
j AS (SELECT u, g, min(i) AS first FROM n WHERE jump AND NOT label GROUP BY 1, 2)
SELECT 'u/' || n.u || '.c' AS path, CAST(1 + labels + i AS INTEGER) AS line FROM n JOIN j USING (u, g) WHERE i = first + 1 AND NOT label
""")
def c_unreachable(spark, read):
    """unreachable-statement over a function a user: a statement an event, jumps for two kinds of them, and labels."""
    e = read("events").select("event_id", "event_type", C("user_id").alias("u"))
    label = mod("event_id", 7) == 0
    text = F.when(label, cat("l", C("event_id"), ":")).when(C("event_type") == "error", "  goto out;").when(C("event_type") == "purchase", cat("  return ", C("event_id"), ";")).otherwise(cat("  if (x > ", C("event_id"), ") { a(); } else b();"))
    ways = joined(e.filter(label), ["u"], "event_id", cat("  if (x) goto l", C("event_id"), ";")).withColumnRenamed("body", "ways")
    body = joined(e, ["u"], "event_id", text).join(ways, "u", "left")
    head = F.coalesce(F.concat("ways", F.lit("\n")), F.lit(""))
    f = file(body, cat("u/", C("u"), ".c"), cat("int f", C("u"), "(int x) {\n", head, C("body"), "\nout:\n  return 0;\n}\n"))
    return facts.table(facts.facts(f), "finding").filter("rule = 'unreachable-statement'").select("path", "line")


MEMBERS = "SELECT DISTINCT doc_id % 3 AS e, source AS m FROM documents"


@query(f"""
WITH all_ AS ({MEMBERS}), old AS (SELECT * FROM all_ WHERE m <> 'src3'), c AS (SELECT DISTINCT doc_id % 3 AS e, doc_id // 3 % 7 AS s, source AS m FROM documents WHERE source <> 'src3' OR doc_id // 3 % 7 > 4),
k AS (SELECT e, s, count(*) FILTER (m <> 'src3') AS has, count(*) FILTER (m = 'src3') AS got FROM c GROUP BY 1, 2), n AS (SELECT e, count(*) AS n, count(*) FILTER (m = 'src3') > 0 AS adds FROM all_ GROUP BY 1)
SELECT 's/' || e || '_' || s || '.c' AS path, CAST(3 AS INTEGER) AS line, 'medium' AS severity FROM k JOIN n USING (e) WHERE adds AND has = n - 1 AND n - 1 >= 2 AND got = 0
""")
def c_unhandled_new_member(spark, read):
    """The rule, from text to finding: an enum of sources a group of documents, and switches over what groups of it hold."""
    d = read("documents").select(mod("doc_id", 3).alias("e"), F.pmod(F.floor(C("doc_id") / 3), F.lit(7)).alias("s"), "source")
    name = lambda m: cat("E", C("e"), "_", m)

    def enum(rows: DataFrame, snapshot: str) -> DataFrame:
        body = joined(rows.select("e", "source").distinct(), ["e"], "source", name(C("source")), ", ")
        return file(body, cat("s/", C("e"), ".h"), cat("enum s", C("e"), " { ", C("body"), " };\n"), snapshot)

    held = d.filter((C("source") != "src3") | (C("s") > 4)).distinct()
    cases = joined(held, ["e", "s"], "source", cat("  case ", name(C("source")), ": a(); break;"))
    code = lambda snapshot: file(cases, cat("s/", C("e"), "_", C("s"), ".c"), cat('#include "', C("e"), '.h"\nvoid f', C("e"), "_", C("s"), "(enum s", C("e"), " x) {\n  switch (x) {\n", C("body"), "\n  default: b();\n  }\n}\n"), snapshot)
    both = enum(d.filter("source <> 'src3'"), "before").unionByName(code("before")).unionByName(enum(d, "after")).unionByName(code("after"))
    return check.check(both, rules={"unhandled-new-member": registry.RULES["unhandled-new-member"]}).findings.select("path", "line", "severity")


# ---- COBOL


def area(*parts):
    """A line of fixed form."""
    return cat("       ", *parts)


def alone(both: DataFrame, rule: str) -> DataFrame:
    return check.check(both, rules={rule: registry.RULES[rule]}).findings.select("path", "line", "severity")


def books(part: DataFrame, n, snapshot: str) -> DataFrame:
    """A copybook for each rest of keys by 100: fields in groups by brand, of characters, packed digits or both in a table."""
    r = part.withColumn("r", mod("p_partkey", 100)).withColumn("g", C("p_brand"))
    pic = F.when(mod("p_partkey", 3) == 0, cat("PIC S9(", n, ") COMP-3")).when(mod("p_partkey", 3) == 1, cat("PIC X(", n, ")")).otherwise(cat("PIC 9(", n, ")V99 OCCURS 3 TIMES"))
    field = area("     10 F", C("p_partkey"), " ", pic, ".")
    groups = joined(r, ["r", "g"], "p_partkey", field)
    tag = F.upper(F.regexp_replace("g", "[^A-Za-z0-9]", "-"))
    whole = joined(groups, ["r"], "g", F.concat(area("   05 G-", tag, "."), F.lit("\n"), C("body")))
    return file(whole, cat("b/B", C("r"), ".cpy"), F.concat(area("01 REC-", C("r"), "."), F.lit("\n"), C("body"), F.lit("\n")), snapshot)


WIDE = "CASE p_partkey % 3 WHEN 0 THEN {0} // 2 + 1 WHEN 1 THEN {0} ELSE {0} + 2 END"
N = "p_size % 9 + 1"


@query(f"""
WITH f AS (SELECT p_partkey % 100 AS r, p_brand AS g, p_partkey AS p, CAST({WIDE.format(f"({N})")} AS BIGINT) AS w, CASE WHEN p_partkey % 3 = 2 THEN 3 ELSE 1 END AS times FROM part)
SELECT 'REC-' || r AS record, 'F' || p AS name, w AS size, CAST(coalesce(sum(w * times) OVER (PARTITION BY r ORDER BY g, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM f
""")
def cobol_layout(spark, read):
    """Sizes and offsets of a record's fields, from the texts of copybooks."""
    known = facts.facts(books(read("part"), mod("p_size", 9) + 1, "after"))
    none = spark.createDataFrame([], "snapshot string, book string, path string")
    opened = copybooks.opened(facts.table(known, "item"), facts.table(known, "copy"), none, ["snapshot"])
    return copybooks.laid_out(opened, ["snapshot"]).filter("name LIKE 'F%' AND name NOT LIKE 'FILLER%'").select("record", "name", "size", "offset")


@query(f"""
WITH f AS (SELECT p_partkey % 100 AS r, {WIDE.format(f"({N})")} AS was, {WIDE.format(f"(CASE WHEN p_partkey % 97 = 0 THEN {N} + 1 ELSE {N} END)")} AS now, p_partkey % 97 = 0 AS other FROM part)
SELECT DISTINCT 'b/B' || r || '.cpy' AS path, CAST(first AS INTEGER) AS line, 'critical' AS severity FROM (SELECT r, bool_or(other) AS hit, sum(now - was) AS moved, 1 AS first FROM f GROUP BY r) WHERE hit AND r % 3 <> 0 AND moved > 0
UNION ALL SELECT 'b/B' || r || '.cpy', CAST(2 + n AS INTEGER), 'critical' FROM (SELECT r, min(n) FILTER (other) AS n, bool_or(other) AS hit, sum(now - was) AS moved
  FROM (SELECT *, i + g AS n FROM (SELECT p_partkey % 100 AS r, row_number() OVER (PARTITION BY p_partkey % 100 ORDER BY p_brand, p_partkey) AS i, dense_rank() OVER (PARTITION BY p_partkey % 100 ORDER BY p_brand) AS g,
    {WIDE.format(f"({N})")} AS was, {WIDE.format(f"(CASE WHEN p_partkey % 97 = 0 THEN {N} + 1 ELSE {N} END)")} AS now, p_partkey % 97 = 0 AS other FROM part)) GROUP BY r) WHERE hit AND r % 3 <> 0 AND moved = 0
""".replace("CAST(2 + n AS INTEGER)", "CAST(1 + n AS INTEGER)"))
def cobol_copybook_layout_changed(spark, read):
    """The rule, from text to finding: every 97th field is a character or digit longer; every third book is copied by nobody."""
    p = read("part")
    n = mod("p_size", 9) + 1
    new = F.when(mod("p_partkey", 97) == 0, n + 1).otherwise(n)
    r = p.select(mod("p_partkey", 100).alias("r")).distinct().filter("r % 3 <> 0")
    uses = lambda snapshot: file(r, cat("u/P", C("r"), ".cbl"), F.concat_ws("\n", area("IDENTIFICATION DIVISION."), area("PROGRAM-ID. P", C("r"), "."), area("DATA DIVISION."), area("WORKING-STORAGE SECTION."), area("COPY B", C("r"), "."), area("PROCEDURE DIVISION."), area("MAIN-ONE."), area("    GOBACK.")), snapshot)
    both = books(p, n, "before").unionByName(books(p, new, "after")).unionByName(uses("before")).unionByName(uses("after"))
    return alone(both, "copybook-layout-changed")


def program(df: DataFrame, name, data, procedure, path, snapshot: str) -> DataFrame:
    text = F.concat_ws("\n", area("IDENTIFICATION DIVISION."), area("PROGRAM-ID. ", name, "."), area("DATA DIVISION."), area("WORKING-STORAGE SECTION."), data, area("PROCEDURE DIVISION."), procedure)
    return file(df, path, text, snapshot)


def moving(part: DataFrame, digits, snapshot: str) -> DataFrame:
    r = part.withColumn("r", mod("p_partkey", 50))
    data = joined(r, ["r"], "p_partkey", F.concat(area("01 A", C("p_partkey"), " PIC 9(", digits, ")."), F.lit("\n"), area("01 B", C("p_partkey"), " PIC 9(5).")))
    code = joined(r, ["r"], "p_partkey", area("    MOVE A", C("p_partkey"), " TO B", C("p_partkey"), ".")).withColumnRenamed("body", "code")
    return program(data.join(code, "r"), cat("M", C("r")), C("body"), F.concat(area("MAIN-ONE."), F.lit("\n"), C("code"), F.lit("\n")), cat("m/M", C("r"), ".cbl"), snapshot)


@query("""
WITH f AS (SELECT p_partkey % 50 AS r, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_partkey % 50) AS n, p_size % 7 + 1 AS was, (p_size % 7 + 1) + CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 0 END AS now FROM part)
SELECT 'm/M' || r || '.cbl' AS path, CAST(4 + 2 * n + 2 + i AS INTEGER) AS line, 'high' AS severity FROM f WHERE greatest(now - 5, 0) > greatest(was - 5, 0)
""")
def cobol_move_truncates(spark, read):
    """The rule, from text to finding: every fifth field is three digits wider, its receiver is not."""
    p = read("part")
    n = mod("p_size", 7) + 1
    return alone(moving(p, n, "before").unionByName(moving(p, n + F.when(mod("p_partkey", 5) == 0, 3).otherwise(0), "after")), "move-truncates")


def talks(read, keep, snapshot: str, main, text) -> DataFrame:
    """A program a conversation, with a paragraph a turn."""
    c = read("conversations").select("conv_id", "turn", "role")
    body = joined(c.filter(keep), ["conv_id"], "turn", F.concat(area("T", C("turn"), "."), F.lit("\n"), area("    ", text, ".")))
    ends = c.filter("turn % 3 <> 2").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("z"))
    return program(body.join(ends, "conv_id"), cat("C", C("conv_id")), area("01 A PIC X."), F.concat_ws("\n", *main, C("body"), F.lit("")), cat("c/C", C("conv_id"), ".cbl"), snapshot)


@query("""
WITH e AS (SELECT conv_id, min(turn) AS a, max(turn) AS z FROM conversations WHERE turn % 3 <> 2 GROUP BY 1)
SELECT DISTINCT 'c/C' || conv_id || '.cbl' AS path, CAST(8 AS INTEGER) AS line, 'high' AS severity FROM conversations JOIN e USING (conv_id) WHERE turn % 3 = 2 AND turn > a AND turn < z
""")
def cobol_perform_thru_range_changed(spark, read):
    """The rule, from text to finding: every third turn comes in between."""
    main = [area("MAIN-ONE."), area("    PERFORM T", C("a"), " THRU T", C("z"), "."), area("    GOBACK.")]
    make = lambda keep, s: talks(read, keep, s, main, F.lit("DISPLAY A"))
    return alone(make("turn % 3 <> 2", "before").unionByName(make("true", "after")), "perform-thru-range-changed")


TALK = "SELECT conv_id AS c, turn AS t, turn % 5 = 3 AS leaves FROM conversations"


@query(f"""
WITH a AS ({TALK}), b AS (SELECT * FROM a WHERE t % 4 <> 2),
fa AS (SELECT c, t, lead(t) OVER w AS next, leaves, coalesce(sum(CASE WHEN leaves THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, row_number() OVER w AS i FROM a WINDOW w AS (PARTITION BY c ORDER BY t)),
fb AS (SELECT c, t, lead(t) OVER w AS next, leaves, coalesce(sum(CASE WHEN leaves THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b WINDOW w AS (PARTITION BY c ORDER BY t))
SELECT 'c/C' || fa.c || '.cbl' AS path, CAST(6 + 2 * i AS INTEGER) AS line, 'medium' AS severity FROM fa JOIN b USING (c, t) LEFT JOIN fb ON fb.c = fa.c AND fb.t = fa.t AND fb.s = 0 AND NOT fb.leaves AND fb.next IS NOT NULL
WHERE fa.s = 0 AND NOT fa.leaves AND fa.next IS NOT NULL AND fa.next IS DISTINCT FROM fb.next AND NOT (fb.next IS NOT NULL AND fb.next NOT IN (SELECT t FROM a x WHERE x.c = fa.c))
""")
def cobol_fall_through_changed(spark, read):
    """The rule, from text to finding: every fourth turn comes in between, some turns leave."""
    text = F.when(mod("turn", 5) == 3, "GOBACK").otherwise("DISPLAY A")
    make = lambda keep, s: talks(read, keep, s, [], text)
    return alone(make("turn % 4 <> 2", "before").unionByName(make("true", "after")), "fall-through-changed")


@query("""
WITH s AS (SELECT s_suppkey AS k, s_nationkey % 4 AS given, s_nationkey % 5 AS size FROM supplier WHERE s_suppkey % 2 = 0)
SELECT 'x/A' || k || '.cbl' AS path, CAST(9 AS INTEGER) AS line, 'critical' AS severity FROM s WHERE (given <> 2) OR (size < 3)
""")
def cobol_call_using_mismatch(spark, read):
    """The rule, from text to finding: a caller a supplier, which before handed over what is taken, and now another number or size."""
    s = read("supplier").select(C("s_suppkey").alias("k"), mod("s_nationkey", 4).alias("given"), mod("s_nationkey", 5).alias("size"))
    two = F.lit("ARG-A ARG-B")
    args = F.when(mod("k", 2) == 1, two).when(C("given") == 0, "").when(C("given") == 1, "ARG-A").when(C("given") == 2, two).otherwise("ARG-A ARG-B ARG-A")
    size = F.when(mod("k", 2) == 1, F.lit(3)).otherwise(C("size") + F.when(C("size") == 0, 1).otherwise(0))
    call = lambda a: area("    CALL 'TAKER'", F.when(a != "", F.concat(F.lit(" USING "), a)).otherwise(""), ".")
    make = lambda a, n, snapshot: program(s, cat("A", C("k")), F.concat(area("01 ARG-A PIC X(", n, ")."), F.lit("\n"), area("01 ARG-B PIC X(9).")), F.concat_ws("\n", area("MAIN-ONE."), call(a), area("    GOBACK.")), cat("x/A", C("k"), ".cbl"), snapshot)
    taker = F.concat_ws("\n", area("IDENTIFICATION DIVISION."), area("PROGRAM-ID. TAKER."), area("DATA DIVISION."), area("LINKAGE SECTION."), area("01 L-A PIC X(3)."), area("01 L-B PIC X(9)."), area("PROCEDURE DIVISION USING L-A L-B."), area("MAIN-ONE."), area("    GOBACK."))
    one = s.orderBy("k").limit(1)
    takers = file(one, F.lit("x/TAKER.cbl"), taker, "before").unionByName(file(one, F.lit("x/TAKER.cbl"), taker, "after"))
    return alone(make(two, F.lit(3), "before").unionByName(make(args, size, "after")).unionByName(takers), "call-using-mismatch")


@query("SELECT 'c/C' || conv_id || '.cbl' AS path, CAST(min(5 + 2 * i) AS INTEGER) AS line, 'low' AS severity FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) WHERE role = 'assistant' AND turn % 4 = 3 GROUP BY 1")
def cobol_legacy_construct_introduced(spark, read):
    """The rule, from text to finding: some turns of the assistant jump now."""
    jump = F.when((C("role") == "assistant") & (mod("turn", 4) == 3), "IF A = SPACE GO TO T0").otherwise("DISPLAY A")
    return alone(talks(read, "true", "before", [], F.lit("DISPLAY A")).unionByName(talks(read, "true", "after", [], jump)), "legacy-construct-introduced")


# ---- patterns over whole texts


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderkey % 4 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT 'w/' || c || '.py' AS path, CAST(2 * i - 1 AS INTEGER) AS line, 'py-import-by-name' AS rule FROM o WHERE k = 1
""")
def f12_hidden_over_lines(spark, read):
    """A call by name whose argument stands on the next line, beside ones that hand over a literal there, or stand in a comment."""
    said = F.array(F.lit("m = import_module(\n    'a.b')"), F.lit("m = import_module(\n    name)"), F.lit("m = 1\nn = 2"), F.lit("# import_module(name)\nn = 2"))
    body = joined(read("orders"), ["o_custkey"], "o_orderkey", F.element_at(said, (mod("o_orderkey", 4) + 1).cast("int")))
    return lines.hidden_calls(body.select(cat("w/", C("o_custkey"), ".py").alias("path"), C("body").alias("text")))


@query("""
WITH e AS (SELECT user_id AS u, event_id % 3 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT 'g/' || u || '.cbl' AS path, CAST(2 * i - 1 AS INTEGER) AS line, 'cobol-go-to-depending' AS rule FROM e WHERE k = 0
UNION ALL SELECT 'g/' || u || '.cbl', CAST(2 * i - 1 AS INTEGER), 'cobol-go-to' FROM e WHERE k = 1
""")
def f12_legacy_over_lines(spark, read):
    """Jumps by number and plain ones, each over two lines."""
    said = F.array(F.concat(area("    GO TO A-ONE B-ONE"), F.lit("\n"), area("      DEPENDING ON K.")), F.concat(area("    GO TO A-ONE"), F.lit("\n"), area("      .")), F.concat(area("    MOVE A"), F.lit("\n"), area("      TO B.")))
    body = joined(read("events"), ["user_id"], "event_id", F.element_at(said, (mod("event_id", 3) + 1).cast("int")))
    return lines.scan(body.select(cat("g/", C("user_id"), ".cbl").alias("path"), C("body").alias("text"))).select("path", "line", "rule")


# ---- Fortran


@query("""
WITH a AS (SELECT c_nationkey AS b, c_mktsegment AS l, 'u' || c_custkey AS u, c_custkey FROM customer), o AS (SELECT * FROM a WHERE c_custkey % 3 <> 0),
ca AS (SELECT b, l, count(*) AS n, min(u) AS f FROM a GROUP BY 1, 2), xa AS (SELECT b, l AS usual FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, f) AS r FROM ca) WHERE r = 1),
co AS (SELECT b, l, count(*) AS n, min(u) AS f FROM o GROUP BY 1, 2), xo AS (SELECT b, l AS usual FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, f) AS r FROM co) WHERE r = 1)
SELECT 'f/' || u || '.f90' AS path, CAST(2 AS INTEGER) AS line, 'critical' AS severity FROM a JOIN xa USING (b) WHERE l <> usual AND u NOT IN (SELECT u FROM o JOIN xo USING (b) WHERE l <> usual)
""")
def fortran_common_layout_mismatch(spark, read):
    """The rule, from text to finding: a unit a customer, a block a nation, laid out as the segment says; every third unit is new."""
    c = read("customer")
    said = {"AUTOMOBILE": "x, y", "BUILDING": "i, y", "FURNITURE": "x(2), y", "HOUSEHOLD": "x, y, z", "MACHINERY": "j, k(3)"}
    names = F.element_at(F.create_map(*(F.lit(v) for kv in said.items() for v in kv)), C("c_mktsegment"))
    make = lambda df, s: file(df, cat("f/u", C("c_custkey"), ".f90"), cat("subroutine u", C("c_custkey"), "\n  common /b", C("c_nationkey"), "/ ", F.coalesce(names, F.lit("q")), "\nend subroutine\n"), s)
    return alone(make(c.filter(mod("c_custkey", 3) != 0), "before").unionByName(make(c, "after")), "common-layout-mismatch")


@query("""
WITH e AS (SELECT user_id AS u, event_id % 5 AS v, event_type IN ('click', 'view') AS w, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT u, v, min_by(w, event_id) AS w, min_by(i, event_id) AS i FROM e GROUP BY 1, 2), o AS (SELECT user_id AS u, event_id % 5 AS v, min_by(event_type IN ('click', 'view'), event_id) AS w FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)
SELECT 'g/s' || u || '.f90' AS path, CAST(1 + i AS INTEGER) AS line, 'medium' AS severity FROM f WHERE NOT w AND (u, v) NOT IN (SELECT (u, v) FROM o WHERE NOT w)
""")
def fortran_reads_unset_local(spark, read):
    """The rule, from text to finding: a routine a user, a statement an event, which sets a variable or adds it up."""
    e = read("events").select("event_id", C("user_id").alias("u"), "event_type")
    v = cat("v", mod("event_id", 5))
    text = F.when(C("event_type").isin("click", "view"), cat("  ", v, " = 1.0")).otherwise(cat("  call add(", v, " + 0.5)"))
    make = lambda df, s: file(joined(df, ["u"], "event_id", text), cat("g/s", C("u"), ".f90"), cat("subroutine s", C("u"), "\n", C("body"), "\nend subroutine\n"), s)
    return alone(make(e.filter(mod("event_id", 3) == 0), "before").unionByName(make(e, "after")), "reads-unset-local")


@query("SELECT 'h/c' || s_suppkey || '.f90' AS path, CAST(2 AS INTEGER) AS line, 'critical' AS severity FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey % 4 <> 2")
def fortran_implicit_interface(spark, read):
    """implicit-interface-arg-mismatch, from text to finding: a caller a supplier, some of which hand over another number of arguments now."""
    s = read("supplier").select(C("s_suppkey").alias("k"), mod("s_nationkey", 4).cast("int").alias("n"))
    args = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n + 1), lambda x: F.concat(F.lit("x"), x.cast("string"))), ", ")
    now = F.when(mod("k", 2) == 0, C("n")).otherwise(2)
    make = lambda n, snapshot: file(s, cat("h/c", C("k"), ".f90"), cat("subroutine c", C("k"), "\n  call taker(", args(n), ")\nend subroutine\n"), snapshot)
    one = s.orderBy("k").limit(1)
    taker = lambda snapshot: file(one, F.lit("h/taker.f90"), F.lit("subroutine taker(a, b, c)\n  c = a + b\nend subroutine\n"), snapshot)
    return alone(make(F.lit(2), "before").unionByName(make(now, "after")).unionByName(taker("before")).unionByName(taker("after")), "implicit-interface-arg-mismatch")


@query("SELECT 'k/r' || p_partkey % 300 || '.f90' AS path, CAST(min(i) + 1 + max(total) AS INTEGER) AS line, 'high' AS severity, 'a' || p_partkey AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 300 ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_partkey % 300) AS total FROM part) WHERE p_size % 3 = 0 AND p_partkey % 4 = 0 GROUP BY p_partkey")
def fortran_intent_out(spark, read):
    """intent-out-read-before-write, from text to finding: arguments a part, some of which are read now before they are set."""
    p = read("part").select("p_partkey", "p_size", mod("p_partkey", 300).alias("r"))
    name = cat("a", C("p_partkey"))
    given = joined(p, ["r"], "p_partkey", cat("  real, intent(", F.when(mod("p_size", 3) == 0, "out").otherwise("inout"), ") :: ", name)).withColumnRenamed("body", "given")
    names = joined(p, ["r"], "p_partkey", name, ", ").withColumnRenamed("body", "names")

    def make(changed, snapshot: str) -> DataFrame:
        body = joined(p, ["r"], "p_partkey", cat("  ", name, " = ", F.when(changed, name).otherwise("0.0"), " + 1.0"))
        return file(body.join(given, "r").join(names, "r"), cat("k/r", C("r"), ".f90"), cat("subroutine r", C("r"), "(", C("names"), ")\n", C("given"), "\n", C("body"), "\nend subroutine\n"), snapshot)

    both = make(F.lit(False), "before").unionByName(make(mod("p_partkey", 4) == 0, "after"))
    rule = "intent-out-read-before-write"
    found = check.check(both, rules={rule: registry.RULES[rule]}).findings
    return found.select("path", "line", "severity", F.regexp_extract("message", r"argument (\w+)", 1).alias("name"))
