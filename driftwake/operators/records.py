"""Values of named constants, sizes of types and layouts of records, over facts of declarations.

A constant may be said in terms of others and a type in terms of others, in whatever file, so both are worked out in rounds: each
joins what waits with what the last round has made known, until nothing new comes. A round is a join and an aggregation over all
scopes at once; their number is the depth of nesting. `keys` name the scope (a version of a project).

Layouts follow the usual rules of 64-bit systems: members at multiples of their alignment, the whole a multiple of the largest, bit
fields packed into units of their type, unions at zero.

Edge cases: a name defined twice in a scope counts once, the last file and line standing; what refers to itself, or to something
that no file declares, has no value (null), and no layout; a flexible or empty array has no size; empty tables give empty ones."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from driftwake.operators.graph import cut_in_loop

C = F.col
#: Sizes of C's own types on 64-bit systems, which are their alignments too.
SIZES = {
    "char": 1, "signed char": 1, "unsigned char": 1, "_Bool": 1, "bool": 1, "short": 2, "unsigned short": 2, "int": 4, "unsigned int": 4, "long": 8, "unsigned long": 8, "long long": 8, "unsigned long long": 8,
    "float": 4, "double": 8, "long double": 16, "__int128": 16, "unsigned __int128": 16, "int8_t": 1, "uint8_t": 1, "int16_t": 2, "uint16_t": 2, "int32_t": 4, "uint32_t": 4, "int64_t": 8, "uint64_t": 8,
    "size_t": 8, "ssize_t": 8, "ptrdiff_t": 8, "intptr_t": 8, "uintptr_t": 8, "time_t": 8, "off_t": 8, "wchar_t": 4, "char16_t": 2, "char32_t": 4, "pid_t": 4, "uid_t": 4, "gid_t": 4, "mode_t": 4,
}
POINTER = 8
NAME = r"(?<![\w.'\\])[A-Za-z_]\w*"
BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.LShift: operator.lshift, ast.RShift: operator.rshift, ast.BitOr: operator.or_, ast.BitAnd: operator.and_, ast.BitXor: operator.xor,
    ast.Div: lambda a, b: int(a / b) if abs(a) < 1 << 52 else a // b, ast.Mod: lambda a, b: a - b * int(a / b),
}
UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Invert: operator.invert}


def number(expr: str | None) -> int | None:
    """The value of an integer expression of C without names; None if it is none, or past 64 bits."""
    text = re.sub(r"(?i)\b(0x[0-9a-f]+|\d+)[ul]+\b", r"\1", expr or "")
    text = re.sub(r"\b0+(?=[0-7])", "0o", text)
    text = re.sub(r"'(\\?.)'", lambda m: str(ord({"\\n": "\n", "\\t": "\t", "\\0": "\0", "\\r": "\r"}.get(m[1], m[1][-1]))), text)

    def value(n: ast.AST) -> int:
        if isinstance(n, ast.Constant) and isinstance(n.value, int):
            return int(n.value)
        if isinstance(n, ast.BinOp) and type(n.op) in BINARY:
            a, b = value(n.left), value(n.right)
            if isinstance(n.op, (ast.LShift, ast.RShift)) and not 0 <= b < 64:
                raise ValueError
            return BINARY[type(n.op)](a, b)
        if isinstance(n, ast.UnaryOp) and type(n.op) in UNARY:
            return UNARY[type(n.op)](value(n.operand))
        raise ValueError

    try:
        out = value(ast.parse(text.strip(), mode="eval").body)
        return out if -(1 << 63) <= out < 1 << 63 else None
    except (ValueError, SyntaxError, ZeroDivisionError, RecursionError, OverflowError, MemoryError):
        return None


def numbers(expr: str) -> Column:
    """`number` of a column of expressions."""
    def run(texts: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known[e] if e in known else known.setdefault(e, number(e)) for e in texts], dtype="Int64")

    return F.pandas_udf(run, "long")(expr)


def last_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row a name of a scope: the last in the order of path and line."""
    w = Window.partitionBy(*by).orderBy(F.desc("path"), F.desc("line"))
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def constants(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, owner, name, value. rows: keys, owner (null: a macro), name, expr, plus (added to what expr gives)."""
    open_ = cut_in_loop(rows.select(*keys, "owner", "name", "expr", "plus", F.array_distinct(F.regexp_extract_all("expr", F.lit(f"({NAME})"), F.lit(1))).alias("names")))  # read four times a round
    known = None
    while True:
        ready = open_.filter("size(names) = 0").select(*keys, "owner", "name", (numbers("expr") + C("plus")).alias("value"))
        new = cut_in_loop(ready)
        known = new if known is None else known.unionByName(new)  # of written parts, as many as constants are deep
        if not new.head(1):
            return known
        # names mean what any owner says; of several the least, so that rounds do not depend on order
        given = new.filter("value IS NOT NULL").groupBy(*keys, C("name").alias("used")).agg(F.min("value").alias("is"))
        waiting = open_.filter("size(names) > 0")
        asked = waiting.select(*keys, F.explode("names").alias("used")).distinct().join(given, [*keys, "used"])
        per = waiting.select(*keys, "expr", F.explode("names").alias("used")).distinct().join(asked, [*keys, "used"]).groupBy(*keys, "expr").agg(F.collect_list(F.struct("used", "is")).alias("values"))
        said = F.aggregate("values", C("expr"), lambda e, v: F.regexp_replace(e, F.concat(F.lit(r"(?<![\w.])"), v["used"], F.lit(r"(?!\w)")), F.concat(F.lit("("), v["is"].cast("string"), F.lit(")"))))
        left = waiting.join(per, [*keys, "expr"], "left").withColumn("expr", F.coalesce(said, "expr"))
        open_ = cut_in_loop(left.select(*keys, "owner", "name", "expr", "plus", F.array_except("names", F.coalesce(F.transform("values", lambda v: v["used"]), F.array().cast("array<string>"))).alias("names")))


def measured(fields: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """fields with n (how many its dimensions make, null if that can't be known) and width (of a bit field)."""
    row = [*keys, "owner", "at"]
    given = values.groupBy(*keys, C("name").alias("used")).agg(F.min("value").alias("is"))
    wide = F.array_compact(F.array(F.when(C("bits").isNotNull(), F.struct(F.lit("bits").alias("what"), C("bits").alias("expr")))))
    asked = fields.select(*row, F.posexplode(F.concat(F.transform("dims", lambda d: F.struct(F.lit("dim").alias("what"), d.alias("expr"))), wide)).alias("i", "x")).select(*row, "i", "x.*")
    names = F.array_distinct(F.regexp_extract_all("expr", F.lit(f"({NAME})"), F.lit(1)))
    plain, named = asked.filter(F.size(names) == 0), asked.filter(F.size(names) > 0)
    per = named.select(*row, "i", "what", "expr", F.explode(names).alias("used")).join(given, [*keys, "used"], "left").groupBy(*row, "i", "what", "expr").agg(F.collect_list(F.struct("used", "is")).alias("values"))
    said = F.aggregate("values", C("expr"), lambda e, v: F.regexp_replace(e, F.concat(F.lit(r"(?<![\w.])"), v["used"], F.lit(r"(?!\w)")), F.coalesce(F.concat(F.lit("("), v["is"].cast("string"), F.lit(")")), F.lit("?"))))
    every = plain.select(*row, "what", "expr").unionByName(per.select(*row, "what", said.alias("expr")))
    told = every.select(*row, "what", F.when(F.trim("expr") == "", F.lit(0).cast("long")).otherwise(numbers("expr")).alias("v"))
    sums = told.groupBy(*row).agg(F.max(F.when(C("what") == "bits", C("v"))).alias("width"), F.collect_list(F.when(C("what") == "dim", F.struct("v"))).alias("ds"))
    product = F.aggregate("ds", F.lit(1).cast("long"), lambda a, d: a * d["v"])
    return fields.join(sums, row, "left").withColumn("n", F.when(C("ds").isNull(), F.lit(1).cast("long")).otherwise(product)).withColumn("lost", C("bits").isNotNull() & C("width").isNull()).drop("ds")


PLACE = StructType([StructField("field", StringType()), StructField("at", IntegerType()), StructField("offset", LongType()), StructField("size", LongType()), StructField("type", StringType())])
PLACED = StructType([StructField("most", LongType()), StructField("align", LongType()), StructField("out", ArrayType(PLACE))])
PLACES = pa.struct([("field", pa.string()), ("at", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("type", pa.string())])
FIELDS_HELD = 20_000


def offsets(kind: str | None, fields: Iterable[tuple]) -> tuple[list[int], list[int], int, int]:
    """Of a record's fields (size, align, n, width) in order: where each begins and how long it is, the end of the last one, and the record's
    alignment; one pass. In bits, but for sizes and alignments that are given."""
    starts, lengths, pos, most, whole = [], [], 0, 0, 1
    for size, align, n, width in fields:
        bits = size * n * 8 if width is None else width
        unit = 8 * (size if width else align)
        if kind == "union":
            start = 0
        elif not width or pos % unit + width > unit:
            start = -(-pos // unit) * unit
        else:
            start = pos
        pos = start + bits
        most = max(most, pos)
        if kind == "union" or width != 0:
            whole = max(whole, align)
        starts.append(start)
        lengths.append(bits)
    return starts, lengths, most, whole


def placed(rows: DataFrame) -> DataFrame:
    """rows(kind, fields, ...) with l (PLACED): records leave FIELDS_HELD fields at a time, and one is held whole."""
    schema = StructType([*rows.schema.fields, StructField("l", PLACED)])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, start, held = [], 0, 0
            for i in range(b.num_rows):
                f = b.column("fields")[i].values
                x, bits, most, align = offsets(b.column("kind")[i].as_py(), zip(*(f.field(c).to_pylist() for c in ("size", "align", "n", "width"))))
                out = pa.StructArray.from_arrays([f.field("name"), f.field("at"), pa.array(x, pa.int64()), pa.array(bits, pa.int64()), f.field("said")], fields=list(PLACES))
                done.append((most, align, out))
                held += len(f)
                if held >= FIELDS_HELD or i + 1 == b.num_rows:
                    ends = pa.array(np.cumsum([0, *(len(d[2]) for d in done)]), pa.int32())
                    outs = pa.ListArray.from_arrays(ends, pa.concat_arrays([d[2] for d in done]))
                    l = pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), outs], names=["most", "align", "out"])
                    yield pa.RecordBatch.from_arrays([*b.slice(start, len(done)).columns, l], names=[*names, "l"])
                    done, start, held = [], i + 1, 0

    return rows.mapInArrow(run, schema)


def sized(records: DataFrame, aliases: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Layouts: keys, name, path, line, size (bytes, null if unknown), fields (field, at, offset and size in bits, type), in the order of
    declaration. records: keys, name, kind, path, line, fields(name, base, pointer, dims, bits, said); aliases: keys, name, base,
    pointer, dims, path, line; values: what constants gives."""
    one = last_of(records, [*keys, "name"])
    flat = one.select(*keys, "name", F.posexplode("fields").alias("at", "f")).select(*keys, C("name").alias("owner"), "at", "f.*")
    named = last_of(aliases, [*keys, "name"]).select(*keys, C("name").alias("owner"), F.lit(-1).alias("at"), F.lit(None).cast("string").alias("name"), "base", "pointer", "dims", F.lit(None).cast("string").alias("bits"), C("base").alias("said"))
    own = F.create_map(*(F.lit(x) for kv in SIZES.items() for x in kv))
    parts = measured(flat.unionByName(named), values, keys)
    given = F.when(C("pointer"), F.lit(POINTER)).when(C("base").startswith("enum "), F.lit(4)).otherwise(own[C("base")]).cast("long")
    parts = cut_in_loop(parts.withColumn("size", given).withColumn("align", given))
    kinds = one.select(*keys, C("name").alias("owner"), "kind")
    empty = kinds.join(parts.select(*keys, "owner").distinct(), [*keys, "owner"], "left_anti").select(*keys, C("owner").alias("type"), F.lit(0).cast("long").alias("t_size"), F.lit(1).cast("long").alias("t_align"))
    known = layouts = None
    while True:
        # what has no part left without a size, and was not known before
        waiting = parts if known is None else parts.join(known.select(*keys, C("type").alias("owner")), [*keys, "owner"], "left_anti")
        whole = waiting.groupBy(*keys, "owner").agg(F.count_if(C("size").isNull() | C("n").isNull() | C("lost")).alias("open"), F.array_sort(F.collect_list(F.struct("at", "name", "size", "align", "n", "width", "said"))).alias("fields")).filter("open = 0")
        told = placed(whole.join(kinds, [*keys, "owner"], "left"))
        total = F.when(C("kind").isNull(), C("fields")[0]["size"] * C("fields")[0]["n"]).otherwise((F.ceil(C("l.most") / (C("l.align") * 8)) * C("l.align")).cast("long"))
        new = cut_in_loop(told.select(*keys, C("owner").alias("type"), total.alias("t_size"), F.when(C("kind").isNull(), C("fields")[0]["align"]).otherwise(C("l.align")).alias("t_align"), F.when(C("kind").isNotNull(), C("l.out")).alias("out")))
        layouts = new if layouts is None else layouts.unionByName(new)  # of written parts, as many as types are deep
        fresh = new.select(*keys, "type", "t_size", "t_align")
        if known is None:
            fresh = fresh.unionByName(empty)
        known = fresh if known is None else known.unionByName(fresh)
        if not new.head(1):
            break
        by = fresh.withColumnRenamed("type", "base")
        parts = cut_in_loop(parts.join(by, [*keys, "base"], "left").withColumn("size", F.coalesce("size", "t_size")).withColumn("align", F.coalesce("align", "t_align")).drop("t_size", "t_align"))
    found = layouts.filter("out IS NOT NULL").select(*keys, C("type").alias("name"), C("t_size").alias("size"), C("out"))
    plain = F.transform("fields", lambda f, i: F.struct(f["name"].alias("field"), i.alias("at"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("size"), f["said"].alias("type")))
    out = one.join(found, [*keys, "name"], "left")
    size = F.when(F.size(C("fields")) == 0, F.lit(0).cast("long")).otherwise(C("size"))
    return out.select(*keys, "name", "path", "line", size.alias("size"), F.coalesce("out", plain).alias("fields"))


def field_rows(layouts: DataFrame, keys: list[str]) -> DataFrame:
    """A row a field, and one without a name for the whole; members without a name are told by their place."""
    own = F.coalesce(C("f.field"), F.concat(F.lit("#"), C("f.at").cast("string")))
    each = layouts.select(*keys, C("name").alias("owner"), F.explode("fields").alias("f")).select(*keys, "owner", own.alias("field"), "f.at", "f.offset", "f.size", "f.type")
    return each.unionByName(layouts.select(*keys, C("name").alias("owner"), F.lit("").alias("field"), F.lit(-1).alias("at"), F.lit(0).cast("long").alias("offset"), (C("size") * 8).alias("size"), F.lit("").alias("type")))


def of_enum(switches: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """J26. Which enum a switch is over: one that owns a label. keys, owner, holder, subject, line, path, member, has_default; a row a label.
    A label that several enums own goes with the one that owns most of the switch's."""
    one = [*keys, "path", "holder", "subject", "line"]
    s = switches.select(*one, "has_default", F.explode(F.array_distinct("labels")).alias("member"))
    j = s.join(members.select(*keys, "owner", "member").distinct(), [*keys, "member"])
    most = j.groupBy(*one, "owner").agg(F.count("*").alias("n")).groupBy(*one).agg(F.max(F.struct("n", "owner")).alias("m")).select(*one, C("m.owner").alias("owner"))
    return j.join(most, [*one, "owner"])


def line_text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
