"""Copybooks put where they are copied, and bytes of records.

COPY ... REPLACING is opened in rounds: each joins what is still to be copied with the books of its scope, until no copy is left; a
book within itself is not opened again. An item keeps its place as an array of ordinals, one a level of copying, so no text is
ever spliced. A record (a level 01 or 77, or what stands before one in a book) is then read in one pass; levels are its tree (an item's
parent is the last before it with a smaller level), and sizes and offsets are sums over it: of elementary items times how often they
occur, without what redefines; an item that redefines begins where the item before it that does not redefine does.

Edge cases: a book that is not there gives nothing; books of one name in a scope count once, the first path standing; groups
without elementary items have no size; copies within copies take the inner replacement first; empty tables give empty ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwake.operators.graph import cut_in_loop

C = F.col
ABOUT = ["level", "name", "pic", "usage", "bytes", "kind", "whole", "fraction", "occurs", "redefines"]
BATCH = 10_000


def replaced(name: Column, pairs: Column) -> Column:
    def one(n: Column, p: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), p["was"], F.lit(r"\E"))
        word = F.concat(F.lit(r"(?<![\w-])"), quoted, F.lit(r"(?![\w-])"))
        return F.regexp_replace(n, F.when(p["whole"], word).otherwise(quoted), p["now"])

    return F.aggregate(pairs, name, one)


def opened(items: DataFrame, copies: DataFrame, books: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, program, place (array), origin (the file an item stands in), line, and the columns of items. items and copies: keys, path,
    program, ord, line; copies also book, replacing; books: keys, book, path. Rounds are as many as copies stand in each other."""
    origin = items.select(*keys, "path", "program", F.array(C("ord").cast("long")).alias("place"), C("path").alias("origin"), "line", *ABOUT)
    found = [origin]
    first = books.groupBy(*keys, "book").agg(F.min("path").alias("target"))
    inner_items = items.select(*keys, C("path").alias("target"), C("ord").alias("at"), C("line").alias("l"), *ABOUT)
    inner_copies = copies.select(*keys, C("path").alias("target"), C("ord").alias("at"), C("book").alias("next"), C("replacing").alias("more"))
    open_ = copies.select(*keys, "path", "program", F.array(C("ord").cast("long")).alias("place"), "book", "replacing", F.array("path").alias("seen"))
    while True:
        met = cut_in_loop(open_.join(first, [*keys, "book"]).filter(~F.array_contains("seen", C("target"))).drop("book"))
        if not met.head(1):
            break
        here = met.join(inner_items, [*keys, "target"])
        changed = {"name": replaced(C("name"), C("replacing")), "redefines": replaced(C("redefines"), C("replacing"))}
        found.append(here.select(*keys, "path", "program", F.concat("place", F.array(C("at").cast("long"))).alias("place"), C("target").alias("origin"), C("l").alias("line"), *(changed.get(c, C(c)).alias(c) for c in ABOUT)))
        open_ = met.join(inner_copies, [*keys, "target"]).select(*keys, "path", "program", F.concat("place", F.array(C("at").cast("long"))).alias("place"), C("next").alias("book"), F.concat("more", "replacing").alias("replacing"), F.concat("seen", F.array("target")).alias("seen"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def record(rows: list[tuple]) -> Iterator[tuple]:
    """(level, name, bytes, occurs, redefines) of a record's items in order -> (record, field, offset, size) of each: up the tree for
    sizes, down it for offsets."""
    n, parents, stack = len(rows), [], []
    for i, (level, *_) in enumerate(rows):
        while stack and rows[stack[-1]][0] >= level:
            stack.pop()
        parents.append(stack[-1] if stack else None)
        stack.append(i)
    inner: list[int | None] = [None] * n  # bytes of what an item holds, without what redefines
    for i in range(n - 1, -1, -1):
        own, held, parent = rows[i][2], inner[i], parents[i]
        if parent is not None and rows[i][4] is None and (own is not None or held is not None):
            inner[parent] = (inner[parent] or 0) + rows[i][3] * ((own or 0) + (held or 0))
    ends: dict[int | None, tuple[int, int]] = {}  # of a parent: where its next item begins, and where its last that does not redefine began
    told: list[tuple] = []
    for i, (_, name, bytes_, occurs, redefines) in enumerate(rows):
        size, parent = inner[i] if bytes_ is None else bytes_, parents[i]
        after, last = ends.get(parent, (0, 0))
        begin = after if redefines is None else last
        if redefines is None:
            ends[parent] = (begin + (size or 0) * occurs, begin)
        top, field, offset = (name, name, begin) if parent is None else (told[parent][0], f"{told[parent][1]}.{name}", told[parent][2] + begin)
        told.append((top, field, offset, size))
    return iter(told)


def laid_out(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, program, record, field (names from the record down), name, offset and size (bytes; size of one occurrence), pic, usage,
    kind, whole, occurs, redefines, origin, line. items: what opened gives. A unit's items come to one task in the order of their places,
    which holds a record at a time; work on a record grows with its items."""
    unit = [*keys, "path", "program"]
    about = ["pic", "usage", "kind", "whole", "occurs", "redefines", "origin", "line"]
    need = ["level", "name", "bytes", "occurs", "redefines"]
    rows = items.select(*unit, "place", *ABOUT, "origin", "line").repartition(*unit).sortWithinPartitions(*unit, "place", *ABOUT)
    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {of[c]}" for c in unit), "record string, field string, name string, offset long, size long", *(f"`{c}` {of[c]}" for c in about)])
    columns = [*unit, "record", "field", "name", "offset", "size", *about]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, types = None, [], None  # of a record: (unit, what record needs, the rest)

        def batch(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=columns)

        def told() -> list[tuple]:
            return [(*now, *t[:2], own[1], *t[2:], *rest) for t, (own, rest) in zip(record([own for own, _ in held]), held)]

        done: list[tuple] = []
        for b in batches:
            if types is None:
                known = b.schema
                types = [known.field(c).type if c in known.names else pa.int64() if c in ("offset", "size") else pa.string() for c in columns]
            each = [list(zip(*(b.column(c).to_pylist() for c in cs))) for cs in (unit, need, about)]
            for who, own, rest in zip(*each):
                if held and (who != now or own[0] in (1, 77)):
                    done += told()
                    held = []
                    if len(done) >= BATCH:
                        yield batch(done)
                        done = []
                now = who
                held.append((own, rest))
        if held:
            done += told()
        if done:
            yield batch(done)

    return rows.mapInArrow(run, schema)
