"""The order of paragraphs: ranges as intervals over it, and which paragraphs control runs off the end of.

Control comes into a program at its first paragraph and at targets of jumps from elsewhere, and runs on from each paragraph that does not
leave into the next. So within a stretch of paragraphs up to one that leaves, all from the first entry on are run in sequence:
a running count and a running maximum over the order, no search. What only PERFORM runs comes back and falls nowhere; inside
a range (but its last) or a section one paragraph runs into the next as it was meant to.

Edge cases: a range whose ends are missing or the wrong way round runs nothing and is not told; of two paragraphs of one name the first
counts; programs without paragraphs have no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def ranges(paragraphs: DataFrame, performs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, program, first, last, members (in order), empty (those of them without statements), path, line (of the first PERFORM): every
    range that is performed."""
    at = paragraphs.groupBy(*keys, "program", "name").agg(F.min("ord").alias("ord"), F.min_by("empty", "ord").alias("empty"), F.min_by("is_section", "ord").alias("is_section"))
    place = lambda c, o: at.select(*keys, "program", C("name").alias(c), C("ord").alias(o))
    sites = performs.filter("last IS NOT NULL").groupBy(*keys, "program", "first", "last").agg(F.min(F.struct("path", "line")).alias("site"))
    ends = sites.join(place("first", "a"), [*keys, "program", "first"]).join(place("last", "z"), [*keys, "program", "last"]).filter("a <= z")
    inside = ends.join(at.filter("NOT is_section"), [*keys, "program"]).filter("ord BETWEEN a AND z")
    held = inside.groupBy(*keys, "program", "first", "last").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "empty"))).alias("m"), F.first("site").alias("site"))
    return held.select(*keys, "program", "first", "last", F.transform("m", lambda x: x["name"]).alias("members"), F.transform(F.filter("m", lambda x: x["empty"]), lambda x: x["name"]).alias("empty"), "site.path", "site.line")


def changed_ranges(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """W5. Ranges performed in both versions that run other paragraphs now: joined (not counting empty ones) and left."""
    on = [*keys, "program", "first", "last"]
    j = after.join(before.select(*on, C("members").alias("was")), on)
    out = j.withColumn("joined", F.array_except(F.array_except("members", "was"), "empty")).withColumn("left", F.array_except("was", "members"))
    return out.filter("size(joined) + size(left) > 0").select(*on, "path", "line", "joined", "left")


def falls(paragraphs: DataFrame, performs: DataFrame, jumps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, program, name, next, ord, empty, path, end_line: paragraphs in sequence, and the paragraph that each runs off its end into."""
    unit = [*keys, "program"]
    w = Window.partitionBy(*unit).orderBy("ord")
    rows = paragraphs.withColumn("next", F.lead("name").over(w)).withColumn("next_section", F.lead("section").over(w)).withColumn("next_is_section", F.lead("is_section").over(w))
    rows = rows.withColumn("stretch", F.coalesce(F.sum(C("leaves").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("start", F.row_number().over(w) == 1)
    place = paragraphs.select(*unit, C("name").alias("paragraph"), C("section").alias("own"))
    goal = paragraphs.select(*unit, C("name").alias("target"), C("section").alias("other"))
    outside = jumps.join(place, [*unit, "paragraph"]).join(goal, [*unit, "target"]).filter("own = '' OR own <> other").select(*unit, C("target").alias("name")).distinct().withColumn("entered", F.lit(True))
    # inside a range, but for its last
    spans = ranges(paragraphs, performs, keys).select(*unit, F.explode(F.expr("slice(members, 1, size(members) - 1)")).alias("name")).distinct().withColumn("ranged", F.lit(True))
    rows = rows.join(outside, [*unit, "name"], "left").join(spans, [*unit, "name"], "left")
    run = Window.partitionBy(*unit, "stretch").orderBy("ord")
    live = F.max(C("start") | F.coalesce("entered", F.lit(False))).over(run)
    within = (C("section") != "") & (C("section") == C("next_section")) & ~C("next_is_section")
    return rows.withColumn("live", live).filter(C("live") & ~C("leaves") & C("next").isNotNull() & C("ranged").isNull() & ~within).select(*unit, "name", "next", "ord", "empty", "path", "end_line")


def changed_falls(before: DataFrame, after: DataFrame, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """W4, G11. keys, program, name, path, line, next, was: paragraphs of both versions that run into another one now. before and after: what
    falls gives; old and new: all paragraphs. Empty paragraphs that came in are passed through, and one that took the place of the one that
    followed (gone, and the new one was not there) is no change."""
    unit = [*keys, "program"]
    there = old.select(*unit, "name").distinct().withColumn("there", F.lit(True))
    falling = after.select(*unit, "ord", "next", "end_line", F.lit(True).alias("falls"))
    marked = new.select(*unit, "ord", "name", "empty", "path").join(falling, [*unit, "ord"], "left").join(there, [*unit, "name"], "left")
    w = Window.partitionBy(*unit).orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    through = C("falls").isNotNull() & C("empty") & C("there").isNull()
    lands = marked.withColumn("lands", F.first(F.when(~through, C("name")), ignorenulls=True).over(w)).filter("falls AND there")
    j = lands.join(before.select(*unit, "name", C("next").alias("was")), [*unit, "name"], "left")
    j = j.filter(~C("next").eqNullSafe(C("was")) & ~F.coalesce(C("lands") == C("was"), F.lit(False)))
    gone = j.join(new.select(*unit, C("name").alias("was"), F.lit(True).alias("was_there")).distinct(), [*unit, "was"], "left").join(there.select(*unit, C("name").alias("next"), C("there").alias("next_there")), [*unit, "next"], "left")
    in_place = C("was").isNotNull() & C("was_there").isNull() & C("next_there").isNull()
    return gone.filter(~in_place).select(*unit, "name", "path", C("end_line").alias("line"), "next", "was")
