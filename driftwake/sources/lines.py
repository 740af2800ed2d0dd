"""Texts line by line: comments and strings masked, line patterns, differences, close names, statements.

Masking, patterns over whole texts, differences and close matches are sequential in a text, so they run over Arrow batches; all else is
column functions."""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwake.functions.text import language
from driftwake.operators.graph import cut
from driftwake.values import HIDDEN_CALLS, LEGACY, URGENCY

C = F.col
STRINGS = r"'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\""
COMMENTS = {"python": r"\#[^\n]*", "c": r"//[^\n]*|/\*.*?\*/", "fortran": r"![^\n]*", "fixed": r"![^\n]*|(?m:^[cC*][^\n]*)", "cobol": r"(?m:^.{6}[*/][^\n]*)|\*>[^\n]*"}
LEAD = re.compile(r"(?:[=;{}(),!&|?:+\-][ \t]*\n\s*)?")
FIXED_FORM = (".f", ".for", ".f77", ".ftn", ".fpp")
FAMILY = {"c": "c", "cpp": "c", "java": "c", "typescript": "c"}


def mask(text: str, lang: str, path: str = "", strings: bool = True) -> str:
    """F11. text with comments (and, if asked, what strings hold) as blanks; quotes, line ends and all places stay."""
    comment = COMMENTS["fixed"] if lang == "fortran" and path.lower().endswith(FIXED_FORM) else COMMENTS.get(FAMILY.get(lang, lang))
    quoted = r"'[^'\n]*'|\"[^\"\n]*\"" if lang in ("fortran", "cobol") else STRINGS
    blank = lambda s: re.sub(r"[^\n]", " ", s)

    def hide(m: re.Match) -> str:
        s = m[0]
        if s[0] not in "'\"":
            return blank(s)
        if not strings:
            return s
        q = 3 if len(s) >= 6 and s[:3] in ("'''", '"""') else 1
        return s[:q] + blank(s[q:-q]) + s[-q:]

    return re.sub(f"{quoted}|{comment}" if comment else quoted, hide, text, flags=re.S)


def masked(files: DataFrame) -> DataFrame:
    """files(path, text, ...) with text masked, of languages that are known."""
    rows = files.withColumn("lang", language(C("path"))).filter("lang IS NOT NULL")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["text"] = [mask(t, lang, path) for t, lang, path in zip(p["text"], p["lang"], p["path"])]
            yield p

    return rows.mapInPandas(run, rows.schema)


def needed(pattern: str) -> list[str]:
    """Texts of which one stands in whatever the pattern matches, the longest that can be told; empty if none can."""
    def of(seq) -> set[str]:
        found, run = [], ""
        for op, about in [*seq, (None, None)]:
            if op is parser.LITERAL:
                run += chr(about)
                continue
            found.append({run} if run else set())
            run = ""
            if op is parser.SUBPATTERN:
                found.append(of(about[3]))
            elif op is parser.BRANCH:
                ways = [of(b) for b in about[1]]
                found.append(set().union(*ways) if all(ways) else set())
            elif op is parser.MAX_REPEAT and about[0]:
                found.append(of(about[2]))
        return max((f for f in found if f), key=lambda f: min(map(len, f)), default=set())

    return sorted(of(parser.parse(pattern)))


def scan(files: DataFrame, rules=LEGACY) -> DataFrame:
    """F12. path, line, rule, level: each rule once a line, on code without comments and strings; a line is that of a match's start (of the
    name that a K&R definition defines; a sign that only ends the line before is no start). Rules are (language, id, level, pattern). Patterns are tried on whole texts, for what they look for
    may stand over several lines, and only where a text holds a literal that they need."""
    rows = files.select("path", "text").withColumn("lang", language(C("path"))).filter("lang IS NOT NULL")
    known: dict[str, list] = {}
    for lang, id_, level, pattern in rules:
        known.setdefault(lang, []).append((id_, level, pattern, needed(pattern)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {lang: [(i, level, re.compile(p, re.M | (re.I if lang in ("fortran", "cobol") else 0)), [n.lower() for n in need]) for i, level, p, need in own] for lang, own in known.items()}
        for part in parts:
            out = []
            for path, text, lang in zip(part["path"], part["text"], part["lang"]):
                code = mask(text or "", lang, path)
                low, starts = code.lower(), [0, *(i + 1 for i, c in enumerate(code) if c == "\n")]
                for id_, level, pattern, need in ready.get(lang, ()):
                    if need and not any(n in low for n in need):
                        continue
                    places = {m.start(1) if id_ == "c-kr-definition" else m.start() + len(LEAD.match(m[0])[0]) for m in pattern.finditer(code)}
                    out += [(path, n, id_, level) for n in {bisect.bisect_right(starts, at) for at in places}]
            yield pd.DataFrame(out, columns=["path", "line", "rule", "level"])

    return rows.mapInPandas(run, "path string, line int, rule string, level string").distinct()


def hidden_calls(files: DataFrame) -> DataFrame:
    """F12. path, line, rule: places where what is called is only known when it runs."""
    return scan(files, HIDDEN_CALLS).drop("level")


def legacy_summary(markers: DataFrame, uses: DataFrame) -> DataFrame:
    """A15. path, markers, a count a level, dependents, priority: urgency times the root of one more than the files that use it.
    markers(path, level), uses(src_path, dst_path)."""
    levels = markers.groupBy("path").agg(F.count("*").alias("markers"), *(F.count_if(C("level") == k).alias(k) for k in URGENCY))
    users = uses.filter("src_path <> dst_path").groupBy(C("dst_path").alias("path")).agg(F.countDistinct("src_path").alias("dependents"))
    urgency = sum((C(k) * w for k, w in URGENCY.items()), F.lit(0))
    return levels.join(users, "path", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0))).withColumn("priority", urgency * F.sqrt(C("dependents") + 1))


def whole_word(name: Column, lang: Column) -> Column:
    """F6. A pattern for a name as a whole word: COBOL's words have hyphens, Fortran and COBOL ignore case."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    plain = F.concat(F.lit(r"(?<!\w)"), quoted, F.lit(r"(?!\w)"))
    return F.when(lang == "cobol", F.concat(F.lit(r"(?i)(?<![\w-])"), quoted, F.lit(r"(?![\w-])"))).when(lang == "fortran", F.concat(F.lit("(?i)"), plain)).otherwise(plain)


FEW_NAMES = 100_000


def mentions(files: DataFrame, names: DataFrame) -> DataFrame:
    """F6. name, path, line: lines that say a name as a whole word. files(path, text), names(name). Lines meet names by their
    words; the exact pattern decides. Few names are broadcast; to more than FEW_NAMES go words without their lines, which join again
    what met."""
    lines = files.withColumn("lang", F.coalesce(language(C("path")), F.lit("python"))).select("path", "lang", F.posexplode(F.split("text", "\n")).alias("at", "row"))
    lines = lines.select("path", "lang", (C("at") + 1).alias("line"), "row")
    fold = lambda c: F.lower(F.regexp_extract(c, r"\w+", 0))
    each = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("row", F.lit(r"\w+"), F.lit(0)), F.lower))).alias("word")
    asked = cut(names.select("name", fold(C("name")).alias("word")).distinct())
    if asked.count() <= FEW_NAMES:
        j = lines.select("*", each).join(F.broadcast(asked), "word")
    else:
        own = F.xxhash64("row").alias("own")
        met = lines.select("path", "line", own, each).join(asked, "word").select("path", "line", "own", "name").distinct()
        j = lines.withColumn("own", own).join(met, ["path", "line", "own"])
    return j.filter(F.regexp_like("row", whole_word(C("name"), C("lang")))).select("name", "path", "line").distinct()


def close_matches(asked: DataFrame, known: DataFrame, most: int = 6, cutoff: float = 0.6) -> DataFrame:
    """F9. asked, close: for each asked(name) the known(name) most like it, best first. The known ones are a project's words; they go
    to a task a thousand at a time, each with the best so far, and the lists are merged."""
    from pyspark.sql import Window

    pairs = asked.select(C("name").alias("asked")).distinct().join(known.select("name").distinct().withColumn("part", F.pmod(F.xxhash64("name"), F.lit(64))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        q = part["asked"].iloc[0]
        found = difflib.get_close_matches(q, sorted(map(str, part["name"])), n=most, cutoff=cutoff)
        return pd.DataFrame([(q, x, difflib.SequenceMatcher(None, x, q).ratio()) for x in found], columns=["asked", "name", "ratio"])

    best = pairs.groupBy("asked", "part").applyInPandas(run, "asked string, name string, ratio double")
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("ratio"), F.desc("name")))).filter(C("n") <= most)
    return ranked.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("c")).select("asked", F.transform("c", lambda x: x["name"]).alias("close"))


def changed_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """F10. path, op (replace, delete, insert), first, last (lines of the new text; last < first where lines only went): how each
    file(path, text) of both or either version differs."""
    j = before.select("path", C("text").alias("b")).join(after.select("path", C("text").alias("a")), "path", "full_outer").filter(~C("a").eqNullSafe(C("b")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, b, a in p.itertuples(index=False):
                for op, _, _, j1, j2 in difflib.SequenceMatcher(None, (b or "").splitlines(), (a or "").splitlines()).get_opcodes():
                    if op != "equal":
                        rows.append((path, op, j1 + 1, j2))
            yield pd.DataFrame(rows, columns=["path", "op", "first", "last"])

    return j.mapInPandas(run, "path string, op string, first int, last int")


def statement(lines: list[str], line: int, path: str, lang: str) -> tuple[int, int]:
    """J40. First and last line of the statement that a line is part of: continuation lines in Fortran, up to the period in COBOL (five
    lines at most), elsewhere until brackets close (nine at most)."""
    at = min(max(line, 1), max(len(lines), 1)) - 1
    first = last = at
    if lang == "fortran":
        if path.lower().endswith(FIXED_FORM):
            goes_on = [len(s) > 5 and s[0] not in "cC*!" and s[5] not in " 0" for s in lines]
        else:
            goes_on = [False, *(s.split("!", 1)[0].rstrip().endswith("&") for s in lines[:-1])]
        while first > 0 and goes_on[first]:
            first -= 1
        while last + 1 < len(lines) and goes_on[last + 1]:
            last += 1
    elif lang == "cobol":
        last = next((i for i in range(at, min(at + 6, len(lines))) if lines[i].rstrip().endswith(".")), min(at + 5, len(lines) - 1))
    else:
        depth = 0
        for i in range(at, min(at + 10, len(lines))):
            depth += sum((c in "([{") - (c in ")]}") for c in lines[i])
            last = i
            if depth <= 0:
                break
    return first + 1, last + 1


def statements(files: DataFrame, points: DataFrame) -> DataFrame:
    """points(path, line) with first and last line of their statements; files(path, text)."""
    asked = points.select("path", "line").distinct().groupBy("path").agg(F.collect_list("line").alias("lines"))
    j = files.select("path", "text", F.coalesce(language(C("path")), F.lit("python")).alias("lang")).join(asked, "path")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(path, int(n), *statement(text.split("\n"), int(n), path, lang)) for path, text, lang, lines in p[["path", "text", "lang", "lines"]].itertuples(index=False) for n in lines]
            yield pd.DataFrame(rows, columns=["path", "line", "first", "last"])

    return points.join(j.mapInPandas(run, "path string, line int, first int, last int"), ["path", "line"])
