"""Column expressions over names, paths and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwake.values import SKIPPED, SUFFIXES

WORDS = r"[A-Za-z_][A-Za-z0-9_-]*"
#: Fixed value. What parts a name into words.
NAME_WORDS = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"


def module_name(path: Column) -> Column:
    """P1. src/pkg/mod.py -> pkg.mod; pkg/__init__.py -> pkg."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^src/", ""), r"\.py$", ""), r"(^|/)__init__$", "")
    return F.translate(bare, "/", ".")


def language(path: Column) -> Column:
    """P2. By suffix, null where unknown."""
    out, suffix = F.lit(None).cast("string"), F.regexp_extract(path, r"\.([A-Za-z0-9+]+)$", 1)
    for name, suffixes in SUFFIXES.items():
        out = F.when(suffix.isin(*suffixes), name).otherwise(out)
    return out


def in_skipped_dir(path: Column) -> Column:
    """P3. Is any directory of the path one that scans leave out?"""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*SKIPPED) | d.startswith("."))


def is_test_path(path: Column) -> Column:
    """P4. As rules see it: a tests directory, or a name that test runners collect."""
    return path.rlike(r"(^|/)(tests?|testing)/") | path.rlike(r"(^|/)(test_[^/]*|[^/]*_test\.py|conftest\.py)$")


def is_test_file(path: Column) -> Column:
    """P5. As the brief sees it: for Python the file's stem alone decides, else the directory or the stem."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    by_stem = stem.startswith("test") | stem.endswith("_test")
    return F.when(path.endswith(".py"), by_stem).otherwise(by_stem | path.rlike(r"(^|/)(tests?|testing)/"))


def tokens(text: Column) -> Column:
    """F4."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def name_words(name: Column) -> Column:
    """F5. camelCase, snake_case and digits apart, in lower case."""
    return F.transform(F.regexp_extract_all(name, F.lit(NAME_WORDS), F.lit(0)), lambda w: F.lower(w))


def shingles(words: Column, size: int) -> Column:
    """W8. Hashes of each `size` consecutive words. Shifted copies are zipped, since a lambda that slices the words
    would have their expression worked out again for each place."""
    n = F.size(words)
    shifted = [F.slice(words, i + 1, F.greatest(n, F.lit(1))) for i in range(size)]
    whole = F.slice(F.arrays_zip(*shifted), 1, F.greatest(n - size + 1, F.lit(0)))
    return F.transform(whole, lambda x: F.xxhash64(x))


def short_hash(*parts: Column | str) -> Column:
    """F1. The first 12 hex digits of the SHA-1 of the parts, parted by NUL."""
    return F.substring(F.sha1(F.concat_ws("\0", *parts)), 1, 12)


def content_hash(text: Column) -> Column:
    """F2. Line endings do not count."""
    return F.substring(F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256), 1, 16)


def shortened(text: Column, most: int) -> Column:
    """P16. White space collapsed; cut with an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 1)), F.lit("…"))).otherwise(one)


def distribution(name: Column) -> Column:
    """F7. A distribution's name as package indexes compare it."""
    return F.lower(F.regexp_replace(F.trim(name), r"[-_.]+", "-"))


def counted(n: Column, noun: str, plural: str | None = None) -> Column:
    """F15. 1 file, 2 files."""
    return F.concat(n.cast("string"), F.when(n == 1, " " + noun).otherwise(" " + (plural or noun + "s")))


def glob_regex(pattern: str) -> str:
    """P9. A glob whose star crosses directories, or a directory's prefix."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.removeprefix("./").rstrip("/"))
    return f"^{body}(/.*)?$"


def excluded(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def picture_digits(picture: Column) -> Column:
    """F13. Digits that a numeric picture like S9(5)V99 holds before and after the point."""
    def count(part: Column) -> Column:
        runs = F.regexp_extract_all(part, F.lit(r"9(?:\((\d+)\))?"), F.lit(1))
        return F.aggregate(runs, F.lit(0), lambda acc, x: acc + F.when(x == "", 1).otherwise(x.cast("int")))

    halves = F.split(F.upper(picture), "V")
    return F.struct(count(halves[0]).alias("whole"), F.when(F.size(halves) > 1, count(F.get(halves, F.lit(1)))).otherwise(0).alias("fraction"))


def big_o(degree: Column, log: Column) -> Column:
    """F14."""
    poly = F.when(degree == 0, "1").when(degree == 1, "n").otherwise(F.concat(F.lit("n^"), degree.cast("string")))
    logs = F.when(log == 0, "").when(log == 1, " log n").otherwise(F.concat(F.lit(" log^"), log.cast("string"), F.lit(" n")))
    return F.concat(F.lit("O("), F.when((degree == 0) & (log > 0), F.trim(logs)).otherwise(F.concat(poly, logs)), F.lit(")"))
