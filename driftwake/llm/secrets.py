"""Secret scan: three base patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of at least `window` characters of [A-Za-z0-9+/_=-]. Within it, for each character class
(hex, alnum, base64) every window is judged by the entropy of its characters, kept by incremental counts; windows
over the class's threshold that mix kinds of characters join to spans. Windows of allow-listed strings (UUIDs, dates,
paths of words, runs of an alphabet, placeholders) are suppressed, one by one: a key beside such strings is still found.
The base spans are never suppressed.

Edge cases: a null text is empty; texts are scanned whole; each row is judged alone, so repeated rows and null ids
give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.llm.common import in_batches, table

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # greedy runs: the same as the failing-dropped [0-9a-f]+

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Of each class: its runs, the window, and the bits a character a window must reach.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.1),
    "entropy_alnum": (re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.75),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.0),
}
#: What is allow-listed in a candidate: words and numbers between separators, and the separators; runs of an alphabet and
#: placeholders; of a segment that says it is an example, all of it; UUIDs and dates.
ALLOW = re.compile(
    r"(?<![A-Za-z0-9])(?:[A-Za-z]+|\d+)(?![A-Za-z0-9])|[/_=+-]"
    r"|[Xx]{4,}|0{7,}|1234567(?:89?0?)?|abcdefg[h-z]*|ABCDEFG[H-Z]*"
)
EXAMPLE = re.compile(r"[A-Za-z0-9]*(?:EXAMPLE|example)[A-Za-z0-9]*")
LONGER = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|\d{4}-\d\d-\d\d(?:T[\d-]*)?")
#: A window is suppressed if fewer of its characters than this are outside the allow-list.
LEAST_OPEN = 6


def open_places(candidate: str) -> bytearray:
    """1 for each character outside the allow-list."""
    out = bytearray(b"\1") * len(candidate)
    for pattern in (ALLOW, EXAMPLE, LONGER):  # a UUID's parts are words or not, so these have a turn of its own
        for m in pattern.finditer(candidate):
            out[m.start() : m.end()] = bytes(m.end() - m.start())
    return out


def windows(text: str, size: int, bits: float, open_: bytes | None = None) -> Iterator[tuple[int, int]]:
    """Spans of text all of whose windows of `size` have at least `bits` of entropy, hold letters and digits and,
    where open_ is given, at least LEAST_OPEN characters marked there.

    Entropy of a window is log2(size) - sum(c*log2(c))/size; moving by one changes two terms of the sum.
    """
    term = [0.0, 0.0, *(c * math.log2(c) for c in range(2, size + 2))]  # the new character comes before the old one goes
    counts: dict[str, int] = {}
    opened, least = 0, LEAST_OPEN if open_ is not None else 0
    total, digits, letters, most = 0.0, 0, 0, (math.log2(size) - bits) * size
    begin = end = -1
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        digits += c.isdigit()
        letters += c.isalpha()
        opened += open_[i] if least else 0
        if i >= size:
            gone = text[i - size]
            n = counts[gone]
            counts[gone] = n - 1
            total += term[n - 1] - term[n]
            digits -= gone.isdigit()
            letters -= gone.isalpha()
            opened -= open_[i - size] if least else 0
        if i >= size - 1 and total <= most + 1e-9 and digits and letters and opened >= least:
            if begin >= 0 and i - size + 1 > end:
                yield begin, end
                begin = -1
            if begin < 0:
                begin = i - size + 1
            end = i + 1
    if begin >= 0:
        yield begin, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), each kind leftmost without overlaps."""
    out = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        found, at = m[0], m.start()
        if found.isalpha() or found.isdigit():
            continue
        open_ = open_places(found)
        if sum(open_) < LEAST_OPEN:
            continue
        taken: list[tuple[int, int]] = []  # of narrower classes, by start; an end is the furthest so far
        for kind, (runs, size, bits) in CLASSES.items():
            new = []
            for run in runs.finditer(found):
                for a, b in windows(run[0], size, bits, open_[run.start() : run.end()]):
                    a, b = a + run.start(), b + run.start()
                    i = bisect_right(taken, (a, len(found))) - 1
                    if i < 0 or taken[i][1] < b:  # else a narrower class has it: wider ones need not repeat it
                        new.append((a, b))
                        out.append((at + a, KINDS.index(kind), at + b))
            spans = sorted(taken + new)
            taken = list(zip((a for a, _ in spans), accumulate((b for _, b in spans), max)))
    return out


def join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in ARROW]
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                row = (doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(join(base).encode()).hexdigest(), join(sorted(base + entropy_spans(text))))
                for column, x in zip(out, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ARROW)], schema=ARROW)

    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, SCHEMA)


def op3_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
