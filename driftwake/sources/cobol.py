"""What COBOL texts say of data and of the order of procedures: items with level numbers and pictures, COPY with REPLACING,
paragraphs with how they end, ranges performed, jumps, moves, arguments. Fixed form: columns 8 to 72, comments by column 7 or `*>`.

A reader of sentences: copybooks are not opened and levels not put into trees; that is done over all files together
(operators/copybooks.py, operators/paragraphs.py).

Edge cases: what stands outside the divisions known here is passed over; a copybook is a text without PROGRAM-ID; conditions (level 88)
and renames (66) are no items; an empty text says nothing."""

from __future__ import annotations

import json
import re
from bisect import bisect_left

from driftwake.sources.lines import mask

WORD = r"[A-Z0-9][A-Z0-9-]*"
SENTENCE = re.compile(r"(?:[^.]|\.(?=\S))*\.(?=\s|$)", re.S)
PICTURE = re.compile(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)")
USAGES = {"COMP-1": "COMP-1", "COMPUTATIONAL-1": "COMP-1", "COMP-2": "COMP-2", "COMPUTATIONAL-2": "COMP-2", "COMP-3": "COMP-3", "COMPUTATIONAL-3": "COMP-3", "PACKED-DECIMAL": "COMP-3", "COMP": "COMP", "COMPUTATIONAL": "COMP", "COMP-4": "COMP", "COMP-5": "COMP", "BINARY": "COMP", "INDEX": "INDEX", "POINTER": "POINTER"}
USAGE = re.compile(r"(?<![\w-])(" + "|".join(sorted(USAGES, key=len, reverse=True)) + r")(?![\w-])")
PARAGRAPH = re.compile(rf"(?m)^ {{7,10}}({WORD})(\s+SECTION)?[ \t]*\.[ \t]*(?=$|\S)")
LEAVES = re.compile(rf"\b(?:GOBACK|STOP\s+RUN|EXIT\s+PROGRAM|GO\s+(?:TO\s+)?{WORD})\s*\.?\s*$")
CONDITIONAL = re.compile(r"\b(?:IF|WHEN|ELSE|AT\s+END|INVALID\s+KEY|ON\s+SIZE|ON\s+EXCEPTION|ON\s+OVERFLOW)\b")
TIMES = re.compile(r"\s+TIMES\b")
SCOPES = re.compile(r"\bEND-(?:IF|EVALUATE|READ|WRITE|CALL|SEARCH|STRING|UNSTRING|COMPUTE|ADD|SUBTRACT|MULTIPLY|DIVIDE|PERFORM|REWRITE|DELETE|START|RETURN)\b")
#: Constructs that are told when they come in, by the word that shows them.
TAGS = {
    "ALTER": r"\bALTER\b", "GO TO": rf"\bGO\s+(?:TO\s+)?(?!DEPENDING\b){WORD}(?!(?:\s+{WORD})*\s+DEPENDING)", "GO TO ... DEPENDING ON": r"\bGO\s+(?:TO\s+)?[\w\s-]+?\bDEPENDING\b", "an ALTERable GO TO": r"\bGO\s+TO\s*\.", "NEXT SENTENCE": r"\bNEXT\s+SENTENCE\b",
    "EXAMINE": r"\bEXAMINE\b", "TRANSFORM": r"\bTRANSFORM\b", "EXHIBIT": r"\bEXHIBIT\b", "READY TRACE": r"\bREADY\s+TRACE\b", "NOTE": r"(?m)^\s*NOTE\b", "ENTER": r"(?m)^\s*ENTER\b",
}


def picture(pic: str) -> tuple[int, str, int, int]:
    """Characters, kind (digits or text), digits before and after the point."""
    run = [(c, int(n or 1)) for c, n in re.findall(r"([A-Z09*+$,./-])(?:\((\d+)\))?", pic.upper().replace("CR", ",,").replace("DB", ",,"))]
    chars = sum(n for c, n in run if c not in "SVP")
    if any(c in "XANG" for c, _ in run):
        return chars, "text", chars, 0
    whole, fraction, after = 0, 0, False
    floating = {s: sum(n for c, n in run if c == s) for s in "+-$"}
    for c, n in run:
        if c in "V.":
            after = True
        elif c in "9ZP*0":
            fraction += n if after else 0
            whole += 0 if after or c == "0" else n
    whole += sum(n - 1 for n in floating.values() if n > 1)
    return chars, "digits", whole, fraction


def size(chars: int, digits: int, usage: str, separate: bool) -> int:
    """Bytes of an elementary item."""
    if usage == "COMP-3":
        return digits // 2 + 1
    if usage == "COMP":
        return 2 if digits <= 4 else 4 if digits <= 9 else 8
    return {"COMP-1": 4, "COMP-2": 8, "INDEX": 4, "POINTER": 8}.get(usage, chars + separate)


class Text:
    def __init__(self, text: str):
        rows = []
        for s in text.upper().split("\n"):
            s = s.expandtabs(8)
            rows.append("" if len(s) > 6 and s[6] in "*/D" else " " * 7 + s[7:72] if len(s) > 6 else "")
        self.said = re.sub(r"\*>[^\n]*", "", "\n".join(rows))
        self.code = mask(self.said, "cobol")
        self.ends = [m.start() for m in re.finditer("\n", self.code)]
        self.out: list[tuple[str, str]] = []
        self.order = 0

    def line(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1

    def note(self, fact: str, **data) -> None:
        self.out.append((fact, json.dumps(data)))

    def read(self) -> list[tuple[str, str]]:
        starts = [*re.finditer(rf"\bPROGRAM-ID\s*\.\s*({WORD})", self.code)]
        if not starts:
            self.data(0, len(self.code), None)
        for m, end in zip(starts, [*(x.start() for x in starts[1:]), len(self.code)]):
            self.note("program", program=m[1], line=self.line(m.start()))
            procedure = re.compile(r"\bPROCEDURE\s+DIVISION\b([^.]*)\.").search(self.code, m.end(), end)
            data = re.compile(r"\bDATA\s+DIVISION\s*\.").search(self.code, m.end(), end)
            if data:
                self.data(data.end(), procedure.start() if procedure else end, m[1])
            if procedure:
                for i, name in enumerate((w for w in re.findall(WORD, procedure[1]) if w not in ("USING", "BY", "REFERENCE", "VALUE", "RETURNING")), 1):
                    self.note("taken", program=m[1], position=i, name=name)
                self.procedure(m[1], procedure.end(), end)
        return self.out

    # -- data

    def data(self, start: int, end: int, program: str | None) -> None:
        for m in SENTENCE.finditer(self.code, start, end):
            text, at = m[0].strip(), m.start() + len(m[0]) - len(m[0].lstrip())
            copy = re.search(rf"\bCOPY\s+['\"]?({WORD})", self.said[m.start() : m.end()])
            first = re.match(r"(\d\d?)(?:\s+(?!COPY\b)([^\s.]+)|\s*\.)", text)
            if first and int(first[1]) not in (66, 88):
                self.item(int(first[1]), first[2] or "FILLER", text, at, program)
            if copy:
                self.order += 1
                said = self.said[m.start() + copy.end() : m.end()]
                pairs = re.findall(rf"(==.*?==|{WORD})\s+BY\s+(==.*?==|{WORD})", said, re.S)
                self.note("copy", program=program, ord=self.order, book=copy[1], line=self.line(m.start() + copy.start()), replacing=[{"was": a.strip("= \n"), "now": b.strip("= \n"), "whole": not a.startswith("==") or re.fullmatch(WORD, a.strip("= \n")) is not None} for a, b in pairs])

    def item(self, level: int, name: str, text: str, at: int, program: str | None) -> None:
        if name in ("PIC", "PICTURE", "REDEFINES", "OCCURS", "USAGE", "VALUE"):
            name = "FILLER"
        pic = PICTURE.search(text)
        said = pic[1].rstrip(".") if pic else ""
        plain = text.replace(pic[0], " ") if pic else text
        usage = USAGE.search(re.sub(r"\bVALUE\b.*", "", plain, flags=re.S))
        usage = USAGES[usage[1]] if usage else "DISPLAY"
        occurs = re.search(r"\bOCCURS\s+(\d+)(?:\s+TO\s+(\d+))?", plain)
        redefines = re.search(r"\bREDEFINES\s+([^\s.]+)", plain)
        chars, kind, whole, fraction = picture(said) if said else (0, "group", 0, 0)
        bytes_ = size(chars, whole + fraction, usage, "SEPARATE" in plain) if said or usage in ("COMP-1", "COMP-2", "INDEX", "POINTER") else None
        self.order += 1
        self.note("item", program=program, ord=self.order, level=level, name=name, pic=said, usage=usage, bytes=bytes_, kind=kind, whole=whole, fraction=fraction, occurs=int((occurs[2] or occurs[1]) if occurs else 1), redefines=redefines[1] if redefines else None, line=self.line(at))

    # -- procedure

    def procedure(self, program: str, start: int, end: int) -> None:
        body = self.code[start:end]
        heads = [h for h in PARAGRAPH.finditer(body) if h[1] not in ("END", "EXIT", "GOBACK", "CONTINUE") and not h[1].startswith("END-")]
        spans = [(0, 0, "", False)] + [(h.start(), h.end(), h[1], bool(h[2])) for h in heads]
        section = ""
        for i, ((head, a, name, is_section), z) in enumerate(zip(spans, [*(s[0] for s in spans[1:]), len(body)])):
            section = name if is_section else section
            text = body[a:z]
            statements = re.sub(r"\b(?:EXIT|CONTINUE)\b\s*\.?", "", text).strip(" \n.")
            if name or statements:
                self.note("paragraph", program=program, ord=i, name=name, section=section, is_section=is_section, line=self.line(start + head + len(body[head:a]) - len(body[head:a].lstrip())), end_line=self.line(start + z - 1), empty=not statements, leaves=bool(self.leaves(text)), tags=sorted(t for t, p in TAGS.items() if re.search(p, text)))
            at = lambda m: self.line(start + a + m.start())  # noqa: B023, E731
            for m in re.finditer(rf"\bPERFORM\s+({WORD})(?:\s+(?:THRU|THROUGH)\s+({WORD}))?", text):
                if m[1] not in ("UNTIL", "VARYING", "WITH", "TEST") and not TIMES.match(text, m.end(1)):
                    self.note("performs", program=program, paragraph=name, first=m[1], last=m[2], line=at(m))
            for m in re.finditer(rf"\bGO\s+(?:TO\s+)?((?:{WORD}\s*)+)", text):
                for to in re.findall(WORD, m[1]):
                    if to in ("DEPENDING", "ON"):
                        break
                    self.note("jump", program=program, paragraph=name, target=to, line=at(m))
            for n, m in enumerate(re.finditer(rf"\bMOVE\s+({WORD})(\s+(?:OF|IN)\s+{WORD}|\s*\()?\s*TO\s+((?:{WORD}(?:\s*\([^)]*\))?[\s,]*)+?)(?=\.|\b(?:MOVE|IF|ELSE|END-\w+|PERFORM|ADD|SUBTRACT|COMPUTE|DISPLAY|GO|CALL|READ|WRITE|SET|STOP|GOBACK|EVALUATE|WHEN|INITIALIZE|MULTIPLY|DIVIDE|ACCEPT|OPEN|CLOSE|STRING|UNSTRING|INSPECT|EXIT|CONTINUE|NEXT)\b)", text)):
                if not m[2] and not re.fullmatch(r"\d+|ZEROS?|ZEROES|SPACES?|LOW-VALUES?|HIGH-VALUES?|QUOTES?|ALL|CORR(?:ESPONDING)?|LENGTH|FUNCTION", m[1]):
                    for to in re.findall(WORD, re.sub(r"\([^)]*\)", " ", m[3])):
                        self.note("move", program=program, paragraph=name, src=m[1], dst=to, line=at(m), ord=n)
            for n, m in enumerate(re.finditer(r"\bCALL\s+['\"]([^'\"]*)['\"]([^.]*?)(?=\.|\bEND-CALL|\bON\s+(?:EXCEPTION|OVERFLOW)|$)", self.said[start + a : start + z], re.S)):
                self.passed(program, name, m, n, at(m))

    def passed(self, program: str, paragraph: str, m: re.Match, n: int, line: int) -> None:
        using = re.match(r"\s*USING\b(.*)", m[2], re.S)
        by, position = "REFERENCE", 0
        self.note("call", program=program, paragraph=paragraph, callee=m[1].strip(), ord=n, line=line)
        for w in re.findall(r"'[^']*'|\"[^\"]*\"|[A-Z0-9][\w-]*", using[1]) if using else []:
            if w in ("REFERENCE", "CONTENT", "VALUE"):
                by = w
            elif w in ("RETURNING", "GIVING") or position and re.fullmatch(r"MOVE|IF|ELSE|PERFORM|ADD|DISPLAY|GO|STOP|GOBACK|CALL|EVALUATE|COMPUTE|SET", w):
                break
            elif w not in ("BY", "OF", "LENGTH", "ADDRESS", "OMITTED"):
                position += 1
                self.note("passed", program=program, paragraph=paragraph, callee=m[1].strip(), ord=n, position=position, item=w if w[0] not in "'\"" else None, by=by, line=line)

    @staticmethod
    def leaves(text: str) -> bool:
        """Does the last sentence end in a statement that goes elsewhere, on no condition?"""
        last = [s for s in SENTENCE.findall(text.rstrip() + " ") if s.strip(" .\n")]
        if not last or not LEAVES.search(last[-1]):
            return False
        tail = SCOPES.split(last[-1])[-1]
        return not CONDITIONAL.search(tail)


def read(text: str) -> list[tuple[str, str]]:
    return Text(text).read()
