"""Which statements of a C function can't be reached, from its control flow.

The body is read to statements, and reachability goes forward through them: both arms of a condition, round loops, into a switch
by its labels and on from one to the next, out of them by break, and to labels by goto; labels may be reached from further down, so
that is repeated until no more labels are. A loop may always be left, whatever its condition says, and so may a
switch: a return behind one is a way to quiet compilers.

Silent where a reader can't know: preprocessor lines between the leaving statement and the dead ones; dead statements that only
say so (`break` after a return, a jump after `abort()`, calls that mark the place, a NOTREACHED comment); bodies whose brackets do not match."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

RULE = "unreachable-statement"
TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|'(?:\\.|[^'\\])*'|\"[^\"]*\"|::|->|[^\s\w]")
NEVER_RETURNS = {"exit", "_exit", "_Exit", "abort", "quick_exit", "longjmp", "siglongjmp", "__builtin_unreachable", "__builtin_trap", "unreachable", "err", "errx"}
MARKS = re.compile(r"(?i)unreachable|abort|assert|trap|panic")
SAID = re.compile(r"(?i)not\s*-?_?reached|unreachable")


@dataclass
class Statement:
    kind: str  # block, if, loop, switch, label, case, jump, plain, empty
    line: int
    word: str = ""  # of a jump; the name of a label or of where a goto goes
    target: str = ""
    parts: list = field(default_factory=list)  # lists of statements
    text: str = ""
    end: int = 0


class Unread(Exception):
    pass


class Body:
    def __init__(self, code: str, first: int):
        line, last = first, 0
        self.code = code
        self.tokens, self.lines, self.places = [], [], []
        for m in TOKEN.finditer(code):
            line += code.count("\n", last, m.start())
            last = m.start()
            self.tokens.append(m.group())
            self.lines.append(line)
            self.places.append(m.start())
        self.at = 0

    def since(self, start: int) -> str:
        """What has been passed, as it was written but for white space."""
        return " ".join(self.code[self.places[start] : self.places[self.at - 1] + len(self.tokens[self.at - 1])].split())

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def line(self) -> int:
        return self.lines[min(self.at, len(self.lines) - 1)]

    def skip(self) -> str:
        """Past the bracketed part here."""
        opened, start, depth = self.peek(), self.at, 0
        close = {"(": ")", "[": "]", "{": "}"}[opened]
        while self.at < len(self.tokens):
            t = self.tokens[self.at]
            self.at += 1
            depth += (t == opened) - (t == close)
            if not depth:
                return self.since(start)
        raise Unread

    def to_semicolon(self) -> str:
        start = self.at
        while self.peek() not in (";", ""):
            if self.peek() in "([{":
                self.skip()
            elif self.peek() in ")]}":
                raise Unread
            else:
                self.at += 1
        if not self.peek():
            raise Unread
        self.at += 1
        return self.since(start).removesuffix(";").rstrip()

    def items(self) -> list[Statement]:
        out = []
        while self.at < len(self.tokens) and self.peek() != "}":
            out.append(self.statement())
        return out

    def statement(self) -> Statement:
        s = self.one()
        s.end = self.lines[max(0, min(self.at, len(self.lines)) - 1)]
        return s

    def one(self) -> Statement:
        line, t = self.line(), self.peek()
        if t == "{":
            self.at += 1
            inner = self.items()
            if self.peek() != "}":
                raise Unread
            self.at += 1
            return Statement("block", line, parts=[inner])
        if t == ";":
            self.at += 1
            return Statement("empty", line)
        if t == "if":
            self.at += 1
            head = self.condition()
            arms = [[self.statement()]]
            if self.peek() == "else":
                self.at += 1
                arms.append([self.statement()])
            return Statement("if", line, parts=arms, text=f"if {head}")
        if t in ("while", "for", "switch"):
            self.at += 1
            head = self.condition()
            return Statement("switch" if t == "switch" else "loop", line, parts=[[self.statement()]], text=f"{t} {head}")
        if t == "do":
            self.at += 1
            inner = [self.statement()]
            if self.peek() != "while":
                raise Unread
            self.at += 1
            self.condition()
            self.to_semicolon()
            return Statement("loop", line, parts=[inner], text="do")
        if t in ("return", "goto", "break", "continue"):
            text = self.to_semicolon()
            return Statement("jump", line, t, text.split()[1] if t == "goto" and " " in text else "", text=text)
        if t in ("case", "default"):
            self.at += 1
            while self.peek() and self.peek() != ":":
                if self.peek() in "([{":
                    self.skip()
                elif self.peek() in ";})":
                    raise Unread
                else:
                    self.at += 1
            self.at += 1
            return Statement("case", line, t)
        if re.match(r"[A-Za-z_]", t) and self.peek(1) == ":" and t != "default":
            self.at += 2
            return Statement("label", line, t)
        if t in ("else", ")", "]", ""):
            raise Unread
        text = self.to_semicolon()
        name = re.match(r"\w*", text)[0]
        if name in NEVER_RETURNS and text[len(name) :].lstrip().startswith("("):
            return Statement("jump", line, "call", name, text=text)
        return Statement("plain", line, text=text)

    def condition(self) -> str:
        if self.peek() != "(":
            raise Unread
        return self.skip()


def labels(items: list[Statement]) -> bool:
    """Is there a way in from outside?"""
    return any(s.kind in ("label", "case") or any(labels(p) for p in s.parts if s.kind != "switch") or s.kind == "switch" and any(named(p) for p in s.parts) for s in items)


def named(items: list[Statement]) -> bool:
    return any(s.kind == "label" or any(named(p) for p in s.parts) for s in items)


class Reach:
    """Forward reachability, again until no more labels are reached; found: (list, place) of the first dead statement of each run;
    alive: lines of statements that control comes to."""

    def __init__(self, items: list[Statement]):
        self.gotos: set[str] = set()
        size = -1
        while len(self.gotos) != size:
            size, self.found, self.alive = len(self.gotos), [], set()
            self.through(items, True, [])

    def through(self, items: list[Statement], live: bool, inside: list[dict]) -> bool:
        """Whether control comes out at the end; inside: the loops and switches round here, the nearest last."""
        lived = False
        for i, s in enumerate(items):
            if s.kind == "label":
                live = live or s.word in self.gotos
            elif s.kind == "case":
                live = live or next((x["live"] for x in reversed(inside) if x["switch"]), False)
            if s.kind in ("label", "case"):
                lived = lived and live  # what only dead code jumps to is not told apart
            elif s.kind != "empty":
                if live or labels([s]):
                    lived = lived or live
                    if live:
                        self.alive.add(s.line)
                    live = self.step(s, live, inside)
                elif lived:
                    self.found.append((items, i))
                    lived = False
        return live

    def step(self, s: Statement, live: bool, inside: list[dict]) -> bool:
        if s.kind == "block":
            return self.through(s.parts[0], live, inside)
        if s.kind == "if":
            outs = [self.through(p, live, inside) for p in s.parts]
            return any(outs) or live and len(outs) == 1
        if s.kind == "loop":
            own = {"switch": False, "live": live, "left": False, "again": False}
            out = self.through(s.parts[0], live, [*inside, own])
            if not live and (out or own["again"]):  # entered by a label, and round again from the top
                self.alive.add(s.line)
                self.through(s.parts[0], True, [*inside, own])
                out = True
            return live or out or own["left"]
        if s.kind == "switch":
            own = {"switch": True, "live": live, "left": False, "again": False}
            return self.through(s.parts[0], False, [*inside, own]) or own["left"] or live
        if s.kind == "jump" and live:
            if s.word == "goto":
                self.gotos.add(s.target)
            elif s.word == "break" and inside:
                inside[-1]["left"] = True
            elif s.word == "continue":
                for x in inside[::-1]:
                    if not x["switch"]:
                        x["again"] = True
                        break
            return False
        return live


def runs(items: list[Statement]) -> list[tuple[Statement, list[Statement]]]:
    """(what leaves, dead statements after it), for each run."""
    out = []
    for where, i in Reach(items).found:
        dead = [where[i]]
        for s in where[i + 1 :]:
            if s.kind in ("label", "case") or labels([s]):
                break
            dead.append(s)
        j = i - 1
        while j > 0 and where[j].kind == "empty":
            j -= 1
        out.append((where[j], [d for d in dead if d.kind != "empty"]))
    return out


def quiet(left: Statement, dead: list[Statement]) -> bool:
    if all(d.kind == "jump" and d.word == "break" for d in dead):
        return True
    if left.kind == "jump" and left.word == "call" and all(d.kind == "jump" for d in dead):
        return True
    return all(d.kind == "plain" and MARKS.search(d.text.split("(")[0]) or d.kind == "jump" and d.word == "call" for d in dead)


def unreachable(name: str, code: str, said: str, first: int) -> list[tuple[str, str]]:
    """Findings in a body: code (masked, preprocessor lines blank), said (as written, same places), its first line."""
    try:
        body = Body(code, first)
        items = body.items()
        if body.at < len(body.tokens):
            return []
    except (Unread, RecursionError):
        return []
    rows = said.split("\n")
    out = []
    for left, dead in runs(items):
        if not dead or quiet(left, dead):
            continue
        a, z = left.line, dead[0].end
        between = rows[a - first : z - first + 1]
        if any(r.lstrip().startswith("#") for r in between):
            keep = dead[:1] if not any(r.lstrip().startswith("#") for r in rows[a - first : dead[0].line - first + 1]) else []
            if not keep or any(r.lstrip().startswith("#") for r in rows[dead[0].line - first : dead[0].end - first + 1]):
                continue
        if SAID.search("\n".join(rows[left.end - first : dead[0].line - first + 1])):
            continue
        why = left.text or left.kind
        more = f" and {len(dead) - 1} more" if len(dead) > 1 else ""
        out.append(("finding", json.dumps({"rule": RULE, "severity": "high", "line": dead[0].line, "message": f"`{dead[0].text or dead[0].kind}`{more} in {name.partition('@')[2]} can't run: `{why}` on line {left.line} always leaves"})))
    return out
