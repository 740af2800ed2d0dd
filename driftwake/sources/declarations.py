"""What C texts declare: records with their fields, typedefs, enumerators, integer macros, and what switches name.

A reader of declarations alone: types are spelled, not looked up, and expressions are kept as texts; sizes, values and layouts are
worked out over all files together (operators/records.py). Bodies of functions are passed over. What can't be read as a declaration
is left out up to the next semicolon or closing brace, never guessed.

Edge cases: anonymous records and enums are named after what they declare, or by the record and place they stand in; conditional
branches are all read, the last definition of a name standing; an empty text declares nothing."""

from __future__ import annotations

import json
import re

from driftwake.sources.lines import mask

TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|'(?:\\.|[^'\\])*'|\"[^\"]*\"|<<|>>|->|\.\.\.|[^\s\w]")
DIRECTIVE = re.compile(r"(?m)^[ \t]*#(?:[^\n\\]|\\[^\n])*(?:\\\n[^\n]*)*")
DEFINE = re.compile(r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)[ \t]+([^\n]+)$")
ARITHMETIC = {"unsigned", "signed", "int", "long", "short", "char", "float", "double", "_Bool", "bool", "void", "_Complex", "__int128"}
PASSED = {"typedef", "extern", "static", "inline", "register", "auto", "const", "volatile", "restrict", "_Atomic", "__extension__", "__inline", "__restrict", "_Thread_local", "thread_local"}
BRACKETED = {"__attribute__", "__declspec", "_Alignas", "alignas", "__asm__", "asm", "_Static_assert", "static_assert"}
CLOSE = {"(": ")", "[": "]", "{": "}"}
INTEGER = re.compile(r"[\s()\w+\-*/%<>&|^~']+$")


def arithmetic(words: list[str]) -> str:
    """One spelling for each arithmetic type."""
    for plain in ("void", "float", "_Bool", "bool"):
        if plain in words:
            return plain
    if "double" in words:
        return "long double" if "long" in words else "double"
    size = "char" if "char" in words else "short" if "short" in words else "long long" if words.count("long") > 1 else "long" if "long" in words else "__int128" if "__int128" in words else "int"
    return f"unsigned {size}" if "unsigned" in words else "signed char" if size == "char" and "signed" in words else size


class Declarations:
    def __init__(self, text: str, lang: str = "c"):
        self.code = mask(text, lang, strings=False)
        self.out: list[tuple[str, str]] = []
        for m in DEFINE.finditer(self.code):
            if INTEGER.match(m[2].strip()) and not re.match(r"[A-Za-z_]\w*\s*\(", m[2].strip()):
                self.constant(None, m[1], m[2].strip(), 0, 0, self.code.count("\n", 0, m.start()) + 1)
        plain = DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), self.code)
        found, line, last = [], 1, 0
        for m in TOKEN.finditer(plain):
            line += plain.count("\n", last, m.start())
            last = m.start()
            found.append((m.group(), line))
        self.tokens, self.lines = [t for t, _ in found], [n for _, n in found]
        self.at = self.unnamed = 0

    def note(self, fact: str, **data) -> None:
        self.out.append((fact, json.dumps(data)))

    def constant(self, owner: str | None, name: str, expr: str, plus: int, order: int, line: int) -> None:
        self.note("constant", owner=owner, name=name, expr=expr, plus=plus, ord=order, line=line)

    # -- tokens

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self) -> str:
        t = self.peek()
        self.at += 1
        return t

    def enclosed(self) -> str:
        """What stands between the bracket here and its partner, both passed."""
        opened, depth, start = self.peek(), 0, self.at + 1
        while self.at < len(self.tokens):
            t = self.take()
            depth += (t == opened) - (t == CLOSE[opened])
            if not depth:
                break
        return " ".join(self.tokens[start : self.at - 1])

    def until(self, *ends: str) -> str:
        """Up to one of ends outside brackets, which is not passed."""
        start = self.at
        while self.peek() and self.peek() not in ends:
            if self.peek() in CLOSE:
                self.enclosed()
            elif self.peek() in ")]}":
                break
            else:
                self.at += 1
        return " ".join(self.tokens[start : self.at])

    # -- declarations

    def read(self) -> list[tuple[str, str]]:
        while self.at < len(self.tokens):
            before = self.at
            self.declaration(None, 0)
            if self.at == before:
                self.at += 1
        return self.out

    def declaration(self, owner: str | None, order: int) -> list[dict]:
        """One declaration, with what it declares; outside records typedefs are noted and functions passed over."""
        if self.peek() == "extern" and self.peek(1).startswith('"') and self.peek(2) == "{":
            self.at += 3
            return []
        line = self.lines[self.at]
        typedef, spec = self.specifiers(owner, order)
        if spec is None:
            self.until(";")
            if self.peek() in (";", "}"):
                self.at += 1
            return []
        fields: list[dict] = []
        while self.peek() and self.peek() not in ";{}":
            d = self.declarator()
            if self.peek() == ":":
                self.at += 1
                d["bits"] = self.until(",", ";")
            if self.peek() in BRACKETED:
                self.at += 1
                if self.peek() == "(":
                    self.enclosed()
            if self.peek() == "=":
                self.until(",", ";")
            fields.append(d)
            if self.peek() != ",":
                break
            self.at += 1
        if self.peek() == "{" and fields and fields[-1]["function"]:
            self.enclosed()
            return []
        self.until(";")
        if self.peek() == ";":
            self.at += 1
        base = self.named(spec, next((d["name"] for d in fields if d["name"]), None), owner, order)
        for d in fields:
            d["base"] = base
        if typedef:
            for d in fields:
                if d["name"]:
                    self.note("alias", name=d["name"], base=base, pointer=d["pointer"] or d["function"], dims=d["dims"], line=line)
        if not fields and base.startswith(("struct ", "union ")) and spec[1] and not spec[2]:
            fields = [{"name": None, "pointer": False, "function": False, "dims": [], "bits": None, "base": base}]  # an anonymous member
        return fields

    def specifiers(self, owner: str | None, order: int):
        """(is it a typedef, (spelling, body, tag)); None if no type is there."""
        typedef, words, spec = False, [], None
        while self.peek():
            t = self.peek()
            if t in PASSED:
                typedef |= t == "typedef"
                self.at += 1
            elif t in BRACKETED:
                self.at += 1
                if self.peek() == "(":
                    self.enclosed()
            elif t in ("struct", "union", "enum") and not words and spec is None:
                spec = self.tagged(owner, order)
            elif t in ARITHMETIC and spec is None:
                words.append(self.take())
            elif re.match(r"[A-Za-z_]", t) and not words and spec is None and re.match(r"[A-Za-z_*(:]|$", self.peek(1) or ""):
                spec = (self.take(), None, None)
            else:
                break
        return typedef, spec or ((arithmetic(words), None, None) if words else None)

    def tagged(self, owner: str | None, order: int):
        line, kind = self.lines[self.at], self.take()
        while self.peek() in BRACKETED:
            self.at += 1
            if self.peek() == "(":
                self.enclosed()
        tag = self.take() if re.match(r"[A-Za-z_]", self.peek()) else None
        if kind == "enum" and self.peek() == ":":
            self.until("{", ";")
        if self.peek() != "{":
            return f"{kind} {tag}", None, tag
        self.at += 1
        body: list = []
        if kind == "enum":
            expr, plus = "0", 0
            while self.peek() and self.peek() != "}":
                name, at = self.take(), self.lines[self.at - 1]
                if self.peek() == "=":
                    self.at += 1
                    expr, plus = self.until(",", "}"), 0
                body.append((name, expr, plus, at))
                plus += 1
                if self.peek() == ",":
                    self.at += 1
                elif self.peek() != "}":
                    self.until("}")
        else:
            self.unnamed += 1
            inside = f"{kind} {tag or f'?{self.unnamed}?'}"
            while self.peek() and self.peek() != "}":
                before = self.at
                body += [d for d in self.declaration(inside, len(body)) if not d["function"] or d["pointer"]]
                if self.at == before:
                    self.at += 1
        if self.peek() == "}":
            self.at += 1
        return kind, (line, body, None if kind == "enum" else inside), tag

    def named(self, spec, declared: str | None, owner: str | None, order: int) -> str:
        """The spelling of a specifier; what has a body is noted under it."""
        spelled, body, tag = spec
        if body is None:
            return spelled
        line, rows, inside = body
        own = tag or (f"{owner.split(' ', 1)[1]}.{declared or order}" if owner else declared or f"@{line}")
        name = f"{spelled} {own}"
        if inside and inside != name:  # what stands in it was noted before it had a name
            was, now = inside.split(" ", 1)[1], own
            self.out = [(fact, data.replace(was, now)) for fact, data in self.out]
            for d in rows:
                d["base"] = d["base"].replace(was, now)
        if spelled == "enum":
            for i, (member, expr, plus, at) in enumerate(rows):
                self.constant(name, member, expr, plus, i, at)
        else:
            fields = [{"name": d["name"], "base": d["base"], "pointer": d["pointer"], "dims": d["dims"], "bits": d.get("bits"), "said": d["base"] + "*" * d["pointer"] + "".join(f"[{x}]" for x in d["dims"]) + (f":{d['bits']}" if d.get("bits") else "")} for d in rows]
            self.note("record", name=name, kind=spelled, line=line, fields=fields)
        return name

    def declarator(self) -> dict:
        pointer = False
        while self.peek() in ("*", "^") or self.peek() in PASSED or self.peek() in BRACKETED:
            t = self.take()
            pointer |= t in "*^"
            if t in BRACKETED and self.peek() == "(":
                self.enclosed()
        inner = None
        if self.peek() == "(" and self.peek(1) in ("*", "^", "("):
            self.at += 1
            inner = self.declarator()
            self.until(")")
            self.at += 1
        name = None if inner or not re.match(r"[A-Za-z_]", self.peek()) else self.take()
        dims, function = [], False
        while self.peek() in ("[", "("):
            if self.peek() == "(":
                function = True
                self.enclosed()
            else:
                dims.append(self.enclosed())
        if inner:
            return inner if inner["pointer"] else inner | {"dims": inner["dims"] + dims, "function": function, "pointer": pointer}
        return {"name": name, "pointer": pointer and not function, "function": function, "dims": dims, "bits": None}


SWITCH = re.compile(r"\bswitch\s*\(")
LABEL = re.compile(r"\bcase\s+([^:?]+?)\s*:(?!:)|\bdefault\s*:(?!:)")


def closing(code: str, at: int) -> int:
    """The place of the bracket that closes the one at a place, or the end."""
    opened, depth = code[at], 0
    for i in range(at, len(code)):
        depth += (code[i] == opened) - (code[i] == CLOSE[opened])
        if not depth:
            return i
    return len(code)


def switches(holder: str, code: str, first: int) -> list[tuple[str, str]]:
    """Switches of a function's body (masked), whose first line is `first`: subject, labels that are names, and whether there is a default."""
    out, spans = [], []
    for m in SWITCH.finditer(code):
        end = closing(code, m.end() - 1)
        start = code.find("{", end)
        if start >= 0 and not code[end + 1 : start].strip():
            spans.append((m.start(), start, closing(code, start), " ".join(code[m.end() : end].split())))
    for at, start, end, subject in spans:
        own = code[start:end]
        for _, s, z, _ in spans:
            if start < s < end:  # a switch within has its own labels
                own = own[: s - start] + " " * (z - s) + own[z - start :]
        labels = [m[1] for m in LABEL.finditer(own)]
        names = [re.sub(r"^\(\s*[\w\s]+\)\s*", "", x) for x in labels if x]
        out.append(("switch", json.dumps({"holder": holder, "subject": subject, "line": first + code.count("\n", 0, at), "labels": [x for x in names if re.fullmatch(r"[A-Za-z_]\w*", x)], "has_default": None in labels})))
    return out


def read(text: str) -> list[tuple[str, str]]:
    return Declarations(text).read()
