"""Facts of C, C++, Java, TypeScript/JavaScript, Fortran and COBOL texts, read lexically: definitions with their parameters, and calls
with the number of their arguments; of C also declarations, switches and what can't be reached (declarations.py, flow.py), of COBOL data and
the order of procedures (cobol.py), of Fortran storage and accesses (fortran.py).

There is no preprocessor, no type and no overload here: names are those of a language's own scope (`java@Class.method`, `c@name`,
`fortran@name`, `cobol@PROGRAM.PARAGRAPH`), Fortran's in lower case, COBOL's in upper. Comments and what strings hold are masked first.
What these facts can't tell is left out, never guessed: a call whose arguments can't be counted has none."""

from __future__ import annotations

import hashlib
import json
import re

from driftwake.sources import cobol as divisions
from driftwake.sources import declarations, flow
from driftwake.sources import fortran as storage
from driftwake.sources.lines import FIXED_FORM, mask

KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "sizeof", "new", "delete", "throw", "else", "do", "synchronized", "function", "typeof", "await", "super", "this", "defined", "static_assert", "constructor", "case"}
OPEN = re.compile(
    r"\b(?P<scope>class|struct|interface|enum|namespace)\s+(?P<type>[A-Za-z_]\w*)(?P<bases>[^;{}()=]*)\{"
    r"|(?P<name>[A-Za-z_~]\w*(?:::~?\w+)*)\s*\((?P<params>(?:[^(){};]|\([^()]*\))*)\)\s*(?:(?:const|noexcept|override|final)\b\s*|throws\s+[\w.,\s]+|:\s*[\w<>\[\]|., ]+)*(?P<arrow>=>\s*)?\{"
    r"|(?P<open>\{)|(?P<close>\})"
)
CALL = re.compile(r"([A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)*)\s*\(")


def digest(text: str) -> str:
    return hashlib.sha1(re.sub(r"\s+", " ", text).strip().encode()).hexdigest()[:12]


def parts(text: str) -> list[str]:
    """What commas part, outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    out.append(text[last:])
    return [p.strip() for p in out if p.strip() and p.strip() != "void"]


def enclosed(text: str, at: int) -> str | None:
    """What stands between the bracket at a place and the one that closes it."""
    depth = 0
    for i in range(at, min(len(text), at + 4000)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return text[at + 1 : i]
    return None


def contract(params: list[str], lang: str) -> dict:
    names, defaults, more = [], 0, False
    for p in params:
        if "..." in p:
            more = True
            continue
        optional = "=" in p or lang == "typescript" and re.search(r"\w\?\s*(:|$)", p)
        p = re.split(r"=", p)[0]
        found = re.findall(r"[A-Za-z_]\w*", p.split(":")[0] if lang == "typescript" else re.sub(r"\[[^\]]*\]", "", p))
        names.append(found[-1] if found else "_")
        defaults += bool(optional)
    return {"positional": names, "defaults": defaults, "positional_only": len(names), "varargs": more, "keyword_only": [], "keyword_required": [], "varkw": False, "binds_first": False}


class Facts:
    def __init__(self) -> None:
        self.out: list[tuple[str, str]] = []
        self.order = 0

    def define(self, name: str, kind: str, line: int, end: int, signature: str, body: str, params: dict | None = None, bases: list[str] | None = None) -> None:
        self.order += 1
        self.out.append(("def", json.dumps({"name": name, "kind": kind, "line": line, "end_line": end, "signature": re.sub(r"\s+", " ", signature).strip(), "body": digest(body), "ord": self.order, "decorated": False, "params": params, "bases": bases or []})))

    def call(self, src: str, line: int, candidates: list[str], method: str | None, args: list[str] | None) -> None:
        data = {"src": src, "kind": "calls", "line": line, "candidates": candidates, "bound": [False] * len(candidates), "method": method, "positional": len(args or []), "keywords": [], "unpacked": args is None, "smaller": False}
        self.out.append(("use", json.dumps(data)))


def braces(path: str, text: str, lang: str) -> list[tuple[str, str]]:
    """C, C++, Java, TypeScript, JavaScript."""
    code, facts = mask(text, lang), Facts()
    bare = mask(text, lang, strings=False)  # comments alone are gone: what bodies say
    line = lambda at: code.count("\n", 0, at) + 1
    plain = declarations.DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code) if lang == "c" else ""
    stack: list[tuple] = []
    inside = lambda: any(s[0] == "fn" for s in stack)
    for m in OPEN.finditer(code):
        if m["close"]:
            if stack:
                kind, name, at, start, extra = stack.pop()
                if kind == "fn":
                    body = code[start : m.start()]
                    facts.define(name, "method" if extra[1] else "function", line(at), line(m.start()), extra[0], bare[start : m.start()], contract(parts(extra[0]), lang))
                    if lang == "c":
                        facts.out += declarations.switches(name, plain[start : m.start()], line(start))
                        facts.out += flow.unreachable(name, plain[start : m.start()], text[start : m.start()], line(start))
                    for c in CALL.finditer(body):
                        said = re.split(r"\.|->|::", c[1])
                        args = enclosed(body, c.end() - 1)
                        if said[-1] in KEYWORDS or said[0] in ("new",):
                            continue
                        own = f"{lang}@{extra[1]}.{said[-1]}" if extra[1] and (len(said) == 1 or said[0] == "this") else None
                        tries = [own] if own else []
                        tries += [f"{lang}@{'.'.join(said)}"] if said[0] != "this" else []
                        facts.call(name, line(start + c.start()), tries, said[-1] if len(said) > 1 and said[0] != "this" else None, None if args is None or "..." in args else parts(args))
                elif kind == "type":
                    facts.define(name, "class", line(at), line(m.start()), extra, "")
        elif m["scope"]:
            full = ".".join([*(s[1].split("@")[1].split(".")[-1] for s in stack if s[0] == "type"), m["type"]])
            stack.append(("space" if m["scope"] == "namespace" else "type", f"{lang}@{full}", m.start(), m.end(), m["bases"]))
        elif m["name"] and m["name"] not in KEYWORDS and not inside() and not m["arrow"]:
            owner = next((s[1].split("@")[1] for s in reversed(stack) if s[0] == "type"), "")
            said = m["name"].replace("::", ".")
            if "." in said:
                owner = said.rpartition(".")[0]
            full = f"{owner}.{said.rpartition('.')[2]}" if owner else said
            stack.append(("fn", f"{lang}@{full}", m.start(), m.end(), (m["params"], owner)))
        else:
            stack.append(("block", "", m.start(), m.end(), None))
    return facts.out + (declarations.read(text) if lang == "c" else [])


UNIT = re.compile(r"^\s*(?:(?:recursive|pure|elemental|integer|real|logical|double\s+precision|character|complex)[\w\s()*=]*?\s)?(subroutine|function|program)\s+(\w+)\s*(?:\(([^)]*)\))?", re.I)
END = re.compile(r"^\s*end\s*(?:subroutine|function|program)?(?:\s+\w+)?\s*$", re.I)


def fortran(path: str, text: str) -> list[tuple[str, str]]:
    facts, rows = Facts(), []
    fixed = path.lower().endswith(FIXED_FORM)
    for n, s in enumerate(mask(text, "fortran", path).split("\n"), 1):
        goes_on = rows and (len(s) > 5 and s[5] not in " 0" and not s[:5].strip() if fixed else rows[-1][1].rstrip().endswith("&"))
        if goes_on:
            rows[-1][1] = rows[-1][1].rstrip().rstrip("&") + " " + (s[6:] if fixed else s.lstrip().lstrip("&"))
        else:
            rows.append([n, s])
    now = None
    for n, s in rows:
        m = UNIT.match(s)
        if m and not s.strip().lower().startswith("end"):
            now = (f"fortran@{m[2].lower()}", n, [p.lower() for p in parts(m[3] or "")], [])
        elif now and END.match(s):
            name, at, params, said = now
            facts.define(name, "function", at, n, f"({', '.join(params)})", "\n".join(t for _, t in said), contract(params, "fortran"))
            for i, t in said:
                called = {c.start(1): True for c in re.finditer(r"\bcall\s+(\w+)", t, re.I)}
                for c in re.finditer(r"\b([A-Za-z]\w*)\s*\(", t):
                    args = enclosed(t, c.end() - 1)
                    facts.call(name, i, [f"fortran@{c[1].lower()}"], None, None if args is None else parts(args))
                    called.pop(c.start(1), None)
                for c in called:
                    facts.call(name, i, [f"fortran@{re.match(r'\w+', t[c:])[0].lower()}"], None, [])
            now = None
        elif now:
            now[3].append((n, s))
    return facts.out + storage.read(path, text)


def cobol(path: str, text: str) -> list[tuple[str, str]]:
    facts = Facts()
    code = "\n".join("" if len(s) > 6 and s[6] in "*/" else s[:6].replace(s[:6], " " * len(s[:6])) + s[6:72] for s in text.upper().split("\n"))
    line = lambda at: code.count("\n", 0, at) + 1
    starts = [*re.finditer(r"PROGRAM-ID\.\s+([\w-]+)", code)]
    for m, after in zip(starts, [*(x.start() for x in starts[1:]), len(code)]):
        name, body = f"cobol@{m[1]}", code[m.start() : after]
        using = re.search(r"PROCEDURE\s+DIVISION(?:\s+USING\s+([^.]+))?\.", body)
        names = [w for w in re.findall(r"[\w-]+", (using[1] or "") if using else "") if w not in ("BY", "REFERENCE", "VALUE", "CONTENT")]
        facts.define(name, "function", line(m.start()), line(after - 1), f"({', '.join(names)})", body, contract(names, "cobol"))
        at = using.end() if using else len(body)
        heads = [*re.finditer(r"(?m)^ {7}([A-Z0-9][\w-]*)\.[ \t]*$", body[at:])]
        spans = [(at, "")] + [(at + h.start(), h[1]) for h in heads]
        for (a, para), z in zip(spans, [*(s for s, _ in spans[1:]), len(body)]):
            src, said = f"{name}.{para}" if para else name, body[a:z]
            if para:
                facts.define(src, "function", line(m.start() + a), line(m.start() + z - 1), "", said, contract([], "cobol"))
            for c in re.finditer(r"\bCALL\s+['\"]([\w-]+)['\"](?:\s+USING\s+([^.]*?))?(?=\.|\bEND-CALL|\bON\s|\n\s*[A-Z]+\s+[A-Z])", said):
                args = [w for w in re.findall(r"[\w-]+", c[2] or "") if w not in ("BY", "REFERENCE", "VALUE", "CONTENT")]
                facts.call(src, line(m.start() + a + c.start()), [f"cobol@{c[1]}"], None, args)
            for c in re.finditer(r"\bPERFORM\s+([A-Z][\w-]*)", said):
                facts.call(src, line(m.start() + a + c.start()), [f"{name}.{c[1]}"], None, [])
    return facts.out + divisions.read(text)


def read(path: str, text: str, lang: str) -> list[tuple[str, str]]:
    return fortran(path, text) if lang == "fortran" else cobol(path, text) if lang == "cobol" else braces(path, text, lang)
