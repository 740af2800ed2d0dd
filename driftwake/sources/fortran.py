"""What Fortran texts say of storage: units and whether callers see their interface, COMMON blocks as they are laid out, which scalars
have no value at entry, and what statements read and write, in their order.

A reader of statements, fixed and free form. Only what is certain is told: a variable that is handed to a procedure counts as
written (who gets it may set it), and of a unit with a jump back nothing is told of the order.

Edge cases: names of no declaration are typed by their first letter, but under IMPLICIT NONE they are no variables of the unit, and have no
type; an empty text says nothing; preprocessor lines are passed over."""

from __future__ import annotations

import json
import re

from driftwake.sources.lines import FIXED_FORM, mask

NAME = r"[a-z]\w*"
TYPE = re.compile(r"(integer|real|logical|complex|character|double\s*precision|double\s*complex|type|class)\s*(\*\s*\d+|\*\s*\(\s*\*\s*\)|\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*(?=[,:a-z])")
UNIT = re.compile(rf"(?:(?:recursive|pure|elemental|impure|module|integer|real|logical|complex|character|double\s*precision|type)\b[\w\s(),*=]*?\s)?(subroutine|function|program)\s+({NAME})\s*(?:\(([^)]*)\))?")
END = re.compile(r"end\s*(?:subroutine|function|program|module|submodule|interface|block\s*data)?(?:\s+\w+)?$")
INTRINSIC = set("abs sqrt sin cos tan asin acos atan atan2 exp log log10 mod modulo min max int nint real dble float sign dim aint anint ceiling floor sum product maxval minval size shape lbound ubound len len_trim trim index ichar char iachar achar present allocated associated dot_product matmul transpose any all count merge huge tiny epsilon kind selected_int_kind selected_real_kind cmplx aimag conjg iand ior ieor not btest ishft amax1 amin1 max0 min0 dabs dsqrt dexp dlog dmax1 dmin1 iabs idint ifix sngl dsin dcos alog amod isnan".split())
NOT_LOCAL = {"parameter", "save", "pointer", "allocatable", "target", "external", "value", "intrinsic", "codimension", "volatile"}


def statements(text: str, path: str) -> list[tuple[int, str, str]]:
    """(line, label, statement in lower case), continuations joined and parted at semicolons."""
    rows: list[list] = []
    fixed = path.lower().endswith(FIXED_FORM)
    goes_on = False
    for n, s in enumerate(mask(text, "fortran", path).lower().split("\n"), 1):
        s = s.expandtabs(8)
        if not s.strip() or s.lstrip().startswith("#"):
            continue
        if fixed and len(s) > 5 and s[5] not in " 0" and not s[:5].strip() and rows:
            rows[-1][1] += s[6:72]
        elif not fixed and goes_on and rows:
            rows[-1][1] += " " + s.strip().removeprefix("&").strip().removesuffix("&")
        else:
            rows.append([n, (s[:72] if fixed else s).strip().removesuffix("&")])
        goes_on = s.rstrip().endswith("&")
    out = []
    for n, s in rows:
        m = re.match(r"(\d+)\s+(?=\S)", s)
        label = m[1] if m else ""
        for part in s[m.end() if m else 0 :].split(";"):
            if part.strip():
                out.append((n, label, " ".join(part.split())))
                label = ""
    return out


def top(text: str) -> list[str]:
    """What commas part, outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    return [x for x in [*out, text[last:].strip()] if x]


class Unit:
    def __init__(self, name: str, line: int, kind: str, args: list[str], explicit: bool):
        self.name, self.line, self.kind, self.args, self.explicit = name, line, kind, args, explicit
        self.types: dict[str, str] = {}
        self.dims: dict[str, str] = {}
        self.not_local: set[str] = set(args) | {name}
        self.out: set[str] = set()
        self.commons: list[tuple[str, str, int]] = []
        self.accesses: list[tuple[str, int, bool]] = []
        self.labels: dict[str, int] = {}
        self.jumps: list[tuple[str, int]] = []
        self.known, self.typed, self.done = True, True, {}

    # -- declarations

    def declares(self, line: int, s: str) -> bool:
        m = TYPE.match(s)
        if m and not re.match(rf"{NAME}\s*=", s) and not re.match(rf"(?:real|int|cmplx)\s*\([^)]*\)\s*[=+*/-]", s):
            spec = re.sub(r"\s+", "", m[1]) + re.sub(r"\s+", "", (m[2] or "").replace("kind=", ""))
            rest = s[m.end() :]
            said, _, names = rest.rpartition("::") if "::" in rest else ("", "", rest)
            attributes = [a.strip() for a in top(said)]
            flags = {re.match(r"\w+", a)[0] for a in attributes if re.match(r"\w+", a)}
            dims = next((a[a.index("(") :] for a in attributes if a.startswith("dimension")), "")
            for item in top(names):
                name = re.match(NAME, item)
                if not name:
                    continue
                own = re.match(rf"{NAME}\s*(\((?:[^()]|\([^()]*\))*\))?", item)[1] or dims
                self.types[name[0]] = spec
                if own:
                    self.dims[name[0]] = re.sub(r"\s+", "", own)
                if flags & NOT_LOCAL or "=" in item[len(name[0]) :].split("(")[0] or "/" in item or m[1] in ("type", "class"):
                    self.not_local.add(name[0])
                if any(re.sub(r"\s+", "", a) == "intent(out)" for a in attributes):
                    self.out.add(name[0])
            return True
        word = re.match(r"[a-z]+(?:\s*data)?", s)
        word = word[0] if word else ""
        if word == "common":
            for block, names in re.findall(r"(?:/\s*(\w*)\s*/)\s*([^/]+)", s if "/" in s else s.replace("common", "common //", 1)):
                for item in top(names):
                    name = re.match(NAME, item)
                    if name:
                        self.not_local.add(name[0])
                        if "(" in item:
                            self.dims[name[0]] = re.sub(r"\s+", "", item[item.index("(") :])
                self.commons.append((block or "(blank)", names, line))
            return True
        if word in ("dimension", "allocatable", "pointer", "target"):
            for item in top(s[len(word) :].lstrip(": ")):
                name = re.match(NAME, item)
                if name and "(" in item:
                    self.dims[name[0]] = re.sub(r"\s+", "", item[item.index("(") :])
                if name and word != "dimension":
                    self.not_local.add(name[0])
            return True
        if word in ("save", "data", "equivalence", "namelist", "external", "intrinsic", "parameter", "volatile"):
            named = set(re.findall(NAME, s[len(word) :]))
            self.not_local |= named
            self.known &= not (word == "save" and not named)
            return True
        if word == "intent":
            if re.match(r"intent\s*\(\s*out\s*\)", s):
                self.out |= set(re.findall(NAME, s[s.index(")") + 1 :]))
            return True
        if word == "implicit":
            self.typed = "none" not in s
            return True
        if word == "use":
            self.known = False  # a name may be the module's
            return True
        return word in ("include", "format", "entry", "interface", "import", "sequence", "private", "public")

    # -- statements

    def access(self, name: str, line: int, writes: bool) -> None:
        if name not in self.done:
            self.done[name] = writes
            self.accesses.append((name, line, writes))

    def reads(self, text: str, line: int) -> None:
        """Names that an expression reads; what stands in the brackets of a procedure is handed over."""
        text = re.sub(r"'[^']*'|\"[^\"]*\"", " ", text)
        text = re.sub(r"\.(?:and|or|not|eq|ne|lt|le|gt|ge|eqv|neqv|true|false)\.", " ", text)
        text = re.sub(r"(?<!\w)\d+(?:\.\d*)?(?:[de][+-]?\d+)?(?:_\w+)?|%\s*\w+", " ", text)
        at = 0
        while m := re.compile(NAME).search(text, at):
            at = m.end()
            inner = re.compile(r"\s*\(").match(text, at)
            if not inner:
                self.access(m[0], line, False)
                continue
            depth, end = 0, inner.end() - 1
            for end in range(inner.end() - 1, len(text)):
                depth += (text[end] == "(") - (text[end] == ")")
                if not depth:
                    break
            part = text[inner.end() : end]
            if m[0] in self.dims or m[0] in INTRINSIC or self.types.get(m[0], "").startswith("character"):
                self.access(m[0], line, False)
                self.reads(part, line)
            else:
                self.passes(part, line)
            at = end + 1

    def passes(self, text: str, line: int) -> None:
        for arg in top(text):
            arg = re.sub(rf"^{NAME}\s*=\s*", "", arg)
            if re.fullmatch(NAME, arg):
                self.access(arg, line, True)
            else:
                self.reads(arg, line)

    def sets(self, target: str, line: int) -> None:
        m = re.match(rf"({NAME})\s*(.*)", target)
        if m:
            if m[2].startswith("("):
                self.reads(m[2], line)
            self.access(m[1], line, True)

    def runs(self, line: int, s: str) -> None:
        s = re.sub(rf"^{NAME}\s*:\s*(?=(?:do|if|select|where|forall|block)\b)", "", s)
        if m := re.match(r"(?:else\s*)?if\s*\(", s):
            end = self.closing(s, m.end() - 1)
            self.reads(s[m.end() : end], line)
            rest = s[end + 1 :].strip()
            if rest and rest != "then" and not re.fullmatch(r"then \w+|[\d\s,]+", rest):
                self.runs(line, rest)
            self.jumps += [(x, line) for x in re.findall(r"\d+", rest)] if re.fullmatch(r"[\d\s,]+", rest) else []
        elif m := re.match(r"go\s*to\s*(.*)", s):
            self.jumps += [(x, line) for x in re.findall(r"\d+", m[1])] or [("?", line)]
        elif m := re.match(rf"do(?:\s+\d+)?\s*,?\s*({NAME})\s*=(.*)", s):
            self.reads(m[2], line)
            self.access(m[1], line, True)
        elif m := re.match(r"do\s+while\s*(\(.*)", s):
            self.reads(m[1], line)
        elif m := re.match(rf"call\s+({NAME})(?:\s*%\s*\w+)*\s*(?:\((.*)\))?$", s):
            self.passes(m[2] or "", line)
        elif m := re.match(r"(read|inquire|open|close|rewind|backspace|allocate|deallocate|nullify)\b\s*(.*)", s):
            for name in re.findall(NAME, m[2]):
                self.access(name, line, True)
        elif m := re.match(r"write\s*\(", s):
            end = self.closing(s, m.end() - 1)
            for name in re.findall(NAME, s[m.end() : end]):
                self.access(name, line, True)
            if "=" not in s[end:]:
                self.reads(s[end + 1 :], line)
            else:  # an implied loop sets its own index
                for name in re.findall(NAME, s[end:]):
                    self.access(name, line, True)
        elif m := re.match(r"print\s*[^,]*,(.*)", s):
            if "=" not in m[1]:
                self.reads(m[1], line)
        elif m := re.match(r"(?:select\s*case|case|where|else\s*where|forall|return|stop)\s*(\(.*)?$", s):
            if m[1] and not s.startswith("forall"):
                self.reads(m[1], line)
        elif m := re.match(rf"({NAME}(?:\s*%\s*\w+|\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*)\s*=(?![=>])(.*)", s):
            self.reads(m[2], line)
            self.sets(m[1], line)
        elif "=>" in s:
            for name in re.findall(NAME, s):
                self.access(name, line, True)

    @staticmethod
    def closing(s: str, at: int) -> int:
        depth = 0
        for i in range(at, len(s)):
            depth += (s[i] == "(") - (s[i] == ")")
            if not depth:
                return i
        return len(s)

    def told(self) -> list[tuple[str, dict]]:
        out = [("unit", {"unit": self.name, "line": self.line, "kind": self.kind, "explicit": self.explicit})]
        for block, names, line in self.commons:
            kinds = []
            for item in top(names):
                name = re.match(NAME, item)
                if name:
                    kinds.append((self.types.get(name[0]) or ("integer" if name[0][0] in "ijklmn" else "real")) + self.dims.get(name[0], ""))
            out.append(("common", {"unit": self.name, "block": block, "layout": ", ".join(kinds), "line": line}))
        back = any(x == "?" or self.labels.get(x, line + 1) <= line for x, line in self.jumps)
        if not back:
            for name, line, writes in self.accesses:
                local = self.known and name not in self.not_local and name not in self.dims and (name in self.types or self.typed) and name not in INTRINSIC
                if name in self.out and name not in self.dims or local:
                    out.append(("access", {"unit": self.name, "name": name, "what": "out" if name in self.out else "local", "line": line, "writes": writes}))
        return out


def read(path: str, text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, dict]] = []
    stack: list = []
    for line, label, s in statements(text, path):
        unit = stack[-1] if stack and isinstance(stack[-1], Unit) else None
        started = UNIT.match(s)
        if started and not s.startswith("end") and not (unit and TYPE.match(s) and "function" not in s):
            inside = any(x in ("module", "interface") or isinstance(x, Unit) for x in stack)
            new = Unit(started[2], line, started[1], [a.strip() for a in (started[3] or "").split(",") if a.strip()], inside)
            result = re.search(rf"result\s*\(\s*({NAME})\s*\)", s)
            new.not_local |= {result[1]} if result else set()
            new.known = not any(isinstance(x, Unit) or x == "module" for x in stack)  # else a name may be the host's
            stack.append(new if "interface" not in stack else "prototype")
        elif re.match(r"(?:module|submodule\s*\([^)]*\))\s+(?!procedure\b)\w+$", s):
            stack.append("module")
        elif re.match(r"(?:abstract\s+)?interface\b", s):
            stack.append("interface")
        elif END.fullmatch(s) and stack:
            done = stack.pop()
            out += done.told() if isinstance(done, Unit) else []
        elif unit:
            if label:
                unit.labels[label] = line
            if not unit.declares(line, s):
                unit.runs(line, s)
    for left in stack:
        out += left.told() if isinstance(left, Unit) else []
    return [(fact, json.dumps(data)) for fact, data in out]
