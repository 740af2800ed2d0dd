"""F16. Python 2 texts as Python 3 ones, line by line, so that one parser reads both and every line keeps its number.

Only what stops Python 3's parser is rewritten. Strings and comments are left alone: rewriting works on the code between
them."""

from __future__ import annotations

import re

#: Strings (with prefixes) and comments: what no rewriting may touch.
OPAQUE = re.compile(r"""(?:[uUbBrR]{0,2})(?:'''(?:\\.|[^\\])*?'''|\"{3}(?:\\.|[^\\])*?\"{3}|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")|\#[^\n]*""", re.S)
HOLE = "\0{}\0"
STEPS = [
    (r"(?m)^(\s*(?:.*:\s*)?)print\s*>>\s*([^,\n]+?)\s*,\s*([^\n;]*?)(?=\s*(?:;|$|\0c))", r"\1print(\3, file=\2)"),
    (r"(?m)^(\s*(?:(?:if|else|elif|for|while|try|except|finally|with)\b[^\n]*?:\s*)?)print[ \t]+(?!\()([^\n;]*?),?(?=[ \t]*(?:;|$))", r"\1print(\2)"),
    (r"(?m)^(\s*(?:(?:if|else|elif|for|while|try|except|finally|with)\b[^\n]*?:\s*)?)print[ \t]+(\([^\n;]*?),?(?=[ \t]*(?:;|$))", r"\1print(\2)"),
    (r"(?m)^(\s*)print(?=[ \t]*(?:;|$))", r"\1print()"),
    (r"\bexcept\s+((?:[\w.]+|\([^()]*\)))\s*,\s*(\w+)\s*:", r"except \1 as \2:"),
    (r"(?m)\braise\s+([\w.]+)\s*,\s*([^\n,;]+?)\s*,\s*([^\n;]+?)(?=[ \t]*(?:;|$))", r"raise \1(\2).with_traceback(\3)"),
    (r"(?m)\braise\s+([\w.]+)\s*,\s*([^\n;]+?)(?=[ \t]*(?:;|$))", r"raise \1(\2)"),
    (r"(?m)\bexec\s+(?!\()([^\n;]+?)\s+in\s+([^\n;]+?)(?=[ \t]*(?:;|$))", r"exec(\1, \2)"),
    (r"(?m)\bexec\s+(?!\()([^\n;]+?)(?=[ \t]*(?:;|$))", r"exec(\1)"),
    (r"`([^`\n]+)`", r"repr(\1)"),
    (r"<>", "!="),
    (r"\b0([0-7]+)\b(?![.\w])", r"0o\1"),
    (r"\b(\d+|0[xX][\da-fA-F]+)[lL]\b", r"\1"),
]


def rewritten(text: str) -> str:
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(re.sub(r"^[uU](?=[rR]?['\"])|^([uU])([rR])", lambda p: p[2] or "", m[0]))
        return HOLE.format(len(kept) - 1)

    code = OPAQUE.sub(hide, text).expandtabs(8)
    trail = re.compile(r"(?m)[ \t]*(\0\d+\0)$")
    tails: dict[int, str] = {}
    lines = code.split("\n")
    for i, line in enumerate(lines):  # a comment at the end is set aside, so that statements end where their code does
        m = trail.search(line)
        if m and kept[int(m[1].strip("\0"))].startswith("#"):
            tails[i], lines[i] = m[0], line[: m.start()]
    code = "\n".join(lines)
    for pattern, by in STEPS:
        code = re.sub(pattern, by, code)
    lines = code.split("\n")
    code = "\n".join(line + tails.get(i, "") for i, line in enumerate(lines))
    return re.sub(r"\0(\d+)\0", lambda m: kept[int(m[1])], code)
