"""Globs and ECMAScript regular expressions as patterns of Java and of Python."""

from __future__ import annotations

import re
from functools import lru_cache

GLOB_CHARS = frozenset("*?[]{}!()+@")


@lru_cache(4096)
def glob_regex(glob: str, dot: bool = False) -> str:
    """An anchored pattern for a path glob: **, *, ?, classes, braces and extended groups; `dot` lets * match dot files."""
    head = "" if dot else r"(?!\.)"
    segment = head + r"[^/]*?"

    def convert(g: str, at_start: bool) -> str:
        out, i, start = "", 0, at_start
        while i < len(g):
            c = g[i]
            if g.startswith("**", i) and start and (i + 2 == len(g) or g[i + 2] == "/"):
                if i + 2 == len(g):
                    out += rf"(?:{segment}(?:/{segment})*)?" if not dot else ".*?"
                    i += 2
                else:
                    out += rf"(?:{segment}/)*?" if not dot else r"(?:[^/]*?/)*?"
                    i += 3
                    start = True
                    continue
            elif c in "?*+@!" and i + 1 < len(g) and g[i + 1] == "(" and (end := closing(g, i + 1, "(", ")")) > 0:
                inner = "|".join(convert(x, start) for x in split_top(g[i + 2 : end], "|"))
                if c == "!":
                    rest = convert(g[end + 1 :], False)
                    return out + f"(?!(?:{inner}){rest}$){head if start else ''}[^/]*?{rest}"
                out += {"?": f"(?:{inner})?", "*": f"(?:{inner})*", "+": f"(?:{inner})+", "@": f"(?:{inner})"}[c]
                i = end + 1
            elif c == "*":
                while i < len(g) and g[i] == "*":
                    i += 1
                out += (segment if start and not dot else "[^/]*?") if i < len(g) and g[i] != "/" or not start else head + "[^/]+?"
            elif c == "?":
                out += (head if start else "") + "[^/]"
                i += 1
            elif c == "[" and (end := g.find("]", i + 2)) > 0:
                body = g[i + 1 : end]
                body = "^" + body[1:] if body[0] in "!^" else body
                out += "[" + body.replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&") + "]"
                i = end + 1
            elif c == "{" and (end := closing(g, i, "{", "}")) > 0:
                parts = split_top(g[i + 1 : end], ",")
                if len(parts) == 1 and (m := re.fullmatch(r"(-?\d+)\.\.(-?\d+)", parts[0])):
                    a, b = int(m[1]), int(m[2])
                    parts = [str(n) for n in range(min(a, b), max(a, b) + 1)]
                out += "(?:" + "|".join(convert(p, start) for p in parts) + ")"
                i = end + 1
            elif c == "\\" and i + 1 < len(g):
                out += re.escape(g[i + 1])
                i += 2
            else:
                out += re.escape(c) if c != "/" else "/"
                i += 1
                start = c == "/"
                continue
            start = False
        return out

    if glob.startswith("!") and not glob.startswith("!("):
        return rf"^(?!{glob_regex(glob[1:], dot)[1:]}).*$"
    return f"^{convert(glob.removeprefix('./'), True)}$"


def closing(text: str, at: int, left: str, right: str) -> int:
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == left) - (text[k] == right)
        if not depth:
            return k
    return -1


def split_top(text: str, by: str) -> list[str]:
    """Parts between separators outside nested groups."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c in "({") - (c in ")}")
        if c == by and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def is_glob(text: str) -> bool:
    return any(c in GLOB_CHARS for c in text)


def matches(path: str, glob: str, dot: bool = False) -> bool:
    return re.search(glob_regex(glob, dot), path) is not None


def admitted(path: str, include: list[str], exclude: list[str]) -> bool:
    """Any include matches, or there is none; no exclude matches."""
    return (not include or any(matches(path, g) for g in include)) and not any(matches(path, g) for g in exclude)


class Unsupported(ValueError):
    """A pattern that has no equal in the target dialect."""


def _tokens(pattern: str):
    """Pieces of a pattern and whether each stands in a class."""
    i, inside = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            size = 2
            if m := re.match(r"\\(?:u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|c[A-Za-z]|k<[^>]+>)", pattern[i:]):
                size = m.end()
            yield pattern[i : i + size], inside
            i += size
            continue
        if inside:
            inside = c != "]"
            yield c, True
            i += 1
            continue
        if c == "[":
            size = 2 if pattern[i + 1 : i + 2] == "^" else 1
            yield pattern[i : i + size], False
            inside = True
            i += size
            if pattern[i : i + 1] == "]":  # the empty class matches nothing
                raise Unsupported("empty class")
            continue
        if m := re.match(r"\(\?<([A-Za-z_$][\w$]*)>", pattern[i:]):
            yield m[0], False
            i += m.end()
            continue
        yield c, False
        i += 1


LINE_ENDS = r"\n\r\u2028\u2029"
SPACES = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@lru_cache(4096)
def from_js(pattern: str, flags: str = "", dialect: str = "java") -> str:
    """An ECMAScript pattern in the other dialect, its flags i, m, s inside. g, u and y are left to the caller."""
    multi, dotall = "m" in flags, "s" in flags
    end = r"\z" if dialect == "java" else r"\Z"
    out = ""
    for t, inside in _tokens(pattern):
        if t == "." and not inside:
            out += r"[\s\S]" if dotall else f"[^{LINE_ENDS}]"
        elif t == "^" and not inside:
            out += rf"(?<![^{LINE_ENDS}])" if multi else r"\A"
        elif t == "$" and not inside:
            out += rf"(?![^{LINE_ENDS}])" if multi else end
        elif t in (r"\d", r"\D", r"\w", r"\W"):
            body = {"d": "0-9", "w": "A-Za-z0-9_"}[t[1].lower()]
            if inside and t[1].isupper():
                raise Unsupported(f"{t} in a class")
            out += body if inside else f"[{'^' * t[1].isupper()}{body}]"
        elif t in (r"\s", r"\S"):
            if inside and t == r"\S":
                out += r"\S"
            else:
                out += SPACES if inside else f"[{'^' * t[1].isupper()}{SPACES}]"
        elif t == "[" and inside:
            out += r"\["
        elif t.startswith("(?<"):
            name = re.sub(r"[^A-Za-z0-9]", "", t[3:-1]) if dialect == "java" else t[3:-1].replace("$", "_")
            out += f"(?<{name}>" if dialect == "java" else f"(?P<{name}>"
        elif t.startswith(r"\k<"):
            out += t if dialect == "java" else f"(?P={t[3:-1]})"
        elif t.startswith(r"\u{"):
            out += re.escape(chr(int(t[3:-1], 16)))
        elif t == r"\/" or t in (r"\-", r"\'", r'\"') or len(t) == 2 and t[0] == "\\" and not t[1].isalnum():
            out += "\\" + t[1] if not t[1].isspace() and t[1] not in "/'\"" else t[1]
        elif t == r"\0":
            out += r"\x00"
        elif t == r"\v":
            out += r"\x0b"
        elif t in (r"\p", r"\P") and dialect == "python":
            raise Unsupported("property classes")
        elif len(t) == 2 and t[0] == "\\" and t[1] in "aehzZAGQERXNHVL":
            out += t[1]  # no special meaning there
        else:
            out += t
    return ("(?i)" if "i" in flags else "") + out


def check_js(pattern: str, flags: str = "") -> str | None:
    """What is wrong with a pattern, if anything."""
    if set(flags) - set("gimsuy") or len(set(flags)) != len(flags):
        return f"invalid flags: {flags}"
    try:
        re.compile(from_js(pattern, flags, "python"))
    except (re.error, Unsupported) as e:
        return f"invalid regular expression: {e}"
    return None


@lru_cache(4096)
def compiled(pattern: str, flags: str = "") -> re.Pattern[str]:
    return re.compile(from_js(pattern, flags, "python"))


REFERENCE = re.compile(r"\$(?:(\$)|(&)|(`)|(')|(\d{1,2})|<([^>]*)>)")


def expand(template: str, m: re.Match[str]) -> str:
    """An ECMAScript replacement for a match."""

    def one(r: re.Match[str]) -> str:
        if r[1]:
            return "$"
        if r[2]:
            return m[0]
        if r[3]:
            return m.string[: m.start()]
        if r[4]:
            return m.string[m.end() :]
        if r[5]:
            for digits in (r[5], r[5][:1]):
                if 1 <= int(digits) <= m.re.groups:
                    return (m[int(digits)] or "") + r[5][len(digits) :]
            return r[0]
        return (m.groupdict().get(r[6]) or "") if m.re.groupindex else r[0]

    return REFERENCE.sub(one, template)


def java_replacement(template: str, groups: int, names: tuple[str, ...] = ()) -> str:
    """The same template for Java; text before and after a match has no form there."""
    out, at = "", 0
    quote = lambda s: s.replace("\\", r"\\").replace("$", r"\$")
    for r in REFERENCE.finditer(template):
        out += quote(template[at : r.start()])
        at = r.end()
        if r[1]:
            out += r"\$"
        elif r[2]:
            out += "$0"
        elif r[3] or r[4]:
            raise Unsupported("$` and $'")
        elif r[5]:
            digits = next((d for d in (r[5], r[5][:1]) if 1 <= int(d) <= groups), None)
            out += quote(r[0]) if digits is None else "${0}".replace("{0}", str(int(digits))) + ("" if len(digits) == len(r[5]) else rf"\{r[5][1]}")
        else:
            out += "${" + re.sub(r"[^A-Za-z0-9]", "", r[6]) + "}" if r[6] in names else ("" if names else quote(r[0]))
    return out + quote(template[at:])
