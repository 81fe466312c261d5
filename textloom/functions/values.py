"""Nested values, number and date prefixes, string similarity: the scalar library, in Python and as columns."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = object()


def get_path(data: Any, path: str) -> Any:
    """The value at a dotted path; MISSING where a step isn't a map or has no such key."""
    for key in path.split("."):
        if not isinstance(data, dict) or key not in data:
            return MISSING
        data = data[key]
    return data


def set_path(data: dict, path: str, value: Any) -> None:
    """Set through maps only; what is no map on the way becomes one."""
    *way, last = path.split(".")
    for key in way:
        if not isinstance(data.get(key), dict):
            data[key] = {}
        data = data[key]
    data[last] = value


def delete_path(data: dict, path: str) -> bool:
    *way, last = path.split(".")
    for key in way:
        data = data.get(key)
        if not isinstance(data, dict):
            return False
    return data.pop(last, MISSING) is not MISSING


def deep_merge(base: dict, more: dict) -> dict:
    """Maps merge key by key, everything else is replaced."""
    out = dict(base)
    for key, value in more.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def deep_equal(a: Any, b: Any) -> bool:
    """Equality without coercion: true is not 1."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(deep_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(deep_equal, a, b))
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def canonical(value: Any) -> str:
    """JSON with sorted keys at all depths."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


FLOAT = re.compile(r"\s*([+-]?(?:Infinity|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))")


def float_prefix(text: str) -> float:
    """The number that a text begins with, else 0."""
    m = FLOAT.match(text)
    return float(m[1].replace("Infinity", "inf")) if m else 0.0


DATES = ("%Y-%m-%d", "%Y-%m", "%Y", "%m/%d/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y/%m/%d", "%B %Y")


def date_number(text: str) -> float:
    """Milliseconds since 1970 of an ISO or common date, else 0."""
    text = text.strip()
    try:
        when = datetime.fromisoformat(text)
        return (when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() * 1000
    except ValueError:
        pass
    for form in DATES:
        try:
            return datetime.strptime(text, form).replace(tzinfo=UTC).timestamp() * 1000
        except ValueError:
            continue
    return 0.0


#: The root locale's order of ASCII characters that are no letters or digits; all come before those.
PUNCTUATION = "\t\n\v\f\r _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def collation_key(text: str) -> tuple:
    """Order of the root locale for Latin text, near it for other: letters first without marks and case, then marks, then
    lower case before upper. In columns the locale's own order is used."""
    base = unicodedata.normalize("NFKD", text)
    bare = "".join(c for c in base if not unicodedata.combining(c))
    rank = [(0, PUNCTUATION.find(c), c) if not c.isalnum() else (1, 0, c) if c.isdigit() else (2, 0, c) for c in bare.casefold()]
    return rank, [c for c in base if unicodedata.combining(c)], bare.swapcase()


def levenshtein(a: str, b: str, most: int | None = None) -> int:
    """Edit distance; more than `most` is reported as most + 1."""
    if len(a) < len(b):
        a, b = b, a
    if most is not None and len(a) - len(b) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if most is not None and min(row) > most:
            return most + 1
    return row[-1]


def similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1 - levenshtein(a, b) / longest


def most_distance(n: int) -> int:
    """Edits allowed for a target of n characters."""
    return 2 if n <= 5 else 3 if n <= 10 else 5 if n <= 20 else 7


def similar_strings(target: str, candidates: list[str], top: int = 5, most: int | None = None) -> list[tuple[str, int, float]]:
    """Nearest candidates, with and without case, the smaller distance counting; exact ones excluded."""
    limit = most_distance(len(target)) if most is None else most
    out = []
    for c in dict.fromkeys(candidates):
        if c == target:
            continue
        d = min(levenshtein(target, c, limit), levenshtein(target.lower(), c.lower(), limit))
        if d <= limit:
            out.append((c, d, 1 - d / max(len(target), len(c), 1)))
    return sorted(out, key=lambda x: (x[1], x[0]))[:top]


def slug(text: str) -> str:
    text = re.sub(r"\s+", "-", text.lower().strip())
    return re.sub(r"-+", "-", re.sub(r"[^a-z0-9_-]", "", text)).strip("-")


# The same as columns.


def slug_of(text: Column) -> Column:
    text = F.regexp_replace(F.trim(F.lower(text)), r"\s+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9_-]", ""), "-+", "-"), r"^-|-$", "")


def similarity_of(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def occurrences(text: Column, part: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def word_count(text: Column) -> Column:
    """Words after a leading frontmatter block."""
    body = F.regexp_replace(text, r"\A---[^\S\n]*\n[\s\S]*?\n---[^\S\n]*(?:\n|\z)", "")
    return F.regexp_count(body, F.lit(r"\S+"))


def line_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def is_finite(x: float) -> bool:
    return math.isfinite(x)
