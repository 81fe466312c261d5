"""Conditions and validators, as columns where that is exact and in Python everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.codecs import CONDITION_BLOCK, condition_frontmatter
from textloom.functions.patterns import compiled, from_js
from textloom.functions.values import MISSING, deep_equal, get_path, line_count, word_count
from textloom.operators import frontmatter
from textloom.plans.spec import slashed


def holds(condition: dict, text: str) -> bool:
    """A condition on a document; whatever fails to evaluate is false."""
    try:
        kind, value = next(iter(condition.items()))
        if kind == "fileContains":
            return value in text
        if kind == "fileMatches":
            return compiled(*slashed(value)).search(text) is not None
        if kind == "frontmatterEquals":
            found = get_path(condition_frontmatter(text), value["key"])
            return found is not MISSING and deep_equal(found, value["value"])
        if kind == "frontmatterExists":
            return get_path(condition_frontmatter(text), value) is not MISSING
        if kind == "not":
            return not holds(value, text)
        return (any if kind == "anyOf" else all)(holds(c, text) for c in value)
    except Exception:  # noqa: BLE001  bad patterns and bad frontmatter are false
        return False


def leaves(condition: dict) -> list[tuple[str, object]]:
    """The conditions within a condition that test something."""
    kind, value = next(iter(condition.items()))
    if kind == "not":
        return leaves(value)
    return [x for c in value for x in leaves(c)] if kind in ("anyOf", "allOf") else [(kind, value)]


def reads_frontmatter(condition: dict) -> bool:
    return any(kind.startswith("frontmatter") for kind, _ in leaves(condition))


def has_column(condition: dict) -> bool:
    return all(frontmatter.supported(kind, value) for kind, value in leaves(condition) if kind.startswith("frontmatter"))


def condition_column(condition: dict, text: Column) -> Column:
    """The same as a column; frontmatter is read from the column _front (see operators.frontmatter)."""
    kind, value = next(iter(condition.items()))
    if kind == "frontmatterEquals":
        return F.when(text.isNotNull(), frontmatter.equals(value["key"], value["value"]))
    if kind == "frontmatterExists":
        return F.when(text.isNotNull(), frontmatter.exists(value))
    if kind == "fileContains":
        return F.contains(text, F.lit(value))
    if kind == "fileMatches":
        body, flags = slashed(value)
        return text.rlike(from_js(body, flags))
    if kind == "not":
        return ~condition_column(value, text)
    out = F.lit(kind == "allOf")
    for c in value:
        out = out & condition_column(c, text) if kind == "allOf" else out | condition_column(c, text)
    return out


def words(text: str) -> int:
    return len(CONDITION_BLOCK.sub("", text, count=1).split()) if text.startswith("---") else len(text.split())


def lines(text: str) -> int:
    return text.count("\n") + 1 if text else 0


#: Rules in the order in which they are checked; each tells whether a text keeps it.
RULES = {
    "contains": lambda t, v: v in t,
    "notContains": lambda t, v: v not in t,
    "matchesRegex": lambda t, v: compiled(v).search(t) is not None,
    "notMatchesRegex": lambda t, v: compiled(v).search(t) is None,
    "frontmatterRequired": lambda t, v: has_keys(t, v),
    "minWordCount": lambda t, v: words(t) >= v,
    "maxWordCount": lambda t, v: words(t) <= v,
    "minLineCount": lambda t, v: lines(t) >= v,
    "maxLineCount": lambda t, v: lines(t) <= v,
}


def has_keys(text: str, keys: list[str]) -> bool:
    try:
        data = condition_frontmatter(text)
    except Exception:  # noqa: BLE001  bad frontmatter has no keys
        return False
    return all(get_path(data, k) is not MISSING for k in keys)


def failures(rules: dict, text: str) -> list[str]:
    """All rules that a text breaks."""
    return [k for k, ok in RULES.items() if k in rules and not ok(text, rules[k])]


def rule_columns(rules: dict, text: Column) -> list[tuple[str, Column]]:
    """Name and whether it is broken, in order; frontmatter is read from the column _front."""
    make = {
        "frontmatterRequired": lambda v: ~reduce(lambda a, b: a & b, [frontmatter.exists(k) for k in v], F.lit(True)),
        "contains": lambda v: ~F.contains(text, F.lit(v)),
        "notContains": lambda v: F.contains(text, F.lit(v)),
        "matchesRegex": lambda v: ~text.rlike(from_js(v)),
        "notMatchesRegex": lambda v: text.rlike(from_js(v)),
        "minWordCount": lambda v: word_count(text) < v,
        "maxWordCount": lambda v: word_count(text) > v,
        "minLineCount": lambda v: line_count(text) < v,
        "maxLineCount": lambda v: line_count(text) > v,
    }
    return [(k, make[k](rules[k])) for k in RULES if k in rules and k in make]


def failure_array(rules: dict, text: Column) -> Column:
    """All broken rules as an array of names."""
    found = [F.when(broken, F.lit(name)) for name, broken in rule_columns(rules, text)]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def first_failure(rules: dict, text: Column) -> Column:
    """The first broken rule, null if none."""
    found = [F.when(broken, F.lit(name)) for name, broken in rule_columns(rules, text)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")

