"""Programs: a configuration's fields, patches by operator, conditions and validators, read and validated with field paths."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath
from typing import Any, NamedTuple

from textloom.functions.codecs import yaml_load
from textloom.functions.patterns import check_js
from textloom.operators.md import COMMON

#: Fixed values of the configuration's format; the version follows the name of an engine and a slash.
API_VERSION, KIND = "v1", "Kustomization"
NO_MATCH = ("skip", "warn", "error")


class Problem(NamedTuple):
    field: str
    message: str


class Invalid(ValueError):
    def __init__(self, problems: list[Problem]) -> None:
        super().__init__("; ".join(f"{p.field}: {p.message}" for p in problems))
        self.problems = problems


S, I, B, L, M, A, SI, RI = "text", "whole number", "true or false", "list", "map", "any", "text or whole number", "row"
#: Required and optional fields of each operator, with their types.
FIELDS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "replace": ({"old": S, "new": S}, {}),
    "replace-regex": ({"pattern": S, "replacement": S}, {"flags": S}),
    "prepend-to-file": ({"content": S}, {}),
    "append-to-file": ({"content": S}, {}),
    "replace-code-block": ({"index": I, "content": S}, {"language": S}),
    "modify-links": ({}, dict.fromkeys(("urlMatch", "urlPattern", "textMatch", "textPattern", "newUrl", "urlReplacement", "newText", "textReplacement"), S)),
    "replace-line": ({"match": S, "replacement": S}, {}),
    "insert-after-line": ({"content": S}, {"match": S, "pattern": S, "regex": B}),
    "insert-before-line": ({"content": S}, {"match": S, "pattern": S, "regex": B}),
    "delete-between": ({"start": S, "end": S}, {"inclusive": B}),
    "replace-between": ({"start": S, "end": S, "content": S}, {"inclusive": B}),
    "remove-section": ({"id": S}, {"includeChildren": B}),
    "replace-section": ({"id": S, "content": S}, {}),
    "prepend-to-section": ({"id": S, "content": S}, {}),
    "append-to-section": ({"id": S, "content": S}, {}),
    "replace-in-section": ({"id": S, "old": S, "new": S}, {}),
    "rename-header": ({"id": S, "new": S}, {}),
    "move-section": ({"id": S, "after": S}, {}),
    "change-section-level": ({"id": S, "delta": I}, {}),
    "insert-section": ({"id": S, "header": S}, {"position": S, "content": S}),
    "update-toc": ({}, {"marker": S, "endMarker": S, "minLevel": I, "maxLevel": I, "ordered": B, "indent": S}),
    "set-frontmatter": ({"key": S, "value": A}, {}),
    "remove-frontmatter": ({"key": S}, {}),
    "rename-frontmatter": ({"old": S, "new": S}, {}),
    "merge-frontmatter": ({"values": M}, {}),
    "replace-table-cell": ({"table": SI, "row": RI, "column": SI, "content": S}, {}),
    "add-table-row": ({"table": SI, "values": L}, {"position": I}),
    "remove-table-row": ({"table": SI, "row": RI}, {}),
    "add-table-column": ({"table": SI, "header": S}, {"defaultValue": S, "position": I}),
    "remove-table-column": ({"table": SI, "column": SI}, {}),
    "rename-table-column": ({"table": SI, "column": SI, "new": S}, {}),
    "reorder-table-columns": ({"table": SI, "columns": L}, {}),
    "sort-table": ({"table": SI, "column": SI}, {"direction": S, "type": S}),
    "filter-table-rows": ({"table": SI, "column": SI}, {"match": S, "pattern": S, "invert": B}),
    "deduplicate-table-rows": ({"table": SI}, {"column": SI, "keep": S}),
    "add-list-item": ({"list": SI, "item": S}, {"position": I}),
    "remove-list-item": ({"list": SI, "item": SI}, {}),
    "set-list-item": ({"list": SI, "item": SI, "new": S}, {}),
    "sort-list": ({"list": SI}, {"direction": S, "type": S}),
    "filter-list-items": ({"list": SI}, {"match": S, "pattern": S, "invert": B}),
    "deduplicate-list-items": ({"list": SI}, {"keep": S}),
    "reorder-list-items": ({"list": SI, "order": L}, {}),
    "json-set": ({"path": S, "value": A}, {}),
    "json-delete": ({"path": S}, {}),
    "json-merge": ({"value": M}, {"path": S}),
    "copy-file": ({"src": S, "dest": S}, {}),
    "rename-file": ({"match": S, "rename": S}, {}),
    "delete-file": ({"match": S}, {}),
    "move-file": ({"match": S, "dest": S}, {}),
    "write-file": ({"path": S, "content": S}, {}),
    "exec": ({"command": S}, {"timeout": I}),
    "ai-transform": ({"prompt": S}, {"provider": S, "endpoint": S, "apiKeyEnv": S, "model": S, "timeout": I, "maxTokens": I, "temperature": A}),
    "plugin": ({"plugin": S}, {"params": M}),
}
CHOICES = {"position": ("before", "after"), "direction": ("asc", "desc"), "keep": ("first", "last")}
SORT_TYPES = {"sort-table": ("string", "number", "date"), "sort-list": ("string", "number")}
PATTERN_FIELDS = ("pattern", "urlPattern", "textPattern")
SECTION_OPS = frozenset(k for k, (required, _) in FIELDS.items() if "id" in required)
CONDITIONS = ("fileContains", "fileMatches", "frontmatterEquals", "frontmatterExists", "not", "anyOf", "allOf")
RULES = {"contains": S, "notContains": S, "matchesRegex": S, "notMatchesRegex": S, "frontmatterRequired": L, "minWordCount": I, "maxWordCount": I, "minLineCount": I, "maxLineCount": I}
PATCH_RULES = {"notContains": S}
CONFIG_FIELDS = ("apiVersion", "kind", "output", "resources", "patches", "onNoMatch", "validators", "watch", "security", "plugins", "vars", "envVars")


def fits(value: Any, kind: str) -> bool:
    if kind == A:
        return True
    number = isinstance(value, int) and not isinstance(value, bool)
    if kind == RI:
        return number or isinstance(value, dict) and set(value) == {"column", "value"}
    checks = {S: isinstance(value, str), I: number, B: isinstance(value, bool), L: isinstance(value, list), M: isinstance(value, dict)}
    return isinstance(value, str) or number if kind == SI else checks[kind]


def patch_problems(patch: Any, at: str) -> list[Problem]:
    if not isinstance(patch, dict):
        return [Problem(at, "a patch is a map")]
    name = patch.get("op")
    if name not in FIELDS:
        return [Problem(f"{at}.op", f"unknown operator {name!r}")]
    required, optional = FIELDS[name]
    out = [Problem(f"{at}.{k}", "missing") for k in required if k not in patch]
    for key, value in patch.items():
        kind = required.get(key) or optional.get(key)
        if kind:
            if not fits(value, kind):
                out.append(Problem(f"{at}.{key}", f"must be {kind}"))
            elif key in PATTERN_FIELDS and (wrong := check_js(value, patch.get("flags", "") if key == "pattern" else "")):
                out.append(Problem(f"{at}.{key}", wrong))
            elif (key in CHOICES and kind == S and value not in CHOICES[key]) or (key == "type" and value not in SORT_TYPES.get(name, ())):
                out.append(Problem(f"{at}.{key}", f"{value!r} is not a choice"))
        elif key == "id" or key in COMMON:
            out += common_problems(key, value, at)
        else:
            out.append(Problem(f"{at}.{key}", "unknown field"))
    if name == "replace" and patch.get("old") == "":
        out.append(Problem(f"{at}.old", "must not be empty"))
    if name.startswith("insert-") and name.endswith("-line") and "match" not in patch and "pattern" not in patch:
        out.append(Problem(at, "match or pattern is needed"))
    if name == "modify-links" and not any(k in patch for k in ("urlMatch", "urlPattern", "textMatch", "textPattern")):
        out.append(Problem(at, "a criterion is needed"))
    if name == "rename-file" and "/" in str(patch.get("rename", "")):
        out.append(Problem(f"{at}.rename", "must be a name without a folder"))
    return out


def common_problems(key: str, value: Any, at: str) -> list[Problem]:
    where = f"{at}.{key}"
    if key in ("include", "exclude", "extends"):
        ok = isinstance(value, str) or isinstance(value, list) and all(isinstance(x, str) for x in value)
        return [] if ok else [Problem(where, "must be text or a list of text")]
    if key == "onNoMatch":
        return [] if value in NO_MATCH else [Problem(where, f"{value!r} is not a choice")]
    if key == "when":
        return condition_problems(value, where)
    if key == "validate":
        return rule_problems(value, where)
    return [] if isinstance(value, str) and value else [Problem(where, "must be text")]


def condition_problems(c: Any, at: str) -> list[Problem]:
    if not isinstance(c, dict) or len(c) != 1 or (kind := next(iter(c))) not in CONDITIONS:
        return [Problem(at, f"must be one of {', '.join(CONDITIONS)}")]
    value = c[kind]
    if kind == "not":
        return condition_problems(value, f"{at}.not")
    if kind in ("anyOf", "allOf"):
        if not isinstance(value, list) or not value:
            return [Problem(f"{at}.{kind}", "must be a list with conditions")]
        return [p for k, x in enumerate(value) for p in condition_problems(x, f"{at}.{kind}[{k}]")]
    if kind == "frontmatterEquals":
        return [] if isinstance(value, dict) and "key" in value and "value" in value else [Problem(f"{at}.{kind}", "needs key and value")]
    if not isinstance(value, str):
        return [Problem(f"{at}.{kind}", "must be text")]
    if kind == "fileMatches" and (wrong := check_js(*slashed(value))):
        return [Problem(f"{at}.{kind}", wrong)]
    return []


def slashed(pattern: str) -> tuple[str, str]:
    """Body and flags of a pattern that may be written /body/flags."""
    if pattern.startswith("/") and (end := pattern.rfind("/")) > 0:
        return pattern[1:end], pattern[end + 1 :]
    return pattern, ""


def rule_problems(rules: Any, at: str) -> list[Problem]:
    if not isinstance(rules, dict):
        return [Problem(at, "must be a map")]
    out = []
    for key, value in rules.items():
        if key == "name":
            continue
        if key not in RULES or not fits(value, RULES[key]):
            out.append(Problem(f"{at}.{key}", f"must be {RULES[key]}" if key in RULES else "unknown rule"))
        elif key.lower().endswith("regex") and (wrong := check_js(value)):
            out.append(Problem(f"{at}.{key}", wrong))
    return out


def id_of(patch: dict) -> str | None:
    """A patch's own id: patchId anywhere, id where it isn't a section's."""
    return patch.get("patchId") or (None if patch["op"] in SECTION_OPS else patch.get("id"))


def problems(config: Any) -> list[Problem]:
    """Everything that is wrong with a configuration."""
    if not isinstance(config, dict):
        return [Problem("config", "must be a map")]
    out = []
    if not re.fullmatch(rf"[a-z]+/{API_VERSION}", str(config.get("apiVersion"))):
        out.append(Problem("apiVersion", f"must be <engine>/{API_VERSION}"))
    if config.get("kind") != KIND:
        out.append(Problem("kind", f"must be {KIND}"))
    if not isinstance(config.get("resources"), list) or not config["resources"]:
        out.append(Problem("resources", "must be a list with resources"))
    if config.get("onNoMatch", "warn") not in NO_MATCH:
        out.append(Problem("onNoMatch", "is not a choice"))
    patches = config.get("patches", [])
    if not isinstance(patches, list):
        return [*out, Problem("patches", "must be a list")]
    seen: dict[str, int] = {}
    for k, patch in enumerate(patches):
        found = patch_problems(patch, f"patches[{k}]")
        out += found
        if found and any(p.field.endswith(".op") for p in found) or not isinstance(patch, dict):
            continue
        parents = patch.get("extends", [])
        for parent in [parents] if isinstance(parents, str) else parents:
            if parent not in seen:
                out.append(Problem(f"patches[{k}].extends", f"no earlier patch has id {parent!r}"))
        if name := id_of(patch):
            if name in seen:
                out.append(Problem(f"patches[{k}].id", f"{name!r} is taken"))
            seen[name] = k
    for k, v in enumerate(config.get("validators", [])):
        if not isinstance(v, dict) or not isinstance(v.get("name"), str):
            out.append(Problem(f"validators[{k}].name", "missing"))
        else:
            out += rule_problems(v, f"validators[{k}]")
    return out


def read(text: str) -> dict:
    """A valid configuration from YAML."""
    config = yaml_load(text)
    if found := problems(config):
        raise Invalid(found)
    return config


def schema() -> dict:
    """The configuration as JSON Schema."""
    types = {S: {"type": "string"}, I: {"type": "integer"}, B: {"type": "boolean"}, L: {"type": "array"}, M: {"type": "object"}, A: {}, SI: {"type": ["string", "integer"]}, RI: {"type": ["integer", "object"]}}
    patches = [{"type": "object", "required": ["op", *need], "properties": {"op": {"const": name}} | {k: types[v] for k, v in (need | may).items()}} for name, (need, may) in FIELDS.items()]
    return {
        "$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "required": ["apiVersion", "kind", "resources"],
        "properties": {"apiVersion": {"pattern": f"^[a-z]+/{API_VERSION}$"}, "kind": {"const": KIND}, "resources": {"type": "array", "minItems": 1}, "onNoMatch": {"enum": list(NO_MATCH)}, "patches": {"type": "array", "items": {"oneOf": patches}}},
    }


def relative(path: str) -> str:
    """A path within its corpus; an escape raises ValueError."""
    parts: list[str] = []
    for x in PurePosixPath(path.replace("\\", "/")).parts:
        if x == "..":
            if not parts:
                raise ValueError(f"{path!r} leaves the corpus")
            parts.pop()
        elif x == "/":
            raise ValueError(f"{path!r} is not relative")
        elif x != ".":
            parts.append(x)
    return "/".join(parts)


def as_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)
