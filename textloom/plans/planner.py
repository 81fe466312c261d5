"""From a configuration to a program: inheritance, variables, groups, and the split of patches by what runs them."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from textloom.operators.frontmatter import path_of
from textloom.operators.md import CORPUS_OPS
from textloom.operators.native import BUILDERS
from textloom.plans.spec import id_of

VARIABLE = re.compile(r"\$\{(\w+)\}")


@dataclass
class Program:
    """What a build runs, in order: corpus patches first, then content patches on every document they admit."""

    corpus: list[dict]
    content: list[dict]
    on_no_match: str = "warn"
    validators: list[dict] = field(default_factory=list)


def as_list(value: Any) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def inherited(patches: list[dict]) -> list[dict]:
    """Patches with their parents' fields: parents from left to right, then the patch; include and exclude add up."""
    named = {name: p for p in patches if (name := id_of(p))}
    done: dict[int, dict] = {}

    def resolve(patch: dict, way: tuple[str, ...]) -> dict:
        if id(patch) in done:
            return done[id(patch)]
        out: dict = {}
        for parent in as_list(patch.get("extends")):
            if parent in way:
                raise ValueError(f"patches extend each other: {' -> '.join((*way, parent))}")
            if parent not in named:
                raise ValueError(f"no patch has id {parent!r}")
            out = merged(out, {k: v for k, v in resolve(named[parent], (*way, parent)).items() if k not in ("patchId", "id") or k == "id" and patch.get("op") == named[parent]["op"] and "id" not in patch and id_of(named[parent]) != parent})
        done[id(patch)] = out = merged(out, {k: v for k, v in patch.items() if k != "extends"})
        return out

    return [resolve(p, (id_of(p),) if id_of(p) else ()) for p in patches]


def merged(base: dict, more: dict) -> dict:
    out = base | more
    for key in ("include", "exclude"):
        if key in base and key in more:
            out[key] = as_list(base[key]) + as_list(more[key])
    return out


def substituted(patch: dict, variables: Mapping[str, str]) -> dict:
    """${name} in text fields and lists of text; unknown names stay."""

    def fill(text: str) -> str:
        return VARIABLE.sub(lambda m: str(variables.get(m[1], m[0])), text)

    return {k: fill(v) if isinstance(v, str) else [fill(x) if isinstance(x, str) else x for x in v] if isinstance(v, list) else v for k, v in patch.items()}


def in_groups(patch: dict, enable: list[str] | None, disable: list[str] | None) -> bool:
    """Ungrouped patches always run; a list of enabled groups wins, else disabled groups don't run."""
    group = patch.get("group")
    if not group:
        return True
    return group in enable if enable else group not in (disable or ())


def variables_of(config: dict, given: Mapping[str, str] | None) -> dict[str, str]:
    """Configured values, then listed environment variables, then given ones."""
    return dict(config.get("vars") or {}) | {k: os.environ[k] for k in config.get("envVars") or () if k in os.environ} | dict(given or {})


def program(config: dict, *, variables: Mapping[str, str] | None = None, enable: list[str] | None = None, disable: list[str] | None = None) -> Program:
    values = variables_of(config, variables)
    patches = [substituted(p, values) for p in inherited(config.get("patches") or []) if in_groups(p, enable, disable)]
    return Program([p for p in patches if p["op"] in CORPUS_OPS], [p for p in patches if p["op"] not in CORPUS_OPS], config.get("onNoMatch", "warn"), config.get("validators") or [])


def own(patch: dict) -> dict:
    """A patch without its id, which is no parameter but for sections."""
    from textloom.plans.spec import SECTION_OPS

    return patch if patch["op"] in SECTION_OPS else {k: v for k, v in patch.items() if k != "id"}


def needs_python(patch: dict) -> bool:
    """Whether an operator, condition or rule of a patch has no form as a column."""
    from textloom.plans.checks import has_column

    keys = (patch.get("validate") or {}).get("frontmatterRequired", [])
    return patch["op"] not in BUILDERS or patch.get("type") == "date" or not has_column(patch.get("when") or {"allOf": []}) or any(path_of(k) is None for k in keys)


#: Operators that sort by the whole root locale as columns, by an approximation of it in Python.
COLLATED = ("sort-table", "sort-list")


def parsers(patch: dict) -> int:
    """How often a patch as columns hands frontmatter to a YAML parser: each time is a Python worker of every task."""
    from textloom.plans.checks import reads_frontmatter

    return ("when" in patch and reads_frontmatter(patch["when"])) + ("frontmatterRequired" in (patch.get("validate") or {}))


def runs(patches: list[dict], fuse: bool = True) -> list[tuple[bool, list[dict]]]:
    """Neighbouring patches that run alike: (in Python, patches).

    fuse: neighbours that run in Python or parse frontmatter run in Python together, as all workers of a task live at once:
    as columns each would have its own, and their memory would grow with the program's length.
    """
    marks = [needs_python(p) for p in patches]
    at = 0
    while fuse and at < len(patches):
        end = at
        while end < len(patches) and (marks[end] or parsers(patches[end]) and patches[end]["op"] not in COLLATED):
            end += 1
        if sum(1 if marks[k] else parsers(patches[k]) for k in range(at, end)) > 1:
            marks[at:end] = [True] * (end - at)
        at = max(end, at + 1)
    out: list[tuple[bool, list[dict]]] = []
    for python, p in zip(marks, patches, strict=True):
        if out and out[-1][0] == python:
            out[-1][1].append(p)
        else:
            out.append((python, [p]))
    return out
