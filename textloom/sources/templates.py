"""Templates of configurations: {{name}} substitution with an escape, built-in and user templates, and scaffolding.

A user template is a folder with a `template.yaml` (name, description, variables) and the files that it writes; later folders
win over earlier ones, and all over those built in.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from textloom.functions.codecs import yaml_load
from textloom.plans.spec import relative

VARIABLE = re.compile(r"(\\?)\{\{\s*([A-Za-z_]\w*)\s*\}\}")
FILE = "template.yaml"


def substitute(text: str, values: Mapping[str, str]) -> str:
    """Known names become their values, unknown ones stay, \\{{ loses its backslash."""
    return VARIABLE.sub(lambda m: m[0][1:] if m[1] else str(values.get(m[2], m[0])), text)


def names(text: str) -> list[str]:
    return list(dict.fromkeys(m[2] for m in VARIABLE.finditer(text) if not m[1]))


@dataclass
class Template:
    """Files by their path, and variables with their defaults (None: must be given)."""

    name: str
    description: str
    files: dict[str, str]
    variables: dict[str, str | None] = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)

    def rendered(self, values: Mapping[str, str]) -> dict[str, str]:
        """path, text of all files; ValueError if a variable without a default isn't given."""
        known = {k: v for k, v in self.variables.items() if v is not None} | dict(values)
        asked = dict.fromkeys([*self.variables, *(n for p, t in self.files.items() for n in (*names(p), *names(t)))])
        if missing := [n for n in asked if n not in known]:
            raise ValueError(f"template {self.name!r} needs {', '.join(missing)}")
        return {relative(substitute(path, known)): substitute(text, known) for path, text in self.files.items()}


CONFIG = "output: {{output}}\nresources:\n  - \"{{resource}}\"\npatches: []\n"
BUILT_IN = {
    t.name: t
    for t in (
        Template("base", "Documents of one folder, as they are", {"config.yaml": CONFIG, "README.md": "# {{title}}\n"}, {"output": "out", "resource": "**/*.md", "title": "Documents"}, ["starter"]),
        Template("overlay", "Changes over another configuration", {"config.yaml": CONFIG.replace("[]", "\n  - op: append-to-file\n    content: {{note}}")}, {"output": "out", "resource": "../base", "note": "changed"}, ["starter"]),
        Template("fork", "Changes over a repository's documents", {"config.yaml": CONFIG, "README.md": "# Changes over {{resource}}\n"}, {"output": "out", "resource": None}, ["git"]),
        Template("pipeline", "Stages, each over the one before", {f"{k}/config.yaml": CONFIG.replace("{{resource}}", r) for k, r in (("base", "{{resource}}"), ("staging", "../base"), ("production", "../staging"))}, {"output": "out", "resource": "**/*.md"}, ["stages"]),
    )
}


def load(folder: str | Path) -> Template:
    """The user template in a folder."""
    folder = Path(folder)
    told = yaml_load((folder / FILE).read_text()) or {}
    files = {p.relative_to(folder).as_posix(): p.read_text() for p in sorted(folder.rglob("*")) if p.is_file() and p.name != FILE}
    variables = {k: (v.get("default") if isinstance(v, dict) else v) for k, v in (told.get("variables") or {}).items()}
    return Template(told.get("name") or folder.name, told.get("description") or "", files, variables, told.get("tags") or [])


def available(*folders: str | Path) -> dict[str, Template]:
    """Templates by name: those built in, then those in the folders below each of these."""
    out = dict(BUILT_IN)
    for f in folders:
        for p in sorted(Path(f).iterdir()) if Path(f).is_dir() else ():
            if (p / FILE).is_file():
                t = load(p)
                out[t.name] = t
    return out


def scaffold(template: Template, target: str | Path, values: Mapping[str, str], *, overwrite: bool = False) -> list[str]:
    """Write a template's files below a folder; their paths. Files that are there are an error unless they may be replaced."""
    files = template.rendered(values)
    if not overwrite and (there := [p for p in files if Path(target, p).exists()]):
        raise FileExistsError(", ".join(there))
    for path, text in files.items():
        Path(target, path).parent.mkdir(parents=True, exist_ok=True)
        Path(target, path).write_text(text, newline="")
    return sorted(files)
