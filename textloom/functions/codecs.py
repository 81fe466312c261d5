"""Frontmatter and structured files as nested values: YAML, JSON, TOML, .env and .properties, read and written."""

from __future__ import annotations

import json
import re
import tomllib
from datetime import date, datetime
from functools import lru_cache
from typing import Any

import yaml


class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML 1.2 core scalars, and timestamps as text stays dates."""


Loader.yaml_implicit_resolvers = {}
for tag, pattern, first in (
    ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("tag:yaml.org,2002:int", r"^(?:[-+]?(?:0b[01_]+|0o[0-7_]+|0x[0-9a-fA-F_]+|[0-9][0-9_]*))$", "-+0123456789"),
    ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:[0-9][0-9_]*)(?:\.[0-9_]*)?(?:[eE][-+]?[0-9]+)?|[-+]?\.[0-9][0-9_]*(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
    ("tag:yaml.org,2002:timestamp", r"^(?:\d{4}-\d{2}-\d{2}|\d{4}-\d{1,2}-\d{1,2}(?:[Tt]|[ \t]+)\d{1,2}:\d{2}:\d{2}(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d{1,2}(?::?\d{2})?))?)$", "0123456789"),
    ("tag:yaml.org,2002:merge", r"^(?:<<)$", "<"),
):
    Loader.add_implicit_resolver(tag, re.compile(pattern), list(first))


def _int(loader: Loader, node: yaml.Node) -> int:
    text = node.value.replace("_", "")
    sign, digits = (-1 if text[0] == "-" else 1), text.lstrip("+-")
    return sign * (int(digits, 0) if digits[:2] in ("0b", "0o", "0x") else int(digits))


Loader.add_constructor("tag:yaml.org,2002:int", _int)


class Dumper(yaml.SafeDumper):
    """Keys in order, block style, lists indented, no line folding, no anchors."""

    def ignore_aliases(self, data: Any) -> bool:
        return True

    def increase_indent(self, flow: bool = False, indentless: bool = False) -> None:
        super().increase_indent(flow, False)


Dumper.yaml_implicit_resolvers = Loader.yaml_implicit_resolvers


def _text(dumper: Dumper, data: str) -> yaml.Node:
    style = "|" if "\n" in data and data.strip() and not re.search(r"[^\S\n]\n|[\x00-\x08\x0b-\x1f\x7f]", data) else None
    return dumper.represent_scalar("tag:yaml.org,2002:str", data, style=style)


Dumper.add_representer(str, _text)
Dumper.add_representer(type(None), lambda d, _: d.represent_scalar("tag:yaml.org,2002:null", "null"))
Dumper.add_representer(float, lambda d, x: d.represent_scalar("tag:yaml.org,2002:float" if x != int(x) or abs(x) > 1e15 else "tag:yaml.org,2002:int", repr(int(x)) if x == int(x) and abs(x) <= 1e15 else repr(x)) if x == x and abs(x) != float("inf") else yaml.SafeDumper.represent_float(d, x))


#: Keys and scalars that are themselves in every YAML reader and writer; lists of such scalars under their key.
SIMPLE_KEY, SIMPLE_TEXT, SIMPLE_INT = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z"), re.compile(r"[A-Za-z](?:[A-Za-z0-9 _./-]*[A-Za-z0-9])?\Z"), re.compile(r"(?:0|-?[1-9][0-9]*)\Z")
WORDS = {"true": True, "false": False, "null": None}


def _simple(text: str) -> Any:
    """The value of a simple scalar; KeyError for any other."""
    if SIMPLE_TEXT.match(text):
        if text in WORDS:
            return WORDS[text]
        if text.lower() not in WORDS:
            return text
    elif SIMPLE_INT.match(text):
        return int(text)
    raise KeyError(text)


def simple_load(lines: list[str]) -> dict:
    """A block of `key: scalar` lines and lists of scalars, as yaml_load reads it; KeyError if anything else is there."""
    out: dict = {}
    items: list | None = None
    for line in lines:
        if line.startswith("  - ") and items is not None:
            items.append(_simple(line[4:]))
            continue
        if items == []:
            raise KeyError(line)
        key, colon, value = line.partition(":")
        if not colon or not SIMPLE_KEY.match(key) or key.lower() in WORDS or (value and value[0] != " "):
            raise KeyError(line)
        items = None if value else []
        out[key] = _simple(value[1:]) if value else items
    if items == []:
        raise KeyError("an empty value")
    return out


def _scalar(value: Any) -> str | None:
    """A scalar as yaml_dump writes it, None for what needs more care."""
    if value is None or value is True or value is False:
        return {None: "null", True: "true", False: "false"}[value]
    if type(value) is int:
        return str(value)
    return value if type(value) is str and SIMPLE_TEXT.match(value) and value.lower() not in WORDS else None


def simple_dump(key: Any, value: Any, pad: str = "") -> str | None:
    """One entry of a map as yaml_dump writes it, None for what needs more care."""
    if type(key) is not str or not SIMPLE_KEY.match(key) or key.lower() in WORDS:
        return None
    if type(value) in (list, dict) and value:
        inner = pad + "  "
        parts = [simple_dump(k, v, inner) for k, v in value.items()] if type(value) is dict else [f"{inner}- {x}\n" if (x := _scalar(y)) else None for y in value]
        return None if None in parts else f"{pad}{key}:\n{''.join(parts)}"
    text = _scalar(value)
    return None if text is None else f"{pad}{key}: {text}\n"


def yaml_load(text: str) -> Any:
    return yaml.load(text, Loader)  # noqa: S506  a safe loader


def yaml_dump(data: Any) -> str:
    return yaml.dump(data, Dumper=Dumper, sort_keys=False, width=float("inf"), allow_unicode=True, default_flow_style=False)


def split_frontmatter(text: str) -> tuple[dict, str, bool]:
    """The engine's grammar: exact --- lines. Data, body and whether there is a block; bad YAML counts as none."""
    lines = text.split("\n")
    if lines[0] != "---" or "---" not in lines[1:]:
        return {}, text, False
    end = lines.index("---", 1)
    try:
        data = simple_load(lines[1:end])
    except KeyError:
        try:
            data = yaml_load("\n".join(lines[1:end]))
        except (yaml.YAMLError, ValueError):
            return {}, text, False
    return (data if isinstance(data, dict) else {}), "\n".join(lines[end + 1 :]), True


def join_frontmatter(data: dict, body: str) -> str:
    parts = [simple_dump(k, v) or yaml_dump({k: v}) for k, v in data.items()]
    return f"---\n{''.join(parts) or yaml_dump(data)}---\n{body}"


CONDITION_BLOCK = re.compile(r"\A---\s*\n(.*?)\n---\s*\n", re.S)


def condition_frontmatter(text: str) -> dict:
    """The grammar of conditions and validators: spaces after --- are fine, a final line feed is needed. Bad YAML raises."""
    m = CONDITION_BLOCK.match(text)
    return _condition_block(m[1]) if m else {}


@lru_cache(maxsize=4)  # the conditions of neighbouring patches read one block
def _condition_block(block: str) -> dict:
    """Its data, which nobody changes."""
    try:
        return simple_load(block.split("\n"))
    except KeyError:
        data = yaml_load(block)
    return data if isinstance(data, dict) else {}


def format_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    if name == ".env" or name.startswith(".env.") or name.endswith(".env"):
        return "env"
    return {"json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "properties": "properties"}.get(name.rsplit(".", 1)[-1] if "." in name else "")


def pairs(text: str, nested: bool) -> dict:
    out: dict = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        at = min((k for k in (line.find("="), line.find(":")) if k >= 0), default=-1)
        if at < 0:
            continue
        key, value = line[:at].strip(), line[at + 1 :].strip()
        if not nested and len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        node = out
        *way, last = key.split(".") if nested else [key]
        for k in way:
            if not isinstance(node.get(k), dict):
                node[k] = {}
            node = node[k]
        node[last] = value
    return out


def flat(data: dict, prefix: str = "") -> list[tuple[str, Any]]:
    return [x for k, v in data.items() for x in (flat(v, f"{prefix}{k}.") if isinstance(v, dict) else [(prefix + str(k), v)])]


def shown(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def load(text: str, form: str) -> dict:
    """A file's root map; an empty file is an empty map. Raises ValueError for what can't be read."""
    try:
        if form == "json":
            data = json.loads(text) if text.strip() else {}
        elif form == "yaml":
            data = yaml_load(text)
        elif form == "toml":
            data = tomllib.loads(text)
        else:
            data = pairs(text, form == "properties")
    except (yaml.YAMLError, tomllib.TOMLDecodeError) as e:
        raise ValueError(str(e)) from e
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ValueError("the root is not a map")
    return data


def dump(data: dict, form: str) -> str:
    if form == "json":
        return json.dumps(data, indent=2, ensure_ascii=False, default=str)
    if form == "yaml":
        return yaml_dump(data)
    if form == "toml":
        return toml_dump(data)
    if form == "env":
        return "\n".join(f"{k}={quoted(shown(v))}" for k, v in data.items()) + ("\n" if data else "")
    return "\n".join(f"{k}={shown(v)}" for k, v in flat(data)) + ("\n" if data else "")


def quoted(value: str) -> str:
    return f'"{value}"' if re.search(r"[\s#]", value) else value


def toml_key(key: str) -> str:
    return key if re.fullmatch(r"[A-Za-z0-9_-]+", key) else json.dumps(key, ensure_ascii=False)


def toml_value(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, list):
        return "[" + ", ".join(map(toml_value, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{toml_key(k)} = {toml_value(v)}" for k, v in value.items()) + "}"
    return json.dumps("" if value is None else str(value), ensure_ascii=False)


def toml_dump(data: dict, prefix: str = "") -> str:
    """Scalars and arrays of a table first, then its tables. Nulls have no form and are left out."""
    tables = {k: v for k, v in data.items() if isinstance(v, dict)}
    arrays = {k: v for k, v in data.items() if isinstance(v, list) and v and all(isinstance(x, dict) for x in v)}
    out = [f"{toml_key(k)} = {toml_value(v)}\n" for k, v in data.items() if k not in tables and k not in arrays and v is not None]
    for k, v in tables.items():
        name = prefix + toml_key(k)
        simple = any(not isinstance(x, dict) for x in v.values()) or not v
        out.append((f"\n[{name}]\n" if simple else "") + toml_dump(v, name + "."))
    for k, rows in arrays.items():
        name = prefix + toml_key(k)
        out += [f"\n[[{name}]]\n" + toml_dump(x, name + ".") for x in rows]
    text = "".join(out)
    return text.lstrip("\n") if not prefix else text
