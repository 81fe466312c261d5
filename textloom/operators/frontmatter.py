"""Frontmatter as VARIANT: read once a document, its nested paths compared as columns.

Blocks of `key: scalar` lines and lists of scalars, the same that `simple_load` reads without a YAML parser, become JSON by
a fold over their lines and never leave the JVM. Any other block goes to the YAML parser in Python, the block alone; all
other rows send a null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.codecs import yaml_load
from textloom.operators.blocks import WHITE

BLOCK = rf"(?s)\A---{WHITE}*\n(.*?)\n---{WHITE}*\n"
KEY, TEXT, INT = r"[A-Za-z_][A-Za-z0-9_-]*", r"[A-Za-z](?:[A-Za-z0-9 _./-]*[A-Za-z0-9])?", r"(?:0|-?[1-9][0-9]{0,17})"
#: Scalars that readers of YAML take for something else when written otherwise.
WORDS, ODD = ("true", "false", "null"), r"(?i)(?:true|false|null)"
#: Names of the types of a number in a VARIANT.
NUMBERS = r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def scalar(x: Column) -> Column:
    """A simple scalar as JSON, null for any other."""
    words = x.isin(*WORDS)
    return F.when(words | x.rlike(rf"\A{INT}\z"), x).when(x.rlike(rf"\A{TEXT}\z") & ~x.rlike(rf"\A{ODD}\z"), F.concat(F.lit('"'), x, F.lit('"')))


def simple(block: Column) -> Column:
    """A simple block as JSON; null for a block that is not."""

    def step(acc: Column, line: Column) -> Column:
        # keys so far, their values as JSON, and whether the last is a list that is being read
        item = F.startswith(line, F.lit("  - ")) & acc["open"]
        key = F.regexp_extract(line, rf"\A({KEY}):(?: |\z)", 1)
        value = scalar(line.substr(F.length(key) + 3, F.length(line)))
        bare = F.length(line) == F.length(key) + 1
        last = F.element_at(acc["values"], -1)
        more = F.concat(F.slice(acc["values"], 1, F.size(acc["values"]) - 1), F.array(F.concat(last, F.when(last == "", F.lit("[")).otherwise(F.lit(",")), scalar(line.substr(F.lit(5), F.length(line))))))
        good = F.when(item, F.element_at(more, -1).isNotNull()).otherwise((key != "") & ~key.rlike(rf"\A{ODD}\z") & ~F.array_contains(acc["keys"], key) & (bare | value.isNotNull()) & ~(acc["open"] & (last == "")))
        return F.struct(
            (acc["ok"] & F.coalesce(good, F.lit(False))).alias("ok"),
            F.when(item, acc["keys"]).otherwise(F.concat(acc["keys"], F.array(key))).alias("keys"),
            F.when(item, more).otherwise(F.concat(acc["values"], F.array(F.when(bare, F.lit("")).otherwise(value)))).alias("values"),
            (item | bare).alias("open"),
        )

    none = F.array().cast("array<string>")
    begin = F.struct(F.lit(True).alias("ok"), none.alias("keys"), none.alias("values"), F.lit(False).alias("open"))

    def told(acc: Column) -> Column:
        pair = lambda k, v: F.concat(F.lit('"'), k, F.lit('":'), v, F.when(F.startswith(v, F.lit("[")), F.lit("]")).otherwise(F.lit("")))
        whole = acc["ok"] & ~(acc["open"] & (F.element_at(acc["values"], -1) == ""))
        return F.when(whole, F.concat(F.lit("{"), F.array_join(F.zip_with(acc["keys"], acc["values"], pair), ","), F.lit("}")))

    return F.aggregate(F.split(block, "\n", -1), begin, step, told)


def plain(value: Any) -> Any:
    """What JSON can hold as it is; all else as a map that equals no condition's value."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    good = value is None or isinstance(value, (bool, int, str)) or isinstance(value, float) and value == value and abs(value) != float("inf")
    return value if good else {"": type(value).__name__}


def loaded(block: str | None) -> str | None:
    if block is None:
        return None
    try:
        data = yaml_load(block)
    except Exception:  # noqa: BLE001  bad frontmatter has no keys
        return None
    return json.dumps(plain(data), ensure_ascii=False) if isinstance(data, dict) else None


def yaml_json(block: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for blocks in batches:
            yield pa.array([loaded(x) for x in blocks.to_pylist()], pa.string())

    return run(block)


def stages(content: Column, native_only: bool = False) -> list[tuple[str, Column]]:
    """Columns to add one after the other; the last is the frontmatter, null where there is none or it is bad.

    native_only: a block that needs a YAML parser fails the job.
    """
    block = F.when(content.rlike(BLOCK), F.regexp_extract(content, BLOCK, 1))
    hard = F.col("_yaml").isNotNull() & F.col("_json").isNull()
    rest = F.when(hard, F.raise_error(F.concat(F.lit("frontmatter needs a YAML parser: "), F.col("_yaml"))).cast("string")) if native_only else yaml_json(F.when(hard, F.col("_yaml")))
    return [("_yaml", block), ("_json", simple(F.col("_yaml"))), ("_front", F.try_parse_json(F.coalesce("_json", rest)))]


STAGES = ("_yaml", "_json", "_front")


def path_of(key: str) -> str | None:
    """A nested key as a VARIANT path, null if it can't be written as one."""
    parts = key.split(".")
    return None if any("'" in p or "\\" in p or not p for p in parts) else "$" + "".join(f"['{p}']" for p in parts)


def supported(kind: str, value: Any) -> bool:
    """Whether a condition on frontmatter has a form as a column."""
    if kind == "frontmatterExists":
        return path_of(value) is not None
    wanted = value["value"]
    return path_of(value["key"]) is not None and (wanted is None or isinstance(wanted, (bool, str)) or isinstance(wanted, (int, float)) and abs(wanted) < 2**53)


def exists(key: str) -> Column:
    return F.coalesce(F.variant_get(F.col("_front"), path_of(key), "variant").isNotNull(), F.lit(False))


def equals(key: str, value: Any) -> Column:
    """Equality without coercion: true is not 1, and 1 is not "1"."""
    found = F.variant_get(F.col("_front"), path_of(key), "variant")
    kind = F.schema_of_variant(found)
    as_ = lambda t: F.try_variant_get(F.col("_front"), path_of(key), t)
    if value is None:
        same = F.is_variant_null(found)
    elif isinstance(value, bool):
        same = (kind == "BOOLEAN") & (as_("boolean") == value)
    elif isinstance(value, str):
        same = (kind == "STRING") & (as_("string") == value)
    else:
        same = kind.rlike(NUMBERS) & (as_("double") == float(value))
    return F.coalesce(same, F.lit(False))
