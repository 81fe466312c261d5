"""Golden suites of programs: cases of input, patches and expected text, run as one build over a corpus of cases."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.codecs import yaml_load
from textloom.plans.build import fold
from textloom.plans.planner import inherited, own
from textloom.plans.spec import Invalid, Problem, patch_problems
from textloom.plans.stores import unified


def read(text: str) -> list[dict]:
    """Cases of a YAML suite: unique name, input, patches and expected."""
    data: Any = yaml_load(text)
    cases = data.get("tests") if isinstance(data, dict) else None
    if not isinstance(cases, list) or not cases:
        raise Invalid([Problem("tests", "must be a list with cases")])
    found, seen = [], set()
    for k, case in enumerate(cases):
        at = f"tests[{k}]"
        found += [Problem(f"{at}.{key}", "missing") for key in ("name", "input", "patches", "expected") if not isinstance(case, dict) or key not in case]
        if found:
            continue
        if case["name"] in seen:
            found.append(Problem(f"{at}.name", f"{case['name']!r} is taken"))
        seen.add(case["name"])
        found += [p for n, patch in enumerate(case["patches"]) for p in patch_problems(patch, f"{at}.patches[{n}]")]
    if found:
        raise Invalid(found)
    return cases


def run(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """name, passed, applied, actual, diff of every case; texts must be equal exactly."""
    rows = [(c["name"], c["input"], json.dumps(c["patches"]), c["expected"]) for c in cases]
    return run_table(spark.createDataFrame(rows, "name string, input string, patches string, expected string"))


def run_table(cases: DataFrame) -> DataFrame:
    """The same for a table of cases (name, input, patches as JSON, expected), however many there are."""

    @F.arrow_udf("struct<passed:boolean,applied:int,actual:string,diff:string>")
    def one(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for text, patches, expected in zip(*(c.to_pylist() for c in batch), strict=True):
                actual, applied, *_ = fold(text, "", list(enumerate(map(own, inherited(json.loads(patches))))), "warn")
                done.append((actual == expected, applied, actual, "" if actual == expected else unified(expected, actual, "expected")))
            kinds = (("passed", pa.bool_()), ("applied", pa.int32()), ("actual", pa.string()), ("diff", pa.string()))
            yield pa.StructArray.from_arrays([pa.array([d[k] for d in done], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    return cases.withColumn("r", one("input", "patches", "expected")).select("name", "r.*")
