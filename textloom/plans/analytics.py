"""What patches do to a corpus, from paths alone: coverage, impact, complexity, safety, lint, conflicts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.patterns import glob_regex
from textloom.plans.planner import as_list
from textloom.plans.spec import as_json, id_of

#: Risk scores and levels of operators; every other operator is medium, 5.
RISK = {
    "delete-file": 10, "replace-regex": 9, "remove-section": 8, "remove-frontmatter": 8, "remove-table-row": 8, "remove-table-column": 8,
    "rename-file": 6, "move-file": 6, "delete-between": 6, "replace": 5, "replace-section": 5, "replace-between": 5, "replace-line": 5,
    "rename-header": 5, "move-section": 5, "change-section-level": 5, "rename-frontmatter": 5, "merge-frontmatter": 5, "replace-table-cell": 5,
    "copy-file": 3, "set-frontmatter": 2, "append-to-section": 1, "prepend-to-section": 1, "insert-after-line": 1, "insert-before-line": 1,
    "add-table-row": 1, "add-table-column": 1,
}
HIGH, LOW = 8, 3
#: Weights of a dry run.
DRY_RISK = {"delete-file": 50, "remove-section": 30, "delete-between": 30, "move-file": 25, "rename-file": 25, "replace-section": 20, "replace-between": 20, "move-section": 15, "change-section-level": 15, "remove-frontmatter": 12, "remove-table-row": 12, "remove-table-column": 12}


def level(score: int) -> str:
    return "high" if score >= HIGH else "low" if score <= LOW else "medium"


def patch_table(spark: SparkSession, patches: list[dict]) -> DataFrame:
    """ord, op, id, group, include and exclude patterns, risk, spec: one row a patch, so a program's size bounds it."""
    rows = []
    for k, p in enumerate(patches):
        score = RISK.get(p["op"], 5)
        spec = {x: v for x, v in p.items() if x not in ("include", "exclude")}
        rows.append((k, p["op"], id_of(p), p.get("group"), [glob_regex(g) for g in as_list(p.get("include"))], [glob_regex(g) for g in as_list(p.get("exclude"))], score, level(score), as_json(spec)))
    return spark.createDataFrame(rows, "ord int, op string, id string, grp string, include array<string>, exclude array<string>, risk int, risk_level string, spec string")


#: Patches that are broadcast; a longer program meets paths as Spark plans it.
FEW = 10_000


def small(patches: DataFrame) -> DataFrame:
    """A table of patches, marked for broadcast if it is short."""
    return F.broadcast(patches) if len(patches.take(FEW + 1)) <= FEW else patches


def edges(files: DataFrame, patches: DataFrame) -> DataFrame:
    """path, ord, op, risk, risk_level, spec: which patches admit which documents.

    The one theta join of the engine: every path is tested against every patch's globs, the patches broadcast up to FEW.
    Their number is a program's length, not the corpus's.
    """
    hit = ((F.size("include") == 0) | F.exists("include", lambda g: F.rlike("path", g))) & ~F.exists("exclude", lambda g: F.rlike("path", g))
    return files.select("path").join(small(patches), hit).select("path", "ord", "op", "risk", "risk_level", "spec")


def coverage(files: DataFrame, edge: DataFrame) -> DataFrame:
    """total, patched, unpatched, percent."""
    patched = edge.select("path").distinct().withColumn("hit", F.lit(1))
    out = files.select("path").join(patched, "path", "left").agg(F.count("*").alias("total"), F.count("hit").alias("patched"))
    return out.select("total", "patched", (F.col("total") - F.col("patched")).alias("unpatched"), F.when(F.col("total") > 0, F.col("patched") / F.col("total") * 100).otherwise(0.0).alias("percent"))


def unpatched(files: DataFrame, edge: DataFrame) -> DataFrame:
    return files.select("path").join(edge.select("path"), "path", "left_anti")


def impact(edge: DataFrame, listed: int = 0) -> DataFrame:
    """ord, op, files: how many documents a patch admits; with `listed`, also paths, the first so many of them in order.

    Tasks pass on no more than that many paths of a patch; all of them are the rows of `edges`.
    """
    out = edge.groupBy("ord", "op").agg(F.count("*").alias("files"))
    if not listed:
        return out
    place = F.row_number().over(Window.partitionBy("ord").orderBy("path"))
    first = edge.select("ord", "path", place.alias("_n")).filter(F.col("_n") <= listed).groupBy("ord").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return out.join(first, "ord")


def shared_files(edge: DataFrame) -> DataFrame:
    """path, patches: documents with more than one patch."""
    return edge.groupBy("path").agg(F.count("*").alias("patches")).filter("patches > 1")


def complexity(edge: DataFrame) -> DataFrame:
    """path, patches, ops, high_risk, score."""
    out = edge.groupBy("path").agg(F.count("*").alias("patches"), F.countDistinct("op").alias("ops"), F.sum((F.col("risk_level") == "high").cast("long")).alias("high_risk"))
    return out.withColumn("score", F.col("patches") * 2 + F.col("ops") * 1.5 + F.col("high_risk") * 3)


def most_complex(edge: DataFrame, n: int = 10) -> DataFrame:
    return complexity(edge).orderBy(F.desc("score"), "path").limit(n)


def safety(patches: DataFrame) -> DataFrame:
    """Numbers of patches by risk and their mean score."""
    count = lambda x: F.sum((F.col("risk_level") == x).cast("long")).alias(x)
    return patches.agg(F.count("*").alias("patches"), count("high"), count("medium"), count("low"), F.avg("risk").alias("mean_risk"))


def unreachable(patches: DataFrame, edge: DataFrame) -> DataFrame:
    """Patches that admit no document."""
    return patches.select("ord", "op").join(edge.select("ord"), "ord", "left_anti")


def pairs_in_common(edge: DataFrame) -> DataFrame:
    """a, b, files: patches a before b that share documents. Pairs are of patches: their number is the program's alone."""
    each = edge.groupBy("path").agg(F.array_sort(F.collect_set("ord")).alias("ords"))
    each = each.groupBy("ords").agg(F.count("*").alias("files"))  # documents with the same patches count at once
    a = each.select("files", "ords", F.explode("ords").alias("a"))
    return a.select("files", "a", F.explode(F.filter("ords", lambda b: b > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.sum("files").alias("files"))


def redundant(patches: DataFrame, edge: DataFrame) -> DataFrame:
    """a, b, files: later patches equal to an earlier one on the same documents."""
    p, q = patches.select(F.col("ord").alias("a"), F.col("spec").alias("x")), patches.select(F.col("ord").alias("b"), F.col("spec").alias("y"))
    return pairs_in_common(edge).join(small(p), "a").join(small(q), "b").filter(F.col("x") == F.col("y")).select("a", "b", "files")


def target(spec: Column) -> Column:
    """What a patch works on: its section, key, file, table, list or text."""
    return F.coalesce(*(F.get_json_object(spec, f"$.{k}") for k in ("id", "key", "table", "list", "old", "match", "path", "pattern")))


def overlapping(patches: DataFrame, edge: DataFrame) -> DataFrame:
    """a, b, files: patches with one target on the same documents."""
    p = patches.select(F.col("ord").alias("a"), target(F.col("spec")).alias("x"))
    q = patches.select(F.col("ord").alias("b"), target(F.col("spec")).alias("y"))
    return pairs_in_common(edge).join(small(p), "a").join(small(q), "b").filter(F.col("x") == F.col("y")).select("a", "b", "files")


def regex_complexity(pattern: str) -> int:
    """Weighted counts of a pattern's constructs, at most 100."""
    weights = {r"\(\?[=!<]": 10, r"\\[1-9]": 8, r"[*+]": 3, r"\{\d+,?\d*\}": 3, r"\|": 2, r"\(": 2, r"\[": 2, r"\?": 1}
    return min(100, len(pattern) // 10 + sum(w * len(re.findall(rx, pattern)) for rx, w in weights.items()))


def dry_run(patches: list[dict]) -> dict:
    """Mean risk and complexity of a program before it runs, and its conflicts."""
    risks, costs = [], []
    for p in patches:
        risk = 15 if p["op"] == "replace-regex" and "g" in p.get("flags", "") else 10 if p["op"] == "replace-regex" else DRY_RISK.get(p["op"], 5)
        risk += 3 * ("validate" not in p) + 10 * (p["op"] in ("delete-file", "remove-section") and "when" not in p)
        risks.append(risk)
        costs.append((15 + regex_complexity(p["pattern"]) if p["op"] == "replace-regex" else 10) + 5 * ("when" in p) + 5 * ("include" in p or "exclude" in p))
    mean = lambda x: sum(x) / len(x) if x else 0.0
    risk = mean(risks)
    return {"risk": risk, "risk_level": "high" if risk >= 30 else "medium" if risk >= 15 else "low", "complexity": min(100.0, mean(costs) * 1.5), "conflicts": conflicts(patches)}


def conflicts(patches: list[dict]) -> list[tuple[int, int, str, str]]:
    """Earlier patch, later patch, kind and severity."""
    out = []
    strong = ("remove-section", "replace-section", "move-section")
    for i, a in enumerate(patches):
        for j, b in enumerate(patches[i + 1 :], i + 1):
            same = lambda k: k in a and a.get(k) == b.get(k)  # noqa: B023, E731
            if same("id") and "section" in a["op"] + b["op"] and (a["op"] in strong or b["op"] in strong):
                out.append((i, j, "section", "high"))
            elif same("key") and a["op"].endswith("frontmatter") and b["op"].endswith("frontmatter"):
                out.append((i, j, "frontmatter", "medium"))
            elif a["op"] == "delete-file" and b["op"] == "copy-file" and a["match"] == b["src"]:
                out.append((i, j, "file", "high"))
            elif same("table") and "table" in a["op"] and "table" in b["op"]:
                out.append((i, j, "table", "medium"))
            elif a["op"] == b["op"] == "replace-regex":
                out.append((i, j, "regex", "medium"))
    return out


def lint(patches: list[dict]) -> list[tuple[int, str, str]]:
    """Patch, severity and message of what looks wrong without a corpus."""
    out = []
    for k, p in enumerate(patches):
        if p["op"] in ("delete-file", "remove-section", "delete-between") and "when" not in p and "include" not in p:
            out.append((k, "warning", "destructive and unguarded"))
        if p["op"] == "replace" and p["old"] == p["new"]:
            out.append((k, "warning", "replaces text by itself"))
        if "pattern" in p and regex_complexity(str(p["pattern"])) >= 50:
            out.append((k, "info", "complex pattern"))
        if any(g in ("**", "**/*") for g in as_list(p.get("include"))):
            out.append((k, "info", "glob admits everything"))
    return out


def explain(edge: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """path, lineage: the patches that a document meets, in order.

    chains: path and chain, the configurations through which documents came (see sources.files.overlay). With it every
    document has a row, with its chain and how many configurations are in it; one that no patch admits has an empty lineage.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "op")))
    if chains is not None:
        return chains.select("path", "chain").join(explain(edge), "path", "left").select("path", "chain", F.size("chain").alias("depth"), F.coalesce("lineage", F.lit("")).alias("lineage"))
    return edge.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["ord"].cast("string"), x["op"])), ",").alias("lineage"))
