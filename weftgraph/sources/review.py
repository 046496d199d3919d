"""Reading a repository's files and diffs for review: rows of files and hunks, and the text a reviewer gets."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.settle import merged, paired, settled

MAX_FILES, MAX_BYTES = 30, 256 * 1024
_TEXT = re.compile(r"\.(?:java|pyw?|[cm]?[jt]sx?|go|ya?ml|json|toml|ini|cfg|properties|sql|bat|cmd|vue|svelte|cs|kts?|scala|sc|cpp|cc|cxx|h|hpp|rs|tf|tfvars|bicep|proto|xml|md|markdown|ps1|sh|bash|zsh|rb|groovy|gradle|txt|html?|s?css)$|(?:^|/)(?:Dockerfile|Makefile|LICENSE|README)$", re.I)


def read_repo_file(root: str, path: str, first: int = 1, last: int | None = None, most: int = MAX_BYTES) -> str:
    """Lines of a text file below ``root``. A ValueError for an absolute path, one that leaves ``root``, or another kind of file."""
    if os.path.isabs(path) or not _TEXT.search(path):
        raise ValueError(f"not a text file of this repository: {path}")
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([base, full]) != base:
        raise ValueError(f"outside the repository: {path}")
    with open(full, "rb") as f:
        text = f.read(most).decode(errors="replace")
    return "\n".join(text.split("\n")[max(1, first) - 1 : last])


def parse_diff(text: str) -> list[dict]:
    """Files of a unified diff: path, status, lines added and removed, and the hunks' text."""
    out: list[dict] = []
    for line in text.splitlines():
        if m := re.match(r"diff --git a/(.*) b/(.*)$", line):
            out.append({"path": m[2], "status": "modified", "added": 0, "removed": 0, "hunks": ""})
        elif not out:
            continue
        elif line.startswith("new file"):
            out[-1]["status"] = "added"
        elif line.startswith("deleted file"):
            out[-1]["status"] = "deleted"
        elif line.startswith("rename to "):
            out[-1]["status"] = "renamed"
        elif line.startswith("@@") or out[-1]["hunks"]:
            out[-1]["hunks"] += line + "\n"
            out[-1]["added"] += line.startswith("+")
            out[-1]["removed"] += line.startswith("-")
    return out


def diff_rows(diffs: DataFrame) -> DataFrame:
    """One row for each file of each diff text (diff_id, text)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([{"diff_id": i, **f} for i, t in zip(pdf["diff_id"], pdf["text"], strict=True) for f in parse_diff(t or "")], columns=["diff_id", "path", "status", "added", "removed", "hunks"])

    return diffs.select("diff_id", "text").mapInPandas(run, "diff_id long, path string, status string, added long, removed long, hunks string")


def focused(files: DataFrame, focus: list[str]) -> DataFrame:
    """The files asked for; all where none are."""
    return files.filter(F.col("path").isin(focus)) if focus else files


def evidence_of_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame, most_nodes: int = 25, most_upstream: int = 15) -> DataFrame:
    """(path, text) for each of ``paths`` (path): its first nodes, and the first that point to them, as lines of text; of all at once."""
    line = lambda mark: F.concat(F.lit(mark), F.col("kind"), F.lit(" "), F.col("label"), F.lit(" ("), F.col("id"), F.lit(")"))
    first = lambda d, n: d.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("id"))).filter(F.col("place") <= n)
    asked = paired(settled(paths.select(F.col("path").alias("file_path")).distinct()))
    own = settled(first(nodes.select("id", "kind", "label", "file_path").join(asked, "file_path").withColumnRenamed("file_path", "path"), most_nodes))
    hit = edges.select("src", "dst").join(paired(own.select("path", F.col("id").alias("dst"))), "dst").select("path", F.col("src").alias("id")).distinct()
    up = first(merged(nodes.select("id", "kind", "label")).join(hit, "id"), most_upstream)
    rows = own.select("path", F.lit(0).alias("part"), "place", line("- ").alias("line")).unionByName(up.select("path", F.lit(1).alias("part"), "place", line("< ").alias("line")))
    return rows.groupBy("path").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "line"))), lambda r: r["line"])).alias("text"))  # some lines a file


def review_changes(nodes: DataFrame, edges: DataFrame, diff: DataFrame, focus: list[str] | None = None, most: int = MAX_FILES) -> DataFrame:
    """One row of text for a reviewer: the changed files of ``diff`` (path, status, added, removed, hunks) with what the graph knows."""
    files = focused(diff, focus or []).orderBy("path").limit(most)
    return review_prompt(files, evidence_of_files(nodes, edges, files.select("path")), None, most)


def review_prompt(files: DataFrame, evidence: DataFrame, focus: list[str] | None = None, most: int = MAX_FILES) -> DataFrame:
    """One row of text: up to ``most`` files in order, each with its evidence (path, text) and hunks."""
    picked = focused(files, focus or []).orderBy("path").limit(most).join(evidence.select("path", F.col("text").alias("evidence")), "path", "left")
    part = F.concat(F.lit("## "), "path", F.lit(" ("), "status", F.lit(", +"), F.col("added").cast("string"), F.lit(" -"), F.col("removed").cast("string"), F.lit(")\n"), F.coalesce(F.concat("evidence", F.lit("\n")), F.lit("")), "hunks")
    return picked.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("path", part.alias("part")))), lambda x: x["part"])).alias("prompt"))
