"""``git diff`` as a data source: ``spark.read.format("git_diff").option("repo", ...).option("base", ...).option("head", ...)``.

The driver lists the changed files of the range; each is a partition, whose task asks git for that file's hunks. So the repository
must lie in a folder that executors share. Without ``head`` the working tree is compared with ``base``, without both with the index.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, old_path string, status string, added bigint, removed bigint, hunks string"
_STATUS = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "C": "copied", "T": "modified"}


def _git(repo: str, *args: str) -> bytes:
    try:
        return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True, timeout=600).stdout
    except subprocess.CalledProcessError as e:
        raise ValueError(f"git {' '.join(args)}: {e.stderr.decode(errors='replace').strip()}") from None


def _range(options: dict) -> list[str]:
    base, head = options.get("base", ""), options.get("head", "")
    if any(x.startswith("-") for x in (base, head)):
        raise ValueError("a revision can't begin with a dash")
    return [f"{base}..{head}"] if base and head else [base] if base else []


@dataclass
class ChangedFile(InputPartition):
    path: str
    old_path: str
    status: str


def changed_files(options: dict) -> list[ChangedFile]:
    """The files that the range changes, in order of paths."""
    parts = [x.decode(errors="replace") for x in _git(options["repo"], "diff", "--name-status", "-z", "-M", *_range(options), "--").split(b"\0")]
    out, i = [], 0
    while i < len(parts) and parts[i]:
        two = parts[i][0] in "RC"
        out.append(ChangedFile(parts[i + 2] if two else parts[i + 1], parts[i + 1], _STATUS.get(parts[i][0], "modified")))
        i += 3 if two else 2
    return sorted(out, key=lambda f: f.path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[ChangedFile]:
        return changed_files(self.options)

    def read(self, partition: ChangedFile) -> Iterator[tuple]:
        if partition is None:
            return
        paths = sorted({partition.old_path, partition.path})
        text = _git(self.options["repo"], "diff", "--unified=3", "-M", *_range(self.options), "--", *paths).decode(errors="replace")
        lines = text.split("\n")
        at = next((i for i, x in enumerate(lines) if x.startswith("@@")), len(lines))
        hunks = "\n".join(lines[at:])
        body = [x for x in lines[at:] if not x.startswith("@@")]
        yield partition.path, partition.old_path, partition.status, sum(x.startswith("+") for x in body), sum(x.startswith("-") for x in body), hunks


class GitDiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_diff(spark: SparkSession, repo: str, base: str = "", head: str = "") -> DataFrame:
    """A row for each file that the range changes. A ValueError where git can't tell them."""
    changed_files({"repo": repo, "base": base, "head": head})  # a wrong range shows here, not in a task
    spark.dataSource.register(GitDiff)
    reader = spark.read.format("git_diff").option("repo", repo)
    for name, value in (("base", base), ("head", head)):
        reader = reader.option(name, value) if value else reader
    return reader.load()
