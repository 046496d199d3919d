"""Source files as rows: discovery, languages, hashes, manifests, change detection and the staged cache."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders left out, and the language of each extension.
EXCLUDED = "node_modules build target dist out bin obj .git .svn .idea .vscode .eclipse .settings __pycache__ venv .venv .tox .mypy_cache .pytest_cache .eggs .gradle .mvn bower_components .next .nuxt coverage .nyc_output .parcel-cache .turbo .cache vendor .weftgraph".split()
LANGUAGES = {
    "java": "java", "py": "python", "pyw": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "go": "go", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "ini": "ini", "cfg": "ini", "properties": "properties", "sql": "sql", "bat": "batch", "cmd": "batch", "vue": "vue", "svelte": "svelte", "cs": "csharp", "kt": "kotlin", "kts": "kotlin",
    "scala": "scala", "sc": "scala", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "h": "cpp", "rs": "rust", "tf": "terraform", "tfvars": "terraform", "bicep": "bicep", "proto": "proto", "xml": "xml", "md": "markdown", "markdown": "markdown", "ps1": "powershell", "psm1": "powershell", "psd1": "powershell", "sh": "bash", "bash": "bash", "zsh": "bash", "rb": "ruby", "groovy": "groovy", "gradle": "groovy",
}
#: A name without extension that is a language of its own.
NAMES = {"Dockerfile": "dockerfile"}


def language(path: Column) -> Column:
    """The language of a path, or null for one that isn't analysed."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    names = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    return F.coalesce(names[F.regexp_extract(path, r"([^/]*)$", 1)], table[F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))])


def kept(path: Column) -> Column:
    """Whether no folder of the path is left out."""
    return ~F.exists(F.split(path, "/"), lambda x: x.isin(EXCLUDED))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def listed_by_git(root: str) -> list[str] | None:
    """Tracked and untracked, not ignored files of a working tree on the driver's machine; None where git can't tell."""
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, timeout=60, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return sorted({x for x in done.stdout.decode(errors="replace").split("\0") if x}) or None


def read_files(spark: SparkSession, root: str, use_git: bool = True) -> DataFrame:
    """(path, language, content, content_hash) of the analysed files below ``root``, paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    files = raw.select(F.element_at(F.split("path", base, 2), -1).alias("path"), "content")
    files = files.withColumn("language", language(F.col("path"))).filter(kept(F.col("path")) & F.col("language").isNotNull())
    names = listed_by_git(root) if use_git and os.path.isdir(root) else None
    if names is not None:
        files = files.join(spark.createDataFrame([(x,) for x in names], "path string"), "path", "left_semi")
    return files.select("path", "language", F.col("content").try_cast("string").alias("content"), content_hash(F.col("content")).alias("content_hash"))


def manifest_hash(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over path, NUL, hash, NUL of all files in order of paths. As long as the list of files is."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "content_hash"))), lambda x: F.concat(x["path"], F.lit("\0"), x["content_hash"], F.lit("\0")))
    return files.agg(F.sha2(F.array_join(parts, ""), 256).alias("manifest"))


#: Files that one branch of a manifest holds, about.
BRANCH_FILES = 4096


def manifest_branches(files: DataFrame, branches: int) -> DataFrame:
    """(branch, hash, n): SHA-256 over path, NUL, hash, NUL of each branch's files in order of paths, a path's branch being told by
    its own hash. With as many branches as there are some thousand files no row holds many of them."""
    dealt = files.select(F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(branches)).cast("int").alias("branch"), "path", "content_hash")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "content_hash"))), lambda x: F.concat(x["path"], F.lit("\0"), x["content_hash"], F.lit("\0")))
    return dealt.groupBy("branch").agg(F.sha2(F.array_join(parts, ""), 256).alias("hash"), F.count(F.lit(1)).alias("n"))


def branches_for(n: int) -> int:
    """A power of two that leaves some ``BRANCH_FILES`` files to a branch."""
    return 1 << max(0, (n - 1) // BRANCH_FILES).bit_length()


def manifest_tree(files: DataFrame) -> DataFrame:
    """One row, as ``manifest_hash`` gives it for up to ``BRANCH_FILES`` files; of more, the hash of their branches' hashes."""
    n = files.count()
    if n <= BRANCH_FILES:
        return manifest_hash(files)
    tree = manifest_branches(files, branches_for(n))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("branch", "hash"))), lambda x: F.concat(x["branch"].cast("string"), F.lit("\0"), x["hash"], F.lit("\0")))
    return tree.agg(F.sha2(F.array_join(parts, ""), 256).alias("manifest"))


def manifest_flat(files: DataFrame) -> DataFrame:
    """One row: the manifest where it is one branch, as ``manifest_hash`` and ``manifest_tree`` both give it; null where it has more."""
    n = files.count()
    return manifest_hash(files) if n <= BRANCH_FILES else files.sparkSession.createDataFrame([(None,)], "manifest string")


def changed_branches(before: DataFrame, now: DataFrame) -> DataFrame:
    """(branch) of two manifests' branches whose hashes differ."""
    a, b = before.select("branch", F.col("hash").alias("old")), now.select("branch", F.col("hash").alias("new"))
    return a.join(b, "branch", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))).select("branch")


def diff_branches(before: DataFrame, now: DataFrame, branches: int) -> DataFrame:
    """As ``diff``, of the files that aren't unchanged; files are joined in branches whose hashes differ alone."""
    moved = changed_branches(manifest_branches(before, branches), manifest_branches(now, branches))
    inside = lambda d: d.withColumn("branch", F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(branches)).cast("int")).join(F.broadcast(moved), "branch", "left_semi").select("path", "content_hash")
    return diff(inside(before), inside(now)).filter("status <> 'unchanged'")


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status) of two manifests (path, content_hash): added, modified, deleted or unchanged."""
    a, b = before.select("path", F.col("content_hash").alias("old")), now.select("path", F.col("content_hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


class Cache:
    """Detector output by file: three Parquet tables, keyed by (path, content_hash). Every change writes a new version."""

    TABLES = ("files", "raw_nodes", "raw_edges")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str, version: int) -> str:
        return f"{self.root}/v{version}/{table}"

    def _versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.root)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(p.getPath().getName()[1:]) for p in fs.listStatus(folder) if p.getPath().getName()[1:].isdigit() and fs.exists(hadoop.Path(p.getPath(), "raw_edges/_SUCCESS")))

    def version(self) -> int:
        """How many changes the cache has seen; 0 before the first."""
        return (self._versions() or [0])[-1]

    def stats(self) -> dict[str, int]:
        """Numbers of files, nodes and edges, and the version."""
        rows = [self.read(t) for t in self.TABLES]
        return dict(zip(("files", "nodes", "edges"), (0 if r is None else r.count() for r in rows), strict=True)) | {"version": self.version()}

    def read(self, table: str) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(self._path(table, versions[-1])) if versions else None

    def put(self, files: DataFrame, raw_nodes: DataFrame, raw_edges: DataFrame) -> None:
        """Replace what is known of the paths of ``files``; all three tables have path and content_hash."""
        versions = self._versions()
        for name, rows in zip(self.TABLES, (files, raw_nodes, raw_edges), strict=True):
            old = self.spark.read.parquet(self._path(name, versions[-1])).join(files.select("path"), "path", "left_anti") if versions else None
            (rows if old is None else old.unionByName(rows)).write.parquet(self._path(name, (versions or [0])[-1] + 1))

    def purge(self, paths: DataFrame) -> None:
        versions = self._versions()
        for name in self.TABLES if versions else ():
            self.spark.read.parquet(self._path(name, versions[-1])).join(paths.select("path"), "path", "left_anti").write.parquet(self._path(name, versions[-1] + 1))

    def clear(self) -> int:
        """Forget everything; how many files there were."""
        files = self.read("files")
        n = 0 if files is None else files.count()
        if n:
            self.purge(files)
        return n


def cache_scan(rows: DataFrame) -> DataFrame:
    """Arrival order for merging."""
    return rows.orderBy("path", "content_hash", "seq")


def cache_stats(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda d, x: d.agg(F.count(F.lit(1)).alias(x))
    return one(files, "files").crossJoin(one(nodes, "nodes")).crossJoin(one(edges, "edges"))


def cache_list(files: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """Each file with the numbers of its nodes and edges, in order of paths; a limit of 0 lists all."""
    per = lambda d, x: d.groupBy("path", "content_hash").agg(F.count(F.lit(1)).alias(x))
    keys = ["path", "content_hash"]
    out = files.select("path", "content_hash", "language").join(per(nodes, "n_nodes"), keys, "left").join(per(edges, "n_edges"), keys, "left").fillna(0, ["n_nodes", "n_edges"]).orderBy(*keys)
    return out.offset(max(0, offset)).limit(limit) if limit > 0 else out


def cache_get(files: DataFrame, content_hash: str) -> DataFrame:
    """The cached files of a content hash, in order of paths; no rows where the cache lacks it."""
    return files.filter(F.col("content_hash") == content_hash).orderBy("path")


def cache_has(files: DataFrame, content_hash: str) -> bool:
    return not cache_get(files, content_hash).isEmpty()


def cache_lookup(files: DataFrame, query: str) -> DataFrame:
    """The file of this hash, else of this path, else the first whose path ends so."""
    rank = F.when(F.col("content_hash") == query, 0).when(F.col("path") == query, 1).when(F.col("path").endswith(query), 2)
    return files.withColumn("rank", rank).filter("rank IS NOT NULL").orderBy("rank", "path").limit(1).drop("rank")
