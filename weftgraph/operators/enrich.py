"""What nodes gain from their files: comments, config keys, services, and calls."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators import lexer
from weftgraph.operators.linkers import first_by, longest_prefix
from weftgraph.sources.files import EXCLUDED

# Kinds that can carry a comment, build files and their tools, tools that don't override others.
COMMENT_KINDS = ["class", "abstract_class", "interface", "enum", "annotation_type", "method", "module", "endpoint", "entity", "component", "service", "repository", "guard"]
BUILD_FILES = {
    "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "settings.gradle": "gradle", "settings.gradle.kts": "gradle", "build.xml": "ant", "build.sbt": "sbt", "project.clj": "leiningen", "package.json": "npm", "deno.json": "deno", "deno.jsonc": "deno", "go.mod": "go", "Cargo.toml": "cargo", "pyproject.toml": "python", "setup.py": "python", "setup.cfg": "python", "Pipfile": "python", "requirements.txt": "python", "manage.py": "django",
    "Gemfile": "ruby", "composer.json": "php", "Directory.Build.props": "dotnet", "Package.swift": "swift", "mix.exs": "elixir", "pubspec.yaml": "dart", "stack.yaml": "haskell", "build.zig": "zig", "dune-project": "ocaml", "DESCRIPTION": "r", "BUILD": "bazel", "BUILD.bazel": "bazel", "nx.json": "nx", "lerna.json": "lerna", "turbo.json": "turbo", "rush.json": "rush",
    "Dockerfile": "docker", "docker-compose.yml": "docker", "docker-compose.yaml": "docker", "compose.yml": "docker", "compose.yaml": "docker",
}
BUILD_SUFFIXES = {".csproj": "dotnet", ".fsproj": "dotnet", ".vbproj": "dotnet", ".gemspec": "ruby", ".cabal": "haskell", ".nimble": "nim"}
SUPPLEMENTAL = ["docker", "nx", "lerna", "turbo", "rush"]
PYTHON_ORDER = ["pyproject.toml", "setup.py", "requirements.txt", "manage.py"]


def with_config_keys(nodes: DataFrame) -> DataFrame:
    """Config nodes get their name as the property that text search reads."""
    key = F.when(F.col("fqn") != "", F.col("fqn")).otherwise(F.col("label"))
    is_config = F.col("kind").isin("config_key", "config_file", "config_definition")
    return nodes.withColumn("props", F.when(is_config, F.map_concat(F.map_filter("props", lambda k, _: k != "lex_config_keys"), F.create_map(F.lit("lex_config_keys"), key))).otherwise(F.col("props")))


def doc_comment(lines: list[str], language: str, line: int) -> str:
    """The comment that belongs to what begins at ``line`` (from 1): a docstring, or what stands above."""
    if not 1 <= line <= len(lines):
        return ""
    if language == "python":
        for i in range(line - 1, min(len(lines), line + 15)):
            if m := re.match(r"""\s*[rRuU]?(\"\"\"|''')(.*)$""", lines[i]):
                rest = "\n".join([m[2], *lines[i + 1 :]])
                return " ".join(rest.split(m[1], 1)[0].split()) if m[1] in rest else ""
        return ""
    at = line - 2
    if language in ("go", "rust"):
        found = []
        while at >= 0 and re.match(r"\s*//", lines[at]):
            found.append(re.sub(r"^\s*//[/!]?\s?", "", lines[at]))
            at -= 1
        return " ".join(" ".join(found[::-1]).split())
    while at >= 0 and (not lines[at].strip() or lines[at].lstrip().startswith("@")):
        at -= 1
    if at < 0 or not lines[at].rstrip().endswith("*/"):
        return ""
    end = at
    while at >= 0 and "/*" not in lines[at]:
        at -= 1
    text = "\n".join(lines[max(at, 0) : end + 1])
    return " ".join(re.sub(r"^\s*(?:/\*+|\*/|\*)\s?|\s*\*/\s*$", "", text, flags=re.M).split())


def with_comments(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes of kinds that can carry one get the comment of their place as a property."""

    @F.pandas_udf("string")
    def comment(content: pd.Series, language: pd.Series, line: pd.Series) -> pd.Series:
        return pd.Series([doc_comment((c or "").split("\n"), x or "", int(n)) for c, x, n in zip(content, language, line, strict=True)])

    asked = nodes.filter(F.col("kind").isin(COMMENT_KINDS) & (F.col("line_start") > 0)).select("id", "line_start", F.col("file_path").alias("path"))
    found = asked.join(files.select("path", "language", "content"), "path").select("id", comment("content", "language", "line_start").alias("comment")).filter("comment <> ''")
    found = found.groupBy("id").agg(F.min("comment").alias("comment"))
    rest = F.map_filter("props", lambda k, _: k != "lex_comment")
    return nodes.join(found, "id", "left").withColumn("props", F.when(F.col("comment").isNotNull(), F.map_concat(rest, F.create_map(F.lit("lex_comment"), F.col("comment")))).otherwise(F.col("props"))).select(*nodes.columns)


def _build_tool(path) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    tool = F.create_map(*(F.lit(x) for kv in BUILD_FILES.items() for x in kv))[name]
    for suffix, t in BUILD_SUFFIXES.items():
        tool = F.coalesce(tool, F.when(name.endswith(suffix), t))
    return tool


def service_name(tool: str, text: str) -> str:
    """What a build file calls its module; '' where it doesn't."""
    plain = re.sub(r"<parent>.*?</parent>|<dependenc.*?</dependenc\w+>", "", text, flags=re.S) if tool == "maven" else text
    patterns = {"maven": r"<artifactId>\s*([^<\s]+)", "npm": r'"name"\s*:\s*"([^"]+)"', "go": r"^module\s+(\S+)", "cargo": r'^name\s*=\s*"([^"]+)"', "python": r"""^\s*name\s*=\s*["']([^"']+)""", "gradle": r"""rootProject\.name\s*=\s*["']([^"']+)""", "php": r'"name"\s*:\s*"([^"]+)"', "dart": r"^name:\s*(\S+)", "elixir": r"app:\s*:(\w+)", "sbt": r'name\s*:=\s*"([^"]+)"'}
    m = re.search(patterns[tool], plain, re.M) if tool in patterns else None
    return m[1].rsplit("/", 1)[-1] if m else ""


def build_files(files: DataFrame) -> DataFrame:
    """(dir, file, build_tool, place, name): every build file, its place among those of its folder's tool, and what it names."""

    @F.pandas_udf("string")
    def named(tool: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([service_name(t, x or "") for t, x in zip(tool, text, strict=True)])

    place = F.coalesce(F.create_map(*(F.lit(x) for i, f in enumerate(PYTHON_ORDER) for x in (f, i)))[F.regexp_extract("path", r"([^/]*)$", 1)], F.lit(len(PYTHON_ORDER)))
    found = files.withColumn("build_tool", _build_tool(F.col("path"))).filter(F.col("build_tool").isNotNull() & ~F.exists(F.split("path", "/"), lambda x: x.isin(EXCLUDED)))
    return found.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.col("path").alias("file"), "build_tool", place.alias("place"), named("build_tool", "content").alias("name"))


def build_modules(builds: DataFrame, project: str = "root") -> DataFrame:
    """(dir, build_tool, service, service_id): of each folder's build files the one that names it."""
    first = first_by(builds, ["dir"], [F.col("build_tool").isin(SUPPLEMENTAL), F.col("place"), F.col("file")])
    folder = F.when(F.col("dir") == "", F.lit(project)).otherwise(F.element_at(F.split("dir", "/"), -1))
    named = first.withColumn("service", F.when(F.col("name") != "", F.col("name")).otherwise(folder))
    return named.select("dir", "build_tool", "service", F.concat(F.lit("service:"), F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), F.lit(":"), "service").alias("service_id"))


def no_build_file(spark: SparkSession, project: str = "root") -> DataFrame:
    """The one service of a tree without any build file, as ``build_modules`` gives them."""
    return build_modules(spark.createDataFrame([("", None, "unknown", len(PYTHON_ORDER), "")], "dir string, file string, build_tool string, place int, name string"), project)


def placed_nodes(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """``nodes`` with dir, build_tool, service and service_id of the deepest module above each; null where there is none."""
    path = F.coalesce("file_path", F.lit(""))
    return nodes.join(longest_prefix(nodes.select(path.alias("path")), modules.select("dir")), path == F.col("path"), "left").drop("path").join(modules, "dir", "left")


def service_nodes(modules: DataFrame) -> DataFrame:
    """A node for each of ``modules``, which have n_endpoints and n_entities too."""
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    made = {"id": F.col("service_id"), "kind": F.lit("service"), "label": F.col("service"), "fqn": F.lit(""), "file_path": F.col("dir"), "layer": F.lit("backend"), "confidence": F.lit("SYNTACTIC"), "source": F.lit("service_detector"), "annotations": F.array().cast("array<string>"), "props": F.create_map(F.lit("build_tool"), F.col("build_tool"), F.lit("endpoint_count"), text("n_endpoints"), F.lit("entity_count"), text("n_entities"))}
    return modules.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in M.NODES))


def service_edges(placed: DataFrame) -> DataFrame:
    return placed.filter("service_id IS NOT NULL").select(F.concat_ws("|", F.lit("service"), "service_id", "id").alias("id"), F.lit("contains").alias("kind"), F.col("service_id").alias("src"), F.col("id").alias("dst"), F.lit("SYNTACTIC").alias("confidence"), F.lit("service_detector").alias("source"), F.create_map().cast("map<string,string>").alias("props"))


def stamped(placed: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes with their service among the properties; where no module holds one its properties stay."""
    rest = F.map_filter("props", lambda k, _: k != "service")
    return placed.withColumn("props", F.when(F.col("service").isNotNull(), F.map_concat(rest, F.create_map(F.lit("service"), F.col("service")))).otherwise(F.col("props"))).select(*columns)


def detect_services(nodes: DataFrame, files: DataFrame, project: str = "root") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with their service among the properties, service nodes, contains edges): a service for each directory with a
    build file, every node in the deepest one above it; without any build file, one ``unknown`` service."""
    builds = build_files(files)
    modules = no_build_file(nodes.sparkSession, project) if builds.isEmpty() else build_modules(builds, project)
    placed = placed_nodes(nodes, modules)
    counts = placed.groupBy("service_id").agg(F.count_if(F.col("kind") == "endpoint").alias("n_endpoints"), F.count_if(F.col("kind") == "entity").alias("n_entities"))
    return stamped(placed, nodes.columns), service_nodes(modules.join(counts, "service_id", "left")), service_edges(placed)


#: Sorts of files, as detectors may mark them, that extractors leave out; from how many letters, and letters a line, a script is packed.
NOT_SOURCE, PACKED, PACKED_LINE = ["test", "generated", "minified", "binary", "text", "filtered"], 50_000, 1000


def source_files(files: DataFrame) -> DataFrame:
    """``files`` without scripts that are packed into a few long lines."""
    script = F.col("path").rlike(r"\.(?:[cm]?js|jsx|ts|css)$") & (F.length("content") >= PACKED)
    lines = F.greatest(F.lit(1), F.regexp_count("content", F.lit("\n")))
    return files.filter(~F.coalesce(script & (F.length("content") / lines > PACKED_LINE), F.lit(False)))


def source_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` that aren't marked as parts of tests or of generated files."""
    return nodes.filter(~F.coalesce(M.prop("file_type").isin(NOT_SOURCE), F.lit(False))) if "props" in nodes.columns else nodes


def call_sites(language: str, text: str) -> list[tuple[str, int, str]]:
    """(method, its line, name called) within a file: python by its syntax tree, other languages by their tokens."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        out = []
        for f in ast.walk(tree):
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                for c in ast.walk(f):
                    if isinstance(c, ast.Call) and (name := getattr(c.func, "attr", None) or getattr(c.func, "id", None)):
                        out.append((f.name, f.lineno, name))
        return out
    return lexer.calls(language, text) if language in lexer.TOKENS else []


def extract_calls(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, name, path) of call sites: the method nodes of a file and the names they call."""

    def run(batches):
        for pdf in batches:
            rows = [(p, m, n) for p, x, t in zip(pdf["path"], pdf["language"], pdf["content"], strict=True) for m, _, n in call_sites(x, t or "")]
            yield pd.DataFrame(sorted(set(rows)), columns=["file_path", "label", "name"])

    sites = source_files(files).select("path", "language", "content").mapInPandas(run, "file_path string, label string, name string")
    return sites.join(source_nodes(nodes).filter("kind = 'method'").select("file_path", "label", F.col("id").alias("src")), ["file_path", "label"]).select("src", "name", F.col("file_path").alias("path"))


def type_relations(language: str, text: str) -> list[tuple[str, str, str]]:
    """(type, extends_type or implements_types, names)."""
    if language == "python":
        return [(m[1], "extends_type", m[2].strip()) for m in re.finditer(r"^\s*class\s+(\w+)\(([^)]*)\)", text, re.M) if m[2].strip()]
    return lexer.type_relations(language, text) if language in lexer.TOKENS else []


def exports(language: str, text: str) -> list[tuple[str, str]]:
    """(property, names) of what a file as a module exports: Python's list of names, TypeScript's declarations."""
    if language == "python":
        m = re.search(r"^__all__\s*=\s*[\[(]([^\])]*)[\])]", text, re.M)
        names = [x for x in (p.strip().strip("\"'`") for p in re.sub(r"#[^\n]*", "", m[1]).split(",")) if x] if m else []
        return [("all_exports", ", ".join(names))] if names else []
    found = lexer.module_exports(text) if language == "typescript" else []
    return [("module_exports", ", ".join(found))] if found else []


def extract_exports(files: DataFrame) -> DataFrame:
    """(file_path, relation, names) of the files that export something."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, x, t in zip(pdf["path"], pdf["language"], pdf["content"], strict=True) for r in exports(x, t or "")]
            yield pd.DataFrame(rows, columns=["file_path", "relation", "names"])

    return source_files(files).select("path", "language", "content").mapInPandas(run, "file_path string, relation string, names string")


def extract_types(files: DataFrame) -> DataFrame:
    """(file_path, label, relation, names) of the types that files declare over others."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, x, t in zip(pdf["path"], pdf["language"], pdf["content"], strict=True) for r in type_relations(x, t or "")]
            yield pd.DataFrame(sorted(set(rows)), columns=["file_path", "label", "relation", "names"])

    return source_files(files).select("path", "language", "content").mapInPandas(run, "file_path string, label string, relation string, names string")


def with_types(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``nodes`` whose types have the properties extends_type and implements_types, and whose modules have what their files export;
    a property that is there already stays."""
    types, own = extract_types(files), extract_exports(files)
    found = types.select("file_path", F.concat(F.lit("type:"), "label").alias("_key"), "relation", "names").unionByName(own.select("file_path", F.lit("module").alias("_key"), "relation", "names"))
    found = found.groupBy("file_path", "_key").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("relation", "names")))).alias("_types"))
    key = F.when(F.col("kind") == "module", F.lit("module")).when(F.col("kind").isin("class", "abstract_class", "interface", "entity"), F.concat(F.lit("type:"), "label"))
    key = F.when(~F.coalesce(M.prop("file_type").isin(NOT_SOURCE), F.lit(False)), key)
    met = nodes.withColumn("_key", key).join(found, ["file_path", "_key"], "left")
    missing = F.map_filter(F.col("_types"), lambda k, _: ~F.map_contains_key(F.col("props"), k))
    return met.withColumn("props", F.when(F.col("_types").isNotNull(), F.map_concat("props", missing)).otherwise(F.col("props"))).select(*nodes.columns)
