"""Detectors as a table function of SQL: ``SELECT ... FROM files f, LATERAL detect(f.path, f.language, f.content)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from weftgraph.detectors import catalogue, engine
from weftgraph.sources import structured

COLUMNS = "item string, seq bigint, id string, kind string, label string, fqn string, src string, dst string, line_start bigint, line_end bigint, confidence string, source string, props map<string,string>"


def _rows(nodes: list[dict], edges: list[dict]):
    for i, n in enumerate(nodes):
        yield "node", i, n["id"], n["kind"], n["label"], n["fqn"], None, None, n["line_start"], n["line_end"], n["confidence"], n["source"], n["props"]
    for i, e in enumerate(edges):
        yield "edge", i, e["id"], e["kind"], None, None, e["src"], e["dst"], None, None, e["confidence"], e["source"], e["props"]


@udtf(returnType=COLUMNS)
class Detect:
    """Every detector of the file's language; no rows for a file without text."""

    def eval(self, path: str, language: str, content: str):
        if path is not None and language is not None:
            yield from _rows(*engine.detect_text(path, language, content or ""))


@udtf(returnType=COLUMNS)
class DetectWith:
    """One detector by its name, whatever the file's language; an unknown name gives no rows."""

    def eval(self, name: str, path: str, language: str, content: str):
        found = catalogue.all_detectors().get(name)
        if found and path is not None:
            out = found.run(engine.File(path, language or "", content or "", structured.parse(language or "", content or "")))
            yield from _rows(out.nodes, out.edges)


def register(spark: SparkSession) -> None:
    """Make ``detect(path, language, content)`` and ``detect_with(name, path, language, content)`` known to the session's SQL."""
    spark.udtf.register("detect", Detect)
    spark.udtf.register("detect_with", DetectWith)


def detect_lateral(files: DataFrame, name: str | None = None) -> DataFrame:
    """(path, content_hash, and the function's columns) of every row that detectors, or the one called ``name``, find in ``files``."""
    spark = files.sparkSession
    register(spark)
    call = "detect(f.path, f.language, f.content)" if name is None else "detect_with(:name, f.path, f.language, f.content)"
    return spark.sql(f"SELECT f.path, f.content_hash, d.* FROM {{files}} f, LATERAL {call} d", args=None if name is None else {"name": name}, files=files)


def inspect(spark: SparkSession, name: str) -> DataFrame:
    """One row about a detector: category, languages, confidence, the kinds of nodes and edges that its rules name, and how many
    rules it has. A ValueError for an unknown name."""
    d = catalogue.all_detectors().get(name)
    if d is None:
        raise ValueError(f"unknown detector {name!r}")
    category = d.name.split(".")[0] if "." in d.name else d.languages[0]
    nodes, edges = sorted({r.kind for r in d.rules if r.kind}), sorted({e[0] for r in d.rules for e in r.edges})
    row = (d.name, category, ",".join(d.languages), d.confidence, "function" if d.function else "rules", len(d.rules), ",".join(nodes), ",".join(edges))
    return spark.createDataFrame([row], "name string, category string, languages string, default_confidence string, how string, n_rules int, node_kinds string, edge_kinds string")
