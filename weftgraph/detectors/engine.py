"""Detection rules: what a pattern or a parsed file says about the graph.

A detector is a name, its languages, and rules or a function. All detectors of a file's language run in one pass of one
Python task; files are rows, so the pass is spread as the files are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftgraph import model as M
from weftgraph.sources import structured


@dataclass
class File:
    path: str
    language: str
    text: str
    parsed: dict | None = None

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    @property
    def owner(self) -> str:
        """The first type or module that the file names."""
        m = re.search(r"\b(?:class|interface|object|struct|trait|enum)\s+(\w+)", self.text)
        return m[1] if m else re.sub(r"\.[^.]*$", "", self.path.rsplit("/", 1)[-1])


@dataclass
class Found:
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)

    def node(self, id: str, kind: str, label: str, file: File | None = None, line: int | None = None, end: int | None = None, /, **props) -> str:
        known = {k: str(v) for k, v in props.items() if v not in (None, "")}
        self.nodes.append({"id": id, "kind": kind, "label": label, "fqn": known.pop("fqn", ""), "file_path": file.path if file else "", "line_start": line, "line_end": end, "props": known})
        return id

    def edge(self, kind: str, src: str, dst: str, /, **props) -> None:
        self.edges.append({"id": f"{src}->{kind}->{dst}", "kind": kind, "src": src, "dst": dst, "props": {k: str(v) for k, v in props.items() if v not in (None, "")}})


@dataclass
class Rule:
    """For each match a node (unless ``kind`` is None) and edges. Texts are formatted with the match's named groups and
    path, owner, language, line and file (the id of the file's own node)."""

    kind: str | None
    pattern: str
    label: str
    id: str = "{path}:{kind}:{label}"
    props: dict[str, str] = field(default_factory=dict)
    edges: tuple[tuple[str, str, str], ...] = ()
    flags: int = re.MULTILINE
    upper: tuple[str, ...] = ()
    #: A pattern that must be somewhere in the file.
    when: str = ""

    def __post_init__(self):
        self.regex = re.compile(self.pattern, self.flags)


@dataclass
class Detector:
    name: str
    languages: tuple[str, ...]
    rules: tuple[Rule, ...] = ()
    needs: tuple[str, ...] = ()
    function: Callable[[File, Found], None] | None = None
    confidence: str = "LEXICAL"
    unless: tuple[str, ...] = ()

    def run(self, file: File) -> Found:
        out = Found()
        if (self.needs and not any(x in file.text for x in self.needs)) or any(x in file.text for x in self.unless):
            return out
        seen = set()
        for rule in self.rules:
            if rule.when and not re.search(rule.when, file.text):
                continue
            for m in rule.regex.finditer(file.text):
                v = {k: x or "" for k, x in m.groupdict().items()}
                v |= {k: v[k].upper() for k in rule.upper if k in v}
                v |= {"path": file.path, "owner": file.owner, "language": file.language, "line": file.line(m.start()), "kind": rule.kind or "", "file": f"{file.language}:file:{file.path}"}
                v["label"] = rule.label.format(**v)
                v["id"] = rule.id.format(**v)
                if rule.kind and v["label"] and v["id"] not in seen:
                    seen.add(v["id"])
                    out.node(v["id"], rule.kind, v["label"], file, v["line"], **{k: x.format(**v) for k, x in rule.props.items()})
                for kind, src, dst in rule.edges:
                    if (edge := (kind, src.format(**v), dst.format(**v))) not in seen and not edge[2].endswith(":"):
                        seen.add(edge)
                        if kind in ("imports", "depends_on") and src == "{file}" and edge[1] not in seen:
                            # The file itself is a node, or its edges would dangle.
                            seen.add(edge[1])
                            out.node(edge[1], "module", file.path, file, module_type=f"{file.language}_file")
                        out.edge(*edge)
        if self.function:
            self.function(file, out)
        for x in (*out.nodes, *out.edges):
            x |= {"confidence": self.confidence, "source": self.name}
        return out


REGISTRY: dict[str, Detector] = {}


def register(*detectors: Detector) -> None:
    for d in detectors:
        if d.name in REGISTRY:
            raise ValueError(f"two detectors are named {d.name}")
        REGISTRY[d.name] = d


def for_language(language: str) -> list[Detector]:
    """In order of names."""
    from weftgraph.detectors import catalogue

    return [d for _, d in sorted(catalogue.all_detectors().items()) if language in d.languages]


def detect_text(path: str, language: str, text: str) -> tuple[list[dict], list[dict]]:
    file = File(path, language, text, structured.parse(language, text))
    nodes, edges = [], []
    for d in for_language(language):
        found = d.run(file)
        nodes += found.nodes
        edges += found.edges
    return nodes, edges


_RAW = "path string, content_hash string, nodes array<struct<seq:bigint,id:string,kind:string,label:string,fqn:string,file_path:string,line_start:bigint,line_end:bigint,module:string,layer:string,confidence:string,source:string,annotations:array<string>,props:map<string,string>>>, edges array<struct<seq:bigint,id:string,kind:string,src:string,dst:string,confidence:string,source:string,props:map<string,string>>>"


def detect(files: DataFrame) -> DataFrame:
    """(path, content_hash, nodes, edges) for each of ``files`` (path, language, content, content_hash)."""
    spark = files.sparkSession
    schema = spark.createDataFrame([], _RAW).schema
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields}

    def run(batches):
        for b in batches:
            columns = b.to_pydict()
            all_nodes, all_edges = [], []
            for path, language, text in zip(columns["path"], columns["language"], columns["content"], strict=True):
                nodes, edges = detect_text(path, language, text or "")
                all_nodes.append([{"seq": i, "module": "", "layer": "unknown", "annotations": [], **n, "props": list(n["props"].items())} for i, n in enumerate(nodes)])
                all_edges.append([{"seq": i, **e, "props": list(e["props"].items())} for i, e in enumerate(edges)])
            yield pa.RecordBatch.from_arrays([pa.array(columns["path"], kinds["path"]), pa.array(columns["content_hash"], kinds["content_hash"]), pa.array(all_nodes, kinds["nodes"]), pa.array(all_edges, kinds["edges"])], list(kinds))

    return files.select("path", "language", "content", "content_hash").mapInArrow(run, schema)


def raw_nodes(detected: DataFrame) -> DataFrame:
    return detected.select("path", "content_hash", F.explode("nodes").alias("n")).select("path", "content_hash", "n.*")


def raw_edges(detected: DataFrame) -> DataFrame:
    return detected.select("path", "content_hash", F.explode("edges").alias("e")).select("path", "content_hash", "e.*")


def plugins(spark) -> DataFrame:
    from weftgraph.detectors import catalogue

    return spark.createDataFrame([(n, ",".join(d.languages), d.confidence) for n, d in sorted(catalogue.all_detectors().items())], "name string, languages string, confidence string")


def check_domains(nodes: list[dict], edges: list[dict]) -> list[str]:
    """Kinds a detector gave that the model lacks."""
    return [n["kind"] for n in nodes if n["kind"] not in M.NODE_KINDS] + [e["kind"] for e in edges if e["kind"] not in M.EDGE_KINDS]
