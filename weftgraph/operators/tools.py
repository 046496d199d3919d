"""Tools over a graph: each has modes that lead to an operator, checked arguments, and errors as envelopes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators import flow, gate, neighbours, search, stats, topology, traversal
from weftgraph.sources import git_diff, review
from weftgraph.sources.adjacency import Adjacency
from weftgraph.sources.text_index import TextIndex

# The codes of errors.
INTERNAL_ERROR, INVALID_INPUT, FILE_READ_FAILED = "INTERNAL_ERROR", "INVALID_INPUT", "FILE_READ_FAILED"
WALKS = {"callers": neighbours.callers, "consumers": neighbours.consumers, "producers": neighbours.producers, "dependencies": neighbours.dependencies, "dependents": neighbours.dependents}


@dataclass(frozen=True)
class Graph:
    """What tools work on; ``files`` (path, content) and ``root`` only where texts are asked for."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    root: str | None = None
    #: The edges by both ends, and the stored index over labels, where there are any.
    walks: Adjacency | None = None
    index: TextIndex | None = None

    @property
    def steps(self) -> DataFrame | Adjacency:
        return self.walks or self.edges


@dataclass(frozen=True)
class Mode:
    run: Callable[[Graph, dict], DataFrame]
    needs: tuple[str, ...] = ()


def _rows(g: Graph, rows: list[tuple], schema: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame(rows, schema)


def _category(g: Graph, a: dict) -> DataFrame:
    found = stats.category(g.nodes, g.edges, a["category"])
    if found is None:
        raise ValueError(f"unknown category {a['category']!r}: expected {'|'.join(stats.CATEGORIES)}")
    return found


def _neighbours(g: Graph, a: dict) -> DataFrame:
    way = (a.get("direction") or "both").lower()
    if way not in ("in", "out", "both"):
        raise ValueError(f"unknown direction {way!r}: expected in|out|both")
    parts = [f(g.nodes, g.edges, a["node_id"]).withColumn("direction", F.lit(d)) for d, f in (("in", neighbours.incoming), ("out", neighbours.outgoing)) if way in (d, "both")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _evidence(g: Graph, a: dict) -> DataFrame:
    if not a.get("node_id") and not a.get("file_path"):
        raise ValueError("node_id or file_path is required")
    return search.full_evidence(g.nodes, g.edges, g.files, a.get("node_id"), a.get("file_path"))


def _source(g: Graph, a: dict) -> DataFrame:
    if g.root is None:
        raise ValueError("this graph has no folder of sources")
    return _rows(g, [(a["file_path"], review.read_repo_file(g.root, a["file_path"]))], "path string, text string")


def _changed(g: Graph, a: dict) -> DataFrame:
    if g.root is None:
        raise ValueError("this graph has no folder of sources")
    return git_diff.read_diff(g.nodes.sparkSession, g.root, a.get("base_ref") or "", a.get("head_ref") or "")


def _review(g: Graph, a: dict) -> DataFrame:
    focus = a.get("focus_files") or []
    if not isinstance(focus, list):
        raise ValueError("focus_files must be a list of paths")
    return review.review_changes(g.nodes, g.edges, _changed(g, a), focus)


def _path(g: Graph, a: dict) -> DataFrame:
    return _rows(g, list(enumerate(traversal.shortest_path(g.nodes, g.steps, a["from"], a["to"]))), "hop int, id string")


def _flow(g: Graph, a: dict) -> DataFrame:
    view, form = a.get("view") or "overview", a.get("format") or "json"
    if view not in (*flow.VIEWS, "all"):
        raise ValueError(f"unknown view {view!r}: expected {'|'.join(flow.VIEWS)}|all")
    made = flow.generate_all(g.nodes, g.edges) if view == "all" else {view: flow.generate(g.nodes, g.edges, view)}
    return _rows(g, [(v, form, flow.render(d, form)) for v, d in made.items()], "view string, format string, text string")


def _capped(g: Graph, a: dict) -> DataFrame:
    """A query's rows with a column that says whether there were more."""
    found = gate.query_result(g.nodes.sparkSession, a["query"], g.nodes, g.edges, a.get("limit") or 500)
    if "truncated" in (c.lower() for c in found.rows.columns):
        raise ValueError("a column is called truncated already")
    return found.rows.withColumn("truncated", F.lit(found.truncated))


def _table(g: Graph, a: dict) -> DataFrame:
    """A query's rows as one text in columns."""
    found = gate.query_result(g.nodes.sparkSession, a["query"], g.nodes, g.edges, a.get("limit") or 500)
    return _rows(g, [(found.table(), found.truncated)], "text string, truncated boolean")


def _fuzzy(g: Graph, a: dict) -> DataFrame:
    """Found nodes with the route that the planner takes and its note."""
    told = search.plan("FIND_SYMBOL", a.get("language") or search.guess_language(a["query"]))
    return search.find_node(g.nodes, a["query"], a.get("limit") or 50, told["route"] != "GRAPH_FIRST").withColumns({"route": F.lit(told["route"]), "note": F.lit(told["note"])})


TOOLS: dict[str, tuple[str | None, dict[str, Mode]]] = {
    "graph_summary": ("overview", {
        "overview": Mode(lambda g, a: stats.count_by_kind(g.nodes)),
        "categories": Mode(_category, ("category",)),
        "capabilities": Mode(lambda g, a: search.capability_table(g.nodes.sparkSession, [a["language"]] if a.get("language") else sorted(search.CAPABILITIES))),
        "provenance": Mode(lambda g, a: search.provenance(g.nodes)),
    }),
    "find_in_graph": (None, {
        "nodes": Mode(lambda g, a: neighbours.find_by_kind(g.nodes, a["kind"], 0, M.cap_results(a.get("limit") or 50)), ("kind",)),
        "edges": Mode(lambda g, a: neighbours.query_edges(g.edges, a.get("kind"), a.get("limit") or 50)),
        "text": Mode(lambda g, a: search.text_search(g.nodes, a["query"], limit=a.get("limit") or 50, index=g.index), ("query",)),
        "fuzzy": Mode(_fuzzy, ("query",)),
        "by_file": Mode(lambda g, a: neighbours.component_by_file(g.nodes, g.edges, a["file_path"]), ("file_path",)),
        "by_endpoint": Mode(lambda g, a: neighbours.related_endpoints(g.nodes, g.edges, a["node_id"]), ("node_id",)),
    }),
    "inspect_node": (None, {
        "neighbors": Mode(_neighbours, ("node_id",)),
        "ego": Mode(lambda g, a: traversal.ego_graph(g.nodes, g.steps, a["center"], a.get("radius") or 2), ("center",)),
        "evidence": Mode(_evidence),
        "source": Mode(_source, ("file_path",)),
    }),
    "trace_relationships": (None, {k: Mode(lambda g, a, f=f: f(g.nodes, g.edges, a["node_id"]), ("node_id",)) for k, f in WALKS.items()} | {"shortest_path": Mode(_path, ("from", "to"))}),
    "analyze_impact": (None, {
        "blast_radius": Mode(lambda g, a: traversal.blast_radius(g.nodes, g.steps, a["node_id"], a.get("depth") or 1), ("node_id",)),
        "trace": Mode(lambda g, a: traversal.blast_radius(g.nodes, g.steps, a["node_id"], a.get("depth") or 5), ("node_id",)),
        "cycles": Mode(lambda g, a: traversal.cycles(g.steps, limit=a.get("limit") or 100)),
        "circular_deps": Mode(lambda g, a: topology.service_cycle_rows(g.nodes, g.edges)),
        "dead_code": Mode(lambda g, a: neighbours.dead_code(g.nodes, g.edges, [a["kind"]] if a.get("kind") else None, a.get("limit") or 100)),
        "dead_services": Mode(lambda g, a: topology.dead_services(g.nodes, g.edges)),
        "bottlenecks": Mode(lambda g, a: topology.bottlenecks(g.nodes, g.edges)),
    }),
    "topology_view": (None, {
        "summary": Mode(lambda g, a: topology.summary(g.nodes, g.edges)),
        "service": Mode(lambda g, a: topology.service_detail(g.nodes, g.edges, a["service_name"]), ("service_name",)),
        "service_deps": Mode(lambda g, a: topology.service_links(g.nodes, g.edges, a["service_name"]), ("service_name",)),
        "service_dependents": Mode(lambda g, a: topology.service_links(g.nodes, g.edges, a["service_name"], False), ("service_name",)),
        "flow": Mode(_flow),
    }),
    "run_query": ("query", {"query": Mode(lambda g, a: gate.run_query(g.nodes.sparkSession, a["query"], g.nodes, g.edges, a.get("limit") or 500), ("query",)), "capped": Mode(_capped, ("query",)), "table": Mode(_table, ("query",))}),
    "review_changes": ("prompt", {"prompt": Mode(_review), "files": Mode(_changed)}),
    "read_file": ("file", {"file": Mode(_source, ("file_path",))}),
    "generate_flow": ("flow", {"flow": Mode(_flow)}),
}


def envelope(code: str, message: str) -> dict:
    return {"code": code, "message": message or "(no message)", "request_id": str(uuid.uuid4()), "error": message or "(no message)"}


def call(graph: Graph, tool: str, args: dict | None = None) -> DataFrame | dict:
    """The rows of a tool's mode, or an envelope with a code, a message and a request id."""
    args = dict(args or {})
    if tool not in TOOLS:
        return envelope(INVALID_INPUT, f"unknown tool {tool!r}: expected {'|'.join(TOOLS)}")
    default, modes = TOOLS[tool]
    mode = args.get("mode") or default
    if mode not in modes:
        return envelope(INVALID_INPUT, f"unknown mode {mode!r}: expected {'|'.join(modes)}")
    lacking = [x for x in modes[mode].needs if not isinstance(args.get(x), str) or not args[x].strip()]
    if lacking:
        return envelope(INVALID_INPUT, f"{', '.join(lacking)} required")
    wrong = [x for x in ("limit", "depth", "radius") if args.get(x) is not None and (isinstance(args[x], bool) or not isinstance(args[x], int))]
    if wrong:
        return envelope(INVALID_INPUT, f"{', '.join(wrong)} must be a number")
    try:
        return modes[mode].run(graph, args)
    except (OSError, UnicodeError) as e:
        return envelope(FILE_READ_FAILED, str(e))
    except ValueError as e:
        return envelope(FILE_READ_FAILED if modes[mode].run is _source else INVALID_INPUT, str(e))
