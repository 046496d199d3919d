"""Architecture views: small diagrams drawn from aggregates, and their renderers."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators.stats import auth_coverage

# Bracket pairs, arrows and style marks of the Mermaid renderer.
SHAPES = {"trigger": ("([", "])"), "endpoint": ("{{", "}}"), "entity": ("[(", ")]"), "database": ("[(", ")]"), "guard": (">", "]"), "middleware": (">", "]"), "component": ("([", "])"), "messaging": ("[/", "\\]")}
ARROWS = {"solid": "-->", "dotted": "-.->", "thick": "==>"}
STYLES = ["success", "warning", "danger"]
VIEWS = ["overview", "ci", "deploy", "runtime", "auth"]
MOST_PER_GROUP, MOST_TRIGGERS, MOST_NODES = 20, 10, 500


@dataclass
class Node:
    id: str
    label: str
    kind: str
    style: str = "default"
    props: dict = field(default_factory=dict)


@dataclass
class Edge:
    source: str
    target: str
    label: str = ""
    style: str = "solid"


@dataclass
class Group:
    id: str
    label: str
    nodes: list[Node]


@dataclass
class Diagram:
    title: str
    view: str
    groups: list[Group] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    stats: dict = field(default_factory=dict)

    def valid_edges(self) -> list[Edge]:
        """Edges whose two ends are drawn."""
        ids = {n.id for n in self.nodes} | {n.id for g in self.groups for n in g.nodes}
        return [e for e in self.edges if e.source in ids and e.target in ids]


def is_ci() -> Column:
    return F.col("id").contains("gha:") | F.col("id").contains("gitlab:")


def overview_counts(nodes: DataFrame) -> DataFrame:
    """One row with what the overview shows."""
    k, low = F.col("kind"), F.lower("id")
    infra = k.isin("infra_resource", "azure_resource")
    k8s, docker, tf = F.col("id").contains("k8s:"), F.col("id").contains("compose:") | low.contains("dockerfile"), F.col("id").contains("tf:")
    return nodes.agg(
        F.count_if((k == "module") & is_ci()).alias("workflows"), F.count_if((k == "method") & is_ci()).alias("jobs"), F.count_if(infra & k8s).alias("k8s"), F.count_if(infra & ~k8s & docker).alias("docker"), F.count_if(infra & ~k8s & ~docker & tf).alias("terraform"), F.count_if(infra & ~k8s & ~docker & ~tf).alias("other_infra"),
        F.count_if(k == "endpoint").alias("endpoints"), F.count_if(k == "entity").alias("entities"), F.count_if(k == "class").alias("classes"), F.count_if(k == "component").alias("components"), F.count_if(k.isin("topic", "queue", "message_queue")).alias("messaging"), F.count_if(k == "database_connection").alias("databases"), F.count_if(k == "guard").alias("guards"), F.count_if(k == "middleware").alias("middleware"),
    )


def _first_of_group(rows: DataFrame, group: str, most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("id"))).filter(F.col("place") <= most)


def ci_jobs(nodes: DataFrame) -> DataFrame:
    """(workflow, id, label, place): up to 20 jobs of each workflow, in order of ids."""
    own = F.when(F.col("module") != "", F.col("module")).otherwise(F.regexp_replace("id", ":job:.*$", ""))
    rows = nodes.filter((F.col("kind") == "method") & is_ci()).select(own.alias("workflow"), "id", "label")
    return _first_of_group(rows, "workflow", MOST_PER_GROUP).orderBy("workflow", "place")


def ci_triggers(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("kind") == "config_key") & is_ci()).select("id", "label").orderBy("id").limit(MOST_TRIGGERS)


def deploy_groups(nodes: DataFrame) -> DataFrame:
    """(part, id, label, place): up to 20 infrastructure nodes of each sort."""
    low = F.lower("id")
    part = F.when(F.col("id").contains("k8s:"), "k8s").when(F.col("id").contains("compose:"), "compose").when(F.col("id").contains("tf:"), "terraform").when(low.contains("dockerfile") | F.col("id").startswith("docker:"), "docker").otherwise("other")
    rows = nodes.filter(F.col("kind").isin("infra_resource", "azure_resource")).select(part.alias("part"), "id", "label")
    return _first_of_group(rows, "part", MOST_PER_GROUP).orderBy("part", "place")


def runtime_counts(nodes: DataFrame) -> DataFrame:
    """One row; a layer among the properties goes before the column."""
    k, layer = F.col("kind"), F.coalesce(M.prop("layer"), F.col("layer"))
    e = k.isin("endpoint", "websocket_endpoint")
    return nodes.agg(F.count_if(e & (layer == "frontend")).alias("frontend_endpoints"), F.count_if(e & (layer == "backend")).alias("backend_endpoints"), F.count_if(e & ~layer.isin("frontend", "backend")).alias("other_endpoints"), F.count_if(k == "entity").alias("entities"), F.count_if(k == "database_connection").alias("databases"), F.count_if(k.isin("topic", "queue", "message_queue", "event")).alias("messaging"))


def auth_groups(nodes: DataFrame) -> DataFrame:
    kind = M.prop("auth_type")
    return nodes.filter(F.col("kind") == "guard").groupBy(F.when(kind != "", kind).otherwise("unknown").alias("auth_type")).agg(F.count(F.lit(1)).alias("n")).orderBy("auth_type")


def generate(nodes: DataFrame, edges: DataFrame, view: str) -> Diagram:
    """A diagram of one view; a KeyError for an unknown one. What is collected is a row of counts or some groups' first rows."""
    return {"overview": _overview, "ci": _ci, "deploy": _deploy, "runtime": _runtime, "auth": _auth}[view](nodes, edges)


def generate_all(nodes: DataFrame, edges: DataFrame) -> dict[str, Diagram]:
    return {v: generate(nodes, edges, v) for v in VIEWS}


def _counted(counts: dict, parts: list[tuple[str, str, str]]) -> list[Node]:
    return [Node(f"n_{key}", f"{label} x{counts[key]}", kind, props={"count": counts[key]}) for key, label, kind in parts if counts[key]]


def _overview(nodes: DataFrame, edges: DataFrame) -> Diagram:
    c = overview_counts(nodes).first().asDict()
    d = Diagram("Architecture overview", "overview", stats=c)
    sorts = [
        ("ci", "CI/CD pipeline", [("workflows", "Pipelines", "pipeline"), ("jobs", "Jobs", "job")]), ("infra", "Infrastructure", [("k8s", "Kubernetes", "k8s"), ("docker", "Docker", "docker"), ("terraform", "Terraform", "terraform"), ("other_infra", "Other", "infra")]),
        ("app", "Application", [("endpoints", "Endpoints", "endpoint"), ("entities", "Entities", "entity"), ("classes", "Classes", "code"), ("components", "Components", "component"), ("messaging", "Messaging", "messaging"), ("databases", "Databases", "database")]), ("security", "Security", [("guards", "Guards", "guard"), ("middleware", "Middleware", "middleware")]),
    ]
    d.groups = [Group(i, label, found) for i, label, parts in sorts if (found := _counted(c, parts))]
    d.edges = [Edge("n_workflows", "n_jobs"), Edge("n_endpoints", "n_entities", "queries"), Edge("n_guards", "n_endpoints", "protects", "thick"), *(Edge("n_jobs", f"n_{x}", "deploys", "dotted") for x in ("k8s", "docker", "terraform"))]
    d.edges = d.valid_edges()
    return d


def _ci(nodes: DataFrame, edges: DataFrame) -> Diagram:
    d = Diagram("CI/CD", "ci", nodes=[Node(r["id"], r["label"], "trigger") for r in ci_triggers(nodes).collect()])
    for r in ci_jobs(nodes).collect():
        if not d.groups or d.groups[-1].id != r["workflow"]:
            d.groups.append(Group(r["workflow"], r["workflow"], []))
        d.groups[-1].nodes.append(Node(r["id"], r["label"], "job"))
    jobs = [n.id for g in d.groups for n in g.nodes]
    for r in edges.filter((F.col("kind") == "depends_on") & F.col("src").isin(jobs) & F.col("dst").isin(jobs)).select("src", "dst").distinct().orderBy("src", "dst").collect():
        d.edges.append(Edge(r["dst"], r["src"]))
    d.stats = {"workflows": len(d.groups), "jobs": len(jobs)}
    return d


def _deploy(nodes: DataFrame, edges: DataFrame) -> Diagram:
    d = Diagram("Deployment", "deploy")
    for r in deploy_groups(nodes).collect():
        if not d.groups or d.groups[-1].id != r["part"]:
            d.groups.append(Group(r["part"], r["part"], []))
        d.groups[-1].nodes.append(Node(r["id"], r["label"], r["part"]))
    ids = [n.id for g in d.groups for n in g.nodes]
    rows = edges.filter(F.col("kind").isin("connects_to", "depends_on") & F.col("src").isin(ids) & F.col("dst").isin(ids)).select("src", "dst", "kind").distinct().orderBy("src", "dst", "kind")
    d.edges = [Edge(r["src"], r["dst"], r["kind"]) for r in rows.collect()]
    return d


def _runtime(nodes: DataFrame, edges: DataFrame) -> Diagram:
    c = runtime_counts(nodes).first().asDict()
    d = Diagram("Runtime", "runtime", stats=c)
    d.nodes = _counted(c, [("frontend_endpoints", "Frontend endpoints", "endpoint"), ("backend_endpoints", "Backend endpoints", "endpoint"), ("other_endpoints", "Endpoints", "endpoint"), ("entities", "Entities", "entity"), ("databases", "Databases", "database"), ("messaging", "Messaging", "messaging")])
    d.edges = [Edge("n_frontend_endpoints", "n_backend_endpoints", "calls"), Edge("n_backend_endpoints", "n_entities", "queries"), Edge("n_entities", "n_databases"), Edge("n_backend_endpoints", "n_messaging", "events", "dotted")]
    d.edges = d.valid_edges()
    return d


def _auth(nodes: DataFrame, edges: DataFrame) -> Diagram:
    c = auth_coverage(nodes, edges).first().asDict()
    d = Diagram("Authentication", "auth", stats=c)
    d.groups = [Group("guards", "Guards", [Node(f"guard_{r['auth_type']}", f"{r['auth_type']} x{r['n']}", "guard", props={"count": r["n"]}) for r in auth_groups(nodes).collect()])]
    ways = nodes.filter("kind = 'middleware'").count()
    if ways:
        d.groups[0].nodes.append(Node("guard_middleware", f"Middleware x{ways}", "middleware", props={"count": ways}))
    bare = c["endpoints"] - c["protected"]
    d.nodes = [Node("protected", f"Protected x{c['protected']}", "endpoint", "success"), Node("unprotected", f"Unprotected x{bare}", "endpoint", "danger" if bare else "default")]
    d.edges = [Edge(n.id, "protected", "protects", "thick") for n in d.groups[0].nodes]
    return d


def graph_diagram(nodes: DataFrame, edges: DataFrame, most: int = MOST_NODES) -> Diagram:
    """The first nodes by id and the edges among them."""
    n = nodes.orderBy("id").limit(most).select("id", "kind", "label")
    e = edges.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "kind").distinct().orderBy("src", "dst", "kind")
    shown = {"topic": "messaging", "queue": "messaging", "message_queue": "messaging", "database_connection": "database", "infra_resource": "infra", "azure_resource": "infra"}
    return Diagram("Graph", "graph", nodes=[Node(r["id"], r["label"], shown.get(r["kind"], r["kind"])) for r in n.collect()], edges=[Edge(r["src"], r["dst"], r["kind"]) for r in e.collect()])


def _safe(name: str) -> str:
    return re.sub(r"\W", "_", name, flags=re.ASCII)


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', "&quot;").replace("\n", " ")


def render(d: Diagram, form: str = "json") -> str:
    """json, yaml, mermaid or dot; ids and edges in order. A ValueError for another form."""
    edges = sorted(d.valid_edges(), key=lambda e: (e.source, e.target, e.label))
    if form == "json":
        return json.dumps(asdict(d) | {"edges": [asdict(e) for e in edges]}, indent=2)
    if form == "yaml":
        import yaml

        return yaml.safe_dump(asdict(d) | {"edges": [asdict(e) for e in edges]}, sort_keys=False)
    groups, loose = sorted(d.groups, key=lambda g: g.id), sorted(d.nodes, key=lambda n: n.id)
    if form == "mermaid":

        def node(n: Node) -> str:
            a, b = SHAPES.get(n.kind, ("[", "]"))
            return f'{_safe(n.id)}{a}"{_quoted(n.label)}"{b}' + (f":::{n.style}" if n.style in STYLES else "")

        out = ["graph LR"]
        for g in groups:
            out += [f'  subgraph {_safe(g.id)}["{_quoted(g.label)}"]', *(f"    {node(n)}" for n in sorted(g.nodes, key=lambda n: n.id)), "  end"]
        out += [f"  {node(n)}" for n in loose]
        return "\n".join([*out, *(f"  {_safe(e.source)} {ARROWS.get(e.style, '-->')}{'|' + _quoted(e.label) + '|' if e.label else ''} {_safe(e.target)}" for e in edges)]) + "\n"
    if form == "dot":
        label = lambda x: x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        out = ["digraph G {", "  rankdir=LR;"]
        for g in groups:
            out += [f"  subgraph cluster_{_safe(g.id)} {{", f'    label="{label(g.label)}";', *(f'    {_safe(n.id)} [label="{label(n.label)}"];' for n in sorted(g.nodes, key=lambda n: n.id)), "  }"]
        out += [f'  {_safe(n.id)} [label="{label(n.label)}"];' for n in loose]
        return "\n".join([*out, *(f'  {_safe(e.source)} -> {_safe(e.target)}{f" [label={chr(34)}{label(e.label)}{chr(34)}]" if e.label else ""};' for e in edges), "}"]) + "\n"
    raise ValueError(f"unknown form: {form}")
