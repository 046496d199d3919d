"""Where edges come from: facts by group, the claims that groups make, and the claim that stands of those to one edge.

A linker looks at what shares a topic's label, a name of an entity, of a module or of a method. Each such thing is a fact
(linker, group, role, id, origin), origin being the node, edge or file that says so. What a group claims depends on its own facts
alone, so a change needs to look again only at groups whose facts changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators import linkers

#: Who claims an edge, the first one first.
DETECTORS, TOPICS, ENTITIES, MODULES, CALLS, SERVICES = range(6)
KEY = ["src", "dst", "kind"]
CLAIM = ["rank", "group", *(f.name for f in M.EDGES)]
FACT = ["linker", "group", "role", "id", "origin"]
MAKES, TAKES = ["produces", "publishes"], ["consumes", "listens"]
TOPIC_KINDS = ["topic", "queue", "message_queue"]


def claimed(edges: DataFrame, rank: int, group: str | Column = "") -> DataFrame:
    return edges.withColumn("rank", F.lit(rank)).withColumn("group", F.lit(group) if isinstance(group, str) else group).select(*CLAIM)


def ranked(*found: DataFrame) -> DataFrame:
    """Claims from the edges of each rank, in the order of the ranks."""
    out = claimed(found[0], 0)
    for rank, edges in enumerate(found[1:], 1):
        out = out.unionByName(claimed(edges, rank))
    return out


def survivors(claims: DataFrame) -> DataFrame:
    """An edge for each (src, dst, kind): the claim of the lowest rank, then group, then id."""
    kept = ["id", "confidence", "source", "props"]
    best = claims.groupBy(*KEY).agg(F.min_by(F.struct(*kept), F.struct("rank", "group", "id")).alias("x"))
    return best.select(*KEY, "x.*").select(*(f.name for f in M.EDGES))


def _facts(rows: DataFrame, linker: str, group, role, id, origin) -> DataFrame:
    return rows.select(F.lit(linker).alias("linker"), group.alias("group"), (F.lit(role) if isinstance(role, str) else role).alias("role"), F.col(id).alias("id"), origin.alias("origin"))


def node_facts(nodes: DataFrame) -> DataFrame:
    """What nodes say of entities, repositories, modules and methods."""
    names = F.array_distinct(F.array(F.lower("label"), F.lower(F.element_at(F.split("fqn", r"\."), -1))))
    ids = F.col("id")
    suffix = "(?:Repository|Repo|Dao|DAO)$"
    entities = _facts(nodes.filter("kind = 'entity'").select("id", F.explode(names).alias("key")).filter("key <> ''"), "entity", F.col("key"), "entity", "id", ids)
    repos = _facts(nodes.filter((F.col("kind") == "repository") & F.col("label").rlike(suffix)).withColumn("key", F.lower(F.regexp_replace("label", suffix, ""))).filter("key <> ''"), "entity", F.col("key"), "repository", "id", ids)
    members = _facts(nodes.filter((F.col("kind") != "module") & (F.trim("module") != "")), "module", F.col("module"), "member", "id", ids)
    modules = _facts(nodes.filter((F.col("kind") == "module") & F.col("label").isNotNull()), "module", F.col("label"), "module", "id", ids)
    methods = _facts(nodes.filter((F.col("kind") == "method") & F.col("label").isNotNull()), "method", F.col("label"), "method", "id", ids)
    return entities.unionByName(repos).unionByName(members).unionByName(modules).unionByName(methods)


def topic_facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Who makes and takes the topics among ``nodes`` (id, kind, label), by detectors' ``edges``."""
    topics = nodes.filter(F.col("kind").isin(TOPIC_KINDS) & (F.col("label") != "")).select(F.col("id").alias("dst"), F.col("label").alias("topic"))
    met = edges.filter(F.col("kind").isin(MAKES + TAKES)).join(topics, "dst")
    return _facts(met, "topic", F.col("topic"), F.when(F.col("kind").isin(MAKES), "makes").otherwise("takes"), "src", F.concat_ws("|", *KEY))


def call_facts(calls: DataFrame) -> DataFrame:
    """Call sites (path, src, name)."""
    return _facts(calls, "method", F.col("name"), "call", "src", F.col("path"))


def derived(facts: DataFrame) -> DataFrame:
    """The claims of all groups that ``facts`` hold whole."""
    role = lambda linker, name, id: facts.filter((F.col("linker") == linker) & (F.col("role") == name)).select("group", F.col("id").alias(id)).distinct()
    plain, named = linkers.inferred(), linkers.inferred(F.lit("topic"), F.col("group"))

    def edges(rows: DataFrame, rank: int, kind: str, source: str, props: Column) -> DataFrame:
        made = rows.filter("src <> dst") if rank in (TOPICS, CALLS) else rows
        return made.select(F.lit(rank).alias("rank"), "group", *linkers.edge_columns(kind, source, props)).select(*CLAIM)

    pairs = role("topic", "makes", "src").join(role("topic", "takes", "dst"), "group")
    owned = role("entity", "repository", "src").join(role("entity", "entity", "dst").groupBy("group").agg(F.max("dst").alias("dst")), "group")
    there = role("module", "module", "src").groupBy("group").agg(F.min("src").alias("src"))
    held = role("module", "member", "dst").join(there, "group", "left").withColumn("src", F.coalesce("src", F.concat(F.lit("module:"), "group")))
    once = role("method", "method", "dst").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).filter("n = 1")
    calls = role("method", "call", "src").join(once, "group")
    return edges(pairs, TOPICS, "calls", "topic_linker", named).unionByName(edges(owned, ENTITIES, "queries", "entity_linker", plain)).unionByName(edges(held, MODULES, "contains", "module_linker", plain)).unionByName(edges(calls, CALLS, "calls", "extractor", plain))


def module_names(facts: DataFrame) -> DataFrame:
    """(group): modules that members name and no node is, of all groups that ``facts`` hold whole."""
    rows = facts.filter("linker = 'module'")
    return rows.filter("role = 'member'").select("group").distinct().join(rows.filter("role = 'module'").select("group"), "group", "left_anti")
