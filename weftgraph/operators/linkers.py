"""Edges that follow from the graph itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators.neighbours import drop_dangling


def edge_columns(kind: str, source: str, props: Column) -> list[Column]:
    """An edge that ``source`` infers between the columns src and dst."""
    return [F.concat_ws("|", F.lit(source), "src", "dst").alias("id"), F.lit(kind).alias("kind"), F.col("src"), F.col("dst"), F.lit("LEXICAL").alias("confidence"), F.lit(source).alias("source"), props.alias("props")]


def _edges(rows: DataFrame, kind: str, source: str, props: Column) -> DataFrame:
    return rows.select(*edge_columns(kind, source, props))


def inferred(*more) -> Column:
    return F.create_map(F.lit("inferred"), F.lit("true"), *more).cast("map<string,string>")


def link_topics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """calls edges from every producer to every other consumer of topics of one label. The pairs are what is asked
    for; each comes once, of its topics the first by label."""
    topics = nodes.filter(F.col("kind").isin("topic", "queue", "message_queue") & (F.col("label") != "")).select(F.col("id").alias("dst"), F.col("label").alias("topic"))
    met = edges.join(topics, "dst").select("src", "topic", "kind").distinct()
    makes = met.filter(F.col("kind").isin("produces", "publishes")).select("topic", F.col("src")).distinct()
    takes = met.filter(F.col("kind").isin("consumes", "listens")).select("topic", F.col("src").alias("dst")).distinct()
    pairs = makes.join(takes, "topic").filter("src <> dst").groupBy("src", "dst").agg(F.min("topic").alias("topic"))
    return _edges(pairs, "calls", "topic_linker", inferred(F.lit("topic"), F.col("topic"))).orderBy("id")


def link_entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """queries edges from repositories to the entity their name holds; of entities of one name the last id counts."""
    names = F.array_distinct(F.array(F.lower("label"), F.lower(F.element_at(F.split("fqn", r"\."), -1))))
    entities = nodes.filter(F.col("kind") == "entity").select("id", F.explode(names).alias("key")).filter("key <> ''")
    entities = entities.groupBy("key").agg(F.max("id").alias("dst"))
    repos = nodes.filter((F.col("kind") == "repository") & F.col("label").rlike("(?:Repository|Repo|Dao|DAO)$")).select(F.col("id").alias("src"), F.lower(F.regexp_replace("label", "(?:Repository|Repo|Dao|DAO)$", "")).alias("key")).filter("key <> ''")
    have = edges.filter(F.col("kind") == "queries").select("src", "dst")
    return _edges(repos.join(entities, "key").select("src", "dst").join(have, ["src", "dst"], "left_anti"), "queries", "entity_linker", inferred()).orderBy("id")


def module_nodes(names: DataFrame) -> DataFrame:
    """A node for each module name (module)."""
    made = {"id": F.concat(F.lit("module:"), "module"), "kind": F.lit("module"), "label": F.col("module"), "fqn": F.col("module"), "module": F.col("module"), "layer": F.lit("unknown"), "confidence": F.lit("LEXICAL"), "source": F.lit("module_linker")}
    return names.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in M.NODES))


def link_modules(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A module node for each module named but not there, and contains edges to the members that lack one."""
    members = nodes.filter((F.col("kind") != "module") & (F.trim("module") != "")).select("id", "module")
    there = nodes.filter(F.col("kind") == "module").groupBy(F.col("label").alias("module")).agg(F.min("id").alias("have"))
    named = members.select("module").distinct().join(there, "module", "left")
    extra = module_nodes(named.filter("have IS NULL").select("module"))
    links = members.join(named.select("module", F.coalesce("have", F.concat(F.lit("module:"), "module")).alias("src")), "module").select("src", F.col("id").alias("dst"))
    have = edges.filter(F.col("kind") == "contains").select("src", "dst")
    return extra.orderBy("id"), _edges(links.join(have, ["src", "dst"], "left_anti"), "contains", "module_linker", inferred()).orderBy("id")


def longest_prefix(paths: DataFrame, dirs: DataFrame) -> DataFrame:
    """For each row of ``paths`` (path) the deepest of ``dirs`` (dir) that holds it; '' holds all.

    A path is expanded to its own ancestors, so the match is an equality and never compares all pairs.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = paths.select("path").distinct().select("path", F.explode(F.array_distinct(up)).alias("dir"))
    return each.join(dirs.select("dir").distinct(), "dir").groupBy("path").agg(F.max(F.struct(F.length("dir").alias("n"), "dir")).alias("best")).select("path", F.col("best.dir").alias("dir"))


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls edges for call sites (src, name) whose name belongs to just one method."""
    methods = nodes.filter(F.col("kind") == "method").groupBy(F.col("label").alias("name")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("dst")).filter("n = 1")
    return _edges(calls.join(methods, "name").select("src", "dst").filter("src <> dst").distinct(), "calls", "extractor", inferred()).orderBy("id")


def phantom_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: distinct nodes, distinct edges (src, dst, kind), repeated nodes and edges, and edges with an end that is no node."""
    n = nodes.agg(F.count_distinct("id").alias("nodes"), (F.count("id") - F.count_distinct("id")).alias("repeated_nodes"))
    # Grouped first: edges in buckets by source are counted where they lie.
    e = edges.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).withColumn("repeated_edges", F.col("all") - F.col("edges"))
    whole = drop_dangling(nodes, edges).agg(F.count(F.lit(1)).alias("whole"))
    # Three tables of one row each.
    return n.crossJoin(e).crossJoin(whole).select("nodes", "repeated_nodes", "edges", "repeated_edges", (F.col("all") - F.col("whole")).alias("dangling_edges"))


def first_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
