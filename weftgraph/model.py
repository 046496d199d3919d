"""The property graph's schema and closed domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
NODES = T.StructType([T.StructField("id", _S, False), *(T.StructField(x, _S) for x in ("kind", "label", "fqn", "file_path")), T.StructField("line_start", T.LongType()), T.StructField("line_end", T.LongType()), *(T.StructField(x, _S) for x in ("module", "layer", "confidence", "source")), T.StructField("annotations", T.ArrayType(_S)), T.StructField("props", T.MapType(_S, _S))])
EDGES = T.StructType([*(T.StructField(x, _S) for x in ("id", "kind", "src", "dst", "confidence", "source")), T.StructField("props", T.MapType(_S, _S))])

# The domains of kinds, layers and confidences.
NODE_KINDS = "module package class method endpoint entity repository query migration topic queue event rmi_interface config_file config_key websocket_endpoint interface abstract_class enum annotation_type protocol_message config_definition database_connection azure_resource azure_function message_queue infra_resource component guard middleware hook service external sql_entity".split()
EDGE_KINDS = "depends_on imports extends implements calls injects exposes queries maps_to produces consumes publishes listens invokes_rmi exports_rmi reads_config migrates contains defines overrides connects_to triggers provisions sends_to receives_from protects renders references_table".split()
LAYERS = ["frontend", "backend", "infra", "shared", "unknown"]
CONFIDENCE = {"LEXICAL": 0.6, "SYNTACTIC": 0.8, "RESOLVED": 0.95}
RUNTIME_KINDS = ["calls", "produces", "consumes", "queries", "connects_to", "publishes", "listens", "sends_to", "receives_from", "invokes_rmi", "exports_rmi"]
SEMANTIC_KINDS = ["calls", "imports", "depends_on", "extends", "implements", "injects", "queries", "maps_to", "consumes", "listens", "invokes_rmi", "overrides", "connects_to", "triggers", "renders", "protects"]
ENTRY_POINT_KINDS = ["endpoint", "websocket_endpoint", "migration", "config_file", "config_key", "config_definition", "guard", "middleware", "topic", "queue", "event", "message_queue"]
DEAD_CODE_KINDS = ["class", "method", "interface", "abstract_class", "component", "service"]
PRESETS = {"endpoints": "endpoint", "guards": "guard", "entities": "entity", "topics": "topic", "queues": "queue", "services": "service", "databases": "database_connection", "components": "component"}
#: Caps of results and of path depth.
MAX_RESULTS, MAX_DEPTH = 500, 10


def prop(name: str) -> Column:
    """A property's text, or null."""
    return F.col("props")[name]


def confidence_rank(column: Column) -> Column:
    """0 to 2; unknown names rank lowest."""
    up = F.upper(column)
    return F.when(up == "RESOLVED", 2).when(up == "SYNTACTIC", 1).otherwise(0)


def compact(nodes: DataFrame) -> DataFrame:
    """What lists of nodes show."""
    return nodes.select("id", "kind", "label", "file_path", "layer")


def cap_results(wanted: int, cap: int = MAX_RESULTS) -> int:
    """At least 1, at most ``cap`` (500 where the cap itself isn't positive)."""
    return max(1, min(wanted, cap if cap > 0 else MAX_RESULTS))


def cap_depth(wanted: int, cap: int = MAX_DEPTH) -> int:
    return max(1, min(wanted, cap if cap > 0 else MAX_DEPTH))


def invalid_kinds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Kinds outside the domains, with their table."""
    n = nodes.select(F.lit("nodes").alias("table"), "kind").filter(~F.col("kind").isin(NODE_KINDS))
    e = edges.select(F.lit("edges").alias("table"), "kind").filter(~F.col("kind").isin(EDGE_KINDS))
    return n.unionByName(e).distinct()
