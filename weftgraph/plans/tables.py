"""A graph over the star-schema tables, in SQL that more than one engine runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

#: id, kind, label, fqn, file_path, module, layer, language, framework, then properties (null where absent).
NODES_SQL = """
SELECT 'nation:' || CAST(n_nationkey AS STRING) AS id, 'service' AS kind, n_name AS label, 'svc.' || n_name AS fqn, 'services/' || n_name || '/build.yaml' AS file_path, '' AS module, 'backend' AS layer, 'yaml' AS language, '' AS framework,
       CAST(NULL AS STRING) AS http_method, CAST(NULL AS STRING) AS auth_type, CAST(NULL AS STRING) AS protocol, CAST(NULL AS STRING) AS db_type, CAST(n_regionkey AS STRING) AS build_tool FROM {nation}
UNION ALL SELECT 'region:' || CAST(r_regionkey AS STRING), 'module', r_name, r_name, 'docs/' || r_name || '.md', '', 'shared', 'markdown', '', NULL, NULL, NULL, NULL, NULL FROM {region}
UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), 'class', c_name, 'app.' || c_mktsegment || '.' || c_name, 'src/main/java/' || c_mktsegment || '/C' || CAST(c_custkey % 100 AS STRING) || '.java', c_mktsegment, 'backend', 'Java', 'spring', NULL, NULL, NULL, NULL, NULL FROM {customer}
UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS STRING), 'repository', s_name, s_name, 'lib/supplier' || CAST(s_suppkey % 10 AS STRING) || '.py', '', 'backend', NULL, '', NULL, NULL, NULL, NULL, NULL FROM {supplier}
UNION ALL SELECT 'part:' || CAST(p_partkey AS STRING), 'entity', p_name, p_name, 'schema/part' || CAST(p_partkey % 50 AS STRING) || '.sql', '', 'unknown', p_type, ' ' || p_brand, NULL, NULL, NULL, NULL, NULL FROM {part}
UNION ALL SELECT 'order:' || CAST(o_orderkey AS STRING), 'endpoint', '/orders/' || CAST(o_orderkey AS STRING), '', 'api/orders' || CAST(o_orderkey % 20 AS STRING) || '.ts', '', CASE o_orderstatus WHEN 'F' THEN 'backend' WHEN 'O' THEN 'frontend' ELSE 'unknown' END, NULL, 'express',
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'get' WHEN '2' THEN 'POST' WHEN '3' THEN 'put' WHEN '4' THEN 'DELETE' END, NULL, CASE WHEN o_orderkey % 11 = 0 THEN 'gRPC' END, NULL, NULL FROM {orders}
UNION ALL SELECT 'guard:' || CAST(n_nationkey AS STRING), 'guard', n_name || 'Guard', '', 'auth/' || n_name || '.java', '', 'backend', 'java', 'spring_security', NULL, CASE n_regionkey % 3 WHEN 0 THEN 'jwt' WHEN 1 THEN 'oauth2' END, NULL, NULL, NULL FROM {nation}
UNION ALL SELECT 'db:' || CAST(s_suppkey AS STRING), 'database_connection', CASE WHEN s_suppkey % 3 = 0 THEN 'Redis' ELSE 'spring.datasource.url' END, '', 'conf/app.properties', '', 'infra', 'properties', '', NULL, NULL, NULL, CASE s_suppkey % 3 WHEN 1 THEN 'postgres' WHEN 2 THEN 'MySQL@host' END, NULL FROM {supplier} WHERE s_suppkey % 10 = 0 OR s_suppkey < 6
UNION ALL SELECT DISTINCT 'topic:' || p_brand, 'topic', p_brand, '', 'conf/topics.yml', '', 'infra', 'yaml', '', NULL, NULL, CASE WHEN p_brand < 'Brand#3' THEN 'kafka' END, NULL, NULL FROM {part}
UNION ALL SELECT 'queue:' || CAST(s_suppkey AS STRING), 'queue', 'orders.' || s_name, '', 'conf/queues.yml', '', 'infra', 'yaml', '', NULL, NULL, 'jms', NULL, NULL FROM {supplier} WHERE s_suppkey % 20 = 0
UNION ALL SELECT 'component:' || CAST(c_custkey AS STRING), 'component', 'View' || CAST(c_custkey AS STRING), '', 'web/View' || CAST(c_custkey % 30 AS STRING) || '.tsx', '', 'frontend', 'typescript', 'react', NULL, NULL, NULL, NULL, NULL FROM {customer} WHERE c_custkey % 25 = 0
UNION ALL SELECT 'gha:' || r_name, 'module', r_name || ' build', '', '.github/workflows/' || r_name || '.yml', 'gha:' || r_name, 'infra', 'yaml', '', NULL, NULL, NULL, NULL, NULL FROM {region}
UNION ALL SELECT 'gha:' || r_name || ':job:' || n_name, 'method', n_name, '', '.github/workflows/' || r_name || '.yml', 'gha:' || r_name, 'infra', 'yaml', '', NULL, NULL, NULL, NULL, NULL FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT CASE n_nationkey % 4 WHEN 0 THEN 'k8s:' WHEN 1 THEN 'compose:' WHEN 2 THEN 'tf:' ELSE 'other:' END || n_name, 'infra_resource', n_name, '', 'deploy/' || n_name || '.tf', '', 'infra', 'terraform', '', NULL, NULL, NULL, NULL, NULL FROM {nation}
UNION ALL SELECT 'batch:' || CAST(r_regionkey AS STRING), 'service', r_name || '_BATCH', 'svc.' || r_name || '_BATCH', 'batch/' || r_name || '/pom.xml', '', 'backend', 'xml', '', NULL, NULL, NULL, NULL, 'maven' FROM {region}
UNION ALL SELECT 'old:' || CAST(p_partkey AS STRING), 'entity', p_name || ' (old)', p_name || '.old', 'schema/old.sql', '', 'backend', 'sql', '', NULL, NULL, NULL, NULL, NULL FROM {part} WHERE p_partkey % 40 = 0
"""

#: src, kind, dst.
EDGES_SQL = """
SELECT 'region:' || CAST(n_regionkey AS STRING) AS src, 'contains' AS kind, 'nation:' || CAST(n_nationkey AS STRING) AS dst FROM {nation}
UNION ALL SELECT 'nation:' || CAST(c_nationkey AS STRING), 'contains', 'customer:' || CAST(c_custkey AS STRING) FROM {customer}
UNION ALL SELECT 'nation:' || CAST(s_nationkey AS STRING), 'contains', 'supplier:' || CAST(s_suppkey AS STRING) FROM {supplier}
UNION ALL SELECT 'nation:' || CAST(c_nationkey AS STRING), 'contains', 'order:' || CAST(o_orderkey AS STRING) FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), 'contains', 'guard:' || CAST(n_nationkey AS STRING) FROM {nation}
UNION ALL SELECT 'nation:' || CAST(s_nationkey AS STRING), 'contains', 'db:' || CAST(s_suppkey AS STRING) FROM {supplier} WHERE s_suppkey % 10 = 0 OR s_suppkey < 6
UNION ALL SELECT 'guard:' || CAST(c_nationkey AS STRING), 'protects', 'order:' || CAST(o_orderkey AS STRING) FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'order:' || CAST(o_orderkey AS STRING), 'depends_on', 'customer:' || CAST(o_custkey AS STRING) FROM {orders}
UNION ALL SELECT DISTINCT 'order:' || CAST(l_orderkey AS STRING), 'queries', 'part:' || CAST(l_partkey AS STRING) FROM {lineitem}
UNION ALL SELECT DISTINCT 'supplier:' || CAST(l_suppkey AS STRING), 'produces', 'part:' || CAST(l_partkey AS STRING) FROM {lineitem}
UNION ALL SELECT DISTINCT 'customer:' || CAST(o_custkey AS STRING), 'consumes', 'part:' || CAST(l_partkey AS STRING) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'order:' || CAST(l_orderkey AS STRING), 'calls', 'supplier:' || CAST(l_suppkey AS STRING) FROM {lineitem} WHERE l_quantity >= 40 AND l_returnflag = 'R'
UNION ALL SELECT DISTINCT 'part:' || CAST(p_partkey AS STRING), 'depends_on', 'part:' || CAST((p_partkey * 22) % 97 AS STRING) FROM {part}
UNION ALL SELECT 'part:' || CAST(p_partkey AS STRING), 'imports', 'part:' || CAST(p_partkey + 10000000 AS STRING) FROM {part} WHERE p_partkey % 100 = 0
UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS STRING), 'publishes', 'topic:Brand#' || CAST(1 + s_suppkey % 5 AS STRING) || CAST(1 + s_suppkey % 3 AS STRING) FROM {supplier} WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), 'listens', 'topic:Brand#' || CAST(1 + c_custkey % 5 AS STRING) || CAST(1 + c_custkey % 4 AS STRING) FROM {customer} WHERE c_custkey % 50 = 0
UNION ALL SELECT 'gha:' || r_name, 'contains', 'gha:' || r_name || ':job:' || n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'batch:' || CAST(s_suppkey % 5 AS STRING), 'contains', 'queue:' || CAST(s_suppkey AS STRING) FROM {supplier} WHERE s_suppkey % 20 = 0
UNION ALL SELECT 'k8s:' || n_name, 'connects_to', 'nation:' || CAST(n_nationkey AS STRING) FROM {nation} WHERE n_nationkey % 4 = 0
"""
_PROPS = ["language", "framework", "http_method", "auth_type", "protocol", "db_type", "build_tool"]


def graph_from_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the full graph schema; every edge id is ``src|kind|dst``."""
    t = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in TABLES}
    n = spark.sql(NODES_SQL, **t)
    props = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, _PROPS)), F.array(*_PROPS)), lambda _, v: v.isNotNull())
    nodes = n.select("id", "kind", "label", "fqn", "file_path", F.lit(None).cast("long").alias("line_start"), F.lit(None).cast("long").alias("line_end"), "module", "layer", F.lit("LEXICAL").alias("confidence"), F.lit("").alias("source"), F.array().cast("array<string>").alias("annotations"), props.alias("props"))
    return nodes, whole_edges(spark.sql(EDGES_SQL, **t))


def whole_edges(e: DataFrame) -> DataFrame:
    """Edges with the full schema, of which only src, kind and dst differ."""
    return e.select(F.concat_ws("|", "src", "kind", "dst").alias("id"), "kind", "src", "dst", F.lit("LEXICAL").alias("confidence"), F.lit("").alias("source"), F.create_map().cast("map<string,string>").alias("props"))


def edges_dealt(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(src, kind, dst) of the edges, dealt to ``n`` tasks by source. What is DISTINCT in SQL is so after it was dealt, not in a shuffle
    of its own; no two of those parts have a kind in common."""
    t = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in TABLES}
    parts = EDGES_SQL.split("UNION ALL ")
    deal = lambda some: reduce(DataFrame.unionAll, (spark.sql(x, **t).toDF("src", "kind", "dst") for x in some)).repartition(n, "src")
    once = [x.replace("SELECT DISTINCT", "SELECT", 1) for x in parts if x.startswith("SELECT DISTINCT")]
    return deal(once).distinct().unionAll(deal([x for x in parts if not x.startswith("SELECT DISTINCT")]))


def with_graph(sql: str, recursive: bool = False) -> str:
    """``sql`` (a SELECT, or further CTEs and a SELECT) over CTEs ``nodes`` and ``edges``, for another engine over the same tables."""
    body = {x: x for x in TABLES}
    flat = f"SELECT *, coalesce(language, '') AS lang FROM ({NODES_SQL.format(**body)})"
    return f"WITH {'RECURSIVE ' if recursive else ''}nodes AS MATERIALIZED ({flat}), edges AS MATERIALIZED ({EDGES_SQL.format(**body)}){' ' if sql.lstrip().upper().startswith('SELECT') else ', '}{sql}"
