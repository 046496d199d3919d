"""Fixed statistics over a graph, each a conditional aggregate of one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import model as M

# Language of a file extension (others stand for themselves), and names of database types.
EXTENSION_LANGUAGE = {"java": "java", "kt": "kotlin", "kts": "kotlin", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "cs": "csharp", "rb": "ruby", "scala": "scala", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "c", "proto": "protobuf", "yml": "yaml", "yaml": "yaml", "json": "json", "xml": "xml", "toml": "toml", "ini": "ini", "cfg": "ini", "properties": "properties", "gradle": "gradle", "tf": "terraform", "bicep": "bicep", "sql": "sql", "md": "markdown", "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css", "vue": "vue", "svelte": "svelte", "jsx": "jsx", "sh": "shell", "bash": "shell"}
DATABASES = {"mysql": "MySQL", "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "sqlserver": "SQL Server", "mssql": "SQL Server", "oracle": "Oracle", "db2": "DB2", "h2": "H2", "sqlite": "SQLite", "mariadb": "MariaDB", "derby": "Derby", "hsqldb": "HSQLDB", "mongo": "MongoDB", "mongodb": "MongoDB", "redis": "Redis", "cassandra": "Cassandra", "dynamodb": "DynamoDB", "couchbase": "Couchbase", "neo4j": "Neo4j", "cockroachdb": "CockroachDB"}
CATEGORIES = ["graph", "languages", "frameworks", "infra", "connections", "auth", "architecture"]
_ARCHITECTURE = {"class": "classes", "interface": "interfaces", "abstract_class": "abstract_classes", "enum": "enums", "annotation_type": "annotation_types", "module": "modules", "method": "methods"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def counted(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Counts, largest first, then by key."""
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def count_by_kind(nodes: DataFrame) -> DataFrame:
    return counted(nodes, F.col("kind"), "kind")


def count_by_layer(nodes: DataFrame) -> DataFrame:
    return counted(nodes, F.col("layer"), "layer")


def graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, distinct non-blank files."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct(F.when(F.trim("file_path") != "", F.col("file_path"))).alias("files"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).select("nodes", "edges", "files")


def edges_by_kind(edges: DataFrame) -> DataFrame:
    return counted(edges, F.col("kind"), "kind")


def language() -> Column:
    ext = F.lower(F.regexp_extract("file_path", r"\.([^.]*)$", 1))
    named = F.lower(M.prop("language"))
    return F.when(F.trim(named) != "", named).when(F.col("file_path").contains("."), F.coalesce(lookup(EXTENSION_LANGUAGE, ext), ext)).otherwise("")


def languages(nodes: DataFrame) -> DataFrame:
    return counted(nodes.withColumn("x", language()).filter("x <> ''"), F.col("x"), "language")


def frameworks(nodes: DataFrame) -> DataFrame:
    return counted(nodes.withColumn("x", F.trim(M.prop("framework"))).filter("x <> ''"), F.col("x"), "framework")


def _database_name(raw: Column) -> Column:
    low = F.regexp_replace(F.trim(F.lower(raw)), "@.*$", "")
    return F.coalesce(lookup(DATABASES, low), F.trim(raw))


def database_type() -> Column:
    """From db_type, else a jdbc: address, else a label that isn't a config key; '' where there is none."""
    from_url = F.lit(None).cast("string")
    for key in ("url", "value", "connection_url"):
        kind = F.lower(F.regexp_extract(F.coalesce(M.prop(key), F.lit("")), r"jdbc:([^:]+):", 1))
        from_url = F.when(kind != "", F.coalesce(lookup(DATABASES, kind), kind)).otherwise(from_url)
    label = F.col("label")
    return F.when(F.trim(M.prop("db_type")) != "", _database_name(M.prop("db_type"))).when(from_url.isNotNull(), from_url).when((label != "") & ~label.contains(".") & ~label.contains("="), _database_name(label)).otherwise("")


def _prop_or_label(name: str) -> Column:
    return F.when(F.trim(M.prop(name)) != "", M.prop(name)).when(F.col("label") != "", F.col("label")).otherwise("unknown")


def infra(nodes: DataFrame) -> DataFrame:
    """(part, key, n): databases, messaging, cloud."""
    kind = F.col("kind")
    part = F.when(kind == "database_connection", "databases").when(kind.isin("topic", "queue", "message_queue"), "messaging").when(kind.isin("azure_resource", "infra_resource"), "cloud")
    key = F.when(part == "databases", database_type()).when(part == "messaging", _prop_or_label("protocol")).otherwise(_prop_or_label("resource_type"))
    rows = nodes.select(part.alias("part"), key.alias("key")).filter("part IS NOT NULL AND key <> ''")
    return rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).orderBy("part", F.desc("n"), "key")


def _is_grpc() -> Column:
    return F.coalesce(F.lower(M.prop("protocol")) == "grpc", F.lit(False))


def connections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: rest, grpc, websocket, producers, consumers."""
    n = nodes.agg(F.count_if((F.col("kind") == "endpoint") & ~_is_grpc()).alias("rest"), F.count_if((F.col("kind") == "endpoint") & _is_grpc()).alias("grpc"), F.count_if(F.col("kind") == "websocket_endpoint").alias("websocket"))
    e = edges.agg(F.count_if(F.col("kind").isin("produces", "publishes")).alias("producers"), F.count_if(F.col("kind").isin("consumes", "listens")).alias("consumers"))
    return n.crossJoin(e)


def rest_by_method(nodes: DataFrame) -> DataFrame:
    method = M.prop("http_method")
    return counted(nodes.filter((F.col("kind") == "endpoint") & ~_is_grpc()), F.upper(F.when(method != "", method).otherwise("UNKNOWN")), "method")


def auth(nodes: DataFrame) -> DataFrame:
    kind, fw = M.prop("auth_type"), F.trim(M.prop("framework"))
    guard = F.col("kind") == "guard"
    x = F.when(guard, F.when(kind != "", kind).otherwise("unknown")).when(fw.startswith("auth:"), F.trim(F.substring(fw, 6, 1 << 20)))
    return counted(nodes.withColumn("x", x).filter("x <> ''"), F.col("x"), "auth_type")


def architecture(nodes: DataFrame) -> DataFrame:
    return counted(nodes.filter(F.col("kind").isin(list(_ARCHITECTURE))), lookup(_ARCHITECTURE, F.col("kind")), "part")


def auth_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: endpoints, protected ones, percent rounded to 0.1 (0 without endpoints)."""
    hit = edges.filter(F.col("kind") == "protects").select(F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(1))
    rows = nodes.filter(F.col("kind").isin("endpoint", "websocket_endpoint")).select("id").join(hit, "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("endpoints"), F.count("hit").alias("protected")).withColumn("coverage", F.when(F.col("endpoints") > 0, F.round(100.0 * F.col("protected") / F.col("endpoints"), 1)).otherwise(0.0))


def category(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame | None:
    """One category's statistics, its name in any case; None for an unknown one."""
    made = {"graph": lambda: graph(nodes, edges), "languages": lambda: languages(nodes), "frameworks": lambda: frameworks(nodes), "infra": lambda: infra(nodes), "connections": lambda: connections(nodes, edges), "auth": lambda: auth(nodes), "architecture": lambda: architecture(nodes)}.get(name.lower())
    return made() if made else None


def all_stats(nodes: DataFrame, edges: DataFrame) -> dict[str, list[dict]]:
    """Every category's rows in fixed order; each has as many as there are kinds of things."""
    return {c: [r.asDict() for r in category(nodes, edges, c).collect()] for c in CATEGORIES}
