"""The layer of a node, by ordered rules in one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import model as M

# Kinds, languages, frameworks and patterns that decide.
FRONTEND_KINDS = ["component", "hook"]
BACKEND_KINDS = ["guard", "middleware", "endpoint", "repository", "database_connection", "query", "entity", "migration", "service", "topic", "queue", "event", "message_queue", "rmi_interface", "websocket_endpoint"]
INFRA_KINDS = ["infra_resource", "azure_resource", "azure_function", "sql_entity"]
SHARED_KINDS = ["config_file", "config_key", "config_definition", "protocol_message"]
INFRA_LANGUAGES = ["terraform", "bicep", "dockerfile"]
FRONTEND_FRAMEWORKS = ["react", "vue", "angular", "svelte", "nextjs"]
BACKEND_FRAMEWORKS = ["express", "nestjs", "flask", "django", "fastapi", "spring", "spring_boot", "spring_mvc", "spring_data", "spring_security", "gin", "echo", "fiber", "actix", "rocket", "axum", "asp.net", "koa", "hapi", "fastify"]
FRONTEND_EXT = r"\.(?:tsx|jsx)$"
FRONTEND_PATH = r"(?:^|/)(?:src/)?(?:components|pages|views|app/ui|public)/"
BACKEND_PATH = r"(?:^|/)(?:src/)?(?:server|api|controllers|services|routes|handlers)/"
FRONTEND_PACKAGE = r"(?i)(?:^|/|\.)(?:components|views|pages|ui|widgets|screens|templates|layouts)(?:/|\.|$)"
BACKEND_PACKAGE = r"(?i)(?:^|/|\.)(?:controller|controllers|api|web|rest|resource|resources|model|models|entity|entities|domain|dto|dtos|repository|repositories|dao|persistence|service|services|business|logic|routes|handlers|handler|middleware|middlewares|schemas)(?:/|\.|$)"
SHARED_PACKAGE = r"(?i)(?:^|/|\.)(?:config|configuration|util|utils|helper|helpers|common|shared|exception|exceptions|constants|enums)(?:/|\.|$)"


def layer() -> Column:
    kind, path = F.col("kind"), F.coalesce("file_path", F.lit(""))
    both = F.concat(path, F.lit("|"), F.col("id"))
    jvm = path.rlike(r"\.(?:java|kt|scala)$") & path.rlike(r"src/main/(?:java|kotlin)/")
    rules = [
        (kind.isin(FRONTEND_KINDS), "frontend"), (kind.isin(BACKEND_KINDS), "backend"), (kind.isin(INFRA_KINDS) | M.prop("language").isin(INFRA_LANGUAGES), "infra"),
        (path.rlike(FRONTEND_EXT) | path.rlike(FRONTEND_PATH), "frontend"), (path.rlike(BACKEND_PATH), "backend"),
        (M.prop("framework").isin(FRONTEND_FRAMEWORKS), "frontend"), (M.prop("framework").isin(BACKEND_FRAMEWORKS), "backend"),
        (kind.isin(SHARED_KINDS), "shared"), (both.rlike(FRONTEND_PACKAGE), "frontend"), (both.rlike(BACKEND_PACKAGE), "backend"), (both.rlike(SHARED_PACKAGE), "shared"), (jvm, "backend"),
    ]
    out = F.when(*[rules[0][0], rules[0][1]])
    for rule, name in rules[1:]:
        out = out.when(rule, name)
    return out.otherwise("unknown")


def classify(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("layer", layer())
