"""Text search over labels and prose, routing by capability, and evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators.settle import settled

K1, B = 1.2, 0.75
# Which capabilities a kind of query needs, and what the analysis of each language offers.
DIMENSIONS = ["SYMBOL_DEFINITIONS", "SYMBOL_REFERENCES", "IMPORT_RESOLUTION", "TYPE_INFO", "CLASS_HIERARCHY", "FRAMEWORK_SEMANTICS", "ORM_ENTITY_MAPPING", "AUTH_SECURITY", "ASYNC_PATTERNS"]
QUERY_DIMENSIONS = {"FIND_SYMBOL": ["SYMBOL_DEFINITIONS"], "FIND_REFERENCES": ["SYMBOL_REFERENCES"], "FIND_CALLERS": ["SYMBOL_REFERENCES"], "FIND_DEPENDENCIES": ["IMPORT_RESOLUTION"], "SEARCH_TEXT": [], "FIND_CONFIG": ["FRAMEWORK_SEMANTICS"]}
CAPABILITIES = {
    "java": {
        "SYMBOL_DEFINITIONS": "EXACT",
        "SYMBOL_REFERENCES": "EXACT",
        "IMPORT_RESOLUTION": "EXACT",
        "TYPE_INFO": "EXACT",
        "CLASS_HIERARCHY": "EXACT",
        "FRAMEWORK_SEMANTICS": "EXACT",
        "ORM_ENTITY_MAPPING": "EXACT",
        "AUTH_SECURITY": "EXACT",
        "ASYNC_PATTERNS": "PARTIAL",
    },
    "typescript": {
        "SYMBOL_DEFINITIONS": "PARTIAL",
        "SYMBOL_REFERENCES": "PARTIAL",
        "IMPORT_RESOLUTION": "PARTIAL",
        "TYPE_INFO": "PARTIAL",
        "CLASS_HIERARCHY": "PARTIAL",
        "FRAMEWORK_SEMANTICS": "PARTIAL",
        "ORM_ENTITY_MAPPING": "PARTIAL",
        "AUTH_SECURITY": "PARTIAL",
        "ASYNC_PATTERNS": "PARTIAL",
    },
    "javascript": {
        "SYMBOL_DEFINITIONS": "PARTIAL",
        "SYMBOL_REFERENCES": "PARTIAL",
        "IMPORT_RESOLUTION": "PARTIAL",
        "TYPE_INFO": "LEXICAL_ONLY",
        "CLASS_HIERARCHY": "PARTIAL",
        "FRAMEWORK_SEMANTICS": "PARTIAL",
        "ORM_ENTITY_MAPPING": "PARTIAL",
        "AUTH_SECURITY": "PARTIAL",
        "ASYNC_PATTERNS": "PARTIAL",
    },
    "python": {
        "SYMBOL_DEFINITIONS": "PARTIAL",
        "SYMBOL_REFERENCES": "PARTIAL",
        "IMPORT_RESOLUTION": "PARTIAL",
        "TYPE_INFO": "LEXICAL_ONLY",
        "CLASS_HIERARCHY": "PARTIAL",
        "FRAMEWORK_SEMANTICS": "PARTIAL",
        "ORM_ENTITY_MAPPING": "PARTIAL",
        "AUTH_SECURITY": "PARTIAL",
        "ASYNC_PATTERNS": "PARTIAL",
    },
    "go": {
        "SYMBOL_DEFINITIONS": "PARTIAL",
        "SYMBOL_REFERENCES": "PARTIAL",
        "IMPORT_RESOLUTION": "PARTIAL",
        "TYPE_INFO": "PARTIAL",
        "CLASS_HIERARCHY": "LEXICAL_ONLY",
        "FRAMEWORK_SEMANTICS": "PARTIAL",
        "ORM_ENTITY_MAPPING": "PARTIAL",
        "AUTH_SECURITY": "LEXICAL_ONLY",
        "ASYNC_PATTERNS": "PARTIAL",
    },
    "csharp": {
        "SYMBOL_DEFINITIONS": "PARTIAL",
        "SYMBOL_REFERENCES": "PARTIAL",
        "IMPORT_RESOLUTION": "PARTIAL",
        "TYPE_INFO": "PARTIAL",
        "CLASS_HIERARCHY": "PARTIAL",
        "FRAMEWORK_SEMANTICS": "PARTIAL",
        "ORM_ENTITY_MAPPING": "PARTIAL",
        "AUTH_SECURITY": "PARTIAL",
        "ASYNC_PATTERNS": "PARTIAL",
    },
    "rust": {
        "SYMBOL_DEFINITIONS": "PARTIAL",
        "SYMBOL_REFERENCES": "PARTIAL",
        "IMPORT_RESOLUTION": "PARTIAL",
        "TYPE_INFO": "PARTIAL",
        "CLASS_HIERARCHY": "LEXICAL_ONLY",
        "FRAMEWORK_SEMANTICS": "PARTIAL",
        "ORM_ENTITY_MAPPING": "UNSUPPORTED",
        "AUTH_SECURITY": "LEXICAL_ONLY",
        "ASYNC_PATTERNS": "PARTIAL",
    },
    "cpp": {
        "SYMBOL_DEFINITIONS": "PARTIAL",
        "SYMBOL_REFERENCES": "PARTIAL",
        "IMPORT_RESOLUTION": "PARTIAL",
        "TYPE_INFO": "PARTIAL",
        "CLASS_HIERARCHY": "PARTIAL",
        "FRAMEWORK_SEMANTICS": "PARTIAL",
        "ORM_ENTITY_MAPPING": "UNSUPPORTED",
        "AUTH_SECURITY": "LEXICAL_ONLY",
        "ASYNC_PATTERNS": "PARTIAL",
    },
}
#: Languages known by their text alone, and all others.
LEXICAL_CAPABILITIES = {
    "SYMBOL_DEFINITIONS": "LEXICAL_ONLY",
    "SYMBOL_REFERENCES": "LEXICAL_ONLY",
    "IMPORT_RESOLUTION": "LEXICAL_ONLY",
    "TYPE_INFO": "UNSUPPORTED",
    "CLASS_HIERARCHY": "LEXICAL_ONLY",
    "FRAMEWORK_SEMANTICS": "LEXICAL_ONLY",
    "ORM_ENTITY_MAPPING": "UNSUPPORTED",
    "AUTH_SECURITY": "LEXICAL_ONLY",
    "ASYNC_PATTERNS": "LEXICAL_ONLY",
}
NO_CAPABILITIES = {
    "SYMBOL_DEFINITIONS": "UNSUPPORTED",
    "SYMBOL_REFERENCES": "UNSUPPORTED",
    "IMPORT_RESOLUTION": "UNSUPPORTED",
    "TYPE_INFO": "UNSUPPORTED",
    "CLASS_HIERARCHY": "UNSUPPORTED",
    "FRAMEWORK_SEMANTICS": "UNSUPPORTED",
    "ORM_ENTITY_MAPPING": "UNSUPPORTED",
    "AUTH_SECURITY": "UNSUPPORTED",
    "ASYNC_PATTERNS": "UNSUPPORTED",
}
LEXICAL_LANGUAGES = "kotlin scala ruby php shell bash powershell markdown proto hcl terraform dockerfile yaml json toml ini properties xml sql".split()
ALIASES = {"c#": "csharp", "c++": "cpp"}


def clamp(limit: int) -> int:
    """50 where not positive, at most 200."""
    return 50 if limit <= 0 else min(limit, 200)


def label_search(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    q = query.strip().lower()
    return M.compact(nodes.filter(F.lower("label").contains(q) | F.lower("fqn").contains(q))).orderBy("id").limit(clamp(limit))


def lexical_search(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    q = query.strip().lower()
    hit = F.lower(F.coalesce(M.prop("lex_comment"), F.lit(""))).contains(q) | F.lower(F.coalesce(M.prop("lex_config_keys"), F.lit(""))).contains(q)
    return M.compact(nodes.filter(hit)).orderBy("id").limit(clamp(limit))


def config_key_search(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Kinds are checked after the limit."""
    return lexical_search(nodes, query, limit).filter(F.col("kind").isin("config_key", "config_file", "config_definition"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+"), lambda t: t != "")


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf, size) of each document."""
    t = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t")).withColumn("size", F.size("t"))
    return t.select("key", "size", F.explode("t").alias("token")).groupBy("key", "size", "token").agg(F.count(F.lit(1)).alias("tf"))


def query_words(query: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9_]+", query.lower()) if w]


def hits(docs: DataFrame, key: str, text: str, words: list[str]) -> tuple[DataFrame, DataFrame]:
    """The part of the inverted index that ``words`` ask for (one word is a prefix), and the number and mean size of all documents.

    Other words leave a document within its row, before anything is exploded or grouped.
    """
    t = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    asked = (lambda x: x.startswith(words[0])) if len(words) == 1 else (lambda x: x.isin(words))
    some = t.select("key", F.size("t").alias("size"), F.explode(F.filter("t", asked)).alias("token"))
    sizes = t.filter(F.size("t") > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean"))
    return some.groupBy("key", "size", "token").agg(F.count(F.lit(1)).alias("tf")), sizes


def index_hits(index: DataFrame, words: list[str]) -> tuple[DataFrame, DataFrame]:
    """As ``hits``, from a stored inverted index."""
    sizes = index.groupBy("key").agg(F.first("size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    return index.filter(F.col("token").startswith(words[0]) if len(words) == 1 else F.col("token").isin(words)), sizes


def ranked(hit: DataFrame, sizes: DataFrame, words: list[str], limit: int = 50, digits: int = 9) -> DataFrame:
    """(key, score) by BM25 of documents with every word of the query; a single word counts as a prefix. Score first, then key.

    Scores that agree in ``digits`` decimals are equal in this order: the sums' last bits depend on the order of their parts.
    """
    df = hit.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = sizes.first()  # two numbers
    idf = F.log(1 + (F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(total["mean"])))
    scored = hit.join(df, "token").groupBy("key").agg(F.sum(part).alias("score"), F.count_distinct("token").alias("met"))
    scored = scored if len(words) == 1 else scored.filter(F.col("met") == len(set(words)))
    return scored.select("key", "score").orderBy(F.desc(F.round("score", digits)), "key").limit(clamp(limit))


def bm25(index: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Ranked search in a stored inverted index."""
    words = query_words(query)
    return ranked(*index_hits(index, words), words, limit) if words else index.limit(0).select("key", F.lit(0.0).alias("score"))


def bm25_documents(docs: DataFrame, key: str, text: str, query: str, limit: int = 50, digits: int = 9) -> DataFrame:
    """Ranked search straight over documents."""
    words = query_words(query)
    return ranked(*hits(docs, key, text, words), words, limit, digits) if words else docs.limit(0).select(F.col(key).alias("key"), F.lit(0.0).alias("score"))


def node_text(nodes: DataFrame, fields: str = "label") -> DataFrame:
    """(id, text) of what the label index (label and fqn) or the lexical one (comment and config keys) covers."""
    parts = ["label", "fqn"] if fields == "label" else [M.prop("lex_comment"), M.prop("lex_config_keys")]
    return nodes.select("id", F.concat_ws(" ", *parts).alias("text"))


def text_search(nodes: DataFrame, query: str, fields: str = "label", limit: int = 50, index=None) -> DataFrame:
    """Compact rows by rank from the index over node fields, the stored one if it is given; where it finds nothing, the scan for
    the query as part of a text."""
    found = index.search(query, limit) if index is not None else bm25_documents(node_text(nodes, fields), "id", "text", query, limit)
    rows = M.compact(nodes).join(F.broadcast(found.withColumnRenamed("key", "id")), "id")
    if not rows.isEmpty():
        return rows.orderBy(F.desc(F.round("score", 9)), "id")
    scan = label_search if fields == "label" else lexical_search
    return scan(nodes, query, limit).withColumn("score", F.lit(0.0))


def find_node(nodes: DataFrame, query: str, limit: int = 50, lexical: bool = True) -> DataFrame:
    """Label matches, then prose matches not among them; names equal but for case come first."""
    a = label_search(nodes, query, limit).withColumn("pass", F.lit(0))
    rows = a.unionByName(lexical_search(nodes, query, limit).withColumn("pass", F.lit(1))) if lexical else a
    once = rows.groupBy("id", "kind", "label", "file_path", "layer").agg(F.min("pass").alias("pass"))
    rank = F.when(F.lower("label") == query.strip().lower(), 0).otherwise(1)
    return once.withColumn("rank", rank).orderBy("rank", "pass", "id").limit(clamp(limit)).drop("pass")


def capability(language: str | None) -> dict[str, str]:
    name = (language or "").strip().lower()
    name = ALIASES.get(name, name)
    return CAPABILITIES.get(name, LEXICAL_CAPABILITIES if name in LEXICAL_LANGUAGES else NO_CAPABILITIES)


def route(query_type: str, language: str | None) -> str:
    if query_type == "SEARCH_TEXT":
        return "LEXICAL_FIRST"
    levels = {capability(language)[d] for d in QUERY_DIMENSIONS.get(query_type, [])}
    if not levels or "UNSUPPORTED" in levels:
        return "DEGRADED"
    if "PARTIAL" in levels or {"LEXICAL_ONLY", "EXACT"} <= levels:
        return "MERGED"
    return "LEXICAL_FIRST" if "LEXICAL_ONLY" in levels else "GRAPH_FIRST"


def plan(query_type: str, language: str | None) -> dict:
    """Route, capabilities, and a note where results will be poorer."""
    way = route(query_type, language)
    named = ", ".join(d.lower().replace("_", " ") for d in QUERY_DIMENSIONS.get(query_type, []))
    who = f"'{language}'" if language and language.strip() else "this language"
    note = ""
    if way == "DEGRADED":
        note = f"{query_type} has no structural analysis of {named or 'anything'} for {who}; SEARCH_TEXT still works."
    elif way == "LEXICAL_FIRST" and query_type != "SEARCH_TEXT":
        note = f"{query_type} for {who} is by text alone: no analysis of {named}."
    return {"query_type": query_type, "language": language, "route": way, "capabilities": capability(language), "note": note}


def capability_rows(languages: DataFrame) -> DataFrame:
    """(language, dimension, level) of each of ``languages`` (language). What is known of languages is a table of fixed size."""
    spark, known = languages.sparkSession, sorted({*CAPABILITIES, *LEXICAL_LANGUAGES})
    name = F.lower(F.trim("language"))
    for alias, real in ALIASES.items():
        name = F.when(name == alias, real).otherwise(name)
    levels = spark.createDataFrame([(x, d, v) for x in known for d, v in capability(x).items()], "name string, dimension string, level string")
    each = languages.select("language", name.alias("name"), F.explode(F.array(*map(F.lit, NO_CAPABILITIES))).alias("dimension"))
    return each.join(F.broadcast(levels), ["name", "dimension"], "left").select("language", "dimension", F.coalesce("level", F.lit("UNSUPPORTED")).alias("level"))


def route_rows(languages: DataFrame) -> DataFrame:
    """(query_type, language, route) for every kind of query in each of ``languages``, as ``route`` tells."""
    spark = languages.sparkSession
    asked = spark.createDataFrame([(q, d) for q, ds in QUERY_DIMENSIONS.items() for d in ds], "query_type string, dimension string")
    levels = capability_rows(languages).join(F.broadcast(asked), "dimension").groupBy("query_type", "language").agg(F.collect_set("level").alias("levels"))
    has = lambda x: F.array_contains("levels", x)
    way = F.when(has("UNSUPPORTED"), "DEGRADED").when(has("PARTIAL") | (has("LEXICAL_ONLY") & has("EXACT")), "MERGED").when(has("LEXICAL_ONLY"), "LEXICAL_FIRST").otherwise("GRAPH_FIRST")
    rest = [q for q, ds in QUERY_DIMENSIONS.items() if not ds or q == "SEARCH_TEXT"]
    text = languages.select(F.explode(F.array(*map(F.lit, [*rest, *([] if "SEARCH_TEXT" in rest else ["SEARCH_TEXT"])]))).alias("query_type"), "language")
    text = text.withColumn("route", F.when(F.col("query_type") == "SEARCH_TEXT", "LEXICAL_FIRST").otherwise("DEGRADED"))
    return levels.filter(F.col("query_type") != "SEARCH_TEXT").select("query_type", "language", way.alias("route")).unionByName(text)


def capability_table(spark: SparkSession, languages: list[str]) -> DataFrame:
    return spark.createDataFrame([(x, d, v) for x in languages for d, v in capability(x).items()], "language string, dimension string, level string")


def guess_language(query: str) -> str | None:
    return "java" if re.fullmatch(r"[\w$]+(?:\.[\w$]+){2,}", query) else None


def snippet(files: DataFrame, nodes: DataFrame, context: int = 3, most: int = 50) -> DataFrame:
    """(id, snippet, first_line): the lines of each node with some around, at most ``most``, centred."""
    lines = F.split("content", "\n")
    start = F.greatest(F.lit(1), F.col("line_start") - context)
    end = F.least(F.size(lines).cast("long"), F.coalesce("line_end", "line_start") + context)
    n = end - start + 1
    from_ = F.when(n > most, start + F.floor((n - most) / 2)).otherwise(start)
    rows = nodes.filter("line_start > 0").join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    return rows.select("id", F.array_join(F.slice(lines, from_.cast("int"), F.greatest(F.lit(0), F.least(n, F.lit(most))).cast("int")), "\n").alias("snippet"), from_.alias("first_line"))


def provenance(nodes: DataFrame) -> DataFrame:
    """Place, kind and prov_ properties of nodes, the latter as sorted ``name=value`` texts."""
    kept = F.map_entries(F.map_filter("props", lambda k, _: k.startswith("prov_")))
    return nodes.select("id", "kind", "file_path", "line_start", "line_end", F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("provenance"))


def references(nodes: DataFrame, edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Callers and dependents of matches that aren't matches."""
    hit = edges.filter(F.col("kind").isin("calls", "depends_on")).join(matches.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return M.compact(nodes.join(hit, "id", "left_semi").join(matches.select("id"), "id", "left_anti")).orderBy("id")


def evidence_pack(nodes: DataFrame, edges: DataFrame, symbol: str | None = None, path: str | None = None, limit: int = 20) -> DataFrame:
    """(part, id, kind, label, file_path): the matches of a symbol or file, and what refers to them."""
    found = label_search(nodes, symbol, limit) if symbol else M.compact(nodes.filter(F.col("file_path") == path)).orderBy("id").limit(limit)
    found = settled(found)  # at most ``limit`` rows, read again for what refers to them
    refs = references(nodes, edges, found)
    rows = found.withColumn("part", F.lit("match")).unionByName(refs.withColumn("part", F.lit("reference")))
    return rows.select("part", "id", "kind", "label", "file_path").orderBy("part", "id")


def related_files(pack: DataFrame) -> DataFrame:
    """(file_path, parts): the distinct files of an evidence pack's rows."""
    return pack.filter("file_path <> ''").groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("parts")).orderBy("file_path")


def full_evidence(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, symbol: str | None = None, path: str | None = None, query_type: str = "FIND_SYMBOL", language: str | None = None, limit: int = 20) -> DataFrame:
    """The evidence pack with, for each row, its snippet and provenance, and the same level and note on all rows.

    The level is the weakest capability that the query's kind needs in the language (guessed from the symbol if not given).
    """
    pack = settled(evidence_pack(nodes, edges, symbol, path, limit))
    own = nodes.join(pack.select("id"), "id", "left_semi")
    told = plan(query_type, language or guess_language(symbol or ""))
    weakest = ["UNSUPPORTED", "LEXICAL_ONLY", "PARTIAL", "EXACT"]
    level = min((told["capabilities"][d] for d in QUERY_DIMENSIONS.get(query_type, [])), key=weakest.index, default="UNSUPPORTED")
    out = pack.join(provenance(own).select("id", "provenance"), "id", "left")
    out = out.join(snippet(files, own), "id", "left") if files is not None else out.withColumns({"snippet": F.lit(None).cast("string"), "first_line": F.lit(None).cast("long")})
    return out.withColumns({"level": F.lit(level), "note": F.lit(told["note"])}).orderBy("part", "id")
