import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators import flow, gate, layers, linkers, merge, search, stats, topology, traversal
from weftgraph.operators import neighbours as N


def graph(spark, nodes, edges):
    """nodes: (id, kind, label, file_path, layer, props); edges: (src, kind, dst)."""
    n = [(i, k, x, "", f, None, None, "", y, "LEXICAL", "", [], p) for i, k, x, f, y, p in nodes]
    e = [(f"{a}|{k}|{b}", k, a, b, "LEXICAL", "", {}) for a, k, b in edges]
    return spark.createDataFrame(n, M.NODES).coalesce(1).cache(), spark.createDataFrame(e, M.EDGES).coalesce(1).cache()


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.fixture(scope="module")
def services(spark):
    nodes = [(x, "class", x, "", "backend", {}) for x in "ABCDEF"]
    return graph(spark, nodes, [("A", "depends_on", "B"), ("A", "produces", "B"), ("D", "depends_on", "B"), ("D", "produces", "B"), ("B", "calls", "A"), ("D", "calls", "A"), ("B", "depends_on", "C"), ("B", "calls", "C"), ("F", "consumes", "B")])


def test_neighbours(services):
    n, e = services
    assert ids(N.consumers(n, e, "B")) == ["F"]
    assert ids(N.producers(n, e, "B")) == ["A", "D"]
    assert ids(N.callers(n, e, "A")) == ["B", "D"]
    assert ids(N.dependencies(n, e, "A")) == ["B"]
    assert ids(N.dependents(n, e, "B")) == ["A", "D"]
    assert ids(N.dead_code(n, e)) == ids(N.dead_code(n, e, ["class"])) == ["D", "E", "F"]
    assert ids(N.find_by_kind(n, "class", -1, 2)) == ["A", "B"]
    assert N.limited(n, 2)[1] and not N.limited(n, 6)[1]
    assert [r["target"] for r in N.query_edges(e, "Consumes", 5).collect()] == ["B"]


def test_paths(services):
    n, e = services
    assert traversal.shortest_path(n, e, "A", "C") == ["A", "B", "C"]
    assert traversal.shortest_path(n, e, "A", "E") == []
    assert traversal.shortest_path(n, e, "A", "A") == ["A"]
    assert [r["path"] for r in traversal.cycles(e).collect()] == [["A", "B"]]
    assert {r["id"]: r["hops"] for r in traversal.blast_radius(n, e, "D", 0).collect()} == {"A": 1, "B": 1, "C": 2}
    assert set(ids(traversal.blast_radius(n, e, "A", 3, include_start=True))) == {"A", "B", "C"}
    assert ids(traversal.ego_graph(n, e, "C", 1)) == ["B"]


@pytest.fixture(scope="module")
def shop(spark):
    nodes = [
        ("svc:checkout", "service", "checkout", "", "backend", {"build_tool": "maven", "endpoint_count": "1", "entity_count": "1"}), ("svc:billing", "service", "billing", "", "backend", {"build_tool": "maven", "entity_count": "1"}), ("ep:pay", "endpoint", "POST /pay", "checkout/PayController.java", "backend", {"http_method": "POST"}),
        ("entity:Order", "entity", "Order", "checkout/Order.java", "backend", {}), ("guard:Jwt", "guard", "JwtFilter", "checkout/JwtFilter.java", "backend", {"auth_type": "jwt"}), ("db:primary", "database_connection", "primary", "checkout/application.yml", "infra", {"db_type": "postgres"}),
        ("topic:created", "topic", "checkout.created", "checkout/EventConfig.java", "infra", {"protocol": "kafka"}), ("entity:Invoice", "entity", "Invoice", "billing/Invoice.java", "backend", {}),
    ]
    own = [("svc:checkout", "contains", x) for x in ("ep:pay", "entity:Order", "guard:Jwt", "db:primary", "topic:created")]
    return graph(spark, nodes, [*own, ("svc:billing", "contains", "entity:Invoice"), ("ep:pay", "calls", "entity:Invoice")])


def test_topology(spark, shop):
    n, e = shop
    rows = {r["label"]: r for r in topology.summary(n, e).collect()}
    assert (rows["checkout"]["connections_out"], rows["billing"]["connections_in"], rows["checkout"]["endpoint_count"], rows["billing"]["endpoint_count"]) == (1, 1, 1, 0)
    assert [tuple(r) for r in topology.connections(n, e).collect()] == [("checkout", "billing", "calls")]
    assert [r["bucket"] for r in topology.service_detail(n, e, "checkout").collect()] == ["databases", "endpoints", "entities", "guards", "queues"]
    assert [r["label"] for r in topology.dead_services(n, e).collect()] == ["checkout"]
    assert topology.service_path(n, e, "checkout", "billing") == [{"from": "checkout", "to": "billing", "type": "calls"}]
    assert topology.service_path(n, e, "billing", "checkout") is None
    assert topology.service_path(n, e, "billing", "billing") == []
    assert topology.service_cycles(n, e) == []
    back = e.unionByName(spark.createDataFrame([("x", "queries", "entity:Invoice", "entity:Order", "LEXICAL", "", {})], M.EDGES))
    assert topology.service_cycles(n, back) == [["billing", "checkout"]]
    assert [r["service"] for r in traversal.affected_services(n, e, traversal.blast_radius(n, e, "ep:pay")).collect()] == ["billing"]
    assert ids(N.related_endpoints(n, e, "Order")) == ["ep:pay"]
    assert N.component_by_file(n, e, "billing/Invoice.java").first()["service"] == "billing"
    assert "- entity Invoice" in N.evidence_text(n, e, "billing/Invoice.java").first()["text"]


def test_stats(shop):
    n, e = shop
    assert stats.connections(n, e).first().asDict() == {"rest": 1, "grpc": 0, "websocket": 0, "producers": 0, "consumers": 0}
    assert {(r["part"], r["key"]) for r in stats.infra(n).collect()} == {("databases", "PostgreSQL"), ("messaging", "kafka")}
    assert list(stats.all_stats(n, e)) == stats.CATEGORIES
    assert stats.category(n, e, "nothing") is None
    assert stats.auth_coverage(n, e).first()["coverage"] == 0.0
    assert {r["language"]: r["n"] for r in stats.languages(n).collect()} == {"java": 5, "yaml": 1}


def test_flow(shop):
    n, e = shop
    for view in flow.VIEWS:
        d = flow.generate(n, e, view)
        for form in ("json", "yaml", "mermaid", "dot"):
            assert flow.render(d, form) == flow.render(d, form)
    assert "n_endpoints{{" in flow.render(flow.generate(n, e, "overview"), "mermaid")
    with pytest.raises(KeyError):
        flow.generate(n, e, "other")
    with pytest.raises(ValueError, match="unknown"):
        flow.render(d, "png")
    assert len(flow.graph_diagram(n, e).edges) == 7


def fold(reports):
    """The merge, one report after the other."""
    rank, kept = {"LEXICAL": 0, "SYNTACTIC": 1, "RESOLVED": 2}, None
    for r in reports:
        if kept is None:
            kept = {**r, "props": dict(r["props"]), "annotations": set(r["annotations"])}
            continue
        a, b = (r, kept) if rank[r["confidence"]] > rank[kept["confidence"]] else (kept, r)
        kept = {**a, "fqn": a["fqn"] or b["fqn"], "layer": a["layer"] if a["layer"] != "unknown" else b["layer"], "props": {**b["props"], **a["props"]}, "annotations": set(a["annotations"]) | set(b["annotations"])}
    return kept


def test_merge_equals_a_fold(spark):
    r, reports, groups = random.Random(1), [], {}
    for g, levels in enumerate(x for n in range(1, 5) for x in itertools.product(["LEXICAL", "SYNTACTIC", "RESOLVED"], repeat=n)):
        for c in levels:
            one = {"confidence": c, "label": f"l{len(reports)}", "fqn": r.choice(["", f"f{len(reports)}"]), "layer": r.choice(["unknown", "infra", "shared"]), "props": {k: str(len(reports)) for k in r.sample("abc", r.randint(0, 3))}, "annotations": r.sample("xyz", r.randint(0, 2))}
            groups.setdefault(f"g{g}", []).append(one)
            reports.append((f"g{g}", "class", one["label"], one["fqn"], "", None, None, "", one["layer"], c, "", one["annotations"], one["props"], len(reports)))
    got = merge.merge_nodes(spark.createDataFrame(reports, M.NODES.add("seq", "long") if False else "id string, kind string, label string, fqn string, file_path string, line_start long, line_end long, module string, layer string, confidence string, source string, annotations array<string>, props map<string,string>, seq long").repartition(3), ["seq"])
    for row in got.collect():
        want = fold(groups[row["id"]])
        assert (row["confidence"], row["label"], row["fqn"] or "", row["layer"], row["props"], set(row["annotations"])) == (want["confidence"], want["label"], want["fqn"], want["layer"], want["props"], want["annotations"])
        assert row["annotations"] == sorted(row["annotations"])


def test_linkers(spark):
    nodes = [("t1", "topic", "orders", "", "infra", {}), ("t2", "queue", "orders", "", "infra", {}), ("p", "class", "p", "", "", {}), ("c", "class", "c", "", "", {}), ("e:User", "entity", "User", "", "", {}), ("r1", "repository", "UserRepository", "", "", {}), ("r2", "repository", "userDAO", "", "", {}), ("r3", "repository", "OtherRepo", "", "", {})]
    n, e = graph(spark, nodes, [("p", "produces", "t1"), ("c", "listens", "t2"), ("p", "consumes", "t2"), ("r1", "queries", "e:User")])
    assert [(x["src"], x["dst"]) for x in linkers.link_topics(n, e).collect()] == [("p", "c")]
    assert [(x["src"], x["dst"]) for x in linkers.link_entities(n, e).collect()] == [("r2", "e:User")]
    m = n.withColumn("module", F.when(F.col("kind") == "class", "core").otherwise(""))
    modules, links = linkers.link_modules(m, e)
    assert (ids(modules), sorted(x["dst"] for x in links.collect())) == (["module:core"], ["c", "p"])
    assert N.drop_dangling(n, e.unionByName(e.withColumn("dst", F.lit("gone")))).count() == e.count()
    paths, dirs = spark.createDataFrame([("a/b/x.py",), ("a/bc/y.py",), ("z.py",)], "path string"), spark.createDataFrame([("",), ("a",), ("a/b",)], "dir string")
    assert dict(map(tuple, linkers.longest_prefix(paths, dirs).collect())) == {"a/b/x.py": "a/b", "a/bc/y.py": "a", "z.py": ""}


@pytest.mark.parametrize(("kind", "path", "props", "want"), [("component", "x", {}, "frontend"), ("guard", "a.tsx", {}, "backend"), ("class", "a.tf", {"language": "terraform"}, "infra"), ("class", "web/a.jsx", {}, "frontend"), ("class", "src/pages/a.ts", {}, "frontend"), ("class", "src/api/a.ts", {}, "backend"), ("class", "lib/a.py", {"framework": "flask"}, "backend"), ("config_key", "x.yml", {}, "shared"), ("class", "com/acme/dto/A.java", {}, "backend"), ("class", "com/acme/util/A.java", {}, "shared"), ("class", "src/main/java/A.java", {}, "backend"), ("class", "A.txt", {}, "unknown")])
def test_layers(spark, kind, path, props, want):
    n, _ = graph(spark, [("x1", kind, "x", path, "unknown", props)], [("a", "calls", "b")])
    assert layers.classify(n).first()["layer"] == want


def test_search(spark):
    nodes = [("1", "class", "UserService", "a.py", "", {"lex_comment": "Finds people"}), ("2", "class", "user", "b.py", "", {"lex_config_keys": "people.max"}), ("3", "config_key", "max", "c.yml", "", {"lex_config_keys": "people.max"})]
    n, e = graph(spark, nodes, [("1", "calls", "2"), ("3", "depends_on", "1")])
    assert ids(search.label_search(n, " USER ")) == ["1", "2"]
    assert ids(search.find_node(n, "User")) == ["2", "1"]
    assert ids(search.lexical_search(n, "people")) == ["1", "2", "3"]
    assert ids(search.config_key_search(n, "people")) == ["3"]
    assert ids(search.references(n, e, n.filter("id = '2'"))) == ["1"]
    assert [(r["part"], r["id"]) for r in search.evidence_pack(n, e, symbol="user").collect()] == [("match", "1"), ("match", "2"), ("reference", "3")]
    assert search.route("FIND_SYMBOL", "Java ") == "GRAPH_FIRST"
    assert search.route("FIND_REFERENCES", "kotlin") == "LEXICAL_FIRST"
    assert search.route("FIND_SYMBOL", "cobol") == search.route("NOTHING", "java") == "DEGRADED"
    assert search.route("FIND_CONFIG", "c#") == "MERGED"
    assert "cobol" in search.plan("FIND_SYMBOL", "cobol")["note"]
    assert search.guess_language("com.acme.User") == "java"
    assert [search.clamp(x) for x in (0, 7, 999)] == [50, 7, 200]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "red red red"), (3, "blue sky"), (4, None)], "k long, t string")
    index = search.inverted_index(docs, "k", "t")
    assert [r["key"] for r in search.bm25(index, "red").collect()] == [2, 1]
    assert [r["key"] for r in search.bm25(index, "red fox").collect()] == [1]
    assert [r["key"] for r in search.bm25(index, "sk").collect()] == [3]
    assert search.bm25(index, " ?").count() == 0


@pytest.mark.parametrize(("query", "word"), [("MATCH (n) RETURN n", None), ("match (n) detach delete n", "DETACH"), ("/* CREATE */ MATCH (n) // DROP\n RETURN n.created_at", None), ("CALL db.labels()", None), ("CALL show_tables()", None), ("CALL apoc.create.node()", "CALL apoc.create"), ("LOAD  CSV FROM 'x'", "LOAD  CSV"), ("MATCH (n) SET n.x = 1", "SET")])
def test_gate(query, word):
    assert gate.mutation_keyword(query) == word


def test_sql_gate(spark, services):
    n, e = services
    assert gate.run_query(spark, "SELECT count(*) AS c FROM {nodes} n JOIN {edges} e ON n.id = e.src", n, e).first()["c"] == 9
    for bad in ("DROP TABLE x", "INSERT INTO x SELECT 1", "CREATE TABLE x AS SELECT 1", "nonsense"):
        with pytest.raises(ValueError, match="only queries"):
            gate.run_query(spark, bad, n, e)


def test_caps_and_domains(spark, shop):
    assert [M.cap_results(x) for x in (0, 3, 9999)] == [1, 3, 500]
    assert [M.cap_depth(x, 0) for x in (0, 3, 99)] == [1, 3, 10]
    assert M.invalid_kinds(*shop).count() == 0
    assert (len(M.NODE_KINDS), len(M.EDGE_KINDS)) == (34, 28)
