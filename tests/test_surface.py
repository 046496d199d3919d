import json
import os
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.detectors import catalogue, engine
from weftgraph.operators import search, tools
from weftgraph.plans import build, specimens
from weftgraph.queries import ORACLES, QUERIES
from weftgraph.sources import files as S
from weftgraph.sources import graph_store as G
from weftgraph.sources import structured
from weftgraph.streaming import refresh as R

SMALLEST = "/root/testdata/sf0.001"


def test_every_detector_has_a_specimen():
    assert {s.detector for s in specimens.SPECIMENS} == set(catalogue.all_detectors())


@pytest.mark.parametrize("s", specimens.SPECIMENS, ids=lambda s: s.detector)
def test_specimens(s):
    d = catalogue.all_detectors()[s.detector]
    assert s.language in d.languages
    run = lambda text: d.run(engine.File(s.path, s.language, text, structured.parse(s.language, text)))
    found = run(s.text)
    assert [(n["kind"], n["label"]) for n in found.nodes] == s.nodes
    assert [(e["kind"], e["dst"]) for e in found.edges] == s.edges
    assert engine.check_domains(found.nodes, found.edges) == []
    again = run(s.text)
    assert (again.nodes, again.edges) == (found.nodes, found.edges)


def test_specimens_are_told_apart():
    """A detector that looks for words of its own gives nothing on the other specimens of its language that lack them."""
    quiet = 0
    for d in catalogue.all_detectors().values():
        for s in specimens.SPECIMENS:
            if d.needs and s.language in d.languages and s.detector != d.name and not any(x in s.text for x in d.needs):
                out = d.run(engine.File(s.path, s.language, s.text, structured.parse(s.language, s.text)))
                assert (out.nodes, out.edges) == ([], [])
                quiet += 1
    assert quiet > 100


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="the tables aren't there")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_has_rows(spark, name):
    assert not QUERIES[name](spark, SMALLEST).isEmpty()


MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(MIDDLE), reason="the tables aren't there")
@pytest.mark.parametrize("name", ["dead_code", "dead_code_entities", "dead_services", "manifest_diff_tree", "node_components", "reach_of_services", "review_evidence"])
def test_rows_at_the_scale_of_the_comparison(spark, name):
    assert not QUERIES[name](spark, MIDDLE).isEmpty()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def graph(spark):
    node = lambda i, kind, label, path: (i, kind, label, "", path, 1, 2, "", "backend", "LEXICAL", "", [], {})
    edge = lambda a, k, b: (f"{a}|{k}|{b}", k, a, b, "LEXICAL", "", {})
    n = spark.createDataFrame([node("s", "service", "shop", "shop/pom.xml"), node("a", "class", "Cart", "shop/Cart.java"), node("b", "method", "addItem", "shop/Cart.java"), node("c", "endpoint", "GET /cart", "shop/Api.java")], M.NODES)
    e = spark.createDataFrame([edge("s", "contains", "a"), edge("s", "contains", "c"), edge("a", "defines", "b"), edge("c", "calls", "b")], M.EDGES)
    return tools.Graph(n, e, spark.createDataFrame([("shop/Cart.java", "one\ntwo\nthree")], "path string, content string"))


@pytest.mark.parametrize(("tool", "args", "ids"), [
    ("find_in_graph", {"mode": "nodes", "kind": "class"}, ["a"]), ("find_in_graph", {"mode": "text", "query": "cart"}, ["a", "c"]), ("find_in_graph", {"mode": "fuzzy", "query": "Cart"}, ["a", "c"]), ("find_in_graph", {"mode": "by_file", "file_path": "shop/Cart.java"}, ["a", "b"]), ("find_in_graph", {"mode": "by_endpoint", "node_id": "Cart"}, ["c"]),
    ("inspect_node", {"mode": "neighbors", "node_id": "a"}, ["s", "b"]), ("inspect_node", {"mode": "neighbors", "node_id": "a", "direction": "out"}, ["b"]), ("inspect_node", {"mode": "ego", "center": "b", "radius": 1}, ["a", "c"]), ("inspect_node", {"mode": "evidence", "node_id": "Cart"}, ["a", "c"]),
    ("trace_relationships", {"mode": "callers", "node_id": "b"}, ["c"]), ("trace_relationships", {"mode": "shortest_path", "from": "s", "to": "b"}, ["s", "a", "b"]),
    ("analyze_impact", {"mode": "blast_radius", "node_id": "s"}, ["a", "c"]), ("analyze_impact", {"mode": "trace", "node_id": "s"}, ["a", "b", "c"]), ("analyze_impact", {"mode": "dead_code", "kind": "class"}, ["a"]), ("analyze_impact", {"mode": "dead_services"}, ["s"]),
    ("topology_view", {"mode": "service", "service_name": "shop"}, ["c"]), ("run_query", {"query": "SELECT id FROM {nodes} WHERE kind = 'method'"}, ["b"]),
])
def test_tools(graph, tool, args, ids):
    out = tools.call(graph, tool, args)
    assert not isinstance(out, dict), out
    assert sorted(r["id"] for r in out.collect()) == sorted(ids)


def test_tools_of_texts(graph):
    pack = tools.call(graph, "inspect_node", {"mode": "evidence", "node_id": "Cart"}).first()
    assert (pack["part"], pack["snippet"], pack["level"]) == ("match", "one\ntwo\nthree", "UNSUPPORTED")
    assert json.loads(tools.call(graph, "topology_view", {"mode": "flow", "view": "runtime"}).first()["text"])["title"] == "Runtime"
    assert tools.call(graph, "graph_summary").count() == 4
    assert {r["level"] for r in tools.call(graph, "graph_summary", {"mode": "capabilities", "language": "go"}).collect()} == {"PARTIAL", "LEXICAL_ONLY"}


@pytest.mark.parametrize(("tool", "args", "code"), [
    ("nope", {}, "INVALID_INPUT"), ("find_in_graph", {}, "INVALID_INPUT"), ("find_in_graph", {"mode": "text"}, "INVALID_INPUT"), ("find_in_graph", {"mode": "nodes", "kind": "class", "limit": "9"}, "INVALID_INPUT"), ("inspect_node", {"mode": "neighbors", "node_id": "a", "direction": "up"}, "INVALID_INPUT"),
    ("graph_summary", {"mode": "categories", "category": "weather"}, "INVALID_INPUT"), ("run_query", {"query": "DROP TABLE x"}, "INVALID_INPUT"), ("inspect_node", {"mode": "evidence"}, "INVALID_INPUT"), ("read_file", {"file_path": "x.py"}, "FILE_READ_FAILED"), ("topology_view", {"mode": "flow", "view": "moon"}, "INVALID_INPUT"),
])
def test_tool_errors(graph, tool, args, code):
    out = tools.call(graph, tool, args)
    assert isinstance(out, dict)
    assert out["code"] == code and out["message"] == out["error"] != "" and out["request_id"]


def test_text_search_ranks_and_falls_back(spark):
    n = [("1", "order service"), ("2", "order order"), ("3", "reorder"), ("4", "an order service of many other words here")]
    rows = spark.createDataFrame([(i, "class", x, "", "", None, None, "", "", "", "", [], {}) for i, x in n], M.NODES)
    assert [r["id"] for r in search.text_search(rows, "order service").collect()] == ["1", "4"]
    assert [r["id"] for r in search.text_search(rows, "order").collect()][0] == "2"
    assert [r["id"] for r in search.text_search(rows, "eorde").collect()] == ["3"]


def tree(r):
    out = {"shop/pom.xml": "<project>\n<artifactId>shop</artifactId>\n</project>"}
    for i in range(6):
        out[f"shop/C{i}.java"] = f'@Entity\npublic class C{i} extends Base {{\n  public String one{i}() {{ return ""; }}\n  @KafkaListener(topics = "t{r.randint(0, 2)}")\n  void a() {{ kafkaTemplate.send("t{r.randint(0, 2)}", x); }}\n}}\n'
    return out


def changes(spark, texts):
    rows = spark.createDataFrame([(p, t) for p, t in texts.items()], "path string, content string")
    return rows.select("path", S.language(F.col("path")).alias("language"), "content", S.content_hash(F.col("content").cast("binary")).alias("content_hash"))


def test_stream_keeps_a_graph_up(spark, tmp_path):
    r = random.Random(3)
    texts, drops = tree(r), str(tmp_path / "drops")
    store = G.GraphStore(spark, str(tmp_path / "graph"))
    store.reset()
    changes(spark, texts).write.parquet(f"{drops}/1")
    stream = lambda: spark.readStream.schema("path string, language string, content string, content_hash string").option("recursiveFileLookup", "true").parquet(drops)
    R.follow(store, stream(), str(tmp_path / "at")).awaitTermination()
    first = {x["id"] for x in store.nodes().collect()}
    assert {"shop/C0.java:C0", "shop/C5.java:C5"} <= first
    changed = {"shop/C1.java": texts["shop/C1.java"].replace("class C1", "class D1"), "shop/C2.java": None}
    changes(spark, changed).write.parquet(f"{drops}/2")
    R.follow(store, stream(), str(tmp_path / "at")).awaitTermination()
    again = G.GraphStore(spark, str(tmp_path / "whole"))
    again.reset()
    R.refresh(again, changes(spark, {p: t for p, t in (texts | changed).items() if t}))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(store.nodes().select("id", "kind", "label", "props")) == rows(again.nodes().select("id", "kind", "label", "props"))
    assert rows(store.edges().select("src", "kind", "dst")) == rows(again.edges().select("src", "kind", "dst"))
    ids = {x["id"] for x in store.nodes().collect()}
    assert "shop/C1.java:D1" in ids and not any("C2.java" in x for x in ids)


def test_types_reach_the_graph(spark, tmp_path):
    place = tmp_path / "tree"
    (place / "a").mkdir(parents=True)
    (place / "a/Q.java").write_text("public class Q extends Base implements Runnable {\n}\n")
    cache, store = S.Cache(spark, str(tmp_path / "cache")), G.GraphStore(spark, str(tmp_path / "graph"))
    build.build(spark, str(place), cache, store, use_git=False)
    props = store.nodes().filter("id = 'a/Q.java:Q'").first()["props"]
    assert (props["extends_type"], props["implements_types"]) == ("Base", "Runnable")
