"""Stored adjacency, stored text index, components and the gate."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.operators import gate, search, tools, traversal
from weftgraph.sources.adjacency import Adjacency, neighbours
from weftgraph.sources.text_index import TextIndex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def walked(spark, tmp_path_factory):
    r = random.Random(4)
    pairs = sorted({(f"n{r.randrange(400)}", f"n{r.randrange(400)}") for _ in range(900)})
    edges = spark.createDataFrame([(f"{a}|{b}", r.choice(["calls", "imports"]), a, b, "LEXICAL", "", {}) for a, b in pairs], M.EDGES)
    nodes = spark.createDataFrame([(f"n{i}", "class", f"n{i}", "", "", None, None, "", "", "", "", [], {}) for i in range(400)], M.NODES)
    return nodes, edges, Adjacency.write(edges, str(tmp_path_factory.mktemp("adjacency")), 4), pairs


def test_hops_do_not_move_edges(spark, walked):
    _, edges, adjacency, pairs = walked
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = spark.range(300).select(F.concat(F.lit("n"), "id").alias("id")).repartition(3)
        for back, by in ((False, "src"), (True, "dst")):
            hop = neighbours(adjacency, front, None, back)
            text = plan(hop)
            # The only exchange is the frontier's: edges join as they are read.
            assert f"weft_{by}_" in text and text.count("Exchange hashpartitioning") <= 1 and "Bucketed: true" in text
            want = sorted((b, a) if back else (a, b) for a, b in pairs if int((b if back else a)[1:]) < 300)
            assert sorted(map(tuple, hop.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_nodes_read_their_buckets(walked):
    _, _, adjacency, pairs = walked
    few = neighbours(adjacency, None, ["n7"])
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.optionalBucketSet().get().cardinality() == 1
    assert sorted(r["to"] for r in few.collect()) == sorted(b for a, b in pairs if a == "n7")


@pytest.mark.parametrize("named", [200, 0])
def test_walks_agree(walked, monkeypatch, named):
    monkeypatch.setattr(traversal, "NAMED", named)
    nodes, edges, adjacency, pairs = walked
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    seen, front = {"n3": 0}, {"n3"}
    for hop in range(1, 5):
        front = {b for a in front for b in out[a]} - set(seen)
        seen |= dict.fromkeys(front, hop)
    want = {x: h for x, h in seen.items() if h}
    for e in (edges, adjacency):
        assert {r["id"]: r["hops"] for r in traversal.blast_radius(nodes, e, "n3", 4).collect()} == want
        far = max(want, key=lambda x: (want[x], x))
        path = traversal.shortest_path(nodes, e, "n3", far)
        assert len(path) == want[far] + 1 and all(b in out[a] for a, b in zip(path, path[1:], strict=False))
        each = {r["start"]: r["n"] for r in traversal.reach_of_each(nodes, e, nodes.filter("id IN ('n3', 'n5')"), 4).collect()}
        assert each["n3"] == len(want)


def strong(pairs):
    """Strongly connected components of two nodes or more, by reachability."""
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    to = {x: reach(x) for x in list(out)}
    groups = {x: {y for y in to[x] if x in to.get(y, ())} for x in to if x in to[x]}
    return {x: min(g) for x, g in groups.items() if len(g) > 1}


@pytest.mark.parametrize("n", [12, 40, 90])
def test_components(spark, n):
    r = random.Random(n)
    pairs = sorted({(f"v{r.randrange(n)}", f"v{r.randrange(n)}") for _ in range(int(n * 1.3))})
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, kind string")
    assert {x["id"]: x["component"] for x in traversal.components(edges).collect()} == strong(pairs)


def test_cycles_of_a_dense_graph(spark):
    r = random.Random(1)
    pairs = sorted({(f"{c}{r.randrange(5)}", f"{c}{r.randrange(5)}") for c in "ab" for _ in range(30)} | {("a0", "b0")})
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)

    def walk(path):
        for d in out[path[-1]]:
            if d == path[0] and len(path) > 1:
                yield tuple(path)
            elif d > path[0] and d not in path:
                yield from walk([*path, d])

    want = sorted((len(c), c) for x in list(out) for c in walk([x]))
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, kind string")
    assert sorted((len(x["path"]), tuple(x["path"])) for x in traversal.cycles(edges, limit=None).collect()) == want
    some = [len(x["path"]) for x in traversal.cycles(edges, limit=5).collect()]
    assert some == [n for n, _ in want[:5]]


WORDS = "order service orders user ordering pay a b naïve x_1".split()


def test_index_follows_updates(spark, tmp_path):
    """After any updates, over several runs and a merge, a search gives what a scan of the documents gives."""
    r, index, docs = random.Random(2), TextIndex(spark, str(tmp_path), buckets=3), {}
    text = lambda: " ".join(r.choices(WORDS, k=r.randint(0, 9)))
    for step in range(6):
        batch = {f"d{i}": text() for i in (range(30) if step == 0 else r.sample(range(40), 5))}
        batch |= {k: None for k in r.sample(sorted(docs), min(2, len(docs)))}
        docs |= batch
        index.update(spark.createDataFrame(list(batch.items()), "key string, text string"))
        if step in (0, 3, 5):
            now = spark.createDataFrame([(k, t) for k, t in docs.items() if t is not None], "key string, text string")
            for query in ("order", "ORDER service", "x", "pay order a", "missing", "", "o"):
                rows = lambda d: [(x["key"], round(x["score"], 9)) for x in d.collect()]
                assert rows(index.search(query)) == rows(search.bm25_documents(now, "key", "text", query)), query
    assert len(index._note()["runs"]) < 4


def test_a_search_reads_the_folders_of_its_words(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    index.update(spark.createDataFrame([("1", "order pay"), ("2", "user zebra")], "key string, text string"))
    seen = lambda words: {p.split("head=")[1].split("/")[0] for p in index.hits(words)._jdf.queryExecution().executedPlan().collectLeaves().apply(0).relation().location().inputFiles()}
    assert seen(["order", "zebra"]) >= {"or", "ze"}
    text = plan(index.hits(["order", "pay"]))
    assert "PartitionFilters: [isnotnull(head" in text or "PartitionFilters: [head" in text
    assert "PushedFilters: [In(token, [order,pay])" in text.replace("  ", " ") or "In(token" in text
    assert "StartsWith(token" in plan(index.hits(["ord"])) and "(head" in plan(index.hits(["ord"]))


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame([(f"n{i}", "class", f"c{i}", "", "", None, None, "", "", "", "", [], {}) for i in range(7)], M.NODES)
    e = spark.createDataFrame([("e", "calls", "n0", "n1", "", "", {})], M.EDGES)
    return tools.Graph(n, e)


@pytest.mark.parametrize("sql", [
    "SELECT id FROM {nodes} WHERE kind = 'class'", "WITH a AS (SELECT src FROM {edges}) SELECT n.id, count(*) AS k FROM {nodes} n LEFT JOIN a ON a.src = n.id GROUP BY n.id HAVING count(*) > 0 ORDER BY k DESC LIMIT 3",
    "SELECT id FROM {nodes} WHERE id IN (SELECT dst FROM {edges}) UNION SELECT src FROM {edges}", "SELECT upper(label) AS l, row_number() OVER (PARTITION BY kind ORDER BY id) AS r FROM {nodes}", "SELECT (SELECT max(id) FROM {nodes}) AS m, EXISTS (SELECT 1 FROM {edges}) AS e",
    "SELECT x FROM {nodes} LATERAL VIEW explode(annotations) t AS x", "SELECT CASE WHEN id LIKE 'n%' THEN 1 ELSE 0 END AS c, cast(line_start AS string) AS s FROM {nodes}",
])
def test_the_gate_lets_reads_through(spark, graph, sql):
    assert gate.objection(spark, sql.replace("{nodes}", "nodes").replace("{edges}", "edges")) is None
    gate.run_query(spark, sql, graph.nodes, graph.edges).collect()


@pytest.mark.parametrize("sql", [
    "SELECT java_method('java.lang.System', 'setProperty', 'weft.x', '1')", "SELECT reflect('java.lang.System', 'getenv')", "SELECT count(*) FROM parquet.`/etc`", "SELECT * FROM text.`/etc/passwd`", "SELECT * FROM other", "SELECT * FROM spark_catalog.default.nodes", "SET spark.x = 1", "DROP TABLE nodes",
    "CREATE TABLE t AS SELECT 1", "INSERT INTO nodes SELECT 1", "SELECT TRANSFORM(id) USING 'cat' FROM nodes", "SELECT input_file_name() FROM nodes", "SELECT current_user()", "SELECT * FROM range(5)", "SELECT id FROM nodes WHERE id IN (SELECT value FROM text.`/etc/passwd`)", "SHOW TABLES", "SELECT 1; DROP TABLE x",
    "WITH a AS (SELECT try_reflect('java.lang.System', 'getenv') AS x) SELECT x FROM a", "SELECT (SELECT java_method('java.lang.System', 'lineSeparator')) AS x FROM nodes", "SELECT transform(array(1), x -> reflect('java.lang.System', 'getenv')) FROM nodes", "ADD JAR 'x'", "SELECT * FROM IDENTIFIER('parquet.`/etc`')", "EXPLAIN SELECT 1", "not sql",
    "SELECT count(*) FROM nodes WHERE EXISTS (SELECT java_method('java.lang.System', 'lineSeparator'))", "SELECT * FROM nodes LATERAL VIEW stack(1, java_method('java.lang.System', 'lineSeparator')) t AS x",
])
def test_the_gate_stops_all_else(spark, graph, sql):
    assert gate.objection(spark, sql)
    with pytest.raises(ValueError, match="only queries that read"):
        gate.run_query(spark, sql, graph.nodes, graph.edges)


def test_truncated(spark, graph):
    sql = "SELECT id FROM {nodes} ORDER BY id"
    assert [(gate.query_result(spark, sql, graph.nodes, graph.edges, k).truncated, gate.query_result(spark, sql, graph.nodes, graph.edges, k).rows.count()) for k in (6, 7, 0)] == [(True, 6), (False, 7), (True, 1)]
    rows = tools.call(graph, "run_query", {"mode": "capped", "query": sql, "limit": 2}).collect()
    assert [tuple(r) for r in rows] == [("n0", True), ("n1", True)]
    text = tools.call(graph, "run_query", {"mode": "table", "query": "SELECT label, id FROM {nodes} WHERE id < 'n2' ORDER BY id"}).first()
    assert (text["text"], text["truncated"]) == ("id  label\nn0  c0\nn1  c1\n", False)
    assert tools.call(graph, "run_query", {"query": "SELECT reflect('java.lang.System', 'getenv')"})["code"] == "INVALID_INPUT"
