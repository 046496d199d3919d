"""What queries send, write and order where tables are large: no table of nodes goes whole to every task, and little is stored."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import linkers, settle, topology, traversal
from weftgraph.operators import neighbours as N
from weftgraph.plans.stored import StoredGraph
from weftgraph.plans.tables import graph_from_tables
from weftgraph.queries import ORACLES, QUERIES
from weftgraph.sources import review

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    return StoredGraph(spark, SMALL)


@pytest.fixture
def none_is_few(monkeypatch):
    """Every table counts as large, as it would with many rows."""
    monkeypatch.setattr(settle, "FEW", 0)


def sent(df):
    """Joins of the plan that send a side whole to every task."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def by_sql(query):
    c = duckdb.connect()
    for t in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SMALL}/{t}'")
    return sorted(c.execute(ORACLES[query]).fetchall(), key=str)


def test_service_counts(stored, none_is_few):
    found = topology.counts_by_service(stored.nodes, stored.edges)
    assert sent(found) == 1  # the services
    assert rows(found) == by_sql("service_counts")


def test_snapshot_counters(stored, none_is_few):
    found = linkers.phantom_counts(stored.nodes, stored.edges)
    assert sent(found) == 0
    # Edges that lie in buckets by source are counted there: what moves are ends, nodes and counts.
    assert "hashpartitioning(src" not in found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    assert rows(found) == by_sql("snapshot_counters")


def test_affected_services(stored, none_is_few):
    near = traversal.blast_radius(stored.nodes, stored.walks, "order:1", 3)
    assert sent(near) == 0
    found = traversal.affected_services(stored.nodes, stored.edges, near)
    assert sent(found) == 1  # the services
    assert rows(found) == by_sql("affected_services")


@pytest.mark.parametrize("few", [0, 100_000])
def test_drop_phantom_edges(spark, stored, monkeypatch, few):
    monkeypatch.setattr(settle, "FEW", few)
    found = N.drop_dangling(stored.nodes, stored.edges).select(F.col("id").alias("edge"), "kind", "src", "dst")
    assert sent(found) == (0 if few == 0 else 2)
    assert rows(found) == by_sql("drop_phantom_edges")
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("a", "x"), ("x", "b"), (None, "b"), ("a", None), ("a", "b")], "src string, dst string")
    assert rows(N.drop_dangling(n, e)) == [("a", "b"), ("a", "b")]


def test_all_callers(spark, none_is_few):
    found = QUERIES["all_callers"](spark, SMALL)
    assert sent(found) == 0
    assert rows(found) == by_sql("all_callers")


def test_review_evidence(stored, none_is_few):
    found = review.evidence_of_files(stored.nodes, stored.edges, stored.nodes.filter("kind = 'entity'").select(F.col("file_path").alias("path")))
    assert sent(found) == 0
    assert rows(found) == by_sql("review_evidence")


def test_reach_of_services(stored, none_is_few):
    found = traversal.reach_of_each(stored.nodes, stored.walks, stored.nodes.filter("kind = 'service'"), 2)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString().split("LeftOuter")[-1]
    assert rows(found) == by_sql("reach_of_services")


def test_neighbours(stored, none_is_few):
    found = N.incoming(stored.nodes, stored.edges, "part:5")
    assert sent(found) == 0
    assert rows(found) == by_sql("incoming_neighbors")


def test_cycles_write_what_can_lie_on_one(spark, tmp_path):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(300)]
    tree = [(f"t{i}", f"t{2 * i + k}") for i in range(1, 200) for k in (0, 1)]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r3", "t1"), ("r1", "r1"), ("r1", "r2")]
    e = spark.createDataFrame(tree + chain[:4] + ring, "src string, dst string")
    left = traversal._entered(e, 10)
    # Nothing of the chain; of what the ring leads to all, which goes from the other end.
    assert {tuple(r) for r in left.collect()} == {x for x in {*tree, *ring} if x[0] != x[1]}
    assert {tuple(r) for r in traversal._entered(spark.createDataFrame(chain, "src string, dst string"), 400).collect()} == set()
    found = spark.createDataFrame(tree + chain + ring, "src string, dst string")
    assert [r["path"] for r in traversal.cycles(found, limit=None).collect()] == [["r1", "r2", "r3"]]


def test_queries_store_what_they_read(spark):
    graph = StoredGraph(spark, SMALL)
    there = lambda: {x for x in ("nodes", "edges/src", "edges/dst") if os.path.isdir(f"{graph.root}/{x}".removeprefix("file://"))}
    assert linkers.resolve_calls(graph.nodes.filter("kind = 'service'").select(F.col("id").alias("src"), F.col("label").alias("name")), graph.nodes).count() == 25
    assert there() == {"nodes"}
    assert graph.edges.count() and there() == {"nodes", "edges/src"}
    assert spark.read.parquet(f"{graph.root}/edges/src").columns == ["src", "kind", "dst"]
    assert graph.walks.into.count() == graph.edges.count() and "edges/dst" in there()


@pytest.mark.parametrize("query", ["resolve_calls", "stats_infra", "tool_graph_summary"])
def test_queries_of_nodes_store_no_edges(spark, monkeypatch, query):
    from weftgraph import queries

    graph = StoredGraph(spark, SMALL)
    monkeypatch.setattr(queries, "stored_graph", lambda *_: graph)
    assert rows(QUERIES[query](spark, SMALL)) == by_sql(query)
    assert not os.path.exists(f"{graph.root}/edges".removeprefix("file://"))


@pytest.mark.parametrize("query", ["tool_analyze_impact", "service_cycles", "service_path", "topic_link", "incoming_neighbors"])
def test_queries_of_edges_store_them_once(spark, monkeypatch, query):
    from weftgraph import queries

    graph = StoredGraph(spark, SMALL)
    monkeypatch.setattr(queries, "stored_graph", lambda *_: graph)
    assert rows(QUERIES[query](spark, SMALL)) == by_sql(query)
    assert not os.path.exists(f"{graph.root}/edges/dst".removeprefix("file://"))


def test_repeated_rows_of_tables(spark, tmp_path):
    """What is DISTINCT in the SQL of edges is so in the stored ones, and what isn't stays repeated."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        df = spark.read.parquet(f"{SMALL}/{t}.parquet").limit(60)
        (df if t in ("region", "nation", "supplier") else df.unionAll(df.limit(9))).write.parquet(f"{tmp_path}/{t}.parquet")
    want, graph = graph_from_tables(spark, str(tmp_path)), StoredGraph(spark, str(tmp_path))
    for a, b in ((want[0], graph.nodes), (want[1], graph.edges), (want[1], graph.walks.into)):
        as_text = lambda d: rows(d.select(F.to_json(F.struct(*d.columns))))
        assert as_text(a) == as_text(b)


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """120 documents of one score, and some a little below it in the seventh decimal or less."""
    place = str(tmp_path_factory.mktemp("alike"))
    made = [(i, "the license " + "word " * 4) for i in range(1, 121)] + [(i, "other " * (i - 200)) for i in range(201, 230)]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{place}/documents.parquet")
    return place


@pytest.mark.parametrize("query", ["indexed_bm25", "indexed_bm25_prefix", "bm25_search", "bm25_prefix"])
def test_ties_of_scores_go_by_number(spark, alike, query):
    found = [r["key"] for r in QUERIES[query](spark, alike).collect()]
    assert found == list(range(1, 51))


def test_scores_are_compared_rounded(spark, alike):
    """Texts whose scores differ less than is shown: the smaller key comes first."""
    long = 4_000_000
    from weftgraph.operators import search

    hit = spark.createDataFrame([("x", 1, 1, long), ("x", 2, 1, long - 1), ("y", 3, 1, 5)], "token string, key long, tf long, size int")
    sizes = spark.createDataFrame([(3, float(long))], "n long, mean double")
    assert [r["key"] for r in search.ranked(hit.filter("token = 'x'"), sizes, ["x"], digits=6).collect()] == [1, 2]


def test_a_new_index_sends_no_keys(spark, stored, tmp_path):
    """Keys of a first batch are dealt, whatever Spark thinks of their size."""
    from weftgraph.sources.text_index import TextIndex

    index = TextIndex(spark, str(tmp_path / "index"))
    seen, put = [], index.tables.begin().__class__.put

    def watched(self, table, buckets, found):
        seen.append(sent(found))
        put(self, table, buckets, found)

    index.tables.begin().__class__.put = watched
    try:
        index.update(stored.nodes.select(F.col("id").alias("key"), F.col("label").alias("text")))
    finally:
        index.tables.begin().__class__.put = put
    assert seen == [0] and index._note()["n"] == stored.nodes.count()


def test_manifest_of_more_than_a_branch(spark, tmp_path):
    """Its SQL gives null there; the whole tree's hash has a query of its own."""
    e = spark.read.parquet(f"{SMALL}/events.parquet").limit(1).drop("user_id", "event_id").crossJoin(spark.range(5000).select(F.col("id").alias("user_id"), F.col("id").alias("event_id")))
    e.write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(QUERIES["manifest_tree"](spark, str(tmp_path))) == c.execute(ORACLES["manifest_tree"]).fetchall() == [(None,)]
    assert len(QUERIES["manifest_tree_all"](spark, str(tmp_path)).first()["manifest"]) == 64
    assert rows(QUERIES["manifest_tree"](spark, SMALL)) == rows(QUERIES["manifest_tree_all"](spark, SMALL)) == by_sql("manifest_tree")


def test_an_update_reads_texts_no_more_than_needed(spark, tmp_path):
    """Sizes are written, not cut out of the texts once more."""
    from weftgraph.sources.text_index import TextIndex

    cut = spark.sparkContext.accumulator(0)

    def seen(key):
        cut.add(1)
        return f"word{key}"

    text = F.udf(seen, "string").asNondeterministic()
    TextIndex(spark, str(tmp_path / "cut")).update(spark.range(40).select(F.col("id").cast("string").alias("key"), text("id").alias("text")).filter("text <> ''"))
    assert cut.value <= 40 * 6  # a text is made anew in the filter too; without the written sizes 7 times
