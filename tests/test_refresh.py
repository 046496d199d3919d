"""A refreshed graph against one built anew from the final files."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.detectors import engine
from weftgraph.plans import build
from weftgraph.sources import files as S
from weftgraph.sources import graph_store as G
from weftgraph.streaming import refresh as R


def changes(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "path string, content string")
    return rows.select("path", S.language(F.col("path")).alias("language"), "content", S.content_hash(F.col("content").cast("binary")).alias("content_hash"))


def listed(nodes, edges):
    """Rows as plain values: nodes with sorted properties, edges too."""
    props = lambda x: tuple(sorted((x or {}).items()))
    n = sorted((r["id"], r["kind"], r["label"], r["fqn"] or "", r["file_path"] or "", r["line_start"] or 0, r["line_end"] or 0, r["module"] or "", r["layer"], r["confidence"], r["source"] or "", tuple(r["annotations"] or ()), props(r["props"])) for r in nodes.collect())
    e = sorted((r["src"], r["kind"], r["dst"], r["id"], r["confidence"], r["source"] or "", props(r["props"])) for r in edges.collect())
    return n, e


def rebuilt(spark, texts):
    files = changes(spark, texts) if texts else spark.createDataFrame([], "path string, language string, content string, content_hash string")
    found = engine.detect(files).cache()
    return listed(*build.assemble(engine.raw_nodes(found), engine.raw_edges(found), files))


def same(spark, store, texts):
    n, e = rebuilt(spark, {p: t for p, t in texts.items() if t is not None})
    stored = listed(store.nodes(), store.edges())
    assert stored[0] == n
    assert stored[1] == e


PRODUCER = 'public class Shop {\n  void buy() { kafkaTemplate.send("paid", x); settle(); }\n}\n'
LISTENER = 'public class Mail {\n  @KafkaListener(topics = "paid")\n  public void settle(String x) { }\n}\n'


def test_a_listener_that_goes_takes_its_edge_along(spark, tmp_path):
    store, texts = G.GraphStore(spark, str(tmp_path)), {"shop/pom.xml": "<project><artifactId>shop</artifactId></project>", "shop/Shop.java": PRODUCER, "shop/Mail.java": LISTENER}
    store.reset()
    R.refresh(store, changes(spark, texts))
    same(spark, store, texts)
    linked = lambda: {(r["src"], r["dst"]) for r in store.edges().filter("source = 'topic_linker'").collect()}
    assert len(linked()) == 1
    texts["shop/Mail.java"] = LISTENER.replace('  @KafkaListener(topics = "paid")\n', "")
    R.refresh(store, changes(spark, {"shop/Mail.java": texts["shop/Mail.java"]}))
    assert linked() == set()
    assert store.nodes().filter("id = 'shop/Mail.java:Mail'").first()["props"]["service"] == "shop"
    same(spark, store, texts)


def source(r, i, folder):
    """A file that takes part in topics, entities, repositories, calls and imports, at random."""
    t, k = r.randint(0, 2), r.randint(0, 3)
    body = [
        f'@Entity\npublic class User{k} extends Base {{\n  /** Runs. */\n  public void run{i}() {{ helper{k}(); }}\n}}\n',
        f"interface User{k}Repository extends JpaRepository<User{k}, Long> {{ }}\n",
        f'public class P{i} {{\n  void a{i}() {{ kafkaTemplate.send("t{t}", x); run{k}(); }}\n}}\n',
        f'public class L{i} {{\n  @KafkaListener(topics = "t{t}")\n  public void helper{k}(String x) {{ }}\n}}\n',
    ]
    if r.random() < 0.2:
        return f"{folder}/m{i}.py", f"import os\n\n\ndef helper{k}():\n    run{t}()\n\n\nclass C{i}(Base):\n    \"\"\"Keeps {k}.\"\"\"\n"
    return f"{folder}/F{i}.java", f"package p{k};\nimport java.util.List;\n" + r.choice(body) + r.choice(["", body[k]])


@pytest.mark.parametrize("seed", [1])
def test_refresh_equals_rebuild(spark, tmp_path, seed):
    r = random.Random(seed)
    folders, store, texts = ["shop", "shop/api", "mail", "lib"], G.GraphStore(spark, str(tmp_path), buckets=3), {}
    store.reset()
    for step in (0, 1, 5):
        batch = {}
        for i in range(12 if step == 0 else 4):
            path, text = source(r, r.randint(0, 9), r.choice(folders))
            batch[path] = text
        for path in r.sample(sorted(texts), min(len(texts), 2)):
            batch[path] = None
        if step == 1:
            folder = r.choice(folders)
            batch[f"{folder}/pom.xml"] = r.choice([None, f"<project><artifactId>{folder[-3:]}{step}</artifactId></project>"])
        if step == 1:
            batch["package.json"] = '{"name": "all"}'
        if step == 5:
            batch["package.json"] = None
            batch |= {p: None for p in texts if p.endswith("pom.xml")}
        texts |= batch
        R.refresh(store, changes(spark, batch))
        same(spark, store, texts)
    R.refresh(store, changes(spark, dict.fromkeys(texts)))  # everything goes
    same(spark, store, {})


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = G.GraphStore(spark, str(tmp_path), buckets=64)
    texts = {f"a/F{i}.java": f"public class F{i} {{\n  public void m{i}() {{ }}\n}}\n" for i in range(40)} | {"a/pom.xml": "<project><artifactId>a</artifactId></project>"}
    store.reset()
    R.refresh(store, changes(spark, texts))
    before = store.tables.state()["tables"]
    texts["a/F3.java"] = "public class G3 {\n}\n"
    R.refresh(store, changes(spark, {"a/F3.java": texts["a/F3.java"]}))
    after = store.tables.state()["tables"]
    same(spark, store, texts)
    for table, most in (("nodes", 6), ("edges", 6), ("claims", 6), ("files", 1), ("raw_nodes", 6)):
        moved = [b for b in after[table] if before[table].get(b) != after[table][b]]
        assert 1 <= len(moved) <= most < len(after[table]) - 10, table
    assert store.built_at() > "2020"


def test_a_graph_stored_whole_cannot_be_refreshed(spark, tmp_path):
    store = G.GraphStore(spark, str(tmp_path))
    texts = {"a.py": "def f(): pass\n"}
    files = changes(spark, texts)
    found = engine.detect(files)
    store.write(*build.assemble(engine.raw_nodes(found), engine.raw_edges(found), files), "m")
    assert store.fresh("m")
    with pytest.raises(ValueError, match="stored whole"):
        R.refresh(store, files)


def test_a_lost_race_is_noticed(spark, tmp_path):
    store = G.GraphStore(spark, str(tmp_path))
    store.reset()
    late = store.begin()
    R.refresh(store, changes(spark, {"a.py": "def f(): pass\n"}))
    with pytest.raises(ValueError, match="meanwhile"):
        late.commit()
