"""Table functions, the git data source, review, export and manifests in branches."""

import json
import subprocess

import pytest
import yaml
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.detectors import engine, udtf
from weftgraph.operators import search, tools
from weftgraph.plans import specimens
from weftgraph.sources import export, git_diff, review
from weftgraph.sources import files as S
from weftgraph.sources import graph_store as G
from weftgraph.streaming import refresh as R


def test_lateral_detection_equals_the_engine(spark):
    some = [s for s in specimens.SPECIMENS if s.family in ("jvm_messaging", "python", "structured")]
    files = spark.createDataFrame([(s.path, s.language, s.text, s.detector) for s in some] + [("none.py", "python", None, "x"), ("odd", None, "y", "z")], "path string, language string, content string, content_hash string")
    found = engine.detect(files.filter("language IS NOT NULL"))
    plain = lambda d, item, cols: sorted(str((r["path"], r["content_hash"], *(r[c] for c in cols), sorted((r["props"] or {}).items()))) for r in d.collect())
    got = udtf.detect_lateral(files).cache()
    for item, raw, cols in (("node", engine.raw_nodes(found), ["seq", "id", "kind", "label", "fqn", "line_start", "line_end", "confidence", "source"]), ("edge", engine.raw_edges(found), ["seq", "id", "kind", "src", "dst", "confidence", "source"])):
        assert plain(got.filter(F.col("item") == item), item, cols) == plain(raw, item, cols)
    one = udtf.detect_lateral(files, "kafka").filter("item = 'node'").select("source").distinct()
    assert [r["source"] for r in one.collect()] == ["kafka"]
    assert udtf.detect_lateral(files, "no such").count() == 0


def test_sql_calls_the_function(spark):
    udtf.register(spark)
    spark.createDataFrame([("a.md", "markdown", "# One\n## Two")], "path string, language string, content string").createOrReplaceTempView("sources_here")
    rows = spark.sql("SELECT d.label FROM sources_here f, LATERAL detect(f.path, f.language, f.content) d WHERE d.kind = 'config_key' ORDER BY d.line_start").collect()
    assert [r["label"] for r in rows] == ["One", "Two"]


def test_inspect(spark):
    row = udtf.inspect(spark, "kafka").first()
    assert (row["languages"], row["how"]) == ("java,kotlin", "rules") and "topic" in row["node_kinds"]
    with pytest.raises(ValueError, match="unknown detector"):
        udtf.inspect(spark, "nope")


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "a.py").write_text("one\ntwo\nthree\n")
    (root / "gone.py").write_text("x\n")
    (root / "old name.py").write_text("\n".join(map(str, range(30))) + "\n")
    run("add", "-A")
    run("commit", "-qm", "1")
    run("tag", "v1")
    (root / "a.py").write_text("one\n2\nthree\n-- four\n")
    (root / "gone.py").unlink()
    (root / "new.py").write_text("y\n+ z\n")
    (root / "old name.py").rename(root / "new name.py")
    run("add", "-A")
    run("commit", "-qm", "2")
    return str(root)


def test_git_diff_source(spark, repo):
    rows = {r["path"]: r for r in git_diff.read_diff(spark, repo, "v1", "HEAD").collect()}
    assert {p: (r["status"], r["added"], r["removed"]) for p, r in rows.items()} == {"a.py": ("modified", 2, 1), "gone.py": ("deleted", 0, 1), "new.py": ("added", 2, 0), "new name.py": ("renamed", 0, 0)}
    assert rows["new name.py"]["old_path"] == "old name.py" and rows["a.py"]["hunks"].startswith("@@ -1,3 +1,4 @@")
    assert git_diff.read_diff(spark, repo, "v1", "HEAD").rdd.getNumPartitions() == 4
    assert git_diff.read_diff(spark, repo).count() == 0
    for base in ("nowhere", "--output=x"):
        with pytest.raises(ValueError, match="git|dash"):
            git_diff.read_diff(spark, repo, base, "HEAD")


def test_review_changes(spark, repo):
    node = lambda i, kind, path: (i, kind, i, "", path, 1, 1, "", "", "", "", [], {})
    nodes = spark.createDataFrame([node("f", "method", "a.py"), node("g", "method", "b.py"), node("h", "class", "new.py")], M.NODES)
    edges = spark.createDataFrame([("e", "calls", "g", "f", "", "", {})], M.EDGES)
    graph = tools.Graph(nodes, edges, root=repo)
    text = tools.call(graph, "review_changes", {"base_ref": "v1", "head_ref": "HEAD"}).first()["prompt"]
    assert "## a.py (modified, +2 -1)\n- method f (f)\n< method g (g)\n@@ -1,3 +1,4 @@" in text and "## new.py (added, +2 -0)\n- class h (h)\n" in text
    only = tools.call(graph, "review_changes", {"base_ref": "v1", "head_ref": "HEAD", "focus_files": ["new.py"]}).first()["prompt"]
    assert only.startswith("## new.py") and "a.py" not in only
    assert tools.call(graph, "review_changes", {"mode": "files", "base_ref": "v1"}).count() == 4
    assert tools.call(graph, "review_changes", {"base_ref": "nowhere"})["code"] == tools.call(tools.Graph(nodes, edges), "review_changes", {})["code"] == "INVALID_INPUT"


@pytest.mark.parametrize("form", ["json", "yaml"])
@pytest.mark.parametrize("n", [0, 1, 57])
def test_export(spark, tmp_path, form, n):
    nodes = spark.createDataFrame([(f"n{i}", "class", f'l"{i}\\', "", "a: b\n#c", i, None, "", "", "", "", ["x"], {"k: 1": "é", "z": "- q"}) for i in range(n)], M.NODES).repartition(3)
    edges = spark.createDataFrame([(f"e{i}", "calls", f"n{i}", "n0", "", "", {}) for i in range(n)], M.EDGES).repartition(2)
    export.write_export(nodes, edges, str(tmp_path / "out"), form)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    found = json.loads(text) if form == "json" else yaml.safe_load(text)
    assert [x["id"] for x in found["nodes"]] == sorted(f"n{i}" for i in range(n))
    assert found["stats"] == {"node_count": n, "edge_count": n} and len(found["edges"]) == n
    if n:
        assert (found["nodes"][0]["label"], found["nodes"][0]["props"], found["nodes"][0]["file_path"]) == ('l"0\\', {"k: 1": "é", "z": "- q"}, "a: b\n#c")
    with pytest.raises(ValueError, match="unknown format"):
        export.export_lines(nodes, edges, "xml")


def test_manifest_branches(spark, monkeypatch):
    files = lambda xs: spark.createDataFrame(xs, "path string, content_hash string")
    rows = [(f"d/f{i}", str(i % 7)) for i in range(300)]
    one, two = files(rows), files([*rows[:100], ("d/f100", "other"), *rows[101:299], ("new", "1")])
    moved = [r["branch"] for r in S.changed_branches(S.manifest_branches(one, 64), S.manifest_branches(one.repartition(3), 64)).collect()]
    assert moved == []
    moved = {r["branch"] for r in S.changed_branches(S.manifest_branches(one, 64), S.manifest_branches(two, 64)).collect()}
    assert 1 <= len(moved) <= 3
    assert sorted(map(tuple, S.diff_branches(one, two, 64).collect())) == sorted(map(tuple, S.diff(one, two).filter("status <> 'unchanged'").collect()))
    small = S.manifest_tree(one).first()["manifest"]
    assert small == S.manifest_hash(one).first()["manifest"]
    monkeypatch.setattr(S, "BRANCH_FILES", 10)
    assert S.branches_for(10) == 1 and S.branches_for(11) == 2 and S.branches_for(300) == 32
    many = S.manifest_tree(one).first()["manifest"]
    assert many == S.manifest_tree(one.repartition(4)).first()["manifest"] != S.manifest_tree(two).first()["manifest"]
    assert many != small


def test_indexes_follow_a_refresh(spark, tmp_path):
    store = G.GraphStore(spark, str(tmp_path), buckets=2)
    files = lambda xs: spark.createDataFrame(xs, "path string, content string").select("path", S.language(F.col("path")).alias("language"), "content", S.content_hash(F.col("content").cast("binary")).alias("content_hash"))
    store.reset()
    R.refresh(store, files([("a.py", "class Cart:\n    pass\n"), ("b.py", "class Shop:\n    pass\n")]))
    store.build_indexes()
    R.refresh(store, files([("a.py", "class Basket:\n    pass\n"), ("b.py", None)]))
    for query in ("cart", "basket", "shop"):
        got, want = ([(r["id"], round(r["score"], 9)) for r in search.text_search(store.nodes(), query, index=i).collect()] for i in (store.index("label"), None))
        assert got == want
    assert store.index("label").search("basket").count() > 0 == store.index("label").search("shop").count()
