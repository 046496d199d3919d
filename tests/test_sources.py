import pytest
from pyspark.sql import functions as F

from weftgraph import model as M
from weftgraph.detectors import catalogue, engine
from weftgraph.operators import enrich, search
from weftgraph.plans import build
from weftgraph.sources import files as S
from weftgraph.sources import graph_store as G
from weftgraph.sources import review, structured

JAVA = """package shop;
import java.util.List;

/** Takes orders. */
@RestController
@RequestMapping("/orders")
public class OrderController extends Base {
    @GetMapping("/{id}")
    public Order find(long id) {
        return load(id);
    }
    @KafkaListener(topics = "paid")
    public void onPaid(String x) { kafkaTemplate.send("shipped", x); }
    public Order load(long id) { return null; }
}
"""
PYTHON = '''import os


class User(models.Model):
    """A person."""
    team = models.ForeignKey("Team")


@app.route("/users", methods=["POST"])
def add():
    helper()


def helper():
    return os.name
'''
TREE = {"shop/pom.xml": "<project><artifactId>shop-core</artifactId></project>", "shop/src/OrderController.java": JAVA, "py/setup.py": "setup(\n    name='people'\n)", "py/models.py": PYTHON, "conf/app.yaml": "a: 1\nb: {c: 2}", "node_modules/x.js": "function x() {}", "notes.unknown": "?"}


def write(root, tree):
    for path, text in tree.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_discovery(spark, tmp_path):
    write(tmp_path, TREE)
    rows = {r["path"]: r for r in S.read_files(spark, str(tmp_path), use_git=False).collect()}
    assert set(rows) == set(TREE) - {"node_modules/x.js", "notes.unknown"}
    assert (rows["py/models.py"]["language"], rows["py/models.py"]["content"]) == ("python", PYTHON)


def manifest(spark, rows):
    return spark.createDataFrame(rows, "path string, content_hash string")


def test_diff_and_manifest(spark):
    a, b = manifest(spark, [("x", "1"), ("y", "1"), ("z", "1")]), manifest(spark, [("z", "2"), ("w", "1"), ("x", "1")])
    assert dict(map(tuple, S.diff(a, b).collect())) == {"x": "unchanged", "y": "deleted", "z": "modified", "w": "added"}
    one = lambda d: S.manifest_hash(d).first()["manifest"]
    assert one(b) == one(b.orderBy("path").repartition(3)) != one(a)


@pytest.mark.parametrize(("language", "text", "data"), [("json", '{"a": [1]}', {"a": [1]}), ("json", "[1]", {}), ("json", "{bad", {}), ("yaml", "a: {1: x}", {"a": {"1": "x"}}), ("yaml", "a: [", {}), ("toml", '[a.b]\nx = "1" # c\ny = ["p", \n "q"]\n', {"a": {"x": "1", "y": ["p", "q"]}}), ("ini", "k=0\n[s]\n; c\na = 1\nb: 2", {"s": {"a": "1", "b": "2"}}), ("properties", "a=1\nb: 2\nc 3\n# d=4", {"a": "1", "b": "2", "c": "3"})])
def test_parsers(language, text, data):
    assert structured.parse(language, text)["data"] == data


def test_many_yaml_documents():
    found = structured.parse_yaml("a: 1\n---\nb: 2\n---\nc: [")
    assert (found["type"], found["documents"]) == ("yaml_multi", [{"a": 1}, {"b": 2}])


def found(path, language, text):
    nodes, edges = engine.detect_text(path, language, text)
    assert engine.check_domains(nodes, edges) == []
    assert engine.detect_text(path, language, text) == (nodes, edges)
    return {(n["source"], n["kind"], n["label"]) for n in nodes}, {(e["source"], e["kind"], e["dst"]) for e in edges}


CASES = [
    ("A.java", "java", JAVA, {("spring_rest", "endpoint", "find"), ("kafka", "topic", "kafka:paid"), ("java.class_hierarchy", "class", "OrderController")}), ("m.py", "python", PYTHON, {("python.django_models", "entity", "User"), ("python.flask_routes", "endpoint", "add"), ("python_structures", "method", "helper")}),
    ("R.java", "java", "interface UserRepository extends JpaRepository<User, Long> { @Query(\"select 1\") int n(); }", {("spring_repository", "repository", "UserRepository"), ("raw_sql", "query", "select 1")}), ("E.java", "java", '@Entity\n@Table(name = "users")\npublic class User {}', {("jpa_entity", "entity", "User")}),
    ("api.py", "python", '@router.get("/items/{id}")\nasync def item(id): ...', {("python.fastapi_routes", "endpoint", "GET /items/{id}")}), ("t.py", "python", "@shared_task\ndef mail(): ...\nmail.delay()", {("python.celery_tasks", "method", "mail")}), ("s.py", "python", "class A(Base):\n    __tablename__ = 'a'\n", {("python.sqlalchemy_models", "entity", "A")}), ("p.py", "python", "class A(BaseModel):\n    x: int\n", {("python.pydantic_models", "entity", "A")}),
    ("a.ts", "typescript", "const app = express();\napp.get('/x', f);", {("typescript.express_routes", "endpoint", "GET /x")}), ("c.ts", "typescript", "@Controller('cats')\nexport class Cats {\n  @Get(':id')\n  one() {}\n}", {("typescript.nestjs_controllers", "class", "Cats"), ("typescript.nestjs_controllers", "endpoint", "GET :id")}), ("B.tsx", "typescript", "import React from 'react';\nexport function Box() { return <Inner/>; }\nconst useIt = () => 1;", {("frontend.react_components", "component", "Box"), ("frontend.react_components", "hook", "useIt")}), ("k.ts", "typescript", "import { Kafka } from 'kafkajs';\nconst k = new Kafka({});\np.send({ topic: 'a' })", {("kafka_js", "topic", "kafka:a")}),
    ("m.go", "go", 'package main\n\nimport (\n\t"fmt"\n)\n\ntype S struct {}\n\nfunc (s *S) Run() {}\nfunc f() { r.GET("/x", h) }', {("go_structures", "class", "S"), ("go_structures", "method", "Run"), ("go_web", "endpoint", "GET /x")}), ("m.rs", "rust", '#[get("/x")]\nasync fn x() {}\npub struct P;\nimpl T for P {}', {("actix_web", "endpoint", "GET /x"), ("rust_structures", "class", "P")}), ("m.cs", "csharp", 'namespace N;\npublic class A : B, IC {}\napp.MapGet("/x", f);', {("csharp_structures", "class", "A"), ("csharp_minimal_apis", "endpoint", "GET /x")}), ("m.kt", "kotlin", 'import io.ktor.server\nrouting { get("/x") { } }\nclass A : B()', {("ktor_routes", "endpoint", "GET /x"), ("kotlin_structures", "class", "A")}),
    ("m.scala", "scala", "trait T\nclass A extends B with T { def f = 1 }", {("scala_structures", "class", "A"), ("scala_structures", "interface", "T")}), ("m.cpp", "cpp", '#include <vector>\nclass A : public B {\n};\nint f(int x) {\n}', {("cpp_structures", "class", "A"), ("cpp_structures", "method", "f")}), ("s.sql", "sql", "CREATE TABLE a (id int REFERENCES b(id));", {("sql_structure", "entity", "a"), ("sql_migration", "sql_entity", "a")}), ("m.tf", "terraform", 'resource "aws_s3_bucket" "b" {}\nvariable "v" {}', {("terraform", "infra_resource", "aws_s3_bucket.b"), ("terraform", "config_definition", "v")}),
    ("Dockerfile", "dockerfile", "FROM python:3 AS base\nEXPOSE 80\nENV A=1", {("dockerfile", "infra_resource", "FROM python:3 AS base"), ("dockerfile", "endpoint", "port 80")}), ("m.proto", "proto", "package p;\nservice S {\n  rpc Do (A) returns (B);\n}\nmessage A {}", {("proto_structure", "interface", "S"), ("proto_structure", "method", "Do"), ("proto_structure", "protocol_message", "A")}), ("r.md", "markdown", "# Top\n[x](other.md)", {("markdown_structure", "config_key", "Top")}), ("b.sh", "bash", "#!/bin/sh\nrun() {\n docker ps\n}\nexport A=1", {("bash", "method", "run"), ("bash", "config_definition", "A")}),
    (".github/workflows/ci.yml", "yaml", "name: CI\non: [push]\njobs:\n  a: {}\n  b: {needs: a}", {("github_actions", "module", "CI"), ("github_actions", "method", "b")}), ("docker-compose.yml", "yaml", "services:\n  web: {image: x, depends_on: [db]}\n  db: {image: y}", {("docker_compose", "infra_resource", "web")}), ("k.yaml", "yaml", "apiVersion: v1\nkind: Service\nmetadata: {name: s}\nspec: {selector: {app: a}}\n---\napiVersion: apps/v1\nkind: Deployment\nmetadata: {name: d}\nspec: {template: {metadata: {labels: {app: a}}, spec: {containers: [{name: c, image: i}]}}}", {("kubernetes", "infra_resource", "Service/s"), ("kubernetes", "config_key", "c")}), ("package.json", "json", '{"name": "p", "scripts": {"t": "x"}, "dependencies": {"d": "1"}}', {("package_json", "module", "p"), ("package_json", "method", "t")}),
    ("o.yaml", "yaml", "openapi: 3.0.0\ninfo: {title: T}\npaths: {/x: {get: {}}}\ncomponents: {schemas: {A: {type: object}}}", {("openapi", "endpoint", "GET /x"), ("openapi", "entity", "A")}), ("pyproject.toml", "toml", '[project]\nname = "n"\ndependencies = ["d>=1"]\n[project.scripts]\nrun = "m:f"', {("pyproject_toml", "module", "n"), ("pyproject_toml", "config_definition", "run")}), ("tsconfig.json", "json", '{"extends": "./b", "compilerOptions": {"strict": true}}', {("tsconfig_json", "config_key", "strict")}), ("a.properties", "properties", "spring.datasource.url=jdbc:mysql://h/d", {("properties", "database_connection", "spring.datasource.url")}),
]


@pytest.mark.parametrize(("path", "language", "text", "want"), CASES, ids=[c[0] for c in CASES])
def test_detectors(path, language, text, want):
    assert want - found(path, language, text)[0] == set()


def test_every_detector_is_quiet_about_plain_text():
    structural = {"markdown_structure", "bash", "batch_structure", "ini_structure", "json_structure", "yaml_structure", "toml_structure", "properties"}
    assert len(catalogue.all_detectors()) == 99
    for d in catalogue.all_detectors().values():
        for language in d.languages:
            out = d.run(engine.File("a.txt", language, "nothing to see\n", structured.parse(language, "nothing")))
            assert d.name in structural or (out.nodes, out.edges) == ([], [])


def test_two_detectors_of_one_name():
    with pytest.raises(ValueError, match="two detectors"):
        engine.register(*[next(iter(catalogue.all_detectors().values()))])


def test_comments():
    lines = JAVA.split("\n")
    assert enrich.doc_comment(lines, "java", 7) == "Takes orders."
    assert enrich.doc_comment(PYTHON.split("\n"), "python", 4) == "A person."
    assert enrich.doc_comment(["// One", "// two", "func f() {}"], "go", 3) == "One two"
    assert enrich.doc_comment(["x"], "java", 9) == ""


def test_build_and_rebuild(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, TREE)
    cache, store = S.Cache(spark, str(tmp_path / "cache")), G.GraphStore(spark, str(tmp_path / "graph"))
    assert build.build(spark, str(root), cache, store, use_git=False)
    assert not build.build(spark, str(root), cache, store, use_git=False)
    nodes = {r["id"]: r for r in store.nodes().collect()}
    assert nodes["service:shop:shop-core"]["props"]["endpoint_count"] == "1"
    assert nodes["service:py:people"]["props"]["entity_count"] == "1"
    assert nodes["shop/src/OrderController.java:OrderController"]["props"]["lex_comment"] == "Takes orders."
    assert nodes["shop/src/OrderController.java:OrderController"]["props"]["service"] == "shop-core"
    edges = {(r["src"], r["kind"], r["dst"]) for r in store.edges().collect()}
    assert any(k == "calls" and "add" in a and "helper" in b for a, k, b in edges)
    write(root, {"py/models.py": PYTHON.replace("User", "Person"), "py/new.py": "def fresh(): pass\n"})
    (root / "conf/app.yaml").unlink()
    assert build.build(spark, str(root), cache, store, use_git=False)
    again = G.GraphStore(spark, str(tmp_path / "other"))
    build.build(spark, str(root), S.Cache(spark, str(tmp_path / "cache2")), again, use_git=False)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(store.nodes()) == rows(again.nodes())
    assert rows(store.edges()) == rows(again.edges())
    assert S.cache_stats(*(cache.read(t) for t in S.Cache.TABLES)).first()["files"] == 5
    assert S.cache_lookup(cache.read("files"), "new.py").first()["path"] == "py/new.py"
    assert cache.clear() == 5
    assert cache.read("files").count() == 0
    n, e = G.without_files(again.nodes(), again.edges(), spark.createDataFrame([("py/models.py",)], "path string"))
    assert n.filter("file_path = 'py/models.py'").count() == 0
    assert G.without_sources(n, e, ["service_detector"])[0].filter("kind = 'service'").count() == 0
    with pytest.raises(ValueError, match="two nodes"):
        again.write(n.unionByName(n).select(*(f.name for f in M.NODES)), e)


def test_no_build_file(spark):
    nodes = spark.createDataFrame([("a", "class", "a", "", "x/a.py", None, None, "", "", "", "", [], {})], M.NODES)
    files = spark.createDataFrame([("x/a.py", "python", "")], "path string, language string, content string")
    _, services, edges = enrich.detect_services(nodes, files)
    assert [r["id"] for r in services.collect()] == ["service:.:root"]
    assert edges.count() == 1


def test_snippets(spark):
    text = "\n".join(map(str, range(1, 201)))
    files = spark.createDataFrame([("f", text)], "path string, content string")
    nodes = spark.createDataFrame([("a", "f", 2, 3), ("b", "f", 10, 190)], "id string, file_path string, line_start long, line_end long")
    got = {r["id"]: r["snippet"].split("\n") for r in search.snippet(files, nodes).collect()}
    assert got["a"] == list("123456")
    assert (len(got["b"]), got["b"][0]) == (50, "75")


DIFF = "diff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-a\n+b\n+c\ndiff --git a/n.py b/n.py\nnew file mode 1\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\n+x\n"


def test_review(spark, tmp_path):
    rows = review.diff_rows(spark.createDataFrame([(1, DIFF), (2, None)], "diff_id long, text string"))
    assert [tuple(r)[1:5] for r in rows.orderBy("path").collect()] == [("n.py", "added", 1, 0), ("x.py", "modified", 2, 1)]
    text = review.review_prompt(rows, spark.createDataFrame([("x.py", "known")], "path string, text string"), ["x.py"]).first()["prompt"]
    assert text.startswith("## x.py (modified, +2 -1)\nknown\n@@")
    write(tmp_path, {"a.py": "1\n2\n3"})
    (tmp_path / "b.py").symlink_to("/etc/hostname")
    assert review.read_repo_file(str(tmp_path), "a.py", 2, 2) == "2"
    for bad in ("/etc/passwd", "../x.py", "b.py", "a.bin"):
        with pytest.raises(ValueError, match="repository"):
            review.read_repo_file(str(tmp_path), bad)


def test_plugins(spark):
    assert engine.plugins(spark).filter(F.col("name") == "kafka").first()["languages"] == "java,kotlin"
