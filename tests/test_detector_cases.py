"""What single detectors must find, read off the sources by hand."""

import pytest

from weftgraph import model as M
from weftgraph.detectors import catalogue, engine
from weftgraph.operators import flow
from weftgraph.sources import files as S
from weftgraph.sources import structured


def run(name, path, language, text):
    out = catalogue.all_detectors()[name].run(engine.File(path, language, text, structured.parse(language, text)))
    return {(n["kind"], n["label"]) for n in out.nodes}, {(e["kind"], e["src"], e["dst"]) for e in out.edges}, {n["id"]: n for n in out.nodes}


def test_compose_links():
    nodes, edges, _ = run("docker_compose", "docker-compose.yml", "yaml", "services:\n  web:\n    image: w\n    links: ['db:database', cache]\n    depends_on: [db]\n  db: {image: d}\n  cache: {image: c}\n")
    at = "compose:docker-compose.yml:service:"
    assert edges == {("connects_to", f"{at}web", f"{at}db"), ("connects_to", f"{at}web", f"{at}cache"), ("depends_on", f"{at}web", f"{at}db")}
    assert {x for x in nodes if x[0] == "infra_resource"} == {("infra_resource", x) for x in ("web", "db", "cache")}


KUBE = """apiVersion: v1
kind: Service
metadata: {name: shop, namespace: prod}
spec: {selector: {app: shop}}
---
apiVersion: networking.k8s.io/v1
kind: Ingress
metadata: {name: front, namespace: prod}
spec:
  rules:
    - http:
        paths:
          - backend: {service: {name: shop}}
---
apiVersion: apps/v1
kind: Deployment
metadata: {name: shop, namespace: prod}
spec: {template: {metadata: {labels: {app: shop}}, spec: {containers: [{name: c, image: i}]}}}
"""


def test_ingress_connects_to_its_service():
    _, edges, _ = run("kubernetes", "k.yaml", "yaml", KUBE)
    assert edges == {("connects_to", "k8s:Ingress:prod:front", "k8s:Service:prod:shop"), ("depends_on", "k8s:Service:prod:shop", "k8s:Deployment:prod:shop")}


RBAC = """apiVersion: rbac.authorization.k8s.io/v1
kind: Role
metadata: {name: reader, namespace: prod}
rules: [{apiGroups: [""], resources: [pods], verbs: [get, list]}]
---
apiVersion: v1
kind: ServiceAccount
metadata: {name: robot, namespace: prod}
---
apiVersion: rbac.authorization.k8s.io/v1
kind: RoleBinding
metadata: {name: bind, namespace: prod}
roleRef: {kind: Role, name: reader}
subjects: [{kind: ServiceAccount, name: robot}, {kind: User, name: jane}]
"""


def test_a_role_protects_the_account_it_is_bound_to():
    _, edges, byid = run("config.kubernetes_rbac", "r.yaml", "yaml", RBAC)
    assert edges == {("protects", "rbac:k8s:Role:prod:reader", "rbac:k8s:ServiceAccount:prod:robot")}
    assert byid["rbac:k8s:Role:prod:reader"]["props"]["verbs"] == "get,list"


def test_helm_values_and_templates():
    nodes, _, _ = run("helm_chart", "shop/values.yaml", "yaml", "replicas: 2\nimage: {tag: x}\n")
    assert nodes == {("config_key", "replicas"), ("config_key", "image")}
    _, edges, _ = run("helm_chart", "shop/templates/d.yaml", "yaml", 'a: {{ .Values.image.tag }}\nb: {{ include "shop.name" . }}\nc: {{ .Values.replicas }}\n')
    assert edges == {("reads_config", "helm:shop/templates/d.yaml", "helm:value:image.tag"), ("reads_config", "helm:shop/templates/d.yaml", "helm:value:replicas"), ("imports", "helm:shop/templates/d.yaml", "helm:helper:shop.name")}


def test_go_queries():
    nodes, edges, _ = run("go_orm", "m.go", "go", 'type User struct {\n\tgorm.Model\n\tName string\n}\n\nfunc f(db *gorm.DB) {\n\tdb.AutoMigrate(&User{})\n\tdb.Where("a = ?", 1).First(&u)\n}\n')
    assert {k for k, _, _ in edges} == {"queries"} and {k for k, _ in nodes} == {"entity", "migration"}


@pytest.mark.parametrize(("name", "text", "queue", "topic"), [
    ("tibco_ems", 'class Q {\n  TibjmsConnectionFactory f = new TibjmsConnectionFactory("tcp://h");\n  void a() { Queue q = s.createQueue("in"); producer.send(m); }\n  void b() { s.createTopic("news"); }\n}\n', "in", "news"),
    ("ibm_mq", 'class Q {\n  MQQueueManager m = new MQQueueManager("QM1");\n  void a() { m.accessQueue("in", 1).put(x); }\n  void b() { s.createTopic("news"); }\n}\n', "in", "news"),
])
def test_brokers_send_and_name_topics(name, text, queue, topic):
    nodes, edges, byid = run(name, "Q.java", "java", text)
    labels = {(n["kind"], (n["label"]).split(":")[-1]) for n in byid.values()}
    assert {("queue", queue), ("topic", topic)} <= labels
    assert any(k == "sends_to" and dst.endswith(queue) for k, _, dst in edges)


def test_azure_topics_and_cosmos():
    text = 'class F {\n  @FunctionName("one")\n  public void run(@ServiceBusTopicTrigger(name = "m", topicName = "news", subscriptionName = "s") String m, @CosmosDBOutput(name = "d") Out d) { }\n}\n'
    nodes, edges, _ = run("azure_functions", "F.java", "java", text)
    assert {("azure_function", "one"), ("topic", "news"), ("azure_resource", "CosmosDBOutput")} <= nodes
    assert any(k == "triggers" and src == "azure:topic:news" for k, src, _ in edges)


def test_abstract_classes():
    nodes, _, _ = run("csharp_structures", "A.cs", "csharp", "namespace N {\n  public abstract class Base { }\n  public class Child : Base { }\n}\n")
    assert {("abstract_class", "Base"), ("class", "Child"), ("module", "N")} <= nodes and ("class", "Base") not in nodes


def test_auth_view_shows_middleware(spark):
    node = lambda i, kind, **p: (i, kind, i, "", "", None, None, "", "", "", "", [], p)
    nodes = spark.createDataFrame([node("g", "guard", auth_type="jwt"), node("m", "middleware"), node("m2", "middleware"), node("e", "endpoint")], M.NODES)
    d = flow.generate(nodes, spark.createDataFrame([("x", "protects", "g", "e", "", "", {})], M.EDGES), "auth")
    assert [n.label for n in d.groups[0].nodes] == ["jwt x1", "Middleware x2"] and d.nodes[0].label == "Protected x1"


def test_cache_statistics_tell_the_version(spark, tmp_path):
    cache = S.Cache(spark, str(tmp_path / "c"))
    assert cache.stats() == {"files": 0, "nodes": 0, "edges": 0, "version": 0}
    rows = spark.createDataFrame([("a", "x", "h")], "path string, language string, content_hash string")
    cache.put(rows, rows.select("path", "content_hash"), rows.select("path", "content_hash").limit(0))
    assert cache.stats() == {"files": 1, "nodes": 1, "edges": 0, "version": 1}
