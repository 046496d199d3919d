"""A small source file for every detector, and the rows it must give; NAME stands for a name taken from a table.

The queries over them put each name of ``nation`` into each file, run every detector of the file's language and
return what the specimen's own detector found, next to SQL that fills the names into the rows below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.detectors import engine

#: What names are put in for: letters that no name of an API holds.
NAME = "ZQZ"


@dataclass(frozen=True)
class Specimen:
    family: str
    detector: str
    path: str
    language: str
    text: str
    nodes: list[tuple[str, str]]  # kind and label
    edges: list[tuple[str, str]]  # kind and target


def families() -> list[str]:
    return sorted({s.family for s in SPECIMENS})


def of(family: str) -> list[Specimen]:
    return [s for s in SPECIMENS if s.family == family]


def files(names: DataFrame, specimens: list[Specimen]) -> DataFrame:
    """(path, language, content, content_hash) of each specimen with each name (column n_name); the detector's name stands as the hash."""
    one = lambda s: F.struct(F.lit(s.path).alias("path"), F.lit(s.language).alias("language"), F.lit(s.text).alias("content"), F.lit(s.detector).alias("content_hash"))
    each = names.select("n_name", F.explode(F.array(*map(one, specimens))).alias("f"))
    put = lambda c: F.replace(F.col(f"f.{c}"), F.lit(NAME), F.col("n_name")).alias(c)
    return each.select(put("path"), F.col("f.language").alias("language"), put("content"), F.col("f.content_hash").alias("content_hash"))


def findings(names: DataFrame, family: str) -> DataFrame:
    """detector, path, item, kind, label of what each specimen's detector finds."""
    found = engine.detect(files(names, of(family)))
    rows = lambda d, item, label: d.filter("source = content_hash").select(F.col("source").alias("detector"), "path", F.lit(item).alias("item"), "kind", F.col(label).alias("label"))
    return rows(engine.raw_nodes(found), "node", "label").unionByName(rows(engine.raw_edges(found), "edge", "dst"))


def sql(family: str) -> str:
    quoted = lambda *x: "(" + ", ".join("'" + y.replace("'", "''") + "'" for y in x) + ")"
    rows = [quoted(s.detector, s.path, item, kind, label) for s in of(family) for item, found in (("node", s.nodes), ("edge", s.edges)) for kind, label in found]
    return f"SELECT detector, replace(path, '{NAME}', n_name) AS path, item, kind, replace(label, '{NAME}', n_name) AS label FROM nation, (VALUES {', '.join(rows)}) AS t(detector, path, item, kind, label)"


#: (path, language, text) of small sources with calls, types and comments, and what must be found in them.
SOURCES = [
    ("src/ZQZ.py", "python", 'class ZQZ(Base, Mixin):\n    """Keeps ZQZ."""\n\n    def run(self):\n        helperZQZ()\n\ndef helperZQZ():\n    print(1)\n'),
    ("src/ZQZ.java", "java", "/** Serves ZQZ. */\npublic class ZQZ extends Base implements Runnable {\n  public void run() {\n    helperZQZ();\n  }\n}\n"),
    ("src/ZQZ.go", "go", "package m\n\nvar _ Reader = (*ZQZ)(nil)\n\nfunc runZQZ() {\n\thelperZQZ()\n}\n"),
    ("src/ZQZ.ts", "typescript", "export class ZQZ extends Base implements Store {\n}\nfunction runZQZ() {\n  helperZQZ();\n}\n"),
]
CALLS = [("src/ZQZ.py", "run", "helperZQZ"), ("src/ZQZ.py", "helperZQZ", "print"), ("src/ZQZ.java", "run", "helperZQZ"), ("src/ZQZ.go", "runZQZ", "helperZQZ"), ("src/ZQZ.ts", "runZQZ", "helperZQZ")]
TYPES = [("src/ZQZ.py", "ZQZ", "extends_type", "Base, Mixin"), ("src/ZQZ.java", "ZQZ", "extends_type", "Base"), ("src/ZQZ.java", "ZQZ", "implements_types", "Runnable"), ("src/ZQZ.go", "ZQZ", "implements_types", "Reader"), ("src/ZQZ.ts", "ZQZ", "extends_type", "Base"), ("src/ZQZ.ts", "ZQZ", "implements_types", "Store")]
COMMENTS = [("src/ZQZ.py", 1, "Keeps ZQZ."), ("src/ZQZ.java", 2, "Serves ZQZ.")]


def sources(names: DataFrame) -> DataFrame:
    """(path, language, content) of SOURCES with each name."""
    one = lambda s: F.struct(F.lit(s[0]).alias("path"), F.lit(s[1]).alias("language"), F.lit(s[2]).alias("content"))
    each = names.select("n_name", F.explode(F.array(*map(one, SOURCES))).alias("f"))
    put = lambda c: F.replace(F.col(f"f.{c}"), F.lit(NAME), F.col("n_name")).alias(c)
    return each.select(put("path"), F.col("f.language").alias("language"), put("content"))


def source_sql(rows: list[tuple], columns: list[str]) -> str:
    """SQL that fills the names of ``nation`` into ``rows``."""
    value = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    listed = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    shown = ", ".join(c if isinstance(v, int) else f"replace({c}, 'ZQZ', n_name) AS {c}" for c, v in zip(columns, rows[0], strict=True))
    return f"SELECT {shown} FROM nation, (VALUES {listed}) AS t({', '.join(columns)})"


SPECIMENS = [
    Specimen('auth', 'certificate_auth', 'src/ZQZ.java', 'java', 'class ZQZ { X509Certificate cert; }\nString s = "mTLS";\nSystem.setProperty("javax.net.ssl.keyStore", "ZQZ");', [('guard', 'mTLS'), ('guard', 'X.509'), ('guard', 'TLS configuration')], []),
    Specimen('auth', 'ldap_auth', 'src/ZQZ.py', 'python', "import ldap3\nserver = ldap3.Server('ZQZ')\nAUTH_LDAP_SERVER_URI = 'ZQZ'", [('guard', 'LDAP: ldap3.'), ('guard', 'LDAP: AUTH_LDAP_SERVER_URI')], []),
    Specimen('auth', 'session_header_auth', 'src/ZQZ.ts', 'typescript', "import session from 'express-session';\nconst key = req.headers['x-api-key'];\napp.use(csurf());\nconst a = req.headers.authorization; // ZQZ", [('middleware', 'session: express-session'), ('guard', "API key: 'x-api-key'"), ('guard', 'CSRF: csurf'), ('guard', 'authorization header')], []),
    Specimen('auth', 'spring_security', 'src/ZQZ.java', 'java', '@EnableWebSecurity\nclass ZQZ {\n  @PreAuthorize("hasRole(\'ZQZ\')")\n  void a() {}\n  @Secured("ROLE_ZQZ")\n  void b() {}\n}', [('guard', 'PreAuthorize'), ('guard', 'Secured'), ('guard', '@EnableWebSecurity')], []),
    Specimen('auth', 'django_auth', 'src/ZQZ.py', 'python', "@login_required\ndef a(request): ...\n\n@permission_required('app.ZQZ')\ndef b(request): ...\n\nclass ZQZ(LoginRequiredMixin, View): ...", [('guard', 'login_required'), ('guard', 'app.ZQZ'), ('guard', 'LoginRequiredMixin')], []),
    Specimen('auth', 'fastapi_auth', 'src/ZQZ.py', 'python', "oauth = OAuth2PasswordBearer(tokenUrl='ZQZ')\n\n@app.get('/ZQZ')\ndef a(user=Depends(get_current_user)): ...", [('guard', 'get_current_user'), ('guard', 'OAuth2PasswordBearer')], []),
    Specimen('auth', 'typescript.nestjs_guards', 'src/ZQZ.ts', 'typescript', "import { UseGuards } from '@nestjs/common';\n@UseGuards(ZQZGuard)\n@Roles('ZQZ')\nclass A {}\nclass ZQZGuard implements CanActivate {}\nconst g = AuthGuard('jwt');", [('guard', 'ZQZGuard'), ('guard', "roles 'ZQZ'"), ('guard', 'ZQZGuard'), ('guard', 'AuthGuard jwt')], []),
    Specimen('auth', 'typescript.passport_jwt', 'src/ZQZ.ts', 'typescript', "passport.use(new ZQZStrategy());\napp.get('/', passport.authenticate('ZQZ'));\njwt.verify(token, key);", [('guard', 'ZQZStrategy'), ('middleware', 'ZQZ'), ('middleware', 'jwt.verify')], []),
    Specimen('csharp', 'csharp_efcore', 'src/ZQZ.cs', 'csharp', 'public class ZQZContext : DbContext {\n  public DbSet<ZQZ> All { get; set; }\n}\npublic class AddZQZ : Migration {\n  void Up() { b.CreateTable(name: "ZQZ_rows"); }\n}', [('repository', 'ZQZContext'), ('entity', 'ZQZ'), ('migration', 'AddZQZ'), ('entity', 'ZQZ_rows')], [('queries', 'efcore:entity:ZQZ')]),
    Specimen('csharp', 'csharp_minimal_apis', 'src/ZQZ.cs', 'csharp', 'var b = WebApplication.CreateBuilder(args);\napp.UseAuthorization();\napp.MapGet("/ZQZ", () => 1);\napp.MapPost("/ZQZ", () => 1);', [('endpoint', 'GET /ZQZ'), ('endpoint', 'POST /ZQZ'), ('guard', 'UseAuthorization'), ('module', 'src/ZQZ.cs')], [('exposes', 'src/ZQZ.cs:GET:/ZQZ'), ('exposes', 'src/ZQZ.cs:POST:/ZQZ')]),
    Specimen('csharp', 'csharp_structures', 'src/ZQZ.cs', 'csharp', 'using System.Text;\nnamespace App.ZQZ;\npublic class ZQZ : Base { }\npublic interface IZQZ { }\npublic class ZQZImpl : IZQZ { }\npublic enum ZQZKind { A }\npublic abstract class ZQZBase { }\n[HttpGet("ZQZ")]', [('module', 'App.ZQZ'), ('abstract_class', 'ZQZBase'), ('class', 'ZQZ'), ('class', 'ZQZImpl'), ('interface', 'IZQZ'), ('enum', 'ZQZKind'), ('external', 'System.Text'), ('module', 'src/ZQZ.cs'), ('endpoint', 'GET ZQZ')], [('imports', 'csharp:external:System.Text'), ('extends', 'Base'), ('implements', 'IZQZ')]),
    Specimen('frontend', 'frontend.angular_components', 'src/ZQZ.ts', 'typescript', "@Component({ selector: 'ZQZ' })\nexport class ZQZComponent {}\n@Injectable()\nexport class ZQZService {}", [('component', 'ZQZComponent'), ('middleware', 'ZQZService')], []),
    Specimen('frontend', 'frontend.frontend_routes', 'src/ZQZ.tsx', 'typescript', 'const a = <Route path="/ZQZ" element={<ZQZ/>} />;\nconst b = [{ path: \'/list-ZQZ\', component: ZQZList }];', [('endpoint', '/ZQZ'), ('endpoint', '/list-ZQZ')], [('renders', 'ZQZList')]),
    Specimen('frontend', 'frontend.react_components', 'src/ZQZ.tsx', 'typescript', "import React from 'react';\nexport function ZQZ() { return <ZQZItem/>; }\nclass ZQZOld extends React.Component {}\nexport const useZQZ = () => 1;", [('component', 'ZQZ'), ('component', 'ZQZOld'), ('hook', 'useZQZ')], [('renders', 'ZQZItem')]),
    Specimen('frontend', 'frontend.svelte_components', 'src/ZQZ.svelte', 'svelte', '<script>\n  export let ZQZ;\n</script>\n<p>{ZQZ}</p>', [('component', 'src/ZQZ.svelte')], []),
    Specimen('frontend', 'frontend.vue_components', 'src/ZQZ.vue', 'vue', '<template><p/></template>\n<script setup>\nexport function useZQZ() { return 1 }\n</script>', [('component', 'ZQZ'), ('hook', 'useZQZ')], []),
    Specimen('generic', 'generic_imports', 'src/ZQZ.java', 'java', 'import java.util.List;\nimport org.ZQZ.Thing;', [('module', 'java.util.List'), ('module', 'src/ZQZ.java'), ('module', 'org.ZQZ.Thing')], [('imports', 'java:external:java.util.List'), ('imports', 'java:external:org.ZQZ.Thing')]),
    Specimen('go', 'go_orm', 'src/ZQZ.go', 'go', 'package m\n\ntype ZQZ struct {\n\tgorm.Model\n}\n\nfunc f() {\n\tdb, _ := gorm.Open(x)\n\tdb.AutoMigrate(&ZQZ{})\n}', [('entity', 'ZQZ'), ('migration', '&ZQZ{}'), ('database_connection', 'gorm.Open')], []),
    Specimen('go', 'go_structures', 'src/ZQZ.go', 'go', 'package ZQZ\n\nimport (\n\t"fmt"\n)\n\ntype S struct {}\n\ntype I interface {}\n\nfunc (s *S) Run() {}\n\nfunc ZQZRun() {}', [('module', 'ZQZ'), ('class', 'S'), ('interface', 'I'), ('method', 'Run'), ('method', 'ZQZRun'), ('external', 'fmt'), ('module', 'src/ZQZ.go')], [('defines', 'src/ZQZ.go:S:Run'), ('defines', 'src/ZQZ.go::ZQZRun'), ('imports', 'go:external:fmt')]),
    Specimen('go', 'go_web', 'src/ZQZ.go', 'go', 'package m\n\nfunc f() {\n\tr.GET("/ZQZ", h)\n\thttp.HandleFunc("/any-ZQZ", h)\n\tr.Use(ZQZLog)\n}', [('endpoint', 'GET /ZQZ'), ('endpoint', '/any-ZQZ'), ('middleware', 'ZQZLog')], []),
    Specimen('iac', 'bicep', 'src/ZQZ.bicep', 'bicep', "param ZQZ string\nresource acc 'Microsoft.Storage/storageAccounts@2021-02-01' = {\n}\nmodule net './ZQZ.bicep' = {\n}", [('azure_resource', 'acc'), ('config_key', 'ZQZ'), ('infra_resource', 'module net (./ZQZ.bicep)'), ('external', './ZQZ.bicep'), ('module', 'src/ZQZ.bicep')], [('depends_on', 'bicep:external:./ZQZ.bicep')]),
    Specimen('iac', 'dockerfile', 'src/ZQZ/Dockerfile', 'dockerfile', 'FROM python:3 AS base\nARG ZQZ\nENV ZQZ_HOME=1\nEXPOSE 8080/tcp\nLABEL team=ZQZ\nFROM alpine\nCOPY --from=base /a /a', [('infra_resource', 'FROM python:3 AS base'), ('infra_resource', 'FROM alpine'), ('external', 'python:3'), ('module', 'src/ZQZ/Dockerfile'), ('external', 'alpine'), ('endpoint', 'port 8080'), ('config_definition', 'ZQZ_HOME'), ('config_definition', 'ZQZ'), ('config_definition', 'team')], [('depends_on', 'docker:image:python:3'), ('depends_on', 'docker:image:alpine'), ('depends_on', 'docker:src/ZQZ/Dockerfile:from:base')]),
    Specimen('iac', 'terraform', 'src/ZQZ.tf', 'terraform', 'resource "aws_s3_bucket" "ZQZ" {\n}\ndata "aws_ami" "ZQZ" {\n}\nmodule "ZQZ" {\n  source = "./ZQZ"\n}\nvariable "ZQZ" {\n}\noutput "ZQZ" {\n}\nprovider "aws" {\n}', [('infra_resource', 'aws_s3_bucket.ZQZ'), ('infra_resource', 'data.aws_ami.ZQZ'), ('module', 'ZQZ'), ('config_definition', 'ZQZ'), ('config_definition', 'ZQZ'), ('config_definition', 'aws')], [('depends_on', './ZQZ')]),
    Specimen('jvm_messaging', 'active_mq', 'src/ZQZ.java', 'java', 'import org.apache.activemq.ActiveMQConnectionFactory;\nclass ZQZ {\n  Object f = new ActiveMQConnectionFactory("tcp://ZQZ");\n  void a() { s.createQueue("ZQZ.in"); s.createTopic("ZQZ.all"); p.send(m); c.receive(); }\n}', [('message_queue', 'activemq:ActiveMQConnectionFactory'), ('queue', 'activemq:queue:ZQZ.in'), ('topic', 'activemq:topic:ZQZ.all')], [('connects_to', 'activemq:server:ActiveMQConnectionFactory'), ('sends_to', 'activemq:queue:ZQZ.in'), ('receives_from', 'activemq:queue:ZQZ.in'), ('sends_to', 'activemq:topic:ZQZ.all'), ('receives_from', 'activemq:topic:ZQZ.all')]),
    Specimen('jvm_messaging', 'ibm_mq', 'src/ZQZ.java', 'java', 'import com.ibm.mq.MQQueueManager;\nclass ZQZ {\n  void a() { m = new MQQueueManager("QM_ZQZ"); q = m.accessQueue("ZQZ.Q", 1); q.put(x); q.get(x); }\n}', [('message_queue', 'ibm_mq:QM_ZQZ'), ('queue', 'ibm_mq:queue:ZQZ.Q')], [('connects_to', 'ibm_mq:server:QM_ZQZ'), ('sends_to', 'ibm_mq:queue:ZQZ.Q'), ('receives_from', 'ibm_mq:queue:ZQZ.Q')]),
    Specimen('jvm_messaging', 'tibco_ems', 'src/ZQZ.java', 'java', 'class ZQZ {\n  Object f = new TibjmsQueueConnectionFactory("tcp://ZQZ");\n  void a() { s.createQueue("ZQZ.q"); s.createTopic("ZQZ.t"); c.receive(); }\n}', [('message_queue', 'tibco_ems:TibjmsQueueConnectionFactory'), ('queue', 'tibco_ems:queue:ZQZ.q'), ('topic', 'tibco_ems:topic:ZQZ.t')], [('connects_to', 'tibco_ems:server:TibjmsQueueConnectionFactory'), ('receives_from', 'tibco_ems:queue:ZQZ.q'), ('receives_from', 'tibco_ems:topic:ZQZ.t')]),
    Specimen('jvm_messaging', 'azure_functions', 'src/ZQZ.java', 'java', 'class ZQZ {\n  @FunctionName("ZQZ")\n  public void run(@HttpTrigger(name = "r") Object r) {}\n  @FunctionName("ZQZ2")\n  public void two(@ServiceBusQueueTrigger(name = "m", queueName = "ZQZ-q") String m) {}\n}', [('azure_function', 'ZQZ'), ('azure_function', 'ZQZ2'), ('endpoint', 'HTTP trigger'), ('queue', 'ZQZ-q')], [('exposes', 'src/ZQZ.java:http:3'), ('triggers', 'java:file:src/ZQZ.java')]),
    Specimen('jvm_messaging', 'azure_messaging', 'src/ZQZ.java', 'java', 'class ZQZ {\n  ServiceBusSenderClient c = b.sender().queueName("ZQZ-q").buildClient();\n  EventHubConsumerClient e = b.eventHubName("ZQZ-h");\n}', [('queue', 'ZQZ-q'), ('topic', 'ZQZ-h')], [('connects_to', 'azure:servicebus:ZQZ-q'), ('connects_to', 'azure:eventhub:ZQZ-h'), ('sends_to', 'azure:ServiceBusSenderClient'), ('receives_from', 'azure:EventHubConsumerClient')]),
    Specimen('jvm', 'java.class_hierarchy', 'src/ZQZ.java', 'java', 'public class ZQZ extends Base implements Runnable {\n  enum Kind { A }\n}\ninterface ZQZApi {}\nabstract class ZQZBase {}\n@interface ZQZMark {}', [('class', 'ZQZ'), ('abstract_class', 'ZQZBase'), ('interface', 'ZQZApi'), ('enum', 'Kind'), ('annotation_type', 'ZQZMark')], [('extends', 'Base'), ('implements', 'Runnable')]),
    Specimen('jvm', 'config_def', 'src/ZQZ.java', 'java', '@ConfigurationProperties(prefix = "ZQZ")\nclass ZQZ {\n  @Value("${ZQZ.size:3}") int size;\n  void a() { d.define("ZQZ.retry", 1); }\n}', [('config_definition', 'ZQZ.size'), ('config_definition', 'ZQZ'), ('config_definition', 'ZQZ.retry')], [('reads_config', 'config:ZQZ.size'), ('reads_config', 'config:ZQZ'), ('reads_config', 'config:ZQZ.retry')]),
    Specimen('jvm', 'cosmos_db', 'src/ZQZ.java', 'java', 'class ZQZ {\n  CosmosClient c;\n  void a() { c.getDatabase("ZQZ-db").getContainer("ZQZ-c"); }\n}', [('azure_resource', 'ZQZ-db'), ('azure_resource', 'ZQZ-c')], [('connects_to', 'cosmos:database:ZQZ-db'), ('connects_to', 'cosmos:container:ZQZ-c')]),
    Specimen('jvm', 'graphql_resolver', 'src/ZQZ.java', 'java', 'class ZQZ {\n  @QueryMapping\n  public Thing findZQZ(String id) { return null; }\n  @MutationMapping\n  public Thing saveZQZ(Thing t) { return t; }\n}', [('endpoint', 'findZQZ'), ('endpoint', 'saveZQZ')], [('exposes', 'src/ZQZ.java:graphql:findZQZ'), ('exposes', 'src/ZQZ.java:graphql:saveZQZ')]),
    Specimen('jvm', 'grpc_service', 'src/ZQZ.java', 'java', 'class ZQZ extends ZQZSvcGrpc.ZQZSvcImplBase {\n  Object s = OtherGrpc.newBlockingStub(ch);\n}', [('endpoint', 'ZQZSvc')], [('exposes', 'grpc:ZQZSvc'), ('calls', 'grpc:Other')]),
    Specimen('jvm', 'jaxrs', 'src/ZQZ.java', 'java', '@Path("/ZQZ")\nclass ZQZ {\n  @GET\n  @Path("/one")\n  public String one() { return ""; }\n  @POST\n  public void add(String x) {}\n}', [('endpoint', 'one'), ('endpoint', 'add')], [('exposes', 'src/ZQZ.java:ZQZ:one:GET'), ('exposes', 'src/ZQZ.java:ZQZ:add:POST')]),
    Specimen('jvm', 'jdbc', 'src/ZQZ.java', 'java', 'class ZQZ {\n  String u = "jdbc:postgresql://host/ZQZ";\n  private JdbcTemplate template;\n}', [('database_connection', 'postgresql@host/ZQZ'), ('database_connection', 'JdbcTemplate')], [('connects_to', 'db:postgresql:host/ZQZ'), ('connects_to', 'src/ZQZ.java:JdbcTemplate')]),
    Specimen('jvm_messaging', 'jms', 'src/ZQZ.java', 'java', 'class ZQZ {\n  @JmsListener(destination = "ZQZ.in")\n  void a(String m) { jmsTemplate.convertAndSend("ZQZ.out", m); }\n}', [('queue', 'jms:ZQZ.in'), ('queue', 'jms:ZQZ.out')], [('consumes', 'jms:queue:ZQZ.in'), ('produces', 'jms:queue:ZQZ.out')]),
    Specimen('jvm', 'jpa_entity', 'src/ZQZ.java', 'java', '@Entity\n@Table(name = "ZQZ_rows")\npublic class ZQZ {}', [('entity', 'ZQZ')], []),
    Specimen('jvm_messaging', 'kafka', 'src/ZQZ.java', 'java', 'class ZQZ {\n  @KafkaListener(topics = "ZQZ-in")\n  void a(String m) { kafkaTemplate.send("ZQZ-out", m); }\n}', [('topic', 'kafka:ZQZ-in'), ('topic', 'kafka:ZQZ-out')], [('consumes', 'kafka:topic:ZQZ-in'), ('produces', 'kafka:topic:ZQZ-out')]),
    Specimen('jvm_messaging', 'kafka_protocol', 'src/ZQZ.java', 'java', 'public class ZQZRequest extends AbstractRequest {}\nclass ZQZResponse extends AbstractResponse {}', [('protocol_message', 'ZQZRequest'), ('protocol_message', 'ZQZResponse')], [('extends', 'AbstractRequest'), ('extends', 'AbstractResponse')]),
    Specimen('jvm', 'micronaut', 'src/ZQZ.java', 'java', 'import io.micronaut.http.annotation.Get;\n@Singleton\nclass ZQZ {\n  @Get("/ZQZ")\n  public String one() { return ""; }\n  @Scheduled(fixedDelay = "1s")\n  void tick() {}\n  @EventListener\n  void on() {}\n  @Client("ZQZ-api") Object api;\n}', [('class', 'ZQZ'), ('endpoint', 'one'), ('middleware', 'scheduled fixedDelay = "1s"'), ('event', 'event listener')], [('exposes', 'src/ZQZ.java:GET:one'), ('depends_on', 'ZQZ-api')]),
    Specimen('jvm', 'module_deps', 'ZQZ/pom.xml', 'xml', '<project>\n<artifactId>ZQZ</artifactId>\n<modules><module>ZQZ-core</module></modules>\n<dependencies><dependency><groupId>g</groupId><artifactId>ZQZ-lib</artifactId></dependency></dependencies>\n</project>', [('module', 'ZQZ')], [('contains', 'maven:module:ZQZ-core'), ('depends_on', 'g:ZQZ-lib')]),
    Specimen('jvm', 'java.public_api', 'src/ZQZ.java', 'java', 'class ZQZ {\n  public String findZQZ(int id) { return null; }\n  protected void saveZQZ() {}\n  private void hidden() {}\n}', [('method', 'findZQZ'), ('method', 'saveZQZ')], [('defines', 'src/ZQZ.java:ZQZ:findZQZ'), ('defines', 'src/ZQZ.java:ZQZ:saveZQZ')]),
    Specimen('jvm', 'quarkus', 'src/ZQZ.java', 'java', 'import io.quarkus.runtime.Startup;\n@ApplicationScoped\nclass ZQZ {\n  @ConfigProperty(name = "ZQZ.size") int size;\n  @Scheduled(every = "1m")\n  @Transactional\n  void a() {}\n}', [('config_key', 'ZQZ.size'), ('class', 'ZQZ'), ('event', 'scheduled'), ('middleware', 'Transactional')], []),
    Specimen('jvm_messaging', 'rabbitmq', 'src/ZQZ.java', 'java', 'class ZQZ {\n  @RabbitListener(queues = "ZQZ-in")\n  void a(String m) { rabbitTemplate.convertAndSend("ZQZ-out", m); }\n  Object e = new TopicExchange("ZQZ-x");\n}', [('queue', 'rabbitmq:ZQZ-in'), ('queue', 'rabbitmq:ZQZ-out'), ('queue', 'ZQZ-x')], [('consumes', 'rabbitmq:queue:ZQZ-in'), ('produces', 'rabbitmq:queue:ZQZ-out')]),
    Specimen('jvm', 'raw_sql', 'src/ZQZ.java', 'java', 'interface ZQZ {\n  @Query("select q from ZQZ q")\n  List<ZQZ> all();\n}\nclass B { void a() { jdbcTemplate.update("delete from ZQZ"); } }', [('query', 'select q from ZQZ q'), ('query', 'delete from ZQZ')], []),
    Specimen('jvm', 'spring_repository', 'src/ZQZ.java', 'java', 'interface ZQZRepository extends JpaRepository<ZQZ, Long> {}', [('repository', 'ZQZRepository')], [('queries', 'ZQZ')]),
    Specimen('jvm', 'rmi', 'src/ZQZ.java', 'java', 'interface ZQZApi extends Remote {}\nclass ZQZ extends UnicastRemoteObject {\n  void a() { Naming.rebind("ZQZ-svc", this); Naming.lookup("other"); }\n}', [('rmi_interface', 'ZQZApi')], [('exports_rmi', 'rmi:ZQZ'), ('exports_rmi', 'rmi:ZQZ-svc'), ('invokes_rmi', 'rmi:other')]),
    Specimen('jvm', 'spring_events', 'src/ZQZ.java', 'java', 'class ZQZ {\n  void a() { bus.publishEvent(new ZQZMade(this)); }\n  @EventListener\n  public void on(ZQZGone e) {}\n}', [('event', 'ZQZMade'), ('event', 'ZQZGone')], [('publishes', 'event:ZQZMade'), ('listens', 'event:ZQZGone')]),
    Specimen('jvm', 'spring_rest', 'src/ZQZ.java', 'java', '@RestController\n@RequestMapping("/ZQZ")\nclass ZQZ {\n  @GetMapping("/{id}")\n  public String one(String id) { return id; }\n  @PostMapping\n  public void add() {}\n}', [('endpoint', 'one'), ('endpoint', 'add')], []),
    Specimen('jvm', 'websocket', 'src/ZQZ.java', 'java', '@ServerEndpoint("/ZQZ")\nclass ZQZ {\n  @MessageMapping("/say-ZQZ")\n  @SendTo("/topic/ZQZ")\n  void a() {}\n}', [('websocket_endpoint', '/ZQZ'), ('websocket_endpoint', '/say-ZQZ')], [('exposes', 'ws:/ZQZ'), ('exposes', 'ws:/say-ZQZ'), ('produces', 'ws:/topic/ZQZ')]),
    Specimen('jvm', 'kotlin_structures', 'src/ZQZ.kt', 'kotlin', 'import app.ZQZ\n\nclass ZQZ : Base\ninterface ZQZApi\nobject ZQZOnly\nfun runZQZ() {}', [('class', 'ZQZ'), ('class', 'ZQZOnly'), ('interface', 'ZQZApi'), ('method', 'runZQZ'), ('external', 'app.ZQZ'), ('module', 'src/ZQZ.kt')], [('imports', 'kotlin:external:app.ZQZ'), ('extends', 'Base')]),
    Specimen('jvm', 'ktor_routes', 'src/ZQZ.kt', 'kotlin', 'import io.ktor.server.routing.*\nfun a() {\n  install(CORS)\n  routing {\n    authenticate("ZQZ") {\n      get("/ZQZ") { }\n    }\n  }\n}', [('module', 'src/ZQZ.kt'), ('endpoint', 'GET /ZQZ'), ('guard', 'ZQZ'), ('middleware', 'CORS')], []),
    Specimen('jvm', 'scala_structures', 'src/ZQZ.scala', 'scala', 'import app.ZQZ\ntrait T\nclass ZQZ extends Base with T {\n  def runZQZ = 1\n}\nobject ZQZOnly', [('class', 'ZQZ'), ('class', 'ZQZOnly'), ('interface', 'T'), ('method', 'runZQZ'), ('external', 'app.ZQZ'), ('module', 'src/ZQZ.scala')], [('imports', 'scala:external:app.ZQZ'), ('extends', 'Base'), ('implements', 'T')]),
    Specimen('markup', 'markdown_structure', 'docs/ZQZ.md', 'markdown', '# ZQZ\n\n## Use\n\nSee [more](more-ZQZ.md) and [web](https://x.y).', [('module', 'docs/ZQZ.md'), ('config_key', 'ZQZ'), ('config_key', 'Use')], [('contains', 'md:docs/ZQZ.md:1'), ('contains', 'md:docs/ZQZ.md:3'), ('depends_on', 'more-ZQZ.md')]),
    Specimen('markup', 'proto_structure', 'src/ZQZ.proto', 'proto', 'package app.ZQZ;\nimport "base.proto";\nservice ZQZService {\n  rpc Get (ZQZRequest) returns (ZQZReply);\n}\nmessage ZQZRequest {}', [('config_key', 'app.ZQZ'), ('external', 'base.proto'), ('module', 'src/ZQZ.proto'), ('interface', 'ZQZService'), ('method', 'Get'), ('protocol_message', 'ZQZRequest')], [('imports', 'proto:external:base.proto'), ('contains', 'proto:src/ZQZ.proto:rpc:Get')]),
    Specimen('python', 'python.celery_tasks', 'src/ZQZ.py', 'python', '@shared_task\ndef mailZQZ(): ...\n\nmailZQZ.delay()', [('method', 'mailZQZ'), ('queue', 'celery:mailZQZ')], [('consumes', 'celery:queue:mailZQZ'), ('produces', 'celery:queue:mailZQZ')]),
    Specimen('python', 'python.django_models', 'src/ZQZ.py', 'python', "class ZQZ(models.Model):\n    owner = models.ForeignKey('User')", [('entity', 'ZQZ'), ('module', 'src/ZQZ.py')], [('depends_on', 'User')]),
    Specimen('python', 'python.django_views', 'src/ZQZ.py', 'python', "urlpatterns = [path('ZQZ/', views.one)]\n\nclass ZQZList(ListView): ...", [('endpoint', '/ZQZ/'), ('class', 'ZQZList')], []),
    Specimen('python', 'python.fastapi_routes', 'src/ZQZ.py', 'python', "@router.get('/ZQZ/{id}')\nasync def one(id): ...\n\n@app.post('/ZQZ')\ndef add(): ...", [('endpoint', 'GET /ZQZ/{id}'), ('endpoint', 'POST /ZQZ')], []),
    Specimen('python', 'python.flask_routes', 'src/ZQZ.py', 'python', "@bp.route('/ZQZ', methods=['POST'])\ndef addZQZ(): ...", [('endpoint', 'addZQZ')], []),
    Specimen('python', 'kafka_python', 'src/ZQZ.py', 'python', "from kafka import KafkaConsumer\nc = KafkaConsumer('ZQZ-in')\np.send('ZQZ-out', b'')", [('topic', 'kafka:ZQZ-out'), ('topic', 'kafka:ZQZ-in'), ('external', 'kafka'), ('module', 'src/ZQZ.py')], [('produces', 'kafka:topic:ZQZ-out'), ('consumes', 'kafka:topic:ZQZ-in'), ('imports', 'py:external:kafka')]),
    Specimen('python', 'python.pydantic_models', 'src/ZQZ.py', 'python', 'class ZQZ(BaseModel):\n    a: int\n\nclass ZQZSettings(BaseSettings): ...', [('entity', 'ZQZ'), ('config_definition', 'ZQZSettings')], [('extends', 'BaseModel')]),
    Specimen('python', 'python.sqlalchemy_models', 'src/ZQZ.py', 'python', "class ZQZ(Base):\n    __tablename__ = 'ZQZ_rows'\n    owner = relationship('User')", [('entity', 'ZQZ')], [('maps_to', 'User')]),
    Specimen('python', 'python_structures', 'src/ZQZ.py', 'python', "import os\nfrom app.ZQZ import x\n\n__all__ = ['ZQZ']\n\nclass ZQZ(Base):\n    def run(self): ...\n\nasync def go(): ...", [('class', 'ZQZ'), ('method', 'run'), ('method', 'go'), ('external', 'app.ZQZ'), ('module', 'src/ZQZ.py'), ('external', 'os')], [('defines', 'src/ZQZ.py:run:7'), ('defines', 'src/ZQZ.py:go:8'), ('imports', 'py:external:app.ZQZ'), ('imports', 'py:external:os'), ('extends', 'Base')]),
    Specimen('shell', 'bash', 'src/ZQZ.sh', 'bash', '#!/bin/bash\nsource ./ZQZ-lib.sh\nexport ZQZ=1\nrunZQZ() {\n  docker ps\n}', [('module', 'src/ZQZ.sh'), ('method', 'runZQZ'), ('external', './ZQZ-lib.sh'), ('config_definition', 'ZQZ')], [('imports', 'bash:external:./ZQZ-lib.sh'), ('calls', 'tool:docker')]),
    Specimen('shell', 'powershell', 'src/ZQZ.ps1', 'powershell', 'Import-Module ZQZ\n. ./ZQZ-lib.ps1\nfunction Get-ZQZ {\n  [CmdletBinding()]\n  param([string]$ZQZ)\n}', [('method', 'Get-ZQZ'), ('external', 'ZQZ'), ('module', 'src/ZQZ.ps1'), ('external', './ZQZ-lib.ps1'), ('config_definition', 'ZQZ')], [('imports', 'ps:external:ZQZ'), ('imports', 'ps:external:./ZQZ-lib.ps1')]),
    Specimen('shell', 'batch_structure', 'src/ZQZ.bat', 'batch', '@echo off\nset ZQZ=1\ncall :ZQZ_sub\n:ZQZ_sub\necho x', [('module', 'src/ZQZ.bat'), ('method', 'ZQZ_sub'), ('config_definition', 'ZQZ')], [('contains', 'src/ZQZ.bat:ZQZ_sub'), ('calls', 'src/ZQZ.bat:ZQZ_sub')]),
    Specimen('sql', 'sql_migration', 'db/ZQZ.sql', 'sql', 'CREATE TABLE ZQZ (id int REFERENCES base(id));', [('sql_entity', 'ZQZ'), ('migration', 'db/ZQZ.sql')], [('migrates', 'sql_entity:ZQZ'), ('references_table', 'sql_entity:base')]),
    Specimen('sql', 'sql_structure', 'db/ZQZ.sql', 'sql', 'CREATE TABLE ZQZ (id int REFERENCES base(id));\nCREATE VIEW ZQZ_v AS SELECT 1;\nCREATE INDEX ZQZ_i ON ZQZ (id);\nCREATE FUNCTION ZQZ_f() RETURNS int;', [('entity', 'ZQZ'), ('entity', 'ZQZ_v'), ('config_definition', 'ZQZ_i'), ('config_definition', 'ZQZ_f')], [('depends_on', 'sql:table:base')]),
    Specimen('structured', 'cloudformation', 'ZQZ.yaml', 'yaml', "Parameters:\n  ZQZSize: {Type: String}\nResources:\n  ZQZ: {Type: 'AWS::S3::Bucket', Properties: {Role: {Ref: ZQZRole}}}\n  ZQZRole: {Type: 'AWS::IAM::Role'}\nOutputs:\n  ZQZName: {Value: x}", [('infra_resource', 'ZQZ'), ('infra_resource', 'ZQZRole'), ('config_definition', 'ZQZSize'), ('config_definition', 'ZQZName')], [('depends_on', 'cfn:ZQZ.yaml:resource:ZQZRole')]),
    Specimen('structured', 'docker_compose', 'ZQZ/docker-compose.yml', 'yaml', "services:\n  ZQZ: {image: x, ports: ['80:80'], depends_on: [db]}\n  db: {image: y}", [('infra_resource', 'ZQZ'), ('config_key', 'ZQZ:80:80'), ('infra_resource', 'db')], [('depends_on', 'compose:ZQZ/docker-compose.yml:service:db')]),
    Specimen('structured', 'github_actions', '.github/workflows/ZQZ.yml', 'yaml', 'name: ZQZ\non: [push]\njobs:\n  a: {}\n  b: {needs: a}', [('module', 'ZQZ'), ('config_key', 'push'), ('method', 'a'), ('method', 'b')], [('contains', 'gha:.github/workflows/ZQZ.yml:job:a'), ('contains', 'gha:.github/workflows/ZQZ.yml:job:b'), ('depends_on', 'gha:.github/workflows/ZQZ.yml:job:a')]),
    Specimen('structured', 'gitlab_ci', 'ZQZ/.gitlab-ci.yml', 'yaml', 'stages: [ZQZ]\ninclude: [ZQZ-base.yml]\na: {stage: ZQZ, script: [x]}\nb: {stage: ZQZ, needs: [a], extends: a}', [('module', 'ZQZ/.gitlab-ci.yml'), ('config_key', 'ZQZ'), ('method', 'a'), ('method', 'b')], [('imports', 'ZQZ-base.yml'), ('contains', 'gitlab:ZQZ/.gitlab-ci.yml:job:a'), ('contains', 'gitlab:ZQZ/.gitlab-ci.yml:job:b'), ('depends_on', 'gitlab:ZQZ/.gitlab-ci.yml:job:a'), ('extends', 'gitlab:ZQZ/.gitlab-ci.yml:job:a')]),
    Specimen('structured', 'helm_chart', 'ZQZ/Chart.yaml', 'yaml', 'name: ZQZ\nversion: 1.0.0\ndependencies:\n- {name: ZQZ-dep, version: 2.0.0}', [('module', 'ZQZ')], [('depends_on', 'helm:chart:ZQZ-dep')]),
    Specimen('structured', 'ini_structure', 'ZQZ.ini', 'ini', '[ZQZ]\nsize = 3', [('config_file', 'ZQZ.ini'), ('config_key', 'ZQZ'), ('config_key', 'ZQZ.size')], [('contains', 'ini:ZQZ.ini:ZQZ'), ('contains', 'ini:ZQZ.ini:ZQZ.size')]),
    Specimen('structured', 'json_structure', 'ZQZ.json', 'json', '{"ZQZ": 1, "other": {"a": 2}}', [('config_file', 'ZQZ.json'), ('config_key', 'ZQZ'), ('config_key', 'other')], [('contains', 'json:ZQZ.json:ZQZ'), ('contains', 'json:ZQZ.json:other')]),
    Specimen('structured', 'kubernetes', 'ZQZ.yaml', 'yaml', 'apiVersion: v1\nkind: Service\nmetadata: {name: ZQZ}\nspec: {selector: {app: ZQZ}}\n---\napiVersion: apps/v1\nkind: Deployment\nmetadata: {name: ZQZ}\nspec: {template: {metadata: {labels: {app: ZQZ}}, spec: {containers: [{name: ZQZ-c, image: x}]}}}', [('infra_resource', 'Service/ZQZ'), ('infra_resource', 'Deployment/ZQZ'), ('config_key', 'ZQZ-c')], [('depends_on', 'k8s:Deployment:default:ZQZ')]),
    Specimen('structured', 'config.kubernetes_rbac', 'ZQZ.yaml', 'yaml', 'apiVersion: rbac.authorization.k8s.io/v1\nkind: Role\nmetadata: {name: ZQZ}\nrules: [{verbs: [get], resources: [pods]}]\n---\napiVersion: v1\nkind: ServiceAccount\nmetadata: {name: ZQZ-sa}', [('guard', 'ZQZ'), ('guard', 'ZQZ-sa')], []),
    Specimen('structured', 'openapi', 'ZQZ.yaml', 'yaml', "openapi: 3.0.0\ninfo: {title: ZQZ, version: '1'}\npaths: {/ZQZ: {get: {}, post: {}}}\ncomponents: {schemas: {ZQZ: {type: object, properties: {a: {$ref: '#/components/schemas/Part'}}}, Part: {type: object}}}", [('config_file', 'ZQZ'), ('endpoint', 'GET /ZQZ'), ('endpoint', 'POST /ZQZ'), ('entity', 'ZQZ'), ('entity', 'Part')], [('contains', 'api:ZQZ.yaml:get:/ZQZ'), ('contains', 'api:ZQZ.yaml:post:/ZQZ'), ('depends_on', 'api:ZQZ.yaml:schema:Part')]),
    Specimen('structured', 'package_json', 'ZQZ/package.json', 'json', '{"name": "ZQZ", "version": "1.0.0", "dependencies": {"ZQZ-dep": "1"}, "scripts": {"build": "x"}}', [('module', 'ZQZ'), ('method', 'build')], [('depends_on', 'npm:ZQZ-dep'), ('contains', 'npm:ZQZ/package.json:script:build')]),
    Specimen('structured', 'properties', 'ZQZ.properties', 'properties', 'ZQZ.size=3\nZQZ.url=jdbc:mysql://h/ZQZ', [('config_file', 'ZQZ.properties'), ('config_key', 'ZQZ.size'), ('database_connection', 'ZQZ.url')], [('contains', 'properties:ZQZ.properties:ZQZ.size'), ('contains', 'properties:ZQZ.properties:ZQZ.url')]),
    Specimen('structured', 'pyproject_toml', 'ZQZ/pyproject.toml', 'toml', '[project]\nname = "ZQZ"\nversion = "1"\ndependencies = ["ZQZ-dep>=1"]\n[project.scripts]\nrunZQZ = "m:f"', [('module', 'ZQZ'), ('config_definition', 'runZQZ')], [('depends_on', 'pypi:ZQZ-dep'), ('contains', 'pypi:ZQZ/pyproject.toml:script:runZQZ')]),
    Specimen('structured', 'toml_structure', 'ZQZ.toml', 'toml', '[ZQZ]\nsize = 3', [('config_file', 'ZQZ.toml'), ('config_key', 'ZQZ')], [('contains', 'toml:ZQZ.toml:ZQZ')]),
    Specimen('structured', 'tsconfig_json', 'ZQZ/tsconfig.json', 'json', '{"extends": "./ZQZ.json", "compilerOptions": {"strict": true, "target": "es2020"}}', [('config_file', 'ZQZ/tsconfig.json'), ('config_key', 'strict'), ('config_key', 'target')], [('depends_on', './ZQZ.json'), ('contains', 'tsconfig:ZQZ/tsconfig.json:strict'), ('contains', 'tsconfig:ZQZ/tsconfig.json:target')]),
    Specimen('structured', 'yaml_structure', 'ZQZ.yml', 'yaml', 'ZQZ: 1\nother: {a: 2}', [('config_file', 'ZQZ.yml'), ('config_key', 'ZQZ'), ('config_key', 'other')], [('contains', 'yaml:ZQZ.yml:ZQZ'), ('contains', 'yaml:ZQZ.yml:other')]),
    Specimen('systems', 'cpp_structures', 'src/ZQZ.cpp', 'cpp', '#include <vector>\nnamespace ZQZns {\nclass ZQZ : public Base {\n};\nenum class ZQZKind { A };\nint runZQZ(int x) {\n}\n}', [('class', 'ZQZ'), ('enum', 'ZQZKind'), ('module', 'ZQZns'), ('method', 'runZQZ'), ('external', 'vector'), ('module', 'src/ZQZ.cpp')], [('imports', 'cpp:external:vector'), ('extends', 'Base')]),
    Specimen('systems', 'actix_web', 'src/ZQZ.rs', 'rust', '#[get("/ZQZ")]\nasync fn one() {}\n#[actix_web::main]\nasync fn main() { App::new().wrap(Logger::default()).route("/ZQZ-two", web::post().to(h)); }', [('endpoint', 'GET /ZQZ'), ('endpoint', 'POST /ZQZ-two'), ('middleware', 'Logger::default'), ('module', 'src/ZQZ.rs')], []),
    Specimen('systems', 'rust_structures', 'src/ZQZ.rs', 'rust', 'use std::io;\nmod ZQZmod;\npub struct ZQZ;\nenum ZQZKind { A }\ntrait ZQZApi {}\nimpl ZQZApi for ZQZ {}\npub fn runZQZ() {}\nmacro_rules! mZQZ { }', [('module', 'ZQZmod'), ('class', 'ZQZ'), ('enum', 'ZQZKind'), ('interface', 'ZQZApi'), ('method', 'runZQZ'), ('method', 'mZQZ'), ('external', 'std::io'), ('module', 'src/ZQZ.rs')], [('defines', 'src/ZQZ.rs:runZQZ'), ('imports', 'rust:external:std::io'), ('implements', 'ZQZApi')]),
    Specimen('typescript', 'typescript.express_routes', 'src/ZQZ.ts', 'typescript', "const app = express();\napp.get('/ZQZ', f);\nrouter.post('/ZQZ', f);", [('endpoint', 'GET /ZQZ'), ('endpoint', 'POST /ZQZ')], []),
    Specimen('typescript', 'fastify_routes', 'src/ZQZ.ts', 'typescript', "const fastify = require('fastify')();\nfastify.get('/ZQZ', f);\nfastify.addHook('onRequest', f);\nfastify.register(pluginZQZ);", [('endpoint', 'GET /ZQZ'), ('middleware', 'onRequest'), ('module', 'src/ZQZ.ts')], [('imports', 'pluginZQZ')]),
    Specimen('typescript', 'typescript.graphql_resolvers', 'src/ZQZ.ts', 'typescript', '@Resolver(() => ZQZ)\nexport class ZQZResolver {\n  @Query(() => ZQZ)\n  async oneZQZ() {}\n}', [('class', 'ZQZResolver'), ('endpoint', 'oneZQZ')], []),
    Specimen('typescript', 'kafka_js', 'src/ZQZ.ts', 'typescript', "const kafka = new Kafka({});\np.send({ topic: 'ZQZ-out', messages: [] });\nc.subscribe({ topic: 'ZQZ-in' });\nc.run({ eachMessage: f });", [('database_connection', 'kafka'), ('topic', 'kafka:ZQZ-out'), ('topic', 'kafka:ZQZ-in'), ('event', 'eachMessage')], [('produces', 'kafka:topic:ZQZ-out'), ('consumes', 'kafka:topic:ZQZ-in')]),
    Specimen('typescript', 'mongoose_orm', 'src/ZQZ.ts', 'typescript', "import mongoose from 'mongoose';\nmongoose.connect('x');\nconst ZQZSchema = new mongoose.Schema({});\nconst ZQZ = mongoose.model('ZQZ', ZQZSchema);\nZQZSchema.pre('save', f);\nZQZ.findOne({});", [('database_connection', 'mongodb'), ('entity', 'ZQZ'), ('entity', 'ZQZSchema'), ('event', 'pre save')], [('queries', 'mongoose:ZQZ')]),
    Specimen('typescript', 'typescript.nestjs_controllers', 'src/ZQZ.ts', 'typescript', "@Controller('ZQZ')\nexport class ZQZController {\n  @Get(':id')\n  one() {}\n}", [('class', 'ZQZController'), ('endpoint', 'GET :id')], [('exposes', 'src/ZQZ.ts:GET:one')]),
    Specimen('typescript', 'prisma_orm', 'src/ZQZ.ts', 'typescript', "import { PrismaClient } from '@prisma/client';\nconst prisma = new PrismaClient();\nprisma.itemZQZ.findMany({});", [('database_connection', 'PrismaClient'), ('entity', 'itemZQZ'), ('module', 'src/ZQZ.ts')], [('queries', 'prisma:itemZQZ'), ('imports', '@prisma/client')]),
    Specimen('typescript', 'remix_routes', 'app/routes/ZQZ.tsx', 'typescript', "import { json } from '@remix-run/node';\nexport async function loader() {}\nexport const action = 1;\nexport default function ZQZ() {}", [('endpoint', 'loader'), ('endpoint', 'action'), ('component', 'ZQZ')], []),
    Specimen('typescript', 'sequelize_orm', 'src/ZQZ.ts', 'typescript', "const s = new Sequelize('x');\nconst ZQZ = s.define('ZQZ', {});\nZQZ.hasMany(ZQZPart);\nZQZ.findAll();", [('database_connection', 'Sequelize'), ('entity', 'ZQZ')], [('depends_on', 'sequelize:ZQZPart'), ('queries', 'sequelize:ZQZ')]),
    Specimen('typescript', 'typescript_structures', 'src/ZQZ.ts', 'typescript', "import { a } from './ZQZ-lib';\nexport class ZQZ {}\ninterface ZQZApi {}\ntype ZQZAlias = string;\nenum ZQZKind { A }\nexport function runZQZ() {}\nnamespace ZQZns {}", [('class', 'ZQZ'), ('interface', 'ZQZApi'), ('class', 'ZQZAlias'), ('enum', 'ZQZKind'), ('method', 'runZQZ'), ('external', './ZQZ-lib'), ('module', 'src/ZQZ.ts'), ('module', 'ZQZns')], [('imports', 'ts:external:./ZQZ-lib')]),
    Specimen('typescript', 'typescript.typeorm_entities', 'src/ZQZ.ts', 'typescript', "@Entity('ZQZ_rows')\nexport class ZQZ {\n  @ManyToOne(() => User)\n  owner: User;\n}", [('entity', 'ZQZ')], [('maps_to', 'User')]),
]
