"""Detectors that a few patterns describe."""

from __future__ import annotations

from weftgraph.detectors.engine import Detector, Rule

JS = ("typescript", "javascript")
WEB = (*JS, "vue", "svelte")
_VERB = r"get|post|put|delete|patch|options|head"
_Q = r"[\"'`]"
_OWNER = "{path}:{owner}"


def _words(*names: str) -> str:
    return "|".join(names)


def _guard(pattern: str, auth: str, label: str, kind: str = "guard", /, **props: str) -> Rule:
    return Rule(kind, pattern, label, "{path}:" + auth + ":{line}", {"auth_type": auth, "language": "{language}", **props})


def _topic(broker: str, pattern: str, edge: str, kind: str = "topic", word: str = "topic", owner: str = _OWNER) -> Rule:
    return Rule(kind, pattern, broker + ":{name}", f"{broker}:{word}:{{name}}", {"broker": broker, word: "{name}"}, ((edge, owner, f"{broker}:{word}:{{name}}"),) if edge else ())


def _types(pattern: str, kind: str, **props: str) -> Rule:
    return Rule(kind, pattern, "{name}", "{path}:{name}", {"type": kind, **props})


def _imports(pattern: str, prefix: str) -> Rule:
    return Rule("external", pattern, "{name}", prefix + ":{name}", {"module": "{name}"}, (("imports", "{file}", prefix + ":{name}"),))


AUTH = (
    Detector("certificate_auth", ("java", "python", "typescript", "csharp", "json", "yaml"), (
        _guard(r"(?P<x>clientAuth\s*=\s*[\"']?(?:true|want|need)|requestCert\s*:\s*true|ssl\.CERT_REQUIRED|RequireCertificate|mutual[_-]?tls|\bmTLS\b)", "mtls", "mTLS", pattern="{x}", auth_flow="mtls"), _guard(r"(?P<x>\.x509\s*\(|X509Certificate2?|X509TrustManager|AddCertificate\s*\()", "x509", "X.509", pattern="{x}", auth_flow="x509"),
        _guard(r"(?P<x>javax\.net\.ssl\.(?:keyStore|trustStore)|ssl_context|tls\.createServer|server\.ssl\.|ssl\.key-store)", "tls", "TLS configuration", pattern="{x}", auth_flow="tls"), _guard(r"(?P<x>ClientCertificateCredential|CertificateCredential|clientCertificatePath|AZURE_CLIENT_CERTIFICATE)", "azure_ad", "Azure AD certificate", pattern="{x}", auth_flow="client_certificate"),
    ), needs=("ssl", "SSL", "tls", "TLS", "x509", "X509", "ertificate", "requestCert", "clientAuth", "CERT_REQUIRED")),
    Detector("ldap_auth", ("java", "python", "typescript", "csharp"), (_guard(r"(?P<x>LdapContextSource|LdapTemplate|ActiveDirectoryLdapAuthenticationProvider|EnableLdapRepositories|\bldap3\.|ldap\.initialize|AUTH_LDAP_\w+|ldapjs|passport-ldapauth|DirectoryEntry|LdapConnection|PrincipalContext|DirectorySearcher)", "ldap", "LDAP: {x}", pattern="{x}"),)),
    Detector("session_header_auth", ("java", "python", "typescript"), (
        _guard(r"(?P<x>express-session|HttpSession|SessionMiddleware|SESSION_ENGINE|cookie-session|@SessionAttributes|SessionRegistry)", "session", "session: {x}", "middleware", pattern="{x}"), _guard(r"(?i)(?P<x>[\"']x-api-key[\"']|api[_-]?key[_-]?header|APIKeyHeader|ApiKeyAuthFilter)", "api_key", "API key: {x}", pattern="{x}"),
        _guard(r"(?P<x>CsrfFilter|csrf_protect|CsrfViewMiddleware|csurf|csrf\(\)|CSRFProtect)", "csrf", "CSRF: {x}", pattern="{x}"), _guard(r"(?i)(?P<x>headers?(?:\.get\(|\[|\.)\s*[\"']?authorization|getHeader\(\s*\"Authorization\")", "header", "authorization header", pattern="{x}"),
    )),
    Detector("django_auth", ("python",), (_guard(r"@(?P<x>login_required)", "django", "{x}", auth_required="True"), _guard(r"@permission_required\(\s*[\"'](?P<x>[^\"']+)", "django", "{x}", permissions="{x}", auth_required="True"), _guard(r"@(?P<x>user_passes_test|staff_member_required)\b", "django", "{x}", auth_required="True"), _guard(r"class\s+\w+\([^)]*(?P<x>LoginRequiredMixin|PermissionRequiredMixin|UserPassesTestMixin)", "django", "{x}", auth_required="True"))),
    Detector("fastapi_auth", ("python",), (_guard(r"(?:Depends|Security)\(\s*(?P<x>\w*(?:user|auth|token|scheme)\w*)", "fastapi", "{x}", auth_required="True"), _guard(r"(?P<x>HTTPBearer|HTTPBasic|OAuth2PasswordBearer|APIKeyHeader)\s*\(", "fastapi", "{x}", auth_required="True"))),
    Detector("spring_security", ("java",), (_guard(r"@(?P<x>PreAuthorize|PostAuthorize)\(\s*\"(?P<e>[^\"]*)\"", "spring_security", "{x}", framework="spring_security", expression="{e}", auth_required="true"), _guard(r"@(?P<x>Secured|RolesAllowed)\(\s*\{?\s*(?P<r>[^)}]*)", "spring_security", "{x}", framework="spring_security", roles="{r}", auth_required="true"), _guard(r"(?P<x>SecurityFilterChain|@EnableWebSecurity|authorizeHttpRequests|authorizeRequests)\b", "spring_security", "{x}", framework="spring_security", auth_required="true"))),
    Detector("typescript.nestjs_guards", JS, (_guard(r"@UseGuards\(\s*(?P<x>\w+)", "nestjs_guard", "{x}", guard_name="{x}"), _guard(r"@Roles\(\s*(?P<x>[^)]*)\)", "nestjs_guard", "roles {x}", roles="{x}"), _guard(r"class\s+(?P<x>\w+)\s[^{]*implements[^{]*CanActivate", "nestjs_guard", "{x}", guard_impl="true"), _guard(r"AuthGuard\(\s*['\"](?P<x>\w+)", "nestjs_guard", "AuthGuard {x}", strategy="{x}")), needs=("@nestjs/",)),
    Detector("typescript.passport_jwt", JS, (_guard(r"passport\.use\(\s*new\s+(?P<x>\w+)", "passport", "{x}", strategy="{x}"), _guard(r"passport\.authenticate\(\s*['\"](?P<x>[\w-]+)", "jwt", "{x}", "middleware", strategy="{x}"), _guard(r"(?P<x>jwt\.verify|expressJwt|expressjwt)\s*\(", "jwt", "{x}", "middleware"))),
)

_CLASSY = r"(?:(?:public|private|protected|internal|static|sealed|partial|final|open|data|abstract)\s+)*"
CODE = (
    Detector("csharp_efcore", ("csharp",), (Rule("repository", r"class\s+(?P<name>\w+)\s*:\s*[^{]*DbContext\b", "{name}", "{path}:{name}", {"framework": "efcore"}), Rule("entity", r"DbSet<(?P<name>\w+)>", "{name}", "efcore:entity:{name}", {"framework": "efcore"}, (("queries", _OWNER, "efcore:entity:{name}"),)), Rule("migration", r"class\s+(?P<name>\w+)\s*:\s*Migration\b", "{name}", "{path}:{name}", {"framework": "efcore"}), Rule("entity", r"CreateTable\(\s*(?:name:\s*)?\"(?P<name>\w+)\"", "{name}", "efcore:table:{name}", {"framework": "efcore"}))),
    Detector("csharp_minimal_apis", ("csharp",), (Rule("endpoint", r"\.Map(?P<verb>Get|Post|Put|Delete|Patch)\(\s*\"(?P<name>[^\"]+)\"", "{verb} {name}", "{path}:{verb}:{name}", {"http_method": "{verb}", "path": "{name}", "framework": "dotnet_minimal_api"}, (("exposes", "{file}", "{path}:{verb}:{name}"),), upper=("verb",)), Rule("guard", r"(?P<name>(?:Add|Use)(?:Authentication|Authorization))\b", "{name}", "{path}:{name}", {"guard_type": "{name}"}), Rule("module", r"(?P<name>WebApplication\.CreateBuilder)", "{path}", "{file}", {"framework": "dotnet_minimal_api"})), needs=(".Map", "WebApplication", "Authentication")),
    Detector("csharp_structures", ("csharp",), (Rule("module", r"^\s*namespace\s+(?P<name>[\w.]+)", "{name}", "csharp:namespace:{name}"), _types(r"^\s*(?:public\s+|internal\s+)?abstract\s+(?:partial\s+)?class\s+(?P<name>\w+)", "abstract_class"), _types(rf"^\s*{_CLASSY}class\s+(?P<name>\w+)", "class"), _types(rf"^\s*{_CLASSY}interface\s+(?P<name>\w+)", "interface"), _types(rf"^\s*{_CLASSY}enum\s+(?P<name>\w+)", "enum"), _imports(r"^\s*using\s+(?:static\s+)?(?P<name>[\w.]+)\s*;", "csharp:external"), Rule(None, r"class\s+(?P<a>\w+)\s*(?:<[^>]*>)?\s*:\s*(?P<b>[A-HJ-Z]\w*)", "{b}", edges=(("extends", "{path}:{a}", "{b}"),)), Rule(None, r"class\s+(?P<a>\w+)\s*(?:<[^>]*>)?\s*:[^{\n]*?\b(?P<b>I[A-Z]\w*)", "{b}", edges=(("implements", "{path}:{a}", "{b}"),)), Rule("endpoint", r"\[Http(?P<verb>Get|Post|Put|Delete|Patch)(?:\(\s*\"(?P<name>[^\"]*)\")?", "{verb} {name}", "{path}:{verb}:{line}", {"http_method": "{verb}", "path": "{name}"}, upper=("verb",)))),
    Detector("generic_imports", ("java", "python"), (Rule("module", r"^\s*import\s+(?:static\s+)?(?P<name>[\w.]+)", "{name}", "{language}:external:{name}", {"module": "{name}", "external": "true", "language": "{language}"}, (("imports", "{file}", "{language}:external:{name}"),)), Rule("module", r"^\s*from\s+(?P<name>[\w.]+)\s+import", "{name}", "{language}:external:{name}", {"module": "{name}", "external": "true", "language": "{language}"}, (("imports", "{file}", "{language}:external:{name}"),)))),
    Detector("go_structures", ("go",), (Rule("module", r"^package\s+(?P<name>\w+)", "{name}", "go:package:{name}", {"package": "{name}"}), _types(r"^type\s+(?P<name>\w+)\s+struct\b", "class"), _types(r"^type\s+(?P<name>\w+)\s+interface\b", "interface"), Rule("method", r"^func\s+(?:\(\s*\w*\s*\*?(?P<on>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*\(", "{name}", "{path}:{on}:{name}", {"receiver_type": "{on}"}, (("defines", "{file}", "{path}:{on}:{name}"),)), _imports(r"^(?:import\s+|\s+)(?:\w+\s+)?\"(?P<name>[\w./-]+)\"\s*$", "go:external"))),
    Detector("go_web", ("go",), (Rule("endpoint", r"\.(?P<verb>GET|POST|PUT|DELETE|PATCH|Get|Post|Put|Delete|Patch)\(\s*\"(?P<name>/[^\"]*)\"", "{verb} {name}", "{path}:{verb}:{name}", {"http_method": "{verb}", "path": "{name}"}, upper=("verb",)), Rule("endpoint", r"\.?HandleFunc\(\s*\"(?P<name>[^\"]+)\"", "{name}", "{path}:ANY:{name}", {"http_method": "ANY", "path": "{name}", "framework": "net_http"}), Rule("middleware", r"\.Use\(\s*(?P<name>[\w.]+)", "{name}", "{path}:use:{name}", {"middleware": "{name}"}))),
    Detector("go_orm", ("go",), (Rule("entity", r"type\s+(?P<name>\w+)\s+struct\s*\{[^}]*(?:gorm\.Model|gorm:\")", "{name}", "gorm:entity:{name}", {"framework": "gorm"}), Rule("migration", r"AutoMigrate\((?P<name>[^)]*)\)", "{name}", "{path}:migrate:{line}", {"framework": "gorm"}), Rule("database_connection", r"(?P<name>gorm\.Open|sql\.Open|sqlx\.(?:Connect|Open))\s*\(", "{name}", "{path}:db:{line}", {"type": "{name}"}), Rule(None, r"\.(?P<name>Find|First|Create|Save|Where|Query|QueryRow|Exec|Select)\(", "{name}", edges=(("queries", "{file}", "{path}:db"),)))),
    Detector("java.class_hierarchy", ("java",), (_types(r"^\s*(?:public\s+|protected\s+|private\s+|static\s+|final\s+)*class\s+(?P<name>\w+)", "class"), _types(r"^\s*(?:public\s+|protected\s+|static\s+)*abstract\s+(?:static\s+)?class\s+(?P<name>\w+)", "abstract_class", is_abstract="true"), _types(r"^\s*(?:public\s+|protected\s+|private\s+|static\s+)*interface\s+(?P<name>\w+)", "interface"), _types(r"^\s*(?:public\s+|protected\s+|private\s+|static\s+)*enum\s+(?P<name>\w+)", "enum"), _types(r"@interface\s+(?P<name>\w+)", "annotation_type"), Rule(None, r"class\s+(?P<a>\w+)(?:<[^{]*?>)?\s+extends\s+(?P<b>\w+)", "{b}", edges=(("extends", "{path}:{a}", "{b}"),)), Rule(None, r"class\s+(?P<a>\w+)[^{]*?\bimplements\s+(?P<b>\w+)", "{b}", edges=(("implements", "{path}:{a}", "{b}"),)))),
    Detector("java.public_api", ("java",), (Rule("method", r"^\s*(?P<visibility>public|protected)\s+(?:static\s+|final\s+|abstract\s+|synchronized\s+)*(?P<type>[\w<>\[\], ?]+?)\s+(?P<name>\w+)\s*\((?P<args>[^)]*)\)\s*(?:throws[^{;]*)?[{;]", "{name}", "{path}:{owner}:{name}", {"visibility": "{visibility}", "return_type": "{type}", "parameters": "{args}"}, (("defines", _OWNER, "{path}:{owner}:{name}"),)),)),
    Detector("kotlin_structures", ("kotlin",), (_types(rf"^\s*{_CLASSY}(?:class|object)\s+(?P<name>\w+)", "class"), _types(r"^\s*(?:sealed\s+|fun\s+)?interface\s+(?P<name>\w+)", "interface"), Rule("method", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\(", "{name}", "{path}:{name}"), _imports(r"^import\s+(?P<name>[\w.]+)", "kotlin:external"), Rule(None, r"class\s+(?P<a>\w+)[^:{\n]*:\s*(?P<b>\w+)", "{b}", edges=(("extends", "{path}:{a}", "{b}"),)))),
    Detector("scala_structures", ("scala",), (_types(r"^\s*(?:\w+\s+)*(?:class|object)\s+(?P<name>\w+)", "class"), _types(r"^\s*(?:sealed\s+)?trait\s+(?P<name>\w+)", "interface"), Rule("method", r"^\s*(?:\w+\s+)*def\s+(?P<name>\w+)", "{name}", "{path}:{name}"), _imports(r"^\s*import\s+(?P<name>[\w.]+)", "scala:external"), Rule(None, r"class\s+(?P<a>\w+)[^{\n]*?\bextends\s+(?P<b>\w+)", "{b}", edges=(("extends", "{path}:{a}", "{b}"),)), Rule(None, r"class\s+(?P<a>\w+)[^{\n]*?\bwith\s+(?P<b>\w+)", "{b}", edges=(("implements", "{path}:{a}", "{b}"),)))),
    Detector("python_structures", ("python",), (_types(r"^class\s+(?P<name>\w+)", "class"), Rule("method", r"^\s*(?:async\s+)?def\s+(?P<name>\w+)", "{name}", "{path}:{name}:{line}", {}, (("defines", "{file}", "{path}:{name}:{line}"),)), _imports(r"^\s*(?:from\s+(?P<name>[\w.]+)\s+import|import\s+\w+)", "py:external"), _imports(r"^\s*import\s+(?P<name>[\w.]+)", "py:external"), Rule(None, r"^class\s+(?P<a>\w+)\(\s*(?P<b>[\w.]+)", "{b}", edges=(("extends", "{path}:{a}", "{b}"),)), Rule("module", r"^__all__\s*=\s*(?P<name>\[[^\]]*\])", "{path}", "{file}", {"all_exports": "{name}", "module_type": "python_file"}))),
    Detector("typescript_structures", JS, (_types(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)", "class"), _types(r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)", "interface"), _types(r"^\s*(?:export\s+)?type\s+(?P<name>\w+)\s*[=<]", "class", alias="true"), _types(r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)", "enum"), Rule("method", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)", "{name}", "{path}:{name}"), Rule("method", r"^\s*(?:export\s+)?const\s+(?P<name>\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>", "{name}", "{path}:{name}"), _imports(r"^\s*import\s[^'\"]*['\"](?P<name>[^'\"]+)['\"]", "ts:external"), Rule("module", r"^\s*(?:export\s+)?(?:declare\s+)?namespace\s+(?P<name>[\w.]+)", "{name}", "ts:{path}:namespace:{name}"))),
    Detector("cpp_structures", ("cpp", "c"), (_types(r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?P<name>\w+)\s*(?:final\s*)?[:{]", "class"), _types(r"^\s*enum\s+(?:class\s+)?(?P<name>\w+)", "enum"), Rule("module", r"^\s*namespace\s+(?P<name>[\w:]+)", "{name}", "cpp:namespace:{name}", {"namespace": "{name}"}), Rule("method", r"^[\w:<>*&~ ]+?\b(?P<name>\w+)\s*\([^;{}]*\)\s*(?:const\s*)?\{", "{name}", "{path}:{name}"), _imports(r"^\s*#include\s*[<\"](?P<name>[^>\"]+)", "cpp:external"), Rule(None, r"(?:class|struct)\s+(?P<a>\w+)\s*(?:final\s*)?:\s*(?:public|private|protected)?\s*(?P<b>\w+)", "{b}", edges=(("extends", "{path}:{a}", "{b}"),)))),
    Detector("rust_structures", ("rust",), (Rule("module", r"^\s*(?:pub\s+)?mod\s+(?P<name>\w+)", "{name}", "{path}:mod:{name}"), _types(r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)", "class"), _types(r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)", "enum"), _types(r"^\s*(?:pub\s+)?trait\s+(?P<name>\w+)", "interface"), Rule("method", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<name>\w+)", "{name}", "{path}:{name}", {}, (("defines", "{file}", "{path}:{name}"),)), Rule("method", r"^\s*macro_rules!\s*(?P<name>\w+)", "{name}", "{path}:macro:{name}", {"type": "macro"}), _imports(r"^\s*(?:pub\s+)?use\s+(?P<name>[\w:]+)", "rust:external"), Rule(None, r"impl(?:<[^>]*>)?\s+(?P<b>\w+)(?:<[^>]*>)?\s+for\s+(?P<a>\w+)", "{b}", edges=(("implements", "{path}:{a}", "{b}"),)))),
    Detector("bash", ("bash",), (Rule("module", r"\A(?P<name>#!.*)?", "{path}", "{file}", {"shell": "{name}"}), Rule("method", r"^\s*(?:function\s+(?P<name>[\w-]+)|(?P<b>[\w-]+)\s*\(\)\s*\{)", "{name}{b}", "{path}:{name}{b}"), _imports(r"^\s*(?:source|\.)\s+(?P<name>[^\s;]+)", "bash:external"), Rule("config_definition", r"^\s*export\s+(?P<name>\w+)=", "{name}", "{path}:export:{name}"), Rule(None, r"^\s*(?:sudo\s+)?(?P<name>docker|kubectl|helm|terraform|aws|gcloud|az|npm|yarn|pip|mvn|gradle|make|git|curl|ansible)\b", "{name}", edges=(("calls", "{file}", "tool:{name}"),)))),
    Detector("powershell", ("powershell",), (Rule("method", r"(?i)^\s*function\s+(?P<name>[\w-]+)", "{name}", "{path}:{name}"), _imports(r"(?i)^\s*Import-Module\s+[\"']?(?P<name>[\w.\\/-]+)", "ps:external"), _imports(r"^\s*\.\s+[\"']?(?P<name>[^\s\"']+\.ps1)", "ps:external"), Rule("config_definition", r"\[(?P<type>\w+)\]\s*\$(?P<name>\w+)", "{name}", "{path}:param:{name}", {"param_type": "{type}"}))),
    Detector("batch_structure", ("batch",), (Rule("module", r"\A(?P<name>)", "{path}", "{file}"), Rule("method", r"^:(?P<name>[A-Za-z_]\w*)", "{name}", "{path}:{name}", {}, (("contains", "{file}", "{path}:{name}"),)), Rule("config_definition", r"(?i)^\s*@?set\s+(?:/[ap]\s+)?\"?(?P<name>\w+)=", "{name}", "{path}:set:{name}", {"variable": "{name}"}), Rule(None, r"(?i)^\s*@?call\s+:?(?P<name>[\w.\\-]+)", "{name}", edges=(("calls", "{file}", "{path}:{name}"),)))),
    Detector("markdown_structure", ("markdown",), (Rule("module", r"\A(?P<name>)", "{path}", "md:{path}"), Rule("config_key", r"^(?P<level>#{1,6})\s+(?P<name>.+?)\s*#*$", "{name}", "md:{path}:{line}", {"text": "{name}", "level": "{level}"}, (("contains", "md:{path}", "md:{path}:{line}"),)), Rule(None, r"\[(?P<text>[^\]]*)\]\((?P<name>(?!https?:|mailto:|#)[^)\s]+)", "{name}", edges=(("depends_on", "md:{path}", "{name}"),)))),
    Detector("proto_structure", ("proto",), (Rule("config_key", r"^\s*package\s+(?P<name>[\w.]+)", "{name}", "proto:{path}:package:{name}", {"package": "{name}"}), _imports(r"^\s*import\s+(?:public\s+)?\"(?P<name>[^\"]+)\"", "proto:external"), Rule("interface", r"^\s*service\s+(?P<name>\w+)", "{name}", "proto:{path}:service:{name}"), Rule("method", r"^\s*rpc\s+(?P<name>\w+)\s*\(\s*(?:stream\s+)?(?P<a>[\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?(?P<b>[\w.]+)", "{name}", "proto:{path}:rpc:{name}", {"request_type": "{a}", "response_type": "{b}"}, (("contains", "{file}", "proto:{path}:rpc:{name}"),)), Rule("protocol_message", r"^\s*message\s+(?P<name>\w+)", "{name}", "proto:{path}:message:{name}"))),
    Detector("bicep", ("bicep",), (Rule("azure_resource", r"^resource\s+(?P<name>\w+)\s+'(?P<type>Microsoft[^@']+)@?(?P<version>[^']*)'", "{name}", "bicep:{path}:{name}", {"azure_type": "{type}", "api_version": "{version}"}), Rule("infra_resource", r"^resource\s+(?P<name>\w+)\s+'(?!Microsoft)(?P<type>[^@']+)", "{name}", "bicep:{path}:{name}", {"azure_type": "{type}"}), Rule("config_key", r"^param\s+(?P<name>\w+)\s+(?P<type>\w+)", "{name}", "bicep:{path}:param:{name}", {"param_type": "{type}"}), Rule("infra_resource", r"^module\s+(?P<name>\w+)\s+'(?P<from>[^']+)'", "module {name} ({from})", "{path}:module:{name}", {"module_path": "{from}"}), Rule("external", r"^module\s+(?P<name>\w+)\s+'(?P<from>[^']+)'", "{from}", "bicep:external:{from}", {"module": "{from}"}, (("depends_on", "{file}", "bicep:external:{from}"),)))),
    Detector("dockerfile", ("dockerfile",), (Rule("infra_resource", r"(?i)^FROM\s+(?P<name>\S+)\s+AS\s+(?P<stage>\S+)", "FROM {name} AS {stage}", "docker:{path}:from:{name}", {"image": "{name}", "stage_alias": "{stage}"}), Rule("infra_resource", r"(?i)^FROM\s+(?P<name>\S+)(?!\S)(?![ \t]+AS\s)", "FROM {name}", "docker:{path}:from:{name}", {"image": "{name}"}), Rule("external", r"(?i)^FROM\s+(?P<name>\S+)", "{name}", "docker:image:{name}", {"module": "{name}"}, (("depends_on", "{file}", "docker:image:{name}"),)), Rule("endpoint", r"(?i)^EXPOSE\s+(?P<name>\d+)(?:/(?P<p>\w+))?", "port {name}", "docker:{path}:expose:{name}", {"port": "{name}", "protocol": "{p}"}), Rule("config_definition", r"(?i)^ENV\s+(?P<name>\w+)", "{name}", "docker:{path}:env:{name}", {"env_key": "{name}"}), Rule("config_definition", r"(?i)^ARG\s+(?P<name>\w+)", "{name}", "docker:{path}:arg:{name}", {"arg_name": "{name}"}), Rule("config_definition", r"(?i)^LABEL\s+(?P<name>[\w.-]+)=", "{name}", "docker:{path}:label:{name}", {"label_key": "{name}"}), Rule(None, r"(?i)^COPY\s+--from=(?P<name>\S+)", "{name}", edges=(("depends_on", "{file}", "docker:{path}:from:{name}"),)))),
    Detector("terraform", ("terraform",), (Rule("infra_resource", r"^resource\s+\"(?P<type>[^\"_]+(?P<rest>[^\"]*))\"\s+\"(?P<name>[^\"]+)\"", "{type}.{name}", "tf:resource:{type}.{name}", {"resource_type": "{type}"}), Rule("infra_resource", r"^data\s+\"(?P<type>[^\"]+)\"\s+\"(?P<name>[^\"]+)\"", "data.{type}.{name}", "tf:data:{type}.{name}", {"data_source": "true", "resource_type": "{type}"}), Rule("module", r"^module\s+\"(?P<name>[^\"]+)\"\s*\{[^}]*?source\s*=\s*\"(?P<from>[^\"]+)\"", "{name}", "tf:module:{name}", {"module_source": "{from}"}, (("depends_on", "tf:module:{name}", "{from}"),)), Rule("config_definition", r"^(?P<type>variable|output|provider)\s+\"(?P<name>[^\"]+)\"", "{name}", "tf:{type}:{name}", {"config_type": "{type}"}))),
    Detector("sql_structure", ("sql",), (Rule("entity", r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(?P<name>[\w.]+)", "{name}", "sql:table:{name}", {"entity_type": "table"}), Rule("entity", r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\s+[`\"\[]?(?P<name>[\w.]+)", "{name}", "sql:view:{name}", {"entity_type": "view"}), Rule("config_definition", r"(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(?P<name>[\w.]+)", "{name}", "sql:index:{name}", {"definition_type": "index"}), Rule("config_definition", r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|FUNCTION)\s+[`\"\[]?(?P<name>[\w.]+)", "{name}", "sql:procedure:{name}", {"definition_type": "procedure"}), Rule(None, r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(?P<a>[\w.]+)(?:(?!CREATE\s+TABLE).)*?REFERENCES\s+[`\"\[]?(?P<b>[\w.]+)", "{b}", edges=(("depends_on", "sql:table:{a}", "sql:table:{b}"),)))),
    Detector("sql_migration", ("sql", "python", "ruby", "xml", "yaml"), (Rule("sql_entity", r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(?P<name>[\w.]+)", "{name}", "sql_entity:{name}", {"sql_object_type": "table", "table": "{name}"}, (("migrates", "migration:{path}", "sql_entity:{name}"),)), Rule("sql_entity", r"(?:op\.create_table\(\s*['\"]|create_table\s+:|<createTable[^>]*tableName=\"|tableName:\s*)(?P<name>\w+)", "{name}", "sql_entity:{name}", {"sql_object_type": "table", "table": "{name}"}, (("migrates", "migration:{path}", "sql_entity:{name}"),)), Rule("migration", r"\A(?P<name>)(?=(?:.|\n)*(?i:create\s+table|create_table|createTable|alter\s+table|changeSet))", "{path}", "migration:{path}", {"format": "{language}"}), Rule(None, r"(?i)REFERENCES\s+[`\"\[]?(?P<b>[\w.]+)", "{b}", edges=(("references_table", "migration:{path}", "sql_entity:{b}"),)))),
)

_SENDS, _RECEIVES = r"\b(?:send|publish)\s*\(|\bMessageProducer\b", r"\b(?:receive|onMessage)\s*\(|\bMessageConsumer\b"


def _mq(name: str, broker: str, needs: tuple[str, ...], server: Rule, queue: str, topic: str, sends: str = _SENDS, receives: str = _RECEIVES) -> Detector:
    """Servers, queues and topics of a broker; whether the file's type sends or receives is told by calls anywhere in it."""
    rules = [server]
    for kind, pattern in (("queue", queue), ("topic", topic)):
        id = f"{broker}:{kind}:{{name}}"
        rules += [Rule(kind, pattern, id, id, {"broker": broker, kind: "{name}"}), Rule(None, pattern, "{name}", edges=(("sends_to", _OWNER, id),), when=sends), Rule(None, pattern, "{name}", edges=(("receives_from", _OWNER, id),), when=receives)]
    return Detector(name, ("java",), tuple(rules), needs)


def _factory(broker: str, pattern: str) -> Rule:
    return Rule("message_queue", pattern, broker + ":{name}", broker + ":server:{name}", {"broker": broker, "factory_type": "{name}"}, (("connects_to", _OWNER, broker + ":server:{name}"),))


_MQ = (
    _mq("active_mq", "activemq", ("ActiveMQ", "activemq", "artemis"), _factory("activemq", r"new\s+(?P<name>\w*ConnectionFactory)\s*\("), r"(?:createQueue|new\s+ActiveMQQueue)\s*\(\s*\"(?P<name>[^\"]+)\"", r"(?:createTopic|new\s+ActiveMQTopic)\s*\(\s*\"(?P<name>[^\"]+)\""),
    _mq("ibm_mq", "ibm_mq", ("MQQueueManager", "com.ibm.mq"), Rule("message_queue", r"new\s+MQQueueManager\s*\(\s*\"(?P<name>[^\"]+)\"", "ibm_mq:{name}", "ibm_mq:server:{name}", {"broker": "ibm_mq", "queue_manager": "{name}"}, (("connects_to", _OWNER, "ibm_mq:server:{name}"),)), r"(?:accessQueue|createQueue)\s*\(\s*\"(?P<name>[^\"]+)\"", r"createTopic\s*\(\s*\"(?P<name>[^\"]+)\"", r"\bput\s*\(", r"\bget\s*\("),
    _mq("tibco_ems", "tibco_ems", ("Tibjms", "tibjms", "TibEMS"), _factory("tibco_ems", r"new\s+(?P<name>Tibjms(?:Queue|Topic)?ConnectionFactory)\s*\("), r"(?:createQueue|new\s+TibjmsQueue)\s*\(\s*\"(?P<name>[^\"]+)\"", r"(?:createTopic|new\s+TibjmsTopic)\s*\(\s*\"(?P<name>[^\"]+)\""),
)
JVM = (
    *_MQ,
    Detector("azure_functions", ("java", "csharp", *JS), (Rule("azure_function", r"[@\[]Function(?:Name)?\(\s*(?:name\s*=\s*)?\"(?P<name>[^\"]+)\"", "{name}", "azure:function:{name}", {"function_name": "{name}"}), Rule("endpoint", r"@?HttpTrigger\b(?P<name>[^)\n]*)", "HTTP trigger", "{path}:http:{line}", {"http_trigger": "true"}, (("exposes", "{file}", "{path}:http:{line}"),)), Rule("queue", r"ServiceBus(?:Queue)?Trigger\(?(?:[^)]*?queueName\s*=\s*|\s*)\"(?P<name>[^\"]+)\"", "{name}", "azure:queue:{name}", {"queue": "{name}", "broker": "azure_servicebus"}, (("triggers", "azure:queue:{name}", "{file}"),)), Rule("topic", r"EventHubTrigger\(?[^)]*?eventHubName\s*=\s*\"(?P<name>[^\"]+)\"", "{name}", "azure:eventhub:{name}", {"event_hub": "{name}"}, (("triggers", "azure:eventhub:{name}", "{file}"),)), Rule("topic", r"ServiceBusTopicTrigger\(?[^)]*?topicName\s*=\s*\"(?P<name>[^\"]+)\"", "{name}", "azure:topic:{name}", {"topic": "{name}", "broker": "azure_servicebus"}, (("triggers", "azure:topic:{name}", "{file}"),)), Rule("azure_resource", r"(?P<name>CosmosDB(?P<how>Trigger|Input|Output))\b", "{name}", "{path}:cosmos", {"cosmos_type": "{how}"})), needs=("Trigger", "FunctionName")),
    Detector("azure_messaging", ("java",), (Rule("queue", r"queueName\(\s*\"(?P<name>[^\"]+)\"", "{name}", "azure:servicebus:{name}", {}, (("connects_to", _OWNER, "azure:servicebus:{name}"),)), Rule("topic", r"(?:topicName|eventHubName)\(\s*\"(?P<name>[^\"]+)\"", "{name}", "azure:eventhub:{name}", {}, (("connects_to", _OWNER, "azure:eventhub:{name}"),)), Rule(None, r"(?P<name>ServiceBusSenderClient|EventHubProducerClient)", "{name}", edges=(("sends_to", _OWNER, "azure:{name}"),)), Rule(None, r"(?P<name>ServiceBusReceiverClient|ServiceBusProcessorClient|EventHubConsumerClient|EventProcessorClient)", "{name}", edges=(("receives_from", _OWNER, "azure:{name}"),))), needs=("ServiceBus", "EventHub", "EventProcessor")),
    Detector("config_def", ("java",), (Rule("config_definition", r"@Value\(\s*\"\$\{(?P<name>[^}:\"]+)", "{name}", "config:{name}", {"config_key": "{name}", "config_source": "spring_value"}, (("reads_config", _OWNER, "config:{name}"),)), Rule("config_definition", r"@ConfigurationProperties\(\s*(?:prefix\s*=\s*)?\"(?P<name>[^\"]+)", "{name}", "config:{name}", {"config_key": "{name}", "config_source": "spring_config_props"}, (("reads_config", _OWNER, "config:{name}"),)), Rule("config_definition", r"\.define\(\s*\"(?P<name>[^\"]+)", "{name}", "config:{name}", {"config_key": "{name}", "config_source": "kafka_configdef"}, (("reads_config", _OWNER, "config:{name}"),)))),
    Detector("cosmos_db", ("java", *JS), (Rule("azure_resource", r"(?:getDatabase|database|databases\.get)\(\s*[\"'](?P<name>[^\"']+)", "{name}", "cosmos:database:{name}", {"cosmos_type": "database", "resource_name": "{name}"}, (("connects_to", _OWNER, "cosmos:database:{name}"),)), Rule("azure_resource", r"(?:getContainer|container)\(\s*[\"'](?P<name>[^\"']+)", "{name}", "cosmos:container:{name}", {"cosmos_type": "container", "resource_name": "{name}"}, (("connects_to", _OWNER, "cosmos:container:{name}"),))), needs=("Cosmos", "cosmos")),
    Detector("graphql_resolver", ("java",), (Rule("endpoint", r"@(?P<type>QueryMapping|MutationMapping|SubscriptionMapping|SchemaMapping|DgsQuery|DgsMutation|DgsSubscription|DgsData)\b[^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:public\s+)?[\w<>, ]+\s+(?P<name>\w+)\s*\(", "{name}", "{path}:graphql:{name}", {"protocol": "graphql", "graphql_type": "{type}", "field": "{name}"}, (("exposes", _OWNER, "{path}:graphql:{name}"),)),)),
    Detector("grpc_service", ("java",), (Rule("endpoint", r"class\s+\w+\s+extends\s+(?P<name>\w+)Grpc\.\w+ImplBase", "{name}", "grpc:{name}", {"protocol": "grpc", "service": "{name}", "implementation": "{owner}"}, (("exposes", _OWNER, "grpc:{name}"),)), Rule(None, r"(?P<name>\w+)Grpc\.new\w*Stub\(", "{name}", edges=(("calls", _OWNER, "grpc:{name}"),)))),
    Detector("jaxrs", ("java",), (Rule("endpoint", r"@(?P<verb>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b(?:\s*@(?!Path)\w+(?:\([^)]*\))?)*(?:\s*@Path\(\s*\"(?P<route>[^\"]*)\"\s*\))?(?:\s*@\w+(?:\([^)]*\))?)*\s*(?:public\s+)?[\w<>, ?]+\s+(?P<name>\w+)\s*\(", "{name}", "{path}:{owner}:{name}:{verb}", {"http_method": "{verb}", "path": "{route}", "framework": "jaxrs"}, (("exposes", _OWNER, "{path}:{owner}:{name}:{verb}"),)),), needs=("@Path",)),
    Detector("jdbc", ("java",), (Rule("database_connection", r"jdbc:(?P<type>\w+):(?://)?(?P<name>[^\s\"';?]*)", "{type}@{name}", "db:{type}:{name}", {"db_type": "{type}"}, (("connects_to", _OWNER, "db:{type}:{name}"),)), Rule("database_connection", r"(?P<name>JdbcTemplate|NamedParameterJdbcTemplate|JdbcClient)\s+\w+\s*[;=,)]", "{name}", "{path}:{name}", {}, (("connects_to", _OWNER, "{path}:{name}"),)), Rule("database_connection", r"DataSource\s+(?P<name>\w+)\s*\(", "{name}", "{path}:datasource:{name}"))),
    Detector("jms", ("java",), (_topic("jms", r"@JmsListener\([^)]*?destination\s*=\s*\"(?P<name>[^\"]+)\"", "consumes", "queue", "queue"), _topic("jms", r"[jJ]msTemplate\.(?:convertAndSend|send)\(\s*\"(?P<name>[^\"]+)\"", "produces", "queue", "queue"))),
    Detector("jpa_entity", ("java",), (Rule("entity", r"@Entity\b(?:(?!\bclass\b)(?:.|\n))*?(?:@Table\([^)]*?name\s*=\s*\"(?P<table>[^\"]+)\"(?:(?!\bclass\b)(?:.|\n))*?)?class\s+(?P<name>\w+)", "{name}", "{path}:{name}", {"framework": "jpa", "table_name": "{table}"}),), needs=("@Entity",)),
    Detector("kafka", ("java", "kotlin"), (_topic("kafka", r"@KafkaListener\s*\(\s*(?:.*?topics?\s*=\s*)?[\[{]?\s*\"(?P<name>[^\"]+)\"", "consumes"), _topic("kafka", r"[kK]afkaTemplate\s*\.send\s*\(\s*\"(?P<name>[^\"]+)\"", "produces"))),
    Detector("kafka_protocol", ("java",), (Rule("protocol_message", r"class\s+(?P<name>\w+)\s+extends\s+Abstract(?P<type>Request|Response)\b", "{name}", "{path}:{name}", {"protocol_type": "{type}"}, (("extends", "{path}:{name}", "Abstract{type}"),)),)),
    Detector("micronaut", ("java",), (Rule("class", r"@(?P<scope>Singleton|Prototype|RequestScope|Context|Bean)\b(?:(?!\bclass\b)(?:.|\n))*?class\s+(?P<name>\w+)", "{name}", "{path}:{name}", {"bean_scope": "{scope}", "framework": "micronaut"}), Rule("endpoint", r"@(?P<verb>Get|Post|Put|Delete|Patch)(?:\(\s*(?:value\s*=\s*|uri\s*=\s*)?\"(?P<route>[^\"]*)\")?[^\n]*\s+(?:@\w+[^\n]*\s+)*(?:public\s+)?[\w<>, ?]+\s+(?P<name>\w+)\s*\(", "{name}", "{path}:{verb}:{name}", {"http_method": "{verb}", "path": "{route}", "framework": "micronaut"}, (("exposes", _OWNER, "{path}:{verb}:{name}"),), upper=("verb",)), Rule("middleware", r"@Scheduled\(\s*(?P<name>[^)]*)\)", "scheduled {name}", "{path}:scheduled:{line}", {"framework": "micronaut", "fixed_rate": "{name}"}), Rule("event", r"@EventListener\b", "event listener", "{path}:event:{line}", {"framework": "micronaut"}), Rule(None, r"@Client\(\s*(?:id\s*=\s*)?\"(?P<name>[^\"]+)", "{name}", edges=(("depends_on", _OWNER, "{name}"),))), needs=("io.micronaut",)),
    Detector("module_deps", ("java", "xml", "gradle", "groovy"), (Rule("module", r"\A(?:.|\n)*?<project[\s>](?:(?!<parent>|<dependenc)(?:.|\n))*?<artifactId>(?P<name>[^<]+)</artifactId>", "{name}", "maven:{path}", {"artifact_id": "{name}", "build_tool": "maven"}), Rule(None, r"<module>(?P<name>[^<]+)</module>", "{name}", edges=(("contains", "maven:{path}", "maven:module:{name}"),)), Rule(None, r"<dependency>\s*<groupId>(?P<g>[^<]+)</groupId>\s*<artifactId>(?P<name>[^<]+)</artifactId>", "{name}", edges=(("depends_on", "maven:{path}", "{g}:{name}"),)), Rule(None, r"^\s*(?:implementation|api|compile|testImplementation|runtimeOnly)\s*\(?[\"'](?P<name>[^\"']+)", "{name}", edges=(("depends_on", "gradle:{path}", "{name}"),))), needs=("<project", "implementation", "compile")),
    Detector("quarkus", ("java",), (Rule("config_key", r"@ConfigProperty\(\s*name\s*=\s*\"(?P<name>[^\"]+)", "{name}", "config:{name}", {"framework": "quarkus"}), Rule("class", r"@(?P<scope>ApplicationScoped|RequestScoped|Singleton|Dependent|QuarkusTest)\b(?:(?!\bclass\b)(?:.|\n))*?class\s+(?P<name>\w+)", "{name}", "{path}:{name}", {"cdi_scope": "{scope}", "framework": "quarkus"}), Rule("event", r"@Scheduled\(\s*(?P<name>[^)]*)\)", "scheduled", "{path}:scheduled:{line}", {"schedule": "{name}", "framework": "quarkus"}), Rule("middleware", r"@(?P<name>Transactional)\b", "{name}", "{path}:tx:{line}", {"framework": "quarkus"})), needs=("io.quarkus", "org.eclipse.microprofile", "jakarta.enterprise", "QuarkusTest")),
    Detector("rabbitmq", ("java",), (_topic("rabbitmq", r"@RabbitListener\([^)]*?queues?\s*=\s*\{?\s*\"(?P<name>[^\"]+)\"", "consumes", "queue", "queue"), _topic("rabbitmq", r"[rR]abbitTemplate\.(?:convertAndSend|send)\(\s*\"(?P<name>[^\"]+)\"", "produces", "queue", "queue"), Rule("queue", r"new\s+(?:Direct|Topic|Fanout|Headers)Exchange\(\s*\"(?P<name>[^\"]+)", "{name}", "rabbitmq:exchange:{name}", {"broker": "rabbitmq", "exchange": "{name}"}))),
    Detector("raw_sql", ("java",), (Rule("query", r"@Query\(\s*(?:value\s*=\s*)?\"(?P<name>[^\"]+)\"", "{name}", "{path}:query:{line}", {"query": "{name}"}), Rule("query", r"(?:jdbcTemplate|createNativeQuery|createQuery)[^\"\n]*\(\s*\"(?P<name>(?i:select|insert|update|delete)[^\"]+)\"", "{name}", "{path}:query:{line}", {"query": "{name}"}))),
    Detector("spring_repository", ("java",), (Rule("repository", r"interface\s+(?P<name>\w+)\s+extends\s+(?P<base>\w*Repository)\s*<\s*(?P<entity>\w+)", "{name}", "{path}:{name}", {"framework": "spring_data", "entity_type": "{entity}", "extends": "{base}"}, (("queries", "{path}:{name}", "{entity}"),)),)),
    Detector("rmi", ("java",), (Rule("rmi_interface", r"interface\s+(?P<name>\w+)\s+extends\s+(?:java\.rmi\.)?Remote\b", "{name}", "{path}:{name}", {"type": "rmi"}), Rule(None, r"class\s+(?P<name>\w+)\s+extends\s+UnicastRemoteObject", "{name}", edges=(("exports_rmi", "{path}:{name}", "rmi:{name}"),)), Rule(None, r"\.(?:bind|rebind)\(\s*\"(?P<name>[^\"]+)", "{name}", edges=(("exports_rmi", _OWNER, "rmi:{name}"),)), Rule(None, r"\.lookup\(\s*\"(?P<name>[^\"]+)", "{name}", edges=(("invokes_rmi", _OWNER, "rmi:{name}"),))), needs=("Remote", "Naming", "Registry")),
    Detector("spring_events", ("java",), (Rule("event", r"publishEvent\(\s*new\s+(?P<name>\w+)", "{name}", "event:{name}", {"event_class": "{name}", "framework": "spring"}, (("publishes", _OWNER, "event:{name}"),)), Rule("event", r"@(?:Transactional)?EventListener\b[^\n]*\n(?:\s*@[^\n]*\n)*[^(\n]*\(\s*(?:final\s+)?(?P<name>\w+)", "{name}", "event:{name}", {"event_class": "{name}", "framework": "spring"}, (("listens", _OWNER, "event:{name}"),)))),
    Detector("websocket", ("java",), (Rule("websocket_endpoint", r"@ServerEndpoint\(\s*(?:value\s*=\s*)?\"(?P<name>[^\"]+)", "{name}", "ws:{name}", {"path": "{name}", "protocol": "websocket"}, (("exposes", _OWNER, "ws:{name}"),)), Rule("websocket_endpoint", r"@MessageMapping\(\s*\"(?P<name>[^\"]+)", "{name}", "ws:{name}", {"path": "{name}", "protocol": "stomp"}, (("exposes", _OWNER, "ws:{name}"),)), Rule("websocket_endpoint", r"addEndpoint\(\s*\"(?P<name>[^\"]+)", "{name}", "ws:{name}", {"path": "{name}", "protocol": "stomp"}), Rule(None, r"(?:@SendTo\(\s*|convertAndSend\(\s*)\"(?P<name>/[^\"]+)", "{name}", edges=(("produces", _OWNER, "ws:{name}"),)))),
    Detector("ktor_routes", ("kotlin",), (Rule("module", r"(?P<name>routing)\s*\{", "{path}", "{file}", {"framework": "ktor"}), Rule("endpoint", rf"\b(?P<verb>{_VERB})\(\s*\"(?P<name>[^\"]*)\"\s*\)\s*\{{", "{verb} {name}", "{path}:{verb}:{name}", {"http_method": "{verb}", "path_pattern": "{name}", "framework": "ktor", "protocol": "http"}, upper=("verb",)), Rule("guard", r"authenticate\(\s*\"(?P<name>[^\"]+)", "{name}", "{path}:auth:{name}", {"auth_name": "{name}", "framework": "ktor"}), Rule("middleware", r"install\(\s*(?P<name>\w+)", "{name}", "{path}:install:{name}", {"feature": "{name}", "framework": "ktor"})), needs=("io.ktor",)),
)

PYTHON = (
    Detector("python.celery_tasks", ("python",), (Rule("method", r"@(?:\w+\.)?(?:shared_)?task(?:\((?P<args>[^)]*)\))?\s*\n\s*(?:async\s+)?def\s+(?P<name>\w+)", "{name}", "{path}:task:{name}", {"function": "{name}", "task_name": "{name}", "broker": "celery"}), Rule("queue", r"@(?:\w+\.)?(?:shared_)?task(?:\([^)]*\))?\s*\n\s*(?:async\s+)?def\s+(?P<name>\w+)", "celery:{name}", "celery:queue:{name}", {"broker": "celery"}, (("consumes", "{path}:task:{name}", "celery:queue:{name}"),)), Rule(None, r"\b(?P<name>\w+)\.(?:delay|apply_async)\(", "{name}", edges=(("produces", "{file}", "celery:queue:{name}"),)))),
    Detector("python.django_models", ("python",), (Rule("entity", r"^class\s+(?P<name>\w+)\(\s*(?:models\.)?Model\s*\)", "{name}", "{path}:{name}", {"framework": "django"}), Rule(None, r"(?:ForeignKey|ManyToManyField|OneToOneField)\(\s*['\"]?(?P<name>[\w.]+)", "{name}", edges=(("depends_on", "{file}", "{name}"),))), needs=("Model",)),
    Detector("python.django_views", ("python",), (Rule("endpoint", r"\b(?:re_)?(?:path|url)\(\s*r?['\"](?P<name>[^'\"]*)['\"]\s*,\s*(?P<view>[\w.]+)", "/{name}", "{path}:url:{name}", {"path_pattern": "{name}", "view_reference": "{view}", "framework": "django", "protocol": "http"}), Rule("class", r"^class\s+(?P<name>\w+)\([^)]*(?:View|ViewSet)\b", "{name}", "{path}:{name}", {"stereotype": "view", "framework": "django"}))),
    Detector("python.fastapi_routes", ("python",), (Rule("endpoint", rf"@(?P<router>\w+)\.(?P<verb>{_VERB})\(\s*['\"](?P<route>[^'\"]*)['\"][^)]*\)\s*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(?P<name>\w+)", "{verb} {route}", "{path}:{verb}:{route}", {"http_method": "{verb}", "path_pattern": "{route}", "router": "{router}", "framework": "fastapi", "protocol": "http"}, upper=("verb",)),)),
    Detector("python.flask_routes", ("python",), (Rule("endpoint", r"@(?P<blueprint>\w+)\.route\(\s*['\"](?P<route>[^'\"]+)['\"](?:[^)]*?methods\s*=\s*\[\s*['\"](?P<verb>\w+)[^\]]*\])?[^)]*\)\s*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(?P<name>\w+)", "{name}", "{path}:{blueprint}:{name}", {"http_method": "{verb}", "path": "{route}", "blueprint": "{blueprint}", "framework": "flask", "protocol": "http"}, upper=("verb",)),), needs=(".route(",)),
    Detector("kafka_python", ("python",), (_topic("kafka", r"\.(?:send|produce|send_and_wait)\(\s*['\"](?P<name>[^'\"]+)", "produces", owner="{file}"), _topic("kafka", r"(?:KafkaConsumer|AIOKafkaConsumer)\(\s*['\"](?P<name>[^'\"]+)", "consumes", owner="{file}"), _topic("kafka", r"\.subscribe\(\s*\[?\s*['\"](?P<name>[^'\"]+)", "consumes", owner="{file}"), _imports(r"^\s*(?:from|import)\s+(?P<name>kafka|confluent_kafka|aiokafka)\b", "py:external")), needs=("kafka",)),
    Detector("python.pydantic_models", ("python",), (Rule("entity", r"^class\s+(?P<name>\w+)\(\s*(?P<base>(?:\w+\.)?BaseModel)", "{name}", "{path}:{name}", {"framework": "pydantic", "base_class": "{base}"}, (("extends", "{path}:{name}", "{base}"),)), Rule("config_definition", r"^class\s+(?P<name>\w+)\(\s*(?P<base>(?:\w+\.)?BaseSettings)", "{name}", "{path}:{name}", {"framework": "pydantic", "base_class": "{base}"}))),
    Detector("python.sqlalchemy_models", ("python",), (Rule("entity", r"^class\s+(?P<name>\w+)\(\s*(?:db\.Model|Base|DeclarativeBase)\b(?:(?!^class\s)(?:.|\n))*?__tablename__\s*=\s*['\"](?P<table>\w+)", "{name}", "{path}:{name}", {"framework": "sqlalchemy", "table_name": "{table}"}), Rule(None, r"relationship\(\s*['\"](?P<name>\w+)", "{name}", edges=(("maps_to", "{file}", "{name}"),)))),
)

_ROUTE = rf"\b(?P<router>\w+)\.(?P<verb>{_VERB}|all)\(\s*{_Q}(?P<route>/[^\"'`]*){_Q}"
SCRIPT = (
    Detector("frontend.angular_components", ("typescript",), (Rule("component", r"@(?P<type>Component|Directive|NgModule)\((?:.|\n)*?\bclass\s+(?P<name>\w+)", "{name}", "{path}:{name}", {"decorator": "{type}"}), Rule("middleware", r"@(?P<type>Injectable|Pipe)\((?:.|\n)*?\bclass\s+(?P<name>\w+)", "{name}", "{path}:{name}", {"decorator": "{type}"}))),
    Detector("frontend.frontend_routes", WEB, (Rule("endpoint", r"<Route\b[^>]*?\bpath=\{?[\"'](?P<name>[^\"']+)", "{name}", "{path}:route:{name}", {"route_path": "{name}", "framework": "react", "protocol": "http"}), Rule("endpoint", r"\bpath:\s*['\"](?P<name>[^'\"]*)['\"]\s*,\s*(?:\w+:\s*['\"][^'\"]*['\"]\s*,\s*)?component:\s*(?P<c>\w+)", "{name}", "{path}:route:{name}", {"route_path": "{name}", "protocol": "http"}, (("renders", "{path}:route:{name}", "{c}"),)))),
    Detector("frontend.react_components", JS, (Rule("component", r"^\s*(?:export\s+)?(?:default\s+)?(?:function|const)\s+(?P<name>[A-Z]\w*)\s*(?:\(|=\s*(?:\([^)]*\)|\w+)\s*=>|:\s*React\.FC|=\s*(?:React\.)?(?:memo|forwardRef))", "{name}", "{path}:{name}", {"component_type": "function"}), Rule("component", r"class\s+(?P<name>[A-Z]\w*)\s+extends\s+(?:React\.)?(?:Pure)?Component", "{name}", "{path}:{name}", {"component_type": "class"}), Rule("hook", r"^\s*(?:export\s+)?(?:default\s+)?(?:function|const)\s+(?P<name>use[A-Z]\w*)", "{name}", "{path}:{name}"), Rule(None, r"<(?P<name>[A-Z]\w*)[\s/>]", "{name}", edges=(("renders", "{file}", "{name}"),))), needs=("react", "React", "jsx", "</", "/>")),
    Detector("frontend.svelte_components", ("svelte", *JS), (Rule("component", r"\A(?P<name>)(?=(?:.|\n)*<script)", "{path}", "{path}:component", {"framework": "svelte"}),), needs=("<script",)),
    Detector("frontend.vue_components", ("vue", *JS), (Rule("component", r"(?P<api>defineComponent\s*\(|<script\s+setup|export\s+default\s*\{)", "{owner}", "{path}:component", {"api_style": "{api}"}), Rule("hook", r"^\s*(?:export\s+)?(?:function|const)\s+(?P<name>use[A-Z]\w*)", "{name}", "{path}:{name}")), needs=("vue", "Vue", "<template", "defineComponent")),
    Detector("typescript.express_routes", JS, (Rule("endpoint", _ROUTE, "{verb} {route}", "{path}:{verb}:{route}", {"http_method": "{verb}", "path_pattern": "{route}", "router": "{router}", "framework": "express", "protocol": "http"}, upper=("verb",)),), unless=("fastify",)),
    Detector("fastify_routes", JS, (Rule("endpoint", _ROUTE, "{verb} {route}", "{path}:{verb}:{route}", {"http_method": "{verb}", "path_pattern": "{route}", "framework": "fastify", "protocol": "http"}, upper=("verb",)), Rule("endpoint", r"\.route\(\s*\{(?:(?!\}\s*\)).|\n)*?method:\s*['\"](?P<verb>\w+)['\"](?:.|\n)*?url:\s*['\"](?P<route>[^'\"]+)", "{verb} {route}", "{path}:{verb}:{route}", {"http_method": "{verb}", "path_pattern": "{route}", "framework": "fastify"}, upper=("verb",)), Rule("middleware", r"\.addHook\(\s*['\"](?P<name>\w+)", "{name}", "{path}:hook:{name}", {"hook_name": "{name}", "framework": "fastify"}), Rule(None, r"\.register\(\s*(?P<name>[\w.]+)", "{name}", edges=(("imports", "{file}", "{name}"),))), needs=("fastify",)),
    Detector("typescript.graphql_resolvers", JS, (Rule("class", r"@Resolver\(\s*(?:\(\)\s*=>\s*|of\s*=>\s*)?(?P<type>\w*)[^)]*\)(?:.|\n)*?class\s+(?P<name>\w+)", "{name}", "{path}:{name}", {"entity_type": "{type}", "framework": "nestjs_graphql"}), Rule("endpoint", r"@(?P<op>Query|Mutation|Subscription)\([^\n]*\)\s*\n?\s*(?:async\s+)?(?P<name>\w+)\s*\(", "{name}", "{path}:{op}:{name}", {"operation_type": "{op}", "field_name": "{name}", "protocol": "graphql"})), needs=("@Resolver", "@Query", "@Mutation", "@Subscription")),
    Detector("kafka_js", JS, (Rule("database_connection", r"new\s+(?P<name>Kafka)\s*\(", "kafka", "{path}:kafka", {"broker": "kafka", "library": "kafkajs"}), _topic("kafka", r"\.send\(\s*\{\s*(?:\n\s*)?topic:\s*['\"`](?P<name>[^'\"`]+)", "produces", owner="{file}"), _topic("kafka", r"\.subscribe\(\s*\{\s*(?:\n\s*)?topics?:\s*\[?['\"`](?P<name>[^'\"`]+)", "consumes", owner="{file}"), Rule("event", r"(?P<name>eachMessage|eachBatch)\s*:", "{name}", "{path}:{name}", {"handler": "{name}"})), needs=("kafka", "Kafka")),
    Detector("mongoose_orm", JS, (Rule("database_connection", r"mongoose\.(?P<name>connect|createConnection)\(", "mongodb", "{path}:mongoose", {"framework": "mongoose"}), Rule("entity", r"mongoose\.model(?:<[^>]*>)?\(\s*['\"](?P<name>\w+)|(?<!mongoose\.)\bmodel(?:<[^>]*>)?\(\s*['\"](?P<b>\w+)", "{name}{b}", "mongoose:{name}{b}", {"framework": "mongoose", "definition": "model"}), Rule("entity", r"(?:const|let|var)\s+(?P<name>\w+)\s*=\s*new\s+(?:mongoose\.)?Schema\b", "{name}", "{path}:schema:{name}", {"framework": "mongoose", "definition": "schema"}), Rule("event", r"\.(?P<hook>pre|post)\(\s*['\"](?P<name>\w+)", "{hook} {name}", "{path}:{hook}:{name}", {"hook_type": "{hook}", "event": "{name}"}), Rule(None, r"\b(?P<name>[A-Z]\w*)\.(?:find|findOne|findById|create|updateOne|updateMany|deleteOne|deleteMany|aggregate|countDocuments)\(", "{name}", edges=(("queries", "{file}", "mongoose:{name}"),))), needs=("mongoose",)),
    Detector("typescript.nestjs_controllers", JS, (Rule("class", r"@Controller\(\s*(?:['\"](?P<route>[^'\"]*)['\"])?\s*\)(?:.|\n)*?class\s+(?P<name>\w+)", "{name}", "{path}:{name}", {"stereotype": "controller", "framework": "nestjs", "path_pattern": "{route}"}), Rule("endpoint", r"@(?P<verb>Get|Post|Put|Delete|Patch|Options|Head|All)\(\s*(?:['\"](?P<route>[^'\"]*)['\"])?\s*\)(?:\s*@\w+\([^\n]*\))*\s*(?:public\s+)?(?:async\s+)?(?P<name>\w+)\s*\(", "{verb} {route}", "{path}:{verb}:{name}", {"http_method": "{verb}", "path_pattern": "{route}", "framework": "nestjs", "protocol": "http"}, (("exposes", _OWNER, "{path}:{verb}:{name}"),), upper=("verb",))), needs=("@Controller",)),
    Detector("prisma_orm", JS, (Rule("database_connection", r"new\s+(?P<name>PrismaClient)\s*\(", "{name}", "{path}:prisma", {"framework": "prisma"}), Rule("entity", r"\bprisma\.(?P<name>[a-z]\w*)\.(?P<op>find\w+|create\w*|update\w*|delete\w*|upsert|count|aggregate|groupBy)\(", "{name}", "prisma:{name}", {"framework": "prisma", "operation": "{op}"}, (("queries", "{file}", "prisma:{name}"),)), Rule(None, r"['\"](?P<name>@prisma/client)['\"]", "{name}", edges=(("imports", "{file}", "{name}"),))), needs=("prisma", "Prisma")),
    Detector("remix_routes", JS, (Rule("endpoint", r"export\s+(?:const|async\s+function|function)\s+(?P<name>loader|action)\b", "{name}", "{path}:{name}", {"framework": "remix", "type": "{name}", "route_path": "{path}"}), Rule("component", r"export\s+default\s+function\s+(?P<name>\w+)", "{name}", "{path}:{name}", {"framework": "remix", "type": "component"})), needs=("@remix-run", "LoaderFunction", "ActionFunction")),
    Detector("sequelize_orm", JS, (Rule("database_connection", r"new\s+(?P<name>Sequelize)\s*\(", "{name}", "{path}:sequelize", {"framework": "sequelize"}), Rule("entity", r"\.define\(\s*['\"](?P<name>\w+)|class\s+(?P<b>\w+)\s+extends\s+Model\b", "{name}{b}", "sequelize:{name}{b}", {"framework": "sequelize", "definition": "model"}), Rule(None, r"\b(?P<a>[A-Z]\w*)\.(?P<k>hasMany|hasOne|belongsTo|belongsToMany)\(\s*(?:\w+\.)?(?P<b>[A-Z]\w*)", "{b}", edges=(("depends_on", "sequelize:{a}", "sequelize:{b}"),)), Rule(None, r"\b(?P<name>[A-Z]\w*)\.(?:findAll|findOne|findByPk|create|bulkCreate|update|destroy|count)\(", "{name}", edges=(("queries", "{file}", "sequelize:{name}"),))), needs=("equelize",)),
    Detector("typescript.typeorm_entities", JS, (Rule("entity", r"@Entity\(\s*(?:['\"](?P<table>[^'\"]+)['\"])?[^)]*\)(?:.|\n)*?class\s+(?P<name>\w+)", "{name}", "{path}:{name}", {"framework": "typeorm", "table_name": "{table}"}), Rule(None, r"@(?P<k>ManyToOne|OneToMany|ManyToMany|OneToOne)\(\s*(?:\(\)|type|\w+)\s*=>\s*(?P<name>\w+)", "{name}", edges=(("maps_to", _OWNER, "{name}"),))), needs=("@Entity",)),
    Detector("actix_web", ("rust",), (Rule("endpoint", r"#\[(?P<verb>get|post|put|delete|patch)\(\s*\"(?P<route>[^\"]+)\"[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<name>\w+)", "{verb} {route}", "{path}:{verb}:{route}", {"http_method": "{verb}", "path": "{route}", "handler": "{name}", "framework": "actix"}, upper=("verb",)), Rule("endpoint", r"\.route\(\s*\"(?P<route>[^\"]+)\"\s*,\s*(?:web::)?(?P<verb>get|post|put|delete|patch)\(", "{verb} {route}", "{path}:{verb}:{route}", {"http_method": "{verb}", "path": "{route}", "framework": "axum"}, upper=("verb",)), Rule("endpoint", r"web::resource\(\s*\"(?P<route>[^\"]+)", "{route}", "{path}:resource:{route}", {"path": "{route}", "framework": "actix"}), Rule("middleware", r"\.(?:wrap|layer)\(\s*(?P<name>[\w:]+)", "{name}", "{path}:wrap:{name}", {"middleware": "{name}"}), Rule("module", r"#\[(?:actix_web::|tokio::)?(?P<name>main)\]", "{path}", "{file}", {"framework": "actix"}))),
)
ALL = (*AUTH, *CODE, *JVM, *PYTHON, *SCRIPT)
