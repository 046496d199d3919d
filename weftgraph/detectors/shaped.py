"""Detectors that read parsed files, or need more than a pattern."""

from __future__ import annotations

import re

from weftgraph.detectors.engine import Detector, File, Found
from weftgraph.sources.structured import documents


def _as_dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _as_list(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _file_and_keys(prefix: str, sections: bool = False):
    def run(file: File, out: Found) -> None:
        root = out.node(f"{prefix}:{file.path}", "config_file", file.path, file, format=prefix)
        for doc in documents(file.parsed):
            for key, value in doc.items():
                deep = sections and isinstance(value, dict)
                out.edge("contains", root, out.node(f"{prefix}:{file.path}:{key}", "config_key", key, file, section=str(deep).lower() if sections else None))
                for sub in value if deep and prefix == "ini" else ():
                    out.edge("contains", root, out.node(f"{prefix}:{file.path}:{key}.{sub}", "config_key", f"{key}.{sub}", file, section=key))

    return run


def _properties(file: File, out: Found) -> None:
    root = out.node(f"properties:{file.path}", "config_file", file.path, file, format="properties")
    for key, value in _as_dict(file.parsed and file.parsed["data"]).items():
        jdbc = re.match(r"jdbc:(\w+):", str(value))
        kind = "database_connection" if jdbc else "config_key"
        out.edge("contains", root, out.node(f"properties:{file.path}:{key}", kind, key, file, value=value if jdbc else None, db_type=jdbc and jdbc[1]))


def _cloudformation(file: File, out: Found) -> None:
    for doc in documents(file.parsed):
        resources = _as_dict(doc.get("Resources"))
        if not any(str(_as_dict(r).get("Type", "")).startswith("AWS::") for r in resources.values()):
            continue
        for name, r in resources.items():
            me = out.node(f"cfn:{file.path}:resource:{name}", "infra_resource", name, file, resource_type=_as_dict(r).get("Type"), logical_id=name)
            for to, how in _references(r):
                if to in resources and to != name:
                    out.edge("depends_on", me, f"cfn:{file.path}:resource:{to}", ref_type=how)
        for part in ("Parameters", "Outputs"):
            for name, p in _as_dict(doc.get(part)).items():
                out.node(f"cfn:{file.path}:{part.lower()[:-1]}:{name}", "config_definition", name, file, cfn_type=part.lower()[:-1], param_type=_as_dict(p).get("Type"))


def _references(x):
    """(name, how) of Ref, Fn::GetAtt and DependsOn anywhere below."""
    if isinstance(x, dict):
        for k, v in x.items():
            if k == "Ref" and isinstance(v, str):
                yield v, "Ref"
            elif k == "Fn::GetAtt" and v:
                yield (v[0] if isinstance(v, list) else str(v).split(".")[0]), "GetAtt"
            elif k == "DependsOn":
                yield from ((d, "DependsOn") for d in _as_list(v))
            else:
                yield from _references(v)
    elif isinstance(x, list):
        for v in x:
            yield from _references(v)


def _compose(file: File, out: Found) -> None:
    for doc in documents(file.parsed):
        services = _as_dict(doc.get("services"))
        if not re.search(r"compose", file.path) and not any("image" in _as_dict(s) or "build" in _as_dict(s) for s in services.values()):
            continue
        for name, s in services.items():
            s = _as_dict(s)
            me = out.node(f"compose:{file.path}:service:{name}", "infra_resource", name, file, image=s.get("image"))
            for part, one in (("ports", "port"), ("volumes", "volume"), ("networks", "network")):
                for x in _as_list(list(s[part]) if isinstance(s.get(part), dict) else s.get(part)):
                    out.node(f"{me}:{one}:{x}", "config_key", f"{name}:{x}", file, **{one: x})
            for to in s.get("depends_on") or ():
                out.edge("depends_on", me, f"compose:{file.path}:service:{to}")
            for to in s.get("links") or ():
                out.edge("connects_to", me, f"compose:{file.path}:service:{str(to).split(':')[0]}")


def _github(file: File, out: Found) -> None:
    if ".github/workflows" not in file.path:
        return
    for doc in documents(file.parsed):
        jobs = _as_dict(doc.get("jobs"))
        flow = out.node(f"gha:{file.path}", "module", str(doc.get("name") or file.path), file, workflow_file=file.path)
        on = doc.get("on", doc.get("True"))
        for event in on if isinstance(on, (dict, list)) else _as_list(on):
            out.node(f"gha:{file.path}:on:{event}", "config_key", str(event), file, event=event)
        for name, job in jobs.items():
            me = out.node(f"gha:{file.path}:job:{name}", "method", str(_as_dict(job).get("name") or name), file)
            out.edge("contains", flow, me)
            for to in _as_list(_as_dict(job).get("needs")):
                out.edge("depends_on", me, f"gha:{file.path}:job:{to}")


_GITLAB_WORDS = {"stages", "variables", "image", "services", "before_script", "after_script", "cache", "include", "default", "workflow", "pages"}


def _gitlab(file: File, out: Found) -> None:
    if not file.path.rsplit("/", 1)[-1].endswith(".gitlab-ci.yml"):
        return
    for doc in documents(file.parsed):
        flow = out.node(f"gitlab:{file.path}", "module", file.path, file, pipeline_file=file.path)
        for stage in _as_list(doc.get("stages")):
            out.node(f"gitlab:{file.path}:stage:{stage}", "config_key", str(stage), file, stage=stage)
        for x in _as_list(doc.get("include")):
            out.edge("imports", flow, str(next(iter(x.values()), "")) if isinstance(x, dict) else str(x))
        for name, job in doc.items():
            if name in _GITLAB_WORDS or not isinstance(job, dict):
                continue
            me = out.node(f"gitlab:{file.path}:job:{name}", "method", name, file, stage=job.get("stage"))
            out.edge("contains", flow, me)
            for to in _as_list(job.get("needs")):
                out.edge("depends_on", me, f"gitlab:{file.path}:job:{to.get('job') if isinstance(to, dict) else to}")
            for to in _as_list(job.get("extends")):
                out.edge("extends", me, f"gitlab:{file.path}:job:{to}")


def _helm(file: File, out: Found) -> None:
    base, root = file.path.rsplit("/", 1)[-1], f"helm:{file.path}"
    doc = next(iter(documents(file.parsed)), {})
    if base == "Chart.yaml":
        out.node(root, "module", str(doc.get("name") or file.path), file, chart_name=doc.get("name"), chart_version=doc.get("version"), type=doc.get("type"))
        for d in map(_as_dict, _as_list(doc.get("dependencies"))):
            out.edge("depends_on", root, f"helm:chart:{d.get('name')}", version=d.get("version"), repository=d.get("repository"))
    elif base == "values.yaml":
        for key in doc:
            out.node(f"{root}:{key}", "config_key", key, file, helm_value="true")
    elif "/templates/" in file.path:
        for m in re.finditer(r"\.Values\.([\w.]+)", file.text):
            out.edge("reads_config", root, f"helm:value:{m[1]}", key=m[1], line=file.line(m.start()))
        for m in re.finditer(r'\b(?:include|template)\s+"([^"]+)"', file.text):
            out.edge("imports", root, f"helm:helper:{m[1]}", helper=m[1])


_WORKLOADS = {"Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "ReplicaSet", "Pod"}


def _manifests(file: File) -> list[dict]:
    return [d for d in documents(file.parsed) if "apiVersion" in d and "kind" in d]


def _kube_id(doc: dict) -> str:
    meta = _as_dict(doc.get("metadata"))
    return f"k8s:{doc['kind']}:{meta.get('namespace', 'default')}:{meta.get('name', 'unnamed')}"


def _kubernetes(file: File, out: Found) -> None:
    found = _manifests(file)
    for doc in found:
        meta, spec = _as_dict(doc.get("metadata")), _as_dict(doc.get("spec"))
        me = out.node(_kube_id(doc), "infra_resource", f"{doc['kind']}/{meta.get('name')}", file, kind=doc["kind"], namespace=meta.get("namespace", "default"))
        template = _as_dict(_as_dict(_as_dict(spec.get("jobTemplate")).get("spec") or spec).get("template"))
        for c in map(_as_dict, _as_list((_as_dict(template.get("spec")) or spec).get("containers"))):
            out.node(f"{me}:container:{c.get('name')}", "config_key", str(c.get("name")), file, image=c.get("image"), ports=",".join(str(_as_dict(p).get("containerPort")) for p in _as_list(c.get("ports"))), env_vars=",".join(str(_as_dict(e).get("name")) for e in _as_list(c.get("env"))))
        if doc["kind"] == "Service" and _as_dict(spec.get("selector")):
            for other in found:
                labels = _as_dict(_as_dict(_as_dict(_as_dict(other.get("spec")).get("template")).get("metadata")).get("labels")) or _as_dict(_as_dict(other.get("metadata")).get("labels"))
                if other["kind"] in _WORKLOADS and spec["selector"].items() <= labels.items():
                    out.edge("depends_on", me, _kube_id(other))
        if doc["kind"] == "Ingress":
            for rule in map(_as_dict, _as_list(spec.get("rules"))):
                for p in map(_as_dict, _as_list(_as_dict(rule.get("http")).get("paths"))):
                    b = _as_dict(p.get("backend"))
                    if name := b.get("serviceName") or _as_dict(b.get("service")).get("name"):
                        out.edge("connects_to", me, f"k8s:Service:{meta.get('namespace', 'default')}:{name}")


def _rbac(file: File, out: Found) -> None:
    for doc in _manifests(file):
        if doc["kind"] not in ("Role", "ClusterRole", "RoleBinding", "ClusterRoleBinding", "ServiceAccount"):
            continue
        rules = [_as_dict(r) for r in _as_list(doc.get("rules"))]
        listed = lambda k, rules=rules: ",".join(sorted({str(x) for r in rules for x in _as_list(r.get(k))}))
        me = out.node(f"rbac:{_kube_id(doc)}", "guard", str(_as_dict(doc.get("metadata")).get("name")), file, auth_type="k8s_rbac", k8s_kind=doc["kind"], verbs=listed("verbs"), resources=listed("resources"), apiGroups=listed("apiGroups"))
        role, space = _as_dict(doc.get("roleRef")), _as_dict(doc.get("metadata")).get("namespace", "default")
        giver = f"rbac:k8s:{role.get('kind')}:{'default' if role.get('kind') == 'ClusterRole' else space}:{role.get('name')}"
        for s in map(_as_dict, _as_list(doc.get("subjects"))):  # a binding without a role, and users and groups, protect no account
            if role and s.get("kind") == "ServiceAccount":
                out.edge("protects", giver, f"rbac:k8s:ServiceAccount:{s.get('namespace', space)}:{s.get('name')}", binding_kind=doc["kind"])


def _openapi(file: File, out: Found) -> None:
    for doc in documents(file.parsed):
        version = doc.get("openapi") or doc.get("swagger")
        if not version:
            continue
        info = _as_dict(doc.get("info"))
        root = out.node(f"api:{file.path}", "config_file", str(info.get("title") or file.path), file, config_type="openapi", spec_version=version, api_title=info.get("title"), api_version=info.get("version"))
        for path, item in _as_dict(doc.get("paths")).items():
            for verb, op in _as_dict(item).items():
                if verb.lower() in ("get", "post", "put", "delete", "patch", "options", "head", "trace"):
                    out.edge("contains", root, out.node(f"api:{file.path}:{verb.lower()}:{path}", "endpoint", f"{verb.upper()} {path}", file, http_method=verb.upper(), path=path, operation_id=_as_dict(op).get("operationId")))
        schemas = _as_dict(_as_dict(doc.get("components")).get("schemas")) or _as_dict(doc.get("definitions"))
        for name, schema in schemas.items():
            me = out.node(f"api:{file.path}:schema:{name}", "entity", name, file, schema_name=name, schema_type=_as_dict(schema).get("type"))
            for to in sorted(set(re.findall(r"'\$ref': '#/(?:components/schemas|definitions)/([^']+)'", str(schema)))):
                out.edge("depends_on", me, f"api:{file.path}:schema:{to}")


def _package_json(file: File, out: Found) -> None:
    if not file.path.rsplit("/", 1)[-1] == "package.json":
        return
    doc = _as_dict(file.parsed and file.parsed["data"])
    root = out.node(f"npm:{file.path}", "module", str(doc.get("name") or file.path), file, version=doc.get("version"))
    for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        for name, spec in _as_dict(doc.get(part)).items():
            out.edge("depends_on", root, f"npm:{name}", dep_type=part, version_spec=spec)
    for name, command in _as_dict(doc.get("scripts")).items():
        out.edge("contains", root, out.node(f"npm:{file.path}:script:{name}", "method", name, file, script_name=name, command=command))


def _pyproject(file: File, out: Found) -> None:
    if not file.path.rsplit("/", 1)[-1] == "pyproject.toml":
        return
    doc = _as_dict(file.parsed and file.parsed["data"])
    project = _as_dict(doc.get("project")) or _as_dict(doc.get("tool"))
    root = out.node(f"pypi:{file.path}", "module", str(project.get("name") or file.path), file, version=project.get("version"))
    for spec in _as_list(project.get("dependencies")):
        out.edge("depends_on", root, "pypi:" + re.split(r"[\s<>=!~;\[]", str(spec), maxsplit=1)[0], dep_spec=spec)
    section = ""
    for line in file.text.splitlines():
        if m := re.match(r"\s*\[([^\]]+)\]", line):
            section = m[1]
        elif m := re.match(r"""\s*["']?([\w.-]+)["']?\s*=\s*(.+?)\s*$""", line):
            if re.fullmatch(r"tool\.poetry(\.group\.\w+)?\.(dev-)?dependencies", section) and m[1] != "python":
                out.edge("depends_on", root, f"pypi:{m[1]}", dep_spec=m[2].strip("\"'"))
            elif section in ("project.scripts", "tool.poetry.scripts"):
                out.edge("contains", root, out.node(f"pypi:{file.path}:script:{m[1]}", "config_definition", m[1], file, script_name=m[1], target=m[2].strip("\"'")))


_TS_OPTIONS = {"target", "module", "strict", "jsx", "outDir", "rootDir", "baseUrl", "paths", "moduleResolution", "lib", "esModuleInterop", "declaration", "sourceMap"}


def _tsconfig(file: File, out: Found) -> None:
    if not re.fullmatch(r"tsconfig.*\.json", file.path.rsplit("/", 1)[-1]):
        return
    doc = _as_dict(file.parsed and file.parsed["data"])
    root = out.node(f"tsconfig:{file.path}", "config_file", file.path, file, config_type="tsconfig")
    for to in _as_list(doc.get("extends")):
        out.edge("depends_on", root, str(to), relation="extends")
    for ref in map(_as_dict, _as_list(doc.get("references"))):
        out.edge("depends_on", root, str(ref.get("path")), relation="references")
    for key, value in _as_dict(doc.get("compilerOptions")).items():
        if key in _TS_OPTIONS:
            out.edge("contains", root, out.node(f"tsconfig:{file.path}:{key}", "config_key", key, file, key=key, value=value))


_MAPPING = re.compile(r"@(Request|Get|Post|Put|Delete|Patch)Mapping\b\s*(?:\(([^)]*)\))?")
_METHOD = re.compile(r"(?:public|protected|private)?\s*(?:static\s+)?[\w<>\[\], ?]+\s+(\w+)\s*\(")


def join_path(base: str, sub: str) -> str:
    """One slash between the parts, where there are two."""
    return f"{base.rstrip('/')}/{sub.lstrip('/')}" if base and sub else base or sub


def _attribute(args: str, name: str) -> str:
    m = re.search(rf'\b{name}\s*=\s*\{{?\s*"([^"]*)"', args)
    return m[1] if m else ""


def _spring_rest(file: File, out: Found) -> None:
    owner = re.search(r"\bclass\s+(\w+)", file.text)
    base, name = "", owner[1] if owner else "Unknown"
    for m in _MAPPING.finditer(file.text):
        args = m[2] or ""
        first = re.match(r'\s*\{?\s*"([^"]*)"', args)
        route = first[1] if first else _attribute(args, "value") or _attribute(args, "path")
        if owner and m.start() < owner.start():
            base = route
            continue
        method = _METHOD.search(file.text, m.end(), m.end() + 400)
        if not method or re.search(r"@(?:ModelAttribute|InitBinder|ExceptionHandler)\b", file.text[m.end() : method.start()]):
            continue
        told = re.search(r"RequestMethod\.(\w+)", args)
        verb = m[1].upper() if m[1] != "Request" else told[1] if told else "GET"
        out.node(f"{file.path}:{name}:{method[1]}:{verb}", "endpoint", method[1], file, file.line(m.start()), framework="spring_boot", http_method=verb, path=join_path(base, route), method=method[1], produces=_attribute(args, "produces"), consumes=_attribute(args, "consumes"))


ALL = (
    Detector("ini_structure", ("ini",), function=_file_and_keys("ini", True), confidence="SYNTACTIC"),
    Detector("json_structure", ("json",), function=_file_and_keys("json"), confidence="SYNTACTIC"),
    Detector("yaml_structure", ("yaml",), function=_file_and_keys("yaml"), confidence="SYNTACTIC"),
    Detector("toml_structure", ("toml",), function=_file_and_keys("toml", True), confidence="SYNTACTIC"),
    Detector("properties", ("properties",), function=_properties, confidence="SYNTACTIC"),
    Detector("cloudformation", ("yaml", "json"), function=_cloudformation, confidence="SYNTACTIC"),
    Detector("docker_compose", ("yaml",), function=_compose, confidence="SYNTACTIC"),
    Detector("github_actions", ("yaml",), function=_github, confidence="SYNTACTIC"),
    Detector("gitlab_ci", ("yaml",), function=_gitlab, confidence="SYNTACTIC"),
    Detector("helm_chart", ("yaml",), function=_helm, confidence="SYNTACTIC"),
    Detector("kubernetes", ("yaml",), function=_kubernetes, confidence="SYNTACTIC"),
    Detector("config.kubernetes_rbac", ("yaml",), function=_rbac, confidence="SYNTACTIC"),
    Detector("openapi", ("json", "yaml"), function=_openapi, confidence="SYNTACTIC"),
    Detector("package_json", ("json",), function=_package_json, confidence="SYNTACTIC"),
    Detector("pyproject_toml", ("toml",), function=_pyproject, confidence="SYNTACTIC"),
    Detector("tsconfig_json", ("json",), function=_tsconfig, confidence="SYNTACTIC"),
    Detector("spring_rest", ("java",), function=_spring_rest, needs=("Mapping",)),
)
