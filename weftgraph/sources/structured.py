"""Shallow parsers for configuration files; malformed input gives an empty result, never an error."""

from __future__ import annotations

import json
import re

import yaml


def _plain(x):
    """Keys as text, all the way down."""
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def parse_yaml(text: str) -> dict:
    """{"type": "yaml", "data"} for one document, {"type": "yaml_multi", "documents"} for more; reading stops at a bad one."""
    found = []
    try:
        for doc in yaml.safe_load_all(text):
            found.append(_plain(doc))
    except (yaml.YAMLError, ValueError, RecursionError):
        pass
    found = [d for d in found if d is not None]
    if len(found) > 1:
        return {"type": "yaml_multi", "documents": found}
    return {"type": "yaml", "data": found[0] if found else {}}


def parse_json(text: str) -> dict:
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        data = {}
    return {"type": "json", "data": data if isinstance(data, dict) else {}}


def _value(raw: str):
    raw = raw.strip()
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
        return raw[1:-1]
    if raw.startswith("[") and raw.endswith("]"):
        return [_value(x) for x in re.findall(r'"[^"]*"|\'[^\']*\'|[^,\[\]\s]+', raw)]
    return raw


def parse_toml(text: str) -> dict:
    """Sections and keys; nested tables go into their top-level section."""
    data: dict = {}
    here, waiting = data, ""
    for line in text.splitlines():
        line = re.sub(r'^((?:[^"\'#]|"[^"]*"|\'[^\']*\')*)#.*$', r"\1", line).strip()
        if waiting:
            waiting += " " + line
            if line.endswith("]"):
                key, _, raw = waiting.partition("=")
                here[key.strip().strip("\"'")] = _value(raw)
                waiting = ""
        elif m := re.match(r"\[+\s*([^\]]+?)\s*\]+$", line):
            here = data.setdefault(m[1].split(".")[0].strip("\"' "), {})
            here = here if isinstance(here, dict) else {}
        elif "=" in line:
            key, _, raw = line.partition("=")
            if raw.strip().startswith("[") and not raw.strip().endswith("]"):
                waiting = line
            else:
                here[key.strip().strip("\"'")] = _value(raw)
    return {"type": "toml", "data": data}


def parse_ini(text: str) -> dict:
    """Sections and keys; keys before the first section are left out."""
    data: dict = {}
    here = None
    for line in text.splitlines():
        line = line.strip()
        if m := re.match(r"\[([^\]]+)\]", line):
            here = data.setdefault(m[1].strip(), {})
        elif here is not None and line and line[0] not in "#;" and (m := re.match(r"([^=:]+)[=:](.*)", line)):
            here[m[1].strip()] = m[2].strip()
    return {"type": "ini", "data": data}


def parse_properties(text: str) -> dict:
    data = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!" and (m := re.match(r"([^=:\s]+)\s*[=:\s]\s*(.*)", line)):
            data[m[1]] = m[2].strip()
    return {"type": "properties", "data": data}


PARSERS = {"yaml": parse_yaml, "json": parse_json, "toml": parse_toml, "ini": parse_ini, "properties": parse_properties}


def parse(language: str, text: str) -> dict | None:
    return PARSERS[language](text) if language in PARSERS else None


def documents(parsed: dict | None) -> list[dict]:
    """The mappings at the top of a parsed file."""
    if not parsed:
        return []
    found = parsed.get("documents", [parsed.get("data")])
    return [d for d in found if isinstance(d, dict)]
