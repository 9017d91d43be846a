"""Configuration files: keys with their lines, script entry points, declared links. Values are never kept."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import yaml

from edgeatlas.extract.facts import Facts

MOST_PAIRS = 100_000
ENV_LINE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=")
_JSON = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"/]+', re.S)


def json_keys(text: str) -> Iterator[tuple[str, int]]:
    """(path joined by ``:``, line of the key) of the leaves; an array is one leaf."""
    import json

    tokens = [(m.group(), text.count("\n", 0, m.start()) + 1) for m in _JSON.finditer(text)] if len(text) < 4096 else list(_numbered(text))
    tokens = [t for t in tokens if not t[0].startswith(("//", "/*"))]
    at = 0

    def value(path: list[str], line: int) -> Iterator[tuple[str, int]]:
        nonlocal at
        token, here = tokens[at]
        at += 1
        if token == "{":
            empty = True
            while tokens[at][0] != "}":
                if tokens[at][0] == ",":
                    at += 1
                    continue
                key, key_line = tokens[at]
                if tokens[at + 1][0] != ":":
                    raise ValueError("a key without a value")
                at += 2
                empty = False
                yield from value([*path, json.loads(key)], key_line)
            at += 1
            if empty and path:
                yield ":".join(path), line
        elif token == "[":
            depth = 1
            while depth:
                depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(tokens[at][0], 0)
                at += 1
            if path:
                yield ":".join(path), line
        elif token in ("}", "]", ":", ","):
            raise ValueError("unexpected punctuation")
        elif path:
            yield ":".join(path), line

    yield from value([], 1)


def _numbered(text: str) -> Iterator[tuple[str, int]]:
    line, last = 1, 0
    for m in _JSON.finditer(text):
        line += text.count("\n", last, m.start())
        last = m.start()
        yield m.group(), line


def yaml_keys(text: str) -> Iterator[tuple[str, int]]:
    """(path joined by ``.``, line) of the leaves; an alias counts once, so that merging one adds nothing; mappings merged in place add their keys."""
    seen: set[int] = set()
    budget = MOST_PAIRS

    def walk(node: yaml.Node, path: str, line: int) -> Iterator[tuple[str, int]]:
        nonlocal budget
        if isinstance(node, yaml.MappingNode) and node.value:
            if id(node) in seen:
                yield path, line
                return
            seen.add(id(node))
            for k, v in node.value:
                budget -= 1
                if budget < 0:
                    raise ValueError("too many keys")
                if k.value == "<<":
                    for x in v.value if isinstance(v, yaml.SequenceNode) else [v]:
                        if isinstance(x, yaml.MappingNode) and id(x) not in seen:
                            yield from walk(x, path, k.start_mark.line + 1)
                elif isinstance(k, yaml.ScalarNode):
                    yield from walk(v, f"{path}.{k.value}" if path else str(k.value), k.start_mark.line + 1)
        elif path:
            yield path, line

    for doc in yaml.compose_all(text, Loader=yaml.SafeLoader):
        if doc is not None:
            yield from walk(doc, "", 1)


def compose_keys(text: str) -> Iterator[tuple[str, int]]:
    """Environment names of a compose file's services."""
    child = lambda node, name: next((v for k, v in node.value if k.value == name), None) if isinstance(node, yaml.MappingNode) else None
    for doc in yaml.compose_all(text, Loader=yaml.SafeLoader):
        services = child(doc, "services")
        for _, service in services.value if isinstance(services, yaml.MappingNode) else []:
            env = child(service, "environment")
            if isinstance(env, yaml.MappingNode):
                yield from ((k.value, k.start_mark.line + 1) for k, _ in env.value)
            elif isinstance(env, yaml.SequenceNode):
                yield from ((x.value.split("=", 1)[0], x.start_mark.line + 1) for x in env.value if isinstance(x, yaml.ScalarNode))


def extract(path: str, content: bytes) -> Facts:
    text = content.decode("utf-8", "replace").removeprefix("﻿")
    name = path.rsplit("/", 1)[-1]
    facts = Facts()
    try:
        if name == "pyproject.toml":
            for script, target in (tomllib.loads(text).get("project", {}).get("scripts", {})).items():
                found = re.search(rf"(?m)^\s*[\"']?{re.escape(script)}[\"']?\s*=", text)
                facts.add("entry_points", kind="console-script", name=script, target=str(target), line=text.count("\n", 0, found.start()) + 1 if found else 1)
        elif ".env" in name:
            for i, line in enumerate(text.split("\n"), 1):
                if m := ENV_LINE.match(line):
                    facts.add("config_keys", key_path=m[1], line=i, origin="env-example")
        elif name.endswith((".yaml", ".yml")):
            keys = compose_keys if re.fullmatch(r"(docker-)?compose.*", name) else yaml_keys
            for k, line in keys(text):
                facts.add("config_keys", key_path=k, line=line, origin="yaml")
        else:
            for k, line in json_keys(text):
                facts.add("config_keys", key_path=k, line=line, origin="json")
    except Exception:  # what was read so far is dropped with the file
        return Facts(parse_error=True)
    return facts


def overrides(path: str, content: bytes) -> Facts:
    """Declared links; one malformed entry makes the whole file a parse error."""
    facts = Facts()
    for e in yaml.safe_load(content.decode())["edges"]:
        if not isinstance(e, dict) or not isinstance(e["from"], str) or not isinstance(e["to"], str) or not {*e} <= {"from", "to", "kind", "note"}:
            raise ValueError("malformed link")
        facts.add("refs", from_qualified=e["from"], to_name=e["to"], kind="curated", line=1, note=e.get("note"))
    return facts
