"""Python files, by the standard parser. A file it rejects is read again with the offending lines blanked, and marked."""

from __future__ import annotations

import ast

from edgeatlas.extract.facts import Facts
from edgeatlas.functions.names import is_name, module_name

# ---- fixed values
GETTERS = ("os.getenv", "os.environ.get", "getenv", "environ.get")
MAPPINGS = ("os.environ", "environ")
ACTORS = ("dramatiq.actor", "actor")
SENDS = ("send", "send_with_options")
# ---- end of fixed values
BLANKED = 40


def dotted(node: ast.AST | None) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def text_of(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def parse(source: str) -> tuple[ast.Module, bool]:
    lines, broken = source.split("\n"), False
    for _ in range(BLANKED):
        try:
            return ast.parse("\n".join(lines)), broken
        except (SyntaxError, ValueError) as e:
            broken = True
            at = min(max((getattr(e, "lineno", None) or 1) - 1, 0), len(lines) - 1)
            while at >= 0 and not lines[at].strip():
                at -= 1
            if at < 0:
                break
            line = lines[at]
            # first a statement that does nothing, to keep the block; where that is what fails, nothing
            lines[at] = "" if line.strip() == "pass" else line[: len(line) - len(line.lstrip())] + "pass"
    return ast.Module(body=[], type_ignores=[]), True


class _Reader(ast.NodeVisitor):
    def __init__(self, module: str, package: str, facts: Facts, strings: dict[str, str]):
        self.module, self.package, self.facts, self.strings = module, package, facts, strings
        self.scope, self.owner = module, None  # owner: the class, directly in its body

    def inside(self, scope: str, owner: str | None, body: list[ast.stmt]) -> None:
        before = self.scope, self.owner
        self.scope, self.owner = scope, owner
        for x in body:
            self.visit(x)
        self.scope, self.owner = before

    def ref(self, kind: str, to: str, node: ast.AST, source: str | None = None) -> None:
        self.facts.add("refs", from_qualified=source or self.scope, to_name=to, kind=kind, line=node.lineno)

    def define(self, node: ast.stmt, kind: str, **more) -> str:
        q = f"{self.scope}.{node.name}"
        self.facts.add("symbols", kind=kind, name=node.name, qualified_name=q, line_start=node.lineno, line_end=node.end_lineno, visibility="private" if node.name.startswith("_") else "public", **more)
        return q

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for d in node.decorator_list:
            self.visit(d)
        q = self.define(node, "class")
        for b in node.bases:
            if name := dotted(b):
                self.ref("inherit", name, b, q)
        self.inside(q, q, node.body)

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        for d in node.decorator_list:
            self.visit(d)
        self.handler(node)
        a = node.args
        names = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
        method = self.owner is not None and self.owner == self.scope
        q = self.define(node, "method" if method else "function", param_count=len(names) - (method and names[:1] in (["self"], ["cls"])))
        self.inside(q, None, node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def handler(self, node: ast.FunctionDef) -> None:
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            if dotted(call.func if call else d) not in ACTORS:
                continue
            job = node.name
            for k in call.keywords if call else []:
                if k.arg == "actor_name":
                    given = text_of(k.value) or (self.strings.get(k.value.id) if isinstance(k.value, ast.Name) else None)
                    job = given if is_name(given) else job
            self.facts.add("queue_handlers", protocol="dramatiq", name=job, handler_qualified=f"{self.scope}.{node.name}", line=min([node.lineno, *(x.lineno for x in node.decorator_list)]))

    def visit_Call(self, node: ast.Call) -> None:
        name = dotted(node.func) or (f"?.{node.func.attr}" if isinstance(node.func, ast.Attribute) else None)
        if name:
            self.ref("call", name, node)
            self.sends(node)
            if name in GETTERS:
                self.setting(node.args[0] if node.args else None, node)
        self.generic_visit(node)

    def sends(self, node: ast.Call) -> None:
        f = node.func
        if not isinstance(f, ast.Attribute):
            return
        if f.attr in SENDS and (to := dotted(f.value)):
            self.ref("queue_actor", to, node)
        elif f.attr == "enqueue" and node.args and isinstance(m := node.args[0], ast.Call) and (dotted(m.func) or "").split(".")[-1] == "Message":
            for k in m.keywords:
                if k.arg == "actor_name" and is_name(job := text_of(k.value)):
                    self.ref("queue", job, node)

    def setting(self, key: ast.AST | None, node: ast.AST) -> None:
        if is_name(name := text_of(key)):
            self.facts.add("config_keys", key_path=name, line=node.lineno, origin="code-read", reader_qualified=self.scope)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if dotted(node.value) in MAPPINGS:
            self.setting(node.slice, node)
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        t = node.test
        if self.scope == self.module and isinstance(t, ast.Compare) and dotted(t.left) == "__name__" and len(t.ops) == 1 and isinstance(t.ops[0], ast.Eq) and text_of(t.comparators[0]) == "__main__":
            self.facts.add("entry_points", kind="main-block", name=self.module, line=node.lineno)
        self.generic_visit(node)

    def bind(self, local: str, target: str, node: ast.AST) -> None:
        self.facts.add("imports", local_name=local, target=target, line=node.lineno)
        self.ref("import", target, node, self.module)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            head = a.name.split(".")[0]
            self.bind(a.asname or head, a.name if a.asname else head, node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = (node.module or "").split(".") if node.module else []
        if node.level:
            package = self.package.split(".") if self.package else []
            base = package[: max(0, len(package) - (node.level - 1))] + base
        for a in node.names:
            if a.name == "*":
                self.bind("*", ".".join(base), node)
            else:
                self.bind(a.asname or a.name, ".".join([*base, a.name]), node)


def once_assigned(tree: ast.Module) -> dict[str, str]:
    """String constants of the module's top level that are assigned once."""
    seen: dict[str, list[str | None]] = {}
    for x in tree.body:
        targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, (ast.AnnAssign, ast.AugAssign)) else []
        for t in targets:
            if isinstance(t, ast.Name):
                seen.setdefault(t.id, []).append(text_of(x.value))
    return {k: v[0] for k, v in seen.items() if len(v) == 1 and v[0] is not None}


def extract(path: str, content: bytes) -> Facts:
    source = content.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n")
    tree, broken = parse(source)
    module = module_name(path)
    package = module if path.endswith("__init__.py") else module.rpartition(".")[0]
    facts = Facts(module=module, parse_error=broken)
    facts.add("symbols", kind="module", name=module.rsplit(".", 1)[-1], qualified_name=module, line_start=1, line_end=max(1, source.count("\n") + (not source.endswith("\n"))), visibility="public")
    reader = _Reader(module, package, facts, once_assigned(tree))
    for x in tree.body:
        reader.visit(x)
    return facts
