"""C# files, by a tokenizer and a reader of declarations; bodies are scanned for declared types and calls."""

from __future__ import annotations

import re
from dataclasses import dataclass

from edgeatlas.extract.facts import Facts
from edgeatlas.functions.names import digest, is_name

_TOKENS = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^[ \t]*\#[^\n]*)|(?P<str>\$*"{3,}.*?"{3,}|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"(?:[^"\\\n]|\\.)*")|(?P<chr>'(?:[^'\\]|\\.)+')|(?P<num>\d[\w.]*)|(?P<id>@?[^\W\d]\w*)|(?P<op>\?\.|=>|::|\?\?|&&|\|\||[=!<>+\-*/%&|^]=|.)""",
    re.S | re.M | re.X,
)
MODIFIERS = set("public private protected internal static abstract sealed virtual override readonly async partial extern unsafe new required volatile file ref".split())
TYPE_WORDS = {"class", "interface", "struct", "enum", "record"}
NOT_CALLS = set("if while for foreach switch using lock catch fixed return typeof sizeof default checked unchecked when nameof base this new await throw in is as and or not yield else do".split())
NOT_TYPES = NOT_CALLS | set("var case break continue goto out ref const true false null get set init add remove where select from join let on equals by into orderby group ascending descending with".split())
SENDS = ("Enqueue", "EnqueueAsync")


@dataclass
class Tok:
    kind: str
    text: str
    line: int


def tokens(source: str) -> list[Tok]:
    out, line = [], 1
    for m in _TOKENS.finditer(source):
        if m.lastgroup != "skip":
            out.append(Tok(m.lastgroup, m.group().lstrip("@") if m.lastgroup == "id" else m.group(), line))
        line += m.group().count("\n")
    return out


def plain_string(t: Tok) -> str | None:
    return t.text.strip('@"') if t.kind == "str" and not t.text.startswith("$") and "\\" not in t.text else None


class _File:
    def __init__(self, path: str, source: str):
        self.t = tokens(source)
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in "([{":
                stack.append(i)
            elif t.kind == "op" and t.text in ")]}" and stack:
                self.close[stack.pop()] = i
        self.facts = Facts(parse_error=bool(stack))
        self.module = path.rsplit("/", 1)[-1].removesuffix(".cs")
        self.lines = source.count("\n") + (not source.endswith("\n"))
        self.started = False

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def end_of(self, i: int) -> int:
        return self.close.get(i, len(self.t) - 1)

    def generic_end(self, i: int) -> int:
        """Just after a type-argument list that opens at i, or i where it is not one."""
        depth, j = 0, i
        while j < len(self.t) and (self.t[j].kind == "id" or self.text(j) in "<>,.?[]()"):
            depth += {"<": 1, ">": -1}.get(self.text(j), 0)
            j += 1
            if depth == 0:
                return j
        return i

    def name_at(self, i: int) -> tuple[str, int]:
        """A dotted name without type arguments, and what follows it."""
        parts = []
        while i < len(self.t) and self.t[i].kind == "id":
            parts.append(self.text(i))
            i += 1
            if self.text(i) == "<":
                i = self.generic_end(i)
            if self.text(i) in (".", "::"):
                i += 1
            else:
                break
        return ".".join(parts), i

    def type_at(self, i: int) -> tuple[str, int]:
        name, j = self.name_at(i)
        while name and self.text(j) in ("?", "["):
            if self.text(j) == "[":
                if self.text(j + 1) not in ("]", ","):
                    break
                name, j = "", self.end_of(j) + 1
                return "[]", j
            j += 1
        return name, j

    # ---- declarations

    def run(self) -> Facts:
        first = next((self.name_at(i + 1)[0] for i, t in enumerate(self.t) if t.text == "namespace" and t.kind == "id"), None)
        self.module = first or self.module
        self.facts.module = self.module
        self.facts.add("symbols", kind="module", name=self.module.rsplit(".", 1)[-1], qualified_name=self.module, line_start=1, line_end=max(1, self.lines), visibility="public")
        self.space(0, len(self.t), "")
        return self.facts

    def space(self, i: int, end: int, namespace: str) -> None:
        env: list[dict[str, str]] = [{}]
        while i < end:
            word = self.text(i)
            if word == "[":
                i = self.end_of(i) + 1
            elif word in ("using", "global") and self.text(i + (2 if word == "global" else 1)) != "(" and (word == "using" or self.text(i + 1) == "using") and not self._declares(i + 1):
                i = self.using(i)
            elif word == "namespace":
                name, j = self.name_at(i + 1)
                full = f"{namespace}.{name}" if namespace else name
                if self.text(j) == "{":
                    self.space(j + 1, self.end_of(j), full)
                    i = self.end_of(j) + 1
                else:
                    namespace, i = full, j + 1
            elif self.t[i].kind == "id" and (j := self.type_word(i)) is not None:
                i = self.declare(i, j, namespace, top=True)
            elif word == "delegate" or word in MODIFIERS and "delegate" in (self.text(k) for k in range(i, min(i + 4, end))):
                i = self.until(i, end, ";") + 1
            elif word in (";", "}"):
                i += 1
            else:
                j = self.statement_end(i, end)
                if not self.started:
                    self.started = True
                    self.facts.add("entry_points", kind="program-main", name=self.module, line=self.t[i].line)
                self.scan(i, j, self.module, env)
                i = j

    def _declares(self, i: int) -> bool:
        return self.text(i) == "var"

    def until(self, i: int, end: int, stop: str) -> int:
        while i < end and self.text(i) != stop:
            i = self.close[i] + 1 if i in self.close else i + 1
        return i

    def statement_end(self, i: int, end: int) -> int:
        while i < end:
            if self.text(i) == ";":
                return i + 1
            if self.text(i) == "{":
                return self.end_of(i) + 1
            i = self.close[i] + 1 if i in self.close and self.text(i) != "{" else i + 1
        return end

    def using(self, i: int) -> int:
        line, shared = self.t[i].line, self.text(i) == "global"
        i += 2 if shared else 1
        static = self.text(i) == "static"
        i += static
        alias = None
        if self.text(i + 1) == "=":
            alias, i = self.text(i), i + 2
        target, j = self.name_at(i)
        local = ("*global=" + alias if alias else "*global-static" if static else "*global") if shared else alias or ("*static" if static else "*")
        self.facts.add("imports", local_name=local, target=target, line=line)
        return self.until(j, len(self.t), ";") + 1

    def type_word(self, i: int) -> int | None:
        """Index of the type keyword of a declaration that starts at i."""
        while self.text(i) in MODIFIERS:
            i += 1
        if self.text(i) in TYPE_WORDS and i + 1 < len(self.t) and self.t[i + 1].kind == "id":
            return i
        return None

    def visibility(self, i: int, j: int, default: str) -> str:
        words = {self.text(k) for k in range(i, j)}
        return "public" if "public" in words else "private" if words & {"private", "protected", "internal"} else default

    def declare(self, i: int, j: int, outer: str, top: bool, member_default: str = "private") -> int:
        kind = "interface" if self.text(j) == "interface" else "class"
        k = j + 1 + (self.text(j) == "record" and self.text(j + 1) in ("class", "struct"))
        name = self.text(k)
        full = f"{outer}.{name}" if outer else name
        line = self.t[i].line
        k += 1
        if self.text(k) == "<":
            k = self.generic_end(k)
        fields: dict[str, str] = {}
        params = None
        if self.text(k) == "(":
            params = (k + 1, self.end_of(k))
            k = self.end_of(k) + 1
        if self.text(k) == ":":
            k += 1
            while k < len(self.t) and self.text(k) not in ("{", ";", "where"):
                base, after = self.name_at(k)
                if base and self.text(j) != "enum":
                    self.facts.add("refs", from_qualified=full, to_name=base, kind="inherit", line=self.t[k].line)
                k = max(after, k + 1)
                if self.text(k) == "(":
                    k = self.end_of(k) + 1
                if self.text(k) == ",":
                    k += 1
        while k < len(self.t) and self.text(k) not in ("{", ";"):
            k += 1
        end = self.end_of(k) if self.text(k) == "{" else k
        self.facts.add("symbols", kind=kind, name=name, qualified_name=full, line_start=line, line_end=self.t[min(end, len(self.t) - 1)].line, visibility=self.visibility(i, j, "public" if top else member_default))
        if params:
            fields |= self.parameters(*params)
        if self.text(k) == "{" and self.text(j) != "enum":
            self.members(k + 1, end, full, name, kind, fields)
        return end + 1

    def parameters(self, i: int, end: int) -> dict[str, str]:
        out = {}
        while i < end:
            if self.text(i) == "[":
                i = self.end_of(i) + 1
                continue
            if self.text(i) in ("this", "ref", "out", "in", "params", "scoped", "readonly"):
                i += 1
                continue
            t, j = self.type_at(i)
            if t and j < end and self.t[j].kind == "id":
                out[self.text(j)] = t if t != "[]" else ""
            i = self.until(max(j, i + 1), end, ",") + 1
        return out

    def members(self, i: int, end: int, full: str, name: str, kind: str, fields: dict[str, str]) -> None:
        default = "public" if kind == "interface" else "private"
        bodies = []
        while i < end:
            if self.text(i) == "[":
                i = self.end_of(i) + 1
                continue
            if self.text(i) in (";", "}"):
                i += 1
                continue
            if (j := self.type_word(i)) is not None:
                i = self.declare(i, j, full, top=False, member_default=default)
                continue
            start = i
            while self.text(i) in MODIFIERS or self.text(i) in ("const", "event", "implicit", "explicit"):
                i += 1
            mods = {self.text(k) for k in range(start, i)}
            # up to the parameter list, the body or the initial value
            j = i
            while j < end and self.text(j) not in ("(", "{", ";", "=>", "="):
                j = self.generic_end(j) if self.text(j) == "<" and self.generic_end(j) > j else self.end_of(j) + 1 if self.text(j) == "[" else j + 1
            if self.text(j) == "(" and j > i:
                at = j - 1
                if self.text(at) == ">":
                    depth = 0
                    while at > i:
                        depth += {">": 1, "<": -1}.get(self.text(at), 0)
                        at -= 1
                        if depth == 0:
                            break
                label = self.text(at)
                stop = self.end_of(j)
                k = stop + 1
                while k < end and self.text(k) not in ("{", ";", "=>"):
                    k = self.close.get(k, k) + 1
                body_end = self.end_of(k) if self.text(k) == "{" else self.until(k, end, ";")
                if self.t[at].kind == "id":
                    ctor = label == name and at == i
                    label = (".cctor" if "static" in mods else ".ctor") if ctor else label
                    q = f"{full}.{label}"
                    params = self.parameters(j + 1, stop)
                    self.facts.add("symbols", kind="method", name=label, qualified_name=q, line_start=self.t[start].line, line_end=self.t[min(body_end, len(self.t) - 1)].line, visibility=self.visibility(start, i, default), param_count=len(params))
                    if label == "Main" and "static" in mods:
                        self.facts.add("entry_points", kind="program-main", name=q, line=self.t[start].line)
                    bodies.append((stop + 1, body_end, q, params))
                i = body_end + 1
                continue
            t, after = self.type_at(i)
            label = self.text(after) if after < end and self.t[after].kind == "id" else None
            if label:
                fields[label] = "" if t == "[]" else t
                if "const" in mods and t == "string" and self.text(j) == "=" and is_name(value := plain_string(self.t[j + 1])):
                    self.facts.add("string_consts", qualified_name=f"{full}.{label}", value=digest(value), line=self.t[start].line)
            if self.text(j) == "{":
                stop = self.end_of(j)
                bodies.append((j + 1, stop, full, {}))
                i = stop + 1
                if self.text(i) == "=":
                    k = self.until(i, end, ";")
                    bodies.append((i, k, full, {}))
                    i = k + 1
            else:
                k = self.until(j, end, ";")
                bodies.append((j, k, full, {}))
                i = max(k, start) + 1
        for a, b, q, params in bodies:
            self.scan(a, b, q, [fields, params])

    # ---- bodies

    def declared(self, env: list[dict[str, str]], name: str) -> str | None:
        return next((f[name] for f in reversed(env) if name in f), None)

    def scan(self, i: int, end: int, scope: str, env: list[dict[str, str]]) -> None:
        env = [*env, {}]
        opened: list[int] = []
        while i < end:
            t = self.t[i]
            if t.text == "{":
                env.append({})
                opened.append(self.end_of(i))
            elif t.text == "}" and opened and i == opened[-1]:
                opened.pop()
                env.pop()
            elif t.kind == "id":
                self.local(i, end, env)
                if t.text == "new":
                    self.creation(i, scope, env)
                elif t.text not in NOT_CALLS:
                    j = i + 1
                    if self.text(j) == "<":
                        j = self.generic_end(j)
                    if self.text(j) == "(" and self.text(i - 1) != "new" and not self.made(i):
                        self.call(i, j, scope, env)
            elif t.text == "[" and i and self.t[i - 1].kind == "id" and self.is_configuration(self.text(i - 1), env) and i + 2 < end and self.text(i + 2) == "]":
                self.setting(plain_string(self.t[i + 1]), self.t[i], scope, "")
            i += 1

    def made(self, i: int) -> bool:
        while self.text(i - 1) in (".", "::") and self.t[i - 2].kind == "id":
            i -= 2
        return self.text(i - 1) == "new"

    def local(self, i: int, end: int, env: list[dict[str, str]]) -> None:
        """``T x =``, ``T x;``, ``var x = new T``, ``T x in``, ``is T x``: the type of x from here on."""
        before = self.text(i - 1)
        if self.text(i) == "var":
            if i + 1 < end and self.t[i + 1].kind == "id" and self.text(i + 2) in ("=", "in", ";"):
                made = self.text(i + 2) == "=" and self.text(i + 3) == "new"
                env[-1][self.text(i + 1)] = self.name_at(i + 4)[0] if made else ""
        elif self.text(i) not in NOT_TYPES and before not in (".", "?.", "new"):
            t, j = self.type_at(i)
            if t and j < end and self.t[j].kind == "id" and j > i and self.text(j) not in NOT_TYPES and self.text(j + 1) in ("=", ";", "in", ")", ",", "&&", "||", "=>", "{") and (before != "." and self.text(j - 1) != "."):
                env[-1][self.text(j)] = "" if t == "[]" else t

    def creation(self, i: int, scope: str, env: list[dict[str, str]]) -> None:
        name, j = self.name_at(i + 1)
        if name and self.text(j) in ("(", "{"):
            self.facts.add("refs", from_qualified=scope, to_name=name, kind="instantiate", line=self.t[i].line)
        elif self.text(i + 1) == "(" and self.text(i - 1) == "=" and i >= 3 and self.t[i - 2].kind == "id" and (t := self.declared(env, self.text(i - 2))):
            self.facts.add("refs", from_qualified=scope, to_name=t, kind="instantiate", line=self.t[i].line)

    def is_configuration(self, name: str, env: list[dict[str, str]]) -> bool:
        return name.endswith("Configuration") or (self.declared(env, name) or "").endswith("Configuration")

    def setting(self, key: str | None, at: Tok, scope: str, prefix: str) -> None:
        whole = (prefix + ":" if prefix else "") + (key or "")
        if key and all(is_name(p) for p in whole.split(":")):
            self.facts.add("config_keys", key_path=whole, line=at.line, origin="code-read", reader_qualified=scope)

    def section_before(self, i: int) -> str:
        """``A:B`` of ``GetSection("A").GetSection("B")`` chained before the call at i."""
        parts = []
        while self.text(i - 1) in (".", "?.") and self.text(i - 2) == ")":
            opening = next((a for a, b in self.close.items() if b == i - 2), None)
            if opening is None or self.text(opening - 1) not in ("GetSection", "GetRequiredSection") or (s := plain_string(self.t[opening + 1])) is None:
                break
            parts.append(s)
            i = opening - 1
        return ":".join(reversed(parts))

    def call(self, i: int, paren: int, scope: str, env: list[dict[str, str]]) -> None:
        name, at = self.text(i), self.t[i]
        chain, k = [], i
        while self.text(k - 1) in (".", "?.", "::") and k >= 2 and (self.t[k - 2].kind == "id" and self.text(k - 2) not in ("new",)):
            chain.insert(0, self.text(k - 2))
            k -= 2
        opaque = self.text(k - 1) in (".", "?.", "::")
        first = self.t[paren + 1] if paren + 1 < len(self.t) else at
        literal = plain_string(first)
        receiver = None
        if opaque:
            to = f"?.{name}"
        elif not chain:
            to = name
        else:
            walk = chain[1:] if chain[0] == "this" and len(chain) > 1 else chain
            kind = self.declared(env, walk[0])
            if len(walk) == 1 and walk[0] in ("this", "base"):
                to = f"{walk[0]}.{name}"
            elif kind is not None:
                to, receiver = (name, kind) if len(walk) == 1 and kind else (f"?.{name}", None)
            else:
                to = ".".join([*walk, name])
        start = self.t[k] if chain and not opaque else at
        self.facts.add("refs", from_qualified=scope, to_name=to, kind="call", line=start.line, receiver_type=receiver)
        if name == "GetEnvironmentVariable" and chain[-1:] == ["Environment"]:
            self.setting(literal, at, scope, "")
        elif name == "GetConnectionString":
            self.setting(literal, at, scope, "ConnectionStrings")
        elif name in ("GetSection", "GetRequiredSection", "GetValue"):
            self.setting(literal, at, scope, self.section_before(i))
        if name in self.sends and (chain or opaque):
            if is_name(literal):
                self.facts.add("refs", from_qualified=scope, to_name=literal, kind="queue", line=at.line)
            elif first.kind == "id":
                dotted, j = self.name_at(paren + 1)
                if "." in dotted and self.text(j) in (",", ")"):
                    self.facts.add("refs", from_qualified=scope, to_name=dotted, kind="queue_const", line=at.line)


def extract(path: str, content: bytes, sends: tuple[str, ...] = SENDS) -> Facts:
    file = _File(path, content.decode("utf-8", "replace").removeprefix("\ufeff").replace("\r\n", "\n"))
    file.sends = sends
    return file.run()
