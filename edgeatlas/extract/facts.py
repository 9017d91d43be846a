"""The facts of one file."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa

LISTS = {
    "symbols": "kind:string,name:string,qualified_name:string,line_start:int,line_end:int,visibility:string,param_count:int",
    "refs": "from_qualified:string,to_name:string,kind:string,line:int,receiver_type:string,note:string",
    "imports": "local_name:string,target:string,line:int",
    "config_keys": "key_path:string,line:int,origin:string,reader_qualified:string",
    "entry_points": "kind:string,name:string,target:string,line:int",
    "queue_handlers": "protocol:string,name:string,handler_qualified:string,line:int",
    "string_consts": "qualified_name:string,value:string,line:int",
}
FACTS_DDL = "module string, parse_error boolean, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in LISTS.items())
_FIELDS = {k: [x.split(":")[0] for x in v.split(",")] for k, v in LISTS.items()}
_ARROW = {"string": pa.string(), "int": pa.int32()}


def arrow_schema(*strings: str, **others: str) -> pa.Schema:
    """The schema of ``FACTS_DDL`` for Arrow, after further columns."""
    lists = {k: pa.list_(pa.struct([(n, _ARROW[t]) for n, t in (x.split(":") for x in v.split(","))])) for k, v in LISTS.items()}
    return pa.schema({**dict.fromkeys(strings, pa.string()), **{k: _ARROW[t] for k, t in others.items()}, "module": pa.string(), "parse_error": pa.bool_(), **lists})


@dataclass
class Facts:
    module: str | None = None
    parse_error: bool = False
    symbols: list[dict[str, Any]] = field(default_factory=list)
    refs: list[dict[str, Any]] = field(default_factory=list)
    imports: list[dict[str, Any]] = field(default_factory=list)
    config_keys: list[dict[str, Any]] = field(default_factory=list)
    entry_points: list[dict[str, Any]] = field(default_factory=list)
    queue_handlers: list[dict[str, Any]] = field(default_factory=list)
    string_consts: list[dict[str, Any]] = field(default_factory=list)

    def add(self, what: str, **values: Any) -> None:
        getattr(self, what).append({k: values.get(k) for k in _FIELDS[what]})

    @staticmethod
    def columns(many: list[Facts]) -> dict[str, list[Any]]:
        return {k: [getattr(f, k) for f in many] for k in ("module", "parse_error", *LISTS)}
