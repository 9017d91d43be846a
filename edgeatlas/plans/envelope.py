"""Answers with evidence, structured errors, and the runner that audits and sanitises every call."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from edgeatlas.schemas import SOURCES

CODES = ("not_indexed", "ambiguous_symbol", "not_found", "invalid_argument", "internal")


class ToolError(Exception):
    def __init__(self, error: str, message: str, hint: str = "", data: Any = None):
        super().__init__(message)
        self.error, self.message, self.hint, self.data = error, message, hint, data

    def as_dict(self) -> dict[str, Any]:
        return {"error": self.error, "message": self.message, "hint": self.hint, "data": self.data}


def invalid(message: str, hint: str = "") -> ToolError:
    return ToolError("invalid_argument", message, hint)


@dataclass
class Answer:
    """Rows, the evidence beside each, where they come from, the snapshots they hold for, confidence, staleness and notes."""

    data: Any
    evidence: list[dict[str, Any]] = field(default_factory=list)
    source: str = "parsed"
    as_of: list[dict[str, Any]] = field(default_factory=list)
    confidence: float = 1.0
    stale: bool = False
    notes: list[str] = field(default_factory=list)


def weakest(sources: list[str]) -> str:
    return min(sources, key=SOURCES.index) if sources else "parsed"


def with_staleness(answer: Answer, repos: list[dict[str, Any]], head_fn: Callable[[str], str | None]) -> Answer:
    """Add the repositories' snapshots by name; a head that differs or can't be read makes the answer stale."""
    behind, unreadable = False, []
    for r in sorted(repos, key=lambda x: x["name"]):
        answer.as_of.append({"repo": r["name"], "sha": r["head_sha"], "indexed_at": r["indexed_at"]})
        now = head_fn(r["path"])
        unreadable += [r["name"]] if now is None else []
        behind |= now not in (None, r["head_sha"])
    answer.stale = behind or bool(unreadable)
    if behind:
        answer.notes.append("index is behind HEAD for at least one repo; run `edgeatlas index <root>`")
    if unreadable:
        answer.notes.append(f"HEAD could not be read for {', '.join(unreadable)} (git is missing or the repo path is gone), so freshness is unknown and the answer is marked stale")
    return answer


class HeadCache:
    """A repository's head commit, kept for some seconds."""

    def __init__(self, read: Callable[[str], str | None], seconds: float = 60, clock: Callable[[], float] = time.monotonic):
        self.read, self.seconds, self.clock, self.kept = read, seconds, clock, {}

    def __call__(self, path: str) -> str | None:
        at, value = self.kept.get(path, (None, None))
        if at is None or self.clock() - at > self.seconds:
            value = self.read(path)
            self.kept[path] = (self.clock(), value)
        return value


class ToolRunner:
    """Bind the arguments, run, audit and sanitise; nothing escapes but an answer or a structured error."""

    def __init__(self, tools: dict[str, Callable[..., Any]], audit: Callable[..., None] | None = None, clean: Callable[[Any], Any] = lambda x: x):
        self.tools, self.audit, self.clean = tools, audit, clean

    def run(self, tool: str, args: dict[str, Any], client: str = "") -> dict[str, Any]:
        began, error, count = time.perf_counter(), None, 0
        try:
            if tool not in self.tools:
                raise invalid(f"no such tool: {tool}", f"one of {', '.join(sorted(self.tools))}")
            fn = self.tools[tool]
            try:
                inspect.signature(fn).bind(**args)
            except TypeError as e:
                raise invalid(str(e)) from None
            got = fn(**args)
            out = dict(vars(got)) if isinstance(got, Answer) else {"data": got}
            count = len(out["data"]) if isinstance(out["data"], list) else 1
        except ToolError as e:
            error, out = e.error, e.as_dict()
        except Exception as e:  # the boundary: a tool's failure is an answer
            error, out = "internal", ToolError("internal", f"{type(e).__name__} in {tool}").as_dict()
        if self.audit:
            self.audit(tool=tool, args=args, result_count=count, duration_ms=(time.perf_counter() - began) * 1000, client=client, error=error)
        return self.clean(out)
