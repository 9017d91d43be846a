"""Repositories on disk: discovery, manifests, projects, contents. The control plane runs on the driver; contents are read by Spark."""

from __future__ import annotations

import os
import subprocess
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeatlas.functions.names import glob_regex, included, language

# ---- fixed values
SKIPPED = {"node_modules", "venv", "__pycache__", "site-packages", "bin", "obj"}
MARKERS = ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt")
DEPTH, LARGEST = 4, 2_000_000
EXCLUDED = ["**/node_modules/**", "**/.venv/**", "**/venv/**", "**/vendor/**", "**/dist/**", "**/build/**"]
SEND_METHODS = ["Enqueue", "EnqueueAsync"]
# ---- end of fixed values


class IngestError(Exception):
    pass


class ConfigError(Exception):
    pass


@dataclass
class Config:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDED))
    languages: list[str] = field(default_factory=lambda: ["python", "csharp"])
    projects: str | list[str] = "off"
    extra_redaction_patterns: list[str] = field(default_factory=list)
    send_methods: list[str] = field(default_factory=lambda: list(SEND_METHODS))


def load_config(path: str | Path) -> Config:
    """One line says what is wrong with a file, never its values."""
    import re

    try:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return Config()
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{Path(path).name}: not valid TOML ({type(e).__name__})") from None
    queues = raw.pop("queues", {})
    if not isinstance(queues, dict) or not {*queues} <= {"send_methods"} or "send_methods" in raw:
        raise ConfigError(f"{Path(path).name}: queues must be a table with send_methods")
    raw |= queues
    known = Config.__dataclass_fields__
    for key, value in raw.items():
        if key not in known:
            raise ConfigError(f"{Path(path).name}: unknown key {key}")
        fine = isinstance(value, list) and all(isinstance(x, str) for x in value)
        if not fine and not (key == "projects" and value in ("auto", "off")):
            raise ConfigError(f"{Path(path).name}: {key} must be a list of strings")
    for i, p in enumerate(raw.get("extra_redaction_patterns", [])):
        try:
            re.compile(p)
        except re.error:
            raise ConfigError(f"{Path(path).name}: extra_redaction_patterns[{i}] is not a regular expression") from None
    return Config(**raw)


def git(repo: Path, *args: str) -> bytes:
    try:
        return subprocess.run(["git", "-c", "core.fsmonitor=false", "-C", str(repo), *args], capture_output=True, check=True, timeout=120).stdout
    except (OSError, subprocess.SubprocessError) as e:
        raise IngestError(f"git {args[0]} failed in {repo.name}") from e


def head_sha(repo: str | Path) -> str:
    return git(Path(repo), "rev-parse", "HEAD").decode().strip()


def head_or_none(repo: str) -> str | None:
    try:
        return head_sha(repo)
    except IngestError:
        return None


def tracked_files(repo: Path) -> list[str]:
    return [p for p in git(repo, "ls-files", "-z").decode("utf-8", "surrogateescape").split("\0") if p]


def discover_repos(root: str | Path) -> list[Path]:
    """The root itself, or repositories up to four levels down, links not followed, nothing inside a repository.

    A repository counts whatever its name; folders that can't be read, hidden ones and those named in SKIPPED are not searched.
    """
    root = Path(root)
    if (root / ".git").exists():
        return [root]
    found, at = [], [root]
    for _ in range(DEPTH):
        below = []
        for d in at:
            try:
                entries = [x for x in d.iterdir() if not x.is_symlink() and x.is_dir()]
            except OSError:
                continue
            for x in entries:
                if os.access(x, os.X_OK) and (x / ".git").exists():
                    found.append(x)
                elif not x.name.startswith(".") and x.name not in SKIPPED:
                    below.append(x)
        at = below
    return sorted(found, key=lambda p: p.relative_to(root).as_posix())


def repo_name(root: Path, repo: Path) -> str:
    return root.name if repo == root else repo.relative_to(root).as_posix()


def inside(path: Path, root: Path) -> bool:
    """A regular file, not a link, that really lies under the root."""
    return not path.is_symlink() and path.is_file() and root.resolve() in path.resolve().parents


def project_roots(tracked: list[str], mode: str | list[str] = "auto") -> list[str]:
    """Folders that count as projects of their own: with a Python marker or a solution, or a C# project under no solution. Never the root."""
    if mode == "off":
        return []
    if isinstance(mode, list):
        return sorted({m.strip("/") for m in mode} - {"", "."})
    folder = lambda p: PurePosixPath(p).parent.as_posix()
    solutions = {folder(p) for p in tracked if p.endswith(".sln")}
    out = {folder(p) for p in tracked if PurePosixPath(p).name in MARKERS} | solutions
    for p in tracked:
        if p.endswith(".csproj"):
            d = PurePosixPath(folder(p))
            if not any(x.as_posix() in solutions for x in (d, *d.parents)):
                out.add(d.as_posix())
    return sorted(out - {"."})


def manifest(spark: SparkSession, root: str | Path, config: Config | None = None) -> tuple[DataFrame, dict[str, tuple[str, str]], list[str], list[str]]:
    """(repo, path, file_path) of the files to index; per repository its folder and commit; repositories that git can't read; notes.

    A file belongs to the deepest project folder above it, and its path starts there; the rest stays with the repository.
    """
    config, root = config or Config(), Path(root)
    rows, repos, failed, notes = [], {}, [], []
    for repo in discover_repos(root):
        name = repo_name(root, repo)
        try:
            sha, tracked = head_sha(repo), tracked_files(repo)
        except IngestError as e:
            failed.append(name)
            notes.append(f"{name}: {e}")
            continue
        projects = project_roots(tracked, config.projects)
        for p in projects:
            if isinstance(config.projects, list) and not any(t.startswith(p + "/") for t in tracked):
                notes.append(f"{name}: project folder {p} has no files")
        for t in tracked:
            if not inside(repo / t, repo):
                continue
            own = max((p for p in projects if t.startswith(p + "/")), key=len, default=None)
            full = f"{name}/{own}" if own else name
            repos.setdefault(full, (str(repo), sha))
            rows.append((full, t[len(own) + 1 :] if own else t, os.fspath(repo / t)))
        repos.setdefault(name, (str(repo), sha))
    df = spark.createDataFrame(rows, "repo string, path string, file_path string")
    df = df.withColumn("lang", language(F.col("path"))).where(included(F.col("path"), config.include, config.exclude))
    return df.where(F.col("lang").isin("config", "overrides", *config.languages)), repos, failed, notes


def contents(spark: SparkSession, root: str | Path, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, path, lang, content, content_hash), and the files left out for their size.

    Tasks open the files themselves, on the mount that the driver listed them from: Spark's own listing leaves out names that start
    with ``_`` or ``.``. What is no longer a regular file under the root by then is left out.
    """
    top = Path(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for repo, path, lang, name in zip(b["repo"], b["path"], b["lang"], b["file_path"], strict=True):
                p = Path(name)
                if inside(p, top):
                    size = p.stat().st_size
                    got.append((repo, path, lang, size, p.read_bytes() if size <= LARGEST else None))
            yield pd.DataFrame(got, columns=["repo", "path", "lang", "length", "content"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = files.repartition(n, "repo", "path").mapInPandas(read, "repo string, path string, lang string, length long, content binary")
    small = raw.where("content is not null").select("repo", "path", "lang", "content", F.sha2("content", 256).alias("content_hash"))
    return small, raw.where("content is null").select("repo", "path", "length")


__all__ = ["Config", "ConfigError", "IngestError", "contents", "discover_repos", "glob_regex", "head_sha", "inside", "load_config", "manifest", "project_roots", "repo_name", "tracked_files"]
