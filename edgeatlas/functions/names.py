"""Names, keys, globs and digests: as Spark expressions, and as Python where extractors need them."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what may be stored as a name.
NAME = r"[A-Za-z_][A-Za-z0-9_.:-]{0,63}"
SALT = "edgeatlas-const"


def is_name(value: str | None) -> bool:
    return bool(value and re.fullmatch(NAME, value))


def name_shaped(c: Column) -> Column:
    return c.rlike(rf"\A{NAME}\z")


def digest(value: str) -> str:
    """A constant's value is stored as this only; equal values have equal digests."""
    return hashlib.sha256((SALT + value).encode()).hexdigest()[:24]


def name_digest(c: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(SALT), c), 256), 1, 24)


def normal_key(key: str) -> str:
    return key.strip().lower().replace("__", ":").replace(".", ":")


def normalize_key(c: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(c)), F.lit("__"), F.lit(":")), F.lit("."), F.lit(":"))


def module_name(path: str) -> str:
    """Dotted module of a Python file."""
    p = path.removeprefix("src/").removesuffix(".py")
    parts = p.split("/")
    if parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts)


def module_of(path: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(path, r"\Asrc/", ""), r"\.py\z", "")
    return F.replace(F.regexp_replace(p, r"(\A|/)__init__\z", ""), F.lit("/"), F.lit("."))


def glob_regex(glob: str) -> str:
    """A case-sensitive glob whose ``*`` also crosses ``/``, as a regular expression for the whole text."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[" and (j := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            body = glob[i:j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = j + 1
        else:
            out.append(re.escape(c))
    return r"\A(?:" + "".join(out) + r")\z"


def glob_match(path: Column, globs: list[str]) -> Column:
    """Whether any glob meets the path, as it is or with a slash before it."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g)) | F.concat(F.lit("/"), path).rlike(glob_regex(g))
    return hit


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    keep = glob_match(path, include) if include else F.lit(True)
    return keep & ~glob_match(path, exclude)


#: Files read as configuration.
CONFIG_GLOBS = ("appsettings*.json", "config*.json", "*.config.yaml", "*.config.yml", "docker-compose*.yml", "docker-compose*.yaml", ".env.example", ".env.sample", ".env.template", "pyproject.toml")
OVERRIDES_FILE = "edgeatlas.overrides.yaml"


def language(path: Column) -> Column:
    """overrides, config, python, csharp or null; configuration before the extension."""
    base = F.element_at(F.split(path, "/"), -1)
    config = F.lit(False)
    for g in CONFIG_GLOBS:
        config = config | base.rlike(glob_regex(g))
    return F.when(base == OVERRIDES_FILE, "overrides").when(config, "config").when(base.endswith(".py"), "python").when(base.endswith(".cs"), "csharp")


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
