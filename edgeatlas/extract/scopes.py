"""Statements and definitions of Python files by their lines alone: no grammar, so files that do not parse have scopes too.

A line starts a statement if a logical line begins there: lines inside brackets, after a backslash or inside a string of several lines do
not. Where the file's tokens cannot be told, every line with something other than a comment does. Definitions nest by indentation.
"""

from __future__ import annotations

import io
import keyword
import re
import tokenize
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T
from pyspark.sql.udtf import AnalyzeResult, UserDefinedTableFunction

from edgeatlas.extract import config

DEFINED = re.compile(r"(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)")
CALLED = re.compile(r"([A-Za-z_]\w*)\s*\(")
SILENT = {tokenize.NL, tokenize.COMMENT, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER}
#: Names before a parenthesis that are no calls.
NOT_CALLED = {*keyword.kwlist, "print"}
SCOPE = "line int, indent int, starts boolean, scope string, defines string, name string, ends int, calls array<string>"

TYPES = {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def statement_lines(text: str) -> set[int]:
    """Numbers (from 1) of the lines that start a statement."""
    lines = text.split("\n")
    try:
        told = [t for t in tokenize.generate_tokens(io.StringIO(text + "\n").readline) if t.type not in SILENT]
    except (tokenize.TokenError, SyntaxError):
        return {i for i, line in enumerate(lines, 1) if line.strip() and not line.lstrip().startswith("#")}
    before = [tokenize.NEWLINE] + [t.type for t in told]
    return {t.start[0] for t, last in zip(told, before, strict=False) if last == tokenize.NEWLINE and t.type != tokenize.NEWLINE}


def scopes(text: str, module: str) -> list[tuple]:
    """A row per line as in ``SCOPE``: the definition around it, what it defines (qualified and by itself), the last line of that body, and names before a parenthesis."""
    starts = statement_lines(text)
    out: list[list] = []
    around: list[tuple[int, str, int]] = []  # indentation, qualified name, row
    for number, line in enumerate(text.split("\n"), 1):
        indent = len(line) - len(line.lstrip())
        calls = [c for c in CALLED.findall(line) if c not in NOT_CALLED]
        if number not in starts:
            out.append([number, indent, False, out[-1][3] if out else module, None, None, None, calls])
            continue
        while around and around[-1][0] >= indent:
            out[around.pop()[2]][6] = number - 1
        scope = around[-1][1] if around else module
        out.append([number, indent, True, scope, None, None, None, calls])
        if m := DEFINED.match(line.strip()):
            out[-1][4:6] = [f"{scope}.{m[1]}", m[1]]
            around.append((indent, f"{scope}.{m[1]}", len(out) - 1))
    for _, _, row in around:
        out[row][6] = len(out)
    return [tuple(r) for r in out]


# ---- table functions

def _columns(ddl: str) -> staticmethod:
    """What ``analyze`` of a table function says: its columns, whatever its arguments. It runs where there is no session to read DDL."""
    schema = T.StructType()
    for name, kind in (column.split() for column in ddl.split(", ")):
        schema.add(name, TYPES[kind])
    return staticmethod(lambda *args: AnalyzeResult(schema=schema))


class _Table:
    """A table function of texts; where one is null it has no rows."""

    def eval(self, *args: str | None) -> Iterator[tuple]:
        if args and all(a is not None for a in args):
            yield from self.rows(*args)


class PythonScopes(_Table):
    """python_scopes(text, module): a row per line."""

    analyze = _columns(SCOPE)

    def rows(self, text: str, module: str) -> Iterator[tuple]:
        yield from scopes(text, module)


class EnvKeys(_Table):
    """env_keys(text): key and line of every assignment line of an environment file."""

    analyze = _columns("key string, line int")

    def rows(self, text: str) -> Iterator[tuple]:
        for i, line in enumerate(text.split("\n"), 1):
            if m := config.ENV_LINE.match(line):
                yield m[1], i


class JsonKeys(_Table):
    """json_keys(text): path (joined by ``:``) and line of every leaf; a text that cannot be read has none."""

    analyze = _columns("key string, line int")

    def rows(self, text: str) -> Iterator[tuple]:
        try:
            yield from list(config.json_keys(text))
        except (ValueError, IndexError, RecursionError):
            return


class YamlKeys(_Table):
    """yaml_keys(text): path (joined by ``.``) and line of every leaf; a text that cannot be read has none."""

    analyze = _columns("key string, line int")

    def rows(self, text: str) -> Iterator[tuple]:
        import yaml

        try:
            yield from list(config.yaml_keys(text))
        except (ValueError, RecursionError, yaml.YAMLError):
            return


FUNCTIONS = {"python_scopes": PythonScopes, "env_keys": EnvKeys, "json_leaf_keys": JsonKeys, "yaml_keys": YamlKeys}


def register(spark: SparkSession) -> None:
    """The table functions by name, for ``LATERAL`` in SQL."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, UserDefinedTableFunction(cls, returnType=None, name=name))


def lines_of(files: DataFrame) -> DataFrame:
    """``files`` (its columns but text and module) with a row per line, as ``python_scopes`` gives them."""
    table = UserDefinedTableFunction(PythonScopes, returnType=None, name="python_scopes")
    return files.lateralJoin(table(F.col("text").outer(), F.col("module").outer())).drop("text", "module")


def definitions(lines: DataFrame) -> DataFrame:
    """repo, path, qualified_name, name, line_start, line_end: of ``lines`` (repo, path and the columns of ``python_scopes``)."""
    return lines.where("defines is not null").select("repo", "path", F.col("defines").alias("qualified_name"), "name", F.col("line").alias("line_start"), F.col("ends").alias("line_end"))
