"""Resolution of raw references into edges: an ordered cascade of rules, written as joins.

Every reference ends at the first rule that hits, and some rules end it even when they miss. Each rule therefore adds rows
(ref_id, rank, symbol) and the terminal ones a stop at their rank; what counts is the least rank. Lookups by name:

* ``lookup``: of the symbols with a qualified name, the first of the reference's repository, else the only one there is;
* ``by_name``: of the symbols with a simple name, the repository's only one, else the only one anywhere, else all (of the repository,
  if it has any) as ambiguous; names with too many candidates, or on the stop list, give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeatlas.operators import csharp_rules
from edgeatlas.operators.lookup import lookup
from edgeatlas.schemas import MAX_CANDIDATES, RULES
from edgeatlas.session import cut

# ---- fixed values: names too common to guess at
COMMON = [
    "get", "set", "run", "init", "start", "stop", "close", "open", "read", "write", "update", "delete", "add", "remove", "append", "extend", "pop",
    "push", "send", "call", "execute", "process", "handle", "load", "save", "create", "build", "parse", "format", "render", "validate", "main",
    "setup", "reset", "clear", "copy", "keys", "values", "items", "join", "split", "strip", "replace", "encode", "decode", "emit", "next", "apply",
    "map", "filter", "reduce", "then", "catch", "log", "debug", "info", "warning", "error", "ToString", "Equals", "GetHashCode",
]
CSHARP_COMMON = [
    "ToString", "Equals", "GetHashCode", "Dispose", "Add", "Remove", "Get", "Set", "Execute", "Handle", "Invoke", "Configure", "Map", "Select",
    "Where", "Any", "First", "ToList", "ToListAsync", "SaveChangesAsync",
]
#: Python's built-in names, of version 3.13.
BUILTINS = [
    "ArithmeticError", "AssertionError", "AttributeError", "BaseException", "BaseExceptionGroup", "BlockingIOError", "BrokenPipeError", "BufferError",
    "BytesWarning", "ChildProcessError", "ConnectionAbortedError", "ConnectionError", "ConnectionRefusedError", "ConnectionResetError",
    "DeprecationWarning", "EOFError", "Ellipsis", "EncodingWarning", "EnvironmentError", "Exception", "ExceptionGroup", "False", "FileExistsError",
    "FileNotFoundError", "FloatingPointError", "FutureWarning", "GeneratorExit", "IOError", "ImportError", "ImportWarning", "IndentationError",
    "IndexError", "InterruptedError", "IsADirectoryError", "KeyError", "KeyboardInterrupt", "LookupError", "MemoryError", "ModuleNotFoundError",
    "NameError", "None", "NotADirectoryError", "NotImplemented", "NotImplementedError", "OSError", "OverflowError", "PendingDeprecationWarning",
    "PermissionError", "ProcessLookupError", "PythonFinalizationError", "RecursionError", "ReferenceError", "ResourceWarning", "RuntimeError",
    "RuntimeWarning", "StopAsyncIteration", "StopIteration", "SyntaxError", "SyntaxWarning", "SystemError", "SystemExit", "TabError", "TimeoutError",
    "True", "TypeError", "UnboundLocalError", "UnicodeDecodeError", "UnicodeEncodeError", "UnicodeError", "UnicodeTranslateError", "UnicodeWarning",
    "UserWarning", "ValueError", "Warning", "ZeroDivisionError", "abs", "aiter", "all", "anext", "any", "ascii", "bin", "bool", "breakpoint",
    "bytearray", "bytes", "callable", "chr", "classmethod", "compile", "complex", "copyright", "credits", "delattr", "dict", "dir", "divmod",
    "enumerate", "eval", "exec", "exit", "filter", "float", "format", "frozenset", "getattr", "globals", "hasattr", "hash", "help", "hex", "id",
    "input", "int", "isinstance", "issubclass", "iter", "len", "license", "list", "locals", "map", "max", "memoryview", "min", "next", "object",
    "oct", "open", "ord", "pow", "print", "property", "quit", "range", "repr", "reversed", "round", "set", "setattr", "slice", "sorted",
    "staticmethod", "str", "sum", "super", "tuple", "type", "vars", "zip",
]
# ---- end of fixed values
HOPS = 3


def stoplisted(name: Column, lang: Column) -> Column:
    return name.rlike(r"(?s)\A__.*__\z") | name.isin(*COMMON, *BUILTINS) | ((lang == "csharp") & name.isin(*CSHARP_COMMON))


def by_name(refs: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """ref_id, to_symbol_id, rule, candidates. ``refs``: ref_id, to_name, repo, lang; ``symbols``: symbol_id, name, repo, lang, kind.

    Names over the cap are dropped before the join, from one count per name, so a common name never multiplies.
    """
    s = symbols.where(F.col("kind") != "module")
    s = s.where(F.col("kind").isin(*kinds)) if kinds else s
    few = s.groupBy("lang", "name").agg(F.count("*").alias("total")).where(F.col("total") <= MAX_CANDIDATES)
    s = s.join(few, ["lang", "name"]).select("lang", F.col("name").alias("to_name"), "total", F.col("symbol_id").alias("to_symbol_id"), F.col("repo").alias("to_repo"))
    r = refs.where((F.col("to_name") != "") & ~stoplisted(F.col("to_name"), F.col("lang"))).select("ref_id", "to_name", "repo", "lang")
    j = r.join(s, ["lang", "to_name"]).withColumn("same", F.col("to_repo") == F.col("repo"))
    j = j.withColumn("n_same", F.sum(F.col("same").cast("int")).over(Window.partitionBy("ref_id")))
    rule = F.when(F.col("n_same") == 1, "repo_unique").when((F.col("n_same") == 0) & (F.col("total") == 1), "cross_repo_unique").otherwise("ambiguous")
    kept = j.where((F.col("n_same") == 0) | F.col("same"))
    return kept.select("ref_id", "to_symbol_id", rule.alias("rule"), F.when(F.col("n_same") > 0, F.col("n_same")).otherwise(F.col("total")).cast("int").alias("candidates"))


class Facts:
    """The fact tables, denormalised: symbols, refs (with their source symbol) and imports carry repo, lang, module and file."""

    def __init__(self, tables: dict[str, DataFrame]):
        repos = tables["repos"].select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
        repos = F.broadcast(repos) if _small(repos) else repos
        self.files = tables["files"].join(repos, "repo_id").select(F.col("id").alias("file_id"), "repo", "lang", "module", F.col("path").alias("file_path"))
        f = self.files
        self.symbols = cut(tables["symbols"].withColumnRenamed("id", "symbol_id").join(f, "file_id"), "symbols")
        self.in_file = self.symbols.groupBy("file_id", "qualified_name").agg(F.max_by(F.struct("symbol_id", "kind"), "symbol_id").alias("s")).select("file_id", "qualified_name", "s.symbol_id", "s.kind")
        self.imports = tables["imports"].join(f, "file_id")
        self.import_map = self.imports.where("local_name <> '*'").groupBy("file_id", "local_name").agg(F.max_by("target", "id").alias("target"))
        src = self.in_file.select("file_id", F.col("qualified_name").alias("from_qualified"), F.col("symbol_id").alias("from_symbol_id"), F.col("kind").alias("from_kind"))
        r = tables["refs"].withColumnRenamed("id", "ref_id").join(f, "file_id")
        self.curated = r.where("kind = 'curated'")
        self.refs = cut(r.where("kind <> 'curated'").join(src, ["file_id", "from_qualified"]), "refs")
        self.handlers = tables["queue_handlers"].join(f, "file_id")
        self.consts = tables["string_consts"].join(f, "file_id")


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def _first_star(facts: Facts, starred: DataFrame, keys: list[str]) -> DataFrame:
    """``starred`` (keys, name, repo, lang, id, target: the star imports of one file a row) with the first target that has ``name``, else the first."""
    defined = lookup(starred.select(*keys, "id", F.concat_ws(".", "target", "name").alias("qualified"), "repo", "lang"), facts.symbols, [*keys, "id"])
    j = starred.join(defined.select(*keys, "id", F.lit(True).alias("defines")), [*keys, "id"], "left")
    return j.groupBy(*keys).agg(F.min_by("target", F.struct(F.col("defines").isNull(), "id")).alias("target"))


def follow(facts: Facts, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``lookup``, and for what it misses up to ``HOPS`` re-exports: the deepest module prefix whose file imports the next part, or stars.

    Where the reference's repository has a module, only its files may re-export from it; else the first file of any repository that does. Files
    go by their ids, and a file's imports by name come before its star imports.
    """
    modules = facts.files.where("module is not null and lang = 'python'").select("module", "file_id", "repo")
    named = facts.import_map.join(modules, "file_id").select("repo", "module", "file_id", F.col("local_name").alias("part"), "target")
    starred = facts.imports.where("local_name = '*' and lang = 'python' and module is not null").groupBy("repo", "module", "file_id").agg(F.collect_list(F.struct("id", "target")).alias("stars"))
    least = lambda df, by, value: df.groupBy(*by).agg(F.min("file_id").alias("file_id"), F.min_by(value, "file_id").alias(value))
    # per repository and over all: one row a name, one file's star imports a module, whatever the number of repositories
    tables = [(["repo", "module"], least(named, ["repo", "module", "part"], "target"), least(starred, ["repo", "module"], "stars")), (["module"], least(named, ["module", "part"], "target"), least(starred, ["module"], "stars"))]
    has = modules.select("repo", "module").distinct().withColumn("has", F.lit(True))
    found = None
    at = wanted
    for hop in range(HOPS + 1):
        hit = cut(lookup(at, facts.symbols, keys).drop("to_file"), "lookup")
        found = hit if found is None else found.unionByName(hit)
        if hop == HOPS:
            break
        missed = at.join(hit.select(*keys), keys, "left_anti")
        parts = F.split("qualified", r"\.")
        cutting = missed.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts) - 1))).where(F.size(parts) > 1)
        cutting = cutting.withColumn("module", F.array_join(F.slice(parts, 1, F.col("k")), ".")).withColumn("part", F.get(parts, F.col("k"))).withColumn("rest", F.array_join(F.slice(parts, F.col("k") + 2, F.size(parts)), "."))
        cutting = cut(cutting.join(has, ["repo", "module"], "left").drop("qualified"), "prefixes")
        onward = lambda base: F.concat_ws(".", base, F.when(F.col("rest") != "", F.col("rest")))
        ways = []
        for (by, names, stars), mine in zip(tables, (cutting.where("has"), cutting.where("has is null")), strict=True):
            ways.append(mine.join(names, [*by, "part"]).select(*keys, "repo", "lang", "k", "file_id", F.lit(0).alias("star"), onward(F.col("target")).alias("next")))
            s = mine.where(~F.col("part").startswith("_")).join(stars, by)
            first = _first_star(facts, s.select(*keys, "k", F.col("part").alias("name"), "repo", "lang", F.inline("stars")), [*keys, "k"])
            ways.append(s.join(first, [*keys, "k"]).select(*keys, "repo", "lang", "k", "file_id", F.lit(1).alias("star"), onward(F.concat_ws(".", "target", "part")).alias("next")))
        all_ = ways[0].unionByName(ways[1]).unionByName(ways[2]).unionByName(ways[3])
        best = all_.groupBy(*keys, "repo", "lang").agg(F.min_by("next", F.struct(-F.col("k"), "file_id", "star")).alias("qualified"))
        at = cut(best, "hops")
        if at.isEmpty():
            break
    return found


def python_edges(facts: Facts) -> DataFrame:
    """ref_id, to_symbol_id, rule, candidates for Python calls, bases and imports."""
    r = facts.refs.where("lang = 'python'")
    # what imports name, what imported heads stand for, what star imports may give: followed together
    imported = r.where("kind = 'import'").select("ref_id", F.lit("import").alias("how"), F.col("to_name").alias("qualified"), "repo", "lang")
    calls = r.where(F.col("kind").isin("call", "inherit", "queue_actor")).withColumn("parts", F.split("to_name", r"\."))
    calls = calls.withColumns({"head": F.get("parts", F.lit(0)), "last": F.element_at("parts", -1), "rest": F.array_join(F.slice("parts", 2, 1_000_000), ".")})
    own = F.col("head").isin("self", "cls") & (F.size("parts") > 1)
    opaque = F.col("head") == "?"
    plain = ~own & ~opaque
    # same file: the owner's member, or the name under the source, or under the module
    owner = F.regexp_extract("from_qualified", r"(?s)\A(.*)\.[^.]+\z", 1)
    tries = F.when(own, F.when((F.col("from_kind") == "method") & (F.size("parts") == 2), F.array(F.concat_ws(".", owner, "rest"))).otherwise(F.array().cast("array<string>"))).when(plain, F.array(F.concat_ws(".", "from_qualified", "to_name"), F.concat_ws(".", "module", "to_name"))).otherwise(F.array().cast("array<string>"))
    near = calls.select("ref_id", "file_id", F.posexplode(tries).alias("at", "qualified_name")).join(facts.in_file, ["file_id", "qualified_name"])
    near = near.select("ref_id", F.col("at").alias("rank"), F.col("symbol_id").alias("to_symbol_id"), F.lit("same_file").alias("rule"), F.lit(1).alias("candidates"))
    # the head is imported: what it stands for, and no guess after that
    bound = calls.where(plain).join(facts.import_map.withColumnRenamed("local_name", "head"), ["file_id", "head"])
    bound = bound.select("ref_id", F.lit("bound").alias("how"), F.concat_ws(".", "target", F.when(F.col("rest") != "", F.col("rest"))).alias("qualified"), "repo", "lang")
    stop = bound.select("ref_id", F.lit(3).alias("rank"), F.lit(None).cast("long").alias("to_symbol_id"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("candidates"))
    # star imports of the file: the first that defines the name, else the first
    st = calls.where(plain & ~F.col("head").startswith("_")).join(facts.imports.where("local_name = '*'").select("file_id", "id", "target"), "file_id")
    first = _first_star(facts, st.select("ref_id", F.col("head").alias("name"), "repo", "lang", "id", "target"), ["ref_id"])
    starred = calls.join(first, "ref_id").select("ref_id", F.lit("star").alias("how"), F.concat_ws(".", "target", "to_name").alias("qualified"), "repo", "lang")
    followed = follow(facts, imported.unionByName(bound).unionByName(starred), ["ref_id", "how"])
    rank = F.when(F.col("how") == "bound", 2).otherwise(4)
    scoped = followed.where("how <> 'import'").select("ref_id", rank.alias("rank"), "to_symbol_id", F.lit("import_scope").alias("rule"), F.lit(1).alias("candidates"))
    guess = by_name(calls.select("ref_id", F.col("last").alias("to_name"), "repo", "lang"), facts.symbols).select("ref_id", F.lit(5).alias("rank"), "to_symbol_id", "rule", "candidates")
    rows = near.unionByName(scoped).unionByName(stop).unionByName(guess)
    best = rows.withColumn("least", F.min("rank").over(Window.partitionBy("ref_id"))).where("rank = least and to_symbol_id is not null").drop("rank", "least")
    return best.unionByName(followed.where("how = 'import'").select("ref_id", "to_symbol_id", F.lit("import_scope").alias("rule"), F.lit(1).alias("candidates")))


def queue_edges(facts: Facts, actors: DataFrame, constants: DataFrame) -> DataFrame:
    """Jobs sent to handlers by name, by a constant's digest, or by a receiver that resolves to a handler."""
    from edgeatlas.functions.names import name_digest

    h = facts.handlers.join(facts.in_file.select("file_id", F.col("qualified_name").alias("handler_qualified"), F.col("symbol_id").alias("to_symbol_id")), ["file_id", "handler_qualified"])
    h = h.select(F.col("name").alias("job"), name_digest(F.col("name")).alias("value"), "to_symbol_id").distinct()
    named = facts.refs.where("kind = 'queue'").select("ref_id", F.col("to_name").alias("job")).join(h, "job").select("ref_id", "to_symbol_id")
    const = constants.join(h, "value").select("ref_id", "to_symbol_id")
    direct = actors.join(h.select("to_symbol_id").distinct(), "to_symbol_id", "left_semi").select("ref_id", "to_symbol_id")
    all_ = named.unionByName(const).unionByName(direct).distinct()
    n = F.count("*").over(Window.partitionBy("ref_id"))
    return all_.withColumn("candidates", n.cast("int")).select("ref_id", "to_symbol_id", F.when(F.col("candidates") == 1, "queue_match").otherwise("ambiguous").alias("rule"), "candidates")


def curated_edges(facts: Facts) -> DataFrame:
    """ref_id, from_symbol_id, to_symbol_id for declared links: both ends must each mean one symbol group."""
    both = F.explode(F.array("qualified_name", F.concat_ws(":", "repo", "qualified_name")))
    s = facts.symbols.select("repo", "qualified_name", "kind", "symbol_id", both.alias("text"))

    def end(column: str, out: str) -> DataFrame:
        want = facts.curated.select("ref_id", F.col(column).alias("text"))
        j = want.join(s, "text")
        w = Window.partitionBy("ref_id")
        j = j.withColumn("other", F.max((F.col("kind") != "module").cast("int")).over(w)).where((F.col("other") == 0) | (F.col("kind") != "module"))
        g = j.groupBy("ref_id").agg(F.count_distinct("repo", "qualified_name", "kind").alias("n"), F.min("symbol_id").alias(out))
        return g.where("n = 1").select("ref_id", out)

    return end("from_qualified", "from_symbol_id").join(end("to_name", "to_symbol_id"), "ref_id")


def resolve(tables: dict[str, DataFrame]) -> DataFrame:
    """All edges: id, ref_id, from_symbol_id, to_symbol_id, kind, rule, confidence, candidates."""
    facts = Facts(tables)
    spark = facts.refs.sparkSession
    py = cut(python_edges(facts), "python")
    cs, constants = csharp_rules.csharp_edges(facts, by_name)
    kinds = facts.refs.select("ref_id", "kind", "lang", "from_symbol_id")
    both = py.unionByName(cs)
    actors = both.join(kinds.where("kind = 'queue_actor'"), "ref_id")
    plain = both.join(kinds.where("kind <> 'queue_actor'").select("ref_id"), "ref_id", "left_semi")
    edges = plain.unionByName(queue_edges(facts, actors, constants)).join(kinds, "ref_id")
    first = csharp_rules.first_declarations(facts)
    edges = edges.join(first, F.col("from_symbol_id") == F.col("d_id"), "left").withColumn("from_symbol_id", F.coalesce("d_first", "from_symbol_id")).drop("d_id", "d_first")
    target = facts.symbols.select(F.col("symbol_id").alias("to_symbol_id"), F.col("kind").alias("to_kind"))
    edges = edges.join(target, "to_symbol_id")
    call = F.when(F.col("kind").startswith("queue"), "call").when((F.col("kind") == "call") & (F.col("to_kind") == "class"), "instantiate").otherwise(F.col("kind"))
    edges = edges.select("ref_id", "from_symbol_id", "to_symbol_id", call.alias("kind"), "rule", "candidates")
    declared = curated_edges(facts).select("ref_id", "from_symbol_id", "to_symbol_id", F.lit("call").alias("kind"), F.lit("curated").alias("rule"), F.lit(1).alias("candidates"))
    rules = F.broadcast(spark.createDataFrame([(k, c) for k, (c, _) in RULES.items()], "rule string, confidence double"))
    out = edges.unionByName(declared).distinct().join(rules, "rule")
    return out.select(F.xxhash64("ref_id", "to_symbol_id", "rule").alias("id"), "ref_id", "from_symbol_id", "to_symbol_id", "kind", "rule", "confidence", "candidates")
