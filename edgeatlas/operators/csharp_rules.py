"""C# references: types by alias, nesting, namespace and using; members through base types; then by name.

A type name becomes a list of qualified names with a priority each, joined once; the least priority that exists decides. Base types are
resolved first; a member is looked for in the type, then in its bases, at most three steps away.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeatlas.operators.lookup import lookup
from edgeatlas.session import cut

TYPES = ("class", "interface")
STEPS = 3


def first_declarations(facts) -> DataFrame:
    """d_id, d_first: a C# symbol and the first declaration of its group in the repository."""
    s = facts.symbols.where("lang = 'csharp'")
    w = Window.partitionBy("repo", "qualified_name", "kind")
    return s.select(F.col("symbol_id").alias("d_id"), F.min("symbol_id").over(w).alias("d_first"))


def _chain(text: Column) -> Column:
    """a.b.c, a.b, a: a dotted name and what encloses it; nothing for an empty one."""
    parts = F.split(text, r"\.")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), ".")))


def _usings(facts) -> tuple[DataFrame, DataFrame]:
    """(file_id, alias, target) and (file_id, namespace, static): of the file, and global ones of its repository."""
    i = facts.imports.where("lang = 'csharp'")
    files = facts.files.where("lang = 'csharp'").select("file_id", "repo")
    own = i.where(~F.col("local_name").startswith("*global")).select("file_id", "local_name", "target")
    shared = i.where(F.col("local_name").startswith("*global")).select("repo", F.regexp_replace(F.regexp_replace("local_name", r"^\*global=", ""), r"^\*global(-static)?$", "*$1").alias("local_name"), "target").join(files, "repo").select("file_id", "local_name", "target")
    shared = shared.withColumn("local_name", F.when(F.col("local_name") == "*-static", "*static").otherwise(F.col("local_name")))
    all_ = own.unionByName(shared).distinct()
    alias = all_.where(~F.col("local_name").startswith("*")).groupBy("file_id", F.col("local_name").alias("alias")).agg(F.max("target").alias("target"))
    return alias, all_.where(F.col("local_name").isin("*", "*static")).select("file_id", (F.col("local_name") == "*static").alias("static"), F.col("target").alias("namespace"))


def resolve_types(facts, wanted: DataFrame) -> DataFrame:
    """key, type, to_symbol_id, rule: the types that a name means where it stands. ``wanted``: key, file_id, repo, name, enclosing (type or null)."""
    alias, using = _usings(facts)
    head = F.regexp_extract("name", r"\A([^.]+)", 1)
    rest = F.regexp_extract("name", r"\A[^.]+(\..*)?\z", 1)
    w = wanted.withColumns({"head": head, "tail": rest})
    w = w.join(alias.withColumnRenamed("alias", "head"), ["file_id", "head"], "left")
    aliased = w.where("target is not null").select("key", "file_id", "repo", F.lit(0).alias("priority"), F.lit(False).alias("by_using"), F.concat("target", "tail").alias("type"))
    stop = w.where("target is not null").select("key", F.lit(1).alias("priority"))
    w = w.where("target is null")
    # nested in the enclosing types, then in the namespaces around, then on its own: one outward walk
    outward = F.concat(F.transform(_chain(F.coalesce("enclosing", F.lit(""))), lambda e: F.concat(e, F.lit("."), F.col("name"))), F.array("name"))
    walk = w.select("key", "file_id", "repo", F.posexplode(outward).alias("at", "type")).select("key", "file_id", "repo", (F.col("at") + 2).alias("priority"), F.lit(False).alias("by_using"), "type")
    used = w.join(using.where(~F.col("static")), "file_id").select("key", "file_id", "repo", F.lit(1000).alias("priority"), F.lit(True).alias("by_using"), F.concat_ws(".", "namespace", "name").alias("type"))
    asked = aliased.unionByName(walk).unionByName(used).withColumns({"qualified": F.col("type"), "lang": F.lit("csharp")})
    hits = lookup(asked, facts.symbols, ["key", "file_id", "priority", "by_using", "type"], TYPES)
    hits = hits.select("key", "priority", "type", "to_symbol_id", (F.col("to_file") == F.col("file_id")).alias("here"), "by_using")
    all_ = hits.unionByName(stop.withColumns({"here": F.lit(False), "by_using": F.lit(False)}), allowMissingColumns=True)
    best = all_.withColumn("least", F.min("priority").over(Window.partitionBy("key"))).where("priority = least and type is not null").dropDuplicates(["key", "type"])
    n = F.count("*").over(Window.partitionBy("key"))
    rule = F.when(n > 1, "ambiguous").when(F.col("here"), "same_file").when(F.col("by_using") | (F.col("priority") == 0), "import_scope").otherwise("same_namespace")
    return best.select("key", "type", "to_symbol_id", rule.alias("rule"))


def bases_closure(direct: DataFrame) -> DataFrame:
    """type, base, steps: every type with itself (0) and its bases up to ``STEPS`` away, the shortest way."""
    d = direct.distinct()
    out = d.select("type", "base", F.lit(1).alias("steps"))
    at = out
    for k in range(2, STEPS + 1):
        at = at.select("type", F.col("base").alias("mid")).join(d.select(F.col("type").alias("mid"), "base"), "mid").select("type", "base", F.lit(k).alias("steps"))
        out = out.unionByName(at)
    return out.groupBy("type", "base").agg(F.min("steps").alias("steps"))


def members(facts, wanted: DataFrame, closure: DataFrame) -> DataFrame:
    """key, to_symbol_id: the member ``member`` of ``type``, or of the nearest bases that have it. ``wanted``: key, type, member, repo, own (0: bases only)."""
    near = wanted.where("own").select("key", "member", "repo", F.col("type").alias("base"), F.lit(0).alias("steps")).unionByName(wanted.join(closure, "type").where("base <> type").select("key", "member", "repo", "base", "steps"))
    asked = near.withColumns({"qualified": F.concat_ws(".", "base", "member"), "lang": F.lit("csharp")})
    per = lookup(asked, facts.symbols, ["key", "steps"], ("method",))
    return per.withColumn("least", F.min("steps").over(Window.partitionBy("key"))).where("steps = least").select("key", "to_symbol_id").distinct()


def csharp_edges(facts, by_name: Callable) -> tuple[DataFrame, DataFrame]:
    """(ref_id, to_symbol_id, rule, candidates) and, for jobs sent by a constant, (ref_id, value)."""
    r = facts.refs.where("lang = 'csharp'")
    owner = F.when(F.col("from_kind").isin(*TYPES), F.col("from_qualified")).when(F.col("from_kind") == "method", F.regexp_extract("from_qualified", r"(?s)\A(.*)\.[^.]+\z", 1))
    r = r.withColumn("enclosing", F.coalesce(owner, F.when(F.col("from_kind") == "module", F.col("from_qualified"))))
    s = facts.symbols

    def types_of(refs: DataFrame, enclosing: Column) -> DataFrame:
        return resolve_types(facts, refs.select(F.col("ref_id").alias("key"), "file_id", "repo", F.col("to_name").alias("name"), enclosing.alias("enclosing"))).withColumnRenamed("key", "ref_id")

    def count(df: DataFrame, rank: int) -> DataFrame:
        return df.select("ref_id", F.lit(rank).alias("rank"), "to_symbol_id", "rule", F.count("*").over(Window.partitionBy("ref_id")).cast("int").alias("candidates"))

    outer = F.regexp_extract("from_qualified", r"(?s)\A(.*)\.[^.]+\z", 1)
    inherit = cut(types_of(r.where("kind = 'inherit'"), outer), "bases")
    closure = cut(bases_closure(r.select("ref_id", F.col("from_qualified").alias("type")).join(inherit.select("ref_id", F.col("type").alias("base")), "ref_id").select("type", "base")), "closure")
    made = types_of(r.where("kind = 'instantiate'"), F.col("enclosing"))
    rows = [count(x, 0) for x in (inherit, made)]
    guess_types = by_name(r.where(F.col("kind").isin("inherit", "instantiate")).select("ref_id", F.element_at(F.split("to_name", r"\."), -1).alias("to_name"), "repo", "lang"), s, TYPES)
    rows.append(guess_types.select("ref_id", F.lit(9).alias("rank"), "to_symbol_id", "rule", "candidates"))

    calls = r.where("kind = 'call'").withColumn("parts", F.split("to_name", r"\.")).withColumn("last", F.element_at("parts", -1))
    typed = calls.where("receiver_type is not null and receiver_type <> ''")
    untyped = calls.where("receiver_type is null or receiver_type = ''")
    head = F.get("parts", F.lit(0))
    # a receiver of declared type
    t = resolve_types(facts, typed.select(F.col("ref_id").alias("key"), "file_id", "repo", F.col("receiver_type").alias("name"), "enclosing"))
    want = typed.select("ref_id", "repo", F.col("last").alias("member")).join(t.select(F.col("key").alias("ref_id"), "type"), "ref_id")
    m = members(facts, want.select(F.col("ref_id").alias("key"), "type", "member", "repo", F.lit(True).alias("own")), closure).withColumnRenamed("key", "ref_id")
    several = F.count("*").over(Window.partitionBy("ref_id")) > 1
    rows.append(count(m.withColumn("rule", F.when(several, "ambiguous").otherwise("declared_type")), 0))
    # this., base. and bare calls: the enclosing type, outward for bare ones
    self_ = untyped.where((F.size("parts") == 2) & head.isin("this", "base"))
    bare = untyped.where(F.size("parts") == 1)
    around = self_.select("ref_id", "repo", F.col("last").alias("member"), F.col("enclosing").alias("type"), (head == "this").alias("own"), F.lit(0).alias("out"), "file_id").unionByName(
        bare.select("ref_id", "repo", F.col("last").alias("member"), F.posexplode(_chain(F.coalesce("enclosing", F.lit("")))).alias("out", "type"), F.lit(True).alias("own"), "file_id").select("ref_id", "repo", "member", "type", "own", "out", "file_id")
    )
    m = members(facts, around.select(F.struct("ref_id", "out", "file_id").alias("key"), "type", "member", "repo", "own"), closure)
    m = m.select("key.*", "to_symbol_id").withColumn("least", F.min("out").over(Window.partitionBy("ref_id"))).where("out = least")
    where = s.select(F.col("symbol_id").alias("to_symbol_id"), F.col("file_id").alias("to_file"))
    m = m.join(where, "to_symbol_id").withColumn("rule", F.when(F.count("*").over(Window.partitionBy("ref_id")) > 1, "ambiguous").when(F.col("file_id") == F.col("to_file"), "same_file").otherwise("declared_type"))
    rows.append(count(m, 0))
    # methods of types used statically
    _, using = _usings(facts)
    static = bare.join(using.where("static"), "file_id").select(F.col("ref_id").alias("key"), F.col("namespace").alias("type"), F.col("last").alias("member"), "repo", F.lit(True).alias("own"))
    m = members(facts, static, closure).withColumnRenamed("key", "ref_id").withColumn("rule", F.when(several, "ambiguous").otherwise("import_scope"))
    rows.append(count(m, 2))
    # A.B.Foo: the longest prefix that is a type; all but the last part ends the search, hit or miss
    dotted = untyped.where((F.size("parts") > 1) & ~head.isin("this", "base", "?"))
    pre = dotted.select("ref_id", "file_id", "repo", "enclosing", "parts", "last", F.explode(F.sequence(F.size("parts") - 1, F.lit(1), F.lit(-1))).alias("k")).withColumn("name", F.array_join(F.slice("parts", 1, F.col("k")), "."))
    t = resolve_types(facts, pre.select(F.struct("ref_id", "k").alias("key"), "file_id", "repo", "name", "enclosing")).select("key.ref_id", "key.k", "type", "rule")
    t = t.withColumn("most", F.max("k").over(Window.partitionBy("ref_id"))).where("k = most").join(dotted.select("ref_id", "repo", "last", F.size("parts").alias("n")), "ref_id")
    whole = cut(t.where("k = n - 1"), "static")
    m = members(facts, whole.select(F.struct("ref_id", "rule").alias("key"), "type", F.col("last").alias("member"), "repo", F.lit(True).alias("own")), closure).select("key.ref_id", "key.rule", "to_symbol_id")
    rows.append(count(m.withColumn("rule", F.when(several, "ambiguous").otherwise(F.col("rule"))), 0))
    rows.append(whole.select("ref_id").distinct().select("ref_id", F.lit(5).alias("rank"), F.lit(None).cast("long").alias("to_symbol_id"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("candidates")))
    guess = by_name(calls.select("ref_id", F.col("last").alias("to_name"), "repo", "lang"), s, ("method",))
    rows.append(guess.select("ref_id", F.lit(9).alias("rank"), "to_symbol_id", "rule", "candidates"))

    all_ = rows[0]
    for x in rows[1:]:
        all_ = all_.unionByName(x)
    best = all_.withColumn("least", F.min("rank").over(Window.partitionBy("ref_id"))).where("rank = least and to_symbol_id is not null").drop("rank", "least")

    sent = r.where("kind = 'queue_const'").withColumn("member", F.element_at(F.split("to_name", r"\."), -1)).withColumn("holder", F.regexp_extract("to_name", r"(?s)\A(.*)\.[^.]+\z", 1))
    t = resolve_types(facts, sent.where("holder <> ''").select(F.col("ref_id").alias("key"), "file_id", "repo", F.col("holder").alias("name"), "enclosing")).select(F.col("key").alias("ref_id"), "type", "to_symbol_id")
    # the constant of the type's own repository
    of_type = facts.symbols.select(F.col("symbol_id").alias("to_symbol_id"), F.col("repo").alias("c_repo"))
    values = facts.consts.groupBy(F.col("repo").alias("c_repo"), "qualified_name").agg(F.min_by("value", "id").alias("value"))
    constants = sent.join(t, "ref_id").join(of_type, "to_symbol_id").withColumn("qualified_name", F.concat_ws(".", "type", "member")).join(values, ["c_repo", "qualified_name"]).select("ref_id", "value").distinct()
    return cut(best, "csharp"), constants
