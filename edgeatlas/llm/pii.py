"""Personal data: strict base spans, and further spans chosen by boosted trees. DataFrame expressions only.

Positions come from one pattern twice: the matches, and the pieces between them, whose lengths in code points add up to every
match's start. The patterns are written so that no text makes them backtrack far: runs are possessive, and a failed run is not
tried again from its middle, which changes no match.

Loose generators propose spans that the strict kinds miss: numbers and phones glued to neighbours, written-out addresses, secrets. The
trees see a span's format and what stands before it. They learn from candidates that equal a strict span, are a strict address written
out, or a secret after an assignment, against the generators' other candidates, in all documents: candidates alike in fold, kind, features and label are
counted, and trees and thresholds come from sums over all counts, whatever their number: a Spark job for each level of the trees where there are many,
which gives the same trees. Each kind's threshold is the least that holds the precision on held-out documents.

Work is linear in a text's length and nearly so in its matches (their number over ``PIECE``, squared, is copied, too): no fold carries more than a piece.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeatlas.llm import boosting
from edgeatlas.llm.session import cut, free

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators; a kind's candidates may overlap others and the base.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20dot\x20)[A-Za-z]{2,}+",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}(?:[\x20-][0-9]{3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|(?<![0-9])[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{24,200}+(?![A-Za-z0-9_/+=-])",
}
#: What a text must hold for a pattern to match at all, cheaper to look for than the pattern.
_WRITTEN = r"(?:[\[(](?:at|AT)[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20dot\x20)[A-Za-z]{2}"
GUARD = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
}
LOOSE_GUARD = {
    "email": lambda t: t.rlike(_WRITTEN),
    "ip": GUARD["ip"],
    "card": lambda t: t.rlike(r"[0-9]{4}[\x20-]?[0-9]{4}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9_/+-]{24}"),
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|auth)[a-z_-]*[\"']?\s{0,3}[:=]\s{0,3}[\"']?$"
#: What tells a written-out address from a place: the dot is a word, too.
WRITTEN_OUT = r"(?:[\[(](?:dot|DOT)[\])]|\x20dot\x20)"
#: Distinct examples up to which the driver takes their sums itself; beyond it Spark does, over all of them alike. Precision asked for on held-out ones.
SAMPLE_SPANS, PRECISION = 50_000, 0.9
#: Features, for fitting and for scoring alike: exact up to the first, then rounded down to multiples of the second, and at most the third.
EXACT, STEP, MOST = 16, 8, 256
VALUES = np.array([*range(EXACT + 2), *range(EXACT + STEP, MOST + 1, STEP)])
#: A span: start, end, text, and what stands before and after it.
SPAN = "struct<s:int,e:int,m:string,b:string,a:string>"
#: Elements that one fold of ``scan`` gathers.
PIECE = 64


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether a text's digits pass the check digit."""
    d = F.transform(F.split(F.reverse(digits(m)), ""), lambda c: c.try_cast("int"))
    weighed = F.transform(d, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(weighed, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda m: F.length(digits(m)).between(14, 19) & luhn(m),
    "phone": lambda m: F.length(digits(m)).between(10, 15),
}


def scan(items: Column, state: Column, step, kind: str) -> Column:
    """An array of ``kind``: ``step(state, item, index)`` gives the next state and an element.

    A fold copies its whole accumulator at every step, so none holds more than one piece: the first pass folds states alone and notes the one
    that each piece of ``PIECE`` items starts from, the second folds each piece by itself.
    """
    none, n = F.array().cast(f"array<{kind}>"), F.size(items)
    upto = lambda c: F.sequence(c, F.least(c + F.lit(PIECE - 1), n - 1))
    noted = lambda at, seen: F.struct(at.alias("at"), seen.alias("seen"))
    begin = lambda c, at: F.struct(c.alias("c"), at.alias("at"))
    pack = lambda at, cur: F.struct(at.alias("at"), cur.alias("cur"))

    def note(acc, c):
        after = F.aggregate(upto(c), acc["at"], lambda at, i: step(at, F.get(items, i), i)[0])
        return noted(after, F.array_append(acc["seen"], begin(c, acc["at"])))

    def one(acc, i):
        at, out = step(acc["at"], F.get(items, i), i)
        return pack(at, F.array_append(acc["cur"], out))

    empty = F.slice(F.array(begin(F.lit(0), state)), 1, 0)
    starts = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(PIECE)), noted(state, empty), note, lambda a: a["seen"])
    done = F.flatten(F.transform(starts, lambda x: F.aggregate(upto(x["c"]), pack(x["at"], none), one, lambda a: a["cur"])))
    return F.when(n > 0, done).otherwise(none)


def _spans(df: DataFrame, name: str, text: str, pattern: str, guard) -> DataFrame:
    """Add ``name``: the pattern's matches with start and end in code points."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_m", F.when(guard(t), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
    m = F.col(f"{name}_m")
    df = df.withColumn(f"{name}_p", F.when(F.size(m) > 0, F.split(t, pattern, -1)).otherwise(none))
    p = F.col(f"{name}_p")

    def step(at, found, i):
        s = at + F.length(F.get(p, i))
        e = s + F.length(found)
        before = F.right(F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(p, i)), F.lit(24))
        return e, F.struct(s.alias("s"), e.alias("e"), found.alias("m"), before.alias("b"), F.left(F.get(p, i + 1), F.lit(1)).alias("a"))

    return df.withColumn(name, F.when((F.size(m) > 0) & (F.size(p) > 0), scan(m, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))).drop(f"{name}_m", f"{name}_p")


FEATURES = ("length", "digits", "letters", "others", "luhn", "octets", "word_before", "word_after", "assigned", "plus", "hex", "distinct", "written")


def _features(c: Column) -> list[Column]:
    m, before, after = c["m"], c["b"], c["a"]
    n, d, a = F.length(m), F.length(digits(m)), F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    flag = lambda x: x.cast("int")
    f = [
        n, d, a, n - d - a, flag(luhn(m)), flag(m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")), flag(before.rlike(r"[\p{L}0-9._@-]$")), flag(after.rlike(r"[\p{L}0-9_@]")),
        flag(before.rlike(ASSIGNED)), flag(m.startswith("+")), flag(m.rlike("^[0-9a-fA-F]+$")), F.size(F.array_distinct(F.split(m, ""))), flag(m.rlike(WRITTEN_OUT)),
    ]
    rounded = lambda v: F.when(v > EXACT, F.least(F.greatest(F.lit(EXACT + 1), v - v % STEP), F.lit(MOST))).otherwise(v)
    return [F.coalesce(rounded(x), F.lit(0)).cast("double") for x in f]


def with_base(docs: DataFrame, text: str, tag: str = "__", raw: bool = False) -> DataFrame:
    """Add ``<tag>base_<kind>`` for the four strict kinds; with ``raw`` also ``<tag>raw_<kind>``, matches that failed included."""
    for kind, pattern in BASE.items():
        name = f"{tag}base_{kind}"
        docs = _spans(docs, name, text, pattern, GUARD[kind])
        valid = VALID[kind]
        docs = docs.withColumn(f"{tag}raw_{kind}", F.col(name)) if raw else docs
        docs = docs.withColumn(name, F.filter(name, lambda x: valid(x["m"])))  # noqa: B023
    return docs


def with_candidates(docs: DataFrame, text: str, tag: str = "__", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Add ``<tag>cand``: the generators' spans with kind and features, those that equal a strict span of their kind included."""
    every = [F.array().cast("array<struct<k:int,s:int,e:int,f:array<double>>>")]
    for k, (kind, pattern) in enumerate(LOOSE.items()):
        if kind in kinds:
            docs = _spans(docs, f"{tag}loose_{kind}", text, pattern, LOOSE_GUARD[kind])
            every.append(F.transform(f"{tag}loose_{kind}", lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.array(*_features(x)).alias("f"))))  # noqa: B023
    return docs.withColumn(f"{tag}cand", F.concat(*every)).drop(*[f"{tag}loose_{k}" for k in LOOSE])


class Model:
    """Trees and a threshold for each kind."""

    def __init__(self, trees: list[boosting.Boosted], cuts: list[float]):
        self.trees, self.cuts = trees, cuts

    def kinds(self) -> tuple[str, ...]:
        """Kinds that can add spans; the other generators need not run."""
        return tuple(kind for kind, cut in zip(KINDS, self.cuts, strict=True) if cut <= 1)

    def score(self, c: Column) -> Column:
        """A candidate's score less its kind's threshold, at least 0 where it is chosen."""
        out = F.lit(-1.0)
        f = [c["f"][i] for i in range(len(FEATURES))]
        for k, (tree, cut) in enumerate(zip(self.trees, self.cuts, strict=True)):
            if cut <= 1:
                out = F.when(c["k"] == k, tree.column(f) - F.lit(cut)).otherwise(out)
        return out


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Fit on the candidates of all documents; a text's copies count as often as they occur, and under one key fall into one fold."""
    t = F.col("__text")
    some = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).select(F.xxhash64("key", "__text").alias("h"), "__text")
    # strict addresses written out in two ways: examples for the written-out ones, of which a text's own are left out
    word = F.when(F.col("h") % 2 == 0, F.lit(r"$1 at $2 dot $3")).otherwise(F.lit(r"$1 [at] $2 [dot] $3"))
    written = F.regexp_replace(t, F.lit(r"(?:\G|(?<![A-Za-z0-9._%+-]))([A-Za-z0-9._%+-]++)@([A-Za-z0-9-]++)\.([A-Za-z]{2,})(?![A-Za-z0-9.-])"), word)
    way = lambda out, x: F.struct(F.lit(out).alias("out"), x.alias("t"))
    some = some.select("h", F.explode(F.when(t.contains("@"), F.array(way(False, t), way(True, written))).otherwise(F.array(way(False, t)))).alias("w")).select("h", "w.out", F.col("w.t").alias("__text"))
    d = with_candidates(with_base(some, "__text", raw=True), "__text")
    told = F.col("c.f")[FEATURES.index("written")] == 1
    same = F.lit(False)
    glued = F.lit(False)  # part of a longer match: neither an example for nor against
    for k, kind in enumerate(KINDS):
        hit = F.col("c.f")[FEATURES.index("assigned")] == 1 if kind == "secret" else told if kind == "email" else F.exists(f"__base_{kind}", lambda b: (b["s"] == F.col("c.s")) & (b["e"] == F.col("c.e")))
        same = F.when(F.col("c.k") == k, hit).otherwise(same)
        if kind != "secret":
            part = F.exists(f"__raw_{kind}", lambda b: (b["s"] <= F.col("c.s")) & (b["e"] >= F.col("c.e")) & (b["e"] - b["s"] > F.col("c.e") - F.col("c.s")))
            glued = F.when(F.col("c.k") == k, part).otherwise(glued)
    spans = d.select("h", F.pmod("h", F.lit(3)).alias("fold"), F.explode("__cand").alias("c"), "out", *[f"__{x}_{k}" for k in BASE for x in ("base", "raw")])
    spans = spans.where(~glued & F.when(F.col("out"), (F.col("c.k") == 0) & told).otherwise((F.col("c.k") != 0) | ~told)).select("fold", "c.k", F.col("c.f").cast("array<int>").alias("f"), same.alias("y"))
    alike = cut(spans.groupBy("fold", "k", "f", "y").agg(F.count("*").alias("n")), "examples")
    shape = boosting.Shape(len(KINDS), len(FEATURES), VALUES)
    few = alike.count() <= SAMPLE_SPANS
    examples = boosting.Local(boosting.Examples.of(alike.toArrow(), len(FEATURES)), shape) if few else boosting.Spread(alike, shape)
    trees, hits = boosting.fit(examples)
    cuts = [max(0.5, c) for c in boosting.thresholds(examples.held(trees), len(KINDS), hits, PRECISION)]
    return Model(trees, cuts)


def find(docs: DataFrame, model: Model, text: str = "text", name: str = "__pii") -> DataFrame:
    """The input's columns and a struct ``name``: base and all, arrays of (s, k, e) by start, then kind; k indexes ``KINDS``.

    Null and empty texts have no spans; a candidate that meets a strict span of any kind, or a better candidate that stays, is dropped;
    ties go to the earlier start, then the longer span; other columns pass through.
    """
    tag = "__"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    own, base_, events, marked, back, runs = (tag + x for x in ("text", "base", "events", "marked", "back", "runs"))
    d = with_base(docs.withColumn(own, F.coalesce(F.col(text), F.lit(""))), own, tag)
    d = with_candidates(d, own, tag, model.kinds())
    base = F.concat(*[F.transform(f"{tag}base_{kind}", lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))) for k, kind in enumerate(BASE)])  # noqa: B023
    d = d.withColumn(base_, F.array_sort(base))
    # strict spans (0) and chosen candidates (1) by start; a candidate meets a strict span that began before it and lasts, or begins inside it
    event = lambda s, w, e, k, z: F.struct(s.alias("s"), F.lit(w).alias("w"), e.alias("e"), k.alias("k"), z.alias("z"))
    scored = F.filter(F.transform(f"{tag}cand", lambda c: event(c["s"], 1, c["e"], c["k"], -model.score(c))), lambda x: x["z"] <= 0)
    d = d.withColumn(f"{tag}chosen", scored)
    chosen, kind = F.col(f"{tag}chosen"), "struct<s:int,w:int,e:int,k:int,z:double>"
    d = d.withColumn(events, F.when(F.size(chosen) > 0, F.array_sort(F.concat(F.transform(base_, lambda b: event(b["s"], 0, b["e"], b["k"], F.lit(0.0))), chosen))).otherwise(F.array().cast(f"array<{kind}>")))
    moved = lambda x, hit: F.struct(*[x[c].alias(c) for c in ("s", "w", "e", "k", "z")], hit.alias("hit"))
    flagged = "struct<s:int,w:int,e:int,k:int,z:double,hit:boolean>"
    d = d.withColumn(marked, F.reverse(scan(F.col(events), F.lit(-1), lambda at, x, i: (F.when(x["w"] == 0, F.greatest(at, x["e"])).otherwise(at), moved(x, at > x["s"])), flagged)))
    d = d.withColumn(back, scan(F.col(marked), F.lit(2**31 - 1), lambda at, x, i: (F.when(x["w"] == 0, x["s"]).otherwise(at), moved(x, x["hit"] | (at < x["e"]))), flagged))
    left = F.array_sort(F.transform(F.filter(back, lambda x: (x["w"] == 1) & ~x["hit"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["z"].alias("z"))))
    d = d.withColumn(f"{tag}left", left)
    # candidates that overlap, one to the next, are a run; within a run the best goes first
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("run"))

    def into_runs(at, x, i):
        run = at["run"] + F.when(x["s"] >= at["end"], 1).otherwise(0)
        return F.struct(F.greatest(at["end"], x["e"]).alias("end"), run.alias("run")), F.struct(run.alias("run"), x["z"].alias("z"), x["s"].alias("s"), (-x["e"]).alias("w"), x["k"].alias("k"))

    d = d.withColumn(runs, F.array_sort(scan(F.col(f"{tag}left"), start, into_runs, "struct<run:int,z:double,s:int,w:int,k:int>")))
    ends = "array<struct<s:int,e:int>>"

    def best_first(at, x, i):
        got = F.when(at["run"] == x["run"], at["got"]).otherwise(F.array().cast(ends))
        e = -x["w"]
        met = F.exists(got, lambda b: (b["s"] < e) & (x["s"] < b["e"]))
        more = F.when(met, got).otherwise(F.array_append(got, F.struct(x["s"].alias("s"), e.alias("e"))))
        return F.struct(x["run"].alias("run"), more.alias("got")), F.struct(x["s"].alias("s"), x["k"].alias("k"), e.alias("e"), (~met).alias("stays"))

    picked = scan(F.col(runs), F.struct(F.lit(0).alias("run"), F.array().cast(ends).alias("got")), best_first, "struct<s:int,k:int,e:int,stays:boolean>")
    d = d.withColumn(f"{tag}picked", picked)
    added = F.transform(F.filter(f"{tag}picked", lambda x: x["stays"]), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return d.select(*docs.columns, F.struct(F.col(base_).alias("base"), F.array_sort(F.concat(base_, added)).alias("all")).alias(name))


def digest(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input with every span of its text replaced by ``[kind]``; overlapping spans become one, named by the first. A null text stays null."""
    name = free(docs, "__pii")[0]
    d = find(docs, model, text, name)
    t, kinds, all_ = F.col(text), F.array(*[F.lit(f"[{k}]") for k in KINDS]), free(docs, "__all", "__parts")
    d = d.withColumn(all_[0], F.col(name)["all"])
    spans = F.col(all_[0])

    def step(at, x, i):
        fresh = F.concat(F.substring(t, at + 1, x["s"] - at), F.get(kinds, x["k"]))
        return F.greatest(at, x["e"]), F.when(x["s"] >= at, fresh).otherwise(F.lit(""))

    d = d.withColumn(all_[1], scan(spans, F.lit(0), step, "string"))
    last = F.array_max(F.transform(spans, lambda x: x["e"]))
    done = F.concat(F.array_join(all_[1], ""), F.substring(t, last + 1, F.length(t)))
    return d.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(t)).select(*docs.columns)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = find(docs, fit(docs))
    count = lambda k: F.size(F.filter("__pii.base", lambda x: x["k"] == k)).cast("long")
    return d.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)], F.sha2(digest(F.col("__pii.base")), 256).alias("base_sha256"), digest(F.col("__pii.all")).alias("spans"))


def pii_base(spark, sf_dir: str) -> DataFrame:
    """The strict spans of ``op7_pii``, as SQL can say them: counts of each kind."""
    d = with_base(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    return d.select("doc_id", *[F.size(f"__base_{kind}").cast("long").alias(f"n_{kind}") for kind in BASE])


#: Digits of a card are weighed from the right: every second one doubled, its digits summed.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
  CAST(len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: TRY_CAST(p AS HUGEINT) > 255 OR TRY_CAST(p AS HUGEINT) IS NULL)) = 0)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(card, lambda x: len(x) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(x), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phone, lambda x: len(x) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
FROM m
"""
