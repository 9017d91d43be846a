"""The index: facts per file and edges, in versions of a fragment store; the other fact tables are views of the facts.

Only files whose content hash is new are extracted, and only the fragments that hold them are written again; edges are resolved anew and
written where a fragment of them differs. A file keeps its id while it lives, and its facts' ids follow it, so what did not change
has the same rows. Nothing of a deleted file is left once older versions are gone, by default with the commit.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeatlas import schemas
from edgeatlas.extract import extract
from edgeatlas.extract.facts import LISTS
from edgeatlas.functions import secrets
from edgeatlas.functions.names import normalize_key
from edgeatlas.operators.resolve import BUILTINS, COMMON, CSHARP_COMMON, resolve
from edgeatlas.operators.trigrams import postings, trigrams
from edgeatlas.plans.envelope import ToolError
from edgeatlas.plans.fragments import FragmentStore
from edgeatlas.plans.snapshot import diff
from edgeatlas.session import cut
from edgeatlas.sources import repos as R

PER_FILE = 1 << 20  # ids of a file's facts; more than a file of the largest size can have
#: Files that a bucket of facts is meant for.
BUCKET_FILES = 4096


def resolver_fingerprint() -> str:
    import hashlib

    return hashlib.sha256(repr((schemas.SCHEMA_VERSION, sorted(schemas.RULES.items()), schemas.MAX_CANDIDATES, sorted({*COMMON, *BUILTINS, *CSHARP_COMMON}))).encode()).hexdigest()[:12]


def clean_facts(files: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The facts of files, every string of them sanitised, nested ones too, before anything is written."""
    return extract(files, clean=lambda x: secrets.sanitize_obj(x, extra), clean_path=secrets.sanitize_path)


def numbered(files: DataFrame, after: int = 0) -> DataFrame:
    """``files`` (with repo and path) with file_id: from ``after`` on, by repository and path. Ranges of both are sorted apart and written; read twice."""
    place = F.col("place")
    ranges = cut(files.repartitionByRange("repo", "path").sortWithinPartitions("repo", "path").withColumn("place", F.monotonically_increasing_id()), "ranges")
    per = ranges.groupBy(F.shiftright(place, 33).alias("range")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    base = F.broadcast(per.select("range", (before + after + 1).alias("base")))
    out = ranges.withColumn("range", F.shiftright(place, 33)).join(base, "range")
    return out.withColumn("file_id", F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("range", "base", "place")


def repo_table(spark: SparkSession, repo_rows: list[tuple[str, str, str]], now: dt.datetime) -> DataFrame:
    return spark.createDataFrame([(i, n, p, s, now) for i, (n, p, s) in enumerate(sorted(repo_rows), 1)], schemas.TABLES["repos"])


def views_of(facts: DataFrame, repos: DataFrame) -> dict[str, DataFrame]:
    """The fact tables, read from the facts of each file: a scan of what each table needs."""
    f = facts.join(repos.select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo")
    out = {"repos": repos, "files": f.select(F.col("file_id").alias("id"), "repo_id", "path", "lang", "content_hash", "loc", "parse_error", "module")}
    for k in LISTS:
        x = rows_of(facts, k, "file_id").withColumn("id", F.col("file_id") * PER_FILE + F.col("pos"))
        out[k] = x.select(*[c.split()[0] for c in schemas.TABLES[k].split(", ")])
    return out


def rows_of(facts: DataFrame, name: str, *file: str) -> DataFrame:
    """The rows of one table beside columns of their file; ``pos`` is a row's place in the file."""
    x = facts.select(*file, F.posexplode(name).alias("pos", "x")).select(*file, "pos", "x.*")
    return x.withColumn("key_norm", normalize_key(F.col("key_path"))) if name == "config_keys" else x


def tables_of(facts: DataFrame, repo_rows: list[tuple[str, str, str]], now: dt.datetime) -> dict[str, DataFrame]:
    """The fact tables of facts that no catalog keeps."""
    return views_of(numbered(cut(facts, "facts")), repo_table(facts.sparkSession, repo_rows, now))


class Catalog:
    """A fragment store with the index; the folder is any that Spark reads and writes. Readers take the last version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, FragmentStore(spark, str(folder))

    def current(self) -> int | None:
        at = self.store.manifest()
        if at is None:
            return None
        if at["schema_version"] > schemas.SCHEMA_VERSION:
            raise ToolError("not_indexed", "the index was written by a newer version", "upgrade, or index again")
        return at["version"]

    def table(self, name: str) -> DataFrame:
        version = self.current()
        if version is None:
            raise ToolError("not_indexed", "there is no index here", "index a folder first")
        at = self.store.manifest(version)
        read = lambda n: self.store.read(n, at)
        return read(name) if name in at["tables"] else views_of(read("facts"), read("repos"))[name]

    def postings_of(self, needle: str) -> DataFrame:
        """The index's postings in the fragments that the needle's trigrams fall into, those trigrams alone."""
        at = self.store.manifest(self.current())
        own = self.spark.range(1).select(F.explode(trigrams(F.lit(needle))).alias("trigram"))
        asked = own.select("trigram", self.store.bucket(at, ["trigram"]).alias("b")).collect()  # of one needle
        return self.store.read("trigrams", at, {r["b"] for r in asked}).where(F.col("trigram").isin([r["trigram"] for r in asked]))

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.table("meta").collect()}


def build(spark: SparkSession, catalog: Catalog, files: DataFrame, repo_rows: list[tuple[str, str, str]], extra: tuple[str, ...] = (), now: dt.datetime | None = None, keep: tuple[str, ...] = (), versions: int = 1) -> dict[str, int]:
    """Bring the catalog to ``files`` (repo, path, lang, content, content_hash). Returns counts of added, changed, removed and same files.

    Repositories in ``keep``, and projects below them, stay as they were: their scan failed. The last ``versions`` are kept. Where another
    writer commits first, ``Conflict`` is raised and nothing has changed.
    """
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    fingerprint = resolver_fingerprint() + "/" + secrets.fingerprint(extra)
    store = catalog.store
    keyed = files.withColumn("raw_path", F.col("path"))
    old, meta = None, {}
    if catalog.current() is not None:
        meta = catalog.meta()
        if meta.get("fingerprint", "").endswith(secrets.fingerprint(extra)):
            old = catalog.table("facts")
    keys = ["repo", "raw_path"]
    new_hashes = keyed.select(*keys, "content_hash")
    old_hashes = old.select(*keys, "content_hash") if old is not None else new_hashes.limit(0)
    if keep and old is not None:
        stays = F.col("repo").isin(*keep)
        for k in keep:
            stays = stays | F.col("repo").startswith(k + "/")
        new_hashes = new_hashes.unionByName(old_hashes.where(stays))
        have = {n for n, _, _ in repo_rows}
        before = catalog.table("repos").withColumnRenamed("name", "repo").where(stays).collect()
        repo_rows = [*repo_rows, *((r["repo"], r["path"], r["head_sha"]) for r in before if r["repo"] not in have)]
    state = cut(diff(old_hashes, new_hashes, keys), "diff")
    counts = {r["state"]: r["count"] for r in state.groupBy("state").count().collect()}
    manifest = store.start(max(16, 1 << (sum(counts.values()) // BUCKET_FILES).bit_length()), schema_version=schemas.SCHEMA_VERSION)
    if old is None:
        manifest["tables"] = {}
    fresh = keyed.join(state.where(F.col("state").isin("added", "changed")), keys, "left_semi")
    got = clean_facts(fresh.drop("raw_path"), extra)
    raw = secrets.mapped(secrets.sanitize_path, "string")
    got = cut(got.join(fresh.select("repo", raw("path").alias("path"), "raw_path"), ["repo", "path"]), "fresh")
    # a changed file keeps its id; new ones follow the highest there was
    last = int(meta.get("last_file_id", 0)) if old is not None else 0
    if old is not None:
        known = old.select(*keys, "file_id").join(state.where("state = 'changed'"), keys, "left_semi")
        rows = got.join(known.select(*keys, "file_id"), keys).unionByName(numbered(got.join(known, keys, "left_anti"), last))
    else:
        rows = numbered(got)
    gone = state.where(F.col("state").isin("removed", "changed")).select(*keys)
    written = store.upsert(manifest, "facts", cut(rows, "rows"), gone, keys)
    facts = store.read("facts", manifest)
    repos = repo_table(spark, repo_rows, now)
    same = old is not None and counts.get("same", 0) == sum(counts.values()) and meta.get("fingerprint") == fingerprint
    if not same:
        edges = cut(resolve(views_of(facts, repos)).withColumn("file_id", F.expr(f"ref_id div {PER_FILE}")), "edges")
        written += store.replace(manifest, "edges", edges, ["file_id"])
        names = store.read("facts", manifest).select("file_id", F.posexplode("symbols").alias("pos", "x")).select((F.col("file_id") * PER_FILE + F.col("pos")).alias("symbol_id"), "x.name", "x.qualified_name")
        written += store.replace(manifest, "trigrams", cut(postings(names), "postings"), ["trigram"])
    run = [(1, now, dt.datetime.now(dt.UTC).replace(tzinfo=None), {n: s for n, _, s in repo_rows}, {k: int(v) for k, v in counts.items()}, facts.where("parse_error").count(), None)]
    runs = spark.createDataFrame(run, schemas.TABLES["index_runs"])
    if old is not None:
        before = catalog.table("index_runs")
        runs = before.unionByName(runs.withColumn("id", F.col("id") + (before.agg(F.max("id")).first()[0] or 0)))
    top = facts.agg(F.max("file_id")).first()[0] or 0
    small = {"repos": repos, "index_runs": runs, "overrides": spark.createDataFrame([], schemas.TABLES["overrides"])}
    small["meta"] = spark.createDataFrame([("schema_version", schemas.SCHEMA_VERSION), ("fingerprint", fingerprint), ("last_file_id", str(max(last, top))), ("fragments_written", str(written))], schemas.TABLES["meta"])
    for name, df in small.items():
        store.replace(manifest, name, df.coalesce(1))
    store.commit(manifest)
    store.retain(versions)
    return counts


def index_root(spark: SparkSession, catalog: Catalog, root: str, config: R.Config | None = None) -> dict[str, int]:
    files, repos, failed, notes = R.manifest(spark, root, config)
    small, large = R.contents(spark, root, files)
    counts = build(spark, catalog, small, [(n, p, s) for n, (p, s) in repos.items()], tuple((config or R.Config()).extra_redaction_patterns), keep=tuple(failed))
    return counts | {"skipped_large": large.count(), "failed": len(failed), "notes": len(notes)}
