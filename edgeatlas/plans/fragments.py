"""Tables in versions, on any store that Spark reads: copy-on-write fragments under write-once manifests.

A table is dealt into buckets by a hash of its key, and a fragment is the folder of one bucket's Parquet files, which never change. A version
is a manifest: which fragments make up each table. A change rewrites the fragments of the buckets it touches and keeps the others by
name; rows go by an anti-join against the keys that change. A commit creates the next version's manifest, and creation fails where the
manifest is there already, so of two writers from one version one has to start again. Readers choose a version and see all of it or
nothing. ``retain`` deletes older versions and every fragment that only they have.

The manifest holds names of fragments alone, in proportion to buckets and not to rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class FragmentStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = jvm.org.apache.commons.io.IOUtils

    # ---- versions

    def versions(self) -> list[int]:
        at = self._path(f"{self.folder}/versions")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getLen()) if self._fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the last; None where there is none."""
        have = self.versions()
        version = have[-1] if version is None and have else version
        if version not in have:
            return None
        stream = self._fs.open(self._path(self._version(version)))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _version(self, version: int) -> str:
        return f"{self.folder}/versions/{version:012d}"

    def commit(self, manifest: dict) -> int:
        """Make ``manifest`` the version after the one it started from."""
        version = manifest["version"] + 1
        text = json.dumps(manifest | {"version": version}, sort_keys=True).encode()
        try:
            out = self._fs.create(self._path(self._version(version)), False)  # fails where the file exists
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.toString() or "already exists" in e.java_exception.toString():
                raise Conflict(f"version {version} of {self.folder} is there already") from e
            raise
        try:
            out.write(bytearray(text))
        finally:
            out.close()
        return version

    def start(self, buckets: int = BUCKETS, **more) -> dict:
        """A manifest to change and commit: the last version's, or an empty one with so many buckets."""
        return (self.manifest() or {"version": 0, "buckets": buckets, "tables": {}}) | more

    def retain(self, n: int = 1) -> int:
        """Keep the last ``n`` versions; delete the others and what only they have. How many folders went."""
        have = self.versions()
        old, kept = have[: max(0, len(have) - n)], have[max(0, len(have) - n) :]
        named = lambda versions: {p for v in versions for t in (self.manifest(v) or {"tables": {}})["tables"].values() for p in t["fragments"].values()}
        gone = named(old) - named(kept)
        for v in old:
            self._fs.delete(self._path(self._version(v)), False)
        for p in gone:
            self._fs.delete(self._path(f"{self.folder}/{p}"), True)
        for parent in {p.rsplit("/", 1)[0] for p in gone}:
            at = self._path(f"{self.folder}/{parent}")
            if self._fs.exists(at) and not any(f.isDirectory() for f in self._fs.listStatus(at)):
                self._fs.delete(at, True)
        return len(gone)

    # ---- reading

    def read(self, name: str, manifest: dict | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as a manifest has it (by default the last version), or some of its buckets."""
        manifest = manifest or self.manifest()
        table = manifest["tables"][name]
        wanted = table["fragments"] if buckets is None else {str(b): table["fragments"][str(b)] for b in buckets if str(b) in table["fragments"]}
        schema = StructType.fromJson(table["schema"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in sorted(wanted.values())])

    # ---- writing: each changes ``manifest`` in place, and counts the fragments written

    def bucket(self, manifest: dict, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(manifest["buckets"])).cast("int")

    def _write(self, manifest: dict, name: str, rows: DataFrame, bucket: Column | None, buckets: Iterable[int]) -> dict[str, str]:
        folder = f"data/{name}-{uuid.uuid4().hex}"
        out = rows.withColumn("__bucket", F.lit(0) if bucket is None else bucket)
        out = out if bucket is None else out.repartition("__bucket")
        out.write.partitionBy("__bucket").parquet(f"{self.folder}/{folder}")
        made = {f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/{folder}")) if f.isDirectory()}
        return {str(b): f"{folder}/__bucket={b}" for b in buckets if f"__bucket={b}" in made}

    def replace(self, manifest: dict, name: str, rows: DataFrame, keys: list[str] | None = None) -> int:
        """All rows of a table. With keys, only fragments whose rows differ from those of the manifest are written; without, it is one fragment."""
        before = manifest["tables"].get(name, {})
        schema = json.loads(rows.schema.json())
        if keys is None:
            manifest["tables"][name] = {"schema": schema, "fragments": self._write(manifest, name, rows, None, [0])}
            return 1
        at = self.bucket(manifest, keys)
        sums = rows.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)")).alias("s"))  # a row per bucket
        now = {str(r["b"]): f"{r['n']}:{r['s']}" for r in sums.collect()}
        same = {b for b, d in now.items() if before.get("digests", {}).get(b) == d and before.get("schema") == schema}
        changed = [int(b) for b in now if b not in same]
        written = self._write(manifest, name, rows.where(at.isin(changed)), at, changed) if changed else {}
        manifest["tables"][name] = {"schema": schema, "keys": keys, "digests": now, "fragments": {b: before["fragments"][b] for b in same} | written}
        return len(written)

    def upsert(self, manifest: dict, name: str, rows: DataFrame, gone: DataFrame, keys: list[str]) -> int:
        """Put ``rows`` in, in place of those with their keys, and take the rows with the keys of ``gone`` out. Only their buckets are read and written."""
        table = manifest["tables"].get(name)
        at = self.bucket(manifest, keys)
        touched = sorted(r[0] for r in rows.select(at).union(gone.select(at)).distinct().collect())  # bucket numbers
        new = rows
        if table:
            keyed = gone.select(*keys).union(rows.select(*keys)).distinct()
            left = self.read(name, manifest, touched).join(keyed, keys, "left_anti")
            new = left.select(*rows.columns).unionByName(rows)
        written = self._write(manifest, name, new, at, touched) if touched else {}
        kept = {b: p for b, p in (table or {"fragments": {}})["fragments"].items() if int(b) not in touched}
        manifest["tables"][name] = {"schema": json.loads(rows.schema.json()), "keys": keys, "fragments": kept | written}
        return len(written)
