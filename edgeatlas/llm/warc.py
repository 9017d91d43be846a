"""WARC archives: a writer made of text expressions and a Python data source that reads them back.

The writer renders every record as one string and lets Spark's text sink write it, so archives land through the same commit
protocol and on the same file systems as any table. The reader plans tasks over files, takes record-type and header
predicates, reads a record's headers first and steps over the block of a record that they reject, or whose payload nobody asked
for. Plain and gzipped archives (one stream, or one member per record) are read.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from edgeatlas.llm.session import cut, scratch

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always stored in full.
LEAST_BYTES = 100
#: Most groups of equal payloads whose table is broadcast to the writers.
BROADCAST_GROUPS = 100_000
#: Bytes of archive that one reading task takes, and rows' bytes that one Arrow batch holds.
SPLIT, BATCH = 64 << 20, 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, refers_to string, content_length long, http_length long, headers map<string,string>, payload binary"

NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


# ---- writing

def _header(name: str, value: Column) -> Column:
    clean = F.regexp_replace(value, r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip") -> None:
    """One record per row. Of equal payloads of at least ``LEAST_BYTES`` the row with the smallest id is a response, others revisit it.

    A null payload is an empty one, a null url has no target header, line breaks in a url become a space; rows that repeat
    the smallest id with the same payload are all responses. Other columns are ignored.
    """
    p = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"))
    p = p.withColumns({"n": F.octet_length("body"), "sha": F.sha2(F.col("body").cast("binary"), 256)})
    firsts = p.where(F.col("n") >= LEAST_BYTES).groupBy(F.col("sha").alias("sha1")).agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    firsts = cut(firsts, "payloads")
    if firsts.count() <= BROADCAST_GROUPS:
        firsts = F.broadcast(firsts)
    p = p.join(firsts, (p.sha == firsts.sha1) & (p.n >= LEAST_BYTES), "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", record_id(F.col("id"))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", record_id(F.col("first"))))).otherwise(""),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
        F.lit("\r\n"),
    )
    p.select(F.concat(head, block).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


# ---- reading

class _Archive:
    """Sequential reads over a plain or gzipped stream; ``skip`` seeks where the stream can."""

    def __init__(self, raw):
        self.raw, self.plain = raw, True
        self.buf = raw.read(1 << 16)
        self.z = None
        if self.buf[:2] == b"\x1f\x8b":
            self.plain, self.z, self.packed, self.buf = False, zlib.decompressobj(31), self.buf, b""
        self.at = 0

    def _more(self) -> bytes:
        if self.plain:
            return self.raw.read(1 << 20)
        while True:
            if not self.packed:
                self.packed = self.raw.read(1 << 18)
                if not self.packed:
                    return b""
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(self.packed)
            self.packed = self.z.unused_data if self.z.eof else b""
            if out:
                return out

    def _fill(self) -> bool:
        got = self._more()
        self.buf = self.buf[self.at :] + got
        self.at = 0
        return bool(got)

    def line(self) -> bytes:
        while (i := self.buf.find(b"\n", self.at)) < 0:
            if not self._fill():
                i = len(self.buf) - 1
                break
        out, self.at = self.buf[self.at : i + 1], i + 1
        return out

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0:
            part = self.buf[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
            if n and not self._fill():
                raise ValueError("archive ends inside a record")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        here = min(n, len(self.buf) - self.at)
        self.at, n = self.at + here, n - here
        if n and self.plain and self.raw.seekable():
            self.raw.seek(n, io.SEEK_CUR)
        else:
            while n:
                if not self._fill():
                    raise ValueError("archive ends inside a record")
                here = min(n, len(self.buf))
                self.at, n = here, n - here


def _headers(stream: _Archive) -> tuple[dict[str, str], int]:
    """Header lines up to the empty one, names in lower case, and the bytes they took."""
    found: dict[str, str] = {}
    last, size = "", 0
    while (line := stream.line()):
        size += len(line)
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not text:
            break
        if text[0] in " \t" and last:
            found[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        found[last] = value.strip()
    return found, size


def records(raw, wanted=lambda row: True, payload: bool = True, strict: bool = True) -> Iterator[dict]:
    """Rows of an archive. ``wanted`` sees a row before its block is read; without ``payload`` only HTTP headers of a block are.

    What is no record raises ValueError; unless ``strict``, an archive then ends with a row of type ``malformed`` that says why.
    """
    try:
        yield from _records(raw, wanted, payload)
    except (ValueError, zlib.error) as e:
        if strict:
            raise ValueError(str(e)) from e
        yield dict.fromkeys(NAMES) | {"record_type": "malformed", "headers": [("error", str(e))]}


def _records(raw, wanted, payload: bool) -> Iterator[dict]:
    s = _Archive(raw)
    while line := s.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        h, _ = _headers(s)
        if not h.get("content-length", "").isdigit():
            raise ValueError("a record without a length")
        n = int(h["content-length"])
        digest = h.get("warc-payload-digest")
        row = {"record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "content_type": h.get("content-type"), "payload_digest": digest, "refers_to": h.get("warc-refers-to"), "content_length": n, "http_length": None, "headers": list(h.items()), "payload": None}
        if not wanted(row):
            s.skip(n)
            continue
        if (h.get("content-type") or "").startswith("application/http") and n:
            status = len(s.line())
            http, size = _headers(s)
            row["http_length"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
            n -= status + size
        if payload:
            row["payload"] = s.read(n)
        else:
            s.skip(n)
        yield row


def _test(f: D.Filter):
    """A predicate over rows without payload, or None where the filter can't be decided from headers."""
    name = getattr(f, "attribute", None)
    if isinstance(f, D.Not):
        inner = _test(f.child)
        return None if inner is None else lambda r: (v := inner(r)) is not None and not v
    if not name or len(name) != 1 or name[0] not in ("record_id", "record_type", "target_uri", "date", "content_type", "payload_digest", "refers_to", "content_length"):
        return None
    k, v = name[0], getattr(f, "value", None)
    ops = {
        D.EqualTo: lambda x: x == v, D.EqualNullSafe: None, D.GreaterThan: lambda x: x > v, D.GreaterThanOrEqual: lambda x: x >= v, D.LessThan: lambda x: x < v,
        D.LessThanOrEqual: lambda x: x <= v, D.In: lambda x: x in v, D.StringStartsWith: lambda x: x.startswith(v), D.StringEndsWith: lambda x: x.endswith(v), D.StringContains: lambda x: v in x,
    }
    if isinstance(f, D.IsNull):
        return lambda r: r[k] is None
    if isinstance(f, D.IsNotNull):
        return lambda r: r[k] is not None
    op = ops.get(type(f))
    return op and (lambda r: None if r[k] is None else op(r[k]))


class _Files(D.InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(0)
        self.files = files


class WarcReader(D.DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.split, self.strict = int(options.get("split", SPLIT)), str(options.get("mode", "failfast")).lower() != "permissive"
        self.kept: list[D.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.kept.append(f)

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._" and x.size)
        tasks: list[list[str]] = []
        room = 0
        for name, size in files:
            if not tasks or size > room:
                tasks.append([])
                room = self.split
            tasks[-1].append(name)
            room -= size
        return [_Files(t) for t in tasks] or [_Files([])]

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        tests = [_test(f) for f in self.kept]
        wanted = lambda row: all(t(row) for t in tests)
        names = NAMES
        kinds = dict(zip(names, [pa.string()] * 7 + [pa.int64()] * 2 + [pa.map_(pa.string(), pa.string()), pa.binary()], strict=True))
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

        for name in partition.files:
            with store.open_input_file(name) as f:
                for row in records(f, wanted, self.payload, self.strict):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= BATCH:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(D.DataSource):
    """``spark.read.format("warc").option("path", folder or file).option("payload", "true" or "false")``; ``mode`` permissive reports broken archives as rows."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)


def read_warc(spark: SparkSession, path: str, payload: bool = True, **options) -> DataFrame:
    """Archives as a table. Predicates only reach Python sources where ``PUSHDOWN`` is on; it is switched on unless the session says otherwise."""
    spark.dataSource.register(WarcSource)
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("warc").options(path=path, payload=str(payload).lower(), **options).load()


def archive_digest(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archives that ``write_warc`` wrote.

    A response's size and digest are those of the payload read back; a revisit has the original's in its headers.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    full = F.col("record_type") == "response"
    return archive.select(
        as_id(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        as_id(F.col("refers_to")).alias("refers_to"),
    )


def _written_and_read(spark, pages: DataFrame) -> DataFrame:
    """Archives of the pages, read back twice: responses whole, revisits from their headers, blocks stepped over."""
    path = scratch(spark, "warc")
    write_warc(pages, path)
    whole = read_warc(spark, path).where("record_type = 'response'")
    heads = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return archive_digest(whole).unionByName(archive_digest(heads))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    return _written_and_read(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def warc_revisits(spark, sf_dir: str) -> DataFrame:
    """``op1_warc`` on the pages and a second visit of every third one, as the small tables hold no equal payloads."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return _written_and_read(spark, p.unionByName(p.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1_000_000_000)))


SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS body, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""

REVISITS_SQL = SQL.replace("FROM pages)", "FROM (SELECT page_id, html FROM pages UNION ALL SELECT page_id + 1000000000, html FROM pages WHERE page_id % 3 = 0))")
