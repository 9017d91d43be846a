"""From a source file to its facts: one row in, arrays of facts out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from edgeatlas.extract.facts import FACTS_DDL, LISTS, Facts, arrow_schema

Extractor = Callable[[str, bytes], Facts]
#: Files whose facts a worker holds at once.
SLICE = 256


def registry(send_methods: tuple[str, ...] | None = None) -> dict[str, Extractor]:
    """Extractors by language; ``send_methods`` are the C# methods whose first argument names a job."""
    from functools import partial

    from edgeatlas.extract import config, csharp, python

    sharp = csharp.extract if send_methods is None else partial(csharp.extract, sends=tuple(send_methods))
    return {"python": python.extract, "csharp": sharp, "config": config.extract, "overrides": config.overrides}


def extract_one(lang: str, path: str, content: bytes, extractors: dict[str, Extractor] | None = None) -> Facts:
    """A failing extractor gives an empty file marked as a parse error."""
    try:
        return (extractors or registry())[lang](path, content)
    except Exception:  # any file may be broken in any way
        return Facts(parse_error=True)


def extract(files: DataFrame, extractors: dict[str, Extractor] | None = None, clean: Callable[[Any], Any] = lambda x: x, clean_path: Callable[[str], str] = lambda x: x) -> DataFrame:
    """``files``: repo, path, lang, content (binary), content_hash. The result has the facts in place of the content; ``clean`` maps a list of facts,
    ``clean_path`` a path, in the same pass. A worker holds the facts of ``SLICE`` files, whatever comes in a batch.
    """
    given = ("repo", "path", "lang", "content_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = extractors or registry()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                repo, path, lang, content_hash = (b.column(c).to_pylist() for c in given)
                loc, got = [], []
                for x, name, content in zip(lang, path, b.column("content"), strict=True):
                    c = content.as_py()
                    loc.append(c.count(b"\n") + (not c.endswith(b"\n") and len(c) > 0))
                    got.append(extract_one(x, name, c, known))
                facts = {k: [clean(v) for v in values] if k in LISTS else values for k, values in Facts.columns(got).items()}
                columns = {"repo": repo, "path": [clean_path(x) for x in path], "lang": lang, "content_hash": content_hash, "loc": loc, **facts}
                yield pa.RecordBatch.from_pydict(columns, schema=arrow_schema(*given, loc="int"))

    return files.select(*given, "content").mapInArrow(run, f"repo string, path string, lang string, content_hash string, loc int, {FACTS_DDL}")
