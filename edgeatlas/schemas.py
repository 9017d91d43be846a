"""Fact tables, enumerations and the rule table."""

from __future__ import annotations

SCHEMA_VERSION = "1"

TABLES = {
    "meta": "key string, value string",
    "repos": "id bigint, name string, path string, head_sha string, indexed_at timestamp",
    "files": "id bigint, repo_id bigint, path string, lang string, content_hash string, loc int, parse_error boolean, module string",
    "symbols": "id bigint, file_id bigint, kind string, name string, qualified_name string, line_start int, line_end int, visibility string, param_count int",
    "refs": "id bigint, file_id bigint, from_qualified string, to_name string, kind string, line int, receiver_type string, note string",
    "imports": "id bigint, file_id bigint, local_name string, target string, line int",
    "config_keys": "id bigint, file_id bigint, key_path string, key_norm string, line int, origin string, reader_qualified string",
    "entry_points": "id bigint, file_id bigint, kind string, name string, target string, line int",
    "queue_handlers": "id bigint, file_id bigint, protocol string, name string, handler_qualified string, line int",
    "string_consts": "id bigint, file_id bigint, qualified_name string, value string, line int",
    "edges": "id bigint, ref_id bigint, from_symbol_id bigint, to_symbol_id bigint, kind string, rule string, confidence double, candidates int",
    "overrides": "id bigint, from_symbol string, to_symbol string, kind string, note string",
    "index_runs": "id bigint, started timestamp, finished timestamp, repo_shas map<string,string>, counts map<string,bigint>, parse_errors int, leak_scan_clean boolean",
}

SYMBOL_KINDS = ("module", "class", "interface", "function", "method")
REF_KINDS = ("call", "import", "inherit", "instantiate", "queue", "queue_const", "queue_actor", "curated")
CONFIG_ORIGINS = ("json", "yaml", "env-example", "code-read")
ENTRY_KINDS = ("main-block", "console-script", "program-main")
#: Edge kinds that callers, callees and paths follow.
TRAVERSED = ("call", "instantiate")
#: Strongest last: an answer made of several sources has the weakest.
SOURCES = ("derived", "curated", "parsed")

#: Each rule's confidence and meaning.
RULES = {
    "direct": (1.0, "the reference names the target directly"),
    "curated": (1.0, "a person declared the link"),
    "same_file": (0.95, "the target is defined in the same file"),
    "import_scope": (0.9, "the name was imported from the target's module"),
    "same_namespace": (0.9, "the target is in the same or an enclosing namespace"),
    "declared_type": (0.85, "the receiver's declared type has the member"),
    "queue_match": (0.9, "the job name has one handler"),
    "repo_unique": (0.7, "the repository has one symbol of that name"),
    "cross_repo_unique": (0.6, "all repositories together have one symbol of that name"),
    "ambiguous": (0.15, "several symbols have that name"),
}
#: A name with more candidates than this, over all repositories, is not guessed at.
MAX_CANDIDATES = 10
