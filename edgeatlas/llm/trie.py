"""Prefix trie of conversations: a node per distinct sequence of first turns.

Turns are dictionary-encoded: one id per distinct (role, text). Conversations with one sequence of ids become one class, named by
its smallest id, before anything is split. Then buckets of classes that share their first d turns are partitioned by the id of
the next turn, most significant first: a pass is one grouping over the buckets still too large and yields the nodes one level deeper.
A bucket of one class is a chain of nodes, written down turn by turn; a bucket of at most ``LOCAL`` turns (``DEEP``, where few long
conversations share their starts) goes to one task, where multikey quicksort finishes it and every recursion into an equal part emits a
node; the others go through the next pass. Counts over subtrees then climb the levels of the passes. Work in a pass is proportional to the
classes still in large buckets; there are as many passes as turns that the classes of a large bucket share.

No group is unbounded: positions come from a range partitioning (a long conversation is split by turn), sequences and lists of ids are
digested in blocks, and only digests of blocks, or rows in order, meet in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeatlas.llm.session import cut, drop

#: Turns of a bucket that one task finishes, at most; and where its conversations still have more than ``LONG`` turns each, on average.
LOCAL, DEEP, LONG = 1 << 12, 1 << 18, 64
#: Turns of a conversation, or ids of a list, that are digested together: 2 to this power.
BLOCK_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, top boolean"
NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep")


# ---- turns as ids at positions

def encode_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0), id, words: one row per turn, by turn number (null first), then role, then the SHA-256 of role and text.

    Null roles and texts are empty; rows that repeat are turns of their own; rows without a conv_id (an integer) belong to no conversation.
    """
    spark = turns.sparkSession
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))
    key = ["conv_id", "turn", "role", "digest"]
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256)).alias("digest"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).select("conv_id", "digest", "words")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            base = -first
            base[0] = at if ids[0] == last else 0
            pos = np.arange(len(ids)) + np.repeat(base, np.diff(np.append(first, len(ids))))
            last, at = ids[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(pos)], names=["conv_id", "digest", "words", "part", "at"])

    ranked = cut(dealt.mapInArrow(number, "conv_id long, digest binary, words long, part int, at long"), "ranked")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranked.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(before))
    ids = cut(ranked.groupBy("digest").agg(F.first("words")).select("digest", F.monotonically_increasing_id().alias("id")), "dictionary")
    # a part continues one conversation at most, so there are fewer rows to broadcast than parts
    base = F.broadcast(parts.where("base > 0").select("conv_id", "part", "base"))
    numbered = ranked.join(ids, "digest").join(base, ["conv_id", "part"], "left")
    out = cut(numbered.select("conv_id", (F.col("at") + F.coalesce("base", F.lit(0))).alias("pos"), "id", "words"), "turns")
    drop(spark, ranked, ids)
    return out


def shared_starts(turns: DataFrame, group: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another one, as if several had been asked from one start: (turns, conv_ids).

    The first h turns of c are those of conversation c - c % group (% with the sign of c, as in SQL; fewer if it has fewer, none if there is none), h = crc32(c) % longest;
    its own turns after its first h follow. ``turns`` as ``encode_turns`` gives them; a conversation may end up without turns.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % longest
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    c = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("start"), h.alias("h"))
    c = cut(c.join(counts.select(F.col("conv_id").alias("start"), "n"), "start", "left").withColumn("b", F.least("h", F.coalesce("n", F.lit(0)))), "starts")
    early = turns.where(F.col("pos") < longest - 1).withColumnRenamed("conv_id", "start")
    lent = early.join(c.select("conv_id", "start", "b"), "start").where("pos < b").select("conv_id", "pos", "id", "words")
    short = c.where("b < h").select("conv_id", (F.col("b") - F.col("h")).alias("shift"))
    own = turns.where(F.col("pos") >= h).join(short, "conv_id", "left").select("conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "id", "words")
    return cut(own.unionByName(lent), "rebuilt"), c.select("conv_id")


# ---- classes of equal sequences

def _in_order(value: str, by: str) -> Column:
    """The group's values in order of ``by``, comma-joined."""
    return F.expr(f"array_join(transform(array_sort(collect_list(struct({by}, {value}))), x -> cast(x.{value} as string)), ',')")


def classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """rep (smallest conv_id), cnt, n_turns, ends (SHA-256 of the sorted ids): a row per distinct sequence of turns."""
    spark = turns.sparkSession
    block = F.shiftright("pos", BLOCK_BITS)
    parts = turns.groupBy("conv_id", block.alias("block")).agg(F.sha2(_in_order("id", "pos"), 256).alias("part"), F.count("*").alias("n"))
    whole = parts.groupBy("conv_id").agg(F.sha2(_in_order("part", "block"), 256).alias("name"), F.sum("n").alias("n_turns"))
    named = convs.join(whole, "conv_id", "left").select("conv_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("n_turns", F.lit(0)).alias("n_turns"))
    ids = F.expr("array_join(transform(array_sort(collect_list(conv_id)), x -> cast(x as string)), ',')")
    lists = named.groupBy("name", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(ids.alias("ids"), F.min("conv_id").alias("rep"), F.count("*").alias("cnt"), F.first("n_turns").alias("n_turns"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha, row = None, None, None
        for batch in batches:
            out = []
            for key, ids, rep, cnt, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == name:
                    sha.update(b",")
                    row[1] += cnt
                else:
                    if row:
                        out.append((*row, sha.hexdigest()))
                    name, sha, row = key, hashlib.sha256(), [rep, cnt, turns]
                sha.update(ids.encode())
            yield _table(out, CLASS)
        if row:
            yield _table([(*row, sha.hexdigest())], CLASS)

    CLASS = [("rep", pa.int64()), ("cnt", pa.int64()), ("n_turns", pa.int64()), ("ends", pa.string())]  # noqa: N806
    ordered = lists.repartition(n, "name").sortWithinPartitions("name", "block").select("name", "ids", "rep", "cnt", "n_turns")
    return cut(ordered.mapInArrow(digest, "rep long, cnt long, n_turns long, ends string"), "classes")


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


# ---- buckets in one task

def quicksort_nodes(node: int, depth: int, reps: list[int], counts: list[int], turns: list[list[int]], words: dict[int, int]) -> list[tuple]:
    """Nodes below ``node``, a bucket of classes whose turns from ``depth`` on are given: multikey quicksort, emitting a node per equal part.

    Rows as in ``NODE``; the last is the bucket's own, with what hangs below it (flag top).
    """
    conv, level, parent, total, text, ends, kids = [node], [depth], [-1], [0], [0], [None], [0]
    stack = [(list(range(len(reps))), 0, 0)]
    while stack:
        part, k, above = stack.pop()
        key = sorted(turns[part[i]][k] for i in (0, len(part) // 2, -1))[1]
        less, same, more = [], [], []
        for x in part:
            t = turns[x][k]
            (same if t == key else less if t < key else more).append(x)
        stack += [(p, k, above) for p in (less, more) if p]
        here = len(conv)
        conv.append(min(reps[x] for x in same))
        level.append(depth + k + 1)
        parent.append(above)
        total.append(sum(counts[x] for x in same))
        text.append(words[key])
        ends.append(next((reps[x] for x in same if len(turns[x]) == k + 1), None))
        kids.append(0)
        kids[above] += 1
        longer = [x for x in same if len(turns[x]) > k + 1]
        if longer:
            stack.append((longer, k + 1, here))
    leaves, saved = [int(not n) for n in kids], [(n - 1) * w for n, w in zip(total, text, strict=True)]
    saved[0] = 0
    for i in range(len(conv) - 1, 0, -1):  # a parent comes before its children
        leaves[parent[i]] += leaves[i]
        saved[parent[i]] += saved[i]
    rows = [(conv[i], level[i], conv[parent[i]], total[i], kids[i], leaves[i], saved[i], ends[i], False) for i in range(1, len(conv))]
    return [*rows, (node, depth, None, None, kids[0], leaves[0], saved[0], None, True)]


def _finished(rows: DataFrame) -> DataFrame:
    """Nodes of the buckets of (depth, node, rep, pos, id, cnt, words), each within one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [pa.int64()] * 8 + [pa.bool_()]
    fields = list(zip([*NODE_COLUMNS, "top"], kinds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def finish(block: np.ndarray) -> pa.RecordBatch:
            """``block``: whole buckets, a row per turn."""
            out = []
            new = lambda a: np.append(np.flatnonzero(np.append(True, (a[1:] != a[:-1]).any(1))), len(a))
            buckets, members = new(block[:, :2]), new(block[:, :3])
            lists = block[:, 4].tolist()
            for a, b in zip(buckets[:-1], buckets[1:], strict=True):
                at = members[np.searchsorted(members, a) : np.searchsorted(members, b) + 1].tolist()
                turns = [lists[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                first = block[at[:-1]]
                words = dict(zip(lists[a:b], block[a:b, 6].tolist(), strict=True))
                out += quicksort_nodes(int(block[a, 1]), int(block[a, 0]), first[:, 2].tolist(), first[:, 5].tolist(), turns, words)
            return _table(out, fields)

        for batch in batches:
            if batch.num_rows:
                held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
                block = np.concatenate(held)
                last = np.flatnonzero((block[:, :2] != block[-1, :2]).any(1))
                end = int(last[-1]) + 1 if len(last) else 0
                if end:
                    yield finish(block[:end])
                held = [block[end:]]
        if held and len(held[0]):
            yield finish(np.concatenate(held))

    columns = ["depth", "node", "rep", "pos", "id", "cnt", "words"]
    dealt = rows.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "rep", "pos").select(*[F.col(c).cast("long") for c in columns])
    return dealt.mapInArrow(run, NODE)


# ---- the trie

def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node.

    ``turns`` as ``encode_turns`` gives them; ``convs`` has every conv_id once, also those without turns (default: those with turns). A
    node is named by its depth and its smallest member. No conversations give no rows; conversations without turns alone give the root.
    """
    spark = turns.sparkSession
    convs = turns.select("conv_id").distinct() if convs is None else convs
    groups = classes(turns, convs)
    rows = turns.join(groups.select(F.col("rep").alias("conv_id"), "cnt", "n_turns"), "conv_id").withColumnRenamed("conv_id", "rep")
    rows = cut(rows.sortWithinPartitions("pos"), "classes-turns")  # a pass reads one position: row groups of others are skipped
    root = groups.agg(F.min("rep"), F.sum("cnt"), F.max(F.when(F.col("n_turns") == 0, F.col("rep")))).first()  # one row
    levels = [spark.createDataFrame([(root[0], root[1], 0, root[2], None)] if root[1] else [], "conv_id long, n_convs long, words long, end_rep long, parent_conv_id long")]
    active = groups.where("n_turns > 0").select("rep", F.lit(root[0]).cast("long").alias("node"))
    small: list[DataFrame] = []
    depth = 0
    while True:
        at = active.join(rows.where(F.col("pos") == depth), "rep")
        goes_on = F.col("n_turns") > depth + 1
        kids = cut(
            at.groupBy("node", "id").agg(
                F.min("rep").alias("conv_id"), F.sum("cnt").alias("n_convs"), F.first("words").alias("words"), F.max(F.when(~goes_on, F.col("rep"))).alias("end_rep"),
                F.count(F.when(goes_on, 1)).alias("going"), F.sum(F.col("n_turns") - depth - 1).alias("beyond"),
            ),
            "level",
        )
        depth += 1
        levels.append(kids.withColumnRenamed("node", "parent_conv_id"))
        into = kids.where("going > 0").select("node", "id", F.col("conv_id").alias("child"), (F.col("going") == 1).alias("chain"), ((F.col("beyond") > DEEP) | (F.col("beyond") > local) & (F.col("beyond") <= LONG * F.col("going"))).alias("large"))
        dealt = cut(at.where(goes_on).join(into, ["node", "id"]).select("rep", F.col("child").alias("node"), "chain", "large"), "dealt")
        small.append(dealt.where("chain or not large").select("rep", "node", "chain", F.lit(depth).cast("long").alias("depth")))
        active = dealt.where("not chain and large").select("rep", "node")
        if active.isEmpty():
            break
    placed = small[0]
    for s in small[1:]:
        placed = placed.unionByName(s)
    deep = rows.join(placed, "rep").where("pos >= depth")
    one = Window.partitionBy("rep").orderBy(F.desc("pos"))
    chain = deep.where("chain")
    saving = chain.where("cnt > 1").withColumn("saved", (F.col("cnt") - 1) * F.sum("words").over(one)).unionByName(chain.where("cnt = 1").withColumn("saved", F.lit(0).cast("long")))
    first, last = F.col("pos") == F.col("depth"), F.col("pos") + 1 == F.col("n_turns")
    node = saving.select(
        F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(first, F.col("node")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("cnt").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(last, F.col("rep")).alias("end_rep"), F.lit(False).alias("top"),
    )
    below = cut(_finished(deep.where("not chain")).unionByName(node), "below")
    # what hangs below a node of the passes: the top row of a bucket, the first node of a chain, or nodes of the next pass
    tops = below.where("top").select("conv_id", "depth", "n_children", "n_leaves", "saved_tokens")
    starts = placed.where("chain").join(below.where("not top").select(F.col("conv_id").alias("rep"), F.col("depth").alias("d"), "saved_tokens"), "rep").where("d = depth + 1")
    tops = tops.unionByName(starts.select(F.col("node").alias("conv_id"), "depth", F.lit(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved_tokens"))
    tops = cut(tops, "tops")
    climbed: list[DataFrame] = []
    for d in range(depth, -1, -1):
        under = tops.where(F.col("depth") == d).drop("depth")
        if climbed:
            of_kids = climbed[-1].groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            under = under.unionByName(of_kids)
        own = (F.col("n_convs") - 1) * F.col("words")
        done = levels[d].join(under, "conv_id", "left").select(
            "conv_id", F.lit(d).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            (own + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"), "end_rep",
        )
        climbed.append(cut(done, "climbed"))
    nodes = below.where("not top").drop("top")
    for c in climbed:
        nodes = nodes.unionByName(c)
    drop(spark, rows, *levels[1:])
    # every node has a class of its own name, so no key is null: nodes at which nothing ends ask for that one and leave its digest
    ends = groups.select(F.col("rep").alias("asked"), "ends")
    found = nodes.withColumn("asked", F.coalesce("end_rep", "conv_id")).join(ends, "asked")
    digest = F.when(F.col("end_rep").isNotNull(), F.col("ends")).otherwise(F.sha2(F.lit(""), 256))
    return found.select(*NODE_COLUMNS[:-1], digest.alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = encode_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(*shared_starts(turns))


SQL = r"""WITH o AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, turn, role, sha256(strlen(role) || ':' || role || text) AS item, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM o),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, item) - 1 AS pos FROM i),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS start, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS later, pos, item, words FROM c JOIN t ON t.conv_id = c.start WHERE pos < h UNION ALL SELECT c.conv_id, 1, pos, item, words FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos >= h),
s AS (SELECT c.conv_id, COALESCE(list(item ORDER BY later, pos) FILTER (item IS NOT NULL), []) AS items, COALESCE(list(words ORDER BY later, pos) FILTER (item IS NOT NULL), []) AS words FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, d, array_to_string(items[1:d], ',') AS key, len(items) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words FROM (SELECT *, unnest(range(0, len(items) + 1)) AS d FROM s)),
n AS (SELECT d, key, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MAX(words) AS words, sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, key),
p AS (SELECT n.*, m.key AS parent_key, q.conv_id AS parent_conv_id FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.d = n.d - 1 LEFT JOIN n q ON q.d = m.d AND q.key = m.key),
k AS (SELECT d - 1 AS d, parent_key AS key, COUNT(*) AS n_children FROM p WHERE d > 0 GROUP BY 1, 2),
u AS (SELECT m.d, m.key, COUNT(*) FILTER (k.n_children IS NULL) AS n_leaves, SUM((n.n_convs - 1) * n.words) AS saved FROM n JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d LEFT JOIN k ON k.d = n.d AND k.key = n.key GROUP BY m.d, m.key)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, COALESCE(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM p LEFT JOIN k USING (d, key) JOIN u USING (d, key)"""
