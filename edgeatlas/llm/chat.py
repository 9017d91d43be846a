"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the assistant last. Each turn keeps or
changes its role, joins the turn before it or opens a new one, and empty turns may be put before it; costs are in ``COST``. The
cheapest repair is a shortest path through four states, so a stretch of turns is a 4 by 4 matrix of costs and stretches compose.
A long conversation is therefore dealt over tasks by turn: each task sums up its stretches, the few matrices of a
conversation decide every stretch's first and last state, and the stretches are then traced on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeatlas.llm.session import cut

ROLES = ("system", "user", "assistant")
#: Other spellings of the roles, in lower case.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: Costs: changing a known role, naming an unknown one, joining the turn before, an empty turn.
COST = {"relabel": 4, "name": 1, "merge": 2, "insert": 5}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
START = 3
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
FINAL = (2,)
FAR = 1 << 40


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest run of empty turns that leads from one state to another."""
    best = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (a, b), path in list(best.items()):
            for c in NEXT[b]:
                if (a, c) not in best or len(path) + 1 < len(best[a, c]):
                    best[a, c] = (*path, c)
    return best


INSERTS = _inserts()


def _moves() -> dict[tuple[int, int, int], tuple[int, bool, tuple[int, ...]]]:
    """(role or 3 if unknown, state before, state after) -> (cost, joined, empty turns put before); the cheapest, opening rather than joining."""
    out: dict[tuple[int, int, int], tuple[int, bool, tuple[int, ...]]] = {}
    for role, p, q in product(range(4), range(4), range(3)):
        label = 0 if role == q else COST["name"] if role == 3 else COST["relabel"]
        ways = [(label + COST["insert"] * len(path), False, path) for mid in range(4) if q in NEXT[mid] and (path := INSERTS.get((p, mid))) is not None]
        if p == q:
            ways.append((label + COST["merge"], True, ()))
        if ways:
            out[role, p, q] = min(ways)
    return out


MOVES = _moves()
TURN = np.full((4, 4, 4), FAR)
for (_r, _p, _q), (_c, _, _) in MOVES.items():
    TURN[_r, _p, _q] = _c
END = [COST["insert"] * min(len(INSERTS[s, f]) for f in FINAL if (s, f) in INSERTS) for s in range(3)] + [0]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def trace(roles: list[int], first: int, last: int | None = None) -> tuple[int, list[tuple[int, bool, tuple[int, ...]]]]:
    """Cheapest repair from state ``first`` to ``last`` (None: the end of the conversation): cost, and (role, joined, empties before) by turn. Ties: the lowest states."""
    cost, back = [FAR] * 4, []
    cost[first] = 0
    for r in roles:
        new, via = [FAR] * 4, [0] * 4
        for p, q in product(range(4), range(3)):
            if (move := MOVES.get((r, p, q))) and cost[p] + move[0] < new[q]:
                new[q], via[q] = cost[p] + move[0], p
        cost = new
        back.append(via)
    q = last if last is not None else min(range(4), key=lambda s: (cost[s] + END[s], s))
    total = cost[q] + (END[q] if last is None else 0)
    out = []
    for r, via in zip(reversed(roles), reversed(back), strict=True):
        p = via[q]
        _, joined, empties = MOVES[r, p, q]
        out.append((q, joined, empties))
        q = p
    return total, out[::-1]


def role_code(role: str | None) -> int:
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return ROLES.index(r) if r in ROLES else 3


def turns_repaired(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", partitions: int | None = None) -> DataFrame:
    """conv_id, stretch, pos, turn, role, text, new_role, joined, empties (roles put before), cost, last: one row per turn, in order of (stretch, pos).

    ``cost`` is the whole conversation's, ``last`` its last state. Turns go by turn number, then role and text; rows that
    repeat are turns of their own; null roles and unheard-of ones are unknown; null conv_ids form one conversation.
    """
    spark = turns.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    key = F.xxhash64("conv_id")
    dealt = t.withColumn("deal", key).repartitionByRange(n, "deal", "conv_id", "turn", "role", "text").sortWithinPartitions("deal", "conv_id", "turn", "role", "text").drop("deal")
    kind = turns.schema[conv_id].dataType.simpleString()
    tkind = turns.schema[turn].dataType.simpleString()

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, pos, m, held = object(), 0, None, None

        def emit(rows, closes):
            names = ["conv_id", "turn", "role", "text"]
            cols = rows.columns
            return pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in closes], pa.int64()), pa.array([x[1] for x in closes], pa.int32()), pa.array([x[2] for x in closes], pa.int32()), pa.array([x[3] for x in closes], pa.list_(pa.int64()))], names=[*names, "stretch", "pos", "code", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, codes = batch.column(0).to_pylist(), [role_code(r) for r in batch.column(2).to_pylist()]
            closes = []
            for i, (c, r) in enumerate(zip(ids, codes, strict=True)):
                if c != now or m is None:
                    if m is not None:
                        (closes if i else held[1])[-1][3] = m.reshape(-1).tolist()
                    now, pos, m = c, 0, np.where(np.eye(4, dtype=bool), 0, FAR)
                m = times(m, TURN[r])
                closes.append([part, pos, r, None])
                pos += 1
            if held:
                yield emit(*held)
            held = (batch, closes)
        if held:
            held[1][-1][3] = m.reshape(-1).tolist()
            yield emit(*held)

    rows = cut(dealt.mapInArrow(sum_up, f"conv_id {kind}, turn {tkind}, role string, text string, stretch long, pos int, code int, sums array<long>"), "turns")
    sums = rows.where("sums is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("stretch", "sums"))).alias("s"))  # a matrix per task at most

    @F.arrow_udf("struct<cost:long,last:int,ways:array<struct<stretch:long,first:int,final:int>>>")
    def decide(column: pa.Array) -> pa.Array:
        out = []
        for s in column.to_pylist():
            mats = [np.array(x["sums"]).reshape(4, 4) for x in s]
            cost = np.full(4, FAR)
            cost[START] = 0
            back = []
            for m in mats:
                all_ = cost[:, None] + m
                back.append(all_.argmin(0))
                cost = np.minimum(all_.min(0), FAR)
            q = min(range(4), key=lambda x: (cost[x] + END[x], x))
            total, last, ways = int(cost[q] + END[q]), q, []
            for x, via in zip(reversed(s), reversed(back), strict=True):
                ways.append({"stretch": x["stretch"], "first": int(via[q]), "final": int(q)})
                q = int(via[q])
            out.append({"cost": total, "last": int(last), "ways": ways})
        return pa.array(out, pa.struct([("cost", pa.int64()), ("last", pa.int32()), ("ways", pa.list_(pa.struct([("stretch", pa.int64()), ("first", pa.int32()), ("final", pa.int32())])))]))

    ways = sums.select(F.col("conv_id").alias("w_conv"), decide("s").alias("d")).select("w_conv", F.col("d.cost").alias("cost"), F.col("d.last").alias("last"), F.inline("d.ways")).withColumnRenamed("stretch", "w_stretch")
    stretches = rows.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("pos", "code", "turn", "role", "text"))).alias("t"))  # no larger than a task's share

    @F.arrow_udf("array<struct<new_role:int,joined:boolean,empties:array<int>>>")
    def follow(codes: pa.Array, first: pa.Array, final: pa.Array) -> pa.Array:
        out = [[{"new_role": q, "joined": j, "empties": list(e)} for q, j, e in trace(c, a, b)[1]] for c, a, b in zip(codes.to_pylist(), first.to_pylist(), final.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("new_role", pa.int32()), ("joined", pa.bool_()), ("empties", pa.list_(pa.int32()))])))

    j = stretches.join(ways, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("stretch") == F.col("w_stretch")))
    j = j.withColumn("r", follow(F.col("t.code"), F.col("first"), F.col("final")))
    return j.select("conv_id", "stretch", "cost", "last", F.explode(F.arrays_zip("t", "r")).alias("x")).select("conv_id", "stretch", "x.t.pos", "x.t.code", "x.t.turn", "x.t.role", "x.t.text", "x.r.new_role", "x.r.joined", "x.r.empties", "cost", "last")


def render(turns: DataFrame, **columns) -> DataFrame:
    """conv_id, n_turns, cost, n_merged, n_relabeled, n_inserted, rendered: one row per conversation.

    The rendered text of a conversation is one value, as any use of it needs; what is gathered for it is its own turns.
    """
    r = turns_repaired(turns, **columns)
    names = F.array(*[F.lit(x) for x in ROLES])
    opened = lambda q: F.concat(F.lit(OPEN), F.get(names, q), F.lit("\n"))
    text = F.coalesce("text", F.lit(""))
    empties = F.array_join(F.transform("empties", lambda q: F.concat(F.lit(CLOSE), opened(q))), "")
    piece = F.when(F.col("joined"), F.concat(F.lit("\n"), text)).otherwise(F.concat(empties, F.lit(CLOSE), opened(F.col("new_role")), text))
    tail = F.when(F.first("last") == 1, F.lit(1)).when(F.first("last") == 0, F.lit(2)).otherwise(F.lit(0))
    g = r.withColumn("piece", piece).groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.first("cost").alias("cost"),
        F.sum(F.col("joined").cast("long")).alias("n_merged"),
        F.sum((F.col("code") != F.col("new_role")).cast("long")).alias("n_relabeled"),
        (F.sum(F.size("empties")) + tail).cast("long").alias("n_inserted"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stretch", "pos", "piece"))), lambda x: x["piece"]), "").alias("body"),
        tail.alias("tail"),
    )
    end = F.when(F.col("tail") == 2, F.concat(F.lit(CLOSE), opened(F.lit(1)), F.lit(CLOSE), opened(F.lit(2)))).when(F.col("tail") == 1, F.concat(F.lit(CLOSE), opened(F.lit(2)))).otherwise("")
    whole = F.concat(F.expr(f"substring(body, {len(CLOSE) + 1})"), end, F.lit(CLOSE))
    return g.select("conv_id", "n_turns", "cost", "n_merged", "n_relabeled", "n_inserted", whole.alias("rendered"))


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    out = render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "n_turns", "cost", "n_merged", "n_relabeled", "n_inserted", F.length("rendered").cast("long").alias("rendered_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
