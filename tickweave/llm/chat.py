"""Chat formatting: least-cost repair of role sequences over a legal-turn automaton, then rendering.

A conversation is repaired by dynamic programming over the states of the automaton. A turn acts on the cost vector as a matrix in
the (min, +) semiring, and matrices of following turns multiply. So a conversation is cut into blocks of turns: each block gives
its product, a conversation's blocks are joined by their few products, and every block is then traced back on its own, from the
state it is entered in to the state it is left in. A conversation of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ._store import small_batches, written

STATES = ("start", "system", "user", "assistant", "tool")
#: What may follow what; a conversation ends after an assistant's turn.
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
MERGE, RELABEL, GUESS, INSERT = 1.0, 2.0, 1.0, 3.0
#: Names that count as one of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "function": "tool"}
#: Turn numbers that one task repairs together; rows of one turn number beyond as many are cut into blocks of their own.
BLOCK = 2048
#: The block of rows without a turn number, before all others.
NO_TURN = -(1 << 62)
#: Conversations with such turn numbers are broadcast up to so many (some 100 bytes each), else joined by a shuffle.
MOST_BROADCAST = 100_000
#: Blocks whose products one batch takes.
BATCH = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _ways() -> dict[tuple[str, str], tuple[str, ...]]:
    """The fewest turns to insert between two states so that the second may follow; no entry for none."""
    out = {}
    for a in STATES:
        seen, layer = {a}, [((), a)]
        while layer:
            following = []
            for way, s in layer:
                for t in LEGAL[s]:
                    out.setdefault((a, t), way)
                    if t not in seen:
                        seen.add(t)
                        following.append(((*way, t), t))
            layer = following
    return out


WAYS = _ways()


def relabel(role: str | None, new: str) -> float:
    return GUESS if role not in STATES[1:] else 0.0 if role == new else RELABEL


def step(role: str | None, a: str, b: str) -> tuple[float, str]:
    """Cost and kind of going from state a to b by a turn of this role: a new turn, or merging it into the last one."""
    new = INSERT * len(WAYS[a, b]) + relabel(role, b) if (a, b) in WAYS else np.inf
    merge = MERGE + relabel(role, b) if a == b and a != "start" else np.inf
    return (merge, "merge") if merge < new else (new, "turn")


def matrix(role: str | None) -> np.ndarray:
    return np.array([[step(role, a, b)[0] for b in STATES] for a in STATES])


MATRICES = {r: matrix(r) for r in (*STATES[1:], None)}
#: Cost of ending in a state: turns inserted so that an assistant's is the last.
ENDS = {s: () if s in ("start", "assistant") else (*WAYS[s, "assistant"], "assistant") for s in STATES}
END_COST = np.array([INSERT * len(ENDS[s]) for s in STATES])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(1)


def trace(roles: list[str | None], entry: int, leave: int) -> list[int]:
    """The state after each turn on a least-cost way from one state to another; of equal ways that by the first states, from the end."""
    costs = [np.where(np.arange(len(STATES)) == entry, 0.0, np.inf)]
    for r in roles:
        costs.append((costs[-1][:, None] + MATRICES[r]).min(0))
    out, state = [], leave
    for k in range(len(roles) - 1, -1, -1):
        out.append(state)
        state = int(np.argmin(costs[k] + MATRICES[roles[k]][:, state]))
    return out[::-1]


def role_of(role: Column) -> Column:
    """The role's common name, or null if it is none."""
    name = F.lower(F.trim(role))
    for a, b in ALIASES.items():
        name = F.when(name == a, b).otherwise(name)
    return F.when(name.isin(*STATES[1:]), name)


def _segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal first columns, of batches sorted by them."""
    rows = (r for b in batches for r in b.to_pylist())
    names: list[str] = []

    def key(r: dict) -> tuple:
        if not names:
            names.extend(list(r)[:keys])
        return tuple(r[n] for n in names)

    yield from groupby(rows, key)


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with block, seg and part, which in this order are the order of the turns.

    A block is BLOCK turn numbers. A turn number with more than BLOCK rows is cut from it: ``seg`` counts the cuts up to a row, and
    ``part`` divides the turn's rows by ranges of their hashes, in the order of which they are taken.
    """
    block = F.when(F.col("turn").isNull(), F.lit(NO_TURN)).otherwise(F.floor(F.col("turn") / BLOCK)).cast("long")
    rows = rows.withColumn("block", block).withColumn("t", F.coalesce("turn", F.lit(0).cast("long")))
    many = rows.groupBy("conv_id", "block", "t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    hot = many.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b")).agg(F.sort_array(F.collect_list(F.struct("t", F.ceil(F.col("n") / BLOCK).alias("parts")))).alias("hot"))
    hot = written(hot, "chat-turns")
    count = hot.count()
    if not count:
        return rows.withColumn("seg", F.lit(0)).withColumn("part", F.lit(0).cast("long")).drop("t")
    own = F.get(F.filter("hot", lambda h: h["t"] == F.col("t")), F.lit(0))
    seg = 2 * F.size(F.filter("hot", lambda h: h["t"] < F.col("t"))) + F.when(F.col("own").isNotNull(), 1).otherwise(0)
    # The upper 31 bits of the hash, the smallest hash as 0.
    high = F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63))), 33)
    part = F.coalesce(F.floor(high * F.col("own.parts") / (1 << 31)), F.lit(0)).cast("long")
    met = rows.join(F.broadcast(hot) if count <= MOST_BROADCAST else hot, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").withColumn("own", own)
    return met.withColumn("seg", F.coalesce(seg, F.lit(0))).withColumn("part", part).drop("t", "hot", "own", "c", "b")


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per row of ``conversations`` with what the repair does to it.

    Columns: conv_id, turn, role (as given), new_role, action (keep, relabel, merge), before and after (roles of empty turns
    inserted ahead of it, and at the conversation's end), cost, rendered, block, seg, part and place. The rendered parts of a
    conversation, joined in the order of (block, seg, part, place), are its formatted text.

    Turns are taken in the order of turn number, nulls first; rows of the same number by a hash of role and text, so ties and
    repeated rows have a fixed order. Null or unknown roles are given one for a lower cost; null texts are empty turns. Rows
    without conv_id are one conversation. In a mark of the format inside a text the bar becomes a space. An empty table gives no
    rows; other columns are not read. A task holds a block: at most some BLOCK turn numbers, or a share of the rows of one; rows
    that are equal in all of conversation, turn number, role and text stay together. What joins a conversation's blocks is a
    matrix of 25 numbers a block.
    """
    spark = conversations.sparkSession
    ship(spark)
    small_batches(spark)
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = placed(rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("tie"), "role", role_of(F.col("role")).alias("known"), "text"))
    key = ["conv_id", "block", "seg", "part"]
    order = [*key, "turn", "tie"]
    n = spark.conf.get("spark.sql.shuffle.partitions")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
        out = []
        for spot, turns in _segments(batches, 4):
            m = None
            for r in turns:
                m = MATRICES[r["known"]] if m is None else times(m, MATRICES[r["known"]])
            out.append((*spot, m.ravel().tolist()))
            if len(out) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[*key, "m"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[*key, "m"])

    slim = rows.select(*order, "known").repartition(int(n), *key).sortWithinPartitions(*order)
    made = slim.mapInArrow(products, "conv_id long, block long, seg int, part long, m array<double>")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        names, out = ["c", "b", "s", "p", "entry", "leave", "last"], []
        for (conv,), parts in _segments(batches, 1):
            spots, mats, costs = [], [], [np.where(np.arange(len(STATES)) == 0, 0.0, np.inf)]
            for r in parts:
                spots.append((r["block"], r["seg"], r["part"]))
                mats.append(np.array(r["m"]).reshape(len(STATES), -1))
                costs.append((costs[-1][:, None] + mats[-1]).min(0))
            state = int(np.argmin(costs[-1] + END_COST))
            for k in range(len(spots) - 1, -1, -1):
                entry = int(np.argmin(costs[k] + mats[k][:, state]))
                out.append((conv, *spots[k], entry, state, k == len(spots) - 1))
                state = entry
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    bounds = made.repartition(int(n), "conv_id").sortWithinPartitions(*key).mapInArrow(joined, "c long, b long, s int, p long, entry int, leave int, last boolean")
    bounds = written(bounds, "chat-bounds")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("seg") == F.col("s")) & (F.col("part") == F.col("p"))
    met = rows.join(bounds, same).select(*key, "entry", "leave", "last", "turn", "tie", "role", "known", "text")
    met = met.repartition(int(n), *key).sortWithinPartitions(*order)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.string()]
        names = ["conv_id", "turn", "block", "seg", "part", "place", "role", "new_role", "action", "before", "after", "cost", "rendered"]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held) if held else [()] * 13, kinds)], names=names)
            held.clear()
            return out

        for (conv, blk, seg, part, entry, leave, last), turns in _segments(batches, 7):
            turns = list(turns)
            states = trace([r["known"] for r in turns], entry, leave)
            before = entry
            for k, (r, s) in enumerate(zip(turns, states)):
                a, b = STATES[before], STATES[s]
                cost, kind = step(r["known"], a, b)
                body = (r["text"] or "").replace("<|im_", "< im_")
                added = WAYS[a, b] if kind == "turn" else ()
                shown = "".join(f"{OPEN}{x}\n{CLOSE}\n" for x in added)
                shown = f"{'' if a == 'start' else CLOSE + chr(10)}{shown}{OPEN}{b}\n{body}" if kind == "turn" else f"\n{body}"
                after = ENDS[b] if last and k == len(turns) - 1 else ()
                if last and k == len(turns) - 1:
                    shown += f"{CLOSE}\n" + "".join(f"{OPEN}{x}\n{CLOSE}\n" for x in after)
                action = "merge" if kind == "merge" else "keep" if r["known"] == b else "relabel"
                held.append((conv, r["turn"], blk, seg, part, k, r["role"], b, action, list(added), list(after), cost + INSERT * len(after), shown))
                before = s
                if len(held) >= 2000:
                    yield batch()
        yield batch()

    return met.mapInArrow(parts, "conv_id long, turn long, block long, seg int, part long, place long, role string, new_role string, action string, before array<string>, after array<string>, cost double, rendered string")


def op1_chat(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
