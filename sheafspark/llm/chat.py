"""Operator 8: chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, an assistant's last.
Dynamic programming over that automaton chooses for each turn to keep it, merge it with the one before, relabel it or
put an empty turn before it, at the least total cost, and each turn is then rendered. Costs of a stretch of turns form
a states x states matrix, and such matrices compose, so a conversation is cut into chunks of CHUNK turn numbers that
separate tasks judge: first each chunk's matrix, then the states at its ends, then its turns. No task needs a whole
conversation, and the rendering comes as a piece a turn: in order, the pieces make up the conversation.

A null text is an empty one; a null or unknown role must be relabelled; a null turn comes last; turns with one number
go by role and text; a null conv_id is one conversation. Repeated rows are turns of their own. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm.common import stored, table

CHUNK = 64
#: States: the role of the last turn, or none yet.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Other names of roles, in lower case.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
MERGE, RELABEL, INSERT = 1, 2, 3
NEVER = 1 << 40
BEGIN, END = "<|{}|>\n", "<|end|>\n"


@cache
def steps(role: int) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """steps(role)[s][t]: (cost, action, role put before) of a turn of this role that leads from state s to t.

    role 0: unknown. Ties go to the first of keep, merge, insert.
    """
    out = []
    for s in range(4):
        row = []
        for t in range(4):
            label = 0 if role == t else RELABEL
            ways = [(NEVER, "", 0)]
            if t != START:
                if (s, t) in LEGAL:
                    ways.append((label, "keep" if not label else "relabel", 0))
                if s == t:
                    ways.append((MERGE + label, "merge", 0))
                ways += [(INSERT + label, "insert", x) for x in (SYSTEM, USER, ASSISTANT) if (s, x) in LEGAL and (x, t) in LEGAL]
            row.append(min(ways, key=lambda w: w[0]))
        out.append(tuple(row))
    return tuple(out)


@cache
def step_costs(role: int) -> np.ndarray:
    return np.array([[w[0] for w in row] for row in steps(role)], np.int64)


#: What ends a conversation in each state: the empty turns to add.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs through a, then b."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def chunk_matrix(roles: list[int]) -> np.ndarray:
    out = np.full((4, 4), NEVER)
    np.fill_diagonal(out, 0)
    for r in roles:
        out = composed(out, step_costs(r))
    return out


def path(matrices: list[np.ndarray], start: int, end: int | None) -> list[int]:
    """The states after each matrix on a cheapest way from start; end: the last state, None for the cheapest closing."""
    costs = np.full(4, NEVER)
    costs[start] = 0
    back = []
    for m in matrices:
        ways = costs[:, None] + m
        back.append(ways.argmin(axis=0))
        costs = np.minimum(ways.min(axis=0), NEVER)
    if end is None:
        end = int((costs + np.array([INSERT * len(CLOSING[s]) for s in range(4)])).argmin())
    out = [end]
    for b in reversed(back[1:]):
        out.append(int(b[out[-1]]))
    return out[::-1]


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches, 2):
        flat = chunk_matrix([r[2] for r in rows]).ravel().tolist()
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int64()), pa.array([rows[0][1]], pa.int64()), pa.array([flat], pa.list_(pa.int64()))], ["conv", "chunk", "costs"])


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation: the states at each of its chunks' ends."""
    for batch in batches:
        out = []
        for conv, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            states = path([np.array(c["costs"]).reshape(4, 4) for c in chunks], START, None)
            for i, (c, before, after) in enumerate(zip(chunks, [START, *states], states)):
                out.append((conv, c["chunk"], before, after, i == len(chunks) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()])], ["e_conv", "e_chunk", "before", "after", "last"])


_OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("piece", pa.string())])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, chunk, before, after, last, code, turn, role, text) in order: each turn's repair and rendering."""
    empty = lambda r: BEGIN.format(NAMES[r]) + END
    for rows in _grouped(batches, 2):
        _, chunk, before, after, last = rows[0][:5]
        states = path([step_costs(r[5]) for r in rows], before, after)
        out = []
        for i, (row, s, t) in enumerate(zip(rows, [before, *states], states)):
            _, action, put = steps(row[5])[s][t]
            head = "\n" if action == "merge" else (END if s != START else "") + (empty(put) if put else "") + BEGIN.format(NAMES[t])
            tail = END + "".join(map(empty, CLOSING[t])) if last and i == len(rows) - 1 else ""
            inserted = [NAMES[put]] * bool(put) + ([NAMES[x] for x in CLOSING[t]] if tail else [])
            out.append((row[0], row[6], i, row[7], NAMES[t], action, ",".join(inserted), head + (row[8] or "") + tail))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)


def _code(role: Column) -> Column:
    out = F.lit(START)
    for name, code in ALIASES.items():
        out = F.when(F.lower(F.btrim(role)) == name, code).otherwise(out)
    return out


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, turn, place (order among a chunk's turns), role, new_role, action, inserted (roles of empty turns put
    before it, or after it at the end), piece. By (turn nulls last, place), pieces concatenate to the conversation."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.col("turn").cast("long")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.floor(turn / CHUNK), F.lit((1 << 62))).cast("long").alias("chunk"), _code(F.col("role")).alias("code"), turn.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    order = ["conv", "chunk", F.col("turn").asc_nulls_last(), "role", "text"]
    matrices = rows.repartition(parts, "conv", "chunk").sortWithinPartitions(*order).select("conv", "chunk", "code").mapInArrow(_matrices, "conv long, chunk long, costs array<long>")
    ends = matrices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "costs"))).alias("chunks"))
    ends = stored(ends.mapInArrow(_ends, "e_conv long, e_chunk long, before int, after int, last boolean"))
    both = rows.join(ends, F.col("conv").eqNullSafe(F.col("e_conv")) & (F.col("chunk") == F.col("e_chunk")))
    placed = both.repartition(parts, "conv", "chunk").sortWithinPartitions(*order).select("conv", "chunk", "before", "after", "last", "code", "turn", "role", "text")
    return placed.mapInArrow(_pieces, "conv_id long, turn long, place long, role string, new_role string, action string, inserted string, piece string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
