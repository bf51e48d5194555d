"""Chat formatting with role repair at least cost.

A legal conversation is an optional system message and then user and assistant messages in turn,
the assistant's last. Each turn keeps its role or takes another one (RELABEL, or GUESS where it has
none that is known), joins the message before it if that has the same role (MERGE), and where a
message is missing an empty one is put in (INSERT). Dynamic programming over the states of the
legal-turn automaton finds the repair of least cost.

Turns are sorted by conversation and turn over all tasks. A task repairs the conversations that it
has whole. Of those that reach over its edges it first tells only the least cost from each state to
each state, a 4 x 4 table; two tables a partition settle the states at the edges. So a
conversation of any length is shared out, and no group is gathered. The result has one row for each
turn; the rendered pieces of a conversation, in order, are its text.

Nulls: a null text is empty; a null role, like an unknown one, is guessed; null ids are one
conversation, and a null turn comes first. Equal turns are ordered by role and text. An empty table
gives an empty result. Very long texts are passed on whole. Other columns, whatever their names, are ignored.
A conversation may be longer than a task can hold, so it is never put together in one row: its text is its
turns' `rendered`, in the order of turn, role and text, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, partitions

MERGE, INSERT, RELABEL, GUESS = 1.0, 1.5, 2.0, 1.0
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
# Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT, "ai": ASSISTANT}
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"
#: Cost of what must be put in at the end, by state.
FINISH = np.array([0.0, 2 * INSERT, INSERT, 0.0])
#: Cost of a message of a role (column) after a state (row), without the turn's own.
STEP = np.array(
    [
        [np.inf, 0.0, 0.0, INSERT],
        [np.inf, MERGE, 0.0, INSERT],
        [np.inf, np.inf, MERGE, 0.0],
        [np.inf, np.inf, 0.0, MERGE],
    ]
)
RESULT = "conv_id long, turn long, role string, new_role string, action string, inserted int, cost double, rendered string"
RESULT_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.int32()), ("cost", pa.float64()), ("rendered", pa.string())]
)


def state_of(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), START)


def turn_cost(role: str | None) -> np.ndarray:
    """Cost of giving a turn each role."""
    known = state_of(role)
    out = np.full(4, RELABEL if known else GUESS)
    if known:
        out[known] = 0.0
    return out


def table(roles: list[str | None]) -> np.ndarray:
    """Least cost of the turns from each state to each state."""
    out = np.where(np.eye(4) > 0, 0.0, np.inf)
    for role in roles:
        out = (out[:, :, None] + (STEP + turn_cost(role))[None]).min(axis=1)
    return out


def repair(roles: list[str | None], entry: int = START, leave: int | None = None) -> tuple[list[int], float]:
    """Role of each turn, from the state before the first to the one after the last (any legal end if None)."""
    cost = np.full(4, np.inf)
    cost[entry] = 0.0
    back = np.zeros((len(roles), 4), np.int64)
    for i, role in enumerate(roles):
        ways = cost[:, None] + STEP + turn_cost(role)
        back[i] = ways.argmin(axis=0)
        cost = ways.min(axis=0)
    end = int((cost + FINISH).argmin()) if leave is None else leave
    total = float(cost[end] + (FINISH[end] if leave is None else 0))
    path = [end]
    for i in range(len(roles) - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return path[::-1] if roles else [], total


def rendered(turns: list[tuple[str | None, str | None]], path: list[int], entry: int, ends: bool) -> Iterator[tuple[str, int, float, str]]:
    """action, messages put in, cost and text of each turn."""
    before = entry
    for i, ((role, text), now) in enumerate(zip(turns, path, strict=True)):
        cost = float(STEP[before, now] + turn_cost(role)[now])
        actions = [] if state_of(role) == now else ["relabel"]
        out, added = "", 0
        if now == before:
            actions.append("merge")
            out = "\n"
        else:
            out = CLOSE if before != START else ""
            if now == ASSISTANT and before != USER:
                out, added = out + OPEN.format(NAMES[USER]) + CLOSE, 1
            out += OPEN.format(NAMES[now])
        out += text or ""
        if ends and i == len(turns) - 1:
            out += CLOSE
            cost += float(FINISH[now])
            for missing in (USER, ASSISTANT)[0 if now == SYSTEM else 1 :] if now != ASSISTANT else ():
                out, added = out + OPEN.format(NAMES[missing]) + CLOSE, added + 1
        yield "+".join((*actions, *(["insert"] if added else []))) or "keep", added, cost, out
        before = now


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[int | None, str | None, str | None]]]]:
    """Runs of turns of one conversation in a sorted partition."""
    now: tuple | None = None
    turns: list = []
    for batch in batches:
        for conv, *turn in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if now is not None and now[0] != conv:
                yield now[0], turns
                turns = []
            now = (conv,)
            turns.append(tuple(turn))
    if now is not None:
        yield now[0], turns


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, action, inserted, cost, rendered of each turn."""
    by = ("conv_id", "turn", "role", "text")
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = keep(given.repartitionByRange(partitions(conversations.sparkSession), *by).sortWithinPartitions(*by))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tables of a partition's first and last conversation."""
        edges: list = []
        for k, (conv, turns) in enumerate(_conversations(batches)):
            edges = [*edges[: min(k, 1)], (conv, turns)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part] * len(edges), pa.int32()),
                "place": pa.array(list(range(len(edges))), pa.int32()),
                "conv": pa.array([c for c, _ in edges], pa.int64()),
                "costs": pa.array([table([t[1] for t in turns]).ravel().tolist() for _, turns in edges], pa.list_(pa.float64())),
            }
        )

    edges = sorted(rows.mapInArrow(tell, "part int, place int, conv long, costs array<double>").collect())  # two a partition at most
    settled = _settle([(x.part, x.conv, np.array(x.costs).reshape(4, 4)) for x in edges])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        for conv, turns in _conversations(batches):
            entry, leave = settled.get((part, conv), (START, None))
            path, _ = repair([t[1] for t in turns], entry, leave)
            said = rendered([t[1:] for t in turns], path, entry, leave is None)
            out += [
                {"conv_id": conv, "turn": t[0], "role": t[1], "new_role": NAMES[now], "action": action, "inserted": added, "cost": cost, "rendered": text}
                for t, now, (action, added, cost, text) in zip(turns, path, said, strict=True)
            ]
            if len(out) > 5_000:
                yield pa.RecordBatch.from_pylist(out, RESULT_ARROW)
                out = []
        yield pa.RecordBatch.from_pylist(out, RESULT_ARROW)

    return rows.mapInArrow(work, RESULT)


def _settle(edges: list[tuple[int, int | None, np.ndarray]]) -> dict[tuple[int, int | None], tuple[int, int | None]]:
    """States before and after each piece of the conversations that reach over several partitions."""
    out: dict[tuple[int, int | None], tuple[int, int | None]] = {}
    k = 0
    while k < len(edges):
        last = k
        while last + 1 < len(edges) and edges[last + 1][1] == edges[k][1]:
            last += 1
        if last > k:
            cost, back = np.where(np.arange(4) == START, 0.0, np.inf), []
            for _, _, costs in edges[k : last + 1]:
                ways = cost[:, None] + costs
                back.append(ways.argmin(axis=0))
                cost = ways.min(axis=0)
            state: int = int((cost + FINISH).argmin())
            leave: int | None = None
            for i in range(last, k - 1, -1):
                before = int(back[i - k][state])
                out[edges[i][0], edges[i][1]] = (before, leave)
                state = leave = before
        k = last + 1
    return out
