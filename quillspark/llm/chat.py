"""Chat formatting with minimum-cost role repair.

Legal conversations are an optional system turn and then user and assistant turns in alternation, ending with the
assistant. Each conversation is repaired by dynamic programming over that automaton: every
message keeps its role, is relabelled, or is merged into the turn before it, and empty turns are inserted where a
role is missing; the cheapest sequence is rendered.

Costs: ``RELABEL`` (an unknown role costs ``UNKNOWN``, since it must be given some role), ``MERGE``, ``INSERT``.
Equal costs go to the sequence with more kept messages: keeping before merging before inserting before relabelling,
user before assistant before system.

Defined results: messages stand in the order of turn (null first), role and text; exactly repeated rows count once;
a null text is an empty message; a null or unknown role is repaired; rows with a null conv_id belong to no
conversation and are left out; markers inside a text are escaped, so a rendered text can be read back
exactly; whole texts are rendered; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELABEL, UNKNOWN, MERGE, INSERT = 5, 2, 1, 3
ROLES = ("user", "assistant", "system")
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "agent": "assistant", "instruction": "system", "developer": "system"}
#: Last role so far -> roles that may follow.
NEXT = {"": ("user", "system"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("assistant",)
SCHEMA = "conv_id long, cost int, relabels int, merges int, insertions int, roles array<string>, rendered string"


def canonical(role: str | None) -> str | None:
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return r if r in ROLES else None


def as_role(role: str | None, target: str) -> int:
    return 0 if role == target else UNKNOWN if role is None else RELABEL


def _paths(state: str, target: str) -> list[str] | None:
    """Empty turns needed between ``state`` and a turn of ``target``: none, one, or None where it can't follow."""
    if target in NEXT[state]:
        return []
    for mid in NEXT[state]:
        if target in NEXT[mid]:
            return [mid]
    return None


def repair(roles: list[str | None]) -> tuple[int, list[tuple[str, list[int]]]]:
    """Cost and the turns (role, positions of the messages in it) of the cheapest legal sequence."""
    # state -> (cost, order of preference, link); a link is (earlier link, role of a new turn or None for a merge, message or None)
    best: dict[str, tuple[int, tuple, tuple | None]] = {"": (0, (), None)}
    for i, role in enumerate(roles):
        new: dict[str, tuple[int, tuple, tuple | None]] = {}

        def offer(state, cost, rank, link):
            if state not in new or (cost, rank) < new[state][:2]:
                new[state] = (cost, rank, link)

        for state, (cost, rank, link) in best.items():
            if state:
                own = as_role(role, state)
                offer(state, cost + MERGE + own, (rank[0] + 1 + 3 * (own > 0),) if rank else (1 + 3 * (own > 0),), (link, None, i))
            for k, target in enumerate(ROLES):
                gap = _paths(state, target)
                if gap is None:
                    continue
                own = as_role(role, target)
                at = link
                for mid in gap:
                    at = (at, mid, None)
                offer(target, cost + own + INSERT * len(gap), ((rank[0] if rank else 0) + 2 * len(gap) + (3 + k) * (own > 0),), (at, target, i))
        # only the last layer is kept: links share their tails
        best = new
    ends = []
    for state, (cost, rank, link) in best.items():
        if state in FINAL or not roles:
            ends.append((cost, rank, state, link))
        else:
            for end in FINAL:
                gap = _paths(state, end)
                if gap is not None:
                    at = link
                    for mid in gap + [end]:
                        at = (at, mid, None)
                    ends.append((cost + INSERT * (len(gap) + 1), rank, state, at))
    cost, _, _, link = min(ends, key=lambda e: e[:3])
    steps = []
    while link is not None:
        link, role, message = link
        steps.append((role, message))
    turns: list[tuple[str, list[int]]] = []
    for role, message in reversed(steps):
        if role is not None:
            turns.append((role, []))
        if message is not None:
            turns[-1][1].append(message)
    return cost, turns


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{escape(text)}<|end|>\n" for role, text in turns)


def _format(batches):
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for conv, messages in zip(b.column("conv_id").to_pylist(), b.column("m").to_pylist()):
            roles = [canonical(m["role"]) for m in messages]
            cost, turns = repair(roles)
            texts = [(role, "\n".join(messages[k]["text"] or "" for k in own)) for role, own in turns]
            changed = sum(roles[k] != role for role, own in turns for k in own)
            row = (conv, cost, changed, sum(max(0, len(own) - 1) for _, own in turns), sum(not own for _, own in turns), [r for r, _ in turns], render(texts))
            for col, x in zip(out, row):
                col.append(x)
        types = [pa.int64()] + [pa.int32()] * 4 + [pa.list_(pa.string()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["conv_id", "cost", "relabels", "merges", "insertions", "roles", "rendered"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its cheapest legal form, rendered, with what was changed."""
    m = F.struct("turn", "role", "text")
    return (
        conversations.where("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("long").alias("conv_id"), m.alias("m"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_set("m")).alias("m"))
        .mapInArrow(_format, SCHEMA)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
