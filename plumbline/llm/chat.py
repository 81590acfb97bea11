"""Chat formatting with minimum-cost role repair.

Legal conversations are the language of an automaton: an optional system turn, then user and assistant turns in alternation, from a user to an assistant. A dynamic program over the turns and the
automaton's states finds the cheapest way to make a conversation legal: keep a turn (0), merge it with the one before (1), insert an empty turn (2), relabel a turn (3). The repaired turns are then
rendered. The program sees roles alone, so Python gets only arrays of roles, and texts are put together in the JVM.

Ties: of equally cheap repairs the one that, at the first turn where they differ, keeps before it merges, merges before it inserts, inserts before it relabels, and then the role first in system,
user, assistant. Roles are compared without case and outer space; an unknown or null role must be relabelled. A null text is empty. Turns are ordered by turn (null first), then role and text;
repeated turns are turns. Rows with a null conv_id are one conversation. In texts "<|" becomes "< |", so that no text forges a turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Which role may follow; "" is the beginning. A conversation may end after an assistant.
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
MERGE, INSERT, RELABEL = 1, 2, 3


def _shortest(state: str) -> tuple[tuple[str, ...], ...]:
    """The shortest row of inserted turns from a state to each other one, the empty row first."""
    found: dict[str, tuple[str, ...]] = {}
    todo: list[tuple[str, tuple[str, ...]]] = [(state, ())]
    while todo:
        at, path = todo.pop(0)
        if at in found and (path or at != state):
            continue
        found[at] = path
        todo += [(role, (*path, role)) for role in NEXT[at] if role not in found]
    return tuple(found.values())


_PATHS = {state: _shortest(state) for state in NEXT}

Step = tuple[tuple[str, ...], str, bool]  # inserted before, role of the turn, merged?


def repair(roles: tuple[str | None, ...]) -> tuple[int, tuple[tuple[str, tuple[int, ...]], ...]]:
    """The least cost, and the repaired turns: role and the places of the turns merged into it (none for an inserted one)."""
    known = [r if r in ROLES else None for r in ((r or "").strip().lower() for r in roles)]
    if not known:
        return 0, ()
    # backwards: least cost to finish from a state before turn t, with the choice that reaches it
    after = {s: (min(len(p) for p in _PATHS[s] if (p[-1] if p else s) == "assistant") * INSERT, ()) for s in NEXT}
    choices: list[dict[str, Step]] = []
    for role in reversed(known):
        now: dict[str, tuple[int, Step]] = {}
        for state in NEXT:
            best: tuple[tuple[int, int, int], Step] | None = None
            for to in ROLES:
                change = 0 if to == role else RELABEL
                options: list[tuple[int, int, Step]] = []
                if to == state:
                    options.append((MERGE, 1, ((), to, True)))
                for path in _PATHS[state]:
                    end = path[-1] if path else state
                    if to in NEXT[end]:
                        options.append((INSERT * len(path), 2 if path else 0, (path, to, False)))
                for cost, rank, step in options:
                    total = cost + change + after[to][0]
                    key = (total, rank + (4 if change else 0), ROLES.index(to))
                    if best is None or key < best[0]:
                        best = (key, step)
            now[state] = (best[0][0], best[1])
        choices.append({s: step for s, (_, step) in now.items()})
        after = {s: (cost, ()) for s, (cost, _) in now.items()}
    state, turns = "", []
    for k, choice in enumerate(reversed(choices)):
        inserted, role, merged = choice[state]
        turns += [(r, []) for r in inserted]
        if merged:
            turns[-1][1].append(k)
        else:
            turns.append((role, [k]))
        state = role
    tail = min((p for p in _PATHS[state] if (p[-1] if p else state) == "assistant"), key=len)
    turns += [(r, []) for r in tail]
    return after[""][0], tuple((r, tuple(k)) for r, k in turns)


_PLAN = "cost int, turns array<struct<role: string, src: array<int>>>"


def _plans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    known: dict[tuple, tuple] = {}
    for batch in batches:
        keys = [tuple(r) for r in batch]
        known.update({k: repair(k) for k in {*keys} - known.keys()})
        found = [known[k] for k in keys]
        if len(known) > 100_000:
            known = {}
        yield pd.DataFrame({"cost": [c for c, _ in found], "turns": [[{"role": r, "src": list(k)} for r, k in t] for _, t in found]})


def rendered(turns: Column, texts: Column) -> Column:
    """The turns in order, each between its marks."""
    body = lambda t: F.array_join(F.transform(t["src"], lambda i: F.get(texts, i)), "\n")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), body(t), F.lit("<|im_end|>\n"))), "")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, cost, roles, rendered) for each conversation."""
    plan = F.pandas_udf(_plans, _PLAN)
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
        F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"<\|", "< |").alias("text"),
    )
    whole = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    planned = whole.withColumn("p", plan(F.col("t.role")))
    return planned.select(
        "conv_id", F.size("t").alias("n_turns"), F.col("p.cost").alias("cost"), F.col("p.turns.role").alias("roles"), rendered(F.col("p.turns"), F.col("t.text")).alias("rendered")
    )
