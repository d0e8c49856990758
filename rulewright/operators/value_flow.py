"""Values that reach variables within each function, by a worklist over a lattice with a budget."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: More values than this in one variable are not told apart.
BUDGET = 16


def flow_values(moves: list[tuple], seeds: list[tuple], budget: int = BUDGET) -> dict:
    """For each variable a frozenset of values, or None for any value. moves: (from, to); seeds: (variable, value or None)."""
    to, state = defaultdict(list), {}
    for a, b in moves:
        to[a].append(b)

    def join(var, more) -> bool:
        was = state.get(var, frozenset())
        new = None if was is None or more is None or len(was | more) > budget else was | more
        state[var] = new
        return new != was

    todo = deque()
    for var, x in seeds:
        if join(var, None if x is None else frozenset([x])):
            todo.append(var)
    while todo:
        var = todo.popleft()
        for b in to[var]:
            if join(b, state[var]):
                todo.append(b)
    return state


def value_flow(moves: DataFrame, seeds: DataFrame, budget: int = BUDGET) -> DataFrame:
    """func, var, value, complete: the values that reach each variable; one row with a null value and complete false for any value.

    moves: func, src, dst. seeds: func, var, value (null: any value). A function is one group; what it keeps for a variable is bounded by budget.
    """
    none = F.lit(None).cast("string")
    rows = moves.select("func", F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), none.alias("value"), F.lit(True).alias("move"))
    rows = rows.unionAll(seeds.select("func", F.col("var").cast("string"), none, F.col("value").cast("string"), F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        moved, seeded = pdf[pdf["move"]], pdf[~pdf["move"]]
        state = flow_values(list(zip(moved["a"], moved["b"], strict=True)), [(v, None if pd.isna(x) else x) for v, x in zip(seeded["a"], seeded["value"], strict=True)], budget)
        f = pdf["func"].iloc[0]
        out = [(f, var, x, True) for var, xs in state.items() for x in xs or ()] + [(f, var, None, False) for var, xs in state.items() if xs is None]
        return pd.DataFrame(sorted(out, key=lambda r: (r[1], r[2] or "")), columns=["func", "var", "value", "complete"])

    return rows.groupBy("func").applyInPandas(run, "func string, var string, value string, complete boolean")
