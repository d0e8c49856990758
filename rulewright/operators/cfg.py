"""Control-flow graphs of many functions at once: blocks, dominators, control dependence, loops, reaching definitions.

A function's graph is small and is one group of its own, so each function is one call on an executor; functions are independent of each other.
Tables: edges(func, src, dst), entries(func, entry), code(func, at, kind, target), defs(func, block, at, var), uses likewise.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def immediate_dominators(succ: dict, entry) -> dict:
    """Each reachable node's immediate dominator (the entry's is itself), by iteration over reverse postorder."""
    order, seen, stack = [], {entry}, [(entry, iter(sorted(succ.get(entry, ()))))]
    while stack:
        node, children = stack[-1]
        for child in children:
            if child not in seen:
                seen.add(child)
                stack.append((child, iter(sorted(succ.get(child, ())))))
                break
        else:
            stack.pop()
            order.append(node)
    number = {n: i for i, n in enumerate(order)}
    pred = defaultdict(list)
    for n in order:
        for m in succ.get(n, ()):
            pred[m].append(n)
    idom = {entry: entry}
    changed = True
    while changed:
        changed = False
        for n in reversed(order):
            if n == entry:
                continue
            new = None
            for p in pred[n]:
                if p in idom:
                    if new is None:
                        new = p
                    a, b = p, new
                    while a != b:
                        while number[a] < number[b]:
                            a = idom[a]
                        while number[b] < number[a]:
                            b = idom[b]
                    new = a
            if idom.get(n) != new:
                idom[n], changed = new, True
    return idom


def _graph(pdf: pd.DataFrame) -> dict:
    succ = defaultdict(set)
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        if not pd.isna(a) and not pd.isna(b):
            succ[a].add(b)
    return succ


def _per_function(edges: DataFrame, entries: DataFrame, run, schema: str) -> DataFrame:
    """run(func, successors, entry) for each function with an entry."""
    both = edges.select("func", "src", "dst", F.lit(None).cast(edges.schema["src"].dataType).alias("entry")).unionByName(entries.select("func", F.lit(None).cast(edges.schema["src"].dataType).alias("src"), F.lit(None).cast(edges.schema["src"].dataType).alias("dst"), F.col("entry").cast(edges.schema["src"].dataType)))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = pdf["entry"].dropna()
        rows = run(pdf["func"].iloc[0], _graph(pdf), starts.iloc[0]) if len(starts) else []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return both.groupBy("func").applyInPandas(group, schema)


def _node(edges: DataFrame) -> str:
    return edges.schema["src"].dataType.simpleString()


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """func, node, idom of every node that the entry reaches but the entry itself."""
    kind = _node(edges)
    return _per_function(edges, entries, lambda f, succ, e: [(f, n, d) for n, d in immediate_dominators(succ, e).items() if n != e], f"func string, node {kind}, idom {kind}")


_EXIT = object()


def _post(succ: dict, entry) -> dict:
    """Immediate post-dominators; _EXIT follows every node without successors, and one of each endless loop."""
    nodes = set(succ) | {m for ms in succ.values() for m in ms} | {entry}
    back = defaultdict(set)
    for n in nodes:
        for m in succ.get(n, ()):
            back[m].add(n)
        if not succ.get(n):
            back[_EXIT].add(n)
    reach, todo = set(), list(back[_EXIT])
    while True:
        while todo:
            n = todo.pop()
            if n not in reach:
                reach.add(n)
                todo += back[n]
        rest = sorted(nodes - reach)
        if not rest:
            break
        back[_EXIT].add(rest[-1])
        todo = [rest[-1]]
    number = {n: i for i, n in enumerate(sorted(nodes))}
    names = sorted(nodes)
    ints = {number.get(k, -1): {number[m] for m in v} for k, v in back.items()}
    return {(names[n] if n >= 0 else _EXIT): (names[d] if d >= 0 else _EXIT) for n, d in immediate_dominators(ints, -1).items()}


def control_dependence(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """func, node, on: node runs or not by which way on goes."""
    kind = _node(edges)

    def run(func, succ, entry):
        post, out = _post(succ, entry), set()
        for a in list(succ):
            for b in succ[a]:
                runner = b
                while runner is not _EXIT and runner != post.get(a):
                    out.add((func, runner, a))
                    runner = post.get(runner, _EXIT)
        return sorted(out)

    return _per_function(edges, entries, run, f"func string, node {kind}, on {kind}")


def loop_headers(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """func, header, tail of every back edge: the header dominates the tail."""
    kind = _node(edges)

    def run(func, succ, entry):
        idom, out = immediate_dominators(succ, entry), []
        for a in idom:
            for b in succ.get(a, ()):
                x = a
                while x != b and idom[x] != x:
                    x = idom[x]
                if x == b:
                    out.append((func, b, a))
        return sorted(out)

    return _per_function(edges, entries, run, f"func string, header {kind}, tail {kind}")


def blocks(code: DataFrame) -> DataFrame:
    """func, at, block of every instruction: a block starts at the first instruction, at targets and after jumps.

    code: func, at, kind (plain, jump, branch or return), target (an at, or null).
    """
    targets = code.filter("target is not null").select("func", F.col("target").alias("at"), F.lit(True).alias("aimed")).distinct()
    w = Window.partitionBy("func").orderBy("at")
    led = code.join(targets, ["func", "at"], "left")
    leader = F.col("aimed").isNotNull() | F.coalesce(F.lag("kind").over(w) != "plain", F.lit(True))
    return led.withColumn("lead", leader).withColumn("block", F.last(F.when(F.col("lead"), F.col("at")), ignorenulls=True).over(w)).select("func", "at", "block")


def block_flow(code: DataFrame) -> DataFrame:
    """func, src, dst, kind (next, jump or branch) between blocks."""
    b = blocks(code)
    full = code.join(b, ["func", "at"])
    w = Window.partitionBy("func").orderBy("at")
    last = full.withColumns({"after": F.lead("block").over(w)}).filter("after is null or after <> block")
    falls = last.filter("kind in ('plain', 'branch') and after is not null").select("func", F.col("block").alias("src"), F.col("after").alias("dst"), F.lit("next").alias("kind"))
    jumps = last.filter("kind in ('jump', 'branch') and target is not null").select("func", F.col("block").alias("src"), F.col("target").alias("dst"), "kind")
    return falls.unionByName(jumps).distinct()


def site_blocks(code: DataFrame, sites: DataFrame) -> DataFrame:
    """func, at, kind, block of every site (func, at, kind); a block goes by its first instruction."""
    return sites.join(blocks(code), ["func", "at"]).select("func", "at", F.col("kind"), "block")


def conditional_sites(code: DataFrame, sites: DataFrame) -> DataFrame:
    """The rows of sites (func, at) that some completing path from the function's first instruction leaves out, or that no path reaches.

    A path completes at a return, or at an instruction after which nothing follows; one that ends in a raise doesn't. A function without
    completing paths has no conditional sites among those that are reached.
    """
    located = blocks(code)
    last = code.join(located, ["func", "at"]).withColumn("after", F.lead("at").over(Window.partitionBy("func").orderBy("at")))
    ends = last.filter("kind = 'return' or (kind <> 'raise' and kind <> 'jump' and after is null)").select("func", F.col("block").alias("src"), F.lit(-1).cast("long").alias("dst"))
    flow = block_flow(code).select("func", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).unionByName(ends)
    entries = located.groupBy("func").agg(F.min("block").cast("long").alias("entry"))
    alone = entries.select("func", F.col("entry").alias("src"), F.col("entry").alias("dst"))

    def run(func, succ, entry):
        idom = immediate_dominators(succ, entry)
        always, x = set(), -1
        while x in idom and idom[x] != x:
            x = idom[x]
            always.add(x)
        return sorted((func, b) for b in idom if b >= 0 and (b in always or -1 not in idom))

    sure = _per_function(flow.unionByName(alone).distinct(), entries, run, "func string, block long")
    return sites.join(located, ["func", "at"]).join(sure, ["func", "block"], "left_anti").select(*sites.columns)


def reaching_definitions(spark, edges: DataFrame, defs: DataFrame) -> DataFrame:
    """func, block, var, at: definitions that reach the start of a block, by rules: made last in a block, and killed nowhere on the way.

    defs: func, block, at, var. All functions run in one fixpoint.
    """
    from .solve import solve

    last = defs.groupBy("func", "block", "var").agg(F.max("at").alias("at"))
    program = """
.decl flow(func: symbol, src: long, dst: long) mutable
.input flow
.decl made(func: symbol, block: long, var: symbol, at: long) mutable
.input made
.decl kills(func: symbol, block: long, var: symbol)
kills(f, b, v) :- made(f, b, v, _).
.decl enters(func: symbol, block: long, var: symbol, at: long)
enters(f, c, v, i) :- made(f, b, v, i), flow(f, b, c).
enters(f, c, v, i) :- enters(f, b, v, i), !kills(f, b, v), flow(f, b, c).
.output enters
"""
    return solve(spark, program, {"flow": edges.select("func", "src", "dst"), "made": last.select("func", "block", "var", "at")}, nulls="drop")["enters"]


def def_use(spark, edges: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """func, var, def_at, use_at: the latest definition before the use in its block, else those that enter the block."""
    near = uses.alias("u").join(defs.alias("d"), ["func", "block", "var"]).filter("d.at < u.at").groupBy("func", "block", "var", F.col("u.at").alias("use_at")).agg(F.max("d.at").alias("def_at"))
    far = uses.withColumnRenamed("at", "use_at").join(near.select("func", "block", "var", "use_at"), ["func", "block", "var", "use_at"], "left_anti")
    entering = reaching_definitions(spark, edges, defs).withColumnRenamed("at", "def_at")
    cols = ["func", "var", "def_at", "use_at"]
    return near.select(*cols).unionByName(far.join(entering, ["func", "block", "var"]).select(*cols)).distinct()
