import json

from rulewright.functions.ids import InstrId, parse_id
from rulewright.operators import cfg, findings as fi


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_representatives(spark):
    df = spark.createDataFrame([("B", "2"), ("A", "9"), ("A", "1")], "mod string, id string")
    assert tuples(fi.representatives(df, ["mod"])) == [("A", "1"), ("B", "2")]
    at = spark.createDataFrame([("A", "M:f/1#10"), ("A", "M:f/1#9")], "mod string, at string")
    assert tuples(fi.representatives(at, ["mod"], earliest="at")) == [("A", "M:f/1#9")]
    kinds = spark.createDataFrame([("x", "a", "1"), ("x", "b", "1"), ("y", "a", "1"), ("y", "b", "1")], "kind string, p string, q string")
    assert len(tuples(fi.representatives(kinds, ["p"], variants=("kind", {"y": ["q"]})))) == 3


def test_step_down_has_a_floor(spark):
    df = spark.createDataFrame([("critical",), ("low",), ("info",)], "s string")
    assert [r[0] for r in df.select(fi.step_down(df.s, 2, "low")).collect()] == ["medium", "low", "info"]


def test_builders_lose_one_row(spark):
    df = spark.createDataFrame([(1,), (0,)], "n long")
    good, bad = fi.build(df, lambda r: {"t": str(10 // r["n"])}, "t string")
    assert tuples(good) == [("10",)] and json.loads(bad.first()["row"]) == {"n": 0} and "ZeroDivision" in bad.first()["error"]


def test_reports_and_thresholds(spark):
    df = spark.createDataFrame([("a.ex", 3, "high", "Late"), (None, None, "low", "Odd")], "file string, line int, severity string, title string")
    assert sorted(r[0] for r in fi.to_text(df).collect()) == ["?: low: Odd", "a.ex:3: high: Late"]
    assert json.loads(fi.to_json(df).collect()[0][0])["title"] == "Late"
    assert fi.fails(df, above=1) and not fi.fails(df, above=2) and fi.fails(df, on="high") and not fi.fails(df, on="critical")


def test_ids():
    assert parse_id("Elixir.A:f/2#17") == InstrId("Elixir.A", "f", 2, 17)
    assert str(parse_id("m:f/0")) == "m:f/0"


def brute_dominators(succ, entry):
    def reach(without):
        seen, todo = set(), [entry] if entry != without else []
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [m for m in succ.get(n, ()) if m != without]
        return seen

    return {n: {d for d in reach(None) if d == n or n not in reach(d)} for n in reach(None)}


def test_dominators_by_brute_force():
    import random

    for seed in range(30):
        rnd = random.Random(seed)
        succ = {}
        for _ in range(14):
            succ.setdefault(rnd.randrange(8), set()).add(rnd.randrange(8))
        idom, want = cfg.immediate_dominators(succ, 0), brute_dominators(succ, 0)
        assert set(idom) == set(want)
        for n in idom:
            chain, x = {n}, n
            while idom[x] != x:
                x = idom[x]
                chain.add(x)
            assert chain == want[n]


def test_flow_of_a_loop(spark):
    code = spark.createDataFrame([("f", 0, "plain", None), ("f", 1, "branch", 4), ("f", 2, "plain", None), ("f", 3, "jump", 1), ("f", 4, "return", None)], "func string, at int, kind string, target int")
    flow = cfg.block_flow(code)
    assert {(r.src, r.dst, r.kind) for r in flow.collect()} == {(0, 1, "next"), (1, 4, "branch"), (1, 2, "next"), (2, 1, "jump")}
    entries = spark.createDataFrame([("f", 0), ("empty", 0)], "func string, entry int")
    assert tuples(cfg.dominators(flow, entries)) == [("f", 1, 0), ("f", 2, 1), ("f", 4, 1)]
    assert tuples(cfg.loop_headers(flow, entries)) == [("f", 1, 2)]
    assert ("f", 2, 1) in tuples(cfg.control_dependence(flow, entries))
    defs = spark.createDataFrame([("f", 0, 0, "x"), ("f", 2, 2, "x")], "func string, block long, at long, var string")
    uses = spark.createDataFrame([("f", 1, 1, "x"), ("f", 2, 3, "x")], "func string, block long, at long, var string")
    assert tuples(cfg.reaching_definitions(spark, flow, defs)) == [("f", 1, "x", 0), ("f", 1, "x", 2), ("f", 2, "x", 0), ("f", 2, "x", 2), ("f", 4, "x", 0), ("f", 4, "x", 2)]
    assert tuples(cfg.def_use(spark, flow, defs, uses)) == [("f", "x", 0, 1), ("f", "x", 2, 1), ("f", "x", 2, 3)]


def test_endless_loops_have_control_dependence(spark):
    edges = spark.createDataFrame([("f", 0, 1), ("f", 1, 1), ("f", 0, 2)], "func string, src int, dst int")
    out = tuples(cfg.control_dependence(edges, spark.createDataFrame([("f", 0)], "func string, entry int")))
    assert ("f", 1, 0) in out and ("f", 2, 0) in out
