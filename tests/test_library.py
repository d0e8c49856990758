import random

import pytest
from naive import evaluate

from rulewright.errors import ProgramError
from rulewright.operators import extract
from rulewright.operators.solve import solve
from rulewright.operators.staged import run_stages
from rulewright.operators.value_flow import flow_values, value_flow
from rulewright.plans import library
from rulewright.plans.analyse import analyse
from rulewright.plans.syntax import parse
from rulewright.sources import relations
from rulewright.sources.catalogue import FACTS, Catalogue, RelationSpec


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frames(spark, facts, names):
    return {n: FACTS.frame(spark, n, facts.get(n, [])) for n in names}


def heap(seed, functions=4, terms=5, rows=8):
    rng = random.Random(seed)
    f, t = (lambda: f"f{rng.randrange(functions)}"), (lambda: f"t{rng.randrange(terms)}")
    var = lambda: rng.choice([("term", t()), ("param", str(rng.randrange(2))), ("load", f"l{rng.randrange(4)}"), ("result", f"i{rng.randrange(4)}"), ("process", "p")])
    many = lambda make: sorted({make() for _ in range(rows)})
    return {
        "supervisor_child": [("s", 1, "m1", "permanent", "worker"), ("s", 2, "m2", "permanent", "worker")],
        "implements_behaviour": [("m1", ":gen_server"), ("m2", "Other")],
        "process_register_var": many(lambda: (f"i{rng.randrange(4)}", f(), f"n{rng.randrange(3)}", *var())),
        "table_allocation": many(lambda: (f"i{rng.randrange(4)}", f(), t())),
        "table_use": many(lambda: (f"i{rng.randrange(4)}", f(), *var())),
        "term_allocation": many(lambda: (f(), t(), "map", "", "1")),
        "process_start": [("i9", f(), "p", "spawn", "g")],
        "call_arg_var": many(lambda: (f"i{rng.randrange(4)}", f(), f(), str(rng.randrange(2)), "call", *var())),
        "call_result_var": many(lambda: (f"i{rng.randrange(4)}", f(), f())),
        "return_var": many(lambda: (f(), *var())),
        "field_load": many(lambda: (f(), f"l{rng.randrange(4)}", rng.choice("xy"), *var())),
        "field_store": many(lambda: (f(), t(), rng.choice("xyz"), *var())),
        "process_call_var": many(lambda: (f"i{rng.randrange(4)}", f(), "call", *var())),
    }


@pytest.mark.parametrize("seed", range(2))
def test_points_to_equals_the_plain_evaluator(spark, seed):
    facts, stage = heap(seed), library.points_to()
    for text in [stage.program, *stage.fallbacks][:: 2 - seed]:
        plan = analyse(parse(text))
        expected = evaluate(plan, {n: facts.get(n, []) for n in plan.inputs})
        got = solve(spark, plan, frames(spark, facts, plan.inputs))
        assert {n: set(map(tuple, df.collect())) for n, df in got.items()} == expected


def test_a_heap_over_its_budget_is_told_apart_less(spark):
    """callers x helpers objects meet in the fields of one helper's term."""
    facts = {
        "term_allocation": [(f"c{k}", f"o{k}", "map", "", "0") for k in range(6)] + [("h", f"b{k}", "map", "", "0") for k in range(5)],
        "call_arg_var": [(f"i{k}", f"c{k}", "h", "0", "call", "term", f"o{k}") for k in range(6)],
        "field_store": [("h", f"b{k}", "x", "param", "0") for k in range(5)],
        "field_load": [("h", "l", "x", "term", "b0")],
    }
    names = analyse(parse(library.points_to().program)).inputs
    mode = lambda budget: run_stages(spark, [library.points_to(budget)], frames(spark, facts, names))
    full = mode(30)
    assert tuples(full.outputs["points_to_mode"]) == [("full",)] and full.outputs["field_holds"].count() == 30 and not full.degraded
    merged = mode(29)
    assert tuples(merged.outputs["points_to_mode"]) == [("merged",)] and tuples(merged.outputs["field_holds"]) == [("h", "", f"o{k}") for k in range(6)]
    assert [s for s, _ in merged.degraded] == ["points_to"] * 2
    unread = facts | {"field_load": [("h", "l", "y", "term", "b0")]}
    kept = run_stages(spark, [library.points_to(29)], frames(spark, unread, names)).outputs
    assert tuples(kept["points_to_mode"]) == [("selective",)] and kept["field_holds"].count() == 0


def test_stages_have_no_budget_of_their_own():
    """Whatever the size of the facts, the stage that is asked for runs."""
    for stage in (library.points_to(), library.values()):
        assert not stage.fallbacks and not analyse(parse(stage.program)).limits
    assert analyse(parse(library.points_to(7).program)).limits == {"field_holds": 7} and analyse(parse(library.values(7).program)).limits == {"value": 7}


# What the stage means, with a place for each load.
INCLUSION = """
holds(f, "term", t, t) :- term_allocation(f, t, _, _, _).
holds(f, "process", p, p) :- process_start(_, f, p, _, _).
holds(f, "table", t, t) :- table_allocation(_, f, t).
holds(g, "param", n, o) :- call_arg_var(_, f, g, n, _, k, v), holds(f, k, v, o).
holds(f, "result", i, o) :- call_result_var(i, f, g), returns(g, o).
holds(f, "load", l, o) :- reads(f, l, t, x), field_holds(t, x, o).
returns(f, o) :- return_var(f, k, v), holds(f, k, v, o).
process(p) :- process_start(_, _, p, _, _).
named_pid(n, p) :- process_register_var(_, f, n, k, v), holds(f, k, v, p), process(p).
process_call(f, i, i, a, p) :- process_call_var(i, f, a, k, v), holds(f, k, v, p), process(p).
var_table(f, k, v, t) :- table_use(_, f, k, v), holds(f, k, v, t), table_allocation(_, _, t).
"""
FIELDS = [
    "reads(f, l, t, x) :- field_load(f, l, x, k, v), holds(f, k, v, t).\nfield_holds(t, x, o) :- field_store(f, t, x, k, v), holds(f, k, v, o).",
    "reads(f, l, t, x) :- field_load(f, l, x, k, v), holds(f, k, v, t).\nfield_holds(t, x, o) :- field_store(f, t, x, k, v), field_load(_, _, x, _, _), holds(f, k, v, o).",
    'reads(f, l, g, "") :- field_load(f, l, _, k, v), holds(f, k, v, t), term_allocation(g, t, _, _, _).\nfield_holds(g, "", o) :- field_store(f, t, _, k, v), term_allocation(g, t, _, _, _), holds(f, k, v, o).',
]


@pytest.mark.parametrize("mode", range(3))
def test_places_by_kind_hold_what_one_relation_of_places_does(mode):
    stage = library.points_to(10**6)
    plan = analyse(parse([stage.program, *stage.fallbacks][mode]))
    columns = {"reads": 4, "holds": 4, "returns": 2, "field_holds": 3, "process": 1, "named_pid": 2, "process_call": 5, "var_table": 4}
    declared = FACTS.declarations(sorted(n for n in plan.inputs if n not in ("supervisor_child", "implements_behaviour")))
    meant = analyse(parse(declared + "".join(f".decl {n}({', '.join(f'c{i}: symbol' for i in range(w))})\n.output {n}\n" for n, w in columns.items()) + INCLUSION + FIELDS[mode]))
    chained = 0
    for seed in range(12):
        facts = heap(seed, functions=3, rows=10) | {"supervisor_child": [], "implements_behaviour": []}
        got, expected = (evaluate(p, {n: facts.get(n, []) for n in p.inputs}) for p in (plan, meant))
        assert {n: got[n] for n in columns if n != "reads"} == {n: expected[n] for n in columns if n != "reads"}
        chained += sum(r[1] == "load" for r in expected["holds"])
    assert chained


@pytest.mark.parametrize("seed", range(2))
def test_fallbacks_of_a_budget_equal_the_plain_evaluator(spark, seed):
    facts, stage = heap(seed + 2), library.points_to(10**6)
    plan = analyse(parse(stage.fallbacks[seed]))
    expected = evaluate(plan, {n: facts.get(n, []) for n in plan.inputs})
    assert {n: set(map(tuple, df.collect())) for n, df in solve(spark, plan, frames(spark, facts, plan.inputs)).items()} == expected


@pytest.mark.parametrize("seed", range(2))
def test_values_equal_the_plain_evaluator(spark, seed):
    rng = random.Random(seed)
    f = lambda: f"f{rng.randrange(5)}"
    many = lambda make: sorted({make() for _ in range(8)})
    facts = {"function_def": [(f"f{k}", "m", "n", 1, int(k == 0)) for k in range(5)], "call_edge": many(lambda: (f(), f())), "call_arg": many(lambda: (f(), f(), rng.randrange(2), f"v{rng.randrange(3)}")), "call_arg_derived": many(lambda: (f(), f(), rng.randrange(2), rng.randrange(2)))}
    plan = analyse(parse(library.values().program))
    got = solve(spark, plan, frames(spark, facts, plan.inputs))
    assert {n: set(map(tuple, df.collect())) for n, df in got.items()} == evaluate(plan, facts)


def test_an_analysis_without_facts_costs_its_own_findings(spark):
    facts = frames(spark, {"sync_call": [("a:f/0", "b"), ("b:f/0", "a")], "function_def": [("a:f/0", "a", "f", 0, 1), ("b:f/0", "b", "f", 0, 1)]}, ["sync_call", "function_def"])
    done = extract.run_analyses(spark, [library.coverage(), library.waits(fan_in=1)], facts)
    assert [n for n, _ in done.degraded] == ["coverage"] and "MissingRelationError" in done.degraded[0][1]
    rows = {(r.title, r.anchor): r for r in done.findings.collect()}
    assert set(rows) == {("Call cycle", "a"), ("Bottleneck", "a"), ("Bottleneck", "b")}
    assert len(rows["Call cycle", "a"].related) == 2 and '"witness":"b:f/0"' in rows["Bottleneck", "a"].related[0]


def test_extractors_lose_one_module(spark):
    class Odd:
        name = "odd"

        def relations(self):
            return [RelationSpec("odd", (("n", "number"), ("text", "symbol")))]

        def candidate(self, module):
            return module["n"] != 4

        def extract(self, module):
            if module["n"] == 2:
                raise KeyError("two")
            return {"odd": [(module["n"], "a", "b")] if module["n"] == 3 else [(module["n"], "t")]}

    rows = extract.run_extractors(spark.range(1, 6).toDF("n"), [Odd()])
    assert tuples(extract.extracted(rows, Odd().relations()[0])) == [(1, "t"), (5, "t")]
    assert sorted(r.error.split(":")[0] for r in rows.filter("error is not null").collect()) == ["KeyError", "ValueError"]


def test_priors_answer_once_and_misses_give_no_row(spark):
    def classify(batch):
        assert not {"a"} & set(batch)
        if "bad" in batch:
            raise OSError
        return [(x.upper(),) if x != "none" else None for x in batch]

    items = spark.createDataFrame([("a",), ("b",), ("b",), ("none",)], "k string")
    known = spark.createDataFrame([("a", "kept"), ("z", "other")], "k string, answer string")
    assert tuples(extract.ask(items, "k", known, classify)) == [("a", "kept"), ("b", "B")]
    assert tuples(extract.ask(items.union(spark.createDataFrame([("bad",)], "k string")).coalesce(1), "k", known, classify, batch=10)) == [("a", "kept")]
    assert tuples(extract.ask(items, "k", known)) == [("a", "kept")]


def test_values_over_budget_are_any_value(spark):
    assert flow_values([("a", "b"), ("b", "a")], [("a", "1"), ("b", "2")], 2) == {"a": frozenset("12"), "b": frozenset("12")}
    assert flow_values([("a", "b"), ("b", "a")], [("a", "1"), ("b", "2")], 1) == {"a": None, "b": None}
    moves = spark.createDataFrame([("f", "a", "b"), ("g", "a", "b")], "func string, src string, dst string")
    seeds = spark.createDataFrame([("f", "a", "1"), ("g", "a", None)], "func string, var string, value string")
    assert tuples(value_flow(moves, seeds)) == [("f", "a", "1", True), ("f", "b", "1", True), ("g", "a", None, False), ("g", "b", None, False)]
    assert value_flow(moves.limit(0), seeds.limit(0)).count() == 0


def test_the_catalogue_declares_what_programs_read():
    c = Catalogue([RelationSpec("b", (("x", "instr_id"), ("n", "number"))), RelationSpec("a", (("x", "label"),)), RelationSpec("own", (("x", "symbol"),), in_process=True)])
    assert c.declarations() == ".decl a(x: symbol) mutable\n.input a\n.decl b(x: symbol, n: number) mutable\n.input b\n"
    assert c["b"].schema()["x"].metadata == {"kind": "instr_id"}
    for bad in (RelationSpec("a", (("x", "symbol"),)), RelationSpec("c", (("x", "text"),)), RelationSpec("c", (("x", "symbol"),), "none")):
        with pytest.raises(ProgramError):
            c.add(bad)
    with pytest.raises(ProgramError):
        c["c"]


def test_rows_by_name_and_by_page(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(5)], "n long, s string")
    assert tuples(relations.select_rows(df, {"s": "a", "n": [0, 1, 2]}, ["s"])) == [(0,), (2,)]
    with pytest.raises(ProgramError):
        relations.select_rows(df, {"t": 1})
    rows, more = relations.page(df, 2, 2)
    assert tuples(rows) == [(2, "a"), (3, "b")] and more
    assert not relations.page(df, 2, 3)[1] and relations.page(df, 2, 9)[0].count() == 0


def test_digests_follow_rows_and_not_files(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "string(id % 7) as s")
    for k, path in enumerate(("a", "b")):
        df.filter("id < 50").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{path}")
        df.filter("id >= 50").coalesce(1).sortWithinPartitions("id" if k else "s").write.mode("append").parquet(f"{tmp_path}/{path}")
    read = lambda p: spark.read.parquet(f"{tmp_path}/{p}")
    assert relations.relation_digest(read("a")) == relations.relation_digest(read("b")) and relations.chunk_digests(read("a")).count() == 2
    df.filter("id = 3").write.mode("append").parquet(f"{tmp_path}/b")
    assert relations.relation_digest(read("a")) != relations.relation_digest(read("b"))
    first = relations.publish(read("a"), f"{tmp_path}/store")
    assert relations.publish(df.orderBy("s"), f"{tmp_path}/store") == first != relations.publish(read("b"), f"{tmp_path}/store")
    assert spark.read.parquet(first).count() == 100


def test_a_relation_is_all_its_chunks(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([("r", list(x)) for x in xs], "relation string, fields array<string>")
    plan = analyse(parse(".decl r(x: symbol, n: number) mutable\n.input r\n.decl o(x: symbol)\no(x) :- r(x, _).\n.output o"))
    relations.write_by_relation(rows(("a\tb", "1")), f"{tmp_path}/f")
    relations.write_by_relation(rows(("", "-2"), ("c\\", "3")), f"{tmp_path}/f")
    assert tuples(relations.read_relation(spark, f"{tmp_path}/f", plan, "r")) == [("", -2), ("a\tb", 1), ("c\\", 3)]
    relations.write_by_relation(rows(("a", "x")), f"{tmp_path}/f")
    with pytest.raises(Exception, match="isn't a number"):
        relations.read_relation(spark, f"{tmp_path}/f", plan, "r").collect()


def test_rules_without_atoms_in_threads(spark):
    """Analyses run in threads, which have no active session of their own."""
    a = extract.Analysis("a", "", '.decl o(x: symbol, n: number)\no("b", strlen("abc")).\no("c", n) :- n = 1 + 1, n < 3.\n.output o', {"o": extract.Output("T", "low", "{n}", "x")})
    done = extract.run_analyses(spark, [a, a], {})
    assert tuples(done.findings.select("anchor", "detail")) == [("b", "3"), ("b", "3"), ("c", "2"), ("c", "2")] and not done.degraded


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    df = spark.range(500).selectExpr("cast(id * 37 % 500 as int) a", "cast(id % 3 as string) b").repartition(7)
    for limit, offset in ((10, 0), (10, 123), (200, 290), (10, 490), (10, 495), (5, 700)):
        monkeypatch.setattr(relations, "DEEP", 10**9)
        rows, more = relations.page(df, limit, offset)
        want = [tuple(r) for r in rows.collect()], more
        monkeypatch.setattr(relations, "DEEP", -1)
        rows, more = relations.page(df, limit, offset)
        assert ([tuple(r) for r in rows.collect()], more) == want == ([tuple(r) for r in df.orderBy("a", "b").collect()][offset : offset + limit], offset + limit < 500)


def test_findings_of_a_key_are_made_by_the_key(spark):
    """Two modules that register a name at several sites are one finding; it is made once, not once for each pair of sites."""
    sites = [(f"m{m}:f/0#{i}", f"m{m}:f/0", "n", "name") for m in range(3) for i in range(4)]
    facts = {"process_register": sites, "function_def": [(f"m{m}:f/0", f"m{m}", "f", 0, 1) for m in range(3)]}
    analysis = library.structure()
    parsed = parse(analysis.program)
    key = extract.by_key(parsed, "duplicate_process_name", analysis.outputs["duplicate_process_name"])
    plan = analyse(parsed, [key, "duplicate_process_name"])
    got = solve(spark, plan, frames(spark, facts, plan.inputs))
    assert tuples(got[key]) == [("n", f"m{a}", f"m{b}") for a in range(3) for b in range(a + 1, 3)]
    assert got["duplicate_process_name"].count() == 3 * 16
    done = extract.run_analyses(spark, [analysis], frames(spark, facts, plan.inputs | dict.fromkeys(analyse(parse(analysis.program)).inputs)))
    assert tuples(done.findings.select("anchor", "detail")) == [(f"m{a}", f"m{a} and m{b} both register n") for a in range(3) for b in range(a + 1, 3)] and not done.degraded
    assert extract.by_key(parse(analysis.program), "consumer_supervisor_permanent_child", analysis.outputs["consumer_supervisor_permanent_child"]) is None
