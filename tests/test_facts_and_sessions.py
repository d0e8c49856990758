import random

import pytest
from hypothesis import given, settings, strategies as st
from naive import evaluate
from test_solve import FERRIES

from rulewright.errors import BadRowError, LimitExceeded, MissingRelationError, PoisonedSession, ReadFailed, StalePreviousError, UnknownRelationError
from rulewright.plans.analyse import analyse
from rulewright.plans.syntax import parse
from rulewright.sources import facts
from rulewright.streaming.session import Session, SolveCache, drive

PLAN = analyse(parse(".decl r(a: symbol, n: number) mutable\n.input r\n.decl s(a: symbol) mutable\n.input s\n.decl out(a: symbol, n: number)\nout(a, n) :- r(a, n), s(a).\n.output out"))


@given(st.lists(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=2, max_size=2)))
@settings(max_examples=60, deadline=None)
def test_fields_survive(rows):
    assert facts.decode_rows(facts.encode_rows(rows)) == rows


def test_bytes_and_unknown_escapes():
    assert facts.decode_field(facts.encode_field(b"\xff\\a")) == b"\xff\\a"
    assert facts.decode_field("\\q\\") == "\\q\\"


def test_escaped_bytes_are_read_and_written_alike(spark, tmp_path):
    values = [b"\xff\\a", "é".encode(), b"plain", b"\\x41", b"\xc3\xa9\xe2", b"tab\tand\xfe", b""]
    raw = [facts.encode_field(v).encode() for v in values] + [b"\\xC3\\xA9", b"\\x41\\\\x42\\q"]
    (tmp_path / "s.facts").write_bytes(b"".join(x + b"\n" for x in raw))
    df = facts.read_facts(spark, f"{tmp_path}/s.facts", PLAN, "s")
    own = lambda x: x.encode() if isinstance(x, str) else x
    want = sorted(own(facts.decode_field(x.decode())) for x in raw)
    assert sorted(bytes(r[0]) for r in df.selectExpr("cast(a as binary)").collect()) == want
    facts.write_facts_file(df, f"{tmp_path}/back.facts")
    assert sorted(own(facts.decode_field(x)) for x in (tmp_path / "back.facts").read_bytes().decode().split("\n")[:-1]) == want


def test_bad_rows():
    with pytest.raises(BadRowError, match="2 fields"):
        facts.parse_rows(PLAN, "s", "a\tb\n")
    for text in ("x\t 1\n", "x\t1.5\n", "x\t2147483648\n"):
        with pytest.raises(BadRowError):
            facts.parse_rows(PLAN, "r", text)
    assert facts.parse_rows(PLAN, "r", "x\t+7\n\t-1\n") == [("x", 7), ("", -1)]


def test_folders(spark, tmp_path):
    rows = [("a\tb", 1), ("", -5), ("\\t", 2), ("c\nd\r", 3)]
    (tmp_path / "r.facts").write_text(facts.encode_rows(rows), newline="")
    with pytest.raises(MissingRelationError):
        facts.read_facts_folder(spark, str(tmp_path), PLAN)
    (tmp_path / "s.facts").write_text("\n", newline="")
    got = facts.read_facts_folder(spark, str(tmp_path), PLAN)
    assert sorted(map(tuple, got["r"].collect())) == sorted(rows)
    assert [tuple(x) for x in got["s"].collect()] == [("",)]
    facts.write_facts_file(got["r"], f"{tmp_path}/back.facts")
    assert sorted(facts.decode_rows((tmp_path / "back.facts").read_bytes().decode())) == sorted([a, str(n)] for a, n in rows)
    (tmp_path / "r.facts").write_text("x\tten\n", newline="")
    with pytest.raises(Exception, match="isn't a number"):
        facts.read_facts_folder(spark, str(tmp_path), PLAN)["r"].collect()
    (tmp_path / "r.facts").write_text("x\n", newline="")
    with pytest.raises(Exception, match="not 2 fields"):
        facts.read_facts_folder(spark, str(tmp_path), PLAN)["r"].collect()


def frames(spark, plan, **rows):
    return {n: spark.createDataFrame(r, plan.schema(n)) for n, r in rows.items()}


def test_commits_retract_and_skip(spark):
    s = Session(spark, FERRIES)
    f = lambda **rows: frames(spark, s.plan, **rows)
    signed = lambda df: sorted(map(tuple, df.collect()))
    with pytest.raises(MissingRelationError):
        s.commit(f(leg=[]))
    first = s.commit(f(leg=[("Oban", "Mull"), ("Mull", "Iona"), ("Iona", "Oban")], shut=[], fare=[("Oban", 4)]))
    assert set(first.changed) == {"voyage", "sails", "cheapest", "round_trip"} and first.deltas["voyage"].count() == 9
    second = s.commit(f(leg=[("Oban", "Mull"), ("Mull", "Iona")]), previous=1)
    assert signed(second.deltas["round_trip"]) == [("Iona", -1), ("Mull", -1), ("Oban", -1)] and "cheapest" in second.skipped
    third = s.commit(f(shut=[("Iona",)]))
    assert set(third.changed) == {"sails"} and signed(third.deltas["sails"]) == [("Mull", "Iona", -1), ("Oban", "Iona", -1)]
    assert not s.commit(f(leg=[("Mull", "Iona"), ("Oban", "Mull"), ("Oban", "Mull")])).changed
    assert s.commit(f(shut=[("Iona",)]), rewrite=True).changed.keys() == {"voyage", "sails", "cheapest", "round_trip"}
    fifth = s.change({"leg": f(leg=[("Iona", "Coll"), ("Oban", "Mull")])["leg"]})
    assert signed(fifth.deltas["voyage"]) == [("Iona", "Coll", 1), ("Mull", "Coll", 1), ("Oban", "Coll", 1)]
    assert signed(s.change(removed={"leg": f(leg=[("Mull", "Iona"), ("Not", "there")])["leg"]}).deltas["voyage"]) == [("Mull", "Coll", -1), ("Mull", "Iona", -1), ("Oban", "Coll", -1), ("Oban", "Iona", -1)]
    with pytest.raises(StalePreviousError):
        s.commit({}, previous=1)
    with pytest.raises(UnknownRelationError):
        s.commit({"nothing": spark.range(1)})
    with pytest.raises(UnknownRelationError):
        s.result("leg")


def test_failed_commits_leave_nothing(spark, tmp_path):
    s = Session(spark, FERRIES)
    s.commit(frames(spark, s.plan, leg=[("a", "b")], shut=[], fare=[]))
    before = s.output_digests
    with pytest.raises(BadRowError):
        s.commit({"leg": spark.createDataFrame([("a", None)], "port string, next string")})
    gone = f"{tmp_path}/gone"
    spark.createDataFrame([("a", "c")], "port string, next string").write.parquet(gone)
    lost = spark.read.parquet(gone)
    import shutil

    shutil.rmtree(gone)
    with pytest.raises(ReadFailed):
        s.commit({"leg": lost})
    assert s.epoch == 1 and s.output_digests == before
    assert s.change({"leg": frames(spark, s.plan, leg=[("b", "c")])["leg"]}).epoch == 2 and s.result("voyage").count() == 3
    paths = [t.path.removeprefix("file:") for t in s.relations.tables().values()]
    s.close()
    import os

    assert paths and not any(os.path.exists(p) for p in paths)


def test_limits_poison(spark):
    text = ".decl e(x: number) mutable\n.input e\n.decl r(x: number, y: number)\nr(x, y) :- e(x), e(y).\n.limitsize r(n=10)\n.output r"
    s = Session(spark, text)
    s.commit(frames(spark, s.plan, e=[(1,)]))
    with pytest.raises(LimitExceeded):
        s.commit(frames(spark, s.plan, e=[(i,) for i in range(4)]))
    with pytest.raises(PoisonedSession):
        s.commit(frames(spark, s.plan, e=[(1,)]))


def test_kept_sessions_equal_fresh_ones(spark):
    rnd = random.Random(5)
    s, state, was = Session(spark, FERRIES), {"leg": set(), "shut": set(), "fare": set()}, {}
    port = lambda: rnd.choice("uvwxy")
    make = {"leg": lambda: (port(), port()), "shut": lambda: (port(),), "fare": lambda: (port(), rnd.randint(0, 3))}
    for k in range(7):
        pick = list(state) if not k else rnd.sample(list(state), rnd.randint(1, 2))
        rows = {n: {make[n]() for _ in range(rnd.randint(0, 6))} for n in pick}
        if k < 3:
            state |= rows
            done = s.commit(frames(spark, s.plan, **{n: list(rows[n]) for n in pick}))
        elif k % 2:
            state |= {n: state[n] | rows[n] for n in pick}
            done = s.change(frames(spark, s.plan, **{n: list(rows[n]) for n in pick}))
        else:
            rows = {n: set(sorted(state[n])[:2]) for n in pick}
            state |= {n: state[n] - rows[n] for n in pick}
            done = s.change(removed=frames(spark, s.plan, **{n: list(rows[n]) for n in pick}))
        want = evaluate(s.plan, state)
        assert {n: {tuple(r) for r in s.result(n).collect()} for n in want} == want
        for n in want:
            new, old = want[n], was.get(n, set())
            got = {tuple(r) for r in done.deltas[n].collect()} if n in done.deltas else set()
            assert got == {(*r, 1) for r in new - old} | {(*r, -1) for r in old - new}
        was = want


def test_solve_cache(spark):
    c, text = SolveCache(spark, most=1), ".decl e(x: number) mutable\n.input e\n.decl r(x: number)\nr(x + 1) :- e(x).\n.output r"
    one, two = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (1,), (1,)], "x int")
    assert c.solve(text, {"e": one})["r"].count() == c.solve(text, {"e": two})["r"].count() == 2
    assert c.hits == 1
    c.solve(text, {"e": spark.createDataFrame([(9,)], "x int")})
    assert len(c.known) == 1


def test_streams_drive_commits(spark, tmp_path):
    text = ".decl e(x: number, y: number) mutable\n.input e\n.decl r(x: number, y: number)\nr(x, y) :- e(x, y).\nr(x, z) :- r(x, y), e(y, z).\n.output r"
    s, seen = Session(spark, text), []
    for k in range(2):
        spark.createDataFrame([(k, k + 1)], "x int, y int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x int, y int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drive(stream, s, "e", f"{tmp_path}/state", lambda c: seen.append(c.epoch)).awaitTermination()
    assert seen == [1, 2] and {tuple(r) for r in s.result("r").collect()} == {(0, 1), (1, 2), (0, 2)}
