"""The registered queries: a program or operator over the supplied tables for each entry of the operator inventory, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulewright.operators import findings
from rulewright.operators.solve import solve
from rulewright.operators.staged import Stage, run_stages
from rulewright.plans.syntax import parse
from rulewright.streaming.session import Session, consolidate

PROGRAMS = Path(__file__).parent / "programs"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input relations over the tables: declaration, and how rows are made.
INPUTS: dict[str, tuple[str, Callable[[SparkSession, str], DataFrame]]] = {
    "nation": ("(key: number, name: symbol, region: number)", lambda s, d: table(s, d, "nation")),
    "region": ("(key: number, name: symbol)", lambda s, d: table(s, d, "region")),
    "customer": ("(key: long, name: symbol, nation: number, segment: symbol)", lambda s, d: table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")),
    "supplier": ("(key: long, name: symbol, nation: number)", lambda s, d: table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")),
    "part": ("(key: long, name: symbol, brand: symbol, kind: symbol, size: number)", lambda s, d: table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")),
    "orders": ("(key: long, customer: long, status: symbol, priority: symbol)", lambda s, d: table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")),
    "lineitem": ("(order: long, part: long, supplier: long, line: number, flag: symbol, status: symbol)", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")),
    "quantity": ("(order: long, line: number, n: number)", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int"))),
    "follows": ("(x: symbol, y: symbol)", lambda s, d: follows(s, d)),
    "chain": ("(x: number, y: number)", lambda s, d: chain(s, d)),
    "event": ("(id: long, user: long, kind: symbol)", lambda s, d: table(s, d, "events").select("event_id", "user_id", "event_type")),
}


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an event type and the next one of the same user: a small cyclic graph. Salted by time ranges it would still need users whole, so a window by user it is."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("x"), after.alias("y")).filter("y is not null").distinct()


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between nations: each to the nation 1 and 4 further on, an acyclic graph with long paths."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("x"))
    return n.select("x", F.explode(F.array(F.col("x") + 1, F.col("x") + 4)).alias("y")).filter("y < 25")


FOLLOWS_SQL = "follows AS (SELECT DISTINCT x, y FROM (SELECT event_type AS x, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events) WHERE y IS NOT NULL)"
CHAIN_SQL = "chain AS (SELECT n_nationkey AS x, n_nationkey + k AS y FROM nation, (VALUES (1), (4)) AS v(k) WHERE n_nationkey + k < 25)"


def program(inputs: str, rules: str) -> str:
    """Rules with the declarations of their inputs."""
    return "\n".join(f".decl {n}{INPUTS[n][0]} mutable\n.input {n}" for n in inputs.split()) + "\n" + rules


def register(name: str, inputs: str, rules: str, oracle: str | None, output: str = "out", root: Path | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = parse(program(inputs, rules), name, root)
        return solve(spark, parsed, {n: INPUTS[n][1](spark, sf_dir) for n in inputs.split()}, nulls="drop")[output]

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def query(name: str, oracle: str | None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


# Maps, filters and predicates.
register("q_map_filter", "lineitem", """
.decl out(order: long, line: number)
out(o, l) :- lineitem(o, _, _, l, f, _), l >= 3, f != "N".
.output out""", "SELECT DISTINCT l_orderkey AS \"order\", l_linenumber AS line FROM lineitem WHERE l_linenumber >= 3 AND l_returnflag <> 'N'")
register("q_const_arg", "lineitem", """
.decl out(part: long, supplier: long)
out(p, s) :- lineitem(_, p, s, 1, "R", _).
.output out""", "SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'")
register("q_repeated_var", "lineitem", """
.decl out(order: long, key: long)
out(o, k) :- lineitem(o, k, k, _, _, _).
.output out""", "SELECT DISTINCT l_orderkey AS \"order\", l_partkey AS key FROM lineitem WHERE l_partkey = l_suppkey")
register("q_disjunction", "customer orders", """
.decl out(key: long)
out(c) :- customer(c, _, n, s), (s = "BUILDING", n < 5 ; s = "MACHINERY", n >= 20 ; orders(_, c, "P", _)).
.output out""", "SELECT DISTINCT c_custkey AS key FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_nationkey < 5) OR (c_mktsegment = 'MACHINERY' AND c_nationkey >= 20) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
register("q_compare", "part", """
.decl out(key: long, brand: symbol)
out(k, b) :- part(k, n, b, t, s), s > 10, s <= 30, b < "Brand#4", t != n, k >= 20.
.output out""", "SELECT DISTINCT p_partkey AS key, p_brand AS brand FROM part WHERE p_size > 10 AND p_size <= 30 AND p_brand < 'Brand#4' AND p_type <> p_name AND p_partkey >= 20")
register("q_contains", "part", """
.decl out(name: symbol)
out(n) :- part(_, n, _, t, _), contains("a", n), !contains("ST", t).
.output out""", "SELECT DISTINCT p_name AS name FROM part WHERE contains(p_name, 'a') AND NOT contains(p_type, 'ST')")
register("q_match", "customer", """
.decl out(name: symbol, odd: symbol)
out(n, "end") :- customer(_, n, _, _), match(".*[02468]", n).
out(n, "none") :- customer(_, n, _, s), !match("[A-M].*", s), !match("(", n).
.output out""", "SELECT DISTINCT c_name AS name, 'end' AS odd FROM customer WHERE regexp_full_match(c_name, '.*[02468]') UNION SELECT DISTINCT c_name, 'none' FROM customer WHERE NOT regexp_full_match(c_mktsegment, '[A-M].*')")

# Joins.
register("q_join2", "customer orders", """
.decl out(name: symbol, order: long)
out(n, o) :- customer(c, n, _, _), orders(o, c, "F", _).
.output out""", "SELECT DISTINCT c_name AS name, o_orderkey AS \"order\" FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
register("q_join_multi", "region nation customer orders lineitem", """
.decl out(region: symbol, part: long)
out(r, p) :- region(k, r), nation(n, _, k), customer(c, _, n, _), orders(o, c, _, "1-URGENT"), lineitem(o, p, _, _, "R", _).
.output out""", "SELECT DISTINCT r_name AS region, l_partkey AS part FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R'")
register("q_theta", "supplier customer", """
.decl out(supplier: long, customer: long)
out(s, c) :- supplier(s, _, n), customer(c, _, n, _), s < c.
.output out""", "SELECT DISTINCT s_suppkey AS supplier, c_custkey AS customer FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_suppkey < c_custkey")
register("q_selfjoin", "nation", """
.decl out(a: symbol, b: symbol)
out(a, b) :- nation(x, a, r), nation(y, b, r), x < y.
.output out""", "SELECT DISTINCT p.n_name AS a, q.n_name AS b FROM nation p JOIN nation q ON p.n_regionkey = q.n_regionkey AND p.n_nationkey < q.n_nationkey")
register("q_cross", "region nation", """
.decl out(r: symbol, n: symbol)
out(r, n) :- region(_, r), nation(k, n, _), k < 3.
.output out""", "SELECT DISTINCT r_name AS r, n_name AS n FROM region, nation WHERE n_nationkey < 3")
register("q_match_column", "nation part", """
.decl out(size: number, n: symbol)
out(s, n) :- part(_, _, _, _, s), nation(_, n, _), match(cat("N.*_[0-9]*", to_string(s)), n).
out(0, n) :- nation(_, n, _), match(cat("(", n), n).
.output out""", "SELECT DISTINCT p_size AS size, n_name AS n FROM part, nation WHERE regexp_full_match(n_name, 'N.*_[0-9]*' || p_size)")
register("q_antijoin", "customer orders", """
.decl out(key: long, name: symbol)
out(c, n) :- customer(c, n, _, _), !orders(_, c, "P", _).
.output out""", "SELECT DISTINCT c_custkey AS key, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
register("q_antijoin_subset", "orders lineitem", """
.decl out(order: long)
out(o) :- orders(o, _, s, _), !lineitem(o, _, _, _, "R", _), s != "O".
.output out""", "SELECT DISTINCT o_orderkey AS \"order\" FROM orders WHERE o_orderstatus <> 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
register("q_gate", "nation region", """
.decl unknown(name: symbol)
unknown("ATLANTIS").
.decl out(n: symbol)
out(n) :- nation(_, n, _), !unknown("LEMURIA"), region(_, "ASIA").
out("never") :- nation(_, n, _), !unknown("ATLANTIS").
.output out""", "SELECT DISTINCT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')")
register("q_semijoin", "supplier lineitem", """
.decl out(key: long)
out(s) :- supplier(s, _, _), lineitem(_, _, s, 1, "A", _).
.output out""", "SELECT DISTINCT s_suppkey AS key FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A')")

# Aggregates.
register("q_count", "orders", """
.decl out(customer: long, n: number)
out(c, count(o)) :- orders(o, c, _, _).
.output out""", "SELECT o_custkey AS customer, CAST(count(DISTINCT o_orderkey) AS INTEGER) AS n FROM orders GROUP BY 1")
register("q_count_tuple", "lineitem", """
.decl out(flag: symbol, n: number)
out(f, count((p, s))) :- lineitem(_, p, s, _, f, _).
.output out""", "SELECT l_returnflag AS flag, CAST(count(DISTINCT (l_partkey, l_suppkey)) AS INTEGER) AS n FROM lineitem GROUP BY 1")
register("q_sum_distinct", "quantity", """
.decl out(order: long, n: number)
out(o, sum(q)) :- quantity(o, _, q).
.output out""", "SELECT l_orderkey AS \"order\", CAST(sum(DISTINCT CAST(l_quantity AS INTEGER)) AS INTEGER) AS n FROM lineitem GROUP BY 1")
register("q_min", "part", """
.decl out(brand: symbol, n: number)
out(b, min(s)) :- part(_, _, b, _, s).
.output out""", "SELECT p_brand AS brand, min(p_size) AS n FROM part GROUP BY 1")
register("q_max", "lineitem", """
.decl out(order: long, n: number)
out(o, max(l)) :- lineitem(o, _, _, l, _, _).
.output out""", "SELECT l_orderkey AS \"order\", max(l_linenumber) AS n FROM lineitem GROUP BY 1")
register("q_count_empty", "nation", """
.decl none(k: number)
none(k) :- nation(k, _, _), k < 0.
.decl counted(n: number)
counted(count(k)) :- none(k).
.decl summed(n: number)
summed(sum(k)) :- none(k).
.decl least(n: number)
least(min(k)) :- none(k).
.decl out(what: symbol, n: number)
out("count", n) :- counted(n).
out("sum", n) :- summed(n).
out("min", n) :- least(n).
.output out""", "SELECT 'count' AS what, 0 AS n UNION ALL SELECT 'sum', 0")
register("q_count_union", "orders customer", """
.decl out(nation: number, n: number)
out(n, count(c)) :- customer(c, _, n, "BUILDING").
out(n, count(c)) :- orders(_, c, "F", _), customer(c, _, n, _).
.output out""", "SELECT nation, CAST(count(DISTINCT c) AS INTEGER) AS n FROM (SELECT c_nationkey AS nation, c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT c_nationkey, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F') GROUP BY 1")
register("q_best_row", "quantity lineitem", """
.decl most(order: long, n: number)
most(o, max(q)) :- quantity(o, _, q).
.decl out(order: long, line: number, n: number)
out(o, l, q) :- most(o, q), quantity(o, l, q).
.output out""", "SELECT DISTINCT l_orderkey AS \"order\", l_linenumber AS line, CAST(l_quantity AS INTEGER) AS n FROM lineitem l WHERE CAST(l_quantity AS INTEGER) = (SELECT max(CAST(l_quantity AS INTEGER)) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey)")
register("q_unranked", "nation", """
.decl outranked(k: number)
outranked(x) :- nation(x, _, r), nation(y, _, r), y < x.
.decl out(region: number, name: symbol)
out(r, n) :- nation(k, n, r), !outranked(k).
.output out""", "SELECT n_regionkey AS region, n_name AS name FROM nation n WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey)")

# Set operations.
register("q_union", "customer supplier", """
.decl out(nation: number)
out(n) :- customer(_, _, n, _).
out(n) :- supplier(_, _, n).
.output out""", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
register("q_intersect", "customer supplier", """
.decl out(nation: number)
out(n) :- customer(_, _, n, "BUILDING"), supplier(_, _, n).
.output out""", "SELECT c_nationkey AS nation FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT s_nationkey FROM supplier")
register("q_difference", "lineitem", """
.decl accepted(part: long, supplier: long)
accepted(p, s) :- lineitem(_, p, s, _, "A", _).
.decl out(part: long, supplier: long)
out(p, s) :- lineitem(_, p, s, _, "R", _), !accepted(p, s).
.output out""", "SELECT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
register("q_input_and_rules", "follows", """
.decl out(x: symbol, y: symbol)
out(x, y) :- follows(x, y).
out(y, x) :- follows(x, y).
out("start", "stop").
.output out""", f"WITH {FOLLOWS_SQL} SELECT x, y FROM follows UNION SELECT y, x FROM follows UNION SELECT 'start', 'stop'")

# Scalar functions.
register("q_cat", "part", """
.decl out(s: symbol)
out(cat(cat(b, "/"), cat(t, to_string(s)))) :- part(_, _, b, t, s).
.output out""", "SELECT DISTINCT p_brand || '/' || p_type || CAST(p_size AS VARCHAR) AS s FROM part")
register("q_to_number", "part customer", """
.decl out(s: symbol, n: number)
out(b, to_number(substr(b, 6, 9))) :- part(_, _, b, _, _).
out(n, to_number(substr(n, 9, 99))) :- customer(_, n, _, _).
out("+7", to_number("+7")).
out(" 7 ", to_number(" 7 ")).
out("9999999999", to_number("9999999999")).
.output out""", "SELECT DISTINCT p_brand AS s, coalesce(CASE WHEN regexp_full_match(substr(p_brand, 7, 9), '[+-]?[0-9]+') THEN try_cast(substr(p_brand, 7, 9) AS INTEGER) END, 0) AS n FROM part UNION SELECT c_name, coalesce(CASE WHEN regexp_full_match(substr(c_name, 10, 99), '[+-]?[0-9]+') THEN try_cast(substr(c_name, 10, 99) AS INTEGER) END, 0) FROM customer UNION SELECT '+7', 7 UNION SELECT ' 7 ', 0 UNION SELECT '9999999999', 0")
register("q_strlen", "part", """
.decl out(name: symbol, n: number)
out(n, strlen(n)) :- part(_, n, _, _, _).
out("hé😀", strlen("hé😀")).
.output out""", "SELECT DISTINCT p_name AS name, CAST(length(p_name) AS INTEGER) AS n FROM part UNION SELECT 'hé😀', 3")
register("q_substr", "part", """
.decl out(a: symbol, b: symbol, c: symbol)
out(substr(t, 0, 3), substr(t, 2, -1), substr(t, -1, 2)) :- part(_, _, _, t, _).
.output out""", "SELECT DISTINCT substr(p_type, 1, 3) AS a, substr(p_type, 3) AS b, '' AS c FROM part")
register("q_arith_wrap", "part", """
.decl out(size: number, a: number, b: number, c: number)
out(s, s * 100000000, 2147483647 + s, -2147483648 - s) :- part(_, _, _, _, s).
.output out""", "SELECT DISTINCT p_size AS size, CAST(((CAST(p_size AS HUGEINT) * 100000000 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS a, CAST(((CAST(2147483647 AS HUGEINT) + p_size + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS b, CAST(((CAST(-2147483648 AS HUGEINT) - p_size + 2147483648 + 4294967296) % 4294967296) - 2147483648 AS INTEGER) AS c FROM part")
register("q_div_mod", "part", """
.decl out(size: number, a: number, b: number, c: number)
out(s, s / 7, s % 7, (0 - s) / 3) :- part(_, _, _, _, s).
.output out""", "SELECT DISTINCT p_size AS size, p_size // 7 AS a, p_size % 7 AS b, -(p_size // 3) AS c FROM part")
register("q_bits", "part", """
.decl out(size: number, a: number, b: number, c: number, d: number, e: number)
out(s, s band 12, s bor 3, s bxor 5, s bshl 3, s bshr 1) :- part(_, _, _, _, s).
.output out""", "SELECT DISTINCT p_size AS size, p_size & 12 AS a, p_size | 3 AS b, xor(p_size, 5) AS c, p_size << 3 AS d, p_size >> 1 AS e FROM part")
register("q_left_fold", "nation", """
.decl out(k: number, n: number)
out(k, 1 + k * 2 - 3) :- nation(k, _, _).
.output out""", "SELECT n_nationkey AS k, (1 + n_nationkey) * 2 - 3 AS n FROM nation")
register("q_tuple", "nation region", """
.type Place = (region: symbol, nation: symbol)
.decl at(key: number, place: Place)
at(k, (r, n)) :- nation(k, n, q), region(q, r).
.decl out(key: number, region: symbol, other: number)
out(k, r, j) :- at(k, p), p = (r, _), at(j, (r, m)), at(k, q), q = (_, n), n < m.
.output out""", "SELECT a.n_nationkey AS key, r_name AS region, b.n_nationkey AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name JOIN region ON r_regionkey = a.n_regionkey")

# Recursion.
register("q_tc", "follows", """
.decl out(x: symbol, y: symbol)
out(x, y) :- follows(x, y).
out(x, z) :- out(x, y), follows(y, z).
.output out""", f"WITH RECURSIVE {FOLLOWS_SQL}, r AS (SELECT x, y FROM follows UNION SELECT r.x, f.y FROM r JOIN follows f ON r.y = f.x) SELECT x, y FROM r")
register("q_tc_chain", "chain", """
.decl out(x: number, y: number)
out(x, y) :- chain(x, y).
out(x, z) :- chain(x, y), out(y, z).
.output out""", f"WITH RECURSIVE {CHAIN_SQL}, r AS (SELECT x, y FROM chain UNION SELECT r.x, c.y FROM r JOIN chain c ON r.y = c.x) SELECT x, y FROM r")
register("q_mutual", "chain", """
.decl odd(x: number, y: number)
.decl even(x: number, y: number)
odd(x, y) :- chain(x, y).
even(x, z) :- odd(x, y), chain(y, z).
odd(x, z) :- even(x, y), chain(y, z).
.decl out(x: number, y: number)
out(x, y) :- odd(x, y), even(x, y).
.output out""", f"WITH RECURSIVE {CHAIN_SQL}, r AS (SELECT x, y, 1 AS p FROM chain UNION SELECT r.x, c.y, 1 - p FROM r JOIN chain c ON r.y = c.x) SELECT x, y FROM r GROUP BY x, y HAVING count(*) = 2")
register("q_bounded", "chain", """
.decl out(x: number, y: number, d: number)
out(x, y, 1) :- chain(x, y), x < 3.
out(x, z, d + 1) :- out(x, y, d), d < 4, chain(y, z).
.output out""", f"WITH RECURSIVE {CHAIN_SQL}, r AS (SELECT x, y, 1 AS d FROM chain WHERE x < 3 UNION SELECT r.x, c.y, d + 1 FROM r JOIN chain c ON r.y = c.x WHERE d < 4) SELECT x, y, d FROM r")
register("q_nonlinear", "chain", """
.decl out(x: number, y: number)
out(x, y) :- chain(x, y), x >= 10.
out(x, z) :- out(x, y), out(y, z).
.output out""", f"WITH RECURSIVE {CHAIN_SQL}, c AS (SELECT * FROM chain WHERE x >= 10), r AS (SELECT x, y FROM c UNION SELECT r.x, c.y FROM r JOIN c ON r.y = c.x) SELECT x, y FROM r")
register("q_after_recursion", "chain", """
.decl reach(x: number, y: number)
reach(x, y) :- chain(x, y).
reach(x, z) :- reach(x, y), chain(y, z).
.decl out(x: number, n: number)
out(x, count(y)) :- reach(x, y), !chain(x, y).
.output out""", f"WITH RECURSIVE {CHAIN_SQL}, r AS (SELECT x, y FROM chain UNION SELECT r.x, c.y FROM r JOIN chain c ON r.y = c.x) SELECT x, CAST(count(*) AS INTEGER) AS n FROM (SELECT * FROM r EXCEPT SELECT * FROM chain) GROUP BY x")
register("q_reach_linked", "customer orders lineitem", """
.decl linked(a: long, b: long)
linked(c, p) :- orders(o, c, "P", _), lineitem(o, p, _, 1, _, _).
.decl found(c: long)
.decl shared(p: long)
found(c) :- customer(c, _, 3, "BUILDING").
shared(p) :- found(c), linked(c, p).
found(c) :- shared(p), linked(c, p).
.decl out(key: long)
out(c) :- found(c).
.output out""", "WITH RECURSIVE linked AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_linenumber = 1), f AS (SELECT c_custkey AS c FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' UNION SELECT b.c FROM f JOIN linked a ON a.c = f.c JOIN linked b ON a.p = b.p) SELECT c AS key FROM f")

_CALLS = """
.decl call_edge(x: symbol, y: symbol)
call_edge(to_string(x), to_string(y)) :- chain(x, y).
.decl runs_elsewhere(x: symbol, y: symbol)
runs_elsewhere(to_string(x), to_string(y)) :- chain(x, y), y = x + 4, x % 2 = 0.
.decl in_module(f: symbol, m: symbol)
in_module(to_string(k), to_string(k / 7)) :- nation(k, _, _).
.decl awaits_task(x: symbol, site: symbol, y: symbol)
awaits_task(to_string(x), "s", to_string(y)) :- chain(x, y), x = 8.
.decl call_site(x: symbol, y: symbol, site: symbol)
call_site(to_string(x), to_string(y), cat(to_string(x), cat(":", to_string(y)))) :- chain(x, y).
.decl handed(site: symbol, x: symbol, y: symbol)
handed("h", "2", "9").
handed("back", "24", "20").
runs_elsewhere("24", "20").
.decl argument(x: symbol, y: symbol, k: number, p: number)
argument(to_string(x), to_string(y), (x + y) % 3, x % 3) :- chain(x, y).
.decl argument_reads(x: symbol, y: symbol, k: number, p: symbol)
argument_reads(to_string(x), to_string(y), x % 2, "head") :- chain(x, y), x % 5 = 0.
.decl closure_def(x: symbol, y: symbol)
closure_def("3", "11").
.decl fun_ref(x: symbol, y: symbol)
fun_ref("5", "20").
.include "walks.dl"
.decl out(f: symbol)
.output out
"""
_STEP = f"{CHAIN_SQL}, e AS (SELECT CAST(x AS VARCHAR) AS x, CAST(y AS VARCHAR) AS y, x AS i, y AS j FROM chain)"
_UP = "r AS (SELECT '20' AS f UNION SELECT e.x FROM r JOIN e ON e.y = r.f WHERE {})"
_DOWN = "r AS (SELECT '2' AS f UNION SELECT e.y FROM r JOIN e ON e.x = r.f WHERE {})"
_SAME, _CUT = "NOT (j = i + 4 AND i % 2 = 0)", "NOT (x = '7' AND y = '8')"
_LOCAL = "i // 7 = j // 7"
for _form, _start, _walk in (("Up", 'w.seed("20", "20").\nout(f) :- w.reaches(f, "20").', _UP), ("UpSet", 'w.seed("20").\nout(f) :- w.reaches(f).', _UP), ("Down", 'w.root("2", "2").\nout(f) :- w.reaches("2", f).', _DOWN), ("DownSet", 'w.root("2").\nout(f) :- w.reaches(f).', _DOWN)):
    for _step, _cuts, _where in (("Plain", False, "true"), ("Kept", True, _CUT), ("Same", False, _SAME), ("SameKept", True, f"{_SAME} AND {_CUT}"), ("Holding", False, f"({_SAME} OR x = '8')"), ("Local", False, _LOCAL), ("LocalSame", False, f"{_LOCAL} AND {_SAME}"), ("LocalSameKept", True, f"{_LOCAL} AND {_SAME} AND {_CUT}"), ("LocalHolding", False, f"{_LOCAL} AND ({_SAME} OR x = '8')")):
        if _form in ("Up", "DownSet") or _step in ("Plain", "SameKept"):
            _cut = 'w.cut("7", "8").\n' if _cuts else ""
            register(f"q_walk_{_form}_{_step}".lower(), "chain nation", f"{_CALLS}.init w = {_form}{_step}\n{_cut}{_start}", f"WITH RECURSIVE {_STEP}, {_walk.format(_where)} SELECT f FROM r", root=PROGRAMS)
register("q_walk_within", "chain nation", f'{_CALLS}.init w = DownWithin\n.init v = UpWithin\nw.root("2", "2").\nv.root("20", "20").\nw.bound(3).\nv.bound(2).\nout(cat("down ", f)) :- w.reaches(_, f, _).\nout(cat("up ", f)) :- v.reaches(_, f, _).', f"WITH RECURSIVE {_STEP}, r AS (SELECT '2' AS f, 0 AS d UNION SELECT e.y, d + 1 FROM r JOIN e ON e.x = r.f WHERE d < 3), q AS (SELECT '20' AS f, 0 AS d UNION SELECT e.x, d + 1 FROM q JOIN e ON e.y = q.f WHERE d < 2) SELECT DISTINCT 'down ' || f AS f FROM r UNION SELECT 'up ' || f FROM q", root=PROGRAMS)
register("q_walk_unguarded", "chain nation", f'{_CALLS}.init w = UpUnguarded\n.init v = DownUnguarded\nw.seed("20", "20").\nw.guarded("16:20").\nv.root("2", "k").\nv.guarded("2:3", "k").\nv.guarded("7:8", "other").\nout(cat("up ", f)) :- w.reaches(f, _).\nout(cat("down ", f)) :- v.reaches(f, "k").', f"WITH RECURSIVE {_STEP}, s AS (SELECT x, y FROM e WHERE NOT (x = '16' AND y = '20') UNION SELECT '2', '9' UNION SELECT '24', '20'), o AS (SELECT x, y FROM e WHERE NOT (x = '2' AND y = '3') UNION SELECT '3', '11' UNION SELECT '5', '20'), u AS (SELECT '20' AS f UNION SELECT s.x FROM u JOIN s ON s.y = u.f), d AS (SELECT '2' AS f UNION SELECT o.y FROM d JOIN o ON o.x = d.f) SELECT 'up ' || f AS f FROM u UNION SELECT 'down ' || f FROM d", root=PROGRAMS)

register("q_walk_unguarded_same", "chain nation", f'{_CALLS}.init w = UpUnguardedSame\nw.seed("20", "20").\nw.guarded("16:20").\nw.guarded("7:8").\nw.guarded("4:8").\nout(f) :- w.reaches(f, _).', f"WITH RECURSIVE {_STEP}, s AS (SELECT x, y FROM e WHERE x || ':' || y NOT IN ('16:20', '7:8', '4:8') UNION SELECT '2', '9'), u AS (SELECT '20' AS f UNION SELECT s.x FROM u JOIN s ON s.y = u.f) SELECT f FROM u", root=PROGRAMS)
register("q_walk_parameter", "chain nation", f'{_CALLS}.init w = UpParameter\nw.seed("20", 0, "20").\nout(cat(f, cat(":", to_string(p)))) :- w.reaches(f, p, _).', f"WITH RECURSIVE {_STEP}, r AS (SELECT 20 AS f, 0 AS p UNION SELECT e.i, e.i % 3 FROM r JOIN e ON e.j = r.f AND (e.i + e.j) % 3 = r.p) SELECT f || ':' || p AS f FROM r", root=PROGRAMS)
register("q_walk_parameter_read", "chain nation", f'{_CALLS}.init w = UpParameterRead\nw.seed("20", "0", "20").\nout(cat(f, cat(":", p))) :- w.reaches(f, p, _).', f"WITH RECURSIVE {_STEP}, a AS (SELECT i, j, CAST((i + j) % 3 AS VARCHAR) AS k, CAST(i % 3 AS VARCHAR) AS p FROM e UNION SELECT i, j, CAST(i % 2 AS VARCHAR), 'head' FROM e WHERE i % 5 = 0), r AS (SELECT 20 AS f, '0' AS p UNION SELECT a.i, a.p FROM r JOIN a ON a.j = r.f AND a.k = r.p) SELECT f || ':' || p AS f FROM r", root=PROGRAMS)

# Components and stages.
register("q_component", "follows chain", """
.comp Closure {
  .decl link(x: symbol, y: symbol)
  .decl reach(x: symbol, y: symbol)
  reach(x, y) :- link(x, y).
  reach(x, z) :- reach(x, y), link(y, z).
}
.init e = Closure
.init n = Closure
e.link(x, y) :- follows(x, y).
n.link(to_string(x), to_string(y)) :- chain(x, y), x > 15.
.decl out(x: symbol, y: symbol)
out(x, y) :- e.reach(x, y).
out(x, y) :- n.reach(x, y).
.output out""", f"WITH RECURSIVE {FOLLOWS_SQL}, {CHAIN_SQL}, l AS (SELECT x, y FROM follows UNION SELECT CAST(x AS VARCHAR), CAST(y AS VARCHAR) FROM chain WHERE x > 15), r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x) SELECT x, y FROM r")
register("q_component_inherit", "chain", """
.comp Linked { .decl link(x: number, y: number)
  link(x, y) :- chain(x, y). }
.comp Both : Linked { .decl both(x: number, y: number)
  link(y, x) :- chain(x, y), x < 4.
  .init inner = Looped
  inner.start(x) :- link(x, x + 1).
  both(x, y) :- link(x, y), inner.start(x). }
.comp Looped { .decl start(x: number) }
.init b = Both
.decl out(x: number, y: number)
out(x, y) :- b.both(x, y).
.output out""", f"WITH {CHAIN_SQL}, l AS (SELECT x, y FROM chain UNION SELECT y, x FROM chain WHERE x < 4) SELECT x, y FROM l WHERE x IN (SELECT x FROM l WHERE y = x + 1)")


@query("q_stage", f"WITH RECURSIVE {CHAIN_SQL}, r AS (SELECT x, y FROM chain UNION SELECT r.x, c.y FROM r JOIN chain c ON r.y = c.x) SELECT x, CAST(count(*) AS INTEGER) AS n, 'direct' AS kind FROM chain GROUP BY x")
def q_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = program("chain", ".decl reach(x: number, y: number)\nreach(x, y) :- chain(x, y).\nreach(x, z) :- reach(x, y), chain(y, z).\n.limitsize reach(n=100)\n.decl kind(k: symbol)\nkind(\"full\").\n.output reach\n.output kind")
    plain = program("chain", ".decl reach(x: number, y: number)\nreach(x, y) :- chain(x, y).\n.decl kind(k: symbol)\nkind(\"direct\").\n.output reach\n.output kind")
    count = ".decl reach(x: number, y: number) mutable\n.input reach\n.decl kind(k: symbol) mutable\n.input kind\n.decl out(x: number, n: number, kind: symbol)\nout(x, count(y), k) :- reach(x, y), kind(k).\n.output out"
    return run_stages(spark, [Stage("reach", full, [plain]), Stage("count", count)], {"chain": chain(spark, sf_dir)}, nulls="drop").outputs["out"]


# Commits.
_COMMITS = program("orders customer", """
.decl busy(c: long)
busy(c) :- orders(_, c, "F", _).
.decl out(c: long, name: symbol)
out(c, n) :- customer(c, n, _, _), !busy(c).
.output out""")
_FINAL = "SELECT c_custkey AS c, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND {})"


def _committed(spark: SparkSession, sf_dir: str, states: list[str]):
    session = Session(spark, _COMMITS, nulls="drop")
    orders, customer = INPUTS["orders"][1](spark, sf_dir), INPUTS["customer"][1](spark, sf_dir)
    last = session.commit({"orders": orders.filter(states[0]), "customer": customer})
    for state in states[1:]:
        last = session.commit({"orders": orders.filter(state)})
    return session, last


@query("q_commit", _FINAL.format("o_orderpriority >= '2'"))
def q_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, sf_dir, ["o_orderpriority < '4'", "o_orderpriority >= '2'"])[0].result("out")


_OLD, _NEW = _FINAL.format("o_orderpriority < '4'"), _FINAL.format("o_orderpriority >= '2'")
_DELTA = f"SELECT *, CAST(-1 AS INTEGER) AS __diff FROM (({_OLD}) EXCEPT ({_NEW})) UNION ALL SELECT *, 1 FROM (({_NEW}) EXCEPT ({_OLD}))"


@query("q_commit_delta", _DELTA)
def q_commit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, sf_dir, ["o_orderpriority < '4'", "o_orderpriority >= '2'"])[1].deltas["out"]


@query("q_commit_retract", _FINAL.format("o_orderpriority < '3'"))
def q_commit_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, sf_dir, ["true", "o_orderpriority < '3'"])[0].result("out")


@query("q_consolidate", "SELECT o_custkey AS c, CAST(sum(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END) AS INTEGER) AS __diff FROM orders GROUP BY 1 HAVING sum(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END) <> 0")
def q_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return consolidate(o.select(F.col("o_custkey").alias("c"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0).alias("__diff")))


# Findings.
@query("q_dedupe_key", "SELECT p_partkey, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_name) AS n FROM part) WHERE n = 1")
def q_dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.representatives(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), ["p_brand"])


@query("q_evidence_limit", "SELECT c_custkey, coalesce(k, '') AS orders FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3 GROUP BY 1) ON o_custkey = c_custkey")
def q_evidence_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    out = findings.with_evidence(c, o, [("c_custkey", "o_custkey")], 3, ["o_orderkey"])
    return out.select("c_custkey", F.array_join(F.transform("related", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


def _orders_as_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    severity = F.element_at(F.array(*map(F.lit, findings.SEVERITIES)), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select("o_orderkey", "o_orderdate", F.col("o_custkey").cast("string").alias("module"), F.col("o_orderstatus").alias("analysis"), F.col("o_orderpriority").alias("title"), severity.alias("severity"), F.lit("high").alias("confidence"))


@query("q_retier", """WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS module, CASE WHEN c_nationkey < 5 THEN 'structural' ELSE 'prior' END AS basis, CASE WHEN c_nationkey < 5 THEN 'medium' ELSE 'low' END AS c FROM customer WHERE c_mktsegment = 'BUILDING'),
f AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS module, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS s FROM orders)
SELECT o_orderkey, (['info', 'low', 'medium', 'high', 'critical'])[CASE WHEN t.module IS NULL THEN s ELSE greatest(s - 1, least(2, s)) END] AS severity, coalesce(c, 'high') AS confidence, basis FROM f LEFT JOIN t USING (module)""")
def q_retier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    own = F.col("c_nationkey") < 5
    tooling = c.select(F.col("c_custkey").cast("string").alias("module"), F.when(own, "structural").otherwise("prior").alias("basis"), F.when(own, "medium").otherwise("low").alias("confidence"))
    return findings.retier(_orders_as_findings(spark, sf_dir), tooling, floor="low").select("o_orderkey", "severity", "confidence", "basis")


_BASELINE = "WITH n AS (SELECT o_orderstatus AS analysis, o_orderpriority AS title, 1 AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' UNION ALL SELECT o_orderstatus, o_orderpriority, -1 FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), s AS (SELECT analysis, title, sum(d) AS d FROM n GROUP BY 1, 2 HAVING sum(d) <> 0) SELECT analysis, title, CAST(greatest(d, 0) AS BIGINT) AS added, CAST(greatest(-d, 0) AS BIGINT) AS removed FROM s"


@query("q_baseline_diff", _BASELINE)
def q_baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _orders_as_findings(spark, sf_dir)
    new, old = (f.filter(c).select("analysis", "title") for c in ("o_orderdate >= timestamp'1994-01-01'", "o_orderdate < timestamp'1997-01-01'"))
    return findings.summary(findings.multiset_difference(new, old))


@query("q_multiset_diff", "SELECT s_nationkey AS nation, CAST(sum(d) AS BIGINT) AS __diff FROM (SELECT s_nationkey, 1 AS d FROM supplier UNION ALL SELECT c_nationkey, -1 FROM customer) GROUP BY 1 HAVING sum(d) <> 0")
def q_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.multiset_difference(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")))


@query("q_override", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'info' ELSE (['info', 'low', 'medium', 'high', 'critical'])[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] END AS severity FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '2-HIGH')")
def q_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignore = spark.createDataFrame([("F", "2-HIGH")], "analysis string, title string")
    return findings.override(_orders_as_findings(spark, sf_dir), ignore, {("O", "5-LOW"): "info"}).select("o_orderkey", "severity")


@query("q_locate", "SELECT l_orderkey AS o, l_linenumber AS l, CASE WHEN l_linenumber <= 2 THEN 'own' WHEN EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = x.l_orderkey AND m.l_linenumber <= 2) THEN 'own' ELSE 'start' END AS file, CASE WHEN l_linenumber <= 2 THEN l_linenumber ELSE coalesce((SELECT min(l_linenumber) FROM lineitem m WHERE m.l_orderkey = x.l_orderkey AND m.l_linenumber <= 2), 0) END AS line FROM lineitem x WHERE l_returnflag = 'R'")
def q_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    anchor = F.concat(F.lit("M:f"), F.col("l_orderkey").cast("string"), F.lit("/1#"), F.col("l_linenumber").cast("string"))
    lines = li.filter("l_linenumber <= 2").select(anchor.alias("instruction"), F.lit("own").alias("file"), F.col("l_linenumber").alias("line"))
    declared = spark.createDataFrame([("M", "start", 0)], "module string, file string, line int")
    found = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), anchor.alias("anchor"))
    return findings.locate(found, lines, declared).select("o", "l", "file", "line")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_tc"](spark, sf_dir)


from rulewright import library_queries  # noqa: E402, F401  registers its queries with the functions above
