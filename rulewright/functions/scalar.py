"""Expressions of the rule language as JVM-side columns with the language's semantics."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from rulewright.errors import ProgramError, SafetyError
from rulewright.plans.syntax import Arith, Call, Const, Tup, Var

Typed = tuple[Column, object]
LOW, SPAN = 2**31, 2**32
_INTEGER = r"\A[+-]?[0-9]+\z"


def wrap32(c: Column) -> Column:
    """A bigint as a signed 32-bit number that wraps around."""
    return ((c + F.lit(LOW)).bitwiseAND(F.lit(SPAN - 1)) - F.lit(LOW)).cast("int")


def to_number(s: Column) -> Column:
    """The whole string as a 32-bit number, 0 if it isn't one; blanks aren't skipped."""
    return F.when(s.rlike(_INTEGER), F.coalesce(s.try_cast("int"), F.lit(0))).otherwise(F.lit(0))


def substr(s: Column, start: Column, length: Column) -> Column:
    """By characters from 0; a negative start is past the end, a negative length reaches to it."""
    rest = F.length(s) - start
    return F.when(start < 0, F.lit("")).otherwise(F.substr(s, start + 1, F.when(length < 0, F.greatest(rest, F.lit(0))).otherwise(length)))


def valid_pattern(pattern: str) -> bool:
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def matches(pattern, text: Column) -> Column:
    """Whether pattern fits the whole text; a pattern that can't be compiled fits nothing. pattern: a string, or a column."""
    if isinstance(pattern, str):
        whole = rf"(?d)\A(?:{pattern})\z"
        return text.rlike(whole) if valid_pattern(whole) else F.lit(False)

    whole = F.concat(F.lit(r"(?d)\A(?:"), pattern, F.lit(r")\z"))
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), whole)
    return F.coalesce(F.regexp_like(text, F.when(compiled.isNotNull(), whole)), F.lit(False))


def _power(a: Column, b: Column) -> Column:
    steps = F.when(b > 0, F.sequence(F.lit(1), b)).otherwise(F.array().cast("array<int>"))
    value = F.aggregate(steps, F.lit(1), lambda acc, _: wrap32(acc.cast("bigint") * a.cast("bigint")))
    return F.when(b < 0, F.raise_error(F.lit("negative exponent")).cast("int")).otherwise(value)


def _divide(a: Column, b: Column) -> Column:
    bad = (b == -1) & (a == -LOW)
    return F.when(bad, F.raise_error(F.lit("the quotient isn't a 32-bit number")).cast("int")).otherwise(F.call_function("div", a.cast("bigint"), b.cast("bigint")).cast("int"))


_NUMBER = {
    "+": lambda a, b: wrap32(a.cast("bigint") + b.cast("bigint")),
    "-": lambda a, b: wrap32(a.cast("bigint") - b.cast("bigint")),
    "*": lambda a, b: wrap32(a.cast("bigint") * b.cast("bigint")),
    "/": _divide,
    "%": lambda a, b: F.when((b == -1), F.lit(0)).otherwise(a % b),
    "^": _power,
    "band": lambda a, b: a.bitwiseAND(b),
    "bor": lambda a, b: a.bitwiseOR(b),
    "bxor": lambda a, b: a.bitwiseXOR(b),
    "bshl": lambda a, b: F.call_function("shiftleft", a, b),
    "bshr": lambda a, b: F.call_function("shiftright", a, b),
    "bshru": lambda a, b: F.call_function("shiftrightunsigned", a, b),
}
_WIDE = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": lambda a, b: a % b}
_SIGNATURES = {"cat": None, "to_string": 1, "to_number": 1, "strlen": 1, "substr": 3}
RANKS = {"number": 0, "long": 1, "float": 2}


def _arith(op: str, a: Typed, b: Typed) -> Typed:
    (x, s), (y, t) = a, b
    if s not in RANKS or t not in RANKS:
        raise ProgramError(f"{op} needs numbers")
    if s == t == "number":
        return _NUMBER[op](x, y), "number"
    kind = max(s, t, key=RANKS.get)
    if op == "/":
        return (x / y, "float") if kind == "float" else (F.call_function("div", x.cast("bigint"), y.cast("bigint")), "long")
    if op not in _WIDE:
        raise ProgramError(f"{op} needs 32-bit numbers")
    return _WIDE[op](x, y), kind


def constant(value: object) -> Typed:
    kind = "bool" if isinstance(value, bool) else {int: "number", float: "float", str: "symbol"}[type(value)]
    if kind == "number" and not -LOW <= value < LOW:
        kind = "long"
    return F.lit(value), kind


def compile_expression(node, bound: dict[str, Typed]) -> Typed:
    """The column and type of an expression over bound variables. A tuple's type is the tuple of its items' types."""
    if isinstance(node, Const):
        return constant(node.value)
    if isinstance(node, Var):
        if node.name not in bound:
            raise SafetyError(f"{node.name} has no value")
        return bound[node.name]
    if isinstance(node, Tup):
        items = [compile_expression(x, bound) for x in node.items]
        return F.struct(*(c.alias(f"_{i}") for i, (c, _) in enumerate(items))), tuple(t for _, t in items)
    if isinstance(node, Arith):
        out = compile_expression(node.first, bound)
        for op, operand in node.rest:
            out = _arith(op, out, compile_expression(operand, bound))
        return out
    if isinstance(node, Call):
        return _call(node, bound)
    raise ProgramError(f"{type(node).__name__} isn't an expression")


def _call(node: Call, bound: dict[str, Typed]) -> Typed:
    if node.name == "ord":
        raise ProgramError("ord depends on the order in which strings are seen; it is refused")
    if node.name not in _SIGNATURES:
        if node.name in UDFS:
            fn, kind = UDFS[node.name]
            return fn(*(compile_expression(a, bound)[0] for a in node.args)), kind
        raise ProgramError(f"no function is named {node.name}")
    args = [compile_expression(a, bound) for a in node.args]
    if _SIGNATURES[node.name] not in (None, len(args)) or not args:
        raise ProgramError(f"{node.name} takes {_SIGNATURES[node.name]} arguments")
    kinds, c = [t for _, t in args], [x for x, _ in args]
    if node.name == "to_string":
        if isinstance(kinds[0], tuple):
            raise ProgramError("to_string takes no tuple")
        return c[0].cast("string"), "symbol"
    if node.name == "substr":
        if kinds != ["symbol", "number", "number"]:
            raise ProgramError("substr takes a symbol and two numbers")
        return substr(*c), "symbol"
    if any(k != "symbol" for k in kinds):
        raise ProgramError(f"{node.name} takes symbols")
    if node.name == "cat":
        return F.concat(*c), "symbol"
    return (to_number(c[0]), "number") if node.name == "to_number" else (F.length(c[0]).cast("int"), "number")


#: Functions of the user's: name -> (columns to column, type).
UDFS: dict[str, tuple] = {}


def register_function(name: str, fn, kind: str) -> None:
    """Makes fn, from columns to a column (built-in functions or a pandas UDF), callable from rules."""
    UDFS[name] = (fn, kind)
