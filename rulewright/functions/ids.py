"""Instruction and function names: Module:function/arity#index."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, functions as F

_ID = re.compile(r"(?P<module>[^:]+(?:::[^:]+)*):(?P<name>.+)/(?P<arity>\d+)(?:#(?P<index>\d+))?", re.S)


class InstrId(NamedTuple):
    module: str
    name: str
    arity: int
    index: int | None

    def function(self) -> str:
        return f"{self.module}:{self.name}/{self.arity}"

    def __str__(self) -> str:
        return self.function() + (f"#{self.index}" if self.index is not None else "")


def parse_id(text: str) -> InstrId:
    m = _ID.fullmatch(text)
    if not m:
        raise ValueError(f"no instruction or function: {text!r}")
    return InstrId(m["module"], m["name"], int(m["arity"]), int(m["index"]) if m["index"] else None)


def function_of(c: Column) -> Column:
    """The function part of an instruction's name; a function's name stays."""
    return F.regexp_replace(c, "#[0-9]+$", "")


def module_of(c: Column) -> Column:
    return F.substring_index(c, ":", 1)


def index_of(c: Column) -> Column:
    """The instruction's index as a number, null for a function."""
    found = F.regexp_extract(c, "#([0-9]+)$", 1)
    return F.when(found != "", found.cast("int"))


def make_id(function: Column, index: Column) -> Column:
    return F.concat(function, F.lit("#"), index.cast("string"))
