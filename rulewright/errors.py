"""Typed errors of programs, facts and sessions."""

from __future__ import annotations


class ProgramError(Exception):
    """A program that can't be read, typed or planned."""


class SafetyError(ProgramError):
    """A variable that no positive atom and no binding gives a value."""


class StratificationError(ProgramError):
    """Negation or aggregation within a recursive group."""


class MissingRelationError(Exception):
    """An input without facts, or a name that no relation has."""


class UnknownRelationError(MissingRelationError):
    """A name that no input or output of the program has."""


class ReadFailed(Exception):
    """An input whose rows couldn't be read."""


class WriteFailed(Exception):
    """A table that couldn't be written to the shared folder."""


class BadRowError(Exception):
    """A fact of the wrong width, or a field that isn't of its type."""


class StalePreviousError(Exception):
    """A commit that names another state than the session's as its predecessor."""


class LimitExceeded(Exception):
    """A relation that grew past its row limit."""

    def __init__(self, relation: str, rows: int, limit: int):
        super().__init__(f"{relation} has {rows} rows; its limit is {limit}")
        self.relation, self.rows, self.limit = relation, rows, limit


class PoisonedSession(Exception):
    """A session that met its limit in an earlier commit."""
