"""Errors of the engine, and their HTTP statuses."""


class EngineError(Exception):
    status = 500


class ParseError(EngineError):
    """The query or update is not well formed."""

    status = 400


class UnsupportedError(EngineError):
    """Well formed, but outside what the engine offers (SERVICE, LOAD)."""

    status = 400


class QueryTimeout(EngineError):
    status = 503


class LimitExceeded(EngineError):
    """A guard on materialised rows was hit; the query was stopped, nothing was cut short."""


class PartialCommit(EngineError):
    """A commit failed after some of its operations were written."""

    def __init__(self, written: int, total: int, cause: Exception):
        super().__init__(f"{written} of {total} operations were written: {cause}")
        self.written, self.total = written, total
