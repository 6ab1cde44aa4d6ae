"""The errors that callers see."""


class QueryError(Exception):
    """A statement that cannot be parsed, planned or run."""


class InsertError(Exception):
    """Points that cannot be accepted."""


class AccessError(QueryError):
    """A statement that the user may not run."""
