"""Errors of the query language."""


class QueryError(ValueError):
    """A query that cannot be parsed, typed or run."""
