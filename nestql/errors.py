"""Errors, all raised while planning, before any data is read."""


class QueryError(ValueError):
    """The query text, its arguments or a cursor is wrong."""


class SchemaError(ValueError):
    """The schema lacks what a query needs."""
