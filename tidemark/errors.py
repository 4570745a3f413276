"""The one error class of the query surface."""


class QueryError(Exception):
    """A statement, schema or table name that cannot be used."""
