"""Registration of a module's queries with their SQL."""

from __future__ import annotations


def registry():
    queries, sql = {}, {}

    def query(oracle: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return put

    return queries, sql, query
