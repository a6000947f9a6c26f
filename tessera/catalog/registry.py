"""A registry of queries with their SQL."""

from __future__ import annotations


class Registry(dict):
    def add(self, text: str | None = None):
        """Register the function below under its name with the SQL that gives the same rows."""

        def put(f):
            self[f.__name__] = (f, text)
            return f

        return put
