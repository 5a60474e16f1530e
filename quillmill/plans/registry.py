"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    """Query name -> (function, SQL or None)."""

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self[name or f.__name__] = (f, sql)
            return f

        return add
