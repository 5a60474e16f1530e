"""A reference manager's SQLite file as a Spark source.

``spark.dataSource.register(LibraryItems)``, then ``spark.read.format("library_items").option("path", ...)``. The key
range is cut into ``partitions`` reads, each by its own read-only connection.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

QUERY = """
SELECT i.itemID, i.key, t.typeName, f.fieldName, v.value
FROM items i JOIN itemTypes t USING (itemTypeID) LEFT JOIN itemData d USING (itemID) LEFT JOIN fields f USING (fieldID) LEFT JOIN itemDataValues v USING (valueID)
WHERE i.itemID BETWEEN ? AND ? AND i.itemID NOT IN (SELECT itemID FROM deletedItems) ORDER BY i.itemID
"""


class KeyRange(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, parts: int):
        self.path, self.parts = path, parts

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def partitions(self):
        with self._open() as c:
            lo, hi = c.execute("SELECT coalesce(min(itemID), 0), coalesce(max(itemID), -1) FROM items").fetchone()
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [KeyRange(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)] or [KeyRange(0, -1)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        with self._open() as c:
            held: tuple | None = None
            fields: dict[str, str] = {}
            for item, key, kind, name, value in c.execute(QUERY, (partition.lo, partition.hi)):
                if held and held[0] != item:
                    yield (*held, fields)
                    fields = {}
                held = (item, key, kind)
                if name:
                    fields[name] = str(value)
            if held:
                yield (*held, fields)


class LibraryItems(DataSource):
    """Items with their fields as a map; deleted items are left out."""

    @classmethod
    def name(cls) -> str:
        return "library_items"

    def schema(self) -> str:
        return "item_id bigint, key string, item_type string, fields map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partitions", "4")))
