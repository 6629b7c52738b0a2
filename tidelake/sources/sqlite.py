"""A hot store kept in a SQLite file, as a Python data source: ``spark.read.format('tidelake_sqlite').option('path', f)`` (SRC-4).

One partition per ``option('partitions', n)`` of the arrival ids; comparisons on ts, rowid, path, context and source are pushed into SQLite.
The file must be where executors run (it is a local store by nature).
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNull, LessThan, LessThanOrEqual

from tidelake.model import HOT

COLUMNS = [f.name for f in HOT.fields]
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class Span(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelake_sqlite"

    def schema(self):
        return HOT

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", 1))
        self.where: list[str] = []
        self.values: list[object] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in COLUMNS and type(f) in _SIGNS:
                self.where.append(f'"{column}" {_SIGNS[type(f)]} ?')
                self.values.append(f.value)
            elif column in COLUMNS and isinstance(f, In):
                self.where.append(f'"{column}" IN ({", ".join("?" * len(f.value))})')
                self.values += list(f.value)
            elif column in COLUMNS and isinstance(f, IsNull):
                self.where.append(f'"{column}" IS NULL')
            else:
                yield f

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as base:
            low, high = base.execute("SELECT min(rowid), max(rowid) FROM sample").fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Span(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Span) -> Iterator[tuple]:
        tests = ["rowid BETWEEN ? AND ?", *self.where]
        with self._open() as base:
            yield from base.execute(f"SELECT {', '.join(COLUMNS)} FROM sample WHERE {' AND '.join(tests)}", [partition.low, partition.high, *self.values])
