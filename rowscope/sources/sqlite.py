"""SQLite tables as a Spark data source: ranges of row ids are partitions, exact filters go to the database.

The file must be at the same path on every executor.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from rowscope.functions.access import ORD

RANGE_ROWS = 200_000


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def choose_table(path: str, table: str | None = None) -> str:
    with connect(path) as db:
        names = [r[0] for r in db.execute("select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite\\_%' escape '\\' order by name")]
    if table:
        if table not in names:
            raise ValueError(f"no table {table!r}; there are: {', '.join(names)}")
        return table
    if len(names) != 1:
        raise ValueError(f"name one of the tables: {', '.join(names)}" if names else "no table")
    return names[0]


def _schema(path: str, table: str) -> T.StructType:
    """Columns by what is stored in them: whole numbers, numbers, or text for anything else."""
    fields = []
    with connect(path) as db:
        columns = [r[1:3] for r in db.execute(f"pragma table_info({quote(table)})")]
        stored = ("integer", "real", "text", "blob")
        ask = ", ".join(f"max(typeof({quote(name)}) = '{k}')" for name, _ in columns for k in stored)
        seen = db.execute(f"select {ask} from {quote(table)}").fetchone()  # one scan for all columns
        for i, (name, declared) in enumerate(columns):
            kinds = {k for k, has in zip(stored, seen[4 * i : 4 * i + 4], strict=True) if has}
            kind: T.DataType = T.LongType() if kinds == {"integer"} else T.DoubleType() if kinds and kinds <= {"integer", "real"} else T.StringType()
            if (declared or "").upper() in ("BOOLEAN", "BOOL") and kinds == {"integer"}:
                kind = T.BooleanType()
            fields.append(T.StructField(name, kind))
    return T.StructType([*fields, T.StructField(ORD, T.LongType())])


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None, first: int):
        self.low, self.high, self.first = low, high, first


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.schema = path, table, schema
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take the filters whose meaning is the same here and there; give back the others."""
        for f in filters:
            sql = self._sql(f)
            if sql is None or len(sql[1]) + sum(len(p) for _, p in self.where) > 900:
                yield f
            else:
                self.where.append(sql)

    def _sql(self, f: Filter) -> tuple[str, list] | None:
        attr = getattr(f, "attribute", ())
        if len(attr) != 1 or attr[0] not in self.schema.names or attr[0] == ORD:
            return None
        name, kind = quote(attr[0]), self.schema[attr[0]].dataType
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{name} is {'not ' * isinstance(f, IsNotNull)}null", []
        values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
        text = isinstance(kind, T.StringType)
        if not values or isinstance(kind, T.BooleanType):
            return None
        for v in values:
            if text and not isinstance(v, str) or not text and (isinstance(v, bool) or not isinstance(v, (int, float)) or abs(v) >= 2**53):
                return None
        if text:  # bytes compare alike, but only where all that is stored is text
            with connect(self.path) as db:
                if db.execute(f"select 1 from {quote(self.table)} where typeof({name}) not in ('text', 'null') limit 1").fetchone():
                    return None
        name += " collate binary" * text
        if isinstance(f, In):
            return f"{name} in ({','.join('?' * len(values))})", values
        op = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}.get(type(f))
        return (f"{name} {op} ?", values) if op and not (text and op != "=") else None

    def _rowid(self, db: sqlite3.Connection) -> bool:
        try:
            db.execute(f"select _rowid_ from {quote(self.table)} limit 1")
        except sqlite3.OperationalError:
            return False
        return True

    def partitions(self) -> list[_Range]:
        """Ranges of row ids; each knows how many rows lie before it, so ordinals do not depend on gaps."""
        with connect(self.path) as db:
            if not self._rowid(db):
                return [_Range(None, None, 0)]
            low, high, n = db.execute(f"select min(_rowid_), max(_rowid_), count(*) from {quote(self.table)}").fetchone()
            if not n:
                return [_Range(None, None, 0)]
            parts = max(1, min(1024, n // RANGE_ROWS))
            step = (high - low) // parts + 1
            sizes = dict(db.execute(f"select (_rowid_ - ?) / ?, count(*) from {quote(self.table)} group by 1", (low, step)))
            out, before = [], 0
            for k, a in enumerate(range(low, high + 1, step)):
                out.append(_Range(a, a + step - 1, before))
                before += sizes.get(k, 0)
            return out

    def read(self, part: _Range) -> Iterator[tuple]:
        names = [n for n in self.schema.names if n != ORD]
        kinds = [self.schema[n].dataType for n in names]
        cols = ", ".join(quote(n) for n in names)
        span, args = ("", []) if part.low is None else ("where _rowid_ between ? and ? ", [part.low, part.high])
        order = "" if part.low is None else "order by _rowid_"
        inner = f"select {cols}, row_number() over ({order}) - 1 as \"__n\" from {quote(self.table)} {span}"
        test = " and ".join(s for s, _ in self.where) or "1"
        for row in connect(self.path).execute(f"select * from ({inner}) where {test} order by \"__n\"", args + [v for _, p in self.where for v in p]):
            yield (*(_convert(v, t) for v, t in zip(row[:-1], kinds, strict=True)), part.first + row[-1])


def _convert(v, t: T.DataType):
    if v is None:
        return None
    if isinstance(t, T.BooleanType):
        return bool(v)
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(t, T.LongType):
        return int(v)
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rowscope_sqlite"

    def schema(self) -> T.StructType:
        return _schema(self.options["path"], self.options["table"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema)


def read_sqlite(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("rowscope_sqlite").option("table", choose_table(path, table)).load(path)
