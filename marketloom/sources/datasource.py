"""``spark.read.format("marketloom")``: a folder of market data as a source that SQL can name.

Options: ``path`` of the folder, ``table`` (price, news, filing_k, filing_q), ``first`` and
``last`` (days), ``symbols`` (with commas between), and for streams ``daysPerBatch``. A file is a
partition. Days leave out files by the year in their folder, and with the symbols row groups by
their statistics; the rows left are just those asked for. As a stream the folder is replayed by
day: an offset is the last day given, and a batch has the days up to the next one.

With the option ``pushdown`` a query's filters are used in the same way. Spark 4.1 keeps what one
query pushed with the relation, and a later query without filters over the same DataFrame or
view would get it, too: with pushdown, load anew for every query.

Files are read by Arrow's own file systems in the executors: local and mounted paths, and the
schemes that Arrow knows.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from .market import FOLDERS

_EPOCH = datetime.date(1970, 1, 1)


def _files(path: str) -> tuple[object, list[tuple[str, int]]]:
    """(file system, (file, year of its folder) in order) of a table's folder."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    years = [(f.path, re.search(r"year=(\d+)", f.path)) for f in found if f.is_file and f.path.endswith(".parquet") and not re.search(r"/[_.]", f.path.removeprefix(root))]
    return where, sorted((p, int(y[1])) for p, y in years if y)


class File(D.InputPartition):
    """A file to read, the conditions on its rows, and the days that are wanted of it."""

    def __init__(self, path: str, file: str, year: int, conditions: list[tuple], days: tuple[int, int] | None = None):
        super().__init__(file)
        self.path, self.file, self.year, self.conditions, self.days = path, file, year, conditions, days


#: Comparisons that Arrow takes over, by the kind of filter.
_COMPARES = {D.EqualTo: "==", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<=", D.In: "in"}


def _holds(kind: str, x: int, value) -> bool:
    return x in value if kind == "in" else {"==": x == value, ">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value}[kind]


def _condition(column: str, kind: str, value) -> pc.Expression:
    field = pc.field(column)
    if kind == "in":
        return field.isin([v for v in value if v is not None])
    return {"==": field == value, ">": field > value, ">=": field >= value, "<": field < value, "<=": field <= value}[kind]


def _read(part: File | None, schema: StructType) -> Iterator[pa.RecordBatch]:
    """A file's rows; without files Spark asks for the rows of no partition."""
    import pyarrow.dataset as ds
    from pyspark.sql.pandas.types import to_arrow_schema

    if part is None:
        return
    wanted = to_arrow_schema(schema)
    condition = None
    for c in [_condition(*c) for c in part.conditions if c[0] != "year"]:
        condition = c if condition is None else condition & c
    if part.days is not None:
        first, last = (_EPOCH + datetime.timedelta(d) for d in part.days)
        between = (pc.field("date") > first) & (pc.field("date") <= last)
        condition = between if condition is None else condition & between
    data = ds.dataset(part.file, filesystem=_system(part.path), format="parquet")
    there = [f.name for f in wanted if f.name in data.schema.names]
    for batch in data.scanner(columns=there, filter=condition).to_batches():
        if batch.num_rows:
            columns = [pa.array([part.year] * batch.num_rows, f.type) if f.name == "year" else batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in wanted]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()


class Reader(D.DataSourceReader):
    def __init__(self, path: str, schema: StructType, conditions: list[tuple] = ()):
        self.path, self.schema, self.conditions = path, schema, list(conditions)

    def partitions(self):
        _, found = _files(self.path)
        years = [(k, v) for c, k, v in self.conditions if c == "year"]
        # a day bounds the year
        for c, kind, value in self.conditions:
            if c == "date":
                years.append(("in", tuple(v.year for v in value if v)) if kind == "in" else ("==", value.year) if kind == "==" else (kind if "=" in kind else kind + "=", value.year))
        return [File(self.path, f, y, self.conditions) for f, y in found if all(_holds(k, y, v) for k, v in years)]

    def read(self, partition: File):
        return _read(partition, self.schema)


class PushedReader(Reader):
    def pushFilters(self, filters):
        """Comparisons of year, date and symbol with a value are done here; the rest is Spark's."""
        for f in filters:
            kind = _COMPARES.get(type(f))
            column = f.attribute[0] if kind and len(f.attribute) == 1 else None
            if column not in ("year", "date", "symbol") or getattr(f, "value", 0) is None:
                yield f
            else:
                self.conditions.append((column, kind, tuple(f.value) if kind == "in" else f.value))


class Replay(D.DataSourceStreamReader):
    """Days in order. Days that come into the folder behind the last offset are not seen again."""

    def __init__(self, path: str, schema: StructType, days: int, conditions: list[tuple] = ()):
        self.path, self.schema, self.days, self.conditions, self.at = path, schema, days, list(conditions), None

    def _ends(self) -> tuple[int, int]:
        """The first and last day of the folder, from the files' footers of its first and last year."""
        import pyarrow.parquet as pq

        where, found = _files(self.path)
        if not found:
            return 0, 0
        days = []
        for year in (found[0][1], found[-1][1]) if found else ():
            for f in [f for f, y in found if y == year]:
                with where.open_input_file(f) as source:
                    meta = pq.ParquetFile(source).metadata
                    at = meta.schema.names.index("date")
                    for g in range(meta.num_row_groups):
                        s = meta.row_group(g).column(at).statistics
                        if s is not None and s.has_min_max:
                            days += [(s.min - _EPOCH).days, (s.max - _EPOCH).days]
        return min(days), max(days)

    def initialOffset(self):
        return {"day": self._ends()[0] - 1}

    def latestOffset(self):
        """The next batch's last day; a stream that starts anew is asked for it before anything is planned, one that goes on after its last batch is."""
        first, last = self._ends()
        at = first - 1 if self.at is None else self.at
        return {"day": max(at, min(last, at + self.days)) if self.days else max(at, last)}

    def partitions(self, start, end):
        _, found = _files(self.path)
        self.at = end["day"]
        first, last = ((_EPOCH + datetime.timedelta(d)).year for d in (start["day"] + 1, end["day"]))
        return [File(self.path, f, y, self.conditions, (start["day"], end["day"])) for f, y in found if first <= y <= last and start["day"] < end["day"]]

    def read(self, partition: File):
        return _read(partition, self.schema)


class MarketSource(D.DataSource):
    """The source named marketloom."""

    @classmethod
    def name(cls) -> str:
        return "marketloom"

    def _table(self) -> tuple[str, StructType]:
        table = self.options.get("table", "price")
        if table not in FOLDERS or "path" not in self.options:
            raise ValueError(f"give a path and one of the tables {sorted(FOLDERS)}")
        folder, schema = FOLDERS[table]
        return f"{self.options['path'].rstrip('/')}/{folder}", schema

    def schema(self) -> StructType:
        return self._table()[1]

    def _conditions(self) -> list[tuple]:
        """What the options ask for."""
        day = datetime.date.fromisoformat
        out = [("date", kind, day(self.options[name])) for name, kind in (("first", ">="), ("last", "<=")) if name in self.options]
        return out + ([("symbol", "in", tuple(self.options["symbols"].split(",")))] if "symbols" in self.options else [])

    def reader(self, schema: StructType) -> Reader:
        made = PushedReader if self.options.get("pushdown", "false").lower() == "true" else Reader
        return made(self._table()[0], schema, self._conditions())

    def streamReader(self, schema: StructType) -> Replay:
        return Replay(self._table()[0], schema, int(self.options.get("daysPerBatch", 0)), self._conditions())


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let it take filters where ``pushdown`` is asked for."""
    spark.dataSource.register(MarketSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
