"""Tables that a service gives out page by page, as a Spark data source: batch and stream, page ranges as partitions."""

from __future__ import annotations

import functools
import importlib
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "quarry_pages"


class Rows(InputPartition):
    """Rows first to last - 1 of what is served."""

    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def _service(options: dict):
    """The service named by option ``service``, as module:name. It has total(options), the rows there are now, and
    rows(options, first, last), which gives them as dicts or as an Arrow table. It only ever appends rows."""
    module, _, name = options["service"].partition(":")
    return getattr(importlib.import_module(module), name)


def ask(options: dict, call, sleep=time.sleep):
    """call(), and again after 1, 2, 4 ... times ``wait`` seconds while it fails, ``retries`` times at most."""
    retries, wait = int(options.get("retries", 3)), float(options.get("wait", 1))
    for attempt in range(retries + 1):
        try:
            return call()
        except (OSError, ValueError):
            if attempt == retries:
                raise
            sleep(wait * 2.0**attempt)


def _cut(options: dict, first: int, last: int) -> list[Rows]:
    """Partitions of ``pages`` pages of ``page_size`` rows."""
    step = int(options.get("page_size", 100)) * int(options.get("pages", 50))
    return [Rows(at, min(at + step, last)) for at in range(first, last, step)]


def _read(options: dict, schema: StructType, part: Rows) -> Iterator[pa.RecordBatch]:
    service, size, arrow = _service(options), int(options.get("page_size", 100)), to_arrow_schema(schema)
    for at in range(part.first, part.last, size):
        end = min(at + size, part.last)
        got = ask(options, lambda at=at, end=end: service.rows(options, at, end))
        table = got if isinstance(got, pa.Table) else pa.Table.from_pylist(got, schema=arrow)
        if table.num_rows != end - at:
            raise ValueError(f"rows {at} to {end} asked for, {table.num_rows} given")
        yield from table.select(arrow.names).cast(arrow).to_batches()


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.schema = options, schema

    def partitions(self) -> list[Rows]:
        return _cut(self.options, 0, ask(self.options, lambda: _service(self.options).total(self.options)))

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        # all that a partition needs is in its range, so one that failed or was lost asks for the same rows again
        return _read(self.options, self.schema, partition)


class PageStream(DataSourceStreamReader):
    """Offsets are numbers of rows; a batch has what was added since the last one, ``most`` rows if given at most."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.schema, self.given = options, schema, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rows": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        total = ask(self.options, lambda: _service(self.options).total(self.options))
        self.given = min(total, self.given + int(self.options["most"])) if "most" in self.options else total
        return {"rows": self.given}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        self.given = max(self.given, end["rows"])
        return _cut(self.options, start["rows"], end["rows"])

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return _read(self.options, self.schema, partition)


class Pages(DataSource):
    """spark.read.format("quarry_pages").option("service", "module:name"), or readStream. Options: page_size (100), pages
    of a partition (50), retries (3), wait (1 second), most (rows of a micro batch), and what the service asks for. Without
    a schema the service's first row tells it."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        first = ask(self.options, lambda: _service(self.options).rows(self.options, 0, 1))
        return from_arrow_schema((first if isinstance(first, pa.Table) else pa.Table.from_pylist(first)).schema)

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> PageStream:  # noqa: N802
        return PageStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)


class ParquetService:
    """A service over Parquet files, named by option ``path`` and separated by commas: rows in the order of the files."""

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def _groups(path: str) -> tuple[tuple[str, int, int, int], ...]:
        """(file, row group, first row, one past its last row) of all files."""
        out, at = [], 0
        for name in path.split(","):
            meta = pq.read_metadata(name)
            for g in range(meta.num_row_groups):
                n = meta.row_group(g).num_rows
                out.append((name, g, at, at + n))
                at += n
        return tuple(out)

    @staticmethod
    @functools.lru_cache(maxsize=1)
    def _group(name: str, g: int) -> pa.Table:
        """The row group that the last page was from: pages of a partition follow each other."""
        return pq.ParquetFile(name).read_row_group(g)

    @classmethod
    def total(cls, options: dict) -> int:
        groups = cls._groups(options["path"])
        return groups[-1][3] if groups else 0

    @classmethod
    def rows(cls, options: dict, first: int, last: int) -> pa.Table:
        parts = [cls._group(name, g).slice(max(first - lo, 0), min(last, hi) - max(first, lo)) for name, g, lo, hi in cls._groups(options["path"]) if lo < last and first < hi]
        return pa.concat_tables(parts)
