"""What tables there are and what they hold; paging and search over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.records import any_contains, predicate

_SORTABLE = ("int", "bigint", "smallint", "tinyint", "double", "float", "string", "date", "timestamp", "timestamp_ntz", "boolean")


class Catalog:
    """Named DataFrames with their keys."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables, self.keys = spark, {}, {}

    def add(self, name: str, df: DataFrame, key: str) -> Catalog:
        self.tables[name], self.keys[name] = df, key
        return self

    def list_tables(self) -> DataFrame:
        """(table_name, n_columns, primary_key, sortable, filterable, searchable)."""
        rows = []
        for name, df in self.tables.items():
            kinds = dict(df.dtypes)
            sortable = [c for c, k in kinds.items() if k in _SORTABLE or k.startswith("decimal")]
            rows.append((name, len(kinds), self.keys[name], sortable, sortable, [c for c, k in kinds.items() if k == "string"]))
        return self.spark.createDataFrame(rows, "table_name string, n_columns long, primary_key string, sortable array<string>, filterable array<string>, searchable array<string>")

    def describe(self, name: str) -> DataFrame:
        """(position, column_name, data_type, nullable)."""
        rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(self.tables[name].schema.fields)]
        return self.spark.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean")

    def stats(self) -> DataFrame:
        """(table_name, row_count, estimated): Parquet counts come from file footers."""
        counted = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count", F.lit(False).alias("estimated")) for n, df in self.tables.items()]
        return reduce(DataFrame.unionByName, counted)

    def record(self, name: str, key) -> DataFrame:
        return self.tables[name].where(F.col(self.keys[name]) == F.lit(key))

    def page(self, name: str, limit: int = 50, sort_by: str | None = None, descending: bool = False, filters: dict | None = None, cursor: tuple | None = None) -> DataFrame:
        """One page by key, not by offset: rows after the cursor (sort value, key). Filters without a value are dropped."""
        key = self.keys[name]
        return keyset_page(self.tables[name], sort_by or key, key, limit, descending, filters, cursor)

    def search(self, name: str, term: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        df = self.tables[name]
        names = columns or [c for c, k in df.dtypes if k == "string"]
        found = df.where(any_contains([F.col(c) for c in names], term))
        return found.orderBy(self.keys[name]).limit(limit) if limit else found

    def global_search(self, term: str, exact: bool = False, limit: int | None = None, date_columns: dict[str, str] | None = None, date_from=None, date_to=None) -> DataFrame:
        """(table_name, record_id, matched_fields): one plan over all tables, which Spark runs side by side."""
        parts, low = [], term.lower()
        for name, df in self.tables.items():
            names = [c for c, k in df.dtypes if k == "string"]
            if not names:
                continue
            test = (lambda c: F.lower(F.col(c)) == low) if exact else (lambda c: F.contains(F.lower(F.col(c)), F.lit(low)))
            hits = F.filter(F.array(*(F.when(test(c), F.lit(c)) for c in names)), lambda x: x.isNotNull())
            rows = df
            at = (date_columns or {}).get(name)
            if at and date_from is not None:
                rows = rows.where(F.col(at) >= F.lit(date_from))
            if at and date_to is not None:
                rows = rows.where(F.col(at) < F.lit(date_to))
            any_hit = reduce(lambda a, b: a | b, [F.coalesce(test(c), F.lit(False)) for c in names])
            parts.append(rows.where(any_hit).select(F.lit(name).alias("table_name"), F.col(self.keys[name]).cast("string").alias("record_id"), F.array_join(hits, ",").alias("matched_fields")))
        found = reduce(DataFrame.unionByName, parts)
        return found.orderBy("table_name", "record_id").limit(limit) if limit else found


def keyset_page(df: DataFrame, sort_by: str, key: str, limit: int, descending: bool = False, filters: dict | None = None, cursor: tuple | None = None) -> DataFrame:
    for c, v in (filters or {}).items():
        if v is not None and v != "":
            df = df.where(F.col(c) == F.lit(v))
    if cursor is not None:
        s, k = cursor
        beyond = F.col(sort_by) < F.lit(s) if descending else F.col(sort_by) > F.lit(s)
        df = df.where(beyond | ((F.col(sort_by) == F.lit(s)) & (F.col(key) > F.lit(k))))
    return df.orderBy(F.col(sort_by).desc() if descending else F.col(sort_by).asc(), F.col(key).asc()).limit(limit)


def page_with_cursor(df: DataFrame, sort_by: str, key: str, limit: int, **options) -> tuple[list, tuple | None, bool]:
    """(rows, cursor of the next page, whether there is one): one row more than the page is read."""
    rows = keyset_page(df, sort_by, key, limit + 1, **options).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    return rows, ((rows[-1][sort_by], rows[-1][key]) if more else None), more


def drain(df: DataFrame, order: list[str], most: int = 10_000) -> DataFrame:
    """The first ``most`` rows, as paging to the end would give them."""
    return df.orderBy(*order).limit(most)


def term_pages(hits: DataFrame, caps: Column, order: list[str], term: str = "term") -> DataFrame:
    """Per search term the first rows up to its cap. Spark keeps the cap's worth per task before it shuffles."""
    return hits.withColumn("__rank", F.row_number().over(Window.partitionBy(term).orderBy(*order))).where(F.col("__rank") <= caps).drop("__rank")


def source_table(columns: list[str]) -> Column:
    """Table that a fetched record says it is from."""
    names = [c for c in ("_source_table", "table_name", "tableName", "_table") if c in columns]
    return F.coalesce(*(F.col(c) for c in names), F.lit("unknown"))


def normalize_response(spark: SparkSession, payload) -> DataFrame:
    """Records of a JSON answer as (source_table, record_json): a list, or an object with results (list or table -> list),
    records, data or items."""
    import json

    if isinstance(payload, str):
        payload = json.loads(payload)
    rows: list[tuple[str | None, dict]] = []
    if isinstance(payload, list):
        rows = [(None, r) for r in payload]
    elif isinstance(payload.get("results"), list):
        rows = [(None, r) for r in payload["results"]]
    elif isinstance(payload.get("results"), dict):
        rows = [(t, r) for t, rs in payload["results"].items() if isinstance(rs, list) for r in rs]
    else:
        for name in ("records", "data", "items"):
            if isinstance(payload.get(name), list):
                rows = [(None, r) for r in payload[name]]
                break
    named = [(t or next((str(r[k]) for k in ("_source_table", "table_name", "tableName", "_table") if r.get(k)), "unknown"), json.dumps(r, ensure_ascii=False)) for t, r in rows]
    return spark.createDataFrame(named, "source_table string, record_json string")


def where_all(df: DataFrame, filters: list[tuple]) -> DataFrame:
    """filters: (column, operator, value[, high])."""
    return df.where(reduce(lambda a, b: a & b, [predicate(F.col(f[0]), *f[1:]) for f in filters], F.lit(True)))
