"""Records of any table: cells, JSON text, filters, aliases and rendering."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_to_null

# Columns that carry no evidence.
NOISE_COLUMNS = ("global_id", "s_indx", "is_deleted", "updated_at", "created_at", "deleted_at", "id", "_id", "uuid", "timestamp", "version", "rowid", "pk")
# Cell categories by column-name part, first that fits wins.
CATEGORIES = (
    ("phone", ("phone", "mobile", "tel", "contact")), ("email", ("email", "mail")), ("address", ("address", "add1", "add2", "street", "zip", "pin")),
    ("name", ("name",)), ("company", ("company", "organization", "firm")), ("location", ("city", "state", "country", "location", "district")),
    ("website", ("website", "url", "web")), ("designation", ("designation", "title", "position", "role")),
)


def cells(columns: Iterable[str]) -> Column:
    """array<struct<field, value>> of the columns as text, in order; nulls stay."""
    return F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))


def records(df: DataFrame, table: str, id_col: str, columns: list[str] | None = None) -> DataFrame:
    """(table_name, record_id, record_json, cells): the common shape, one row per record and no shuffle."""
    names = columns or df.columns
    return df.select(F.lit(table).alias("table_name"), F.col(id_col).cast("string").alias("record_id"), record_json(names).alias("record_json"), cells(names).alias("cells"))


def unpivot(recs: DataFrame) -> DataFrame:
    """(table_name, record_id, field, value) with a row per cell that is not blank."""
    return recs.select("table_name", "record_id", F.inline("cells")).where(blank_to_null(F.col("value")).isNotNull())


def record_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def record_text(columns: list[str], separator: str = "\n", skip_private: bool = False) -> Column:
    """`k: v` parts of the columns that are not blank. skip_private: without columns that begin with an underscore."""
    chosen = [c for c in columns if not (skip_private and c.startswith("_"))]
    parts = [F.when(blank_to_null(F.col(c)).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in chosen]
    return F.concat_ws(separator, *parts)


def drop_noise_columns(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c.lower() not in NOISE_COLUMNS and not c.lower().endswith("_id") and not c.startswith("_")))


def drop_noise_value(c: Column, numeric: bool = False) -> Column:
    """Null for values that only look like identifiers: huge, negative or broken numbers, exponents, long digit runs."""
    if numeric:
        x = c.cast("double")
        return F.when((F.abs(x) > 9_999_999_999) | (x < 0) | (x != F.floor(x)), None).otherwise(c)
    text = c.cast("string")
    return F.when(text.rlike(r"(?i)e\+?\d+$") | text.rlike(r"^\d{15,}$") | text.rlike(r"^-\d+$"), None).otherwise(c)


def any_contains(values: Iterable[Column], term: str) -> Column:
    """Whether any value contains the term, whatever the case."""
    low = term.lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(v.cast("string")), F.lit(low)), F.lit(False)) for v in values], F.lit(False))


def matched_fields(columns: Iterable[str], term: str) -> Column:
    """Names of the columns whose text contains the term, in order."""
    low = term.lower()
    return F.filter(F.array(*(F.when(F.contains(F.lower(F.col(c).cast("string")), F.lit(low)), F.lit(c)) for c in columns)), lambda x: x.isNotNull())


def predicate(c: Column, operator: str, value, high=None) -> Column:
    """One filter. Text operators ignore case; comparisons are on numbers, and text that is no number never passes."""
    text, number = F.lower(c.cast("string")), c.try_cast("double")
    low = str(value).lower()
    tests = {
        "equals": lambda: text == low, "contains": lambda: F.contains(text, F.lit(low)), "starts_with": lambda: F.startswith(text, F.lit(low)), "ends_with": lambda: F.endswith(text, F.lit(low)),
        "greater_than": lambda: number > float(value), "less_than": lambda: number < float(value), "between": lambda: number.between(float(value), float(high)), "regex": lambda: c.cast("string").rlike(str(value)),
        "in": lambda: text.isin([str(v).lower() for v in value]), "exists": lambda: blank_to_null(c).isNotNull(),
    }
    return F.coalesce(tests[operator](), F.lit(False))


def filters_all(cells_col: str, filters: list[tuple[str, str]], location_words=("location", "city", "state", "country", "address", "district")) -> Column:
    """Every (type, value) must match. A location first tries columns named after one, either text inside the other."""

    def one(kind: str, value: str) -> Column:
        low = value.lower()
        inside = F.exists(cells_col, lambda x: F.contains(F.lower(x["value"]), F.lit(low)))
        if kind != "location":
            return F.coalesce(inside, F.lit(False))
        named = lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x["field"]), F.lit(w)) for w in location_words])
        both = F.exists(cells_col, lambda x: named(x) & (F.length(F.trim(x["value"])) > 0) & (F.contains(F.lower(x["value"]), F.lit(low)) | F.contains(F.lit(low), F.lower(x["value"]))))
        return F.coalesce(both, F.lit(False)) | F.coalesce(inside, F.lit(False))

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in filters], F.lit(True))


def filters_any(json: Column, values: list[str]) -> Column:
    """Whether any value appears in the record's JSON; true if there are no values."""
    if not values:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(json), F.lit(v.lower())) for v in values])


def matched_filters(json: Column, values: list[str]) -> Column:
    return F.filter(F.array(*(F.when(F.contains(F.lower(json), F.lit(v.lower())), F.lit(v)) for v in values)), lambda x: x.isNotNull())


def first_of(columns: list[str]) -> Column:
    """First of the columns that is not blank."""
    return F.coalesce(*(F.when(blank_to_null(F.col(c)).isNotNull(), F.col(c).cast("string")) for c in columns))


def combine(columns: list[str], separator: str = ", ") -> Column:
    return F.concat_ws(separator, *(blank_to_null(F.col(c)) for c in columns))


def relevant_fields(columns: list[str]) -> Column:
    """map of lower-cased column name to value, without blanks."""
    pairs = F.array(*(F.struct(F.lit(c.lower()).alias("k"), F.col(c).cast("string").alias("v")) for c in columns))
    return F.map_from_entries(F.filter(pairs, lambda p: blank_to_null(p["v"]).isNotNull()))


def all_columns(tables: Iterable[DataFrame]) -> list[str]:
    return list(dict.fromkeys(c for t in tables for c in t.columns))


def union_by_columns(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def display(df: DataFrame, skipped: Iterable[str] = ("id", "global_id", "s_indx", "is_deleted", "updated_at")) -> DataFrame:
    """Columns as shown: true and false as Yes and No, nested values as JSON, blanks as null; some columns left out."""
    shown = []
    for name, kind in df.dtypes:
        if name in skipped:
            continue
        c = F.col(name)
        if kind == "boolean":
            c = F.when(c, "Yes").when(~c, "No")
        elif kind.startswith(("struct", "array", "map")):
            c = F.to_json(c)
        shown.append(blank_to_null(c).alias(name))
    return df.select(*shown)


def categorize(field: Column, value: Column) -> Column:
    """Category of a cell: a phone has six characters or more and an e-mail an @."""
    low, out = F.lower(field), None
    for kind, parts in CATEGORIES:
        test = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])
        if kind == "phone":
            test = test & (F.length(value) >= 6)
        elif kind == "email":
            test = test & F.contains(value, F.lit("@"))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds the number of the chunk of ``size`` rows, in order. The order is global, so rows are numbered over sorted partitions."""
    spark = df.sparkSession
    schema = df.schema.add("chunk", "long")
    numbered = df.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1] // size))
    return spark.createDataFrame(numbered, schema)


def percentage(part: Column, whole: Column, places: int = 1) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100 * part / whole, places))
