"""Table profiles, field types, likely foreign keys and data quality."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, digits, parse_date

# Field types in the order they are tried, each with patterns of names, patterns of values, and keywords.
FIELD_TYPES = (
    ("person_name", ("name", "full_?name", "first_?name", "last_?name", "suspect", "victim", "witness", "accused", "complainant", "applicant", "father_?name", "mother_?name", "spouse", "nominee"), (r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)+$", "^[A-Z]+$"), ("name", "suspect", "victim", "witness", "accused", "complainant", "applicant")),
    ("company_name", ("company", "firm", "organization", "org_?name", "business", "employer", "establishment"), (r"(?i)PVT\.?\s*LTD\.?$", "(?i)LIMITED$", "(?i)LLP$", r"(?i)INC\.?$", r"(?i)CORP\.?$", r"(?i)CO\.?$"), ("company", "firm", "organization", "business", "employer")),
    ("address", ("address", "addr", "location", "street", "residence", "perm_?addr", "present_?addr", "house", "building"), (r"^\d+", "(?i)street", "(?i)road", "(?i)colony", "(?i)sector", "(?i)village", "(?i)mandal", "(?i)district", r"(?i)pin.*\d{6}"), ("address", "location", "residence", "street", "house")),
    ("phone", ("phone", "mobile", "contact", "cell", "tel", "mob", "phone_?no"), (r"^[+]?[\d\s\-\(\)]{10,15}$", r"^\d{10}$", r"^[+]?91\d{10}$"), ("phone", "mobile", "contact", "cell")),
    ("email", ("email", "mail", "e_?mail"), (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",), ("email", "mail")),
    ("date", ("date", "_date$", "^dt_", "dob", "birth", "reg_?date", "created", "updated"), (r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$"), ("date", "dob", "birth", "created", "updated")),
    ("datetime", ("datetime", "timestamp", "created_at", "updated_at", "time"), (r"^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}",), ("datetime", "timestamp", "created_at", "updated_at")),
    ("amount", ("amount", "amt", "value", "price", "cost", "fee", "balance", "deposit", "withdrawal", "transaction", "sum"), (r"^[\d,]+\.?\d*$", r"(?i)^Rs\.?\s*\d", r"^\$\s*\d", r"(?i)^INR\s*\d"), ("amount", "value", "price", "cost", "balance", "deposit")),
    ("currency", ("currency", "curr"), ("(?i)^INR$", "(?i)^USD$", "(?i)^EUR$", "^₹$"), ("currency",)),
    ("id_number", ("id", "_id$", "^id_", "identifier"), (r"^\d+$", r"^[A-Z0-9\-]{5,30}$"), ("id", "identifier")),
    ("pan_number", ("pan", "pan_?no", "pan_?card"), (r"^[A-Z]{5}\d{4}[A-Z]$",), ("pan",)),
    ("aadhaar_number", ("aadhaar", "aadhar", "uid", "uidai"), (r"^\d{4}\s?\d{4}\s?\d{4}$", r"^\d{12}$"), ("aadhaar", "aadhar", "uid")),
    ("account_number", ("account", "acc", "acc_?no", "bank_?acc"), (r"^\d{9,18}$",), ("account", "acc")),
    ("ifsc_code", ("ifsc", "bank_?code"), ("^[A-Z]{4}0[A-Z0-9]{6}$",), ("ifsc",)),
    ("case_number", ("case_?no", "case_?id", "fir_?no", "sc_?no", "cc_?no", "crl_?no"), (r"^\d+/\d{4}$", r"^[A-Z]+/\d+/\d{4}$", r"(?i)^FIR\s*\d+"), ("case", "fir", "sc", "cc", "crl")),
    ("fir_number", ("fir", "fir_?no", "fir_?number"), (r"^\d+/\d{4}$", r"(?i)^FIR\s*\d+"), ("fir",)),
    ("vehicle_number", ("vehicle", "reg_?no", "number_?plate", "chassis", "engine"), (r"(?i)^[A-Z]{2}\d{1,2}[A-Z]{1,2}\d{4}$", r"(?i)^[A-Z]{3}\d{4}$"), ("vehicle", "reg_no", "number_plate")),
    ("ip_address", ("ip", "ip_?address"), (r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",), ("ip", "ip_address")),
    ("url", ("url", "website", "link", "domain"), ("(?i)^https?://", r"(?i)^www\."), ("url", "website", "link")),
    ("age", ("age", "_age$"), (r"^\d{1,3}$", r"^(1[0-5]|[1-9]\d?)$"), ("age",)),
    ("gender", ("gender", "sex"), ("(?i)^[MF]$", "(?i)^male$", "(?i)^female$", "(?i)^other$"), ("gender", "sex")),
    ("occupation", ("occupation", "profession", "job", "designation", "role"), (), ("occupation", "profession", "job", "designation")),
    ("relation", ("relation", "relationship", "relative", "kin", "guardian"), ("(?i)S/O", "(?i)D/O", "(?i)W/O", "(?i)H/O", "(?i)son of", "(?i)daughter of"), ("relation", "relationship", "relative", "kin")),
    ("location", ("place", "spot", "area", "locality", "venue", "scene"), (), ("place", "spot", "area", "locality", "venue")),
    ("district", ("district", "dist", "zilla"), (), ("district", "dist")),
    ("state", ("state", "province"), (), ("state",)),
    ("country", ("country", "nation", "nationality"), ("(?i)^INDIA$", "(?i)^USA$", "(?i)^IN$"), ("country", "nation", "nationality")),
    ("pincode", ("pin", "pincode", "postal", "zip"), (r"^\d{6}$", r"^\d{5}$"), ("pin", "pincode", "postal", "zip")),
    ("description", ("description", "desc", "details", "remarks", "notes", "narrative", "summary", "comment", "observation"), (), ("description", "details", "remarks", "notes", "narrative")),
    ("status", ("status", "stage", "state$"), ("(?i)^(active|inactive|pending|closed|open|resolved|under.*investigation)$",), ("status", "stage")),
    ("category", ("category", "type", "classification", "kind"), (), ("category", "type", "classification")),
    ("priority", ("priority", "urgency", "importance"), ("(?i)^(high|medium|low|critical|urgent)$",), ("priority", "urgency")),
)
# Weight of each quality dimension.
WEIGHTS = {"completeness": 0.25, "accuracy": 0.20, "consistency": 0.15, "timeliness": 0.15, "validity": 0.15, "uniqueness": 0.10}
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
ENTITY_TYPES = ("person", "company", "address", "phone", "email", "bank_account", "transaction", "document", "vehicle", "property", "event", "location", "unknown")


def type_by_name(field: str, strict: bool = False) -> tuple[str, float] | None:
    """The first type of which a name pattern (.9) or a keyword (.7) occurs in the field's name. strict: only at word limits."""
    edge = (r"(?<![a-z])", r"(?![a-z])") if strict else ("", "")
    forms = (field, re.sub("[^a-z0-9]", "_", field.lower()))
    for kind, names, _, keywords in FIELD_TYPES:
        if any(re.search(rf"{edge[0]}(?:{'|'.join(names)}){edge[1]}", f, re.IGNORECASE) for f in forms):
            return kind, 0.9
        if any(re.search(edge[0] + w + edge[1], forms[1]) for w in keywords):
            return kind, 0.7
    return None


def detect_types(df: DataFrame, sample: int | None = None, strict: bool = False) -> DataFrame:
    """(field, detected_type, confidence): by name, else by more than half of the values, else unknown.

    sample: so many rows only, the first in the order of the columns that the name leaves open."""
    spark, names = df.sparkSession, {c: type_by_name(c, strict) for c in df.columns}
    rows = [(c, *x) for c, x in names.items() if x]
    open_ = [c for c, x in names.items() if not x]
    if open_:
        few = df.select(*(blank_to_null(F.col(c)).alias(c) for c in open_))
        few = few.orderBy(*open_).limit(sample) if sample else few
        tests = [(c, k) for c in open_ for k, _, v, _ in FIELD_TYPES if v]
        patterns = {k: "|".join(f"(?:{x})" for x in v) for k, _, v, _ in FIELD_TYPES}
        got = few.agg(*(F.avg(F.col(c).rlike(patterns[k]).cast("double")).alias(f"{c}|{k}") for c, k in tests)).first()
        for c in open_:
            kind = next((k for x, k in tests if x == c and (got[f"{c}|{k}"] or 0) > 0.5), None)
            rows.append((c, kind or "unknown", 0.8 if kind else 0.0))
    return spark.createDataFrame(rows, "field string, detected_type string, confidence double")


def profile(df: DataFrame, table: str) -> DataFrame:
    """(table_name, field, filled, empty, unique, total); distinct values are counted exactly, null as the text null.

    Cells are counted by field and value, map tasks first, so a row is read once and goes on as one row per field, and a
    value that most rows have is no hot key.
    """
    spark, names = df.sparkSession, df.columns
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("f"), F.col(c).cast("string").alias("v")) for k, c in enumerate(names)))))
    values = cells.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    full = F.coalesce(F.col("v") != "", F.lit(False))
    counts = values.groupBy("f").agg(F.sum(F.when(full, F.col("n")).otherwise(0)).alias("filled"), F.sum(F.when(full, 0).otherwise(F.col("n"))).alias("empty"), F.countDistinct(F.coalesce("v", F.lit("null"))).alias("unique"), F.sum("n").alias("total"))
    # a row per field, also for a table without rows
    fields = spark.createDataFrame(list(enumerate(names)), "f int, field string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fields.join(F.broadcast(counts), "f", "left").select(F.lit(table).alias("table_name"), "field", *(zero(c) for c in ("filled", "empty", "unique", "total")))


def key_fields(prof: DataFrame, table: str) -> DataFrame:
    """Candidates for a key: filled and unique in every row, and whether the name says so."""
    return prof.where("total > 0 and filled = total and unique = total").select("table_name", "field", F.lower("field").isin("id", f"{table}_id").alias("named"))


def purpose(table: str, kinds: list[str]) -> str:
    name = table.lower()
    if any(w in name for w in ("case", "fir", "crime", "incident")):
        return "case_data"
    if any(w in name for w in ("transaction", "payment", "transfer", "log")) and ("amount" in kinds or "datetime" in kinds):
        return "transaction_data"
    if "master" in name or "registry" in name:
        return "master_data"
    people = sum(k in ("person_name", "company_name") for k in kinds)
    if people >= 2 and "address" in kinds:
        return "master_data"
    return "logs" if "datetime" in kinds and not people else "reference_data"


def foreign_keys(tables: dict[str, tuple[DataFrame, list[str]]], least: float = 0.0) -> DataFrame:
    """(source_table, source_field, target_table, target_field, confidence): shared values over the smaller set of
    distinct values, for fields of different tables. All values count; the join is on the value."""
    cells = None
    for name, (df, fields) in tables.items():
        rows = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in fields)))).where("v is not null and v <> ''").select(F.lit(name).alias("t"), "f", "v").distinct()
        cells = rows if cells is None else cells.unionByName(rows)
    sizes = cells.groupBy("t", "f").agg(F.count(F.lit(1)).alias("n"))
    x, y = cells.alias("x"), cells.alias("y")
    both = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.t") < F.col("y.t"))).groupBy(F.col("x.t").alias("source_table"), F.col("x.f").alias("source_field"), F.col("y.t").alias("target_table"), F.col("y.f").alias("target_field")).agg(F.count(F.lit(1)).alias("shared"))
    a, b = (sizes.select(F.col("t").alias(f"{s}_table"), F.col("f").alias(f"{s}_field"), F.col("n").alias(m)) for s, m in (("source", "n1"), ("target", "n2")))
    out = both.join(F.broadcast(a), ["source_table", "source_field"]).join(F.broadcast(b), ["target_table", "target_field"])  # a row per field
    return out.select("source_table", "source_field", "target_table", "target_field", (F.col("shared") / F.least("n1", "n2")).alias("confidence")).where(F.col("confidence") > least)


def fill_rates(prof: DataFrame) -> DataFrame:
    return prof.select("table_name", "field", F.when(F.col("total") == 0, "0.0").otherwise(F.format_string("%.1f", 100 * F.col("filled") / F.col("total"))).alias("fill_rate"))


def has_value(c: Column) -> Column:
    return blank_to_null(c).isNotNull()


def valid_email(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(EMAIL), F.lit(False))


def valid_phone(c: Column) -> Column:
    return F.coalesce(F.length(digits(c)).between(7, 15), F.lit(False))


def valid_date(c: Column) -> Column:
    return parse_date(c).isNotNull()


def entity_key() -> Column:
    return F.lower(F.concat_ws("|", F.coalesce("type", F.lit("")), F.coalesce("name", F.lit("")), F.coalesce("email", F.lit("")), F.coalesce("phone", F.lit(""))))


def dimensions(e: DataFrame, now: str, required: tuple[str, ...] = ("name", "type"), validators: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(dimension, score, weight) of entities (type, name, email, phone, address, company, updated_at, and dob if known).

    Completeness counts filled cells; accuracy the rows whose e-mail, phone and date of birth are right or absent; consistency spoils
    rows whose normalised name is written in several ways; timeliness the rows changed within 365 days of ``now`` (.5 if
    none says); validity rows with a known type, a name and no failed validator; uniqueness distinct keys.
    """
    fields = [c for c in dict.fromkeys((*required, "email", "phone", "address", "company")) if c in e.columns]
    n = F.count(F.lit(1))
    filled = reduce(lambda a, b: a + b, [F.sum(has_value(F.col(c)).cast("long")) for c in fields])
    ok_mail = ~has_value(F.col("email")) | valid_email(F.col("email"))
    ok_phone = ~has_value(F.col("phone")) | valid_phone(F.col("phone"))
    ok_birth = ~has_value(F.col("dob")) | valid_date(F.col("dob")) if "dob" in e.columns else F.lit(True)
    valid = F.coalesce(F.col("type").isin(*ENTITY_TYPES), F.lit(False)) & has_value(F.col("name"))
    for c, check in (validators or {}).items():
        valid = valid & (~has_value(F.col(c)) | F.coalesce(check(F.col(c)), F.lit(False)))
    fresh = F.col("updated_at") >= F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 365 DAYS")
    one = e.agg(
        n.alias("n"), (filled / (n * len(fields))).alias("completeness"), F.avg((ok_mail & ok_phone & ok_birth).cast("double")).alias("accuracy"), F.avg(valid.cast("double")).alias("validity"),
        F.coalesce(F.avg(F.when(F.col("updated_at").isNotNull(), fresh.cast("double"))), F.lit(0.5)).alias("timeliness"), (F.countDistinct(entity_key()) / n).alias("uniqueness"),
    )
    plain = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    spelled = e.where(has_value(F.col("name"))).groupBy(plain.alias("k")).agg(F.countDistinct("name").alias("v")).where("v > 1").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("spoiled"))
    row = one.crossJoin(spelled).withColumn("consistency", F.greatest(F.lit(0.0), 1 - F.col("spoiled") / F.col("n")))
    return row.select(F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit(0.0)).alias("score"), F.lit(w).alias("weight")) for d, w in WEIGHTS.items()))))


def overall(dims: DataFrame) -> DataFrame:
    return dims.agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("overall"))


def issues(e: DataFrame, required: tuple[str, ...] = ("type",)) -> DataFrame:
    """(id, field, issue, severity)."""
    found = [F.when(~has_value(F.col(c)), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("issue"), F.lit("high").alias("severity"))) for c in required]
    found += [
        F.when(has_value(F.col("email")) & ~valid_email(F.col("email")), F.struct(F.lit("email").alias("field"), F.lit("invalid").alias("issue"), F.lit("medium").alias("severity"))),
        F.when(has_value(F.col("phone")) & ~valid_phone(F.col("phone")), F.struct(F.lit("phone").alias("field"), F.lit("invalid").alias("issue"), F.lit("low").alias("severity"))),
        F.when(~has_value(F.col("name")), F.struct(F.lit("name").alias("field"), F.lit("blank").alias("issue"), F.lit("critical").alias("severity"))),
    ]
    return e.select("id", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def field_analysis(e: DataFrame, checks: dict[str, Callable[[Column], Column] | None]) -> DataFrame:
    """(field, completeness, validity, uniqueness, flags) and, in top_values(), the five most frequent values."""
    total = F.count(F.lit(1))
    parts = []
    for c, check in checks.items():
        there = has_value(F.col(c))
        full, good = F.count_if(there), F.count_if(there & (check(F.col(c)) if check else F.lit(True)))
        kinds = F.countDistinct(F.when(there, F.col(c)))
        parts.append(F.struct(F.lit(c).alias("field"), (full / total).alias("completeness"), F.when(full == 0, 1.0).otherwise(good / full).alias("validity"), F.when(full == 0, 1.0).otherwise(kinds / full).alias("uniqueness")).alias(c))
    rows = e.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    flags = F.concat_ws(",", F.when(F.col("completeness") < 0.5, "missing"), F.when(F.col("validity") < 0.8, "invalid"), F.when(F.col("uniqueness") < 0.7, "duplicates"))
    return rows.withColumn("flags", flags)


def top_values(e: DataFrame, fields: list[str], k: int = 5) -> DataFrame:
    counts = e.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields)))).where(has_value(F.col("value"))).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def recommendations(dims: DataFrame, problems: DataFrame) -> DataFrame:
    """(recommendation): one for each dimension under one half, and one if there are critical issues."""
    weak = dims.where("score < 0.5").select(F.concat(F.lit("Improve "), "dimension").alias("recommendation"))
    critical = problems.where("severity = 'critical'").limit(1).select(F.lit("Resolve critical issues first").alias("recommendation"))
    return weak.unionByName(critical)
