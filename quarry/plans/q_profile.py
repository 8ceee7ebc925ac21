"""Queries: profiles, quality and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ann as A
from ..operators import profile as Q
from ..operators import vectors as V
from .registry import query, sql_values, values


def _by_value(field: str) -> str:
    """The first type whose values most of a field's are, for the types that come before what the customers hold."""
    v = f"CAST({field} AS VARCHAR)"
    tests = (("person_name", "^[A-Z][a-z]+(\\s+[A-Z][a-z]+)+$|^[A-Z]+$"), ("company_name", "(?i)PVT\\.?\\s*LTD\\.?$|LIMITED$|LLP$|INC\\.?$|CORP\\.?$|CO\\.?$"), ("address", "(?i)^\\d+|street|road|colony|sector|village|mandal|district|pin.*\\d{6}"))
    return f"SELECT '{field}' AS field, CASE " + " ".join(f"WHEN (SELECT avg(regexp_matches({v}, '{p}')::INT) FROM customer) > 0.5 THEN '{k}'" for k, p in tests) + " END AS detected_type, 0.8::DOUBLE AS confidence"


@query("i01_field_types", "SELECT * FROM " + sql_values([("c_name", "person_name", 0.9), ("c_nationkey", "country", 0.9), ("c_acctbal", "account_number", 0.9)], "field, detected_type, confidence") + " UNION ALL " + _by_value("c_custkey") + " UNION ALL " + _by_value("c_mktsegment"))
def field_types(t) -> DataFrame:
    return Q.detect_types(t("customer"))


@query("i01_field_types_by_name", "SELECT * FROM " + sql_values([("FIR Date", "date", 0.9), ("case", "case_number", 0.7), ("crl no", "case_number", 0.9), ("acc", "account_number", 0.9), ("zz", "unknown", 0.0)], "field, detected_type, confidence"))
def types_by_name(t) -> DataFrame:
    return Q.detect_types(values(t, [(None,) * 5], "`FIR Date` string, `case` string, `crl no` string, acc string, zz string"))


_VALUES = [("a@b.org", "2024-01-02", "word one"), ("c@d.com", "2024-05-06", "x"), (None, "2024-07-08", "y9")]


@query("i01_types_by_value", "SELECT * FROM " + sql_values([("x1", "email", 0.8), ("x2", "address", 0.8), ("x3", "unknown", 0.0)], "field, detected_type, confidence"))
def types_by_value(t) -> DataFrame:
    return Q.detect_types(values(t, _VALUES, "x1 string, x2 string, x3 string"))


def _profile_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{c}' AS field, CAST(count_if({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') AS BIGINT) AS filled, CAST(count(*) - count_if({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') AS BIGINT) AS empty, count(DISTINCT coalesce(CAST({c} AS VARCHAR), 'null')) AS \"unique\", count(*) AS total FROM {table}" for c in columns)


@query("i02_profile", _profile_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))
def profiled(t) -> DataFrame:
    return Q.profile(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "orders")


@query("i03_key_fields", "SELECT 'nation' AS table_name, 'n_nationkey' AS field, false AS named UNION ALL SELECT 'nation', 'n_name', false")
def keys(t) -> DataFrame:
    return Q.key_fields(Q.profile(t("nation"), "nation"), "nation")


@query("i04_purpose", "SELECT * FROM " + sql_values([("fir_list", "case_data"), ("payments", "transaction_data"), ("staff_registry", "master_data"), ("clients", "master_data"), ("events", "logs"), ("codes", "reference_data")], "t, purpose"))
def purposes(t) -> DataFrame:
    cases = [("fir_list", []), ("payments", ["amount"]), ("staff_registry", []), ("clients", ["person_name", "company_name", "address"]), ("events", ["datetime"]), ("codes", ["category"])]
    return values(t, [(n, Q.purpose(n, k)) for n, k in cases], "t string, purpose string")


@query("i05_foreign_keys", """WITH c AS (SELECT DISTINCT 'customer' AS t, 'c_nationkey' AS f, CAST(c_nationkey AS VARCHAR) AS v FROM customer UNION SELECT 'nation', 'n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation UNION SELECT 'nation', 'n_name', n_name FROM nation UNION SELECT 'orders', 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders UNION SELECT 'customer', 'c_custkey', CAST(c_custkey AS VARCHAR) FROM customer),
n AS (SELECT t, f, count(*) AS n FROM c GROUP BY ALL)
SELECT x.t AS source_table, x.f AS source_field, y.t AS target_table, y.f AS target_field, count(*)::DOUBLE / least(any_value(a.n), any_value(b.n)) AS confidence FROM c x JOIN c y ON x.v = y.v AND x.t < y.t JOIN n a ON a.t = x.t AND a.f = x.f JOIN n b ON b.t = y.t AND b.f = y.f GROUP BY ALL""")
def foreign(t) -> DataFrame:
    return Q.foreign_keys({"customer": (t("customer"), ["c_custkey", "c_nationkey"]), "nation": (t("nation"), ["n_nationkey", "n_name"]), "orders": (t("orders"), ["o_custkey"])})


@query("i06_fill_rates", "SELECT 'part' AS table_name, * FROM " + sql_values([("p_partkey", "100.0"), ("p_name", "100.0")], "field, fill_rate"))
def fills(t) -> DataFrame:
    return Q.fill_rates(Q.profile(t("part").select("p_partkey", "p_name"), "part"))


_SQL_ENT = """e AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'alien' ELSE 'person' END AS type, CASE WHEN c_custkey % 13 = 0 THEN ' ' WHEN c_custkey % 17 = 0 THEN 'Same Name' WHEN c_custkey % 19 = 0 THEN 'same-name' ELSE c_name END AS name,
CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'bad mail' ELSE 'u' || c_custkey || '@x.org' END AS email, CASE WHEN c_custkey % 3 = 0 THEN '123' ELSE '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS phone, c_mktsegment AS address, CASE WHEN c_custkey % 9 = 0 THEN 'never' WHEN c_custkey % 2 = 0 THEN '1990-05-06' END AS dob, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'Acme' END AS company,
CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' - to_days(CAST(c_custkey AS INT)) END AS updated_at FROM customer)"""


def entities(t) -> DataFrame:
    """Customers as entities, with faults of every kind."""
    k = F.col("c_custkey")
    return t("customer").select(
        F.concat(F.lit("c"), k).alias("id"), F.when(k % 11 == 0, "alien").otherwise("person").alias("type"), F.when(k % 13 == 0, " ").when(k % 17 == 0, "Same Name").when(k % 19 == 0, "same-name").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 5 == 0, None).when(k % 7 == 0, "bad mail").otherwise(F.concat(F.lit("u"), k, F.lit("@x.org"))).alias("email"), F.when(k % 3 == 0, "123").otherwise(F.concat(F.lit("9"), F.lpad(k.cast("string"), 9, "0"))).alias("phone"), F.col("c_mktsegment").alias("address"), F.when(k % 9 == 0, "never").when(k % 2 == 0, "1990-05-06").alias("dob"), F.when(k % 2 == 0, None).otherwise("Acme").alias("company"),
        F.when(k % 4 == 0, None).otherwise(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' - make_dt_interval(int(c_custkey))")).alias("updated_at"),
    )


_FILLED = "(trim(name) <> '')::INT + 1 + (coalesce(trim(email), '') <> '')::INT + 1 + 1 + (company IS NOT NULL)::INT"
_MAIL = "(email IS NULL OR regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$'))::INT"
_PHONE = "(length(phone) BETWEEN 7 AND 15)::INT"
_DIMS = f"""d AS (SELECT count(*)::DOUBLE AS n, sum({_FILLED}) / (count(*)::DOUBLE * 6) AS completeness, avg(({_MAIL} * {_PHONE} * (coalesce(dob, '') <> 'never')::INT)::DOUBLE) AS accuracy, avg((type = 'person' AND trim(name) <> '')::INT::DOUBLE) AS validity,
avg(CASE WHEN updated_at IS NOT NULL THEN (updated_at >= TIMESTAMP '2024-01-01 00:00:00' - INTERVAL 365 DAY)::INT::DOUBLE END) AS timeliness, count(DISTINCT lower(concat_ws('|', type, name, coalesce(email, ''), phone))) / count(*)::DOUBLE AS uniqueness FROM e),
s AS (SELECT coalesce(sum(v), 0) AS spoiled FROM (SELECT count(DISTINCT name) AS v FROM e WHERE trim(name) <> '' GROUP BY regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) WHERE v > 1),
q AS (SELECT 'completeness' AS dimension, completeness AS score, 0.25::DOUBLE AS weight FROM d UNION ALL SELECT 'accuracy', accuracy, 0.2 FROM d UNION ALL SELECT 'consistency', greatest(0, 1 - spoiled / n), 0.15 FROM d, s UNION ALL SELECT 'timeliness', timeliness, 0.15 FROM d UNION ALL SELECT 'validity', validity, 0.15 FROM d UNION ALL SELECT 'uniqueness', uniqueness, 0.1 FROM d)"""


def dims(t) -> DataFrame:
    return Q.dimensions(entities(t), "2024-01-01")


@query("i07_dimensions", f"WITH {_SQL_ENT}, {_DIMS} SELECT dimension, round(score, 9) AS score, weight FROM q")
def dimensions(t) -> DataFrame:
    """Completeness, accuracy, consistency, timeliness, validity and uniqueness, i07 to i12."""
    return dims(t).withColumn("score", F.round("score", 9))


@query("i13_overall", f"WITH {_SQL_ENT}, {_DIMS} SELECT round(sum(score * weight) / sum(weight), 9) AS overall FROM q")
def overall(t) -> DataFrame:
    return Q.overall(dims(t)).select(F.round("overall", 9).alias("overall"))


@query("i14_issues", f"WITH {_SQL_ENT} SELECT id, 'email' AS field, 'invalid' AS issue, 'medium' AS severity FROM e WHERE email = 'bad mail' UNION ALL SELECT id, 'phone', 'invalid', 'low' FROM e WHERE phone = '123' UNION ALL SELECT id, 'name', 'blank', 'critical' FROM e WHERE trim(name) = ''")
def issues(t) -> DataFrame:
    return Q.issues(entities(t))


def _field_sql(c: str, good: str) -> str:
    there = f"coalesce(trim({c}), '') <> ''"
    return f"SELECT '{c}' AS field, count_if({there}) / count(*)::DOUBLE AS completeness, count_if({there} AND {good}) / count_if({there})::DOUBLE AS validity, count(DISTINCT CASE WHEN {there} THEN {c} END) / count_if({there})::DOUBLE AS \"uniqueness\" FROM e"


@query("i15_field_analysis", f"WITH {_SQL_ENT}, f AS ({' UNION ALL '.join(_field_sql(c, g) for c, g in (('name', 'true'), ('email', _MAIL + ' = 1'), ('phone', _PHONE + ' = 1'), ('address', 'true'), ('company', 'true')))}) SELECT *, concat_ws(',', CASE WHEN completeness < 0.5 THEN 'missing' END, CASE WHEN validity < 0.8 THEN 'invalid' END, CASE WHEN uniqueness < 0.7 THEN 'duplicates' END) AS flags FROM f")
def analysed(t) -> DataFrame:
    return Q.field_analysis(entities(t), {"name": None, "email": Q.valid_email, "phone": Q.valid_phone, "address": None, "company": None})


@query("i15_top_values", "SELECT field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM (SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL)) WHERE r <= 5")
def tops(t) -> DataFrame:
    return Q.top_values(t("part"), ["p_brand", "p_type"])


@query("i16_recommendations", f"WITH {_SQL_ENT}, {_DIMS} SELECT 'Improve ' || dimension AS recommendation FROM q WHERE score < 0.5 UNION ALL SELECT 'Resolve critical issues first'")
def recommended(t) -> DataFrame:
    return Q.recommendations(dims(t), Q.issues(entities(t)))


@query("i17_predicates", f"WITH {_SQL_ENT} SELECT id, coalesce(trim(email), '') <> '' AS has_email, coalesce({_MAIL} = 1 AND email IS NOT NULL, false) AS mail, {_PHONE} = 1 AS phone FROM e")
def predicates(t) -> DataFrame:
    return entities(t).select("id", Q.has_value(F.col("email")).alias("has_email"), Q.valid_email(F.col("email")).alias("mail"), Q.valid_phone(F.col("phone")).alias("phone"))


@query("n01_custom_validator", f"WITH {_SQL_ENT} SELECT round(avg((type = 'person' AND trim(name) <> '' AND address <> 'BUILDING')::INT::DOUBLE), 9) AS validity FROM e")
def validated(t) -> DataFrame:
    out = Q.dimensions(entities(t), "2024-01-01", validators={"address": lambda c: c != "BUILDING"})
    return out.where("dimension = 'validity'").select(F.round("score", 9).alias("validity"))


def vecs(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("j01_cosine", f"SELECT a.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def cosines(t) -> DataFrame:
    q = t("embeddings").where("vec_id = 0").first()["embedding"]
    return vecs(t).select("id", F.round(V.cosine("vector", F.array(*(F.lit(float(x)) for x in q))), 6).alias("score"))


@query("j02_zero_vectors", "SELECT vec_id AS id, 8 AS n, 0.0::DOUBLE AS score FROM embeddings")
def zero_vectors(t) -> DataFrame:
    out = V.embed(t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("text")), "text", size=8)
    return out.select("id", F.size("vector").alias("n"), V.cosine("vector", "vector").alias("score"))


@query("j03_nearest", f"SELECT a.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {_COS} DESC, id LIMIT 5")
def nearest(t) -> DataFrame:
    return V.nearest(vecs(t), t("embeddings").where("vec_id = 0").first()["embedding"], 5).withColumn("score", F.round("score", 6))


@query("j03_nearest_of_each", f"SELECT query, id, score FROM (SELECT b.vec_id AS query, a.vec_id AS id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS r FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0) WHERE r <= 5")
def nearest_of_each(t) -> DataFrame:
    v = vecs(t)
    return V.nearest_of_each(v.select("id", "vector"), v.where("id % 100 = 0").select(F.col("id").alias("query"), "vector"), 5).withColumn("score", F.round("score", 6))


@query("j03_nearest_by_index")
def nearest_by_index(t) -> DataFrame:
    """The five nearest of every hundredth vector, by an index of all vectors; tests hold its recall against brute force."""
    v = vecs(t)
    out = A.search(A.build(v, k=5), v.where("id % 100 = 0").select(F.col("id").alias("query"), "vector"), 5)
    return out.withColumn("score", F.round("score", 6))


@query("j05_near_pairs_by_index")
def pairs_by_index(t) -> DataFrame:
    """Near pairs by an index of all vectors; each is truly near, and tests hold how many are found against brute force."""
    return A.near_pairs(A.build(vecs(t), k=5), 0.4).withColumn("similarity", F.round("similarity", 6))


@query("j05_near_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.9")
def near_pairs(t) -> DataFrame:
    return V.near_pairs(vecs(t), 0.9).withColumn("similarity", F.round("similarity", 6))


@query("j05_near_pairs_looser", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= 0.4")
def looser_pairs(t) -> DataFrame:
    """At a limit that pairs of the tables reach."""
    return V.near_pairs(vecs(t), 0.4).withColumn("similarity", F.round("similarity", 6))


def _leaders_sql(threshold: float) -> str:
    """One row after the other joins the first leader that is near enough, or leads itself."""
    return f"""WITH RECURSIVE near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= {threshold}),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, coalesce(before, []) AS before FROM embeddings LEFT JOIN (SELECT b, list(a) AS before FROM near GROUP BY b) ON b = vec_id),
r(k, leaders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT p.k, CASE WHEN len(list_intersect(leaders, before)) > 0 THEN leaders ELSE list_append(leaders, vec_id) END FROM r JOIN p ON p.k = r.k + 1)
SELECT coalesce(list_min(list_intersect(leaders, before)), vec_id) AS leader, vec_id AS id FROM p, (SELECT leaders FROM r ORDER BY k DESC LIMIT 1)"""


@query("j04_leader_clusters", _leaders_sql(0.85))
def leaders(t) -> DataFrame:
    return V.leader_clusters(vecs(t), 0.85)


@query("j04_leader_clusters_looser", _leaders_sql(0.3))
def looser_leaders(t) -> DataFrame:
    """At a limit that vectors of the tables reach."""
    return V.leader_clusters(vecs(t), 0.3)


@query("j06_semantic_dedup", f"SELECT vec_id AS id FROM embeddings b WHERE NOT EXISTS (SELECT 1 FROM embeddings a WHERE a.vec_id < b.vec_id AND {_COS} >= 0.95)")
def semantic_dedup(t) -> DataFrame:
    v = vecs(t)
    pairs = V.near_pairs(v, 0.95).select(F.col("b").alias("id")).distinct()
    return v.select("id").join(pairs, "id", "left_anti")


@query("j07_representation", "SELECT s_suppkey, 'type: supplier; value: ' || s_name AS text FROM supplier")
def represented(t) -> DataFrame:
    return t("supplier").select("s_suppkey", V.representation({"type": F.lit("supplier"), "value": F.col("s_name"), "company": F.lit("")}).alias("text"))
