"""Queries: resolution, relations, patterns, anomalies and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import patterns as P
from ..operators import resolve as X
from .q_graph import _SQL_M, _SQL_P, mentions
from .registry import query, sql_values, values

_NAMES = [("e1", "name", "rajesh kumar"), ("e2", "name", "rajesh kumarr"), ("e3", "name", "rajesh kumaar"), ("e4", "name", "meena shah"), ("e5", "organization", "rajesh kumar"), ("e6", "name", "meena shah"), ("e7", "name", "x")]
_SCHEMA = "id string, type string, normalized string"


@query("g01_blocking_keys", "SELECT * FROM " + sql_values([("e1", "prefix:name:ra,phonetic:r97256,length:name:2"), ("e4", "prefix:name:me,phonetic:m57,length:name:2"), ("e7", "phonetic:x,length:name:0")], "id, keys"))
def blocking(t) -> DataFrame:
    e = values(t, _NAMES, _SCHEMA).where("id in ('e1', 'e4', 'e7')")
    return e.select("id", F.array_join(X.blocking_keys(F.col("type"), F.col("normalized")), ",").alias("keys"))


@query("g02_similarity_score", "SELECT * FROM " + sql_values([("e1", "e2", round((1 - 1 / 13) * 0.6 + 0.0, 6)), ("e1", "e3", round((1 - 1 / 13) * 0.6 + 0.3, 6)), ("e4", "e6", 1.0), ("e1", "e5", 0.0)], "a, b, score"))
def scored(t) -> DataFrame:
    e = values(t, _NAMES, _SCHEMA)
    pairs = e.alias("x").join(e.alias("y"), F.expr("(x.id, y.id) in (('e1', 'e2'), ('e1', 'e3'), ('e4', 'e6'), ('e1', 'e5'))"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.round(X.similarity_score("x", "y"), 6).alias("score"))


@query("g03_resolve", "SELECT * FROM " + sql_values([("e1", "e1"), ("e2", "e2"), ("e3", "e1"), ("e4", "e4"), ("e5", "e5"), ("e6", "e4"), ("e7", "e7")], "id, cluster"))
def resolved(t) -> DataFrame:
    return X.resolve(values(t, _NAMES, _SCHEMA))


@query("g04_string_similarity", "SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(lower(a.p_name), lower(b.p_name))::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def similar_parts(t) -> DataFrame:
    """All pairs of a brand and size. Each two names are compared once, however many parts have them."""
    return X.scored_pairs(t("part"), "p_partkey", "p_name", ["p_brand", "p_size"]).withColumn("similarity", F.round("similarity", 6))


@query("g05_phonetic", "SELECT n_nationkey, substr(lower(n_name), 1, 1) || regexp_replace(translate(replace(replace(replace(replace(replace(regexp_replace(substr(lower(n_name), 2), '[0-9]', ' ', 'g'), 'bh', '1'), 'ch', '2'), 'dh', '3'), 'th', '3'), 'sh', '7'), 'bpckqdtlmnrsvwjgz', '11222334556788999'), '[^0-9]', '', 'g') AS code FROM nation")
def phonetic(t) -> DataFrame:
    return t("nation").select("n_nationkey", T.phonetic(F.col("n_name")).alias("code"))


@query("g06_compare", "SELECT 'e1' AS a, 'e5' AS b, 1.0 AS score")
def compared(t) -> DataFrame:
    e = values(t, _NAMES, _SCHEMA)
    pairs = e.alias("x").join(e.alias("y"), F.expr("x.id = 'e1' and y.id = 'e5'"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), X.compare(F.col("x.type"), F.col("x.normalized"), F.col("y.type"), F.col("y.normalized")).alias("score"))


@query("g07_merge", "SELECT * FROM " + sql_values([("e1", "rajesh kumaar|rajesh kumar|rajesh kumarr", 0.9, 4), ("e4", "meena shah", 0.9, 2), ("e7", "x", 0.9, 1)], "id, aliases, confidence, merged_from"))
def merged(t) -> DataFrame:
    return X.merge(values(t, _NAMES, _SCHEMA).withColumn("confidence", F.lit(0.9))).withColumn("aliases", F.array_join("aliases", "|")).withColumn("merged_from", F.col("merged_from").cast("int"))


@query("g08_normalize", "SELECT p_partkey, trim(regexp_replace(lower(p_type || '. (' || p_brand || ')'), '[\\s\\-_.,;:''\"()]+', ' ', 'g')) AS name FROM part")
def normalised(t) -> DataFrame:
    return t("part").select("p_partkey", T.normalize_string(F.concat("p_type", F.lit(". ("), "p_brand", F.lit(")"))).alias("name"))


@query("g09_record_entities", "SELECT 'supplier:' || s_suppkey || ':company' AS id, 'company' AS type, s_name AS name, '9' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS phone FROM supplier UNION ALL SELECT 'supplier:' || s_suppkey || ':person', 'person', 'owner ' || s_suppkey, '9' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier WHERE s_suppkey % 2 = 0")
def entities_of(t) -> DataFrame:
    s = t("supplier").select("s_suppkey", F.col("s_name").alias("company"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("owner "), "s_suppkey")).otherwise(" ").alias("name"), F.concat(F.lit("9"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("phone"))
    return X.record_entities(s, "supplier", "s_suppkey").select("id", "type", "name", "phone")


@query("g10_merge_duplicates", "SELECT 'brand' AS type, lower(replace(p_brand, '#', '#')) AS normalized, min_by(p_brand, p_partkey) AS name, CAST(min(p_partkey) AS VARCHAR) AS phone FROM part GROUP BY p_brand")
def deduplicated(t) -> DataFrame:
    e = t("part").select(F.lit("brand").alias("type"), F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("phone"), F.lit("part").alias("source"), F.col("p_partkey").alias("seq"))
    return X.merge_duplicates(e, "seq").select("type", "normalized", "name", "phone")


_PAIRS = [("R. Kumar", "Rajesh Kumar x", False), ("Rajesh", "Rajesh Kumar", True), ("asha", "ASHA", True), ("R K", "Ravi Kumar Shah", True), ("Meena Shah", "Reena Shah", False)]


@query("g12_initials", "SELECT a, b, m FROM " + sql_values(_PAIRS, "a, b, m"))
def initials(t) -> DataFrame:
    df = values(t, [p[:2] for p in _PAIRS], "a string, b string")
    return df.select("a", "b", T.initials_match(F.col("a"), F.col("b")).alias("m"))


_CONTACTS = [("e1", "+91 90000 00001", "a@b.c"), ("e2", "9000000001", None), ("e3", None, "A@B.C "), ("e4", "12", "")]


@query("g13_record_similarity", "SELECT * FROM " + sql_values([("e1", "e2", 1.0), ("e1", "e3", 0.98), ("e1", "e4", 0.5), ("e2", "e3", 0.5), ("e2", "e4", 0.5), ("e3", "e4", 0.5)], "a, b, s"))
def record_similarity(t) -> DataFrame:
    e = values(t, _CONTACTS, "id string, phone string, email string")
    return e.alias("x").join(e.alias("y"), F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), X.record_similarity("x", "y", F.lit(0.5)).alias("s"))


_DATES = [(1, "15/01/2024"), (2, "5-3-2023"), (3, "2024-02-29"), (4, "soon"), (5, None)]


@query("g15_parse_date", "SELECT * FROM " + sql_values([(1, "2024-01-15"), (2, "2023-03-05"), (3, "2024-02-29"), (4, None), (5, None)], "id, d"))
def dates(t) -> DataFrame:
    return values(t, _DATES, "id int, v string").select("id", F.date_format(T.parse_date(F.col("v")), "yyyy-MM-dd").alias("d"))


@query("g16_days_between", "SELECT l_orderkey, l_linenumber, l_partkey, abs(datediff('day', o_orderdate, l_shipdate)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def day_gaps(t) -> DataFrame:
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", X.days_between(F.col("l_shipdate"), F.col("o_orderdate")).cast("long").alias("days"))


_ENTITIES = [
    ("p1", "person", "Asha Rao", "90000-00001", "a@x.org", "12 Lake Road, Pune", "Acme Ltd", None, None), ("p2", "person", "Bina Rao", "+919000000001", None, "12 Lake Road Pune", None, "77", None), ("p3", "person", "Cara", None, "A@X.org", "12 Lake Rd. Pune", "ACME LTD.", "77", None),
    ("c1", "company", "Acme Ltd", None, None, "12 Lake Road Pune", None, None, None), ("c2", "company", "Zeta", "9000000009", None, "12 Lake Road, Pune", None, None, "z.org"), ("c3", "company", "Yota", "9000000009", None, "12 lake road pune", None, None, None),
]
_ESCHEMA = "id string, type string, name string, phone string, email string, address string, company string, account string, website string"


@query("f19_relations", "SELECT * FROM " + sql_values([("c2", "c3", "shared_contact", 0.95), ("p1", "p2", "shared_contact", 0.95), ("p1", "p3", "shared_contact", 0.99), ("p2", "p3", "financial_link", 0.99), ("p1", "p2", "shared_address", 1.0), ("p1", "p3", "shared_address", round(1 - 2 / 17, 6)), ("p2", "p3", "shared_address", round(1 - 2 / 17, 6)), ("p1", "c1", "employed_by", 0.85), ("p3", "c1", "employed_by", 0.85)], "a, b, type, strength"))
def relations(t) -> DataFrame:
    return X.relations(values(t, _ENTITIES, _ESCHEMA)).withColumn("strength", F.round("strength", 6))


@query("h13_address_sharing", "SELECT '12 lake road pune' AS value, 5 AS n, 'high' AS severity")
def address_sharing(t) -> DataFrame:
    return P.address_sharing(values(t, _ENTITIES, _ESCHEMA)).withColumn("n", F.col("n").cast("int"))


@query("h14_contact_sharing", "SELECT * FROM " + sql_values([("phone", "9000000001", 2, "medium"), ("phone", "9000000009", 2, "medium"), ("email", "a@x.org", 2, "medium")], "kind, value, n, severity"))
def contact_sharing(t) -> DataFrame:
    return P.contact_sharing(values(t, _ENTITIES, _ESCHEMA)).withColumn("n", F.col("n").cast("int"))


@query("h15_hasty_changes", "SELECT 'o' || o_orderkey AS id, CAST(abs(datediff('day', o_orderdate, s)) AS INT) AS days FROM (SELECT o_orderkey, o_orderdate, min(l_shipdate) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) WHERE abs(datediff('day', o_orderdate, s)) BETWEEN 1 AND 6")
def hasty(t) -> DataFrame:
    j = t("orders").join(t("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("updated_at")), F.col("o_orderkey") == F.col("l_orderkey"))
    return P.hasty_changes(j.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), "updated_at"))


@query("h16_shared_accounts", "SELECT '77' AS account, 2 AS n")
def accounts(t) -> DataFrame:
    return P.shared_accounts(values(t, _ENTITIES, _ESCHEMA)).withColumn("n", F.col("n").cast("int"))


@query("h17_shell_companies", "SELECT * FROM " + sql_values([("c1", 0.4, "medium"), ("c2", 0.55, "medium"), ("c3", 0.65, "high")], "id, score, severity"))
def shells(t) -> DataFrame:
    return P.shell_companies(values(t, _ENTITIES, _ESCHEMA)).withColumn("score", F.round("score", 6))


@query("h18_circular_relations", "SELECT 'x>y>z' AS cycle, 'high' AS severity, 0.85 AS score")
def circular(t) -> DataFrame:
    from .q_graph import edges

    return G.cycles(edges(t), 4).select(F.array_join("cycle", ">").alias("cycle"), F.lit("high").alias("severity"), F.lit(0.85).alias("score"))


@query("h19_severity_order", "SELECT * FROM " + sql_values([("critical", 0), ("high", 1), ("medium", 2), ("low", 3)], "severity, rank"))
def severities(t) -> DataFrame:
    return values(t, [("low",), ("critical",), ("medium",), ("high",)], "severity string").withColumn("rank", P.severity_rank(F.col("severity"))).orderBy("rank")


_DEG = f"{_SQL_M}, {_SQL_P}, n AS (SELECT DISTINCT entity AS id FROM m), d AS (SELECT n.id, coalesce(c, 0) AS degree FROM n LEFT JOIN (SELECT v, count(*) AS c FROM (SELECT a AS v FROM p UNION ALL SELECT b FROM p) GROUP BY v) ON n.id = v)"


def degree(t) -> DataFrame:
    m = mentions(t)
    return G.degrees(m.select(F.col("entity").alias("id")).distinct(), G.pair_counts(m))


@query("h01_frequent_nodes", f"WITH {_DEG} SELECT id, degree AS frequency, least(degree::DOUBLE / 50, 1) AS significance FROM d WHERE degree > 10 AND least(degree::DOUBLE / 50, 1) >= 0.7")
def frequent(t) -> DataFrame:
    return P.frequent_nodes(degree(t))


@query("h06_outliers", f"WITH {_DEG} SELECT id, round((degree - (SELECT avg(degree) FROM d)) / (SELECT stddev_pop(degree) FROM d), 6) AS z FROM d WHERE abs((degree - (SELECT avg(degree) FROM d)) / (SELECT stddev_pop(degree) FROM d)) > 2.5")
def outlying(t) -> DataFrame:
    return P.outliers(degree(t)).withColumn("z", F.round("z", 6))


_MONEY = [("a", "b", "financial"), ("b", "a", "financial"), ("b", "c", "financial"), ("c", "a", "financial"), ("c", "b", "other"), ("d", "d", "financial")]


@query("h02_money_circles", "SELECT * FROM " + sql_values([("a>b", 0.9), ("a>b>c", 0.95)], "cycle, significance"))
def circles(t) -> DataFrame:
    return P.money_circles(values(t, _MONEY, "source string, target string, type string"))


@query("h03_daily_spikes", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM (SELECT ts FROM events UNION ALL SELECT ts FROM events WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events) UNION ALL SELECT ts FROM events WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events)) GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, n, n / (3 * (SELECT avg(n) FROM d)) AS significance FROM d WHERE n > 2 * (SELECT avg(n) FROM d) AND n >= 3 AND n / (3 * (SELECT avg(n) FROM d)) >= 0.6")
def spikes(t) -> DataFrame:
    """The first day's events are counted three times, to make a spike."""
    e = t("events").select("ts")
    first = e.agg(F.min(F.to_date("ts")).alias("f"))
    day = e.join(F.broadcast(first), F.to_date("ts") == F.col("f")).select("ts")
    return P.daily_spikes(e.unionByName(day).unionByName(day), "ts").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("h04_location_clusters", "SELECT 'n' || c_nationkey AS id, count(*) AS frequency, count(*)::DOUBLE / 10 AS significance FROM customer GROUP BY c_nationkey HAVING count(*) >= 5")
def located(t) -> DataFrame:
    c = t("customer")
    nodes = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("location").alias("type"))
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.lit("location").alias("type"))
    return P.location_clusters(nodes, edges)


_KINDS = [("a", "person"), ("b", "phone"), ("c", "account"), ("d", "amount"), ("e", "vehicle")]
_KEDGES = [("a", "b", "x"), ("b", "d", "x"), ("c", "d", "x"), ("e", "a", "x"), ("a", "e", "x")]


@query("h07_type_mismatches", "SELECT * FROM " + sql_values([("b", "d", "phone", "amount", 0.85), ("e", "a", "vehicle", "person", 0.85), ("a", "e", "person", "vehicle", 0.85)], "source, target, source_type, target_type, score"))
def mismatches(t) -> DataFrame:
    return P.type_mismatches(values(t, _KINDS, "id string, type string"), values(t, _KEDGES, "source string, target string, type string"))


_SQL_HUB = "e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'f' || l_returnflag FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 't' || l_linestatus FROM lineitem), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def hub_edges(t) -> DataFrame:
    l = t("lineitem")
    return G.written(l.select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.explode(F.array(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("f"), "l_returnflag"), F.concat(F.lit("t"), "l_linestatus"))).alias("b")).distinct())


@query("h08_hidden_hubs", f"WITH {_SQL_HUB} SELECT a AS id, count(*) AS neighbours, count(DISTINCT substr(b, 1, 1)) AS types, count(DISTINCT substr(b, 1, 1))::DOUBLE / 5 AS score FROM l GROUP BY a HAVING count(*) > 5 AND count(DISTINCT substr(b, 1, 1)) >= 3")
def hubs(t) -> DataFrame:
    e = hub_edges(t)
    nodes = e.select(F.col("a").alias("id")).union(e.select("b")).distinct().withColumn("type", F.substring("id", 1, 1))
    return P.hidden_hubs(nodes, e)


def risk_graph(t) -> tuple[DataFrame, DataFrame]:
    """Customers pay suppliers; both lie in nations; accounts lead to customers."""
    o, l, c = t("orders"), t("lineitem"), t("customer")
    pay = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.lit("financial").alias("type"))
    lie = c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.lit("location").alias("type"))
    acc = c.select(F.concat(F.lit("a"), "c_custkey").alias("source"), F.concat(F.lit("c"), F.col("c_custkey") % 400).alias("target"), F.lit("owns").alias("type"))
    edges = pay.unionByName(lie).unionByName(acc)
    kind = G.case_map(F.substring("id", 1, 1), {"c": "person", "s": "organization", "n": "location", "a": "account"}, "other")
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().withColumn("type", kind), edges


_SQL_RISK = """e AS (SELECT 'c' || o_custkey AS s, 's' || l_suppkey AS t, 'financial' AS ty FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'location' FROM customer UNION ALL SELECT 'a' || c_custkey, 'c' || (c_custkey % 400), 'owns' FROM customer),
x AS (SELECT s AS id, t AS o, ty, 0 AS i FROM e UNION ALL SELECT t, s, ty, 1 FROM e),
g AS (SELECT id, count_if(ty = 'financial') AS fin, count(*) AS deg, count(DISTINCT CASE WHEN o LIKE 'n%' THEN o END) AS loc, count_if(o LIKE 'a%' AND i = 1) AS acc, sum(i)::DOUBLE AS i, sum(1 - i)::DOUBLE AS o FROM x GROUP BY id),
r AS (SELECT *, CASE WHEN o = 0 THEN i ELSE i / o END AS ratio FROM g),
f AS (SELECT id, least(fin / 10, 1)::DOUBLE AS high_value, least(deg / 50, 1)::DOUBLE AS frequent, CASE WHEN loc > 1 THEN least(loc / 5, 1) ELSE 0 END::DOUBLE AS cross_border, CASE WHEN acc > 2 THEN least(acc / 5, 1) ELSE 0 END::DOUBLE AS multiple_accounts,
CASE WHEN ratio = 0 THEN 1 WHEN ratio > 5 OR ratio < 0.2 THEN least(abs(log10(ratio)) / 2, 1) ELSE 0 END::DOUBLE AS unusual FROM r)"""


@query("h09_risk_factors", f"WITH {_SQL_RISK} SELECT id, high_value, frequent, cross_border, multiple_accounts, round(unusual, 9) AS unusual FROM f")
def factors(t) -> DataFrame:
    return P.risk_factors(*risk_graph(t)).withColumn("unusual", F.round("unusual", 9))


@query("h10_risk_indicators", f"WITH {_SQL_RISK}, w AS (SELECT id, {' + '.join(f'CASE WHEN {k} > 0.5 THEN {k} * {v} ELSE 0 END' for k, v in P.FACTORS.items())} AS a, {' + '.join(f'CASE WHEN {k} > 0.5 THEN {v} ELSE 0 END' for k, v in P.FACTORS.items())} AS b FROM f) SELECT id, round(a / b, 9)::DOUBLE AS risk, CASE WHEN round(a / b, 12) >= 0.8 THEN 'critical' WHEN round(a / b, 12) >= 0.6 THEN 'high' WHEN round(a / b, 12) >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM w WHERE b > 0")
def indicators(t) -> DataFrame:
    return P.risk_indicators(P.risk_factors(*risk_graph(t))).withColumn("risk", F.round("risk", 9))


@query("h05_gated_patterns", f"WITH {_DEG} SELECT id, degree AS frequency, least(degree::DOUBLE / 50, 1) AS significance FROM d WHERE degree > 10 AND least(degree::DOUBLE / 50, 1) >= 0.9")
def gated(t) -> DataFrame:
    return P.gate_patterns(P.frequent_nodes(degree(t)), 5, 0.9)


@query("h11_insights", f"WITH {_DEG}, s AS (SELECT id, least(degree::DOUBLE / 50, 1) AS g FROM d WHERE degree >= 35), z AS (SELECT id, round((degree - (SELECT avg(degree) FROM d)) / (SELECT stddev_pop(degree) FROM d), 6) AS z FROM d) SELECT 'pattern' AS kind, id AS subject, g AS score FROM (SELECT * FROM s ORDER BY g DESC, id LIMIT 5) UNION ALL SELECT 'anomaly', id, z FROM (SELECT * FROM z WHERE abs(z) > 2.5 ORDER BY z DESC, id LIMIT 5) UNION ALL SELECT 'connectivity', 'hubs', count(*) FROM d WHERE degree > 15 HAVING count(*) > 0")
def insight(t) -> DataFrame:
    d = degree(t)
    none = values(t, [], "severity string")
    return P.insights(P.frequent_nodes(d), P.outliers(d).select("id", F.round("z", 6).alias("score")), none, d)


@query("h12_node_timeline", "SELECT o_orderdate AS ts, 'edge' AS kind, 'c' || o_custkey || '>o' || o_orderkey AS id, 0.9::DOUBLE AS importance FROM orders UNION ALL SELECT m, 'node', 'c' || o_custkey, CASE WHEN n > 5 THEN 0.8 ELSE 0.5 END FROM (SELECT o_custkey, min(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY o_custkey)")
def timeline(t) -> DataFrame:
    o = t("orders")
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"), F.lit(0.9).alias("confidence"), F.col("o_orderdate").alias("ts"))
    nodes = o.groupBy(F.concat(F.lit("c"), "o_custkey").alias("id")).agg(F.min("o_orderdate").alias("ts"))
    return P.node_timeline(nodes, edges, o.groupBy(F.concat(F.lit("c"), "o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "ts")


@query("h21_statistics", "SELECT * FROM " + sql_values([("entities:person", 3.0), ("entities:company", 3.0), ("relations:shared_contact", 3.0), ("relations:financial_link", 1.0), ("relations:shared_address", 3.0), ("relations:employed_by", 2.0), ("mean_connections", 3.0)], "measure, value"))
def statistics(t) -> DataFrame:
    e = values(t, _ENTITIES, _ESCHEMA)
    return P.statistics(e, X.relations(e))


_SEVERITIES = [(1, "critical"), (2, "high"), (3, "medium"), (4, "low"), (5, "high")]


@query("h27_overall_risk", "SELECT 'critical' AS level, 1.0 AS score, 0.95 AS confidence")
def overall(t) -> DataFrame:
    return P.overall_risk(values(t, _SEVERITIES, "id int, severity string"))


@query("h28_report_risk", "SELECT o_custkey, CASE WHEN f >= 5 OR n > 100 THEN 'high' WHEN f >= 3 OR n > 50 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT o_custkey, count(*) AS n, count_if(o_totalprice > 300000) AS f FROM orders GROUP BY o_custkey)")
def report_risk(t) -> DataFrame:
    g = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 300000).alias("f"))
    return g.select("o_custkey", P.report_risk(F.col("n"), F.col("f")).alias("risk"))


@query("n03_registry", f"WITH {_DEG} SELECT 'frequent' AS detector, id, least(degree::DOUBLE / 50, 1) AS score FROM d WHERE degree >= 35 UNION ALL SELECT 'outlier', id, round((degree - (SELECT avg(degree) FROM d)) / (SELECT stddev_pop(degree) FROM d), 6) FROM d WHERE abs((degree - (SELECT avg(degree) FROM d)) / (SELECT stddev_pop(degree) FROM d)) > 2.5")
def registry(t) -> DataFrame:
    m = mentions(t)
    return P.default_registry().run(m.select(F.col("entity").alias("id")).distinct(), G.pair_counts(m)).withColumn("score", F.round("score", 6))
