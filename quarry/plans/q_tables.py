"""Queries: rules that other modules try on given rows, here over whole tables with SQL that computes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from ..operators import extract as X
from ..operators import graph as G
from ..operators import patterns as P
from ..operators import resolve as E
from ..operators import search as S
from ..sources.shared import written
from .q_extract import _MAIL_SQL
from .q_graph import _SQL_M, _SQL_P, _least_reached, mentions
from .registry import query


def _code(x: str) -> str:
    """Phonetic code in SQL."""
    rest = f"regexp_replace(substr(lower({x}), 2), '[0-9]', ' ', 'g')"
    for pair, digit in (("bh", "1"), ("ch", "2"), ("dh", "3"), ("th", "3"), ("sh", "7")):
        rest = f"replace({rest}, '{pair}', '{digit}')"
    return f"substr(lower({x}), 1, 1) || regexp_replace(translate({rest}, 'bpckqdtlmnrsvwjgz', '11222334556788999'), '[^0-9]', '', 'g')"


_LIKE = "(1 - levenshtein(lower(a.n), lower(b.n))::DOUBLE / greatest(length(a.n), length(b.n)))"
_PARTS = "p AS (SELECT DISTINCT p_name AS n FROM part), q AS (SELECT a.n AS a, b.n AS b, {score} AS score FROM p a JOIN p b ON a.n < b.n) SELECT a, b, round(score, 6) AS score FROM q"


def _named(t) -> DataFrame:
    """Pairs of different part names, as entities of one type."""
    p = t("part").select(F.col("p_name").alias("normalized"), F.lit("name").alias("type")).distinct()
    return p.alias("x").join(p.alias("y"), F.col("x.normalized") < F.col("y.normalized"))


@query("g02_similarity_score_parts", "WITH " + _PARTS.format(score=f"CASE WHEN {_LIKE} > 0.8 THEN {_LIKE} * 0.6 ELSE 0 END + CASE WHEN {_code('a.n')} = {_code('b.n')} THEN 0.3 ELSE 0 END"))
def scores_of_parts(t) -> DataFrame:
    return _named(t).select(F.col("x.normalized").alias("a"), F.col("y.normalized").alias("b"), F.round(E.similarity_score("x", "y"), 6).alias("score"))


@query("g06_compare_parts", "WITH " + _PARTS.format(score=f"CASE WHEN {_code('a.n')} = {_code('b.n')} THEN greatest({_LIKE}, 0.8) ELSE {_LIKE} END"))
def compared_parts(t) -> DataFrame:
    score = E.compare(F.col("x.type"), F.col("x.normalized"), F.col("y.type"), F.col("y.normalized"))
    return _named(t).select(F.col("x.normalized").alias("a"), F.col("y.normalized").alias("b"), F.round(score, 6).alias("score"))


_LINKED = f"WITH e AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS n FROM part), k AS (SELECT min(id) AS id, n FROM e GROUP BY n), l AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.n <> b.n AND {{test}}), {_least_reached(8)}, r AS (SELECT k.n, coalesce(c.component, k.id) AS cluster FROM k LEFT JOIN c ON c.id = k.id)"
_RESOLVED = _LINKED.format(test=f"CASE WHEN {_LIKE} > 0.8 THEN {_LIKE} * 0.6 ELSE 0 END + CASE WHEN {_code('a.n')} = {_code('b.n')} THEN 0.3 ELSE 0 END >= 0.85")


def _part_entities(t, *more) -> DataFrame:
    return t("part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("name").alias("type"), F.col("p_name").alias("normalized"), *more)


@query("g03_resolve_parts", f"{_RESOLVED} SELECT e.id, r.cluster FROM e JOIN r ON r.n = e.n")
def resolved_parts(t) -> DataFrame:
    return E.resolve(_part_entities(t))


_MERGED = " SELECT r.cluster AS id, string_agg(DISTINCT r.n, '|' ORDER BY r.n) AS aliases, max(confidence) AS confidence, count(*) AS merged_from FROM e JOIN r ON r.n = e.n GROUP BY r.cluster"


def _merged(e: DataFrame) -> DataFrame:
    return E.merge(e).withColumn("aliases", F.array_join("aliases", "|"))


@query("g07_merge_parts", _LINKED.format(test=f"{_LIKE} >= 0.85").replace("p_name AS n FROM", "p_name AS n, p_retailprice AS confidence FROM") + _MERGED)
def merged_parts(t) -> DataFrame:
    """Parts under the least key of those with names that are nearly equal."""
    return _merged(_part_entities(t, F.col("p_retailprice").alias("confidence")))


@query("g07_merge_customers", f"""WITH RECURSIVE e AS (SELECT c_custkey AS id, 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') AS n, c_acctbal AS confidence FROM customer), d AS (SELECT id, n, substr(n, 1, i) || '*' || substr(n, i + 2) AS rest FROM e, range(0, 18) r(i)),
l AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b FROM (SELECT rest, min(id) AS id FROM d GROUP BY rest) x JOIN d y USING (rest) WHERE x.id <> y.id), w AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
s AS (SELECT min(id) AS id FROM e UNION SELECT b FROM s JOIN w ON a = s.id)
SELECT min(e.id) AS id, count(*) AS merged_from, max(confidence) AS confidence FROM e JOIN s USING (id)""")
def merged_customers(t) -> DataFrame:
    """Customers by their numbered names, each of which is near very many others: one class, by links that grow with the
    names and not with their pairs. The SQL follows names that differ in one place."""
    e = t("customer").select(F.col("c_custkey").alias("id"), F.lit("name").alias("type"), F.col("c_name").alias("normalized"), F.col("c_acctbal").alias("confidence"))
    return E.merge(e).select("id", "merged_from", "confidence")


@query("g01_blocking_keys_parts", f"SELECT p_partkey AS id, CASE WHEN length(p_name) >= 2 THEN 'prefix:name:' || substr(p_name, 1, 2) || ',' ELSE '' END || 'phonetic:' || {_code('p_name')} || ',length:name:' || (length(p_name) // 5) AS keys FROM part")
def blocks_of_parts(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), F.array_join(E.blocking_keys(F.lit("name"), F.col("p_name")), ",").alias("keys"))


@query("g15_parse_dates_orders", "SELECT o_orderkey, o_orderdate AS d FROM orders WHERE o_orderkey % 4 < 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3")
def dates_of_orders(t) -> DataFrame:
    """Order dates written in three ways, and something else."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 1, F.date_format(d, "d-M-yyyy")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.lit("on "), F.date_format(d, "yyyy")))
    return t("orders").select("o_orderkey", T.parse_date(text).cast("timestamp_ntz").alias("d"))


@query("g12_initials_parts", "SELECT a, b, lower(a) = lower(b) OR (len(x) <> len(y) AND list_bool_and(list_transform(list_zip(x[:least(len(x), len(y))], y[:least(len(x), len(y))]), lambda p: starts_with(p[1], p[2]) OR starts_with(p[2], p[1])))) AS m FROM (SELECT p_name AS a, substr(p_name, 1, 3) || ' ' || substr(split_part(p_name, ' ', 2), 1, 1) || CASE WHEN p_partkey % 2 = 0 THEN ' x' ELSE '' END AS b FROM part), LATERAL (SELECT string_split_regex(lower(trim(a)), '\\s+') AS x, string_split_regex(lower(trim(b)), '\\s+') AS y)".replace("\\\\", "\\"))
def initials_of_parts(t) -> DataFrame:
    p = t("part").select(F.col("p_name").alias("a"), F.concat(F.substring("p_name", 1, 3), F.lit(" "), F.substring(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)), 1, 1), F.when(F.col("p_partkey") % 2 == 0, " x").otherwise("")).alias("b"))
    return p.select("a", "b", T.initials_match(F.col("a"), F.col("b")).alias("m"))


@query("f04_star_clusters_orders", f"WITH {_SQL_M}, {_SQL_P}, l AS MATERIALIZED (SELECT a, b FROM p WHERE weight >= 3 UNION ALL SELECT b, a FROM p WHERE weight >= 3), {_least_reached(12)} SELECT id, component FROM c")
def stars_of_orders(t) -> DataFrame:
    return G.star_clusters(written(G.pair_counts(mentions(t))), 3)


@query("f02_node_types_orders", f"WITH {_SQL_M} SELECT CASE type WHEN 'name' THEN 'person' ELSE 'organization' END AS node_type, count(*) AS n FROM m GROUP BY ALL")
def node_types_of_orders(t) -> DataFrame:
    return mentions(t).groupBy(G.node_type(F.col("type")).alias("node_type")).agg(F.count(F.lit(1)).alias("n"))


@query("f07_merge_entities_customers", "SELECT 'name' AS type, lower(c_mktsegment) AS normalized, min_by('e' || c_custkey, c_custkey) AS id, string_agg(DISTINCT v, '|' ORDER BY v) AS aliases, string_agg(DISTINCT s, '|' ORDER BY s) AS sources FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS v, 't' || (c_custkey % 2) AS s FROM customer) GROUP BY ALL")
def merged_customers(t) -> DataFrame:
    k = F.col("c_custkey")
    e = t("customer").select(k.alias("seq"), F.concat(F.lit("e"), k).alias("id"), F.lit("name").alias("type"), F.lower("c_mktsegment").alias("normalized"), F.when(k % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("value"), F.concat(F.lit("t"), k % 2).alias("source"))
    return G.merge_entities(e).select("type", "normalized", "id", F.array_join("aliases", "|").alias("aliases"), F.array_join("sources", "|").alias("sources"))


@query("f08_merge_relationships_lines", "SELECT source, target, type, count(*) AS occurrences, round(least(1, min_by(confidence, seq) + 0.05::DOUBLE * (count(*) - 1)), 6) AS confidence FROM (SELECT (l_orderkey * 10 + l_linenumber) * 10000 + l_partkey AS seq, 's' || l_suppkey AS source, 'p' || (l_partkey % 50) AS target, l_returnflag AS type, 0.5::DOUBLE AS confidence FROM lineitem WHERE l_suppkey % 2 = 0) GROUP BY source, target, type")
def merged_lines(t) -> DataFrame:
    """Relations to odd suppliers dangle."""
    rels = t("lineitem").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000 + F.col("l_partkey")).alias("seq"), F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("target"), F.col("l_returnflag").alias("type"), F.lit(0.5).alias("confidence"))
    nodes = t("supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(t("part").select(F.concat(F.lit("p"), F.col("p_partkey") % 50).alias("id")))
    return G.merge_relationships(rels, nodes).withColumn("confidence", F.round("confidence", 6))


@query("f09_edge_weight_orders", f"WITH {_SQL_M}, {_SQL_P} SELECT a, b, round(least(1, 0.5 + CASE WHEN weight >= 5 THEN 0.3 WHEN weight >= 2 THEN 0.2 ELSE 0.1 END + least(0.05 * weight, 0.2)), 6)::DOUBLE AS w FROM p")
def weights_of_orders(t) -> DataFrame:
    return G.cooccurrence_edges(mentions(t)).select("a", "b", F.round(G.edge_weight(F.col("strength"), F.col("weight")), 6).alias("w"))


@query("f11_cluster_risk_parts", "SELECT p_brand AS component, round(least(1, avg(CASE p_size % 5 WHEN 0 THEN 0.3 WHEN 1 THEN 0.1 WHEN 2 THEN 0.02 ELSE 0.05 END::DOUBLE) * 5), 6) AS risk FROM part GROUP BY p_brand")
def risk_of_parts(t) -> DataFrame:
    k = F.col("p_size") % 5
    members = t("part").select(F.col("p_brand").alias("component"), F.when(k == 0, "crypto_address").when(k == 1, "phone").when(k == 2, "date").when(k == 3, "name").otherwise("other").alias("type"))
    return G.cluster_risk(members).withColumn("risk", F.round("risk", 6))


@query("f16_graph_json_orders", f"WITH {_SQL_M}, {_SQL_P} SELECT '{{\"a\":\"' || a || '\",\"b\":\"' || b || '\",\"weight\":' || weight || '}}' AS json FROM p")
def json_of_orders(t) -> DataFrame:
    return G.pair_counts(mentions(t)).select(F.to_json(F.struct("a", "b", "weight")).alias("json"))


_CONTACTS = "e AS (SELECT c_custkey AS k, '+91 9' || lpad((c_custkey % 400)::VARCHAR, 9, '0') AS phone, CASE WHEN c_custkey % 2 = 0 THEN ' U' || (c_custkey % 300) || '@X.org' END AS email, c_mktsegment || ', no. ' || c_nationkey AS address, (c_custkey % 700)::VARCHAR AS account FROM customer)"


def contacts(t) -> DataFrame:
    k = F.col("c_custkey")
    return t("customer").select(
        k.alias("k"), F.concat(F.lit("+91 9"), F.lpad((k % 400).cast("string"), 9, "0")).alias("phone"), F.when(k % 2 == 0, F.concat(F.lit(" U"), (k % 300).cast("string"), F.lit("@X.org"))).alias("email"),
        F.concat("c_mktsegment", F.lit(", no. "), F.col("c_nationkey").cast("string")).alias("address"), (k % 700).cast("string").alias("account"),
    )


_PLAIN_ADDRESS = "trim(regexp_replace(lower(address), '[\\s\\-_.,;:''\"()]+', ' ', 'g'))"


@query("h13_address_sharing_customers", f"WITH {_CONTACTS} SELECT {_PLAIN_ADDRESS} AS value, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'high' ELSE 'medium' END AS severity FROM e GROUP BY 1 HAVING count(*) >= 3")
def shared_addresses(t) -> DataFrame:
    return P.address_sharing(contacts(t))


@query("h14_contact_sharing_customers", f"WITH {_CONTACTS}, v AS (SELECT 'phone' AS kind, right(phone, 10) AS value FROM e UNION ALL SELECT 'email', lower(trim(email)) FROM e WHERE email IS NOT NULL) SELECT kind, value, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM v GROUP BY ALL HAVING count(*) >= 2")
def shared_contacts(t) -> DataFrame:
    return P.contact_sharing(contacts(t))


@query("h16_shared_accounts_customers", f"WITH {_CONTACTS} SELECT account, count(*) AS n FROM e GROUP BY account HAVING count(*) > 1")
def accounts_of_customers(t) -> DataFrame:
    return P.shared_accounts(contacts(t))


_PEOPLE = "e AS (SELECT lpad(c_custkey::VARCHAR, 6, '0') AS id, lower(c_mktsegment) || ' ' || c_nationkey || ' road ' || (c_custkey % 50) AS n, CASE WHEN c_custkey % 3 = 0 THEN 'part ' || p_name ELSE NULL END AS co FROM customer LEFT JOIN part ON p_partkey = c_custkey)"


@query("f19_relations_people", f"""WITH {_PEOPLE}, k AS (SELECT n, min(id) AS id FROM e GROUP BY n), f AS (SELECT 'part ' || p_name AS n, min('f' || lpad(p_partkey::VARCHAR, 6, '0')) AS id FROM part GROUP BY 1), c AS (SELECT DISTINCT co AS n FROM e WHERE co IS NOT NULL), m AS (SELECT a.n AS co, b.id AS firm FROM c a JOIN f b ON {_LIKE} >= 0.85)
SELECT k.id AS a, e.id AS b, 'shared_address' AS type, 1.0::DOUBLE AS strength FROM e JOIN k USING (n) WHERE e.id <> k.id UNION ALL SELECT a.id, b.id, 'shared_address', round({_LIKE}, 6) FROM k a JOIN k b ON a.id < b.id AND {_LIKE} >= 0.8 UNION ALL SELECT e.id, firm, 'employed_by', 0.85 FROM e JOIN m USING (co)""")
def relations_of_people(t) -> DataFrame:
    """Customers as persons with addresses that many share or nearly share, and companies of other tables they work for."""
    c, p = t("customer"), t("part")
    none = F.lit(None).cast("string")
    blank = {"phone": none, "email": none, "account": none}
    key = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    where = F.concat_ws(" ", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("road"), (F.col("c_custkey") % 50).cast("string"))
    people = c.join(p, F.col("p_partkey") == F.col("c_custkey"), "left").select(key.alias("id"), F.lit("person").alias("type"), none.alias("name"), where.alias("address"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Part "), "p_name")).alias("company"))
    firms = p.select(F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("id"), F.lit("company").alias("type"), F.concat(F.lit("part "), "p_name").alias("name"), none.alias("address"), none.alias("company"))
    return E.relations(people.unionByName(firms).withColumns(blank), firsts=True).withColumn("strength", F.round("strength", 6))


@query("f19_relations_customers", f"""WITH {_CONTACTS}, i AS (SELECT lpad(k::VARCHAR, 6, '0') AS id, * FROM e), s AS (SELECT right(phone, 10) AS v, min(id) AS a FROM i GROUP BY 1), m AS (SELECT lower(trim(email)) AS v, min(id) AS a FROM i WHERE email IS NOT NULL GROUP BY 1), c AS (SELECT account AS v, min(id) AS a FROM i GROUP BY 1)
SELECT a, id AS b, 'shared_contact' AS type, 0.95::DOUBLE AS strength FROM i JOIN s ON v = right(phone, 10) WHERE id <> a UNION ALL SELECT a, id, 'shared_contact', 0.99 FROM i JOIN m ON v = lower(trim(email)) WHERE id <> a UNION ALL SELECT a, id, 'financial_link', 0.99 FROM i JOIN c ON v = account WHERE id <> a""")
def relations_of_customers(t) -> DataFrame:
    """Everybody who shares a contact or an account, related to the first who has it."""
    e = contacts(t).select(F.lpad(F.col("k").cast("string"), 6, "0").alias("id"), F.lit("company").alias("type"), F.lit(None).cast("string").alias("name"), "phone", "email", "address", F.lit(None).cast("string").alias("company"), "account")
    return E.relations(e)


@query("h27_overall_risk_parts", "WITH s AS (SELECT count_if(p_size > 49) AS c, count_if(p_size BETWEEN 40 AND 49) AS h, count_if(p_size < 40) AS m, count(*) AS n FROM part) SELECT CASE WHEN c > 0 OR h >= 3 THEN 'critical' WHEN h > 0 OR m >= 5 THEN 'high' WHEN m > 0 OR n >= 3 THEN 'medium' ELSE 'low' END AS level, least(0.4 * c + 0.25 * h + 0.1 * m + 0.05 * n, 1)::DOUBLE AS score, least(0.1 * n + 0.5, 0.95)::DOUBLE AS confidence FROM s")
def risk_over_parts(t) -> DataFrame:
    return P.overall_risk(t("part").select(F.when(F.col("p_size") > 49, "critical").when(F.col("p_size") >= 40, "high").otherwise("medium").alias("severity")))


@query("e20_signature_customers", f"WITH {_CONTACTS} SELECT k, CASE WHEN k % 5 = 4 THEN 'hash:{{\"k\":' || k || '}}' ELSE concat_ws('|', CASE WHEN k % 5 < 3 THEN 'phone:' || right(phone, 10) END, CASE WHEN k % 2 = 0 THEN 'email:' || lower(email) END, 'pan:' || account) END AS signature FROM e")
def signatures_of_customers(t) -> DataFrame:
    c, k = contacts(t), F.col("k")
    none = F.lit(None).cast("string")
    e = c.select("k", F.when(k % 5 < 3, F.col("phone")).otherwise(none).alias("phone"), F.when(k % 5 == 4, none).otherwise(F.col("email")).alias("email"), F.when(k % 5 == 4, none).otherwise(F.col("account")).alias("pan"))
    return e.select("k", S.signature(F.col("phone"), F.col("email"), {"pan": F.col("pan")}, R.record_json(["k"])).alias("signature"))


@query("e02_entity_score_parts", "SELECT p_partkey, least(1::DOUBLE, (0.5 + 0.3 * (p_size % 2) + 0.1 * (p_size % 3) + CASE WHEN p_size > 40 THEN 0.2 WHEN p_size > 20 THEN 0.1 ELSE 0 END)::DOUBLE * (p_size / 50.0)::DOUBLE) AS score FROM part")
def scores_over_parts(t) -> DataFrame:
    s = F.col("p_size")
    return t("part").select("p_partkey", S.entity_score(s % 2, s % 3, F.when(s > 40, "HIGH").when(s > 20, "MEDIUM").otherwise("LOW"), s / 50.0).alias("score"))


@query("e23_merge_connections_orders", "WITH a AS (SELECT 'name' AS type, 'c' || o_custkey AS entity, count(*) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT 'name' AS type, 'c' || o_custkey AS entity, count(*) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL) SELECT type, entity, greatest(a.s, b.s) AS strength FROM a FULL JOIN b USING (type, entity) ORDER BY strength DESC, type, entity LIMIT 30")
def merged_connections(t) -> DataFrame:
    side = lambda test: t("orders").where(test).groupBy(F.lit("name").alias("type"), F.concat(F.lit("c"), "o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("strength"))
    return S.merge_connections(side("o_orderstatus = 'F'"), side("o_orderstatus <> 'F'"))


def _found(t) -> DataFrame:
    return X.extract(t("documents"), kinds=["email"])


@query("c30_best_of_documents", f"SELECT doc, 'email' AS type, normalized, 0.98::DOUBLE AS confidence FROM ({_MAIL_SQL})")
def best_of_documents(t) -> DataFrame:
    e = _found(t)
    return X.best_of(e.unionByName(e.withColumn("confidence", F.lit(0.5)))).select("doc", "type", "normalized", "confidence")


@query("c38_searchable_documents", f"SELECT doc, normalized FROM ({_MAIL_SQL}) WHERE doc % 2 = 0")
def searchable_documents(t) -> DataFrame:
    e = _found(t).withColumn("confidence", F.when(F.col("doc") % 2 == 0, F.col("confidence")).otherwise(0.5))
    return X.searchable(e).select("doc", "normalized")


@query("c39_merge_results_documents", f"SELECT DISTINCT 'email' AS type, normalized FROM ({_MAIL_SQL})")
def merged_documents(t) -> DataFrame:
    e = _found(t).select("type", "normalized")
    return X.merge_results(e, e)


@query("c37_unique_identifiers_documents", f"SELECT doc, 'email' AS type, normalized FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY normalized) AS r FROM ({_MAIL_SQL})) WHERE r <= 5")
def identifiers_of_documents(t) -> DataFrame:
    return X.unique_identifiers(_found(t).select("doc", "type", "normalized"))


@query("c36_formats_customers", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'international' WHEN 1 THEN 'spaced' WHEN 2 THEN 'segmented' ELSE 'standard' END AS f FROM customer")
def formats_of_customers(t) -> DataFrame:
    k, d = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")
    text = F.when(k % 4 == 0, F.concat(F.lit("+91"), d)).when(k % 4 == 1, F.concat(F.substring(d, 3, 5), F.lit(" "), F.substring(d, 8, 5))).when(k % 4 == 2, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 4), F.substring(d, 9, 4))).otherwise(d)
    return t("customer").select("c_custkey", T.format_tag(text).alias("f"))


@query("b08_filters_any_parts", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'eco')")
def any_filter_of_parts(t) -> DataFrame:
    return t("part").where(R.filters_any(R.record_json(["p_name", "p_type"]), ["RING", "Eco"])).select("p_partkey")


@query("b15_first_of_parts", "SELECT p_partkey, coalesce(CASE WHEN p_size > 30 THEN p_name END, CASE WHEN p_size > 10 THEN p_brand END, p_type) AS v FROM part")
def first_of_parts(t) -> DataFrame:
    p = t("part").select("p_partkey", F.when(F.col("p_size") > 30, F.col("p_name")).otherwise(" ").alias("a"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("b"), F.col("p_type").alias("c"))
    return p.select("p_partkey", R.first_of(["a", "b", "c"]).alias("v"))


@query("b16_combine_parts", "SELECT p_partkey, concat_ws(', ', CASE WHEN p_size > 30 THEN trim(p_name) END, CASE WHEN p_size > 10 THEN p_brand END, p_type) AS v FROM part")
def combined_parts(t) -> DataFrame:
    p = t("part").select("p_partkey", F.when(F.col("p_size") > 30, F.col("p_name")).otherwise(" ").alias("a"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("b"), F.col("p_type").alias("c"))
    return p.select("p_partkey", R.combine(["a", "b", "c"]).alias("v"))


@query("j06_semantic_dedup_looser", "SELECT vec_id AS id FROM embeddings b WHERE NOT EXISTS (SELECT 1 FROM embeddings a WHERE a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4)")
def looser_dedup(t) -> DataFrame:
    """At a limit that pairs of the tables reach."""
    from ..operators import vectors as V
    from .q_profile import vecs

    v = vecs(t)
    return v.select("id").join(V.near_pairs(v, 0.4).select(F.col("b").alias("id")).distinct(), "id", "left_anti")
