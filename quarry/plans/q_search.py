"""Queries: criteria search, ranking, deduplication and lead expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import search as S
from ..operators import terms as M
from ..sources import sinks
from .registry import query, sql_values, values

_TABLES = {"customer": ("c_custkey", ["c_name", "c_mktsegment"]), "supplier": ("s_suppkey", ["s_name"]), "part": ("p_partkey", ["p_name", "p_brand", "p_type"]), "orders": ("o_orderkey", ["o_orderstatus", "o_orderpriority"]), "nation": ("n_nationkey", ["n_name"])}
CRITERIA = [S.Criterion("segment", "keyword", "BUILDING"), S.Criterion("number", "id_number", "#00000001"), S.Criterion("nation", "name", "an"), S.Criterion("brand", "company", "brand#1"), S.Criterion("urgent", "keyword", "urgent"), S.Criterion("common", "location", "o", "P5")]


def recs(t) -> DataFrame:
    return reduce(DataFrame.unionByName, [R.records(t(n), n, k, cols) for n, (k, cols) in _TABLES.items()])


_SQL_RECS = "r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, CAST({k} AS VARCHAR) AS record_id, lower({' || chr(124) || '.join(cols)}) AS txt FROM {n}" for n, (k, cols) in _TABLES.items()) + ")"
_USED = [c for c in CRITERIA if c.rank != "P5"]
_HIT = {c.id: f"contains(txt, '{c.term.lower()}')::INT" for c in CRITERIA}
_N = " + ".join(_HIT[c.id] for c in _USED)
_SQL_MATCHED = f"m AS (SELECT *, {_N} AS match_count, concat_ws(',', {', '.join(f'CASE WHEN {_HIT[c.id]} = 1 THEN $${c.id}$$ END' for c in _USED)}) AS criteria FROM r WHERE {_N} > 0)"
_WITH = f"WITH {_SQL_RECS}, {_SQL_MATCHED} "
_WEIGHTED = "(" + " + ".join(f"{_HIT[c.id]} * {c.weight * S.MULTIPLIERS[c.rank]}" for c in _USED) + ")::DOUBLE"
_PLAIN = "(" + " + ".join(f"{_HIT[c.id]} * {c.weight}" for c in _USED) + ")::DOUBLE"
_CROSS = f"{_WEIGHTED} * CASE WHEN match_count > 1 THEN 1 + 0.3::DOUBLE * match_count ELSE 1 END"


def matched(t) -> DataFrame:
    return S.match(recs(t), CRITERIA)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("table_name", "record_id", F.array_join("matched_criteria", ",").alias("criteria"), "score", "is_exact")


@query("e11_cross_reference", f"{_WITH} SELECT table_name, record_id, criteria, {_CROSS} AS score, match_count = {len(_USED)} AS is_exact FROM m ORDER BY is_exact DESC, score DESC, table_name, record_id LIMIT 500")
def cross_reference(t) -> DataFrame:
    """Records of five tables that match any criterion, scored, best 500."""
    return _shown(S.top(S.cross_reference(matched(t), CRITERIA), 500))


@query("e06_criteria_search", f"{_WITH} SELECT table_name, record_id, criteria FROM m")
def criteria_search(t) -> DataFrame:
    return matched(t).select("table_name", "record_id", F.array_join("matched_criteria", ",").alias("criteria"))


_WATCHED = "w AS (SELECT 'brand' || n_nationkey AS id, 'Brand#' || n_nationkey AS term FROM nation UNION ALL SELECT 's' || s_suppkey, substr(s_name, 12) FROM supplier UNION ALL SELECT DISTINCT 'p' || p_name, p_name FROM part)"


@query("e06_watch_list", f"WITH {_SQL_RECS}, {_WATCHED}, k AS (SELECT lower(term) AS low, id FROM w) SELECT table_name, record_id, id FROM r JOIN k ON contains(txt, low)")
def watch_list(t) -> DataFrame:
    """Records of five tables that hold a term of a list that is itself a table: numbers of suppliers, names of parts, brands."""
    nation = t("nation").select(F.concat(F.lit("brand"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("term"))
    number = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.substring("s_name", 12, 100))
    named = t("part").select(F.concat(F.lit("p"), "p_name"), "p_name").distinct()
    return M.watch(recs(t), nation.union(number).union(named))


@query("e12_cross_reference_plain", f"{_WITH} SELECT table_name, record_id, criteria, {_PLAIN} * CASE WHEN match_count > 1 THEN 1 + 0.5::DOUBLE * match_count ELSE 1 END AS score, match_count = {len(_USED)} AS is_exact FROM m")
def cross_reference_plain(t) -> DataFrame:
    return _shown(S.cross_reference_plain(matched(t), _USED))


@query("e13_relevance", f"{_WITH} SELECT table_name, record_id, {_PLAIN} AS score FROM m")
def relevance(t) -> DataFrame:
    return S.relevance(matched(t), _USED).select("table_name", "record_id", "score")


@query("e14_compiled_score", f"{_WITH} SELECT table_name, record_id, 10 + 3.0::DOUBLE * (match_count - 1) AS score FROM m")
def compiled(t) -> DataFrame:
    return S.compiled_score(matched(t)).select("table_name", "record_id", "score")


@query("d13_strategy", "SELECT 'intersection' AS strategy, 'union' AS single")
def strategies(t) -> DataFrame:
    return values(t, [(S.strategy(CRITERIA), S.strategy(CRITERIA[:1]))], "strategy string, single string")


@query("e09_merge_hits", f"WITH {_SQL_RECS} SELECT table_name, record_id, string_agg(c, ',' ORDER BY c) AS criteria, CAST(count(*) AS INT) AS match_count FROM (SELECT DISTINCT table_name, record_id, c FROM (SELECT *, 'nation' AS c FROM r WHERE contains(txt, 'an') UNION ALL SELECT *, 'brand' FROM r WHERE contains(txt, 'brand#1'))) GROUP BY ALL")
def hits_merged(t) -> DataFrame:
    one = S.match(recs(t), [CRITERIA[2]]).select("table_name", "record_id", F.lit("nation").alias("criterion"))
    two = S.match(recs(t), [CRITERIA[3]]).select("table_name", "record_id", F.lit("brand").alias("criterion"))
    return S.merge_hits(one.unionByName(two).unionByName(one)).select("table_name", "record_id", F.array_join("matched_criteria", ",").alias("criteria"), "match_count")


@query("e10_record_hash", "SELECT count(*) AS n, count(DISTINCT c_name || c_mktsegment) AS kinds FROM customer")
def hashes(t) -> DataFrame:
    return recs(t).where("table_name = 'customer'").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(S.record_hash(F.col("record_json"))).alias("kinds"))


@query("e07_stop_early", f"{_WITH} SELECT (SELECT count(*) FROM m WHERE {_HIT['number']} + {_HIT['nation']} >= 2) >= 1 AS stop")
def early(t) -> DataFrame:
    strong = matched(t).withColumn("strong_matches", F.size(F.filter("matched_criteria", lambda x: x.isin("number", "nation"))))
    return values(t, [(S.stop_early(strong, 1),)], "stop boolean")


_ENTITIES = [("name", "supplier#000000001", "HIGH", 0.9), ("name", "customer#00000001", "LOW", 0.7), ("company", "Brand#11", "MEDIUM", 0.95)]
_MAPPING = [("supplier", "s_name", "name"), ("customer", "c_name", "name"), ("part", "p_brand", "company")]


@query("e01_typed_lookup", f"""WITH e AS (SELECT * FROM {sql_values(_ENTITIES, 'type, entity, priority, confidence')}),
c AS (SELECT 'supplier' AS table_name, CAST(s_suppkey AS VARCHAR) AS record_id, 'name' AS type, s_name AS value FROM supplier UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'name', c_name FROM customer UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 'company', p_brand FROM part),
h AS (SELECT entity, table_name, record_id, least(1::DOUBLE, (0.5::DOUBLE + 0.3::DOUBLE * (value = entity)::INT + 0.1::DOUBLE * (value <> entity)::INT + CASE priority WHEN 'HIGH' THEN 0.2::DOUBLE WHEN 'MEDIUM' THEN 0.1::DOUBLE ELSE 0 END) * confidence::DOUBLE) AS score, row_number() OVER (PARTITION BY entity, table_name ORDER BY record_id) AS r FROM c JOIN e ON c.type = e.type AND contains(lower(value), lower(entity)))
SELECT entity, table_name, record_id, score FROM h WHERE r <= 100""")
def typed_lookup(t) -> DataFrame:
    mapping = values(t, _MAPPING, "table_name string, field string, type string")
    entities = values(t, _ENTITIES, "type string, entity string, priority string, confidence double")
    return S.lookup_typed(R.unpivot(recs(t)), mapping, entities, 100)


_SCORES = [(0, 0, "LOW", 0.5), (1, 0, "HIGH", 0.9), (3, 2, "HIGH", 1.0), (0, 1, "MEDIUM", 0.8)]


@query("e02_entity_score", f"SELECT e, p, least(1::DOUBLE, (0.5 + 0.3 * e + 0.1 * p + CASE pr WHEN 'HIGH' THEN 0.2 WHEN 'MEDIUM' THEN 0.1 ELSE 0 END)::DOUBLE * c::DOUBLE) AS score FROM {sql_values(_SCORES, 'e, p, pr, c')}")
def entity_scores(t) -> DataFrame:
    df = values(t, _SCORES, "e int, p int, pr string, c double")
    return df.select("e", "p", S.entity_score(F.col("e"), F.col("p"), F.col("pr"), F.col("c")).alias("score"))


@query("e15_strategy_score", """SELECT table_name, record_id, score FROM (SELECT 'part' AS table_name, CAST(p_partkey AS VARCHAR) AS record_id,
(10 * ((contains(lower(p_name), 'brand#12 steel') OR contains('brand#12 steel', lower(p_name)))::INT + (contains(lower(p_brand), 'brand#12 steel') OR contains('brand#12 steel', lower(p_brand)))::INT + (contains(lower(p_type), 'brand#12 steel') OR contains('brand#12 steel', lower(p_type)))::INT + (contains('brand#12 steel', CAST(p_size AS VARCHAR)))::INT)
 + 3 * (contains(lower(p_name), 'brand#12')::INT + contains(lower(p_brand), 'brand#12')::INT + contains(lower(p_type), 'brand#12')::INT + contains(lower(p_name), 'steel')::INT + contains(lower(p_brand), 'steel')::INT + contains(lower(p_type), 'steel')::INT)
 + 15 * (p_size > 30)::INT + 5 * 1 + 5 * (contains(lower(p_brand), 'brand#12') OR contains(lower(p_brand), 'steel'))::INT)::DOUBLE AS score FROM part) WHERE score > 5""")
def strategies_scored(t) -> DataFrame:
    rows = R.records(t("part"), "part", "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])
    out = S.strategy_score(rows, "Brand#12 STEEL", ["brand#12", "steel", "of"], [("p_size", "greaterThan", "30")], {"name": ["p_name"]}, ["p_brand"])
    return out.where("score > 5").select("table_name", "record_id", "score")


@query("e16_first_by_json", "SELECT min(c_name) AS c_name, count(*) AS n FROM (SELECT c_nationkey, c_mktsegment, min(CAST(c_custkey AS VARCHAR)) AS c_name FROM customer GROUP BY ALL)")
def first_json(t) -> DataFrame:
    rows = R.records(t("customer"), "customer", "c_custkey", ["c_nationkey", "c_mktsegment"])
    return S.first_by_json(rows).agg(F.min("record_id").alias("c_name"), F.count(F.lit(1)).alias("n"))


@query("e17_merged_entities", "SELECT v AS entity, count(*) AS strength FROM (SELECT lower(trim(c_mktsegment)) AS v FROM customer UNION ALL SELECT lower(trim(p_brand)) FROM part UNION ALL SELECT lower(trim(n_name)) FROM nation) GROUP BY v HAVING count(*) > 1")
def entities_merged(t) -> DataFrame:
    return S.merged_entities(R.unpivot(recs(t)), ["c_mktsegment", "p_brand", "n_name"])


@query("e18_boosted", f"""{_WITH}, b AS (SELECT v, count(*) AS s FROM (SELECT lower(trim(c_mktsegment)) AS v FROM customer UNION ALL SELECT lower(trim(p_brand)) FROM part) GROUP BY v HAVING count(*) > 1),
x AS (SELECT DISTINCT 'customer' AS table_name, CAST(c_custkey AS VARCHAR) AS record_id, lower(trim(c_mktsegment)) AS v FROM customer UNION SELECT 'part', CAST(p_partkey AS VARCHAR), lower(trim(p_brand)) FROM part)
SELECT m.table_name, m.record_id, {_CROSS} + 2 * coalesce((SELECT sum(s) FROM x JOIN b USING (v) WHERE x.table_name = m.table_name AND x.record_id = m.record_id), 0) AS score FROM m ORDER BY score DESC, table_name, record_id LIMIT 100""")
def boosted(t) -> DataFrame:
    c = R.unpivot(recs(t))
    return S.boost(S.cross_reference(matched(t), CRITERIA), c, S.merged_entities(c, ["c_mktsegment", "p_brand"]), 100).select("table_name", "record_id", "score")


@query("e19_confidence", f"{_WITH} SELECT round(0.6::DOUBLE * least(avg({_CROSS}) / 20, 1) + 0.4::DOUBLE * least(count(*) / 10, 1), 9) AS confidence FROM m")
def confident(t) -> DataFrame:
    return S.confidence(S.cross_reference(matched(t), CRITERIA)).select(F.round("confidence", 9).alias("confidence"))


_SIGNED = [(1, "+91 90000-00001", "A@B.C", "X1"), (2, None, "", None), (3, " ", "q@r.s", None), (4, "12", None, "Z9")]


@query("e20_signature", "SELECT id, s AS signature FROM " + sql_values([(1, "phone:9000000001|email:a@b.c|pan:X1"), (2, 'hash:{"id":2}'), (3, "email:q@r.s"), (4, "phone:12|pan:Z9")], "id, s"))
def signatures(t) -> DataFrame:
    df = values(t, _SIGNED, "id int, phone string, email string, pan string")
    return df.select("id", S.signature(F.col("phone"), F.col("email"), {"pan": F.col("pan")}, R.record_json(["id"])).alias("signature"))


@query("e21_first_by_signature", "SELECT c_mktsegment AS signature, max_by(c_custkey, (c_acctbal, -c_custkey)) AS record FROM customer GROUP BY c_mktsegment")
def by_signature(t) -> DataFrame:
    out = S.first_by(t("customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), "c_custkey"])
    return out.select(F.col("c_mktsegment").alias("signature"), F.col("c_custkey").alias("record"))


@query("e22_connections", "SELECT type, entity, count(*) AS strength, string_agg(DISTINCT tn, ',' ORDER BY tn) AS tables FROM (SELECT 'name' AS type, lower(trim(n_name)) AS entity, 'nation' AS tn FROM nation UNION ALL SELECT 'name', lower(trim(c_name)), 'customer' FROM customer UNION ALL SELECT 'location', lower(trim(c_mktsegment)), 'customer' FROM customer UNION ALL SELECT 'location', lower(trim(p_brand)), 'part' FROM part) WHERE length(entity) > 2 AND length(entity) < 100 GROUP BY type, entity ORDER BY strength DESC, type, entity LIMIT 30")
def connected(t) -> DataFrame:
    return S.connections(R.unpivot(recs(t)), {"name": ["n_name", "c_name"], "location": ["c_mktsegment", "p_brand"], "phone": ["phone"]})


_CA, _CB = [("name", "x", 3), ("name", "y", 1)], [("name", "x", 2), ("phone", "z", 5)]


@query("e23_merge_connections", "SELECT * FROM " + sql_values([("name", "x", 3), ("name", "y", 1), ("phone", "z", 5)], "type, entity, strength"))
def connections_merged(t) -> DataFrame:
    schema = "type string, entity string, strength int"
    return S.merge_connections(values(t, _CA, schema), values(t, _CB, schema))


@query("e24_breakdown", f"{_WITH} " + " UNION ALL ".join(f"SELECT '{c.id}' AS criterion, CAST(coalesce(sum({_HIT[c.id]}), 0) AS BIGINT) AS matches FROM m" for c in _USED) + " UNION ALL SELECT 'common', 0")
def broken_down(t) -> DataFrame:
    return S.breakdown(matched(t), CRITERIA)


@query("e25_summary", f"{_WITH} SELECT count(*) AS total, CAST(count_if(match_count = {len(_USED)}) AS BIGINT) AS exact, CAST(count(*) - count_if(match_count = {len(_USED)}) AS BIGINT) AS partial, 'Found ' || count(*) || ' records: ' || count_if(match_count = {len(_USED)}) || ' exact, ' || (count(*) - count_if(match_count = {len(_USED)})) || ' partial' AS summary FROM m")
def summarised(t) -> DataFrame:
    return S.summary(S.cross_reference(matched(t), CRITERIA))


@query("e26_primary_subject", "SELECT table_name, record_id, score FROM (SELECT 'customer' AS table_name, CAST(c_custkey AS VARCHAR) AS record_id, (0.9 * contains(lower(c_name), 'customer#000000012')::INT + contains(lower(c_name), 'customer#000000012')::INT + 1.6 * contains(lower(c_mktsegment), 'machinery')::INT)::DOUBLE AS score FROM customer) ORDER BY score DESC, table_name, record_id LIMIT 1")
def subject(t) -> DataFrame:
    rows = R.records(t("customer"), "customer", "c_custkey", ["c_name", "c_mktsegment"])
    return S.primary_subject(rows, [("name", "Customer#000000012", 0.9), ("email", "machinery", 0.8)]).select("table_name", "record_id", "score")


@query("e27_first_by_id", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 500")
def first_ids(t) -> DataFrame:
    return S.first_by(t("orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey").orderBy("o_custkey").limit(500)


@query("e28_per_table", f"{_WITH} SELECT table_name, count(*) AS n FROM m GROUP BY table_name")
def tables_counted(t) -> DataFrame:
    return S.per_table(matched(t))


@query("e28_best_per_table", f"{_WITH}, s AS (SELECT *, {_CROSS} AS score FROM m) SELECT table_name, record_id FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY score DESC, record_id) AS k FROM s) WHERE k <= 10")
def best_per_table(t) -> DataFrame:
    return S.per_table(S.cross_reference(matched(t), CRITERIA), 10).select("table_name", "record_id")


@query("e29_table_profile", "SELECT 5 AS tables, CAST(9 AS BIGINT) AS columns, 5 AS searchable")
def profile_stats(t) -> DataFrame:
    rows = values(t, [(n, len(c)) for n, (_, c) in _TABLES.items()], "table_name string, n int")
    return rows.agg(F.count(F.lit(1)).cast("int").alias("tables"), F.sum("n").alias("columns"), F.count_if(F.col("n") > 0).cast("int").alias("searchable"))


def _mentions(t) -> DataFrame:
    """Orders name their customer and their suppliers."""
    l = t("lineitem")
    return l.select(F.col("l_orderkey").alias("record_id"), F.concat(F.lit("s"), "l_suppkey").alias("entity")).unionByName(t("orders").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("c"), "o_custkey").alias("entity")))


_MENTIONS = "mn AS MATERIALIZED (SELECT l_orderkey AS record_id, 's' || l_suppkey AS entity FROM lineitem UNION ALL SELECT o_orderkey, 'c' || o_custkey FROM orders)"


def _hop(k: int, extra: str = "") -> str:
    before = " UNION ALL ".join(f"SELECT entity FROM h{i}" for i in range(k))
    return f"h{k} AS MATERIALIZED (SELECT entity, {k} AS hop FROM (SELECT DISTINCT entity FROM mn WHERE record_id IN (SELECT record_id FROM mn WHERE entity IN (SELECT entity FROM h{k - 1})) AND entity NOT IN ({before})) {extra})"


def _hops(n: int, extra: str = "") -> str:
    return f"WITH {_MENTIONS}, h0 AS MATERIALIZED (SELECT 's1' AS entity, 0 AS hop), " + ", ".join(_hop(k, extra) for k in range(1, n + 1)) + " " + " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(n + 1))


@query("e03_expand_leads", _hops(3))
def expanded(t) -> DataFrame:
    """Suppliers and customers that three rounds of shared orders reach from supplier 1."""
    return S.expand(_mentions(t), values(t, [("s1",)], "entity string"), 3)


@query("e04_expand_by_priority", _hops(3, "ORDER BY entity LIMIT 5"))
def expanded_limited(t) -> DataFrame:
    return S.expand(_mentions(t), values(t, [("s1",)], "entity string"), 3, per_round=5, most=50_000)


@query("e05_agent_expansion", _hops(2, "ORDER BY entity DESC LIMIT 5"))
def expanded_agent(t) -> DataFrame:
    return S.expand(_mentions(t), values(t, [("s1",)], "entity string"), 2, per_round=5, order=[F.col("entity").desc()])


@query("a30_ranked_export", f"""{_WITH}, s AS (SELECT *, {_CROSS} AS score FROM m WHERE table_name = 'customer' ORDER BY score DESC, record_id LIMIT 50)
SELECT CAST(row_number() OVER (ORDER BY score DESC, record_id) AS INT) AS "Rank", 'customer' AS "Table", CAST(round(score) AS BIGINT) AS "Match Score", match_count AS "Match Count", 'No' AS "Is Exact Match", replace(criteria, ',', '; ') AS "Matched Criteria", c_mktsegment, c_name FROM s JOIN customer ON c_custkey = CAST(record_id AS BIGINT)""")
def exported(t) -> DataFrame:
    rows = t("customer").select("c_name", "c_mktsegment", F.lit("customer").alias("table_name"), F.col("c_custkey").cast("string").alias("record_id"), R.cells(["c_name", "c_mktsegment"]).alias("cells"))
    found = S.top(S.cross_reference(S.match(rows, CRITERIA), CRITERIA), 50)
    return sinks.ranked(found, ["c_name", "c_mktsegment"])


@query("a29_provenance_export", f"{_WITH} SELECT c_name, replace(criteria, ',', '; ') AS _matched_criteria, 'balance' AS _passed_filters, {_PLAIN} AS _relevance_score, 'customer' AS _table FROM m JOIN customer ON table_name = 'customer' AND c_custkey = CAST(record_id AS BIGINT) WHERE c_acctbal > 0")
def provenance(t) -> DataFrame:
    rows = t("customer").where("c_acctbal > 0").select("c_name", F.lit("customer").alias("table_name"), F.col("c_custkey").cast("string").alias("record_id"), R.cells(["c_name", "c_mktsegment"]).alias("cells"), F.array(F.lit("balance")).alias("passed_filters"))
    return sinks.with_provenance(S.relevance(S.match(rows, CRITERIA), _USED), ["c_name"])
