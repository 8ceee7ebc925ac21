"""Queries: further catalogs, single quality dimensions, ingest jobs and plug-in points."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..operators import graph as G
from ..operators import patterns as P
from ..operators import search as S
from ..sources import sinks, web
from ..sources.shared import shared_dir
from ..streaming import ingest
from . import assist as A
from . import question as Q
from . import reports as M
from .q_extract import _MAIL_SQL
from .q_profile import _DIMS, _SQL_ENT, dims
from .registry import query, sql_values, values

for _id, _name in (("i08", "accuracy"), ("i09", "consistency"), ("i10", "timeliness"), ("i11", "validity"), ("i12", "uniqueness")):

    def _dimension(t, name=_name) -> DataFrame:
        return dims(t).where(F.col("dimension") == name).select(F.round("score", 9).alias("score"))

    query(f"{_id}_{_name}", f"WITH {_SQL_ENT}, {_DIMS} SELECT round(score, 9) AS score FROM q WHERE dimension = '{_name}'")(_dimension)

_MATCH = [("+91 90000 00001", "9000000001", "A@b.c", "a@B.c "), ("1", "1", "", ""), (None, "9000000001", None, "x")]


@query("g14_contacts_match", "SELECT * FROM " + sql_values([(0, True, True), (1, False, False), (2, False, False)], "id, phone, email"))
def contacts(t) -> DataFrame:
    df = values(t, [(i, *m) for i, m in enumerate(_MATCH)], "id int, p1 string, p2 string, e1 string, e2 string")
    return df.select("id", T.phones_match(F.col("p1"), F.col("p2")).alias("phone"), T.emails_match(F.col("e1"), F.col("e2")).alias("email"))


_NOTE = [(1, "call Asha Rao 91-9000000001 or A@b.org from Pune, PAN abcde1234f, account: 123456789"), (2, "Asha Rao knows Ravi Shah. Ravi Shah works at Acme Ltd; phone 9000000002")]


def _notes(t) -> DataFrame:
    return values(t, _NOTE, "doc_id int, text string")


@query("c22_compact", "SELECT * FROM " + sql_values([(1, "phone", "9000000001"), (1, "email", "a@b.org"), (1, "id_number", "ABCDE1234F"), (1, "account", "123456789")], "doc, type, normalized"))
def compact(t) -> DataFrame:
    return X.extract(_notes(t), catalog=X.COMPACT, kinds=["phone", "email", "id_number", "account"]).where("doc = 1").select("doc", "type", "normalized")


@query("c23_agent", "SELECT * FROM " + sql_values([(1, "email", "a@b.org"), (1, "city", "Pune"), (2, "phone", "9000000002"), (2, "name", "Ravi Shah"), (3, "phone", "+919000000003"), (3, "pincode", "411001"), (3, "name", "Sanjay"), (3, "city", "Navi mumbai"), (3, "city", "Mumbai")], "doc, type, value"))
def agent(t) -> DataFrame:
    docs = values(t, [(1, "mail A@b.org from Pune"), (2, "Asha Rao knows Ravi Shah, phone: 9000000002"), (3, "Sanjay +91-9000000003 pin 411001 NAVI MUMBAI")], "doc_id int, text string")
    return X.agent_entities(docs).select("doc", "type", "value")


_CITY_LIST = "[" + ", ".join(f"'{c}'" for c in X.AGENT_CITIES) + "]"
_AGENT_SQL = f"WITH d AS (SELECT doc_id, coalesce(text, '') || ' in ' || {_CITY_LIST}[(doc_id % {len(X.AGENT_CITIES)} + 1)::INT] || ' 411' || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS x FROM documents) SELECT doc_id AS doc, 'city' AS type, upper(c[1]) || c[2:] AS value FROM d, (SELECT unnest({_CITY_LIST}) AS c) WHERE contains(lower(x), c) UNION ALL SELECT DISTINCT doc_id, 'pincode', unnest(regexp_extract_all(x, '\\b[1-9][0-9]{{5}}\\b')) FROM d"


@query("c23_agent_documents", _AGENT_SQL)
def agent_documents(t) -> DataFrame:
    """Cities and pin codes of all documents, with one of each put in at the end."""
    city = F.element_at(F.array(*map(F.lit, X.AGENT_CITIES)), (F.col("doc_id") % len(X.AGENT_CITIES) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" in "), city, F.lit(" 411"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))
    return X.agent_entities(t("documents").select("doc_id", text.alias("text"))).where("type in ('city', 'pincode')").select("doc", "type", "value")


@query("c24_json_connections", "SELECT * FROM " + sql_values([("email", "a@b.org"), ("phone", "9000000001")], "type, normalized"))
def from_json(t) -> DataFrame:
    docs = values(t, [(1, json.dumps({"mail": "A@b.org", "tel": "9000000001"}))], "doc_id int, text string")
    return X.extract(docs, kinds=["phone", "email"]).select("type", "normalized")


@query("c32_layered", "SELECT * FROM " + sql_values([(1, "9000000002", 1.0), (2, "9000000003", 0.95)], "doc, normalized, confidence"))
def layered(t) -> DataFrame:
    docs = values(t, [(1, "phone 9000000002"), (2, "9000000003")], "doc_id int, text string")
    return X.layered(docs).where("type = 'phone'").select("doc", "normalized", F.round("confidence", 6).alias("confidence"))


@query("c32_layers", "SELECT * FROM " + sql_values([(1, "email", "rajesh.k@example.org", 0.97, "rajesh.k@exemple.org"), (1, "email", "rajesh.k@exemple.org", 0.97, "rajesh.k@example.org"), (2, "amount", "500", 1.0, "")], "doc, type, normalized, confidence, aliases"))
def layers(t) -> DataFrame:
    docs = values(t, [(1, "mail rajesh.k@example.org or rajesh.k@exemple.org"), (2, "paid Rs. 500")], "doc_id int, text string")
    return X.layered(docs).where("type in ('email', 'amount')").select("doc", "type", "normalized", F.round("confidence", 6).alias("confidence"), F.array_join("aliases", ",").alias("aliases"))


@query("c40_relationships", "SELECT * FROM " + sql_values([(2, "asha rao", "ravi shah", "association"), (2, "ravi shah", "9000000002", "contact")], "doc, source, target, type"))
def relationships(t) -> DataFrame:
    parties = values(t, [(2, "name", "Asha Rao"), (2, "name", "Ravi Shah"), (2, "company", "Acme Ltd"), (2, "phone", "9000000002")], "doc int, kind string, value string")
    return X.relationships(_notes(t), parties)


_STATED = "SELECT c_custkey AS doc, replace(c_name, '#', ' ') AS name, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query("c40_relationships_customers", f"WITH s AS ({_STATED}) SELECT doc, lower(name) AS source, lower(place) AS target, 'location' AS type FROM s")
def customer_relationships(t) -> DataFrame:
    """Where customers are, read back from a sentence about each."""
    s = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("doc"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("name"), F.col("n_name").alias("place"))
    parties = s.select("doc", F.inline(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")), F.struct(F.lit("location").alias("kind"), F.col("place").alias("value")))))
    return X.relationships(s.select(F.col("doc").alias("doc_id"), F.concat("name", F.lit(" located in "), "place").alias("text")), parties)


_INTENT_SQL = "CASE WHEN contains(lower(text), 'analyze') OR contains(lower(text), 'analysis') THEN 'analyze' WHEN contains(lower(text), 'connect') OR contains(lower(text), 'related') OR contains(lower(text), 'linked') THEN 'connect' WHEN contains(lower(text), 'find') OR contains(lower(text), 'search') THEN 'find' ELSE 'search' END"


@query("c41_smart_parse", "SELECT * FROM " + sql_values([(1, "connect", "Sanjay", "Pune", ""), (2, "analyze", "", "", "Blue Lake"), (3, "search", "", "", "")], "doc, intent, names, locations, companies"))
def smart_parse(t) -> DataFrame:
    docs = values(t, [(1, "find who is linked to Sanjay in Pune"), (2, "search and analyze Blue Lake Pvt Ltd"), (3, "what is there")], "doc_id int, text string")
    return X.smart_parse(docs).select("doc", "intent", *(F.array_join(c, ",").alias(c) for c in ("names", "locations", "companies")))


@query("c41_intent_turns", f"SELECT conv_id, turn, {_INTENT_SQL} AS intent FROM conversations")
def intent_turns(t) -> DataFrame:
    """What every turn of the conversations asks for."""
    docs = t("conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("doc_id"), "text")
    return X.intents(docs).select("doc.conv_id", "doc.turn", "intent")


@query("d15_fallback_promotion", "SELECT 'delhi' AS searched, 0 AS filters")
def promoted(t) -> DataFrame:
    a, b = Q.search_and_filter([S.Criterion("c1", "location", "delhi", "P5")])
    return values(t, [(a[0].term, len(b))], "searched string, filters int")


@query("h29_agent_counts", """WITH r AS (SELECT c_custkey AS id, '9' || lpad(c_nationkey::VARCHAR, 9, '0') AS phone, CASE WHEN c_custkey % 3 = 0 THEN 'u' || (c_custkey % 50) || '@x.org' END AS email, c_mktsegment AS address FROM customer)
SELECT 'records' AS kind, count(*) AS n, 'customer' AS detail FROM r UNION ALL SELECT 'phones', count(DISTINCT phone), NULL FROM r HAVING count(DISTINCT phone) > 1 UNION ALL SELECT 'emails', count(DISTINCT email), NULL FROM r HAVING count(DISTINCT email) > 1
UNION ALL SELECT 'places', count(DISTINCT address), NULL FROM r UNION ALL SELECT 'shared_phone', count(phone) - count(DISTINCT phone), NULL FROM r HAVING count(phone) > count(DISTINCT phone) UNION ALL SELECT 'shared_email', count(email) - count(DISTINCT email), NULL FROM r HAVING count(email) > count(DISTINCT email)""")
def agent_counts(t) -> DataFrame:
    k = F.col("c_custkey")
    r = t("customer").select(k.alias("record_id"), F.lit("customer").alias("table_name"), F.concat(F.lit("9"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0")).alias("phone"), F.when(k % 3 == 0, F.concat(F.lit("u"), (k % 50).cast("string"), F.lit("@x.org"))).alias("email"), F.col("c_mktsegment").alias("address"))
    entities = r.select(F.inline(F.array(*(F.struct(F.lit(c).alias("type"), F.col(c).alias("value")) for c in ("phone", "email", "address"))))).where("value is not null")
    return M.agent_counts(r, entities, G.chains(r, {"shared_phone": (F.col("phone"), 0.9), "shared_email": (F.col("email"), 0.95)}, "record_id"))


_RULES = [P.Rule("large", (("p_size", "greaterThan", 45), ("p_name", "exists", None)), "alert", "high"), P.Rule("steel", (("p_type", "contains", "steel"), ("p_size", "lessThan", 20))), P.Rule("brand", (("p_brand", "equals", "brand#11"),), "ignore"), P.Rule("odd", (("p_brand", "matches", "#[13]3$"),), severity="low")]


@query("b13_pattern_rules", """WITH p AS (SELECT * FROM part WHERE lower(p_brand) <> 'brand#11') SELECT p_partkey AS id, 'large' AS rule, 'alert' AS action, 'high' AS severity FROM p WHERE p_size > 45 AND trim(p_name) <> '' UNION ALL SELECT p_partkey, 'steel', 'flag', 'medium' FROM p WHERE contains(lower(p_type), 'steel') AND p_size < 20
UNION ALL SELECT p_partkey, 'odd', 'flag', 'low' FROM p WHERE regexp_matches(p_brand, '#[13]3$')""")
def pattern_rules(t) -> DataFrame:
    return P.apply_rules(t("part"), _RULES, "p_partkey")


@query("a13_parallel_endpoints", "SELECT 'u/' || n_nationkey AS url, '{\"name\": \"' || n_name || '\", \"n\": ' || k || '}' AS record_json FROM nation, range(2) r(k)")
def endpoints(t) -> DataFrame:
    """One endpoint per nation, of which each task fails the first call and asks again."""
    names = {r["n_nationkey"]: r["n_name"] for r in t("nation").collect()}  # 25 rows
    failed = []

    def serve(url, params):
        if not failed:
            failed.append(url)
            raise ValueError("once")
        return json.dumps({"results": [{"name": names[int(url[2:])], "n": k} for k in range(2)]})

    urls = t("nation").select(F.concat(F.lit("u/"), "n_nationkey").alias("url"))
    return web.fetch_all(urls, serve, parallel=2, per_minute=1000)


@query("a12_record_entities", "SELECT 'u1' AS url, 'email' AS type, 'a@b.org' AS normalized UNION ALL SELECT 'u1', 'phone', '9000000001'")
def fetched_entities(t) -> DataFrame:
    records = values(t, [("u1", json.dumps({"m": "A@b.org", "t": "9000000001"})), ("u2", "{}")], "url string, record_json string")
    return web.entities_of(records).where("type in ('email', 'phone')").select("url", "type", "normalized")


@query("a12_record_relations", "SELECT * FROM " + sql_values([("ravi@x.org", "asha@x.org", "communication")], "source, target, type"))
def fetched_relations(t) -> DataFrame:
    """A pattern's ends are words, so of addresses the parts at the keyword are given."""
    records = values(t, [("u1", json.dumps({"note": "ravi called asha"}))], "url string, record_json string")
    entities = values(t, [("u1", json.dumps({"note": "ravi called asha"}), "ravi"), ("u1", json.dumps({"note": "ravi called asha"}), "asha")], "url string, record_json string, value string")
    return web.relations_of(records, entities).select(F.concat("source", F.lit("@x.org")).alias("source"), F.concat("target", F.lit("@x.org")).alias("target"), "type")


@query("n07_without_model", "SELECT 'Unknown' AS risk, 4 AS suggested, 0 AS flags, 'Unable to process query. Please try again.' AS answer")
def without_model(t) -> DataFrame:
    """What is said where no model answers, or a model's answer is no JSON."""
    broken = lambda prompt: "sorry"
    return values(t, [(A.narrative({"n": 1}, broken)["riskAssessment"], len(A.suggested_queries({})), len(A.red_flags({}, broken)), A.answer("who", {"region": t("region")}, broken)["answer"])], "risk string, suggested int, flags int, answer string")


@query("n08_extracted", _MAIL_SQL.replace("AS normalized FROM", "AS value FROM"))
def extracted(t) -> DataFrame:
    return A.extracted(t("documents"), kinds=["email"]).select("doc", "value")


@query("n08_disambiguated", "SELECT 'brand' AS type, p_brand AS value, p_brand AS meant FROM part GROUP BY p_brand UNION ALL SELECT 'brand', lower(p_brand), p_brand FROM part WHERE p_size = 1 GROUP BY p_brand")
def disambiguated(t) -> DataFrame:
    """Spellings in lower case of a part of the brands, under the one that most parts have."""
    p = t("part")
    rows = p.select(F.lit("brand").alias("type"), F.col("p_brand").alias("value")).unionByName(p.where("p_size = 1").select(F.lit("brand"), F.lower("p_brand").alias("value")).distinct().toDF("type", "value"))
    return A.disambiguated(rows)


@query("n08_ranked_terms", "SELECT * FROM " + sql_values([(0, "b", 9), (1, "a", 5), (2, "c", 5)], "place, term, priority"))
def ranked_terms(t) -> DataFrame:
    return values(t, [(i, *x) for i, x in enumerate(A.ranked_terms(["a", "b", "c"], lambda p: '{"b": 9}'))], "place int, term string, priority int")


@query("n10_fallback_report", """SELECT 'title' AS section, 'Report: x' AS text UNION ALL SELECT 'summary', 'The search x returned ' || count(*) || ' results.' FROM supplier UNION ALL SELECT 'method', 'Pattern extraction, iterative search and correlation; no model was asked.' UNION ALL SELECT 'finding', 'flag a' UNION ALL SELECT 'entities', 'segment: ' || count(*) FROM customer
UNION ALL SELECT 'key_entity', 'segment ' || c_mktsegment || ': ' || count(*) || ' occurrences' FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'recommendation', 'Review search results manually' UNION ALL SELECT 'recommendation', 'Expand search criteria if needed' UNION ALL SELECT 'risk', CASE WHEN count(*) > 100 THEN 'high' WHEN count(*) > 50 THEN 'medium' ELSE 'low' END FROM supplier""")
def fallback_report(t) -> DataFrame:
    entities = t("customer").groupBy(F.lit("segment").alias("type"), F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("occurrences"))
    return A.report("x", t("supplier"), entities, ["flag a"]).select("section", "text")


@query("n02_transform", "SELECT * FROM " + sql_values([(1,), (2,)], "id"))
def transformed(t) -> DataFrame:
    rows = web.Fetcher(lambda u, p: '{"deep": {"rows": [1, 2]}}', transform=lambda a: [{"id": x} for x in a["deep"]["rows"]]).records("u")
    return values(t, [(r["id"],) for r in rows], "id int")


@query("n04_custom_schema", "SELECT 'x' AS entity, 'nation' AS table_name, '1' AS record_id")
def custom_schema(t) -> DataFrame:
    cells = values(t, [("nation", "1", "remark", "xy"), ("nation", "2", "other", "xy")], "table_name string, record_id string, field string, value string")
    mapping = values(t, [("nation", "remark", "name")], "table_name string, field string, type string")
    entities = values(t, [("name", "x", "LOW", 0.5)], "type string, entity string, priority string, confidence double")
    return S.lookup_typed(cells, mapping, entities, 10).select("entity", "table_name", "record_id")


def _job(t) -> tuple:
    spark = t("region").sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    n = t("nation").select("n_nationkey", "n_name")
    sinks.write_csv(n.where("n_nationkey < 10").coalesce(1), f"{root}/in/a")
    sinks.write_csv(n.where("n_nationkey >= 10").coalesce(1), f"{root}/in/b")
    q = ingest.start_folder_job(spark, f"{root}/in", "n_nationkey int, n_name string", f"{root}/out", f"{root}/state")
    q.awaitTermination()
    return spark, root, q


@query("a22_ingested", "SELECT n_nationkey, n_name FROM nation")
def ingested(t) -> DataFrame:
    """Two CSV files of nations, written quoted and read back as a stream of files."""
    spark, root, _ = _job(t)
    return spark.read.parquet(f"{root}/out").drop("_file")


@query("a23_job_status", "SELECT false AS active, count(*) AS rows, 2 AS files FROM nation")
def job_status(t) -> DataFrame:
    spark, root, q = _job(t)
    s = ingest.job_status(q)
    return values(t, [(s["active"], s["rows"], ingest.ingested_files(spark, f"{root}/out").count())], "active boolean, rows long, files int")


@query("a24_job_events", "SELECT 'started' AS first, 'ended' AS last, count(*) AS rows, 1 AS jobs, 0 AS errors FROM nation")
def job_events(t) -> DataFrame:
    """What a listener is told of a job, its log and the list of jobs."""
    spark, told = t("region").sparkSession, []
    log = ingest.JobLog().attach(spark)
    log.listen(lambda job, level, message: told.append((job, message)))
    try:
        _, _, q = _job(t)
        job = str(q.id)
        for _ in range(200):  # events come a little later
            if any(m == "ended" for j, m in told if j == job):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    lines = [x["message"] for x in log.logs(job)]
    return values(t, [(lines[0], lines[-1], ingest.job_status(q, log)["rows"], sum(j["id"] == job and not j["active"] for j in log.list()), sum(x["level"] == "error" for x in log.logs(job)))], "first string, last string, rows long, jobs int, errors int")


@query("a15_presets", "SELECT * FROM " + sql_values([("fast", 60, 3600), ("slow", 10, 86400), ("standard", 30, 300)], "name, per_minute, ttl"))
def presets(t) -> DataFrame:
    made = {n: web.preset(n, lambda u, p: "[]") for n in web.PRESETS}
    return values(t, [(n, f.limiter.n, int(f.cache.ttl)) for n, f in made.items()], "name string, per_minute int, ttl int")


@query("a16_cached_answers", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'kept' ELSE 'asked' END AS answer FROM nation")
def cached(t) -> DataFrame:
    """Every third nation is asked for again within its time to live, the others when it is over."""
    out = []
    for (k,) in sorted(t("nation").select("n_nationkey").collect()):
        now = [0.0]
        cache = web.TTLCache(10, clock=lambda now=now: now[0])
        cache.put(str(k), "kept")
        now[0] = 9.0 if k % 3 == 0 else 11.0
        out.append((k, cache.get(str(k)) or "asked"))
    return values(t, out, "n_nationkey int, answer string")


@query("a17_limited_calls", "SELECT i AS call, CASE WHEN i % 13 < 10 THEN 0 ELSE 60 - i % 13 END AS wait FROM range(39) r(i)")
def limited(t) -> DataFrame:
    """Ten calls a minute, a call a second; after thirteen a minute's rest."""
    now, out = [0.0], []
    for i in range(39):
        if i % 13 == 0:
            limiter = web.RateLimiter(10, clock=lambda: now[0])
        now[0] += 1.0
        out.append((i, int(limiter.wait())))
    return values(t, out, "call long, wait long")


@query("a32_simple_csv", "SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ', \"' || p_brand || '\"' ELSE '' END AS label FROM part")
def simple_csv(t) -> DataFrame:
    """Parts with commas and quotes, written and read back."""
    spark = t("region").sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    label = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(', "'), "p_brand", F.lit('"'))).otherwise(""))
    sinks.write_csv(t("part").select("p_partkey", label.alias("label")), path)
    return spark.read.option("header", True).option("escape", '"').schema("p_partkey long, label string").csv(path)
