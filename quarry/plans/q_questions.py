"""Queries: questions, plans, reports, ingest and change status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search as S
from ..streaming import ingest
from . import question as Q
from .registry import query, sql_values, values

NOW = datetime(2024, 3, 15, 12)
_INTENTS = [("find all people with phone", "find_entity"), ("how are they connected to him", "find_connections"), ("list all transactions", "find_transactions"), ("detect anomalies", "analyze_patterns"), ("timeline of events", "timeline_analysis"), ("risk assessment", "risk_assessment"), ("generate a report", "generate_report"), ("hello", "unknown")]


@query("d01_intents", "SELECT * FROM " + sql_values(_INTENTS, "q, intent"))
def intents(t) -> DataFrame:
    return values(t, [(q, Q.detect_intent(q)) for q, _ in _INTENTS], "q string, intent string")


@query("d02_filters", "SELECT * FROM " + sql_values([("amount", "greater_than", "50000.0"), ("phone", "starts_with", "98"), ("location", "contains", "Pune")], "field, operator, value"))
def filters(t) -> DataFrame:
    found = Q.extract_filters("above Rs 50,000 phone starting with 98") + Q.extract_filters("people in Pune")
    return values(t, [(f, o, str(v)) for f, o, v in found], "field string, operator string, value string")


_TIMES = [("last 24 hours", "2024-03-14 12"), ("last 2 weeks", "2024-03-01 12"), ("last 1 month", "2024-02-15 12"), ("yesterday", "2024-03-14 00"), ("this week", "2024-03-10 00"), ("this year", "2024-01-01 00"), ("between 01/02/2024 and 03/02/2024", "2024-02-01 00"), ("in january 2023", "2023-01-01 00"), ("never", None)]


@query("d03_time_ranges", "SELECT * FROM " + sql_values(_TIMES, "q, start"))
def times(t) -> DataFrame:
    found = [(q, Q.time_range(q, NOW)) for q, _ in _TIMES]
    return values(t, [(q, r[0].strftime("%Y-%m-%d %H") if r else None) for q, r in found], "q string, start string")


@query("d03_time_filter", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00'")
def time_filter(t) -> DataFrame:
    a, b = Q.time_range("last week", datetime(2024, 1, 15))
    return t("events").where((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))).agg(F.count(F.lit(1)).alias("n"))


@query("d04_location", "SELECT 'New Delhi' AS place")
def location(t) -> DataFrame:
    return values(t, [(Q.location_of("people from New Delhi with cars"),)], "place string")


@query("d05_constraints", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limited(t) -> DataFrame:
    c = Q.constraints("top 10 orders sort by o_totalprice")
    column, direction = c["order"]
    return t("orders").orderBy(F.col(column).desc() if direction == "desc" else F.col(column).asc(), "o_orderkey").limit(c["limit"]).select("o_orderkey")


@query("d06_actions", "SELECT * FROM " + sql_values([(k, ",".join(v)) for k, v in Q.ACTIONS.items()], "intent, actions"))
def actions(t) -> DataFrame:
    return values(t, [(k, ",".join(Q.ACTIONS[k])) for k in Q.INTENTS], "intent string, actions string")


@query("d07_plan", "SELECT * FROM " + sql_values([("find all people with x", 2, "low", 1200), ("how are they connected to him", 4, "medium", 2200), ("generate a report", 5, "high", 2700)], "q, steps, complexity, ms"))
def plans(t) -> DataFrame:
    found = [(q, Q.plan(q, 2)) for q in ("find all people with x", "how are they connected to him", "generate a report")]
    return values(t, [(q, len(p.steps), p.complexity, p.estimate_ms) for q, p in found], "q string, steps int, complexity string, ms int")


_ASK = "find Asha Rao 9000000001 a@b.org from Delhi near Nagpur with silver bicycle"


@query("d08_criteria", "SELECT * FROM " + sql_values([("email", "a@b.org", "P1"), ("phone", "9000000001", "P1"), ("name", "asha rao", "P3"), ("location", "nagpur", "P4"), ("keyword", "silver", "P4"), ("keyword", "bicycle", "P4"), ("location", "delhi", "P5")], "type, term, priority"))
def criteria(t) -> DataFrame:
    return values(t, [(c.type, c.term, c.rank) for c in Q.criteria(_ASK)], "type string, term string, priority string")


@query("d09_classification", "SELECT * FROM " + sql_values([("a@b.org", "search"), ("9000000001", "search"), ("asha rao", "search"), ("nagpur", "filter"), ("silver", "search"), ("bicycle", "search"), ("delhi", "filter")], "term, use"))
def classes(t) -> DataFrame:
    return values(t, [(c.term, Q.classify(c)) for c in Q.criteria(_ASK)], "term string, use string")


@query("d10_variations", "SELECT * FROM " + sql_values([("asha rao",), ("asha",), ("rao",), ("ASHA RAO",), ("Asha Rao",)], "v"))
def variations(t) -> DataFrame:
    return values(t, [(v,) for v in Q.variations("asha rao")], "v string")


@query("d11_promoted", "SELECT 'asha' AS searched, 'delhi' AS filtered")
def promoted(t) -> DataFrame:
    a, b = Q.search_and_filter([S.Criterion("c1", "location", "delhi", "P5"), S.Criterion("c2", "name", "asha")])
    return values(t, [(a[0].term, b[0].term)], "searched string, filtered string")


@query("d12_fallback_queries", "SELECT * FROM " + sql_values([("Asha Rao in Pune", 10), ("Asha Rao", 9), ("Asha", 6), ("Rao", 6), ("Pune", 8)], "q, weight"))
def fallback(t) -> DataFrame:
    return values(t, Q.fallback_queries("Asha Rao in Pune"), "q string, weight int")


@query("d14_intent_label", "SELECT 'email+keyword+location+name+phone' AS label")
def label(t) -> DataFrame:
    return values(t, [("+".join(sorted({c.type for c in Q.criteria(_ASK)})),)], "label string")


@query("d16_entity_order", "SELECT * FROM " + sql_values([("other", 0), ("phone", 1), ("email", 2), ("name", 3)], "kind, place"))
def ordered(t) -> DataFrame:
    got = Q.entity_order([("name", "x", 0.9), ("email", "m", 0.5), ("other", "o", 0.1), ("phone", "1", 0.9)])
    return values(t, [(k, i) for i, (k, _, _) in enumerate(got)], "kind string, place int")


@query("n06_hooks", "SELECT 'silver' AS term, 'a: 1; b: 2' AS told")
def hooks(t) -> DataFrame:
    """A model that fails leaves the question to the rules, and the story to the template."""

    def broken(_):
        raise RuntimeError("no model")

    h = Q.Hooks(criteria=broken, narrative=broken)
    return values(t, [(h.find_criteria("silver")[0].term, h.tell({"b": 2, "a": 1}))], "term string, told string")


@query("a25_change_status", "SELECT 'events' AS table_name, max(event_id) AS last_id, count(*) AS rows, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) AS lag_s FROM events")
def change_status(t) -> DataFrame:
    return ingest.change_status(t("events"), "events", "event_id", "ts", "2024-02-01 00:00:00")


@query("h03_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed(t) -> DataFrame:
    return ingest.windowed_counts(t("events"), key="event_type")


@query("m_report_stats", "SELECT 'orders' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'mean_price', round(avg(o_totalprice), 4) FROM orders")
def report_stats(t) -> DataFrame:
    o, c = t("orders").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("m")), t("customer").agg(F.count(F.lit(1)).alias("c"))
    return o.crossJoin(c).select(F.inline(F.array(F.struct(F.lit("orders").alias("metric"), F.col("n").cast("double").alias("value")), F.struct(F.lit("customers").alias("metric"), F.col("c").cast("double").alias("value")), F.struct(F.lit("mean_price").alias("metric"), F.col("m").alias("value")))))


@query("m_report_timeline", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def report_timeline(t) -> DataFrame:
    return t("orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("l_event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props(t) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("a31_json_rows", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def json_rows(t) -> DataFrame:
    return t("nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("json"))
