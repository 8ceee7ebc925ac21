"""Queries: report datasets and fetched records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import patterns as P
from ..sources import pages, web
from . import reports as M
from .q_graph import _SQL_M, _SQL_P, mentions
from .q_links import _DEG, degree
from .registry import query, sql_values, values


def _nodes(t) -> DataFrame:
    m = mentions(t)
    return G.cooccurrence_nodes(m).join(degree(t), "id")


_SQL_N = f"{_DEG}, nn AS (SELECT entity AS id, count(*) AS occurrences, count(DISTINCT source) AS sources, any_value(type) AS type FROM m GROUP BY entity), nd AS (SELECT nn.*, d.degree FROM nn JOIN d USING (id))"


@query("h22_search_insights", f"WITH {_SQL_N} SELECT 'table' AS kind, 'orders' AS subject, count(*) AS value FROM orders UNION ALL SELECT 'entity', id, occurrences FROM (SELECT * FROM nd ORDER BY occurrences DESC, id LIMIT 10) UNION ALL SELECT 'many_connections', id, degree FROM nd WHERE degree > 5 UNION ALL SELECT 'many_sources', id, sources FROM nd WHERE sources > 2")
def search_insights(t) -> DataFrame:
    return M.search_insights(t("orders").select(F.lit("orders").alias("table_name")), _nodes(t))


@query("h23_agent_insights", f"WITH {_SQL_M}, {_SQL_P} SELECT 'node' AS kind, id AS subject, n AS value FROM (SELECT entity AS id, count(*) AS n FROM m GROUP BY entity HAVING count(*) >= 2 ORDER BY n DESC, id LIMIT 5) UNION ALL SELECT 'edge', a || '-' || b, weight FROM (SELECT * FROM p WHERE weight >= 2 ORDER BY weight DESC, a, b LIMIT 5)")
def agent_insights(t) -> DataFrame:
    m = mentions(t)
    return M.agent_insights(m.groupBy(F.col("entity").alias("id")).agg(F.count(F.lit(1)).alias("count")), G.pair_counts(m))


@query("h24_findings", f"WITH {_DEG}, z AS (SELECT id, round((degree - (SELECT avg(degree) FROM d)) / (SELECT stddev_pop(degree) FROM d), 6) AS z FROM d) SELECT 'pattern' AS kind, id, s AS score, CASE WHEN s > 0.9 THEN 'critical' WHEN s > 0.8 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT id, least(degree::DOUBLE / 50, 1) AS s FROM d WHERE degree > 35 ORDER BY s DESC, id LIMIT 5) WHERE s > 0.7 UNION ALL SELECT 'anomaly', id, z, CASE WHEN z > 3.75 THEN 'critical' ELSE 'high' END FROM (SELECT * FROM z WHERE z > 2.5 ORDER BY z DESC, id LIMIT 3)")
def findings(t) -> DataFrame:
    d = degree(t)
    return M.findings(P.frequent_nodes(d), P.outliers(d).select("id", F.round("z", 6).alias("score")), 2.5)


@query("h25_entity_breakdown", f"WITH {_SQL_N} SELECT 'type' AS kind, type AS subject, count(*) AS n FROM nd GROUP BY type UNION ALL SELECT 'node', id, degree FROM (SELECT * FROM nd WHERE degree > 5 ORDER BY degree DESC, id LIMIT 10)")
def breakdown(t) -> DataFrame:
    return M.entity_breakdown(_nodes(t), degree(t))


@query("h26_strong_relations", f"WITH {_SQL_M}, {_SQL_P} SELECT a, b, weight FROM p WHERE weight >= 5 ORDER BY a, b LIMIT 15")
def strong(t) -> DataFrame:
    return M.strong_relations(G.cooccurrence_edges(mentions(t))).select("a", "b", "weight")


@query("h20_relation_timeline", "SELECT min(o_orderdate) AS ts, 'registration' AS kind, 'c' || o_custkey AS id, 'medium' AS importance FROM orders GROUP BY o_custkey UNION ALL SELECT o_orderdate, 'relation', 'c' || o_custkey || '-o' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'high' ELSE 'medium' END FROM orders")
def relation_timeline(t) -> DataFrame:
    o = t("orders")
    made = o.groupBy(F.concat(F.lit("c"), "o_custkey").alias("id")).agg(F.min("o_orderdate").alias("ts"))
    rels = o.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("o"), "o_orderkey").alias("b"), F.when(F.col("o_orderstatus") == "F", 0.9).otherwise(0.5).alias("strength"), F.col("o_orderdate").alias("ts"))
    return M.relation_timeline(made, rels, "ts")


@query("h30_executive_summary", "SELECT count(*) || ' entities, 3 relations, 2 patterns; data quality 88 %' AS text FROM customer")
def summary(t) -> DataFrame:
    return t("customer").agg(F.count(F.lit(1)).alias("n")).select(M.executive_summary(F.col("n"), F.lit(3), F.lit(2), F.lit(0.88)).alias("text"))


_PAGES = {1: [{"id": 1}, {"id": 2}], 2: [{"id": 3}]}


@query("a12_fetched_records", "SELECT * FROM " + sql_values([("u1", '{"id": 1}'), ("u1", '{"id": 2}')], "url, record_json"))
def fetched(t) -> DataFrame:
    """A source that fails once is asked again."""
    calls = []

    def answer(url, params):
        calls.append(url)
        if len(calls) == 1:
            raise OSError("once")
        return json.dumps({"results": _PAGES[1]})

    return web.Fetcher(answer, sleep=lambda s: None).frame(t("region").sparkSession, ["u1"])


@query("a14_fetched_pages", "SELECT * FROM " + sql_values([(1,), (2,), (3,)], "id"))
def paged(t) -> DataFrame:
    pages = web.Fetcher(lambda url, p: json.dumps(_PAGES[p["page"]])).pages("u", page_size=2)
    return values(t, [(r["id"],) for rows in pages for r in rows], "id int")


@query("a14_paged_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def paged_orders(t) -> DataFrame:
    """All orders from a service that gives 1,000 rows a page, 20 pages to a task."""
    orders = t("orders")
    spark = orders.sparkSession
    pages.register(spark)
    files = ",".join(sorted(x.removeprefix("file:").replace("///", "/") for x in orders.inputFiles()))
    served = spark.read.format(pages.NAME).option("service", "quarry.sources.pages:ParquetService").option("path", files).option("page_size", 1000).option("pages", 20).load()
    return served.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("a19_scraped", "SELECT url, length(substr(html, 1, 10000)) AS n FROM pages")
def scraped(t) -> DataFrame:
    return web.scraped(t("pages")).select("url", F.length("raw").cast("long").alias("n"))
