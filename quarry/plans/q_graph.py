"""Queries: graphs of orders' customers, parts and suppliers, and hand-made ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import graph as G
from ..sources.shared import written
from .registry import query, sql_values, values

_SQL_M = "m AS MATERIALIZED (SELECT l_orderkey AS record_id, 's' || l_suppkey AS entity, 'organization' AS type, l_returnflag AS source, 'LOW' AS priority FROM lineitem UNION ALL SELECT o_orderkey, 'c' || o_custkey, 'name', o_orderpriority, 'HIGH' FROM orders)"
_SQL_P = "p AS MATERIALIZED (SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM (SELECT DISTINCT record_id, entity FROM m) x JOIN (SELECT DISTINCT record_id, entity FROM m) y ON x.record_id = y.record_id AND x.entity < y.entity GROUP BY ALL)"


def mentions(t) -> DataFrame:
    l = t("lineitem").select(F.col("l_orderkey").alias("record_id"), F.concat(F.lit("s"), "l_suppkey").alias("entity"), F.lit("organization").alias("type"), F.col("l_returnflag").alias("source"), F.lit("LOW").alias("priority"))
    return l.unionByName(t("orders").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("c"), "o_custkey").alias("entity"), F.lit("name").alias("type"), F.col("o_orderpriority").alias("source"), F.lit("HIGH").alias("priority")))


@query("f01_cooccurrence_nodes", f"WITH {_SQL_M} SELECT entity AS id, type, count(*) AS occurrences, count(DISTINCT source) AS sources, CASE first(priority) WHEN 'HIGH' THEN 0.8 ELSE 0.2 END::DOUBLE AS risk FROM m GROUP BY entity, type")
def cooccurrence_nodes(t) -> DataFrame:
    return G.cooccurrence_nodes(mentions(t))


@query("f01_cooccurrence_edges", f"WITH {_SQL_M}, {_SQL_P} SELECT a, b, weight, CASE WHEN weight >= 5 THEN 'strong' WHEN weight >= 2 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN weight >= 5 THEN 0.85 WHEN weight >= 2 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM p")
def cooccurrence_edges(t) -> DataFrame:
    return G.cooccurrence_edges(mentions(t))


@query("f02_node_types", "SELECT * FROM " + sql_values([("name", "person"), ("account_number", "account"), ("pincode", "other")], "type, node_type"))
def node_types(t) -> DataFrame:
    return values(t, [("name",), ("account_number",), ("pincode",)], "type string").select("type", G.node_type(F.col("type")).alias("node_type"))


@query("f03_field_graph", "SELECT 'segment:' || lower(c_mktsegment) AS a, 'unit:' || c_nationkey AS b, count(*) AS weight, min(CAST(c_custkey AS VARCHAR)) AS first_record FROM customer WHERE c_nationkey >= 10 GROUP BY ALL")
def field_graph(t) -> DataFrame:
    cells = R.unpivot(R.records(t("customer"), "customer", "c_custkey", ["c_mktsegment", "c_nationkey"]))
    _, edges = G.field_graph(cells, {"c_mktsegment": "segment", "c_nationkey": "unit"})
    return edges.select("a", "b", "weight", F.element_at("records", 1).alias("first_record"))


_EDGES = [("a", "b", 3), ("b", "c", 2), ("c", "d", 1), ("x", "y", 2), ("y", "z", 5), ("x", "z", 1), ("k", "k", 9), ("d", "e", 4)]
_SQL_E = f"e AS (SELECT * FROM {sql_values(_EDGES, 'a, b, weight')}), l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b)"


def edges(t) -> DataFrame:
    return values(t, _EDGES, "a string, b string, weight int")


def _reach(where: str) -> str:
    return f"WITH RECURSIVE l AS (SELECT a, b FROM {sql_values(_EDGES, 'a, b, weight')} WHERE a <> b AND {where} UNION SELECT b, a FROM {sql_values(_EDGES, 'a, b, weight')} WHERE a <> b AND {where}), r(id, o) AS (SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.o = l.a) SELECT id, min(o) AS component FROM r GROUP BY id"


@query("f10_components", _reach("true"))
def component(t) -> DataFrame:
    return G.components(edges(t))


@query("f04_star_clusters", _reach("weight >= 2"))
def star_clusters(t) -> DataFrame:
    return G.star_clusters(edges(t))


def all_edges(t) -> DataFrame:
    """Suppliers and customers that share an order."""
    return G.pair_counts(mentions(t))


def key_links(t) -> DataFrame:
    """all_edges() by keys: even ones of suppliers, odd ones of customers."""
    l = t("lineitem").select(F.col("l_orderkey").alias("record_id"), (F.col("l_suppkey").cast("long") * 2).alias("entity"))
    return G.pair_counts(l.unionByName(t("orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_custkey").cast("long") * 2 + 1).alias("entity")))).select("a", "b")


def key_name(key: Column) -> Column:
    """The name that mentions() gives to a key of key_links()."""
    return F.concat(F.when(key % 2 == 0, "s").otherwise("c"), F.shiftright(key, 1))


_SQL_B = f"m AS MATERIALIZED (SELECT l_orderkey AS record_id, 's' || l_suppkey AS entity FROM lineitem UNION ALL SELECT o_orderkey, 'c' || o_custkey FROM orders), l AS MATERIALIZED (SELECT DISTINCT x.entity AS a, y.entity AS b FROM m x JOIN m y ON x.record_id = y.record_id AND x.entity <> y.entity)"


def _least_reached(rounds: int) -> str:
    """Every vertex takes the least name among its neighbours' and its own, so many times: enough for graphs of that diameter."""
    steps = [f"r{k} AS MATERIALIZED (SELECT l.a AS id, least(min(p.o), min(q.o)) AS o FROM l JOIN r{k - 1} p ON p.id = l.b JOIN r{k - 1} q ON q.id = l.a GROUP BY l.a)" for k in range(1, rounds + 1)]
    return ", ".join(["r0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS o FROM l)", *steps, f"c AS (SELECT id, o AS component FROM r{rounds})"])


@query("f10_clusters", f"WITH {_SQL_B}, {_least_reached(12)} SELECT component, count(*) AS size, 'Cluster ' || row_number() OVER (ORDER BY component) AS label FROM c GROUP BY component HAVING count(*) >= 3")
def clusters(t) -> DataFrame:
    return G.clusters(G.components(G.record_links(mentions(t))))


@query("f14_neighbours", f"WITH {_SQL_B}, s AS (SELECT min(a) AS s FROM l), n AS MATERIALIZED (SELECT DISTINCT b FROM l WHERE a = (SELECT s FROM s)) SELECT b AS id, 1 AS hops FROM n UNION ALL SELECT DISTINCT l.b, 2 FROM l JOIN n ON l.a = n.b WHERE l.b NOT IN (SELECT b FROM n) AND l.b <> (SELECT s FROM s)")
def neighbours(t) -> DataFrame:
    e = written(all_edges(t))
    return G.neighbours(e, e.where("a <> b").agg(F.least(F.min("a"), F.min("b"))).first()[0], 2)


@query("f15_adjacency", f"WITH {_SQL_B} SELECT a AS id, string_agg(b, ',' ORDER BY b) AS neighbours FROM l GROUP BY a")
def adjacency(t) -> DataFrame:
    return G.adjacency(all_edges(t)).select("id", F.array_join("neighbours", ",").alias("neighbours"))


_PATHS = "r(n, path) AS (SELECT b, [a, b] FROM l WHERE a = {start} UNION ALL SELECT l.b, list_append(path, l.b) FROM r JOIN l ON r.n = l.a WHERE r.n <> {goal} AND len(path) <= {most} AND NOT list_contains(path, l.b)) SELECT array_to_string(path, '>') AS path FROM r WHERE n = {goal} ORDER BY len(path), path LIMIT 1"


@query("f13_shortest_path_orders", f"WITH RECURSIVE {_SQL_B}, " + _PATHS.format(start="(SELECT min(a) FROM l)", goal="(SELECT max(a) FROM l)", most=3))
def shortest_path_of_orders(t) -> DataFrame:
    """From the first to the last name among suppliers and customers that share orders."""
    e = written(all_edges(t))
    ends = G.both_ways(e).agg(F.min("a"), F.max("a")).first()
    return G.shortest_path(e, ends[0], ends[1]).select(F.array_join("path", ">").alias("path"))


@query("f13_shortest_path", f"WITH RECURSIVE {_SQL_E}, " + _PATHS.format(start="'a'", goal="'e'", most=9))
def shortest_path(t) -> DataFrame:
    return G.shortest_path(edges(t), "a", "e").select(F.array_join("path", ">").alias("path"))


@query("f17_simple_paths", f"WITH RECURSIVE {_SQL_E}, r(n, path) AS (SELECT b, [a, b] FROM l WHERE a = 'x' UNION ALL SELECT l.b, list_append(path, l.b) FROM r JOIN l ON r.n = l.a WHERE r.n <> 'z' AND NOT list_contains(path, l.b) AND len(path) <= 3) SELECT array_to_string(path, '>') AS path FROM r WHERE n = 'z'")
def simple_paths(t) -> DataFrame:
    return G.simple_paths(edges(t), "x", "z", 3).select(F.array_join("path", ">").alias("path"))


_ENDS = "z AS (SELECT min(a) AS x, max(a) AS y FROM l)"


@query("f17_simple_paths_orders", f"""WITH {_SQL_B}, {_ENDS} SELECT a || '>' || b AS path FROM l, z WHERE a = x AND b = y UNION ALL SELECT p.a || '>' || p.b || '>' || q.b FROM z, l p JOIN l q ON p.b = q.a WHERE p.a = x AND q.b = y
UNION ALL SELECT p.a || '>' || p.b || '>' || q.b || '>' || r.b FROM z, l p JOIN l q ON p.b = q.a JOIN l r ON q.b = r.a WHERE p.a = x AND r.b = y AND p.b <> y AND q.b <> x AND q.b <> y""")
def simple_paths_of_orders(t) -> DataFrame:
    """Paths of three hops at most from the first customer to the last supplier by name."""
    e = written(all_edges(t))
    ends = e.select(F.least(F.min("a"), F.min("b")).alias("x"), F.greatest(F.max("a"), F.max("b")).alias("y")).first()
    return G.simple_paths(e, ends["x"], ends["y"], 3).select(F.array_join("path", ">").alias("path"))


@query("f22_cycles", f"WITH {_SQL_B}, c3 AS (SELECT p.a || '>' || p.b || '>' || q.b AS cycle FROM l p JOIN l q ON p.b = q.a JOIN l r ON q.b = r.a AND r.b = p.a WHERE p.a < p.b AND p.a < q.b AND p.b < q.b) SELECT cycle FROM c3")
def cycles(t) -> DataFrame:
    """Every triangle of suppliers and customers over all orders; their number is in the nature of a dense graph."""
    return G.cycles(key_links(t), 3, key_name, True).select(F.array_join("cycle", ">").alias("cycle"))


_CLASSES = f"""WITH {_SQL_B}, n AS MATERIALIZED (SELECT a AS id, row_number() OVER (ORDER BY count(*), a) AS no FROM l GROUP BY a), e AS MATERIALIZED (SELECT p.no AS x, q.no AS y FROM l JOIN n p ON p.id = l.a JOIN n q ON q.id = l.b),
w AS (SELECT p.x AS v, q.y AS w, count(*) AS k, min(q.x) AS f, max(q.x) AS t FROM e p JOIN e q ON p.y = q.x WHERE p.y < p.x AND q.y < p.x GROUP BY ALL), c AS (SELECT w.*, e.x IS NOT NULL AS linked FROM w LEFT JOIN e ON e.x = w.v AND e.y = w.w),
s AS (SELECT v, 3 AS size, sum(k) // 2 AS cycles, arg_min([v, f, w], w) AS path FROM c WHERE linked GROUP BY v UNION ALL SELECT v, 4, sum(k * (k - 1) // 2), arg_min([v, f, w, t], w) FROM c WHERE k > 1 GROUP BY v)"""


@query("f22_cycle_classes", f"{_CLASSES} SELECT n.id AS hub, size, cycles::BIGINT AS cycles, (SELECT string_agg(m.id, '>' ORDER BY i) FROM (SELECT unnest(path) AS no, generate_subscripts(path, 1) AS i) p JOIN n m ON m.no = p.no) AS example FROM s JOIN n ON n.no = v")
def cycle_classes(t) -> DataFrame:
    """Cycles of three and four suppliers and customers over all orders: how many each hub has, and one of them."""
    return G.cycle_classes(key_links(t), key_name, True).withColumn("example", F.array_join("example", ">"))


@query("h18_circular_hubs", f"{_CLASSES} SELECT n.id AS hub, sum(cycles)::BIGINT AS cycles, 'high' AS severity, 0.85::DOUBLE AS score FROM s JOIN n ON n.no = v GROUP BY n.id")
def circular_hubs(t) -> DataFrame:
    """Circular relations of all orders, by the node of each that has most relations."""
    return G.cycle_classes(key_links(t), key_name, True).groupBy("hub").agg(F.sum("cycles").alias("cycles"), F.lit("high").alias("severity"), F.lit(0.85).alias("score"))


_SAID = [(1, "Asha is the sister of Ravi. Ravi paid Rs. 5,000 to Kiran"), (2, "Kiran lives in Pune and Meena works at Acme"), (3, "nobody called anyone")]
_KNOWN = [(1, "Asha"), (1, "ravi"), (1, "Kiran"), (2, "Kiran"), (2, "Pune"), (2, "Meena"), (3, "anyone")]


@query("f05_text_relations", "SELECT * FROM " + sql_values([(1, "asha", "ravi", "family", "strong", 0.8), (1, "ravi", "kiran", "financial", "strong", 0.8), (2, "kiran", "pune", "location", "moderate", 0.8)], "doc, source, target, type, strength, confidence"))
def text_relations(t) -> DataFrame:
    return G.text_relations(values(t, _SAID, "doc_id int, text string"), values(t, _KNOWN, "doc int, entity string"))


@query("f06_inferred_edges", f"""WITH {_SQL_M}, d AS (SELECT DISTINCT record_id, entity, type FROM m), p AS (SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM d x JOIN d y ON x.record_id = y.record_id AND x.entity < y.entity AND x.type <> y.type GROUP BY ALL)
SELECT a, b, weight, least(0.5 + 0.1 * weight, 0.95)::DOUBLE AS confidence, CASE WHEN weight >= 10 THEN 'strong' WHEN weight >= 5 THEN 'moderate' ELSE 'weak' END AS strength FROM p""")
def inferred_edges(t) -> DataFrame:
    return G.inferred_edges(mentions(t))


_ENTS = [(1, "e1", "name", "asha", "Asha", "t1"), (2, "e2", "name", "asha", "ASHA", "t2"), (3, "e3", "phone", "9000000001", "9000000001", "t1"), (4, "e4", "name", "asha", "Asha", "t3")]


@query("f07_merge_entities", "SELECT * FROM " + sql_values([("name", "asha", "e1", "ASHA|Asha", "t1|t2|t3"), ("phone", "9000000001", "e3", "9000000001", "t1")], "type, normalized, id, aliases, sources"))
def merge_entities(t) -> DataFrame:
    out = G.merge_entities(values(t, _ENTS, "seq int, id string, type string, normalized string, value string, source string"))
    return out.select("type", "normalized", "id", F.array_join("aliases", "|").alias("aliases"), F.array_join("sources", "|").alias("sources"))


_RELS = [(1, "a", "b", "x", 0.8), (2, "a", "b", "x", 0.9), (3, "a", "b", "y", 0.99), (4, "a", "q", "x", 0.5), (5, "a", "b", "x", 0.1)]


@query("f08_merge_relationships", f"SELECT source, target, type, count(*) AS occurrences, round(least(1, min_by(confidence, seq) + 0.05 * (count(*) - 1)), 6)::DOUBLE AS confidence FROM {sql_values(_RELS, 'seq, source, target, type, confidence')} WHERE target <> 'q' GROUP BY source, target, type")
def merge_relationships(t) -> DataFrame:
    nodes = values(t, [("a",), ("b",)], "id string")
    return G.merge_relationships(values(t, _RELS, "seq int, source string, target string, type string, confidence double"), nodes).withColumn("confidence", F.round("confidence", 6))


_WEIGHTS = [("strong", 1), ("moderate", 3), ("weak", 100), ("inferred", 0), ("other", 2)]


@query("f09_edge_weight", f"SELECT s, n, round(least(1, 0.5 + CASE s WHEN 'strong' THEN 0.3 WHEN 'moderate' THEN 0.2 WHEN 'weak' THEN 0.1 WHEN 'inferred' THEN 0.05 ELSE 0 END + least(0.05 * n, 0.2)), 6)::DOUBLE AS weight FROM {sql_values(_WEIGHTS, 's, n')}")
def edge_weight(t) -> DataFrame:
    return values(t, _WEIGHTS, "s string, n int").select("s", "n", F.round(G.edge_weight(F.col("s"), F.col("n")), 6).alias("weight"))


_MEMBERS = [("c1", "crypto_address"), ("c1", "phone"), ("c2", "name"), ("c2", "unknown"), ("c2", "date")]


@query("f11_cluster_risk", f"SELECT c AS component, round(least(1, avg(CASE type WHEN 'crypto_address' THEN 0.3 WHEN 'phone' THEN 0.1 WHEN 'date' THEN 0.02 ELSE 0.05 END::DOUBLE) * 5), 6) AS risk FROM {sql_values(_MEMBERS, 'c, type')} GROUP BY c")
def cluster_risk(t) -> DataFrame:
    return G.cluster_risk(values(t, _MEMBERS, "component string, type string")).withColumn("risk", F.round("risk", 6))


@query("f12_metadata", f"WITH {_SQL_M}, {_SQL_P}, n AS (SELECT DISTINCT entity, type FROM m) SELECT 'node' AS kind, type, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', CASE WHEN weight >= 5 THEN 'strong' WHEN weight >= 2 THEN 'moderate' ELSE 'weak' END, count(*) FROM p GROUP BY ALL")
def metadata(t) -> DataFrame:
    m = mentions(t)
    return G.metadata(G.cooccurrence_nodes(m), G.cooccurrence_edges(m).withColumn("type", F.col("strength")))


@query("f16_graph_json", "SELECT '{\"a\":\"' || a || '\",\"b\":\"' || b || '\",\"weight\":' || weight || '}' AS json FROM " + sql_values(_EDGES, "a, b, weight"))
def graph_json(t) -> DataFrame:
    return edges(t).select(F.to_json(F.struct("a", "b", "weight")).alias("json"))


@query("f18_chains", """SELECT source, target, 'customer' AS type, 0.9::DOUBLE AS strength FROM (SELECT o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target FROM orders) WHERE target IS NOT NULL
UNION ALL SELECT source, target, 'price', 0.7 FROM (SELECT o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY CAST(floor(o_totalprice) AS BIGINT) ORDER BY o_orderdate, o_orderkey) AS target FROM orders) WHERE target IS NOT NULL""")
def chains(t) -> DataFrame:
    o = t("orders").withColumnRenamed("o_orderkey", "record_id")
    return G.chains(o, {"customer": (F.col("o_custkey").cast("string"), 0.9), "price": (F.floor("o_totalprice").cast("string"), 0.7)}, "o_orderdate")


_LINKS = [("a", "b", 0.9), ("b", "c", 0.95), ("c", "d", 0.99), ("p", "q", 0.65), ("q", "r", 0.5), ("a", "b", 0.7)]


@query("f20_closure", "SELECT * FROM " + sql_values([("a", "b", 0.9, False), ("b", "c", 0.95, False), ("c", "d", 0.99, False), ("p", "q", 0.65, False), ("q", "r", 0.5, False), ("a", "c", 0.63, True), ("b", "d", 0.665, True), ("a", "d", 0.4655, True)], "a, b, strength, inferred"))
def closure(t) -> DataFrame:
    return G.closure(values(t, _LINKS, "a string, b string, strength double")).withColumn("strength", F.round("strength", 6))


def _closed(rounds: int) -> str:
    """SQL of so many rounds of two hops over links of .6 or more."""
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"w{k} AS (SELECT a, b, strength FROM r{k - 1} WHERE strength >= 0.6 UNION ALL SELECT b, a, strength FROM r{k - 1} WHERE strength >= 0.6), n{k} AS MATERIALIZED (SELECT x.a, y.b, max(least(x.strength, y.strength)) * 0.7 AS strength FROM w{k} x JOIN w{k} y ON x.b = y.a AND x.a < y.b GROUP BY ALL), r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT a, b, strength, true FROM n{k} ANTI JOIN r{k - 1} USING (a, b))")
    return ", ".join(steps)


def repeated_links(t) -> DataFrame:
    """Customers and suppliers with two orders or more in common, the stronger the more."""
    return G.pair_counts(mentions(t)).where("weight >= 2 and a like 'c%' and b like 's%'").select("a", "b", F.least(F.lit(1.0), 0.5 + 0.15 * F.col("weight")).alias("strength"))


_REPEATED = f"{_SQL_M}, d AS (SELECT DISTINCT record_id, entity FROM m), r0 AS MATERIALIZED (SELECT x.entity AS a, y.entity AS b, least(1.0, 0.5 + 0.15 * count(*))::DOUBLE AS strength, false AS inferred FROM d x JOIN d y ON x.record_id = y.record_id AND x.entity < y.entity WHERE x.entity LIKE 'c%' AND y.entity LIKE 's%' GROUP BY ALL HAVING count(*) >= 2)"


@query("f20_closure_orders", f"WITH {_REPEATED}, {_closed(3)} SELECT a, b, round(strength, 6) AS strength, inferred FROM r3")
def closure_of_orders(t) -> DataFrame:
    return G.closure(repeated_links(t)).withColumn("strength", F.round("strength", 6))


_PEOPLE = [("a", "person", "Asha"), ("b", "person", "Bina"), ("c", "company", "Acme"), ("p", "person", "Pia"), ("q", "person", "Qi"), ("r", "person", "Ra"), ("s", "person", "Su")]
_PLINKS = [("a", "b", 0.9), ("b", "c", 0.7), ("p", "q", 1.0), ("q", "r", 1.0), ("r", "s", 0.7)]


@query("f21_entity_clusters", "SELECT * FROM " + sql_values([("a", 3, "mixed", "Asha - Bina - Acme", "Cluster contains 1 company, 2 persons with shared connections", 0.8), ("p", 4, "person_network", "Pia Network (4 entities)", "Cluster contains 4 persons with shared connections", 0.9)], "component, size, cluster_type, name, summary, strength"))
def entity_clusters(t) -> DataFrame:
    rels = values(t, _PLINKS, "a string, b string, strength double")
    return G.entity_clusters(values(t, _PEOPLE, "id string, type string, name string"), rels, G.components(rels)).withColumn("strength", F.round("strength", 6)).select("component", F.col("size").cast("int").alias("size"), "cluster_type", "name", "summary", "strength")


@query("f23_record_timeline", "SELECT o_orderkey AS record_id, 'o_orderdate' AS field, o_orderdate AS ts FROM orders UNION ALL SELECT l_orderkey, 'l_shipdate', l_shipdate FROM lineitem")
def record_timeline(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("record_id"), F.lit("o_orderdate").alias("field"), F.col("o_orderdate").alias("ts")).unionByName(t("lineitem").select(F.col("l_orderkey").alias("record_id"), F.lit("l_shipdate").alias("field"), F.col("l_shipdate").alias("ts"))).orderBy("ts", "record_id", "field")


@query("f24_layout", "SELECT 'n' || n_nationkey AS id, round(cos(2 * pi() * (row_number() OVER (ORDER BY 'n' || n_nationkey) - 1) / 25), 6) + 0.0 AS x, round(sin(2 * pi() * (row_number() OVER (ORDER BY 'n' || n_nationkey) - 1) / 25), 6) + 0.0 AS y FROM nation")
def layout(t) -> DataFrame:
    out = G.circular_layout(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))
    return out.select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query("f25_metrics", f"""WITH {_SQL_M}, {_SQL_P}, l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), {_least_reached(12)}, n AS (SELECT DISTINCT entity FROM m), d AS (SELECT v, count(*) AS d FROM (SELECT a AS v FROM p UNION ALL SELECT b FROM p) GROUP BY v)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM p) AS edges, (SELECT count(*) FROM p)::DOUBLE / ((SELECT count(*) FROM n)::DOUBLE * ((SELECT count(*) FROM n) - 1) / 2) AS density, 2.0::DOUBLE * (SELECT count(*) FROM p) / (SELECT count(*) FROM n) AS mean_degree, (SELECT max(d) FROM d) AS max_degree, (SELECT count(DISTINCT component) FROM c) + (SELECT count(*) FROM n WHERE entity NOT IN (SELECT id FROM c)) AS components""")
def metrics(t) -> DataFrame:
    m = mentions(t)
    return G.metrics(G.cooccurrence_nodes(m), written(G.pair_counts(m)), G.components(G.record_links(m)))
