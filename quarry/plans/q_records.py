"""Queries: sources, paging, records and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from ..sources import sinks
from ..sources.catalog import Catalog, drain, keyset_page, normalize_response, source_table, term_pages, where_all
from .registry import query, sql_values, values

TABLES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def catalog(t) -> Catalog:
    c = Catalog(t("region").sparkSession)
    for name, key in TABLES.items():
        c.add(name, t(name), key)
    return c


_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
}
_SEARCHABLE = {"region": "r_name", "nation": "n_name", "customer": "c_name,c_mktsegment", "supplier": "s_name", "part": "p_name,p_brand,p_type", "orders": "o_orderstatus,o_orderpriority"}


@query("a01_list_tables", "SELECT * FROM " + sql_values([(t, len(_COLUMNS[t]), k, ",".join(_COLUMNS[t]), _SEARCHABLE[t]) for t, k in TABLES.items()], "table_name, n_columns, primary_key, sortable, searchable").replace("SELECT *", "SELECT *"))
def list_tables(t) -> DataFrame:
    return catalog(t).list_tables().select("table_name", F.col("n_columns").cast("int").alias("n_columns"), "primary_key", F.array_join("sortable", ",").alias("sortable"), F.array_join("searchable", ",").alias("searchable"))


@query("a02_describe_table", "SELECT * FROM " + sql_values(list(zip(range(6), _COLUMNS["orders"], ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"], strict=True)), "position, column_name, data_type"))
def describe_table(t) -> DataFrame:
    return catalog(t).describe("orders").drop("nullable")


@query("a03_table_stats", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, false AS estimated FROM {n}" for n in TABLES))
def table_stats(t) -> DataFrame:
    return catalog(t).stats()


@query("a04_keyset_page", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_custkey > 100 ORDER BY o_custkey, o_orderkey LIMIT 50")
def keyset(t) -> DataFrame:
    """The page of open orders after customer 100, by customer; the empty filter is dropped."""
    page = keyset_page(t("orders"), "o_custkey", "o_orderkey", 50, filters={"o_orderstatus": "O", "o_orderpriority": ""}, cursor=(100, 1 << 60))
    return page.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("a05_point_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def point_lookup(t) -> DataFrame:
    return catalog(t).record("customer", 42).select("c_custkey", "c_name", "c_mktsegment")


@query("a06_search_table", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')")
def search_table(t) -> DataFrame:
    return catalog(t).search("part", "RED", ["p_name", "p_type"]).select("p_partkey", "p_name")


def _global_sql(test: str, limit: str = "") -> str:
    parts = []
    for n, k in TABLES.items():
        cols = _SEARCHABLE[n].split(",")
        hit = " OR ".join(test.format(c=c) for c in cols)
        fields = ", ".join(f"CASE WHEN {test.format(c=c)} THEN '{c}' END" for c in cols)
        parts.append(f"SELECT '{n}' AS table_name, CAST({k} AS VARCHAR) AS record_id, concat_ws(',', {fields}) AS matched_fields FROM {n} WHERE {hit}")
    return " UNION ALL ".join(parts) + limit


@query("a07_global_search", _global_sql("contains(lower({c}), 'an')"))
def global_search(t) -> DataFrame:
    return catalog(t).global_search("AN")


@query("a07_global_search_exact", _global_sql("lower({c}) = 'building'"))
def global_search_exact(t) -> DataFrame:
    return catalog(t).global_search("Building", exact=True)


@query("a08_parallel_search", f"SELECT * FROM ({_global_sql('contains(lower({c}), $$1-$$)')}) ORDER BY table_name, record_id LIMIT 100")
def parallel_search(t) -> DataFrame:
    return catalog(t).global_search("1-", limit=100)


@query("a09_drain", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 10000")
def drained(t) -> DataFrame:
    return drain(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("a10_term_pages", "SELECT o_orderpriority AS term, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 100 WHEN '2' THEN 80 WHEN '3' THEN 50 WHEN '4' THEN 20 ELSE 0 END")
def paged_terms(t) -> DataFrame:
    """Pages by priority 10, 8, 5, 2 and none, of ten rows each."""
    rank = F.substring("term", 1, 1)
    caps = F.when(rank == "1", 100).when(rank == "2", 80).when(rank == "3", 50).when(rank == "4", 20).otherwise(0)
    return term_pages(t("orders").select(F.col("o_orderpriority").alias("term"), "o_orderkey"), caps, ["o_orderkey"])


_IN_MEMORY = [(1, "alpha", 2.5), (2, None, None), (3, "gamma", -1.0)]


@query("a11_in_memory_table", "SELECT * FROM " + sql_values(_IN_MEMORY, "id, label, amount"))
def in_memory(t) -> DataFrame:
    return values(t, _IN_MEMORY, "id int, label string, amount double")


_PAGE_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, string_split(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#') AS p FROM a)
SELECT page_id, trim(regexp_replace(p[1] || array_to_string(list_transform(p[2:], lambda s: CASE WHEN regexp_matches(s, '^\d{1,7};') THEN chr((regexp_extract(s, '^(\d{1,7});', 1)::INT % 65536)::INT) || regexp_replace(s, '^\d{1,7};', '') ELSE '&#' || s END), ''), '\s+', ' ', 'g')) AS text FROM b"""


@query("a18_html_to_text", _PAGE_SQL)
def html_text(t) -> DataFrame:
    return t("pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("a18_html_to_text_fixture", "SELECT 'A < b \" A x end' AS text")
def html_fixture(t) -> DataFrame:
    page = "<html><script>if (a < b) {}</script><style>p {}</style><!-- no -->A &amp;lt; b&nbsp; &quot; &#65; <p>x<b>  end</b></p></html>"
    return values(t, [(page,)], "html string").select(T.html_to_text(F.col("html")).alias("text"))


@query("a20_normalize_response", "SELECT * FROM " + sql_values([("people", '{"name": "x"}'), ("people", '{"name": "y"}'), ("cars", '{"no": 7}')], "source_table, record_json"))
def normalized(t) -> DataFrame:
    return normalize_response(t("region").sparkSession, {"results": {"people": [{"name": "x"}, {"name": "y"}], "cars": [{"no": 7}], "note": "no list"}})


@query("a21_source_table", "SELECT id, coalesce(_source_table, table_name, 'unknown') AS source_table FROM " + sql_values([(1, "a", "b"), (2, None, "b"), (3, None, None)], "id, _source_table, table_name"))
def source_tables(t) -> DataFrame:
    df = values(t, [(1, "a", "b"), (2, None, "b"), (3, None, None)], "id int, _source_table string, table_name string")
    return df.select("id", source_table(df.columns).alias("source_table"))


@query("a26_health", "SELECT 'healthy' AS status, 1 AS probe")
def health(t) -> DataFrame:
    return t("region").sparkSession.sql("SELECT 'healthy' AS status, 1 AS probe")


@query("a34_latest_activities", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_activities(t) -> DataFrame:
    return sinks.latest(t("events").select("event_id", "ts"), "ts", "event_id", 50)


@query("a34_latest_per_user", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def latest_per_user(t) -> DataFrame:
    return sinks.latest_per(t("events"), "user_id", "ts", "event_id", 20).select("user_id", "event_id")


@query("b01_record_json", """SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","note":null}' AS json FROM region""")
def json_records(t) -> DataFrame:
    df = t("region").withColumn("note", F.lit(None).cast("string"))
    return df.select("r_regionkey", R.record_json(["r_regionkey", "r_name", "note"]).alias("json"))


@query("b02_record_lines", "SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey AS text FROM nation")
def record_lines(t) -> DataFrame:
    return t("nation").withColumn("blank", F.lit("  ")).select("n_nationkey", R.record_text(["n_nationkey", "n_name", "n_regionkey", "blank"]).alias("text"))


@query("b03_record_words", "SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || ' n_name: ' || n_name AS text FROM nation")
def record_words(t) -> DataFrame:
    return t("nation").withColumn("_n", F.lit("x")).select("n_nationkey", R.record_text(["n_nationkey", "n_name", "_n"], " ", skip_private=True).alias("text"))


@query("b04_drop_noise_columns", "SELECT r_regionkey, r_name FROM region")
def noise_columns(t) -> DataFrame:
    return R.drop_noise_columns(t("region").withColumn("UUID", F.lit("u")).withColumn("batch_id", F.lit(1)).withColumn("_x", F.lit(1)).withColumn("created_at", F.lit("d")))


_NOISE = [(1, "plain", 5.0), (2, "1.2e+10", -4.0), (3, "123456789012345", 2.5), (4, "-77", 12345678901.0), (5, "12345", 0.0)]


@query("b05_drop_noise_values", "SELECT id, CASE WHEN regexp_matches(v, '(?i)e\\+?\\d+$') OR regexp_matches(v, '^\\d{15,}$') OR regexp_matches(v, '^-\\d+$') THEN NULL ELSE v END AS v, CASE WHEN abs(x) > 9999999999 OR x < 0 OR x <> floor(x) THEN NULL ELSE CAST(x AS DOUBLE) END AS x FROM " + sql_values(_NOISE, "id, v, x"))
def noise_values(t) -> DataFrame:
    return values(t, _NOISE, "id int, v string, x double").select("id", R.drop_noise_value(F.col("v")).alias("v"), R.drop_noise_value(F.col("x"), numeric=True).alias("x"))


@query("b06_any_column_contains", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), '77') OR contains(CAST(c_custkey AS VARCHAR), '77')")
def any_column(t) -> DataFrame:
    return t("customer").where(R.any_contains([F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")], "77")).select("c_custkey")


@query("b07_filters_all", "SELECT record_id FROM (SELECT CAST(s_suppkey AS VARCHAR) AS record_id, s_name, CAST(s_suppkey AS VARCHAR) AS k FROM supplier) WHERE (contains(lower(s_name), 'supplier') OR contains(k, 'supplier')) AND (contains(lower(s_name), '1') OR contains(k, '1'))")
def all_filters(t) -> DataFrame:
    recs = R.records(t("supplier"), "supplier", "s_suppkey", ["s_suppkey", "s_name"])
    return recs.where(R.filters_all("cells", [("name", "Supplier"), ("keyword", "1")])).select("record_id")


_PLACES = [("1", "Springfield", "x"), ("2", "North Springfield East", "y"), ("3", "Spring", "z"), ("4", "Elsewhere", "near springfield"), ("5", None, "none")]


@query("b07_location_filter", "SELECT id AS record_id FROM " + sql_values(_PLACES, "id, city, note") + " WHERE contains(lower(city), 'springfield') OR contains('springfield', lower(city)) OR contains(lower(note), 'springfield')")
def location_filter(t) -> DataFrame:
    recs = R.records(values(t, _PLACES, "id string, city string, note string"), "places", "id")
    return recs.where(R.filters_all("cells", [("location", "Springfield")])).select("record_id")


@query("b08_filters_any", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), 'an') OR contains(lower(n_name), 'united')")
def any_filter(t) -> DataFrame:
    df = t("nation")
    return df.where(R.filters_any(R.record_json(["n_name"]), ["IAN", "AN", "United"])).select("n_nationkey")


@query("b09_filter_or_all", "SELECT r_regionkey FROM region")
def filter_or_all(t) -> DataFrame:
    """No region passes the filter, so all stay."""
    df = t("region")
    found = df.where(R.filters_any(F.col("r_name"), ["no such place"]))
    return (found if found.limit(1).count() else df).select("r_regionkey")


@query("b10_matched_filters", "SELECT c_custkey, concat_ws(',', CASE WHEN contains(lower(c_name), '9') THEN '9' END, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'build' END) AS matched, 0.2 * ((contains(lower(c_name), '9'))::INT + (contains(lower(c_mktsegment), 'build'))::INT)::DOUBLE AS bonus FROM customer WHERE contains(lower(c_name), '9') OR contains(lower(c_mktsegment), 'build')")
def filter_bonus(t) -> DataFrame:
    df = t("customer").withColumn("m", R.matched_filters(F.concat_ws(" ", "c_name", "c_mktsegment"), ["9", "build"])).where(F.size("m") > 0)
    return df.select("c_custkey", F.array_join("m", ",").alias("matched"), (F.lit(0.2) * F.size("m")).alias("bonus"))


@query("b11_operators", """SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice > 900 AND starts_with(lower(p_brand), 'brand') AND regexp_matches(p_type, '[AEIOU]')
UNION ALL SELECT p_partkey FROM part WHERE p_size < 3 AND ends_with(lower(p_brand), '1') UNION ALL SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#11' AND contains(lower(p_name), 'e')""")
def operators(t) -> DataFrame:
    p = t("part")
    a = where_all(p, [("p_size", "between", 10, 30), ("p_retailprice", "greater_than", 900), ("p_brand", "starts_with", "BRAND"), ("p_type", "regex", "[AEIOU]")])
    b = where_all(p, [("p_size", "less_than", 3), ("p_brand", "ends_with", "1")])
    c = where_all(p, [("p_brand", "equals", "brand#11"), ("p_name", "contains", "E")])
    return a.unionByName(b).unionByName(c).select("p_partkey")


@query("b12_in_and_exists", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') AND trim(c_name) <> ''")
def in_exists(t) -> DataFrame:
    return where_all(t("customer"), [("c_mktsegment", "in", ["Building", "machinery"]), ("c_name", "exists", None)]).select("c_custkey")


@query("b14_matched_fields", "SELECT p_partkey, concat_ws(',', CASE WHEN contains(lower(p_name), 'br') THEN 'p_name' END, CASE WHEN contains(lower(p_brand), 'br') THEN 'p_brand' END, CASE WHEN contains(lower(p_type), 'br') THEN 'p_type' END) AS fields FROM part")
def fields_matched(t) -> DataFrame:
    return t("part").select("p_partkey", F.array_join(R.matched_fields(["p_name", "p_brand", "p_type"], "BR"), ",").alias("fields"))


_ALIASES = [(1, " ", "b", "c"), (2, "a", "", None), (3, None, None, " c "), (4, None, "", " ")]


@query("b15_first_of", "SELECT id, coalesce(CASE WHEN trim(a) <> '' THEN a END, CASE WHEN trim(b) <> '' THEN b END, CASE WHEN trim(c) <> '' THEN c END) AS v FROM " + sql_values(_ALIASES, "id, a, b, c"))
def first_filled(t) -> DataFrame:
    return values(t, _ALIASES, "id int, a string, b string, c string").select("id", R.first_of(["a", "b", "c"]).alias("v"))


@query("b16_combine", "SELECT id, concat_ws(', ', nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), '')) AS v FROM " + sql_values(_ALIASES, "id, a, b, c"))
def combined(t) -> DataFrame:
    return values(t, _ALIASES, "id int, a string, b string, c string").select("id", R.combine(["a", "b", "c"]).alias("v"))


@query("b17_relevant_fields", "SELECT n_nationkey, 'n_name=' || n_name || ',n_regionkey=' || n_regionkey AS fields FROM nation")
def relevant(t) -> DataFrame:
    m = R.relevant_fields(["N_NAME", "n_regionkey", "empty"])
    df = t("nation").withColumn("empty", F.lit("")).withColumnRenamed("n_name", "N_NAME")
    return df.select("n_nationkey", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


@query("b18_union_by_columns", "SELECT n_name AS name, n_regionkey::DOUBLE AS region, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def unioned(t) -> DataFrame:
    return R.union_by_columns([t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("region")), t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@query("b19_display", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 'Yes' ELSE 'No' END AS home FROM nation")
def displayed(t) -> DataFrame:
    return R.display(t("nation").select(F.lit(9).alias("id"), "n_nationkey", "n_name", (F.col("n_regionkey") == 1).alias("home")))


_CELLS = [("MOBILE1", "123456"), ("phone", "12"), ("EMAIL", "a@b.c"), ("email", "none"), ("ADD1", "1 road"), ("full_name", "x"), ("company", "y"), ("city", "z"), ("website", "w"), ("role", "r"), ("other", "o")]


@query("b20_categorize", "SELECT * FROM " + sql_values([("MOBILE1", "phone"), ("phone", None), ("EMAIL", "email"), ("email", None), ("ADD1", "address"), ("full_name", "name"), ("company", "company"), ("city", "location"), ("website", "website"), ("role", "designation"), ("other", None)], "field, category"))
def categorized(t) -> DataFrame:
    return values(t, _CELLS, "field string, value string").select("field", R.categorize(F.col("field"), F.col("value")).alias("category"))


@query("b21_highlight_spans", "SELECT * FROM " + sql_values([(1, "0-5"), (2, "0-2,4-8"), (3, ""), (4, "0-3")], "id, spans"))
def spans(t) -> DataFrame:
    df = values(t, [(1, "ababa"), (2, "AB..xcab"), (3, "none"), (4, "aba")], "id int, v string")
    found = T.highlight_spans(F.col("v"), ["ab", "BA", "xc", "a"])
    return df.select("id", F.array_join(F.transform(found, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("spans"))


@query("b22_highlight", "SELECT p_partkey, regexp_replace(p_name, '(?i)(re)', '**\\1**', 'g') AS p_name FROM part")
def highlighted(t) -> DataFrame:
    return t("part").select("p_partkey", T.highlight(F.col("p_name"), "re").alias("p_name"))


@query("b23_results_grid", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 25")
def grid(t) -> DataFrame:
    """Second page of 25 of the parts that match the text, by size."""
    return t("part").where(R.any_contains([F.col("p_name")], "a")).orderBy(F.col("p_size").desc(), "p_partkey").offset(25).limit(25).select("p_partkey", "p_name")


@query("b24_truncate", "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS shown FROM documents")
def truncated(t) -> DataFrame:
    return t("documents").select("doc_id", T.truncate(F.col("text")).alias("shown"))


@query("b25_chunks", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS BIGINT) AS chunk FROM orders")
def chunked(t) -> DataFrame:
    return R.chunks(t("orders").select("o_orderkey"), ["o_orderkey"], 500)


@query("b25_percentage", "SELECT o_orderstatus, CASE WHEN sum(count(*)) OVER () = 0 THEN 0 ELSE round(100.0 * count(*) / sum(count(*)) OVER (), 1) END::DOUBLE AS share FROM orders GROUP BY o_orderstatus")
def percentages(t) -> DataFrame:
    o = t("orders")
    return o.groupBy("o_orderstatus").count().crossJoin(F.broadcast(o.agg(F.count(F.lit(1)).alias("n")))).select("o_orderstatus", R.percentage(F.col("count"), F.col("n")).alias("share"))
