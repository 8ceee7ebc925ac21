"""Graphs as DataFrames: nodes (id, type, ...) and edges (a, b, ...), undirected ones with a < b."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, opened, written

# Risk weight of each entity type in a cluster; what is not listed, and a weight of nothing, counts .05.
RISK_WEIGHTS = {
    "crypto_address": 0.3, "account_number": 0.2, "pan_number": 0.15, "aadhaar_number": 0.15, "aadhaar_vid": 0.15, "amount": 0.15, "upi_id": 0.15, "phone": 0.1, "email": 0.1, "vehicle_number": 0.1,
    "ip_address": 0.1, "ifsc_code": 0.1, "id_number": 0.1, "name": 0.05, "organization": 0.05, "address": 0.05, "url": 0.05, "social_handle": 0.05, "location": 0.03, "date": 0.02, "pincode": 0.02,
}
# Graph node type of each entity type; anything else is other.
NODE_TYPES = {"name": "person", "phone": "phone", "email": "email", "account_number": "account", "address": "address", "company": "organization", "organization": "organization", "location": "location", "vehicle_number": "vehicle"}
# Keywords between two words that tell how they relate, with the strength of the relation.
RELATION_PATTERNS = (
    ("family", r"(\w+)\s+(?:is\s+)?(?:the\s+)?(?:son|daughter|father|mother|brother|sister|husband|wife|cousin|uncle|aunt)\s+(?:of|to)\s+(\w+)", "strong"),
    ("family", r"(\w+)'s\s+(?:son|daughter|father|mother|brother|sister|husband|wife)", "strong"),
    ("financial", r"(\w+)\s+(?:transferred?|sent|paid)\s+(?:Rs\.?|INR|₹)?\s*[\d,]+\s*(?:to|for)\s+(\w+)", "strong"),
    ("financial", r"(\w+)\s+(?:received?|got)\s+(?:Rs\.?|INR|₹)?\s*[\d,]+\s*(?:from|by)\s+(\w+)", "strong"),
    ("financial", r"transaction\s+(?:from|by)\s+(\w+)\s+(?:to)\s+(\w+)", "strong"),
    ("communication", r"(\w+)\s+(?:called|phoned|contacted|emailed)\s+(\w+)", "moderate"),
    ("communication", r"call\s+(?:between|from)\s+(\w+)\s+(?:and|to)\s+(\w+)", "moderate"),
    ("communication", r"(\w+)\s+(?:and|&)\s+(\w+)\s+(?:exchanged|had)\s+(?:calls?|messages?)", "moderate"),
    ("location", r"(\w+)\s+(?:lives?|resides?|stays?|located)\s+(?:in|at)\s+(\w+)", "moderate"),
    ("location", r"(\w+)'s\s+(?:address|location|residence)\s+(?:is|in)\s+(\w+)", "moderate"),
    ("employment", r"(\w+)\s+(?:works?|employed|working)\s+(?:at|for|in)\s+(\w+)", "moderate"),
    ("employment", r"(\w+)\s+(?:is|was)\s+(?:an?\s+)?(?:employee|staff|worker)\s+(?:at|of)\s+(\w+)", "moderate"),
    ("ownership", r"(\w+)\s+(?:owns?|possesses?|has)\s+(?:a\s+)?(\w+)", "strong"),
    ("ownership", r"(\w+)'s\s+(?:vehicle|car|property|house|account)", "strong"),
)


def case_map(c: Column, mapping: dict, otherwise) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(otherwise)


def node_type(c: Column) -> Column:
    return case_map(c, NODE_TYPES, "other")


def cooccurrence_nodes(mentions: DataFrame) -> DataFrame:
    """mentions (record_id, entity, type, source, priority) -> (id, type, occurrences, sources, risk)."""
    risk = case_map(F.first("priority"), {"HIGH": 0.8, "MEDIUM": 0.5}, 0.2)
    return mentions.groupBy(F.col("entity").alias("id"), "type").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("source").alias("sources"), risk.alias("risk"))


#: Mentions whose pairs one task counts.
TASK_MENTIONS = 500_000


def pair_counts(mentions: DataFrame, different_types: bool = False, ts: str | None = None) -> DataFrame:
    """(a, b, weight): records that name both, each record once. One equi-join on the record and a combining count, in tasks
    whose number follows the mentions', so that none grows with them. Mentions meet where their record is, so the distinct
    and the join need one exchange."""
    tasks = max(int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-mentions.count() // TASK_MENTIONS))
    rows = mentions.select("record_id", "entity", *(["type"] if different_types else []), *([ts] if ts else [])).repartition(tasks, "record_id").distinct()
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(y, (F.col("x.record_id") == F.col("y.record_id")) & (F.col("x.entity") < F.col("y.entity")))
    if different_types:
        pairs = pairs.where(F.col("x.type") != F.col("y.type"))
    pairs = pairs.select(F.col("x.entity").alias("a"), F.col("y.entity").alias("b"), *([F.col(f"x.{ts}").alias(ts)] if ts else [])).repartition(tasks, "a", "b")
    seen = [F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")] if ts else []
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"), *seen)


def record_links(mentions: DataFrame) -> DataFrame:
    """(a, b): every entity with the least one of each of its records. They connect what pair_counts() does, and are no
    more than the mentions."""
    first = mentions.groupBy("record_id").agg(F.min("entity").alias("a"))
    return mentions.select("record_id", F.col("entity").alias("b")).join(first, "record_id").where("a <> b").select("a", "b")


def cooccurrence_edges(mentions: DataFrame) -> DataFrame:
    """Weak, moderate from 2 records (confidence .7), strong from 5 (.85)."""
    w = F.col("weight")
    return pair_counts(mentions).select("a", "b", "weight", F.when(w >= 5, "strong").when(w >= 2, "moderate").otherwise("weak").alias("strength"), F.when(w >= 5, 0.85).when(w >= 2, 0.7).otherwise(0.5).alias("confidence"))


def inferred_edges(mentions: DataFrame, ts: str | None = None) -> DataFrame:
    """Pairs of different types: confidence .5 and .1 per record, .95 at most; moderate from 5, strong from 10."""
    w = F.col("weight")
    out = pair_counts(mentions, True, ts)
    return out.withColumn("confidence", F.least(0.5 + 0.1 * w, F.lit(0.95))).withColumn("strength", F.when(w >= 10, "strong").when(w >= 5, "moderate").otherwise("weak"))


def field_graph(cells: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of typed fields (id, type, count) and edges (a, b, weight, records) with the records as evidence."""
    value = F.lower(F.trim("value"))
    rows = cells.where(F.col("field").isin(list(types)) & (F.length(value) >= 2)).select("record_id", F.concat(case_map(F.col("field"), types, "other"), F.lit(":"), value).alias("entity"), case_map(F.col("field"), types, "other").alias("type"))
    nodes = rows.groupBy(F.col("entity").alias("id"), "type").agg(F.count(F.lit(1)).alias("count"))
    one = rows.select("record_id", "entity").distinct()
    x, y = one.alias("x"), one.alias("y")
    pairs = x.join(y, (F.col("x.record_id") == F.col("y.record_id")) & (F.col("x.entity") < F.col("y.entity")))
    return nodes, pairs.groupBy(F.col("x.entity").alias("a"), F.col("y.entity").alias("b")).agg(F.count(F.lit(1)).alias("weight"), F.sort_array(F.collect_set("x.record_id")).alias("records"))


def text_relations(texts: DataFrame, entities: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, source, target, type, strength, confidence): pattern matches whose ends are both known entities of the document.
    A possessive names one end only, which then stands for both.

    entities (doc, entity). One pass over the text per pattern, in the JVM; then two equi-joins.
    """
    parts = []
    for kind, pattern, strength in RELATION_PATTERNS:
        left, right = (F.regexp_extract_all(text_col, F.lit(f"(?i){pattern}"), F.lit(k)) for k in (1, 2 if pattern.count(r"(\w+)") > 1 else 1))
        parts.append(F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), _relation(kind, strength)))
    rows = texts.select(F.col(id_col).alias("doc"), F.inline(F.concat(*parts)))
    known = entities.select("doc", F.lower("entity").alias("e")).distinct()
    ends = rows.join(known.withColumnRenamed("e", "source"), ["doc", "source"], "left_semi").join(known.withColumnRenamed("e", "target"), ["doc", "target"], "left_semi")
    return ends.select("doc", "source", "target", "type", "strength", F.lit(0.8).alias("confidence"))


def _relation(kind: str, strength: str):
    return lambda p: F.struct(F.lower(p["l"]).alias("source"), F.lower(p["r"]).alias("target"), F.lit(kind).alias("type"), F.lit(strength).alias("strength"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """(seq, id, type, normalized, value, source): one per type and normalised value; aliases and sources are united."""
    return entities.groupBy("type", "normalized").agg(F.min_by("id", "seq").alias("id"), F.sort_array(F.collect_set("value")).alias("aliases"), F.sort_array(F.collect_set("source")).alias("sources"))


def merge_relationships(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seq, source, target, type, confidence): dangling ones go; repeats raise the first confidence by .05 each."""
    ids = nodes.select("id").distinct()
    kept = rels.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    n = F.count(F.lit(1))
    return kept.groupBy("source", "target", "type").agg(n.alias("occurrences"), F.least(F.lit(1.0), F.min_by("confidence", "seq") + 0.05 * (n - 1)).alias("confidence"))


def edge_weight(strength: Column, occurrences: Column) -> Column:
    extra = case_map(strength, {"strong": 0.3, "moderate": 0.2, "weak": 0.1, "inferred": 0.05}, 0.0)
    return F.least(F.lit(1.0), 0.5 + extra + F.least(0.05 * occurrences, F.lit(0.2)))


def both_ways(edges: DataFrame) -> DataFrame:
    one = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return one.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def components(edges: DataFrame, write: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """(id, component): the least id that edges (a, b) reach, for every end of an edge.

    Vertices point to their least neighbour, pointers are followed to the root by doubling, and the graph of roots goes
    on to the next round; each round at least halves the vertices that still have edges. Every step is written down by
    ``write`` so that plans don't grow, and deleted when the next one is there.
    """
    left = write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"))
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        least = left.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).groupBy("a").agg(F.min("b").alias("b"))
        up = write(least.select(F.col("a").alias("id"), F.least("a", "b").alias("up")))
        while True:
            parent = up.select(F.col("id").alias("up"), F.col("up").alias("next"))
            step = write(up.select("id", "up").join(parent, "up").select("id", F.col("next").alias("up"), (F.col("up") != F.col("next")).alias("moved")))
            dropped(up)
            up = step
            if not up.where("moved").limit(1).count():
                break
        rounds.append(up)
        root_a, root_b = up.select(F.col("id").alias("a"), F.col("up").alias("ra")), up.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        roots = left.join(root_a, "a").join(root_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        before, left = left, write(roots)
        dropped(before)
    if not rounds:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = rounds[0].select("id", F.col("up").alias("component"))
    for up in rounds[1:]:
        later = up.select(F.col("id").alias("component"), "up")
        out = out.join(later, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    return out


def clusters(comp: DataFrame, least: int = 3) -> DataFrame:
    """(component, size, label) of components with so many members, numbered in the order of their least ids."""
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    # one row per cluster is ordered, not one per node
    return sizes.withColumn("label", F.concat(F.lit("Cluster "), F.row_number().over(Window.orderBy("component"))))


def cluster_risk(members: DataFrame) -> DataFrame:
    """members (component, type) -> (component, risk): five times the mean weight, 1 at most."""
    return members.groupBy("component").agg(F.least(F.lit(1.0), F.avg(case_map(F.col("type"), RISK_WEIGHTS, 0.05)) * 5).alias("risk"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): edge ends, zero for nodes without."""
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("degree"))


def metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n): counts of nodes and edges by type."""
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "type", "n").unionByName(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def metrics(nodes: DataFrame, edges: DataFrame, comp: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean and largest degree, components (lone nodes are one each)."""
    d = degrees(nodes, edges)
    linked = comp.agg(F.countDistinct("component").alias("c"), F.count(F.lit(1)).alias("members"))
    n, e = F.col("nodes"), F.col("edges")
    row = d.agg(F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("max_degree"), (F.sum("degree") / 2).cast("long").alias("edges")).crossJoin(linked)
    return row.select("nodes", "edges", F.when(n > 1, e / (n * (n - 1) / 2)).otherwise(0.0).alias("density"), F.when(n > 0, 2 * e / n).otherwise(0.0).alias("mean_degree"), "max_degree", (F.col("c") + n - F.col("members")).alias("components"))


def neighbours(edges: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """(id, hops): nodes within so many hops, without the start itself. Edges are read where they are, so that only what
    leaves a frontier is sent."""
    spark = edges.sparkSession
    frontier = seen = spark.createDataFrame([(start, 0)], "id string, hops int")
    few = True
    for hop in range(1, depth + 1):
        frontier = written(_level(frontier, edges, seen.select("id"), few).withColumn("hops", F.lit(hop)))
        few = frontier.count() <= LEVEL
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


#: Nodes of a level that are looked up in a broadcast table; a larger one is joined.
LEVEL = 100_000


def _level_of(nodes: list[str], edges: DataFrame) -> DataFrame:
    return edges.sparkSession.createDataFrame([(x,) for x in nodes], "id string")


def _next(frontier: DataFrame, edges: DataFrame, small: bool) -> DataFrame:
    """(a, b): links out of the frontier (id). edges are read as they are, each from both ends, so that of a large graph
    nothing is sent but what leaves a small frontier."""
    ids = F.broadcast(frontier.select("id")) if small else frontier.select("id")
    ways = edges.where("a <> b").select("a", "b")
    return ways.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").select("a", "b").unionByName(ways.join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("b").alias("a"), F.col("a").alias("b")))


def _level(frontier: DataFrame, edges: DataFrame, seen: DataFrame, small: bool) -> DataFrame:
    """(id) one hop on from the frontier, but for what was seen."""
    near = _next(frontier, edges, small).select(F.col("b").alias("id")).distinct()
    return written(near.join(seen, "id", "left_anti"))


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """(path): the shortest path, of several the first by its ids; no row if there is none.

    Two searches, from the start and from the goal, until they meet; the one whose last round met fewer nodes goes on, so
    neither spreads over the whole graph. Nodes go with them, not paths: those are put together only of nodes that lie on
    a shortest one."""
    spark = edges.sparkSession
    if start == goal:
        return spark.createDataFrame([([start],)], "path array<string>")
    sides = [[_level_of([x], edges)] for x in (start, goal)]
    seen, sizes = [side[0] for side in sides], [1, 1]
    while True:
        k = 0 if sizes[0] <= sizes[1] else 1
        new = _level(sides[k][-1], edges, seen[k], sizes[k] <= LEVEL)
        sizes[k] = new.count()
        if not sizes[k]:
            return spark.createDataFrame([], "path array<string>")
        sides[k].append(new)
        seen[k] = written(seen[k].unionByName(new))
        met = new.join(sides[1 - k][-1], "id", "left_semi")
        if met.limit(1).count():
            break
    # back from where they met, only what leads there
    middle = written(met)
    steps = [middle]

    def before(level: DataFrame, step: DataFrame) -> DataFrame:
        return written(level.join(_next(step, edges, step.count() <= LEVEL).select(F.col("b").alias("id")).distinct(), "id", "left_semi"))

    for level in reversed(sides[0][:-1]):
        steps.insert(0, before(level, steps[0]))
    for level in reversed(sides[1][:-1]):
        steps.append(before(level, steps[-1]))
    paths = steps[0].select("id", F.array("id").alias("path"))
    for k, step in enumerate(steps[1:]):
        # of what leaves a step only what leads to the next one
        links = _next(steps[k], edges, steps[k].count() <= LEVEL).join(step.select(F.col("id").alias("b")), "b", "left_semi")
        on = paths.select(F.col("id").alias("a"), "path").join(links, "a").select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        paths = written(on.join(step, "id", "left_semi").groupBy("id").agg(F.min("path").alias("path")))
    return paths.select("path")


def simple_paths(edges: DataFrame, start: str, goal: str, most: int = 3) -> DataFrame:
    """(path): all paths of up to so many hops that visit no node twice.

    Paths grow from both ends and meet: half of the hops from the start, the rest from the goal. An end grows only to
    nodes from which the other can still be reached in the hops that are left, as a search for distances has told."""
    spark = edges.sparkSession
    if start == goal or most < 1:
        return spark.createDataFrame([], "path array<string>")

    def distances(end: str) -> DataFrame:
        level, size = _level_of([end], edges), 1
        out = level.withColumn("left", F.lit(0))
        for hop in range(1, most):
            level = _level(level, edges, out.select("id"), size <= LEVEL)
            size = level.count()
            out = written(out.unionByName(level.withColumn("left", F.lit(hop))))
        return out

    def leaving(paths: DataFrame) -> DataFrame:
        """(a, b): links out of the ends of paths, each once."""
        ends = written(paths.select("id").distinct())
        return _next(ends, edges, ends.count() <= LEVEL).distinct()

    def grown(begin: str, end: str, hops: int) -> list[DataFrame]:
        """Paths from begin of 0 to ``hops`` hops, without end."""
        away, out = distances(end), [spark.createDataFrame([(begin, [begin])], "id string, path array<string>")]
        for hop in range(1, hops + 1):
            on = out[-1].select(F.col("id").alias("a"), "path").join(leaving(out[-1]), "a").where((F.col("b") != end) & ~F.array_contains("path", F.col("b")))
            on = on.select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
            out.append(written(on.join(away.where(F.col("left") <= most - hop).select("id"), "id", "left_semi")))
        return out

    ahead, back = (most + 1) // 2, most // 2
    first, second = grown(start, goal, ahead - 1), grown(goal, start, back)
    # a path is cut before its hop number ``ahead``, or before its last one if it has fewer
    parts = []
    for x, y in [(first[k], second[0]) for k in range(ahead)] + [(first[ahead - 1], second[j]) for j in range(1, back + 1)]:
        left, right = x.select(F.col("id").alias("a"), F.col("path").alias("p")), y.select(F.col("id").alias("b"), F.col("path").alias("q"))
        # both ends are known, so links are told apart before any is sent
        between = leaving(x).join(y.select(F.col("id").alias("b")).distinct(), "b", "left_semi")
        parts.append(left.join(between, "a").join(right, "b").where(~F.arrays_overlap("p", "q")).select(F.concat("p", F.reverse("q")).alias("path")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def adjacency(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_set("b")).alias("neighbours"))


def cycles(edges: DataFrame, most: int = 4, name: Callable[[Column], Column] | None = None, distinct: bool = False) -> DataFrame:
    """(cycle): cycles of three to ``most`` nodes, each once, from its least node and towards the lesser neighbour. name and
    distinct are those of triangles(), for cycles of three."""
    if most < 4:
        return triangles(edges, name, distinct)
    links = both_ways(edges)
    paths, found = links.where("a < b").select(F.array("a", "b").alias("path")), None
    for size in range(3, most + 1):
        paths = paths.join(links, F.element_at("path", -1) == F.col("a")).where((F.col("b") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"))
        closed = paths.join(links.select(F.col("a").alias("x"), F.col("b").alias("y")), (F.element_at("path", -1) == F.col("x")) & (F.element_at("path", 1) == F.col("y")), "left_semi").where(F.element_at("path", 2) < F.element_at("path", size))
        found = closed if found is None else found.unionByName(closed)
    return found.select(F.col("path").alias("cycle"))


def ranked(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """df with ``name``, 1 for the first row in that order, and so on, as row_number() over all rows would give, without
    one task for all: rows are dealt out by ranges and sorted there, and each range begins where those before it end. Rows
    that the order does not tell apart come in any order, which is written down."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the lower 33 bits count the rows of a range
    rows = written(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before, starts = 0, []
    for r in rows.groupBy("__part").count().orderBy("__part").collect():  # one row per range
        starts.append((r["__part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __before long")
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


#: Links of one block, ways of two steps that a tile goes at least when they are counted and when they are listed, ways
#: that a tile goes per link that it reads, and ways that are looked at together.
TILE_LINKS = 8_000_000
TILE_WAYS = 50_000_000
TILE_LISTED = 25_000_000
TILE_SPAN = 30
TILE_CHUNK = 2_000_000
#: Rows of a batch of listed cycles.
LISTED_ROWS = 100_000


class _Links(NamedTuple):
    """A graph in the shared folder: nodes (id, no, name), numbered from 0 by their neighbours, and links (u, w) by these
    numbers, both ways, in a folder for each block of w, its remainder by ``blocks``."""

    nodes: DataFrame
    near: DataFrame
    count: int
    links: int
    ways: int
    blocks: int


def _numbered(edges: DataFrame, name: Callable[[Column], Column] | None, distinct: bool) -> _Links:
    """edges (a, b), with distinct each once and a < b. What is sent is no more than one row for each link, its node
    numbers are looked up where it is, and the files of every exchange go when its table is there."""
    pairs = edges.where("a <> b").select("a", "b")
    if not distinct:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, clear=True)
    degrees = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree")), clear=True)
    order = ranked(degrees.withColumn("name", F.col("id") if name is None else name(F.col("id"))), "degree", "name", name="no")
    nodes = written(order.select("id", (F.col("no") - 1).cast("int").alias("no"), "name"), clear=True)
    d = F.col("degree")
    # of all neighbours of a node, each two make a way at most
    count, links, ways = (x or 0 for x in degrees.agg(F.count(F.lit(1)), F.sum(d), F.sum(d * (d - 1) / 2).cast("long")).first())
    blocks = max(1, min(count, -(-links // TILE_LINKS)))
    dealt = pairs.mapInArrow(_dealer(nodes._quarry_path, blocks), "u int, w int, block int").sortWithinPartitions("block", "u", "w")
    near = written(dealt, by="block")
    dropped(pairs, degrees)
    return _Links(nodes, near, count, links, ways, blocks)


def _dealer(path: str, blocks: int):
    def deal(batches):
        nodes = opened(path, ["id", "no"])
        ids, nos = nodes.column("id").to_numpy(), nodes.column("no").to_numpy()
        order = np.argsort(ids)
        ids, nos = ids[order], nos[order]
        for batch in batches:
            x, y = (nos[np.searchsorted(ids, batch.column(k).to_numpy(zero_copy_only=False))] for k in (0, 1))
            u, w = np.concatenate((x, y)), np.concatenate((y, x))
            yield pa.record_batch({"u": u, "w": w, "block": w % np.int32(blocks)})

    return deal


def _below(path: str, blocks: int, share: int, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """Links down (v, u) of a share of the nodes v, their remainder by shares, in order. blocks divide shares."""
    table = opened(f"{path}/block={share % blocks}", ["u", "w"])
    u, v = table.column("u").to_numpy(), table.column("w").to_numpy()
    mine = (v % np.int32(shares) == share) & (u < v)
    u, v = u[mine], v[mine]
    order = np.lexsort((u, v))
    return v[order].astype(np.int64), u[order].astype(np.int64)


class _Tile:
    """Ways v - u - w of links down (v, u) in order and of the w of one block, below v or below u, and which v and w are
    linked. A w has its code in its block."""

    def __init__(self, path: str, count: int, blocks: int, block: int, v: np.ndarray, u: np.ndarray, below_u: bool = False):
        table = opened(f"{path}/block={block}", ["u", "w"])
        self.blocks, self.block, self.width = blocks, block, np.int64(count // blocks + 1)
        self.keys = table.column("u").to_numpy().astype(np.int64)
        self.keys *= self.width
        self.keys += table.column("w").to_numpy() // np.int32(blocks)
        del table
        self.keys.sort()
        self.codes = np.empty(len(self.keys), np.int32)
        for k in range(0, len(self.keys), TILE_CHUNK):
            self.codes[k : k + TILE_CHUNK] = self.keys[k : k + TILE_CHUNK] % self.width
        self.starts = np.searchsorted(self.keys, np.arange(count) * self.width)
        self.vs, self.group = np.unique(v, return_inverse=True)
        linked = u % blocks == block
        self.links = self.group[linked] * self.width + u[linked] // blocks
        # lists are in order, so what is below begins each: ends are found for all links down at once
        most = ((u if below_u else v) - block + blocks - 1) // blocks
        self.at, self.length = u, np.searchsorted(self.keys, u * self.width + most) - self.starts[u]
        some = self.length > 0
        self.group, self.at, self.length = self.group[some], self.at[some], self.length[some]

    def ends(self, codes: np.ndarray) -> np.ndarray:
        return codes * self.blocks + self.block

    def chunks(self):
        """Rows of whole nodes v, of about TILE_CHUNK ways; a node of more is alone."""
        if not len(self.group):
            return
        firsts = np.concatenate(([0], np.flatnonzero(np.diff(self.group)) + 1))
        ways = np.cumsum(np.add.reduceat(self.length, firsts))
        cuts = firsts[np.concatenate(([True], np.diff(ways // TILE_CHUNK) > 0))]
        yield from zip(cuts, np.append(cuts[1:], len(self.group)), strict=True)

    def met(self, begin: int, end: int):
        """(rows, codes) of the ways of these rows, about TILE_CHUNK at a time."""
        parts = np.searchsorted(np.cumsum(self.length[begin:end]) // TILE_CHUNK, np.arange(1, int(self.length[begin:end].sum()) // TILE_CHUNK + 1))
        for part in np.split(np.arange(begin, end), parts):
            if len(part):
                length = self.length[part]
                yield np.repeat(part, length), self.codes[np.repeat(self.starts[self.at[part]] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))]

    def are_linked(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.links):
            return np.zeros(len(keys), bool)
        return self.links[np.minimum(np.searchsorted(self.links, keys), len(self.links) - 1)] == keys


def _tile_classes(tile: _Tile) -> pa.RecordBatch:
    """(v, size, cycles, w, first, last): twice the cycles of three, and those of four, from v to all w of the tile."""
    out = [[np.zeros(0, np.int64)] * 6]
    for begin, end in tile.chunks():
        base, groups = tile.group[begin], tile.group[end - 1] - tile.group[begin] + 1
        if groups == 1 or groups * tile.width <= 4 * tile.length[begin:end].sum():
            count = np.zeros(int(groups * tile.width), np.int64)
            for rows, codes in tile.met(begin, end):
                count += np.bincount((tile.group[rows] - base) * tile.width + codes, minlength=len(count))
            key = np.flatnonzero(count)
            k = count[key]
        else:
            key, k = np.unique(np.concatenate([(tile.group[rows] - base) * tile.width + codes for rows, codes in tile.met(begin, end)]), return_counts=True)
        group, code = key // tile.width, key % tile.width
        firsts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
        rows = np.arange(begin, end)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(tile.group[rows])) + 1))
        three = tile.are_linked((group + base) * tile.width + code)
        for size, test, n in ((3, three, k), (4, k > 1, k * (k - 1) // 2)):
            cycles = np.add.reduceat(np.where(test, n, 0), firsts)
            least = np.minimum.reduceat(np.where(test, code, tile.width), firsts)
            # the nodes between are those of v whose lists hold w
            between = tile.at[rows]
            want = between * tile.width + np.repeat(least, np.diff(np.append(starts, len(rows))))
            hit = tile.keys[np.minimum(np.searchsorted(tile.keys, want), len(tile.keys) - 1)] == want
            first, last = np.minimum.reduceat(np.where(hit, between, np.iinfo(np.int64).max), starts), np.maximum.reduceat(np.where(hit, between, -1), starts)
            have = cycles > 0
            out.append((tile.vs[group[firsts] + base][have], np.full(int(have.sum()), size), cycles[have], tile.ends(least)[have], first[have], last[have]))
    return pa.record_batch(dict(zip(("v", "size", "cycles", "w", "first", "last"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def triangles(edges: DataFrame, name: Callable[[Column], Column] | None = None, distinct: bool = False) -> DataFrame:
    """(cycle): every cycle of three, by names, from its least node on. Only links down are sent, each to the task that
    lists what it closes; the other links are read where they are, a block at a time, and the list goes to no other task."""
    g = _numbered(edges, name or (lambda c: c.cast("string")), distinct)
    spark, path, count, blocks = edges.sparkSession, g.near._quarry_path, g.count, g.blocks
    shares = max(1, -(-g.ways // max(TILE_LISTED, TILE_SPAN * g.links)))
    tiles = spark.range(shares * blocks).select((F.col("id") % shares).cast("int").alias("share"), F.floor(F.col("id") / shares).cast("int").alias("block"))
    down = g.near.where("w < u").select((F.col("u") % shares).cast("int").alias("share"), F.col("u").alias("v"), F.col("w").alias("u"))

    def dealt(links: pa.Table, tiles: pa.Table) -> pa.Table:
        links = links.select(["v", "u"]).sort_by([("v", "ascending"), ("u", "ascending")])
        packed = np.stack([links.column(k).to_numpy() for k in ("v", "u")]).tobytes()
        return pa.table({"links": pa.array([packed] if links.num_rows and tiles.num_rows else [], "binary")})

    def listed(batches):
        nodes = opened(g_nodes, ["no", "name"]).sort_by("name")
        names = nodes.column("name").combine_chunks()
        place = np.empty(count, np.int64)
        place[nodes.column("no").to_numpy()] = np.arange(count)
        for batch in batches:
            for packed in batch.column(0):
                v, u = np.frombuffer(packed.as_buffer(), np.int32).astype(np.int64).reshape(2, -1)
                for block in range(blocks):
                    tile = _Tile(path, count, blocks, block, v, u, below_u=True)
                    for begin, end in tile.chunks():
                        for rows, codes in tile.met(begin, end):
                            hit = tile.are_linked(tile.group[rows] * tile.width + codes)
                            rows, codes = rows[hit], codes[hit]
                            three = np.sort(place[np.stack((tile.vs[tile.group[rows]], tile.at[rows], tile.ends(codes)), 1)], 1)
                            for part in np.array_split(three, -(-len(three) // LISTED_ROWS)) if len(three) else []:
                                offsets = pa.array(np.arange(0, 3 * len(part) + 1, 3, np.int32))
                                yield pa.record_batch({"cycle": pa.ListArray.from_arrays(offsets, names.take(pa.array(part.ravel())))})

    g_nodes = g.nodes._quarry_path
    found = down.groupBy("share").cogroup(tiles.groupBy("share")).applyInArrow(dealt, "links binary")
    return found.mapInArrow(listed, "cycle array<string>")


def cycle_classes(edges: DataFrame, name: Callable[[Column], Column] | None = None, distinct: bool = False) -> DataFrame:
    """(hub, size, cycles, example): how many cycles of three and of four nodes have this node as their hub, the one of
    most neighbours (the last by name if several have as many), and one of them, by names. Cycles are counted, not listed,
    so the result grows with the nodes. name gives the name of an id, which else is its own; distinct says that each link
    is there once, with a < b.

    Nodes are numbered by their neighbours. From a hub v one step down to u and one further to w, both below v: of k such
    ways from v to w each two make a cycle of four, and if v and w are linked each one makes a cycle of three, which is
    met from both ends. A node is passed only from nodes of more neighbours, so a very large hub is passed by few. A tile
    has a share of the v and a block of the w, and all ways between them; it reads its links from the shared folder, so
    neither links nor ways are sent, and what is on disk doesn't grow with the number of tiles.
    """
    g = _numbered(edges, name, distinct)
    spark, path, count, blocks = edges.sparkSession, g.near._quarry_path, g.count, g.blocks
    shares = blocks * max(1, -(-g.ways // (blocks * blocks * max(TILE_WAYS, TILE_SPAN * min(g.links, TILE_LINKS)))))

    def counted(batches):
        for batch in batches:
            for tile in batch.column(0).to_pylist():
                v, u = _below(path, blocks, tile % shares, shares)
                if len(v):
                    yield _tile_classes(_Tile(path, count, blocks, tile // shares, v, u))

    tiles = spark.range(0, shares * blocks if g.links else 0, 1, shares * blocks)
    found = tiles.mapInArrow(counted, "v long, size long, cycles long, w long, first long, last long")
    sums = found.groupBy("v", "size").agg(F.sum("cycles").alias("n"), F.min(F.struct("w", "first", "last")).alias("e"))
    sums = written(sums, clear=True)
    dropped(g.near)
    example = F.when(F.col("size") == 3, F.array("v", "e.first", "e.w")).otherwise(F.array("v", "e.first", "e.w", "e.last"))
    named = sums.select("v", F.col("size").cast("int").alias("size"), F.expr("n div if(size = 3, 2, 1)").alias("cycles"), F.posexplode(example).alias("at", "no")).join(g.nodes.select("no", "name"), "no")
    out = named.groupBy("v", "size", "cycles").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("path"))
    return out.select(F.col("path")[0]["name"].alias("hub"), "size", "cycles", F.transform("path", lambda p: p["name"]).alias("example"))


def star_clusters(edges: DataFrame, least: int = 2) -> DataFrame:
    """Components over the edges of that weight or more: the same members whatever the order of the nodes."""
    return components(edges.where(F.col("weight") >= least))


def chains(records: DataFrame, keys: dict[str, tuple[Column, float]], order: str) -> DataFrame:
    """(source, target, type, strength): consecutive records, in the order of discovery, that share a key."""
    parts = None
    for kind, (key, strength) in keys.items():
        w = Window.partitionBy("key").orderBy(order, "record_id")
        rows = records.select("record_id", order, key.alias("key")).where("key is not null and key <> ''")
        rows = rows.select(F.col("record_id").alias("source"), F.lead("record_id").over(w).alias("target"), F.lit(kind).alias("type"), F.lit(strength).alias("strength")).where("target is not null")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


#: Links of a node that meet in one cell when two hops over it are followed.
HUB = 10_000


def closure(rels: DataFrame, least: float = 0.6, factor: float = 0.7) -> DataFrame:
    """rels (a, b, strength) with a < b -> with suspected links added: two hops whose weaker half has ``least`` give
    ``factor`` of it, where nothing links the two yet; whole rounds until none is new.

    A round extends the links of the last one only: two hops over older links were followed before. Links below ``least``
    are not followed. Two hops over a node of more than HUB links are followed in cells of as many links each.
    """
    best = written(rels.groupBy("a", "b").agg(F.max("strength").alias("strength")).withColumn("inferred", F.lit(False)))
    last = best
    ways = lambda df: df.where(F.col("strength") >= least).select(F.inline(F.array(F.struct("a", "b", "strength"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "strength"))))
    while True:
        every = ways(best).select(F.col("a").alias("via"), F.col("b").alias("end"), "strength")
        hubs = every.groupBy("via").count().where(F.col("count") > HUB).select("via", F.ceil(F.col("count") / HUB).cast("int").alias("cells"))
        cells = F.coalesce("cells", F.lit(1))
        x = ways(last).select(F.col("b").alias("via"), F.col("a").alias("begin"), F.col("strength").alias("s")).join(hubs, "via", "left")
        x = x.withColumn("row", F.pmod(F.xxhash64("begin"), cells)).withColumn("column", F.explode(F.sequence(F.lit(0), cells - 1))).drop("cells")
        y = every.join(hubs, "via", "left").withColumn("column", F.pmod(F.xxhash64("end"), cells).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), cells.cast("long") - 1))).drop("cells")
        hops = x.join(y, ["via", "row", "column"]).where("begin <> end")
        new = hops.groupBy(F.least("begin", "end").alias("a"), F.greatest("begin", "end").alias("b")).agg((F.max(F.least("s", "strength")) * factor).alias("strength"))
        new = written(new.join(best, ["a", "b"], "left_anti").withColumn("inferred", F.lit(True)))
        if not new.limit(1).count():
            return best
        last, best = new, written(best.unionByName(new))


def entity_clusters(entities: DataFrame, rels: DataFrame, comp: DataFrame) -> DataFrame:
    """(component, size, cluster_type, strength, name, summary) of linked entities, large ones first."""
    members = comp.join(entities, "id")
    kinds = F.collect_set("type")
    only = F.when(F.size(kinds) == 1, case_map(F.element_at(kinds, 1), {"person": "person_network", "company": "company_network", "address": "address_group"}, "mixed")).otherwise("mixed")
    names = F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda s: s["name"])
    described = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), only.alias("cluster_type"), F.when(F.count(F.lit(1)) <= 3, F.array_join(names, " - ")).otherwise(F.concat(F.element_at(names, 1), F.lit(" Network ("), F.count(F.lit(1)), F.lit(" entities)"))).alias("name"))
    counts = members.groupBy("component", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.sort_array(F.collect_list(F.struct("type", "n"))).alias("k"))
    counts = counts.select("component", F.concat(F.lit("Cluster contains "), F.array_join(F.transform("k", lambda s: F.concat(s["n"].cast("string"), F.lit(" "), s["type"], F.when(s["n"] > 1, "s").otherwise(""))), ", "), F.lit(" with shared connections")).alias("summary"))
    inner = rels.join(comp.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(F.avg("strength").alias("strength"))
    return described.where("size > 1").join(counts, "component").join(inner, "component", "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))


def circular_layout(nodes: DataFrame, radius: float = 1.0) -> DataFrame:
    """(id, x, y) on a circle, in the order of the ids; for drawings, so of few nodes."""
    w = Window.orderBy("id")
    angle = 2 * math.pi * (F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy())
    return nodes.select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))
