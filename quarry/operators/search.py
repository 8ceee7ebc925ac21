"""Criteria search over records of any tables: match, score, rank, deduplicate, expand."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, digits
from ..sources.shared import written

# Weight, priority and selectivity of each kind of criterion.
WEIGHTS = {"phone": 9, "email": 9, "id_number": 9, "account": 8, "name": 10, "company": 7, "date": 5, "amount": 5, "location": 6, "keyword": 3}
PRIORITIES = {"phone": "P1", "email": "P1", "id_number": "P1", "account": "P2", "name": "P3", "company": "P3", "date": "P4", "amount": "P4", "location": "P4", "keyword": "P4"}
SELECTIVITY = {"phone": 0.95, "email": 0.95, "id_number": 0.98, "account": 0.90, "name": 0.60, "company": 0.55, "date": 0.40, "amount": 0.35, "location": 0.10, "keyword": 0.30}
MULTIPLIERS = {"P1": 3.0, "P2": 2.5, "P3": 2.0, "P4": 1.5, "P5": 1.0}


@dataclass(frozen=True)
class Criterion:
    id: str
    type: str
    term: str
    priority: str = ""
    importance: float = 0.0

    @property
    def rank(self) -> str:
        return self.priority or PRIORITIES[self.type]

    @property
    def weight(self) -> float:
        return self.importance or float(WEIGHTS[self.type])


def match(recs: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """Adds matched_criteria and match_count and keeps records with a match. One pass, no shuffle: criteria are few and
    become part of the expression; P5 criteria are too common to be searched for."""
    used = [c for c in criteria if c.rank != "P5"]
    hits = F.array(*(F.when(F.coalesce(F.exists("cells", _contains(c.term)), F.lit(False)), F.lit(c.id)) for c in used))
    return recs.withColumn("matched_criteria", F.filter(hits, lambda x: x.isNotNull())).withColumn("match_count", F.size("matched_criteria")).where("match_count > 0")


def _contains(term: str):
    low = term.lower()
    return lambda x: F.contains(F.lower(x["value"]), F.lit(low))


def _sum_over(criteria: list[Criterion], worth) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.array_contains("matched_criteria", c.id), F.lit(float(worth(c)))).otherwise(F.lit(0.0)) for c in criteria])


def cross_reference(matched: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """Weight times the priority's multiplier, summed; several matches raise it by 30 % each. Exact: all searched criteria."""
    used = [c for c in criteria if c.rank != "P5"]
    score = _sum_over(used, lambda c: c.weight * MULTIPLIERS[c.rank])
    bonus = F.when(F.col("match_count") > 1, 1 + 0.3 * F.col("match_count")).otherwise(F.lit(1.0))
    return matched.withColumn("score", score * bonus).withColumn("is_exact", F.col("match_count") == len(used))


def cross_reference_plain(matched: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """Weights summed without multipliers; several matches raise the sum by half each."""
    bonus = F.when(F.col("match_count") > 1, 1 + 0.5 * F.col("match_count")).otherwise(F.lit(1.0))
    return matched.withColumn("score", _sum_over(criteria, lambda c: c.weight) * bonus).withColumn("is_exact", F.col("match_count") == len(criteria))


def relevance(matched: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """Importance of the matched criteria, summed."""
    return matched.withColumn("score", _sum_over(criteria, lambda c: c.weight))


def compiled_score(matched: DataFrame) -> DataFrame:
    """10 for the first query that finds a record and 3 for each further one."""
    return matched.withColumn("score", 10.0 + 3.0 * (F.col("match_count") - 1))


def top(results: DataFrame, k: int, exact_first: bool = True) -> DataFrame:
    """Best k with explicit ties, by a top-k per task and one merge."""
    order = ([F.col("is_exact").desc()] if exact_first else []) + [F.col("score").desc(), F.col("table_name"), F.col("record_id")]
    return results.orderBy(*order).limit(k)


def strategy(criteria: list[Criterion]) -> str:
    return "intersection" if len([c for c in criteria if c.rank != "P5"]) >= 2 else "union"


def merge_hits(hits: DataFrame) -> DataFrame:
    """(table_name, record_id, criterion) rows of many searches -> one row per record with its distinct criteria."""
    return hits.groupBy("table_name", "record_id").agg(F.sort_array(F.collect_set("criterion")).alias("matched_criteria")).withColumn("match_count", F.size("matched_criteria"))


def record_hash(json: Column) -> Column:
    return F.xxhash64(json)


def stop_early(results: DataFrame, enough: int = 3) -> bool:
    """Whether so many records have two matches of the two highest priorities; asked between batches of criteria."""
    return results.where("strong_matches >= 2").limit(enough).count() >= enough


def entity_score(matched_exact: Column, matched_part: Column, priority: Column, confidence: Column) -> Column:
    """0.5, 0.3 per field that equals and 0.1 per field that contains the value, a priority bonus; times the confidence, 1 at most."""
    bonus = F.when(priority == "HIGH", 0.2).when(priority == "MEDIUM", 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), (F.lit(0.5) + 0.3 * matched_exact + 0.1 * matched_part + bonus) * confidence)


def lookup_typed(cells: DataFrame, mapping: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """Typed lookup. cells (table_name, record_id, field, value); mapping (table_name, field, type); entities (type,
    entity, priority, confidence). Per entity and table at most ``limit`` records, in the order of their ids."""
    typed = cells.join(F.broadcast(mapping), ["table_name", "field"])
    hits = typed.join(F.broadcast(entities), (typed["type"] == entities["type"]) & F.contains(F.lower(typed["value"]), F.lower(entities["entity"]))).drop(entities["type"])
    exact = (F.col("value") == F.col("entity")).cast("int")
    rows = hits.groupBy("entity", "table_name", "record_id").agg(F.sum(exact).alias("n_exact"), F.sum(1 - exact).alias("n_part"), F.first("priority").alias("priority"), F.first("confidence").alias("confidence"))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("entity", "table_name").orderBy("record_id"))).where(F.col("__r") <= limit)
    return rows.select("entity", "table_name", "record_id", entity_score(F.col("n_exact"), F.col("n_part"), F.col("priority"), F.col("confidence")).alias("score"))


def strategy_score(recs: DataFrame, query: str, terms: list[str], filters: list[tuple[str, str, str]], targets: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Score of a record from several views of the question; records with none go. Blank cells give nothing.

    10 per cell that contains the query or is contained in it, 3 per cell and term of three characters or more, 15 per
    filter (field, operator, value) that holds, 5 per target type with a filled field, 5 per key field that has a term.
    """
    q = query.lower()
    filled = F.filter("cells", lambda x: blank_to_null(x["value"]).isNotNull())
    low = F.transform(filled, lambda x: F.lower(x["value"]))
    score = 10 * F.size(F.filter(low, lambda v: F.contains(v, F.lit(q)) | F.contains(F.lit(q), v)))
    for term in terms:
        if len(term) > 2:
            score = score + 3 * F.size(F.filter(low, _text_contains(term.lower())))
    for field, operator, value in filters:
        score = score + 15 * F.coalesce(F.exists(filled, _holds(field, operator, value)), F.lit(False)).cast("int")
    for fields in targets.values():
        score = score + 5 * F.exists(filled, _named(fields)).cast("int")
    for key in keys:
        score = score + 5 * F.exists(filled, _key_hit(key, [t.lower() for t in terms])).cast("int")
    return recs.withColumn("score", score.cast("double")).where("score > 0")


def _text_contains(term: str):
    return lambda v: F.contains(v, F.lit(term))


def _named(fields: list[str]):
    return lambda x: x["field"].isin(fields)


def _key_hit(key: str, terms: list[str]):
    return lambda x: (x["field"] == key) & reduce(lambda a, b: a | b, [F.contains(F.lower(x["value"]), F.lit(t)) for t in terms], F.lit(False))


def _holds(field: str, operator: str, value: str):
    def test(x: Column) -> Column:
        v, number = F.lower(x["value"]), x["value"].try_cast("double")
        tests = {"equals": lambda: v == value.lower(), "contains": lambda: F.contains(v, F.lit(value.lower())), "greaterThan": lambda: number > float(value), "lessThan": lambda: number < float(value)}
        return (x["field"] == field) & F.coalesce(tests[operator](), F.lit(False))

    return test


def first_by_json(results: DataFrame, width: int = 100) -> DataFrame:
    """One record per table and first characters of its JSON: the one with the least id."""
    w = Window.partitionBy("table_name", F.substring("record_json", 1, width)).orderBy("record_id")
    return results.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def first_by(results: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return results.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def merged_entities(cells: DataFrame, fields: list[str]) -> DataFrame:
    """Values of identifier fields that appear more than once: (entity, strength)."""
    value = F.lower(F.trim("value"))
    return cells.where(F.col("field").isin(fields) & (F.length(value) > 0)).groupBy(value.alias("entity")).agg(F.count(F.lit(1)).alias("strength")).where("strength > 1")


def boost(results: DataFrame, cells: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """Adds twice the strength of the entities that a record holds; best k."""
    hit = cells.select("table_name", "record_id", F.lower(F.trim("value")).alias("entity")).distinct().join(entities, "entity").groupBy("table_name", "record_id").agg(F.sum("strength").alias("extra"))
    scored = results.join(hit, ["table_name", "record_id"], "left").withColumn("score", F.col("score") + 2 * F.coalesce("extra", F.lit(0))).drop("extra")
    return scored.orderBy(F.col("score").desc(), "table_name", "record_id").limit(k)


def confidence(results: DataFrame) -> DataFrame:
    """One row: 0.6 of the mean score against 20 and 0.4 of the count against 10; 0 for nothing."""
    mean, n = F.avg("score"), F.count(F.lit(1))
    return results.agg(F.when(n == 0, F.lit(0.0)).otherwise(0.6 * F.least(mean / 20, F.lit(1.0)) + 0.4 * F.least(n / 10, F.lit(1.0))).alias("confidence"))


def signature(phone: Column, email: Column, ids: dict[str, Column], json: Column) -> Column:
    """Who a record is about: last ten digits, e-mail and identity numbers; without any of them how its JSON begins."""
    parts = [F.when(blank_to_null(phone).isNotNull(), F.concat(F.lit("phone:"), F.substring(digits(phone), -10, 10))), F.when(blank_to_null(email).isNotNull(), F.concat(F.lit("email:"), F.lower(email)))]
    parts += [F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(f"{k}:"), c.cast("string"))) for k, c in ids.items()]
    known = F.concat_ws("|", *parts)
    return F.when(known == "", F.concat(F.lit("hash:"), F.substring(json, 1, 100))).otherwise(known)


def connections(cells: DataFrame, kinds: dict[str, list[str]], k: int = 30) -> DataFrame:
    """Entities of name, phone, e-mail and location fields with where they occur: (type, entity, strength, tables), best k."""
    out = None
    for kind, fields in kinds.items():
        value = digits(F.col("value")) if kind == "phone" else F.lower(F.trim("value"))
        rows = cells.where(F.col("field").isin(fields)).select(F.lit(kind).alias("type"), value.alias("entity"), "table_name", "record_id")
        rows = rows.where(F.length("entity") == 10) if kind == "phone" else rows.where((F.length("entity") > 2) & (F.length("entity") < 100))
        out = rows if out is None else out.unionByName(rows)
    found = out.groupBy("type", "entity").agg(F.count(F.lit(1)).alias("strength"), F.array_join(F.sort_array(F.collect_set("table_name")), ",").alias("tables"))
    return found.orderBy(F.col("strength").desc(), "type", "entity").limit(k)


def merge_connections(a: DataFrame, b: DataFrame, k: int = 30) -> DataFrame:
    both = a.select("type", "entity", F.col("strength").alias("s1")).join(b.select("type", "entity", F.col("strength").alias("s2")), ["type", "entity"], "full")
    return both.select("type", "entity", F.greatest("s1", "s2").alias("strength")).orderBy(F.col("strength").desc(), "type", "entity").limit(k)


def breakdown(matched: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """(criterion, matches), zeros too."""
    n = [F.sum(F.array_contains("matched_criteria", c.id).cast("long")).alias(c.id) for c in criteria]
    counts = matched.agg(*n)
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c.id).alias("criterion"), F.coalesce(F.col(c.id), F.lit(0)).cast("long").alias("matches")) for c in criteria))))


def summary(results: DataFrame) -> DataFrame:
    """One row: exact and partial counts and a sentence."""
    exact, n = F.count_if(F.col("is_exact")), F.count(F.lit(1))
    return results.agg(n.alias("total"), exact.alias("exact"), (n - exact).alias("partial"), F.format_string("Found %d records: %d exact, %d partial", n, exact, n - exact).alias("summary"))


def primary_subject(recs: DataFrame, entities: list[tuple[str, str, float]]) -> DataFrame:
    """The record that holds most of what was asked: confidence, twice for phone and e-mail, and 1 per part of a name."""
    score, low = F.lit(0.0), F.lower("record_json")
    for kind, value, sure in entities:
        score = score + F.when(F.contains(low, F.lit(value.lower())), F.lit(float(sure) * (2 if kind in ("phone", "email") else 1))).otherwise(0.0)
        if kind == "name":
            for part in value.lower().split():
                score = score + F.when(F.contains(low, F.lit(part)), 1.0).otherwise(0.0)
    return recs.withColumn("score", score).orderBy(F.col("score").desc(), "table_name", "record_id").limit(1)


def per_table(results: DataFrame, k: int | None = None) -> DataFrame:
    """Counts by table, or the best k records of each."""
    if k is None:
        return results.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("table_name").orderBy(F.col("score").desc(), "record_id")
    return results.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def expand(mentions: DataFrame, seeds: DataFrame, rounds: int = 5, per_round: int | None = None, most: int | None = None, order: list[str] | None = None, progress: Callable[[dict], None] | None = None) -> DataFrame:
    """Iterative lead expansion: (entity, hop), seeds at hop 0.

    mentions (record_id, entity): which entities a record names. Each round takes the records that name an entity of the
    last round and all new entities in them: two equi-joins and an anti-join on what has been seen. per_round keeps the
    first new entities in the given order; most ends the search when so many are known. Rounds are written down, so the
    plan doesn't grow. ``progress`` is told {"round", "new", "known"} after each round.
    """
    seen = written(seeds.select("entity").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, rounds + 1):
        records = mentions.join(frontier.select("entity"), "entity", "left_semi").select("record_id").distinct()
        new = mentions.join(records, "record_id", "left_semi").select("entity").distinct().join(seen.select("entity"), "entity", "left_anti")
        if per_round:
            new = new.orderBy(*(order or ["entity"])).limit(per_round)
        frontier = written(new.withColumn("hop", F.lit(hop)))
        if not frontier.limit(1).count():
            break
        seen = written(seen.unionByName(frontier))
        known = seen.count() if most or progress else 0
        if progress:
            progress({"round": hop, "new": frontier.count(), "known": known})
        if most and known >= most:
            break
    return seen
