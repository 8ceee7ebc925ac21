"""Patterns, anomalies, risk, timelines and insights over graphs and entities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import predicate
from ..functions.text import last_ten, normalize_string
from .graph import both_ways, case_map, degrees

# Types that an edge of each source type may lead to.
ALLOWED = {
    "person": ("phone", "email", "address", "account", "organization", "location"), "phone": ("person", "account", "location"), "email": ("person", "account", "organization"),
    "account": ("person", "organization", "amount", "account"), "organization": ("person", "address", "account", "phone"),
}
# Weight of each risk factor.
FACTORS = {"high_value": 0.30, "frequent": 0.20, "cross_border": 0.25, "multiple_accounts": 0.15, "unusual": 0.10}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


@dataclass(frozen=True)
class Rule:
    """A named rule of (field, operator, value) conditions, all of which must hold; operators as in CONDITIONS."""

    name: str
    conditions: tuple[tuple[str, str, object], ...]
    action: str = "flag"
    severity: str = "medium"


# The conditions of a rule, and the filter that each is.
CONDITIONS = {"equals": "equals", "contains": "contains", "greaterThan": "greater_than", "lessThan": "less_than", "matches": "regex", "exists": "exists"}


def apply_rules(df: DataFrame, rules: list[Rule], id_col: str) -> DataFrame:
    """(id, rule, action, severity) of the rules that hold for a record, in one pass. A record that a rule with the action
    ignore holds for gives nothing."""
    holds = lambda r: reduce(lambda a, b: a & b, [predicate(F.col(f), CONDITIONS[o], v) for f, o, v in r.conditions], F.lit(True))
    ignored = reduce(lambda a, b: a | b, [holds(r) for r in rules if r.action == "ignore"], F.lit(False))
    told = [F.when(holds(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.severity).alias("severity"))) for r in rules if r.action != "ignore"]
    if not told:
        return df.select(F.col(id_col).alias("id"), *(F.lit("").alias(c) for c in ("rule", "action", "severity"))).limit(0)
    return df.where(~ignored).select(F.col(id_col).alias("id"), F.inline(F.filter(F.array(*told), lambda x: x.isNotNull())))


def severity_rank(c: Column) -> Column:
    return case_map(c, SEVERITY_RANK, 4)


def frequent_nodes(degree: DataFrame, least: int = 5, gate: float = 0.7) -> DataFrame:
    """Degree above 10; significance a fiftieth of it; what is left has a degree of 35 or more."""
    s = F.least(F.col("degree") / 50, F.lit(1.0))
    return degree.where((F.col("degree") > 10) & (F.col("degree") >= least)).select("id", F.col("degree").alias("frequency"), s.alias("significance")).where(F.col("significance") >= gate)


def money_circles(edges: DataFrame) -> DataFrame:
    """(cycle, significance) of financial edges source -> target: two nodes .9, three .95, each cycle once."""
    f = edges.where("type = 'financial'").select("source", "target").where("source <> target").distinct()
    x, y, z = f.alias("x"), f.alias("y"), f.alias("z")
    two = x.join(y, (F.col("x.target") == F.col("y.source")) & (F.col("y.target") == F.col("x.source"))).where("x.source < x.target").select(F.concat_ws(">", "x.source", "x.target").alias("cycle"), F.lit(0.9).alias("significance"))
    three = x.join(y, F.col("x.target") == F.col("y.source")).join(z, (F.col("y.target") == F.col("z.source")) & (F.col("z.target") == F.col("x.source")))
    three = three.where("x.source < y.source and x.source < z.source and y.source <> z.source").select(F.concat_ws(">", "x.source", "y.source", "z.source").alias("cycle"), F.lit(0.95).alias("significance"))
    return two.unionByName(three)


def daily_spikes(edges: DataFrame, ts: str, factor: float = 2.0, least: int = 3, gate: float = 0.6) -> DataFrame:
    """(day, n, significance) of days with more than twice the mean: n over three means."""
    days = edges.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    mean = F.avg("n").over(Window.partitionBy())  # one row per day
    return days.withColumn("mean", mean).where(F.col("n") > factor * F.col("mean")).select("day", "n", (F.col("n") / (3 * F.col("mean"))).alias("significance")).where((F.col("n") >= least) & (F.col("significance") >= gate))


def location_clusters(nodes: DataFrame, edges: DataFrame, least: int = 3, gate: float = 0.5) -> DataFrame:
    places = nodes.where("type = 'location'").select(F.col("id").alias("target"))
    found = edges.where("type = 'location'").join(places, "target", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("frequency"))
    return found.withColumn("significance", F.col("frequency") / 10).where((F.col("frequency") >= least) & (F.col("significance") >= gate))


def gate_patterns(patterns: DataFrame, least: int, gate: float) -> DataFrame:
    return patterns.where((F.col("frequency") >= least) & (F.col("significance") >= gate)).orderBy(F.col("significance").desc(), "id")


def outliers(degree: DataFrame, threshold: float = 2.5) -> DataFrame:
    """(id, z) with |z| above the threshold; the population's deviation, z of 0 where it is 0. One small aggregate is
    joined back, so nothing is windowed over all rows."""
    stats = degree.agg(F.avg("degree").alias("m"), F.stddev_pop("degree").alias("s"))
    z = F.when(F.col("s") == 0, 0.0).otherwise((F.col("degree") - F.col("m")) / F.col("s"))
    return degree.crossJoin(F.broadcast(stats)).select("id", z.alias("z")).where(F.abs("z") > threshold)


def type_mismatches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to a type that the source's type may not lead to; from other types every edge."""
    pairs = [F.struct(F.lit(a).alias("s"), F.lit(b).alias("t")) for a, bs in ALLOWED.items() for b in bs]
    kinds = nodes.select("id", "type")
    typed = edges.join(kinds.select(F.col("id").alias("source"), F.col("type").alias("s")), "source").join(kinds.select(F.col("id").alias("target"), F.col("type").alias("t")), "target")
    return typed.where(~F.array_contains(F.array(*pairs), F.struct("s", "t"))).select("source", "target", F.col("s").alias("source_type"), F.col("t").alias("target_type"), F.lit(0.85).alias("score"))


def hidden_hubs(nodes: DataFrame, edges: DataFrame, least: float = 0.0) -> DataFrame:
    """More than five distinct neighbours of three types or more; score a fifth of the types."""
    kinds = nodes.select(F.col("id").alias("b"), "type")
    found = both_ways(edges).join(kinds, "b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"), F.countDistinct("type").alias("types"))
    return found.where("neighbours > 5 and types >= 3").withColumn("score", F.col("types") / 5).where(F.col("score") >= least)


def risk_factors(nodes: DataFrame, edges: DataFrame, skip_isolated: bool = True) -> DataFrame:
    """(id, high_value, frequent, cross_border, multiple_accounts, unusual), each 0 to 1, of edges (source, target, type)."""
    kinds = nodes.select("id", F.col("type").alias("kind"))
    out_ = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), F.col("type").alias("etype"), F.lit(0).alias("incoming"))
    in_ = edges.select(F.col("target").alias("id"), F.col("source").alias("other"), F.col("type").alias("etype"), F.lit(1).alias("incoming"))
    ends = out_.unionByName(in_).join(kinds.select(F.col("id").alias("other"), F.col("kind").alias("other_kind")), "other", "left")
    stats = ends.groupBy("id").agg(
        F.count_if(F.col("etype") == "financial").alias("fin"), F.count(F.lit(1)).alias("deg"), F.countDistinct(F.when(F.col("other_kind") == "location", F.col("other"))).alias("loc"),
        F.count_if((F.col("other_kind") == "account") & (F.col("incoming") == 1)).alias("acc"), F.sum("incoming").alias("i"), F.sum(1 - F.col("incoming")).alias("o"),
    )
    s = kinds.join(stats, "id", "inner" if skip_isolated else "left").na.fill(0)
    ratio = F.when(F.col("o") == 0, F.col("i").cast("double")).otherwise(F.col("i") / F.when(F.col("o") == 0, 1).otherwise(F.col("o")))
    unusual = F.when(ratio == 0, 1.0).when((ratio > 5) | (ratio < 0.2), F.least(F.abs(F.log10(ratio)) / 2, F.lit(1.0))).otherwise(0.0)
    return s.select(
        "id", F.least(F.col("fin") / 10, F.lit(1.0)).alias("high_value"), F.least(F.col("deg") / 50, F.lit(1.0)).alias("frequent"), F.when(F.col("loc") > 1, F.least(F.col("loc") / 5, F.lit(1.0))).otherwise(0.0).alias("cross_border"),
        F.when(F.col("acc") > 2, F.least(F.col("acc") / 5, F.lit(1.0))).otherwise(0.0).alias("multiple_accounts"), unusual.alias("unusual"),
    )


def risk_indicators(factors: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, risk, severity): weighted mean of the factors above ``least``; nodes with none go."""
    top = reduce(lambda a, b: a + b, [F.when(F.col(f) > least, F.col(f) * w).otherwise(0.0) for f, w in FACTORS.items()])
    weight = reduce(lambda a, b: a + b, [F.when(F.col(f) > least, F.lit(w)).otherwise(0.0) for f, w in FACTORS.items()])
    scored = factors.withColumn("w", weight).where("w > 0").select("id", F.round(top / F.col("w"), 12).alias("risk"))
    return scored.withColumn("severity", F.when(F.col("risk") >= 0.8, "critical").when(F.col("risk") >= 0.6, "high").when(F.col("risk") >= 0.4, "medium").otherwise("low"))


def node_timeline(nodes: DataFrame, edges: DataFrame, degree: DataFrame, ts: str) -> DataFrame:
    """(ts, kind, id, importance): nodes .8 if they have more than five edges, else .5; edges their confidence."""
    n = nodes.join(degree, "id").select(F.col(ts).alias("ts"), F.lit("node").alias("kind"), F.col("id").cast("string").alias("id"), F.when(F.col("degree") > 5, 0.8).otherwise(0.5).alias("importance"))
    return n.unionByName(edges.select(F.col(ts).alias("ts"), F.lit("edge").alias("kind"), F.concat_ws(">", "source", "target").alias("id"), F.col("confidence").alias("importance")))


def insights(patterns: DataFrame, anomalies: DataFrame, risks: DataFrame, degree: DataFrame) -> DataFrame:
    """(kind, subject, score): five best patterns and anomalies, how many high risks, how many nodes with over 15 edges."""
    best = patterns.orderBy(F.col("significance").desc(), "id").limit(5).select(F.lit("pattern").alias("kind"), F.col("id").alias("subject"), F.col("significance").alias("score"))
    odd = anomalies.orderBy(F.col("score").desc(), "id").limit(5).select(F.lit("anomaly").alias("kind"), F.col("id").alias("subject"), "score")
    high = risks.agg(F.count_if(F.col("severity").isin("critical", "high")).alias("n")).where("n > 0").select(F.lit("risk").alias("kind"), F.lit("high").alias("subject"), F.col("n").cast("double").alias("score"))
    hubs = degree.agg(F.count_if(F.col("degree") > 15).alias("n")).where("n > 0").select(F.lit("connectivity").alias("kind"), F.lit("hubs").alias("subject"), F.col("n").cast("double").alias("score"))
    return best.unionByName(odd).unionByName(high).unionByName(hubs)


def address_sharing(entities: DataFrame, least: int = 3) -> DataFrame:
    """(value, n, severity): three or more entities at an address; five are high."""
    found = entities.groupBy(normalize_string(F.col("address")).alias("value")).agg(F.count(F.lit(1)).alias("n")).where((F.length("value") > 0) & (F.col("n") >= least))
    return found.withColumn("severity", F.when(F.col("n") >= 5, "high").otherwise("medium"))


def contact_sharing(entities: DataFrame, least: int = 2) -> DataFrame:
    """(kind, value, n, severity): entities that share a phone or an e-mail; three are high."""
    phones = entities.select(F.lit("phone").alias("kind"), last_ten(F.col("phone")).alias("value")).where(F.length("value") == 10)
    mails = entities.select(F.lit("email").alias("kind"), F.lower(F.trim("email")).alias("value")).where(F.length("value") > 0)
    found = phones.unionByName(mails).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return found.withColumn("severity", F.when(F.col("n") >= 3, "high").otherwise("medium"))


def hasty_changes(entities: DataFrame, days: int = 7) -> DataFrame:
    """Entities changed within a week of being made, but not on the same day."""
    gap = F.abs(F.datediff("updated_at", "created_at"))
    return entities.where((gap > 0) & (gap < days)).select("id", gap.alias("days"))


def shared_accounts(entities: DataFrame) -> DataFrame:
    return entities.where(F.length(F.trim("account")) > 0).groupBy(F.trim("account").alias("account")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def shell_companies(entities: DataFrame, least: float = 0.4) -> DataFrame:
    """(id, score, severity): .3 for five or more at the address, .25 for a shared contact, .1 without a website."""
    at = address_sharing(entities, 5).select(F.col("value").alias("ad"), F.lit(0.3).alias("s1"))
    c = contact_sharing(entities)
    phones, mails = c.where("kind = 'phone'").select(F.col("value").alias("ph"), F.lit(1).alias("f1")), c.where("kind = 'email'").select(F.col("value").alias("em"), F.lit(1).alias("f2"))
    firms = entities.where("type = 'company'").withColumns({"ad": normalize_string(F.col("address")), "ph": last_ten(F.col("phone")), "em": F.lower(F.trim("email"))})
    joined = firms.join(at, "ad", "left").join(phones, "ph", "left").join(mails, "em", "left")
    zero = F.lit(0.0)
    score = F.coalesce("s1", zero) + F.when(F.coalesce("f1", "f2").isNotNull(), 0.25).otherwise(0.0) + F.when(F.length(F.trim(F.coalesce("website", F.lit("")))) == 0, 0.1).otherwise(0.0)
    return joined.select("id", score.alias("score")).where(F.col("score") >= least).withColumn("severity", F.when(F.col("score") >= 0.6, "high").otherwise("medium"))


def statistics(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """(measure, value): counts by type and mean connections."""
    by_type = entities.groupBy("type").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.concat(F.lit("entities:"), "type").alias("measure"), "value")
    by_rel = rels.groupBy("type").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.concat(F.lit("relations:"), "type").alias("measure"), "value")
    mean = entities.agg(F.count(F.lit(1)).alias("n")).crossJoin(rels.agg(F.count(F.lit(1)).alias("m"))).select(F.lit("mean_connections").alias("measure"), F.when(F.col("n") == 0, 0.0).otherwise(2 * F.col("m") / F.col("n")).alias("value"))
    return by_type.unionByName(by_rel).unionByName(mean)


def overall_risk(patterns: DataFrame) -> DataFrame:
    """One row from severities: level, score and confidence."""
    c, h, m, n = F.col("c"), F.col("h"), F.col("m"), F.col("n")
    counts = patterns.agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "high").alias("h"), F.count_if(F.col("severity") == "medium").alias("m"), F.count(F.lit(1)).alias("n"))
    level = F.when((c > 0) | (h >= 3), "critical").when((h > 0) | (m >= 5), "high").when((m > 0) | (n >= 3), "medium").otherwise("low")
    return counts.select(level.alias("level"), F.least(0.4 * c + 0.25 * h + 0.1 * m + 0.05 * n, F.lit(1.0)).alias("score"), F.least(0.1 * n + 0.5, F.lit(0.95)).alias("confidence"))


def report_risk(results: Column, flags: Column) -> Column:
    return F.when((flags >= 5) | (results > 100), "high").when((flags >= 3) | (results > 50), "medium").otherwise("low")


class Registry:
    """Named detectors (nodes, edges) -> DataFrame, run side by side in one plan each."""

    def __init__(self) -> None:
        self.detectors: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}

    def add(self, name: str, detect: Callable[[DataFrame, DataFrame], DataFrame]) -> Registry:
        self.detectors[name] = detect
        return self

    def run(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """(detector, id, score); a detector's id and first score column."""
        parts = []
        for name, detect in self.detectors.items():
            found = detect(nodes, edges)
            score = next(c for c in ("score", "significance", "risk", "z", "degree") if c in found.columns)
            parts.append(found.select(F.lit(name).alias("detector"), F.col("id").cast("string").alias("id"), F.col(score).cast("double").alias("score")))
        return reduce(DataFrame.unionByName, parts)


def default_registry() -> Registry:
    return Registry().add("frequent", lambda n, e: frequent_nodes(degrees(n, e))).add("outlier", lambda n, e: outliers(degrees(n, e)))
