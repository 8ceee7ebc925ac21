"""Entities in text: a catalog of patterns, normalisers and checks, all run as JVM expressions in one pass over the text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_edits, digits, lowered, similarity
from ..sources.shared import written
from . import gazetteer
from .near import near_pairs
from .terms import held_terms

_DATES = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_IP = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
_URL = r"(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)"
_PHONES = (r"\+91[-.\s]?[6-9]\d{9}\b", r"\b[6-9]\d{4}[-.\s]?\d{5}\b", r"\b[6-9]\d{2}\s\d{3}\s\d{4}\b", r"\b0\d{2,4}[-.\s]?\d{6,8}\b", r"\+\d{1,3}[-.\s]?\d{8,14}\b")
_PAN = (r"(?i)\b[A-Z]{3}[ABCFGHLJPTF][A-Z]\d{4}[A-Z]\b", r"(?i)\bPAN[:\s]+[A-Z]{5}\d{4}[A-Z]\b")
_IFSC = (r"\b[A-Z]{4}0[A-Z0-9]{6}\b", r"(?i)\bIFSC[:\s]+[A-Z]{4}0[A-Z0-9]{6}\b")
_EMAIL = (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",)
_VEHICLE = r"[A-Z]{2}[-\s]?\d{1,2}[-\s]?[A-Z]{1,3}[-\s]?\d{1,4}\b"

# Patterns of the first catalog by type.
PATTERNS_1 = {
    "phone": _PHONES, "email": _EMAIL, "pan_number": _PAN,
    "aadhaar_number": (r"(?i)\bAadhaar?[:\s]+\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", r"(?i)\bUID[:\s]+\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    "account_number": (r"(?i)\b(?:a/c|account|acc|acct)[:\s]+\d{9,18}\b",), "ifsc_code": _IFSC,
    "vehicle_number": (rf"(?i)\b{_VEHICLE}", rf"(?i)\b(?:vehicle|reg|registration)[:\s]+{_VEHICLE}"), "ip_address": (_IP,),
    "url": (rf"(?i)https?://{_URL}", r"(?i)www\.[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)"), "pincode": (r"(?i)\b(?:pin|pincode|postal|zip)[:\s]+\d{6}\b",),
    "amount": (r"(?i)(?:Rs\.?|INR|₹)\s*[\d,]+(?:\.\d{2})?", r"(?i)\b\d+(?:\.\d+)?\s*(?:lakh|lac|crore|million|billion)s?\b", r"[$€£¥]\s*\d+(?:,\d{3})*(?:\.\d{2})?\b"),
    "date": (r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+{_DATES}\s+\d{{2,4}}\b", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"),
    "address": (
        r"(?i)\b(?:flat|fl|house|hs|plot|plt|shop|sh|office|off|room|rm)[:\s]*\d+[a-z]?(?:\s*[-,]?\s*(?:apartment|apt|building|bldg|floor|flr|wing|block|sector|sec))?[\w\s,-]{5,50}",
        r"(?i)\b(?:sector|sec|block)\s*[-]?\s*\d+[a-z]?[\w\s,-]{5,50}", r"(?i)\b\d+[\w\s,-]*(?:street|st|road|rd|lane|ln|avenue|ave|colony|nagar|puram|layout|area|market|chowk|mandi)[\w\s,-]{5,50}",
        r"(?i)\b\d+\s+(?:near|lane|opposite|opp|behind|beside|adjacent)[\w\s,-]{5,80}",
    ),
    "company": (r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:Pvt\.?|Private)?\s*(?:Ltd\.?|Limited|Inc\.?|Corporation|Corp\.?|Company|Co\.?|LLP|LLC)\b", (r"(?i)\b(?:company|firm|business|enterprise)[:\s]+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*)", 1)),
}
# Patterns of the second catalog that are its own or differ.
PATTERNS_2 = {
    "phone": _PHONES, "email": _EMAIL, "pan_number": _PAN, "ifsc_code": _IFSC, "ip_address": (_IP,), "vehicle_number": (rf"(?i)\b{_VEHICLE}",), "url": (rf"(?i)https?://{_URL}",),
    "aadhaar_number": (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",), "aadhaar_vid": (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",),
    "upi_id": (r"(?i)\b[A-Za-z0-9._-]+@(?:paytm|ybl|oksbi|okaxis|okicici|gpay|phonepe|ibl)\b",), "account_number": (r"(?i)\b(?:a/c|account|acc)[:\s]+\d{9,18}\b",), "pincode": (r"(?i)\b(?:pin|pincode|postal)[:\s]+\d{6}\b",),
    "amount": PATTERNS_1["amount"][:2], "date": (PATTERNS_1["date"][0], r"(?i)\b\d{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4}\b", PATTERNS_1["date"][2]),
    "address": (r"(?i)\b(?:flat|fl|house|hs|plot|plt|shop|sh)[:\s]*\d+[a-z]?(?:\s*[-,]?\s*(?:apt|bldg|floor|wing|block|sector))?[\w\s,-]{5,50}", r"(?i)\b(?:sector|sec|block)\s*[-]?\s*\d+[a-z]?[\w\s,-]{5,50}"),
    "crypto_address": (r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", r"\b0x[a-fA-F0-9]{40}\b"), "social_handle": (r"@[\w]{1,15}\b", r"(?i)\b(?:twitter|instagram|facebook|linkedin)[:\s]+@?[\w]+\b"), "id_number": (r"\b[A-Z]{2,4}\d{6,12}\b",),
}
# Priority of each type, and confidence of those that have one of their own.
PRIORITY = {
    "HIGH": ("phone", "email", "pan_number", "ifsc_code", "vehicle_number", "ip_address", "url", "aadhaar_vid", "upi_id", "crypto_address"),
    "MEDIUM": ("address", "account_number", "aadhaar_number", "amount", "social_handle", "id_number"),
}
PRIORITY_2 = {"HIGH": (*PRIORITY["HIGH"], "aadhaar_number", "account_number"), "MEDIUM": ("social_handle", "pincode", "address", "date", "amount", "id_number")}
CONFIDENCE = {"email": 0.98, "vehicle_number": 0.90, "company": 0.80, "address": 0.80}
UNIQUE_ORDER = ("phone", "email", "id_number", "account_number")
# Words before a value, and the value.
CONTEXT_PATTERNS = (
    ("phone", "(?:call|contact|phone|mobile|number)", r"[6-9]\d{9}"), ("amount", "(?:transferred?|received?|paid?|amount|sum)", r"(?:Rs\.?|INR|₹)\s*[\d,]+(?:\.\d{2})?"),
)
# Confidence of names and places.
NAME_CONFIDENCE = {"full": 0.90, "first": 0.75, "last": 0.70, "said": 0.85}
PLACE_CONFIDENCE = {"city": 0.85, "state": 0.90}
# A few names and places of our own beside the fixed lists; callers may give theirs.
OWN_NAMES = ("asha", "anil", "mary")
OWN_PLACES = ("london", "paris", "berlin", "madrid")
FIRST_NAMES = (*gazetteer.FIRST_NAMES, *OWN_NAMES)
PLACES = (*gazetteer.CITIES, *gazetteer.STATES, *OWN_PLACES)


def ascii_bounds(pattern: str) -> str:
    r"""\b as the limit of an ASCII word: Spark's own knows letters of all scripts."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def _normal_1(kind: str, v: Column) -> Column:
    d = digits(v)
    if kind == "phone":
        bare = F.when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10)).when((F.length(d) == 13) & d.startswith("091"), F.substring(d, 4, 10)).otherwise(d)
        return F.when(F.length(bare).between(8, 15), bare)
    if kind == "email":
        return F.lower(v)
    if kind == "pan_number":
        up = F.upper(F.regexp_replace(v, r"(?i)^PAN[:\s]+", ""))
        return F.when(up.rlike(r"^[A-Z]{5}\d{4}[A-Z]$"), up)
    if kind == "aadhaar_number":
        return F.when((F.length(d) == 12) & ~F.substring(d, 1, 1).isin("0", "1"), d)
    if kind in ("account_number", "pincode"):
        return d
    if kind == "ifsc_code":
        return F.upper(F.regexp_replace(v, r"(?i)^IFSC[:\s]+", ""))
    if kind == "vehicle_number":
        return F.regexp_replace(F.upper(F.regexp_replace(v, r"(?i)^(?:vehicle|reg|registration)[:\s]+", "")), r"[-\s]", "")
    if kind == "amount":
        number = F.regexp_replace(F.regexp_replace(v, r"(?i)^(?:Rs\.?|INR|₹|[$€£¥])\s*", ""), r"[^\d.]", "")
        x = number.try_cast("double")
        return F.when((x >= 100) & ~number.rlike(r"^[1-8]\d{5}$") & ~number.rlike(r"^[6-9]\d{9}$") & (F.length(number) <= 15), F.trim(v))
    if kind == "date":
        return F.when((F.length(v) >= 6) & ~v.rlike(r"^\d-\d-\d$"), v)
    if kind == "address":
        t = F.trim(v)
        return F.when(t.rlike(r"\d") & (F.length(t) > 10), t)
    if kind == "company":
        return F.trim(F.regexp_replace(v, r"\s+(?:Pvt\.?|Private)?\s*(?:Ltd\.?|Limited|Inc\.?|Corporation|Corp\.?|Company|Co\.?|LLP|LLC)$", ""))
    return v


def _normal_2(kind: str, v: Column) -> Column:
    v, d = F.trim(v), digits(v)
    if kind == "phone":
        return F.when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10)).otherwise(d)
    if kind == "pan_number":
        return F.upper(F.regexp_replace(v, r"(?i)^PAN[:\s]+", ""))
    if kind == "aadhaar_number":
        return d
    if kind == "ifsc_code":
        return F.upper(F.regexp_replace(v, r"(?i)^IFSC[:\s]+", ""))
    if kind == "vehicle_number":
        return F.regexp_replace(F.upper(v), r"[-\s]", "")
    if kind == "amount":
        return F.replace(F.regexp_extract(v, r"[\d,]+(?:\.\d{2})?", 0), F.lit(","), F.lit(""))
    return F.lower(v)


@dataclass(frozen=True)
class Catalog:
    patterns: dict[str, tuple]
    normal: object
    priority: dict[str, tuple[str, ...]]
    confidence: dict[str, float]
    default: float


FIRST = Catalog(PATTERNS_1, _normal_1, PRIORITY, CONFIDENCE, 0.95)
SECOND = Catalog(PATTERNS_2, _normal_2, PRIORITY_2, {}, 0.95)


def priority(kind: str, table: dict[str, tuple[str, ...]]) -> str:
    return next((p for p, kinds in table.items() if kind in kinds), "LOW")


def found(text: Column, catalog: Catalog = FIRST, kinds: list[str] | None = None) -> Column:
    """array<struct<type, value, normalized, priority, confidence>> of a text, each type and normalised value once."""
    parts = []
    for kind, patterns in catalog.patterns.items():
        if kinds and kind not in kinds:
            continue
        for p in patterns:
            # a pattern with a group: the group is the value, taken as it is
            p, group = p if isinstance(p, tuple) else (p, 0)
            parts.append(F.transform(F.regexp_extract_all(text, F.lit(ascii_bounds(p)), F.lit(group)), _entity(kind, catalog, bool(group))))
    return F.array_distinct(F.filter(F.concat(*parts), lambda e: e["normalized"].isNotNull() & (e["normalized"] != "")))


def _entity(kind: str, catalog: Catalog, as_is: bool = False):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), (v if as_is else catalog.normal(kind, v)).alias("normalized"), F.lit(priority(kind, catalog.priority)).alias("priority"), F.lit(catalog.confidence.get(kind, catalog.default)).alias("confidence"))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: Catalog = FIRST, kinds: list[str] | None = None) -> DataFrame:
    """(doc, type, normalized, value, priority, confidence): no shuffle, duplicates of a document are dropped in place."""
    rows = docs.select(F.col(id_col).alias("doc"), F.inline(found(F.col(text_col), catalog, kinds)))
    return rows.select("doc", "type", "normalized", "value", "priority", "confidence").dropDuplicates(["doc", "type", "normalized"])


def names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_names: tuple[str, ...] = FIRST_NAMES, surnames: tuple[str, ...] = gazetteer.SURNAMES) -> DataFrame:
    """(doc, name, confidence): first names with all names after them, surnames after no first name, and capitalised words after words
    as named or Mr that don't begin with a stop word. The lists are bounded parameters; words count by their letters
    a-z, in any case. Each name once per document, whatever the order. A run that ends in a surname counts .9, another .75,
    a surname alone .7, a name known by the words before it .85; what the lists have goes before what the words say."""
    # a word without letters leaves an empty one, so that its neighbours don't become adjacent
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(text_col), r"\s+", " "), "[^a-z ]", ""), " ")
    firsts, lasts, stops = (sorted(set(x)) for x in (first_names, surnames, gazetteer.NAME_STOP_WORDS))
    tagged = F.array_join(F.transform(words, lambda w: F.when(w.isin(*stops), "-").when(w.isin(*firsts), F.concat(F.lit("F:"), w)).when(w.isin(*lasts), F.concat(F.lit("S:"), w)).otherwise("-")), " ")
    # each step is a projection of its own: what the next one reads twice, or once per name, is made once per text
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), tagged.alias("marked"))
    runs = F.regexp_extract_all("marked", F.lit(r"(?=(?<![^ ])(F:[a-z]+(?: [FS]:[a-z]+)*))F"), F.lit(1))
    alone = F.regexp_extract_all("marked", F.lit(r"(?<!F:[a-z]{1,40} )(S:[a-z]+)"), F.lit(1))
    said = [F.regexp_extract_all("text", F.lit(p + r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"), F.lit(1)) for p in (r"(?:name(?:d)?|called|known as)[:\s]+", r"(?i:mr\.?|mrs\.?|ms\.?|dr\.?|sri|smt|shri|shrimati)\s+")]
    given = F.filter(F.concat(*said), lambda n: ~F.lower(F.regexp_extract(n, r"^\w+", 0)).isin(*stops))
    plain = lambda n: F.initcap(F.regexp_replace(n, "[FS]:", ""))
    worth = lambda n, c: F.struct(n.alias("name"), c.alias("confidence"))
    listed = F.concat(
        F.transform(runs, lambda n: worth(plain(n), F.when(F.regexp_extract(n, "[a-z]+$", 0).isin(*lasts), NAME_CONFIDENCE["full"]).otherwise(NAME_CONFIDENCE["first"]))),
        F.transform(alone, lambda n: worth(plain(n), F.lit(NAME_CONFIDENCE["last"]))),
    )
    both = F.concat(F.transform(listed, lambda x: F.struct(F.lit(1).alias("rank"), x["confidence"].alias("confidence"), x["name"].alias("name"))), F.transform(given, lambda n: F.struct(F.lit(0).alias("rank"), F.lit(NAME_CONFIDENCE["said"]).alias("confidence"), F.initcap(F.regexp_replace(n, r"\s+", " ")).alias("name"))))
    rows = rows.select("doc", both.alias("found"))
    best = F.transform(F.array_distinct(F.transform("found", lambda x: x["name"])), lambda n: F.array_max(F.filter("found", lambda x: x["name"] == n)))
    return rows.select("doc", F.explode(best).alias("b")).select("doc", "b.name", "b.confidence")


def locations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", places: tuple[str, ...] = PLACES, states: tuple[str, ...] = gazetteer.STATES) -> DataFrame:
    """(doc, location, confidence): cities and states of the list that the text holds, in any case; states are the surer.
    Each text is read once, whatever the length of the list."""
    hits = held_terms(docs.sparkSession, F.lower(text_col), sorted(set(places)))
    found_ = docs.select(F.col(id_col).alias("doc"), F.explode(hits).alias("location"))
    return found_.select("doc", "location", F.when(F.col("location").isin(*states), PLACE_CONFIDENCE["state"]).otherwise(PLACE_CONFIDENCE["city"]).alias("confidence"))


def best_of(entities: DataFrame) -> DataFrame:
    """One per type and value of a document: the most certain."""
    w = Window.partitionBy("doc", "type", "normalized").orderBy(F.col("confidence").desc(), "value")
    return entities.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def with_context(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """(doc, type, value, context): each phone after words as call or contact, and each amount after words as paid, with
    ``width`` characters on both sides. What stands around is looked at, not consumed, so neighbours are found as well."""
    before = rf"\A.{{0,{width - 1}}}|.{{{width}}}" if width else ""
    hits = []
    for kind, words, value in CONTEXT_PATTERNS:
        around = rf"(?is)(?={words})(?<=({before}))({words}[:\s]*({value}))(?=(.{{0,{width}}}))"
        left, match, found_, right = (F.regexp_extract_all(text_col, F.lit(around), F.lit(k)) for k in (1, 2, 3, 4))
        parts = F.arrays_zip(left.alias("l"), match.alias("m"), found_.alias("v"), right.alias("r"))
        hits.append(F.transform(parts, _in_context(kind)))
    return docs.select(F.col(id_col).alias("doc"), F.inline(F.concat(*hits)))


def _in_context(kind: str):
    return lambda p: F.struct(F.lit(kind).alias("type"), _normal_2(kind, p["v"]).alias("value"), F.concat(p["l"], p["m"], p["r"]).alias("context"))


#: What parts the words of aliases: the white space of SQL's expressions, which has no vertical tab, and signs.
WORD_BREAK = r"[ \t\n\f\r,;:\-]+"


def fuzzy_aliases(docs: DataFrame, entities: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.85) -> DataFrame:
    """(doc, normalized, alias): words of the same document that are nearly the entity.

    Words and entities of a document meet by rare bigrams (near_pairs), so a long text with many entities is not compared
    word by word with each. Words and entities that differ in case only are the same."""
    words = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(F.split(text_col, WORD_BREAK))).alias("alias")).where("length(alias) > 2").withColumn("v", lowered(F.col("alias")))
    known = entities.select("doc", "normalized", lowered(F.col("normalized")).alias("v")).where("doc is not null and v is not null")
    # only words as long as some entity of the document, or nearly so, can be its aliases
    n = F.length("v")
    lengths = known.groupBy("doc").agg(F.floor(F.min(n) * threshold).alias("least"), F.ceil(F.max(n) / threshold).alias("most"))
    mine = words.join(lengths, "doc").where(n.between(F.col("least"), F.col("most")))
    both = mine.select("doc", "v", F.lit(True).alias("word"), F.lit(False).alias("entity")).unionByName(known.select("doc", "v", F.lit(False).alias("word"), F.lit(True).alias("entity")))
    nodes = both.groupBy("doc", "v").agg(F.max("word").alias("word"), F.max("entity").alias("entity"))
    nodes = nodes.select(F.struct("doc", "v").alias("id"), F.col("doc").alias("kind"), "v", "word", "entity")
    pairs = near_pairs(nodes, threshold, F.expr("(x.word and y.entity) or (x.entity and y.word)"))
    found_ = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    found_ = found_.select(F.col("a.doc").alias("doc"), F.col("a.v").alias("v"), F.col("b.v").alias("w"))
    return found_.join(known, ["doc", "v"]).join(words.withColumnRenamed("v", "w"), ["doc", "w"]).select("doc", "normalized", "alias")


def aliases_of_longest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.85) -> DataFrame:
    """(doc, normalized, alias): words of each document that are nearly its longest plain word, by the edits of bytes, which
    are no fewer than those of characters, and by lengths in characters.

    A text is split once, where it is read, and only words go on that are long enough beside the longest plain one of their
    own row; that of the document, which may have several rows, is no shorter."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.array_distinct(F.split(text_col, WORD_BREAK)).alias("words"))
    plain = F.filter("words", lambda w: w.rlike(r"^[a-z]+\z"))
    rows = rows.withColumn("best", F.array_max(F.transform(plain, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    least = threshold * F.coalesce(F.col("best.n"), F.lit(0)) - 1e-9
    rows = written(rows.select("doc", "best", F.filter("words", lambda w: (F.length(w) > 2) & (F.length(w) >= least)).alias("words")))
    longest = rows.where("best is not null").groupBy("doc").agg(F.max("best")["w"].alias("normalized"))
    n, m = F.length("alias"), F.length("normalized")
    more, v = F.greatest(n, m), lowered(F.col("alias"))
    pairs = rows.select("doc", F.explode("words").alias("alias")).distinct().join(longest, "doc").where((v != F.col("normalized")) & (F.abs(n - m) <= (1 - threshold) * more + 1e-9))
    return pairs.where(1 - byte_edits(v, F.col("normalized")) / more >= threshold - 1e-9).select("doc", "normalized", "alias")


def raised_confidence(entities: DataFrame, context: Column | None = None, aliases: Column | None = None) -> DataFrame:
    """Adds .05 per other entity of the document with the same value, .05 for a context, .02 per alias up to .1; 1 at most."""
    same = F.count(F.lit(1)).over(Window.partitionBy("doc", "normalized")) - 1
    more = 0.05 * same + (F.when(context.isNotNull(), 0.05).otherwise(0.0) if context is not None else 0.0) + (F.least(0.02 * aliases, F.lit(0.1)) if aliases is not None else 0.0)
    return entities.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + more))


def unique_identifiers(entities: DataFrame, k: int = 5) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, UNIQUE_ORDER)), F.col("type"))
    w = Window.partitionBy("doc").orderBy("rank", "normalized")
    return entities.withColumn("rank", rank).where("rank > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("doc", "type", "normalized")


def searchable(entities: DataFrame) -> DataFrame:
    return entities.where("priority = 'HIGH' and confidence >= 0.7")


def merge_results(*results: DataFrame) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, results).dropDuplicates(["type", "normalized"])


# Patterns of the compact catalog; what stands in the first group, or all of it, is the value.
PATTERNS_3 = {
    "phone": (r"(?:\+91[-\s]?|91[-\s]?|0[-\s]?)?[6-9]\d{9}\b", r"\+91[-\s]?[6-9]\d{4}[-\s]?\d{5}\b"), "email": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",),
    "id_number": (r"(?i)\b[A-Z]{5}\d{4}[A-Z]\b", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", r"\b[A-Z]{1,2}\d{6,8}\b", r"(?i)\b[A-Z]{3}\d{7}\b"), "account": (r"(?i)(?:account|a/c|acct|acc)[\s:-]*\d{9,18}\b", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    "name": (r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",), "location": (r"(?i)(?:from|in|at|near|of)\s+(?-i:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",), "company": (r"(?i)(?:company|firm|business|enterprise|pvt|ltd|llp|inc)\s*[.:]?\s*[A-Za-z][A-Za-z0-9\s]{2,30}",),
}
# Words that are no part of a name there.
NAME_STOP = ("from", "having", "with", "near", "delhi", "mumbai", "bangalore", "chennai", "kolkata", "hyderabad", "pune", "india", "west", "east", "north", "south", "market", "road", "street", "area", "city")


def _normal_3(kind: str, v: Column) -> Column:
    d = digits(v)
    if kind == "phone":
        last = F.substring(d, -10, 10)
        return F.when(last.rlike(r"^[6-9]\d{9}$"), last)
    if kind == "email":
        return F.lower(v)
    if kind == "id_number":
        up = F.regexp_replace(F.upper(v), r"[\s-]", "")
        return F.when(up.rlike(r"^([A-Z]{5}\d{4}[A-Z]|\d{12}|[A-Z]{1,2}\d{6,8}|[A-Z]{3}\d{7})$"), up)
    if kind == "account":
        up = F.regexp_replace(F.upper(v), r"^(?:ACCOUNT|A/C|ACCT|ACC)[\s:-]*", "")
        return F.when(up.rlike(r"^(\d{9,18}|[A-Z]{4}0[A-Z0-9]{6})$"), up)
    low = F.lower(F.trim(F.regexp_replace(v, r"(?i)^(?:from|in|at|near|of|company|firm|business|enterprise|pvt|ltd|llp|inc)\s*[.:]?\s+", "") if kind != "name" else v))
    if kind == "name":
        words = F.split(low, r"\s+")
        return F.when((F.size(words) >= 2) & F.forall(words, lambda w: (F.length(w) >= 2) & ~w.isin(*NAME_STOP)), low)
    return F.when(F.length(low) >= 3, low)


COMPACT = Catalog(PATTERNS_3, _normal_3, {"HIGH": ("phone", "email", "id_number", "account")}, {"phone": 0.98, "email": 0.95, "id_number": 0.85, "account": 0.9, "name": 0.6, "location": 0.5, "company": 0.6}, 0.5)
# The agent's patterns, names and cities.
PATTERNS_4 = {
    "phone": (r"(?:\+91[-.\s]?)?[6-9]\d{9}\b", r"(?:\+91[-.\s]?)?\d{3,4}[-.\s]?\d{6,7}\b", r"(?i)(?:phone|mobile|contact|cell)[\s:.-]*[6-9]\d{9}\b"), "email": PATTERNS_3["email"], "pincode": (r"\b[1-9][0-9]{5}\b",),
    "name": (r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?",),
}
AGENT_FIRST_NAMES = ("rahul", "amit", "priya", "vikram", "neha", "arun", "pooja", "rajesh", "sunita", "sanjay", "anil", "deepak", "ravi", "manish", "varun", "ankit", "nitin", "akash", "naveen", "suresh", "kumar", "sharma", "singh", "verma", "gupta", "jain", "mehta", "patel", "shah", "agarwal")
AGENT_LAST_NAMES = ("sharma", "verma", "gupta", "singh", "kumar", "jain", "mehta", "patel", "shah", "agarwal", "mittal", "bansal", "goyal", "bhargava", "dixit", "tiwari", "tripathi", "mishra", "pandey", "yadav")
AGENT_CITIES = (
    "delhi", "mumbai", "bangalore", "bengaluru", "chennai", "kolkata", "hyderabad", "pune", "ahmedabad", "jaipur", "lucknow", "kanpur", "nagpur", "indore", "bhopal", "patna", "ludhiana", "agra", "nashik",
    "faridabad", "meerut", "rajkot", "varanasi", "srinagar", "aurangabad", "dhanbad", "amritsar", "navi mumbai", "gurgaon", "ghaziabad", "noida", "greater noida", "howrah", "ranchi", "coimbatore",
)
AGENT_CONFIDENCE = {"phone": 0.95, "email": 0.95, "pincode": 0.8, "name": 0.85, "city": 0.9}


def _normal_4(kind: str, v: Column) -> Column:
    if kind == "phone":
        number = F.regexp_replace(v, r"[^\d+]", "")
        return F.when(F.length(number) >= 10, number)
    if kind == "name":
        return F.when(F.exists(F.split(F.lower(v), r"\s+"), lambda w: w.isin(*AGENT_FIRST_NAMES, *AGENT_LAST_NAMES)), v)
    return F.lower(v) if kind == "email" else v


AGENT = Catalog(PATTERNS_4, _normal_4, {"HIGH": ("phone", "email")}, AGENT_CONFIDENCE, 0.5)


def agent_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, type, value, confidence) of the agent's catalog, with the cities of its list that the text holds; each once
    whatever its case, the first spelling by order of the alphabet."""
    e = found(F.col(text_col), AGENT)
    own = F.transform(e, lambda x: F.struct(x["type"].alias("type"), x["normalized"].alias("value"), x["confidence"].alias("confidence")))
    cities = held_terms(docs.sparkSession, F.lower(text_col), list(AGENT_CITIES))
    there = F.transform(cities, lambda c: F.struct(F.lit("city").alias("type"), F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 100)).alias("value"), F.lit(AGENT_CONFIDENCE["city"]).alias("confidence")))
    rows = docs.select(F.col(id_col).alias("doc"), F.inline(F.concat(own, there)))
    return rows.groupBy("doc", "type", F.lower("value").alias("k")).agg(F.min("value").alias("value"), F.max("confidence").alias("confidence")).drop("k")


# Keyword families between two parties, in the order they are tried.
RELATION_WORDS = {
    "location": ("from", "in", "at", "living in", "residing in", "based in", "staying in", "located in"),
    "association": ("connected to", "linked to", "associated with", "related to", "relation to", "knows", "friend of", "colleague of"),
    "family": ("son of", "daughter of", "father of", "mother of", "brother of", "sister of", "husband of", "wife of", "cousin of", "uncle of", "aunt of"),
    "contact": ("having phone", "phone number", "mobile", "contact", "email", "mail"),
    "ownership": ("owns", "owner of", "possesses", "has"),
    "employment": ("works at", "working for", "employed at", "employee of", "job at"),
}


def layered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, type, normalized, confidence, aliases): the second catalog, then what the words before a value add (.85 where
    no pattern has found it), then words that are nearly an entity as its aliases, and the confidence that follows."""
    kinds = ["doc", "type", "normalized"]
    e = extract(docs, id_col, text_col, SECOND).select(*kinds, "confidence")
    c = with_context(docs, id_col, text_col).select("doc", "type", F.col("value").alias("normalized"), "context").where("normalized <> ''").dropDuplicates(kinds)
    new = c.join(e, kinds, "left_anti").select(*kinds, F.lit(0.85).alias("confidence"))
    every = e.unionByName(new)
    near = fuzzy_aliases(docs, every.select("doc", "normalized").distinct(), id_col, text_col).groupBy("doc", "normalized").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    both = every.join(c, kinds, "left").join(near, ["doc", "normalized"], "left")
    return raised_confidence(both, F.col("context"), F.coalesce(F.size("aliases"), F.lit(0))).select(*kinds, "confidence", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def relationships(docs: DataFrame, parties: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 50) -> DataFrame:
    """(doc, source, target, type): runs of words on both sides of a keyword that are known parties of the document; and
    a name and a phone that begin within ``near`` characters are in contact. parties (doc, kind, value).

    The left side is a name, whole or part of one; the right side a location, a name, or a phone by its digits. Runs end
    where something else than words and spaces stands, and the keyword is the last one in the run. All matches count, and
    the phone may be written with anything between its digits: it is looked for by its first five.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))
    parts = []
    for kind, words in RELATION_WORDS.items():
        for word in words:
            pattern = rf"(?i)([a-zA-Z0-9_\s]+)\s+{word}\s+([a-zA-Z0-9_\s]+)"
            left, right = (F.regexp_extract_all("t", F.lit(pattern), F.lit(k)) for k in (1, 2))
            parts.append(F.when(F.contains(F.lower("t"), F.lit(f"{word}")), F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), _sides(kind))).otherwise(F.array()))
    said = rows.select("doc", F.inline(F.concat(*parts)))
    known = parties.select("doc", "kind", F.lower("value").alias("v")).distinct()
    lefts, rights = known.where("kind = 'name'").select("doc", F.col("v").alias("source")), known.where("kind in ('name', 'location', 'phone')").select("doc", "kind", F.col("v").alias("target"))
    ends = said.join(lefts, "doc").where(F.contains("source", F.col("left")) & (F.col("left") != ""))
    # a whole name goes before names that hold the words
    exact = F.col("source") == F.col("left")
    best = Window.partitionBy("doc", "left", "right", "type")
    ends = ends.withColumn("whole", F.max(exact.cast("int")).over(best)).where((F.col("whole") == 0) | exact)
    meant = F.when(F.col("kind") == "phone", F.col("target") == F.regexp_replace("right", r"\D", "")).otherwise(F.col("target") == F.col("right"))
    told = ends.join(rights, "doc").where(meant & (F.col("source") != F.col("target"))).select("doc", "source", "target", "type")
    names_, phones = known.where("kind = 'name'").select("doc", F.col("v").alias("source")), known.where("kind = 'phone'").select("doc", F.col("v").alias("target"))
    at = names_.join(phones, "doc").join(rows, "doc").withColumn("x", F.instr(F.lower("t"), F.col("source"))).withColumn("y", F.instr(F.lower("t"), F.substring("target", 1, 5)))
    close = at.where((F.col("x") > 0) & (F.col("y") > 0) & (F.abs(F.col("x") - F.col("y")) < near)).select("doc", "source", "target", F.lit("contact").alias("type"))
    return told.unionByName(close).distinct()


def _sides(kind: str):
    return lambda p: F.struct(F.lower(F.trim(p["l"])).alias("left"), F.lower(F.trim(p["r"])).alias("right"), F.lit(kind).alias("type"))


# Words that tell what a question wants; the last one that occurs counts.
INTENT_WORDS = (("find", ("find", "search")), ("connect", ("connect", "related", "linked")), ("analyze", ("analyze", "analysis")))


def intents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, intent) of questions, by keywords alone."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    intent = F.lit("search")
    for name, words in INTENT_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        intent = F.when(hit, name).otherwise(intent)
    return docs.select(F.col(id_col).alias("doc"), intent.alias("intent"))


def smart_parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, intent, names, locations, companies): what a question wants, and its weak entities as filters."""
    base = intents(docs, id_col, text_col)
    parts = {"names": names(docs, id_col, text_col).select("doc", F.col("name").alias("v")), "locations": locations(docs, id_col, text_col).select("doc", F.initcap("location").alias("v")), "companies": extract(docs, id_col, text_col, kinds=["company"]).select("doc", F.col("normalized").alias("v"))}
    for name, rows in parts.items():
        base = base.join(rows.groupBy("doc").agg(F.sort_array(F.collect_set("v")).alias(name)), "doc", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return base
