"""Entity resolution: blocking, similarity, merging, and relations between entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.records import combine, first_of
from .graph import components
from .near import near_classes, near_pairs

# Where a record's person, company and account are found.
PERSON_FIELDS = ["name", "NAME", "first_name", "FIRST_NAME", "customer_name", "client_name"]
COMPANY_FIELDS = ["company_name", "COMPANY_NAME", "company", "organization"]
ADDRESS_FIELDS = ["address", "ADDRESS", "CADD1", "CADD2", "ADD1", "ADD2"]
PHONE_FIELDS = ["phone", "PHONE", "mobile", "MOBILE", "contact", "CMOBILE"]
EMAIL_FIELDS = ["email", "EMAIL", "email1", "EMAIL1"]
ACCOUNT_FIELDS = ["bank_account", "BANK_ACCNO", "account_number"]


def blocking_keys(kind: Column, value: Column, whole_type: bool = False) -> Column:
    """Two first characters, phonetic code of names, and length in steps of five. whole_type adds a block of everything
    of a type, which compares all pairs and is for small tables only."""
    keys = [
        F.when(F.length(value) >= 2, F.concat(F.lit("prefix:"), kind, F.lit(":"), F.substring(value, 1, 2))),
        F.when(kind.isin("name", "organization"), F.concat(F.lit("phonetic:"), T.phonetic(value))),
        F.concat(F.lit("length:"), kind, F.lit(":"), F.floor(F.length(value) / 5)),
    ]
    if whole_type:
        keys.append(F.concat(F.lit("type:"), kind))
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


#: At this edit similarity and above two strings share a bigram of their prefixes for sure.
LOSSLESS = 0.8


def edit_keys(value: Column, threshold: float) -> Column:
    """Keys of which two strings share one if their similarity() is ``threshold`` or more.

    A string of n characters is at most (1 - threshold) n / threshold edits, k, from such a partner, and an edit changes
    two bigrams at most. Of bigrams numbered by occurrence, in one order for all, the first 2 k + 1 therefore have one in
    common. Under LOSSLESS short strings don't have so many; then all strings have one key, and all pairs are compared.
    """
    v = F.lower(value)
    if threshold < LOSSLESS:
        return F.when(v.isNotNull(), F.array(F.lit("")))
    n = F.length(v)
    grams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(v, i, F.lit(2)))
    numbered = F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda h: h == g)).cast("string")))
    ordered = F.transform(F.array_sort(F.transform(numbered, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))), lambda x: x["g"])
    edits = F.floor((1 - threshold) * n / threshold + 1e-9).cast("int")
    return F.when(n < 2, F.array(v)).when(v.isNotNull(), F.slice(ordered, 1, 2 * edits + 1))


def near_lengths(a: Column, b: Column, threshold: float) -> Column:
    """False only where the lengths alone keep the similarity below the threshold."""
    x, y = F.length(F.lower(a)), F.length(F.lower(b))
    return F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9


def similarity_score(x: str, y: str, aliases: bool = False, contexts: bool = False) -> Column:
    """Score of two entities of prefixes x and y with type and normalized: 1 if equal; else .6 of an edit similarity
    above .8, .3 for equal phonetic codes of names, .2 if an alias is part of the other, .1 if the contexts that both
    have are more than half alike."""
    a, b, kind = F.col(f"{x}.normalized"), F.col(f"{y}.normalized"), F.col(f"{x}.type")
    edit = T.similarity(a, b)
    score = F.when(edit > 0.8, edit * 0.6).otherwise(0.0) + F.when(kind.isin("name", "organization") & (T.phonetic(a) == T.phonetic(b)), 0.3).otherwise(0.0)
    if aliases:
        part = F.exists(f"{x}.aliases", lambda s: F.contains(b, s)) | F.exists(f"{y}.aliases", lambda s: F.contains(a, s))
        score = score + F.when(F.coalesce(part, F.lit(False)), 0.2).otherwise(0.0)
    if contexts:
        c, d = F.col(f"{x}.context"), F.col(f"{y}.context")
        score = score + F.when((F.length(c) > 0) & (F.length(d) > 0) & (T.similarity(c, d) > 0.5), 0.1).otherwise(0.0)
    return F.when(kind != F.col(f"{y}.type"), 0.0).when(a == b, 1.0).otherwise(score)


def candidate_pairs(entities: DataFrame, keys: Column) -> DataFrame:
    """(x, y) structs of entities (id, ...) that share a block, each pair once: the pair is given by its least common key,
    so no distinct over pairs is needed."""
    keyed = entities.withColumn("keys", keys)
    blocks = keyed.select("*", F.explode("keys").alias("key"))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    return pairs.where(F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))


#: Rows of a block that meet in one cell of scored_pairs().
PAIR_CELL = 200


def scored_pairs(rows: DataFrame, id_col: str, value: str, block: list[str]) -> DataFrame:
    """(a, b, similarity): all pairs of rows of a block, a < b, with the similarity of their values.

    The result is quadratic in a block. Different values of a block are compared once and looked up for every pair that
    has them; rows of a block meet in cells of PAIR_CELL on either side, so a large block is many keys.
    """
    keyed = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(value).alias("v"), *block)
    cells = keyed.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / PAIR_CELL).cast("int").alias("cells"))
    placed = keyed.join(cells, block).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    # a cell's row holds its members by value: what is compared is its different values
    side = placed.groupBy(*block, "cells", "cell", "v").agg(F.collect_list("id").alias("ids"))
    x = side.select(*block, F.col("cell").alias("i"), F.explode(F.sequence(F.col("cell"), F.col("cells") - 1)).alias("j"), F.col("v").alias("xv"), F.col("ids").alias("xs"))
    y = side.select(*block, F.explode(F.sequence(F.lit(0), F.col("cell"))).alias("i"), F.col("cell").alias("j"), F.col("v").alias("yv"), F.col("ids").alias("ys"))
    met = x.join(y, [*block, "i", "j"])
    # within a cell both orders of two values meet, and of each two rows the one with the lesser id is named first
    same = F.col("i") == F.col("j")
    met = met.withColumn("similarity", T.similarity(F.col("xv"), F.col("yv"))).select("similarity", same.alias("same"), F.explode("xs").alias("x"), "ys").select("similarity", "same", "x", F.explode("ys").alias("y"))
    return met.where("x <> y and (not same or x < y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def resolve(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, cluster): entities joined by pairs of at least that score; clusters are components, named by their least id.

    A pair that is not equal needs an edit similarity above .8, and above a score of .6 equal phonetic codes as well, or
    an alias or a context; entities (id, type, normalized) have neither. So near_classes() finds all that may be linked.
    At .3 or less equal codes are enough, and everybody of a code is linked with the first.
    """
    e = entities.select("id", "type", "normalized")
    # equal entities are one from the start, so a value that very many have makes no pairs
    same = e.groupBy("type", "normalized").agg(F.min("id").alias("id"))
    nodes = same.select("id", F.col("type").alias("kind"), F.lower("normalized").alias("v")).where("kind is not null and v is not null")
    x, y = F.col("x.v"), F.col("y.v")
    edit, coded = T.similarity(x, y), F.col("x.kind").isin("name", "organization") & (T.phonetic(x) == T.phonetic(y))
    score = F.when(edit > 0.8, edit * 0.6).otherwise(0.0) + F.when(coded, 0.3).otherwise(0.0)
    links = near_classes(nodes, max(LOSSLESS, (threshold - 0.3) / 0.6 - 1e-9), score >= threshold).select(F.col("id").alias("a"), F.col("component").alias("b"))
    if threshold <= 0.3:
        links = links.unionByName(_to_first(nodes.where(F.col("kind").isin("name", "organization")).withColumn("code", T.phonetic(F.col("v"))), ["kind", "code"]))
    comp = components(links)
    clusters = same.withColumnRenamed("id", "lead").join(comp.withColumnRenamed("id", "lead"), "lead", "left").select("type", "normalized", F.coalesce("component", "lead").alias("cluster"))
    return e.join(clusters, e["type"].eqNullSafe(clusters["type"]) & e["normalized"].eqNullSafe(clusters["normalized"])).select("id", "cluster")


def _to_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): the first id of each key with every other one."""
    firsts = rows.groupBy(*keys).agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last").drop("last")
    return rows.join(firsts, keys).where("id <> a").select("a", F.col("id").alias("b"))


def compare(a_type: Column, a: Column, b_type: Column, b: Column) -> Column:
    """1 if equal, 0 for different types, at least .8 for equal phonetic codes, else the edit similarity."""
    edit = T.similarity(a, b)
    return F.when(a == b, 1.0).when(a_type != b_type, 0.0).when(T.phonetic(a) == T.phonetic(b), F.greatest(edit, F.lit(0.8))).otherwise(edit)


def merge(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, aliases, confidence, merged_from): clusters of compare() at the threshold, under their least id.

    Values that are equal but for case are one from the start; near_classes() links the others, and equal values of
    different types meet by the first of them. Entities without a value stay alone.
    """
    e = entities.withColumn("v", F.lower("normalized"))
    same = e.where("v is not null").groupBy("type", "v").agg(F.min("id").alias("lead"))
    nodes = same.select(F.col("lead").alias("id"), F.col("type").alias("kind"), "v").where("kind is not null")
    links = near_classes(nodes, threshold).select(F.col("id").alias("a"), F.col("component").alias("b"))
    if threshold <= 0.8:  # equal phonetic codes alone reach it
        links = links.unionByName(_to_first(nodes.withColumn("code", T.phonetic(F.col("v"))), ["kind", "code"]))
    exact = e.select("type", "v", "normalized").distinct().join(same, ["type", "v"]).select(F.col("lead").alias("id"), "normalized")
    comp = components(links.unionByName(_to_first(exact, ["normalized"])))
    placed = same.join(comp.withColumnRenamed("id", "lead"), "lead", "left").select(F.col("type").alias("t"), F.col("v").alias("w"), F.coalesce("component", "lead").alias("cluster"))
    named = e.join(placed, F.col("type").eqNullSafe(F.col("t")) & (F.col("v") == F.col("w")), "left").withColumn("cluster", F.coalesce("cluster", "id"))
    return named.groupBy(F.col("cluster").alias("id")).agg(F.sort_array(F.collect_set("normalized")).alias("aliases"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("merged_from"))


def record_entities(df: DataFrame, table: str, id_col: str) -> DataFrame:
    """(id, type, name, phone, email, address, account, source): the person, company and account that a record names."""
    have = lambda names: [c for c in names if c in df.columns]
    pick = lambda names: first_of(have(names)) if have(names) else F.lit(None).cast("string")
    address = combine(have(ADDRESS_FIELDS)) if have(ADDRESS_FIELDS) else F.lit(None).cast("string")
    out = None
    for kind, fields in (("person", PERSON_FIELDS), ("company", COMPANY_FIELDS), ("bank_account", ACCOUNT_FIELDS)):
        rows = df.select(F.concat_ws(":", F.lit(table), F.col(id_col).cast("string"), F.lit(kind)).alias("id"), F.lit(kind).alias("type"), pick(fields).alias("name"), pick(PHONE_FIELDS).alias("phone"), pick(EMAIL_FIELDS).alias("email"), F.nullif(address, F.lit("")).alias("address"), pick(ACCOUNT_FIELDS).alias("account"), F.lit(table).alias("source")).where("name is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def merge_duplicates(entities: DataFrame, order: str) -> DataFrame:
    """One per type and normalised name: the first value of each attribute, aliases and sources united."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in ("phone", "email", "address") if c in entities.columns]
    return entities.groupBy("type", T.normalize_string(F.col("name")).alias("normalized")).agg(F.min_by("name", order).alias("name"), *firsts, F.sort_array(F.collect_set("name")).alias("aliases"), F.sort_array(F.collect_set("source")).alias("sources"))


def record_similarity(x: str, y: str, vector: Column) -> Column:
    """1 for equal phones, .98 for equal e-mails, else the given vector similarity."""
    return F.when(T.phones_match(F.col(f"{x}.phone"), F.col(f"{y}.phone")), 1.0).when(T.emails_match(F.col(f"{x}.email"), F.col(f"{y}.email")), 0.98).otherwise(vector)


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def relations(entities: DataFrame, least: float = 0.6, address: float = 0.8, name: float = 0.85, firsts: bool = False) -> DataFrame:
    """(a, b, type, strength) of entities (id, type, name, phone, email, address, company, account).

    Entities with equal phones, e-mails, accounts or addresses are each related to the first of them, so that what k of
    them share gives k - 1 rows, and whoever shares it with whom can be read from the first. Persons
    whose different addresses are near are all related with each other, or with ``firsts`` only the first of each address,
    from whom the others can be read; and persons are related to the first company of each
    name that is near their company's; near_pairs() loses no pair of that similarity.
    """
    e = entities.withColumns({"p": T.last_ten(F.col("phone")), "m": F.lower(F.trim("email")), "ad": T.normalize_string(F.col("address")), "co": T.normalize_string(F.col("company")), "nm": T.normalize_string(F.col("name"))})

    def equal(key: str, test: Column, kind: str, strength: float) -> DataFrame:
        rows = e.where(test).select("id", key)
        first = rows.groupBy(key).agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select(key, "a")
        return rows.join(first, key).where("id <> a").select("a", F.col("id").alias("b"), F.lit(kind).alias("type"), F.lit(strength).alias("strength")).distinct()

    out = equal("p", F.length("p") == 10, "shared_contact", 0.95).unionByName(equal("m", F.length("m") > 0, "shared_contact", 0.99)).unionByName(equal("account", F.length("account") > 0, "financial_link", 0.99))
    at = e.where((F.col("type") == "person") & (F.length("ad") > 0)).select("id", "ad")
    addresses = at.groupBy("ad").agg(F.min("id").alias("id")).select("id", F.lit("").alias("kind"), F.col("ad").alias("v"))
    near = near_pairs(addresses, address)
    if not firsts:
        of = at.join(addresses.select(F.col("v").alias("ad"), F.col("id").alias("first")), "ad")
        near = near.join(of.select(F.col("first").alias("a"), F.col("id").alias("x")), "a").join(of.select(F.col("first").alias("b"), F.col("id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity").where("a <> b")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("shared_address").alias("type"), F.col("similarity").alias("strength"))
    out = out.unionByName(equal("ad", (F.col("type") == "person") & (F.length("ad") > 0), "shared_address", 1.0)).unionByName(near)
    works = e.where((F.col("type") == "person") & (F.length("co") > 0)).select("id", F.col("co").alias("v"))
    firms = e.where((F.col("type") == "company") & (F.length("nm") > 0)).groupBy(F.col("nm").alias("v")).agg(F.min("id").alias("firm"))
    names = works.select("v").distinct().withColumn("works", F.lit(True)).join(firms, "v", "full").select(F.col("v").alias("id"), F.lit("").alias("kind"), "v", "works", "firm")
    across = near_pairs(names, name, F.expr("(x.works and y.firm is not null) or (y.works and x.firm is not null)")).select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    matches = across.unionByName(firms.select(F.col("v").alias("a"), F.col("v").alias("b"))).join(firms.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "firm")
    employed = works.join(matches, "v")
    out = out.unionByName(employed.select(F.col("id").alias("a"), F.col("firm").alias("b"), F.lit("employed_by").alias("type"), F.lit(0.85).alias("strength")))
    return out.where(F.col("strength") >= least)
