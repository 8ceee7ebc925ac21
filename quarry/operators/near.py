"""Near strings: pairs, and classes of what pairs connect, by rare positional bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, written
from .graph import components

#: Bigrams whose number of occurrences orders the bigrams of a string; all others are rarer, and come first by name.
FREQUENT = 4096
#: Members of a block that meet in one cell. A block of more is cut on both sides, and its cells are keys of their own.
CELL = 1000

_KEY = ["kind", "band", "gram", "bucket"]


def edits(n: Column, threshold: float) -> Column:
    """Edits at most between a string of n characters and one no longer, if their similarity reaches the threshold."""
    return F.floor((1 - threshold) * n + 1e-9).cast("int")


def keyed(nodes: DataFrame, threshold: float) -> DataFrame:
    """Rows (id, kind, v, n, longer, band, gram, pos, bucket) by which any two strings of a kind meet whose similarity
    reaches the threshold. nodes (id, kind, v): lower-cased strings under distinct ids.

    The longer string of a pair sets how many edits there may be: its band, d. Each edit changes two bigrams at most and
    moves the others by one place, so of the 2 d + 1 rarest bigrams of either string, in one order for all strings, one is
    in both, at places no more than d apart. A string is the longer one in one band, and the shorter one in the few
    bands up to that of the longest partner. Places are cut into buckets of d + 1; the shorter string is in all that its
    partner's place can be in. Where a shorter string may have too few bigrams, the strings of a band also meet as such.
    """
    n = F.length("v")
    place = F.struct(F.lit("").alias("gram"), F.lit(0).alias("pos"))
    grams = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.substring(F.col("v"), i, F.lit(2)).alias("gram"), i.alias("pos"))))
    # one exchange: what follows up to the sorted bigrams stays where the string is
    spread = nodes.withColumn("n", n).repartition("id").select("id", "kind", "v", "n", F.inline_outer(grams))
    counts = nodes.select(F.explode(F.transform(grams, lambda g: g["gram"])).alias("gram")).groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(FREQUENT)
    ranked = spread.join(F.broadcast(counts), "gram", "left").groupBy("id", "kind", "v", "n")
    ranked = ranked.agg(F.array_sort(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct(F.coalesce("count", F.lit(0)).alias("count"), "gram", "pos")))).alias("grams"))
    own, most = edits(F.col("n"), threshold), edits(F.floor(F.col("n") / threshold + 1e-9), threshold)
    roles = F.concat(F.array(F.struct(F.lit(True).alias("longer"), own.alias("band"))), F.transform(F.sequence(own, most), lambda b: F.struct(F.lit(False).alias("longer"), b.alias("band"))))
    bands = ranked.select("*", F.inline(roles))
    few = F.when(F.col("longer"), F.ceil(threshold * F.col("n") - 1e-9)).otherwise(F.col("n")) - 1 < 2 * F.col("band") + 1
    prefix = F.transform(F.slice("grams", F.lit(1), 2 * F.col("band") + 1), lambda g: F.struct(g["gram"].alias("gram"), g["pos"].alias("pos")))
    rows = bands.select("id", "kind", "v", "n", "longer", "band", F.inline(F.concat(prefix, F.when(few, F.array(place)).otherwise(F.array().cast("array<struct<gram:string,pos:int>>")))))
    width, back = F.col("band") + 1, F.when(F.col("longer") | (F.col("gram") == ""), 0).otherwise(F.col("band"))
    buckets = F.sequence(F.floor((F.col("pos") - back) / width), F.floor((F.col("pos") + back) / width))
    return rows.withColumn("bucket", F.explode(buckets)).withColumn("bucket", F.col("bucket").cast("int"))


def _cut(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows with ``cell``: of a block cut into s x s cells, the longer strings of a share are in s cells of a row, the
    shorter ones in s cells of a column."""
    s = F.coalesce("cells", F.lit(1))
    share = F.pmod(F.xxhash64("id"), s).cast("int")
    cells = F.transform(F.sequence(F.lit(0), s - 1), lambda k: F.when(F.col("longer"), share * s + k).otherwise(k * s + share))
    return rows.join(hot, _KEY, "left").withColumn("cell", F.explode(cells)).drop("cells")


def _met(rows: DataFrame, extra: list[str], accept: Column | None) -> DataFrame:
    """(a, b, distance, longest) of strings that meet and are near; a pair comes once per bigram that it meets by. accept
    sees them as structs x, the longer one, and y."""
    hot = rows.groupBy(*_KEY).count().where(F.col("count") > CELL).select(*_KEY, F.ceil(F.col("count") / CELL).cast("int").alias("cells"))
    cut = _cut(rows, hot)
    columns = ["id", "kind", "v", "n", "pos", *extra]
    sides = [cut.where(test).select(*_KEY, "cell", F.struct(*columns).alias(name)) for name, test in (("x", "longer"), ("y", "not longer"))]
    pairs = sides[0].join(sides[1], [*_KEY, "cell"]).where("(y.n < x.n or (y.n = x.n and (y.v < x.v or (y.v = x.v and y.id < x.id)))) and abs(x.pos - y.pos) <= band")
    if accept is not None:
        pairs = pairs.where(accept)
    near = pairs.withColumn("distance", F.expr("levenshtein(x.v, y.v, band)")).where("distance >= 0")
    return near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "distance", F.col("x.n").alias("longest"))


def near_pairs(nodes: DataFrame, threshold: float, accept: Column | None = None) -> DataFrame:
    """(a, b, similarity): all pairs of nodes (id, kind, v, ...) of a kind whose similarity, 1 - edits / longer length,
    reaches the threshold, each once and in either order. accept narrows what is compared, by structs x and y."""
    extra = [c for c in nodes.columns if c not in ("id", "kind", "v")]
    rows = keyed(nodes.select("id", "kind", "v"), threshold)
    if extra:
        rows = rows.join(nodes.select("id", *extra), "id")
    rows = written(rows)
    out = _met(rows, extra, accept)
    return out.groupBy("a", "b").agg((1 - F.first("distance") / F.first("longest")).alias("similarity"))


def _stars(rows: DataFrame, keys: list[str], threshold: float, accept: Column | None) -> DataFrame:
    """(a, b): every string of a block that is near the block's first one."""
    member = F.struct("v", "id", "kind")
    firsts = rows.groupBy(*keys).agg(F.min(member).alias("y"), F.max(member).alias("last")).where("y <> last").drop("last")
    met = rows.select(*keys, member.alias("x")).join(firsts, keys).where("x.id <> y.id")
    if accept is not None:
        met = met.where(accept)
    longest = F.greatest(F.length("x.v"), F.length("y.v"))
    met = met.withColumn("most", edits(longest, threshold)).where(F.expr("levenshtein(x.v, y.v, most) >= 0"))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_classes(nodes: DataFrame, threshold: float, accept: Column | None = None) -> DataFrame:
    """(id, component) of nodes (id, kind, v) that near pairs connect, as the components of near_pairs() would be.

    Strings are first compared with one string of each block only: the blocks of keyed(), and those of strings that are
    equal after one deletion, which dense groups share. That is linear. What these links connect is never compared again:
    only blocks go on that several components share, and only pairs between components. Nodes without a link are missing.
    """
    rows = written(keyed(nodes, threshold))
    gone = F.transform(F.sequence(F.lit(1), F.length("v")), lambda i: F.xxhash64(F.concat(F.substring(F.col("v"), F.lit(1), i - 1), F.substring(F.col("v"), i + 1, F.length("v")))))
    gone = F.when(edits(F.length("v"), threshold) > 0, gone).otherwise(F.array().cast("array<bigint>"))
    deleted = nodes.select("id", "kind", "v", F.explode(F.array_distinct(F.concat(F.array(F.xxhash64("v")), gone))).alias("rest"))
    stars = written(_stars(rows, _KEY, threshold, accept).unionByName(_stars(deleted, ["kind", "rest"], threshold, accept)))
    known = written(components(stars))
    placed = rows.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy(*_KEY).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(*_KEY)
    left = written(placed.join(open_, _KEY, "left_semi"))
    apart = F.expr("x.component <> y.component")
    links = _met(left, ["component"], apart if accept is None else apart & accept)
    out = components(stars.unionByName(links.select("a", "b")))
    dropped(rows, stars, known, left)
    return out
