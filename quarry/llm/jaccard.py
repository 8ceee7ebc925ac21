"""Near duplicates: exact Jaccard join of word-shingle sets, with an R-tree over count vectors."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, lookup, map_rows, materialize

SHINGLE = 5
#: Similarity in percent.
PERCENT = 80
#: Groups that shingles are hashed into: the dimensions of the count vectors.
GROUPS = 256
#: Counts are held in a byte; one at this value stands for any larger one too, so where both have it nothing is ruled out.
FULL = 127
#: Texts that say which shingles are frequent, at most, and how many shingles are kept of them, at most. They only order
#: the shingles of a set; any order gives the same links.
SAMPLE, FREQUENT = 20_000, 200_000
#: Rows per leaf of a block, and entries per inner node of the R-tree.
LEAF, FANOUT = 512, 16
#: Pairs that are compared with one set in one task, at most.
PART = 256
#: Turns in which components are joined by representatives before all remaining pairs are looked at.
REPRESENTATIVE_TURNS = 2

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["up"]) <= n:
        _tables["up"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE)]))
        _tables["down"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _INVERSE)]))
    return _tables["up"], _tables["down"]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of raw with A-Z lower-cased, and where they begin."""
    low = raw.translate(_LOWER)
    b = np.frombuffer(low, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8))
    start, stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    up, down = _powers(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    h = (sums[stop] - sums[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    return h + (stop - start).astype(np.uint64) * _MIX[1], start


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Per text the sorted distinct shingle hashes; a text with fewer words has one, of all its words; without words none."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raws):
        # texts are hashed together, about a megabyte at a time
        end, total = at, 0
        while end < len(raws) and (end == at or total + len(raws[end]) < 1 << 20):
            total += len(raws[end]) + 1
            end += 1
        h, start = word_hashes(b" ".join(raws[at:end]))
        bounds = np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in raws[at:end]]))
        s = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            s = (s ^ (s >> np.uint64(29))) * _MIX[k % 5] + h[k : k + len(s)]
        s ^= s >> np.uint64(32)
        s *= _MIX[0]
        s ^= s >> np.uint64(31)
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            if z - a >= size:
                out.append(np.unique(s[a : z - size + 1]))
            elif z > a:
                short = blake2b(h[a:z].tobytes(), digest_size=8, person=b"short").digest()
                out.append(np.frombuffer(short, np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        at = end
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles from the front of a set of which a linked set has one too, in any common order of all shingles."""
    return n - -(-percent * n // 100) + 1


def least_overlap(n, m, percent: int = PERCENT):
    """The least intersection with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def most_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of coordinate minima; without limit where a coordinate is FULL in both."""
    least = np.minimum(a, b)
    return np.where((least == FULL).any(axis=-1), 1 << 62, least.sum(axis=-1, dtype=np.int64))


class RTree:
    """Boxes over count vectors, bulk-loaded: points in the order of set size and then of their widest coordinate.

    The overlap of a set with any set in a box is at most the sum of coordinate minima of its vector and the box's upper
    corner; boxes for which that is less than the least overlap are left out.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> None:
        wide = points[:, int(np.argmax(points.max(axis=0) - points.min(axis=0)))] if len(points) else sizes
        order = np.lexsort((wide, sizes // 8))
        self.order, self.points, self.sizes, self.percent = order, points[order], sizes[order], percent
        self.levels = []
        hi, lo, top = self.points, self.sizes, self.sizes
        while len(hi) > FANOUT:
            cut = np.arange(0, len(hi), FANOUT)
            hi, lo, top = np.maximum.reduceat(hi, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(top, cut)
            self.levels.append((hi, lo, top))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places of the points that may be linked with this one."""
        found = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for depth in range(len(self.levels) - 1, -2, -1):
            hi, lo, top = self.levels[depth] if depth >= 0 else (self.points, self.sizes, self.sizes)
            found = found[found < len(hi)]
            fits = (100 * np.minimum(top[found], size) >= self.percent * np.maximum(lo[found], size)) & (most_overlap(hi[found], point) >= least_overlap(lo[found], size, self.percent))
            found = found[fits]
            if depth >= 0:
                found = (found[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return self.order[found]


def _text_hash(text_col: str):
    """128 bits that stand for a text; null as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """One row per document: doc_id, th, n, and what stands for its set: nid, check, keys (prefix), vec."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_hash(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    parts = max(1, -(-rows.count() // SAMPLE))
    sample = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("th"), F.lit(parts)) == 0)).dropDuplicates(["th"]).select("text")

    def shingles(slices):
        for b in slices:
            yield {"s": np.concatenate([np.zeros(0, np.uint64), *shingle_sets(b.column(0).to_pylist(), size)]).view(np.int64)}

    counted = map_rows(sample, shingles, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.col("n").desc(), "s").limit(FREQUENT).toPandas().sort_values("s")
    by_hash = counted["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(by_hash)
    frequent = docs.sparkSession.sparkContext.broadcast((by_hash[order], counted["n"].to_numpy(np.int64)[order]))  # FREQUENT rows at most

    def describe(slices):
        known, counts = frequent.value
        for b in slices:
            out = {"n": [], "nid": [], "check": [], "keys": [], "vec": []}
            for s in shingle_sets(b.column(2).to_pylist(), size):
                n = len(s)
                digest = blake2b(s.tobytes(), digest_size=16).digest()
                keys = s
                if n:
                    if len(known):
                        k = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = known[k] == s
                        keys = np.concatenate([s[~often], s[often][np.argsort(counts[k[often]], kind="stable")]])
                    keys = keys[: prefix_length(n, percent)]
                vec = np.bincount((s >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
                for name, value in zip(out, (n, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), keys.view(np.int64), np.minimum(vec, FULL).astype(np.int8)), strict=True):
                    out[name].append(value)
            yield {"doc_id": b.column(0), "th": b.column(1), **out}

    return map_rows(rows, describe, f"doc_id {dict(rows.dtypes)['doc_id']}, th binary, n long, nid long, check long, keys array<long>, vec array<tinyint>")


def _told_apart(described: DataFrame) -> DataFrame:
    """Sets are compared by 128 bits, nid and check, and named by nid; those few whose nid another set has too get a new one."""
    clashes = described.where("n > 0").groupBy("nid").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).where("c0 <> c1").select(F.col("nid").alias("__nid"))
    clashes = materialize(clashes, "clashes")
    if not clashes.limit(1).count():
        return described
    # n^2 / 2^65 of n sets are to be expected: 3 of 10^10
    marked = described.join(F.broadcast(clashes), F.col("nid") == F.col("__nid"), "left")
    return marked.withColumn("nid", F.when(F.col("__nid").isNotNull(), F.xxhash64("nid", "check")).otherwise(F.col("nid"))).drop("__nid")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough, from the whole sets.

    Pairs go to where the set of their b is: it is sent once to each task that has some of its pairs, PART of them at
    most, and held there while the sets of their a pass by.
    """
    pairs = materialize(pairs, "pairs")
    total = max(1, pairs.count())
    per = materialize(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "per")
    ends = pairs.select(F.col("a").alias("nid")).union(per.select(F.col("b").alias("nid"))).distinct()
    wanted = materialize(nodes.join(ends, "nid").select("nid", "th"), "wanted")
    # a thousand bytes a row would still be small; beyond, the texts are shuffled to where the list is
    side = F.broadcast(wanted) if wanted.count() <= 500_000 else wanted
    texts = docs.select(_text_hash(text_col).alias("th"), F.col(text_col).cast("string").alias("text")).join(side, "th")
    texts = texts.dropDuplicates(["nid"]).select("nid", "text")

    def shingles(slices):
        for b in slices:
            yield {"nid": b.column(0), "s": [x.view(np.int64) for x in shingle_sets(b.column(1).to_pylist(), size)]}

    sets = materialize(map_rows(texts, shingles, "nid long, s array<long>"), "sets")
    parts = F.ceil(F.col("n") / PART)
    dealt = lookup(pairs, "b", per, "n", total, "n").select("a", "b", F.pmod(F.xxhash64("a"), parts).alias("part"))
    passing = dealt.join(sets.select(F.col("nid").alias("a"), "s"), "a").select("b", "part", "a", "s")
    held = per.select("b", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).join(sets.select(F.col("nid").alias("b"), "s"), "b")
    both = passing.unionByName(held.select("b", "part", F.lit(None).cast("long").alias("a"), "s"))
    both = both.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def compare(slices):
        mine = np.zeros(0, np.uint64)
        for x in slices:
            ids, others, lists = x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3)
            found: list[tuple[int, int]] = []
            for i, (b, a) in enumerate(zip(ids, others, strict=True)):
                own = lists[i].values.to_numpy().view(np.uint64)
                if a is None:
                    mine = own
                    continue
                few, many = (own, mine) if len(own) < len(mine) else (mine, own)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                common = int((many[at] == few).sum())
                if 100 * common >= percent * (len(few) + len(many) - common):
                    found.append((a, b))
            yield {"a": [p for p, _ in found], "b": [q for _, q in found]}

    links = materialize(map_rows(both, compare, "a long, b long"), "links")
    discard(pairs, per, wanted, sets)
    return links


def _most_overlap(a: str, b: str):
    """most_overlap() as a column."""
    least = F.zip_with(a, b, lambda x, y: F.least(x, y).cast("int"))
    return F.when(F.array_contains(least, FULL), 1 << 30).otherwise(F.aggregate(least, F.lit(0), lambda t, x: t + x)).cast("long")


_BLOCK_COLUMNS = ["key", "leaf_a", "leaf_b", "side", "nid", "n", "comp", "keys", "vec"]


def _shared_before(key: int, keys: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Which pairs (rows x columns) have a lesser prefix shingle in common, and so meet in another block."""
    seen = np.zeros((len(rows), len(columns)), bool)
    sides = []
    for side in (rows, columns):
        flat = np.concatenate([keys[i] for i in side])
        who = np.repeat(np.arange(len(side)), [len(keys[i]) for i in side])
        less = flat < key
        flat, who = flat[less], who[less]
        order = np.argsort(flat, kind="stable")
        at = np.nonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))[0] if len(flat) else np.zeros(0, np.int64)
        sides.append((flat[order][at], np.split(who[order], at[1:])))
        if rows is columns:
            sides.append(sides[0])
            break
    common, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    for x, y in zip(i, j, strict=True):
        one, other = sides[0][1][x], sides[1][1][y]
        if len(one) > 1 or len(other) > 1 or rows is not columns:
            seen[np.ix_(one, other)] = True
    return seen


def _pairs_of(rows: dict[str, np.ndarray], percent: int):
    """Pairs of different components in one block, or pair of leaves, that the bounds let through. A pair is given by the
    block of the least prefix shingle that both have, so no pair is given twice."""
    key, nid, n, comp, vec, side, keys = (rows[c] for c in ("key", "nid", "n", "comp", "vec", "side", "keys"))
    key, same = key[0], rows["leaf_a"][0] == rows["leaf_b"][0]
    if len(nid) == 2 and same:
        # most blocks: one pair
        fits = comp[0] != comp[1] and 100 * min(n) >= percent * max(n) and most_overlap(vec[0], vec[1]) >= least_overlap(n[0], n[1], percent)
        return [(min(nid), max(nid))] if fits and np.intersect1d(keys[0], keys[1]).min() == key else []
    mine = np.arange(len(nid)) if same else np.nonzero(side == 0)[0]
    other = mine if same else np.nonzero(side == 1)[0]
    if len(other) < 1 + same or not len(mine):
        return []
    open_ = ~_shared_before(key, keys, mine, other) & (comp[mine][:, None] != comp[other][None, :])
    if same:
        open_ &= nid[mine][:, None] < nid[other][None, :]
    asked = np.nonzero(open_.any(axis=1))[0]
    if not len(asked):
        return []
    tree, found = RTree(vec[other], n[other], percent), []
    for k in asked:
        i = mine[k]
        near = tree.near(vec[i], n[i])
        found += [(min(nid[i], x), max(nid[i], x)) for x in nid[other[near[open_[k, near]]]]]
    return found


def _block_pairs(percent: int):
    """Streams over rows sorted by block and pair of leaves."""

    def arrays(b) -> dict[str, np.ndarray]:
        out = {c: b.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(_BLOCK_COLUMNS[:-2])}
        keys = np.empty(b.num_rows, object)
        lists = b.column(len(out))
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        for i, part in enumerate(np.split(lists.flatten().to_numpy(), ends[:-1])):
            keys[i] = part
        return out | {"keys": keys, "vec": b.column(len(out) + 1).flatten().to_numpy().reshape(-1, GROUPS)}

    def done(rows: dict[str, np.ndarray], cut: int):
        change = np.zeros(cut, bool)
        change[:1] = True
        for c in ("key", "leaf_a", "leaf_b"):
            change[1:] |= rows[c][1:cut] != rows[c][: cut - 1]
        at = np.append(np.nonzero(change)[0], cut)
        found = [p for a, z in zip(at[:-1], at[1:], strict=True) if z - a > 1 for p in _pairs_of({c: v[a:z] for c, v in rows.items()}, percent)]
        return {"a": [x for x, _ in found], "b": [y for _, y in found]}

    def run(slices):
        held = None
        for b in slices:
            rows = arrays(b)
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            # the last block may go on in the next slice
            last = (rows["key"] == rows["key"][-1]) & (rows["leaf_a"] == rows["leaf_a"][-1]) & (rows["leaf_b"] == rows["leaf_b"][-1])
            cut = int(np.argmax(last))
            held = {c: v[cut:] for c, v in rows.items()}
            if cut:
                yield done(rows, cut)
        if held is not None:
            yield done(held, len(held["key"]))

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct ``size``-word shingles, or all
    words as one where there are fewer. Sets with 100 * intersection >= percent * union are linked; component_id is the
    least id that links reach. Null, empty and wordless texts have no set and are linked with nothing.

    Equal sets are one node from the start. Linked sets share a shingle in a prefix of each, rare shingles first, so
    nodes with a prefix shingle in common form a block; blocks of one are done with. First every node is compared with
    the first of its blocks, and links that hold join into components. In blocks that still hold several components the
    nodes are points in an R-tree of count vectors; pairs of different components that the bound lets through are
    compared by their whole sets, each once. No pair is left out but by the bounds, and no set is cut.

    A block of more than LEAF nodes is split into leaves by set size and hash, and pairs of leaves are matched whose
    boxes, with the upper corners of their count vectors, the same bounds let through. Rows that repeat an id are rows of their own; a null id never names a component
    that has another id. Other columns are not read. An empty table gives no rows.
    """
    described = materialize(_sets(docs, id_col, text_col, size, percent), "described")
    described, raw = _told_apart(described), described
    rows = materialize(described.select("doc_id", "n", "nid"), "rows")
    nodes = described.where("n > 0").groupBy("nid").agg(F.min("doc_id").alias("lead"), F.first("th").alias("th"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("rows"))
    nodes = materialize(nodes, "nodes")
    discard(raw)
    members = nodes.select("nid", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("nid").alias("lead")).where("members > 1")
    shared = materialize(shared.select("key", "members", F.struct("members", "lead").alias("block")), "shared")
    in_all = nodes.agg(F.sum(F.size("keys"))).first()[0] or 0
    blocks = lookup(members, "key", shared, "members", max(1, in_all), "block").where("block is not null").select("key", "nid", "n", "block.members", "block.lead")
    blocks = materialize(blocks, "blocks")
    discard(shared)

    sized = F.col("a.n") * 100 >= F.col("b.n") * percent
    sized = sized & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    bound = _most_overlap("a.vec", "b.vec") * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n"))
    light = nodes.select("nid", "n", "vec")
    to_first = blocks.where("nid <> lead").select(F.col("nid").alias("x"), F.col("lead").alias("y")).distinct()
    to_first = to_first.join(light.alias("a"), F.col("x") == F.col("a.nid")).join(light.alias("b"), F.col("y") == F.col("b.nid")).where(sized & bound)
    links = _verified(to_first.select(F.col("x").alias("a"), F.col("y").alias("b")), nodes, docs, text_col, size, percent)
    comp = materialize(components(links), "components")

    def place() -> DataFrame:
        return blocks.join(comp.withColumnRenamed("id", "nid"), "nid", "left").select("key", "nid", "n", "members", F.coalesce("comp", "nid").alias("comp"))

    # components that meet in a block send one node each to be compared with one of the first component; that joins what
    # is plainly one group, so that its members need not all be compared
    for turn in range(REPRESENTATIVE_TURNS):
        reps = place().groupBy("key", "comp").agg(F.min(F.struct(F.xxhash64("nid", "key", F.lit(turn)).alias("h"), "nid")).alias("rep"))
        lead = reps.groupBy("key").agg(F.min(F.struct("comp", "rep.nid")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "lead")
        met = reps.join(lead, "key").where(F.col("comp") != F.col("lead.comp")).select(F.least("rep.nid", "lead.nid").alias("x"), F.greatest("rep.nid", "lead.nid").alias("y")).distinct()
        met = met.join(light.alias("a"), F.col("x") == F.col("a.nid")).join(light.alias("b"), F.col("y") == F.col("b.nid")).where(sized & bound)
        joined = _verified(met.select(F.col("x").alias("a"), F.col("y").alias("b")), nodes, docs, text_col, size, percent)
        if not joined.limit(1).count():
            break
        links = links.unionByName(joined)
        comp = materialize(components(links), "components")

    placed = place()
    # blocks of the same nodes are one: two hashes and the count tell
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.bit_xor(F.xxhash64("nid")).alias("h0"), F.bit_xor(F.xxhash64("nid", F.lit(1))).alias("h1"), F.count(F.lit(1)).alias("c")).where("c0 <> c1")
    mixed = mixed.groupBy("h0", "h1", "c").agg(F.min("key").alias("key")).select("key")
    left = materialize(placed.join(mixed, "key", "left_semi"), "open")
    discard(blocks)
    # leaves of large blocks: a band of set sizes, and a part of it
    leaf = F.when(F.col("members") <= LEAF, F.lit(0)).otherwise(F.xxhash64(F.floor(F.log1p("n") / 0.02), F.pmod(F.xxhash64("nid"), F.ceil(F.col("members") / LEAF))))
    left = left.withColumn("leaf", leaf.cast("long"))
    some_large = left.where(F.col("members") > LEAF).limit(1).count() > 0
    # of a node's prefix only the blocks that are left, at most one row each
    own = left.groupBy("nid").agg(F.collect_list("key").alias("keys"))
    left = left.join(own.join(light, "nid").select("nid", "keys", "vec"), "nid")
    # a leaf's box: its range of set sizes, and the upper corner of its count vectors
    corner = F.array(*(F.max(F.col("vec")[i]) for i in range(GROUPS)))
    boxes = left.where(F.col("members") > LEAF).groupBy("key", "leaf").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), corner.alias("corner")) if some_large else None
    small = left.where(F.col("members") <= LEAF).withColumns({"leaf_a": F.col("leaf"), "leaf_b": F.col("leaf"), "side": F.lit(0)})
    large = left.where(F.col("members") > LEAF)
    dealt = small.select(*_BLOCK_COLUMNS)
    if some_large:
        boxes = materialize(boxes, "boxes")
        x, y = boxes.alias("x"), boxes.alias("y")
        alike = (F.col("x.hi") * 100 >= F.col("y.lo") * percent) & (F.col("y.hi") * 100 >= F.col("x.lo") * percent)
        alike = alike & (_most_overlap("x.corner", "y.corner") * (100 + percent) >= percent * (F.col("x.lo") + F.col("y.lo")))
        leaf_pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.leaf") <= F.col("y.leaf")) & alike)
        leaf_pairs = leaf_pairs.select(F.col("x.key").alias("key"), F.col("x.leaf").alias("leaf_a"), F.col("y.leaf").alias("leaf_b"))
        side_a = large.join(leaf_pairs.withColumn("leaf", F.col("leaf_a")), ["key", "leaf"]).withColumn("side", F.lit(0))
        side_b = large.join(leaf_pairs.where("leaf_a <> leaf_b").withColumn("leaf", F.col("leaf_b")), ["key", "leaf"]).withColumn("side", F.lit(1))
        dealt = dealt.unionByName(side_a.select(*_BLOCK_COLUMNS)).unionByName(side_b.select(*_BLOCK_COLUMNS))
    dealt = dealt.repartition("key", "leaf_a", "leaf_b").sortWithinPartitions("key", "leaf_a", "leaf_b")
    survivors = map_rows(dealt, _block_pairs(percent), "a long, b long")
    more = _verified(survivors, nodes, docs, text_col, size, percent)
    if more.limit(1).count():
        comp = materialize(components(links.unionByName(more)), "components")

    # of a component the least id, and for every node of several rows or links that id
    named = nodes.select("nid", "lead", "rows").join(comp.withColumnRenamed("id", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    least = named.groupBy("comp").agg(F.min("lead").alias("component_id"))
    named = materialize(named.where("rows > 1 or comp <> nid").join(least, "comp").unionByName(named.where("rows = 1 and comp = nid").join(comp.select("comp").distinct(), "comp", "left_semi").join(least, "comp")).select("nid", "rows", "component_id"), "named")
    out = lookup(rows.select("doc_id", "n", "nid"), "nid", named, "rows", max(1, rows.count()), "component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


#: The rows of op4_ngram_jaccard: all pairs of documents that share a shingle, and what links reach.
ORACLE_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS s FROM w)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), l AS MATERIALIZED (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(id, o) AS (
  SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.o = l.a
), c AS (
  SELECT id, min(o) AS o FROM r GROUP BY id
)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, least(documents.doc_id, coalesce(o, documents.doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = documents.doc_id
"""
