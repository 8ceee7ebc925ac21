"""Best-fit packing of encoded documents into fixed-length sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize
from .encode import encoder

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: Pieces that one population packs; a table has as many populations as it needs.
BLOCK = 8192


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and end_id, cut only where longer than capacity."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    step = 4 * capacity

    def run(slices):
        encode_all = encoder(vocabulary).encode_all
        for b in slices:
            ids, lengths = encode_all(b.column(1).to_pylist())
            # every document's ids, then the end
            flat = np.full(int(lengths.sum()) + len(lengths), end_id, "<u4")
            inner = np.ones(len(flat), bool)
            inner[np.cumsum(lengths + 1) - 1] = False
            flat[inner] = ids()
            raw, at, out = memoryview(flat.tobytes()), [], {"piece": [], "start": [], "length": [], "ids_crc32": []}
            stop = 0
            for i, n in enumerate((4 * (lengths + 1)).tolist()):
                first, stop = stop, stop + n
                for k, s in enumerate(range(first, stop, step)):
                    part = raw[s : min(s + step, stop)]
                    at.append(i)
                    for name, value in zip(out, (k, (s - first) // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(value)
            yield {"doc_id": b.column(0).take(np.array(at, dtype=np.int64)), **out}

    return map_rows(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long", rows=2048)


class Bins:
    """Open bins by free space. The smallest space that holds a size is found in one bit mask."""

    def __init__(self, capacity: int) -> None:
        self.mask, self.by_space, self.bins = 0, [[] for _ in range(capacity + 1)], []
        self.capacity = capacity

    def add(self, members: list[int], space: int) -> None:
        self.by_space[space].append(len(self.bins))
        self.mask |= 1 << space
        self.bins.append(members)

    def put(self, item: int, size: int) -> None:
        open_ = self.mask >> size
        if not open_:
            self.add([item], self.capacity - size)
            return
        space = size + (open_ & -open_).bit_length() - 1
        k = self.by_space[space].pop()
        if not self.by_space[space]:
            self.mask ^= 1 << space
        self.bins[k].append(item)
        self.by_space[space - size].append(k)
        self.mask |= 1 << (space - size)


def best_fit(order, sizes: list[int], capacity: int, bins: Bins | None = None) -> list[list[int]]:
    bins = bins or Bins(capacity)
    for i in order:
        bins.put(i, sizes[i])
    return bins.bins


def crossover(one: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject whole well-filled bins of ``other`` into ``one``; bins of ``one`` that share a document go, and best fit places the documents they leave behind."""
    fill = [sum(sizes[i] for i in b) for b in other]
    full = [k for k in range(len(other)) if fill[k] >= 0.98 * capacity]
    chosen = rng.sample(full, len(full) // 2) if len(full) > 1 else full
    injected = [other[k] for k in chosen]
    taken = {i for b in injected for i in b}
    bins, displaced = Bins(capacity), []
    for b in injected:
        bins.add(list(b), capacity - sum(sizes[i] for i in b))
    for b in one:
        if taken.isdisjoint(b):
            bins.add(list(b), capacity - sum(sizes[i] for i in b))
        else:
            displaced += [i for i in b if i not in taken]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, capacity, bins)


def mutate(one: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The emptiest bins and a few others are taken apart and best fit places their documents anew."""
    order = sorted(range(len(one)), key=lambda k: sum(sizes[i] for i in one[k]))
    out = set(order[: max(2, len(one) // 50)]) | set(rng.sample(range(len(one)), min(len(one), 1 + len(one) // 50)))
    bins = Bins(capacity)
    for k, b in enumerate(one):
        if k not in out:
            bins.add(list(b), capacity - sum(sizes[i] for i in b))
    loose = sorted((i for k in out for i in one[k]), key=lambda i: -sizes[i])
    return best_fit(loose, sizes, capacity, bins)


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones among them."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def evolve(sizes: list[int], elites: list[list[list[int]]], seed: int, capacity: int = CAPACITY, founders: int = 2, population: int = 4, children: int = 6) -> list[list[int]]:
    """One epoch of one island: the best packing found. Ends when no packing can have fewer bins.

    Where there are fewer elites than ``founders``, best-fit packings of random orders join them; children fill the
    population up, and then take the place of the worst."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    pop = list(elites)
    while len(pop) < founders:
        order = list(range(len(sizes)))
        rng.shuffle(order)
        pop.append(best_fit(order, sizes, capacity))
    scored = sorted(((fitness(b, sizes, capacity), k, b) for k, b in enumerate(pop)), reverse=True)
    for n in range(children):
        if len(scored[0][2]) <= least:
            break
        a, b = rng.sample(scored, 2)
        child = mutate(crossover(a[2], b[2], sizes, capacity, rng), sizes, capacity, rng)
        scored = sorted([*scored, (fitness(child, sizes, capacity), len(pop) + n, child)], reverse=True)[:population]
    return scored[0][2]


def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(labels) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        out.setdefault(int(k), []).append(i)
    return list(out.values())


def pack(items: DataFrame, length_col: str = "length", capacity: int = CAPACITY, islands: int = 2, epochs: int = 2, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity.

    Rows are dealt evenly into blocks of about ``block``. Each block is packed by ``islands`` populations, every one in a
    task of its own, from packings of random orders; after each epoch but the last an island's best packing moves to the
    next island, and the block's best packing stays. At the end it is measured against best fit by decreasing size, which
    takes its place only where it needs fewer sequences. A full-length row is a sequence by itself. The extra cost over
    one packing of everything is less than a sequence per block. Repeated rows are packed one by one; an empty table gives
    no rows.
    """
    items = materialize(items, "pieces")  # so that row numbers hold when tasks run again
    n = items.count()
    blocks = max(1, -(-n // block))
    columns = items.columns
    numbered = items.select(F.struct(*columns).alias("item"), F.col(length_col).cast("int").alias("size"), F.monotonically_increasing_id().alias("row"))
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    # a block has about `block` rows by the deal, so the list is bounded
    grouped = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "size", "item"))).alias("rows"))
    grouped = materialize(grouped, "blocks")
    sizes = grouped.select("block", F.col("rows.size").alias("sizes"))
    isles = sizes.withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).withColumn("elites", F.array().cast("array<array<int>>")).repartition(max(1, min(blocks * islands, max(2000, blocks * islands // 64))), "block", "island")
    for epoch in range(epochs):
        evolved = isles.mapInPandas(_epoch(capacity, epoch, epoch == epochs - 1), "block long, island int, sizes array<int>, best array<int>, n_bins int")
        if epoch < epochs - 1:
            evolved = materialize(evolved, "islands")
            mine = evolved.select("block", "island", "sizes", F.array("best").alias("mine"))
            moved = evolved.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.array("best").alias("moved"))
            isles = mine.join(moved, ["block", "island"]).select("block", "island", "sizes", F.concat("mine", "moved").alias("elites"))
    best = evolved.groupBy("block").agg(F.min_by("best", F.struct("n_bins", "island")).alias("best"))
    placed = grouped.join(best, "block").select("block", F.inline(F.arrays_zip(F.col("rows.item").alias("item"), F.col("rows.size").alias("size"), F.col("rows.row").alias("row"), F.col("best").alias("bin"))))
    from pyspark.sql import Window

    before = Window.partitionBy("block", "bin").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("item.*", (F.col("block") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), (F.sum("size").over(before) - F.col("size")).cast("long").alias("offset"))


def _epoch(capacity: int, epoch: int, last: bool):
    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                sizes = [int(x) for x in row.sizes]
                full = [i for i, s in enumerate(sizes) if s >= capacity]
                rest = [i for i, s in enumerate(sizes) if s < capacity]
                at = {i: k for k, i in enumerate(rest)}
                elites = [[[at[i] for i in b] for b in _bins(e) if sizes[b[0]] < capacity] for e in row.elites]
                small = [sizes[i] for i in rest]
                best = evolve(small, elites, hash((int(row.block), int(row.island), epoch)), capacity) if rest else []
                if last and len(best) * capacity - sum(small) >= capacity:  # fewer are thinkable
                    best = min(best, best_fit(sorted(range(len(small)), key=lambda i: -small[i]), small, capacity), key=len)
                bins = [[rest[i] for i in b] for b in best] + [[i] for i in full]
                out.append((row.block, row.island, row.sizes, _labels(bins, len(sizes)), len(bins)))
            yield pd.DataFrame(out, columns=["block", "island", "sizes", "best", "n_bins"])

    return run


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Long texts are cut into full pieces and a rest. Repeated rows are packed
    once each. Other columns are not read. An empty table gives no rows.
    """
    return pack(pieces(docs, id_col, text_col, capacity, vocabulary), "length", capacity)
