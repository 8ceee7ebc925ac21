"""Quality rules: an isolation forest on rule statistics, with a threshold calibrated from labelled rows."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, materialize

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rule_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; null has none."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    dup = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
    repeat, n = 0, len(words)
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            covered = 0  # words before this one are counted
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeat += i + 3 - max(i, covered)
                    covered = i + 3
    return n, chars, symbols, dup, repeat


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    carried = [id_col, *(c for c in keep or [] if c != id_col)]
    rows = docs.select(*carried, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + "".join(f", {s} long" for s in STATS) + ", n_lines long"

    def run(slices):
        for b in slices:
            texts = b.column(len(carried)).to_pylist()
            found = list(zip(*map(rule_statistics, texts), strict=True)) or [[]] * len(STATS)
            yield {**{c: b.column(k) for k, c in enumerate(carried)}, **dict(zip(STATS, found, strict=True)), "n_lines": [x.count("\n") + 1 if x else 0 for x in texts]}

    return map_rows(rows, run, schema)


def features(table: dict[str, np.ndarray]) -> np.ndarray:
    """Statistics as rates, so that the length of a text alone is no anomaly."""
    n = np.maximum(table["n_words"], 1).astype(np.float64)
    return np.stack([
        table["word_chars"] / n,
        np.log1p(100 * table["n_symbols"] / n),
        np.log1p(100 * table["n_dup_lines"] / np.maximum(table["n_lines"], 1)),
        np.log1p(100 * table["n_repeat_words"] / n),
    ], axis=1)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as complete binary arrays: node k has children 2k + 1 and 2k + 2; a leaf repeats itself down to the last level."""

    feature: np.ndarray  # (trees, inner nodes)
    split: np.ndarray
    path: np.ndarray  # (trees, nodes of the last level)
    subsample: int
    threshold: float = 0.6

    @classmethod
    def fit(cls, points: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(subsample, len(points))
        return cls.grown([points[rng.choice(len(points), size, replace=False)] for _ in range(trees)], rng)

    @classmethod
    def grown(cls, draws: list[np.ndarray], rng: np.random.Generator) -> Forest:
        """A tree from each draw of equally many points."""
        trees, size = len(draws), len(draws[0])
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        inner, last = 2**depth - 1, 2**depth
        feature, split, path = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, last))
        for t in range(trees):
            todo = [(0, 0, draws[t])]
            while todo:
                node, level, own = todo.pop()
                if level == depth:
                    path[t, node - inner] = level + _mean_path(len(own))
                    continue
                spread = own.max(axis=0) - own.min(axis=0) if len(own) > 1 else np.zeros(own.shape[1])
                if not (spread > 0).any():
                    # all points alike: every way down from here ends with the same length
                    a = (node + 1) * 2 ** (depth - level) - 1 - inner
                    path[t, a : a + 2 ** (depth - level)] = level + _mean_path(len(own))
                    continue
                f = rng.choice(np.nonzero(spread > 0)[0])
                cut = rng.uniform(own[:, f].min(), own[:, f].max())
                feature[t, node], split[t, node] = f, cut
                right = own[:, f] > cut
                todo += [(2 * node + 1, level + 1, own[~right]), (2 * node + 2, level + 1, own[right])]
        return cls(feature, split, path, size)

    def score(self, points: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the paths, the nearer to 1."""
        total, rows, inner = np.zeros(len(points)), np.arange(len(points)), self.feature.shape[1]
        for t in range(len(self.feature)):
            node = np.zeros(len(points), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (points[rows, self.feature[t, node]] > self.split[t, node])
            total += self.path[t, node - inner]
        return 2.0 ** (-(total / len(self.feature)) / max(float(_mean_path(self.subsample)), 1e-9))


#: Thresholds that are tried are multiples of 1 / STEPS.
STEPS = 1 << 16


def calibrate(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, least_kept: float = 0.98) -> float:
    """The threshold that does best on labelled rows, share of good ones kept plus share of bad ones rejected, among
    those that keep ``least_kept`` of the good ones. Rows above it are rejected. good, bad: how many rows have a score in
    each of the bins, which are numbered by their upper ends, in steps."""
    if not good.sum() or not bad.sum():
        return 0.6
    order = np.argsort(bins)
    bins, kept, left = bins[order], np.cumsum(good[order]) / good.sum(), np.cumsum(bad[order]) / bad.sum()
    gain = np.where(kept >= least_kept, kept + 1 - left, -1.0)
    return float(bins[int(np.argmax(gain))] / STEPS)


def draw(rows: DataFrame, weights: dict[bool, float], trees: int = 100, subsample: int = 256, seed: int = 7) -> DataFrame:
    """(tree, key, position, *STATS, n_lines): for each tree its own draw of ``subsample`` of all rows (id, *STATS, n_lines,
    good), without replacement and in proportion to the weights of good and bad ones.

    A row's key for a tree is an exponential variable over its weight, from a hash of the id and the tree; a tree has the
    rows of the least keys. A task keeps no more than a draw per tree, and a tree gets those of all tasks."""
    names = [*STATS, "n_lines"]
    hashed = rows.select(F.xxhash64("id", *names, "good").alias("h"), "good", *names)

    def run(slices):
        best_key = np.full((trees, 0), 0.0)
        best = np.zeros((trees, 0, len(names)), np.int64)
        salt = (np.arange(trees, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(0x9E3779B97F4A7C15)
        for b in slices:
            h = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            good = np.array(b.column(1).to_pylist(), dtype=bool)
            table = np.stack([b.column(k + 2).to_numpy() for k in range(len(names))], axis=1)
            x = h[None, :] ^ salt[:, None]
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            key = -np.log1p(-u) / np.where(good, weights[True], weights[False])[None, :]
            keys = np.concatenate([best_key, key], axis=1)
            data = np.concatenate([best, np.broadcast_to(table, (trees, *table.shape))], axis=1)
            if keys.shape[1] > subsample:
                at = np.argpartition(keys, subsample - 1, axis=1)[:, :subsample]
                keys, data = np.take_along_axis(keys, at, axis=1), np.take_along_axis(data, at[:, :, None], axis=1)
            best_key, best = keys, data
        if best_key.shape[1]:
            flat = best.reshape(-1, len(names))
            yield {"tree": np.repeat(np.arange(trees), best_key.shape[1]), "key": best_key.ravel(), **{n: flat[:, k] for k, n in enumerate(names)}}

    drawn = map_rows(hashed, run, "tree int, key double" + "".join(f", {n} long" for n in names), rows=4096)
    place = F.row_number().over(Window.partitionBy("tree").orderBy("key", *names))
    return drawn.withColumn("position", place).where(F.col("position") <= subsample)


def _arrays(rows: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    return {n: rows.column(n).to_numpy().astype(np.float64) for n in names}


def quality_rules(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", min_words: int = 50, bad_share: float = 0.02) -> DataFrame:
    """One row per document: doc_id, the five statistics, base_failed, kept, score.

    The forest and its threshold come from all labelled documents that don't fail the base rules. Each tree draws its 256
    points, as the method says, from all of them: good ones alike, and bad ones so much less often that they are
    ``bad_share`` of the good ones' number, since a forest isolates what is rare. It sees rates only. The threshold comes
    from how many good and bad ones have which score, of all of them. All documents are scored over their whole text.

    Null text has no words and fails. Without labels the threshold is 0.6; without any usable labelled row all that pass
    the base rules are kept. Rows that repeat an id are scored one by one. Other columns are not read. An empty table
    gives no rows.
    """
    stats = materialize(statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text"), "statistics")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats, names = stats.withColumn("base_failed", failed), [*STATS, "n_lines"]
    forest = known = None
    if labels is not None:
        known = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) == 1).alias("good")).where("good is not null and doc_id is not null")
        usable = materialize(stats.where("not base_failed").join(known, "doc_id").select(F.col("doc_id").alias("id"), *names, "good"), "labelled")
        n_good, n_bad = usable.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
        if n_good + n_bad:
            weights = {True: 1.0, False: min(1.0, bad_share * n_good / n_bad) if n_good and n_bad else 1.0}
            drawn = draw(usable, weights).select("tree", "position", *names).orderBy("tree", "position").toArrow()  # a draw per tree
            points = features(_arrays(drawn, names))
            starts = np.unique(drawn.column("tree").to_numpy(), return_index=True)[1]
            forest = Forest.grown(np.split(points, starts[1:]), np.random.default_rng(7))
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # 100 trees of 256 leaves

    def run(slices):
        for b in slices:
            points = features({n: b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names})
            score = shared.value.score(points) if shared.value is not None else np.zeros(b.num_rows)
            yield {"doc_id": b.column(0), **{n: b.column(b.schema.get_field_index(n)) for n in STATS}, "base_failed": b.column(b.schema.get_field_index("base_failed")), "score": score}

    out = map_rows(stats, run, f"doc_id {dict(stats.dtypes)['doc_id']}" + "".join(f", {s} long" for s in STATS) + ", base_failed boolean, score double", rows=4096)
    threshold = 1.0
    if forest is not None:
        out = materialize(out, "scored")
        discard(usable)
        step = F.ceil(F.col("score") * STEPS).cast("int").alias("step")
        counts = out.where("not base_failed").join(known, "doc_id").groupBy(step).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toArrow()  # STEPS rows at most
        threshold = calibrate(*(counts.column(n).to_numpy() for n in ("step", "good", "bad")))
    kept = ~F.col("base_failed") & (F.col("score") <= threshold)
    return out.select("doc_id", *STATS, "base_failed", kept.alias("kept"), "score")
