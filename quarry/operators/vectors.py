"""Vectors: cosine similarity, nearest ones, near pairs and leader clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _double(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda t, x: t + x * x))


def cosine(a, b) -> Column:
    """0 where a norm is 0; vectors of different lengths are an error."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size))


def nearest(vectors: DataFrame, query: list[float], k: int = 5, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """(id, score) of the k vectors nearest to a query: a top-k per task, then one merge."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), q).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 512) -> DataFrame:
    """(query, id, score) for a stated set of queries (query, vector) against all rows (id, vector).

    Queries go in blocks: each task scores its rows against a block as one matrix product and keeps k of each, so what is
    shuffled is k rows per query and task."""
    dims = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.ceil(F.lit(queries.count()) / block)))
    blocks = [r["block"] for r in dims.select("block").distinct().collect()]
    spark, out = vectors.sparkSession, None
    for b in blocks:
        rows = dims.where(F.col("block") == b).select("query", "vector").collect()  # a block is bounded
        shared = spark.sparkContext.broadcast(([r["query"] for r in rows], np.array([r["vector"] for r in rows], dtype=np.float64)))
        part = vectors.mapInPandas(_best(shared, k), "query long, id long, score double")
        out = part if out is None else out.unionByName(part)
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _best(shared, k: int):
    def run(frames):
        names, q = shared.value
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        for f in frames:
            if not len(f):
                continue
            v = np.stack(f["vector"].to_numpy()).astype(np.float64)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            s = q @ v.T
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"query": np.repeat(names, top.shape[1]), "id": f["id"].to_numpy()[top.ravel()], "score": np.take_along_axis(s, top, axis=1).ravel()})

    return run


#: Rows of a block, and directions by which blocks are kept apart.
BLOCK, PIVOTS = 2048, 16
#: Blocks along a side of a tile at most, which one task holds, and rows of a block that are multiplied at a time.
TILE, STRIP = 16, 256
#: Ids of a round that are looked up in a broadcast table; more are joined.
ROUND_IDS = 1_000_000


def near_pairs(vectors: DataFrame, threshold: float = 0.9, id_col: str = "id", vec_col: str = "vector", recall: float | None = None, planes: int = 8, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) with a < b and a cosine of at least the threshold.

    By default every pair is found: rows are dealt into blocks of about ``block`` by the nearest of a few pivots, pairs of
    blocks meet in one task each as one matrix product, and those are left out that a pivot keeps apart: two vectors
    whose angles to it differ by more than the threshold's angle can't be near. With ``recall`` rows meet only if they
    agree in the signs of ``planes`` random planes in one of several tables; there are as many tables as find a pair that
    is just near enough with that probability, and others more often.
    """
    rows = vectors.select(F.col(id_col).alias("id"), _double(vec_col).alias("v")).where("id is not null and v is not null")
    return _sketched_pairs(rows, threshold, recall, planes) if recall is not None else _exact_pairs(rows, threshold, block)


def _exact_pairs(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    from ..sources.shared import written

    spark, kind = rows.sparkSession, dict(rows.dtypes)["id"]
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()
    if not chosen:
        return spark.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    pivots = spark.sparkContext.broadcast(_unit(np.array([r["v"] for r in chosen])))
    cells = min(len(chosen), -(-rows.count() // block))  # no more than there are blocks to fill

    def place(frames):
        for f in frames:
            if len(f):
                u = _unit(np.stack(f["v"].to_numpy()))
                yield pd.DataFrame({"id": f["id"], "cell": (u @ pivots.value[:cells].T).argmax(axis=1).astype(np.int32), "u": [x.tobytes() for x in u]})

    placed = written(rows.mapInPandas(place, f"id {kind}, cell int, u binary"))
    sizes = sorted((r["cell"], -(-r["count"] // block)) for r in placed.groupBy("cell").count().collect())  # a row per pivot
    first = dict(zip([c for c, _ in sizes], np.cumsum([0] + [n for _, n in sizes])[:-1].tolist(), strict=True))
    at = lambda table: F.create_map(*(F.lit(int(x)) for kv in table for x in kv))[F.col("cell")]
    dealt = placed.withColumn("block", (at(first.items()) + F.pmod(F.xxhash64("id"), at(sizes).cast("long"))).cast("int"))

    def gather(f: pd.DataFrame) -> pd.DataFrame:
        u = np.frombuffer(b"".join(f["u"]), np.float64).reshape(len(f), -1)
        angle = np.arccos(np.clip(u @ pivots.value.T, -1, 1))
        return pd.DataFrame({"block": [f["block"].iloc[0]], "ids": [f["id"].tolist()], "data": [u.tobytes()], "lo": [angle.min(axis=0)], "hi": [angle.max(axis=0)]})

    blocks = written(dealt.groupBy("block").applyInPandas(gather, f"block int, ids array<{kind}>, data binary, lo array<double>, hi array<double>"))
    total = sum(n for _, n in sizes)
    box = blocks.select("block", "lo", "hi")
    pairs = box.select(F.col("block").alias("x"), F.col("lo").alias("lx"), F.col("hi").alias("hx"), F.explode(F.sequence("block", F.lit(total - 1))).alias("block")).join(box, "block")
    limit = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-9
    apart = F.exists(F.arrays_zip("lx", "hx", "lo", "hi"), lambda p: (p["lx"] - p["hi"] > limit) | (p["lo"] - p["hx"] > limit))
    open_ = pairs.where(~apart) if threshold > 0 else pairs
    # blocks meet in tiles: a block is sent once to each tile that it has an open pair in, not once per pair
    wide = max(1, min(TILE, total // 8))  # a small table has tiles enough for all cores as well
    side = F.floor(F.col("x") / wide), F.floor(F.col("block") / wide)
    cells = open_.select("x", "block", (side[1] * (side[1] + 1) / 2 + side[0]).cast("int").alias("tile"))
    asked = cells.groupBy("tile", F.col("x").alias("block")).agg(F.collect_list("block").alias("others"))
    needed = asked.unionByName(cells.select("tile", "block").distinct().withColumn("others", F.array().cast("array<int>"))).groupBy("tile", "block").agg(F.flatten(F.collect_list("others")).alias("others"))
    along = -(-total // wide)
    sent = needed.join(blocks.select("block", "ids", "data"), "block").repartitionById(along * (along + 1) // 2, F.col("tile"))

    def product(frames):
        held = {r.block: (r.others, np.asarray(r.ids), np.frombuffer(r.data).reshape(len(r.ids), -1)) for f in frames for r in f.itertuples(index=False)}
        for x, (others, ids, data) in sorted(held.items()):
            for y in sorted(others):
                _, mine, against = held[y]
                for at in range(0, len(ids), STRIP):
                    s = data[at : at + STRIP] @ against.T
                    i, j = np.nonzero(s >= threshold)
                    a, b = ids[at + i], mine[j]
                    # within a block each pair comes twice, and each row meets itself
                    keep = a < b if x == y else a != b
                    a, b, s = a[keep], b[keep], s[i, j][keep]
                    if len(a):
                        yield pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "similarity": s})

    return sent.select("block", "others", "ids", "data").mapInPandas(product, f"a {kind}, b {kind}, similarity double")


def tables_for(threshold: float, recall: float, planes: int) -> int:
    """Tables of so many planes that find a pair at the threshold with that probability."""
    agree = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** planes
    return max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-min(agree, 1 - 1e-12)))))


def _sketched_pairs(rows: DataFrame, threshold: float, recall: float, planes: int) -> DataFrame:
    kind = dict(rows.dtypes)["id"]
    tables = tables_for(threshold, recall, planes)

    def sketch(frames):
        for f in frames:
            if len(f):
                v = np.stack(f["v"].to_numpy())
                signs = (v @ np.random.default_rng(17).standard_normal((v.shape[1], tables * planes)) >= 0).reshape(len(v), tables, planes)
                keys = signs @ (1 << np.arange(planes, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << planes)
                yield pd.DataFrame({"id": f["id"], "v": f["v"], "keys": list(keys)})

    blocks = rows.mapInPandas(sketch, f"id {kind}, v array<double>, keys array<long>").select("*", F.explode("keys").alias("key"))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).where(F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), cosine(F.col("x.v"), F.col("y.v")).alias("similarity")).where(F.col("similarity") >= threshold)


def leader_clusters(vectors: DataFrame, threshold: float = 0.85, id_col: str = "id", vec_col: str = "vector", chunk: int = BLOCK) -> DataFrame:
    """(leader, id): rows in the order of their ids join the first leader that is near enough, or lead themselves.

    The rule is sequential, yet its leaders are the first independent set of the near graph, which comes from rounds:
    whoever has no earlier row near it that is undecided leads, and all rows near it don't. A round decides many rows at
    once, wherever they are, and there are as many as the longest chain of rows that wait for each other. Equal vectors
    are one from the start. ``chunk`` is the block size of near_pairs(). Rows without a vector lead themselves, as zero
    vectors do, which are near nothing; rows without an id are left out.
    """
    from ..sources.shared import dropped, written

    rows = written(vectors.select(F.col(id_col).alias("id"), _double(vec_col).alias("v")).where("id is not null"))
    solid = rows.where(F.col("v").isNotNull() & (norm("v") > 0)) if threshold > 0 else rows.where("v is not null")
    same = solid.groupBy("v").agg(F.min("id").alias("first"))
    pairs = written(near_pairs(same.select(F.col("first").alias("id"), "v"), threshold, "id", "v", block=chunk).select("a", "b"))
    few = same.count() <= ROUND_IDS
    ids = lambda table, name: F.broadcast(table.toDF(name)) if few else table.toDF(name)
    left, out = pairs, None
    while left.limit(1).count():
        waiting = left.select(F.col("b").alias("a")).distinct()
        leads = written(left.select("a").distinct().join(waiting, "a", "left_anti"))
        gone = left.join(ids(leads, "a"), "a", "left_semi").select("b").distinct()
        joined = written(gone if out is None else out.unionByName(gone))
        rest = written(left.join(ids(joined, "a"), "a", "left_anti").join(ids(joined, "b"), "b", "left_anti").select("a", "b"))
        dropped(leads)
        if out is not None:
            dropped(out, left)
        left, out = rest, joined
    if out is None:
        found = same.select(F.col("first"), F.lit(None).cast(dict(rows.dtypes)["id"]).alias("leader"))
    else:
        # all pairs of a row that follows, but for those with other followers
        first = pairs.join(ids(out, "a"), "a", "left_anti").join(ids(out, "b"), "b", "left_semi").groupBy(F.col("b").alias("first")).agg(F.min("a").alias("leader"))
        found = same.select("first").join(first, "first", "left")
    members = solid.join(same, "v").select("id", "first").join(found, "first", "left").select("id", F.coalesce("leader", "first").alias("leader"))
    return rows.select("id").join(members, "id", "left").select(F.coalesce("leader", "id").alias("leader"), "id")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def representation(columns: dict[str, Column]) -> Column:
    """What of an entity is embedded: `type: value; name: value; ...` of the parts that are there."""
    return F.concat_ws("; ", *(F.when(F.length(c) > 0, F.concat(F.lit(f"{k}: "), c)) for k, c in columns.items()))


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]] | None = None, size: int = 64, out: str = "vector") -> DataFrame:
    """Vectors from a model called per batch; without one, and for its errors, zero vectors."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series([[0.0] * size] * len(texts))
        try:
            return pd.Series(model(texts.fillna("").tolist()))
        except Exception:  # a model is foreign code; its failure is a stated result
            return pd.Series([[0.0] * size] * len(texts))

    return df.withColumn(out, run(F.col(text_col)))
