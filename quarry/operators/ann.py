"""Inverted-file index of vectors: cells around centroids, and searches that look into a few of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .vectors import _double, _unit

#: Rows at most that centroids are fitted on, and that the number of probes is chosen on. All rows are indexed.
SAMPLE = 20_000
#: Cells at most, and rows of a part: a cell of more rows is cut, and searched part by part.
CELLS, PART_ROWS = 4096, 8192


@dataclass
class Index:
    """rows (id, cell, part, v) with unit vectors; centroids; probes: cells to look into for the recall asked for; the unit
    vectors of the sample that both were fitted on."""

    rows: DataFrame
    parts: DataFrame
    centroids: np.ndarray
    probes: int
    sample: np.ndarray


def fit_centroids(unit: np.ndarray, cells: int, rounds: int = 8, seed: int = 17) -> np.ndarray:
    """Means of directions: each vector goes to the centroid of the largest cosine, each centroid to the mean of its own."""
    rng = np.random.default_rng(seed)
    out = unit[rng.choice(len(unit), min(cells, len(unit)), replace=False)]
    for _ in range(rounds):
        near = (unit @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, unit)
        filled = np.bincount(near, minlength=len(out)) > 0
        out = np.where(filled[:, None], _unit(sums), out)
    return out


def _places(unit: np.ndarray, centroids: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """At which place of a vector's cells, the nearest first, each of the given cells is; vectors by rows."""
    place = np.empty((len(unit), len(centroids)), np.int64)
    np.put_along_axis(place, np.argsort(-(unit @ centroids.T), axis=1, kind="stable"), np.arange(len(centroids))[None, :], axis=1)
    return np.take_along_axis(place, cells, axis=1)


def _fewest(places: np.ndarray, recall: float, cells: int) -> int:
    shares = np.cumsum(np.bincount(places.ravel(), minlength=cells)) / places.size
    return int(np.searchsorted(shares, recall - 1e-12) + 1)


def probes_for(unit: np.ndarray, centroids: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """The fewest cells that hold ``recall`` of the k nearest rows of queries, both from the sample, over all queries."""
    q, cell = unit[:: max(1, len(unit) // queries)], (unit @ centroids.T).argmax(axis=1)
    near = np.argsort(-(q @ unit.T), axis=1, kind="stable")[:, :k]
    return _fewest(_places(q, centroids, cell[near]), recall, len(centroids))


def probes_for_pairs(unit: np.ndarray, centroids: np.ndarray, threshold: float, recall: float, queries: int = 256) -> int | None:
    """The fewest cells by which ``recall`` of the pairs at the threshold are found from either end, over pairs of the
    sample; None if it has none."""
    step, cell = max(1, len(unit) // queries), (unit @ centroids.T).argmax(axis=1)
    own = np.arange(0, len(unit), step)
    i, j = np.nonzero(unit[own] @ unit.T >= threshold)
    i = own[i]
    i, j = i[i != j], j[i != j]
    if not len(i):
        return None
    order = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    return _fewest(np.minimum(place[i, cell[j]], place[j, cell[i]]), recall, len(centroids))


def build(vectors: DataFrame, id_col: str = "id", vec_col: str = "vector", cells: int | None = None, k: int = 5, recall: float = 0.95, sample: int = SAMPLE) -> Index:
    """Index of every row that has an id and a vector.

    Centroids, as many as the root of the rows but no more than CELLS, are fitted on the ``sample`` rows of least id
    hash, which come to the driver; so is the number of cells to look into chosen, that holds ``recall`` of the ``k``
    nearest rows. Rows are placed by matrix products in their tasks. The centroids are broadcast: CELLS vectors at most.
    """
    rows = vectors.select(F.col(id_col).alias("id"), _double(vec_col).alias("v")).where("id is not null and v is not null")
    kind, n = dict(rows.dtypes)["id"], rows.count()
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    unit = _unit(np.array([r["v"] for r in taken], np.float64)) if taken else np.zeros((0, 1))
    centroids = fit_centroids(unit, min(CELLS, cells or max(1, int(np.sqrt(n))))) if len(unit) else np.zeros((0, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def place(batches):
        for b in batches:
            if b.num_rows:
                u = _unit(np.array(b.column(1).flatten()).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((u @ shared.value.T).argmax(axis=1).astype(np.int32)), pa.array(u.tolist(), pa.list_(pa.float64()))], ["id", "cell", "v"])

    placed = written(rows.mapInArrow(place, f"id {kind}, cell int, v array<double>"))
    # a row per cell, CELLS at most
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    cut = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    return Index(cut, parts, centroids, probes_for(unit, centroids, k, recall) if len(unit) else 0, unit)


def _asked(index: Index, queries: DataFrame, id_col: str, vec_col: str, probes: int | None) -> DataFrame:
    """(query, cell, part, v): each query once per part of the cells that are nearest to it."""
    kind = dict(queries.dtypes)[id_col]
    shared, most = queries.sparkSession.sparkContext.broadcast(index.centroids), index.probes if probes is None else probes

    def ask(batches):
        for b in batches:
            if b.num_rows:
                u = _unit(np.array(b.column(1).flatten()).reshape(b.num_rows, -1))
                cells = np.argsort(-(u @ shared.value.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells.tolist(), pa.list_(pa.int32())), pa.array(u.tolist(), pa.list_(pa.float64()))], ["query", "cells", "v"])

    rows = queries.select(F.col(id_col).alias("query"), _double(vec_col).alias("v")).where("query is not null and v is not null")
    out = rows.mapInArrow(ask, f"query {kind}, cells array<int>, v array<double>").select("query", "v", F.explode("cells").alias("cell"))
    return out.join(F.broadcast(index.parts), "cell").select("query", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return np.array(column.flatten()).reshape(table.num_rows, -1)


#: Scores that are held at a time.
SCORES = 1 << 22


def search(index: Index, queries: DataFrame, k: int = 5, id_col: str = "query", vec_col: str = "vector", probes: int | None = None) -> DataFrame:
    """(query, id, score): of the cells nearest to each query the k rows nearest to it, scored exactly. Each part of a
    cell scores its queries as matrix products and keeps k rows of each, so k rows per query and part are shuffled."""
    kinds = dict(queries.dtypes)[id_col], dict(index.rows.dtypes)["id"]

    def best(q: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        out = []
        if q.num_rows and rows.num_rows:
            a, b, step = _matrix(q), _matrix(rows), max(1, SCORES // rows.num_rows)
            for at in range(0, len(a), step):
                s = a[at : at + step] @ b.T
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                ask = np.repeat(np.arange(at, at + len(s)), top.shape[1])
                out.append((ask, top.ravel(), np.take_along_axis(s, top, axis=1).ravel()))
        ask, hit, score = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": q.column("query").take(pa.array(ask)), "id": rows.column("id").take(pa.array(hit)), "score": score})

    keys = ("cell", "part")
    asked = _asked(index, queries, id_col, vec_col, probes)
    found = asked.groupBy(*keys).cogroup(index.rows.groupBy(*keys)).applyInArrow(best, f"query {kinds[0]}, id {kinds[1]}, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def near_pairs(index: Index, threshold: float, recall: float = 0.95, probes: int | None = None) -> DataFrame:
    """(a, b, similarity) with a < b: rows whose cosine reaches the threshold and of which one looks into the other's cell.

    A pair is found if either end has the other's cell among its probes. There are as many probes as find ``recall`` of
    the pairs of the index's sample, or all cells if it has no pair; with all cells as probes, every pair is found.
    """
    if probes is None:
        probes = (probes_for_pairs(index.sample, index.centroids, threshold, recall) if len(index.sample) else None) or len(index.centroids)
    kind = dict(index.rows.dtypes)["id"]

    def meet(q: pa.Table, rows: pa.Table) -> pa.Table:
        ids, names, out = np.array(rows.column("id")), np.array(q.column("query")), []
        if q.num_rows and rows.num_rows:
            a, b, step = _matrix(q), _matrix(rows), max(1, SCORES // rows.num_rows)
            for at in range(0, len(a), step):
                s = a[at : at + step] @ b.T
                i, j = np.nonzero(s >= threshold)
                x, y, s = names[at + i], ids[j], s[i, j]
                keep = x != y
                out.append((np.minimum(x, y)[keep], np.maximum(x, y)[keep], s[keep]))
        a, b, s = map(np.concatenate, zip(*out, strict=True)) if out else (ids[:0], ids[:0], np.zeros(0))
        return pa.table({"a": a, "b": b, "similarity": s})

    keys = ("cell", "part")
    asked = _asked(index, index.rows.select("id", "v"), "id", "v", probes)
    found = asked.groupBy(*keys).cogroup(index.rows.groupBy(*keys)).applyInArrow(meet, f"a {kind}, b {kind}, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
