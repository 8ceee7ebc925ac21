"""What the text operators share: a shared work folder, Arrow row mapping and name-safe columns."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.graph import components as connected
from quarry.sources.shared import dropped as discard
from quarry.sources.shared import shared_dir

#: Words of the contracts: runs of anything but space, \t, \n, \v, \f, \r. bytes.split() splits at just these six.
WORD = r"[^\x20\x09-\x0D]+"

GC_SECONDS = 5.0
_collected = 0.0

#: Rows that a Python worker turns into objects at a time; the Arrow batch itself stays compact.
SLICE = 256
SLICE_BYTES = 2 << 20

def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    Then the driver collects its garbage, upon which Spark deletes the shuffle files that nothing refers to any more; they
    have no name to delete them by. Not more often than every GC_SECONDS, in which shuffles can't become large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    global _collected
    if time.monotonic() - _collected > GC_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    return out


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | StructType, rows: int = SLICE) -> DataFrame:
    """mapInArrow where fn gets slices and yields dicts of column -> list or array. A slice has at most ``rows`` rows, and
    if it has more than one, no more than SLICE_BYTES of text and bytes."""
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = np.zeros(batch.num_rows + 1, np.int64)
                for c in batch.columns:
                    if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                        size[1:] += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
                before, at = np.cumsum(size), 0
                while at < batch.num_rows:
                    end = min(at + rows, max(at + 1, int(np.searchsorted(before, before[at] + SLICE_BYTES, side="right")) - 1), batch.num_rows)
                    yield batch.slice(at, end - at)
                    at = end

        for out in fn(slices()):
            columns = [x if isinstance(x, pa.Array) and x.type == f.type else x.cast(f.type) if isinstance(x, pa.ListArray) else pa.array(x, f.type) for x, f in ((out[f.name], f) for f in arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, target)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text index of each word, its place among the distinct words, the distinct words as bytes) of the texts' words, in
    their order. Null texts have none. lower: A-Z become a-z first."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    words, place = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # white space at the ends of a text leaves an empty word
    empty = np.nonzero(pc.equal(words, b"").to_numpy(zero_copy_only=False))[0]
    if len(empty):
        kept = place != empty[0]
        owner, place = owner[kept], place[kept]
        place = place - (place > empty[0])
        words = words.filter(pc.not_equal(words, b""))
    return owner, place, words


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of doc_id written as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


#: A key with so many rows is hot: more than a task should get, or 1/HOT_SHARE of a smaller table.
HOT_ROWS, HOT_SHARE = 1_000_000, 256
#: Hot keys at most, whatever the size of the table.
HOT_KEYS = 100_000


def hot_from(total: int) -> int:
    """The number of rows from which a key is hot; fewer than HOT_KEYS keys have so many of ``total`` rows."""
    return max(2, min(-(-total // HOT_SHARE), max(HOT_ROWS, -(-total // HOT_KEYS))))


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that are not among those taken, which Spark tells apart without case."""
    have, out = {x.lower() for x in taken}, []
    for name in wanted:
        while (name := f"__{name}").lower() in have:
            pass
        have.add(name.lower())
        out.append(name)
    return out


def lookup(rows: DataFrame, key: str, table: DataFrame, n_col: str, total: int, value: str) -> DataFrame:
    """rows with ``value`` of the table's one row of the same key, null if none. n_col: how many rows have that key.

    Hot keys find their row in a broadcast table; those rows then go on under a key of their own, so that no task gets
    all rows of a key.
    """
    least = hot_from(total)
    hot = table.where(F.col(n_col) >= least).select(F.col(key).alias("__k"), F.col(value).alias("__hot"))
    cold = table.where(F.col(n_col) < least).select(F.col(key).alias("__k"), F.col(value).alias("__cold"))
    names = rows.columns
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("__k"), "left").drop("__k")
    spread = F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.xxhash64(*names))
    found = found.withColumn("__key", spread).join(cold, F.col("__key") == F.col("__k"), "left")
    return found.select(*names, F.coalesce("__hot", "__cold").alias(value))


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): of every end of an edge (a, b) the least id that edges reach."""
    return connected(edges, lambda df: materialize(df, "components")).withColumnRenamed("component", "comp")
