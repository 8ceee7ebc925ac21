"""Tables served by pages: batch and stream equal the table, and what fails is asked for again."""

import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quarry.sources import pages


class Flaky(pages.ParquetService):
    """Fails the first time that a range is asked for."""

    @classmethod
    def rows(cls, options, first, last):
        mark = os.path.join(options["marks"], f"{first}-{last}")
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("try again")
        return super().rows(options, first, last)


class Dicts:
    """Gives dicts, and one row too few at the end if told so."""

    @staticmethod
    def total(options):
        return int(options["n"])

    @staticmethod
    def rows(options, first, last):
        return [{"id": k, "name": f"n{k}"} for k in range(first, min(last, int(options["n"]) - int(options.get("short", 0))))]


@pytest.fixture
def files(tmp_path):
    out = []
    for k, n in enumerate((0, 250, 1, 730)):
        out.append(str(tmp_path / f"{k}.parquet"))
        pq.write_table(pa.table({"id": [k * 1000 + i for i in range(n)], "v": [f"v{i}" for i in range(n)]}, schema=pa.schema([("id", pa.int64()), ("v", pa.string())])), out[-1], row_group_size=100)
    return out


def load(spark, service, files=(), **options):
    pages.register(spark)
    reader = spark.read.format(pages.NAME).option("service", f"tests.test_pages:{service}" if service != "ParquetService" else f"quarry.sources.pages:{service}").option("path", ",".join(files))
    for k, v in {"wait": 0, **options}.items():
        reader = reader.option(k, v)
    return reader.load()


@pytest.fixture(autouse=True)
def importable(spark):
    """Workers import this module for its services."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert root in os.environ["PYTHONPATH"]


def test_batch_equals_table(spark, files, tmp_path):
    want = sorted(tuple(r) for r in spark.read.parquet(*files).select("id", "v").collect())
    got = load(spark, "ParquetService", files, page_size=70, pages=2)
    assert got.rdd.getNumPartitions() == -(-981 // 140)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in load(spark, "Flaky", files, page_size=100, marks=str(tmp_path)).collect()) == want


def test_dicts_and_short_answers(spark):
    assert sorted((r["id"], r["name"]) for r in load(spark, "Dicts", n=205).collect()) == sorted((k, f"n{k}") for k in range(205))
    with pytest.raises(Exception, match="asked for"):
        load(spark, "Dicts", n=205, short=1, retries=0).collect()


def test_stream_equals_table(spark, files):
    pages.register(spark)
    name = f"t{uuid.uuid4().hex}"
    stream = spark.readStream.format(pages.NAME).option("service", "quarry.sources.pages:ParquetService").option("path", ",".join(files)).option("page_size", 50).option("most", 400).load()
    run = stream.writeStream.format("memory").queryName(name).start()
    try:
        run.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table(name).collect()) == sorted(tuple(r) for r in spark.read.parquet(*files).select("id", "v").collect())
    finally:
        run.stop()
