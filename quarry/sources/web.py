"""Records from HTTP endpoints and text from pages: fetching is injected, so that nothing here needs a network."""

from __future__ import annotations

import json
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_text


class TTLCache:
    """Answers by key for so many seconds; the oldest goes when full."""

    def __init__(self, ttl: float, most: int = 1000, clock: Callable[[], float] = time.monotonic) -> None:
        self.ttl, self.most, self.clock, self.held = ttl, most, clock, OrderedDict()

    def get(self, key: str):
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at > self.ttl:
            self.held.pop(key, None)
            return None
        return value

    def put(self, key: str, value) -> None:
        self.held[key] = (self.clock(), value)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)


class RateLimiter:
    """At most n calls in any 60 seconds; wait() says how long a caller has to."""

    def __init__(self, per_minute: int, clock: Callable[[], float] = time.monotonic) -> None:
        self.n, self.clock, self.calls = per_minute, clock, deque()

    def wait(self) -> float:
        now = self.clock()
        while self.calls and now - self.calls[0] >= 60:
            self.calls.popleft()
        if len(self.calls) < self.n:
            self.calls.append(now)
            return 0.0
        return 60 - (now - self.calls[0])


@dataclass
class Fetcher:
    """fetch(url, params) -> JSON text is given. Retries wait 1, 2, 4 ... seconds."""

    fetch: Callable[[str, dict], str]
    per_minute: int = 60
    ttl: float = 300
    retries: int = 3
    sleep: Callable[[float], None] = time.sleep
    transform: Callable[[object], list[dict]] | None = None
    cache: TTLCache = field(init=False)
    limiter: RateLimiter = field(init=False)

    def __post_init__(self) -> None:
        self.cache, self.limiter = TTLCache(self.ttl), RateLimiter(self.per_minute)

    def records(self, url: str, params: dict | None = None) -> list[dict]:
        key = f"{url}?{json.dumps(params or {}, sort_keys=True)}"
        if (known := self.cache.get(key)) is not None:
            return known
        for attempt in range(self.retries + 1):
            if (pause := self.limiter.wait()) > 0:
                self.sleep(pause)
            try:
                answer = json.loads(self.fetch(url, params or {}))
                break
            except (OSError, ValueError):
                if attempt == self.retries:
                    raise
                self.sleep(2.0**attempt)
        rows = self.transform(answer) if self.transform else _rows(answer)
        self.cache.put(key, rows)
        return rows

    def pages(self, url: str, page_size: int = 100, most: int = 10) -> Iterator[list[dict]]:
        """Pages by number until one is not full."""
        for page in range(1, most + 1):
            rows = self.records(url, {"page": page, "limit": page_size})
            if rows:
                yield rows
            if len(rows) < page_size:
                return

    def frame(self, spark: SparkSession, urls: list[str]) -> DataFrame:
        """(url, record_json) of several endpoints, fetched here one after the other; see fetch_all() for many."""
        return spark.createDataFrame([(u, json.dumps(r, ensure_ascii=False)) for u in urls for r in self.records(u)], "url string, record_json string")


def fetch_all(urls: DataFrame, fetch: Callable[[str, dict], str], parallel: int = 4, per_minute: int = 60, retries: int = 3, transform: Callable[[object], list[dict]] | None = None, url: str = "url") -> DataFrame:
    """(url, record_json) of any number of endpoints, fetched by ``parallel`` tasks at a time on the executors.

    Each task keeps to its share of the calls a minute. Each url is asked once however often it is listed. A task that
    runs again asks again, so answers should not change what they answer."""
    tasks = max(1, min(parallel, per_minute))

    def run(frames):
        source = Fetcher(fetch, max(1, per_minute // tasks), retries=retries, transform=transform)
        for f in frames:
            for u in f["url"]:
                rows = source.records(u)
                if rows:
                    yield pd.DataFrame({"url": [u] * len(rows), "record_json": [json.dumps(r, ensure_ascii=False) for r in rows]})

    return urls.select(F.col(url).alias("url")).where("url is not null").distinct().repartition(tasks, "url").mapInPandas(run, "url string, record_json string")


def entities_of(records: DataFrame) -> DataFrame:
    """(url, record_json, type, normalized, value, priority, confidence): the entities in every fetched record's JSON."""
    from ..operators.extract import found

    return records.select("url", "record_json", F.inline(found(F.col("record_json")))).select("url", "record_json", "type", "normalized", "value", "priority", "confidence")


def relations_of(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc, source, target, type, strength, confidence): relations that a record's JSON states between its entities; doc
    is a hash of the url and the record."""
    from ..operators.graph import text_relations

    doc = F.xxhash64("url", "record_json").alias("doc_id")
    known = entities.select(doc.alias("doc"), F.col("value").alias("entity"))
    return text_relations(records.select(doc, F.col("record_json").alias("text")).dropDuplicates(["doc_id"]), known)


def _rows(answer) -> list[dict]:
    if isinstance(answer, list):
        return answer
    for name in ("results", "records", "data", "items"):
        if isinstance(answer.get(name), list):
            return answer[name]
    return [answer]


#: Presets: calls a minute and seconds that answers keep.
PRESETS = {"standard": (30, 300.0), "fast": (60, 3600.0), "slow": (10, 86400.0)}


def preset(name: str, fetch: Callable[[str, dict], str]) -> Fetcher:
    per_minute, ttl = PRESETS[name]
    return Fetcher(fetch, per_minute, ttl)


def scraped(pages: DataFrame, url: str = "url", html: str = "html", kept: int = 10_000) -> DataFrame:
    """(url, text, raw): text of whole pages, and the first characters of the HTML for the record."""
    return pages.select(F.col(url).alias("url"), html_to_text(F.col(html)).alias("text"), F.substring(html, 1, kept).alias("raw"))
