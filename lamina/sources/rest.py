"""Paged REST source: keyset cursors, OAuth2 client credentials, retries; as a Spark data source, one partition per entity.

``page_of`` has the server side of the protocol, for tests without a network.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_LIMIT, DEFAULT_LIMIT = 2_000, 500


def with_retries(call: Callable[[], Any], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Result of ``call``; waits 1, 2, 4 ... seconds between attempts, raises the last error."""
    for i in range(attempts):
        try:
            return call()
        except (urllib.error.URLError, OSError, TimeoutError):
            if i == attempts - 1:
                raise
            sleep(2.0**i)
    raise ValueError("attempts must be positive")


def encode_cursor(updated: str, key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"t": updated, "i": key}).encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, str]:
    try:
        c = json.loads(base64.urlsafe_b64decode(cursor))
        return c["t"], c["i"]
    except Exception as e:
        raise ValueError("bad cursor") from e


def page_of(rows: list[dict], *, key: str, watermark: str, limit: int | None = None, cursor: str | None = None, updated_since: str | None = None, filters: dict | None = None) -> dict:
    """One page: rows ordered by (watermark, key), strictly after the cursor and ``updated_since``."""
    n = max(1, min(MAX_LIMIT, DEFAULT_LIMIT if limit is None else limit))
    hit = [r for r in rows if (updated_since is None or r[watermark] > updated_since) and all(r.get(k) == v for k, v in (filters or {}).items())]
    hit.sort(key=lambda r: (r[watermark], r[key]))
    total = len(hit)
    if cursor:
        after = decode_cursor(cursor)
        hit = [r for r in hit if (r[watermark], r[key]) > after]
    page = hit[:n]
    more = len(hit) > n
    nxt = encode_cursor(page[-1][watermark], page[-1][key]) if more else None
    return {"data": page, "pagination": {"returned": len(page), "total_matching": total, "limit": n, "has_more": more, "next_cursor": nxt}}


class RestError(Exception):
    """An answer that is no page: status and message."""

    def __init__(self, status: int, message: str):
        super().__init__(f"{status} {message}")
        self.status = status


class PageServer:
    """Server side of the protocol in memory: tokens that expire, a request limit per window, unknown collections, bad cursors.

    ``collections`` maps a name to (rows, key column, watermark column). ``clock`` gives seconds.
    """

    def __init__(self, collections: dict[str, tuple[list[dict], str, str]], client: tuple[str, str], *, token_seconds: int = 900, limit: int = 120, window: int = 60, clock: Callable[[], float] = time.time):
        self.collections, self.client, self.token_seconds, self.limit, self.window, self.clock = collections, client, token_seconds, limit, window, clock
        self.tokens: dict[str, float] = {}
        self.calls: list[float] = []

    def token(self, client_id: str, secret: str) -> str:
        if (client_id, secret) != self.client:
            raise RestError(401, "unknown client")
        t = base64.urlsafe_b64encode(f"{client_id}:{len(self.tokens)}".encode()).decode()
        self.tokens[t] = self.clock() + self.token_seconds
        return t

    def get(self, name: str, params: dict, token: str) -> dict:
        now = self.clock()
        if self.tokens.get(token, -1) <= now:
            raise RestError(401, "token missing or expired")
        self.calls = [c for c in self.calls if c > now - self.window]
        if len(self.calls) >= self.limit:
            raise RestError(429, "too many requests")
        self.calls.append(now)
        if name not in self.collections:
            raise RestError(404, f"no collection {name}")
        rows, key, watermark = self.collections[name]
        extra = {k: v for k, v in params.items() if k not in ("limit", "cursor", "updated_since")}
        try:
            return page_of(rows, key=key, watermark=watermark, limit=None if params.get("limit") is None else int(params["limit"]), cursor=params.get("cursor"), updated_since=params.get("updated_since"), filters=extra)
        except ValueError as e:
            raise RestError(400, str(e)) from e


def all_pages(fetch: Callable[[dict], dict], limit: int = 1_000, updated_since: str | None = None) -> Iterator[dict]:
    """Follow cursors until the server gives none."""
    cursor = None
    while True:
        params = {"limit": limit} | ({"updated_since": updated_since} if updated_since else {}) | ({"cursor": cursor} if cursor else {})
        page = fetch(params)
        yield from page["data"]
        cursor = page["pagination"].get("next_cursor")
        if not cursor:
            return


def http_fetch(base: str, entity: str, token: str, opener: Callable = urllib.request.urlopen) -> Callable[[dict], dict]:
    def fetch(params: dict) -> dict:
        req = urllib.request.Request(f"{base.rstrip('/')}/{entity}?{urllib.parse.urlencode(params)}", headers={"Authorization": f"Bearer {token}"})
        return with_retries(lambda: json.loads(opener(req, timeout=60).read()))

    return fetch


def client_token(url: str, client_id: str, secret: str, opener: Callable = urllib.request.urlopen) -> str:
    body = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": client_id, "client_secret": secret}).encode()
    return with_retries(lambda: json.loads(opener(urllib.request.Request(url, data=body), timeout=60).read()))["access_token"]


class _Entity(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self):
        return [_Entity(e.strip()) for e in self.o["entities"].split(",")]

    def read(self, partition):
        o = self.o
        token = client_token(o["token_url"], o["client_id"], o["client_secret"]) if "token_url" in o else o.get("token", "")
        for row in all_pages(http_fetch(o["base_url"], partition.name, token), int(o.get("limit", 1_000)), o.get("updated_since")):
            yield (partition.name, json.dumps(row))


class PagedRest(DataSource):
    """``spark.read.format('paged_rest')``: ``entity, record`` with the record as JSON text."""

    @classmethod
    def name(cls):
        return "paged_rest"

    def schema(self):
        return "entity string, record string"

    def reader(self, schema):
        return _Reader(dict(self.options))


def pull(spark: SparkSession, record_schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(PagedRest)
    return spark.read.format("paged_rest").options(**options).load().select("entity", F.from_json("record", record_schema).alias("r")).select("entity", "r.*")


def keyset_page(df: DataFrame, watermark: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """The same page over a DataFrame: a top-k, not a global sort."""
    if after:
        t, i = F.lit(after[0]).cast(df.schema[watermark].dataType), F.lit(after[1]).cast(df.schema[key].dataType)
        df = df.filter((F.col(watermark) > t) | ((F.col(watermark) == t) & (F.col(key) > i)))
    return df.orderBy(watermark, key).limit(limit)
