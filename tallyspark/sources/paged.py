"""Paged sources as Spark data sources: batch reads split by time, and streams that resume where they stopped.

An adapter says how one page of an entity is fetched; data_source() makes it a format for spark.read and readStream. Pages
come in the order of the records' update times, so a read is split into time windows, each a partition that walks its own
pages: a lost task reads its window again and nothing else. A stream's offset is the newest update time it has seen; Spark
keeps it in the checkpoint, and a restarted stream goes on from there. Windows include their begin, and the last one its
end, so records at a border may come twice; the merge by key absorbs them.

Rows have the entity's columns, `raw` (the untouched record as JSON) and `cursor` (the source's own token after the
record's page). A read with the option `cursor` takes up a chain of pages where it was left.
"""

from __future__ import annotations

import datetime as dt
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tallyspark.context import BadArgument

Config = dict[str, str]
Record = dict[str, Any]


class SourceError(RuntimeError):
    """The source could not be read; the message is fit for a person."""


@dataclass(frozen=True)
class Entity:
    """schema: DDL of the columns; updated: the record's field with its update time, or None for small lists that are always read whole."""

    schema: str
    updated: str | None = "updated_at"


@dataclass(frozen=True)
class Pages:
    """fetch(config, entity, begin, cursor) gives a page (its records, the next cursor or None); newest(config, entity) the last update time.

    row(entity, record) turns a record into values of the entity's columns; by default its fields of these names.
    """

    name: str
    entities: dict[str, Entity]
    fetch: Callable[[Config, str, dt.datetime | None, str | None], tuple[list[Record], str | None]]
    newest: Callable[[Config, str], dt.datetime | None]
    row: Callable[[str, Record], dict[str, Any]] = field(default=lambda entity, record: record)


def parse_time(value: str | None) -> dt.datetime | None:
    if value is None:
        return None
    at = dt.datetime.fromisoformat(value)
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)


@dataclass
class Window(InputPartition):
    """Records updated from begin on, before end or at it; without either, all. cursor: the token to go on from."""

    begin: str | None = None
    end: str | None = None
    closed: bool = True
    cursor: str | None = None


def windows(begin: dt.datetime, end: dt.datetime, parts: int) -> list[Window]:
    """begin to end in windows of equal length, of which the last includes its end."""
    step = (end - begin) / parts
    if step < dt.timedelta(microseconds=1):
        return [Window(begin.isoformat(), end.isoformat())]
    cuts = [begin + step * i for i in range(parts)] + [end]
    return [Window(a.isoformat(), b.isoformat(), b == end) for a, b in zip(cuts, cuts[1:], strict=False)]


def oldest(pages: Pages, config: Config, entity: str) -> dt.datetime | None:
    """The update time of the first record."""
    records, _ = pages.fetch(config, entity, None, None)
    return parse_time(records[0].get(pages.entities[entity].updated)) if records else None


def walk(pages: Pages, config: Config, entity: str, schema: StructType, window: Window) -> Iterator[tuple]:
    """The rows of a window, page by page; no more than a page is held."""
    updated, end, cursor = pages.entities[entity].updated, parse_time(window.end), window.cursor
    seen = {cursor}
    while True:
        records, after = pages.fetch(config, entity, parse_time(window.begin), cursor)
        for record in records:
            at = parse_time(record.get(updated)) if updated and end else None
            if at and (at > end or at == end and not window.closed):
                return
            values = pages.row(entity, record) | {"raw": json.dumps(record, sort_keys=True), "cursor": after}
            yield tuple(values.get(c) for c in schema.names)
        if after is None:
            return
        if after in seen:
            raise SourceError(f"{pages.name} {entity}: the cursor {after!r} came twice")
        seen = {after}
        cursor = after


def data_source(pages: Pages) -> type[DataSource]:
    """A format named like the adapter, with the options entity, since, until, cursor, partitions, and the adapter's own."""

    def settings(options) -> tuple[Config, str, int]:
        config = {k.lower(): v for k, v in dict(options).items()}
        entity = config.get("entity", "")
        if entity not in pages.entities:
            raise BadArgument(f"{pages.name} has no {entity!r}; it has {', '.join(sorted(pages.entities))}")
        parts = int(config.get("partitions", "8"))
        if parts < 1:
            raise BadArgument("partitions must be at least 1")
        return config | {"concurrency": str(parts)}, entity, parts

    class Batch(DataSourceReader):
        def __init__(self, options, schema: StructType):
            self.config, self.entity, self.parts = settings(options)
            self.columns = schema

        def partitions(self) -> list[Window]:
            since, until = self.config.get("since"), self.config.get("until")
            if "cursor" in self.config or not pages.entities[self.entity].updated:
                return [Window(since, until, cursor=self.config.get("cursor"))]
            newest = parse_time(until) or pages.newest(self.config, self.entity)
            if newest is None:
                return []
            begin = parse_time(since) or oldest(pages, self.config, self.entity) or newest
            return windows(begin, newest, self.parts) if begin <= newest else []

        def read(self, partition: Window | None) -> Iterator[tuple]:  # None where there are no windows
            return walk(pages, self.config, self.entity, self.columns, partition) if partition else iter(())

    class Stream(DataSourceStreamReader):
        def __init__(self, options, schema: StructType):
            self.config, self.entity, self.parts = settings(options)
            self.columns = schema
            if not pages.entities[self.entity].updated:
                raise BadArgument(f"{self.entity} has no update time and can't be streamed")

        def initialOffset(self) -> dict:
            first = parse_time(self.config.get("since")) or oldest(pages, self.config, self.entity) or dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
            return {"at": first.isoformat(), "first": True}

        def latestOffset(self) -> dict:
            newest = pages.newest(self.config, self.entity)
            return {"at": newest.isoformat(), "first": False} if newest else self.initialOffset()

        def partitions(self, start: dict, end: dict) -> list[Window]:
            return windows(parse_time(start["at"]), parse_time(end["at"]), self.parts) if not end["first"] else []

        def read(self, partition: Window) -> Iterator[tuple]:
            return walk(pages, self.config, self.entity, self.columns, partition)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return pages.name

        def schema(self) -> str:
            return f"{pages.entities[settings(self.options)[1]].schema}, raw string, cursor string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Batch(self.options, schema)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return Stream(self.options, schema)

    return Source


def use(spark: SparkSession, pages: Pages) -> None:
    """Make the adapter's format known to the session."""
    spark.dataSource.register(data_source(pages))


def read(spark: SparkSession, name: str, config: Config, entity: str) -> DataFrame:
    """What readers.Adapter.read wants: an entity's rows."""
    return spark.read.format(name).options(**config).option("entity", entity).load()


#: Requests that a source takes, and attempts.
MIN_INTERVAL, ATTEMPTS = 0.12, 8


def request(url: str, token: str, body: dict | None = None, interval: float = MIN_INTERVAL, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> dict:
    """The JSON that a bearer request gets: at most one each `interval` seconds; busy answers are asked again, as late as the source says."""
    said = ""
    for attempt in range(attempts):
        wait(interval)
        asked = urllib.request.Request(url, data=json.dumps(body).encode() if body is not None else None, headers={"Authorization": f"Bearer {token}", "Content-Type": "application/json"})
        later = None
        try:
            with urllib.request.urlopen(asked, timeout=60) as got:
                return json.load(got)
        except urllib.error.HTTPError as e:
            if e.code == 401:
                raise SourceError(f"{url} does not accept the token") from e
            if e.code not in (429, 503):
                raise SourceError(f"{url} failed with {e.code}: {e.read()[:300]!r}") from e
            said, later = f"HTTP {e.code}", e.headers.get("Retry-After")
        except OSError as e:
            said = f"{type(e).__name__}: {e}"
        try:
            delay = float(later) if later else min(8.0, 0.25 * 2**attempt)
        except ValueError:
            delay = 1.0
        wait(delay * (0.75 + random.random() / 2))  # not all readers at once
    raise SourceError(f"{url} still fails after {attempts} attempts ({said})")


def http_pages(name: str, entities: dict[str, Entity], paths: dict[str, str], size: int = 100) -> Pages:
    """An adapter of an HTTP API with the options url, token and interval (seconds between all readers' requests).

    GET url/path?begin_time=&cursor=&limit= gives {"items": [...], "cursor": ...}, in the order of update times;
    GET url/path/newest gives {"updated_at": ...}.
    """

    def pace(config: Config) -> float:
        return float(config.get("interval", MIN_INTERVAL)) * int(config.get("concurrency", "1"))

    def fetch(config: Config, entity: str, begin: dt.datetime | None, cursor: str | None):
        asked = {"limit": size} | ({"begin_time": begin.isoformat()} if begin else {}) | ({"cursor": cursor} if cursor else {})
        got = request(f"{config['url']}/{paths[entity]}?{urllib.parse.urlencode(asked)}", config.get("token", ""), interval=pace(config))
        return got["items"], got.get("cursor")

    def newest(config: Config, entity: str) -> dt.datetime | None:
        return parse_time(request(f"{config['url']}/{paths[entity]}/newest", config.get("token", ""), interval=pace(config)).get("updated_at"))

    return Pages(name, entities, fetch, newest)
