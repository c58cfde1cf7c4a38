"""A data source of numbered web pages: read at once in tasks, or as a stream whose offsets are pages done."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Fetch = Callable[[str], bytes | None]


def http_get(url: str, timeout: float = 15) -> bytes:
    """One page by HTTP."""
    with urlopen(url, timeout=timeout) as answer:  # noqa: S310 the caller names the site
        return answer.read()


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Site:
    """What both readers know: where pages are, how many there are, and how one is had."""

    def __init__(self, options: dict, fetch: Fetch):
        self.url, self.fetch = options["url"], fetch
        if "{page}" not in self.url:
            raise ValueError("the url has no {page}")
        self.pages, self.total, self.size = options.get("pages"), options.get("total"), int(options.get("size", 30))
        if not self.pages and not self.total:
            raise ValueError("give the number of pages, or a pattern of the total that page 1 states")
        self.per_task, self.tries = int(options.get("pagesPerTask", 20)), int(options.get("tries", 2))

    def content(self, page: int) -> bytes | None:
        for _ in range(self.tries):
            try:
                if (found := self.fetch(self.url.format(page=page))) is not None:
                    return found
            except Exception:  # noqa: BLE001 a page that cannot be had is a null, by contract
                continue
        return None

    def count(self) -> int:
        """Pages there are now: as given, or from the number of items that page 1 states; without that, none."""
        if self.pages:
            return int(self.pages)
        stated = re.search(self.total, (self.content(1) or b"").decode("utf-8", "replace"))
        return -(-int(stated[1]) // self.size) if stated else 0

    def dealt(self, first: int, last: int) -> list[Pages]:
        return [Pages(a, min(a + self.per_task - 1, last)) for a in range(first, last + 1, self.per_task)]

    def read(self, part: Pages) -> Iterator[tuple]:
        for page in range(part.first, part.last + 1):
            yield page, self.url.format(page=page), self.content(page)


class _Reader(DataSourceReader):
    def __init__(self, site: _Site):
        self.site = site

    def partitions(self) -> list[Pages]:
        return self.site.dealt(1, self.site.count()) or [Pages(1, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.site.read(partition)


class _StreamReader(DataSourceStreamReader):
    """An offset is how many pages are done. A restarted query first plans the last batch of its log, which tells where it stands."""

    def __init__(self, site: _Site, per_batch: int):
        self.site, self.per_batch, self.done = site, per_batch, 0

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": max(self.done, min(self.done + self.per_batch, self.site.count()))}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.done = max(self.done, end["pages"])
        return self.site.dealt(start["pages"] + 1, end["pages"]) or [Pages(1, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.site.read(partition)

    def commit(self, end: dict) -> None:
        pass


def paged_source(fetch: Fetch = http_get, named: str = "paged") -> type[DataSource]:
    """A data source to register: `spark.dataSource.register(paged_source())`, then `spark.read.format("paged")`.

    Rows are (page, url, content); content is null where fetch raises or gives None, `tries` times (2), and ends
    no job. Options: url with `{page}`; pages, or total (a pattern whose group is the number of items, in page 1)
    with size (30) items a page; pagesPerTask (20); as a stream also pagesPerBatch (100). fetch is called in the
    tasks, but for page 1 where its total is read. A stream asks for the total again before every batch, so pages
    that are added are read too; after a restart it goes on behind the last page of its log, and pages of
    finished batches are not fetched again.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return named

        def schema(self) -> str:
            return "page int, url string, content binary"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(_Site(self.options, fetch))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(_Site(self.options, fetch), int(self.options.get("pagesPerBatch", 100)))

    return Paged
