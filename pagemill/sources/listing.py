"""A listing that is served page by page, as a Python data source, with retries. What fetches a page is passed in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAMESPACES = (14, 12, 104, 100)
#: namespace, where to go on ('' at first) -> the decoded answer
Fetch = Callable[[int, str], dict]


def retrying(call: Callable, attempts: int = 51, most: float = 300, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried again after 1, 2, 4 ... seconds (``most`` at most) while it fails; the last failure is raised."""

    def tried(*args, **kwargs):
        wait = 1.0
        for left in range(attempts - 1, -1, -1):
            try:
                return call(*args, **kwargs)
            except Exception:
                if not left:
                    raise
            sleep(wait)
            wait = min(2 * wait, most)

    return tried


def titles_of(fetch: Fetch, namespace: int) -> Iterator[list[str]]:
    """The titles of a namespace, answer by answer, for as long as one says where to go on. One without pages ends it."""
    at = ""
    while True:
        answer = fetch(namespace, at)
        pages = (answer.get("query") or {}).get("allpages")
        if pages is None:
            return
        yield [p["title"].replace(" ", "_") for p in pages]
        if "continue" not in answer:
            return
        at = answer["continue"]["apcontinue"]


class _Namespaces(InputPartition):
    def __init__(self, namespaces: tuple[int, ...]):
        self.namespaces = namespaces


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, namespaces: tuple[int, ...], limit: int | None):
        self.fetch, self.namespaces, self.limit = fetch, namespaces, limit

    def partitions(self) -> list[InputPartition]:
        # a limit is shared by all namespaces, which then are read one after the other
        return [_Namespaces((n,)) for n in self.namespaces] if self.limit is None else [_Namespaces(self.namespaces)]

    def read(self, partition: _Namespaces) -> Iterator[tuple[str]]:
        left = self.limit
        for namespace in partition.namespaces:
            for titles in titles_of(self.fetch, namespace):
                yield from ((t,) for t in titles)
                if left is not None:
                    left -= len(titles)
                    if left <= 0:
                        break


def read_listing(spark: SparkSession, fetch: Fetch, namespaces: tuple[int, ...] = NAMESPACES, limit: int | None = None, attempts: int = 51) -> DataFrame:
    """(title) of all pages of some namespaces, a task for each. A ``limit`` is checked after whole answers, as is shared
    by the namespaces: once it is used up, each further one gives its first answer only."""
    tried = retrying(fetch, attempts)

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pagemill_listing"

        def schema(self) -> str:
            return "title string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(tried, tuple(namespaces), limit)

    spark.dataSource.register(Listing)
    return spark.read.format("pagemill_listing").load()
