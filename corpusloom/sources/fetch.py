"""Fetching documents over HTTP as a Python data source; transport and page reader are given by the user."""

from __future__ import annotations

from collections.abc import Callable
from http.client import HTTPException

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BROWSER_HEADERS = {"User-Agent": "Mozilla/5.0", "Accept": "application/pdf,*/*"}


class Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def fetched(url: str, get: Callable[[str, dict], bytes]) -> tuple[bytes | None, bool]:
    """Content of a plain request, else of one with browser headers; and whether both failed."""
    for headers in ({}, BROWSER_HEADERS):
        try:
            return get(url, headers), False
        except (OSError, HTTPException):  # refused, timed out, or a body cut short
            continue
    return None, True


def default_get(url: str, headers: dict) -> bytes:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=headers), timeout=30) as answer:
        return answer.read()


class HttpDocuments(DataSource):
    """`spark.read.format("http_documents").option("urls", "u1 u2 ...")`: `url, content, failed`."""

    get: Callable[[str, dict], bytes] = staticmethod(default_get)

    @classmethod
    def name(cls) -> str:
        return "http_documents"

    def schema(self) -> str:
        return "url string, content binary, failed boolean"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options, type(self).get)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict, get: Callable):
        self.urls = options.get("urls", "").split()
        self.each = int(options.get("urlsPerTask", "16"))
        self.get = get

    def partitions(self):
        return [Urls(self.urls[i : i + self.each]) for i in range(0, len(self.urls), self.each)] or [Urls([])]

    def read(self, partition: Urls):
        for url in partition.urls:
            content, failed = fetched(url, self.get)
            yield url, content, failed
