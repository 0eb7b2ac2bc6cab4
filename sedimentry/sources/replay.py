"""A REST source as a Python data source: predicates become query parameters, requests are retried with growing waits.

Without a network it replays responses captured in a folder, one JSON file per endpoint and parameter set, so jobs and
tests run anywhere; with base_url it asks a server.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from urllib import error, parse, request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def with_retries(call: Callable[[], bytes], attempts: int = 3, first_wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """Only time-outs are tried again; any other failure is raised at once."""
    for n in range(attempts):
        try:
            return call()
        except TimeoutError:
            if n + 1 == attempts:
                raise
            sleep(first_wait * 2**n)
    raise ValueError("attempts must be positive")


def fetch(base_url: str, endpoint: str, params: dict[str, str], timeout: float = 60.0) -> bytes:
    url = f"{base_url.rstrip('/')}/{endpoint}?{parse.urlencode(sorted(params.items()))}"

    def call() -> bytes:
        try:
            with request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
                return answer.read()
        except error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise e.reason from e
            raise

    return with_retries(call)


class Page(InputPartition):
    def __init__(self, params: dict[str, str]):
        self.params = params


class RestReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.options = [f.name for f in schema.fields], dict(options)

    def partitions(self):
        """One partition per value of the split parameter, e.g. one per driver."""
        fixed = {k[6:]: v for k, v in self.options.items() if k.startswith("param.")}
        split = self.options.get("split")
        values = self.options.get("values", "").split(",")
        return [Page(fixed | {split: v.strip()}) for v in values] if split else [Page(fixed)]

    def read(self, page):
        endpoint = self.options["endpoint"]
        if "base_url" in self.options:
            body = fetch(self.options["base_url"], endpoint, page.params)
        else:
            suffix = "".join(f"__{k}-{v}" for k, v in sorted(page.params.items()))
            with open(f"{self.options['folder']}/{endpoint}{suffix}.json", "rb") as f:
                body = f.read()
        found = json.loads(body)
        for row in found if isinstance(found, list) else [found]:
            yield tuple(row.get(n) for n in self.names)


class RestSource(DataSource):
    """spark.dataSource.register(RestSource); spark.read.format("rest_replay").schema(...).option("endpoint", ...)."""

    @classmethod
    def name(cls):
        return "rest_replay"

    def schema(self):
        return self.options["columns"]

    def reader(self, schema):
        return RestReader(schema, self.options)
