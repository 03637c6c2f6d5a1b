"""A data source of filing archives: submission lists and documents, fetched one after another at a polite pace.

    spark.dataSource.register(Archive)
    spark.read.format("archive").option("contact", "me@example.org").option("names", "CIK0000000007.json").load(base)

One partition fetches all, since the pace holds for the caller as a whole. base is any URL prefix, file: included.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds between requests and until one is given up (fixed values).
INTERVAL_S, TIMEOUT_S = 0.15, 30.0


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "name string, status int, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.base = options.get("path", "").rstrip("/")
        self.names = [n.strip() for n in options.get("names", "").split(",") if n.strip()]
        self.contact = options.get("contact", "")
        self.interval = float(options.get("interval", INTERVAL_S))
        if "@" not in self.contact:
            raise ValueError("the archive asks for a contact address: option contact")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name in self.names:
            time.sleep(self.interval)
            asked = urllib.request.Request(f"{self.base}/{name}", headers={"User-Agent": self.contact})
            try:
                with urllib.request.urlopen(asked, timeout=TIMEOUT_S) as got:
                    yield name, getattr(got, "status", None) or 200, got.read()
            except urllib.error.HTTPError as e:
                yield name, e.code, None
            except urllib.error.URLError:
                yield name, None, None
