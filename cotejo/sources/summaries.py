"""Daily summaries as a Spark data source: one day after the other, in one task, at a stated pace.

    spark.dataSource.register(DailySummaries)
    spark.read.format("daily_summaries").option("path", folder).option("first", "2031-01-01").option("last", "2031-01-31").load()

This reader takes a day's file from a folder, as a mirror keeps it. A day without a file has no bulletin and no row. An address outside the
allowed hosts, wherever it stands in a summary, is an error. One task reads all days: whoever serves them is asked at most once per `seconds`.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def addresses(node: object):
    """Every address under a key url_..., at any depth."""
    if isinstance(node, dict):
        for k, v in node.items():
            if re.match(r"url_", k) and isinstance(v, str):
                yield v
            else:
                yield from addresses(v)
    elif isinstance(node, list):
        for v in node:
            yield from addresses(v)


class DailySummaries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "daily_summaries"

    def schema(self) -> str:
        return "dia date, json string, esperado_s double"

    def reader(self, schema) -> DataSourceReader:
        return _Days(self.options)


class _Days(DataSourceReader):
    def __init__(self, options):
        self.path, self.hosts = options["path"].removeprefix("file://"), [h for h in options.get("hosts", "").split(",") if h]
        self.first, self.last = (dt.date.fromisoformat(options[k]) for k in ("first", "last"))
        self.seconds = float(options.get("seconds", "0"))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        asked = None
        for n in range((self.last - self.first).days + 1):
            day = self.first + dt.timedelta(days=n)
            waited = 0.0
            if asked is not None and self.seconds > 0:
                waited = max(0.0, asked + self.seconds - time.monotonic())
                time.sleep(waited)
            asked = time.monotonic()
            file = Path(self.path) / f"{day:%Y%m%d}.json"
            if file.exists():
                text = file.read_text()
                for url in addresses(json.loads(text)):
                    if self.hosts and urlsplit(url).hostname not in self.hosts:
                        raise ValueError(f"{day}: {url} is not of an allowed host")
                yield day, text, waited
