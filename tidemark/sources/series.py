"""A Python data source for daily series, behind the same schema as the files.

Live collectors need a network; they plug in by subclassing :class:`SeriesReader`. The built-in one
makes a mean-reverting series from a seed and is for tests only.
"""

from __future__ import annotations

import datetime
import random
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class YearPartition(InputPartition):
    def __init__(self, year: int) -> None:
        self.year = year


class SeriesReader(DataSourceReader):
    """One partition a year; a year starts from its own seed, so partitions do not depend on each other."""

    def __init__(self, options: dict) -> None:
        self.name = options.get("series", "series")
        self.first, self.last = int(options.get("first", 2020)), int(options.get("last", 2020))
        self.seed = int(options.get("seed", 0))

    def partitions(self) -> list[InputPartition]:
        return [YearPartition(y) for y in range(self.first, self.last + 1)]

    def read(self, partition: YearPartition) -> Iterator[tuple]:
        rng = random.Random(self.seed * 10_000 + partition.year)
        day, value = datetime.date(partition.year, 1, 1), 18.0
        while day.year == partition.year:
            value = max(9.0, value + 0.1 * (18.0 - value) + rng.gauss(0, 1))
            yield (self.name, day, value)
            day += datetime.timedelta(days=1)


class DailySeries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "daily_series"

    def schema(self) -> str:
        return "series string, date date, value double"

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader(self.options)
