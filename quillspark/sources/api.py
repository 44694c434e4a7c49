"""Paged services as batch data sources: keys dealt over partitions, an injected transport, bounded retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A transport takes (key, cursor) and gives (status, rows, next cursor or None).
Transport = Callable[[str, object], tuple[int, list[tuple], object]]


@dataclass
class Paging:
    max_pages: int = 50
    max_retries: int = 5
    pause: float = 0.0
    backoff: float = 0.5
    longest: float = 30.0
    retry_on: tuple[int, ...] = (429, 500, 502, 503, 504)
    start: object = None
    partitions: int = 16


def pages(key: str, transport: Transport, paging: Paging) -> Iterator[tuple[list[tuple], str | None]]:
    """(rows, error) page by page. Retries count towards a bound; pages before an error stay."""
    cursor = paging.start
    for _ in range(paging.max_pages):
        for attempt in range(paging.max_retries + 1):
            try:
                status, rows, after = transport(key, cursor)
            except Exception as e:  # noqa: BLE001 - the row carries it
                status, rows, after, text = 0, [], None, str(e) or type(e).__name__
            else:
                text = f"HTTP {status}"
            if status not in paging.retry_on or attempt == paging.max_retries:
                break
            time.sleep(min(paging.longest, paging.backoff * 2**attempt))
        if status != 200:
            yield [], text
            return
        yield rows, None
        if after is None or after == cursor or not rows:  # a page that points to itself would come again for ever
            return
        cursor = after
        if paging.pause:
            time.sleep(paging.pause)
    yield [], f"more than {paging.max_pages} pages"


def read_keys(keys: DataFrame, schema: str, transport: Transport, paging: Paging | None = None) -> DataFrame:
    """``key, error`` and the schema's columns for each distinct value of the first column of ``keys``, which stays distributed."""
    paging = paging or Paging()
    key = keys.columns[0]
    width = len([p for p in schema.split(",") if p.strip()])
    names = ["key", "error", *(p.split()[0] for p in schema.split(",") if p.strip())]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in pdf["key"]:
                for rows, error in pages(k, transport, paging):
                    got = [(k, None, *r) for r in rows] + ([(k, error, *(None,) * width)] if error is not None else [])
                    yield pd.DataFrame(got, columns=names, dtype=object)

    asked = keys.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct()
    return asked.repartition(paging.partitions, "key").mapInPandas(run, f"key string, error string, {schema}")


def register(spark: SparkSession, name: str, schema: str, transport: Transport, paging: Paging | None = None) -> None:
    """Make ``spark.read.format(name).option("keys", "a\\nb")`` read ``key, error`` and the schema's columns."""
    paging = paging or Paging()
    width = len([p for p in schema.split(",") if p.strip()])

    class Reader(DataSourceReader):
        def __init__(self, keys: list[str]):
            self.keys = keys

        def partitions(self) -> list[InputPartition]:
            n = min(len(self.keys), paging.partitions)
            return [InputPartition(self.keys[i::n]) for i in range(n)] or [InputPartition([])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for key in partition.value:
                for rows, error in pages(key, transport, paging):
                    if error is not None:
                        yield (key, error, *(None,) * width)
                    for r in rows:
                        yield (key, None, *r)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"key string, error string, {schema}"

        def reader(self, schema) -> DataSourceReader:
            return Reader([k for k in self.options.get("keys", "").split("\n") if k])

    spark.dataSource.register(Source)


def read(spark: SparkSession, name: str, keys: list[str]) -> DataFrame:
    return spark.read.format(name).option("keys", "\n".join(dict.fromkeys(keys))).load()
