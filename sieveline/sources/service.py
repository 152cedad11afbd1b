"""Services as a Spark data source: a table of answers to a table of requests, asked in parallel by the executors.

`fetch` names a function "module:function" that takes one request (a dict) and the options, and returns the answer's text;
what it raises is reported in the row. A remote client, a replayed folder or a rule can stand behind it alike.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "request string, payload string, error string"


class _Part(InputPartition):
    def __init__(self, requests: list[dict]) -> None:
        self.requests = requests


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[_Part]:
        requests, size = json.loads(self.options["requests"]), int(self.options.get("batch", 16))
        return [_Part(requests[at : at + size]) for at in range(0, len(requests), size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        module, name = self.options["fetch"].split(":")
        fetch = getattr(importlib.import_module(module), name)
        for request in partition.requests:
            try:
                payload, error = fetch(request, self.options), None
            except Exception as e:  # reported with its request
                payload, error = None, f"{type(e).__name__}: {e}"
            yield json.dumps(request, sort_keys=True), payload, error


class ServiceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "service_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


class Reported(RuntimeError):
    """An error whose text alone is told."""


def replayed(request: dict, options: dict) -> str | None:
    """The stored answer in the request's own row: its payload, or the error that it reports."""
    if request.get("reports"):
        raise Reported(request["reports"])
    return request.get("payload")


def ask_all(requests: DataFrame, fetch: str, keep: list[str], tasks: int = 8, at_once: int = 5, attempts: int = 2, wait: float = 0.0, **options: str) -> DataFrame:
    """requests' columns `keep` with payload, error and attempts, one row for each request of a table of any size.

    `fetch` gets each row as a dict, without its nulls. No more than tasks x at_once requests are under way; what fails is tried
    again, `attempts` times in all with a growing wait, and then becomes its row's error. A task takes Arrow batches from its
    share of the table and holds the answers of one batch. Rows keep their keys, so any order can be made again from them.
    Empty table: empty result.
    """
    schema = StructType([requests.schema[k] for k in keep]).add("payload", "string").add("error", "string").add("attempts", "integer")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, name = fetch.split(":")
        call = getattr(importlib.import_module(module), name)

        def one(text: str) -> tuple[str | None, str | None, int]:
            request = json.loads(text)
            for n in range(1, attempts + 1):
                try:
                    return call(request, options), None, n
                except Exception as e:  # reported with its request
                    error = str(e) if isinstance(e, Reported) else f"{type(e).__name__}: {e}"
                    if n < attempts:
                        time.sleep(wait * 2 ** (n - 1))
            return None, error, attempts

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                found = list(pool.map(one, batch.column("request_").to_pylist()))
                answers = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(k).cast(arrow.field(k).type) for k in keep] + answers, schema=arrow)

    return requests.select(*keep, F.to_json(F.struct("*")).alias("request_")).repartition(tasks).mapInArrow(run, schema)


def ask(spark: SparkSession, fetch: str, requests: list[dict], **options: str) -> DataFrame:
    """(request, payload, error) of a bounded list of requests, such as one run's queries."""
    spark.dataSource.register(ServiceSource)
    return spark.read.format("service_answers").options(fetch=fetch, requests=json.dumps(requests), **options).load()
