"""Other systems as backends: a client becomes a Spark data source with partitions and pushed equality filters; a search goes to several backends, and
one that fails is a row of the report while the others answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..functions.shipping import ship
from ..functions.workspace import written
from ..operators import retrieval

HITS = ["query_id", "chunk_id", "distance"]


class Client(Protocol):
    """What a backend must offer. It is sent to the executors, so it opens its connection when it is asked to read."""

    def partitions(self, options: dict[str, str]) -> list[Any]:
        """Parts that can be read apart from each other: shards, namespaces, ranges of ids."""

    def read(self, options: dict[str, str], part: Any, equal: dict[str, Any]) -> Iterator[tuple]:
        """Rows of a part, in the order of the schema, whose columns have the values in equal."""


def source_of(name: str, schema: str, client: Client) -> type[DataSource]:
    """A data source for spark.read.format(name) over a client."""

    class Part(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options, self.equal = options, {}

        def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
            for f in filters:
                # one value a column is handed to the client; Spark applies the others
                if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] not in self.equal:
                    self.equal[f.attribute[0]] = f.value
                else:
                    yield f

        def partitions(self) -> list[InputPartition]:
            return [Part(p) for p in client.partitions(self.options)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return client.read(self.options, partition.value, self.equal)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return Source


def register(spark: SparkSession, name: str, schema: str, client: Client) -> None:
    """Makes a client readable as spark.read.format(name), with equality filters pushed to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source_of(name, schema, client))


def fan_out(queries: DataFrame, backends: dict[str, Callable[[DataFrame], DataFrame]], n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, chunk_id, backend, distance, place), the n nearest of all backends, and a report (backend, ok, hits, error) with a row for each.

    A backend maps queries to hits (query_id, chunk_id, distance), its own n nearest. Each is asked in a job of its own and its hits are written, so
    that one which fails, while it is planned or while it runs, leaves the others' hits whole. Without any answer there are no hits.
    """
    spark, parts, report = queries.sparkSession, [], []
    kind = queries.schema["query_id"].dataType.simpleString()
    for name, search in backends.items():
        try:
            hits = written(search(queries).select(*HITS), "backend").withColumn("backend", F.lit(name))
            report.append((name, True, hits.count(), None))
            parts.append(hits)
        except Exception as e:  # whatever a backend does, the others answer
            report.append((name, False, 0, next((x for x in reversed(str(e).strip().splitlines()) if x.strip()), type(e).__name__)[:500]))
    none = spark.createDataFrame([], f"query_id {kind}, chunk_id string, distance double, backend string")
    merged = retrieval.merge_backends(parts or [none], n)
    return merged.select("query_id", "chunk_id", "backend", "distance", "place"), spark.createDataFrame(report, "backend string, ok boolean, hits bigint, error string")
