"""Paged JSON as a Spark data source: one partition for each page, filters applied by the reader."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Readers travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of an Arrow batch.
BATCH = 10_000
_TESTS: dict[type, Callable] = {
    D.EqualTo: lambda v, x: v == x, D.GreaterThan: lambda v, x: v > x, D.GreaterThanOrEqual: lambda v, x: v >= x, D.LessThan: lambda v, x: v < x, D.LessThanOrEqual: lambda v, x: v <= x,
    D.In: lambda v, x: v in x, D.StringStartsWith: lambda v, x: v.startswith(x), D.StringContains: lambda v, x: x in v,
}


class Page(D.InputPartition):
    def __init__(self, path: str):
        self.path = path


class PageReader(D.DataSourceReader):
    """Reads the pages of a folder; a page is a JSON object with its records under ``results``."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.results = schema, options.get("results", "results")
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.held: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Take the comparisons of one field with a value; Spark applies the others."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1:
                self.held.append((type(f).__name__, f.attribute[0], f.value))
            elif not isinstance(f, D.IsNotNull):
                yield f
            else:
                self.held.append(("IsNotNull", f.attribute[0], None))

    def partitions(self) -> list[Page]:
        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names if not n.startswith(("_", ".")))
        return [Page(p) for p in found] or [Page("")]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        tests = {k.__name__: f for k, f in _TESTS.items()}
        with open(partition.path) as f:
            rows = json.load(f)[self.results]
        kept = [r for r in rows if all(r.get(a) is not None and (k == "IsNotNull" or tests[k](r[a], x)) for k, a, x in self.held)]
        kind = to_arrow_schema(self.schema)
        for at in range(0, len(kept), BATCH):
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in kind.names} for r in kept[at : at + BATCH]], kind)


class PagedJson(D.DataSource):
    """``spark.read.format("paged_json").schema(...).load(folder)``; the option ``results`` names the records' key."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        raise ValueError("paged_json needs a schema")

    def reader(self, schema: T.StructType) -> PageReader:
        return PageReader(schema, dict(self.options))


class PagedClient:
    """A client over a folder of pages that every executor can open: fields and filters as TableClient."""

    def __init__(self, spark: SparkSession, path: str, schema: str, results: str = "results"):
        from .readers import TableClient

        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(PagedJson)
        self.get = TableClient.over(spark.read.format("paged_json").schema(schema).option("results", results).load(path)).get
