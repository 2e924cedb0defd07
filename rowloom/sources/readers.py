"""Sources: delimited files, API-shaped records, SQL text, and any format that Spark reads."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.params import BoundQuery, Context, register_step, typed_filters
from .pages import PagedClient

_SOURCES: dict[str, Callable] = {}


def register_source(name: str):
    """Add a client: the function takes (spark, **resolved options) and returns an object with the methods to call."""

    def add(fn):
        _SOURCES[name] = fn
        return fn

    return add


def read_config(path: str) -> dict:
    """A YAML or JSON file as a dict; errors are raised."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def find_config(root: str, module: str, namespace: str, name: str) -> str:
    path = Path(root) / module / namespace / name
    if not path.is_file():
        raise FileNotFoundError(f"no configuration {path}")
    return str(path)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Comma, quotes doubled, a header; every value text, an empty cell an empty text. Cells of short rows are also
    empty texts. Files may hold line breaks in quotes, so each is read by one task; ``multiLine=False`` lets large
    ones be split where there are none."""
    df = spark.read.options(**{"header": True, "inferSchema": False, "multiLine": True, "quote": '"', "escape": '"', **options}).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def from_records(spark: SparkSession, records: Iterable[dict], schema: str | T.StructType | None = None) -> DataFrame:
    """Dict records held by the driver (fixtures, one API page; not for bulk data) as a DataFrame; mixed scalars of one
    key become text. ``_seq`` carries their order."""
    lines = [(i, json.dumps(r)) for i, r in enumerate(records)]
    raw = spark.createDataFrame(lines, "_seq long, line string")
    schema = schema or spark.read.json(spark.createDataFrame([(x,) for _, x in lines], "value string").rdd.map(lambda r: r[0])).schema
    return raw.select("_seq", F.from_json("line", schema).alias("r")).select("_seq", "r.*")


def _plain(kind: T.DataType) -> T.DataType:
    """A type found in VARIANTs with decimals as doubles, and text where kinds are mixed or only nulls occur."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, (T.DecimalType, T.FloatType)):
        return T.DoubleType()
    return T.StringType() if isinstance(kind, (T.VariantType, T.NullType)) else kind


def ragged_records(df: DataFrame, text: str, name: str = "record", schema: str | T.StructType | None = None) -> DataFrame:
    """``df`` with its column ``text`` of JSON objects as a VARIANT column ``name``, for apply_spec(record=name).

    A VARIANT keeps a missing key apart from a null. Which keys and types occur is told by ``schema``, or found in a
    pass over the texts (mixed scalars of one key become text), and travels in the column's metadata. Text that is no
    JSON gives a null record.
    """
    parsed = F.try_parse_json(F.col(f"`{text}`"))
    if schema is None:
        found = df.select(F.schema_of_variant_agg(parsed)).first()[0] or "OBJECT<>"
        schema = _plain(T.DataType.fromDDL(re.sub(r"\bOBJECT<", "STRUCT<", found)))
        schema = schema if isinstance(schema, T.StructType) else T.StructType([])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return df.withColumn(name, parsed.alias(name, metadata={"record": schema.json()})).drop(*([text] if text != name else []))


def flatten_batches(df: DataFrame, results: str = "results") -> DataFrame:
    """A stream of batches, each with an array of results, as one row per result with its fields as columns."""
    return df.select(F.explode(results).alias("__r")).select("__r.*")


_OPERATORS = {
    "=": lambda c, v: c == F.lit(v), "==": lambda c, v: c == F.lit(v), "EQUAL": lambda c, v: c == F.lit(v), "!=": lambda c, v: c != F.lit(v), "<>": lambda c, v: c != F.lit(v),
    "<": lambda c, v: c < F.lit(v), "<=": lambda c, v: c <= F.lit(v), ">": lambda c, v: c > F.lit(v), ">=": lambda c, v: c >= F.lit(v),
    "IN": lambda c, v: c.isin(list(v)), "NOT IN": lambda c, v: ~c.isin(list(v)), "LIKE": lambda c, v: c.like(v), "CONTAIN": lambda c, v: c.contains(v),
}


def conditions(filters: list[dict] | str) -> Column:
    """Filters as dicts of key, operator and value (in this order, whatever their names), or JSON text of them, as one
    Column."""
    out = F.lit(True)
    filters = json.loads(filters) if isinstance(filters, str) else filters
    for key, operator, value in (tuple(f.values()) for f in filters):
        if operator.upper() not in _OPERATORS:
            raise ValueError(f"operator {operator!r} has no column form")
        out = out & _OPERATORS[operator.upper()](F.col(key), value)
    return out


def filter_columns(node: dict, inputs: dict | None = None) -> Column:
    """A filter or sql_filter node as one Column; parameters that are left out drop their condition.

    Values are typed literals, never text spliced into SQL. Operators: = == != <> < <= > >= IN, NOT IN, LIKE, CONTAIN.
    """
    return conditions([{"key": k, "operator": o, "value": v} for k, o, v in typed_filters(node, Context(inputs))])


class SqlClient:
    """A client whose method runs built query text over the session's tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def search(self, query: str | BoundQuery) -> DataFrame:
        return self.spark.sql(query.text, args=query.args) if isinstance(query, BoundQuery) else self.spark.sql(query)


class TableClient:
    """A client over any Spark format: projection, filter and limit are pushed to the source."""

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet", **options):
        self.df = spark.read.format(format).options(**options).load(path)

    @classmethod
    def over(cls, df: DataFrame) -> TableClient:
        out = cls.__new__(cls)
        out.df = df
        return out

    def get(self, fields: list[str] | None = None, where: Column | list[dict] | None = None, limit: int | None = None) -> DataFrame:
        """``where``: a Column, or what a ``filter`` node of a configuration gives."""
        if where is not None and not isinstance(where, Column):
            where = conditions(where)
        df = self.df if where is None else self.df.where(where)
        df = df if fields is None else df.select(*fields)
        return df if limit is None else df.limit(limit)


class TableSession:
    """An authorised session over a folder of tables: it gives the paths, and would hold a token for a source that asks."""

    def __init__(self, root: str, token: str | None = None):
        self.root, self._token = root.rstrip("/"), token

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"


register_step("table_session")(TableSession)
register_source("sql")(SqlClient)
register_source("table")(TableClient)
register_source("pages")(PagedClient)


def connect(spark: SparkSession, name: str, **options):
    if name not in _SOURCES:
        raise KeyError(f"no registered source {name!r}")
    return _SOURCES[name](spark, **options)


def authorize(config: dict, inputs: dict | None = None) -> Any:
    """The session that an authorization configuration's ``initializer`` makes of the given credentials."""
    from ..functions.params import evaluate

    return evaluate(config["initializer"], inputs)


def open_client(spark: SparkSession, config: dict, inputs: dict | None = None, config_root: str | None = None) -> Any:
    """The source that a connector configuration names under ``client``.

    With ``authorization`` (namespace, config_name) its session is made first, from the file of that name under
    config_root/authorization/namespace; options reach it by ``from_authorizer`` nodes. Credentials stay on the driver.
    """
    from ..functions.params import evaluate

    session = None
    if auth := config.get("authorization"):
        session = authorize(read_config(find_config(config_root, "authorization", auth["namespace"], auth["config_name"])), inputs)
    options = {k: evaluate(v, inputs, session) for k, v in (config["client"].get("options") or {}).items()}
    return connect(spark, config["client"]["source"], **options)


def dispatch(client, config: dict, inputs: dict | None = None) -> DataFrame:
    """Evaluate ``arguments``, call the client's ``method`` with them, and flatten batches where ``post_processor``
    is set."""
    from ..functions.params import evaluate

    rows = getattr(client, config["method"])(**(evaluate(config.get("arguments"), inputs) or {}))
    post = config.get("post_processor")
    return flatten_batches(rows, post.get("results", "results") if isinstance(post, dict) else "results") if post else rows
