"""Enums whose mapping is too large for a plan: a join with a table of it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import same_kind
from ..functions.transforms import alike, mapping_of

#: Entries from which on a mapping in a specification is joined instead of being a literal.
LARGE = 10_000
#: Bytes of keys and results up to which a table is broadcast; a larger one is joined by a shuffle on the key.
MOST_SENT = 64 << 20


def wants_join(transform: dict) -> bool:
    return transform.get("type") == "enum" and ("lookup" in transform or len(mapping_of(transform) or ()) > LARGE)


def lookup_table(spark: SparkSession, transform: dict, mapping: dict, kind: T.DataType) -> DataFrame | None:
    """(key, value) of an enum: from its mapping, or from ``lookup`` (path, format, key, value), a table that Spark reads.

    Keys are of the kind of the values they are to meet (None if no key is); of a table's rows with one key the least
    value counts.
    """
    text = isinstance(kind, T.StringType)
    if "lookup" in transform:
        at = transform["lookup"]
        rows = spark.read.format(at.get("format", "parquet")).load(at["path"]).select(F.col(f"`{at['key']}`").alias("key"), F.col(f"`{at['value']}`").alias("value"))
        if isinstance(rows.schema["key"].dataType, T.StringType) != text:
            return None
        return rows.where("key IS NOT NULL").groupBy("key").agg(F.min("value").alias("value"))
    fit = {k: v for k, v in mapping.items() if k is not None and same_kind(k, kind)}
    if not fit:
        return None
    keys = list(fit) if text else [float(k) for k in fit]
    return spark.createDataFrame(pa.table({"key": pa.array(keys), "value": pa.array(list(fit.values()))}))


def join_lookups(df: DataFrame, inline: tuple[dict, ...], source_of: Callable[[dict], tuple[Column, T.DataType] | None]) -> tuple[DataFrame, tuple[dict, ...]]:
    """``df`` with a result and a hit for every inline enum that wants a join, and the fields that read them.

    A table is measured before it is joined: up to MOST_SENT bytes it is broadcast and nothing of ``df`` moves; a larger
    one is never broadcast, whatever Spark's own estimate of it. Its keys are unique, so a key of many rows meets one
    row of the table and adaptive execution may split it.
    """
    out = []
    for i, f in enumerate(inline):
        source = source_of(f) if wants_join(f.get("transform") or {}) else None
        if source is None:
            out.append(f)
            continue
        c, kind = source
        t = dict(f["transform"])
        own, name = mapping_of(t) or {}, next((k for k in ("on_error", "default") if k in t), None)
        *results, rest = alike([*own.values(), t.get(name)])
        own = dict(zip(own, results, strict=True))
        table = lookup_table(df.sparkSession, t, own, kind)
        if name is not None:
            known = table is not None and isinstance(table.schema["value"].dataType, T.StringType)
            t[name] = str(rest) if known and rest is not None else rest
        hit, value = F.lit(False), F.lit(None)
        if table is not None:
            size = table.agg(F.sum(F.length(F.col("key").cast("string")) + F.coalesce(F.length(F.col("value").cast("string")), F.lit(0)) + 16)).first()[0] or 0
            key = c if isinstance(kind, T.StringType) else c.cast("double")
            named = table.select(F.col("key").alias(f"__key{i}"), F.col("value").alias(f"__value{i}"), F.lit(True).alias(f"__hit{i}"))
            df = df.join(F.broadcast(named) if size <= MOST_SENT else named.hint("merge"), key == F.col(f"__key{i}"), "left")
            hit, value = F.coalesce(F.col(f"__hit{i}"), F.lit(False)), F.col(f"__value{i}")
        if None in own:
            value, hit = F.when(c.isNull(), F.lit(own[None])).otherwise(value), hit | c.isNull()
        for k in ("mappings", "mapping", "lookup"):
            t.pop(k, None)
        out.append({**f, "transform": {**t, "joined": (value, hit)}})
    return df, tuple(out)
