"""Field transforms compiled to Columns. Everything stays in the JVM but the two opt-in exact forms at the end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import any_date, read_date, write_date
from .predicates import is_in, predicate, same_kind, truthy

@dataclass(frozen=True)
class Options:
    """What differs between the documented behaviours.

    intended: nested ``then`` transforms see the whole row (else only the value the condition looked at).
    exact: round as decimal text does (half to even on the binary value), by a pandas UDF.
    text_of_null: ``string`` gives 'None' for null. on_error: 'fail', or 'null' for values that do not convert.
    reasons: compile to why a value does not convert (null where it does) instead of the value itself.
    """

    intended: bool = False
    exact: bool = False
    text_of_null: bool = False
    on_error: str = "fail"
    reasons: bool = False


def number(c: Column, t: T.DataType, o: Options, to: str = "double") -> Column:
    if isinstance(t, T.StringType):
        c = F.trim(c)
        c = F.when(F.contains(c, F.lit("_")), F.regexp_replace(c, r"(?<=\d)_(?=\d)", "")).otherwise(c)
    return c.try_cast(to) if o.on_error == "null" else c.cast(to)


def rounded(c: Column, digits: int, o: Options) -> Column:
    if o.exact:
        return exact_round(c, F.lit(digits))
    scale = float(10**digits)
    return F.round(c * scale) / scale


def date(c: Column, params: dict, o: Options) -> Column:
    wall, offset = read_date(c, params["format"]["input"], o.on_error != "null")
    return write_date(wall, params["format"]["output"], offset)


def loose_date(c: Column, params: dict, o: Options) -> Column:
    """The date as written: a zone is dropped, not applied."""
    value = any_date(c)
    if params.get("fuzzy"):
        value = F.coalesce(value, fuzzy_date(c).try_cast("date"))
    if o.on_error != "null":
        value = F.when(c.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit("not a date: "), c)).cast("date")).otherwise(value)
    return write_date(value.cast("timestamp_ntz"), params["format"]["output"])


def alike(values: list[Any]) -> list[Any]:
    """Results of one field, brought to one type: numbers to floats where one is a float, text and anything else to text."""
    kinds = {type(v) for v in values if v is not None}
    if len(kinds) <= 1:
        return values
    if kinds <= {int, float}:
        return [v if v is None else float(v) for v in values]
    return [v if v is None else str(v) for v in values]


def mapping_of(params: dict) -> dict:
    return params.get("mappings", params.get("mapping"))


def is_strict(params: dict) -> bool:
    return "on_error" not in params and "default" not in params


def enum_miss(c: Column, params: dict, o: Options, rest: Any) -> Column:
    """What a value without a mapping gives."""
    if is_strict(params) and o.on_error != "null":
        return F.raise_error(F.concat(F.lit("no mapping for "), F.coalesce(c.cast("string"), F.lit("null"))))
    return F.lit(rest)


def enum(c: Column, t: T.DataType, params: dict, o: Options) -> Column:
    """A value's mapping. Text keys meet text only, numbers and booleans each other (1, 1.0 and true are one key)."""
    if "joined" in params:
        value, hit = params["joined"]
        return F.when(hit, value).otherwise(enum_miss(c, params, o, params.get("on_error", params.get("default"))))
    table = mapping_of(params)
    keys, rest = list(table), params.get("on_error", params.get("default"))
    *results, rest = alike([*table.values(), rest])
    missed = enum_miss(c, params, o, rest)
    plain = {k: v for k, v in zip(keys, results, strict=True) if k is not None and same_kind(k, t) and isinstance(t, T.AtomicType)}
    if len(plain) > 50:
        whole = isinstance(t, T.IntegralType)
        plain = {(k if isinstance(k, str) else int(k) if whole else float(k)): v for k, v in plain.items() if not (whole and k != int(k))}
        wide = c if isinstance(t, T.StringType) else c.cast("bigint" if whole else "double")
        found = F.create_map(*[x for k, v in plain.items() for x in (F.lit(k).cast("bigint") if whole else F.lit(k), F.lit(v))])
        out = F.when(F.map_contains_key(found, wide), F.element_at(found, wide)).otherwise(missed)
    else:
        out = None
        for k, v in plain.items():
            test = is_in(c, t, [k])
            out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
        out = missed if out is None else out.otherwise(missed)
    return F.when(c.isNull(), F.lit(results[keys.index(None)])).otherwise(out) if None in table else out


def ratio(scope, params: dict, o: Options) -> Column:
    """num / den; missing and null count as 0, text that is no number gives the default, as does den <= 0."""

    def side(name):
        if not scope.has(name):
            return F.lit(0.0)
        return F.when(scope.col(name).isNull(), F.lit(0.0)).otherwise(F.trim(scope.col(name).cast("string")).try_cast("double"))

    den = side(params["denominator"])
    value = rounded(side(params["numerator"]) / F.when(den > 0, den) * F.lit(float(params.get("multiply_by", 1))), params.get("precision", 2), o)
    return F.coalesce(value, F.lit(float(params.get("default", 0.0))))


def then(spec: Any, scope, matched: str | None, o: Options) -> Column:
    """A scalar as it is; a transform on its own ``field``, or on the field the condition looked at."""
    if not isinstance(spec, dict):
        return no_reason() if o.reasons else F.lit(spec)
    if spec["type"] in ("case", "ratio"):
        if spec["type"] == "case" and not o.intended:
            # only the matched value is in reach, so conditions on other fields cannot hold
            return no_reason() if o.reasons else F.lit(spec.get("default"))
        return transform(spec, scope, None, o)
    return transform(spec, scope, spec.get("field", matched), o)


def case(scope, params: dict, o: Options) -> Column:
    out = None
    for item in params["cases"]:
        test = predicate(item["when"], scope, item["when"].get("field"))
        if test is not None:
            value = then(item["then"], scope, item["when"].get("field"), o)
            out = F.when(test, value) if out is None else out.when(test, value)
    rest = no_reason() if o.reasons else F.lit(params.get("default"))
    return rest if out is None else out.otherwise(rest)


def decimal(c: Column, params: dict, o: Options) -> Column:
    return rounded(c, params["precision"], o) if "precision" in params else c


# name -> (params, column, type, options) -> Column, for transforms of one value
ONE: dict[str, Callable] = {
    "date": lambda p, c, t, o: date(c, p, o),
    "date_parser": lambda p, c, t, o: loose_date(c, p, o),
    "float": lambda p, c, t, o: decimal(number(c, t, o) / float(p["divide_by"]) if "divide_by" in p else number(c, t, o), p, o),
    "integer": lambda p, c, t, o: number(c, t, o, p.get("output_type", "bigint")),
    "bool": lambda p, c, t, o: truthy(c, t),
    "string": lambda p, c, t, o: F.coalesce(c.cast("string"), F.lit("None")) if o.text_of_null else c.cast("string"),
    "enum": lambda p, c, t, o: enum(c, t, p, o),
    "currency": lambda p, c, t, o: rounded(number(c, t, o) * float(1e-6 if p.get("from_micros") else p.get("multiplier", 1)), p.get("rounding", p.get("precision", 2)), o),
    "lowercase": lambda p, c, t, o: F.lower(c),
    "email": lambda p, c, t, o: F.when(c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), c),
    "phone": lambda p, c, t, o: F.when(F.regexp_replace(c, r"[\s().-]", "").rlike(r"^\+?[0-9]{7,15}$"), F.regexp_replace(c, r"[\s().-]", "")),
}
ONE["boolean"] = ONE["bool"]


def register_transform(name: str, build: Callable[[dict], Callable[[Column], Column]]) -> None:
    """Add a transform: ``build(params)`` gives a function from Column to Column."""
    ONE[name] = lambda p, c, t, o: build(p)(c)


def register_python_transform(name: str, returns: str, build: Callable[[dict], Callable[[pa.Array], pa.Array]]) -> None:
    """Add a transform in Python: ``build(params)`` gives a function from an Arrow array to one of as many values, of type
    ``returns``. It is called for a batch of values at a time; a Column builder (register_transform) is faster still."""

    def column(p, c, t, o):
        fn = build(p)

        def run(values: pa.Array) -> pa.Array:
            return fn(values)

        return F.arrow_udf(run, returns)(c)

    ONE[name] = column


# name -> (schema, function of a record batch), for rows that become several
FLAT_MAPS: dict[str, tuple[str, Callable[[pa.RecordBatch], pa.RecordBatch]]] = {}


def register_flat_map(name: str, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> None:
    """Add a flat-map in Python: ``fn`` takes a batch of rows and gives the rows made of them, with the columns of
    ``schema`` and before them ``row``, the place in the batch of the row that each comes from."""
    FLAT_MAPS[name] = (schema, fn)


def formula(text: str, scope) -> Column:
    """Arithmetic over fields: names, numbers, + - * / and brackets; anything else is refused."""
    import re

    parts = re.findall(r"\s*([A-Za-z_]\w*|\d+(?:\.\d+)?|[-+*/()])", text)
    if "".join(parts) != re.sub(r"\s", "", text):
        raise ValueError(f"not a formula: {text!r}")
    at = 0

    def take():
        nonlocal at
        at += 1
        return parts[at - 1]

    def atom():
        x = take()
        if x == "(":
            out = add()
            if take() != ")":
                raise ValueError(f"unbalanced formula: {text!r}")
            return out
        if x == "-":
            return -atom()
        return F.lit(float(x)) if x[0].isdigit() else scope.col(x).cast("double")

    def chain(below, ops):
        def parse():
            out = below()
            while at < len(parts) and parts[at] in ops:
                op, right = take(), below()
                out = {"+": lambda: out + right, "-": lambda: out - right, "*": lambda: out * right, "/": lambda: out / F.nullif(right, F.lit(0.0))}[op]()
            return out

        return parse

    mul = chain(atom, "*/")
    add = chain(mul, "+-")
    out = add()
    if at != len(parts):
        raise ValueError(f"not a formula: {text!r}")
    return out


def transform(spec: dict, scope, field: str | None, o: Options) -> Column:
    """One transform over ``field`` of the scope (``case``, ``ratio``, ``percentage`` and ``formula`` take the row)."""
    kind = spec["type"]
    if o.reasons and kind != "case":
        return reason(spec, scope, field, o)
    if kind == "constant":
        out = F.lit(spec["value"])
    elif kind == "case":
        out = case(scope, spec, o)
    elif kind == "ratio":
        out = ratio(scope, spec, o)
    elif kind == "percentage":
        out = ratio(scope, {"multiply_by": 100, **spec}, o)
    elif kind == "formula":
        out = formula(spec["expression"], scope)
        out = rounded(out, spec["precision"], o) if "precision" in spec else out
    elif kind not in ONE:
        raise KeyError(f"unknown transform {kind!r}")
    elif field is None or not scope.has(field):
        return F.lit(None)
    else:
        out = scope.where_present(field, ONE[kind](spec, scope.col(field), scope.type(field), o))
    return out.cast(spec["output_type"]) if "output_type" in spec and kind != "integer" else out


#: Transforms whose values may fail to convert.
FALLIBLE = ("date", "date_parser", "float", "integer", "enum", "currency")


def no_reason() -> Column:
    return F.lit(None).cast("string")


def reason(spec: dict, scope, field: str | None, o: Options) -> Column:
    """``<transform>: <value>`` where a value that is there does not convert, else null."""
    kind = spec["type"]
    if kind not in FALLIBLE or field is None or not scope.has(field):
        return no_reason()
    c, t = scope.col(field), scope.type(field)
    said = F.concat(F.lit(f"{kind}: "), c.cast("string"))
    if kind == "enum":
        if not is_strict(spec):
            return no_reason()
        if "joined" in spec:
            return F.when(c.isNotNull() & ~spec["joined"][1], said)
        hit = {k: True for k in mapping_of(spec)}
        return F.when(c.isNotNull() & ~F.coalesce(enum(c, t, {"mappings": hit, "on_error": False}, Options(on_error="null")), F.lit(False)), said)
    value = ONE[kind](spec, c, t, replace(o, reasons=False, exact=False, on_error="null"))
    return F.when(c.isNotNull() & value.isNull(), said)


@F.pandas_udf(T.DoubleType())
def exact_round(value: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if v != v or v is None else round(v, int(d)) for v, d in zip(value, digits, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def fuzzy_date(text: pd.Series) -> pd.Series:
    from dateutil import parser

    def one(t):
        try:
            return None if t is None else parser.parse(t).date().isoformat()
        except (ValueError, OverflowError):
            return None

    return text.map(one)
