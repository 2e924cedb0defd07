"""Predicates of ``when`` as Columns that are never null."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy(c: Column, t: T.DataType) -> Column:
    """Whether a value counts as true: not null, not zero, not empty."""
    if isinstance(t, T.BooleanType):
        test = c
    elif isinstance(t, T.NumericType):
        test = c != 0
    elif isinstance(t, T.StringType):
        test = F.length(c) > 0
    elif isinstance(t, (T.ArrayType, T.MapType)):
        test = F.size(c) > 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def same_kind(value: Any, t: T.DataType) -> bool:
    """Text compares with text columns only, numbers and booleans with theirs: '0' is not 0."""
    if isinstance(t, T.StringType):
        return isinstance(value, str)
    if isinstance(t, (T.NumericType, T.BooleanType)):
        return isinstance(value, (bool, int, float))
    return True


def _literal(value: Any, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType) and not isinstance(value, bool):
        return F.lit(bool(value)) if value in (0, 1) else F.lit(None).cast("boolean")
    return F.lit(int(value) if isinstance(value, bool) and isinstance(t, T.NumericType) else value)


def is_in(c: Column, t: T.DataType, values: list) -> Column:
    fit = [_literal(v, t) for v in values if v is not None and same_kind(v, t)]
    test = F.coalesce(c.isin(*fit), F.lit(False)) if fit else F.lit(False)
    return test | c.isNull() if None in values else test


def equal(c: Column, t: T.DataType, value: Any) -> Column:
    return c.isNull() if value is None else is_in(c, t, [value])


def compare(c: Column, t: T.DataType, value: Any, more: bool) -> Column:
    if not same_kind(value, t):
        raise TypeError(f"cannot order {t.simpleString()} against {value!r}")
    test = (c > F.lit(value)) if more else (c < F.lit(value))
    return truthy(c, t) & F.coalesce(test, F.lit(False))


OPERATORS = {
    "greater_than": lambda c, t, v: compare(c, t, v, True),
    "less_than": lambda c, t, v: compare(c, t, v, False),
    "equal": equal,
    "equals": equal,
    "not_equal": lambda c, t, v: ~equal(c, t, v),
    "in": is_in,
    "not_in": lambda c, t, v: ~is_in(c, t, v),
    "null": lambda c, t, v: c.isNull(),
    "not_null": lambda c, t, v: c.isNotNull(),
}


def predicate(when: dict, scope, field: str | None) -> Column | None:
    """The Column of one ``when``; None if its field is absent. ``and``/``or`` hold lists of further ones (an absent
    field counts as false there)."""
    for word, join in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if word in when:
            parts = [predicate(w, scope, when.get("field", field)) for w in when[word]]
            out = None
            for p in parts:
                p = F.lit(False) if p is None else p
                out = p if out is None else join(out, p)
            return out
    name = when.get("field", field)
    ops = [k for k in when if k != "field"]
    if len(ops) != 1 or ops[0] not in OPERATORS:
        raise ValueError(f"exactly one known operator is needed in {when!r}")
    if name is None:
        raise KeyError("a condition needs a field")
    if not scope.has(name):
        return None
    test = OPERATORS[ops[0]](scope.col(name), scope.type(name), when[ops[0]])
    there = scope.present(name)
    return test if there is None else there & test
