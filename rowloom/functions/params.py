"""The parameter language: typed configuration nodes evaluated on the driver (never per record)."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class _Ignore:
    """What an optional parameter evaluates to when it is to be left out of a filter."""

    def __repr__(self):
        return "IGNORE"

    def __bool__(self):
        return False


IGNORE = _Ignore()
_NODES: dict[str, Callable] = {}
_STEPS: dict[str, Callable] = {}


def register_node(name: str):
    """Add a node type: the function takes (node without its type, context) and returns the value."""

    def add(fn):
        _NODES[name] = fn
        return fn

    return add


def register_step(name: str):
    """Make a callable known to configuration under a name ('module.Class.method' or any other text).

    Configuration can call what is registered and nothing else: no import takes place from a file's text.
    """

    def add(fn):
        _STEPS[name] = fn
        return fn

    return add


def _quote(text: Any, mark: str) -> str:
    """``text`` between quotes, as one Spark SQL literal: backslashes and quotes inside are escaped."""
    return f"{mark}{str(text).replace(chr(92), chr(92) * 2).replace(mark, chr(92) + mark)}{mark}"


def _whole(x: Any) -> int:
    return int(str(x).strip())


FORMATS: dict[str, Callable[[Any], Any]] = {
    "DOUBLE_QUOTED_LIST": lambda v: "(" + ", ".join(_quote(x, '"') for x in v) + ")",
    "SINGLE_QUOTED_LIST": lambda v: "(" + ", ".join(_quote(x, "'") for x in v) + ")",
    "INT_LIST": lambda v: "(" + ", ".join(str(_whole(x)) for x in v) + ")",
    "STRING_DOUBLE_QUOTED": lambda v: _quote(v, '"'),
    "STRING_SINGLE_QUOTED": lambda v: _quote(v, "'"),
    "STRING_UNQUOTED": str,
    "INT": _whole,
}


def shaped(value: Any, split_on: str | None = None, format_as: str | None = None) -> Any:
    """Split first, then format. Quotes and backslashes inside values are escaped; integers are checked."""
    if split_on is not None:
        value = [x.strip() for x in str(value).split(split_on)]
    if format_as is None:
        return value
    if format_as not in FORMATS:
        raise ValueError(f"unknown format_as {format_as!r}")
    return FORMATS[format_as](value)


class Context:
    """Parameters given from outside, the source client's session, and nothing else."""

    def __init__(self, inputs: dict[str, Any] | None = None, session: Any = None):
        self.inputs, self.session = dict(inputs or {}), session

    def value(self, node: Any) -> Any:
        if not (isinstance(node, dict) and "type" in node):
            return node
        kind = node["type"]
        if kind not in _NODES:
            raise KeyError(f"unknown parameter type {kind!r}")
        return _NODES[kind]({k: v for k, v in node.items() if k != "type"}, self)


def evaluate(node: Any, inputs: dict[str, Any] | None = None, session: Any = None) -> Any:
    return Context(inputs, session).value(node)


@register_node("constant")
def _constant(node, ctx):
    return shaped(node["value"], node.get("split_on"), node.get("format_as"))


@register_node("external_input")
def _external(node, ctx):
    key, value = node["key"], ctx.inputs.get(node["key"])
    if node.get("required") and key not in ctx.inputs:
        raise KeyError(f"parameter {key!r} is required")
    if "ignore_if" in node and value == node["ignore_if"]:
        return IGNORE
    return value if value is None else shaped(value, node.get("split_on"), node.get("format_as"))


@register_node("dict")
def _dict(node, ctx):
    return {k: ctx.value(v) for k, v in node["items"].items()}


@register_node("list")
def _list(node, ctx):
    return [ctx.value(v) for v in node["items"]]


def _step(node) -> Callable:
    names = [node[k] for k in ("module", "class", "method") if k in node]
    for name in (".".join(names), ".".join(names[1:]), names[-1]):
        if name in _STEPS:
            return _STEPS[name]
    raise KeyError(f"no registered step {'.'.join(names)!r}")


@register_node("callable")
def _callable(node, ctx):
    return _step(node)


@register_node("instance")
def _instance(node, ctx):
    return _step(node)(**(ctx.value(node.get("arguments")) or {}))


@register_node("initializer")
def _initializer(node, ctx):
    return ctx.value(node["client"])(**(ctx.value(node.get("arguments")) or {}))


@register_node("from_authorizer")
def _from_session(node, ctx):
    if ctx.session is None:
        raise KeyError("from_authorizer needs an authorised session")
    return getattr(ctx.session, node["method"])(**(ctx.value(node.get("arguments")) or {}))


def filter_items(node: dict, ctx: Context) -> list[tuple[str, str, Any]]:
    """(column, operator, value) of every filter whose value is not left out."""
    out = []
    for key, item in node["items"].items():
        value = ctx.value(item["value"])
        if value is not IGNORE:
            out.append((key, item["operator"], value))
    return out


def typed_filters(node: dict, ctx: Context) -> list[tuple[str, str, Any]]:
    """filter_items with the values themselves instead of their text: ``format_as`` only tells integers."""
    bare = lambda v: {a: b for a, b in v.items() if a != "format_as"} if isinstance(v, dict) else v
    whole = {k for k, i in node["items"].items() if isinstance(i["value"], dict) and i["value"].get("format_as") in ("INT", "INT_LIST")}
    items = filter_items({"items": {k: {**i, "value": bare(i["value"])} for k, i in node["items"].items()}}, ctx)
    number = lambda v: [_whole(x) for x in v] if isinstance(v, (list, tuple)) else _whole(v)
    return [(k, o, number(v) if k in whole else v) for k, o, v in items]


@dataclass(frozen=True)
class BoundQuery:
    """Query text with named parameter markers, and their values."""

    text: str
    args: dict[str, Any] = field(default_factory=dict)


def bind(items: list[tuple[str, str, Any]]) -> BoundQuery:
    """Conditions joined by AND, every value behind a marker, so that no value is read as SQL. A list has a marker for
    each of its values; none of them hold for IN an empty list, all for NOT IN."""
    parts, args = [], {}
    for i, (key, operator, value) in enumerate(items):
        if not isinstance(value, (list, tuple)):
            args[f"p{i}"] = value
            parts.append(f"{key} {operator} :p{i}")
        elif value:
            names = {f"p{i}_{j}": x for j, x in enumerate(value)}
            args |= names
            parts.append(f"{key} {operator} ({', '.join(f':{n}' for n in names)})")
        else:
            parts.append("FALSE" if operator.upper() == "IN" else "TRUE")
    return BoundQuery(" AND ".join(parts), args)


@register_node("filter")
def _filter(node, ctx):
    """Filters as dicts with the key, operator and value names of ``schema``; as JSON text with json_dumps."""
    names = {"key": "key", "operator": "operator", "value": "value"} | node.get("schema", {})
    out = [{names["key"]: k, names["operator"]: o, names["value"]: v} for k, o, v in filter_items(node, ctx)]
    return json.dumps(out) if node.get("json_dumps") else out


@register_node("sql_query")
def _sql_query(node, ctx):
    return node["query"]


@register_node("sql_filter")
def _sql_filter(node, ctx):
    """Conditions as text, or as a BoundQuery with ``bind``."""
    if node.get("bind"):
        return bind(typed_filters(node, ctx))
    return " AND ".join(f"{k} {o} {v}" for k, o, v in filter_items(node, ctx))


@register_node("query_builder")
def _query_builder(node, ctx):
    query, where = ctx.value(node["query"]).strip(), ctx.value(node["filters"]) if node.get("filters") else ""
    if isinstance(where, BoundQuery):
        return BoundQuery(f"{query} WHERE {where.text}" if where.text else query, where.args)
    return f"{query} WHERE {where}" if where else query


@register_node("pipeline")
def _pipeline(node, ctx):
    return {"name": node["name"], "client": ctx.value(node["client"]), "forward_to": node.get("forward_to") or {}, "arguments": node.get("arguments")}
