"""Queries over the driver's tables, one per operator or family, with the SQL that must give the same rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import evaluate
from ..operators.compiler import apply_spec
from ..operators.unique import export_projection, unique_on
from ..sources.readers import SqlClient, dispatch, filter_columns, flatten_batches, open_client, read_config, read_csv
from ..sources.sinks import export_csv, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def field(name: str, source: str, kind: str, **params) -> dict:
    extra = {k: params.pop(k) for k in ("ignore", "object", "path") if k in params}
    return {"name": name, "from": source, "transform": {"type": kind, **params}, **extra}


STATUS = {"F": "finished", "O": "open", "P": "pending"}


@query("SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
def inline_integer(spark, d):
    return apply_spec(table(spark, d, "orders"), {"inline": [field("o_orderkey", "o_orderkey", "integer"), field("whole", "o_totalprice", "integer")]})


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS price, round(l_tax, 1) AS tax FROM lineitem")
def inline_float(spark, d):
    return apply_spec(table(spark, d, "lineitem"), {"inline": [field("price", "l_extendedprice", "float", precision=1), field("tax", "l_tax", "float", precision=1)]}, keep=("l_orderkey", "l_linenumber"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS p FROM orders")
def inline_string(spark, d):
    return apply_spec(table(spark, d, "orders"), {"inline": [field("k", "o_orderkey", "string"), field("p", "o_orderpriority", "string")]})


@query("SELECT l_orderkey, l_linenumber, l_discount <> 0 AS reduced, length(l_returnflag) > 0 AS flagged FROM lineitem")
def inline_bool(spark, d):
    return apply_spec(table(spark, d, "lineitem"), {"inline": [field("reduced", "l_discount", "bool"), field("flagged", "l_returnflag", "boolean")]}, keep=("l_orderkey", "l_linenumber"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, strftime(o_orderdate, '%Y.%m') AS month FROM orders")
def date_reformat(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    return apply_spec(df, {"inline": [field("day", "o_orderdate", "date", format={"input": "%Y-%m-%d", "output": "%d/%m/%Y"}), field("month", "o_orderdate", "date", format={"input": "%Y-%m-%d", "output": "%Y.%m"})]}, keep=("o_orderkey",))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def date_parse(spark, d):
    df = table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-0700")).alias("ts"))
    return apply_spec(df, {"inline": [field("day", "ts", "date_parser", format={"output": "%Y-%m-%d"})]}, keep=("event_id",))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS status FROM orders")
def enum_map(spark, d):
    return apply_spec(table(spark, d, "orders"), {"inline": [field("status", "o_orderstatus", "enum", mappings=STATUS)]}, keep=("o_orderkey",))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 END AS done, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'other' END AS word FROM orders")
def enum_on_error(spark, d):
    return apply_spec(table(spark, d, "orders"), {"inline": [field("done", "o_orderstatus", "enum", mappings={"F": 1}, on_error=None), field("word", "o_orderstatus", "enum", mapping={"O": "open"}, default="other")]}, keep=("o_orderkey",))


@query("SELECT o_orderkey, round(o_totalprice * 0.01, 2) AS hundreds, round(o_totalprice * 0.000001, 4) AS millions FROM orders")
def currency_scale(spark, d):
    return apply_spec(table(spark, d, "orders"), {"inline": [field("hundreds", "o_totalprice", "currency", multiplier=0.01), field("millions", "o_totalprice", "currency", from_micros=True, precision=4)]}, keep=("o_orderkey",))


@query("""SELECT c_custkey, CASE WHEN c_acctbal <> 0 AND c_acctbal > 5000 THEN 'rich' WHEN c_acctbal <> 0 AND c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'BUILDING' THEN 'builder'
  WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'MACHINERY') THEN 'rest' WHEN c_nationkey IN (1, 2, 3) THEN CAST(c_nationkey AS VARCHAR) ELSE 'none' END AS kind,
  CASE WHEN c_nationkey <> 5 AND c_acctbal IS NOT NULL THEN 'y' ELSE 'n' END AS both FROM customer""")
def case_predicates(spark, d):
    cases = [
        {"when": {"field": "c_acctbal", "greater_than": 5000}, "then": "rich"},
        {"when": {"field": "c_acctbal", "less_than": 0}, "then": "debt"},
        {"when": {"field": "absent", "null": None}, "then": "never"},
        {"when": {"field": "c_mktsegment", "equal": "BUILDING"}, "then": "builder"},
        {"when": {"field": "c_mktsegment", "not_in": ["AUTOMOBILE", "MACHINERY", 0]}, "then": "rest"},
        {"when": {"field": "c_nationkey", "in": [1, 2, 3, "1"]}, "then": {"type": "string"}},
    ]
    both = [{"when": {"and": [{"field": "c_nationkey", "not_equal": 5}, {"field": "c_acctbal", "not_null": None}]}, "then": "y"}]
    return apply_spec(table(spark, d, "customer"), {"inline": [{"name": "kind", "transform": {"type": "case", "cases": cases, "default": "none"}}, {"name": "both", "transform": {"type": "case", "cases": both, "default": "n"}}]}, keep=("c_custkey",))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE o_orderpriority END AS calm, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(trunc(o_totalprice) AS BIGINT) END AS due FROM orders")
def ignore_guard(spark, d):
    return apply_spec(table(spark, d, "orders"), {"inline": [
        field("calm", "o_orderpriority", "string", ignore={"when": {"in": ["1-URGENT", "2-HIGH"]}}),
        field("due", "o_totalprice", "integer", ignore={"when": {"field": "o_orderstatus", "equal": "F"}, "then": 0}),
    ]}, keep=("o_orderkey",))


@query("SELECT l_orderkey, l_linenumber, l_tax AS tax, l_discount AS discount, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 6) ELSE 0.0 END AS rate, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount * 100, 2) ELSE -1.0 END AS pct FROM lineitem")
def derived_ratio(spark, d):
    config = {
        "inline": [{"name": "tax", "from": "l_tax", "transform": {"type": "float"}}, {"name": "discount", "from": "l_discount", "transform": {"type": "float"}}],
        "derived": [{"name": "rate", "transform": {"type": "ratio", "numerator": "tax", "denominator": "discount", "precision": 6}}, {"name": "pct", "transform": {"type": "percentage", "numerator": "tax", "denominator": "discount", "default": -1.0}}],
    }
    return apply_spec(table(spark, d, "lineitem"), config, keep=("l_orderkey", "l_linenumber"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, round(round(o_totalprice, 2) * 0.5, 1) AS half, CASE WHEN round(round(o_totalprice, 2) * 0.5, 1) > 50000 THEN 'big' ELSE 'small' END AS size, (round(o_totalprice, 2) + 1) * 2 AS sum FROM orders")
def derived_chain(spark, d):
    config = {
        "inline": [field("price", "o_totalprice", "float", precision=2)],
        "derived": [
            {"name": "half", "from": "price", "transform": {"type": "currency", "multiplier": 0.5, "rounding": 1}},
            {"name": "size", "transform": {"type": "case", "cases": [{"when": {"field": "half", "greater_than": 50000}, "then": "big"}], "default": "small"}},
            {"name": "sum", "transform": {"type": "formula", "expression": "(price + 1) * 2"}},
        ],
    }
    return apply_spec(table(spark, d, "orders"), config, keep=("o_orderkey",))


@query("SELECT r_name AS name, 'social' AS channel, 1 AS level FROM region")
def constants(spark, d):
    return apply_spec(table(spark, d, "region"), {"inline": [field("name", "r_name", "string")], "constants": [{"name": "channel", "value": "social"}, {"name": "level", "value": 1}]})


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS deep, CAST(NULL AS VARCHAR) AS gone FROM events")
def object_path(spark, d):
    df = table(spark, d, "events").select("event_id", F.struct(F.from_json("props", "k bigint").alias("props")).alias("e"))
    return apply_spec(df, {"inline": [field("k", "k", "integer", object="e.props"), {"name": "deep", "path": "e.props.k", "transform": {"type": "integer"}}, field("gone", "k", "string", object="e.none")]}, keep=("event_id",)).withColumn("gone", F.col("gone").cast("string"))


def nested_orders(spark, d, customers: bool = False) -> DataFrame:
    """Test set-up, not an operator: orders with their line items in an array (and customers with those)."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"))).alias("lines"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    if not customers:
        return orders
    by = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "lines"))).alias("orders"))
    return table(spark, d, "customer").join(by, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


LINE = [field("line", "l_linenumber", "integer"), field("part", "l_partkey", "string"), field("quantity", "l_quantity", "float", precision=1)]
LINE_SQL = "CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey AS VARCHAR) AS part, round(l_quantity, 1) AS quantity"


@query(f"SELECT o_orderkey AS key, {LINE_SQL}, CASE WHEN round(l_quantity, 1) > 25 THEN 'bulk' ELSE 'unit' END AS pack FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def array_nested(spark, d):
    pack = [{"name": "pack", "transform": {"type": "case", "cases": [{"when": {"field": "quantity", "greater_than": 25}, "then": "bulk"}], "default": "unit"}}]
    out = apply_spec(nested_orders(spark, d), {"inline": [field("key", "o_orderkey", "integer"), {"name": "items", "from": "lines", "type": "array", "inline": LINE, "derived": pack}]})
    return out.select("key", F.explode("items").alias("i")).select("key", "i.*")


FLAT_1 = {"inline": [field("key", "o_orderkey", "integer"), field("status", "o_orderstatus", "enum", mappings=STATUS), {"name": "items", "from": "lines", "type": "extended_array", "inline": LINE, "constants": [{"name": "level", "value": "line"}]}]}
FLAT_1_SQL = f"""
WITH o AS (SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS status FROM orders)
SELECT key, status, CAST(NULL AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS part, CAST(NULL AS DOUBLE) AS quantity, CAST(NULL AS VARCHAR) AS level FROM o
UNION ALL SELECT key, status, {LINE_SQL}, 'line' FROM o JOIN lineitem ON l_orderkey = key"""


@query(FLAT_1_SQL)
def extended_array_1(spark, d):
    return apply_spec(nested_orders(spark, d), FLAT_1)


FLAT_2 = {"inline": [field("cust", "c_custkey", "integer"), field("segment", "c_mktsegment", "string"), {"name": "o", "from": "orders", "type": "extended_array", "inline": [
    field("key", "o_orderkey", "integer"), field("price", "o_totalprice", "float", precision=1), {"name": "items", "from": "lines", "type": "extended_array", "inline": LINE}],
    "derived": [{"name": "size", "transform": {"type": "case", "cases": [{"when": {"field": "price", "greater_than": 100000}, "then": "big"}], "default": "small"}}]}]}
FLAT_2_SQL = f"""
WITH c AS (SELECT c_custkey AS cust, c_mktsegment AS segment FROM customer),
o AS (SELECT o_custkey, o_orderkey AS key, round(o_totalprice, 1) AS price, CASE WHEN round(o_totalprice, 1) > 100000 THEN 'big' ELSE 'small' END AS size FROM orders)
SELECT cust, segment, CAST(NULL AS BIGINT) AS key, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS size, CAST(NULL AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS part, CAST(NULL AS DOUBLE) AS quantity FROM c
UNION ALL SELECT cust, segment, key, price, size, NULL, NULL, NULL FROM c JOIN o ON o_custkey = cust
UNION ALL SELECT cust, segment, key, price, size, {LINE_SQL} FROM c JOIN o ON o_custkey = cust JOIN lineitem ON l_orderkey = key"""


@query(FLAT_2_SQL)
def extended_array_2(spark, d):
    return apply_spec(nested_orders(spark, d, True), FLAT_2)


@query(f"SELECT key, status, CAST(NULL AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS part, CAST(NULL AS DOUBLE) AS quantity, CAST(NULL AS VARCHAR) AS level FROM ({FLAT_1_SQL})")
def normalize_compat(spark, d):
    return apply_spec(nested_orders(spark, d), FLAT_1, normalize_compat=True)


LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) = 1")
def unique_on_keys(spark, d):
    return unique_on(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT n_name, CAST(NULL AS VARCHAR) AS missing, n_nationkey FROM nation")
def export_fields(spark, d):
    return export_projection(table(spark, d, "nation"), ["n_name", "missing", "n_nationkey"])


FILTERS = {"type": "sql_filter", "items": {
    "o_orderstatus": {"operator": "IN", "value": {"type": "external_input", "key": "status", "split_on": ",", "format_as": "SINGLE_QUOTED_LIST", "ignore_if": None}},
    "o_custkey": {"operator": "IN", "value": {"type": "external_input", "key": "customers", "split_on": ",", "format_as": "INT_LIST", "ignore_if": None}},
    "o_orderpriority": {"operator": "LIKE", "value": {"type": "constant", "value": "1%", "format_as": "STRING_SINGLE_QUOTED"}}}}


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '1%'")
def query_builder(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("rowloom_orders")
    request = {"method": "search", "arguments": {"type": "dict", "items": {"query": {"type": "query_builder", "query": {"type": "sql_query", "query": "SELECT o_orderkey, o_totalprice FROM rowloom_orders\n"}, "filters": FILTERS}}}}
    return dispatch(SqlClient(spark), request, {"status": "F,P"})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 4, 7) AND o_orderpriority LIKE '1%'")
def filter_spec(spark, d):
    return table(spark, d, "orders").where(filter_columns(FILTERS, {"customers": "1,2,4,7"})).select("o_orderkey", "o_custkey")


@query("SELECT l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def flatten_results(spark, d):
    return flatten_batches(nested_orders(spark, d), "lines").select("l_linenumber", "l_partkey", "l_quantity")


@query("SELECT upper(o_orderpriority) AS p, o_orderkey FROM orders WHERE o_orderkey IS NOT NULL")
def registered_transform(spark, d):
    from ..functions.transforms import register_transform

    register_transform("uppercase", lambda params: F.upper)
    return apply_spec(table(spark, d, "orders"), {"inline": [field("p", "o_orderpriority", "uppercase")]}, keep=("o_orderkey",))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 0.01, 2) ELSE round(o_totalprice, 2) END AS due, CASE WHEN o_orderpriority IN ('5-LOW') THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS who FROM orders")
def ignore_then_transform(spark, d):
    return apply_spec(table(spark, d, "orders"), {"inline": [
        field("due", "o_totalprice", "float", precision=2, ignore={"when": {"field": "o_orderstatus", "equal": "F"}, "then": {"type": "currency", "field": "o_totalprice", "multiplier": 0.01}}),
        field("who", "o_orderpriority", "string", ignore={"when": {"in": ["5-LOW"]}, "then": {"type": "string", "field": "o_custkey"}}),
    ]}, keep=("o_orderkey",))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS "total price", round(round(o_totalprice, 2) * 0.1, 1) AS "a tenth", CASE WHEN round(round(o_totalprice, 2) * 0.1, 1) > 10000 THEN 'high' ELSE 'low' END AS "the level" FROM orders""")
def derived_names(spark, d):
    """Derived fields whose names hold spaces still wait for each other."""
    level = {"type": "case", "cases": [{"when": {"field": "a tenth", "greater_than": 10000}, "then": "high"}], "default": "low"}
    config = {"inline": [field("total price", "o_totalprice", "float", precision=2)], "derived": [
        {"name": "a tenth", "from": "total price", "transform": {"type": "currency", "multiplier": 0.1, "rounding": 1}}, {"name": "the level", "transform": level}]}
    return apply_spec(table(spark, d, "orders"), config, keep=("o_orderkey",))


@query("SELECT o_orderkey, unnest([o_custkey + 0.5, o_orderkey + 0.5]) AS half, unnest([lower(o_orderpriority), lower(o_orderstatus)]) AS word FROM orders")
def array_scalars(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.array(F.col("o_custkey") + F.lit(0.5), F.col("o_orderkey") + F.lit(0.5)).cast("array<string>").alias("n"), F.array("o_orderpriority", "o_orderstatus").alias("w"))
    config = {"inline": [{"name": "halves", "from": "n", "type": "array", "item_transform": {"type": "float", "precision": 1}}, {"name": "words", "from": "w", "type": "array", "item_transform": {"type": "lowercase"}}]}
    out = apply_spec(df, config, keep=("o_orderkey",)).select("o_orderkey", F.explode(F.arrays_zip("halves", "words")).alias("z"))
    return out.select("o_orderkey", F.col("z.halves").alias("half"), F.col("z.words").alias("word"))


@query("""SELECT n_nationkey::VARCHAR AS n_nationkey, n_name || ', "' || n_regionkey || '"' AS note, '' AS nothing FROM nation""")
def csv_roundtrip(spark, d):
    """Exported as gzip tab-separated text and read back: quotes, delimiters and empty cells come through."""
    rows = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(', "'), "n_regionkey", F.lit('"')).alias("note"), F.lit(None).cast("string").alias("nothing"))
    path = export_csv(rows, {"filename": "nation", "unique_on": ["n_nationkey"], "fields": rows.columns}, scratch(spark, "exports"), ["note"])
    return read_csv(spark, path, sep="\t")


CONFIGS = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "configs")


@query("""WITH o AS (SELECT o_orderkey::VARCHAR AS key, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS state, lower(o_orderpriority) AS urgency,
  CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 0.01, 3) ELSE round(o_totalprice, 1) END AS due, CAST(o_custkey AS DOUBLE) AS buyer FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '1%')
SELECT key, state, urgency, due, CASE WHEN buyer > 0 THEN round(due / buyer, 4) ELSE 0.0 END AS "per buyer",
  CASE WHEN buyer > 0 AND round(due / buyer, 4) > 100 THEN round(due / buyer, 0) ELSE -1.0 END AS level, 'orders' AS channel FROM o""")
def configured_source(spark, d):
    """The shipped configuration: an authorised session, filters pushed to the scan, records by the shipped specification."""
    source = read_config(f"{CONFIGS}/connector/tables/orders.yaml")
    rows = dispatch(open_client(spark, source, {"root": d}, CONFIGS), source["request"], {"states": "F,P", "priority": "1%"})
    config = read_config(f"{CONFIGS}/serializer/tables/orders.yaml")
    return export_projection(unique_on(apply_spec(rows, config), ["key"], ["key"]), config["export"]["fields"])


FLAGSHIP = {
    "inline": [
        field("key", "o_orderkey", "string"), field("status", "o_orderstatus", "enum", mappings=STATUS), field("price", "o_totalprice", "float", precision=2), field("day", "o_orderdate", "date_parser", format={"output": "%Y-%m-%d"}),
        field("urgency", "o_orderpriority", "string", ignore={"when": {"in": ["5-LOW", "", "0", 0]}, "then": None}),
        {"name": "items", "from": "lines", "type": "extended_array", "inline": [field("line", "l_linenumber", "integer"), field("part", "l_partkey", "integer"), field("cost", "l_extendedprice", "currency", multiplier=0.01), field("returned", "l_returnflag", "enum", mappings={"R": "yes", "A": "no", "N": "no"})]},
    ],
    "derived": [{"name": "size", "transform": {"type": "case", "cases": [{"when": {"field": "price", "greater_than": 150000}, "then": "large"}, {"when": {"field": "price", "greater_than": 50000}, "then": "medium"}], "default": "small"}}],
    "constants": [{"name": "origin", "value": "orders"}],
    "export": {"filename": "orders", "unique_on": ["key", "line"], "fields": ["key", "status", "price", "day", "urgency", "size", "origin", "line", "part", "cost", "returned", "region"]},
}
_PARENT = """o_orderkey::VARCHAR AS key, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS status, round(o_totalprice, 2) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day,
 CASE WHEN o_orderpriority IN ('5-LOW', '', '0') THEN NULL ELSE o_orderpriority END AS urgency, CASE WHEN round(o_totalprice, 2) > 150000 THEN 'large' WHEN round(o_totalprice, 2) > 50000 THEN 'medium' ELSE 'small' END AS size, 'orders' AS origin"""


@query(f"""WITH u AS (SELECT {_PARENT}, CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS part, CAST(NULL AS DOUBLE) AS cost, CAST(NULL AS VARCHAR) AS returned FROM orders
UNION ALL SELECT {_PARENT}, CAST(l_linenumber AS BIGINT), l_partkey, round(l_extendedprice * 0.01, 2), CASE l_returnflag WHEN 'R' THEN 'yes' ELSE 'no' END FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT *, CAST(NULL AS VARCHAR) AS region FROM u QUALIFY row_number() OVER (PARTITION BY key, line ORDER BY part NULLS FIRST, cost NULLS FIRST, returned NULLS FIRST) = 1""")
def flagship(spark, d):
    """Orders with their lines: fields, guards, a case, flattening, first-wins keys and the export projection."""
    df = nested_orders(spark, d).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    flat = apply_spec(df, FLAGSHIP)
    return export_projection(unique_on(flat, FLAGSHIP["export"]["unique_on"], ["part", "cost", "returned"]), FLAGSHIP["export"]["fields"])


from . import further_queries  # noqa: E402, F401  (adds its own)
