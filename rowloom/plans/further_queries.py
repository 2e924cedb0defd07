"""Queries over the driver's tables for records whose keys, types and forms vary, and for what configuration builds."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import evaluate, register_step
from ..functions.transforms import register_flat_map, register_python_transform
from ..operators.compiler import apply_apart, apply_spec, flat_map
from ..sources.readers import SqlClient, dispatch, open_client, ragged_records, read_csv
from ..sources.sinks import export_csv, read_apart, scratch, write_apart
from .pipeline import main
from .queries import CONFIGS, field, query, table


@query("""SELECT o_orderkey AS key, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(trunc(o_totalprice) AS BIGINT) END AS due,
  CASE o_orderkey % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' ELSE 'some' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS cust,
  CASE WHEN o_orderkey % 2 = 0 THEN coalesce(CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END, 'none') END AS state FROM orders""")
def ragged_keys(spark, d):
    """A key that a record lacks is told from a null, row by row, at the top and inside an object."""
    due = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, ',"due":null').otherwise(F.concat(F.lit(',"due":'), F.col("o_totalprice").cast("string")))
    state = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(',"state":"'), "o_orderstatus", F.lit('"'))).otherwise(',"state":null')
    who = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(',"who":{"cust":'), F.col("o_custkey").cast("string"), state, F.lit("}"))).otherwise("")
    text = F.concat(F.lit('{"key":'), F.col("o_orderkey").cast("string"), due, who, F.lit("}"))
    records = ragged_records(table(spark, d, "orders").select(text.alias("text")), "text")
    kind = {"type": "case", "cases": [{"when": {"field": "due", "null": None}, "then": "null"}, {"when": {"field": "due", "not_in": ["x"]}, "then": "some"}], "default": "absent"}
    return apply_spec(records, {"inline": [
        field("key", "key", "integer"), field("due", "due", "integer", ignore={"when": {"equal": None}, "then": 0}), {"name": "kind", "transform": kind},
        field("cust", "cust", "integer", object="who"), field("state", "state", "string", object="who", ignore={"when": {"equal": None}, "then": "none"}),
    ]}, record="record")


@query("""SELECT l_orderkey AS key, l_linenumber AS line, l_quantity AS quantity, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS reason FROM lineitem WHERE l_linenumber <> 3 AND l_returnflag IN ('A', 'R')
UNION ALL SELECT l_orderkey, l_linenumber, NULL, 'quantity', 'float: n/a' FROM lineitem WHERE l_linenumber = 3
UNION ALL SELECT l_orderkey, l_linenumber, NULL, 'back', 'enum: N' FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')""")
def rows_set_apart(spark, d):
    """Records that do not convert, set apart with the reasons while the others are written, in one pass."""
    lines = table(spark, d, "lineitem").withColumn("quantity", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string")))
    config = {"inline": [field("quantity", "quantity", "float"), field("back", "l_returnflag", "enum", mappings={"A": "no", "R": "yes"})]}
    path = scratch(spark, "apart")
    write_apart(apply_apart(lines, config, keep=("l_orderkey", "l_linenumber")), path)
    good, failed = read_apart(spark, path)
    ids = [F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line")]
    none = F.lit(None).cast("string")
    return good.select(*ids, "quantity", none.alias("field"), none.alias("reason")).union(failed.select(*ids, F.lit(None).cast("double"), F.explode("errors").alias("e")).select("key", "line", F.lit(None).cast("double"), "e.field", "e.reason"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey >= 100")
def paged_source(spark, d):
    """Orders as pages of JSON, read a partition for each page by a configured source; filters and fields reach the reader."""
    path = scratch(spark, "pages")
    rows = F.to_json(F.struct(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("results")))
    pages = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 2000).alias("page")).agg(rows.alias("value"))
    pages.write.partitionBy("page").text(path)
    config = {"client": {"source": "pages", "options": {"path": path, "schema": "o_orderkey bigint, o_orderstatus string, o_totalprice double"}}}
    where = {"type": "filter", "items": {"o_orderstatus": {"operator": "=", "value": {"type": "external_input", "key": "state"}}, "o_orderkey": {"operator": ">=", "value": {"type": "constant", "value": 100}}}}
    request = {"method": "get", "arguments": {"type": "dict", "items": {"fields": ["o_orderkey", "o_totalprice"], "where": where}}}
    return dispatch(open_client(spark, config), request, {"state": "F"})


@query("SELECT o_orderkey, o_orderpriority || ' it''s \\ -- \"x\"' AS p FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey > 10")
def bound_query(spark, d):
    """A query whose values go as parameters: quotes, backslashes and comment marks in them stay text."""
    table(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat("o_orderpriority", F.lit(" it's \\ -- \"x\"")).alias("p")).createOrReplaceTempView("rowloom_bound")
    items = {
        "p": {"operator": "IN", "value": {"type": "external_input", "key": "words", "split_on": "|", "format_as": "SINGLE_QUOTED_LIST"}},
        "o_custkey": {"operator": ">", "value": {"type": "external_input", "key": "least", "format_as": "INT"}},
        "o_orderkey": {"operator": "<>", "value": {"type": "external_input", "key": "not_given", "ignore_if": None}},
    }
    text = {"type": "query_builder", "query": {"type": "sql_query", "query": "SELECT o_orderkey, p FROM rowloom_bound"}, "filters": {"type": "sql_filter", "bind": True, "items": items}}
    request = {"method": "search", "arguments": {"type": "dict", "items": {"query": text}}}
    return dispatch(SqlClient(spark), request, {"words": "1-URGENT it's \\ -- \"x\"|5-LOW it's \\ -- \"x\"", "least": "10"})


@query("""SELECT l_orderkey, l_linenumber, p_brand AS brand, CASE WHEN l_partkey % 7 = 0 THEN 'unknown' ELSE p_type END AS kind FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def enum_lookup(spark, d):
    """Enums whose mapping is a table: joined, after its size is known."""
    other = scratch(spark, "lookup")
    table(spark, d, "part").where("p_partkey % 7 <> 0").select("p_partkey", "p_type").write.parquet(other)
    config = {"inline": [
        field("brand", "l_partkey", "enum", lookup={"path": f"{d}/part.parquet", "key": "p_partkey", "value": "p_brand"}, on_error=None),
        field("kind", "l_partkey", "enum", lookup={"path": other, "key": "p_partkey", "value": "p_type"}, on_error="unknown"),
    ]}
    return apply_spec(table(spark, d, "lineitem"), config, keep=("l_orderkey", "l_linenumber"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '1' WHEN '2-HIGH' THEN 'two' ELSE '0.5' END AS word, CASE WHEN o_custkey % 4 = 1 THEN 'one' WHEN o_custkey % 4 = 2 THEN 'two' ELSE 'miss' END AS number,
  CASE WHEN o_custkey % 2 = 1 THEN 'yes' ELSE 'no' END AS flag FROM orders""")
def enum_types(spark, d):
    """Keys meet values of their own kind only, results of several kinds become text."""
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 4).cast("int").alias("n"), (F.col("o_custkey") % 2 == 1).alias("b"))
    return apply_spec(df, {"inline": [
        field("word", "o_orderpriority", "enum", mappings={"1-URGENT": 1, "2-HIGH": "two", 3: "never"}, on_error=0.5),
        field("number", "n", "enum", mappings={"0": "text", 1: "one", 2.0: "two", "A": "text", 2.5: "never"}, on_error="miss"),
        field("flag", "b", "enum", mappings={1: "yes", 0: "no", "1": "text"}),
    ]}, keep=("o_orderkey",))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%d/%m/%y %H:%M') || ' -0700' AS whole, strftime(ts, '%A %d %B %Y %I %p') AS words FROM events")
def date_zone(spark, d):
    """A date with an offset is the date as written, whatever the session's zone."""
    df = table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-0700")).alias("ts"))
    read = "%Y-%m-%dT%H:%M:%S%z"
    return apply_spec(df, {"inline": [field(n, "ts", "date", format={"input": read, "output": out}) for n, out in (("day", "%Y-%m-%d"), ("whole", "%d/%m/%y %H:%M %z"), ("words", "%A %d %B %Y %I %p"))]}, keep=("event_id",))


#: Forms a date is written in by ``date_forms``, in Java letters.
FORMS = ("yyyy-MM-dd", "MM/dd/yyyy", "d MMMM yyyy", "EEEE, MMM d, yyyy", "yyyyMMdd", "dd-MMM-yyyy", "yyyy/MM/dd HH:mm:ss", "MMM d yyyy h:mm a", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd'T'HHmmss", "EEE MMM dd HH:mm:ss 'EST' yyyy", "MM.dd.yyyy")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders")
def date_forms(spark, d):
    """Dates in twelve forms through one field."""
    at = F.pmod(F.col("o_orderkey"), F.lit(len(FORMS)))
    text = F.lit(None).cast("string")
    for i, form in enumerate(FORMS):
        text = F.when(at == i, F.date_format("o_orderdate", form)).otherwise(text)
    return apply_spec(table(spark, d, "orders").select("o_orderkey", text.alias("t")), {"inline": [field("day", "t", "date_parser", format={"output": "%d.%m.%Y"})]}, keep=("o_orderkey",))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN round(l_quantity, 1) END AS metric_quantity, CASE WHEN l_linenumber % 2 = 1 THEN round(l_tax * 10, 1) END AS metric_tax,
  round(l_discount * 10, 1) AS ratio_discount, round(l_tax * 10, 1) AS ratio_tax FROM lineitem""")
def dynamic_fields(spark, d):
    """Fields for every key that a pattern matches: of a map, whose keys are gathered, and of a struct."""
    number = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("metric_quantity"), F.col("l_quantity"))).otherwise(F.create_map(F.lit("metric_tax"), F.col("l_tax") * 10, F.lit("other"), F.lit(0.0)))
    ratios = F.struct((F.col("l_tax") * 10).alias("ratio_tax"), (F.col("l_discount") * 10).alias("ratio_discount"), F.lit(1.0).alias("rate"))
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", number.alias("metrics"), ratios.alias("ratios"))
    rounded = {"type": "float", "precision": 1}
    return apply_spec(df, {"dynamic": [{"pattern": "metric_*", "from_object": "metrics", "transform": rounded}, {"pattern": "ratio_*", "from_object": "ratios", "transform": rounded}]}, keep=("l_orderkey", "l_linenumber"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 'known' ELSE 'unknown' END AS state, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_custkey END AS buyer FROM orders")
def null_predicate(spark, d):
    """``null`` and ``not_null`` on a field that is there."""
    df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("c"))
    state = {"type": "case", "cases": [{"when": {"field": "c", "null": None}, "then": "unknown"}, {"when": {"field": "c", "not_null": None}, "then": "known"}]}
    return apply_spec(df, {"inline": [{"name": "state", "transform": state}, field("buyer", "c", "integer", ignore={"when": {"null": None}, "then": -1})]}, keep=("o_orderkey",))


@query("""WITH c AS (SELECT o_custkey AS cust, o_orderkey, o_orderstatus FROM orders)
SELECT cust, o_orderkey AS key, CAST(NULL AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS flag FROM c UNION ALL SELECT cust, o_orderkey, l_linenumber, lower(l_returnflag) FROM c JOIN lineitem ON l_orderkey = o_orderkey""")
def flattened_in_array(spark, d):
    """An array whose elements flatten an array of their own, as a list in one field."""
    from .queries import nested_orders

    orders = nested_orders(spark, d).groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "lines")).alias("orders"))
    items = {"name": "items", "from": "lines", "type": "extended_array", "inline": [field("line", "l_linenumber", "integer"), field("flag", "l_returnflag", "lowercase")]}
    config = {"inline": [field("cust", "o_custkey", "integer"), {"name": "rows", "from": "orders", "type": "array", "inline": [field("key", "o_orderkey", "integer"), items]}]}
    return apply_spec(orders, config).select("cust", F.explode("rows").alias("r")).select("cust", "r.key", "r.line", "r.flag")


class Prices:
    """A client made by configuration: orders of some states at or above a price."""

    def __init__(self, root: str, states: list[str]):
        self.root, self.states = root, states

    def above(self, spark, price: float) -> DataFrame:
        return spark.read.parquet(f"{self.root}/orders.parquet").where(F.col("o_orderstatus").isin(self.states) & (F.col("o_totalprice") >= price)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice >= 100000")
def configured_instance(spark, d):
    """``instance`` and ``list`` nodes: an object that configuration makes of evaluated arguments."""
    register_step("prices")(Prices)
    node = {"type": "instance", "method": "prices", "arguments": {"type": "dict", "items": {
        "root": {"type": "external_input", "key": "root", "required": True}, "states": {"type": "list", "items": [{"type": "constant", "value": "F"}, {"type": "external_input", "key": "other"}]}}}}
    return evaluate(node, {"root": d, "other": "P"}).above(spark, 100000.0)


@query("""WITH o AS (SELECT o_orderkey::VARCHAR AS key, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE '' END AS state, lower(o_orderpriority) AS urgency,
  CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 0.01, 3) ELSE round(o_totalprice, 1) END AS due, CAST(o_custkey AS DOUBLE) AS buyer FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '1%')
SELECT key, state, urgency, due, CASE WHEN buyer > 0 THEN round(due / buyer, 4) ELSE 0.0 END AS "per buyer", 'orders' AS channel FROM o""")
def shipped_pipeline(spark, d):
    """The shipped pipeline file through the command line: configurations, source, records and export as forwarded steps."""
    argv = ["--namespace", "tables", "--pipeline-config", f"{CONFIGS}/pipeline/record_export.yaml", "--data-ingestion-config", "orders.yaml", "--config-root", CONFIGS, "--output-dir", scratch(spark, "exports")]
    out = main([*argv, "--auth-data", f"root={d}", "--external-input", "states=F,P", "priority=1%"], spark)
    rows = read_csv(spark, out["file"], sep="\t")
    return rows.select("key", "state", "urgency", F.col("due").cast("double").alias("due"), F.col("per buyer").cast("double").alias("per buyer"), "channel")


@query("SELECT o_orderkey, upper(o_orderpriority) || '!' AS loud, o_custkey % 10 AS digit FROM orders")
def python_transforms(spark, d):
    """Transforms registered as Python functions over Arrow arrays."""
    register_python_transform("louder", "string", lambda params: lambda a: pc.binary_join_element_wise(pc.utf8_upper(a), params.get("mark", "!"), ""))
    register_python_transform("last_digit", "bigint", lambda params: lambda a: pc.subtract(a, pc.multiply(pc.divide(a, 10), 10)))
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return apply_spec(df, {"inline": [field("loud", "o_orderpriority", "louder"), field("digit", "o_custkey", "last_digit")]}, keep=("o_orderkey",))


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def python_flat_map(spark, d):
    """A registered Python flat-map: one row for each word."""

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = pc.split_pattern(batch.column(0), " ")
        return pa.RecordBatch.from_arrays([pc.list_parent_indices(parts), pc.list_flatten(parts)], names=["row", "word"])

    register_flat_map("words", "word string", words)
    return flat_map(table(spark, d, "nation"), "words", ["n_name"], keep=["n_nationkey"])


@query("""SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority || chr(9) || '"q"' AS p, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders""")
def one_gzip_file(spark, d):
    """An export as one gzip file whose parts were written in parallel; rows in order."""
    rows = table(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit('\t"q"')).alias("p"))
    path = export_csv(rows, {"filename": "orders"}, scratch(spark, "exports"), ["o_orderkey"], joined=True)
    back = read_csv(spark, path, sep="\t")
    return back.withColumn("place", (F.monotonically_increasing_id() + 1).cast("long"))
