"""Records whose keys, types and forms vary; sources, lookups and sinks beside them."""

import csv
import datetime as dt
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from rowloom.functions.dates import any_date, read_date, write_date
from rowloom.functions.params import BoundQuery, evaluate
from rowloom.operators import lookups
from rowloom.operators.compiler import apply_apart, apply_spec
from rowloom.sources.readers import SqlClient, conditions, ragged_records
from rowloom.sources.sinks import export_csv, read_apart, write_apart


def field(name, kind, **more):
    extra = {k: more.pop(k) for k in ("ignore", "object") if k in more}
    return {"name": name, "from": more.pop("source", name), "transform": {"type": kind, **more}, **extra}


LINES = [
    '{"id":1,"n":null,"m":{"metric_a":1.5,"metric_b":"x","other":3},"items":[{"q":1},{"q":null,"w":"a"},{}]}',
    '{"id":2,"n":5,"items":[]}', '{"id":"3","m":{"metric_a":null}}', '{"id":4,"n":"bad","m":{"metric_c":2}}', '{"id":5,"it\'s":"q","\'\\"":"r","list":[10,20]}', "no json",
]


def test_absent_keys(spark):
    df = ragged_records(spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "seq int, text string"), "text")
    guard = {"when": {"equal": None}, "then": 0}
    kind = {"type": "case", "cases": [{"when": {"field": "n", "null": None}, "then": "null"}, {"when": {"field": "n", "not_equal": "zz"}, "then": "some"}], "default": "absent"}
    spec = {
        "inline": [field("id", "string"), field("n", "string", ignore=guard | {"then": "0"}), {"name": "kind", "transform": kind}, field("a", "string", source="metric_a", object="m", ignore={"when": {"null": None}, "then": "none"}), field("q", "string", source="it's"), field("r", "string", source="'\""),
                   field("second", "integer", source="1", object="list"),
                   {"name": "items", "from": "items", "type": "extended_array", "inline": [field("q2", "integer", source="q", ignore={"when": {"equal": None}, "then": -1}), field("w", "string")]}],
    }
    got = [tuple(r) for r in apply_spec(df, spec, record="record", keep=("seq",)).orderBy("seq", "q2", "w").collect()]
    one = (0, "1", "0", "null", "1.5", None, None, None)
    assert got[:4] == [(*one, None, None), (*one, None, None), (*one, -1, "a"), (*one, 1, None)]
    assert got[4:] == [(1, "2", "5", "some", *[None] * 6), (2, "3", None, "absent", "none", *[None] * 5), (3, "4", "bad", "some", *[None] * 6),
                       (4, "5", None, "absent", None, "q", "r", 20, None, None), (5, *[None] * 9)]
    # a map's missing key is absent, too
    maps = spark.createDataFrame([(1, {"x": None}), (2, {}), (3, None), (4, {"x": "v"})], "id int, m map<string,string>")
    got = apply_spec(maps, {"inline": [field("x", "string", object="m", ignore={"when": {"equal": None}, "then": "null"})]}, keep=("id",)).orderBy("id").collect()
    assert [r.x for r in got] == ["null", None, None, "v"]


def test_rows_set_apart(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.choice(["1", " 2 ", "1_000", "x", None, "2.5"]), r.choice(["F", "Z", None]), r.choice(["2024-01-31", "2024-02-31", "soon", None]), [r.choice(["1.5", "bad"]) for _ in range(i % 3)], [(r.choice(["7", "seven"]),) for _ in range(i % 4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, n string, s string, d string, l array<string>, k array<struct<v:string>>")
    case = {"type": "case", "cases": [{"when": {"field": "s", "equal": "F"}, "then": {"type": "integer", "field": "n"}}], "default": None}
    spec = {
        "inline": [field("n", "integer"), field("s", "enum", mappings={"F": 1}), field("d", "date", format={"input": "%Y-%m-%d", "output": "%d"}), field("e", "date_parser", source="d", format={"output": "%Y"}, ignore={"when": {"equal": "soon"}, "then": "later"}),
                   {"name": "c", "transform": case}, {"name": "l", "from": "l", "type": "array", "item_transform": {"type": "float"}}, {"name": "k", "from": "k", "type": "extended_array", "inline": [field("v", "integer")]}],
        "derived": [{"name": "twice", "from": "n", "transform": {"type": "currency", "multiplier": 2}}],
    }
    out = apply_apart(df, spec, keep=("id",))
    counts = write_apart(out, str(tmp_path / "o"))
    good, failed = read_apart(spark, str(tmp_path / "o"))
    assert counts == {"good": good.count(), "failed": failed.count()} and counts["good"] + counts["failed"] == sum(1 + i % 4 for i in range(200)) and min(counts.values()) > 0
    number = lambda t: t is None or t.strip().replace("_", "").isdigit()
    want = set()
    for i, n, s, d, l, k in rows:
        for row, v in enumerate([None, *[x[0] for x in k]]):
            said = [("n", f"integer: {n}")] * (not number(n)) + [("s", f"enum: {s}")] * (s == "Z") + [("d", f"date: {d}")] * (d in ("2024-02-31", "soon")) + [("e", f"date_parser: {d}")] * (d == "2024-02-31")
            said += [("c", f"integer: {n}")] * (s == "F" and not number(n)) + ([("l", "; ".join("float: bad" for x in l if x == "bad"))] if "bad" in l else []) + [("v", f"integer: {v}")] * (v == "seven")
            want.add((i, row, tuple(sorted(said))))
    got = {}
    for x in out.collect():
        got.setdefault(x.id, []).append(tuple(sorted(map(tuple, x.errors))))
    assert all(sorted(got[i]) == sorted(s for j, _, s in want if j == i) for i in got)
    with pytest.raises(ValueError):
        write_apart(out.withColumn("failed", F.lit(1)), str(tmp_path / "p"))


FORMS = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%m/%d/%Y", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%y", "%d-%m-%y", "%y-%m-%d", "%Y%m%d", "%y%m%d", "%Y%m%d%H%M%S", "%Y%m%dT%H%MZ", "%b %d, %Y", "%d %B %Y", "%d-%b-%y", "%b-%d-%Y", "%a %b %d %H:%M:%S %Y",
         "%a, %d %b %Y %H:%M:%S +0200", "%a %b %d %H:%M:%S EST %Y", "%A %B %d, %Y at %I:%M %p", "%Y-%m-%dT%H:%M:%S.%f-0700", "%Y-%m-%d %I:%M:%S%p", "%dth of %B %Y", "%b. %d, %Y", "%d%b%Y", "%H:%M %d.%m.%Y", "%I:%M %p, %b %d %Y", "%Y %B %d", "%b %d %Y %I%p"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates(spark, zone):
    """Free forms against the parser that Python users know; declared forms against datetime; under two session zones."""
    from dateutil import parser

    r = random.Random(4)
    rows = []
    for k in range(300):
        t = dt.datetime(r.randint(1976, 2070), r.randint(1, 12), r.randint(1, 28), r.randint(0, 23), r.randint(0, 59), r.randint(0, 59), r.randint(0, 999999)).strftime(FORMS[k % len(FORMS)])
        rows.append(t.upper() if k % 7 == 0 else f"  {t} " if k % 11 == 0 else t)
    rows += ["", "x", "31/31/2023", "2023-02-30", "12 monkeys", "Feb 29 2023", "Feb 29 2024", "may may 2020", "1 2 3 4", "99/10/13", "01-99-Jan", "hello 2023-10-13", "2023-10-13 10:00 PM", "2023-10-13T22:47:14-0700", "Sept 5, 2021", "10:36:28 Thu Sep 25 2003", None]

    def free(t):
        try:
            return parser.parse(t).date().isoformat()
        except (ValueError, OverflowError, TypeError):
            return None

    stated = [("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %z", "2023-10-13T22:47:14-0700"), ("%Y-%m-%dT%H:%M:%S%z", "%d/%m/%y %I:%M:%S %p %a %A %b %B %j %f %%", "2023-03-12T02:30:05Z"), ("%Y-%m-%dT%H:%M:%S%z", "%H", "2023-10-13T22:47:14"),
              ("%d.%m.%y", "%Y-%m-%d", "1.2.69"), ("%Y%m%d%H", "%H o'clock %Y", "2023031202"), ("%Y-%m-%d %H:%M:%S.%f", "%f|%S", "2023-01-02 03:04:05.012345"), ("%I:%M %p", "%H:%M", "01:05 PM"), ("%Y-%m-%d", "", "2023-01-02")]

    def strict(a, b, t):
        try:
            return dt.datetime.strptime(t, a).strftime(b)
        except ValueError:
            return None

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", any_date(F.col("t")).cast("string").alias("d")).collect()
        assert [(x.t, x.d) for x in got if x.d != free(x.t)] == []
        for a, b, t in stated:
            wall, offset = read_date(F.col("t"), a, False)
            assert spark.createDataFrame([(t,)], "t string").select(write_date(wall, b, offset)).first()[0] == strict(a, b, t)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    with pytest.raises(ValueError):
        read_date(F.col("t"), "%Q", True)


def test_enum_kinds(spark):
    df = spark.createDataFrame([(0, "0", 1.0, True), (1, "1", 2.5, False), (2, "A", None, None)], "i int, s string, f double, b boolean")
    table = {"0": "text zero", 1: "one", "A": 7, 2.5: "half", None: "none"}
    enums = {"inline": [field(n, "enum", mappings=table, on_error="miss") for n in "isfb"]}
    assert [tuple(r) for r in apply_spec(df, enums).collect()] == [("miss", "text zero", "one", "one"), ("one", "miss", "half", "miss"), ("miss", "7", "none", "none")]
    large = {f"k{i}": i for i in range(60)} | {i: f"n{i}" for i in range(60)}
    got = apply_spec(df, {"inline": [field("i", "enum", mappings=large, on_error=None), field("s", "enum", mappings=large | {"A": "a"}, on_error=None)]}).collect()
    assert [tuple(r) for r in got] == [("n0", None), ("n1", None), ("n2", "a")]
    with pytest.raises(Exception, match="no mapping for [0-2]"):
        apply_spec(df, {"inline": [field("i", "enum", mappings={"0": 1})]}).collect()


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_enum_over_a_large_mapping(spark, monkeypatch, most):
    monkeypatch.setattr(lookups, "MOST_SENT", most)
    table = {f"key {i}": i * 2 for i in range(200_000)} | {5: "number", None: -1}
    df = spark.createDataFrame([(i, f"key {i * 1000}") for i in range(200)] + [(1000, None)], "id int, k string")
    out = apply_spec(df, {"inline": [field("v", "enum", source="k", mappings=table)]}, keep=("id",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (most > 0) and "Python" not in plan
    assert {r.id: r.v for r in out.collect()} == {i: str(i * 2000) for i in range(200)} | {1000: "-1"}
    with pytest.raises(Exception, match="no mapping for key x"):
        apply_spec(spark.createDataFrame([("key x",)], "k string"), {"inline": [field("v", "enum", source="k", mappings=table)]}).collect()
    told = apply_apart(spark.createDataFrame([("key x",), ("key 5",)], "k string"), {"inline": [field("v", "enum", source="k", mappings=table)]}).collect()
    assert sorted((r.v or "", [tuple(e) for e in r.errors]) for r in told) == [("", [("v", "enum: key x")]), ("10", [])]


def test_bound_query(spark):
    spark.createDataFrame([(1, "a'b"), (2, 'c"d'), (3, "e\\f"), (4, "g -- h"), (5, "'; DROP TABLE x; --")], "id int, t string").createOrReplaceTempView("quoted")
    node = {"type": "query_builder", "query": {"type": "sql_query", "query": "SELECT id FROM quoted"}, "filters": {"type": "sql_filter", "bind": True, "items": {
        "t": {"operator": "IN", "value": {"type": "external_input", "key": "words", "split_on": "|", "format_as": "DOUBLE_QUOTED_LIST"}}, "id": {"operator": ">=", "value": {"type": "external_input", "key": "least", "format_as": "INT", "ignore_if": None}}}}}
    ask = lambda **x: evaluate(node, x)
    built = ask(words="a'b|e\\f|'; DROP TABLE x; --", least=None)
    assert built == BoundQuery("SELECT id FROM quoted WHERE t IN (:p0_0, :p0_1, :p0_2)", {"p0_0": "a'b", "p0_1": "e\\f", "p0_2": "'; DROP TABLE x; --"})
    ids = lambda q: sorted(r.id for r in SqlClient(spark).search(q).collect())
    assert ids(built) == [1, 3, 5] and ids(ask(words='c"d|g -- h', least="3")) == [4]
    assert ids(BoundQuery("SELECT id FROM quoted")) == [1, 2, 3, 4, 5]
    text = evaluate({"type": "filter", "json_dumps": True, "schema": {"key": "name", "operator": "op", "value": "val"}, "items": {"id": {"operator": ">", "value": 3}, "t": {"operator": "IN", "value": ["g -- h"]}}})
    assert [r.id for r in spark.table("quoted").where(conditions(text)).collect()] == [4]


def test_pages(spark, tmp_path):
    import json

    from rowloom.sources.pages import PagedJson

    for p in range(3):
        (tmp_path / f"page{p}.json").write_text(json.dumps({"results": [{"id": p * 10 + i, "s": None if i == 3 else f"s{i % 2}", "o": {"x": i}} for i in range(5)]}))
    (tmp_path / "_ignored").write_text("no page")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)
    df = spark.read.format("paged_json").schema("id bigint, s string, o struct<x:int>").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and df.count() == 15
    found = df.where("s = 's1' AND id > 5 AND id % 2 = 1").select("id", "o.x")
    plan = found._jdf.queryExecution().executedPlan().toString()
    left = next(line for line in plan.splitlines() if "Filter" in line)
    assert "% 2" in left and "s1" not in left and "> 5" not in left  # the reader has taken these
    assert sorted(tuple(r) for r in found.collect()) == [(11, 1), (21, 1)]
    (tmp_path / "empty").mkdir()
    assert spark.read.format("paged_json").schema("id bigint").load(str(tmp_path / "empty")).count() == 0


def test_dynamic(spark):
    df = spark.createDataFrame([(1, {"metric_b": "2.5", "x": "0"}), (2, {"metric_a": "1"}), (3, None)], "id int, m map<string,string>")
    spec = {"dynamic": {"pattern": "metric_?", "from_object": "m", "transform": {"type": "float"}}, "derived": [{"name": "double", "transform": {"type": "formula", "expression": "metric_b * 2"}}]}
    out = apply_spec(df, spec, keep=("id",))
    assert out.columns == ["id", "metric_a", "metric_b", "double"] and [tuple(r) for r in out.orderBy("id").collect()] == [(1, None, 2.5, 5.0), (2, 1.0, None, None), (3, None, None, None)]
    struct = spark.sql("SELECT 1 AS id, named_struct('metric_b', 2.5D, 'metric_a', 1D, 'x', 0D) AS m")
    assert apply_spec(struct, spec).columns == ["metric_a", "metric_b", "double"]
    from rowloom.operators.compiler import _scope, expand_dynamic

    with pytest.raises(ValueError, match="more than 1 keys"):
        expand_dynamic(df, spec, _scope(df, None), most=1)


def test_one_gzip_file(spark, tmp_path):
    rows = [(i, r'quote " and' + "\ttab", None if i % 3 else "x y") for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, `a \"t\"` string, b string").repartition(7)
    path = export_csv(df, {"filename": "whole"}, str(tmp_path), ["id"], joined=True)
    raw = open(path, "rb").read()
    got = list(csv.reader(io.StringIO(gzip.decompress(raw).decode(), newline=""), delimiter="\t"))
    assert got[0] == ["id", 'a "t"', "b"] and got[1:] == [[str(i), a, b or ""] for i, a, b in rows]
    assert raw.count(b"\x1f\x8b\x08") > 1 and not list(tmp_path.rglob("*.parts")) and not list(tmp_path.rglob("*.open"))


def test_first_in_order_over_a_stream(spark, tmp_path):
    """A late row that stands earlier in the order wins while the watermark has not passed; later ones start anew."""
    from rowloom.streaming.records import apply_stream, write_stream

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [
        [("a", 5, at(0)), ("b", 1, at(1)), (None, 9, at(2))], [("a", 2, at(20)), ("b", 7, at(5)), (None, 8, at(21))], [("a", 1, at(200)), ("c", 3, at(200))],
        [("a", 0, at(10)), ("c", None, at(210))], [("z", 0, at(600))], [("z", 0, at(1200))],
    ]
    config = {"inline": [field("k", "string"), field("n", "integer")], "export": {"unique_on": ["k"]}}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, "k string, n int, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("k string, n int, ts timestamp").parquet(str(tmp_path / "in"))
            out = apply_stream(stream, config, event_time="ts", delay="1 hour", order_by=["n"])
            write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The row of a at minute 10 arrives after the watermark has passed it, and is dropped.
    assert got - {("z", 0)} == {("a", 1), ("b", 1), (None, 8), ("c", None)}
