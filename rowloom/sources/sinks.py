"""Export: gzip tab-separated files, and any format that Spark writes."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.unique import export_projection, unique_on


def export_csv(df: DataFrame, export: dict, base: str, order_by: list[str] | None = None, single_file: bool = False, joined: bool = False) -> str:
    """Drop repeated keys (``unique_on``), project ``fields`` and write base/YYYYMMDD/<filename>.<time>.<id>.csv.gz/.

    A folder of gzip parts, tab-separated, each with a header, written in parallel; ``single_file`` gathers them into one
    part by one task, for small results. With ``joined`` it is one file of that name, whose parts are written in
    parallel, sorted by ``order_by`` if given (see join_parts). Quotes are doubled, nulls and empty texts are empty
    cells, lines end in CR LF, also those inside a cell.
    """
    if export.get("unique_on"):
        if not order_by:
            raise ValueError("first-wins needs order_by")
        df = unique_on(df, export["unique_on"], order_by)
    if joined and order_by:
        df = df.orderBy(*order_by)
    out = export_projection(df, export["fields"]) if export.get("fields") else df
    out = out.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in out.columns])
    now = datetime.now()
    path = os.path.join(base, f"{now:%Y%m%d}", f"{export['filename']}.{now:%H%M%S}.{uuid.uuid4().hex[:8]}.csv.gz")
    form = {"sep": "\t", "compression": "gzip", "nullValue": "", "emptyValue": "", "quote": '"', "escape": '"', "lineSep": "\r\n"}
    if not joined:
        (out.coalesce(1) if single_file else out).write.options(**form, header=True).csv(path)
        return path
    parts, spark = path + ".parts", df.sparkSession
    spark.createDataFrame([tuple(out.columns)], [f"c{i}" for i in range(len(out.columns))]).coalesce(1).write.options(**form).csv(parts + "/header")
    out.write.options(**form).csv(parts + "/rows")
    join_parts(spark, [parts + "/header", parts + "/rows"], path, parts)
    return path


def join_parts(spark: SparkSession, folders: list[str], path: str, done: str) -> None:
    """Gzip parts of the folders, in order of their names, as the members of one gzip file. Executors have compressed
    them in parallel; the driver copies compressed bytes through a small buffer into a file of another name, renames
    it when it is whole, and removes the folder ``done``."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = file(path).getFileSystem(conf)
    out = fs.create(file(path + ".open"))
    try:
        for folder in folders:
            for name in sorted(x.getPath().getName() for x in fs.listStatus(file(folder)) if x.getPath().getName().startswith("part-")):
                part = fs.open(file(f"{folder}/{name}"))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                finally:
                    part.close()
    finally:
        out.close()
    fs.rename(file(path + ".open"), file(path))
    fs.delete(file(done), True)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir, else the warehouse), removed when
    the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/rowloom-{tag}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def write_apart(df: DataFrame, path: str, errors: str = "errors", format: str = "parquet") -> dict[str, int]:
    """Write records of apply_apart in one pass to two outputs, path/failed=false and path/failed=true; counts of both
    are observed while they are written. A column ``failed`` of the records is refused."""
    if "failed" in df.columns:
        raise ValueError("the records have a column 'failed'")
    seen = Observation()
    failed = F.size(F.col(f"`{errors}`")) > 0
    df.withColumn("failed", failed).observe(seen, F.count_if(~F.col("failed")).alias("good"), F.count_if("failed").alias("failed")).write.partitionBy("failed").format(format).save(path)
    return seen.get


def read_apart(spark: SparkSession, path: str, errors: str = "errors", format: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(good records, failed ones with their errors) of write_apart."""
    rows = spark.read.format(format).load(path)
    return rows.where("failed = 'false'").drop("failed", errors), rows.where("failed = 'true'").drop("failed")
