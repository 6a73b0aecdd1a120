"""Written tables: they cut the lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table: in the shared checkpoint folder, or a temporary one in local sessions."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir() + "/tidemark-rounds"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered_rows(df: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds the number, from 1, of each row among those with equal ``by`` in that order.

    Rows are dealt by ranges of (by, order), so one value of ``by`` with most rows is split over many tasks; rows of one
    value lie together in a task, and what other tasks hold of it before is a sum over one row a task and value. A column
    ``name`` is replaced."""
    df = df.drop(name)
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = cut(dealt.withColumn("_nr_at", F.monotonically_increasing_id())).withColumn("_nr_task", F.expr("shiftright(_nr_at, 33)"))
    parts = rows.groupBy(*by, "_nr_task").agg(F.min("_nr_at").alias("_nr_first"), F.count(F.lit(1)).alias("_nr_n"))
    before = F.coalesce(F.sum("_nr_n").over(Window.partitionBy(*by).orderBy("_nr_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"_nr_by{k}") for k, c in enumerate(by)), F.col("_nr_task").alias("_nr_of"), "_nr_first", before.alias("_nr_before"))
    on = F.col("_nr_task") == F.col("_nr_of")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_nr_by{k}"))
    return rows.join(parts, on).select(*df.columns, (F.col("_nr_before") + F.col("_nr_at") - F.col("_nr_first") + 1).alias(name))
