"""Numbers 1..n in an order over a whole table, without bringing it into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.sources.shared import cut


def numbered(df: DataFrame, name: str, *by: Column) -> DataFrame:
    """df and its rows' places by `by`, which must be a whole order: ranges are sorted apart, and only their counts meet."""
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    # One row a partition: bounded by the number of partitions.
    return placed.join(F.broadcast(before), part == F.col("_part")).select(*df.columns, (within + F.col("_before") + 1).cast("long").alias(name))
