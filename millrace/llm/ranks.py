"""Running totals over a total order, with no task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import materialize


def running(df: DataFrame, order: list[str], values: dict[str, str], name: str) -> DataFrame:
    """``df`` with, for each ``out: column``, the sum of ``column`` over the rows before.

    Rows are dealt by ranges of ``order`` and written with the number of their
    range; sums of ranges (as many rows as partitions) give each range its
    start, and a window inside the range does the rest.
    """
    keys = [F.col(c) for c in order]
    dealt = materialize(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), name)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{out}") for out, c in values.items()])
    start = start.select("_range", *[F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_start_{out}") for out in values])
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{out}") for out, c in values.items()])
    joined = found.join(F.broadcast(start), "_range")
    return joined.select(*df.columns, *[(F.col(f"_start_{out}") + F.col(f"_in_{out}")).alias(out) for out in values])
