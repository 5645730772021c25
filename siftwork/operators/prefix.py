"""Running totals and last values over a whole table without sending it through one task.

Rows are range-partitioned by their order; what lies before a partition comes from a table of one row a partition, whose number is a setting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes for no column of rows to have one of them."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in rows.columns):
        mark += "_"
    return [mark + n for n in names]


def by_range(rows: DataFrame, part: str, *order) -> DataFrame:
    """rows with `part`, the number of their range; written, so that a row keeps its range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()).checkpoint()


def prefix_sum(rows: DataFrame, order: str, value: str, total: str) -> DataFrame:
    """rows with `total`, the sum of `value` over all rows up to this one by `order` (unique).

    Each range is summed up by itself, and the sums of whole ranges give its start. Nulls in `value` count as 0, a null in `order` comes first.
    """
    part, start, own = fresh(rows, "part", "start", "sum")
    parts = by_range(rows, part, order)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(part).agg(F.sum(value).alias(own)).withColumn(start, F.coalesce(F.sum(own).over(before), F.lit(0))).drop(own)
    inside = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(starts), part).withColumn(total, (F.col(start) + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
    return out.drop(part, start)


def carried(rows: DataFrame, order: str, values: dict[str, str], itself: bool = True) -> DataFrame:
    """rows with, for each column -> name of `values`, the column's last value that isn't null in the rows up to this one by `order` (unique, not null).

    Without `itself` in the rows before this one. Null where there is none.
    """
    part, *held = fresh(rows, "part", *(f"held{i}" for i in range(len(values))))
    parts = by_range(rows, part, order)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy(part).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(h) for v, h in zip(values, held, strict=True)))
    ends = ends.select(part, *(F.last(h, ignorenulls=True).over(before).alias(h) for h in held))
    inside = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow if itself else -1)
    out = parts.join(F.broadcast(ends), part).select("*", *(F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(h)).alias(name) for (v, name), h in zip(values.items(), held, strict=True)))
    return out.drop(part, *held)
