"""Running totals within groups of any size, by DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes that one window partition should hold on average.
ROWS_PER_BUCKET, BYTES_PER_BUCKET = 50_000, 32 << 20


def running(df: DataFrame, group: str, weight: Column, order: list[str], n_rows: int, out: str, piece: Column | None = None, n_bytes: int = 0) -> DataFrame:
    """Adds ``out``: the total weight of the rows before this one in its group.

    Rows of a group are ordered by a hash of ``order`` and then ``order``
    itself. The hash's leading bits name a bucket; a window runs within each
    bucket, and bucket totals, partially aggregated, give the offsets. A group
    that holds most rows is thereby split like any other. Buckets are sized by
    rows, and by ``n_bytes``, what the rows carry altogether.

    With ``piece``, a number that does not fall along ``order``, rows keep the
    order itself, and the pieces take the place of the buckets. ``df`` should
    carry its own columns in a struct: names here start with ``_``.
    """
    bits = max(4, math.ceil(math.log2(max(1.0, n_rows / ROWS_PER_BUCKET, n_bytes / BYTES_PER_BUCKET))))
    key = F.expr(f"shiftrightunsigned(_h, {64 - bits})") if piece is None else piece
    rows = df.withColumn("_h", F.xxhash64(*order) if piece is None else F.lit(0)).withColumn("_k", key).withColumn("_w", weight)
    inside = Window.partitionBy(group, "_k").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, "_k").agg(F.sum("_w").alias("_t"))
    above = Window.partitionBy(group).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_k", F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_o"))
    ranked = rows.withColumn("_b", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return ranked.join(offsets, [group, "_k"]).withColumn(out, F.col("_o") + F.col("_b")).drop("_h", "_k", "_w", "_b", "_o")
