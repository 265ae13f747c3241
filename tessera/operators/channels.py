"""Blocks, value channels and streams of a document's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.codec import FEW


def blocks(values: DataFrame, block_size: int) -> DataFrame:
    """Adds block_id: a new block after each ``block_size`` values."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    return values.withColumn("block_id", ((F.row_number().over(w) - 1) / block_size).cast("long"))


def channels(values: DataFrame) -> DataFrame:
    """(doc_id, block_id, uri, local_name, n_values, n_distinct, first_seq)."""
    return values.groupBy("doc_id", "block_id", "uri", "local_name").agg(F.count("*").alias("n_values"), F.countDistinct("value").alias("n_distinct"), F.min("seq").alias("first_seq"))


def streams(found: DataFrame) -> DataFrame:
    """Adds place and stream_no: up to FEW values a block is one stream; else the structure is stream 0, the small channels share the next, and each large one has its own."""
    block = Window.partitionBy("doc_id", "block_id")
    out = found.withColumn("_all", F.sum("n_values").over(block)).withColumn("_big", (F.col("_all") > FEW) & (F.col("n_values") > FEW))
    order = block.orderBy("_big", "first_seq")
    out = out.withColumn("place", F.row_number().over(order).cast("long") - 1)
    small = F.max((~F.col("_big")).cast("int")).over(block)
    large = F.sum(F.col("_big").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("stream_no", F.when(F.col("_all") <= FEW, 0).when(F.col("_big"), small + large).otherwise(1).cast("long")).drop("_all", "_big")
