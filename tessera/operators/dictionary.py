"""String-table ids and hits as windows over the values of each document.

Values are rows (doc_id, seq, uri, local_name, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import bit_width


def values_of(events: DataFrame) -> DataFrame:
    """Attribute values under their names, and text under the name of its element."""
    from tessera.operators.events import depths

    rows = depths(events)
    own = Window.partitionBy("doc_id", "depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.col("kind") == "SE", F.struct("uri", "local_name")), True).over(own)
    rows = rows.withColumn("_o", opened).where(F.col("kind").isin("AT", "CH"))
    return rows.select("doc_id", "seq", F.when(F.col("kind") == "AT", F.col("uri")).otherwise(F.col("_o.uri")).alias("uri"), F.when(F.col("kind") == "AT", F.col("local_name")).otherwise(F.col("_o.local_name")).alias("local_name"), "value")


def value_hits(values: DataFrame, most: int | None = None) -> DataFrame:
    """Adds hit: MISS at a value's first occurrence, LOCAL if its first name is the row's, else GLOBAL; LITERAL if it is never entered."""
    w = Window.partitionBy("doc_id", "value").orderBy("seq")
    entered = F.length("value") > 0
    if most is not None:
        entered = entered & (F.length("value") <= most)
    first = F.first(F.struct("uri", "local_name")).over(w)
    hit = F.when(~entered, "LITERAL").when(F.row_number().over(w) == 1, "MISS").when(first == F.struct("uri", "local_name"), "LOCAL").otherwise("GLOBAL")
    return values.withColumn("hit", hit)


def global_ids(values: DataFrame) -> DataFrame:
    """(doc_id, value, global_id, local_id): ids in the order of first occurrence."""
    first = values.where(F.length("value") > 0).groupBy("doc_id", "value").agg(F.min(F.struct("seq", "uri", "local_name")).alias("f"))
    g = Window.partitionBy("doc_id").orderBy("f.seq")
    own = Window.partitionBy("doc_id", "f.uri", "f.local_name").orderBy("f.seq")
    return first.select("doc_id", "value", (F.row_number().over(g) - 1).alias("global_id"), (F.row_number().over(own) - 1).alias("local_id"))


def running_widths(values: DataFrame) -> DataFrame:
    """Adds size and bits: the global partition's size before each row, and the width of an id in it."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum((F.col("hit") == "MISS").cast("long")).over(w), F.lit(0))
    return value_hits(values).withColumn("size", size).withColumn("bits", bit_width("size"))


def name_ids(events: DataFrame) -> DataFrame:
    """(doc_id, uri, local_name, local_id): local names in the order of first occurrence within their URI."""
    first = events.where(F.col("kind").isin("SE", "AT")).groupBy("doc_id", "uri", "local_name").agg(F.min("seq").alias("_s"))
    w = Window.partitionBy("doc_id", "uri").orderBy("_s")
    return first.select("doc_id", "uri", "local_name", (F.row_number().over(w) - 1).alias("local_id"))


def sizes(values: DataFrame) -> DataFrame:
    """(doc_id, n_values, n_global, n_names): counts of a document's dictionary."""
    return values.where(F.length("value") > 0).groupBy("doc_id").agg(F.count("*").alias("n_values"), F.countDistinct("value").alias("n_global"), F.countDistinct("uri", "local_name").alias("n_names"))
