"""Blanks between tags: which text events of blanks count, by windows over the event table.

A blank text counts where text is content: in an element of simple type, in
mixed content, or anywhere if whitespace is preserved. In others it is kept
only if it is all that its element holds, which the next event tells; in strict
streams it never is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANK = r"^[ \t\r\n]*$"


def _around(events: DataFrame) -> DataFrame:
    """Adds _next, the next kind, and _before, the last kind but attributes and namespaces."""
    doc = Window.partitionBy("doc_id").orderBy("seq")
    past = doc.rowsBetween(Window.unboundedPreceding, -1)
    tags = F.when(~F.col("kind").isin("AT", "NS"), F.col("kind"))
    return events.withColumn("_next", F.lead("kind").over(doc)).withColumn("_before", F.last(tags, True).over(past))


def classify(events: DataFrame, textual: Column, strict: bool = False, preserve: bool = False, nil: Column | None = None) -> DataFrame:
    """Adds ``blank``: keep, skip or look-ahead for texts of blanks, null for other rows.

    ``textual`` tells whether the event's element holds text (simple or mixed),
    ``nil`` whether it is nil, which holds none.
    """
    rows = _around(events)
    text = (F.col("kind") == "CH") & F.coalesce(F.col("value"), F.lit("")).rlike(_BLANK)
    holds = F.coalesce(textual, F.lit(False)) & (~F.coalesce(nil, F.lit(False)) if nil is not None else F.lit(True))
    rule = F.when(holds | F.lit(preserve), "keep").when(F.lit(strict), "skip").when(F.col("_before") == "SE", "look-ahead").otherwise("skip")
    return rows.withColumn("blank", F.when(text, rule)).drop("_before")


def resolve(classified: DataFrame) -> DataFrame:
    """The rows that stay: a blank that looks ahead does if the element ends next."""
    gone = (F.col("blank") == "skip") | ((F.col("blank") == "look-ahead") & F.coalesce(F.col("_next") != "EE", F.lit(True)))
    return classified.where(~F.coalesce(gone, F.lit(False))).drop("blank", "_next")


def skip_blanks(events: DataFrame, textual: Column, strict: bool = False, preserve: bool = False, nil: Column | None = None) -> DataFrame:
    """The events without the blanks that do not count."""
    return resolve(classify(events, textual, strict, preserve, nil))


def add_empty_texts(events: DataFrame, simple: Column) -> DataFrame:
    """An empty CH before the end of each element of simple type that holds nothing, as strict streams need it.

    ``simple`` tells it of the SE rows. Rows are numbered anew in their order.
    """
    doc = Window.partitionBy("doc_id").orderBy("seq")
    past = doc.rowsBetween(Window.unboundedPreceding, -1)
    tag = F.when(F.col("kind").isin("AT", "NS"), None).otherwise(F.struct("kind", simple.alias("simple")))
    rows = events.withColumn("_tag", F.last(tag, True).over(past))
    bare = (F.col("kind") == "EE") & (F.col("_tag.kind") == "SE") & F.coalesce(F.col("_tag.simple"), F.lit(False))
    rows = rows.withColumn("_extra", bare.cast("int"))
    cols = [c for c in events.columns if c != "seq"]
    made = {"kind": F.lit("CH"), "value": F.lit("")}
    keep = [c for c in cols if c == "doc_id"]
    extra = rows.where(bare).select(*[made.get(c, F.col(c) if c in keep else F.lit(None)).alias(c) for c in cols], F.col("seq"), F.lit(0).alias("_place"))
    every = rows.select(*cols, "seq", F.lit(1).alias("_place")).unionByName(extra.select(*[F.col(c).cast(events.schema[c].dataType).alias(c) for c in cols], "seq", "_place"))
    place = Window.partitionBy("doc_id").orderBy("seq", "_place")
    return every.withColumn("seq", (F.row_number().over(place) - 1).cast("long")).select(*events.columns)


def seen_twice(events: DataFrame) -> DataFrame:
    """The SE rows whose name their parent held before, which an ``all`` group does not allow; from ``structure``."""
    own = Window.partitionBy("doc_id", "parent_seq", "uri", "local_name").orderBy("seq")
    return events.where("kind = 'SE' and parent_seq is not null").withColumn("_n", F.row_number().over(own)).where("_n > 1").drop("_n")
