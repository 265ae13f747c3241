"""Making, filtering, ordering and relating event rows; native expressions but for the stack in ``structure``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.options import Preserve

_STRUCT = "named_struct('kind', {k}, 'uri', '', 'local_name', {n}, 'value', {v})"


def rows_to_events(df: DataFrame, id_col: str, root: str, columns: list[str]) -> DataFrame:
    """A document for each row: the root with an element for each column that is not null."""
    none = "cast(null as string)"

    def item(kind: str, name: str = none, value: str = none) -> str:
        return _STRUCT.format(k=f"'{kind}'", n=name, v=value)

    inner = []
    for c in columns:
        text = f"cast(`{c}` as string)"
        inner.append(f"if(`{c}` is null, array(), filter(array({item('SE', repr(c))}, {item('CH', none, text)}, {item('EE')}), e -> e.kind <> 'CH' or e.value <> ''))")
    head, tail = f"array({item('SD')}, {item('SE', repr(root))})", f"array({item('EE')}, {item('ED')})"
    out = df.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.expr(f"concat({head}, {', '.join(inner)}, {tail})")).alias("seq", "e"))
    return out.select("doc_id", F.col("seq").cast("long").alias("seq"), "e.kind", "e.uri", "e.local_name", F.lit(None).cast("string").alias("prefix"), "e.value", F.lit(None).cast("boolean").alias("local_element_ns"), F.lit(None).cast("string").alias("public_id"), F.lit(None).cast("string").alias("system_id"))


def fidelity_filter(events: DataFrame, preserve: Preserve) -> DataFrame:
    """Keeps structure and content, and the optional kinds that are preserved."""
    kinds = ["SD", "ED", "SE", "EE", "AT", "CH"] + ["CM"] * preserve.comments + ["PI"] * preserve.pis + ["DT", "ER"] * preserve.dtd + ["NS"] * preserve.prefixes
    return events.where(F.col("kind").isin(kinds))


def sort_attributes(events: DataFrame, typed: bool = False) -> DataFrame:
    """Attributes of each start tag by (local name, uri); with ``typed``, xsi:type and xsi:nil first."""
    xsi = "http://www.w3.org/2001/XMLSchema-instance"
    doc = Window.partitionBy("doc_id").orderBy("seq")
    tag = events.withColumn("_tag", F.max(F.when(F.col("kind") == "SE", F.col("seq"))).over(doc))
    rank = F.when(F.col("uri") == xsi, F.when(F.col("local_name") == "type", 0).when(F.col("local_name") == "nil", 1).otherwise(2)).otherwise(2) if typed else F.lit(2)
    own = Window.partitionBy("doc_id", "_tag", "kind").orderBy(rank, "local_name", "uri", "seq")
    first = Window.partitionBy("doc_id", "_tag", "kind")
    moved = F.when(F.col("kind") == "AT", F.min("seq").over(first) + F.row_number().over(own) - 1).otherwise(F.col("seq"))
    return tag.withColumn("seq", moved).drop("_tag")


def depths(events: DataFrame) -> DataFrame:
    """Adds depth by a running sum over each document; a start and its end have the same one."""
    doc = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == "SE", 1).when(F.col("kind") == "EE", -1).otherwise(0)
    return events.withColumn("depth", (F.sum(step).over(doc) + F.when(F.col("kind") == "EE", 1).otherwise(0)).cast("int"))


def structure(events: DataFrame) -> DataFrame:
    """Adds depth, parent_seq and path (the names of the elements around an event, outermost first).

    A stack over each document's sorted events: a task holds one batch and the
    names of the open elements, whatever the document's length. An end without
    a start leaves the stack as it is.
    """
    rows = events.drop("depth", "parent_seq", "path")
    names = [*rows.columns, "depth", "parent_seq", "path"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, seqs, above = None, [], []
        for batch in batches:
            depth, parent, path = [], [], []
            for d, seq, kind, name in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "seq", "kind", "local_name")), strict=True):
                if d != doc:
                    doc, seqs, above = d, [], []
                ends = kind == "EE" and bool(seqs)
                if ends:
                    seqs.pop()
                    above.pop()
                depth.append(len(seqs) + (ends or kind == "SE"))
                parent.append(seqs[-1] if seqs else None)
                path.append(list(above))
                if kind == "SE":
                    seqs.append(seq)
                    above.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(depth, pa.int32()), pa.array(parent, pa.int64()), pa.array(path, pa.list_(pa.string()))], names)

    added = T.StructType().add("depth", T.IntegerType()).add("parent_seq", T.LongType()).add("path", T.ArrayType(T.StringType()))
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return dealt.mapInArrow(scan, T.StructType(rows.schema.fields + added.fields))


def complete(events: DataFrame) -> DataFrame:
    """(doc_id, ok): elements balanced, one end, and the end is last."""
    found = events.groupBy("doc_id").agg(
        F.sum(F.when(F.col("kind") == "SE", 1).when(F.col("kind") == "EE", -1).otherwise(0)).alias("open"),
        F.max("seq").alias("last"),
        F.max(F.when(F.col("kind") == "ED", F.col("seq"))).alias("end"),
    )
    return found.select("doc_id", F.coalesce((F.col("open") == 0) & (F.col("last") == F.col("end")), F.lit(False)).alias("ok"))


def coalesce_text(events: DataFrame) -> DataFrame:
    """Adjacent CH rows become the first of them, with all their text."""
    doc = Window.partitionBy("doc_id").orderBy("seq")
    start = (F.col("kind") != "CH") | (F.coalesce(F.lag("kind").over(doc), F.lit("")) != "CH")
    run = events.withColumn("_run", F.sum(start.cast("int")).over(doc))
    rest = [c for c in events.columns if c not in ("doc_id", "seq", "value")]
    return run.groupBy("doc_id", "_run").agg(F.min("seq").alias("seq"), F.expr("listagg(value, '') within group (order by seq)").alias("value"), *[F.min_by(c, "seq").alias(c) for c in rest]).select(*events.columns)


def serialize(events: DataFrame) -> DataFrame:
    """(doc_id, xml) by native expressions, for documents whose names have their prefix or no namespace."""
    doc = Window.partitionBy("doc_id").orderBy("seq")
    name = "concat(if(coalesce(prefix, '') = '', '', concat(prefix, ':')), local_name)"
    rows = depths(events).withColumn("_n", F.expr(name))
    own = Window.partitionBy("doc_id", "depth").orderBy("seq")
    rows = rows.withColumn("_open", F.last(F.when(F.col("kind") == "SE", F.col("_n")), True).over(own))
    rows = rows.withColumn("_next", F.lead("kind").over(doc)).withColumn("_prev", F.lag("kind").over(doc))
    text = "replace(replace(replace(coalesce(value, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    attr = """replace(replace(replace(coalesce(value, ''), '&', '&amp;'), '<', '&lt;'), '"', '&quot;')"""
    close = "case when kind not in ('SE', 'AT', 'NS') or _next in ('AT', 'NS') then '' when _next = 'EE' then '/>' else '>' end"
    piece = F.expr(
        f"""concat(case kind
            when 'SE' then concat('<', _n)
            when 'AT' then concat(' ', _n, '="', {attr}, '"')
            when 'NS' then concat(if(coalesce(prefix, '') = '', ' xmlns', concat(' xmlns:', prefix)), '="', coalesce(uri, ''), '"')
            when 'CH' then {text}
            when 'CM' then concat('<!--', coalesce(value, ''), '-->')
            when 'PI' then concat('<?', local_name, if(coalesce(value, '') = '', '', concat(' ', value)), '?>')
            when 'ER' then concat('&', local_name, ';')
            when 'EE' then if(_prev in ('SE', 'AT', 'NS'), '', concat('</', _open, '>'))
            else '' end, {close})"""
    )
    return rows.withColumn("_p", piece).groupBy("doc_id").agg(F.expr("listagg(_p, '') within group (order by seq)").alias("xml"))


def canonical(events: DataFrame) -> DataFrame:
    """Rows that count when documents are compared: no prefixes, namespaces, blanks between tags or xsi:nil="false"."""
    xsi = "http://www.w3.org/2001/XMLSchema-instance"
    kept = events.where((F.col("kind") != "NS") & ~((F.col("kind") == "CH") & F.coalesce(F.col("value").rlike(r"^[ \t\r\n]*$"), F.lit(True))))
    kept = kept.where(~((F.col("kind") == "AT") & (F.col("uri") == xsi) & (F.col("local_name") == "nil") & F.trim("value").isin("false", "0")))
    ordered = sort_attributes(kept.withColumn("prefix", F.lit(None).cast("string")))
    place = Window.partitionBy("doc_id").orderBy("seq")
    return ordered.withColumn("seq", F.row_number().over(place).cast("long") - 1)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Canonical rows of one event table that the other lacks, with the side they are on."""
    cols = ["doc_id", "seq", "kind", "uri", "local_name", "value"]
    x, y = canonical(a).select(*cols), canonical(b).select(*cols)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))
