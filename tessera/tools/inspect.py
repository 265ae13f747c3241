"""Looking into streams and grammars, as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import events as E
from tessera.plans import grammar
from tessera.plans.codec import Event, _coder, decode, encode
from tessera.plans.options import ALIGNMENTS, Options, read_header
from tessera.plans.schema import Schema
from tessera.sources.xml import parse


def trace(data: bytes, outside: Options | None = None, schema: Schema | None = None) -> Iterator[tuple[int, int, Event]]:
    """(first bit, number of bits, event) of a stream that holds its values in place."""
    o, r, _ = read_header(data, outside)
    if o.check().layout == "pre-compression":
        raise ValueError("values are not in place in this layout")
    coder = _coder(o, schema, "_Decoder")(o, r)
    e = Event("SD")
    while e.kind != "ED":
        at = coder.r.at
        e, _ = coder.event()
        yield at, coder.r.at - at, e


def trace_table(streams: DataFrame, column: str = "data", outside: Options | None = None, schema: Schema | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, seq, bit, bits, kind, uri, local_name, value) of a column of streams."""
    fields = "doc_id long, seq long, bit long, bits long, kind string, uri string, local_name string, value string"
    kinds = [pa.int64()] * 4 + [pa.string()] * 4

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if value.is_valid:
                    rows = [(key, n, at, bits, e.kind, e.uri, e.local, e.value) for n, (at, bits, e) in enumerate(trace(bytes(value.as_py()), outside, schema))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split(" ")[0] for f in fields.split(", ")])

    return streams.select(F.col(id_col).cast("long").alias("doc_id"), column).mapInArrow(scan, fields)


def grammar_table(spark: SparkSession, schema: Schema, options: Options | None = None) -> DataFrame:
    """(element, node, code, terminal, next) of each global element's grammar."""
    g = grammar.Grammars(schema, (options or Options()).check())
    rows = [(e.name, *row) for e in schema.elements.values() for row in grammar.dump(g, grammar.Decl(e.type, e.nillable))]
    return spark.createDataFrame(rows, "element string, node int, code string, terminal string, next int")


def cross_check(docs: DataFrame, column: str, schema: Schema | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, layout, result): OK, FAIL (other events come back) or ERROR, for each document and layout."""
    layouts = [*ALIGNMENTS, "compression"]

    def one(text: str, layout: str) -> str:
        o = Options(alignment="bit-packed" if layout == "compression" else layout, compression=layout == "compression")
        try:
            given = parse(text, o.preserve)
            back = list(decode(encode(given, o, schema=schema), None, schema))
            again = encode(back, o, schema=schema)
            # typed values come back in canonical form, which is coded to the same bytes
            same = list(decode(again, None, schema)) == back if schema else back == given
            return "OK" if same else "FAIL"
        except (ValueError, EOFError):
            return "ERROR"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, x, one(text, x)) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text is not None for x in layouts]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "layout", "result"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), column).mapInArrow(scan, "doc_id long, layout string, result string")


def tally(results: DataFrame) -> DataFrame:
    """(layout, result, n) of a cross check."""
    return results.groupBy("layout", "result").agg(F.count("*").alias("n"))


def infoset_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of canonical events by kind that one table has and the other lacks."""
    return E.differences(a, b).groupBy("kind", "side").agg(F.count("*").alias("n"))
