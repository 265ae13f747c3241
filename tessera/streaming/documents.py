"""Streams of documents: every wrapper works row by row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.codec import encode
from tessera.plans.options import Options, Preserve
from tessera.sources.binary import transcode
from tessera.sources.xml import parse, read_xml


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, doc_id, text), one row for each new file."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return files.select("path", F.xxhash64("path").alias("doc_id"), F.decode("content", "utf-8").alias("text"))


def parse_stream(texts: DataFrame, preserve: Preserve | None = None) -> DataFrame:
    """The events of a stream of texts; documents that are not well-formed give none."""
    return read_xml(texts, "text", preserve or Preserve(True, True, True, True), failed="skip")


def encode_stream(texts: DataFrame, options: Options | None = None) -> DataFrame:
    """(doc_id, data) of a stream of XML texts."""
    o = options or Options()
    return transcode(texts, "text", lambda t: encode(parse(t, o.preserve), o), "data", "binary")
