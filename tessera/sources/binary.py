"""Binary streams: encode and decode columns, and the ``exi`` data source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.model import EVENT_COLUMNS, EVENTS
from tessera.plans.bits import Reader, Writer
from tessera.plans.codec import Event, decode, encode
from tessera.plans.options import Options, Preserve, read_header, read_options, write_header, write_options
from tessera.plans.schema import Schema
from tessera.sources.xml import event_rows, fold_documents


def encode_events(events: DataFrame, options: Options | None = None, cookie: bool = False, schema: Schema | None = None, self_contained: list[tuple] | None = None) -> DataFrame:
    """(doc_id, data): each document's stream. A schema is sent to the tasks as compiled, its grammars are made there."""
    return fold_documents(events, lambda es: encode(es, options, cookie, None, schema, self_contained), "data", "binary")


def decode_streams(streams: DataFrame, column: str = "data", options: Options | None = None, id_col: str = "doc_id", failed: str = "raise", schema: Schema | None = None) -> DataFrame:
    """The events of a column of streams."""
    return event_rows(streams, column, lambda b: list(decode(bytes(b), options, schema)), id_col, failed)


def transcode(docs: DataFrame, column: str, make, out: str, type_: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, out): ``make`` of each value, document by document, without an event table between."""
    kinds = {"string": pa.string(), "binary": pa.binary()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if not v.is_valid else make(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, kinds[type_])], ["doc_id", out])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), column).mapInArrow(scan, f"doc_id long, {out} {type_}")


def header_struct(data: bytes) -> dict:
    """What a stream's header says, as plain values."""
    o, _, h = read_header(data)
    return h | {"alignment": o.alignment, "compression": o.compression, "strict": o.strict, "fragment": o.fragment, "block_size": o.block_size, "value_max_length": o.value_max_length, "value_capacity": o.value_capacity}


def is_compressed(data: bytes, options: Options | None = None) -> bool:
    """What the header, or else ``options``, says about compression; only the header is read."""
    return read_header(data, options)[0].compression


def with_header(body: bytes, options: Options, cookie: bool = False) -> bytes:
    """A body that has no header of its own, such as blocks that were kept apart, behind one that holds its options.

    Only for layouts whose body begins at a byte.
    """
    if options.layout == "bit-packed":
        raise ValueError("the body of a bit-packed stream does not begin at a byte")
    return write_header(options.check(), cookie, True).done() + body


def options_bytes(options: Options) -> bytes:
    """The options document alone."""
    w = Writer()
    write_options(w, options.check())
    return w.done()


def options_of(data: bytes) -> Options:
    return read_options(Reader(data)).check()


def has_cookie(column: str):
    """Whether a stream starts with the cookie; native."""
    return F.expr(f"substring({column}, 1, 4) = X'24455849'")


class _Part(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class ExiReader(DataSourceReader):
    """One task for each file; doc_id is the file's place in the sorted list."""

    def __init__(self, options: dict):
        flags = {k: options.get(k, "false").lower() == "true" for k in ("comments", "pis", "dtd", "prefixes", "lexical_values", "whitespace")}
        self.path = options["path"]
        self.outside = Options(alignment=options.get("alignment", "bit-packed"), compression=options.get("compression", "false").lower() == "true", fragment=options.get("fragment", "false").lower() == "true", preserve=Preserve(**flags))

    def partitions(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(base)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base))
        return [_Part(f.path, i) for i, f in enumerate(sorted((f for f in found if f.is_file and not f.base_name.startswith("_")), key=lambda f: f.path))]

    def read(self, partition):
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with system.open_input_file(partition.path) as f:
            data = f.read()
        for n, e in enumerate(decode(data, self.outside)):
            yield (partition.number, n, *e)


class ExiWriter(DataSourceArrowWriter):
    """A file for each document of a partition, whose rows are sorted by (doc_id, seq).

    Files have names of their own for each attempt until the task has
    finished; the driver gives those of finished tasks their names,
    ``<doc_id>.exi``, and deletes the others' on failure.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.options = ExiReader(options).outside
        self.path, self.overwrite = options["path"], overwrite

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, batches):
        system, base = self._system()
        system.create_dir(base, recursive=True)
        made, now, held = [], None, []

        def done():
            name = f"{base}/_{uuid.uuid4().hex}"
            with system.open_output_stream(name, compression=None) as f:
                f.write(encode(held, self.options, True))
            made.append((name, f"{base}/{now}.exi"))

        for batch in batches:
            for key, _, *rest in zip(*(batch.column(c).to_pylist() for c in EVENT_COLUMNS), strict=True):
                if key != now and held:
                    done()
                    held = []
                now = key
                held.append(Event(*rest))
        if held:
            done()
        return _Made(made)

    def commit(self, messages):
        system, base = self._system()
        from pyarrow import fs

        names = [pair for m in messages if m for pair in m.files]
        if len({final for _, final in names}) < len(names):
            self.abort(messages)
            raise ValueError("a document's rows are in several partitions; repartition by doc_id first")
        if self.overwrite:
            system.create_dir(base, recursive=True)
            for f in system.get_file_info(fs.FileSelector(base)):
                if f.path.endswith(".exi"):
                    system.delete_file(f.path)
        for held, final in names:
            system.move(held, final)

    def abort(self, messages):
        system, _ = self._system()
        for m in messages:
            for held, _ in m.files if m else ():
                system.delete_file(held)


@dataclass
class _Made(WriterCommitMessage):
    files: list


class ExiSource(DataSource):
    """``spark.dataSource.register(ExiSource)``, then ``spark.read.format("exi").load(path)``, or
    ``events.repartition("doc_id").sortWithinPartitions("doc_id", "seq").write.format("exi").mode("append").save(path)``."""

    @classmethod
    def name(cls):
        return "exi"

    def schema(self):
        return EVENTS

    def reader(self, schema):
        return ExiReader(self.options)

    def writer(self, schema, overwrite):
        return ExiWriter(self.options, overwrite)
