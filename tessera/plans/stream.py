"""One large document in little memory: text in pieces to a stream in pieces, and files to files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from tessera.plans.codec import Event, _coder, decode
from tessera.plans.guard import MemoryGuard
from tessera.plans.options import Options
from tessera.plans.schema import Schema
from tessera.sources.xml import iterparse, serialize

#: Bytes that are held before they go out, in the library and on the command line; bytes read at once.
FLUSH, FLUSH_FILE, READ = 1 << 16, 8 << 20, 1 << 16


def check_streaming(o: Options) -> Options:
    """Raises ValueError for layouts that hold back a block's values."""
    if o.check().layout == "pre-compression":
        raise ValueError("compression and pre-compression cannot be written as a stream")
    return o


class StreamEncoder:
    """Takes events one by one; bytes that are complete can be taken out at any time."""

    def __init__(self, o: Options | None = None, cookie: bool = False, in_header: bool | None = None, schema: Schema | None = None, guard: MemoryGuard | None = None):
        o = (o or Options()).check()
        self.coder, self.o, self.guard, self.ended = _coder(o, schema, "_Encoder")(o, cookie, in_header), o, guard, False

    def event(self, e: Event) -> None:
        if self.ended:
            raise ValueError("events after the end of the document")
        self.coder.event(e)
        self.ended = e.kind == "ED"
        if self.guard and e.kind in ("AT", "CH"):
            self.guard.added()

    def flush_to(self, sink: BinaryIO, least: int = 0) -> int:
        """Writes the whole bytes so far if there are ``least`` or more; their number."""
        check_streaming(self.o)
        out = self.coder.w.out
        n = len(out) if len(out) >= least else 0
        if n:
            sink.write(bytes(out))
            out.clear()
        return n

    def finish(self) -> bytes:
        """What is left. Raises ValueError for a document that is not complete."""
        if not self.ended or self.coder.stack:
            raise ValueError("the document is not complete")
        return self.coder.done()

    def finish_to(self, sink: BinaryIO) -> None:
        sink.write(self.finish())


def encode_text(chunks: Iterable[str | bytes], sink: BinaryIO, o: Options | None = None, cookie: bool = False, schema: Schema | None = None, flush: int = FLUSH, external=None, guard: MemoryGuard | None = None) -> None:
    """An XML text in pieces to a stream in ``sink``: memory holds the open elements, the tables, and ``flush`` bytes."""
    o = check_streaming(o or Options())
    coder = StreamEncoder(o, cookie, None, schema, guard)
    for e in iterparse(chunks, o.preserve, external):
        coder.event(e)
        coder.flush_to(sink, flush)
    coder.finish_to(sink)


def _pieces(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while piece := f.read(READ):
            yield piece


def _replaced(path: str, write) -> None:
    """Writes beside ``path`` and renames, so that no half file is ever found there."""
    held = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(held, "wb") as f:
            write(f)
        os.replace(held, path)
    except BaseException:
        if os.path.exists(held):
            os.remove(held)
        raise


def encode_file(source: str, target: str, o: Options | None = None, cookie: bool = False, schema: Schema | None = None, flush: int = FLUSH_FILE) -> None:
    """An XML file to a stream file; piece by piece where the layout allows it."""
    o = (o or Options()).check()
    if o.layout == "pre-compression":
        coder = StreamEncoder(o, cookie, None, schema)
        for e in iterparse(_pieces(source), o.preserve):
            coder.event(e)
        _replaced(target, coder.finish_to)
    else:
        _replaced(target, lambda f: encode_text(_pieces(source), f, o, cookie, schema, flush))


def decode_file(source: str, target: str, o: Options | None = None, schema: Schema | None = None, indent: int = 0) -> None:
    with open(source, "rb") as f:
        events = list(decode(f.read(), o, schema))
    _replaced(target, lambda f: f.write(serialize(events, indent).encode()))
