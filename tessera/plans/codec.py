"""Documents to bits and back with the built-in, learning grammars.

An event is a tuple (kind, uri, local, prefix, value, local_ns, public_id,
system_id) with kind SD ED SE EE AT CH NS CM PI DT ER. States are described by
what may follow at each of three levels of an event code; the productions that
a document teaches come before the first level, the newest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Container, Iterable, Iterator
from typing import NamedTuple

from tessera.plans.bits import Reader, Writer, width
from tessera.plans.guard import StallGuard, log
from tessera.plans.options import Options, read_header, write_header
from tessera.plans.schema import Schema

XML = "http://www.w3.org/XML/1998/namespace"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
#: Values of a channel, and of a block, up to which they share a stream.
FEW = 100


class Event(NamedTuple):
    kind: str
    uri: str | None = None
    local: str | None = None
    prefix: str | None = None
    value: str | None = None
    local_ns: bool | None = None
    public_id: str | None = None
    system_id: str | None = None


class State:
    """Event codes of one grammar state."""

    def __init__(self, *levels: list[str]):
        self.levels, self.learnt = levels, []
        self.place = {t: (i, j) for i, level in enumerate(levels) for j, t in enumerate(level)}

    def _width(self, level: int) -> int:
        more = any(self.levels[level + 1 :])
        return width(len(self.levels[level]) + more + (len(self.learnt) if level == 0 else 0))

    def write(self, w: Writer, kind: str, name: tuple | None) -> bool:
        """True if a learnt production matched."""
        known = len(self.learnt)
        for i, p in enumerate(reversed(self.learnt)):
            if p == (kind, name):
                w.number(i, self._width(0))
                return True
        level, at = self.place[kind]
        for i in range(level):
            w.number(len(self.levels[i]) + (known if i == 0 else 0), self._width(i))
        w.number(at + (known if level == 0 else 0), self._width(level))
        return False

    def read(self, r: Reader) -> tuple[str, tuple | None, bool]:
        known = len(self.learnt)
        for level, terms in enumerate(self.levels):
            at = r.number(self._width(level))
            if level == 0:
                if at < known:
                    return *self.learnt[known - 1 - at], True
                at -= known
            if at < len(terms):
                return terms[at], None, False
            if at > len(terms) or not any(self.levels[level + 1 :]):
                break
        raise ValueError("unknown event code")

    def learn(self, kind: str, name: tuple | None = None) -> None:
        if (kind, name) not in self.learnt:
            self.learnt.append((kind, name))

    def short(self, kind: str) -> bool:
        """Whether the code of a built-in production has one part."""
        return self.place[kind][0] == 0


class Table:
    """String table: URIs, prefixes, local names and values of one document."""

    def __init__(self, o: Options):
        self.uris = ["", XML, XSI]
        self.prefixes = {"": [""], XML: ["xml"], XSI: ["xsi"]}
        self.locals = {XML: ["base", "id", "lang", "space"], XSI: ["nil", "type"]}
        self.locals = {u: {n: i for i, n in enumerate(v)} for u, v in self.locals.items()}
        self.ids = {u: i for i, u in enumerate(self.uris)}
        self.most, self.room = o.value_max_length, o.value_capacity
        self.values: list[tuple[str, tuple, int] | None] = []
        self.at, self.next = {}, 0  # value: (global id, name, local id)
        self.local_values: dict[tuple, list[str | None]] = {}

    def add_uri(self, uri: str) -> None:
        self.ids[uri] = len(self.uris)
        self.uris.append(uri)

    def add_value(self, name: tuple, text: str) -> None:
        if not text or self.room == 0 or (self.most is not None and len(text) > self.most):
            return
        own = self.local_values.setdefault(name, [])
        i = self.next
        if self.room is not None and len(self.values) == self.room:
            old = self.values[i]
            del self.at[old[0]]
            self.local_values[old[1]][old[2]] = None
        else:
            self.values.append(None)
        self.values[i] = (text, name, len(own))
        self.at[text] = (i, name, len(own))
        own.append(text)
        self.next = i + 1 if self.room is None else (i + 1) % self.room


def _levels(o: Options) -> dict[str, tuple[list[str], ...]]:
    p = o.preserve
    group = ["CM"] * p.comments + ["PI"] * p.pis
    child = ["SE", "CH"] + ["ER"] * p.dtd
    return {
        "document": (["SE"], ["DT"] * p.dtd, group),
        "end": (["ED"], group),
        "fragment": (["SE", "ED"], group),
        "start": ([], ["EE", "AT"] + ["NS"] * p.prefixes + ["SC"] * o.self_contained + child, group),
        "content": (["EE"], child, group),
    }


class _Machine:
    """Grammar states and their moves, shared by both directions."""

    def __init__(self, o: Options):
        self.o, self.table, self.levels = o, Table(o), _levels(o)
        self.grammars: dict[tuple, tuple[State, State]] = {}
        self.stack: list[tuple[tuple, State]] = []
        self.state = State(*self.levels["fragment" if o.fragment else "document"])
        self.values = 0

    def enter(self, name: tuple) -> None:
        pair = self.grammars.get(name)
        if pair is None:
            pair = self.grammars[name] = State(*self.levels["start"]), State(*self.levels["content"])
        self.stack.append((name, self.state))
        self.state = pair[0]

    def move(self, kind: str, name: tuple | None, learnt: bool) -> None:
        """After an event: learning, then the next state."""
        inside = bool(self.stack)
        if not learnt:
            if inside and kind in ("CH", "EE") and not self.state.short(kind):
                self.state.learn(kind)
            elif kind in ("SE", "AT") and (inside or self.o.fragment):
                self.state.learn(kind, name)
        if inside and kind not in ("AT", "NS", "EE"):
            self.state = self.grammars[self.stack[-1][0]][1]
        if kind == "SE":
            if not inside and not self.o.fragment:
                self.state = State(*self.levels["end"])
            self.enter(name)
        elif kind == "EE":
            self.state = self.stack.pop()[1]


class _Encoder(_Machine):
    def __init__(self, o: Options, cookie: bool, in_header: bool | None):
        super().__init__(o)
        self.w = write_header(o, cookie, in_header)
        self.w.aligned = o.layout != "bit-packed"
        self.packed: list[bytes] = []
        self.channels: dict[tuple, list[str]] = {}
        if o.layout == "pre-compression":
            self.packed.append(self.w.done())
            self.w = Writer(True)

    def uri(self, uri: str) -> None:
        t, w = self.table, self.w
        n = width(len(t.uris) + 1)
        if uri in t.ids:
            w.number(t.ids[uri] + 1, n)
        else:
            w.number(0, n)
            w.string(uri)
            t.add_uri(uri)

    def prefix(self, uri: str, prefix: str | None) -> None:
        if self.o.preserve.prefixes:
            known = self.table.prefixes.get(uri, [])
            if known:
                self.w.number(known.index(prefix) if prefix in known else 0, width(len(known)))

    def name(self, uri: str, local: str, prefix: str | None) -> None:
        self.uri(uri)
        self.rest(uri, local, prefix)

    def new_or_known(self, known: list[str], text: str) -> None:
        """A text by its place among the known ones, or as the next of them."""
        n = width(len(known) + 1)
        if text in known:
            self.w.number(known.index(text) + 1, n)
        else:
            self.w.number(0, n)
            self.w.string(text)
            known.append(text)

    def rest(self, uri: str, local: str, prefix: str | None) -> None:
        """A name whose URI is known."""
        known = self.table.locals.setdefault(uri, {})
        if local in known:
            self.w.unsigned(0)
            self.w.number(known[local], width(len(known)))
        else:
            self.w.string(local, 1)
            known[local] = len(known)
        self.prefix(uri, prefix)

    def text(self, w: Writer, name: tuple, value: str, characters=None) -> None:
        """``characters`` writes those of a miss, behind their number."""
        t = self.table
        hit = t.at.get(value)
        if hit and hit[1] == name:
            w.unsigned(0)
            w.number(hit[2], width(len(t.local_values[name])))
        elif hit:
            w.unsigned(1)
            w.number(hit[0], width(len(t.values)))
        else:
            if characters is None:
                w.string(value, 2)
            else:
                w.unsigned(len(value) + 2)
                characters(w, value)
            t.add_value(name, value)

    def put(self, w: Writer, name: tuple, value) -> None:
        """A value as its channel holds it."""
        self.text(w, name, value)

    def value(self, name: tuple, value) -> None:
        if self.o.layout != "pre-compression":
            self.put(self.w, name, value)
            return
        self.channels.setdefault(name, []).append(value)
        self.values += 1
        if self.values == self.o.block_size:
            self.flush()

    def flush(self) -> None:
        """One block: its structure, then its value channels, in as many streams as it has."""
        groups = channel_groups({k: len(v) for k, v in self.channels.items()})
        streams = [self.w.done()]
        for group in groups:
            w = Writer(True)
            for name in group:
                for v in self.channels[name]:
                    self.put(w, name, v)
            streams.append(w.done())
        if self.values <= FEW:
            streams = [b"".join(streams)]
        self.packed += [_deflate(s) for s in streams] if self.o.compression else streams
        self.channels, self.values, self.w = {}, 0, Writer(True)

    def event(self, e: Event) -> None:
        o, w, kind = self.o, self.w, e.kind
        if kind == "SD":
            return
        if kind not in self.state.place and (kind, None) not in self.state.learnt:
            if kind in ("CM", "PI", "DT", "ER", "NS"):
                return  # not preserved
            raise ValueError(f"{kind} is not allowed here")
        named = kind in ("SE", "AT")
        name = (e.uri or "", e.local) if named else None
        learnt = self.state.write(w, kind, name)
        own = self.stack[-1][0] if self.stack else None
        if named:
            if learnt:
                self.prefix(name[0], e.prefix)
            else:
                self.name(*name, e.prefix)
            if kind == "AT":
                if name == (XSI, "type"):
                    uri, _, local = (e.value or "").rpartition("}")
                    self.name(uri.lstrip("{"), local, None)
                else:
                    self.value(name, e.value or "")
        elif kind == "CH":
            self.value(own, e.value or "")
        elif kind == "NS":
            self.uri(e.uri or "")
            self.new_or_known(self.table.prefixes.setdefault(e.uri or "", []), e.prefix or "")
            w.number(int(bool(e.local_ns)), 1)
        elif kind == "CM":
            w.string(e.value or "")
        elif kind == "PI":
            w.string(e.local)
            w.string(e.value or "")
        elif kind == "DT":
            for x in (e.local, e.public_id, e.system_id, e.value):
                w.string(x or "")
        elif kind == "ER":
            w.string(e.local)
        if kind == "ED" and o.layout == "pre-compression":
            self.flush()
        self.move(kind, name, learnt)

    def done(self) -> bytes:
        return b"".join(self.packed) if self.packed else self.w.done()


def _deflate(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


def channel_groups(sizes: dict) -> list[list]:
    """Channels in the order of their streams: all of a small block; else the small ones, then each large one."""
    if sum(sizes.values()) <= FEW:
        return [list(sizes)]
    few = [k for k, n in sizes.items() if n <= FEW]
    return ([few] if few else []) + [[k] for k, n in sizes.items() if n > FEW]


def encode(events: Iterable[Event], o: Options | None = None, cookie: bool = False, in_header: bool | None = None, schema: Schema | None = None, self_contained: Container[tuple] | None = None) -> bytes:
    """The stream of one document, with ``schema`` by its grammars.

    With the option for self-contained elements, elements with a name in
    ``self_contained`` (by default none) are written as such. Raises ValueError
    for events out of place or elements left open.
    """
    o = (o or Options()).check()
    coder, last = _coder(o, schema, "_Encoder")(o, cookie, in_header), ""
    coder.apart = self_contained or ()
    for e in events:
        if last == "ED":
            raise ValueError("events after the end of the document")
        coder.event(e)
        last = e.kind
    if last != "ED" or coder.stack:
        raise ValueError("the document is not complete")
    return coder.done()


def _coder(o: Options, schema: Schema | None, side: str):
    """The class, or maker, of the coder that the options and the schema ask for."""
    if schema is None and o.schema_id == "":
        schema = Schema({}, {}, {})
    if schema is not None and o.schema_id is not False:
        from tessera.plans import informed

        return informed.Encoder.of(schema) if side == "_Encoder" else informed.Decoder.of(schema)
    if o.schema_id:
        raise ValueError(f"the stream needs the schema {o.schema_id}")
    if o.strict or o.self_contained:
        from tessera.plans import informed

        return informed.Encoder.of(None) if side == "_Encoder" else informed.Decoder.of(None)
    return _Encoder if side == "_Encoder" else _Decoder


class _Decoder(_Machine):
    lenient = False

    def __init__(self, o: Options, r: Reader):
        self.r = r
        super().__init__(o)
        self.data = b""
        self.r.aligned = o.layout != "bit-packed"
        if o.layout == "pre-compression":
            self.data = self.r.rest()
            self.r = Reader(self.stream(), True)

    def stream(self) -> bytes:
        if not self.o.compression:
            out, self.data = self.data, b""
            return out
        z = zlib.decompressobj(-15)
        out = z.decompress(self.data)
        self.data = z.unused_data
        return out

    def uri(self) -> str:
        t = self.table
        i = self.r.number(width(len(t.uris) + 1))
        if i:
            return t.uris[i - 1]
        uri = self.r.string()
        t.add_uri(uri)
        return uri

    def prefix(self, uri: str) -> str | None:
        known = self.table.prefixes.get(uri, []) if self.o.preserve.prefixes else []
        return known[self.r.number(width(len(known)))] if known else None

    def name(self) -> tuple[str, str, str | None]:
        return self.rest(self.uri())

    def new_or_known(self, known: list[str]) -> str:
        i = self.r.number(width(len(known) + 1))
        if not i:
            known.append(self.r.string())
        return known[i - 1]

    def rest(self, uri: str) -> tuple[str, str, str | None]:
        """A name whose URI is known."""
        known = self.table.locals.setdefault(uri, {})
        n = self.r.unsigned()
        if n:
            local = self.r.characters(n - 1)
            known[local] = len(known)
        else:
            local = list(known)[self.r.number(width(len(known)))]
        return uri, local, self.prefix(uri)

    def get(self, r: Reader, later) -> str:
        """A value that is described as ``event`` left it."""
        return self.text(r, later)

    def text(self, r: Reader, name: tuple, characters=None) -> str:
        t, n = self.table, r.unsigned()
        if n == 0:
            own = t.local_values[name]
            return own[r.number(width(len(own)))]
        if n == 1:
            return t.values[r.number(width(len(t.values)))][0]
        value = r.characters(n - 2) if characters is None else characters(r, n - 2)
        if value not in t.at:
            t.add_value(name, value)
        return value

    def event(self) -> tuple[Event, tuple | None]:
        """An event, and the channel of its value if that comes later."""
        kind, name, learnt = self.state.read(self.r)
        if kind == "SC":
            return self.begin_apart()
        r, later, own = self.r, None, self.stack[-1][0] if self.stack else None
        e = Event(kind)
        if kind in ("SE", "AT"):
            if learnt:
                e = e._replace(uri=name[0], local=name[1], prefix=self.prefix(name[0]))
            else:
                uri, local, prefix = self.name()
                name, e = (uri, local), e._replace(uri=uri, local=local, prefix=prefix)
            if kind == "AT":
                if name == (XSI, "type"):
                    uri, local, _ = self.name()
                    e = e._replace(value=f"{{{uri}}}{local}" if uri else local)
                else:
                    later = name
        elif kind == "CH":
            later = own
        elif kind == "NS":
            uri = self.uri()
            prefix = self.new_or_known(self.table.prefixes.setdefault(uri, []))
            e = e._replace(uri=uri, prefix=prefix, local_ns=bool(r.number(1)))
        elif kind == "CM":
            e = e._replace(value=r.string())
        elif kind == "PI":
            e = e._replace(local=r.string(), value=r.string())
        elif kind == "DT":
            a, b, c, d = (r.string() for _ in range(4))
            e = e._replace(local=a, public_id=b or None, system_id=c or None, value=d or None)
        elif kind == "ER":
            e = e._replace(local=r.string())
        if later and self.o.layout != "pre-compression":
            e, later = e._replace(value=self.get(r, later)), None
        self.move(kind, name, learnt)
        return e, later

    def channel(self, later) -> tuple:
        return later

    def block(self) -> Iterator[Event]:
        """The events of one block of a channelled stream."""
        events: list[Event] = []
        places: dict[tuple, list[tuple]] = {}
        n = 0
        while n < self.o.block_size:
            try:
                e, later = self.event()
            except EOFError:
                if not (self.lenient and events and events[-1].kind == "EE" and not self.stack):
                    raise
                e, later = Event("ED"), None
            events.append(e)
            if later:
                places.setdefault(self.channel(later), []).append((len(events) - 1, later))
                n += 1
            if e.kind == "ED":
                break
        r = self.r
        for group in channel_groups({k: len(v) for k, v in places.items()}):
            if self.o.compression and n > FEW:
                r = Reader(self.stream(), True)
            for name in group:
                for i, later in places[name]:
                    events[i] = events[i]._replace(value=self.get(r, later))
        if events[-1].kind != "ED":
            self.r = Reader(self.stream(), True) if self.o.compression else r
        yield from events


def decode(data: bytes, outside: Options | None = None, schema: Schema | None = None, lenient: bool = False) -> Iterator[Event]:
    """Events of a stream, from SD to ED.

    Raises ValueError or EOFError for streams that are not whole, and for those
    that go on without reading a bit. With ``lenient``, a stream that stops
    behind its last element gets its end.
    """
    o, r, header = read_header(data, outside)
    log.debug("header %s, options %s", header, o)
    coder = _coder(o.check(), schema, "_Decoder")(o, r)
    coder.lenient = lenient
    yield Event("SD")
    stall, closed = StallGuard(), False
    ended = False
    held: Event | None = None  # a start whose prefix a following namespace may give
    while not ended:
        stall.step(coder.r.at, len(coder.data), len(coder.stack), coder.state)
        try:
            events = list(coder.block()) if coder.o.layout == "pre-compression" else [coder.event()[0]]
        except EOFError:
            if not (lenient and closed and not coder.stack):
                raise
            events = [Event("ED")]
        for e in events:
            closed = e.kind == "EE"
            if held is not None:
                if e.kind == "NS" and e.local_ns and e.uri == held.uri:
                    held = held._replace(prefix=e.prefix)
                yield held
                held = None
            if e.kind == "SE" and coder.o.preserve.prefixes:
                held = e
                continue
            ended = e.kind == "ED"
            yield e
    if coder.stack:
        raise ValueError("elements are left open")
