"""Options of a stream, the header, and the options document inside it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from tessera.plans.bits import Reader, Writer, width

COOKIE = b"$EXI"
MEDIA_TYPE, CONTENT_CODING, FILE_EXTENSION = "application/exi", "exi", ".exi"
ALIGNMENTS = ("bit-packed", "byte-alignment", "pre-compression")


@dataclass(frozen=True)
class Preserve:
    comments: bool = False
    pis: bool = False
    dtd: bool = False
    prefixes: bool = False
    lexical_values: bool = False
    whitespace: bool = False


@dataclass(frozen=True)
class Options:
    """Out-of-band or in the header. ``schema_id``: None is absent, False is nil, "" is built-in types only."""

    alignment: str = "bit-packed"
    compression: bool = False
    strict: bool = False
    fragment: bool = False
    preserve: Preserve = field(default_factory=Preserve)
    self_contained: bool = False
    schema_id: str | bool | None = None
    datatype_map: tuple[tuple[tuple[str, str], tuple[str, str]], ...] = ()
    block_size: int = 1_000_000
    value_max_length: int | None = None
    value_capacity: int | None = None

    def check(self) -> Options:
        """Raises ValueError for combinations that the format forbids."""
        p = self.preserve
        if self.alignment not in ALIGNMENTS:
            raise ValueError(f"unknown alignment {self.alignment}")
        if self.compression and self.alignment != "bit-packed":
            raise ValueError("compression excludes an alignment")
        if self.strict and (p.comments or p.pis or p.dtd or p.prefixes or self.self_contained):
            raise ValueError("strict excludes preserved comments, instructions, DTDs, prefixes and self-contained elements")
        if self.self_contained and (self.compression or self.alignment == "pre-compression"):
            raise ValueError("self-contained elements exclude compression and pre-compression")
        if self.block_size < 1:
            raise ValueError("block size below one")
        for n in (self.value_max_length, self.value_capacity):
            if n is not None and n < 0:
                raise ValueError("negative limit")
        return self

    @property
    def layout(self) -> str:
        return "pre-compression" if self.compression else self.alignment


_PRESERVE = ("dtd", "prefixes", "lexical_values", "comments", "pis")


class _Walk:
    """Event codes of a strict sequence of optional elements: what may follow, then its end."""

    def __init__(self, names: list[str], stream: Writer | Reader, wild_start: bool = False, repeat: str = ""):
        self.names, self.stream, self.at, self.wild, self.repeat = names, stream, 0, wild_start, repeat

    def _choices(self) -> list[str]:
        left = self.names[self.at :]
        return [*left, *["*"] * (self.wild and self.at == 0), "/"]

    def _took(self, name: str) -> None:
        if name in self.names:
            self.at = self.names.index(name) + (name != self.repeat)
            self.wild = False

    def write(self, name: str) -> None:
        c = self._choices()
        self.stream.bits(c.index(name), width(len(c)))
        self._took(name)

    def read(self) -> str:
        c = self._choices()
        i = self.stream.bits(width(len(c)))
        if i >= len(c):
            raise ValueError("unknown event code in the options")
        self._took(c[i])
        return c[i]


_HEADER, _LESS, _COMMON = ["lesscommon", "common", "strict"], ["uncommon", "preserve", "block_size"], ["compression", "fragment", "schema_id"]
_UNCOMMON = ["alignment", "self_contained", "value_max_length", "value_capacity", "datatype_map"]


class _Names:
    """The string table of an options document, for the qualified names of datatype maps."""

    def __init__(self) -> None:
        xsi = "http://www.w3.org/2001/XMLSchema-instance"
        self.uris = ["", "http://www.w3.org/XML/1998/namespace", xsi, "http://www.w3.org/2001/XMLSchema", "http://www.w3.org/2009/exi"]
        self.locals: dict[str, list[str]] = {}

    def write(self, w: Writer, uri: str, local: str) -> None:
        n = width(len(self.uris) + 1)
        if uri in self.uris:
            w.bits(self.uris.index(uri) + 1, n)
        else:
            w.bits(0, n)
            w.string(uri)
            self.uris.append(uri)
        known = self.locals.setdefault(uri, [])
        if local in known:
            w.unsigned(0)
            w.bits(known.index(local), width(len(known)))
        else:
            w.string(local, 1)
            known.append(local)

    def read(self, r: Reader) -> tuple[str, str]:
        i = r.bits(width(len(self.uris) + 1))
        if i:
            uri = self.uris[i - 1]
        else:
            uri = r.string()
            self.uris.append(uri)
        known = self.locals.setdefault(uri, [])
        n = r.unsigned()
        if not n:
            return uri, known[r.bits(width(len(known)))]
        known.append(r.characters(n - 1))
        return uri, known[-1]


def write_options(w: Writer, o: Options) -> None:
    """The options document: strict, bit-packed, values that differ from the defaults."""
    d = Options()
    w.bits(0, 1)
    uncommon = [n for n in _UNCOMMON if getattr(o, n) != getattr(d, n)]
    preserve = [n for n in _PRESERVE if getattr(o.preserve, n)]
    size = o.block_size != d.block_size and o.layout == "pre-compression"
    head = _Walk(_HEADER, w)
    if uncommon or preserve or size:
        head.write("lesscommon")
        less = _Walk(_LESS, w)
        if uncommon:
            less.write("uncommon")
            walk, names = _Walk(_UNCOMMON, w, True, "datatype_map"), _Names()
            for name in uncommon:
                if name == "alignment":
                    walk.write(name)
                    w.bits(ALIGNMENTS.index(o.alignment) - 1, 1)
                elif name == "datatype_map":
                    for pair in o.datatype_map:
                        walk.write(name)
                        for q in pair:
                            names.write(w, *q)
                else:
                    walk.write(name)
                    if name != "self_contained":
                        w.unsigned(getattr(o, name))
            walk.write("/")
        if preserve:
            less.write("preserve")
            walk = _Walk(list(_PRESERVE), w)
            for name in preserve:
                walk.write(name)
            walk.write("/")
        if size:
            less.write("block_size")
            w.unsigned(o.block_size)
        less.write("/")
    common = [n for n in _COMMON if getattr(o, n) != getattr(d, n)]
    if common:
        head.write("common")
        walk = _Walk(_COMMON, w)
        for name in common:
            walk.write(name)
            if name == "schema_id":
                if o.schema_id is False:
                    w.bits(0b1011, 4)  # another event, xsi:nil, true, its end
                elif o.schema_id == "":
                    w.bits(0b11, 2)
                else:
                    w.bits(0, 1)
                    w.string(o.schema_id, 2)
        walk.write("/")
    if o.strict:
        head.write("strict")
    head.write("/")


def read_options(r: Reader) -> Options:
    if r.bits(1):
        raise ValueError("the options document has another root")
    got: dict = {}
    head = _Walk(_HEADER, r)
    while (name := head.read()) != "/":
        if name == "strict":
            got["strict"] = True
        elif name == "common":
            walk = _Walk(_COMMON, r)
            while (sub := walk.read()) != "/":
                if sub != "schema_id":
                    got[sub] = True
                elif not r.bits(1):
                    got[sub] = r.characters(r.unsigned() - 2)
                elif r.bits(1):
                    got[sub] = ""
                else:
                    got[sub] = False if r.bits(1) else ""
                    r.bits(1)
        else:
            less = _Walk(_LESS, r)
            while (sub := less.read()) != "/":
                if sub == "block_size":
                    got[sub] = r.unsigned()
                elif sub == "preserve":
                    walk, kept = _Walk(list(_PRESERVE), r), {}
                    while (p := walk.read()) != "/":
                        kept[p] = True
                    got["preserve"] = Preserve(**kept)
                else:
                    walk, names = _Walk(_UNCOMMON, r, True, "datatype_map"), _Names()
                    while (u := walk.read()) != "/":
                        if u == "alignment":
                            got[u] = ALIGNMENTS[r.bits(1) + 1]
                        elif u == "self_contained":
                            got[u] = True
                        elif u == "datatype_map":
                            got[u] = (*got.get(u, ()), (names.read(r), names.read(r)))
                        elif u == "*":
                            raise ValueError("user-defined options are not supported")
                        else:
                            got[u] = r.unsigned()
    return Options(**got)


def write_header(o: Options, cookie: bool = False, in_header: bool | None = None) -> Writer:
    """A writer that holds the header. By default options go in if any differs from its default."""
    w = Writer()
    if cookie:
        for b in COOKIE:
            w.bits(b, 8)
    present = o != Options() if in_header is None else in_header
    w.bits(0b10, 2)
    w.bits(int(present), 1)
    w.bits(0, 5)  # final version 1
    if present:
        write_options(w, o)
    if o.layout != "bit-packed":
        w.align()
    return w


def read_header(data: bytes, outside: Options | None = None) -> tuple[Options, Reader, dict]:
    """Options, a reader behind the header, and what the header says. Options in the header count."""
    r = Reader(data)
    cookie = data[:4] == COOKIE
    if cookie:
        r.at = 32
    if r.bits(2) != 0b10:
        raise ValueError("not a stream of this format")
    present, preview, version = bool(r.bits(1)), bool(r.bits(1)), 1
    while (part := r.bits(4)) == 15:
        version += 15
    version += part
    if version != 1 or preview:
        raise ValueError(f"version {version} is not supported")
    o = read_options(r) if present else outside or Options()
    if present and outside is not None:
        o = replace(o, preserve=replace(o.preserve, whitespace=outside.preserve.whitespace))
    if o.layout != "bit-packed":
        r.align()
    return o, r, {"cookie": cookie, "options_present": present, "version": version}
