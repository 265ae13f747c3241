"""Documents to bits and back by the grammars of a schema.

Elements that the schema declares are read by their grammars and their values
by the codecs of their types; all others fall back on the built-in, learning
grammars. Values that are not of their type are written as untyped text, or
raise an error in strict streams. Self-contained elements are fragments of
their own, with tables and grammars of their own, from one byte boundary to
another.
"""

from __future__ import annotations

from dataclasses import replace

from tessera.plans.bits import Reader, Writer
from tessera.plans.codec import XML, XSI, Event, State, _Decoder, _Encoder
from tessera.plans.grammar import Decl, Grammars, split
from tessera.plans.options import Options
from tessera.plans.schema import BUILTIN_BASES, BUILTIN_LISTS, PRIMITIVES, XSD, Schema, clark
from tessera.plans.values import UNTYPED, Boolean, Codecs

TYPE, NIL = (XSI, "type"), (XSI, "nil")
_FLAG = Boolean()


def _made(schema: Schema, o: Options) -> tuple[Grammars, Codecs, list[tuple[str, list[str]]]]:
    """Grammars, codecs and the first names of the string table; kept with the schema for the next document."""
    kept = schema.__dict__.setdefault("made", {})
    if o not in kept:
        g = Grammars(schema, o)
        names = g.names()
        own = {XML: {"base", "id", "lang", "space"}, XSI: {"nil", "type"}, XSD: {*PRIMITIVES, *BUILTIN_BASES, *BUILTIN_LISTS, "anyType"}}
        uris = ["", *own, *sorted(set(names) - {"", *own})]
        kept[o] = g, Codecs(schema, o.preserve.lexical_values, o.datatype_map), [(u, sorted(names.get(u, set()) | own.get(u, set()))) for u in uris]
    return kept[o]


class _Coder:
    """What both directions share: the schema's part of the state."""

    schema: Schema | None = None
    apart: object = ()

    @classmethod
    def of(cls, schema: Schema | None):
        def make(*args):
            coder = cls(*args)
            coder.prepare(schema)
            return coder

        return make

    def prepare(self, schema: Schema | None) -> None:
        self.schema, self.sub, self.g = schema, None, None
        if schema is not None:
            self.g, self.codecs, names = _made(schema, self.o)
            t = self.table
            t.uris = [u for u, _ in names]
            t.ids = {u: i for i, u in enumerate(t.uris)}
            t.locals = {u: {n: i for i, n in enumerate(found)} for u, found in names}
            self.state, self.after = self.g.roots()

    def global_element(self, name: tuple) -> Decl | None:
        found = self.schema.elements.get(clark(*name)) if self.schema is not None else None
        return Decl(found.type, found.nillable) if found else None

    def enter(self, name: tuple, decl: Decl | str | None = None) -> None:
        decl = decl or self.global_element(name)
        if decl is None:
            super().enter(name)
            return
        self.stack.append((name, self.state, decl))
        self.state = self.g.relaxed()[0] if decl == "relaxed" else self.g.start(decl)

    def start(self, term: tuple, name: tuple) -> None:
        """After the start of an element by a node's production."""
        decl = self.state.infos[term] if term[0] == "SE" else None
        self.state = self.g.follow(self.state, term) if self.stack else self.after
        self.enter(name, decl)

    def switch(self, type_: str) -> None:
        """After xsi:type: the grammar of that type, if there is one."""
        if type_ in self.schema.types or type_[3:] in BUILTIN_BASES or type_[3:] in PRIMITIVES or type_[3:] in BUILTIN_LISTS or type_ == "xs:anyType":
            name, after, old = self.stack.pop()
            decl = Decl(type_, True if old == "relaxed" else old.nillable)
            self.stack.append((name, after, decl))
            self.state = self.g.start(decl, switched=True)

    def empty(self) -> None:
        """After xsi:nil: the element's grammar without content."""
        decl = self.stack[-1][2]
        self.state = self.g.relaxed(True)[0] if decl == "relaxed" else self.g.start(decl, True, True)

    def attribute_type(self, term: tuple, name: tuple) -> str | None:
        """The type of an attribute's value; None for untyped ones."""
        if term[0] == "AT":
            return self.state.infos[term]
        if term[0] in ("AT?", "AT+?"):
            return None
        found = self.schema.attributes.get(clark(*name))
        return found.type if found else None

    def text_type(self) -> str:
        return self.state.infos["CH", None]


def _qualified(value: str) -> tuple[str, str]:
    """(uri, local) of a name as {uri}local."""
    return split(value)


def _type_name(uri: str, local: str) -> str:
    return f"xs:{local}" if uri == XSD else clark(uri, local)


class Encoder(_Coder, _Encoder):
    held: Event | None = None
    first = False  # the root of a self-contained element is not one again

    def value(self, name: tuple, value) -> None:
        super().value(name, (UNTYPED, value) if isinstance(value, str) else value)

    def put(self, w: Writer, name: tuple, value) -> None:
        codec, token = value
        codec.write(w, self, name, token)

    def event(self, e: Event) -> None:
        if self.sub is not None:
            self._inside(e)
            return
        if self.held is not None:
            held, self.held = self.held, None
            if e.kind == "EE":  # blanks are all that the element holds
                self._node(held, True)
        if isinstance(self.state, State):
            if e.kind == "AT" and (e.uri or "", e.local) == TYPE and self.o.preserve.lexical_values:
                raise ValueError("xsi:type with preserved lexical values is not supported")
            super().event(e)
        else:
            self._node(e)
        if e.kind == "SE" and self.o.self_contained and not self.first and (e.uri or "", e.local) in self.apart:
            self._apart(e)
        if e.kind == "SE":
            self.first = False

    def _apart(self, e: Event) -> None:
        if isinstance(self.state, State):
            self.state.write(self.w, "SC", None)
        else:
            self.state.write(self.w, ("SC", None))
        self.w.align()
        self.sub = Encoder.of(self.schema)(replace(self.o, fragment=True), False, False)
        self.sub.w, self.sub.apart, self.sub.first = Writer(self.w.aligned), self.apart, True
        self.sub.event(e)

    def _inside(self, e: Event) -> None:
        self.sub.event(e)
        if not self.sub.stack and self.sub.sub is None:
            self.sub.event(Event("ED"))
            self.w.out += self.sub.w.done()
            self.sub = None
            self.state = self.stack.pop()[1]

    def _pick(self, *terms: tuple) -> tuple:
        for t in terms:
            if t in self.state.codes:
                return t
        raise ValueError(f"{terms[0][0]} {terms[0][1] or ''} is not allowed here".replace("  ", " "))

    def _named(self, term: tuple, e: Event, name: tuple) -> None:
        """The part of a name that its event code leaves open."""
        if term[0] in ("SE", "AT", "AT?"):
            self.prefix(name[0], e.prefix)
        elif term[0] in ("SE:", "AT:"):
            self.rest(*name, e.prefix)
        else:
            self.name(*name, e.prefix)

    def _node(self, e: Event, kept: bool = False) -> None:
        w, kind, state = self.w, e.kind, self.state
        if kind == "SD":
            return
        if kind == "SE":
            name = (e.uri or "", e.local)
            term = self._pick(("SE", name), ("SE:", name[0]), ("SE*", None), ("SE+", None))
            state.write(w, term)
            self._named(term, e, name)
            self.start(term, name)
        elif kind == "AT":
            self._attribute(e, (e.uri or "", e.local))
        elif kind == "CH":
            self._characters(e, kept)
        elif kind == "EE":
            if ("EE", None) not in state.codes and ("CH", None) in state.codes:
                self._characters(Event("CH", value=""), True)  # an empty text of its type
            self.state.write(w, self._pick(("EE", None)))
            self.state = self.stack.pop()[1]
        elif (kind, None) in state.codes:
            state.write(w, (kind, None))
            self._content(e)
            if kind == "ED" and self.o.layout == "pre-compression":
                self.flush()
            if self.stack:
                self.state = self.g.follow(state, (kind, None))
        elif kind not in ("CM", "PI", "DT", "ER", "NS"):
            raise ValueError(f"{kind} is not allowed here")

    def _content(self, e: Event) -> None:
        """What events without a value in a channel hold; the same as in built-in grammars."""
        w, kind = self.w, e.kind
        if kind == "NS":
            self.uri(e.uri or "")
            known = self.table.prefixes.setdefault(e.uri or "", [])
            self.new_or_known(known, e.prefix or "")
            w.number(int(bool(e.local_ns)), 1)
        else:
            for x in {"CM": (e.value,), "PI": (e.local, e.value), "DT": (e.local, e.public_id, e.system_id, e.value), "ER": (e.local,)}.get(kind, ()):
                w.string(x or "")

    def _attribute(self, e: Event, name: tuple) -> None:
        w, state, value = self.w, self.state, e.value or ""
        generic = [("AT:", name[0]), ("AT*", None), ("AT+", None)]
        if name == TYPE:
            term = self._pick(("TYPE", None), *generic)
            state.write(w, term)
            if term[0] != "TYPE":
                self._named(term, e, name)
            else:
                self.prefix(XSI, e.prefix)
            uri, local = _qualified(value)
            if self.o.preserve.lexical_values:
                self.text(w, name, value)
            else:
                self.name(uri, local, None)
            self.state = self.g.follow(state, term)
            self.switch(_type_name(uri, local))
            return
        if name == NIL and ("NIL", None) in state.codes and value.strip() in Boolean.FORMS:
            state.write(w, ("NIL", None))
            self.prefix(XSI, e.prefix)
            token = _FLAG.parse(value)
            _FLAG.write(w, self, name, token)
            if token >= 2:
                self.empty()
            return
        options = [t for t in (("AT", name), *generic) if t in state.codes]
        for term in options[:1]:
            type_ = self.attribute_type(term, name)
            try:
                item = self.codecs.of(type_), self.codecs.of(type_).parse(value)
            except ValueError:
                if self.o.strict:
                    raise
                term, item = self._pick(("AT?", name) if term[0] == "AT" else ("AT+?", None)), (UNTYPED, value)
            state.write(w, term)
            self._named(term, e, name)
            self.value(name, item)
            self.state = self.g.follow(state, term)
            return
        self._pick(("AT", name))

    def _characters(self, e: Event, kept: bool) -> None:
        w, state, value = self.w, self.state, e.value or ""
        name = self.stack[-1][0] if self.stack else None
        if ("CH", None) in state.codes:
            codec = self.codecs.of(self.text_type())
            try:
                item = codec, codec.parse(value)
            except ValueError:
                if self.o.strict:
                    raise
            else:
                state.write(w, ("CH", None))
                self.value(name, item)
                self.state = self.g.follow(state, ("CH", None))
                return
        if not value.strip(" \t\n\r") and not kept and ("CH?", None) not in state.codes:
            if self.o.strict:
                return
            if not self.o.preserve.whitespace:
                if ("AT+", None) in state.codes:  # nothing before it in the element
                    self.held = e
                return
        term = self._pick(("CH?", None), ("CH+", None))
        state.write(w, term)
        self.value(name, (UNTYPED, value))
        self.state = self.g.follow(state, term)


class Decoder(_Coder, _Decoder):
    fresh = False  # of a self-contained element, whose start was given already

    def get(self, r: Reader, later) -> str:
        name, codec = (later, UNTYPED) if isinstance(later[1], str) else later
        return codec.read(r, self, name)

    def channel(self, later) -> tuple:
        return later if isinstance(later[1], str) else later[0]

    def begin_apart(self) -> tuple[Event, tuple | None]:
        self.r.align()
        self.sub = Decoder.of(self.schema)(replace(self.o, fragment=True), self.r)
        self.sub.event()
        return self.event()

    def event(self) -> tuple[Event, tuple | None]:
        if self.sub is not None:
            e, later = self.sub.event()
            if e.kind != "ED":
                return e, later
            self.r.align()
            self.sub = None
            self.state = self.stack.pop()[1]
        if isinstance(self.state, State):
            return super().event()
        r, state = self.r, self.state
        term = state.read(r)
        kind, what = term
        if kind == "SC":
            return self.begin_apart()
        if kind in ("SE", "SE:", "SE*", "SE+"):
            uri, local, prefix = self._named(term)
            self.start(term, (uri, local))
            return Event("SE", uri, local, prefix), None
        if kind == "EE":
            self.state = self.stack.pop()[1]
            return Event("EE"), None
        later, e = None, Event(kind)
        own = self.stack[-1][0] if self.stack else None
        if kind in ("AT", "AT?", "AT:", "AT*", "AT+", "AT+?", "TYPE", "NIL"):
            return self._attribute(term)
        if kind in ("CH", "CH?", "CH+"):
            later = own, self.codecs.of(self.text_type()) if kind == "CH" else UNTYPED
            e = Event("CH")
        elif kind == "NS":
            uri = self.uri()
            known = self.table.prefixes.setdefault(uri, [])
            e = e._replace(uri=uri, prefix=self.new_or_known(known), local_ns=bool(r.number(1)))
        elif kind == "CM":
            e = e._replace(value=r.string())
        elif kind == "PI":
            e = e._replace(local=r.string(), value=r.string())
        elif kind == "DT":
            a, b, c, d = (r.string() for _ in range(4))
            e = e._replace(local=a, public_id=b or None, system_id=c or None, value=d or None)
        elif kind == "ER":
            e = e._replace(local=r.string())
        if self.stack:
            self.state = self.g.follow(state, term)
        return self._now(e, later)

    def _now(self, e: Event, later) -> tuple[Event, tuple | None]:
        if later and self.o.layout != "pre-compression":
            return e._replace(value=self.get(self.r, later)), None
        return e, later

    def _named(self, term: tuple) -> tuple[str, str, str | None]:
        kind, what = term
        if kind in ("SE", "AT", "AT?"):
            return *what, self.prefix(what[0])
        if kind in ("TYPE", "NIL"):
            return *(TYPE if kind == "TYPE" else NIL), self.prefix(XSI)
        return self.rest(what) if kind in ("SE:", "AT:") else self.name()

    def _attribute(self, term: tuple) -> tuple[Event, tuple | None]:
        state = self.state
        uri, local, prefix = self._named(term)
        name, e = (uri, local), Event("AT", uri, local, prefix)
        if name == TYPE:
            if self.o.preserve.lexical_values:
                value = self.text(self.r, name)
            else:
                u, n, _ = self.name()
                value = clark(u, n)
            self.state = self.g.follow(state, term)
            self.switch(_type_name(*_qualified(value)))
            return e._replace(value=value), None
        if term[0] == "NIL":
            value = _FLAG.read(self.r, self, name)
            if value == "true":
                self.empty()
            return e._replace(value=value), None
        later = name, self.codecs.of(self.attribute_type(term, name))
        self.state = self.g.follow(state, term)
        return self._now(e, later)
