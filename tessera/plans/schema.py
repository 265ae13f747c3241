"""XML Schema texts compiled to declarations: elements, types, particles, attributes.

Names are ``{uri}local`` (or ``local`` without a namespace), built-in types
``xs:local``, and anonymous types are called after the place that owns them.
Imports and includes are followed through a function that gives the text of a
location, each location once, so cycles end. A compiled schema is a small
object of the driver that tasks receive as it is; ``tables`` gives its four
DataFrames.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

XSD = "http://www.w3.org/2001/XMLSchema"
_TAG = f"{{{XSD}}}"
ANY = "xs:anyType"

#: Bases of the built-in types that are derived from another one (fixed values).
BUILTIN_BASES = {
    "normalizedString": "string", "token": "normalizedString", "language": "token", "NMTOKEN": "token", "Name": "token", "NCName": "Name",
    "ID": "NCName", "IDREF": "NCName", "ENTITY": "NCName", "integer": "decimal", "nonPositiveInteger": "integer", "negativeInteger": "nonPositiveInteger",
    "long": "integer", "int": "long", "short": "int", "byte": "short", "nonNegativeInteger": "integer", "unsignedLong": "nonNegativeInteger",
    "unsignedInt": "unsignedLong", "unsignedShort": "unsignedInt", "unsignedByte": "unsignedShort", "positiveInteger": "nonNegativeInteger",
}
#: Built-in lists and their items (fixed values).
BUILTIN_LISTS = {"NMTOKENS": "NMTOKEN", "IDREFS": "IDREF", "ENTITIES": "ENTITY"}
#: Built-in types without a built-in base but the ur-types (fixed values).
PRIMITIVES = ["string", "boolean", "decimal", "float", "double", "duration", "dateTime", "time", "date", "gYearMonth", "gYear", "gMonthDay", "gDay", "gMonth", "hexBinary", "base64Binary", "anyURI", "QName", "NOTATION", "anySimpleType"]
_BUILTIN = {f"xs:{n}" for n in [*PRIMITIVES, *BUILTIN_BASES, *BUILTIN_LISTS, "anyType"]}


@dataclass(frozen=True)
class Particle:
    no: int
    parent: int | None
    kind: str  # element, any, sequence, choice, all
    name: str | None
    type: str | None
    least: int
    most: int | None  # None: unbounded


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    use: str  # optional, required, prohibited


@dataclass(frozen=True)
class Element:
    name: str
    type: str
    nillable: bool = False
    head: str | None = None
    abstract: bool = False


@dataclass
class Type:
    name: str
    base: str | None
    variety: str  # atomic, list, union, complex
    derivation: str | None = None
    item: str | None = None
    members: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    mixed: bool = False
    simple_content: bool = False
    particles: list[Particle] = field(default_factory=list)
    attributes: list[Attribute] = field(default_factory=list)
    refs: set[str] = field(default_factory=set)  # particles that refer to global elements
    facets: dict[str, tuple[str, ...]] = field(default_factory=dict)
    wild: str | None = None  # namespaces of the attribute wildcard
    local_elements: dict[str, Element] = field(default_factory=dict)


@dataclass
class Schema:
    elements: dict[str, Element]
    attributes: dict[str, Attribute]
    types: dict[str, Type]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "made"}  # grammars are made anew where they are used

    def chain(self, name: str) -> list[str]:
        """The type and its bases, nearest first."""
        out = []
        while name:
            if name in out:
                raise ValueError(f"type {name} is its own base")
            out.append(name)
            own = self.types.get(name)
            if own is not None:
                name = own.base
            else:
                base = BUILTIN_BASES.get(name[3:])
                name = f"xs:{base}" if base else None
        return out

    def builtin(self, name: str) -> str:
        return next((t for t in self.chain(name) if t.startswith("xs:")), ANY)

    def simple(self, name: str) -> str | None:
        """The simple type of an element's text; None where the content is elements or nothing."""
        for t in self.chain(name):
            own = self.types.get(t)
            if own is None:
                return None if t == ANY else t
            if own.variety != "complex":
                return t
            if not own.simple_content:
                return None
        return None

    def members(self, head: str) -> set[str]:
        """The elements that may stand for a head, itself included."""
        found, left = set(), [head]
        while left:
            at = left.pop()
            if at not in found:
                found.add(at)
                left += [e.name for e in self.elements.values() if e.head == at]
        return found

    def children(self, name: str) -> dict[str, str]:
        """Type of each child element that a type declares, inherited ones included."""
        out: dict[str, str] = {}
        for t in self.chain(name):
            own = self.types.get(t)
            if own is None:
                break
            for p in own.particles:
                if p.kind == "element":
                    for m in self.members(p.name) if p.name in own.refs else ():
                        out.setdefault(m, self.elements[m].type)
                    out.setdefault(p.name, p.type)
            if own.derivation != "extension":
                break
        return out

    def attribute_types(self, name: str) -> dict[str, Attribute]:
        out: dict[str, Attribute] = {}
        for t in self.chain(name):
            for a in self.types[t].attributes if t in self.types else ():
                out.setdefault(a.name, a)
        return {k: a for k, a in out.items() if a.use != "prohibited"}


class _Text:
    """One schema document: its tree with the prefixes in scope of each node."""

    def __init__(self, text: str, location: str, adopted: str | None = None):
        pull = ElementTree.XMLPullParser(("start", "start-ns", "end"))
        pull.feed(text)
        pull.close()
        self.scopes: dict[ElementTree.Element, dict[str, str]] = {}
        stack, fresh = [{"xml": "http://www.w3.org/XML/1998/namespace"}], {}
        self.root = None
        for kind, x in pull.read_events():
            if kind == "start-ns":
                fresh[x[0] or ""] = x[1]
            elif kind == "start":
                self.root = x if self.root is None else self.root
                stack.append({**stack[-1], **fresh})
                fresh = {}
                self.scopes[x] = stack[-1]
            else:
                stack.pop()
        if self.root is None or self.root.tag != f"{_TAG}schema":
            raise ValueError(f"{location} is not a schema")
        self.location, self.uri = location, self.root.get("targetNamespace") or adopted or ""

    def name(self, node: ElementTree.Element, value: str) -> str:
        prefix, _, local = value.strip().rpartition(":")
        scope = self.scopes[node]
        if prefix and prefix not in scope:
            raise ValueError(f"prefix {prefix} is not bound in {self.location}")
        uri = scope.get(prefix, self.uri if not prefix else "")
        return f"xs:{local}" if uri == XSD else clark(uri, local)


def clark(uri: str | None, local: str) -> str:
    return f"{{{uri}}}{local}" if uri else local


def _kids(node: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    return [c for c in node if isinstance(c.tag, str) and c.tag.startswith(_TAG) and (not names or c.tag[len(_TAG) :] in names)]


def _facets(body: ElementTree.Element) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for f in body:
        if isinstance(f.tag, str) and f.get("value") is not None and f.tag != f"{_TAG}enumeration":
            out[f.tag[len(_TAG) :]] = (*out.get(f.tag[len(_TAG) :], ()), f.get("value"))
    return out


def _spaces(node: ElementTree.Element, uri: str) -> str:
    """The namespaces of a wildcard: ##any, ##other, or URIs with ##local for none."""
    given = node.get("namespace", "##any")
    return " ".join((uri or "##local") if x == "##targetNamespace" else x for x in given.split())


class _Compiler:
    GLOBALS = ("element", "attribute", "complexType", "simpleType", "group", "attributeGroup")
    MODELS = ("sequence", "choice", "all")

    def __init__(self, read: Callable[[str], str]):
        self.read, self.seen = read, set()
        self.found: dict[tuple[str, str], tuple[_Text, ElementTree.Element]] = {}
        self.out = Schema({}, {}, {})

    def load(self, location: str, adopted: str | None = None) -> None:
        if (location, adopted) in self.seen:
            return
        self.seen.add((location, adopted))
        text = _Text(self.read(location), location, adopted)
        for node in _kids(text.root):
            kind = node.tag[len(_TAG) :]
            if kind == "redefine":
                raise ValueError("redefine is not supported")
            if kind in ("import", "include") and node.get("schemaLocation"):
                self.load(posixpath.normpath(posixpath.join(posixpath.dirname(location), node.get("schemaLocation"))), text.uri if kind == "include" else None)
            elif kind in self.GLOBALS:
                key = "type" if kind.endswith("Type") else kind, clark(text.uri, node.get("name"))
                if key in self.found and self.found[key][0].location != location:
                    raise ValueError(f"{key[0]} {key[1]} is declared twice")
                self.found[key] = text, node

    def get(self, kind: str, name: str) -> tuple[_Text, ElementTree.Element]:
        if (kind, name) not in self.found:
            raise ValueError(f"{kind} {name} is not declared")
        return self.found[kind, name]

    def known(self, name: str) -> str:
        if name not in _BUILTIN:
            self.get("type", name)
        return name

    def compile(self) -> Schema:
        for (kind, name), (text, node) in self.found.items():
            if kind == "type":
                self.type(text, node, name)
            elif kind == "element":
                self.out.elements[name] = self.element(text, node, name, name)
            elif kind == "attribute":
                self.out.attributes[name] = Attribute(name, self.type_of(text, node, f"@{name}", "xs:anySimpleType"), "optional")
        for name in self.out.types:
            self.out.chain(name)
        return self.out

    def type_of(self, text: _Text, node: ElementTree.Element, place: str, default: str) -> str:
        if node.get("type"):
            return self.known(text.name(node, node.get("type")))
        for own in _kids(node, "simpleType", "complexType"):
            return self.type(text, own, f"{place}/type")
        return default

    def element(self, text: _Text, node: ElementTree.Element, name: str, place: str) -> Element:
        head = text.name(node, node.get("substitutionGroup")) if node.get("substitutionGroup") else None
        default = ANY
        seen = {name}
        up, at = head, (text, node)
        while up and default == ANY:  # without a type of its own, that of its head
            if up in seen:
                raise ValueError(f"element {up} stands for itself")
            seen.add(up)
            at = self.get("element", up)
            if at[1].get("type") or _kids(at[1], "simpleType", "complexType"):
                default = self.known(at[0].name(at[1], at[1].get("type"))) if at[1].get("type") else f"{up}/type"
            up = at[0].name(at[1], at[1].get("substitutionGroup")) if at[1].get("substitutionGroup") else None
        return Element(name, self.type_of(text, node, place, default), node.get("nillable") in ("true", "1"), head, node.get("abstract") in ("true", "1"))

    def type(self, text: _Text, node: ElementTree.Element, name: str) -> str:
        if name in self.out.types:  # compiled, or being compiled further up
            return name
        if node.tag == f"{_TAG}simpleType":
            self.simple(text, node, name)
        else:
            own = Type(name, ANY, "complex", "restriction", mixed=node.get("mixed") in ("true", "1"))
            self.out.types[name] = own
            body = node
            for content in _kids(node, "simpleContent", "complexContent"):
                own.simple_content = content.tag == f"{_TAG}simpleContent"
                own.mixed |= content.get("mixed") in ("true", "1")
                body = _kids(content, "extension", "restriction")[0]
                own.derivation = body.tag[len(_TAG) :]
                own.base = self.known(text.name(body, body.get("base")))
                if own.simple_content:
                    own.values, own.facets = tuple(f.get("value") for f in _kids(body, "enumeration")), _facets(body)
            for model in _kids(body, *self.MODELS, "group"):
                self.particles(text, model, own, None, ())
            own.attributes = self.attributes(text, body, name, ())
            own.wild = self.attribute_wildcard(text, body)
        return name

    def attribute_wildcard(self, text: _Text, body: ElementTree.Element) -> str | None:
        for node in _kids(body, "anyAttribute"):
            return _spaces(node, text.uri)
        for node in _kids(body, "attributeGroup"):
            found = self.attribute_wildcard(*self.get("attributeGroup", text.name(node, node.get("ref"))))
            if found is not None:
                return found
        return None

    def simple(self, text: _Text, node: ElementTree.Element, name: str) -> None:
        body = _kids(node, "restriction", "list", "union")[0]
        kind = body.tag[len(_TAG) :]
        inner = [self.type(text, t, f"{name}/{i}") for i, t in enumerate(_kids(body, "simpleType"))]
        if kind == "list":
            item = self.known(text.name(body, body.get("itemType"))) if body.get("itemType") else inner[0]
            self.out.types[name] = Type(name, "xs:anySimpleType", "list", "list", item=item)
        elif kind == "union":
            named = [self.known(text.name(body, m)) for m in (body.get("memberTypes") or "").split()]
            self.out.types[name] = Type(name, "xs:anySimpleType", "union", "union", members=tuple(named + inner))
        else:
            base = self.known(text.name(body, body.get("base"))) if body.get("base") else inner[0]
            self.out.types[name] = Type(name, base, "atomic", "restriction", values=tuple(f.get("value") for f in _kids(body, "enumeration")), facets=_facets(body))

    def particles(self, text: _Text, node: ElementTree.Element, own: Type, parent: int | None, groups: tuple[str, ...]) -> None:
        kind = node.tag[len(_TAG) :]
        least, most = int(node.get("minOccurs", "1")), node.get("maxOccurs", "1")
        top = None if most == "unbounded" else int(most)
        if top is not None and least > top:
            raise ValueError(f"minOccurs {least} is above maxOccurs {top}")
        name = of = None
        if kind == "element":
            if node.get("ref"):
                name = text.name(node, node.get("ref"))
                at, decl = self.get("element", name)
                own.refs.add(name)
                of = self.element(at, decl, name, name).type
            else:
                form = node.get("form") or text.root.get("elementFormDefault", "unqualified")
                name = clark(text.uri if form == "qualified" else "", node.get("name"))
                decl = self.element(text, node, name, f"{own.name}/{node.get('name')}")
                of, own.local_elements[name] = decl.type, decl
        elif kind == "any":
            name = _spaces(node, text.uri)
        elif kind == "group":
            ref = text.name(node, node.get("ref"))
            if ref in groups:
                raise ValueError(f"group {ref} holds itself")
            text, decl = self.get("group", ref)
            groups += (ref,)
            node = _kids(decl, *self.MODELS)[0]
            kind = node.tag[len(_TAG) :]
        no = len(own.particles)
        own.particles.append(Particle(no, parent, kind, name, of, least, top))
        if kind in self.MODELS:
            for child in _kids(node, *self.MODELS, "element", "any", "group"):
                self.particles(text, child, own, no, groups)

    def attributes(self, text: _Text, body: ElementTree.Element, place: str, groups: tuple[str, ...]) -> list[Attribute]:
        out = []
        for node in _kids(body, "attribute", "attributeGroup"):
            ref = text.name(node, node.get("ref")) if node.get("ref") else None
            if node.tag == f"{_TAG}attributeGroup":
                if ref in groups:
                    raise ValueError(f"attributeGroup {ref} holds itself")
                out += self.attributes(*self.get("attributeGroup", ref), place, (*groups, ref))
            elif ref:
                at, decl = self.get("attribute", ref)
                out.append(Attribute(ref, self.type_of(at, decl, f"@{ref}", "xs:anySimpleType"), node.get("use", "optional")))
            else:
                form = node.get("form") or text.root.get("attributeFormDefault", "unqualified")
                name = clark(text.uri if form == "qualified" else "", node.get("name"))
                out.append(Attribute(name, self.type_of(text, node, f"{place}/@{node.get('name')}", "xs:anySimpleType"), node.get("use", "optional")))
        return out


def compile_schema(main: str, texts: dict[str, str] | Callable[[str], str]) -> Schema:
    """The schema at location ``main``; ``texts`` gives the text of a location.

    Raises ValueError for what is not declared, declared twice or circular, and
    for schema parts that are not supported; KeyError (or the error of the
    function) for a missing location.
    """
    c = _Compiler(texts if callable(texts) else texts.__getitem__)
    c.load(main)
    return c.compile()


def tables(spark: SparkSession, schema: Schema) -> dict[str, DataFrame]:
    """The DataFrames ``elements``, ``types``, ``particles`` and ``attributes`` of a schema."""
    types = list(schema.types.values())
    return {
        "elements": spark.createDataFrame([(e.name, e.type, e.nillable, e.head, e.abstract) for e in schema.elements.values()], "name string, type string, nillable boolean, head string, abstract boolean"),
        "types": spark.createDataFrame([(t.name, t.base, t.variety, t.derivation, t.item, list(t.members), list(t.values), t.mixed) for t in types], "type string, base string, variety string, derivation string, item string, members array<string>, `values` array<string>, mixed boolean"),
        "particles": spark.createDataFrame([(t.name, p.no, p.parent, p.kind, p.name, p.type, p.least, p.most) for t in types for p in t.particles], "owner string, no int, parent int, kind string, name string, type string, least int, most int"),
        "attributes": spark.createDataFrame([(t.name, a.name, a.type, a.use) for t in types for a in t.attributes], "owner string, name string, type string, use string"),
    }
