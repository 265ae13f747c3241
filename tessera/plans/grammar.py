"""Grammars from schemas: nets of productions, made deterministic, with event codes.

A type becomes a net: places joined by terminals or by nothing (ε). Attributes
come first, in order of their names, then the content. Nodes of the grammar are
sets of places (closed under ε), made when they are first reached, so a net
with large bounds costs nothing until a document walks through it. A node's
productions are in the order of the format, and get the undeclared ones that
the options ask for on a second and third level of the event code.

Terminals are pairs (kind, what): AT (uri, local), AT: uri, AT*, SE (uri, local),
SE: uri, SE*, EE, CH (typed), CH? (untyped). Undeclared: TYPE and NIL (xsi:type,
xsi:nil), AT? (declared attribute, untyped value), AT+, AT+?, NS, SC, SE+, CH+, ER,
CM, PI; in documents also DT and ED.
"""

from __future__ import annotations

from dataclasses import dataclass

from tessera.plans.bits import Reader, Writer, width
from tessera.plans.options import Options
from tessera.plans.schema import ANY, Schema

#: The order of productions in a node.
RANK = {"AT": 0, "AT:": 1, "AT*": 2, "SE": 3, "SE:": 4, "SE*": 5, "EE": 6, "CH": 7, "CH?": 7, "ED": 8}
Name = tuple[str, str]


def split(clark: str) -> Name:
    uri, _, local = clark.rpartition("}")
    return uri.lstrip("{"), local


def anonymous(type_: str) -> bool:
    return "/" in type_.rpartition("}")[2]


@dataclass(frozen=True)
class Decl:
    """What an element is declared as."""

    type: str
    nillable: bool = False


class Net:
    """Places and their arcs: (kind, what, order in the schema, info, target)."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple]] = []
        self.free: list[list[int]] = []
        self.tag: set[int] = set()  # places in which attributes may still come
        self.end: set[int] = set()
        self.body = self.level = 0

    def place(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def closed(self, places) -> frozenset[int]:
        seen, left = set(), list(places)
        while left:
            at = left.pop()
            if at not in seen:
                seen.add(at)
                left += self.free[at]
        return frozenset(seen)


class Node:
    """One state: its productions with targets, and their event codes."""

    __slots__ = ("codes", "first", "more", "targets", "infos")

    def __init__(self, first: list[tuple], more: list):
        """``first``: (terminal, info, target); ``more``: the same, or lists of them for the third level."""
        self.first, self.more = first, more
        self.codes: dict[tuple, tuple[int, ...]] = {}
        self.targets, self.infos = {}, {}
        n = len(first)
        flat = [((i,), p) for i, p in enumerate(first)]
        for j, p in enumerate(more):
            flat += [((n, j, k), q) for k, q in enumerate(p)] if isinstance(p, list) else [((n, j), p)]
        for code, (term, info, target) in flat:
            if term not in self.codes:
                self.codes[term], self.infos[term], self.targets[term] = code, info, target

    def _widths(self, code: tuple[int, ...]) -> list[int]:
        out = [width(len(self.first) + bool(self.more)), width(len(self.more))]
        if len(code) == 3:
            out.append(width(len(self.more[code[1]])))
        return out

    def write(self, w: Writer, term: tuple) -> None:
        code = self.codes[term]
        for part, n in zip(code, self._widths(code), strict=False):
            w.number(part, n)

    def read(self, r: Reader) -> tuple:
        n = len(self.first)
        i = r.number(width(n + bool(self.more)))
        if i < n:
            return self.first[i][0]
        j = r.number(width(len(self.more))) if self.more and i == n else len(self.more)
        if j >= len(self.more):
            raise ValueError("unknown event code")
        found = self.more[j]
        if isinstance(found, list):
            k = r.number(width(len(found)))
            if k >= len(found):
                raise ValueError("unknown event code")
            found = found[k]
        return found[0]


class Grammars:
    """The grammars of a schema under given options, each made once."""

    def __init__(self, schema: Schema, o: Options):
        self.schema, self.o = schema, o
        self.nets: dict[tuple, Net] = {}
        self.nodes: dict[tuple, Node] = {}
        #: All declarations of each element name, global ones first.
        self.declared: dict[Name, list[Decl]] = {}
        for e in schema.elements.values():
            self.declared.setdefault(split(e.name), []).append(Decl(e.type, e.nillable))
        for t in schema.types.values():
            for name, e in t.local_elements.items():
                self.declared.setdefault(split(name), []).append(Decl(e.type, e.nillable))
        self.subtyped = {t.base for t in schema.types.values() if t.base and not anonymous(t.name)}

    # nets

    def net(self, type_: str, empty: bool) -> Net:
        if (type_, empty) not in self.nets:
            self.nets[type_, empty] = self._net(type_, empty)
        return self.nets[type_, empty]

    def _net(self, type_: str, empty: bool) -> Net:
        net, s = Net(), self.schema
        at = net.place()
        net.tag.add(at)
        own = s.types.get(type_)
        structured = type_ == ANY or (own is not None and own.variety == "complex")
        if structured:
            wild = "##any" if type_ == ANY else next((t.wild for t in map(s.types.get, s.chain(type_)) if t is not None and t.wild), None)
            uses = sorted(s.attribute_types(type_).values(), key=lambda a: split(a.name)[::-1])
            for a in [*uses, None]:
                if wild is not None:
                    self._wildcard(net, "AT", wild, at, at, 0)
                if a is None:
                    break
                nxt = net.place()
                net.tag.add(nxt)
                net.arcs[at].append(("AT", split(a.name), 0, a.type, nxt))
                if a.use != "required":
                    net.free[at].append(nxt)
                at = nxt
        net.body = begin = net.place()
        net.free[at].append(begin)
        if empty:
            end = begin
        elif type_ == ANY:
            end = begin
            net.arcs[begin] += [("SE*", None, 0, None, begin), ("CH?", None, 0, None, begin)]
        elif not structured or s.simple(type_):
            end = net.place()
            net.arcs[begin].append(("CH", None, 0, type_, end))
        else:
            end = self._content(net, type_, begin)
            if any(t.mixed for t in map(s.types.get, s.chain(type_)) if t is not None):
                for p in range(begin, len(net.arcs)):
                    net.arcs[p].append(("CH?", None, 0, None, p))
        net.end.add(end)
        return net

    def _wildcard(self, net: Net, kind: str, spaces: str, a: int, b: int, order) -> None:
        if spaces in ("##any", "##other"):
            net.arcs[a].append((f"{kind}*", None, order, None, b))
        else:
            for uri in spaces.split():
                net.arcs[a].append((f"{kind}:", "" if uri == "##local" else uri, order, None, b))

    def _content(self, net: Net, type_: str, at: int) -> int:
        """Own content, after that of the type which an extension extends."""
        own = self.schema.types.get(type_)
        if own is None:
            return at
        if own.derivation == "extension":
            at = self._content(net, own.base, at)
        net.level += 1  # what a type adds comes after what its base has
        kids: dict[int | None, list] = {}
        for p in own.particles:
            kids.setdefault(p.parent, []).append(p)
        for p in kids.get(None, []):
            at = self._particle(net, own, kids, p, at)
        return at

    def _particle(self, net: Net, own, kids: dict, p, at: int) -> int:
        for _ in range(p.least):
            at = self._term(net, own, kids, p, at)
        if p.most is None:
            loop = net.place()
            net.free[at].append(loop)
            net.free[self._term(net, own, kids, p, loop)].append(loop)
            return loop
        out = net.place()
        for _ in range(p.most - p.least):
            net.free[at].append(out)
            at = self._term(net, own, kids, p, at)
        net.free[at].append(out)
        return out

    def _term(self, net: Net, own, kids: dict, p, at: int) -> int:
        parts = kids.get(p.no, [])
        if p.kind == "sequence":
            start = net.place()
            net.free[at].append(start)
            for k in parts:
                start = self._particle(net, own, kids, k, start)
            return start
        out = net.place()
        if p.kind == "element":
            if p.name in own.refs:
                names = sorted(self.schema.members(p.name), key=lambda n: split(n)[::-1])
                found = [(n, self.schema.elements[n]) for n in names]
            else:
                found = [(p.name, own.local_elements[p.name])]
            for i, (n, e) in enumerate(found):
                net.arcs[at].append(("SE", split(n), (net.level, p.no, i), Decl(e.type, e.nillable), out))
        elif p.kind == "any":
            self._wildcard(net, "SE", p.name, at, out, (net.level, p.no, 0))
        elif p.kind == "choice":
            for k in parts:
                start = net.place()
                net.free[at].append(start)
                net.free[self._particle(net, own, kids, k, start)].append(out)
            if not parts:
                net.free[at].append(out)
        else:  # all: any of them, in any order, any number of times
            net.free[at].append(out)
            for k in parts:
                start = net.place()
                net.free[out].append(start)
                net.free[self._particle(net, own, kids, k, start)].append(out)
        return out

    # nodes

    def start(self, decl: Decl, empty: bool = False, switched: bool = False) -> Node:
        """The first node of an element; ``switched``: after xsi:type, which then is not allowed again."""
        return self._node(decl, empty, self.net(decl.type, empty).closed([0]), "switched" if switched else "start")

    def _node(self, decl: Decl, empty: bool, places: frozenset[int], role: str = "") -> Node:
        key = (decl if role else decl.type, empty, places, role)
        if key not in self.nodes:
            node = self.nodes[key] = Node.__new__(Node)  # targets are made when they are asked for
            node.__init__(*self._productions(decl, empty, places, role))
        return self.nodes[key]

    def _productions(self, decl: Decl, empty: bool, places: frozenset[int], role: str) -> tuple[list, list]:
        net = self.net(decl.type, empty)
        found: dict[tuple, tuple] = {}
        for p in sorted(places):
            for kind, what, order, info, target in net.arcs[p]:
                old = found.get((kind, what))
                order = order or (0, 0, 0)
                found[kind, what] = (min(order, old[0]), old[1], old[2] | {target}) if old else (order, info, {target})
        if places & net.end:
            found["EE", None] = ((0, 0, 0), None, None)

        def rank(term):
            kind, what = term
            inner = what[::-1] if kind == "AT" else (what,) if kind == "AT:" else found[term][0] if kind in ("SE", "SE:") else ()
            return RANK[kind], inner

        to = lambda t: None if t is None else ("go", decl, empty, net.closed(t))
        first = [(term, found[term][1], to(found[term][2])) for term in sorted(found, key=rank)]
        o, p = self.o, self.o.preserve
        stay = ("same",)
        more: list = []
        if o.strict:
            if role == "start" and (decl.type in self.subtyped or self._union(decl.type)):
                more.append((("TYPE", None), None, stay))
            if role and decl.nillable and not empty:
                more.append((("NIL", None), None, stay))
            return first, more
        tag = bool(places & net.tag)
        if ("EE", None) not in found:
            more.append((("EE", None), None, None))
        if role == "start":
            more.append((("TYPE", None), None, stay))
        if role:
            more.append((("NIL", None), None, stay))
        if tag:
            more.append((("AT+", None), None, stay))
            known = [x for x in first if x[0][0] == "AT"]
            more.append([*((("AT?", term[1]), None, target) for term, _, target in known), (("AT+?", None), None, stay)])
        if role and p.prefixes:
            more.append((("NS", None), None, stay))
        if role and o.self_contained:
            more.append((("SC", None), None, None))
        inner = ("go", decl, empty, net.closed([net.body])) if tag else stay
        more += [(("SE+", None), None, inner), (("CH+", None), None, inner)]
        if p.dtd:
            more.append((("ER", None), None, inner))
        group = [((k, None), None, inner) for k, on in (("CM", p.comments), ("PI", p.pis)) if on]
        return first, more + ([group] if group else [])

    def _union(self, type_: str) -> bool:
        return any(t is not None and t.variety == "union" for t in map(self.schema.types.get, self.schema.chain(type_)))

    def follow(self, node: Node, term: tuple) -> Node:
        """The node after a production that stays in its element."""
        kind, *target = node.targets[term]
        return node if kind == "same" else self.relaxed(target[0])[target[1]] if kind == "relaxed" else self._node(*target)

    def outer(self, names: list[tuple[Name, Decl | str]], fragment: bool) -> tuple[Node, Node]:
        """The document's or fragment's node, and the one after the root."""
        p = self.o.preserve
        group = [((k, None), None, None) for k, on in (("CM", p.comments), ("PI", p.pis)) if on]
        first = [(("SE", n), d, None) for n, d in names] + [(("SE*", None), None, None)]
        if fragment:
            node = Node([*first, (("ED", None), None, None)], [group] if group else [])
            return node, node
        return Node(first, [(("DT", None), None, None)] * p.dtd + ([group] if group else [])), Node([(("ED", None), None, None)], [group] if group else [])

    def roots(self) -> tuple[Node, Node]:
        if not self.o.fragment:
            names = sorted((split(e.name) for e in self.schema.elements.values()), key=lambda n: n[::-1])
            return self.outer([(n, self.declared[n][0]) for n in names], False)
        names = sorted(self.declared, key=lambda n: n[::-1])
        return self.outer([(n, self.declared[n][0] if len(set(self.declared[n])) == 1 else "relaxed") for n in names], True)

    def relaxed(self, empty: bool = False) -> tuple[Node, Node]:
        """The grammar of elements that are declared in several ways: every declared name, in any order."""
        tag, body = ("relaxed", empty, 0), ("relaxed", empty, 1)
        if ("relaxed", empty) not in self.nodes:
            uses: dict[Name, set[str]] = {}
            for t in self.schema.types.values():
                for a in t.attributes:
                    uses.setdefault(split(a.name), set()).add(a.type)
            for a in self.schema.attributes.values():
                uses.setdefault(split(a.name), set()).add(a.type)
            o, p = self.o, self.o.preserve
            attrs = [(("AT", n), min(uses[n]) if len(uses[n]) == 1 else None, tag) for n in sorted(uses, key=lambda n: n[::-1])]
            attrs.append((("AT*", None), None, tag))
            kids = [(("SE", n), d[0] if len(set(d)) == 1 else "relaxed", body) for n, d in sorted(self.declared.items(), key=lambda x: x[0][::-1])]
            content = [] if empty else [*kids, (("SE*", None), None, body)]
            last = [(("EE", None), None, None)] + ([] if empty else [(("CH?", None), None, body)])
            group = [((k, None), None, body) for k, on in (("CM", p.comments), ("PI", p.pis)) if on]
            tail = [] if o.strict else [(("SE+", None), None, body), (("CH+", None), None, body)] + [(("ER", None), None, body)] * p.dtd + ([group] if group else [])
            more = [(("TYPE", None), None, tag), (("NIL", None), None, tag)]
            if not o.strict:
                more += [(("AT+", None), None, tag), [*((("AT?", x[0][1]), None, tag) for x in attrs[:-1]), (("AT+?", None), None, tag)]]
                more += [(("NS", None), None, tag)] * p.prefixes + [(("SC", None), None, None)] * o.self_contained
            self.nodes["relaxed", empty] = Node([*attrs, *content, *last], more + tail), Node([*content, *last], tail)
        return self.nodes["relaxed", empty]

    def names(self) -> dict[str, set[str]]:
        """Local names of elements, attributes and types by URI, for the string table."""
        s, out = self.schema, {}
        found = [*s.elements, *s.attributes, *(t for t in s.types if not anonymous(t))]
        for t in s.types.values():
            found += [*t.local_elements, *(a.name for a in t.attributes)]
            for spaces in [t.wild or "", *(p.name for p in t.particles if p.kind == "any")]:
                for uri in spaces.split():
                    if not uri.startswith("##"):
                        out.setdefault(uri, set())
        for n in found:
            uri, local = split(n)
            out.setdefault(uri, set()).add(local)
        return out


def dump(grammars: Grammars, decl: Decl) -> list[tuple[int, str, str, int | None]]:
    """Rows (node, event code, terminal, next node) of an element's grammar, breadth first; None ends the element."""
    first = grammars.start(decl)
    numbers, order, out = {id(first): 0}, [first], []
    for node in order:
        for term, code in sorted(node.codes.items(), key=lambda x: x[1]):
            target = node.targets[term]
            nxt = None
            if target is not None:
                then = grammars.follow(node, term)
                if id(then) not in numbers:
                    numbers[id(then)] = len(order)
                    order.append(then)
                nxt = numbers[id(then)]
            kind, what = term
            text = kind if what is None else f"{kind} {'{%s}%s' % what if isinstance(what, tuple) else what}"
            out.append((numbers[id(node)], ".".join(map(str, code)), text, nxt))
    return out
