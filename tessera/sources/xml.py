"""XML texts to event rows, and event rows to XML texts."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import EVENT_FIELDS, EVENTS
from tessera.plans.codec import XML, XSI, Event
from tessera.plans.options import Preserve

_KEEP_ALL = Preserve(True, True, True, True, True, False)


def parse(text: str | bytes, preserve: Preserve = _KEEP_ALL, external: Callable[[str], bytes] | None = None) -> list[Event]:
    """Events of one document.

    Adjacent text is one CH; attributes are sorted by (local, uri); text of
    blanks only is kept if it is all that an element holds. External entities
    are read only through ``external``, which gets a system identifier. Raises
    ValueError for text that is not well-formed.
    """
    return list(iterparse([text], preserve, external))


def below(folder: str) -> Callable[[str], bytes]:
    """For ``external``: reads files below a folder, and raises ValueError for all others."""
    root = os.path.realpath(folder)

    def read(system_id: str) -> bytes:
        path = os.path.realpath(os.path.join(root, system_id.removeprefix("file://")))
        if os.path.commonpath((root, path)) != root:
            raise ValueError(f"entity {system_id} is not below {folder}")
        try:
            with open(path, "rb") as f:
                return f.read()
        except OSError as e:
            raise ValueError(f"entity {system_id} cannot be read") from e

    return read


def iterparse(chunks: Iterable[str | bytes], preserve: Preserve = _KEEP_ALL, external: Callable[[str], bytes] | None = None) -> Iterator[Event]:
    """As ``parse``, of a document in pieces; events are given as soon as they are known."""
    out: list[Event] = [Event("SD")]
    scopes: list[dict[str, str]] = [{"": "", "xml": XML, "xmlns": "http://www.w3.org/2000/xmlns/"}]
    child = [False]
    held: list[str] = []

    def flush(closing: bool = False) -> None:
        value = "".join(held)
        held.clear()
        if not value or len(child) == 1:
            return
        if preserve.whitespace or value.strip(" \t\n\r") or (closing and not child[-1]):
            out.append(Event("CH", value=value))

    def resolve(name: str, scope: dict[str, str], element: bool) -> tuple[str, str, str]:
        prefix, colon, local = name.rpartition(":")
        if not colon and not element:
            return "", name, ""
        if prefix not in scope:
            raise ValueError(f"prefix {prefix} is not bound")
        return scope[prefix], local, prefix

    def start(name: str, attrs: list[str]) -> None:
        flush()
        child[-1] = True
        child.append(False)
        scope, spaces, rest = dict(scopes[-1]), [], []
        for a, v in zip(attrs[::2], attrs[1::2], strict=True):
            if a == "xmlns" or a.startswith("xmlns:"):
                prefix = a[6:]
                scope[prefix] = v
                spaces.append((prefix, v))
            else:
                rest.append((a, v))
        scopes.append(scope)
        uri, local, prefix = resolve(name, scope, True)
        out.append(Event("SE", uri, local, prefix if preserve.prefixes else None))
        if preserve.prefixes:
            out.extend(Event("NS", u, prefix=p, local_ns=p == prefix) for p, u in spaces)
        found = []
        for a, v in rest:
            u, n, p = resolve(a, scope, False)
            if (u, n) == (XSI, "type"):
                w, t, _ = resolve(v.strip(), scope, True)
                v = f"{{{w}}}{t}" if w else t
            found.append(Event("AT", u, n, p if preserve.prefixes else None, v))
        out.extend(sorted(found, key=lambda e: (e.local, e.uri)))

    def end(_: str) -> None:
        flush(True)
        child.pop()
        scopes.pop()
        out.append(Event("EE"))

    def other(e: Event, wanted: bool) -> None:
        if wanted:
            flush()
            out.append(e)

    subset: list[str] = []
    doctype: list[tuple] = []

    def entity(name, is_parameter, value, base, system_id, public_id, notation):
        ids = f'PUBLIC "{public_id}" "{system_id}"' if public_id else f'SYSTEM "{system_id}"'
        what = f'"{value}"' if value is not None else ids + (f" NDATA {notation}" if notation else "")
        subset.append(f"<!ENTITY {'% ' * bool(is_parameter)}{name} {what}>")

    def notation_(name, base, system_id, public_id):
        ids = f'PUBLIC "{public_id}"' + (f' "{system_id}"' if system_id else "") if public_id else f'SYSTEM "{system_id}"'
        subset.append(f"<!NOTATION {name} {ids}>")

    def element_(name, model):
        subset.append(f"<!ELEMENT {name} {_model(model)}>")

    def attlist(element, name, type_, default, required):
        rest = f'{"#FIXED " * bool(required)}"{escape_attribute(default)}"' if default is not None else "#REQUIRED" if required else "#IMPLIED"
        subset.append(f"<!ATTLIST {element} {name} {type_} {rest}>")

    def doctype_end():
        if preserve.dtd:
            name, system_id, public_id = doctype[0]
            out.append(Event("DT", local=name, value="".join(subset) or None, public_id=public_id, system_id=system_id))

    p = expat.ParserCreate()
    p.ordered_attributes = True
    p.buffer_text = True
    p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    p.StartElementHandler, p.EndElementHandler = start, end
    p.CharacterDataHandler = held.append
    p.CommentHandler = lambda t: other(Event("CM", value=t), preserve.comments)
    p.ProcessingInstructionHandler = lambda n, t: other(Event("PI", local=n, value=t), preserve.pis)
    p.StartDoctypeDeclHandler = lambda name, system_id, public_id, _: doctype.append((name, system_id, public_id))
    p.EndDoctypeDeclHandler = doctype_end
    p.EntityDeclHandler, p.NotationDeclHandler, p.ElementDeclHandler, p.AttlistDeclHandler = entity, notation_, element_, attlist
    if external is not None:

        def entity_ref(context, base, system_id, public_id):
            p.ExternalEntityParserCreate(context).Parse(external(system_id), True)
            return 1

        p.ExternalEntityRefHandler = entity_ref
    p.SkippedEntityHandler = lambda name, is_parameter: other(Event("ER", local=name), preserve.dtd and not is_parameter)
    try:
        for chunk in chunks:
            p.Parse(chunk.encode("utf-8") if isinstance(chunk, str) else chunk, False)
            yield from out
            out.clear()
        p.Parse(b"", True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from None
    yield from out
    yield Event("ED")


def _model(model: tuple) -> str:
    """The text of an element's content model as expat gives it."""
    kind, quantifier, name, children = model
    often = {0: "", 1: "?", 2: "*", 3: "+"}[quantifier]
    if kind in (1, 2):
        return "EMPTY" if kind == 1 else "ANY"
    if kind == 4:
        return name + often
    if kind == 3:
        return "(#PCDATA" + "".join(f"|{c[2]}" for c in children) + ")" + ("*" if children else "")
    return "(" + {5: "|", 6: ","}[kind].join(_model(c) for c in children) + ")" + often


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def serialize(events: list[Event], indent: int = 0) -> str:
    """The XML text. Names without a prefix in scope get one; with ``indent``, elements without text are laid out."""
    out: list[str] = []
    scopes: list[dict[str, str]] = [{"": "", "xml": XML}]
    names: list[str] = []
    textual: list[bool] = [True]
    i, made = 0, 0
    while i < len(events):
        e = events[i]
        i += 1
        lay = indent and not textual[-1] or (indent and len(names) == 0 and out)
        if e.kind == "SE":
            scope, extra = dict(scopes[-1]), []
            spaces, attrs = [], []
            while i < len(events) and events[i].kind in ("NS", "AT"):
                (spaces if events[i].kind == "NS" else attrs).append(events[i])
                i += 1
            for s in spaces:
                scope[s.prefix or ""] = s.uri or ""
                extra.append((f"xmlns:{s.prefix}" if s.prefix else "xmlns", s.uri or ""))

            def qname(uri: str, local: str, prefix: str | None, attribute: bool, scope=scope, extra=extra) -> str:
                nonlocal made
                uri = uri or ""
                if attribute and not uri:
                    return local
                fits = [p for p, u in scope.items() if u == uri and (p or not attribute)]
                if prefix is not None and prefix in fits:
                    use = prefix
                elif fits:
                    use = "" if "" in fits else fits[0]
                else:
                    use = prefix if prefix is not None and (prefix or not attribute) and prefix not in dict(extra) else None
                    if use is None:
                        use = "" if not attribute else f"ns{made}"
                        made += attribute
                    scope[use] = uri
                    extra.append((f"xmlns:{use}" if use else "xmlns", uri))
                return f"{use}:{local}" if use else local

            tag = qname(e.uri, e.local, e.prefix, False)
            pairs = []
            for a in attrs:
                v = a.value or ""
                name = qname(a.uri, a.local, a.prefix, True)
                if (a.uri, a.local) == (XSI, "type") and v.startswith("{"):
                    u, _, n = v[1:].partition("}")
                    v = qname(u, n, None, True)
                pairs.append((name, v))
            scopes.append(scope)
            names.append(tag)
            if lay:
                out.append("\n" + " " * indent * (len(names) - 1))
            empty = i < len(events) and events[i].kind == "EE"
            out.append("<" + tag + "".join(f' {n}="{escape_attribute(v)}"' for n, v in extra + pairs) + ("/>" if empty else ">"))
            if empty:
                i += 1
                names.pop()
                scopes.pop()
            else:
                depth, mixed = 0, False
                for f in events[i:]:
                    depth += (f.kind == "SE") - (f.kind == "EE")
                    if depth < 0:
                        break
                    mixed |= depth == 0 and f.kind in ("CH", "ER")
                textual.append(mixed)
        elif e.kind == "EE":
            own = textual.pop()
            if indent and not own:
                out.append("\n" + " " * indent * (len(names) - 1))
            out.append(f"</{names.pop()}>")
            scopes.pop()
        elif e.kind == "CH":
            out.append(escape_text(e.value or ""))
        elif e.kind == "CM":
            if "--" in (e.value or "") or (e.value or "").endswith("-"):
                raise ValueError("a comment must not hold -- or end with -")
            out.append(f"<!--{e.value or ''}-->")
        elif e.kind == "PI":
            if "?>" in (e.value or ""):
                raise ValueError("an instruction must not hold ?>")
            out.append(f"<?{e.local} {e.value}?>" if e.value else f"<?{e.local}?>")
        elif e.kind == "ER":
            out.append(f"&{e.local};")
        elif e.kind == "DT":
            ids = f' PUBLIC "{e.public_id}" "{e.system_id or ""}"' if e.public_id else f' SYSTEM "{e.system_id}"' if e.system_id else ""
            out.append(f"<!DOCTYPE {e.local}{ids}{f' [{e.value}]' if e.value else ''}>")
    return "".join(out)


def event_rows(docs: DataFrame, column: str, make: Callable[..., list[Event]], id_col: str = "doc_id", failed: str = "raise") -> DataFrame:
    """Applies ``make`` to ``column`` of each row; one output row for each event.

    With ``failed="skip"`` documents that ``make`` rejects give no rows, with
    ``"raise"`` the job fails.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                try:
                    events = make(value.as_py())
                except (ValueError, EOFError):
                    if failed == "raise":
                        raise
                    continue
                rows += [(key, n, *e) for n, e in enumerate(events)]
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), column).mapInArrow(scan, EVENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [t for _, t in EVENT_FIELDS], strict=True)], [n for n, _ in EVENT_FIELDS])


def read_xml(docs: DataFrame, column: str, preserve: Preserve = _KEEP_ALL, id_col: str = "doc_id", failed: str = "raise") -> DataFrame:
    """The events of a column of XML texts."""
    return event_rows(docs, column, lambda t: parse(t, preserve), id_col, failed)


def read_files(spark: SparkSession, path: str, preserve: Preserve = _KEEP_ALL, external_root: str | None = None, failed: str = "raise") -> DataFrame:
    """The events of the XML files below ``path``; doc_id is the hash of a file's path.

    External entities are read only below ``external_root``, a folder that all
    executors share.
    """
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "content")
    external = below(external_root) if external_root else None
    return event_rows(files, "content", lambda b: parse(bytes(b), preserve, external), "doc_id", failed)


def fold_documents(events: DataFrame, make: Callable[[list[Event]], object], out: str, type_: str) -> DataFrame:
    """(doc_id, out): ``make`` of each document's events in order.

    A document is one value of the result, so its events meet in one task;
    documents are spread by doc_id and streamed one after the other.
    """
    kinds = {"string": pa.string(), "binary": pa.binary()}
    cols = [n for n, _ in EVENT_FIELDS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([make(held)], kinds[type_])], ["doc_id", out])

        for batch in batches:
            for key, _, *rest in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                if key != now and held:
                    yield done()
                    held = []
                now = key
                held.append(Event(*rest))
        if held:
            yield done()

    dealt = events.select(*cols).repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return dealt.mapInArrow(scan, f"doc_id long, {out} {type_}")


def write_xml(events: DataFrame, indent: int = 0) -> DataFrame:
    """(doc_id, xml) of an event table."""
    return fold_documents(events, lambda es: serialize(es, indent), "xml", "string")
