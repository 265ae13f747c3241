"""JSON values as event documents of maps, arrays and scalars, and back."""

from __future__ import annotations

import base64
import json
import math
import re

from tessera.plans.codec import Event
from tessera.plans.options import Options
from tessera.plans.schema import Schema, compile_schema
from tessera.plans.values import plain

SPACE = "http://www.w3.org/2015/EXI/json"
_NAMES = {"map", "array", "string", "number", "boolean", "null", "other", "key"}


def escape_key(key: str) -> str:
    """An element name for a key: reserved names get ``_.`` before them, other characters ``_<code point>.``."""
    if not key:
        raise ValueError("an empty key has no name")
    if key in _NAMES:
        return f"_.{key}"
    out = []
    for i, c in enumerate(key):
        plain = c.isascii() and (c.isalpha() or (i > 0 and (c.isdigit() or c in "-.")))
        out.append(c if plain else f"_{ord(c)}.")
    return "".join(out)


def unescape_key(name: str) -> str:
    if name.startswith("_."):
        return name[2:]
    if re.search(r"_(?!\d+\.)", name):
        raise ValueError(f"malformed key {name}")
    return re.sub(r"_(\d+)\.", lambda m: chr(int(m[1])), name)


def _number(v: float | int) -> str:
    if isinstance(v, float) and not math.isfinite(v):
        raise ValueError("a number beyond the range of doubles")
    return str(v) if isinstance(v, int) else repr(int(v) if v == int(v) and abs(v) < 1e15 else v)


def _pairs(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("an object has a key twice")
    return found


def _constant(name: str):
    raise ValueError(f"{name} is no JSON value")


#: Types that a value may take under ``other``, the first that fits (fixed order).
_STRINGS = ("dateTime", "date", "time", "base64Binary")
_CODECS = {k: plain(k) for k in (*_STRINGS, "integer", "decimal")}


def _other(value) -> tuple[str, str] | None:
    """(type, text) of a string or number that has a typed form from which it comes back as it is."""
    if isinstance(value, str):
        for kind in _STRINGS:
            try:
                token = _CODECS[kind].parse(value)
            except ValueError:
                continue
            if value and (kind != "base64Binary" or base64.b64encode(token).decode() == value):
                return kind, value
        return None
    text = _number(value)
    if isinstance(value, int) or text.lstrip("-").isdigit():
        return ("integer" if -(2**63) <= int(text) < 2**64 else "decimal"), text
    return ("decimal", text) if "e" not in text else None


def to_events(text: str, other: bool = False) -> list[Event]:
    """Objects become ``map`` with an element for each key, in order of keys.

    With ``other``, dates, times, base 64, integers and decimals take their
    typed forms. Raises ValueError for repeated keys, numbers beyond doubles,
    and texts that are no JSON.
    """
    out = [Event("SD")]

    def put(value, name: str | None) -> None:
        if name is not None:
            out.append(Event("SE", SPACE, escape_key(name)))
        typed = _other(value) if other and isinstance(value, str | int | float) and not isinstance(value, bool) else None
        kind = "other" if typed else "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "map"
        out.append(Event("SE", SPACE, kind))
        if kind == "map":
            for k in sorted(value):
                put(value[k], k)
        elif kind == "array":
            for v in value:
                put(v, None)
        elif typed:
            out.extend((Event("SE", SPACE, typed[0]), Event("CH", value=typed[1]), Event("EE")))
        elif kind != "null":
            text = value if kind == "string" else ("true" if value else "false") if kind == "boolean" else _number(value)
            if text or kind != "string":
                out.append(Event("CH", value=text))
        out.append(Event("EE"))
        if name is not None:
            out.append(Event("EE"))

    put(json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant), None)
    return [*out, Event("ED")]


def _plain(text: str) -> int | float:
    """A decimal as JSON's number; without a fraction it is an integer."""
    whole, _, part = text.partition(".")
    return float(text) if part.strip("0") else int(whole)


def json_schema() -> Schema:
    """The grammar of JSON documents: keys are elements that hold one value; values are global elements of their types."""
    simple = {"string": "xs:string", "number": "xs:double", "boolean": "xs:boolean"}
    values = "".join(f'<xs:element ref="j:{n}"/>' for n in ("map", "array", *simple, "null", "other"))
    other = "".join(f'<xs:element name="{n}" type="xs:{n}"/>' for n in (*_STRINGS, "integer", "decimal"))
    text = f"""<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="{SPACE}" xmlns:j="{SPACE}" elementFormDefault="qualified">
      <xs:element name="map"><xs:complexType><xs:sequence minOccurs="0" maxOccurs="unbounded"><xs:any namespace="##targetNamespace" processContents="lax"/></xs:sequence></xs:complexType></xs:element>
      <xs:element name="array"><xs:complexType><xs:choice minOccurs="0" maxOccurs="unbounded">{values}</xs:choice></xs:complexType></xs:element>
      {"".join(f'<xs:element name="{n}" type="{t}"/>' for n, t in simple.items())}<xs:element name="null"><xs:complexType/></xs:element>
      <xs:element name="other"><xs:complexType><xs:choice>{other}</xs:choice></xs:complexType></xs:element></xs:schema>"""
    return compile_schema("json.xsd", {"json.xsd": text})


#: Options of JSON documents that are coded by their schema.
OPTIONS = Options(strict=True, schema_id="exi4json")


def from_events(events: list[Event]) -> str:
    """Compact JSON text; raises ValueError for events that are no JSON document."""
    at = 1

    def expect(kind: str) -> Event:
        nonlocal at
        e = events[at]
        if e.kind != kind:
            raise ValueError(f"{e.kind} where {kind} was expected")
        at += 1
        return e

    def get():
        nonlocal at
        kind = expect("SE").local
        if kind == "map":
            value = {}
            while events[at].kind == "SE":
                key = unescape_key(expect("SE").local)
                value[key] = get()
                expect("EE")
        elif kind == "array":
            value = []
            while events[at].kind == "SE":
                value.append(get())
        elif kind == "null":
            value = None
        elif kind == "other":
            type_ = expect("SE").local
            text = expect("CH").value
            if type_ not in _CODECS:
                raise ValueError(f"unknown type {type_}")
            value = text if type_ in _STRINGS else int(text) if type_ == "integer" else _plain(text)
            expect("EE")
        else:
            text = expect("CH").value if events[at].kind == "CH" else ""
            if kind == "string":
                value = text
            elif kind == "boolean":
                value = {"true": True, "1": True, "false": False, "0": False}[text.strip()]
            elif kind == "number":
                value = json.loads(text.strip(), parse_constant=_constant)
                _number(value)
            else:
                raise ValueError(f"unknown element {kind}")
        expect("EE")
        return value

    found = get()
    expect("ED")
    return json.dumps(found, separators=(",", ":"), ensure_ascii=False)
