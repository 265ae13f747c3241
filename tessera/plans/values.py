"""Typed values on bit streams: a codec for each simple type of a schema.

A codec takes a text to a token (or raises ValueError if the text is not of the
type), writes the token, and reads one back as canonical text. Which codec a
type has follows from its built-in base, its facets, enumerations, the datatype
map of the options, and whether lexical values are preserved.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from decimal import Decimal

from tessera.plans.bits import Reader, Writer, width
from tessera.plans.schema import BUILTIN_LISTS, Schema

EXI = "http://www.w3.org/2009/exi"
#: Ranges of values up to this size are numbered.
SMALL = 4096
#: Bounds of the built-in integers (fixed values).
BOUNDS = {
    "integer": (None, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None),
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
#: Characters of the values of types whose lexical form is preserved (fixed values).
LEXICAL = {
    "base64Binary": "\t\n\r +/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "hexBinary": "\t\n\r 0123456789ABCDEFabcdef", "boolean": "\t\n\r 01aeflrstu",
    "dateTime": "\t\n\r +-.0123456789:TZ", "decimal": "\t\n\r +-.0123456789", "double": "\t\n\r +-.0123456789EFINae", "integer": "\t\n\r +-0123456789",
}
#: Parts of the date and time types: year, month and day, time, and which of them are written.
MOMENTS = {
    "dateTime": (r"(-?\d{4,})-(\d\d)-(\d\d)T", "ymdt"), "date": (r"(-?\d{4,})-(\d\d)-(\d\d)", "ymd"), "time": ("", "t"), "gYearMonth": (r"(-?\d{4,})-(\d\d)", "ym"),
    "gYear": (r"(-?\d{4,})", "y"), "gMonthDay": (r"--(\d\d)-(\d\d)", "md"), "gMonth": (r"--(\d\d)", "m"), "gDay": (r"---(\d\d)", "d"),
}
_CLOCK = r"(?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:\.(?P<f>\d+))?"
_ZONE = r"(?P<z>Z|[+-]\d\d:\d\d)?"
_SPACE = " \t\n\r"


class Text:
    """Untyped: any text, through the string table; with ``chars``, misses take few bits a character."""

    def __init__(self, chars: str | None = None):
        self.chars = chars
        self.at = {c: i for i, c in enumerate(chars)} if chars else {}

    def parse(self, text: str) -> str:
        return text

    def write(self, w: Writer, coder, name: tuple, token: str) -> None:
        coder.text(w, name, token, self.characters if self.chars else None)

    def read(self, r: Reader, coder, name: tuple) -> str:
        return coder.text(r, name, self.read_characters if self.chars else None)

    def characters(self, w: Writer, text: str) -> None:
        n = width(len(self.chars) + 1)
        for c in text:
            w.number(self.at.get(c, len(self.chars)), n)
            if c not in self.at:
                w.unsigned(ord(c))

    def read_characters(self, r: Reader, count: int) -> str:
        n, out = width(len(self.chars) + 1), []
        for _ in range(count):
            i = r.number(n)
            if i > len(self.chars):
                raise ValueError("character outside its set")
            out.append(self.chars[i] if i < len(self.chars) else chr(r.unsigned()))
        return "".join(out)


class Boolean:
    """One bit; two where a pattern tells 0 and 1 from false and true."""

    FORMS = ("false", "0", "true", "1")

    def __init__(self, pattern: bool = False):
        self.pattern = pattern

    def parse(self, text: str) -> int:
        found = self.FORMS.index(text.strip(_SPACE))
        return found if self.pattern else found // 2 * 2

    def write(self, w: Writer, coder, name: tuple, token: int) -> None:
        w.number(token if self.pattern else token // 2, 1 + self.pattern)

    def read(self, r: Reader, coder, name: tuple) -> str:
        return self.FORMS[r.number(2) if self.pattern else 2 * r.number(1)]


class Integer:
    """Numbered in a small range, without a sign from zero on, and else with a sign."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high
        self.small = low is not None and high is not None and 0 <= high - low < SMALL

    def parse(self, text: str) -> int:
        text = text.strip(_SPACE)
        if not re.fullmatch(r"[+-]?[0-9]+", text):
            raise ValueError(f"{text!r} is no integer")
        value = int(text)
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{text} is out of range")
        return value

    def write(self, w: Writer, coder, name: tuple, token: int) -> None:
        if self.small:
            w.number(token - self.low, width(self.high - self.low + 1))
        elif self.low is not None and self.low >= 0:
            w.unsigned(token)
        else:
            w.integer(token)

    def read(self, r: Reader, coder, name: tuple) -> str:
        if self.small:
            return str(r.number(width(self.high - self.low + 1)) + self.low)
        return str(r.unsigned() if self.low is not None and self.low >= 0 else r.integer())


class DecimalNumber:
    """Sign, integral part, and the fraction's digits in reverse."""

    def parse(self, text: str) -> tuple[int, int, int]:
        m = re.fullmatch(r"([+-]?)([0-9]*)(?:\.([0-9]*))?", text.strip(_SPACE))
        if not m or not (m[2] or m[3]):
            raise ValueError(f"{text!r} is no decimal")
        whole, part = int(m[2] or 0), int((m[3] or "0")[::-1])
        return int(m[1] == "-" and bool(whole or part)), whole, part

    def write(self, w: Writer, coder, name: tuple, token: tuple[int, int, int]) -> None:
        w.number(token[0], 1)
        w.unsigned(token[1])
        w.unsigned(token[2])

    def read(self, r: Reader, coder, name: tuple) -> str:
        sign, whole, part = r.number(1), r.unsigned(), r.unsigned()
        return f"{'-' * sign}{whole}.{str(part)[::-1]}"


class Float:
    """Mantissa and decimal exponent; a fixed exponent marks infinities and NaN."""

    SPECIAL = {"INF": 1, "-INF": -1, "NaN": 0}
    MARK, MOST = -(2**14), 2**63

    def parse(self, text: str) -> tuple[int, int]:
        text = text.strip(_SPACE)
        if text in self.SPECIAL:
            return self.SPECIAL[text], self.MARK
        if not re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([Ee][+-]?[0-9]+)?", text):
            raise ValueError(f"{text!r} is no float")
        sign, digits, exponent = Decimal(text).as_tuple()
        m = int("".join(map(str, digits)))
        while m >= self.MOST:
            m, exponent = m // 10, exponent + 1
        while m and m % 10 == 0:
            m, exponent = m // 10, exponent + 1
        exponent = exponent if m else 0
        if not -self.MOST.bit_length() * 260 < exponent < 2**14:
            raise ValueError(f"{text} is out of range")
        return -m if sign else m, exponent

    def write(self, w: Writer, coder, name: tuple, token: tuple[int, int]) -> None:
        w.integer(token[0])
        w.integer(token[1])

    def read(self, r: Reader, coder, name: tuple) -> str:
        m, e = r.integer(), r.integer()
        if e == self.MARK:
            return "INF" if m == 1 else "-INF" if m == -1 else "NaN"
        return f"{m}E{e}" if e else str(m)


class Moment:
    """Dates and times, part by part; 24:00:00 is the only time past 23:59."""

    def __init__(self, kind: str):
        self.kind = kind
        before, self.parts = MOMENTS[kind]
        self.form = re.compile(before + (_CLOCK if "t" in self.parts else "") + _ZONE, re.ASCII)

    def parse(self, text: str) -> dict:
        m = self.form.fullmatch(text.strip(_SPACE))
        if not m:
            raise ValueError(f"{text!r} is no {self.kind}")
        named = iter(m.groups())
        out = {p: int(next(named)) for p in self.parts if p != "t"}
        if not (1 <= out.get("m", 1) <= 12 and 1 <= out.get("d", 1) <= 31):
            raise ValueError(f"{text} is out of range")
        if "t" in self.parts:
            h, mi, s, f = int(m["h"]), int(m["mi"]), int(m["s"]), m["f"]
            if h > 24 or mi > 59 or s > 60 or (h == 24 and (mi or s or int(f or 0))):
                raise ValueError(f"{text} is out of range")
            out |= {"t": (h * 64 + mi) * 64 + s, "f": int(f[::-1]) if f and int(f) else None}
        if m["z"]:
            zone = 0 if m["z"] == "Z" else int(m["z"][0] + "1") * (int(m["z"][1:3]) * 64 + int(m["z"][4:]))
            if abs(zone) > 14 * 64 or abs(zone) % 64 > 59:
                raise ValueError(f"{text} is out of range")
            out["z"] = zone
        return out

    def write(self, w: Writer, coder, name: tuple, token: dict) -> None:
        if "y" in token:
            w.integer(token["y"] - 2000)
        if "m" in token or "d" in token:
            w.number(token.get("m", 0) * 32 + token.get("d", 0), 9)
        if "t" in token:
            w.number(token["t"], 17)
            w.number(int(token["f"] is not None), 1)
            if token["f"] is not None:
                w.unsigned(token["f"])
        w.number(int("z" in token), 1)
        if "z" in token:
            w.number(token["z"] + 14 * 64, 11)

    def read(self, r: Reader, coder, name: tuple) -> str:
        p, out = self.parts, ""
        if "y" in p:
            y = r.integer() + 2000
            out += f"{'-' * (y < 0)}{abs(y):04d}"
        if "m" in p or "d" in p:
            month, day = divmod(r.number(9), 32)
            out += ("-" if "y" in p else "--") + (f"{month:02d}" if "m" in p else "") + (f"-{day:02d}" if "d" in p else "")
        if "t" in p:
            out += "T" * (p != "t")
            t = r.number(17)
            out += f"{t // 4096:02d}:{t // 64 % 64:02d}:{t % 64:02d}"
            if r.number(1):
                out += f".{str(r.unsigned())[::-1]}"
        if r.number(1):
            z = r.number(11) - 14 * 64
            out += "Z" if not z else f"{'+' if z > 0 else '-'}{abs(z) // 64:02d}:{abs(z) % 64:02d}"
        return out


class Binary:
    """Length and bytes; texts in base 64 or 16."""

    def __init__(self, hexadecimal: bool):
        self.hexadecimal = hexadecimal

    def parse(self, text: str) -> bytes:
        text = re.sub(f"[{_SPACE}]", "", text)
        return bytes.fromhex(text) if self.hexadecimal else base64.b64decode(text, validate=True)

    def write(self, w: Writer, coder, name: tuple, token: bytes) -> None:
        w.unsigned(len(token))
        for b in token:
            w.bits(b, 8)

    def read(self, r: Reader, coder, name: tuple) -> str:
        n = r.unsigned()
        if n > len(r.data):
            raise EOFError("binary value longer than the stream")
        data = bytes(r.bits(8) for _ in range(n))
        return data.hex().upper() if self.hexadecimal else base64.b64encode(data).decode()


class Enumeration:
    """The place of a value among those of its type; values are compared by their tokens."""

    def __init__(self, values: tuple[str, ...], of, collapse: bool):
        self.values, self.of, self.collapse = values, of, collapse
        self.tokens = [repr(of.parse(self.plain(v))) for v in values]

    def plain(self, text: str) -> str:
        return " ".join(text.split()) if self.collapse else text

    def parse(self, text: str) -> int:
        return self.tokens.index(repr(self.of.parse(self.plain(text))))

    def write(self, w: Writer, coder, name: tuple, token: int) -> None:
        w.number(token, width(len(self.values)))

    def read(self, r: Reader, coder, name: tuple) -> str:
        i = r.number(width(len(self.values)))
        if i >= len(self.values):
            raise ValueError("no such value in the enumeration")
        return self.values[i]


class List:
    """Number of items, and each item."""

    def __init__(self, item):
        self.item = item

    def parse(self, text: str) -> list:
        return [self.item.parse(t) for t in text.split()]

    def write(self, w: Writer, coder, name: tuple, token: list) -> None:
        w.unsigned(len(token))
        for t in token:
            self.item.write(w, coder, name, t)

    def read(self, r: Reader, coder, name: tuple) -> str:
        n = r.unsigned()
        if n > 8 * len(r.data) + 1:
            raise EOFError("list longer than the stream")
        return " ".join(self.item.read(r, coder, name) for _ in range(n))


class Own:
    """A representation of the user: a pair of functions on a bit stream."""

    def __init__(self, put: Callable[[Writer, str], None], get: Callable[[Reader], str]):
        self.put, self.get = put, get

    def parse(self, text: str) -> str:
        return text

    def write(self, w: Writer, coder, name: tuple, token: str) -> None:
        self.put(w, token)

    def read(self, r: Reader, coder, name: tuple) -> str:
        return self.get(r)


_OWN: dict[tuple[str, str], Own] = {}


def register(uri: str, local: str, put: Callable[[Writer, str], None], get: Callable[[Reader], str]) -> None:
    """Makes a representation known in this process, for datatype maps that name it.

    Tasks run in other processes: call this inside the function that they run.
    """
    _OWN[uri, local] = Own(put, get)


def unregister(uri: str, local: str) -> None:
    _OWN.pop((uri, local), None)


UNTYPED = Text()


def plain(builtin: str):
    """The codec of a built-in type without facets."""
    if builtin in BOUNDS:
        return Integer(*BOUNDS[builtin])
    if builtin in MOMENTS:
        return Moment(builtin)
    if builtin in BUILTIN_LISTS:
        return List(UNTYPED)
    made = {"boolean": Boolean, "decimal": DecimalNumber, "float": Float, "double": Float}.get(builtin)
    if made:
        return made()
    return Binary(builtin == "hexBinary") if builtin in ("hexBinary", "base64Binary") else UNTYPED


class Codecs:
    """The codecs of a schema's simple types under given options."""

    def __init__(self, schema: Schema, lexical: bool, datatype_map: tuple):
        self.schema, self.lexical = schema, lexical
        self.map = {_local(t): r for t, r in datatype_map}
        self.made: dict[str | None, object] = {None: UNTYPED}

    def of(self, name: str | None):
        if name not in self.made:
            self.made[name] = self._make(name)
        return self.made[name]

    def _make(self, name: str):
        chain = self.schema.chain(name)
        own = [self.schema.types[t] for t in chain if t in self.schema.types]
        variety = next((t.variety for t in own if t.variety in ("list", "union")), "atomic")
        builtin = next((t[3:] for t in chain if t.startswith("xs:")), "anySimpleType")
        if self.lexical:
            return Text(LEXICAL.get(_kind(builtin))) if variety == "atomic" and _kind(builtin) in LEXICAL else Text(self._charset(own))
        listed = next((i for i, t in enumerate(own) if t.values), None)
        mapped = next((i for i, t in enumerate(chain) if t in self.map), None)
        if mapped is not None and (listed is None or mapped <= chain.index(own[listed].name)):
            return self._represent(self.map[chain[mapped]])
        if variety == "union" or builtin in ("QName", "NOTATION"):
            return UNTYPED
        if variety == "list":
            return List(self.of(next(t.item for t in own if t.item)))
        base = self._atomic(builtin, own)
        if listed is not None:
            return Enumeration(own[listed].values, base, builtin not in ("string", "normalizedString"))
        return base

    def _represent(self, name: tuple[str, str]):
        if name[0] == EXI:
            return plain(name[1])
        if name not in _OWN:
            raise ValueError(f"no representation {name} is registered")
        return _OWN[name]

    def _atomic(self, builtin: str, own: list):
        if builtin == "boolean":
            return Boolean(any("pattern" in t.facets for t in own))
        if builtin in BOUNDS:
            low, high = BOUNDS[builtin]
            for t in own:
                for facet, (value, *_) in t.facets.items():
                    if facet in ("minInclusive", "minExclusive"):
                        n = int(value) + (facet == "minExclusive")
                        low = n if low is None else max(low, n)
                    elif facet in ("maxInclusive", "maxExclusive"):
                        n = int(value) - (facet == "maxExclusive")
                        high = n if high is None else min(high, n)
            return Integer(low, high)
        base = plain(builtin)
        return Text(self._charset(own)) if base is UNTYPED and self._charset(own) else base

    @staticmethod
    def _charset(own: list) -> str | None:
        return next((charset(t.facets["pattern"]) for t in own if "pattern" in t.facets), None)


def _kind(builtin: str) -> str:
    return "integer" if builtin in BOUNDS else "dateTime" if builtin in MOMENTS else "double" if builtin == "float" else builtin


def _local(name: tuple[str, str]) -> str:
    uri, local = name
    return f"xs:{local}" if uri == "http://www.w3.org/2001/XMLSchema" else f"{{{uri}}}{local}" if uri else local


def charset(patterns: tuple[str, ...]) -> str | None:
    """The characters that texts of these patterns can hold, in order; None if they are not few.

    Groups, branches, quantifiers, classes with ranges and negation inside them
    are read; ``.``, escapes for classes of characters, and characters beyond
    the basic plane leave the set open.
    """
    found: set[str] = set()
    for p in patterns:
        part = _Pattern(p).branches()
        if part is None:
            return None
        found |= part
    return "".join(sorted(found)) if 0 < len(found) < 256 and max(found) <= "\uffff" else None


class _Pattern:
    PLAIN = {"n": "\n", "r": "\r", "t": "\t"}

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def branches(self) -> set[str] | None:
        """Of branches up to a closing bracket or the end."""
        out: set[str] | None = set()
        while self.at < len(self.text) and self.text[self.at] != ")":
            c = self.text[self.at]
            self.at += 1
            part: set[str] | None = set()
            if c == "(":
                part = self.branches()
                self.at += 1
            elif c == "[":
                part = self.group()
            elif c == "\\":
                part = self.escape()
            elif c == ".":
                part = None
            elif c == "{":
                self.at = self.text.index("}", self.at) + 1
            elif c not in "?*+|":
                part = {c}
            out = None if out is None or part is None else out | part
        return out

    def escape(self) -> set[str] | None:
        c = self.text[self.at]
        self.at += 1
        if c in "pP":
            self.at = self.text.index("}", self.at) + 1
        return {"s": set(_SPACE)}.get(c) if c.isalpha() and c not in self.PLAIN else {self.PLAIN.get(c, c)}

    def group(self) -> set[str] | None:
        negative = self.text[self.at] == "^"
        self.at += negative
        out: set[str] | None = set()
        while self.text[self.at] != "]":
            if self.text.startswith("-[", self.at):
                self.at += 2
                less = self.group()
                out = None if out is None or less is None else out - less
                continue
            c = self.text[self.at]
            self.at += 1
            part = self.escape() if c == "\\" else {c}
            if part and len(part) == 1 and self.text[self.at] == "-" and self.text[self.at + 1] not in "[]":
                self.at += 1
                c = self.text[self.at]
                self.at += 1
                top = self.escape() if c == "\\" else {c}
                part = {chr(x) for x in range(ord(min(part)), ord(min(top)) + 1)} if top else None
            out = None if out is None or part is None else out | part
        self.at += 1
        return None if negative else out
