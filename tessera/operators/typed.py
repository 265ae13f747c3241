"""Schema types of the values in an event table, and their checks as native expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.plans.codec import XSI
from tessera.plans.schema import ANY, Schema, clark

_COLUMNS = "doc_id long, seq long, kind string, uri string, local_name string, owner string, type string, builtin string, value string, enum_index int, is_list boolean"
#: Bounds of the integer types (fixed values).
RANGES = {
    "byte": (-128, 127), "short": (-32768, 32767), "int": (-2147483648, 2147483647), "long": (-9223372036854775808, 9223372036854775807),
    "unsignedByte": (0, 255), "unsignedShort": (0, 65535), "unsignedInt": (0, 4294967295), "unsignedLong": (0, 18446744073709551615),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "integer": (None, None),
}
_Y, _M, _D = "-?[0-9]{4,}", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
_TIME = r"(([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?|24:00:00(\.0+)?)"
_ZONE = "(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
#: Forms of the date and time types, every part in its range.
DATES = {
    "dateTime": f"{_Y}-{_M}-{_D}T{_TIME}", "date": f"{_Y}-{_M}-{_D}", "time": _TIME, "gYear": _Y,
    "gYearMonth": f"{_Y}-{_M}", "gMonth": f"--{_M}", "gMonthDay": f"--{_M}-{_D}", "gDay": f"---{_D}",
}


def type_values(events: DataFrame, schema: Schema) -> DataFrame:
    """Attribute values and texts with the types that the schema gives them.

    ``owner`` is the element that a value belongs to. A stack of open elements
    is all that a task holds. xsi:type (a prefixed name, by the NS events of
    the document, or ``{uri}local``) replaces the declared type; elements and
    attributes that are not declared are typed by a global declaration of
    their name or else ``xs:anyType`` and ``xs:anySimpleType``. Text in
    element content is ``xs:string``. ``enum_index`` is the place of a value
    in its type's enumeration, -1 if it is not one of its values.
    """
    kids, atts = {}, {}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, stack, scopes, held = None, [], [], []
        names = [f.split(" ")[0] for f in _COLUMNS.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 7, pa.int32(), pa.bool_()]

        def of(type_: str, row: tuple, owner: str) -> tuple:
            d, seq, kind, uri, local, value = row
            enum, is_list = None, False
            for t in schema.chain(type_):
                own = schema.types.get(t)
                if own is not None and own.values and enum is None:
                    enum = own.values.index(value.strip()) if value.strip() in own.values else -1
                is_list |= (own is not None and own.variety == "list") or t in ("xs:NMTOKENS", "xs:IDREFS", "xs:ENTITIES")
            return d, seq, kind, uri, local, owner, type_, schema.builtin(type_), value, enum, is_list

        def named(value: str) -> str | None:
            value = value.strip()
            if value.startswith("{"):
                uri, _, local = value[1:].partition("}")
            else:
                prefix, _, local = value.rpartition(":")
                uri = next((s[prefix] for s in reversed(scopes) if prefix in s), "" if not prefix else None)
            if uri == "http://www.w3.org/2001/XMLSchema":
                return f"xs:{local}"
            name = clark(uri, local)
            return name if name in schema.types else None

        def settle(out: list) -> None:
            """Types the attributes of the start tag that has just been read."""
            for row in held:
                if row[3] == XSI and row[4] == "type":
                    stack[-1] = (named(row[5]) or stack[-1][0], stack[-1][1])
            own, owner = stack[-1] if stack else (ANY, None)
            if held and own not in atts:
                atts[own] = schema.attribute_types(own)
            for row in held:
                if row[3] != XSI:
                    name = clark(row[3], row[4])
                    decl = atts[own].get(name) or schema.attributes.get(name)
                    out.append(of(decl.type if decl else "xs:anySimpleType", row, owner))
            held.clear()

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "seq", "kind", "uri", "local_name", "value", "prefix")), strict=True):
                d, seq, kind, uri, local, value, prefix = row
                if d != doc:
                    doc, stack, scopes, held = d, [], [], []
                if kind == "AT":
                    held.append(row[:6])
                    continue
                if kind == "NS":
                    if scopes:  # outside of elements it binds nothing
                        scopes[-1][prefix or ""] = uri
                    continue
                if held:
                    settle(out)
                if kind == "SE":
                    name, up = clark(uri, local), stack[-1][0] if stack else None
                    if up is not None and up not in kids:
                        kids[up] = schema.children(up)
                    type_ = kids[up].get(name) if up is not None else None
                    if type_ is None:
                        type_ = schema.elements[name].type if name in schema.elements else ANY
                    stack.append((type_, local))
                    scopes.append({})
                elif kind == "EE":
                    stack.pop()
                    scopes.pop()
                elif kind == "CH" and stack:
                    out.append(of(schema.simple(stack[-1][0]) or "xs:string", row[:6], stack[-1][1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    dealt = events.select("doc_id", "seq", "kind", "uri", "local_name", "value", "prefix").where(F.col("kind").isin("SE", "EE", "AT", "CH", "NS"))
    return dealt.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(scan, _COLUMNS)


def canonical_value(builtin: str = "builtin", value: str = "value") -> Column:
    """The canonical text of a value of a built-in type; texts of other types stay."""
    kind = F.expr(builtin)
    ints = kind.isin(*[f"xs:{n}" for n in RANGES])
    exact = F.when(kind == "xs:boolean", F.coalesce(S.normal_boolean(value), F.expr(value))).when(ints, S.normal_integer(value)).when(kind == "xs:decimal", S.normal_decimal(value))
    texts = kind.isin("xs:string", "xs:normalizedString", "xs:anySimpleType", "xs:anyType")
    return exact.when(kind == "xs:hexBinary", F.upper(F.trim(F.expr(value)))).when(texts, F.expr(value)).otherwise(S.whitespace(value, "collapse"))


def is_valid(builtin: str = "builtin", value: str = "value", enum: str = "enum_index", is_list: str = "is_list") -> Column:
    """Whether a value has the lexical form and range of its built-in type and is in its enumeration.

    Null for lists, whose items are not checked.
    """
    kind, t = F.expr(builtin), F.trim(F.expr(value))
    ok = F.when(kind == "xs:boolean", t.isin("true", "false", "0", "1"))
    # 38 digits hold every bounded type; a longer text is beyond all bounds on the side of its sign
    n = S.normal_integer(value)
    d, negative = n.try_cast("decimal(38,0)"), n.startswith("-")

    def bound(side: int) -> Column:
        known = {f"xs:{name}": r[side] for name, r in RANGES.items() if r[side] is not None}
        return F.try_element_at(F.create_map(*[F.lit(x) for name, v in known.items() for x in (name, str(v))]), kind).cast("decimal(38,0)")

    above, below = F.coalesce(d >= bound(0), ~negative | bound(0).isNull()), F.coalesce(d <= bound(1), negative | bound(1).isNull())
    ok = ok.when(kind.isin(*[f"xs:{name}" for name in RANGES]), t.rlike("^[+-]?[0-9]+$") & above & below)
    ok = ok.when(kind == "xs:decimal", t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"))
    ok = ok.when(kind.isin("xs:float", "xs:double"), t.rlike(r"^(-?INF|NaN|[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"))
    ok = ok.when(kind == "xs:hexBinary", t.rlike("^([0-9A-Fa-f]{2})*$"))
    ok = ok.when(kind == "xs:base64Binary", (t == "") | S.is_base64(f"regexp_replace({value}, '[ \\t\\n\\r]', '')"))
    for name, pattern in DATES.items():
        ok = ok.when(kind == f"xs:{name}", t.rlike(f"^{pattern}{_ZONE}$"))
    return F.when(~F.expr(is_list), ok.otherwise(F.lit(True)) & (F.coalesce(F.expr(enum), F.lit(0)) >= 0))
