"""Streams by the grammars of a schema: hand-made bits, round trips in every layout, typed values."""

import random
from dataclasses import replace

import pytest

from tessera.plans import grammar, values
from tessera.plans.bits import Reader, Writer
from tessera.plans.codec import XSI, Event, decode, encode
from tessera.plans.options import ALIGNMENTS, Options, Preserve
from tessera.plans.schema import XSD, compile_schema

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'


def schema(body, attrs=""):
    return compile_schema("m", {"m": f"<xs:schema {XS} {attrs}>{body}</xs:schema>"})


def el(name, *inner, uri="", **attrs):
    out = [Event("SE", uri, name)]
    for k, v in sorted(attrs.items()):
        out.append(Event("AT", "", k, value=v))
    for x in inner:
        out += [Event("CH", value=x)] if isinstance(x, str) else x
    return [*out, Event("EE")]


def doc(*parts):
    return [Event("SD"), *[e for p in parts for e in p], Event("ED")]


def plain(events):
    """Without prefixes, which only some options keep."""
    return [e._replace(prefix=None) for e in events]


SMALL = schema(
    """<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="a" type="xs:boolean"/><xs:element name="b" type="xs:byte" minOccurs="0" maxOccurs="2"/></xs:sequence>
    <xs:attribute name="k" type="xs:unsignedByte"/></xs:complexType></xs:element>"""
)


def test_strict_bits_by_hand():
    # header 10000000; r of {r, *}: 0; {AT k, SE a}: 1; boolean 1; {SE b, EE}: 0; 5 + 128: 10000101; {SE b, EE}: 1
    events = doc(el("r", el("a", "true"), el("b", "5")))
    assert encode(events, Options(strict=True), in_header=False, schema=SMALL).hex() == "80" + f"{int('0' '1' '1' '0' '10000101' '1' '000', 2):04x}"
    # {AT k, SE a}: 0; 7 as eight bits; then only SE a: nothing; boolean 0; {SE b, EE}: 1
    events = doc(el("r", el("a", "0"), k="7"))
    assert encode(events, Options(strict=True), in_header=False, schema=SMALL).hex() == "80" + f"{int('0' '0' '00000111' '0' '1' '0000', 2):04x}"
    back = plain(decode(encode(events, Options(strict=True), schema=SMALL), None, SMALL))
    assert back == doc(el("r", el("a", "false"), k="7"))


def test_deviations_by_hand():
    # r: 0. First node: AT k, SE a, escape in 2 bits: 10; EE, xsi:type, xsi:nil, AT(*), AT untyped, SE(*), CH in 3 bits: CH 110;
    # content after it: SE a, escape in 1 bit: 1; EE, SE(*), CH in 2 bits: EE 00
    events = doc(el("r", "x"))
    bits = "0" + "10" + "110" + f"{3:08b}" + f"{ord('x'):08b}" + "1" + "00"
    want = f"{int(bits.ljust(-(-len(bits) // 8) * 8, '0'), 2):0{-(-len(bits) // 8) * 2}x}"
    assert encode(events, schema=SMALL).hex() == "80" + want
    # an untyped value of the declared attribute: 10, 100, and one of {k, *}: 0
    data = encode(doc(el("r", el("a", "1"), k="many")), schema=SMALL)
    assert data[1] == int("0" + "10" + "100" + "0" + "0", 2)
    assert plain(decode(data, None, SMALL)) == doc(el("r", el("a", "true"), k="many"))
    with pytest.raises(ValueError):
        encode(doc(el("r", el("a", "1"), k="many")), Options(strict=True), schema=SMALL)


def test_dump_of_a_grammar():
    rows = grammar.dump(grammar.Grammars(SMALL, Options(strict=True)), grammar.Decl("r/type"))
    assert rows == [(0, "0", "AT {}k", 1), (0, "1", "SE {}a", 2), (1, "0", "SE {}a", 2), (2, "0", "SE {}b", 3), (2, "1", "EE", None), (3, "0", "SE {}b", 4), (3, "1", "EE", None), (4, "0", "EE", None)]


RICH = schema(
    """
<xs:simpleType name="size"><xs:restriction base="xs:int"><xs:minInclusive value="10"/><xs:maxExclusive value="200"/></xs:restriction></xs:simpleType>
<xs:simpleType name="shade"><xs:restriction base="xs:token"><xs:enumeration value="dark"/><xs:enumeration value="light"/><xs:enumeration value="none"/></xs:restriction></xs:simpleType>
<xs:simpleType name="sizes"><xs:list itemType="size"/></xs:simpleType>
<xs:simpleType name="either"><xs:union memberTypes="size shade"/></xs:simpleType>
<xs:simpleType name="plate"><xs:restriction base="xs:string"><xs:pattern value="[A-C]{2}-\\d?[0-9]+"/></xs:restriction></xs:simpleType>
<xs:simpleType name="ticket"><xs:restriction base="xs:string"><xs:pattern value="[A-F]{2}-[0-9]+"/></xs:restriction></xs:simpleType>
<xs:complexType name="thing"><xs:sequence>
  <xs:element name="n" type="xs:integer"/><xs:element name="d" type="xs:decimal" minOccurs="0"/><xs:element name="f" type="xs:double" minOccurs="0" maxOccurs="unbounded"/>
  <xs:choice minOccurs="0" maxOccurs="3"><xs:element name="when" type="xs:dateTime"/><xs:element name="day" type="xs:date"/><xs:element name="bin" type="xs:hexBinary"/><xs:element name="b64" type="xs:base64Binary"/></xs:choice>
  <xs:element name="list" type="t:sizes" minOccurs="0"/><xs:element name="u" type="t:either" minOccurs="0"/><xs:element name="s" type="t:ticket" minOccurs="0" nillable="true"/><xs:element ref="t:head" minOccurs="0"/>
</xs:sequence><xs:attribute name="shade" type="t:shade"/><xs:attribute name="id" type="xs:unsignedInt" use="required"/></xs:complexType>
<xs:complexType name="more"><xs:complexContent><xs:extension base="t:thing"><xs:sequence><xs:element name="extra" type="t:money" minOccurs="0"/><xs:any namespace="##other" processContents="lax" minOccurs="0"/></xs:sequence><xs:attribute name="on" type="xs:boolean"/><xs:anyAttribute/></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="money"><xs:simpleContent><xs:extension base="xs:decimal"><xs:attribute name="unit" type="xs:string"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:complexType name="note" mixed="true"><xs:choice minOccurs="0" maxOccurs="unbounded"><xs:element name="b" type="xs:string"/><xs:element name="n" type="xs:short"/></xs:choice></xs:complexType>
<xs:complexType name="loose"><xs:all><xs:element name="x" type="xs:string"/><xs:element name="y" type="xs:boolean" minOccurs="0"/></xs:all></xs:complexType>
<xs:element name="head" type="xs:date"/><xs:element name="stand" substitutionGroup="t:head"/>
<xs:attribute name="world" type="xs:int"/>
<xs:element name="root"><xs:complexType><xs:choice minOccurs="0" maxOccurs="unbounded"><xs:element name="thing" type="t:thing"/><xs:element name="note" type="t:note"/><xs:element name="loose" type="t:loose"/><xs:element name="any" type="xs:anyType"/></xs:choice></xs:complexType></xs:element>
""".replace("memberTypes=\"size shade\"", 'memberTypes="t:size t:shade"').replace('itemType="size"', 'itemType="t:size"'),
    'targetNamespace="urn:t" xmlns:t="urn:t"',
)


def thing(rng, strict):
    at = {"id": str(rng.randrange(10**6))} | ({"shade": rng.choice(["dark", "light", "none"])} if rng.random() < 0.5 else {})
    kids = [el("n", str(rng.randint(-(10**20), 10**20)))]
    if rng.random() < 0.5:
        kids.append(el("d", rng.choice(["1.5", "-0.25", "100.0", "12345678901234567890123.000000000000000000000000123"])))
    kids += [el("f", rng.choice(["15E-1", "INF", "-INF", "NaN", "3", "-7E20"])) for _ in range(rng.randint(0, 3))]
    for _ in range(rng.randint(0, 3)):
        kids.append(rng.choice([el("when", "2020-02-29T24:00:00Z"), el("when", "-0044-03-15T01:02:03.0405-08:30"), el("day", "1999-12-31+14:00"), el("bin", "00FFAB"), el("b64", "AAEC")]))
    if rng.random() < 0.5:
        kids.append(el("list", rng.choice(["10 199 20", "55"])))
    if rng.random() < 0.5:
        kids.append(el("u", rng.choice(["dark", "77"])))
    if rng.random() < 0.5:
        kids.append(el("s", rng.choice(["AF-123", "BB-0"])))
    if rng.random() < 0.5:
        kids.append(rng.choice([el("head", "2001-01-01", uri="urn:t"), el("stand", "2001-01-02", uri="urn:t")]))
    if not strict and rng.random() < 0.5:
        at |= {"zz": "undeclared"}
        kids += [el("surprise", "text", el("n", "12")), "tail"]
        kids[0] = el("n", "no number")
    return el("thing", *kids, **at)


def rich(rng, strict):
    kids = []
    for _ in range(rng.randint(0, 12)):
        kids.append(
            rng.choice(
                [
                    lambda: thing(rng, strict),
                    lambda: el("note", "some ", el("b", "bold"), " text", el("n", "-5"), el("n", "9")),
                    lambda: el("note"),
                    lambda: el("loose", el("y", "true"), el("x", "v"), el("y", "false")),
                    lambda: el("any", "t", el("w", "u", q="1"), el("head", "2010-10-10", uri="urn:t"), a="b"),
                    lambda: el("any", *[el("w", el("w"), q=str(i)) for i in range(3)]),
                ]
            )()
        )
    return doc(el("root", *kids, uri="urn:t"))


@pytest.mark.parametrize("layout", [*ALIGNMENTS, "compression"])
@pytest.mark.parametrize("strict", [False, True])
def test_round_trip(layout, strict):
    rng = random.Random(3)
    for i in range(60):
        o = Options(alignment="bit-packed" if layout == "compression" else layout, compression=layout == "compression", strict=strict, schema_id="s" if i % 2 else None, block_size=rng.choice([1, 9, 1_000_000]))
        if not strict and i % 3 == 0:
            o = replace(o, preserve=Preserve(comments=True, pis=True, dtd=i % 2 == 0))
        events = rich(rng, strict)
        if o.preserve.comments:
            events[2:2] = [Event("CM", value="c"), Event("PI", local="p", value="d")]
        data = encode(events, o, schema=RICH, in_header=i % 2 == 1)
        assert plain(decode(data, None if i % 2 else o, RICH)) == events


@pytest.mark.parametrize("strict", [False, True])
def test_fragments(strict):
    rng = random.Random(4)
    o = Options(fragment=True, strict=strict)
    events = doc(thing(rng, strict), el("n", "12", uri="")[:0], el("x", "text"), thing(rng, strict), el("head", "2020-01-01", uri="urn:t"), el("n", "34"))
    assert plain(decode(encode(events, o, schema=RICH), o, RICH)) == events


def test_type_and_nil_switches():
    for strict in (False, True):
        o = Options(strict=strict)
        typed = el("thing", el("n", "1"), el("extra", "2.5", unit="EUR"), el("q", uri="urn:z"), id="4", on="true", zeta="9")
        typed.insert(1, Event("AT", XSI, "type", value="{urn:t}more"))
        nil = el("thing", el("n", "1"), [Event("SE", "", "s"), Event("AT", XSI, "nil", value="true"), Event("EE")], id="5")
        off = el("thing", el("n", "1"), [Event("SE", "", "s"), Event("AT", XSI, "nil", value="false"), Event("CH", value="AA-1"), Event("EE")], id="6")
        events = doc(el("root", typed, nil, off, uri="urn:t"))
        assert plain(decode(encode(events, o, schema=RICH), o, RICH)) == events
    built_in = el("any", "12")
    built_in.insert(1, Event("AT", XSI, "type", value=f"{{{XSD}}}int"))
    events = doc(el("root", built_in, uri="urn:t"))
    assert plain(decode(encode(events, schema=RICH), None, RICH)) == events


def test_blanks_and_empty_texts():
    blank = [Event("CH", value="\n  ")]
    events = doc(el("root", blank, el("loose", blank, el("x", ""), blank), blank, el("note", blank), uri="urn:t"))
    for strict in (False, True):
        o = Options(strict=strict)
        got = plain(decode(encode(events, o, schema=RICH), o, RICH))
        empty = [Event("SE", "", "x"), Event("CH", value=""), Event("EE")]
        assert got == doc(el("root", el("loose", empty), el("note", blank), uri="urn:t"))
    kept = Options(preserve=Preserve(whitespace=True))
    assert plain(decode(encode(events, kept, schema=RICH), kept, RICH)) == events
    # blanks that are all of an element without text stay unless the stream is strict
    events = doc(el("root", blank, uri="urn:t"))
    assert plain(decode(encode(events, schema=RICH), None, RICH)) == events
    strict = Options(strict=True)
    assert plain(decode(encode(events, strict, schema=RICH), strict, RICH)) == doc(el("root", uri="urn:t"))


def test_built_in_types_only():
    o = Options(schema_id="")
    typed = el("a", "12", el("b"))
    typed[1:1] = [Event("AT", XSI, "type", value=f"{{{XSD}}}anyType")]
    events = doc(typed)
    assert plain(decode(encode(events, o))) == events
    with pytest.raises(ValueError, match="needs the schema"):
        list(decode(encode(doc(el("root", uri="urn:t")), Options(schema_id="s"), schema=RICH)))


def test_lexical_values_are_kept():
    o = Options(preserve=Preserve(lexical_values=True))
    events = doc(el("root", el("thing", el("n", "+007"), el("d", "1.50"), el("f", "1.50e0"), el("list", " 10  20 "), id="0004", shade=" dark "), uri="urn:t"))
    assert plain(decode(encode(events, o, schema=RICH), o, RICH)) == events


@pytest.mark.parametrize("layout", ["bit-packed", "byte-alignment"])
@pytest.mark.parametrize("informed", [False, True])
def test_self_contained(layout, informed):
    rng = random.Random(6)
    s = RICH if informed else None
    o = Options(alignment=layout, self_contained=True)
    for _ in range(20):
        events = rich(rng, False)
        data = encode(events, o, schema=s, self_contained={("", "thing"), ("", "w"), ("", "n")})
        assert plain(decode(data, o, s)) == events
        assert plain(decode(encode(events, o, schema=s), o, s)) == events
    one = encode(doc(el("a", el("b", "t"), el("b", "t"))), Options(alignment="byte-alignment", self_contained=True), self_contained={("", "b")})
    assert one.count(b"\x04t") == 0 and one.count(b"\x03t") == 2  # each has a string table of its own


def test_datatype_maps():
    exi = values.EXI
    o = Options(datatype_map=((("urn:t", "size"), (exi, "string")), ((XSD, "decimal"), (exi, "string")), ((XSD, "date"), ("urn:own", "days"))))
    values.register("urn:own", "days", lambda w, t: w.string(t[::-1]), lambda r: r.string()[::-1])
    try:
        events = doc(el("root", el("thing", el("n", "007"), el("d", "1.50"), el("list", "010 20"), el("head", " odd ", uri="urn:t"), id="1"), uri="urn:t"))
        got = plain(decode(encode(events, o, schema=RICH), o, RICH))
        # n is an integer, derived from decimal; id is derived from integer
        assert got == events
    finally:
        values.unregister("urn:own", "days")
    with pytest.raises(ValueError, match="registered"):
        encode(events, replace(o, block_size=7), schema=RICH)
    kept = values.Codecs(RICH, False, (((XSD, "token"), (exi, "string")),)).of("{urn:t}shade")
    assert isinstance(kept, values.Enumeration)
    assert values.Codecs(RICH, False, ((("urn:t", "shade"), (exi, "string")),)).of("{urn:t}shade") is values.UNTYPED


class Plain:
    """A coder without a string table."""

    def text(self, stream, name, *rest):
        raise AssertionError


@pytest.mark.parametrize("aligned", [False, True])
@pytest.mark.parametrize(
    "kind,given,want",
    [
        ("boolean", " 1 ", "true"), ("integer", "-0", "0"), ("unsignedLong", "18446744073709551615", "18446744073709551615"), ("byte", "-128", "-128"), ("decimal", "-.50", "-0.5"), ("decimal", "+7", "7.0"),
        ("decimal", "0." + "0" * 40 + "1", "0." + "0" * 40 + "1"), ("double", "1.50", "15E-1"), ("float", "-0", "0"), ("double", "1e400", "1E400"), ("double", "123456789012345678901234567890", "1234567890123456789E11"),
        ("time", "24:00:00", "24:00:00"), ("time", "23:59:60.10Z", "23:59:60.1Z"), ("gYear", "-0001", "-0001"), ("gYearMonth", "12345-06", "12345-06"), ("gMonth", "--12Z", "--12Z"), ("gMonthDay", "--02-30", "--02-30"),
        ("gDay", "---31-00:30", "---31-00:30"), ("dateTime", "2000-01-01T00:00:00+00:00", "2000-01-01T00:00:00Z"), ("hexBinary", "0a\nFF", "0AFF"), ("base64Binary", "YQ ==", "YQ=="),
    ],
)
def test_values(kind, given, want, aligned):
    codec, w = values.plain(kind), Writer(aligned)
    codec.write(w, Plain(), None, codec.parse(given))
    w.bits(1, 1)
    r = Reader(w.done(), aligned)
    assert codec.read(r, Plain(), None) == want and r.bits(1) == 1
    assert codec.parse(want) == codec.parse(given)


@pytest.mark.parametrize(
    "kind,bad",
    [("boolean", "yes"), ("integer", "1.0"), ("byte", "128"), ("decimal", "."), ("decimal", "1e3"), ("double", "inf"), ("time", "24:30:00"), ("time", "24:00:01"), ("time", "23:60:00"), ("date", "2020-13-01"), ("date", "2020-01-32"),
     ("date", "20-01-01"), ("dateTime", "2020-01-01T00:00:00+14:01"), ("gDay", "---00"), ("hexBinary", "abc"), ("base64Binary", "a"), ("int", "2147483648"), ("positiveInteger", "0")],
)
def test_values_that_are_not_of_their_type(kind, bad):
    with pytest.raises(ValueError):
        values.plain(kind).parse(bad)


def test_small_ranges_and_patterns():
    codecs = values.Codecs(RICH, False, ())
    size = codecs.of("{urn:t}size")
    w = Writer()
    size.write(w, None, None, size.parse("199"))
    assert (size.low, size.high, size.small) == (10, 199, True) and w.done() == bytes([189])
    assert codecs.of("{urn:t}plate") is values.UNTYPED and codecs.of("{urn:t}ticket").chars == "-0123456789ABCDEF"
    assert values.charset(("a|b+(cd)*", "[x-z-[y]]{3}")) == "abcdxz" and values.charset((r"\-\n",)) == "\n-"
    assert [values.charset((p,)) for p in (".", r"\w", "[^a]", r"\p{L}", "\U0001f600")] == [None] * 5
    flag = schema('<xs:simpleType name="f"><xs:restriction base="xs:boolean"><xs:pattern value="0|1"/></xs:restriction></xs:simpleType>')
    codec, w = values.Codecs(flag, False, ()).of("f"), Writer()
    codec.write(w, None, None, codec.parse("1"))
    assert w.done() == bytes([0b11000000]) and codec.read(Reader(bytes([0b01000000])), None, None) == "0"


def test_characters_of_a_restricted_set():
    data = encode(doc(el("root", el("thing", el("n", "1"), el("s", "AB-5"), el("s2"), id="1"), uri="urn:t")), schema=RICH)
    assert plain(decode(data, None, RICH))[8].value == "AB-5"
    w, text = Writer(), values.Text("ab")
    text.characters(w, "abé")
    data = w.done()  # two bits each for a, b and the escape, then the code point in two groups
    assert data == int("000110" + f"{0xE9 & 127 | 128:08b}" + f"{0xE9 >> 7:08b}" + "00", 2).to_bytes(3, "big")
    assert text.read_characters(Reader(data), 3) == "abé"


def test_damaged_streams():
    data = encode(rich(random.Random(1), False), schema=RICH)
    for i in range(1, len(data), 7):
        for cut in (data[:i], data[:i] + bytes([data[i] ^ 0x5A]) + data[i + 1 :]):
            try:
                list(decode(cut, None, RICH))
            except (ValueError, EOFError, KeyError, IndexError):
                pass
