import pytest

from tessera.operators import typed
from tessera.plans.schema import ANY, compile_schema, tables
from tessera.sources import xml

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'


def schema(body, attrs="", **more):
    return compile_schema("m", {"m": f"<xs:schema {XS} {attrs}>{body}</xs:schema>", **more})


TYPES = """
<xs:complexType name="base"><xs:sequence><xs:element name="id" type="xs:int"/></xs:sequence><xs:attribute name="k" type="xs:boolean"/></xs:complexType>
<xs:complexType name="more"><xs:complexContent><xs:extension base="base"><xs:choice maxOccurs="unbounded"><xs:element ref="head" minOccurs="0"/><xs:element ref="r"/></xs:choice>
  <xs:attribute name="tags" type="list"/></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="less"><xs:complexContent><xs:restriction base="base"><xs:attribute name="k" use="prohibited"/></xs:restriction></xs:complexContent></xs:complexType>
<xs:complexType name="money"><xs:simpleContent><xs:extension base="xs:decimal"><xs:attribute name="unit" type="unit"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:simpleType name="unit"><xs:restriction base="xs:token"><xs:enumeration value="EUR"/><xs:enumeration value="USD"/></xs:restriction></xs:simpleType>
<xs:simpleType name="list"><xs:list itemType="xs:int"/></xs:simpleType>
<xs:element name="head" type="xs:date"/><xs:element name="stand" substitutionGroup="head"/>
<xs:element name="r"><xs:complexType><xs:sequence><xs:element ref="r" minOccurs="0"/><xs:element name="x" type="base"/><xs:element name="m" type="money"/></xs:sequence></xs:complexType></xs:element>
"""


def test_derivation_and_substitution():
    s = schema(TYPES)
    assert s.children("more") == {"id": "xs:int", "head": "xs:date", "stand": "xs:date", "r": "r/type"}
    assert set(s.attribute_types("more")) == {"k", "tags"} and not s.attribute_types("less") and not s.children("less")
    assert s.elements["stand"].type == "xs:date"
    assert s.simple("money") == "xs:decimal" and s.simple("more") is None and s.simple(ANY) is None
    assert s.builtin("unit") == "xs:token" and s.chain("xs:byte")[-1] == "xs:decimal"
    choice = next(p for p in s.types["more"].particles if p.kind == "choice")
    assert (choice.least, choice.most) == (1, None)


def test_namespaces_includes_and_cycles():
    a = f'<xs:schema {XS} targetNamespace="u:a" xmlns:b="u:b" elementFormDefault="qualified"><xs:include schemaLocation="sub/c"/><xs:import namespace="u:b" schemaLocation="b"/><xs:element name="e"><xs:complexType><xs:sequence><xs:element name="f" type="b:t"/></xs:sequence></xs:complexType></xs:element></xs:schema>'
    b = f'<xs:schema {XS} targetNamespace="u:b"><xs:import namespace="u:a" schemaLocation="a"/><xs:simpleType name="t"><xs:restriction base="xs:int"/></xs:simpleType></xs:schema>'
    c = f'<xs:schema {XS}><xs:element name="g" type="xs:date"/></xs:schema>'
    s = compile_schema("a", {"a": a, "b": b, "sub/c": c})
    assert s.children("{u:a}e/type") == {"{u:a}f": "{u:b}t"} and s.elements["{u:a}g"].type == "xs:date"
    with pytest.raises(KeyError):
        compile_schema("a", {"a": a, "sub/c": c})


@pytest.mark.parametrize(
    "bad",
    [
        '<xs:element name="a" type="none"/>',
        '<xs:redefine schemaLocation="x"/>',
        '<xs:simpleType name="a"><xs:restriction base="b"/></xs:simpleType><xs:simpleType name="b"><xs:restriction base="a"/></xs:simpleType>',
        '<xs:group name="g"><xs:sequence><xs:group ref="g"/></xs:sequence></xs:group><xs:complexType name="t"><xs:group ref="g"/></xs:complexType>',
        '<xs:complexType name="t"><xs:sequence><xs:element name="a" minOccurs="2"/></xs:sequence></xs:complexType>',
        '<xs:element name="a" substitutionGroup="b"/><xs:element name="b" substitutionGroup="a"/>',
    ],
)
def test_errors(bad):
    with pytest.raises(ValueError):
        schema(bad)


def test_values_get_their_types(spark):
    docs = [
        (1, '<r><x k="1"><id> +007 </id></x><m unit="USD">1.50</m></r>'),
        (2, '<r xmlns:i="http://www.w3.org/2001/XMLSchema-instance"><x a="q" tags="1 2" i:type="more"><id>x</id><stand>2024-13-01</stand></x><m unit="GBP">.</m></r>'),
        (3, "<none z='1'>t<head>2024-02-01</head></none>"),
    ]
    found = typed.type_values(xml.read_xml(spark.createDataFrame(docs, "doc_id long, xml string"), "xml"), schema(TYPES))
    rows = found.select("doc_id", "seq", "owner", "local_name", "type", typed.canonical_value().alias("c"), typed.is_valid().alias("ok"), "enum_index").orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.local_name or r.owner, r.type, r.c, r.ok) for r in rows] == [
        (1, "k", "xs:boolean", "true", True), (1, "id", "xs:int", "7", True), (1, "unit", "unit", "USD", True), (1, "m", "xs:decimal", "1.5", True),
        (2, "a", "xs:anySimpleType", "q", True), (2, "tags", "list", "1 2", None), (2, "id", "xs:int", "x", False), (2, "stand", "xs:date", "2024-13-01", False),
        (2, "unit", "unit", "GBP", False), (2, "m", "xs:decimal", ".", False),
        (3, "z", "xs:anySimpleType", "1", True), (3, "none", "xs:string", "t", True), (3, "head", "xs:date", "2024-02-01", True),
    ]
    assert [r.enum_index for r in rows if r.local_name == "unit"] == [1, -1]


@pytest.mark.parametrize(
    ("builtin", "good", "bad"),
    [
        ("byte", ["-128", "+127"], ["128", "1.0", ""]),
        ("unsignedLong", ["18446744073709551615"], ["18446744073709551616", "-1", "9" * 60]),
        ("negativeInteger", ["-1", "-" + "9" * 60], ["0", "-0"]),
        ("integer", ["9" * 60, "-0"], ["x"]),
        ("double", ["INF", "-1.5E3", "NaN"], ["+INF", "1e"]),
        ("hexBinary", ["", "aF"], ["a"]),
        ("base64Binary", ["", "YQ==", "YW Jj"], ["YQ="]),
        ("gMonthDay", ["--02-29"], ["--13-01"]),
    ],
)
def test_lexical_checks(spark, builtin, good, bad):
    df = spark.createDataFrame([(f"xs:{builtin}", v, None, False, v in good) for v in good + bad], "builtin string, value string, enum_index int, is_list boolean, want boolean")
    assert [r.value for r in df.where(typed.is_valid() != df.want).collect()] == []


def test_tables(spark):
    t = tables(spark, schema(TYPES))
    assert {r.owner for r in t["particles"].collect()} == {"base", "more", "r/type"}
    assert t["types"].count() == 7 and t["elements"].where("head = 'head'").count() == 1 and t["attributes"].count() == 4
    assert tables(spark, schema(""))["types"].count() == 0
