import io
import json as js
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera.functions import scalars as S
from tessera.operators import events, typed, whitespace
from tessera.plans import stream
from tessera.plans.codec import Event, decode, encode
from tessera.plans.guard import MemoryGuard, StallGuard
from tessera.plans.options import Options, Preserve
from tessera.plans.schema import compile_schema
from tessera.sources import binary, json, xml
from tessera.tools import inspect

XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="k" type="xs:int" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""


@pytest.mark.parametrize("schema", [None, compile_schema("m", {"m": XSD})])
@pytest.mark.parametrize("alignment", ["bit-packed", "byte-alignment"])
def test_streaming_gives_the_same_bytes_in_little_memory(alignment, schema):
    o = Options(alignment=alignment)
    text = "<r>" + "".join(f"<k>{i}</k>" for i in range(3000)) + "</r>"
    sink, sizes = io.BytesIO(), []
    write = sink.write
    sink.write = lambda b: sizes.append(len(b)) or write(b)
    stream.encode_text((text[i : i + 100] for i in range(0, len(text), 100)), sink, o, schema=schema, flush=256)
    assert sink.getvalue() == encode(xml.parse(text, o.preserve), o, schema=schema)
    assert len(sizes) > 10 and max(sizes) < 400


def test_streaming_limits():
    for o in (Options(compression=True), Options(alignment="pre-compression")):
        with pytest.raises(ValueError, match="stream"):
            stream.encode_text(["<r/>"], io.BytesIO(), o)
        one = stream.StreamEncoder(o)
        for e in xml.parse("<r>t</r>", Preserve()):
            one.event(e)
        assert one.finish() == encode(xml.parse("<r>t</r>", Preserve()), o)
    half = stream.StreamEncoder()
    half.event(Event("SD"))
    half.event(Event("SE", "", "a"))
    with pytest.raises(ValueError, match="complete"):
        half.finish()


def test_guards(caplog):
    used = iter([40, 60, 80, 96])
    guard = MemoryGuard(every=2, limit=100, used=lambda: next(used))
    guard.added(2)
    guard.added(3)
    guard.added(1)
    assert [r.levelname for r in caplog.records] == ["WARNING"] * 2
    with pytest.raises(MemoryError):
        guard.added(2)
    assert MemoryGuard().check() is None
    stall = StallGuard(3)
    for _ in range(4):
        stall.step(1, 2)
    with pytest.raises(ValueError, match="without an end"):
        stall.step(1, 2)


def test_stream_without_its_end():
    o = Options(alignment="byte-alignment", preserve=Preserve(comments=True))
    data = encode(xml.parse("<r>t</r>", Preserve()), o)
    cut = data[:-1]
    with pytest.raises(EOFError):
        list(decode(cut))
    assert [e.kind for e in decode(cut, lenient=True)] == ["SD", "SE", "CH", "EE", "ED"]
    with pytest.raises(EOFError):
        list(decode(data[:-2], lenient=True))


def test_files_and_command_line(tmp_path, monkeypatch, capsys):
    (tmp_path / "a.xml").write_text("<r><k>7</k><k>8</k></r>")
    (tmp_path / "s.xsd").write_text(XSD)
    for extra in ([], ["--schema", str(tmp_path / "s.xsd"), "--strict"], ["--compression", "--cookie"]):
        assert cli.main(["encode", str(tmp_path / "a.xml"), *extra]) == 0
        assert cli.main(["decode", str(tmp_path / "a.exi"), str(tmp_path / "b.xml"), *extra]) == 0
        assert (tmp_path / "b.xml").read_text() == "<r><k>7</k><k>8</k></r>"
    assert cli.main(["decode", str(tmp_path / "a.exi"), str(tmp_path / "c.xml"), "--pretty"]) == 0
    assert (tmp_path / "c.xml").read_text() == "<r>\n  <k>7</k>\n  <k>8</k>\n</r>"
    (tmp_path / "j.json").write_text('{"a":[1,"2020-01-01"]}')
    assert cli.main(["json-encode", str(tmp_path / "j.json"), "--typed"]) == 0
    assert cli.main(["json-decode", str(tmp_path / "j.exi"), str(tmp_path / "k.json")]) == 0
    assert js.loads((tmp_path / "k.json").read_text()) == {"a": [1, "2020-01-01"]}
    assert cli.main(["encode", str(tmp_path / "a.xml"), str(tmp_path / "t.exi")]) == 0 and cli.main(["trace", str(tmp_path / "t.exi"), str(tmp_path / "t.txt")]) == 0
    assert (tmp_path / "t.txt").read_text().startswith("8\t")
    assert cli.target_of("encode", "x/a.xml", None) == "x/a.exi" and cli.target_of("decode", "a.xml", None) == "a.xml.xml" and cli.target_of("decode", "-", None) == "-"
    (tmp_path / "bad.xml").write_text("<r>")
    assert cli.main(["encode", str(tmp_path / "bad.xml")]) == 1 and "tessera:" in capsys.readouterr().err
    assert not (tmp_path / "bad.exi").exists() and not list(tmp_path.glob("*.tmp"))
    run = [sys.executable, "-m", "tessera"]
    root = str(Path(cli.__file__).parent.parent)
    data = subprocess.run([*run, "encode", "-"], input=b"<r>x</r>", capture_output=True, cwd=root, check=True).stdout
    assert data == encode(xml.parse("<r>x</r>", Preserve()))
    assert subprocess.run([*run, "decode", "-"], input=data, capture_output=True, cwd=root, check=True).stdout == b"<r>x</r>"
    stream.decode_file(str(tmp_path / "t.exi"), str(tmp_path / "u.xml"))
    assert (tmp_path / "u.xml").read_text() == "<r><k>7</k><k>8</k></r>"


def test_external_entities_below_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part.txt").write_text("inside<b/>")
    (tmp_path / "out.txt").write_text("outside")
    (tmp_path / "docs").mkdir()
    text = '<!DOCTYPE r [<!ENTITY x SYSTEM "{}">]><r>&x;</r>'
    got = xml.parse(text.format("part.txt"), Preserve(), xml.below(str(tmp_path / "in")))
    assert [(e.kind, e.local, e.value) for e in got[2:5]] == [("CH", None, "inside"), ("SE", "b", None), ("EE", None, None)]
    for bad in ("../out.txt", f"file://{tmp_path}/out.txt", "none.txt"):
        with pytest.raises(ValueError, match="entity"):
            xml.parse(text.format(bad), Preserve(), xml.below(str(tmp_path / "in")))
    (tmp_path / "docs" / "d.xml").write_text(text.format("part.txt"))
    found = xml.read_files(spark, str(tmp_path / "docs"), external_root=str(tmp_path / "in"))
    assert found.where("kind = 'CH'").first().value == "inside"


def test_document_types_are_written_again():
    subset = '<!ENTITY e "v"><!ENTITY f PUBLIC "p" "s"><!NOTATION n SYSTEM "s"><!ENTITY g SYSTEM "s" NDATA n><!ELEMENT r (a|(b,c?)+)*><!ELEMENT a (#PCDATA|b)*><!ELEMENT b EMPTY><!ELEMENT c ANY><!ATTLIST r k CDATA #REQUIRED><!ATTLIST r l (x|y) "x"><!ATTLIST r m CDATA #FIXED "1">'
    text = f'<!DOCTYPE r PUBLIC "p" "s" [{subset}]><r k="1" l="y" m="1"/>'
    once = xml.parse(text)
    assert once[1].value == subset and xml.parse(xml.serialize(once)) == once


def test_writer(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"<r><k>{i}</k></r>") for i in range(20)], "doc_id long, t string").repartition(3)
    spark.dataSource.register(binary.ExiSource)
    dealt = xml.read_xml(docs, "t", Preserve()).repartition(3, "doc_id").sortWithinPartitions("doc_id", "seq")
    dealt.write.format("exi").option("alignment", "byte-alignment").mode("append").save(str(tmp_path / "x"))
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == sorted(f"{i}.exi" for i in range(20))
    back = spark.read.format("exi").load(str(tmp_path / "x"))
    assert sorted(int(r.value) for r in back.where("kind = 'CH'").collect()) == list(range(20))
    dealt.where("doc_id < 3").write.format("exi").mode("overwrite").save(str(tmp_path / "x"))
    assert len(list((tmp_path / "x").iterdir())) == 3


def test_headers_apart():
    o = Options(alignment="pre-compression", block_size=3)
    assert binary.options_of(binary.options_bytes(o)) == o
    data = encode(xml.parse("<r>t</r>", Preserve()), o, in_header=False)
    body = data[1:]
    assert list(decode(binary.with_header(body, o))) == xml.parse("<r>t</r>", Preserve())
    assert binary.is_compressed(encode(xml.parse("<r/>", Preserve()), Options(compression=True))) and not binary.is_compressed(data)
    with pytest.raises(ValueError):
        binary.with_header(body, Options())


@pytest.mark.parametrize("text", ["1e400", '{"a":1,"a":2}', "NaN", "[-Infinity]", "{", '{"":1}'])
def test_json_that_has_no_events(text):
    with pytest.raises(ValueError):
        json.to_events(text)


@pytest.mark.parametrize("value", [{"d": "2020-02-29", "t": "12:00:00Z", "w": "2020-02-29T24:00:00", "b": "YWJj", "s": "YWJ", "n": 12345678901234567890123, "f": -0.125, "g": 1e30, "z": [0, -1, "", "24:30:00"]}, "2020-01-01", 7, None, [[], {}]])
@pytest.mark.parametrize("other", [False, True])
def test_json_typed(value, other):
    found = json.to_events(js.dumps(value), other)
    schema = json.json_schema()
    back = json.from_events(list(decode(encode(found, json.OPTIONS, schema=schema), None, schema)))
    assert js.loads(back) == value if other else js.loads(back) == js.loads(js.dumps(value), parse_int=lambda s: int(s) if len(s) < 18 else float(s))
    if other and isinstance(value, dict):
        assert {e.local for e in found if e.kind == "SE"} >= {"date", "time", "dateTime", "base64Binary", "integer", "decimal", "number"}


def test_blanks_and_double_children(spark):
    docs = spark.createDataFrame([(1, "<r> <a>\n</a> <b> </b>x <a/></r>")], "doc_id long, t string")
    e = events.structure(xml.read_xml(docs, "t", Preserve(whitespace=True)))
    own = F.try_element_at("path", F.lit(-1))

    def left(**options):
        return [r.value for r in whitespace.skip_blanks(e, own == "b", **options).where("kind = 'CH'").orderBy("seq").collect()]

    assert left() == ["\n", " ", "x "] and left(strict=True) == [" ", "x "] and left(preserve=True) == [" ", "\n", " ", " ", "x "]
    assert left(nil=own == "b", strict=True) == ["x "]
    assert [(r.local_name, r.seq) for r in whitespace.seen_twice(e).collect()] == [("a", e.where("local_name = 'a'").agg(F.max("seq")).first()[0])]
    assert whitespace.skip_blanks(e.limit(0), own == "b").count() == 0


def test_texts_of_values(spark):
    row = spark.range(1).select(
        S.decimal_parts("'-00123456789012345678901234567890.00000000000000000000123400'").alias("a"), S.normal_float("'-0012.500e-3'").alias("b"), S.normal_float("'1e'").alias("c"), S.normal_float("'000'").alias("d"),
        S.is_datetime("'24:30:00'", "time").alias("e"), S.is_datetime("'24:00:00.000Z'", "time").alias("f"), S.datetime_parts("'x'", "date").alias("g"), S.datetime_parts("'--02-30+14:00'", "gMonthDay").alias("h"),
        S.bounded_integer("99", 0, 24).alias("i"), S.boolean_code("'x'").alias("j"),
    ).first()
    assert tuple(row.a) == (True, "123456789012345678901234567890", "4321" + "0" * 20)
    assert (row.b, row.c, row.d, row.e, row.f, row.g, row.i, row.j) == ("-125E-4", "1e", "0E0", False, True, None, None, None)
    assert (row.h.month, row.h.day, row.h.zone, row.h.year) == (2, 30, 840, None)
    texts = {"dateTime": "-0044-03-15T23:59:60.5-00:30", "date": "12345-01-01", "time": "24:00:00Z", "gYear": "0000", "gYearMonth": "2020-12", "gMonth": "--05", "gMonthDay": "--05-06", "gDay": "---09+01:00"}
    for kind, text in texts.items():
        assert spark.range(1).select(S.datetime_parts(f"'{text}'", kind).alias("p")).select(S.format_datetime("p", kind)).first()[0] == text


def test_typed_events_outside_of_elements(spark):
    table = spark.createDataFrame([(1, 0, "NS", "urn:a", None, "p", None, None, None, None), (1, 1, "SE", "", "r", None, None, None, None, None), (1, 2, "CH", None, None, None, "24:30:00", None, None, None)], xml.EVENTS)
    schema = compile_schema("m", {"m": '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r" type="xs:time"/></xs:schema>'})
    assert [r[0] for r in typed.type_values(table, schema).select(typed.is_valid()).collect()] == [False]


def test_traces_and_tallies(spark):
    docs = spark.createDataFrame([(1, "<r><k>7</k></r>"), (2, "<broken"), (3, None)], "doc_id long, t string")
    schema = compile_schema("m", {"m": XSD})
    found = {(r.layout, r.result): r.n for r in inspect.tally(inspect.cross_check(docs, "t", schema)).collect()}
    assert found == {(x, y): 1 for x in ("bit-packed", "byte-alignment", "pre-compression", "compression") for y in ("OK", "ERROR")}
    data = encode(xml.parse("<r><k>7</k></r>", Preserve()), schema=schema)
    steps = list(inspect.trace(data, schema=schema))
    assert [e.kind for _, _, e in steps] == ["SE", "SE", "CH", "EE", "EE", "ED"] and steps[0][0] == 8
    assert inspect.infoset_differences(xml.read_xml(docs.limit(1), "t"), xml.read_xml(docs.limit(1), "t")).count() == 0
