import json as js

import pytest
from pyspark.sql import functions as F

from tessera.operators import events
from tessera.plans.codec import encode
from tessera.plans.options import Options, Preserve
from tessera.sources import binary, json, xml
from tessera.streaming import documents


def kinds(text, **keep):
    return [e.kind for e in xml.parse(text, Preserve(**keep))]


def test_parse_order_and_blanks():
    e = xml.parse('<r xmlns:p="urn:p" b="1" a="2" p:a="3"> <k> </k> <e/>x</r>')
    assert [(x.local, x.uri) for x in e if x.kind == "AT"] == [("a", ""), ("a", "urn:p"), ("b", "")]
    assert [x.value for x in e if x.kind == "CH"] == [" ", "x"]
    assert kinds("<r>a<![CDATA[b]]>&lt;</r>") == ["SD", "SE", "CH", "EE", "ED"]
    assert kinds("<r><!--c--><?p d?></r>") == ["SD", "SE", "EE", "ED"]
    assert kinds("<r><!--c--><?p d?></r>", comments=True, pis=True) == ["SD", "SE", "CM", "PI", "EE", "ED"]


@pytest.mark.parametrize("bad", ["<a>", "<a></b>", "", "<p:a/>", "<a b='1' b='2'/>"])
def test_not_well_formed(bad):
    with pytest.raises(ValueError):
        xml.parse(bad)


def test_external_entities_are_not_read(tmp_path):
    (tmp_path / "s").write_text("secret")
    text = f'<!DOCTYPE r [<!ENTITY x SYSTEM "file://{tmp_path}/s">]><r>&x;</r>'
    try:
        assert "secret" not in str(xml.parse(text))
    except ValueError:
        pass


@pytest.mark.parametrize(
    "text",
    ["<r/>", '<r a="&lt;&quot;&amp;">x&amp;&lt;&gt;</r>', '<p:r xmlns:p="urn:x"><p:k p:z="1"/><q xmlns="urn:q"><s/></q></p:r>', "<r><!--c--><?t d?>t<k>u</k></r>"],
)
def test_serialize_round_trip(text):
    e = xml.parse(text)
    assert xml.serialize(e) == text
    assert xml.parse(xml.serialize(e)) == e


def test_serialize_finds_names():
    e = xml.parse('<p:r xmlns:p="urn:x" p:a="1"><b xmlns="urn:y"/></p:r>', Preserve())
    back = xml.parse(xml.serialize(e), Preserve())
    assert back == e
    assert xml.serialize(xml.parse("<r><a><b/></a><c>t</c></r>"), 2) == "<r>\n  <a>\n    <b/>\n  </a>\n  <c>t</c>\n</r>"


@pytest.mark.parametrize("value", [{}, [], {"a": 1, "map": None, "k 1": [1.5, True, "", {"_": "é"}]}, "s", 0, -12, 1e30, False, None])
def test_json_round_trip(value):
    text = js.dumps(value)
    assert js.loads(json.from_events(json.to_events(text))) == value


def test_json_keys():
    for k in ("a", "a b", "map", "_", "é", "1a", "a-b.c", "😀"):
        assert json.unescape_key(json.escape_key(k)) == k
    with pytest.raises(ValueError):
        json.escape_key("")
    with pytest.raises(ValueError):
        json.unescape_key("a_x.")


def test_event_table(spark):
    docs = spark.createDataFrame([(1, '<r a="1"><k>t</k><e/></r>'), (2, None), (3, "<r>")], "doc_id long, t string")
    with pytest.raises(Exception, match="no element|unclosed|element"):
        xml.read_xml(docs, "t").collect()
    e = xml.read_xml(docs, "t", failed="skip")
    assert {r.doc_id for r in e.select("doc_id").collect()} == {1}
    found = {r.seq: (r.depth, r.parent_seq, r.path) for r in events.structure(e).collect()}
    assert found[1][:2] == (1, None) and found[3] == (2, 1, ["r"]) and found[4] == (2, 3, ["r", "k"])
    assert events.serialize(e).first().xml == '<r a="1"><k>t</k><e/></r>'
    assert xml.write_xml(e).first().xml == '<r a="1"><k>t</k><e/></r>'
    back = binary.decode_streams(binary.encode_events(e, Options(compression=True, preserve=Preserve(prefixes=True))))
    assert events.differences(e, back).count() == 0
    assert events.complete(back).first().ok


def test_data_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.exi").write_bytes(encode(xml.parse(f"<r><k>{i}</k></r>", Preserve()), cookie=True))
    spark.dataSource.register(binary.ExiSource)
    found = spark.read.format("exi").load(str(tmp_path)).where("kind = 'CH'")
    assert sorted((r.doc_id, r.value) for r in found.collect()) == [(0, "0"), (1, "1"), (2, "2")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("<r>hello</r>")
    (tmp_path / "in" / "b.xml").write_text("<broken")
    files = documents.read_files(spark, str(tmp_path / "in"))
    q = documents.parse_stream(files).where("kind = 'CH'").writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.value for r in spark.sql("select value from texts").collect()] == ["hello"]


def test_scalars(spark):
    from tessera.functions import scalars as S

    row = spark.range(1).select(
        S.normal_decimal("'-00.500'").alias("a"), S.normal_integer("'-000'").alias("b"), S.normal_boolean("' 1 '").alias("c"), S.float_parts("1.5e300").alias("d"),
        S.is_datetime("'2024-13-01'", "date").alias("e"), S.is_datetime("'-0044-03-15T24:00:00Z'", "dateTime").alias("f"), S.character_reference("'#x1F600'").alias("g"),
        S.is_base64("'AAA'").alias("h"), S.charset_index("'5'", S.CHARSETS["integer"]).alias("i"), F.expr("1").alias("j"), S.float_parts("double('nan')").alias("k"),
    ).first()
    assert tuple(row)[:3] == ("-0.5", "0", "true") and tuple(row.d) == (15, 299)
    assert (row.e, row.f, row.g, row.h, row.i, row.k.exponent) == (False, True, "😀", False, 11, -16384)


def test_structure_of_a_long_document(spark):
    n = 30_000
    made = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.explode(F.expr(f"""concat(
      if(id = 0, array(struct(0L as seq, 'SE' as kind, 'r' as local_name)), array()),
      array(struct(2 * id + 1 as seq, 'SE' as kind, 'k' as local_name), struct(2 * id + 2 as seq, 'EE' as kind, cast(null as string) as local_name)),
      if(id = {n - 1}, array(struct(2 * id + 3 as seq, 'EE' as kind, cast(null as string) as local_name)), array()))""")).alias("e")).select("doc_id", "e.*", F.lit("x").alias("extra"))  # fmt: skip
    found = events.structure(made)
    assert {(r.depth, r.parent_seq, tuple(r.path), r.extra, r["count"]) for r in found.groupBy("depth", "parent_seq", "path", "extra").count().collect()} == {(1, None, (), "x", 2), (2, 0, ("r",), "x", 2 * n)}
    again = events.structure(found)
    assert again.columns == found.columns and events.structure(made.limit(0)).count() == 0
