import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.plans.bits import Reader, Writer, width
from tessera.plans.codec import Event, channel_groups, decode, encode
from tessera.plans.options import ALIGNMENTS, Options, Preserve, read_header, write_header


def document(rng, roots=1):
    out = [Event("SD")]

    def element(depth):
        out.append(Event("SE", rng.choice(["", "urn:a", "urn:b"]), rng.choice("abcdef")))
        for a in sorted(rng.sample("xyzw", rng.randint(0, 3))):
            out.append(Event("AT", "", a, value=rng.choice(["1", "", "é😀", str(rng.random())])))
        for _ in range(rng.randint(0, 4) if depth < 5 else 0):
            if rng.random() < 0.4:
                out.append(Event("CH", value=rng.choice(["t", "t2", str(rng.random())])))
            else:
                element(depth + 1)
        out.append(Event("EE"))

    for _ in range(roots):
        element(0)
    return [*out, Event("ED")]


@pytest.mark.parametrize("layout", [*ALIGNMENTS, "compression"])
@pytest.mark.parametrize("in_header", [True, False])
def test_round_trip(layout, in_header):
    rng = random.Random(5)
    for i in range(60):
        o = Options(
            alignment="bit-packed" if layout == "compression" else layout, compression=layout == "compression", fragment=i % 3 == 0,
            block_size=rng.choice([1, 7, 150, 1_000_000]), value_max_length=rng.choice([None, 3]), value_capacity=rng.choice([None, 0, 2]),
        )
        events = document(rng, rng.randint(1, 60) if o.fragment else 1)
        data = encode(events, o, cookie=in_header, in_header=in_header)
        back = list(decode(data, None if in_header else o))
        assert back == events
        assert encode(back, o, cookie=in_header, in_header=in_header) == data


def test_smallest_document_by_hand():
    # 10 0 0 0000 | uri 01 | length+1 00000010 | 'a' 01100001 | EE 00
    assert encode([Event("SD"), Event("SE", "", "a"), Event("EE"), Event("ED")]).hex() == "80409840"


@pytest.mark.parametrize("layout", ALIGNMENTS)
def test_preserved_kinds(layout):
    o = Options(alignment=layout, preserve=Preserve(comments=True, pis=True, dtd=True, prefixes=True))
    events = [
        Event("SD"), Event("DT", local="r", system_id="s.dtd"), Event("CM", value="c"), Event("SE", "urn:a", "r", "p"), Event("NS", "urn:a", prefix="p", local_ns=True),
        Event("AT", "", "q", "", "v"), Event("CM", value="x"), Event("PI", local="t", value="d"), Event("ER", local="e"), Event("CH", value="z"),
        Event("SE", "urn:a", "r", "p"), Event("EE"), Event("EE"), Event("PI", local="e", value=""), Event("ED"),
    ]
    assert list(decode(encode(events, o))) == events
    plain = [e for e in events if e.kind not in ("DT", "CM", "NS", "PI", "ER")]
    assert [e.kind for e in decode(encode(events, replace(o, preserve=Preserve())))] == [e.kind for e in plain]


@given(st.builds(Options, alignment=st.just("byte-alignment"), fragment=st.booleans(), schema_id=st.sampled_from([None, False, "", "x"]), value_max_length=st.none() | st.integers(0, 999), value_capacity=st.none() | st.integers(0, 999),
                 preserve=st.builds(Preserve, st.booleans(), st.booleans(), st.booleans(), st.booleans(), st.booleans())))
@settings(max_examples=80, deadline=None)
def test_header_round_trip(o):
    found, _, head = read_header(write_header(o, cookie=True).done())
    assert found == o and head["cookie"] and head["options_present"]


def test_datatype_map_in_header():
    xsd, exi = "http://www.w3.org/2001/XMLSchema", "http://www.w3.org/2009/exi"
    o = Options(datatype_map=(((xsd, "decimal"), (exi, "string")), (("urn:a", "t"), (exi, "string"))))
    assert read_header(write_header(o).done())[0] == o


@pytest.mark.parametrize(
    "bad",
    [Options(compression=True, alignment="byte-alignment"), Options(strict=True, preserve=Preserve(comments=True)), Options(self_contained=True, compression=True), Options(block_size=0), Options(alignment="x"), Options(value_capacity=-1)],
)
def test_forbidden_options(bad):
    with pytest.raises(ValueError):
        bad.check()


def test_broken_streams_and_documents():
    data = encode(document(random.Random(1)))
    with pytest.raises((ValueError, EOFError, IndexError, KeyError)):
        list(decode(data[: len(data) // 2]))
    with pytest.raises(ValueError):
        list(decode(b"\x00\x00"))
    for events in ([Event("SD"), Event("SE", "", "a"), Event("ED")], [Event("SD"), Event("SE", "", "a"), Event("EE")]):
        with pytest.raises(ValueError):
            encode(events)


@given(st.lists(st.tuples(st.integers(0, 2**70), st.integers(-(2**65), 2**65), st.text(max_size=20))), st.booleans())
@settings(max_examples=60, deadline=None)
def test_primitives(values, aligned):
    w = Writer(aligned)
    for u, i, s in values:
        w.unsigned(u), w.integer(i), w.string(s), w.number(u % 1000, 10)
    r = Reader(w.done(), aligned)
    for u, i, s in values:
        assert (r.unsigned(), r.integer(), r.string(), r.number(10)) == (u, i, s, u % 1000)


def test_widths_and_channel_order():
    assert [width(n) for n in range(10)] == [0, 0, 1, 2, 2, 3, 3, 3, 3, 4]
    assert channel_groups({"a": 3, "b": 5}) == [["a", "b"]]
    assert channel_groups({"a": 200, "b": 5, "c": 101, "d": 1}) == [["b", "d"], ["a"], ["c"]]
