"""Value codecs' arithmetic and lexical rules, all native expressions.

Arguments are SQL expressions; results are Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_width(n: str) -> Column:
    """Bits that tell n values apart."""
    return F.expr(f"case when {n} > 1 then length(bin(cast({n} as bigint) - 1)) else 0 end")


def varint_length(v: str) -> Column:
    """Bytes of an unsigned integer in groups of seven bits."""
    return F.expr(f"cast((length(bin(cast({v} as bigint))) + 6) div 7 as int)")


def sign_magnitude(v: str) -> Column:
    """(negative, magnitude): negatives are stored as -(v + 1)."""
    return F.expr(f"named_struct('negative', {v} < 0, 'magnitude', if({v} < 0, -({v} + 1), {v}))")


def decimal_parts(text: str) -> Column:
    """(negative, integral, fraction_reversed) of a decimal's text; the numbers are digits, of any length."""
    body = f"regexp_replace(trim({text}), '^[+-]', '')"
    whole = f"regexp_replace(regexp_extract({body}, '^([0-9]*)', 1), '^0+', '')"
    part = f"regexp_replace(reverse(regexp_extract({body}, '\\.([0-9]*)$', 1)), '^0+', '')"
    return F.expr(
        f"""named_struct('negative', trim({text}) like '-%',
          'integral', coalesce(nullif({whole}, ''), '0'), 'fraction_reversed', coalesce(nullif({part}, ''), '0'))"""
    )


def bounded_integer(v: str, low: int, high: int) -> Column:
    """(offset, bits) of an integer in a range of up to 4096 values; null outside of it."""
    if not 0 <= high - low < 4096:
        raise ValueError("the range has more than 4096 values")
    return F.expr(f"if({v} between {low} and {high}, named_struct('offset', cast({v} as bigint) - {low}L, 'bits', {(high - low).bit_length()}), null)")


def boolean_code(text: str, pattern: bool = False) -> Column:
    """One bit for a boolean's text; with ``pattern``, two that tell its four forms apart. Null for other texts."""
    code = f"array_position(array('false', '0', 'true', '1'), trim(both ' \t\n\r' from {text})) - 1"
    return F.expr(f"nullif({code}, -1)" if pattern else f"nullif({code}, -1) div 2")


def list_items(text: str) -> Column:
    """The items of a list's text."""
    return F.expr(f"filter(split({text}, '[ \\t\\n\\r]+'), x -> x <> '')")


def restricted_bits(text: str, charset: str) -> Column:
    """Bits of a text's characters under a restricted set: an escaped one adds its code point in groups of seven bits."""
    quoted = charset.replace("\\", "\\\\").replace("'", "\\'")
    width = len(charset).bit_length()
    one = f"if(c = '', 0L, {width}L + if(locate(c, '{quoted}') > 0, 0L, 8L * ((length(bin(cast(ascii(c) as bigint))) + 6) div 7)))"
    return F.expr(f"aggregate(transform(split({text}, ''), c -> {one}), 0L, (a, n) -> a + n)")


def normal_float(text: str) -> Column:
    """Mantissa, E and exponent of a float's text without trailing zeros, digits as they are; other texts stay."""
    t = f"trim(both ' \t\n\r' from {text})"
    form = "^([+-]?)([0-9]*)(?:[.]([0-9]*))?(?:[Ee]([+-]?[0-9]+))?$"
    g = [f"regexp_extract({t}, '{form}', {i})" for i in range(5)]
    digits = f"regexp_replace(concat({g[2]}, {g[3]}), '^0+', '')"
    cut = f"regexp_replace({digits}, '0+$', '')"
    exponent = f"coalesce(try_cast({g[4]} as int), 0) - length({g[3]}) + length({digits}) - length({cut})"
    return F.expr(f"case when {t} in ('INF', '-INF', 'NaN') then {t} when not ({t} rlike '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([Ee][+-]?[0-9]+)?$') then {text} when {cut} = '' then '0E0' else concat(if({g[1]} = '-', '-', ''), {cut}, 'E', {exponent}) end")


def float_parts(v: str) -> Column:
    """(mantissa, exponent) of a double with up to 15 significant digits; exponent -16384 marks INF, -INF and NaN."""
    text = f"format_string('%.14e', abs({v}))"
    digits = f"regexp_replace(concat(substring({text}, 1, 1), substring({text}, 3, 14)), '0+$', '')"
    exponent = f"cast(regexp_extract({text}, 'e([+-][0-9]+)$', 1) as int) - greatest(length({digits}) - 1, 0)"
    return F.expr(
        f"""case when isnan({v}) then named_struct('mantissa', 0L, 'exponent', -16384)
          when {v} = double('infinity') then named_struct('mantissa', 1L, 'exponent', -16384)
          when {v} = -double('infinity') then named_struct('mantissa', -1L, 'exponent', -16384)
          when {v} = 0 then named_struct('mantissa', 0L, 'exponent', 0)
          else named_struct('mantissa', cast(sign({v}) as bigint) * cast({digits} as bigint), 'exponent', {exponent}) end"""
    )


def normal_boolean(text: str) -> Column:
    return F.expr(f"case trim({text}) when '1' then 'true' when 'true' then 'true' when '0' then 'false' when 'false' then 'false' end")


def normal_integer(text: str) -> Column:
    """Without plus sign and leading zeros; other texts stay as they are."""
    t = f"trim({text})"
    digits = f"coalesce(nullif(regexp_replace({t}, '^[+-]?0*', ''), ''), '0')"
    return F.expr(f"case when not ({t} rlike '^[+-]?[0-9]+$') then {text} when {t} like '-%' and {digits} <> '0' then concat('-', {digits}) else {digits} end")


def normal_decimal(text: str) -> Column:
    """As integers, and without trailing zeros of the fraction; a point keeps one digit behind it."""
    t = f"trim({text})"
    whole = f"coalesce(nullif(regexp_replace(regexp_extract({t}, '^[+-]?([0-9]*)', 1), '^0+', ''), ''), '0')"
    frac = f"coalesce(nullif(regexp_replace(regexp_extract({t}, '\\\\.([0-9]*)$', 1), '0+$', ''), ''), '0')"
    value = f"if({t} like '%.%', concat({whole}, '.', {frac}), {whole})"
    return F.expr(f"case when not ({t} rlike '^[+-]?([0-9]+\\\\.?[0-9]*|\\\\.[0-9]+)$') then {text} when {t} like '-%' and {value} rlike '[1-9]' then concat('-', {value}) else {value} end")


def whitespace(text: str, facet: str) -> Column:
    """The whiteSpace facet: preserve, replace, collapse or trim."""
    c = F.expr(text)
    replaced = F.translate(c, "\t\n\r", "   ")
    return {"preserve": c, "replace": replaced, "collapse": F.trim(F.regexp_replace(replaced, " +", " ")), "trim": F.expr(f"trim(both ' \t\n\r' from {text})")}[facet]


def line_endings(text: str) -> Column:
    return F.regexp_replace(F.expr(text), "\r\n?", "\n")


def escape_text(text: str) -> Column:
    return F.expr(f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")


def escape_attribute(text: str) -> Column:
    return F.expr(f"""replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')""")


def character_reference(text: str) -> Column:
    """The character of ``#65`` or ``#x41``; null for others."""
    digits = f"if({text} like '#x%', conv(substring({text}, 3), 16, 10), substring({text}, 2))"
    return F.expr(f"case when {text} rlike '^#([0-9]{{1,7}}|x[0-9A-Fa-f]{{1,6}})$' then decode(unhex(lpad(hex(cast({digits} as bigint)), 8, '0')), 'UTF-32') end")


def literal_size(text: str, offset: int = 0) -> Column:
    """Bytes of a string literal: its length plus offset, then its code points."""
    sizes = f"aggregate(transform(split({text}, ''), c -> if(c = '', 0, (length(bin(cast(ascii(c) as bigint))) + 6) div 7)), 0L, (a, n) -> a + n)"
    return F.expr(f"(length(bin(cast(length({text}) + {offset} as bigint))) + 6) div 7 + {sizes}")


def is_base64(text: str) -> Column:
    return F.expr(f"coalesce(length({text}) > 0 and length({text}) % 4 = 0 and {text} rlike '^[A-Za-z0-9+/]*={{0,2}}$' and replace(replace(base64(try_to_binary({text}, 'base64')), '\\r', ''), '\\n', '') = {text}, false)")


def is_ncname(text: str) -> Column:
    return F.expr(f"{text} rlike '^[A-Za-z_][A-Za-z0-9_.-]*$'")


def charset_index(ch: str, charset: str) -> Column:
    """Place of a character in a restricted set, or the escape, the set's size."""
    quoted = charset.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"if(locate({ch}, '{quoted}') > 0, locate({ch}, '{quoted}') - 1, {len(charset)})")


#: Restricted character sets of the built-in types (fixed values).
CHARSETS = {
    "base64Binary": "\t\n\r +/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "hexBinary": "\t\n\r 0123456789ABCDEFabcdef",
    "boolean": "\t\n\r 01aefrstlu",
    "dateTime": "\t\n\r +-.0123456789:TZ",
    "decimal": "\t\n\r +-.0123456789",
    "double": "\t\n\r +-.0123456789EFINae",
    "integer": "\t\n\r +-0123456789",
}


def enumeration_index(v: str, values: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in values]), F.expr(v)) - 1


def datetime_wire(ts: str) -> Column:
    """(year, month_day, time, fraction_reversed) of a timestamp as the format stores them."""
    frac = f"regexp_replace(date_format({ts}, 'SSSSSS'), '0+$', '')"
    return F.expr(
        f"""named_struct('year', year({ts}) - 2000, 'month_day', month({ts}) * 32 + day({ts}),
          'time', (hour({ts}) * 64 + minute({ts})) * 64 + cast(date_format({ts}, 's') as int),
          'fraction_reversed', cast(coalesce(nullif(reverse({frac}), ''), '0') as bigint))"""
    )


#: Lexical forms of the eight date and time types, without the time zone.
LEXICAL = {
    "dateTime": r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(\.[0-9]+)?",
    "date": r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})",
    "time": r"^([0-9]{2}):([0-9]{2}):([0-9]{2})(\.[0-9]+)?",
    "gYear": r"^(-?[0-9]{4,})",
    "gYearMonth": r"^(-?[0-9]{4,})-([0-9]{2})",
    "gMonth": r"^--([0-9]{2})",
    "gMonthDay": r"^--([0-9]{2})-([0-9]{2})",
    "gDay": r"^---([0-9]{2})",
}


#: Parts of the date and time types, in the order of their groups.
PARTS = {
    "dateTime": ["year", "month", "day", "hour", "minute", "second", "fraction"], "date": ["year", "month", "day"], "time": ["hour", "minute", "second", "fraction"],
    "gYear": ["year"], "gYearMonth": ["year", "month"], "gMonth": ["month"], "gMonthDay": ["month", "day"], "gDay": ["day"],
}
_ZONED = r"(Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?$"


def datetime_parts(text: str, kind: str) -> Column:
    """(year, month, day, hour, minute, second, fraction, zone) of a text of a date or time type; null if it is none.

    ``fraction`` has the digits without trailing zeros, ``zone`` minutes; parts
    that the type or the text lacks are null.
    """
    col, pattern = F.trim(F.expr(text)), LEXICAL[kind] + _ZONED
    group = {p: F.regexp_extract(col, pattern, i + 1) for i, p in enumerate(PARTS[kind])}
    zone = F.regexp_extract(col, pattern, len(PARTS[kind]) + 1)
    offset = F.when(zone == "Z", 0).when(zone != "", F.when(zone.startswith("-"), -1).otherwise(1) * (zone.substr(2, 2).try_cast("int") * 60 + zone.substr(5, 2).try_cast("int")))
    none = F.lit(None)
    fields = [(group[p].try_cast("long") if p in group else none.cast("long")).alias(p) for p in ("year", "month", "day", "hour", "minute", "second")]
    digits = F.regexp_replace(group["fraction"], "^[.]|0+$", "") if "fraction" in group else none.cast("string")
    return F.when(is_datetime(text, kind), F.struct(*fields, F.when(digits != "", digits).alias("fraction"), offset.cast("long").alias("zone")))


def format_datetime(parts: str, kind: str) -> Column:
    """The text of a struct of parts: Z for no offset, four digits or more for a year."""
    own = PARTS[kind]
    date = {"year": f"concat(if({parts}.year < 0, '-', ''), lpad(cast(abs({parts}.year) as string), greatest(4, length(cast(abs({parts}.year) as string))), '0'))"}
    two = lambda p: f"lpad(cast({parts}.{p} as string), 2, '0')"
    days = [date["year"] if p == "year" else two(p) for p in own if p in ("year", "month", "day")]
    head = "" if "year" in own else "---" if own == ["day"] else "--"
    text = [f"'{head}'"] + [x for i, d in enumerate(days) for x in (["'-'"] if i else []) + [d]] if days else []
    if "hour" in own:
        text += (["'T'"] if days else []) + [two("hour"), "':'", two("minute"), "':'", two("second"), f"coalesce(concat('.', {parts}.fraction), '')"]
    z = f"{parts}.zone"
    text.append(f"case when {z} is null then '' when {z} = 0 then 'Z' else concat(if({z} < 0, '-', '+'), lpad(cast(abs({z}) div 60 as string), 2, '0'), ':', lpad(cast(abs({z}) % 60 as string), 2, '0')) end")
    return F.expr(f"concat({', '.join(text)})")


def is_datetime(text: str, kind: str) -> Column:
    """Whether a text has the lexical form and every part is in range."""
    pattern = LEXICAL[kind] + r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?$"
    col = F.trim(F.expr(text))
    ok = col.rlike(pattern)
    parts = {"dateTime": {"month": 2, "day": 3, "hour": 4, "minute": 5, "second": 6}, "date": {"month": 2, "day": 3}, "time": {"hour": 1, "minute": 2, "second": 3}, "gYearMonth": {"month": 2}, "gMonth": {"month": 1}, "gMonthDay": {"month": 1, "day": 2}, "gDay": {"day": 1}}.get(kind, {})
    limits = {"month": (1, 12), "day": (1, 31), "hour": (0, 24), "minute": (0, 59), "second": (0, 60)}
    for name, group in parts.items():
        n = F.regexp_extract(col, pattern, group).try_cast("int")
        ok = ok & n.between(*limits[name])
    if "hour" in parts:  # the end of a day is its only time past 23:59
        late = F.regexp_extract(col, pattern, parts["hour"]) == "24"
        ok = ok & (~late | col.rlike(r"24:00:00(\.0+)?(Z|[+-][0-9:]{5})?$"))
    return F.coalesce(ok, F.lit(False))


def escape_key(key: str) -> Column:
    """Element names for JSON keys; null for the empty key."""
    reserved = "'map','array','string','number','boolean','null','other','key'"
    chars = f"""array_join(transform(split({key}, ''), (c, i) -> if(c rlike '^[A-Za-z]$' or (i > 0 and c rlike '^[0-9.-]$'), c, concat('_', ascii(c), '.'))), '')"""
    return F.expr(f"case when {key} = '' then null when {key} in ({reserved}) then concat('_.', {key}) else {chars} end")


def other_kind(text: str) -> Column:
    """The typed form that a JSON string can take: dateTime, date, time, base64Binary or string."""
    out = F.when(is_base64(text), "base64Binary").otherwise("string")
    for kind in ("time", "date", "dateTime"):
        out = F.when(is_datetime(text, kind), kind).otherwise(out)
    return out
