"""``python -m tessera encode|decode|json-encode|json-decode|trace SOURCE [TARGET]``, one file at a time without Spark.

``-`` is standard input or output. Without TARGET, a file beside the source
gets the suffix of its format. Options go into the header.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from tessera.plans import stream
from tessera.plans.codec import decode, encode
from tessera.plans.options import ALIGNMENTS, FILE_EXTENSION, Options, Preserve
from tessera.plans.schema import compile_schema
from tessera.sources import json, xml

SUFFIXES = {"encode": FILE_EXTENSION, "decode": ".xml", "json-encode": FILE_EXTENSION, "json-decode": ".json", "trace": ".txt"}


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("task", choices=list(SUFFIXES))
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    p.add_argument("--schema", help="XSD file; streams are coded by its grammars")
    p.add_argument("--alignment", choices=ALIGNMENTS, default="bit-packed")
    for flag in ("compression", "strict", "fragment", "cookie", "pretty", "verbose", "typed"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--preserve", default="", help="comments,pis,dtd,prefixes,lexical_values,whitespace")
    p.add_argument("--block-size", type=int, default=1_000_000)
    return p


def _schema(path: str | None):
    if path is None:
        return None
    folder, name = os.path.split(path)

    def read(location: str) -> str:
        with open(os.path.join(folder, location), encoding="utf-8") as f:
            return f.read()

    return compile_schema(name, read)


def target_of(task: str, source: str, target: str | None) -> str:
    """The given target, or the source's name with the suffix of the task's format."""
    if target or source == "-":
        return target or "-"
    stem, suffix = os.path.splitext(source)
    return stem + SUFFIXES[task] if suffix != SUFFIXES[task] else source + SUFFIXES[task]


def main(given: list[str] | None = None) -> int:
    a = _arguments().parse_args(given)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.WARNING)
    try:
        keep = Preserve(**{n: True for n in a.preserve.split(",") if n})
        o = Options(a.alignment, a.compression, a.strict, a.fragment, keep, schema_id=os.path.basename(a.schema) if a.schema else None, block_size=a.block_size).check()
        schema, target = _schema(a.schema), target_of(a.task, a.source, a.target)
        if a.task == "encode" and a.source != "-" and target != "-":
            stream.encode_file(a.source, target, o, a.cookie, schema)
            return 0
        if a.source == "-":
            data = sys.stdin.buffer.read()
        else:
            with open(a.source, "rb") as f:
                data = f.read()
        out = _work(a, data, o, schema)
        if target == "-":
            sys.stdout.buffer.write(out)
            sys.stdout.buffer.flush()
        else:
            stream._replaced(target, lambda f: f.write(out))
    except (ValueError, EOFError, OSError, TypeError) as e:
        print(f"tessera: {e}", file=sys.stderr)
        return 1
    return 0


def _work(a: argparse.Namespace, data: bytes, o: Options, schema) -> bytes:
    if a.task == "encode":
        return encode(xml.parse(data, o.preserve), o, a.cookie, schema=schema)
    if a.task == "decode":
        return xml.serialize(list(decode(data, o, schema)), 2 * a.pretty).encode()
    if a.task == "json-encode":
        return encode(json.to_events(data.decode(), a.typed), json.OPTIONS, a.cookie, schema=json.json_schema())
    if a.task == "json-decode":
        return json.from_events(list(decode(data, None, json.json_schema()))).encode()
    from tessera.tools.inspect import trace

    return "".join(f"{at}\t{bits}\t{' '.join(str(x) for x in e if x is not None)}\n" for at, bits, e in trace(data, o, schema)).encode()


if __name__ == "__main__":
    sys.exit(main())
