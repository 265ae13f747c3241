"""WARC archives with a two-level capture index.

Writing: each page becomes one WARC/1.1 record, compressed by itself, so that
a record can be read by its range; each file begins with a warcinfo record. Of
records with equal payloads (SHA-1 and size) the one with the smallest page_id
is a response and the others are revisits without a payload, which name its
record. Payloads that occur more than once are found by digest alone and sent
to the tasks, if they are at most ``BROADCAST_DIGESTS``; so html is not
shuffled. Beyond that bound only those of many pages are sent, and the others
join by a shuffle.

Index: entries are sorted by URL key (host reversed, so that a site's pages
are neighbours), cut into blocks of ``BLOCK`` lines, and each block is
compressed. A sparse directory has the first and last key and the range of
each block; blocks get longer with the archive, so that it never has more than
``MOST_BLOCKS`` rows and one for each file. A search bisects the directory,
reads the ranges of the blocks found, bisects their lines, and reads the
records' ranges. ``find`` does so for a table of URLs: keys are bisected first,
then each block is read once by the task that it falls to, so the captures of
one URL, which may fill many blocks, are spread over tasks.

Files go to the shared folder under names of their own for each attempt, and
only those that a finished task reports are in the tables, so tasks can be
repeated.

Defined cases: null html is an empty payload; a null url has the key of an
empty one; rows with the same page_id and payload are all responses if theirs
is the smallest; a row without page_id never is a revisit's target (it is
written as a response if no row of its group has one); other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._runtime import Scratch, shuffle_width

BLOCK, FILE_BYTES, MOST_BLOCKS, BROADCAST_DIGESTS = 1000, 1 << 30, 200_000, 200_000
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Reversed host, port, then path and query, without scheme, user and fragment."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?:]*", 0))
    tail = F.regexp_extract(rest, "^[^/?:]*(.*)$", 1)
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), tail), "[\\x00-\\x20]", "%20")


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        root = root.replace("file:/", "file:///") if root.startswith("file:/") and not root.startswith("file://") else root
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    return "".join(c for c in (url or "") if c >= " ")


def record_id(page_id, sha: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{sha}:{url}')}>"


def info(name: str) -> bytes:
    """The record that a file begins with."""
    body = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, '', name)}\r\nWARC-Date: {_DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 5, mtime=0)


def record(page_id, url: str | None, payload: bytes, sha: str, refers_to=None, refers_url: str | None = None) -> bytes:
    """One compressed WARC record; with ``refers_to`` a revisit of that page's record."""
    clean = _clean(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha, clean)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        target = _clean(refers_url)
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha, target)}", f"WARC-Refers-To-Target-URI: {target}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 5, mtime=0)


def parse(data: bytes) -> dict:
    """The fields of one compressed record; a response's size and digest are taken from its payload."""
    raw = gzip.decompress(data)
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response":
        size = len(payload)
        if digest(payload) != sha:
            raise ValueError(f"payload of {fields.get('WARC-Record-ID')} does not match its digest")
    number = {k: int(fields[h]) if h in fields else None for k, h in (("page_id", "X-Page-ID"), ("refers_to", "X-Refers-To-Page-ID"))}
    return number | {"url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": sha, "record_type": kind, "payload": payload}


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Writes the records below ``root``; returns the entries (key, page_id, file, start, length), to be saved once."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "utf-8")))).withColumn("size", F.octet_length("html").cast("long"))
    keys = rows.where(F.col("size") >= int(min_bytes)).groupBy("sha", "size")
    first = keys.agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = Scratch(pages.sparkSession, "warc-payloads").save(first, "repeated")
    n_first = first.count()
    target = first.select("sha", "size", "first")
    if n_first <= BROADCAST_DIGESTS:
        known = rows.join(F.broadcast(target), ["sha", "size"], "left")
    else:
        often = F.broadcast(target.join(first.orderBy(F.desc("n")).limit(BROADCAST_DIGESTS).select("sha", "size"), ["sha", "size"], "left_semi"))
        few = target.join(often.select("sha", "size"), ["sha", "size"], "left_anti")
        known = rows.join(often, ["sha", "size"]).unionByName(rows.join(often.select("sha", "size"), ["sha", "size"], "left_anti").join(few, ["sha", "size"], "left"))
    known = known.withColumn("refers", F.expr("if(page_id <=> first.page_id, null, first.page_id)"))
    ready = known.select(url_key(F.col("url")).alias("key"), "page_id", "url", "html", "refers", F.col("first.url").alias("refers_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        out, name, at = None, "", 0
        for batch in batches:
            made = []
            for key, page_id, url, html, refers, refers_url in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(f"{base}/archive", recursive=True)
                    out = fs.open_output_stream(f"{base}/archive/{name}", compression=None)
                    begin = info(name)
                    out.write(begin)
                    at = len(begin)
                payload = html.encode()
                data = record(page_id, url, payload, digest(payload), refers, refers_url)
                out.write(data)
                made.append((key, page_id, name, at, len(data)))
                at += len(data)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)
        if out is not None:
            out.close()

    return ready.mapInArrow(write, "key string, page_id long, file string, start long, length long")


_ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
_DIRECTORY = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("first_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("n", pa.int64())])


def write_index(entries: DataFrame, root: str, block: int = BLOCK) -> DataFrame:
    """Writes the sorted, compressed blocks; returns their directory, to be saved once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        name, at, out = f"{uuid.uuid4().hex}.cdx.gz", 0, None
        held: list[tuple[str, str, int | None]] = []

        def flush():
            nonlocal at, out
            if out is None:
                fs.create_dir(f"{base}/index", recursive=True)
                out = fs.open_output_stream(f"{base}/index/{name}", compression=None)
            data = gzip.compress("".join(line for _, line, _ in held).encode(), 5, mtime=0)
            out.write(data)
            row = [held[0][0], held[-1][0], -(1 << 63) if held[0][2] is None else held[0][2], name, at, len(data), len(held)]
            at += len(data)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _DIRECTORY.types, strict=True)], schema=_DIRECTORY)

        for batch in batches:
            for key, page_id, file, start, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held.append((key, f"{key} {json.dumps([page_id, file, start, length])}\n", page_id))
                if len(held) >= block:
                    yield flush()
        if held:
            yield flush()
        if out is not None:
            out.close()

    width = shuffle_width(entries.sparkSession)
    dealt = entries.repartitionByRange(width, "key", "page_id").sortWithinPartitions("key", "page_id")
    return dealt.mapInArrow(write, "first_key string, last_key string, first_id long, file string, start long, length long, n long")


def _range(fs: pafs.FileSystem, path: str, start: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, start)


def _lines(fs: pafs.FileSystem, base: str, file: str, start: int, length: int) -> list[tuple[str, list]]:
    text = gzip.decompress(_range(fs, f"{base}/index/{file}", start, length)).decode()
    return [(k, json.loads(v)) for k, _, v in (x.partition(" ") for x in io.StringIO(text).read().split("\n") if x)]


class Archive:
    """Archives, index blocks and the directory below one folder."""

    def __init__(self, spark: SparkSession, root: str, directory: DataFrame):
        self.spark, self.root, self.directory = spark, root, directory
        self._sorted: list[tuple] | None = None

    def blocks(self) -> list[tuple]:
        """The directory in order: (first key, last key, first page_id, file, start, length). Its size has a bound."""
        if self._sorted is None:
            table = self.directory.select("first_key", "last_key", "first_id", "file", "start", "length").toArrow()
            self._sorted = sorted(zip(*(c.to_pylist() for c in table.columns), strict=True))
        return self._sorted

    def lookup(self, url: str) -> Iterator[dict]:
        """The captures of one URL, one after the other in order of page_id, by directory, block and bisection."""
        key = self.spark.range(1).select(url_key(F.lit(url)).alias("k")).first()["k"]
        fs, base = _open(self.root)
        blocks = self.blocks()
        for b in _holding(blocks, [b[1] for b in blocks], key):
            for file, start, length in _matches(_lines(fs, base, *blocks[b][3:]), key):
                yield parse(_range(fs, f"{base}/archive/{file}", start, length))

    def find(self, urls: DataFrame, payloads: bool = False) -> DataFrame:
        """The captures of all URLs in the column ``url``, each once, as ``read`` gives them."""
        root, sent = self.root, self.spark.sparkContext.broadcast(self.blocks())
        keys = urls.select(url_key(F.col("url").cast("string")).alias("key")).distinct()

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = sent.value
            last = [b[1] for b in blocks]
            for batch in batches:
                found = [(b, key) for key in batch.column(0).to_pylist() for b in _holding(blocks, last, key)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())], ["block", "key"])

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, (fs, base) = sent.value, _open(root)
            now, lines, wanted = None, [], []
            for batch in batches:
                for b, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if b != now:
                        yield from _records(fs, base, wanted, payloads)
                        now, lines, wanted = b, _lines(fs, base, *blocks[b][3:]), []
                    wanted += _matches(lines, key)
            yield from _records(fs, base, wanted, payloads)

        dealt = keys.mapInArrow(search, "block int, key string").repartition(shuffle_width(self.spark), "block").sortWithinPartitions("block", "key")
        return dealt.mapInArrow(fetch, _schema(payloads))

    def read(self, payloads: bool = False) -> DataFrame:
        """All records through the index: blocks are dealt to tasks, which read each file's ranges in order."""
        root = self.root

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = _open(root)
            for batch in batches:
                for file, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                    yield from _records(fs, base, [x[1][1:] for x in _lines(fs, base, file, start, length)], payloads)

        return self.directory.repartition(shuffle_width(self.spark)).mapInArrow(scan, _schema(payloads))


def _schema(payloads: bool) -> str:
    return "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads


def _holding(blocks: list[tuple], last: list[str], key: str) -> Iterator[int]:
    """The places in the directory of the blocks that may hold a key: from the first that ends at it or later."""
    i = bisect_left(last, key)
    while i < len(blocks) and blocks[i][0] <= key:
        yield i
        i += 1


def _matches(lines: list[tuple[str, list]], key: str) -> Iterator[tuple[str, int, int]]:
    """(file, start, length) of a block's lines with a key, by bisection."""
    i = bisect_left(lines, key, key=lambda x: x[0])
    while i < len(lines) and lines[i][0] == key:
        yield tuple(lines[i][1][1:])
        i += 1


def _records(fs: pafs.FileSystem, base: str, entries: list, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The records at (file, start, length), file by file and in their order there."""
    rows, size, opened, now = [], 0, None, None
    for name, at, n in sorted(entries):
        if name != now:
            if opened is not None:
                opened.close()
            opened, now = fs.open_input_file(f"{base}/archive/{name}"), name
        r = parse(opened.read_at(n, at))
        rows.append(r)
        size += len(r["payload"])
        if size > 8_000_000:
            yield _batch(rows, payloads)
            rows, size = [], 0
    if opened is not None:
        opened.close()
    if rows:
        yield _batch(rows, payloads)


def _batch(rows: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def archive(pages: DataFrame, min_bytes: int = 0, block: int = BLOCK) -> Archive:
    """Writes archives, index and directory of ``pages`` to the shared folder."""
    scratch = Scratch(pages.sparkSession, "warc")
    entries = scratch.save(write_archives(pages, scratch.root, min_bytes), "entries")
    lines = max(block, -(-entries.count() // MOST_BLOCKS))
    directory = scratch.save(write_index(entries, scratch.root, lines), "directory")
    return Archive(pages.sparkSession, scratch.root, directory)
