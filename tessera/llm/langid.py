"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter maps an n-gram to ``HASHES`` rows of a table; each
row is a bitmask with a bit for each language, and the AND of the rows names
all languages that contain the n-gram. A document's n-grams are looked up, the
bits are counted for each language, and the counts are corrected for the
filters' false positives: a language whose filter is filled to a share f
answers f^HASHES of foreign n-grams with yes. The language with the largest
corrected share decides; ties go to the first in order.

N-grams are four bytes of lower-cased text in which every byte but letters is
a blank. They are counted for each language over all training documents; one
enters a language's filter if it was seen there at least ``MIN_COUNT`` times,
makes up at least ``MIN_SHARE`` of the language's n-grams, and has no less than
``MIN_RATE`` of its highest rate in any language. So a filter holds at most
1 / ``MIN_SHARE`` n-grams, whatever the corpus. The table gets as many rows as
the fullest filter needs for ``FALSE`` foreign n-grams answered with yes; that
bounds what is sent to executors by 2^24 x 8 bytes for each 64 languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a
text with letters but without a usable n-gram gets the most frequent language
with score 0; rows with null language teach nothing; without training rows
everything is ``und``. Repeated rows count as often as they occur. Other
columns of the input, and the language column in prediction, are not read;
columns that are asked for and have the name of one that is added are replaced
by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import _text
from tessera.llm._runtime import Scratch, pieces

#: Bytes of text that are looked up at once.
PIECE = 1_000_000
HASHES, FALSE = 2, 0.01
MIN_COUNT, MIN_SHARE, MIN_RATE = 3, 2e-6, 0.05
ADDED = ("lang_pred", "score")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_LETTER, _text.LOWER, 32).astype(np.uint8)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte windows with two letters or more, each document padded with blanks, and their documents."""
    lens = np.diff(offs)
    n = len(lens)
    buf = np.full(len(data) + 2 * n + 8, 32, np.uint8)
    own = np.repeat(np.arange(n), lens)
    buf[np.arange(len(data)) + 2 * own + 1] = _FOLD[data]
    size = len(data) + 2 * n
    view = np.ndarray((max(size - 3, 0),), "<u4", buf, 0, (1,))
    letter = (buf != 32).view(np.uint8)
    count = letter[:-3] + letter[1:-2] + letter[2:-1] + letter[3:]
    # a window lies in its document if its last byte does; padding is two bytes a document
    start = offs[:-1] + 2 * np.arange(n)
    doc = np.repeat(np.arange(n), np.maximum(lens + 2, 0))
    good = np.flatnonzero(count[: len(view)] >= 2)
    inside = good + 3 < (start + lens + 2)[doc[good]]
    good = good[inside]
    return view[good], doc[good]


def _places(keys: np.ndarray, rows: int) -> np.ndarray:
    h = _text.mix(keys.astype(np.uint64))
    return np.stack([(h >> np.uint64(24 * j)) & np.uint64(rows - 1) for j in range(HASHES)]).astype(np.int64)


def table_rows(n: int) -> int:
    """A power of two of rows, at which a filter of ``n`` n-grams is wrong for ``FALSE`` of all others at most."""
    fill = FALSE ** (1 / HASHES)
    return 1 << max(12, math.ceil(math.log2(max(n, 1) * HASHES / -math.log(1 - fill))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offs in pieces(batch, "text", PIECE):
            g, doc = grams(data, offs)
            lang = rows.column("lang").to_numpy(zero_copy_only=False).astype(np.int64)
            key, n = np.unique((lang[doc].astype(np.uint64) << np.uint64(32)) | g.astype(np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array((key >> np.uint64(32)).astype(np.int32)), pa.array(n)], ["g", "lang", "n"])


def _bits(rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column("g").to_numpy(), rows)
            lang = batch.column("lang").to_numpy().astype(np.uint64)
            mask = (np.uint64(1) << (lang & np.uint64(63))).view(np.int64)
            for row in at:
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array((lang >> np.uint64(6)).astype(np.int32)), pa.array(mask)], ["place", "word", "mask"])

    return scan


class Filters:
    """The bit-sliced table with its languages and their false-positive rates."""

    def __init__(self, langs: list[str], usual: str, table: np.ndarray):
        self.langs, self.usual, self.table = langs, usual, table
        fill = np.array([((table[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.wrong = fill**HASHES

    def shares(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected shares (documents x languages) and the n-grams of each document."""
        g, doc = grams(data, offs)
        n = np.bincount(doc, minlength=len(offs) - 1)
        kinds, back = np.unique(g, return_inverse=True)
        at = _places(kinds, self.table.shape[1])
        found = self.table[:, at[0]]
        for row in at[1:]:
            found = found & self.table[:, row]
        out = np.zeros((len(offs) - 1, len(self.langs)))
        full = np.flatnonzero(n)
        first = np.cumsum(n)[full] - n[full]
        for i in range(len(self.langs)):
            bit = ((found[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).astype(np.uint8)[back]
            if len(full):
                hits = np.add.reduceat(bit, first, dtype=np.int64)
                out[full, i] = (hits / n[full] - self.wrong[i]) / max(1e-9, 1 - self.wrong[i])
        return np.clip(out, 0, 1), n

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        shares, n = self.shares(data, offs)
        ascii_letter = np.append(0, np.cumsum(_LETTER[data] & (data < 128)))
        has = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
        for i in np.flatnonzero(~has & (offs[1:] > offs[:-1])):
            has[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
        best = shares.argmax(1)
        score = np.where(has & (n > 0), shares[np.arange(len(best)), best], 0.0)
        names = [self.langs[b] if s > 0 else self.usual for b, s in zip(best, score, strict=True)]
        return [x if h else "und" for x, h in zip(names, has, strict=True)], score


def learn(train: DataFrame, scratch: Scratch) -> Filters | None:
    """Filters from (text, lang); None if no row has both."""
    train = train.where("text is not null and lang is not null")
    sizes = train.groupBy("lang").count().orderBy("lang").limit(4097).collect()
    if not sizes:
        return None
    if len(sizes) > 4096:
        raise ValueError("more than 4096 languages")
    langs = [r["lang"] for r in sizes]
    ids = train.sparkSession.createDataFrame(list(enumerate(langs)), "id int, lang string")
    coded = train.join(F.broadcast(ids), "lang").select("text", F.col("id").alias("lang"))
    counts = scratch.save(coded.mapInArrow(_count, "g long, lang int, n long").groupBy("g", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("all"))
    most = rates.groupBy("g").agg(F.max("rate").alias("most"))
    seen = (F.col("n") >= MIN_COUNT) & (F.col("rate") >= MIN_SHARE)
    kept = scratch.save(rates.join(most, "g").where(seen & (F.col("rate") >= MIN_RATE * F.col("most"))).select("g", "lang"), "kept")
    size = table_rows(max((r["count"] for r in kept.groupBy("lang").count().collect()), default=0))
    bits = kept.mapInArrow(_bits(size), "place long, word int, mask long").groupBy("place", "word").agg(F.bit_or("mask").alias("mask"))
    found = bits.toArrow()
    table = np.zeros(((len(langs) + 63) // 64, size), np.uint64)
    table[found.column("word").to_numpy(), found.column("place").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return Filters(langs, max(sizes, key=lambda r: (r["count"], r["lang"]))["lang"], table)


def identify(docs: DataFrame, filters: Filters | None, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with (lang_pred, score), from ``text`` alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    columns = [c for c in columns if c.lower() not in ADDED]
    carried = docs.select(F.col("text").alias("text"), *([F.struct(*columns).alias("row")] if columns else []))
    fields = StructType([*carried.schema.fields[1:], *StructType.fromDDL("lang_pred string, score double").fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, data, offs in pieces(batch, "text", PIECE):
                names, score = model.predict(data, offs) if model else (["und"] * rows.num_rows, np.zeros(rows.num_rows))
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(names, pa.string()), pa.array(score)], fields.names)

    return carried.mapInArrow(scan, fields).select(*[F.col("row").getField(c).alias(c) for c in columns], *ADDED)


def held_out(id_col: str, parts: int):
    """Rows whose crc32 of the key as text leaves no remainder; a null key counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == 0, F.lit(True))
