"""Packing into length buckets with the least padding.

The global histogram of token counts is aggregated over all documents, and
dynamic programming over it chooses the bucket boundaries for which padding
every document up to its bucket's boundary adds the fewest tokens. Inside a
bucket, batches are filled to a token budget: each holds
floor(budget / boundary) documents, at least one.

Every length is a bin of its own. Distinct lengths add up to no more than the
corpus, so there are at most sqrt(2 T) of them among T tokens, and the
programme takes time in proportion to them. Places in a
bucket come from running totals over hash buckets (``_rank``), so a bucket of
any size is split over tasks. Documents of a mix keep its order instead: places
come from running totals over stretches of ``STRETCH`` slots.

Texts are tokenised once: the rows are written with their counts, and the
histogram, boundaries and places are made from that table. Who needs no texts
in the result packs the table of ``counted`` instead.

Defined cases: null and empty texts have one token, the end; repeated rows are
packed each; an empty table gives an empty result; the last batch of a bucket
may be short; a document longer than the budget is a batch of its own; columns
of the input that have the name of one that is added are replaced by it.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._rank import running
from tessera.llm._runtime import Scratch
from tessera.llm._words import word_array

#: Slots of a mix that one window orders; bytes of a token, about.
STRETCH, TOKEN_BYTES = 64, 8
ADDED = ("n_tokens", "bucket", "padded_to", "batch", "batch_row")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """At most ``buckets`` upper bounds, ascending, and the total padding; the optimum over all choices.

    ``lengths`` ascend. best[j] is the least cost of the first j lengths with
    the layers so far; a bucket over (i, j] pads its rows to lengths[j-1]. So
    each i is a line in lengths[j-1], of slope -rows[i]; slopes fall and
    lengths rise, and the least line is at the front of a queue of the lower hull.
    """
    x, c = np.array(lengths, np.int64), np.array(counts, np.int64)
    n = len(x)
    if not n:
        return [], 0
    rows, toks, x = np.append(0, np.cumsum(c)).tolist(), np.append(0, np.cumsum(c * x)).tolist(), x.tolist()
    best: list[float] = [0, *[math.inf] * n]
    layers = []
    for _ in range(min(buckets, n)):
        now, back = list(best), np.full(n + 1, -1, np.int32)
        hull: deque[tuple[int, int, int]] = deque()
        for j in range(1, n + 1):
            if best[j - 1] < math.inf:
                r, b = rows[j - 1], best[j - 1] + toks[j - 1]
                while len(hull) > 1 and (b - hull[-2][1]) * (hull[-1][0] - hull[-2][0]) <= (hull[-1][1] - hull[-2][1]) * (r - hull[-2][0]):
                    hull.pop()
                hull.append((r, b, j - 1))
            at = x[j - 1]
            while len(hull) > 1 and hull[1][1] - hull[1][0] * at < hull[0][1] - hull[0][0] * at:
                hull.popleft()
            cost = hull[0][1] - hull[0][0] * at + at * rows[j] - toks[j]
            if cost < now[j]:
                now[j], back[j] = cost, hull[0][2]
        layers.append(back)
        best = now
    out, j = [], n
    for back in reversed(layers):
        if j and back[j] >= 0:
            out.append(int(x[j - 1]))
            j = int(back[j])
    return out[::-1], int(best[n])


def counted(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens) of each row: the words of its whole text, and one end."""
    return docs.select(id_col, _tokens().alias("n_tokens"))


def _tokens() -> Column:
    return (F.coalesce(F.size(word_array("text")), F.lit(0)) + 1).cast("long")


def pack(docs: DataFrame, budget: int = 65_536, buckets: int = 16, tokens: Column | None = None, id_col: str = "doc_id", mixed: bool = False) -> DataFrame:
    """``docs`` with (n_tokens, bucket, padded_to, batch, batch_row).

    ``tokens`` counts a row's tokens; by default its words and one end. If
    ``mixed``, the batches of a bucket take its documents by (mix_slot, mix_pos).
    """
    scratch = Scratch(docs.sparkSession, "packing")
    n = _tokens() if tokens is None else tokens.cast("long")
    mix = [F.col(c).alias(f"_{c}") for c in ("mix_slot", "mix_pos")] if mixed else []
    rows = scratch.save(docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), *mix, n.alias("_n")), "counted")
    scratch.release()
    found = rows.groupBy("_n").agg(F.count("*").alias("c")).orderBy("_n").toArrow()
    lengths, counts = (found.column(c).to_pylist() for c in ("_n", "c"))
    bounds, _ = boundaries(lengths, counts, buckets)
    placed, pad = F.lit(0), F.lit(1)
    for i in range(len(bounds) - 1, -1, -1):
        placed = F.when(F.col("_n") <= bounds[i], F.lit(i)).otherwise(placed)
        pad = F.when(F.col("_n") <= bounds[i], F.lit(bounds[i])).otherwise(pad)
    sized = rows.withColumn("_bucket", placed.cast("int")).withColumn("_pad", pad.cast("long"))
    order, piece = (["_mix_slot", "_mix_pos", "_id"], F.expr(f"_mix_slot div {STRETCH}")) if mixed else (["_id", "_n"], None)
    heavy = sum(m * c for m, c in zip(lengths, counts, strict=True)) * TOKEN_BYTES
    ranked = running(sized, "_bucket", F.lit(1).cast("long"), order, sum(counts), "_rank", piece, heavy)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("_pad")))).cast("long")
    out = ranked.withColumn("_room", room).withColumn("_batch", F.expr("_rank div _room")).withColumn("_batch_row", F.expr("_rank % _room"))
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ADDED]
    return out.select(*kept, *[F.col(c).alias(a) for c, a in zip(("_n", "_bucket", "_pad", "_batch", "_batch_row"), ADDED, strict=True)])
