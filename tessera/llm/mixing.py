"""Mixing sources to target weights by Pfair scheduling.

Time runs in slots, one block of ``block`` characters each; a frame has
``frame`` slots. A source of weight w brings w * frame * block characters to
each frame, whatever the weight is: frames are cut at running totals of
characters, so nothing is rounded to whole shares, and after each frame every
source has had its weight's share exactly. Inside a frame the share is cut
into m = ceil(2 * w * frame) equal quanta, of half a block at most. Quantum k
is released at (k - 1) * frame / m and due at k * frame / m; of the released
quanta the one with the earliest deadline runs next. The weights add up to
one, so there is always a released quantum, and a quantum ends after its
deadline by no more than the half block that was running when it came. So a
source is ahead by less than half a block at any time, and behind by less than
half a block plus w / 2: always less than one block off.

A source of less than half a block a frame is never off by as much, wherever
its share runs; all of these follow each other in one pool, which is scheduled
like a source. So the schedule is made over at most 2 * frame sources and the
pool, however many there are. It is the same for each frame: computed once, by
SQL functions over one row, and applied to any number of frames by arithmetic.

A source that runs dry leaves: its later quanta stay idle, and the others go
on, in the same proportions to each other, until every document has run.

Main path: DataFrame and SQL functions only. Positions inside a source, and
places of tiny sources in the pool, are running totals over hash buckets
(``_rank``), so a source of any size is split. Sources are joined by a plain
join, which Spark broadcasts only if the table of sources is small.

Defined cases: null sources are one source; empty or null texts weigh one
unit; ties and repeated rows keep one row each (equal rows share a position's
neighbourhood, none is lost); a document is placed whole where it begins, also
if it is longer than a block; an empty table gives an empty result; columns of
the input that have the name of one that is added are replaced by it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._rank import running
from tessera.llm._runtime import Scratch

#: Slots of a frame; characters of a block.
FRAME, BLOCK = 1024, 8192
ADDED = ("mix_block", "mix_slot", "mix_pos", "mix_in")


def _key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def weights_of(sizes: DataFrame, alpha: float, target: Mapping[str | None, float] | None) -> DataFrame:
    """(g, w) from (g, n): the exact weights, which add up to one.

    With ``target``, the given weights (sources that it does not name get
    none, and their documents are left out); else the number of documents to
    the power ``alpha``.
    """
    if target is not None:
        given = json.dumps([{"g": "n" if s is None else f"s{s}", "raw": float(w)} for s, w in target.items() if w > 0])
        named = sizes.sparkSession.range(1).select(F.inline(F.from_json(F.lit(given), "array<struct<g: string, raw: double>>")))
        raw = sizes.select("g").join(named, "g")
    else:
        raw = sizes.select("g", F.pow(F.col("n").cast("double"), F.lit(alpha)).alias("raw"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("all")))).select("g", (F.col("raw") / F.col("all")).alias("w"))


def quanta(weight: str, frame: int) -> Column:
    return F.ceil(2 * frame * F.col(weight)).cast("int")


def schedule(big: DataFrame, frame: int = FRAME) -> DataFrame:
    """(g, k, slot) of one frame from (g, w): earliest deadline first over the released quanta.

    The weights add up to one. ``big`` is gathered into one row: it has at
    most 2 * frame sources, each of half a block a frame or more, and the pool.
    ``slot`` is the place in the frame; k counts from 0.
    """
    one = big.withColumn("m", quanta("w", frame)).agg(F.sort_array(F.collect_list(F.struct("g", "w", "m"))).alias("s"), F.sum("m").cast("int").alias("p")).where("p > 0")
    # a quantum lasts w / m of the frame; ties in the deadline go to the heavier source; the least release stands
    # in where rounding leaves none released
    runs = one.selectExpr(
        "s",
        """aggregate(
             sequence(1, p),
             named_struct('t', 0D, 'done', transform(s, x -> 0), 'out', cast(array() as array<int>)),
             (a, j) -> transform(array(
                 array_min(zip_with(s, transform(a.done, (d, i) -> named_struct('d', d, 'i', i)), (x, c) -> named_struct(
                   'no', if(c.d >= x.m, 2, if(c.d / x.m <= a.t + 1e-12D, 0, 1)),
                   'due', if(c.d / x.m <= a.t + 1e-12D, (c.d + 1) / x.m, c.d / x.m), 'light', -x.w, 'i', c.i)))),
               pick -> named_struct(
                 't', a.t + s[pick.i].w / s[pick.i].m,
                 'done', transform(a.done, (n, i) -> if(i = pick.i, n + 1, n)),
                 'out', concat(a.out, array(pick.i))))[0],
             a -> a.out) as runs""",
    )
    slots = runs.select("s", F.posexplode("runs").alias("slot", "i")).selectExpr("s[i].g as g", "slot")
    return slots.selectExpr("g", "cast(row_number() over (partition by g order by slot) - 1 as int) as k", "slot")


def plan(weights: DataFrame, scratch: Scratch, frame: int = FRAME) -> tuple[DataFrame, DataFrame]:
    """Sources (g, w, lane, ahead, lane_w, m) and the schedule (lane, k, slot).

    A lane is a source of its own or the pool; ``ahead`` is what comes before
    the source in its lane's share of a frame, as a part of the whole frame.
    """
    marked = scratch.save(weights.withColumn("tiny", F.col("w") * (2 * frame) < 1), "weights")
    tiny = marked.where("tiny")
    n_tiny = tiny.count()
    big = marked.where("not tiny").select("g", "w")
    pool = tiny.agg(F.sum("w").alias("w")).where("w > 0").selectExpr("'p' as g", "w")
    sources = big.selectExpr("g", "w", "g as lane", "0D as ahead", "w as lane_w")
    if n_tiny:
        placed = running(tiny.withColumn("lane", F.lit("p")), "lane", F.col("w"), ["g"], n_tiny, "ahead")
        sources = sources.unionByName(placed.crossJoin(F.broadcast(pool.select(F.col("w").alias("lane_w")))).select("g", "w", "lane", "ahead", "lane_w"))
    sources = scratch.save(sources.withColumn("m", quanta("lane_w", frame)), "sources")
    slots = scratch.save(schedule(big.unionByName(pool), frame).withColumnRenamed("g", "lane"), "schedule")
    return sources, slots


def _place(rows: DataFrame, at: str, frame: int, block: int) -> DataFrame:
    """Adds _frame, k and mix_pos for characters ``at`` of a source with the columns of ``plan``."""
    rows = rows.withColumn("_frame", F.floor(F.col(at) / (F.col("w") * frame * block)))
    rows = rows.withColumn("_off", F.col("ahead") * frame * block + F.greatest(F.lit(0.0), F.col(at) - F.col("_frame") * (F.col("w") * frame * block)))
    rows = rows.withColumn("k", F.least(F.col("m") - 1, F.floor(F.col("_off") / (F.col("lane_w") * frame * block / F.col("m")))).cast("int"))
    return rows.withColumn("mix_pos", F.floor(F.greatest(F.lit(0.0), F.col("_off") - F.col("k") * (F.col("lane_w") * frame * block / F.col("m")))).cast("long"))


def units() -> Column:
    """What a text weighs: its characters and one."""
    return (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long")


def _timed(docs: DataFrame, alpha: float, target: Mapping[str | None, float] | None, frame: int, block: int, id_col: str, size: Column | None = None) -> DataFrame:
    """The rows as a struct ``_row``, beside the added columns."""
    scratch = Scratch(docs.sparkSession, "mixing")
    scratch.release()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), _key().alias("_g"), (units() if size is None else size).cast("long").alias("_size"))
    sizes = scratch.save(rows.groupBy("_g").agg(F.count("*").alias("n"), F.sum("_size").alias("all")).withColumnRenamed("_g", "g"), "sizes")
    sources, slots = plan(weights_of(sizes, alpha, target), scratch, frame)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("all"), F.lit(0)).alias("all")).first()
    per_frame = slots.count()
    own = sources.withColumnRenamed("g", "_g")

    def timed(df: DataFrame, at: str) -> DataFrame:
        sized = _place(df.join(own, "_g"), at, frame, block).join(F.broadcast(slots), ["lane", "k"])
        return sized.withColumn("mix_block", F.col("_frame") * F.col("m") + F.col("k")).withColumn("mix_slot", F.col("_frame") * per_frame + F.col("slot"))

    placed = running(rows, "_g", F.col("_size"), ["_id", "_size"], total["n"], "_at", n_bytes=total["all"])
    horizon = timed(sizes.select(F.col("g").alias("_g"), F.col("all").alias("_end")), "_end").agg(F.min("mix_slot").alias("_dry"))
    out = timed(placed, "_at").crossJoin(F.broadcast(horizon)).withColumn("mix_in", F.col("mix_slot") < F.col("_dry"))
    return out.select("_row", *[F.col(c) if c == "mix_in" else F.col(c).cast("long").alias(c) for c in ADDED])


def interleave(docs: DataFrame, alpha: float = 0.7, target: Mapping[str | None, float] | None = None, frame: int = FRAME, block: int = BLOCK, id_col: str = "doc_id", added: tuple[str, ...] = ADDED, size: Column | None = None) -> DataFrame:
    """``docs`` with (mix_block, mix_slot, mix_pos, mix_in), or those of them that are ``added``.

    ``size`` weighs the rows of a table without texts.

    Order the mix by (mix_slot, mix_pos): a slot holds one quantum of one
    source or of the pool, and mix_block counts the quanta of a source's lane.
    ``mix_in`` is true up to the slot in which the first source would run dry;
    up to there the mix has its weights, and from there on the others have
    theirs among themselves. Every row of a source with a weight has a slot.
    """
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return _timed(docs, alpha, target, frame, block, id_col, size).select(*kept, *added)


def mix(docs: DataFrame, alpha: float = 0.7, target: Mapping[str | None, float] | None = None, frame: int = FRAME, block: int = BLOCK, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in the order of the mix, partition by partition: all of them, but for sources that ``target`` leaves out."""
    order = _timed(docs, alpha, target, frame, block, id_col).repartitionByRange("mix_slot", "mix_pos").sortWithinPartitions("mix_slot", "mix_pos")
    return order.select("_row.*")
