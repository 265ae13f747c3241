"""Groups around hubs, cut into bounded block pairs.

Candidates come as lists: items that share a filter key. Each list names its
smallest item as its hub, so every pair of a list meets in the group of that
hub, and an item belongs to few hubs however many keys it has. Large groups
are cut into blocks, and a task compares one pair of blocks: no group is ever
gathered in one task, and no pair is ever written as a row. Joins on a key or
a hub go by ``join_counted``, so lists and groups of any size stay spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._runtime import join_counted, shuffle_width


def hub_members(lists: DataFrame, keys: list[str], item: str, n_lists: int) -> DataFrame:
    """Distinct (hub, item) of lists of two items or more; ``n_lists`` is the number of rows. The hub is a member."""
    hubs = lists.groupBy(*keys).agg(F.min(item).alias("hub"), F.max(item).alias("_top"), F.count("*").alias("_c"))
    hubs = hubs.where("hub <> _top").drop("_top")
    return join_counted(lists, hubs, keys, "_c", n_lists).select("hub", item).distinct()


def _cuts(members: DataFrame, weight: str, most_weight: int, most_items: int, out: str) -> DataFrame:
    """(hub, out, _c): how many blocks the group needs, and its rows."""
    size = members.groupBy("hub").agg(F.sum(weight).alias("_w"), F.count("*").alias("_c"))
    return size.select("hub", F.ceil(F.greatest(F.col("_w") / most_weight, F.col("_c") / most_items)).cast("int").alias(out), "_c")


def _own(item: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(item), F.col(blocks).cast("long")).cast("int")


def block_pairs(members: DataFrame, item: str, weight: str, most_weight: int, most_items: int, n_members: int) -> DataFrame:
    """Adds (bi, bj, own): the block pair that a row goes to, and the row's own block.

    A group with one block is sent once; one with b blocks b times.
    """
    size = _cuts(members, weight, most_weight, most_items, "_b")
    out = join_counted(members, size, ["hub"], "_c", n_members).withColumn("own", _own(item, "_b"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return out.withColumn("bi", F.least("own", "_o")).withColumn("bj", F.greatest("own", "_o")).drop("_b", "_o", "_c")


def with_hub(members: DataFrame, item: str, weight: str, most_weight: int, most_items: int, n_members: int) -> DataFrame:
    """Adds (bi, bj, side): the group in blocks (side 1), and its hub beside each of them (side 0)."""
    size = _cuts(members, weight, most_weight, most_items, "_b")
    out = join_counted(members, size, ["hub"], "_c", n_members).where(f"{item} <> hub")
    out = out.withColumn("bj", _own(item, "_b")).withColumn("side", F.lit(1)).drop("_b", "_c")
    first = members.where(f"{item} = hub").join(size.drop("_c"), "hub").withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).withColumn("side", F.lit(0)).drop("_b")
    return out.unionByName(first).withColumn("bi", F.lit(0))


def rest_pairs(members: DataFrame, rest: str, item: str, weight: str, most_weight: int, most_items: int, n_members: int) -> DataFrame:
    """Adds (bi, bj, side): blocks of the rows with ``rest`` (side 0) against blocks of all rows (side 1) of each group."""
    all_ = _cuts(members, weight, most_weight, most_items, "_ball")
    few = _cuts(members.where(rest), weight, most_weight, most_items, "_brest").drop("_c")
    out = join_counted(members, all_.join(few, "hub"), ["hub"], "_c", n_members)
    left = out.where(rest).withColumn("bi", _own(item, "_brest")).withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("_ball") - 1))).withColumn("side", F.lit(0))
    right = out.withColumn("bj", _own(item, "_ball")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("_brest") - 1))).withColumn("side", F.lit(1))
    return left.unionByName(right).drop("_ball", "_brest", "_c")


def each_pair(df: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Runs ``work`` on the rows of each (hub, bi, bj), read as sorted runs of a partition."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("hub", "bi", "bj")], 1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            bounds = [0, *cut.tolist(), len(key)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                now = tuple(key[a])
                if held and now != last:
                    yield work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield work(pa.Table.from_batches(held))

    width = shuffle_width(df.sparkSession)
    dealt = df.repartition(width, "hub", "bi", "bj").sortWithinPartitions("hub", "bi", "bj")
    return dealt.mapInArrow(runs, schema)


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest edges (parents, children) of a symmetric boolean matrix, breadth first."""
    n = len(links)
    new = np.ones(n, bool)
    parents: list[np.ndarray] = []
    children: list[np.ndarray] = []
    for seed in np.flatnonzero(links.any(1)):
        if not new[seed]:
            continue
        new[seed] = False
        queue = [seed]
        while queue and new.any():
            at = queue.pop()
            found = np.flatnonzero(links[at] & new)
            if len(found):
                new[found] = False
                parents.append(np.full(len(found), at))
                children.append(found)
                queue.extend(found.tolist())
    if not parents:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(parents), np.concatenate(children)
