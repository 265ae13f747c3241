"""Near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions, which are 2-stable: the
projections of two vectors differ by a normal variate scaled with their
distance. A key joins ``k`` projections quantised with width ``w``; one key is
made for each of ``L`` tables. Two unit vectors of cosine c lie
sqrt(2 - 2c) apart, so the chance that one table joins them is known, and ``k``
and ``L`` follow from the number of vectors, the cosine and the wanted recall
(``plan``). Every candidate is checked by its exact cosine in double precision.

Equal vectors are one item with a weight from the start. Buckets are joined
through hubs and checked in bounded block pairs of matrix products
(``_blocks``); a pair that meets at several hubs counts at the smallest one.
No pairs are written: tasks return degrees and spanning forests. Buckets,
groups and components of any size, and copies of one vector, are joined by
``join_counted``, which leaves the rows of hot keys where they are.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and stay; vectors of different lengths never
link; a repeated row links with its copies, also if the vec_id is the same;
a row without vec_id takes part in nothing and is returned with null component
and kept. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.llm._blocks import block_pairs, each_pair, forest, hub_members
from tessera.llm._components import components
from tessera.llm._runtime import Scratch, join_counted, keep_keys, list_parts, lists

#: Components and vectors in a block.
BLOCK_VALUES, BLOCK_VECTORS = 400_000, 2048


def collide(distance: float, w: float) -> float:
    """Chance that one quantised projection joins two points at this distance."""
    r = w / distance
    cdf = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * cdf - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, recall: float = 0.995, w: float = 1.0) -> tuple[int, int]:
    """(k, L): about one unrelated partner a bucket, and the recall at the very threshold."""
    near, far = collide(math.sqrt(2 - 2 * cosine), w), collide(math.sqrt(2), w)
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)) - 1)
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _scan(k: int, tables: int, w: float, seed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            vecs = batch.column(1)
            full = vecs.fill_null([]) if vecs.null_count else vecs
            offs = full.offsets.to_numpy().astype(np.int64)
            flat = full.values.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(offs)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), 1024):
                    own = rows[at : at + 1024]
                    x = flat[offs[own][:, None] + np.arange(dim)]
                    with np.errstate(all="ignore"):
                        scale = np.abs(x).max(1, initial=0)
                        y = x / scale[:, None]
                        unit = y / np.sqrt((y * y).sum(1))[:, None]
                    good = np.isfinite(unit).all(1) & np.isfinite(scale) & (scale > 0) & (dim > 0)
                    own, unit = own[good], unit[good]
                    if not len(own):
                        continue
                    if dim not in made:
                        rng = np.random.default_rng([seed, int(dim)])
                        made[dim] = rng.standard_normal((int(dim), tables * k)), rng.uniform(0, w, tables * k)
                    a, b = made[dim]
                    cells = np.floor((unit @ a + b) / w).astype(np.int64).view(np.uint64).reshape(len(own), tables, k)
                    keys = np.broadcast_to(_text.mix(np.arange(tables, dtype=np.uint64) + np.uint64(int(dim) << 20)), (len(own), tables))
                    for j in range(k):
                        keys = _text.mix(keys ^ cells[:, :, j])
                    data = np.ascontiguousarray(x[good]).view(np.uint64)
                    fp = _text.mix(np.full(len(own), int(dim), np.uint64))
                    for j in range(int(dim)):
                        fp = _text.mix(fp ^ data[:, j])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(own)), pa.array(fp.view(np.int64)), lists(unit.ravel(), np.full(len(own), dim), pa.float64()), lists(keys.ravel().view(np.int64), np.full(len(own), tables), pa.int64())],
                        ["vec_id", "fp", "unit", "keys"],
                    )

    return scan


def met(row: np.ndarray, hub: np.ndarray, n: int, slice_: int = 2048) -> np.ndarray:
    """Whether rows have a hub in common, as a symmetric matrix; slices of hubs bound the memory."""
    _, col, times = np.unique(hub, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # hubs of one row join nothing
    some = times[col] > 1
    row, col = row[some], place[col[some]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), bool)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, slice_):
        a, b = np.searchsorted(col, (first, first + slice_))
        m = np.zeros((n, slice_), np.float32)
        m[row[a:b], col[a:b] - first] = 1
        out |= m @ m.T > 0
    return out


def _check(cosine: float):
    def work(table: pa.Table) -> pa.RecordBatch:
        own = table.column("own").to_numpy()
        item = table.column("item").to_numpy()
        weight = table.column("w").to_numpy()
        hub, bi, bj = (table.column(c)[0].as_py() for c in ("hub", "bi", "bj"))
        flat, offs = list_parts(table.column("unit"))
        dims = np.diff(offs)
        hubs, at = list_parts(table.column("hubs"))
        row = np.repeat(np.arange(len(own)), np.diff(at))
        links = np.zeros((len(own),) * 2, bool)
        for dim in np.unique(dims):
            a = np.flatnonzero((own == bi) & (dims == dim))
            b = np.flatnonzero((own == bj) & (dims == dim))
            xa, xb = (flat[offs[i][:, None] + np.arange(dim)] for i in (a, b))
            links[np.ix_(a, b)] = xa @ xb.T >= cosine
        if bi != bj:
            links |= links.T
        np.fill_diagonal(links, False)
        earlier = hubs < hub
        fresh = links & ~met(row[earlier], hubs[earlier], len(own)) if links.any() else links
        degree = fresh @ weight
        u, v = forest(links)
        some = np.flatnonzero(degree)
        none = np.zeros(len(u), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(item[u], item[some])), pa.array(np.append(item[v], item[some])), pa.array(np.append(none, degree[some]))],
            ["u", "v", "d"],
        )

    return work


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed-dedup")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    k, tables = plan(base.count(), cosine, recall)
    hashed = scratch.save(base.where("vec_id is not null").mapInArrow(_scan(k, tables, 1.0, seed), "vec_id long, fp long, unit array<double>, keys array<long>"), "hashed")
    items = scratch.save(hashed.groupBy("fp").agg(F.min("vec_id").alias("item"), F.count("*").alias("w")), "items")
    n_items = items.count()
    reps = keep_keys(hashed.withColumnRenamed("vec_id", "item"), items.select("item"), "item", n_items)
    repeated = items.groupBy("item").count().where("count > 1")  # one vec_id with several vectors
    if repeated.limit(1).count():
        reps = reps.join(items.select("item", "fp"), ["item", "fp"], "left_semi")
    reps = reps.withColumn("item", F.col("fp"))
    lists_ = reps.select("item", F.explode("keys").alias("key"))
    members = scratch.save(hub_members(lists_, ["key"], "item", n_items * tables), "members")
    known = members.groupBy("item").agg(F.sort_array(F.collect_list("hub")).alias("hubs"))
    whole = reps.select("item", "unit").dropDuplicates(["item"]).join(items.select(F.col("fp").alias("item"), "w"), "item").join(known, "item")
    widest = base.agg(F.coalesce(F.max(F.size("v")), F.lit(1)).alias("n")).first()["n"]
    dealt = block_pairs(members.withColumn("n", F.lit(max(widest, 1))), "item", "n", BLOCK_VALUES, BLOCK_VECTORS, members.count())
    rows = dealt.select("hub", "bi", "bj", "own", "item").join(whole, "item").select("hub", "bi", "bj", "own", "item", "w", "unit", "hubs")
    found = scratch.save(each_pair(rows, _check(cosine), "u long, v long, d long"), "links")
    degree = found.where("d > 0").groupBy(F.col("u").alias("fp")).agg(F.sum("d").alias("deg"))
    comp = components(found.where("u <> v").select("u", "v"), scratch)
    named = comp.join(items.select(F.col("fp").alias("node"), "item"), "node")
    named = scratch.save(named, "named")
    low = named.groupBy("component").agg(F.min("item").alias("low"), F.count("*").alias("c"))
    labels = join_counted(named, low, ["component"], "c", n_items).select(F.col("node").alias("fp"), "low")
    state = scratch.save(items.join(degree, "fp", "left").join(labels, "fp", "left").select("fp", "w", (F.coalesce("deg", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("low", "item").alias("component_id")), "state")
    linked = join_counted(hashed.select("vec_id", "fp"), state, ["fp"], "w", hashed.count()).select("vec_id", "n_links", "component_id")
    other = base.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    bad = base.where("vec_id is not null and not coalesce(size(v) > 0 and forall(v, x -> coalesce(not isnan(x) and abs(x) < double('infinity'), false)) and exists(v, x -> x <> 0), false)")
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).unionByName(other)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
