"""N-gram Jaccard self-join by filters under several global token orders.

Two documents link when the Jaccard similarity of their word-shingle sets is
at least ``num``/``den``. If it is, they overlap in at least ceil(t*n) tokens,
so under *any* global order of all tokens their prefixes of
n - ceil(t*n) + l tokens share at least l tokens. This is asked for under
three orders, first of items, then of pairs:

1. token hashes, short prefix (l = 5 % of the set): most documents share too
   few prefix tokens with any other and leave here;
2. a second, independent hash order, longer prefix (l = 25 %), over what is left;
3. ascending document frequency, counted in the second prefixes: only the
   rarest shared tokens are used as keys of candidate lists.

Items that share a key of order 3 meet in the group of a hub (``_blocks``),
which may join more items than share a key. So each pair is tested there under
all three orders, and the filters are intersected: it must share a key of order
3, and as many prefix tokens of orders 1 and 2 as both of its sets ask for.
Only pairs that pass are verified with whole sets. Verification goes in two
steps: each item with its hub, and then the items that did not link with their
hub with all of the group, in bounded block pairs. A group of near copies is
done after the first step, in linear time. Tasks return spanning forests of the
links, never all pairs of a group; the components of the forests are the
components of the links. Exact copies of a set are one item from the start.

Skew: the sorted stream of order 1 is range-partitioned on (token, item), so a
token of any frequency spreads over tasks; order 3 joins counts that were
partially aggregated; hub groups are cut into blocks; keys, hubs, components
and sets of any number of rows are joined by ``join_counted``, which leaves the
rows of hot keys where they are.

Defined cases: null or empty texts, or texts of separators only, have an empty
set and link with nothing; repeated rows of a doc_id are copies of each other;
a row without doc_id is returned as a component of its own (null). Other
columns of the input are ignored. Tokens are 64-bit hashes; two sets are one
item if their 64-bit fingerprints are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _text
from tessera.llm._blocks import each_pair, forest, hub_members, rest_pairs, with_hub
from tessera.llm._components import components
from tessera.llm._runtime import Scratch, join_counted, keep_keys, list_parts, lists, pieces, shuffle_width

#: Shared prefix tokens asked for under orders 1 and 2, in hundredths of the set.
SHARE_1, SHARE_2 = 5, 25
#: Tokens and sets in a block.
BLOCK_TOKENS, BLOCK_SETS = 400_000, 1536
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _least(n, num: int, den: int):
    """Fewest tokens that a set of n shares with any partner: ceil(num * n / den)."""
    return -((-num * n) // den)


def _asked(n, share: int):
    return -((-share * n) // 100)


def _prefix(n, share: int, num: int, den: int):
    return n - _least(n, num, den) + _asked(n, share)


def sets_of(batch_slice: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row's whole text, ascending, with offsets."""
    data = _text.LOWER[data]
    starts, ends, first = _text.words(data, offs)
    values, bounds = _text.shingles(_text.hash_spans(data, starts, ends), first, k)
    return _text.distinct_sets(values, bounds)


def fingerprints(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One hash for each set, whatever its rows' order."""
    n = np.diff(offs)
    full = n > 0
    out = np.zeros(len(n), np.uint64)
    if full.any():
        at = offs[:-1][full]
        out[full] = _text.mix(np.add.reduceat(_text.mix(flat), at) ^ _text.mix(np.bitwise_xor.reduceat(flat, at) + n[full].astype(np.uint64)))
    return out


def _heads(flat: np.ndarray, offs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first sizes[i] values of each part."""
    at = np.arange(int(sizes.sum())) + np.repeat(offs[:-1] - (np.cumsum(sizes) - sizes), sizes)
    return flat[at]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _scan(id_col: str, k: int, num: int, den: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch, "text"):
                flat, bounds = sets_of(rows, data, offs, k)
                n = np.diff(bounds)
                size = np.minimum(n, _prefix(n, SHARE_1, num, den))
                pre = _heads(flat, bounds, size)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(id_col).cast(pa.int64()), pa.array(n), pa.array(_signed(fingerprints(flat, bounds))), lists(_signed(pre), size, pa.int64())],
                    ["doc_id", "n", "fp", "pre"],
                )

    return scan


def _second_order(id_col: str, k: int, num: int, den: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in pieces(batch, "text", 1_000_000):
                flat, bounds = sets_of(rows, data, offs, k)
                n = np.diff(bounds)
                size = np.minimum(n, _prefix(n, SHARE_2, num, den))
                other = _text.mix(flat ^ _SECOND)
                parts = []
                for a, b, s in zip(bounds[:-1], bounds[1:], size, strict=True):
                    own = other[a:b]
                    parts.append(np.partition(own, s - 1)[:s] if 0 < s < len(own) else own)
                pre = np.concatenate(parts) if parts else other[:0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(fingerprints(flat, bounds))), pa.array(n), lists(_signed(pre), size, pa.int64()), lists(_signed(flat), n, pa.int64())],
                    ["fp", "n", "pre", "tokens"],
                )

    return scan


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (t, fp), those whose token more than one item has.

    The first and last token of a partition may go on in another one; their
    rows are kept. Memory: one batch and one row.
    """
    carry: tuple[int, int, bool] | None = None
    opening = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "fp"))
        opening = t[0] if opening is None else opening
        before = False
        if carry:
            t, fp, before = np.append(carry[0], t), np.append(carry[1], fp), carry[2]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (fp[1:] != fp[:-1])
        t, fp = t[new], fp[new]
        same = t[1:] == t[:-1]
        keep = np.append(before, same)
        carry = (int(t[-1]), int(fp[-1]), bool(keep[-1]))
        keep[:-1] |= same
        keep |= t == opening
        keep[-1] = False
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(fp[keep])], ["t", "fp"])
    if carry:
        yield pa.RecordBatch.from_arrays([pa.array([carry[0]], pa.int64()), pa.array([carry[1]], pa.int64())], ["t", "fp"])


def overlaps(fa: np.ndarray, oa: np.ndarray, fb: np.ndarray, ob: np.ndarray) -> np.ndarray:
    """|A_i and B_j| for all i, j, from sets as flat values with offsets.

    Frequent tokens are counted by matrix products over slices of columns,
    rare ones by their short lists.
    """
    na, nb = len(oa) - 1, len(ob) - 1
    out = np.zeros((na, nb), np.int32)
    both = np.intersect1d(np.unique(fa), np.unique(fb), assume_unique=True)
    if not len(both):
        return out

    def entries(flat, offs):
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        hit = both[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    (ra, ta), (rb, tb) = entries(fa, oa), entries(fb, ob)
    ca, cb = np.bincount(ta, minlength=len(both)), np.bincount(tb, minlength=len(both))
    dense = np.flatnonzero(ca * cb >= 64)
    for i in range(0, len(dense), 2048):
        col = np.full(len(both), -1)
        col[dense[i : i + 2048]] = np.arange(len(dense[i : i + 2048]))
        ma, mb = np.zeros((na, 2048), np.float32), np.zeros((nb, 2048), np.float32)
        for m, r, t in ((ma, ra, ta), (mb, rb, tb)):
            own = col[t] >= 0
            m[r[own], col[t[own]]] = 1
        out += (ma @ mb.T).astype(np.int32)
    rare = (ca * cb < 64)[ta]
    ra, ta = ra[rare], ta[rare]
    if len(ta):
        times = cb[ta]
        first = (np.cumsum(cb) - cb)[ta]
        at = np.arange(int(times.sum())) + np.repeat(first - (np.cumsum(times) - times), times)
        out += np.bincount(np.repeat(ra, times) * nb + rb[at], minlength=na * nb).reshape(na, nb).astype(np.int32)
    return out


class _Side:
    """Items of one side of a block pair: whole sets, keys of order 3, and prefixes under orders 1 and 2."""

    def __init__(self, fp: np.ndarray, tokens: tuple[np.ndarray, np.ndarray], keys: tuple[np.ndarray, np.ndarray]):
        self.fp, self.tokens, self.keys = fp, tokens, keys
        self.n = np.diff(tokens[1])

    def take(self, at: np.ndarray) -> _Side:
        def part(flat, offs):
            n = np.diff(offs)[at]
            return _heads(flat, np.append(offs[at], 0), n), np.append(0, np.cumsum(n))

        return _Side(self.fp[at], part(*self.tokens), part(*self.keys))

    def prefix(self, share: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        flat, offs = self.tokens
        size = np.minimum(self.n, _prefix(self.n, share, num, den))
        if share == SHARE_1:
            return _heads(flat, offs, size), np.append(0, np.cumsum(size))
        other = _text.mix(flat ^ _SECOND)
        parts = [np.partition(other[a:b], s - 1)[:s] if 0 < s < b - a else other[a:b] for a, b, s in zip(offs[:-1], offs[1:], size, strict=True)]
        return (np.concatenate(parts) if parts else other[:0]), np.append(0, np.cumsum(size))


def candidates(a: _Side, b: _Side, num: int, den: int) -> np.ndarray:
    """The pairs that pass the filters under every order, as a boolean matrix."""
    out = overlaps(*a.keys, *b.keys) > 0
    out &= np.minimum(a.n[:, None], b.n) * den >= num * np.maximum(a.n[:, None], b.n)
    out &= a.fp[:, None] != b.fp
    for share in (SHARE_1, SHARE_2):
        i, j = np.flatnonzero(out.any(1)), np.flatnonzero(out.any(0))
        if len(i):
            x, y = a.take(i), b.take(j)
            met = overlaps(*x.prefix(share, num, den), *y.prefix(share, num, den))
            out[np.ix_(i, j)] &= met >= np.minimum(_asked(x.n, share)[:, None], _asked(y.n, share))
    return out


def linked(a: _Side, b: _Side, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the linked pairs. Few candidates are verified one by one, many by products over their rows."""
    i, j = np.nonzero(candidates(a, b, num, den))
    if not len(i):
        return i, j
    rows, cols = np.unique(i), np.unique(j)
    if 20 * len(i) >= len(rows) * len(cols):
        both = overlaps(*a.take(rows).tokens, *b.take(cols).tokens)[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)
    else:
        flat, offs = a.tokens
        both = np.empty(len(i), np.int64)
        for r in rows:
            own = flat[offs[r] : offs[r + 1]]
            pairs = np.flatnonzero(i == r)
            other, bounds = b.take(j[pairs]).tokens
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            hits = np.append(0, np.cumsum(own[at] == other))
            both[pairs] = hits[bounds[1:]] - hits[bounds[:-1]]
    good = both * den >= num * (a.n[i] + b.n[j] - both)
    return i[good], j[good]


def _verify(num: int, den: int):
    def work(table: pa.Table) -> pa.RecordBatch:
        side = table.column("side").to_numpy()
        tokens, offs = list_parts(table.column("tokens"))
        every = _Side(table.column("fp").to_numpy(), (tokens.view(np.uint64), offs), list_parts(table.column("keys")))
        a, b = (every.take(np.flatnonzero(side == k)) for k in (0, 1))
        i, j = linked(a, b, num, den)
        ids, at = np.unique(np.append(a.fp[i], b.fp[j]), return_inverse=True)
        full = np.zeros((len(ids),) * 2, bool)
        full[at[: len(i)], at[len(i) :]] = True
        u, v = forest(full | full.T)
        return pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(ids[v], pa.int64())], ["u", "v"])

    return work


def ngram_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    ``k`` words make a shingle; documents link at Jaccard >= num/den;
    component_id is the smallest doc_id reachable by links. Runs its stages at
    once, writing them to the shared folder; the result reads from there.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    width = shuffle_width(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = scratch.save(texts.mapInArrow(_scan("doc_id", k, num, den), "doc_id long, n long, fp long, pre array<long>"), "base")

    def floor_of(share: int):
        """Shared prefix tokens that an item needs: those of its smallest partner."""
        small = F.ceil(F.col("n") * num / F.lit(den))
        return F.greatest(F.lit(1), F.ceil(small * share / F.lit(100)))

    items = base.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"))
    items = scratch.save(items, "items")

    # order 1: token hashes; one row of each item
    reps = items.select(F.col("rep").alias("doc_id"))
    entries = keep_keys(base.where("n > 0"), reps, "doc_id", items.count()).select("fp", F.explode("pre").alias("t"))
    dealt = entries.repartitionByRange(width, "t", "fp").sortWithinPartitions("t", "fp")
    counted = dealt.mapInArrow(_shared, "t long, fp long").groupBy("fp").agg(F.count("*").alias("c"))
    left = scratch.save(counted.join(items, "fp").where(F.col("c") >= floor_of(SHARE_1)).select(F.col("rep").alias("doc_id")), "left-1")

    # order 2: another hash order over what is left, whole sets beside it
    kept = keep_keys(texts.where("text is not null"), left, "doc_id", left.count())
    sets = scratch.save(kept.mapInArrow(_second_order("doc_id", k, num, den), "fp long, n long, pre array<long>, tokens array<long>"), "sets")
    entries = sets.select("fp", "n", F.explode("pre").alias("t"))
    often = entries.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    shared = entries.join(often, "t").groupBy("fp").agg(F.max("n").alias("n"), F.collect_list(F.struct("c", "t")).alias("s"))
    least = F.ceil(F.col("n") * num / F.lit(den))
    prefix = F.least(F.col("n"), F.col("n") - least + F.ceil(F.col("n") * SHARE_2 / F.lit(100)))

    # order 3: ascending frequency within the second prefixes
    take = prefix - floor_of(SHARE_2) + 1 - (prefix - F.size("s"))
    keys = shared.where(F.size("s") >= floor_of(SHARE_2)).select("fp", F.explode(F.slice(F.sort_array("s"), F.lit(1), F.greatest(take, F.lit(0)).cast("int"))).alias("x"))
    keys = scratch.save(keys.select("fp", F.col("x.t").alias("t")), "keys")
    members = hub_members(keys, ["t"], "fp", keys.count()).withColumnRenamed("fp", "item")
    members = scratch.save(members.join(items.select(F.col("fp").alias("item"), "n"), "item"), "members")
    n_members = members.count()
    known = keys.groupBy("fp").agg(F.collect_list("t").alias("keys"))
    whole = scratch.save(sets.select("fp", "tokens").join(known, "fp").dropDuplicates(["fp"]).withColumnRenamed("fp", "item"), "whole")

    def links(dealt: DataFrame) -> DataFrame:
        rows = dealt.select("hub", "bi", "bj", "side", "item").join(whole, "item").select("hub", "bi", "bj", "side", F.col("item").alias("fp"), "tokens", "keys")
        return each_pair(rows, _verify(num, den), "u long, v long")

    limits = ("item", "n", BLOCK_TOKENS, BLOCK_SETS, n_members)
    star = scratch.save(links(with_hub(members, *limits)).select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")), "star")
    done = star.select(F.col("u").alias("hub"), F.col("v").alias("item"), F.lit(True).alias("done"))  # the hub is the smallest
    marked = scratch.save(members.join(done, ["hub", "item"], "left").withColumn("rest", F.expr("done is null and item <> hub")).drop("done"), "marked")
    edges = star.select("u", "v")
    if marked.where("rest").limit(1).count():
        edges = scratch.save(edges.unionByName(links(rest_pairs(marked, "rest", *limits))), "links")
    for name in ("left-1", "sets", "keys", "members", "whole", "marked"):
        scratch.drop(name)
    scratch.release()

    comp = components(edges, scratch)
    named = scratch.save(comp.join(items.select(F.col("fp").alias("node"), "rep"), "node"), "named")
    low = named.groupBy("component").agg(F.min("rep").alias("low"), F.count("*").alias("c"))
    found = join_counted(named, low, ["component"], "c", named.count()).select(F.col("node").alias("fp"), "low")
    labels = scratch.save(items.join(found, "fp", "left").select("fp", "copies", F.coalesce("low", "rep").alias("component_id")), "labels")
    scratch.keep("base", "labels")
    scratch.release()
    full = F.expr("n > 0 and doc_id is not null")
    own = join_counted(base.where(full).select("doc_id", "n", "fp"), labels, ["fp"], "copies", base.count()).select("doc_id", "n", "component_id")
    # documents without shingles have no item, and rows without a key none to name
    alone = base.where(~full).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return own.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component is kept: that with its smallest doc_id.

    Of repeated rows of that doc_id one stays; rows without a doc_id all stay.
    """
    found = ngram_components(docs, k, num, den).where("component_id = doc_id or doc_id is null")
    keys = found.select("doc_id").where("doc_id is not null").distinct()
    kept = keep_keys(docs, keys, "doc_id", keys.count())
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if repeated.limit(1).count():
        often = keep_keys(kept, repeated, "doc_id", repeated.count()).dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(often)
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
