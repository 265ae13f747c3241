"""Each operator against a brute-force version, and its defined cases."""

import itertools
import json
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm import _components, chat, embed_dedup, langid, lm, mixing, ngram_join, packing, quality, rules, warc
from tessera.llm._runtime import Scratch

WORDS = ["the", "of", "and", "rea", "ton", "inga", "sher", "lyon", "éta", "ñor", "vel", "quo"]
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, fp string, train string, item int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(seed=0, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    out = list(base)
    for t in base[:30]:
        w = t.split(" ")
        for _ in range(rng.randint(1, 4)):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = "edit" + str(rng.randint(0, 9))
            out.append((" " if rng.random() < 0.5 else "\n").join(x).upper() if rng.random() < 0.2 else " ".join(x))
    return [*out, None, "", " \t\n", "one", "One", "two words", "two  words", "\x00 odd space", "long " * 3000, base[0], base[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, None, 1, "x", "y", 2) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def closure(ids, pairs):
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_ngram_join(docs, k, num):
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {}
    for i, t in rows.items():
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(rows, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = closure(rows, links)
    got = {r.doc_id: r for r in ngram_join.ngram_components(docs, k, num).collect()}
    assert len(got) == len(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(sets[i]) for i in rows)
    kept = ngram_join.deduplicate(docs, k, num)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in rows if want[i] == i}


def test_ngram_join_hot_group(spark, monkeypatch):
    """A group of near copies that spans many blocks, and repeated rows and missing keys."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 20)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        x = list(base)
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(80)] = f"e{rng.randint(0, 5)}"
        rows.append((i, " ".join(x)))
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(77)} for i, t in rows}
    want = closure(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1]), (None, None)], "doc_id long, text string")
    got = ngram_join.ngram_components(df).collect()
    assert len(got) == 153
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert ngram_join.deduplicate(df).count() == len(set(want.values())) + 2


def test_pairs_pass_every_filter(monkeypatch):
    """Linked pairs all pass; what is verified one by one or by products is the same; pairs without a shared key are not verified."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))
    sets = [np.unique(np.append(base[: 120 - rng.integers(0, 25)], rng.integers(0, 2**63, rng.integers(0, 25)).astype(np.uint64))) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**63, 100).astype(np.uint64)) for _ in range(40)]
    offs = np.append(0, np.cumsum([len(x) for x in sets]))
    keys = (np.concatenate([x[:20].view(np.int64) for x in sets]), np.arange(len(sets) + 1) * 20)
    side = ngram_join._Side(np.arange(len(sets)), (np.concatenate(sets), offs), keys)
    both = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    n = np.array([len(x) for x in sets])
    want = (100 * both >= 85 * (n[:, None] + n - both)) & ~np.eye(len(sets), dtype=bool)
    passed = ngram_join.candidates(side, side, 85, 100)
    assert want.sum() > 20 and not (want & ~passed).any() and passed.sum() < 40 * 40
    got = np.zeros_like(want)
    got[ngram_join.linked(side, side, 85, 100)] = True
    assert (got == want).all()
    apart = side.take(np.arange(40)), side.take(np.arange(40, 80))
    asked = []
    plain = ngram_join.overlaps
    monkeypatch.setattr(ngram_join, "overlaps", lambda *a: asked.append(len(a[0])) or plain(*a))
    assert len(ngram_join.linked(*apart, 85, 100)[0]) == 0 and asked == [800]  # the keys alone
    one = ngram_join._Side(side.fp[:1], side.take(np.arange(1)).tokens, side.take(np.arange(1)).keys)
    few = ngram_join.linked(one, side, 85, 100)
    assert set(few[1].tolist()) == set(np.flatnonzero(want[0]).tolist())


def test_joins_on_hot_keys(spark, monkeypatch):
    from tessera.llm import _runtime

    monkeypatch.setattr(_runtime, "HOT_ROWS", 20)
    monkeypatch.setattr(_runtime, "HOT_KEYS", 50)
    rows = [(1, i) for i in range(300)] + [(k % 97 + 2, k) for k in range(300)] + [(500, 0)]
    big = spark.createDataFrame(rows, "k long, v long").repartition(7)
    small = big.where("k <> 500").groupBy("k").agg(F.count("*").alias("c"), F.min("v").alias("m"))
    got = _runtime.join_counted(big, small, ["k"], "c", 601)
    assert sorted(map(tuple, got.select("k", "v", "m").collect())) == sorted((k, v, min(b for a, b in rows if a == k)) for k, v in rows if k != 500)
    spread = got.where("k = 1").select(F.spark_partition_id()).distinct().count()
    assert spread >= 7


def test_components_of_stars_take_no_round(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 1400)]
    far = [(5000 + i, 4990) for i in range(9)] + [(4990, 4980), (4980, 5003)]
    saved = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))

    def found(edges):
        saved.clear()
        rows = _components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
        assert len(rows) == len({r.node for r in rows})
        return {r.node: r.component for r in rows}

    assert found([*chain, *hub, *far, (7, 7)]) == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 1400)} | {i: 4980 for i in [4980, 4990, *range(5000, 5009)]}
    assert found([*hub, *[(b, a) for a, b in hub], (3, 3)]) == {i: 100 for i in range(100, 1400)}
    assert saved == ["edges-0", "low-0"]
    with pytest.raises(RuntimeError):
        _components.components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "test"), most_rounds=1)


def test_release_frees_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    scratch = Scratch(spark, "test")
    scratch.release()

    def shuffled():
        return len([f for f in disk.getAllFiles().mkString(" ").split() if "shuffle_" in f])

    before = shuffled()
    rows = spark.range(50_000).withColumn("g", F.col("id") % 1000)
    scratch.save(rows.withColumn("n", F.count("*").over(Window.partitionBy("g"))).repartition(3, "id"), "rows")
    assert shuffled() > before
    scratch.release()
    end = time.time() + 1
    while shuffled() > before and time.time() < end:
        time.sleep(0.05)
    assert shuffled() <= before


def test_join_leaves_two_tables(spark, docs):
    """The result reads two tables; all others are deleted when it is returned."""
    from pathlib import Path

    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(top.glob("ngram-join-*"))
    kept = ngram_join.deduplicate(docs, k=5, num=80, den=100)
    assert {x.name for root in set(top.glob("ngram-join-*")) - before for x in root.iterdir()} == {"base", "labels"}
    assert 0 < kept.count() < docs.count()


def test_overlaps():
    rng = np.random.default_rng(0)
    a = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    flat, offs = np.concatenate(a), np.append(0, np.cumsum([len(x) for x in a]))
    want = [[len(np.intersect1d(x, y)) for y in a] for x in a]
    assert (ngram_join.overlaps(flat, offs, flat, offs) == want).all()


def test_language_model(docs, empty):
    rows = docs.collect()
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    count = Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update([*words((r.text or "").translate(LOWER)), "\n"])
    n, v = sum(count.values()), len(count)
    found = {r.doc_id: r for r in lm.score(docs, train).collect()}
    for r in rows:
        w, g = [*words((r.text or "").translate(LOWER)), "\n"], found[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and g.score < 0
    assert lm.score(empty, train).collect() == []
    untrained = lm.score(docs, F.lit(False)).where("doc_id = 0").first()
    assert (untrained.train_tokens, untrained.n_known, untrained.score) == (0, 0, 0)


def test_rungs():
    assert [lm.rung(j) for j in range(8)] == [1, 2, 3, 4, 8, 16, 32, 64]


class BruteTree:
    """The suffix tree over words as the module's text defines it, by dictionaries and without pruning."""

    def __init__(self, texts):
        self.depths = [0] + [lm.rung(j) for j in range(12)]
        self.next, self.words = {}, Counter()
        for seq in texts:
            self.words.update(seq[1:])
            for i in range(1, len(seq)):
                for d in self.depths:
                    if d <= i:
                        self.next.setdefault(seq[i - d : i], Counter())[seq[i]] += 1
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.states = {()}
        for s in self.next:
            if s and self.gain(s) >= lm.MIN_GAIN:
                while s:
                    self.states.add(s)
                    s = self.suffix(s)

    def suffix(self, s):
        return s[len(s) - max(d for d in self.depths if d < len(s)) :]

    def parts(self, s):
        rep = {y: m for y, m in self.next[s].items() if m > 1}
        return rep, sum(rep.values()), len(self.next[s])

    def p(self, s, y):
        if not s:
            return (self.words[y] or self.v) / (self.n + self.v)
        rep, n, t = self.parts(s)
        return (rep.get(y, 0) + t * self.p(self.suffix(s), y)) / (n + t)

    def gain(self, s):
        rep, n, t = self.parts(s)
        if not rep:
            return -1
        up = self.suffix(s)
        out = (sum(self.next[s].values()) - n) * math.log(t / (n + t))
        for y, m in rep.items():
            q = self.p(up, y)
            out += m * math.log((m - 1 + t * q) / ((n + t - 1) * q))
        return out

    def score(self, seq):
        out = 0
        for i in range(1, len(seq)):
            d = 0
            for e in self.depths:
                if e <= i and seq[i - e : i] in self.states:
                    d = e
            out += math.log10(self.p(seq[i - d : i], seq[i]))
        return out


def sequences(rows):
    return {r.doc_id: ("<start>", *words((r.text or "").translate(LOWER)), "\n") for r in rows}


def repeated_docs(spark):
    """Documents with copies and near copies, long repeated passages and one very frequent word."""
    rng = random.Random(21)
    word = lambda: rng.choice(WORDS) + str(min(rng.randint(0, 60), rng.randint(0, 60)))
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(160):
        w = [word() if rng.random() < 0.8 else "the" for _ in range(rng.randint(1, 60))]
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        if i % 4 == 1:
            w = [x if rng.random() < 0.97 else word() for x in passage]
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i % 3][1]) for i in range(6)] + [(300, None), (301, ""), (302, "the " * 500)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_score_is_that_of_a_brute_force_tree(spark):
    docs = repeated_docs(spark)
    found = sequences(docs.collect())
    tree = BruteTree([s for i, s in found.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    assert max(map(len, tree.states)) >= 8 and len(tree.states) > 100
    for s in sorted(tree.states, key=lambda s: (len(s), s))[:: len(tree.states) // 25]:
        assert sum(tree.p(s, y) for y in [*tree.words, "not a word"]) == pytest.approx(1)
    got = {r.doc_id: r.score for r in lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()}
    for i, seq in found.items():
        assert got[i] == pytest.approx(tree.score(seq)), i


def test_scores_do_not_depend_on_what_is_sent(spark, monkeypatch):
    docs = repeated_docs(spark)
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2

    def rows():
        return {tuple(r)[:5] + (round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, train).collect()}

    want = rows()
    for edges, words_, bits in ((0, 0, 1 << 11), (300, 5, 1 << 20)):
        monkeypatch.setattr(lm, "HOT_EDGES", edges)
        monkeypatch.setattr(lm, "HOT_WORDS", words_)
        monkeypatch.setattr(lm, "FILTER_BITS", bits)
        assert rows() == want


def test_a_place_outside_asks_for_one_edge(spark, monkeypatch):
    """In copies nearly every deepest edge is in the tree: no key but that one is looked up, if no filter errs."""
    rng = random.Random(22)
    seq = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(seq)) for i in range(8)], "doc_id long, text string").repartition(2)
    saved, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))
    monkeypatch.setattr(lm, "HOT_EDGES", 0)
    want = {round(r.score, 6) for r in lm.score(docs, F.lit(True)).collect()}
    assert "again" not in saved and saved["scored"].agg(F.sum(F.size("near"))).first()[0] <= 1.2 * 8 * 401
    saved.clear()
    monkeypatch.setattr(lm, "FILTER_BITS", 1 << 6)
    assert {round(r.score, 6) for r in lm.score(docs, F.lit(True)).collect()} == want and "again" in saved


def test_scoring_keeps_only_the_closed_tree(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 30))) for i in range(40)]
    found = []
    save = Scratch.save

    def watched(self, df, name):
        if name == "scored":
            found.extend(os.listdir(self.root.removeprefix("file://")))
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", watched)
    assert lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 != 0).count() == 40
    assert found and {name.split("-")[0] for name in found} == {"words", "states", "tree"}


def test_shuffles_of_filters_and_parts_are_gone_while_texts_are_scored(spark, monkeypatch):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    Scratch(spark, "test").release()
    shuffled = lambda: len([f for f in disk.getAllFiles().mkString(" ").split() if "shuffle_" in f])
    before, found, save = shuffled(), {}, Scratch.save

    def watched(self, df, name):
        if name == "scored" or name.startswith("near"):
            end = time.time() + 1
            while shuffled() > before and time.time() < end:
                time.sleep(0.05)
            found[name] = shuffled()
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", watched)
    monkeypatch.setattr(lm, "HOT_EDGES", 100)
    monkeypatch.setattr(lm, "BUCKET_KEYS", 200)
    docs = repeated_docs(spark)
    assert lm.score(docs, F.lit(True)).count() == docs.count()
    assert {"scored", "near-0", "near-1"} <= found.keys() and max(found.values()) <= before


def test_counting_holds_one_bucket():
    import pyarrow as pa

    keys = np.arange(8, dtype=np.uint64) << np.uint64(61)
    packed = pa.Table.from_batches([lm._pack(0, keys, keys, None, np.full(8, 2), 4)] * 2).combine_chunks().sort_by("bucket")
    rows = packed.to_batches(max_chunksize=1)
    assert packed.column("bucket").to_pylist() == [0, 0, 1, 1, 2, 2, 3, 3]
    taken = []
    found = lm._merge(taken.append(1) or row for row in rows)
    first = next(found)
    assert first.num_rows == 2 and len(taken) == 3  # no more than the next bucket's first row
    assert [n for batch in (first, *found) for n in batch.column("n").to_pylist()] == [4] * 8


def test_counting_tells_each_contexts_sums():
    import pyarrow as pa

    u = np.uint64
    ctx, low = np.array([1, 2, 3], u) << u(62), np.array([5, 6, 7, 8, 9], u)
    of = ctx[[0, 0, 0, 1, 2]]
    parts = [lm._pack(0, ctx, ctx, None, np.array([9, 2, 1]), 4), lm._pack(0, of, of, low, np.array([4, 3, 1, 1, 1]), 4)]
    packed = pa.Table.from_batches(parts).combine_chunks().sort_by("bucket").to_batches()
    found = [r for batch in lm._merge(packed) for r in batch.to_pylist()]
    rows = {(r["ctx"] % 2**64 >> 62, r["low"]): (r["n"], r["rep"], r["k"], r["total"]) for r in found}
    # three successors, two of them twice or more; then one context without, and one that occurs once
    assert rows == {(1, None): (9, 7, 2, 9), (1, 5): (4, 7, 2, 9), (1, 6): (3, 7, 2, 9), (2, None): (2, 0, 0, 2)}


def test_texts_just_long_enough_are_counted(spark):
    """Passes read no text that is too short for their contexts; those of one-letter words that just fit are read."""
    docs = spark.createDataFrame([(i, ("a b c x y z w", "k l m x y z w t", "a", "a b", None)[i % 5]) for i in range(50)], "doc_id long, text string").repartition(2)
    found = sequences(docs.collect())
    tree = BruteTree(found.values())
    assert ("<start>", *"abcxyzw") in tree.states
    got = {r.doc_id: r.score for r in lm.score(docs, F.lit(True)).collect()}
    for i, seq in found.items():
        assert got[i] == pytest.approx(tree.score(seq)), i


def test_sent_tree_stays_until_texts_are_read_again(spark, monkeypatch):
    """An executor that gave the tree back may find its file gone when it reads it again."""
    from pyspark import Broadcast

    done, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (save(self, df, name), done.append(name))[0])
    for name in ("unpersist", "destroy"):
        f = getattr(Broadcast, name)
        monkeypatch.setattr(Broadcast, name, lambda self, *a, f=f, name=name, **b: (done.append(name), f(self, *a, **b))[1])
    monkeypatch.setattr(lm, "HOT_EDGES", 0)
    monkeypatch.setattr(lm, "FILTER_BITS", 1 << 6)
    docs = repeated_docs(spark)
    assert lm.score(docs, F.lit(True)).count() == docs.count()
    between = done[done.index("scored") : done.index("again")]
    assert "unpersist" not in between and "destroy" not in between and "destroy" in done[done.index("again") :]


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is barely above 0.95, which p-stable hashing finds least often."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((1500, 48))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((1500, 48))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rng.uniform(0.9501, 0.956, 1500)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embed_dedup.near_duplicates(df).collect()
    links = sum(r.n_links for r in got)
    assert links >= 0.99 * 3000 and all(r.component_id in (r.vec_id, r.vec_id - 1500) for r in got)
    below = np.concatenate([a[:300], 0.9499 * a[:300] + np.sqrt(1 - 0.9499**2) * b[:300]])
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(below)], "vec_id long, embedding array<double>")
    assert sum(r.n_links for r in embed_dedup.near_duplicates(df).collect()) == 0


def test_meeting_at_hubs():
    rng = np.random.default_rng(0)
    row, hub = rng.integers(0, 30, 200), rng.integers(0, 90, 200)
    want = np.array([[bool(set(hub[row == i]) & set(hub[row == j])) for j in range(30)] for i in range(30)])
    np.fill_diagonal(want, False)
    for size in (3, 2048):
        got = embed_dedup.met(row, hub, 30, size)
        np.fill_diagonal(got, False)
        assert (got == want).all()


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK_VECTORS", 30)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 32))
    x[100:200] = x[0] + 0.05 * rng.standard_normal((100, 32))
    x[200:240] = x[1]
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x.astype(np.float32))]
    odd = [(300, None), (301, []), (302, [0.0] * 32), (303, [float("nan")] * 32), (304, [None] * 32), (305, [1.0]), (None, [1.0] * 32), (306, [float("inf")] * 32)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").withColumn("fp", F.lit("clash"))
    y = np.array([v for _, v in rows])
    unit = y / np.linalg.norm(y, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    want = closure(range(300), zip(*np.nonzero(link), strict=True))
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == 308
    found = sum(got[i].n_links for i in range(300))
    assert found <= link.sum() and found >= 0.99 * link.sum()
    assert {i: got[i].component_id for i in range(300)} == want
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in [300, 301, 302, 303, 304, 305, 306])
    assert got[None].component_id is None and got[None].kept
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def brute_mix(rows, frame, block, alpha=0.7):
    """{doc: (slot, pos)} and the frame's lanes, by an event-driven earliest-deadline-first simulation.

    ``rows``: (doc, key of the source, characters before it in the source).
    """
    count = Counter(g for _, g, _ in rows)
    all_ = sum(n**alpha for n in count.values())
    w = {g: n**alpha / all_ for g, n in count.items()}
    big = {g: x for g, x in w.items() if 2 * frame * x >= 1}
    tiny = [g for g in w if g not in big]
    lanes = dict(big) | ({"p": sum(w[g] for g in tiny)} if tiny else {})
    m = {g: math.ceil(2 * frame * x) for g, x in lanes.items()}
    done, now, order = dict.fromkeys(lanes, 0), 0.0, []
    while any(done[g] < m[g] for g in lanes):
        open_ = [g for g in lanes if done[g] < m[g]]
        free = [g for g in open_ if done[g] / m[g] <= now + 1e-12] or [min(open_, key=lambda g: done[g] / m[g])]
        g = min(free, key=lambda g: ((done[g] + 1) / m[g], -lanes[g]))
        order.append((g, done[g]))
        done[g], now = done[g] + 1, now + lanes[g] / m[g]
    return w, lanes, m, {x: k for k, x in enumerate(order)}, order, tiny


@pytest.mark.parametrize("weights", [[0.5, 0.25, 0.25], [0.985, *[0.015 / 40] * 40], [0.34, 0.21, 0.19, 0.13, 0.07, 0.06], [1.0]])
def test_schedule(spark, weights):
    frame = 64
    sources, slots = mixing.plan(spark.createDataFrame([(f"s{i}", w) for i, w in enumerate(weights)], "g string, w double"), Scratch(spark, "t"), frame)
    of = {r.lane: r for r in sources.collect()}
    runs = sorted(slots.collect(), key=lambda r: r.slot)
    assert len(runs) == sum(r.m for r in of.values()) and [r.slot for r in runs] == list(range(len(runs)))
    now, had = 0.0, Counter()
    for r in runs:
        size = of[r.lane].lane_w * frame / of[r.lane].m
        assert size <= 0.5 + 1e-9 and r.k * frame / of[r.lane].m <= now + 1e-6  # released
        had[r.lane], now = had[r.lane] + size, now + size
        assert now <= (r.k + 1) * frame / of[r.lane].m + 0.5 + 1e-6  # due
        assert all(abs(had[g] - x.lane_w * now) < 1 for g, x in of.items())
    assert now == pytest.approx(frame) and all(had[g] == pytest.approx(x.lane_w * frame) for g, x in of.items())


def test_mixing_holds_the_given_weights(spark):
    """5,001 sources, one of a weight of 0.985; the lag is measured in the mix itself, against the weights as given."""
    n = 20000
    rows = [(i, "x" * 399, "hot" if i % 3 else f"t{i // 3 % 5000}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    target = {"hot": 0.985} | {f"t{i}": 0.015 / 5000 for i in range(5000)}
    block, frame = 2000, 256
    got = sorted(mixing.interleave(docs, target=target, frame=frame, block=block).where("mix_in or source = 'hot'").collect(), key=lambda r: (r.mix_slot, r.mix_pos))
    assert sum(r.source == "hot" for r in got) == sum(s == "hot" for _, _, s in rows)
    sources, slots = mixing.plan(spark.createDataFrame([(f"s{s}", w) for s, w in target.items()], "g string, w double"), Scratch(spark, "t"), frame)
    hot = sources.where("g = 'shot'").first()
    assert sources.count() == 5001 and sources.select("lane").distinct().count() == 2 and abs(hot.w - 0.985) < 1e-12
    begin, per_frame = {}, 0.0
    size = {r.lane: r.lane_w * frame * block / r.m for r in sources.select("lane", "lane_w", "m").distinct().collect()}
    for r in sorted(slots.collect(), key=lambda r: r.slot):
        begin[r.slot] = per_frame
        per_frame += size[r.lane]
    assert per_frame == pytest.approx(frame * block)
    at = 0
    for r in (r for r in got if r.source == "hot"):
        when = r.mix_slot // len(begin) * per_frame + begin[r.mix_slot % len(begin)] + r.mix_pos
        assert abs(at - 0.985 * when) < block
        at += 400


def test_mixing(docs, empty):
    rows = mixing.interleave(docs, frame=16, block=200).collect()
    assert len(rows) == docs.count()
    key = lambda s: "n" if s is None else f"s{s}"
    by, places = {}, []
    for r in rows:
        by.setdefault(key(r.source), []).append(r)
    for g, own in by.items():
        own.sort(key=lambda r: (r.mix_slot, r.mix_pos))
        at = 0
        for r in own:
            places.append((r, g, at))
            at += len(r.text or "") + 1
    w, lanes, m, slot, order, tiny = brute_mix(places, 16, 200)
    assert not tiny
    for r, g, at in places:
        share = w[g] * 16 * 200
        k = int(at % share / (share / m[g]))
        assert r.mix_slot == at // share * len(order) + slot[g, k] and r.mix_block == at // share * m[g] + k
        assert abs(r.mix_pos - (at % share - k * share / m[g])) <= 1
    dry = {}
    for g, own in by.items():
        end, share = sum(len(r.text or "") + 1 for r in own), w[g] * 16 * 200
        dry[g] = end // share * len(order) + slot[g, int(end % share / (share / m[g]))]
    assert all(r.mix_in == (r.mix_slot < min(dry.values())) for r in rows)
    assert any(not r.mix_in for r in rows) and any(r.mix_in for r in rows)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(empty).collect() == [] and mixing.interleave(empty).collect() == []
    assert {r.source for r in mixing.mix(docs, target={"s1": 1.0, None: 2.0}).select("source").distinct().collect()} <= {"s1", None}


def test_mixing_goes_on_when_a_source_runs_dry(spark):
    rows = [(i, "x" * 99, f"s{i % 3}") for i in range(900)] + [(900, "x", "tiny"), (901, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert sorted(r.doc_id for r in mixing.mix(docs, frame=32, block=200).collect()) == list(range(902))
    assert {r.source for r in mixing.mix(docs, target={"s0": 1.0, "tiny": 0.1}).collect()} == {"s0", "tiny"}
    mixed = mixing.interleave(docs, frame=32, block=200)
    got = sorted(mixed.collect(), key=lambda r: (r.mix_slot, r.mix_pos))
    assert not all(r.mix_in for r in got)
    late = [r.source for r in got if r.source in ("s0", "s1", "s2")]
    for t in range(0, len(late), 60):
        assert max(abs(late[:t].count(s) - t / 3) for s in ("s0", "s1", "s2")) <= 4


def test_columns_with_clashing_names(spark, docs, tmp_path):
    """Columns that the operators add or use inside: the former are replaced, all others stay."""
    import corpus_pipeline as p

    names = ["k", "slot", "mix_in", "mix_slot", "_h", "_w", "_k", "_row", "_id", "_size", "_n", "g", "w", "m", "lane", "n_tokens", "bucket", "batch", "score", "lang_pred", "row", "x", "whole", "_text"]
    wide = docs.select("doc_id", "text", "lang", "source", *[F.lit(f"own {c}").alias(c) for c in names])
    for df, added in ((mixing.interleave(wide), mixing.ADDED), (packing.pack(wide), packing.ADDED)):
        rows = df.collect()
        assert len(rows) == docs.count() and df.columns == [c for c in wide.columns if c not in added] + list(added)
        assert all(r[c] == f"own {c}" for r in rows for c in names if c not in added)
    assert mixing.mix(wide).columns == wide.columns and all(r[c] == f"own {c}" for r in mixing.mix(wide).collect() for c in names)
    filters = langid.learn(wide.selectExpr("text", "'en' as lang"), Scratch(spark, "t"))
    found = langid.identify(wide, filters, wide.columns)
    assert all(r[c] == f"own {c}" for r in found.collect() for c in names if c not in langid.ADDED) and all(isinstance(r.score, float) for r in found.collect())
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = p.run(spark, str(tmp_path))
    left = [c for c in names if c in out.columns and c not in (*packing.ADDED, "mix_slot")]
    assert len(left) == len(names) - 4 and all(r[c] == f"own {c}" for r in out.collect() for c in left)


def test_empty_tables(spark, empty, tmp_path):
    import corpus_pipeline as p

    assert packing.pack(empty).collect() == [] and packing.pack(empty.withColumns({"mix_slot": F.lit(1), "mix_pos": F.lit(1)}), mixed=True).collect() == []
    assert ngram_join.ngram_components(empty).collect() == [] and ngram_join.deduplicate(empty).collect() == []
    assert langid.identify(empty, None, ["doc_id"]).collect() == [] and quality.classify(empty, empty.selectExpr("doc_id", "n as y")).collect() == []
    assert rules.judge(empty).collect() == [] and lm.score(empty, F.lit(True)).collect() == []
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []


def test_mixing_packed_in_order(spark):
    import corpus_pipeline as p

    rows = [(i, " ".join(["w"] * (i % 7 * 40 + 1)) + "x" * 900, f"s{i % 3}") for i in range(3000)] + [(3000, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = p.mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns
    got = p.packing_stage(spark, mixed, "").collect()
    assert sorted(r.doc_id for r in got) == list(range(3001)) and max(r.mix_slot for r in got) > 2 * packing.STRETCH
    by = {}
    for r in got:
        by.setdefault(r.bucket, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (r.mix_slot, r.mix_pos))
        room = max(1, 65_536 // own[0].padded_to)
        assert [r.batch * room + r.batch_row for r in own] == list(range(len(own)))


def test_boundaries():
    rng = random.Random(4)
    for _ in range(20):
        lens = sorted(rng.sample(range(1, 40), 7))
        counts = [rng.randint(1, 9) for _ in lens]
        for b in (1, 2, 3, 7, 9):
            best = min(
                sum(c * (min(x for x in cut if x >= n) - n) for n, c in zip(lens, counts, strict=True))
                for k in range(1, min(b, 7) + 1)
                for cut in itertools.combinations(lens, k)
                if cut[-1] == lens[-1]
            )
            bounds, cost = packing.boundaries(lens, counts, b)
            assert cost == best and len(bounds) <= b and bounds[-1] == lens[-1]


def test_long_lengths_are_bins_of_their_own(spark):
    rng = random.Random(12)
    lens = sorted(rng.sample(range(2049, 2065), 12))
    counts = [rng.randint(1, 5) for _ in lens]
    cost = lambda i, j: sum(c * (lens[j - 1] - n) for n, c in zip(lens[i:j], counts[i:j], strict=True))
    best = [0] + [10**9] * len(lens)
    for _ in range(4):
        best = [min([best[j], *[best[i] + cost(i, j) for i in range(j)]]) for j in range(len(lens) + 1)]
    rows = [(k, n) for k, n in enumerate(n for n, c in zip(lens, counts, strict=True) for _ in range(c))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), buckets=4, tokens=F.col("n")).collect()
    assert len(got) == len(rows) and sum(r.padded_to - r.n_tokens for r in got) == best[-1]


def test_packing(docs, empty):
    rows = packing.pack(docs, budget=300, buckets=4).collect()
    assert len(rows) == docs.count()
    full = Counter((r.bucket, r.batch) for r in rows)
    for r in rows:
        assert r.n_tokens == len(words(r.text)) + 1 <= r.padded_to
        assert full[r.bucket, r.batch] <= max(1, 300 // r.padded_to)
    assert len({(r.bucket, r.batch, r.batch_row) for r in rows}) == len(rows)
    for b in {r.bucket for r in rows}:
        batches = sorted(k[1] for k in full if k[0] == b)
        assert batches == list(range(len(batches)))
    assert packing.pack(empty).collect() == []


def test_language(spark):
    rng = random.Random(6)
    vocab = {"en": ["the", "shing", "thorn", "weather"], "de": ["über", "schach", "enkeit", "zwölf"], "es": ["ñandú", "ciónes", "llave", "arroz"]}
    rows = [(i, " ".join(rng.choice(vocab[g]) for _ in range(rng.randint(3, 40))), g) for i, g in enumerate(rng.choices(list(vocab), k=200))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn(df.where("doc_id < 150"), Scratch(spark, "t"))
    odd = spark.createDataFrame([(900, None, "en"), (901, "", "en"), (902, "12 !? \n", "en"), (903, "z", None), (904, "über " * 40000, "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df.unionByName(odd), filters, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[904].lang_pred == "de" and got[903].lang_pred in vocab
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.learn(df.where("false"), Scratch(spark, "t")) is None
    assert {r.lang_pred for r in langid.identify(df.limit(3), None, ["doc_id"]).collect()} == {"und"}


def test_quality(spark, docs, empty):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        w = [rng.choice(WORDS) for _ in range(rng.randint(30, 90))]
        rows.append((i, " ".join(w) + "." if i % 3 else "!! ".join(w).upper(), int(i % 3 > 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    got = {r.doc_id: r for r in quality.classify(df, df.where("doc_id < 160").select("doc_id", "y")).collect()}
    assert all(got[i].predicted == y for i, _, y in rows)
    out = quality.classify(docs, df.select("doc_id", "y"))
    assert out.count() == docs.count() and out.where("not score between 0 and 1 or score is null").count() == 0
    assert quality.classify(empty, df.select("doc_id", "y")).count() == 0
    assert {r.score for r in quality.classify(docs, df.where("false").select("doc_id", "y")).collect()} == {0.5}
    assert {r.score for r in quality.classify(docs, df.where("y = 1").select("doc_id", "y")).collect()} == {1.0}


def test_isotonic():
    at, p = quality.pool(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1, 1, 2, 1]), np.array([1, 0, 1, 1]))
    assert p.tolist() == [0.5, 1.0] and at[0] == pytest.approx(0.225)


def test_rules(docs, empty):
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    for r in docs.collect():
        w, g = words(r.text), got[r.doc_id]
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(covered))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (g.base_failed and g.kept) and 0 <= g.posterior <= 1
    assert rules.judge(empty).count() == 0


def test_chat(spark):
    call = lambda i, a, name="add": {"id": i, "name": name, "arguments": a}
    rows = [
        (1, 0, "user", "hi {"),
        (1, 1, "assistant", json.dumps({"content": "c", "tool_calls": [call("a", {"y": 2, "x": 1}), {"id": "b", "function": {"name": "add", "arguments": '{"x": "no", "y": 1}'}}]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "B"})),
        (1, 0, "tool", json.dumps({"tool_call_id": "a", "content": "A"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (1, 5, "assistant", json.dumps({"tool_calls": [call("a", {"x": 1})]})),
        (2, 0, None, None),
        (2, 1, "assistant", "{not json"),
        (2, 1, "assistant", "{not json"),
    ]
    tools = {"add": {"required": ["x", "y"], "properties": {"x": {"type": "integer"}, "y": {"type": ["integer", "null"]}}}}
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2), tools).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_rank, r.order_pos))
    assert [(r.turn, r.kind) for r in one] == [(0, "message"), (1, "call"), (0, "result"), (3, "result"), (4, "orphan"), (5, "call")]
    made = json.loads(one[1].message)
    assert list(made) == ["content", "role", "tool_calls"] and made["tool_calls"][0]["arguments"] == '{"x":1,"y":2}'
    assert (one[1].n_calls, one[1].n_answered, one[1].args_valid) == (2, 2, False)
    assert (one[5].n_repeated, one[5].n_answered, one[5].args_valid) == (1, 0, False)
    assert json.loads(one[2].message) == {"content": "A", "role": "tool", "tool_call_id": "a"} and one[2].call_turn == 1
    two = [r for r in got if r.conv_id == 2]
    assert sorted(r.message for r in two) == ['{"content":"{not json","role":"assistant"}'] * 2 + ["{}"]
    ok = chat.link(spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": [call("a", {"x": 1, "y": None})]}))], "conv_id long, turn long, role string, text string"), tools)
    assert ok.first().args_valid
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_schemas_and_fields(spark):
    nested = {"type": "object", "properties": {"k": {"type": "string", "pattern": "^a\\d+$", "maxLength": 3}}, "required": ["k"], "additionalProperties": False}
    schema = {"type": "object", "properties": {"u": {"enum": ["C", "F", 2]}, "n": {"type": "integer", "minimum": 1, "exclusiveMaximum": 5}, "o": nested, "l": {"type": "array", "items": {"type": "number"}, "maxItems": 2}, 'q"\'': {"const": None}}, "additionalProperties": {"type": "boolean"}}
    good = [{}, {"u": "C"}, {"u": 2.0}, {"n": 4}, {"n": 1.0}, {"o": {"k": "a12"}}, {"l": [1, 2.5]}, {"l": []}, {"more": True}, {'q"\'': None}]
    bad = [{"u": "K"}, {"u": "2"}, {"n": 0}, {"n": 5}, {"n": 1.5}, {"n": None}, {"o": {}}, {"o": {"k": "b1"}}, {"o": {"k": "a123"}}, {"o": {"k": "a1", "z": 1}}, {"l": [1, "x"]}, {"l": [1, 2, 3]}, {"more": 1}, {'q"\'': 1}]
    turn = lambda i, a: (i, 0, "assistant", "\n\t" + json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": a}], "name": "é", "b": {"y": 1, "x": [None]}}))
    rows = [turn(i, a) for i, a in enumerate(good + bad)] + [(0, 1, "tool", '\r\n{"tool_call_id": "a", "content": "A", "status": "ok", "tool_calls": 3}')]
    fields = "conv_id long, turn long, role string, text string"
    got = chat.link(spark.createDataFrame(rows, fields), {"f": schema}).collect()
    assert {r.conv_id: r.args_valid for r in got if r.turn == 0} == {i: i < len(good) for i in range(len(good + bad))}
    first, result = sorted((r for r in got if r.conv_id == 0), key=lambda r: r.turn)
    assert first.kind == "call" and first.message == '{"b":{"x":[null],"y":1},"name":"é","role":"assistant","tool_calls":[{"arguments":"{}","id":"a","name":"f"}]}'
    assert result.kind == "result" and json.loads(result.message) == {"content": "A", "role": "tool", "status": "ok", "tool_call_id": "a", "tool_calls": 3}
    with pytest.raises(ValueError, match="multipleOf"):
        chat.link(spark.createDataFrame(rows, fields), {"f": {"properties": {"n": {"multipleOf": 2}}}})


def test_chat_tools_are_declared_in_the_conversation(spark, tmp_path, monkeypatch):
    from tessera.llm import queries

    monkeypatch.setattr(chat, "SCHEMAS", 3)
    schema = lambda i: {"type": "object", "properties": {"x": {"type": "integer", "minimum": i}}, "required": ["x"]}
    call = lambda a, name="f": json.dumps({"tool_calls": [{"id": "a", "name": name, "arguments": a}]})
    rows, want = [], {}
    for i in range(400):
        tool = {"name": "f", "parameters": schema(i % 20)}
        rows += [(i, 0, "system", json.dumps({"content": "c", "tools": [{"type": "function", "function": tool} if i % 2 else tool, {"name": "free"}]}))]
        rows += [(i, 1, "assistant", call({"x": i % 7 * 4})), (i, 2, "assistant", call(json.dumps({"x": "no"}))), (i, 3, "assistant", call({"x": "no"}, "free")), (i, 4, "assistant", call([1], "other"))]
        want |= {(i, 0): None, (i, 1): i % 7 * 4 >= i % 20, (i, 2): False, (i, 3): True, (i, 4): False}
    odd = [{"$ref": "#"}, {"pattern": "("}, {"type": "thing"}, {"properties": 3}, {"minimum": "x"}, {"anyOf": []}, 7, None, {"maximum": 10**400}]
    odd.append(True)
    for _ in range(40):
        odd[-1] = {"items": odd[-1]}
    for i, s in enumerate(odd, 1000):
        rows += [(i, 0, "developer", json.dumps({"tools": [{"name": "f", "parameters": s}]})), (i, 1, "assistant", call({"x": 1})), (i, 2, "assistant", call(3))]
        want |= {(i, 0): None, (i, 1): None if s is not None else True, (i, 2): None if s is not None else False}
    # the first declaration holds; others' words declare nothing
    rows += [(2000, 0, "user", json.dumps({"tools": [{"name": "f", "parameters": schema(9)}]})), (2000, 3, "system", json.dumps({"tools": [{"name": "f", "parameters": schema(5)}]}))]
    rows += [(2000, 1, "system", json.dumps({"tools": [{"name": "f", "parameters": schema(2)}]})), (2000, 4, "assistant", call({"x": 3})), (2000, 5, "assistant", call({"x": 1}))]
    want |= {(2000, 0): None, (2000, 3): None, (2000, 1): None, (2000, 4): True, (2000, 5): False}
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op9_chat(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {(r.conv_id, r.turn): r.args_valid for r in got} == want
    assert all(r.kind == ("call" if r.role == "assistant" else "message") for r in got)
    assert all(json.loads(r.message) == {"content": t, "role": o} for r in got if r.kind == "message" for c, n, o, t in rows if (c, n) == (r.conv_id, r.turn))


def test_warc(spark, monkeypatch):
    rows = [(i, f"http://User@B{i % 3}.Example.org:80/p/{i % 10}?q#f", f"<p>é{i % 4}</p>") for i in range(40)]
    rows += [(40, None, None), (41, "x", ""), (42, "http://a/ b", "big" * 100000), (None, "http://n/", "<p>é1</p>"), (7, "http://seven/", "<p>é3</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1)).repartition(3)
    found = warc.archive(pages, block=7)
    got = found.read(payloads=True).collect()
    assert len(got) == len(rows)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == warc.digest(html.encode())
        want = None if r.page_id == least[html] else least[html]
        assert (r.record_type, r.refers_to) == ("response" if want is None else "revisit", want)
        assert bytes(r.payload) == (html.encode() if want is None else b"")
    hits = found.lookup("https://b1.example.org:80/p/4?q")
    assert [r["page_id"] for r in hits] == [4, 34] and list(found.lookup("http://none/")) == []
    every = lambda df: sorted((r.page_id or -1, r.url, r.payload_digest, r.record_type, r.refers_to or -1) for r in df.collect())
    assert every(found.find(pages.select("url"))) == every(found.read())
    assert [r.page_id for r in found.find(spark.createDataFrame([("http://b0.example.org:80/p/0?q",), ("http://b0.example.org:80/p/0?q",), ("zzz",)], "url string")).orderBy("page_id").collect()] == [0, 30]
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 2)
    assert every(warc.archive(pages, block=7).read()) == every(found.read())
    monkeypatch.setattr(warc, "MOST_BLOCKS", 3)
    assert warc.archive(pages, block=7).directory.agg(F.min("n")).first()[0] is not None and every(warc.archive(pages, block=7).find(pages)) == every(found.read())
    assert all(r.record_type == "response" for r in warc.archive(pages, min_bytes=10**6).read().collect())
    assert warc.archive(pages.limit(0)).read().collect() == [] and warc.archive(pages.limit(0)).find(pages).collect() == []


def test_warc_records():
    data = warc.record(7, "http://a/", b"x", warc.digest(b"x"), 3, "http://b/")
    text = warc.gzip.decompress(data).decode()
    assert f"WARC-Refers-To: {warc.record_id(3, warc.digest(b'x'), 'http://b/')}" in text and "WARC-Refers-To-Target-URI: http://b/" in text and "WARC-Type: revisit" in text
    assert warc.gzip.decompress(warc.info("f")).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_captures_of_one_url_fill_many_blocks(spark):
    rows = [(i, "http://hot/", f"{i % 50}") for i in range(300)] + [(1000 + i, f"http://h{i}/", "z") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = warc.archive(pages, block=10)
    assert [r["page_id"] for r in found.lookup("http://hot/")] == list(range(300))
    got = found.find(pages.select("url"))
    assert sorted(r.page_id for r in got.collect()) == sorted(i for i, _, _ in rows)
    assert got.where("url = 'http://hot/'").select(F.spark_partition_id()).distinct().count() > 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(8)
    rows = []
    for i in range(300):
        w = [rng.choice(["the", "thing", "weather", "sharing", "other", "nothing"]) + rng.choice("abcdefgh") for _ in range(rng.randint(40, 90))]
        rows.append((i, " ".join(w) + "." if i % 5 else "%%% ".join(w), "en", f"s{i % 3}", 0))
    rows += [(300 + i, rows[i + 1][1], "en", "s0", 0) for i in range(0, 20, 5)] + [(400, None, None, None, None), (401, "12 34", "en", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id for r in p.quality_stage(spark, docs, str(tmp_path)).collect()}
    assert len({i for i in range(300) if i % 5} & left) >= 235 and len({i for i in range(300) if i % 5 == 0} & left) <= 6
    out = p.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert len(ids) == len(out) and not ids & {300, 305, 310, 315, 400, 401} and ids <= left
    assert [n for n, _ in p.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "mixing sources", "packing"]


def test_quality_stage_judges_rows(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(9)
    text = lambda i: ("" if i % 5 else "%%% ").join(rng.choice(["the ", "thing ", "weather ", "other "]) for _ in range(60))
    rows = [(i, text(i), "en", "s0", 0) for i in range(250)]
    rows += [(1000, text(1), "good", "s0", 0), (1000, text(0), "bad", "s0", 0), (None, text(1), "good", "s0", 0), (None, text(0), "bad", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = p.quality_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.lang) for r in out.where("doc_id is null or doc_id >= 1000").collect()) == [(0, "good"), (1000, "good")]


def test_rows_after_each_stage(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(10)
    vocab = {"en": ["the", "thing", "weather", "other"], "de": ["über", "schach", "enkeit", "zwölf"]}
    rows = []
    for i in range(300):
        g = "de" if i % 3 == 0 else "en"
        w = [rng.choice(vocab[g]) + rng.choice("abcdefgh") for _ in range(rng.randint(40, 90))]
        rows.append((i, " ".join(w) + "." if i % 5 else "%%% ".join(w), g, f"s{i % 4}"))
    for i in range(0, 60, 2):
        w = rows[i + 1][1].split(" ")
        w[len(w) // 2] = "edit" if i % 4 else w[len(w) // 2]
        rows.append((300 + i, " ".join(w), "en", "s9"))
    rows += [(1000 + i, " ".join("".join(rng.choice("jqxzkvw") for _ in range(rng.randint(3, 8))) for _ in range(60)) + ".", None, "s1") for i in range(20)]
    rows += [(2000, "12 34", "en", None), (2001, None, "en", "s1"), (2002, "", None, "s2")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0

    def grams(text):
        b = b" " + bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 else 32 for x in text.encode()) + b" "
        return [b[k : k + 4] for k in range(len(b) - 3) if sum(x != 32 for x in b[k : k + 4]) >= 2]

    def quality_(docs):
        labels = spark.read.parquet(f"{tmp_path}/labels.parquet").selectExpr("doc_id", "quality as y").where(~langid.held_out("doc_id", 5))
        return {r.doc_id for r in quality.classify(spark.createDataFrame(docs), labels).collect() if r.predicted}

    def language(docs):
        count = {}
        for r in docs:
            if r.text is not None and r.lang is not None and not held(r.doc_id):
                count.setdefault(r.lang, Counter()).update(grams(r.text))
        rate = {g: {x: m / sum(c.values()) for x, m in c.items()} for g, c in count.items()}
        most = lambda x: max(c.get(x, 0) for c in rate.values())
        known = {g: {x for x, m in c.items() if m >= langid.MIN_COUNT and rate[g][x] >= langid.MIN_RATE * most(x)} for g, c in count.items()}
        share = {r.doc_id: max(sum(x in k for x in own) / len(own) for k in known.values()) if (own := grams(r.text or "")) else 0 for r in docs}
        assert all(abs(s - p.LEAST_SHARE) > 0.1 for s in share.values())
        return {i for i, s in share.items() if s >= p.LEAST_SHARE}

    def dedup(docs):
        sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in docs for w in [words(r.text.translate(LOWER))]}
        pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        return {i for i, c in closure(sorted(sets), pairs).items() if i == c}

    want = [quality_, language, dedup, lambda docs: {r.doc_id for r in docs}, lambda docs: {r.doc_id for r in docs}]
    docs, scratch, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), Scratch(spark, "stages"), []
    for (name, stage), brute in zip(p.STAGES, want, strict=True):
        before = docs.collect()
        docs = scratch.save(stage(spark, docs, str(tmp_path)), name.split()[0])
        got = [r.doc_id for r in docs.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(before), name
        left.append(len(got))
    assert len(rows) > left[0] > left[1] > left[2] == left[3] == left[4]
    run = p.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in run) == sorted(got) and all(r.n_tokens == len(words(r.text)) + 1 for r in run)
