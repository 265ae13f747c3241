"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each whole text are standardised with their means and deviations
over all documents, and mapped to ``FEATURES`` random cosines whose inner
products approximate a Gaussian kernel. Each partition sums its labelled rows'
normal equations; the sums are added in two levels, so that the driver gets
``SUMS`` matrices of fixed size, and one solve gives the ridge scores. Scores
of the labelled rows, in ``BINS`` bins, are pooled until they rise with the
share of good labels (isotonic regression), which calibrates them to 0..1.

Defined cases: null and empty texts have all-zero statistics and are scored
like any other; rows without a label teach nothing; a doc_id with several
labels teaches each; with no label, or one class only, the score is that
class's share (0.5 without any). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm import _text
from tessera.llm._runtime import Scratch, list_parts, lists, pieces

FEATURES, WIDTH, RIDGE, BINS, SUMS = 256, 4.0, 1.0, 1000, 8
STATS = ["words", "word_bytes", "upper", "digit", "symbol", "mark", "end", "high", "lines", "dup_lines", "distinct", "top", "repeats", "short", "long", "numeric"]


def _classes() -> np.ndarray:
    out = np.zeros((7, 256), np.uint8)
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"\"'()+,-/:;=@[]^_`{}~\\", b".!?")):
        out[i, list(chars)] = 1
    out[5, 128:] = 1
    out[6, 10] = 1
    return out


_CLASS = _classes()


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents x STATS, each a ratio or a logarithm."""
    n = len(offs) - 1
    out = np.zeros((n, len(STATS)))
    size = np.maximum(np.diff(offs), 1)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    kinds = np.zeros((7, n))
    for i in range(7):
        if len(full):
            kinds[i, full] = np.add.reduceat(_CLASS[i][data], offs[:-1][full], dtype=np.int64)
    starts, ends, first = _text.words(data, offs)
    lens, count = ends - starts, np.diff(first)
    some = np.maximum(count, 1)
    low = _text.LOWER[data]
    hashes = _text.hash_spans(low, starts, ends)
    tri, tri_offs = _text.shingles(hashes, first, 3)
    # lines: spans between newlines, within documents
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10), offs[1:]])) if len(data) else offs[1:]
    begin = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offs[:-1]]))
    begin = begin[begin < len(data)]
    finish = cut[np.searchsorted(cut, begin)] if len(begin) else begin
    wordy = np.searchsorted(starts, finish) > np.searchsorted(starts, begin)
    begin, finish = begin[wordy], finish[wordy]
    line = _text.hash_spans(low, begin, finish)
    line_first = np.searchsorted(begin, offs)
    short = np.append(0, np.cumsum(lens <= 2))
    long = np.append(0, np.cumsum(lens > 14))
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b > a:
            _, c = np.unique(hashes[a:b], return_counts=True)
            out[d, 10], out[d, 11] = len(c) / (b - a), c.max() / (b - a)
            t = tri[tri_offs[d] : tri_offs[d + 1]]
            out[d, 12] = 1 - len(np.unique(t)) / len(t)
        a, b = line_first[d], line_first[d + 1]
        if b > a + 1:
            out[d, 9] = 1 - len(np.unique(line[a:b])) / (b - a)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.log1p((np.append(0, np.cumsum(lens))[first[1:]] - np.append(0, np.cumsum(lens))[first[:-1]]) / some)
    out[:, 2], out[:, 3] = kinds[0] / size, kinds[1] / size
    out[:, 4], out[:, 5], out[:, 6] = (np.sqrt(np.minimum(kinds[i] / some, 4)) for i in (2, 3, 4))
    out[:, 7] = kinds[5] / size
    out[:, 8] = np.log1p(kinds[6])
    out[:, 13] = (short[first[1:]] - short[first[:-1]]) / some
    out[:, 14] = (long[first[1:]] - long[first[:-1]]) / some
    out[:, 15] = (kinds[1] > 0) * np.log1p(kinds[1] / some)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offs in pieces(batch, "text"):
            x = statistics(data, offs)
            found = [rows.column("doc_id").cast(pa.int64()), lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())]
            yield pa.RecordBatch.from_arrays([*found, *rows.columns[2:]], ["doc_id", "x", *rows.schema.names[2:]])


def _schema(fields: str, table: DataFrame) -> StructType:
    """``fields``, and the struct ``row`` if ``table`` carries one."""
    return StructType([*StructType.fromDDL(fields).fields, *[f for f in table.schema.fields if f.name == "row"]])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, x) for each row; with ``keep``, also these columns of it as a struct ``row``."""
    row = [F.struct(*keep).alias("row")] if keep else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)
    return rows.mapInArrow(_scan, _schema("doc_id long, x array<double>", rows))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    flat, _ = list_parts(batch.column("x"))
    return flat.reshape(-1, len(STATS))


class Model:
    """Standardisation, random cosines, ridge weights and the calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta: np.ndarray | None = None
        self.at, self.p = np.zeros(1), np.full(1, 0.5)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(x) @ self.beta, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None or not len(x):
            return np.full(len(x), self.p[0])
        return np.clip(np.interp(self.raw(x), self.at, self.p), 0, 1)


def pool(at: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: places in ascending order and the rising shares there (pool adjacent violators)."""
    parts: list[list[float]] = []
    for a, m, g in zip(at, n, good, strict=True):
        parts.append([float(a) * m, float(m), float(g)])
        while len(parts) > 1 and parts[-2][2] * parts[-1][1] >= parts[-1][2] * parts[-2][1]:
            last = parts.pop()
            parts[-1] = [x + y for x, y in zip(parts[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in parts]), np.array([p[2] / p[1] for p in parts])


def fit(table: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """A model from features (doc_id, x) and the training labels (doc_id, y)."""
    k = len(STATS)
    stats = table.select(*[F.col("x")[i].alias(f"x{i}") for i in range(k)])
    row = stats.agg(*[f(f"x{i}") for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = (np.array([v or 0.0 for v in row[j::2]]) for j in (0, 1))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), seed)
    known = table.join(labels.where("y is not null and doc_id is not null"), "doc_id").select("x", F.col("y").cast("double").alias("y"))
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((size + 1, size)), 0
        for batch in batches:
            x, y = _rows(batch), batch.column("y").to_numpy()
            for i in range(0, len(y), 4096):
                z = model.cosines(x[i : i + 4096])
                total[:size] += z.T @ z
                total[size] += y[i : i + 4096] @ z
                part = (part * 31 + int(abs(z).sum() * 1e6)) % SUMS
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1) * size)
        for batch in batches:
            for m in batch.column("m"):
                total += np.frombuffer(m.as_buffer())
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    level = known.mapInArrow(sums, "part int, m binary").repartition(SUMS, "part").mapInArrow(add, "m binary")
    found = [np.frombuffer(r["m"]).reshape(size + 1, size) for r in level.collect()]
    if not found:
        return model
    total = np.sum(found, 0)
    n, good = total[size - 1, size - 1], total[size, size - 1]
    if good <= 0 or good >= n:
        model.p = np.full(1, good / n)
        return model
    model.beta = np.linalg.solve(total[:size] + RIDGE * np.eye(size), total[size])
    calibrate = model

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = calibrate.raw(_rows(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(s * BINS / 2).astype(np.int32)), pa.array(s), batch.column("y")], ["bin", "s", "y"])

    bins = known.mapInArrow(scored, "bin int, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    model.at, model.p = pool(*(np.array([r[c] for r in bins], float) for c in ("s", "n", "y")))
    return model


def apply(table: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each feature row, with its struct ``row`` if it has one."""
    fields = _schema("doc_id long, score double, predicted int", table)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_rows(batch)) if batch.num_rows else np.zeros(0)
            row = [batch.column("row")] if "row" in batch.schema.names else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *row], fields.names)

    return table.mapInArrow(scored, fields)


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``, learnt from ``labels`` (doc_id, y)."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    table = scratch.save(features(docs), "features")
    return apply(table, fit(table, labels))
