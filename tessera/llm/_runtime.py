"""Shared plumbing: materialised stages, size-checked broadcasts, Arrow access.

Stages that are read more than once, or that would otherwise leave a long
lineage behind, are written as Parquet below the folder in
``spark.checkpoint.dir``; every executor and the driver share that folder, so
a lost executor costs a task retry and never a recomputation of the whole job.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a long key that may be broadcast, some 32 bytes each; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000
#: A key with more rows than both HOT_ROWS and a HOT_KEYS-th of all is joined without a shuffle.
HOT_ROWS, HOT_KEYS = 512, 100_000
#: Seconds between the two collections that free shuffle files.
CLEANING_S = 0.2


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; one of our own only if it is unset and all runs in this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables of one operator run, deleted when the session ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back from the files."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished writes now, rather than at its next collection.

        One collection does not do: what it lets Spark's cleaning thread drop still holds them. The second frees them.
        """
        jvm = self.spark.sparkContext._jvm
        jvm.System.gc()
        time.sleep(CLEANING_S)
        jvm.System.gc()

    def drop(self, name: str) -> None:
        """Delete a table that no later stage reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        for found in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
            if (name := found.getPath().getName()) not in names:
                self.drop(name)


def keep_keys(df: DataFrame, keys: DataFrame, on: str, n_keys: int) -> DataFrame:
    """Semi-join on a long key; ``keys`` is broadcast only if few enough.

    ``n_keys`` is the counted number of rows of ``keys``. Above the bound both
    sides are shuffled on the key, which needs no memory that grows.
    """
    side = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys.hint("merge")
    return df.join(side, on, "left_semi")


def join_counted(big: DataFrame, small: DataFrame, on: list[str], n: str, total: int, most: int | None = None) -> DataFrame:
    """Inner join on keys of any skew. ``small`` has one row for each key, and in ``n`` how many rows ``big`` has of it.

    Keys with more than max(HOT_ROWS, total / HOT_KEYS) of the ``total`` rows
    are joined by broadcast, so that their rows stay spread as they are; there
    are at most HOT_KEYS of them. All others are shuffled. ``most`` is the
    largest count, where it is known: if no key has so many, none is joined apart.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    if (total if most is None else most) <= least:
        return big.join(small, on)
    hot, cold = small.where(F.col(n) > least), small.where(F.col(n) <= least)
    spread = big.join(F.broadcast(hot), on)
    return spread.unionByName(big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null reads as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    _, offs, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``most`` bytes of text each, whole rows only."""
    data, offs = utf8(batch.column(text))
    n, at = batch.num_rows, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def lists(flat: np.ndarray, sizes: np.ndarray, type_: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the size of each list."""
    offs = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, type_))


def list_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat int64 values and n+1 offsets of a list column without nulls."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = arr.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = arr.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]] if len(offs) else arr.values.to_numpy()
    return flat, offs - offs[0]
