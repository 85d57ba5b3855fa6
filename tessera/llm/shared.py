"""Helpers shared by the training-data operators: written tables, id handling, group streaming."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside operators, so that null keys survive equi-joins; mapped back on output.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session that has none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nobody else uses; removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Best effort: the context may have ended already."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  shutdown order is not ours
        return


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, which outlives any executor."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables. Only for tables whose every reader has itself been written: no task can ask for them again."""
    for t in tables:
        remove(t.sparkSession, t._written_to)


class Flags:
    """Flags of hashed keys, decided where rows are read: no false negatives, so unset rows need no join and no shuffle.

    There are 8 to 16 flags a key, 2**27 (16 MB) at the most, so what is broadcast is bounded whatever the input; beyond
    that, more rows are flagged in vain, and the join behind the flags still decides.
    """

    def __init__(self, rows: DataFrame, *keys: str):
        self.keys, self.bits = keys, min(27, max(16, 4 + rows.count().bit_length()))
        at = rows.select(F.pmod(F.xxhash64(*keys), F.lit(1 << self.bits)).alias("h"))
        words = at.groupBy(F.shiftright("h", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 32 AS INT))")).alias("v")).toArrow()
        flags = np.zeros(1 << (self.bits - 5), np.uint32)
        flags[words.column("w").to_numpy()] = words.column("v").to_numpy().astype(np.uint32)
        self.shared: Broadcast = rows.sparkSession.sparkContext.broadcast(flags)

    def on(self) -> Column:
        """Whether a row's keys, columns of the same names, may be among the flagged ones. Only their hash goes to Python."""
        shared = self.shared

        @F.pandas_udf("boolean")
        def flagged(h: pd.Series) -> pd.Series:
            at = h.to_numpy()
            return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))

        return flagged(F.pmod(F.xxhash64(*self.keys), F.lit(1 << self.bits)))


def long_id(name: str) -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, over arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], target: int = 8192) -> Iterator[pa.Table]:
    """Tables that hold whole groups only, from batches sorted by the integer columns keys.

    At most one unfinished group is carried over, so memory is bounded by target rows plus the largest group.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group begins in a table sorted by keys."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, target: int = 8192) -> DataFrame:
    """Runs fn over tables of whole groups. Groups must be bounded by the caller (see tiles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, target):
            yield from fn(table)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the undirected edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label
