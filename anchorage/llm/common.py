"""Helpers that the corpus operators share: shared files, code shipping, bounded filters."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session settings of every operator: small Arrow batches keep Python workers within memory,
#: and an action's shuffle files go when it ends (what is read again is written as a table).
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.maxPlanStringLength": "65536",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS and send this package to the executors once per application."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    sc: SparkContext = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        handle, name = tempfile.mkstemp(prefix="anchorage-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        sc.addPyFile(name)
        _SHIPPED.add(sc.applicationId)
    return spark


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster must name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="anchorage-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files all executors see."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def release(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for frames whose readers have all been written out themselves."""
    for frame in frames:
        sc = frame.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def parallelism(spark: SparkSession) -> int:
    """The cluster's shuffle width, which its owner sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bitmap_of(keys: DataFrame, column: str, log2_bits: int = 23) -> np.ndarray:
    """A bit per slot (low bits) of the already uniform BIGINT ``column``: 2**log2_bits / 64 words.

    Its size is fixed (1 MB by default) whatever the number of keys, so it can go to every task. A
    set bit means "perhaps present": callers follow it with an exact join.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    rows = (
        keys.select(slot.alias("s"))
        .groupBy(F.shiftright("s", 6).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("mask"))
        .collect()  # at most 2**log2_bits / 64 rows
    )
    words = np.zeros((1 << log2_bits) // 64, dtype=np.uint64)
    for row in rows:
        words[row["word"]] = row["mask"] & 0xFFFFFFFFFFFFFFFF
    return words


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys have their bit set."""
    slot = keys.astype(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_mod(column, n: int):
    """Unsigned crc32 of the id written as text, modulo n: the held-out folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
