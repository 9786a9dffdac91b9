"""Helpers that the training-data operators share.

Tables that cut lineage are written as Parquet to the folder that the session
names in ``spark.checkpoint.dir``; executors may be lost at any time without
losing them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Freed Arrow buffers go back to the system, so that workers that live on stay small.
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of text that one numpy step works on; bounds the memory of a task.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one where it is unset."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = "file://" + tempfile.mkdtemp(prefix="prosemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table goes away when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def sliced(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about ``limit`` bytes together; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``step`` to slices of ``df``, whose last column is the text."""
    last = len(df.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, last):
                out = step(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def binary_lists(values: np.ndarray, ends: np.ndarray, width: int) -> pa.Array:
    """A binary column whose row i holds the ``width``-byte items of ``values`` between ends[i-1] and ends[i]."""
    offsets = np.concatenate(([0], ends)).astype(np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Least label that each node reaches over undirected links.

    ``nodes`` has (id long); ``links`` has (a long, b long) between ids. Returns
    (id, label). Labels fall to the least of the neighbours' labels and then
    jump along label chains, so the rounds grow with the logarithm of the
    longest path. Each round is a written table.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-links")
    touched = both.select(F.col("a").alias("id")).distinct()
    labels = stored(touched.join(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")), "id").select("id", F.least("id", "m").alias("label")), f"{name}-labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        )
        low = labels.join(near, "id").select("id", "label", F.least("label", "l").alias("low"))
        jumped = low.join(labels.select(F.col("id").alias("low"), F.col("label").alias("jump")), "low", "left")
        moved = stored(jumped.select("id", F.least("low", F.coalesce("jump", "low")).alias("label"), (F.least("low", F.coalesce("jump", "low")) < F.col("label")).alias("moved")), f"{name}-labels")
        done = moved.where("moved").limit(1).count() == 0
        labels = moved.select("id", "label")
        if done:
            return nodes.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
