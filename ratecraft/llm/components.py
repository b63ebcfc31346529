"""Tables cut from lineage, and connected components, for operators that go in rounds."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast, and edges that one task may join; both are counted first.
SMALL = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine only where none is set and all runs in one process, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="ratecraft-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


class Scratch:
    """Tables written to the shared folder, each read by later steps; drop() removes them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def small(self, df: DataFrame) -> DataFrame:
        """A kept table with the hint to broadcast it, if it has few enough rows."""
        return F.broadcast(df) if df.count() <= SMALL else df

    def keep(self, df: DataFrame, few: bool = False) -> DataFrame:
        """The frame, written and read again; ``few`` for tables that are small beside the input: a quarter of the shuffle partitions, or four files a core."""
        self.n += 1
        schema = df.schema
        if few:
            df = df.coalesce(max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4))
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        # Shuffle files go when the driver's collector finds their plans unreachable.
        del df
        gc.collect()
        self.spark._jvm.System.gc()
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes the tables of these frames, or all of them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in [f._scratch_path for f in frames] or [self.top]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def bit_map(values: DataFrame, bits: int) -> np.ndarray:
    """2**bits packed bits, set at the values of the frame's one column; its size doesn't depend on the input."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(seen).tobytes(), 1)], pa.binary())], ["m"])

    out = np.zeros(1 << bits >> 3, np.uint8)
    # At most so many maps come to the driver, one after the other.
    for r in values.coalesce(64).mapInArrow(pack, "m binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(bytes(r.m)), np.uint8)
    return out


def bits_at(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether bits of a map are set."""
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _joined(edges: DataFrame) -> DataFrame:
    """Components of a counted, small number of edges in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        u = np.fromiter(root, np.int64, len(root))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array([find(x) for x in u.tolist()], pa.int64())], ["u", "root"])

    return edges.coalesce(1).mapInArrow(run, "u long, root long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, root) of every vertex of the undirected edges (u, v); root is the least vertex reachable.

    At most SMALL edges are joined in one task.  More go through large-star and small-star steps until nothing changes.  Each step is an
    aggregation by vertex; a vertex of many edges sends them on, and none is gathered.
    """
    def mark(f: DataFrame) -> tuple:
        """Two sets of edges are the same when neither size nor sum of hashes differ."""
        return tuple(f.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), few=True)
    before = mark(now)
    if before[0] <= SMALL:
        return _joined(now.select("u", "v"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of a vertex join the least of its neighbourhood
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.keep(large, few=True)
        # small star: smaller neighbours, and the vertex, join the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        small = scratch.keep(small, few=True)
        after = mark(small)
        scratch.drop(now, large)
        if before == after:
            roots = small.groupBy("u").agg(F.min("v").alias("root"))
            return roots.unionByName(small.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        now, before = small, after
