"""Session helpers: cutting lineage through shared storage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000
MAX_BROADCAST_VERTICES = 500_000  # of rows of a vertex each, a hundred bytes or so
BUCKET_ROWS = 5_000_000
FILE_ROWS = 250_000  # rows of a file where their number is known
GATHER_BYTES = 1 << 20  # of a written table that is read as one partition where rounds are many


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only a local session may fall back to one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"/tmp/checkpoints/pinweave-{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        root = f"file:{path}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once for each application, and keep the batches that they get small, as texts can be long."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if any(os.path.basename(p) == "pinweave.zip" for p in sc._python_includes):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="pinweave-")  # on the driver, which serves the file to the workers
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "pinweave.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.join("pinweave", os.path.relpath(path, top)))
    sc.addPyFile(target)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    ``keep`` writes a frame as Parquet and reads it back with its lineage cut;
    ``drop`` removes a table that later steps no longer need.
    """

    def __init__(self, spark: SparkSession, name: str, gather: int = 0):
        ship_package(spark)
        self.spark = spark
        self.name, self.gather = name, gather
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n, self._lock = 0, threading.Lock()
        self._made: dict[tuple, tuple] = {}

    def once(self, make: Callable, of: object, *key):
        """What ``make`` gives for an object, made once; the object is held with it."""
        key = (make.__qualname__, id(of), *key)
        if key not in self._made:
            self._made[key] = (of, make())
        return self._made[key][1]

    def gathering(self) -> Scratch:
        """Another scratch whose tables are read as one partition each while they are small, so that steps among them need no exchange: a plan of many rounds waits for jobs, not for rows."""
        return Scratch(self.spark, self.name, GATHER_BYTES)

    def small(self, table: DataFrame) -> bool:
        """Whether a kept table is within the bound for one partition."""
        return getattr(table, "_scratch_small", False)

    def keep(self, df: DataFrame, label: str = "t", rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
        """``rows``, where a bound is known, keeps a small table from being written as a file for every shuffle partition."""
        with self._lock:
            self._n += 1
            path = f"{self.base}/{self._n:03d}-{label}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // each)))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        small = self.gather > 0 and self._bytes(path) <= self.gather
        if small:
            out = out.coalesce(1)
        out._scratch_path, out._scratch_small = path, small
        return out

    def _bytes(self, path: str) -> int:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def keep_all(self, tables: list[DataFrame], label: str = "t") -> list[DataFrame]:
        """``keep`` of several tables at once, whose jobs run side by side."""
        with ThreadPoolExecutor(len(tables)) as pool:
            return list(pool.map(lambda i: self.keep(tables[i], f"{label}{i}"), range(len(tables))))

    def keep_by(self, df: DataFrame, key: str, rows: int, label: str = "t") -> DataFrame:
        """``keep`` in buckets of a key, for rounds that group by it: they read the table without an exchange. ``rows`` bounds how many there are.

        Buckets are as few as ``BUCKET_ROWS`` allows, since what a round sums by another key
        leaves each bucket as one row a key at most. The table's name is gone once it is read.
        """
        with self._lock:
            self._n += 1
            path, name = f"{self.base}/{self._n:03d}-{label}", f"pinweave_{uuid.uuid4().hex}"
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
        df.repartition(tasks, key).write.bucketBy(tasks, key).format("parquet").option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast when a counted ``df`` has at most ``max_rows`` rows; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
