"""Tables between the steps of an operator, in the folder that the cluster shares; sides of joins."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset and the master is this machine, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints/kgweave"
#: A side of at most this many narrow rows may be broadcast, or of so many bytes where rows are wide.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Without it a local session gets a folder of this machine; on a
    cluster, where executors don't see one another's folders, that would lose rows, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_SCRATCH


class Scratch:
    """Tables written under ``spark.checkpoint.dir``: they cut lineage and outlive lost executors.

    ``table`` writes a frame as Parquet and returns a reader of it, so nothing above is computed
    twice. ``drop`` removes tables that nothing reads any more. What is left goes at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def path(self, tag: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{tag}"

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._remove(df._scratch_path)

    def _remove(self, path: str) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit; the folder is scratch
            pass


def small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most BROADCAST_ROWS rows, else as it is.

    size: bytes of a row, for rows that hold arrays; then they must be at most BROADCAST_BYTES too.
    """
    fits = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if fits and size is not None:
        fits = (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df
