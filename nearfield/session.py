"""Session-level settings: the shared scratch folder, size limits, the package on the executors."""

from __future__ import annotations

import ctypes
import gc
import io
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nearfield.sources import files

# Largest table (bytes) that is ever collected into one broadcast.
BROADCAST_LIMIT = 64 << 20
# Largest running top-K state (bytes) one task keeps.
STATE_LIMIT = 128 << 20

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is absent *and* the
    session is a single machine; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get(_CHECKPOINT_CONF, None) or context.getConf().get(_CHECKPOINT_CONF, None)
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder every executor can reach")
        if context.applicationId not in _local_roots:
            _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="nearfield-")
        root = _local_roots[context.applicationId]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote, once no later step reads them."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """Bring rows of one key together for writing, without trusting the keys to be even.

    Adaptive execution cuts an oversized partition (a key with a large part of
    the data) into several tasks and joins small ones.
    """
    return df.hint("rebalance", key)


def slots(spark: SparkSession) -> int:
    """Tasks that can run at a time.

    With dynamic allocation the slots present now say little, so the configured executors count as well.
    """
    conf = spark.sparkContext.getConf()
    limits = [conf.get(f"spark.{name}", "0") for name in ("executor.instances", "dynamicAllocation.maxExecutors")]
    executors = max(int(limit) for limit in limits if limit.isdigit()) if any(x.isdigit() for x in limits) else 0
    configured = executors * int(conf.get("spark.executor.cores", "1"))
    return max(spark.sparkContext.defaultParallelism, configured)


def parallelism(spark: SparkSession) -> int:
    """Tasks worth starting: two per slot, so that one slow task does not stall the rest, or the shuffle partitions."""
    return max(2 * slots(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))


def hand_back() -> None:
    """Give a Python worker's freed memory back to the machine: workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application.

    Does nothing when the package was itself submitted as an archive.
    """
    context = spark.sparkContext
    folder = Path(__file__).resolve().parent
    if context.applicationId in _shipped or not folder.is_dir():
        return
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        for source in sorted(folder.rglob("*.py")):
            archive.write(source, source.relative_to(folder.parent))
    path = scratch_path(spark, folder.name) + ".zip"
    files.write_bytes(path, content.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
