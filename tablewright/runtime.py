"""Session helpers: the shared folder, lineage cuts and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Most rows a side may hold before it is no longer sent to every executor.
BROADCAST_ROWS = 100_000
# Most cells (rows x width) such a side may hold: 8M doubles are 64 MB.
BROADCAST_CELLS = 8_000_000


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A folder of our own is set only in local mode with nothing configured; on a
    cluster a machine-local folder would lose data with its executor.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tablewright-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


_owners: list[list[str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder, owned by the innermost ``owned_tables``."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    return path


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was written by ``cut`` and into ``new_folder`` inside.

    Results are lazy: what is to outlive the block has to be written before it ends.
    """
    _owners.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _owners.pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut the lineage by writing ``df`` once and reading it back.

    The written table survives lost executors, is read by column, and carries
    the sizes Spark needs to choose join strategies.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(rows: int, width: int = 1) -> bool:
    return rows <= BROADCAST_ROWS and rows * max(width, 1) <= BROADCAST_CELLS


def bounded_count(df: DataFrame, bound: int) -> int:
    """Row count, but never looks at more than ``bound + 1`` rows."""
    return df.limit(bound + 1).count()
