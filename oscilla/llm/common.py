"""Shared plumbing of the corpus operators: durable intermediates and small Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``, else the session's checkpoint folder.

    A temporary one is made only where neither is set and executors are threads of this process (tests).
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="oscilla-"))
    return sc.getCheckpointDir().rstrip("/")


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once with a number for each row, and that column's name, which is none of ``df``'s.

    Whoever joins by that number reads the written one, however ``df`` itself would number its rows the next time.
    """
    row = fresh(df, "row")
    return durable(df.withColumn(row, F.monotonically_increasing_id())), row


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, lost executors lose nothing.

    The files stay until :func:`cleanup` or the end of the process, since the frame returned is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/oscilla-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many intermediate tables there are now, for :func:`cleanup`."""
    return len(_WRITTEN)


def cleanup(since: int = 0, keep: int = 0) -> None:
    """Delete the intermediate tables this process wrote after the first ``since``, but for the last ``keep``."""
    end = len(_WRITTEN) - keep
    gone, _WRITTEN[since:end] = _WRITTEN[since:end], []
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: nothing is left to ask
            return


atexit.register(cleanup)


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, once a process under this name; another name frees it.

    Python workers outlive the operator they were started for: without this a pipeline's caches would add up in them.
    """
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


#: Rows of one long that are broadcast: some 32 MB as a hash relation.
BROADCAST_ROWS = 2_000_000


def light(ids: DataFrame) -> DataFrame:
    """``ids``, one long a row, for a join with texts: broadcast after a check of its size, else left to a shuffle."""
    ids = durable(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of ``df``'s columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(col: str = "text"):
    """The text column with null as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
