"""Session helpers: shipping this package to executors, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Paths of the tables made inside ``stored``.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom-package.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A temporary one stands in only where driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at storage that outlives an executor, and the rows are
    computed once (``checkpoint()`` runs the last stage twice).
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``materialize`` what ``make`` gives, then remove the tables that were written on the way to it.

    Nothing that ``make`` leaves behind may be read later but the returned frame.
    """
    token = _made.set([])
    try:
        out = materialize(make(), label)
        *spent, kept = _made.get()
    finally:
        _made.reset(token)
    if (outer := _made.get()) is not None:
        outer.append(kept)
    for path in spent:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return out


def materialize_observed(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict]:
    """As ``materialize``, with one-row aggregates of what is written, taken during the write itself.

    The metrics sit in the write's own (result) tasks, whose updates count once however often
    a task is tried, so a round needs no second job to learn whether it was the last.
    """
    seen = Observation()
    stored = materialize(df.observe(seen, *[c.alias(name) for name, c in sums.items()]), label)
    return stored, seen.get


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their 0-based place in a total order, as a long column ``name``.

    Ranges of the order are sorted apart and stored; only their sizes, a row each, are summed up.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # As many rows as the sort has partitions.
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__start")
