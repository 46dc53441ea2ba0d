"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, where it is not installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="latticework-")) / "latticework.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, path.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the folder that spark.checkpoint.dir names, or in local mode a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def counted(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """As `checkpointed`, with aggregates of the rows that are taken while they are written."""
    shared_checkpoints(df.sparkSession)
    seen = Observation()
    cut = df.observe(seen, *(c.alias(n) for n, c in sums.items())).checkpoint(eager=True)
    return cut, seen.get


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a written copy in the shared folder."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


#: rows of a partition that is sorted or hashed in a task's memory
PART = 1_000_000


def parted(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """`df` by hash of `by` in partitions of some PART of its `rows`; as it is where the session's partitions are as many.

    Their number is set by the session, so without this a task's memory grows with the table.
    """
    parts = -(-rows // PART)
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *by)


def written(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """As `counted`, by a Parquet table in the shared folder.

    A checkpoint keeps what the optimiser has inferred about its columns. In a
    loop of conditional columns that list doubles each round; a table forgets it.
    """
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/written-{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *(c.alias(n) for n, c in sums.items())) if sums else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if sums else {}
