"""A stored analysis stack: one Parquet data set for each relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELATIONS = ["voxels", "channels", "raw", "programs", "weights", "assignment", "ranked"]


def write_stack(folder: str, relations: dict[str, DataFrame], mode: str = "errorifexists") -> None:
    """Write relations by name; those with a grid_id are partitioned by it. ValueError for an unknown name."""
    unknown = sorted(set(relations) - set(RELATIONS))
    if unknown:
        raise ValueError(f"unknown relations {unknown}; there are {RELATIONS}")
    for name, df in relations.items():
        out = df.write.mode(mode)
        (out.partitionBy("grid_id") if "grid_id" in df.columns else out).parquet(f"{folder}/{name}")


def read_stack(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The named relations; grid_id is read as a string."""
    found = {}
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}")
        found[name] = df.withColumn("grid_id", df["grid_id"].cast("string")) if "grid_id" in df.columns else df
    return found


def update_stack(spark: SparkSession, folder: str, name: str, fresh: DataFrame) -> list[str]:
    """Replace the stored rows of each grid in `fresh` whose rows differ, and no other partition; returns those grids.

    Grids are compared by their number of rows and the sum of the rows' hashes, so
    only these pass through the driver.
    """
    columns = sorted(fresh.columns)
    rows = F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum")
    before = read_stack(spark, folder, [name])[name].select(columns).groupBy("grid_id").agg(*rows)
    after = fresh.select(columns).groupBy("grid_id").agg(*rows)
    same = (F.col("a.grid_id") == F.col("b.grid_id")) & (F.col("a.rows") == F.col("b.rows")) & (F.col("a.sum") == F.col("b.sum"))
    changed = sorted(r[0] for r in after.alias("a").join(before.alias("b"), same, "left_anti").select("grid_id").collect())
    if changed:
        some = spark.createDataFrame([(g,) for g in changed], "grid_id string")
        fresh.join(some, "grid_id", "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("grid_id").parquet(f"{folder}/{name}")
    return changed
