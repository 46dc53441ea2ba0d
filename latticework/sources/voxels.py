"""Voxel tables, channels, programs and weights from rows.

A voxel table has grid_id, voxel_idx, ix, iy, iz. voxel_idx is the packed key
(ix * ny + iy) * nz + iz: it sorts like (ix, iy, iz) without a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["grid_id", "voxel_idx"]
CELL = ["grid_id", "ix", "iy", "iz"]


def from_keys(df: DataFrame, many: bool = False) -> DataFrame:
    """Distinct keys of (grid_id, ix, iy, iz) rows, with their index. Keys are 0 or more; rows with a null are dropped.

    `many` is for grids that are about as many as rows: their sizes are not broadcast.
    """
    keys = df.select(F.col("grid_id").cast("string"), *(F.col(c).cast("int") for c in CELL[1:])).dropna().distinct()
    dims = keys.groupBy("grid_id").agg((F.max("iy") + 1).cast("long").alias("ny"), (F.max("iz") + 1).cast("long").alias("nz"))
    return keys.join(dims.hint("merge") if many else dims, "grid_id").select("grid_id", ((F.col("ix") * F.col("ny") + F.col("iy")) * F.col("nz") + F.col("iz")).alias("voxel_idx"), *CELL[1:])


def from_points(df: DataFrame, cell: float) -> DataFrame:
    """Voxels of side `cell` that hold a point of (grid_id, x, y, z), counted from each grid's least corner."""
    if cell <= 0:
        raise ValueError("cell has to be positive")
    low = df.groupBy("grid_id").agg(*(F.min(c).alias(f"{c}0") for c in "xyz"))
    return from_keys(df.join(low, "grid_id").select("grid_id", *(F.floor((F.col(c) - F.col(f"{c}0")) / cell).alias(f"i{c}") for c in "xyz")))


def channel(df: DataFrame, label: str, value: Column) -> DataFrame:
    """Rows (grid_id, voxel_idx, label, value); the label is trimmed and must not be empty."""
    if not label.strip():
        raise ValueError("a channel needs a label")
    return df.select(*KEY, F.lit(label.strip()).alias("label"), value.cast("double").alias("value"))


def check_channels(voxels: DataFrame, channels: DataFrame) -> DataFrame:
    """`channels`, or ValueError where a label repeats a voxel or misses some."""
    size = voxels.groupBy("grid_id").agg(F.count(F.lit(1)).alias("voxels"))
    seen = channels.groupBy("grid_id", "label", "voxel_idx").agg(F.count(F.lit(1)).alias("n")).groupBy("grid_id", "label").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"))
    wrong = seen.join(size, "grid_id", "left").where("most > 1 or rows <> coalesce(voxels, 0)").limit(1).collect()
    if wrong:
        w = wrong[0]
        raise ValueError(f"channel {w['label']}: duplicate label" if w["most"] > 1 else f"channel {w['label']}: {w['rows']} values for {w['voxels']} voxels")
    return channels


def programs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(program_idx, name, r, g, b, voxel_count) of (name, voxel_count[, (r, g, b)]) rows.

    Names are trimmed; an empty name or a count of 0 is an error, a negative
    count means no limit. Of equal names the first stays.
    """
    out: dict[str, tuple] = {}
    for row in rows:
        name, count, colour = row[0].strip(), row[1], row[2] if len(row) > 2 else (255, 255, 255)
        if not name:
            raise ValueError("a program needs a name")
        if count == 0:
            raise ValueError(f"program {name}: a count of 0")
        out.setdefault(name, (name, *colour, count))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(out.values())], "program_idx int, name string, r int, g int, b int, voxel_count int")


def weights(programs: DataFrame, labels: list[str], stored: DataFrame | None = None) -> DataFrame:
    """(program_name, label, weight) of every program and label: the stored weight, held to [-1, 1], or 1."""
    every = programs.select(F.col("name").alias("program_name"), F.explode(F.array(*map(F.lit, labels))).alias("label"))
    if stored is None:
        return every.withColumn("weight", F.lit(1.0))
    return every.join(stored.select("program_name", "label", "weight"), ["program_name", "label"], "left").withColumn("weight", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("weight", F.lit(1.0)))))


def merged_weights(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(program_name, label, weight, live, stored) of every pair that is stored or live.

    A live pair has its stored weight, held to [-1, 1], or 1; a pair that is
    stored only keeps its weight and is an extra, which `weight_report` counts.
    """
    pair = ["program_name", "label"]
    held = stored.groupBy(*pair).agg(F.first("weight", ignorenulls=True).alias("kept")).withColumn("stored", F.lit(True))
    both = live.select(*pair).distinct().withColumn("live", F.lit(True)).join(held, pair, "full")
    return both.select(*pair, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("kept", F.lit(1.0)))).alias("weight"), F.coalesce("live", F.lit(False)).alias("live"), F.coalesce("stored", F.lit(False)).alias("stored"))


def weight_report(merged: DataFrame) -> DataFrame:
    """Pairs that are kept, new (live, not stored) and extra (stored, not live)."""
    return merged.agg(F.count_if("live").alias("live"), F.count_if(F.col("live") & ~F.col("stored")).alias("new"), F.count_if(~F.col("live")).alias("extra"))


def stored_extras(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored weights whose program or label is not live; purging keeps the others."""
    return stored.join(live.select("program_name", "label"), ["program_name", "label"], "left_anti")


def purged(stored: DataFrame, live: DataFrame) -> DataFrame:
    return stored.join(live.select("program_name", "label"), ["program_name", "label"], "left_semi")


def generated_weights(weights: DataFrame, mode: str, seed: int = 0, amplitude: float = 0.25) -> DataFrame:
    """Weights by mode random, jitter or reset, held to [-1, 1] in steps of 0.05.

    Random numbers come from a hash of seed, program and label, so they do not
    depend on partitions.
    """
    uniform = F.pmod(F.xxhash64(F.lit(seed), "program_name", "label"), F.lit(1 << 52)) / float(1 << 51) - 1
    value = {"random": uniform, "jitter": F.col("weight") + uniform * amplitude, "reset": F.lit(1.0)}[mode]
    return weights.withColumn("weight", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)) / 0.05) * 0.05)
