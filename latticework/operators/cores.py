"""Vertical cores: voxels near curves, distance to the nearest core, footprints and centrelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.sources.voxels import CELL, KEY


def core_from_curves(centers: DataFrame, segments: DataFrame, radius: float = 10.0, voxel_size: float = 1.0) -> DataFrame:
    """(grid_id, voxel_idx, curve_id, distance) of centres within `radius` (0.01 at least) of a curve.

    `segments` has grid_id, curve_id and ends ax to bz. Space is cut into bins
    not smaller than the radius. A segment walks along its length in steps of a
    bin's side and goes to the bins that each step's grown box touches; a centre
    goes to one. So the join is by equality and a segment's rows grow with its
    length.
    """
    radius = max(0.01, float(radius))
    side = max(radius, float(voxel_size))
    spread = segments.select("grid_id", "curve_id", *(f"{p}{c}" for p in "ab" for c in "xyz")).dropna()
    ends = spread.columns
    steps = F.greatest(F.lit(1), F.ceil(F.sqrt(_sum((F.col(f"b{c}") - F.col(f"a{c}")) ** 2 for c in "xyz")) / side))
    spread = spread.withColumn("steps", steps).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps") - 1)))
    for c in "xyz":
        along_c = F.col(f"b{c}") - F.col(f"a{c}")
        spread = spread.withColumns({f"from_{c}": F.col(f"a{c}") + along_c * F.col("step") / F.col("steps"), f"to_{c}": F.col(f"a{c}") + along_c * (F.col("step") + 1) / F.col("steps")})
    at = centers.select(*KEY, "x", "y", "z").dropna()
    for c in "xyz":
        low, high = (F.floor((f(f"from_{c}", f"to_{c}") + r) / side) for f, r in ((F.least, -radius - 1e-9), (F.greatest, radius + 1e-9)))
        spread = spread.withColumn(f"{c}_bin", F.explode(F.sequence(low, high)))
        at = at.withColumn(f"{c}_bin", F.floor(F.col(c) / side))
    spread = spread.select(*ends, "x_bin", "y_bin", "z_bin").distinct()
    pairs = at.join(spread, ["grid_id", "x_bin", "y_bin", "z_bin"])
    along = {c: F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"}
    from_a = {c: F.col(c) - F.col(f"a{c}") for c in "xyz"}
    length = _sum(along[c] * along[c] for c in "xyz")
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _sum(from_a[c] * along[c] for c in "xyz") / length))).otherwise(0.0)
    near = pairs.select(*KEY, "curve_id", *(from_a[c].alias(f"p{c}") for c in "xyz"), *(along[c].alias(f"s{c}") for c in "xyz"), t.alias("t"))
    gap = [F.col(f"p{c}") - F.col("t") * F.col(f"s{c}") for c in "xyz"]
    far = near.groupBy(*KEY, "curve_id").agg(F.min(F.sqrt(_sum(g * g for g in gap))).alias("distance"))
    return far.where(F.col("distance") <= radius)


def _sum(terms) -> Column:
    total = None
    for term in terms:
        total = term if total is None else total + term
    return total


def core_distance(voxels: DataFrame, core: DataFrame, voxel_size: float = 1.0) -> DataFrame:
    """(grid_id, voxel_idx, distance, is_core): distance of centres to the nearest core voxel; 0 in grids without one.

    The squared distance is a sum over axes, so its minimum is taken axis by
    axis: along z in each core column, then along y, then along x. Arrays are
    no longer than a side of the grid and every join is by equality.
    """
    slim = voxels.select(*KEY, *CELL[1:])
    mine = slim.join(core.select(*KEY).distinct(), KEY, "left_semi")
    sides = slim.groupBy("grid_id").agg(*(f(f"i{c}").cast("long").alias(f"{n}{c}") for c in "yz" for f, n in ((F.min, "low"), (F.max, "high"))))

    def nearest(line: str, cell: str) -> Column:
        return F.expr(f"array_min(transform({line}, p -> ({cell} - p.i) * ({cell} - p.i) + p.rest))")

    z_lines = mine.groupBy("grid_id", "ix", "iy").agg(F.collect_list(F.struct(F.col("iz").cast("long").alias("i"), F.lit(0).cast("long").alias("rest"))).alias("line"))
    z_done = z_lines.join(sides, "grid_id").select("grid_id", "ix", "iy", "lowy", "highy", "line", F.explode(F.sequence("lowz", "highz")).alias("iz")).select("grid_id", "ix", "iy", "iz", "lowy", "highy", nearest("line", "iz").alias("rest"))
    y_lines = z_done.groupBy("grid_id", "ix", "iz", "lowy", "highy").agg(F.collect_list(F.struct(F.col("iy").cast("long").alias("i"), "rest")).alias("line"))
    y_done = y_lines.select("grid_id", "ix", "iz", "line", F.explode(F.sequence("lowy", "highy")).alias("iy")).select("grid_id", "ix", "iy", "iz", nearest("line", "iy").alias("rest"))
    x_lines = y_done.groupBy("grid_id", "iy", "iz").agg(F.collect_list(F.struct(F.col("ix").cast("long").alias("i"), "rest")).alias("line"))
    found = slim.join(x_lines, ["grid_id", "iy", "iz"], "left").select(*KEY, nearest("line", "ix").alias("square"))
    return found.select(*KEY, (F.sqrt(F.coalesce("square", F.lit(0)).cast("double")) * float(voxel_size)).alias("distance"), (F.col("square") == 0).alias("is_core")).withColumn("is_core", F.coalesce("is_core", F.lit(False)))


def core_proximity(distances: DataFrame, invert: bool = False, label: str = "core") -> DataFrame:
    """Channel that is high near a core: greatest distance less distance; the distance itself when inverted."""
    top = distances.groupBy("grid_id").agg(F.max("distance").alias("top"))
    value = F.col("distance") if invert else F.col("top") - F.col("distance")
    return distances.join(top, "grid_id").select(*KEY, F.lit(label).alias("label"), value.alias("value"))


def core_coverage(distances: DataFrame, max_distance: float = 100.0) -> DataFrame:
    """Share of core voxels in percent, voxels farther than max_distance, and the greatest distance."""
    return distances.groupBy("grid_id").agg(
        (100.0 * F.count_if("is_core") / F.count(F.lit(1))).alias("percent"), F.count_if(F.col("distance") > max_distance).alias("beyond"), F.max("distance").alias("greatest")
    )


def footprints(core: DataFrame, voxel_size: float = 1.0) -> DataFrame:
    """(grid_id, core_id, iz, x, y, z, x0, y0, x1, y1): centroid and outline of each core's floor, of (grid_id, core_id, iz, x, y, z) centres."""
    half = float(voxel_size) / 2
    return core.groupBy("grid_id", "core_id", "iz").agg(
        *(F.avg(c).alias(c) for c in "xyz"), *((F.min(c) - half).alias(f"{c}0") for c in "xy"), *((F.max(c) + half).alias(f"{c}1") for c in "xy")
    )


def centerlines(floors: DataFrame, voxel_size: float = 1.0) -> DataFrame:
    """(grid_id, core_id, points): centroids of a core's floors from the lowest up; a core of one floor gets a stub of one voxel."""
    lines = floors.groupBy("grid_id", "core_id").agg(F.array_sort(F.collect_list(F.struct("iz", "x", "y", "z"))).alias("points"))
    points = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    one = F.col("points")[0]
    stub = F.array(F.struct(one["x"].alias("x"), one["y"].alias("y"), one["z"].alias("z")), F.struct(one["x"].alias("x"), one["y"].alias("y"), (one["z"] + float(voxel_size)).alias("z")))
    return lines.select("grid_id", "core_id", F.when(F.size("points") == 1, stub).otherwise(points).alias("points"))
