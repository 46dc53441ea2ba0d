"""Neighbours, surfaces and orientation of voxels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import bricks
from latticework.session import checkpointed, parted
from latticework.sources.voxels import CELL, KEY

#: fixed values: face directions in the order +x, -x, +y, -y, +z, -z
DIRECTIONS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def shifted(voxels: DataFrame, directions: list[tuple[int, tuple[int, int, int]]]) -> DataFrame:
    """Each voxel once for each (number, offset), with dir and the cell it looks at in nx, ny, nz."""
    steps = F.array(*(F.struct(F.lit(d).alias("d"), *(F.lit(v).alias(f"o{c}") for c, v in zip("xyz", o, strict=True))) for d, o in directions))
    return voxels.select("*", F.explode(steps).alias("step")).select(*voxels.columns, F.col("step.d").alias("dir"), *((F.col(f"i{c}") + F.col(f"step.o{c}")).alias(f"n{c}") for c in "xyz"))


def looked_at(voxels: DataFrame, prefix: str = "other_") -> DataFrame:
    """Voxels keyed by nx, ny, nz, their other columns prefixed, to join with `shifted` rows."""
    rest = [c for c in voxels.columns if c not in CELL]
    return voxels.select("grid_id", *(F.col(f"i{c}").alias(f"n{c}") for c in "xyz"), *(F.col(c).alias(prefix + c) for c in rest))


LOOK = ["grid_id", "nx", "ny", "nz"]


def met(asking: DataFrame, voxels: DataFrame, directions: list[tuple[int, tuple[int, int, int]]], how: str = "inner") -> DataFrame:
    """`shifted` rows of `asking` joined with the voxels they look at, in partitions as many as the rows need."""
    rows = asking.count() * len(directions)
    return parted(shifted(asking, directions), rows, *LOOK).join(parted(looked_at(voxels), rows, *LOOK), LOOK, how)


def neighbors(voxels: DataFrame, connectivity: int = 6) -> DataFrame:
    """(grid_id, voxel_idx, dir, other_voxel_idx) of filled face neighbours; 4 leaves out the vertical ones."""
    cells = voxels.select(*KEY, *CELL[1:])
    return shifted(cells, list(enumerate(DIRECTIONS))[:connectivity]).join(looked_at(cells), LOOK).select(*KEY, "dir", "other_voxel_idx")


def open_faces(voxels: DataFrame) -> DataFrame:
    """(grid_id, voxel_idx, dir) of faces without a filled neighbour."""
    cells = voxels.select(*KEY, *CELL[1:])
    return shifted(cells, list(enumerate(DIRECTIONS))).join(looked_at(cells), LOOK, "left_anti").select(*KEY, "dir")


def surface(voxels: DataFrame) -> DataFrame:
    """(grid_id, voxel_idx, open_faces) of voxels with fewer than six neighbours."""
    return open_faces(voxels).groupBy(*KEY).agg(F.count(F.lit(1)).alias("open_faces"))


def orientation(voxels: DataFrame) -> DataFrame:
    """direction (first open face, -1 inside), open_faces and the unit normal (0 where faces cancel)."""
    axis = [F.sum(F.element_at(F.array(*(F.lit(d[k]) for d in DIRECTIONS)), F.col("dir") + 1)).alias(f"s{c}") for k, c in enumerate("xyz")]
    faces = open_faces(voxels).groupBy(*KEY).agg(F.min("dir").alias("direction"), F.count(F.lit(1)).alias("open_faces"), *axis)
    length = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    unit = [F.when(length >= 1e-12, F.col(f"s{c}") / length).otherwise(0.0).alias(f"normal_{c}") for c in "xyz"]
    return voxels.select(*KEY).join(faces, KEY, "left").select(*KEY, F.coalesce("direction", F.lit(-1)).alias("direction"), F.coalesce("open_faces", F.lit(0)).cast("long").alias("open_faces"), *unit)


def direction_histogram(oriented: DataFrame) -> DataFrame:
    """Voxels of each direction and their share; cancelled ones are those on the surface without a normal."""
    flat = (F.col("normal_x") == 0) & (F.col("normal_y") == 0) & (F.col("normal_z") == 0) & (F.col("open_faces") > 0)
    total = oriented.groupBy("grid_id").agg(F.count(F.lit(1)).alias("total"))
    return oriented.groupBy("grid_id", "direction").agg(F.count(F.lit(1)).alias("voxels"), F.count_if(flat).alias("cancelled")).join(total, "grid_id").select("grid_id", "direction", "voxels", "cancelled", (100.0 * F.col("voxels") / F.col("total")).alias("percent"))


def surface_alignment(voxels: DataFrame, target: tuple[float, float, float] = (0, -1, 0)) -> DataFrame:
    """Dot product of normal and unit target as a channel; -1 without a normal."""
    length = sum(t * t for t in target) ** 0.5
    if length == 0:
        raise ValueError("the target has no direction")
    dot = sum((F.col(f"normal_{c}") * F.lit(t / length) for c, t in zip("xyz", target, strict=True)), F.lit(0.0))
    none = (F.col("normal_x") == 0) & (F.col("normal_y") == 0) & (F.col("normal_z") == 0)
    return orientation(voxels).select(*KEY, F.lit("surface_alignment").alias("label"), F.when(none, -1.0).otherwise(dot).alias("value"))


def _levels(planes, fixed, _corner):
    """Steps from the cells marked in `fixed[1]`, through the brick and from what lies around it."""
    now = bricks.inner(planes[0])
    empty = fixed[0] >= bricks.FAR
    now[...] = np.where(fixed[1] < bricks.FAR, 0, bricks.FAR)
    while True:
        near = np.minimum.reduce([bricks.looked(planes[0], k, s) for k in range(3) for s in (1, -1)])
        new = np.where(empty, bricks.FAR, np.minimum(now, np.minimum(near + 1, bricks.FAR)))
        if (new == now).all():
            return new[None]
        now[...] = new


def _waves(planes, fixed, corner):
    """Level, square of the distance, and index and place of the seed whose wave arrives first, level by level."""
    level = _levels(planes[:1], fixed, corner)[0]
    here = np.stack(np.meshgrid(*(np.arange(c, c + bricks.SIDE) for c in corner), indexing="ij"))
    inside = bricks.inner(planes)
    inside[...] = bricks.FAR
    inside[0] = level
    start = level == 0
    for k, value in enumerate((np.zeros_like(level), fixed[0], *here), 1):
        inside[k][start] = value[start]
    for step in np.unique(level[(level > 0) & (level < bricks.FAR)]):
        mine = np.nonzero(level == step)
        place = [h[mine] for h in here]
        best = [np.full(len(mine[0]), bricks.FAR)] * 5
        for axis in range(3):
            for way in (1, -1):
                other = [bricks.looked(p, axis, way)[mine] for p in planes]
                square = np.where(other[0] == step - 1, sum((np.where(o < bricks.FAR, o, 0) - h) ** 2 for o, h in zip(other[3:], place, strict=True)), bricks.FAR)
                better = (square < best[0]) | ((square == best[0]) & (other[2] < best[1]) & (square < bricks.FAR))
                best = [np.where(better, n, b) for n, b in zip((square, *other[2:]), best, strict=True)]
        for k, value in enumerate(best, 1):
            inside[k][mine] = value
    return inside.copy()


def _from_surface(voxels: DataFrame, planes: int, solve, max_rounds: int) -> DataFrame:
    """Bricks with the waves of the surface voxels."""
    top = surface(voxels).select(*KEY, F.lit(0).cast("long").alias("top"))
    return bricks.settle(voxels.select(*KEY, *CELL[1:]).join(top, KEY, "left"), ["top"], planes, solve, max_rounds)


def surface_depth(voxels: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Steps from the surface over face neighbours as a channel; what no surface reaches is one more than the deepest.

    Waves run inside bricks; a round goes on only where a brick's face changed.
    Raises ValueError without a surface voxel.
    """
    levels = checkpointed(bricks.unpacked(_from_surface(voxels, 1, _levels, max_rounds), "depth long", names=["depth"]).select(*KEY, "depth"))
    deepest = levels.groupBy("grid_id").agg((F.max("depth") + 1).alias("beyond"))
    if deepest.where("beyond is not null").isEmpty():
        raise ValueError("no surface voxel")
    return levels.join(deepest, "grid_id").where("beyond is not null").select(*KEY, F.lit("surface_depth").alias("label"), F.coalesce("depth", "beyond").cast("double").alias("value"))


def surface_distance(voxels: DataFrame, voxel_size: float = 1.0, max_rounds: int = 10_000) -> DataFrame:
    """Distance to the surface voxel whose wave arrives first, as a channel; of several, the nearest, then the least index.

    Waves go level by level over face neighbours, as in surface_depth. What no
    surface reaches is one voxel farther than the farthest. Raises ValueError
    without a surface voxel.
    """
    found = bricks.unpacked(_from_surface(voxels, 6, _waves, max_rounds), "square long", names=["level", "square"])
    far = checkpointed(found.select(*KEY, (F.sqrt(F.col("square").cast("double")) * float(voxel_size)).alias("far")))
    beyond = far.groupBy("grid_id").agg((F.max("far") + float(voxel_size)).alias("beyond"))
    if beyond.where("beyond is not null").isEmpty():
        raise ValueError("no surface voxel")
    return far.join(beyond, "grid_id").where("beyond is not null").select(*KEY, F.lit("surface_distance").alias("label"), F.coalesce("far", "beyond").alias("value"))


def centers(voxels: DataFrame, origin: tuple[float, float, float] = (0, 0, 0), voxel_size: float = 1.0, plane: list[float] | None = None) -> DataFrame:
    """(grid_id, voxel_idx, x, y, z) of voxel centres, put through a row-major 4 x 4 plane matrix if one is given."""
    local = [float(o) + (F.col(f"i{c}") + 0.5) * float(voxel_size) for c, o in zip("xyz", origin, strict=True)]
    if plane is not None:
        local = [sum((F.lit(float(plane[4 * k + j])) * local[j] for j in range(3)), F.lit(float(plane[4 * k + 3]))) for k in range(3)]
    return voxels.select(*KEY, *(v.alias(c) for c, v in zip("xyz", local, strict=True)))


def boxes(voxels: DataFrame, origin: tuple[float, float, float] = (0, 0, 0), voxel_size: float = 1.0) -> DataFrame:
    """(grid_id, voxel_idx, x, y, z, side): least corner and side of each voxel's box."""
    return voxels.select(*KEY, *((float(o) + F.col(f"i{c}") * float(voxel_size)).alias(c) for c, o in zip("xyz", origin, strict=True)), F.lit(float(voxel_size)).alias("side"))
