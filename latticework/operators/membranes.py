"""Skins around programs: offset faces and their smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.grid import DIRECTIONS, met
from latticework.session import checkpointed, written
from latticework.sources.voxels import KEY

#: fixed values: corners of a unit face for each direction, counter-clockwise seen from outside
CORNERS = [
    [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)],
    [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)],
    [(0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)],
    [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)],
    [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
    [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)],
]


def _of_direction(values: list) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("dir") + 1)


def membrane_faces(cells: DataFrame, voxel_size: float = 1.0, gap: float = 0.05, include_boundary: bool = False) -> DataFrame:
    """(grid_id, program_idx, voxel_idx, dir, corners) of faces where a program value ends, -1 and -2 included.

    Faces without a filled neighbour count only with include_boundary. Corners
    are in the grid's own axes, moved by `gap` along the axis of the face, away
    from the program's centroid.
    """
    slim = cells.select("grid_id", "voxel_idx", "ix", "iy", "iz", "program_idx")
    ends = F.col("other_program_idx").isNull() if include_boundary else F.lit(False)
    near = met(slim, slim, list(enumerate(DIRECTIONS)), "left").where(ends | (F.col("other_program_idx") != F.col("program_idx")))
    centre = slim.groupBy("grid_id", "program_idx").agg(*((F.avg(f"i{c}") + 0.5).alias(f"m{c}") for c in "xyz"))
    # written, so that few grids are broadcast and the faces stay where they are
    joined = near.join(written(centre)[0], ["grid_id", "program_idx"])
    normal = [_of_direction([d[k] for d in DIRECTIONS]) for k in range(3)]
    towards = sum((n * (F.col(f"m{c}") - F.col(f"i{c}") - 0.5 - n / 2) for n, c in zip(normal, "xyz", strict=True)), F.lit(0.0))
    sign = F.when(towards < 0, 1.0).otherwise(-1.0) * gap
    corner = F.array(*(
        F.struct(*(((F.col(f"i{c}") + _of_direction([o[j][k] for o in CORNERS])) * float(voxel_size) + normal[k] * sign).alias(c) for k, c in enumerate("xyz")))
        for j in range(4)
    ))
    return joined.select("grid_id", "program_idx", "voxel_idx", "dir", corner.alias("corners"))


def smoothed(faces: DataFrame, passes: int = 1) -> DataFrame:
    """Each pass moves a corner to the next one of its face: faces share no corners, so nothing else follows from the rule."""
    k = passes % 4
    return faces if not k else faces.withColumn("corners", F.concat(F.slice("corners", k + 1, 4 - k), F.slice("corners", 1, k)))


def welded(faces: DataFrame, cells: DataFrame, passes: int = 1) -> DataFrame:
    """`faces` with corners smoothed as one skin.

    Corners of a program's faces at one corner of the grid are a single vertex,
    at their mean. Each pass sets it to the mean of the vertices it shares a side
    with; those on a side of just one face stay where they are.
    """
    skin, spot = ["grid_id", "program_idx"], ["cx", "cy", "cz"]
    number = F.array(*(F.array(*(F.struct(F.lit(j).alias("j"), *(F.lit(v).alias(f"o{c}") for c, v in zip("xyz", corner, strict=True))) for j, corner in enumerate(of))) for of in CORNERS))
    rows = faces.join(cells.select(*KEY, "ix", "iy", "iz"), KEY).select(*skin, "voxel_idx", "dir", "corners", "ix", "iy", "iz", F.explode(F.element_at(number, F.col("dir") + 1)).alias("o"))
    rows = checkpointed(rows.select(*skin, "voxel_idx", "dir", F.col("o.j").alias("j"), *((F.col(f"i{c}") + F.col(f"o.o{c}")).alias(f"c{c}") for c in "xyz"), F.get("corners", F.col("o.j")).alias("at")))
    vertices = checkpointed(rows.groupBy(*skin, *spot).agg(*(F.avg(f"at.{c}").alias(c) for c in "xyz")))
    ahead = rows.select(*skin, "voxel_idx", "dir", F.pmod(F.col("j") + 3, F.lit(4)).alias("j"), *(F.col(c).alias(f"to_{c}") for c in spot))
    sides = rows.join(ahead, [*skin, "voxel_idx", "dir", "j"]).select(*skin, F.struct(*spot).alias("a"), F.struct(*(F.col(f"to_{c}").alias(c) for c in spot)).alias("b"))
    both = sides.unionByName(sides.select(*skin, F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpointed(both.groupBy(*skin, "a", "b").agg(F.count(F.lit(1)).alias("n")).select(*skin, *(F.col(f"a.{c}").alias(c) for c in spot), *(F.col(f"b.{c}").alias(f"to_{c}") for c in spot), "n"))
    free = checkpointed(edges.groupBy(*skin, *spot).agg(F.min("n").alias("n")).where("n > 1").drop("n"))
    for _ in range(passes):
        there = vertices.select(*skin, *(F.col(c).alias(f"to_{c}") for c in spot), *"xyz")
        mean = edges.join(there, [*skin, *(f"to_{c}" for c in spot)]).groupBy(*skin, *spot).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
        moved = mean.join(free, [*skin, *spot], "left_semi")
        vertices = checkpointed(vertices.join(moved, [*skin, *spot], "left").select(*skin, *spot, *(F.coalesce(f"m{c}", c).alias(c) for c in "xyz")))
    put = rows.join(vertices, [*skin, *spot]).groupBy(*skin, "voxel_idx", "dir").agg(F.array_sort(F.collect_list(F.struct("j", *"xyz"))).alias("v"))
    return put.select("grid_id", "program_idx", "voxel_idx", "dir", F.transform("v", lambda v: F.struct(*(v[c].alias(c) for c in "xyz"))).alias("corners"))


def membrane_summary(faces: DataFrame) -> DataFrame:
    """Voxels, corners and faces of each program's skin."""
    return faces.groupBy("grid_id", "program_idx").agg(F.countDistinct("voxel_idx").alias("voxels"), (4 * F.count(F.lit(1))).alias("vertices"), F.count(F.lit(1)).alias("faces"))
