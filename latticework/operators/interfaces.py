"""Faces between programs, horizontal caps, and the adjacency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.allocation import CORE, UNASSIGNED
from latticework.operators.grid import DIRECTIONS, met
from latticework.operators.membranes import CORNERS
from latticework.session import parted

_UP = [(0, DIRECTIONS[0]), (1, DIRECTIONS[2]), (2, DIRECTIONS[4])]


def contacts(cells: DataFrame, include_core: bool = True) -> DataFrame:
    """Every +x, +y, +z side of an eligible voxel, tagged: exterior, unallocated, core_ignored, same_program or face.

    `cells` has grid_id, voxel_idx, ix, iy, iz, program_idx. The smaller program
    is A and the core always B; where that swaps the two, direction is -1.
    """
    slim = cells.select("grid_id", "voxel_idx", "ix", "iy", "iz", "program_idx")
    p, q = F.col("program_idx"), F.col("other_program_idx")
    eligible = (p >= 0) | ((p == CORE) & F.lit(include_core))
    tag = F.when(F.col("other_voxel_idx").isNull(), "exterior").when(q == UNASSIGNED, "unallocated").when((q == CORE) & F.lit(not include_core), "core_ignored").when(p == q, "same_program").otherwise("face")
    joined = met(slim.where(eligible), slim, _UP, "left").withColumn("tag", tag)
    swap = (F.col("tag") == "face") & ((p == CORE) | ((q != CORE) & (q < p)))
    return joined.select(
        "grid_id", F.col("dir").alias("axis"), "tag",
        F.when(swap, q).otherwise(p).alias("program_a"), F.when(swap, p).otherwise(q).alias("program_b"),
        F.when(swap, F.col("other_voxel_idx")).otherwise(F.col("voxel_idx")).alias("voxel_a"), F.when(swap, F.col("voxel_idx")).otherwise(F.col("other_voxel_idx")).alias("voxel_b"),
        F.when(swap, -1).otherwise(1).alias("direction"),
    )


def caps(cells: DataFrame, include_core: bool = True) -> DataFrame:
    """Horizontal caps of program voxels: sides up or down that meet neither a program nor an included core."""
    slim = cells.select("grid_id", "voxel_idx", "ix", "iy", "iz", "program_idx")
    q = F.col("other_program_idx")
    kind = F.when(F.col("other_voxel_idx").isNull(), "exterior").when((q == CORE) & F.lit(not include_core), "core").when(q == UNASSIGNED, "unallocated")
    joined = met(slim.where("program_idx >= 0"), slim, [(1, DIRECTIONS[4]), (-1, DIRECTIONS[5])], "left").withColumn("kind", kind)
    return joined.where("kind is not null").select("grid_id", F.col("program_idx").alias("program_a"), F.lit(-1).alias("program_b"), F.col("voxel_idx").alias("voxel_a"), F.coalesce("other_voxel_idx", F.lit(-1)).alias("voxel_b"), F.col("dir").alias("direction"), "kind")


def adjacency(touching: DataFrame, voxel_size: float = 1.0) -> DataFrame:
    """Face count and area of each pair of programs that touch."""
    faces = touching.where("tag = 'face'").groupBy("grid_id", "program_a", "program_b").agg(F.count(F.lit(1)).alias("faces"))
    return faces.withColumn("area", F.col("faces") * F.lit(float(voxel_size**2))).withColumn("to_core", F.col("program_b") == CORE)


def contact_counts(touching: DataFrame) -> DataFrame:
    return touching.groupBy("grid_id", "tag").agg(F.count(F.lit(1)).alias("contacts"))


def cap_counts(capped: DataFrame) -> DataFrame:
    """Caps of each kind: exterior, unallocated, and core where cores are left out."""
    return capped.groupBy("grid_id", "kind").agg(F.count(F.lit(1)).alias("caps"))


def faces(touching: DataFrame, capped: DataFrame | None = None) -> DataFrame:
    """(grid_id, axis, program_a, program_b, voxel_a, voxel_b, direction, kind): the faces of `contacts` and, if given, the rows of `caps`."""
    between = touching.where("tag = 'face'").drop("tag").withColumn("kind", F.lit("face"))
    return between if capped is None else between.unionByName(capped.withColumn("axis", F.lit(2)))


def placed(found: DataFrame, cells: DataFrame, origin: tuple[float, float, float] = (0, 0, 0), voxel_size: float = 1.0, plane: list[float] | None = None) -> DataFrame:
    """`faces` with iz of voxel A, corners, centre (x, y, z), unit normal (normal_x, ...) and area.

    Corners run counter-clockwise seen from the side the face looks to; all are
    put through a row-major 4 x 4 plane matrix if one is given.
    """
    own = cells.select("grid_id", F.col("voxel_idx").alias("voxel_a"), "ix", "iy", "iz")
    number = F.col("axis") * 2 + F.when(F.col("direction") < 0, 1).otherwise(0)

    def of_direction(values: list) -> Column:
        return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (number + 1).cast("int"))

    def turned(v: list[Column], shift: float) -> list[Column]:
        if plane is None:
            return v
        return [sum((F.lit(float(plane[4 * k + j])) * v[j] for j in range(3)), F.lit(shift * float(plane[4 * k + 3]))) for k in range(3)]

    corners = [turned([float(o) + (F.col(f"i{c}") + of_direction([d[n][k] for d in CORNERS])) * float(voxel_size) for k, (c, o) in enumerate(zip("xyz", origin, strict=True))], 1.0) for n in range(4)]
    towards = turned([of_direction([d[k] for d in DIRECTIONS]) for k in range(3)], 0.0)
    length = F.sqrt(sum((t * t for t in towards[1:]), towards[0] * towards[0]))
    centre = [sum((c[k] for c in corners[1:]), corners[0][k]) / 4 for k in range(3)]
    rows, on = 4 * cells.count(), ["grid_id", "voxel_a"]
    return parted(found, rows, *on).join(parted(own, rows, *on), on).select(
        *found.columns, "iz", F.array(*(F.struct(*(v.alias(c) for c, v in zip("xyz", corner, strict=True))) for corner in corners)).alias("corners"),
        *(v.alias(c) for c, v in zip("xyz", centre, strict=True)), *((t / length).alias(f"normal_{c}") for c, t in zip("xyz", towards, strict=True)),
        F.lit(float(voxel_size) ** 2).alias("area"),
    )
