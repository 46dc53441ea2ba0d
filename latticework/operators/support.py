"""Which voxels reach the ground."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import bricks
from latticework.operators.allocation import UNASSIGNED
from latticework.sources.voxels import CELL, KEY


def ground_contact(voxels: DataFrame, origin_z: float = 0.0, voxel_size: float = 1.0) -> DataFrame:
    """Voxels whose lower face is on or below the ground plane."""
    return voxels.where(origin_z + F.col("iz") * voxel_size <= max(1e-9, voxel_size * 1e-9)).select(*KEY)


def _carried(limit: int):
    def solve(planes, fixed, _corner):
        """Steps to the side that each cell needs before the next one down, from `fixed[1]` and what lies around."""
        need = bricks.inner(planes[0])
        empty = fixed[0] >= bricks.FAR
        need[...] = np.where(fixed[1] < bricks.FAR, 0, bricks.FAR)
        while True:
            held = bricks.looked(planes[0], 2, -1) < bricks.FAR
            side = np.minimum.reduce([bricks.looked(planes[0], k, s) for k in range(2) for s in (1, -1)]) + 1
            new = np.where(empty, bricks.FAR, np.minimum(need, np.where(held, 0, np.where(side <= limit, side, bricks.FAR))))
            if (new == need).all():
                return new[None]
            need[...] = new

    return solve


def support(cells: DataFrame, ground: DataFrame, max_cantilever: int = 4, max_rounds: int = 10_000) -> DataFrame:
    """(grid_id, voxel_idx, program_idx, overhang): sideways steps each voxel needs before the next step down; null where no route to the ground exists.

    A route goes down or sideways, never up, with at most max_cantilever
    sideways steps in a row; any voxel carries. Ground rows that are no voxels
    are dropped. Support spreads inside bricks; a round goes on only where a
    brick's face changed.
    """
    slim = cells.select(*KEY, *CELL[1:], "program_idx")
    grounded = slim.join(ground.select(*KEY).distinct().withColumn("ground", F.lit(0).cast("long")), KEY, "left")
    settled = bricks.settle(grounded, ["ground", "program_idx"], 1, _carried(int(max_cantilever)), max_rounds)

    def rows(planes, fixed, place):
        at = tuple(place)
        return {"cell": np.arange(place.shape[1]), "program_idx": fixed[2][at], "overhang": bricks.inner(planes[0])[at]}

    return bricks.unpacked(settled, "program_idx int, overhang int", rows).select(*KEY, "program_idx", "overhang")


def support_report(supported: DataFrame, retained_fraction: float = 0.25) -> DataFrame:
    """Allocated and grounded voxels, and the target count of structure among the unassigned ones."""
    allocated = F.col("program_idx") != UNASSIGNED
    return supported.groupBy("grid_id").agg(
        F.count_if(allocated).alias("allocated"), F.count_if(allocated & F.col("overhang").isNotNull()).alias("grounded"),
        F.ceil(F.count_if(~allocated) * F.lit(retained_fraction)).alias("target"),
    )
