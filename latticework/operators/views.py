"""How far voxels see: rays against obstacle triangles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.sources.voxels import KEY


def sphere_directions(spark: SparkSession, samples: int) -> DataFrame:
    """(ray, dx, dy, dz): at least four directions on a Fibonacci sphere."""
    n = max(4, samples)
    i = F.col("id").cast("double")
    y = 1.0 - 2.0 * i / (n - 1)
    r = F.sqrt(F.greatest(F.lit(0.0), 1.0 - y * y))
    angle = math.pi * (3.0 - math.sqrt(5.0)) * i
    return spark.range(n).select(F.col("id").alias("ray"), (F.cos(angle) * r).alias("dx"), y.alias("dy"), (F.sin(angle) * r).alias("dz"))


def planar_directions(spark: SparkSession, samples: int, up: tuple[float, float, float] = (0, 0, 1)) -> DataFrame:
    """(ray, dx, dy, dz): at least four directions at equal angles in the plane across `up`."""
    n = max(4, samples)
    length = math.sqrt(sum(u * u for u in up))
    z = [u / length for u in up]
    x = _cross(z, (0, 0, 1))
    if math.sqrt(sum(v * v for v in x)) < 1e-6:
        x = _cross(z, (1, 0, 0))
    length = math.sqrt(sum(v * v for v in x))
    x = [v / length for v in x]
    y = _cross(z, x)
    angle = 2.0 * math.pi * F.col("id") / n
    return spark.range(n).select(F.col("id").alias("ray"), *((F.cos(angle) * float(a) + F.sin(angle) * float(b)).alias(f"d{c}") for c, a, b in zip("xyz", x, y, strict=True)))


def _cross(a, b) -> list[float]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


#: triangles of one block, and centres of one
TRIANGLES, CENTRES = 256, 2048
_CORNERS = [f"{p}{c}" for p in "abc" for c in "xyz"]


#: tests of a centre against a triangle along a ray that are done at once
TESTS = 1 << 20


def _across(rays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unit vectors that span the plane across each unit direction."""
    u = np.cross(rays, np.where(np.abs(rays[:, 2:]) > 0.9, (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)))
    u = u / np.sqrt((u * u).sum(axis=1, keepdims=True))
    return u, np.cross(rays, u)


def _nearest(at: np.ndarray, corners: np.ndarray, rays: np.ndarray, axes: tuple[np.ndarray, np.ndarray], near: np.ndarray) -> None:
    """Lower `near` (rays by centres) to the distance at which each ray from each centre meets one of the triangles.

    Seen along a ray a triangle is a flat one: those whose box there does not
    meet the box of the centres, or that lie behind all of them, are left out.
    The pairs of ray and triangle that stay are tested all together.
    """
    open_ = (corners @ rays.T).max(axis=1) >= (at @ rays.T).min(axis=0) - 1e-6
    for axis in axes:
        mine, other = at @ axis.T, corners @ axis.T
        open_ &= (other.max(axis=1) >= mine.min(axis=0) - 1e-6) & (other.min(axis=1) <= mine.max(axis=0) + 1e-6)
    # by ray, then triangle
    r, k = np.nonzero(open_.T)
    a, e1, e2 = corners[:, 0], corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    p = np.cross(rays[r], e2[k])
    det = (e1[k] * p).sum(axis=1)
    some = np.abs(det) > 1e-12
    r, k, p, det = r[some], k[some], p[some], det[some, None]
    if not len(r):
        return
    p, w = p / det, np.cross(e1[k], rays[r]) / det
    # how far a centre is off the plane of a triangle does not depend on the ray
    met, k = np.unique(k, return_inverse=True)
    off = np.stack([(np.cross(at - a[m], e1[m]) * e2[m]).sum(axis=1) for m in met])
    a = a[met][k]
    ps, ws = (p * a).sum(axis=1, keepdims=True), (w * a).sum(axis=1, keepdims=True)
    size = max(1, TESTS // len(at))
    for i in range(0, len(r), size):
        cut = slice(i, i + size)
        s, t, far = p[cut] @ at.T - ps[cut], w[cut] @ at.T - ws[cut], off[k[cut]] / det[cut]
        far[~((s >= -1e-9) & (t >= -1e-9) & (s + t <= 1 + 1e-9) & (far >= 0))] = np.inf
        mine, first = np.unique(r[cut], return_index=True)
        near[mine] = np.minimum(near[mine], np.minimum.reduceat(far, first, axis=0))


def _lost(rays: np.ndarray, radius: float):
    """(grid_id, voxel_idx, lost) of blocks of centres, whose blocks of triangles follow one another in a partition."""

    def run(batches):
        axes = _across(rays)
        key = ids = grid_id = near = at = None

        def told():
            return pa.record_batch([pa.array([grid_id] * len(ids), pa.string()), pa.array(ids), pa.array((radius - near).sum(axis=0))], names=[*KEY, "lost"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                mine = tuple(row[c][0] for c in ("grid_id", "x_bin", "y_bin", "z_bin", "part"))
                if mine != key:
                    if key is not None:
                        yield told()
                    key, grid_id, ids = mine, row["grid_id"][0], np.array(row["ids"][0], dtype=np.int64)
                    at = np.array([row[c][0] for c in "xyz"]).T
                    near = np.full((len(rays), len(ids)), radius)
                _nearest(at, np.array([row[c][0] for c in _CORNERS]).T.reshape(-1, 3, 3), rays, axes, near)
        if key is not None:
            yield told()

    return run


def _parts(df: DataFrame, group: list[str], most: int) -> DataFrame:
    """`df` with `part`, a hash that cuts each group into parts of about `most` rows."""
    sizes = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    return df.join(sizes, group).withColumn("part", F.pmod(F.xxhash64(*df.columns), F.col("parts"))).drop("parts")


def view(centers: DataFrame, directions: DataFrame, triangles: DataFrame | None, radius: float = 1000.0, label: str = "sky_view", bin_size: float = 8.0) -> DataFrame:
    """Sum over directions of the distance to the nearest triangle, at most `radius`, as a channel; 0 below grade (z < 0).

    `centers` has grid_id, voxel_idx, x, y, z; `triangles` has grid_id and
    corners ax to cz. Centres are packed into blocks, by cubes of side bin_size,
    and triangles into blocks of any place. A block of centres meets those of its
    grid within the radius, one after the other, and keeps for each centre and
    ray the least distance so far. Nothing is repeated by the size of a triangle,
    and no row stands for a ray. Rows with a null in a coordinate see nothing.
    """
    radius = max(1.0, float(radius))
    rays = np.array([tuple(r) for r in directions.orderBy("ray").select("dx", "dy", "dz").collect()])
    above = centers.select(*KEY, "x", "y", "z").where(F.col("z") >= 0)
    if triangles is None:
        lost = above.select(*KEY).withColumn("lost", F.lit(0.0))
    else:
        block = ["grid_id", "x_bin", "y_bin", "z_bin", "part"]
        binned = above.dropna().select("*", *(F.floor(F.col(c) / bin_size).alias(f"{c}_bin") for c in "xyz"))
        points = _parts(binned, block[:-1], CENTRES).groupBy(*block).agg(F.collect_list(F.struct("voxel_idx", "x", "y", "z")).alias("p"), *(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xyz"))
        slim = triangles.select("grid_id", *(F.col(c).cast("double").alias(c) for c in _CORNERS)).dropna().distinct()
        edge = {n: [f(*(f"{p}{c}" for p in "abc")) for c in "xyz"] for n, f in (("from", F.least), ("to", F.greatest))}
        shapes = _parts(slim, ["grid_id"], TRIANGLES).groupBy("grid_id", F.col("part").alias("shape")).agg(
            F.collect_list(F.struct(*_CORNERS)).alias("t"), *(F.min(e).alias(f"from_{c}") for c, e in zip("xyz", edge["from"], strict=True)), *(F.max(e).alias(f"to_{c}") for c, e in zip("xyz", edge["to"], strict=True))
        )
        gap = [F.greatest(F.lit(0.0), F.col(f"from_{c}") - F.col(f"high_{c}"), F.col(f"low_{c}") - F.col(f"to_{c}")) for c in "xyz"]
        met = points.join(shapes, "grid_id").where(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= radius * radius)
        rows = met.select(*block, F.col("p.voxel_idx").alias("ids"), *(F.col(f"p.{c}").alias(c) for c in "xyz"), *(F.col(f"t.{c}").alias(c) for c in _CORNERS))
        # all blocks of triangles of one block of centres in a row, wherever that is
        lost = rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(_lost(rays, radius), "grid_id string, voxel_idx long, lost double")
    seen = centers.select(*KEY, "z").join(lost, KEY, "left")
    value = F.when(F.col("z") >= 0, len(rays) * radius - F.coalesce("lost", F.lit(0.0))).otherwise(0.0)
    return seen.select(*KEY, F.lit(label).alias("label"), value.alias("value"))


def sky_view(centers: DataFrame, triangles: DataFrame | None = None, samples: int = 200, radius: float = 1000.0) -> DataFrame:
    return view(centers, sphere_directions(centers.sparkSession, samples), triangles, radius, "sky_view")


def horizon_view(centers: DataFrame, triangles: DataFrame | None = None, samples: int = 72, radius: float = 1000.0) -> DataFrame:
    return view(centers, planar_directions(centers.sparkSession, samples), triangles, radius, "horizon_view")
