"""Voxels of closed triangle meshes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.session import PART, written
from latticework.sources.voxels import from_keys

#: columns of centres that the triangles of a mesh may meet, and its cells, for a task to hold it; and of those that it takes at once
COLUMNS, AT_ONCE = 1 << 22, 1 << 21
#: meshes are counted by hashes in so many ranges first
_RANGES = 1 << 17
_CORNERS = [f"{p}{c}" for p in "abc" for c in "xyz"]
#: the axis along which rays go, and the two across it
_AXES = [("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")]


def grids_of(triangles: DataFrame, resolution: int = 10) -> DataFrame:
    """(grid_id, ox, oy, oz, voxel_size, nx, ny, nz) of meshes given as (grid_id, ax, ay, az, bx .. cz) rows."""
    if resolution < 1:
        raise ValueError("a resolution below 1")
    low = [F.min(F.least(*(f"{p}{c}" for p in "abc"))).alias(f"o{c}") for c in "xyz"]
    high = [F.max(F.greatest(*(f"{p}{c}" for p in "abc"))).alias(f"t{c}") for c in "xyz"]
    box = triangles.dropna().groupBy("grid_id").agg(*low, *high)
    side = F.greatest(*(F.col(f"t{c}") - F.col(f"o{c}") for c in "xyz")) / resolution
    sized = box.withColumn("voxel_size", side).where("voxel_size > 0")
    return sized.select("grid_id", "ox", "oy", "oz", "voxel_size", *(F.greatest(F.lit(1), F.ceil((F.col(f"t{c}") - F.col(f"o{c}")) / F.col("voxel_size"))).cast("int").alias(f"n{c}") for c in "xyz"))


def voxelize(rows: DataFrame, resolution: int = 10, triangles: Callable[[DataFrame], DataFrame] | None = None, each: int = 1) -> DataFrame:
    """Voxels whose centre is inside: at least four of the six axis rays cross the mesh an odd number of times.

    Crossings nearer than a ten-thousandth of a voxel count once. Rows with a null
    are dropped, meshes without extent have no voxels. `rows` are triangles, or,
    where `triangles` makes these of them, rows with a grid_id that stand for
    `each` of them: then only the rows are dealt out. A task takes many meshes at
    a time; one that could meet over COLUMNS columns goes by lines over all tasks.
    """
    if resolution < 1:
        raise ValueError("a resolution below 1")
    made = triangles or (lambda df: df)
    rows = rows.where("grid_id is not null")
    most = COLUMNS // (len(_AXES) * (resolution + 1) ** 2)
    if (resolution + 1) ** 3 > COLUMNS:
        return _by_lines(made(rows), resolution)
    share = rows.groupBy(F.pmod(F.xxhash64("grid_id"), F.lit(_RANGES))).agg(F.count(F.lit(1)).alias("n"))
    total, greatest = share.agg(F.sum("n"), F.max("n")).first()
    large = None
    if (greatest or 0) * each > most:
        sizes, seen = written(rows.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * each > most), n=F.count(F.lit(1)))
        if seen["n"]:
            rows, large = (rows.join(sizes.select("grid_id"), "grid_id", how) for how in ("left_anti", "left_semi"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) * each // PART))
    small = made(rows.repartition(parts, "grid_id")).select(F.col("grid_id").cast("string").alias("grid_id"), *(F.col(c).cast("double").alias(c) for c in _CORNERS)).dropna()
    found = small.mapInArrow(_filled(resolution), "grid_id string, voxel_idx long, ix int, iy int, iz int")
    return found if large is None else found.unionByName(_by_lines(made(large), resolution))


def _filled(resolution: int):
    """Function from the triangles of whole meshes to their voxels, some AT_ONCE columns and cells at a time."""
    a_triangle, a_mesh = len(_AXES) * (resolution + 1) ** 2, (resolution + 1) ** 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([*batches] or [pa.RecordBatch.from_pylist([], pa.schema([("grid_id", pa.string()), *((c, pa.float64()) for c in _CORNERS)]))])
        names = rows["grid_id"].combine_chunks().dictionary_encode()
        mesh = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(mesh, kind="stable")
        starts = np.flatnonzero(np.diff(mesh[order], prepend=-1))
        corners = [rows[c].to_numpy() for c in _CORNERS]
        held = starts * a_triangle + np.arange(len(starts)) * a_mesh
        cuts = starts[np.flatnonzero(np.diff(held // AT_ONCE, prepend=-1))]
        for a, b in zip(cuts, [*cuts[1:], len(order)][: len(cuts)], strict=True):
            at = order[a:b]
            code, cell = _inside(mesh[at], np.array([c[at] for c in corners]).reshape(3, 3, -1), resolution)
            yield pa.record_batch([names.dictionary.take(pa.array(code)), *map(pa.array, cell)], names=["grid_id", "voxel_idx", "ix", "iy", "iz"])

    return run


def _inside(mesh: np.ndarray, corners: np.ndarray, resolution: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Meshes of the voxels, and their indices and places; `mesh` is sorted, `corners` are by corner, axis and triangle. As `_by_lines`."""
    start = np.flatnonzero(np.diff(mesh, prepend=-1))
    low, high = np.minimum.reduceat(corners.min(axis=0), start, axis=1), np.maximum.reduceat(corners.max(axis=0), start, axis=1)
    side = (high - low).max(axis=0) / resolution
    if not np.isfinite(side).all():
        raise ValueError("a mesh without bounds")
    sized = side > 0
    of = np.repeat(np.cumsum(sized) - 1, np.diff(start, append=len(mesh)))
    kept = np.repeat(sized, np.diff(start, append=len(mesh)))
    low, high, side, names, of, corners = low[:, sized], high[:, sized], side[sized], mesh[start][sized], of[kept], corners[:, :, kept]
    if not len(names):
        return names, [np.zeros(0, np.int64), *(np.zeros(0, np.int32) for _ in range(3))]
    n = np.maximum(1, np.ceil((high - low) / side)).astype(np.int64)
    # in units of voxels, centres at whole numbers plus a half
    unit = (corners - low[:, of]) / side[of]
    cells = n.prod(axis=0)
    base = np.cumsum(cells) - cells
    owner = np.repeat(np.arange(len(cells)), cells)
    # places, and the numbers of cells counted along each axis, are looked up by the shape of the grid
    shapes, which = np.unique(n, axis=1, return_inverse=True)
    starts, table = _places(shapes)
    first = base[owner]
    entry = (starts[which.reshape(-1)] - base)[owner] + np.arange(len(owner))
    votes = np.zeros(len(owner), np.int8)
    for k, axes in enumerate(_AXES):
        w, u, v = ("xyz".index(c) for c in axes)
        line, at = _crossings(unit[:, [w, u, v]], of, base, n[[w, u, v]])
        votes += _odd(line, at, n[w], owner, len(owner))[first + table[3 + k][entry]]
    hit = np.flatnonzero(votes >= 4)
    owner, place = owner[hit], [t[entry[hit]] for t in table[:3]]
    # the index counts in the box of the voxels
    sides = [np.zeros(len(cells), np.int64) for _ in range(2)]
    for x, p in zip(sides, place[1:], strict=True):
        np.maximum.at(x, owner, p + 1)
    index = (place[0] * sides[0][owner] + place[1]) * sides[1][owner] + place[2]
    return names[owner], [index, *(p.astype(np.int32) for p in place)]


def _places(shapes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each shape begins in a table of its cells: their places x, y, z, and their numbers counted along each of _AXES."""
    cells = shapes.prod(axis=0)
    starts = np.cumsum(cells) - cells
    x, y, z = np.repeat(shapes, cells, axis=1)
    inside = np.arange(cells.sum()) - np.repeat(starts, cells)
    sides, place = {"x": x, "y": y, "z": z}, {"x": inside // (y * z), "y": inside // z % y, "z": inside % z}
    return starts, [*place.values(), *((place[u] * sides[v] + place[v]) * sides[w] + place[w] for w, u, v in _AXES)]


def _crossings(unit: np.ndarray, of: np.ndarray, base: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of centres, each by the number of its first cell when cells are counted along them, and where triangles cross them, sorted; of axes w, u, v."""
    a, b, c = unit
    area = (b[1] - a[1]) * (c[2] - a[2]) - (c[1] - a[1]) * (b[2] - a[2])
    met = np.flatnonzero(area)
    (a, b, c), area, of = unit[:, :, met], area[met], of[met]
    flat = np.array([a[1:], b[1:], c[1:]])
    first = np.maximum(np.ceil(flat.min(axis=0) - 0.5 - 1e-9), 0).astype(np.int64)
    many = np.maximum(np.minimum(np.floor(flat.max(axis=0) - 0.5 + 1e-9), n[1:][:, of] - 1).astype(np.int64) - first + 1, 0)
    each = many[0] * many[1]
    # of each triangle, for all columns that its outline covers
    au, av, bu, bv, cu, cv, area_ = np.repeat([a[1], a[2], b[1] - a[1], b[2] - a[2], c[1] - a[1], c[2] - a[2], area], each, axis=1)
    t, fu, fv, wide, gone = np.repeat([np.arange(len(met)), *first, many[1], np.cumsum(each) - each], each, axis=1)
    k = np.arange(len(t)) - gone
    iu = k // np.maximum(wide, 1)
    iv = k - iu * wide + fv
    iu += fu
    pu, pv = iu + 0.5 - au, iv + 0.5 - av
    s, r = (pu * cv - cu * pv) / area_, (bu * pv - pu * bv) / area_
    on = np.flatnonzero((s >= -1e-9) & (r >= -1e-9) & (s + r <= 1 + 1e-9))
    t, s, r = t[on], s[on], r[on]
    at = a[0][t] + s * (b[0] - a[0])[t] + r * (c[0] - a[0])[t]
    mesh = of[t]
    line = base[mesh] + (iu[on] * n[2][mesh] + iv[on]) * n[0][mesh]
    # by place, then by line: sorting numbers is faster than sorting by both
    order = np.argsort(at)
    key = line[order] * len(at) + np.arange(len(at))
    key.sort()
    order = order[key % max(len(at), 1)]
    line, at = line[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (line[1:] != line[:-1]) | (at[1:] - at[:-1] > 1e-4)
    return line[new], at[new]


def _odd(line: np.ndarray, at: np.ndarray, long: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """How many of the two rays from each cell along its line cross an odd number of times; cells are counted along lines."""
    end = line + long[owner[line]] if len(line) else line
    below = np.minimum(line + np.maximum(np.ceil(at - 0.5), 0).astype(np.int64), end)
    # what starts at a cell is taken back at the end of its line
    back = np.bincount(end, minlength=cells + 1)[: cells + 1]
    every = np.cumsum(np.bincount(line, minlength=cells + 1) - back)[:cells]
    below = np.cumsum(np.bincount(below, minlength=cells + 1) - back)[:cells]
    return ((every - below) % 2 + below % 2).astype(np.int8)


def _by_lines(triangles: DataFrame, resolution: int) -> DataFrame:
    """`voxelize` with the crossings of each line as rows, for meshes that no task holds.

    Along each axis a triangle meets the columns of centres that its outline
    covers, so crossings come from an equi-join on columns.
    """
    grids = grids_of(triangles, resolution)
    # a grid row for every mesh is as long as the table, so it is never broadcast
    placed = triangles.dropna().join(grids.hint("merge"), "grid_id")
    # in units of voxels, centres at whole numbers plus a half
    unit = placed.select("grid_id", "nx", "ny", "nz", *(((F.col(f"{p}{c}") - F.col(f"o{c}")) / F.col("voxel_size")).alias(f"{p}{c}") for p in "abc" for c in "xyz"))
    # each triangle once for each axis w, with the axes u and v across it
    turned = [F.struct(F.lit(k).alias("axis"), *(F.col(f"{p}{c}").alias(f"{p}{n}") for p in "abcn" for n, c in zip("wuv", axes, strict=True))) for k, axes in enumerate(_AXES)]
    cover = unit.select("grid_id", F.explode(F.array(*turned)).alias("t")).select("grid_id", "t.*")
    for c in "uv":
        low = F.ceil(F.least(*(f"{p}{c}" for p in "abc")) - 0.5 - 1e-9)
        high = F.floor(F.greatest(*(f"{p}{c}" for p in "abc")) - 0.5 + 1e-9)
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.col(f"n{c}") - 1)
        cover = cover.where(low <= high).withColumn(f"i{c}", F.explode(F.sequence(low, high)))
    pu, pv = F.col("iu") + 0.5, F.col("iv") + 0.5
    a, b, c = ((F.col(f"{p}u"), F.col(f"{p}v")) for p in "abc")
    area = (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])
    s = ((pu - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (pv - a[1])) / F.nullif(area, F.lit(0.0))
    t = ((b[0] - a[0]) * (pv - a[1]) - (pu - a[0]) * (b[1] - a[1])) / F.nullif(area, F.lit(0.0))
    line = ["grid_id", "axis", "iu", "iv", "nw"]
    hit = cover.select(*line, *(f"{p}w" for p in "abc"), s.alias("s"), t.alias("t")).where("s >= -1e-9 and t >= -1e-9 and s + t <= 1 + 1e-9")
    hit = hit.select(*line, (F.col("aw") + F.col("s") * (F.col("bw") - F.col("aw")) + F.col("t") * (F.col("cw") - F.col("aw"))).alias("at"))
    every = hit.groupBy(*line).agg(F.array_sort(F.collect_list("at")).alias("all"))
    lines = every.withColumn("at", F.filter("all", lambda x, i: (i == 0) | (x - F.get("all", i - 1) > 1e-4)))
    each = lines.select(*line, "at", F.explode(F.sequence(F.lit(0), F.col("nw") - 1)).alias("iw"))
    centre = F.col("iw") + 0.5
    ahead = F.size("at") - F.aggregate("at", F.lit(0), lambda n, x: n + (x <= centre).cast("int"))
    place = [F.element_at(F.array(*(F.col(f"i{'wuv'[axes.index(c)]}") for axes in _AXES)), F.col("axis") + 1).alias(f"i{c}") for c in "xyz"]
    odd = each.select("grid_id", *place, (ahead % 2 + (F.size("at") - ahead) % 2).alias("odd")).where("odd > 0")
    inside = odd.groupBy("grid_id", "ix", "iy", "iz").agg(F.sum("odd").alias("odd")).where("odd >= 4")
    return from_keys(inside, many=True)
