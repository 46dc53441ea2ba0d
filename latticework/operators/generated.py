"""Cores that are generated: scored cells, cheapest stacked paths, and what they cover."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from latticework.operators import bricks, whole
from latticework.session import checkpointed, counted, written
from latticework.sources.voxels import CELL, KEY

#: fixed values: voxels of a floor that stand for all of them, shares of the own, lower and upper floor, most cores
SAMPLE = 50
SHARES = (0.60, 0.25, 0.15)
MOST_CORES = 20
#: cells a side of the tiles that a task holds with the cells around them
TILE = 32
_AROUND = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]


def floor_ranks(voxels: DataFrame) -> DataFrame:
    """(grid_id, iz, level): the existing floors of each grid, numbered from 0."""
    floors = voxels.select("grid_id", "iz").distinct()
    return floors.withColumn("level", F.row_number().over(Window.partitionBy("grid_id").orderBy("iz")) - 1)


def floor_distances(voxels: DataFrame, voxel_size: float = 1.0) -> DataFrame:
    """(grid_id, voxel_idx, distance): mean distance to the first SAMPLE voxels of the same floor."""
    first = Window.partitionBy("grid_id", "iz").orderBy("voxel_idx")
    some = voxels.select(*KEY, *CELL[1:]).withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE)
    samples = some.groupBy("grid_id", "iz").agg(F.array_sort(F.collect_list(F.struct("k", F.col("ix").alias("x"), F.col("iy").alias("y")))).alias("sample"))
    dx, dy = (lambda s: (F.col("ix") - s["x"]), lambda s: (F.col("iy") - s["y"]))
    total = F.aggregate("sample", F.lit(0.0), lambda a, s: a + F.sqrt((dx(s) * dx(s) + dy(s) * dy(s)).cast("double")) * float(voxel_size))
    return voxels.select(*KEY, *CELL[1:]).join(samples, ["grid_id", "iz"]).select(*KEY, (total / F.size("sample")).alias("distance"))


def _tiled(cells: DataFrame, axes: list[str]) -> DataFrame:
    """Each row once for its tile of TILE cells a side, and for each tile that it touches, as t0, t1, ..."""
    out = cells
    for k, c in enumerate(axes):
        out = out.withColumn(f"t{k}", F.explode(F.array_distinct(F.array(*(F.shiftright(F.col(c) + s, TILE.bit_length() - 1) for s in (-1, 0, 1))))))
    return out


def _spots(rows: pa.Table, corner: list[int], axes: list[str]) -> tuple[np.ndarray, ...]:
    """Places of rows in a tile that has one more cell on each side."""
    return tuple(np.asarray(rows[c]).astype(np.int64) - TILE * t + 1 for c, t in zip(axes, corner, strict=True))


def blended(scored: DataFrame) -> DataFrame:
    """(grid_id, voxel_idx, ix, iy, iz, level, score) of rows with a raw score: each mixed with its floors below and above.

    A neighbouring floor counts with its mean over the 3 x 3 cells there, or, if
    it has none of them, with its first voxel; where there is no such floor, 0.
    """
    axes = ["ix", "iy", "level"]

    def means(rows: pa.Table) -> pa.Table:
        corner = [rows[f"t{k}"][0].as_py() for k in range(3)]
        spot = _spots(rows, corner, axes)
        total, n = np.zeros((TILE + 2,) * 3), np.zeros((TILE + 2,) * 3, np.int64)
        raw, one = np.zeros(total.shape), np.zeros(total.shape, np.int64)
        raw[spot], one[spot] = rows["raw"].to_numpy(), 1
        for x, y in _AROUND:
            total[1:-1, 1:-1] += raw[1 + x : TILE + 1 + x, 1 + y : TILE + 1 + y]
            n[1:-1, 1:-1] += one[1 + x : TILE + 1 + x, 1 + y : TILE + 1 + y]
        mine = np.flatnonzero(np.logical_and.reduce([(s > 0) & (s <= TILE) for s in spot]))
        out = rows.select(names).take(pa.array(mine))
        for name, step in (("below", -1), ("above", 1)):
            at = (spot[0][mine], spot[1][mine], spot[2][mine] + step)
            out = out.append_column(f"{name}_mean", pa.array(total[at] / np.maximum(n[at], 1), mask=n[at] == 0))
        return out

    names = scored.columns
    schema = StructType([*scored.schema.fields, *(StructField(f"{n}_mean", DoubleType()) for n in ("below", "above"))])
    firsts = scored.groupBy("grid_id", "level").agg(F.min_by("raw", "voxel_idx").alias("first"))
    out = _tiled(scored, axes).groupBy("grid_id", "t0", "t1", "t2").applyInArrow(means, schema)
    for name, step in (("below", 1), ("above", -1)):
        first = firsts.select("grid_id", (F.col("level") + step).alias("level"), F.col("first").alias(f"{name}_first"))
        out = out.join(F.broadcast(first), ["grid_id", "level"], "left")
    near = [F.coalesce(f"{n}_mean", f"{n}_first", F.lit(0.0)) for n in ("below", "above")]
    return out.select(*KEY, *CELL[1:], "level", (SHARES[0] * F.col("raw") + SHARES[1] * near[0] + SHARES[2] * near[1]).alias("score"))


def _within(steps: int):
    """Steps of each cell from the nearest of `fixed[1]` over cells of its floor, up to `steps`."""

    def solve(planes, fixed, _corner):
        taken = bricks.inner(planes[0])
        taken[...] = np.where(fixed[1] < bricks.FAR, 0, bricks.FAR)
        while True:
            side = np.minimum.reduce([bricks.looked(planes[0], k, s) for k in range(2) for s in (1, -1)]) + 1
            new = np.where((fixed[0] < bricks.FAR) & (side <= steps), np.minimum(taken, side), taken)
            if (new == taken).all():
                return new[None]
            taken[...] = new

    return solve


def floor_coverage(voxels: DataFrame, core: DataFrame, max_distance: float, voxel_size: float = 1.0) -> DataFrame:
    """(grid_id, voxel_idx) of voxels within max_distance of a core voxel over steps between the cells of their floor."""
    seeds = core.select(*KEY).distinct().withColumn("seed", F.lit(0).cast("long"))
    cells = voxels.select(*KEY, *CELL[1:]).join(seeds, KEY, "left")
    settled = bricks.settle(cells, ["seed"], 1, _within(int(max_distance / voxel_size + 1e-9)))
    return bricks.unpacked(settled, "steps int", names=["steps"]).where("steps is not null").select(*KEY)


def _stepped(penalty: float):
    """Function of a tile's cells and of the path ends under and around them: the cells with the cost of the cheapest path on to them, and the end it comes from."""

    def step(here: pa.Table, under: pa.Table) -> pa.Table:
        if not here.num_rows or not under.num_rows:
            return here.slice(0, 0).select([*KEY, "ix", "iy", "cost"]).append_column("before", pa.array([], pa.int64()))
        corner = [here[f"t{k}"][0].as_py() for k in range(2)]
        so_far, end = np.zeros((TILE + 2,) * 2), np.full((TILE + 2,) * 2, -1)
        spot = _spots(under, corner, ["x", "y"])
        so_far[spot], end[spot] = under["so_far"].to_numpy(), under["v"].to_numpy()
        at, cost = _spots(here, corner, ["ix", "iy"]), here["cost"].to_numpy()
        best, before = np.full(len(cost), np.inf), np.full(len(cost), -1)
        for x, y in _AROUND:
            v = end[at[0] + x, at[1] + y]
            total = so_far[at[0] + x, at[1] + y] + cost + np.sqrt(float(x * x + y * y)) * penalty
            better = (v >= 0) & ((before < 0) | (total < best) | ((total == best) & (v < before)))
            best, before = np.where(better, total, best), np.where(better, v, before)
        out = here.select([*KEY, "ix", "iy"]).append_column("cost", pa.array(best)).append_column("before", pa.array(before))
        return out.filter(pa.array(before >= 0))

    return step


def core_path(cells: DataFrame, penalty: float) -> DataFrame:
    """(grid_id, voxel_idx, ix, iy, iz) of the cheapest stacked path of each grid with uncovered cells.

    `cells` has the score, the level and whether a cell is covered. A path starts
    on the lowest floor with an uncovered cell and goes up a floor at a time, at
    most one cell sideways, which costs `penalty` a cell; covered cells score 0.
    It ends at the cheapest uncovered cell of the highest floor that has one, or
    else the cheapest cell there, or else it is the uncovered cell of least score
    on its first floor. Ties go to the lesser index.
    """
    open_ = cells.where("not covered").groupBy("grid_id").agg(F.min("level").alias("bottom"), F.max("level").alias("top"))
    rows = checkpointed(cells.join(open_, "grid_id").select(*KEY, *CELL[1:], "level", "bottom", "top", "covered", "score", F.when(F.col("covered"), 0.0).otherwise(F.col("score")).alias("cost")))
    span = rows.agg(F.min("bottom"), F.max("top")).first()
    none = F.lit(None).cast("long").alias("before")
    layers, below = [], None
    for level in range(span[0], span[1] + 1) if span[0] is not None else ():
        here = rows.where(F.col("level") == level)
        layer = here.where("level = bottom").select(*KEY, "ix", "iy", "cost", none)
        if below is not None:
            under = _tiled(below.select("grid_id", F.col("voxel_idx").alias("v"), F.col("ix").alias("x"), F.col("iy").alias("y"), F.col("cost").alias("so_far")), ["x", "y"]).withColumnsRenamed({"grid_id": "under", "t0": "u0", "t1": "u1"})
            tile = [F.shiftright(c, TILE.bit_length() - 1).alias(f"t{k}") for k, c in enumerate(("ix", "iy"))]
            step = here.where("level > bottom and level <= top").select(*KEY, "ix", "iy", "cost", *tile)
            layer = layer.unionByName(step.groupBy("grid_id", "t0", "t1").cogroup(under.groupBy("under", "u0", "u1")).applyInArrow(_stepped(float(penalty)), "grid_id string, voxel_idx long, ix int, iy int, cost double, before long"))
        below = checkpointed(layer)
        layers.append(below)
    if not layers:
        return rows.select(*KEY, *CELL[1:])
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer)
    ends = every.join(rows.where("level = top").select(*KEY, "covered"), KEY).groupBy("grid_id").agg(F.min_by("voxel_idx", F.struct("covered", "cost", "voxel_idx")).alias("voxel_idx"))
    lone = rows.where("level = bottom and not covered").groupBy("grid_id").agg(F.min_by("voxel_idx", F.struct("score", "voxel_idx")).alias("voxel_idx"))
    at = checkpointed(ends.unionByName(lone.join(ends, "grid_id", "left_anti")))
    path = at
    back = every.where("before is not null").select(*KEY, "before")
    for _ in range(len(layers)):
        at, seen = counted(at.join(back, KEY).select("grid_id", F.col("before").alias("voxel_idx")), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        path = path.unionByName(at)
    return path.join(rows.select(*KEY, *CELL[1:]), KEY)


def _around(whole: np.ndarray, x: int, y: int) -> np.ndarray:
    """What each place of the floors of a grid with a margin sees one step aside."""
    return whole[..., 1 + x : whole.shape[-2] - 1 + x, 1 + y : whole.shape[-1] - 1 + y]


#: steps of a cell that no core serves
_UNSERVED = 1 << 30


class _Grid:
    """The cells of one grid with their scores as floors of arrays with a margin of one place; see `generate_cores`."""

    def __init__(self, rows: pa.Table, max_distance: float, voxel_size: float):
        known = np.asarray(rows["voxel_idx"].is_valid())
        voxel = rows["voxel_idx"].fill_null(0).to_numpy()
        x, y = (rows[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("ix", "iy"))
        order = np.lexsort((voxel, known, rows["iz"].to_numpy()))
        known, voxel, x, y = (a[order] for a in (known, voxel, x, y))
        self.floors, start, level = np.unique(rows["iz"].to_numpy()[order], return_index=True, return_inverse=True)
        raw = np.empty(len(voxel))
        for a, b in zip(start, [*start[1:], len(voxel)], strict=True):
            some = slice(a, min(a + SAMPLE, b))
            far = np.sqrt((x[a:b] - x[some, None]) ** 2 + (y[a:b] - y[some, None]) ** 2) * voxel_size
            raw[a:b] = reduce(np.add, far) / len(far)
        raw = raw / max_distance
        # a floor whose sample has a row without a place has no distances
        blank = np.isnan(raw)
        if "bonus" in rows.column_names:
            raw = raw - rows["bonus"].to_numpy()[order]
        # each voxel once, by floor and index
        once = known & ~np.isnan(x) & ~np.isnan(y)
        once[1:] &= ~(known[:-1] & (voxel[1:] == voxel[:-1]) & (level[1:] == level[:-1]))
        at = np.flatnonzero(once)
        self.voxel, self.level = voxel[at], level[at]
        low = [int(a[at].min()) if len(at) else 0 for a in (x, y)]
        self.x, self.y = (a[at].astype(np.int64) - m + 1 for a, m in zip((x, y), low, strict=True))
        shape = (len(self.floors), *(int(a.max(initial=0)) + 2 for a in (self.x, self.y)))
        self.place = np.ravel_multi_index((self.level, self.x, self.y), shape)
        self.ends = np.searchsorted(self.level, np.arange(len(self.floors) + 1))
        self.index = np.full(shape, -1)
        self.index.reshape(-1)[self.place] = self.voxel
        self.score = self._blended(raw[at], blank[at], shape)
        self.blank = bool(np.isnan(self.score).any())
        #: steps to the nearest core, -1 where there is no cell
        self.steps = np.full(shape, -1, np.int32)
        self.steps.reshape(-1)[self.place] = _UNSERVED

    def _blended(self, raw: np.ndarray, blank: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
        """As `blended`."""
        held, one, total, n = np.zeros(shape), np.zeros(shape, np.int8), np.zeros(shape), np.zeros(shape, np.int8)
        held.reshape(-1)[self.place], one.reshape(-1)[self.place] = raw, 1
        inside = (slice(None), slice(1, -1), slice(1, -1))
        for x, y in _AROUND:
            total[inside] += _around(held, x, y)
            n[inside] += _around(one, x, y)
        first = np.zeros(shape[0])
        for f in range(shape[0]):
            if self.ends[f] < self.ends[f + 1] and not blank[self.ends[f]]:
                first[f] = raw[self.ends[f]]
        near = []
        for step in (-1, 1):
            there = self.level + step
            exists = (there >= 0) & (there < shape[0])
            f = np.where(exists, there, 0)
            cells = n[f, self.x, self.y]
            near.append(np.where(exists, np.where(cells > 0, total[f, self.x, self.y] / np.maximum(cells, 1), first[f]), 0.0))
        score = np.zeros(shape)
        score.reshape(-1)[self.place] = SHARES[0] * raw + SHARES[1] * near[0] + SHARES[2] * near[1]
        return score

    def path(self, penalty: float) -> list[tuple[int, int, int]]:
        """Floor and place on it of the cells of the cheapest stacked path, as `core_path`; the grid has an uncovered cell."""
        open_ = (self.steps == _UNSERVED).any(axis=(1, 2)).nonzero()[0]
        bottom, top = open_[0], open_[-1]
        cost = np.where(self.steps == _UNSERVED, self.score, 0.0)
        aside = [np.sqrt(float(x * x + y * y)) * penalty for x, y in _AROUND]
        # by floor the cost of the cheapest path on to each cell, infinite where there is none
        so_far = np.full((top - bottom + 1, *cost.shape[1:]), np.inf)
        so_far[0] = np.where(self.steps[bottom] >= 0, cost[bottom], np.inf)
        inside = (slice(1, -1), slice(1, -1))
        for f in range(bottom + 1, top + 1):
            under = np.lib.stride_tricks.sliding_window_view(so_far[f - bottom - 1], cost[f][inside].shape)
            total = (under + cost[f][inside]).reshape(len(_AROUND), *under.shape[2:])
            total += np.reshape(aside, (-1, 1, 1))
            if self.blank:
                # where no path comes from there is none, whatever the cell costs
                total[under.reshape(total.shape) == np.inf] = np.inf
            so_far[f - bottom][inside] = np.where(self.steps[f][inside] >= 0, _first_least(total) if self.blank else total.min(axis=0), np.inf)
        x, y = np.nonzero(so_far[-1] != np.inf)
        if not len(x):
            x, y = np.nonzero(self.steps[bottom] == _UNSERVED)
            least = np.lexsort((self.index[bottom, x, y], self.score[bottom, x, y]))[0]
            return [(bottom, x[least], y[least])]
        least = np.lexsort((self.index[top, x, y], so_far[-1, x, y], self.steps[top, x, y] != _UNSERVED))[0]
        path = [(top, x[least], y[least])]
        for f in range(top, bottom, -1):
            x, y = path[-1][1:]
            best = None
            for (i, j), more in zip(_AROUND, aside, strict=True):
                if so_far[f - bottom - 1, x + i, y + j] == np.inf:
                    continue
                total, v = so_far[f - bottom - 1, x + i, y + j] + cost[f, x, y] + more, self.index[f - 1, x + i, y + j]
                if best is None or total < best[0] or (total == best[0] and v < best[1]):
                    best = total, v, (f - 1, x + i, y + j)
            path.append(best[2])
        return path

    def served(self, cells: np.ndarray, most: int) -> bool:
        """Counts steps from these cells of a core, up to `most`; whether a cell is served that was not."""
        steps, wide = self.steps.reshape(-1), self.steps.shape[-1]
        front = self.place[cells]
        front, gained = front[steps[front] > 0], False
        gained = bool((steps[front] == _UNSERVED).any())
        steps[front] = 0
        for n in range(1, most + 1):
            if not len(front):
                break
            parts = []
            for shift in (1, -1, wide, -wide):
                # only where the way from here is shorter than all before
                to = front + shift
                was = steps[to]
                nearer = was > n
                gained = gained or bool((was == _UNSERVED).any())
                to = to[nearer]
                steps[to] = n
                parts.append(to)
            front = np.concatenate(parts)
        return gained


def _first_least(total: np.ndarray) -> np.ndarray:
    """The least along the first axis; a path without a cost, which has no order, stays where it is the first."""
    first = np.take_along_axis(total, (total != np.inf).argmax(axis=0)[None], axis=0)[0]
    return np.where(np.isnan(first), first, np.fmin.reduce(total))


def _placed(radius: float, max_distance: float, voxel_size: float, most: int, left: bool):
    """Function of a grid's rows: its cores, or if `left` the voxels that none serves."""

    def place(rows: pa.Table) -> pa.Table:
        grid = _Grid(rows, max_distance, voxel_size)
        limit, found = int(max_distance / voxel_size + 1e-9), []
        for k in range(most if len(grid.voxel) else 0):
            core = []
            for f, x, y in grid.path(max_distance / 10.0 / voxel_size):
                a, b = grid.ends[f], grid.ends[f + 1]
                gap = np.sqrt(((grid.x[a:b] - x) ** 2 + (grid.y[a:b] - y) ** 2).astype(float)) * voxel_size
                core.append(a + np.flatnonzero(gap <= max(radius, 0.0)))
            found.append((k, np.concatenate(core)))
            if not grid.served(found[-1][1], limit) or not (grid.steps == _UNSERVED).any():
                break
        at = np.flatnonzero(grid.steps.reshape(-1)[grid.place] == _UNSERVED) if left else np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)])
        out = {"grid_id": rows["grid_id"].combine_chunks().take(pa.array(np.zeros(len(at), np.int64)))}
        if not left:
            out["core_id"] = pa.array(np.repeat([k for k, _ in found], [len(c) for _, c in found]).astype(np.int32))
            out["iz"] = pa.array(grid.floors[grid.level[at]].astype(np.int32))
        return pa.table(out | {"voxel_idx": pa.array(grid.voxel[at])})

    return place


def generate_cores(voxels: DataFrame, channels: DataFrame | None = None, radius: float = 10.0, max_distance: float = 100.0, voxel_size: float = 1.0, most: int = MOST_CORES) -> tuple[DataFrame, DataFrame]:
    """((grid_id, core_id, iz, voxel_idx) of every core's floors, (grid_id, voxel_idx) of voxels that no core serves).

    A core is a path of cells (`core_path`), grown to all cells of its floors
    within `radius` of it. Cells score low that are near the others of their
    floor and high in the normalised `channels`. Cores are placed until every
    voxel is within max_distance of one on its floor, or one brings no progress,
    or there are `most`. A task places all cores of a grid that it can hold;
    larger grids go on in rounds over tiles, all in the same ones. Each of the
    two frames places the cores anew.
    """
    if max_distance == 0:
        raise ValueError("max_distance has to be other than 0")
    given = voxels.select(*KEY, *CELL[1:]).where("iz is not null")
    if channels is not None:
        bonus = channels.groupBy(*KEY).agg(F.avg("value").alias("bonus"))
        given = given.join(bonus, KEY, "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    given, _ = written(given)
    small, large, parts = whole.split(given)
    of = [float(radius), float(max_distance), float(voxel_size), most]
    grids = small.repartition(parts, "grid_id").groupBy("grid_id")
    found, left = (grids.applyInArrow(_placed(*of, left), schema) for left, schema in ((False, "grid_id string, core_id int, iz int, voxel_idx long"), (True, "grid_id string, voxel_idx long")))
    if large is None:
        return found, left
    more = _over_tiles(large, *of)
    return found.unionByName(more[0]), left.unionByName(more[1])


def _over_tiles(voxels: DataFrame, radius: float, max_distance: float, voxel_size: float, most: int) -> tuple[DataFrame, DataFrame]:
    """`generate_cores` of grids that no task holds, whose voxels have a bonus or not."""
    ranks = F.broadcast(floor_ranks(voxels))
    far = floor_distances(voxels, voxel_size)
    scored = voxels.join(ranks, ["grid_id", "iz"]).join(far, KEY).withColumn("raw", F.col("distance") / float(max_distance) - (F.col("bonus") if "bonus" in voxels.columns else F.lit(0.0)))
    cells = checkpointed(blended(checkpointed(scored.select(*KEY, *CELL[1:], "level", "raw"))))
    grids = cells.select("grid_id").distinct()
    served, active, found = cells.select(*KEY).limit(0), checkpointed(grids), None
    for k in range(most):
        state = cells.join(active, "grid_id", "left_semi").join(served.withColumn("covered", F.lit(True)), KEY, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
        seeds = core_path(state, max_distance / 10.0 / voxel_size).groupBy("grid_id", "iz").agg(F.min(F.struct("ix", "iy")).alias("seed"))
        gap = [F.col(f"i{c}") - F.col(f"seed.i{c}") for c in "xy"]
        near = cells.join(F.broadcast(seeds), ["grid_id", "iz"]).where(F.sqrt((gap[0] * gap[0] + gap[1] * gap[1]).cast("double")) * float(voxel_size) <= max(float(radius), 0.0))
        core, seen = counted(near.select("grid_id", F.lit(k).alias("core_id"), "iz", "voxel_idx"), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        found = core if found is None else found.unionByName(core)
        before = served
        served = checkpointed(floor_coverage(cells, found, max_distance, voxel_size).distinct())
        gained = served.join(before, KEY, "left_anti").select("grid_id").distinct()
        unserved = cells.join(served, KEY, "left_anti").select("grid_id").distinct()
        active, seen = counted(active.join(gained, "grid_id", "left_semi").join(unserved, "grid_id", "left_semi"), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
    if found is None:
        found = cells.select("grid_id", F.lit(0).alias("core_id"), "iz", "voxel_idx").limit(0)
    return found, cells.select(*KEY).join(served, KEY, "left_anti")
