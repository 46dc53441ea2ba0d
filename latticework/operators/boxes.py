"""Merging voxels of one program into boxes, largest first.

Cells are merged in tiles by themselves, as far as nothing beyond a tile can
change what is taken there; then in tiles that lie elsewhere. Only what is left
by all of them goes through rounds over the whole table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from latticework.operators.allocation import CORE, UNASSIGNED
from latticework.session import PART, checkpointed, counted, written
from latticework.sources.voxels import CELL

_LINE = ["grid_id", "program_idx"]
#: cells of candidate boxes that a round lists for each cell that is left
LISTED = 8
#: cells a side of a tile: a power of 2, at most 64
SIDE = 64
#: places of the tiles; with four, a cell is well inside a tile of one of them on all three axes
SHIFTS = 4
_TILE = ["tx", "ty", "tz"]


def _maximal(filled: np.ndarray, origins: np.ndarray) -> np.ndarray:
    """Keys of the filled boxes at `origins` (numbers of cells) that no larger filled box contains.

    `filled` has an empty cell at each end of its axes. A key sorts by volume,
    greatest first, then by origin, width, depth and height; `_opened` gives them.
    """
    sx, sy = filled.shape[1] * filled.shape[2], filled.shape[2]
    up = np.zeros(filled.shape, np.int32)
    for z in range(filled.shape[2] - 2, 0, -1):
        up[..., z] = np.where(filled[..., z], up[..., z + 1] + 1, 0)
    up = up.ravel()
    found, row, w = [], up, 1
    while True:
        # row[o], wider[o]: the height that w and w + 1 cells from o on have in common
        wider = np.zeros_like(up)
        wider[: -w * sx] = np.minimum(row[: -w * sx], up[w * sx :])
        o = origins[row[origins] > 0]
        if not len(o):
            return np.concatenate(found) if found else np.empty(0, np.int64)
        h, east, west, below, south, d = row[o], wider[o], wider[o - sx], row[o - 1], row[o - sy], 1
        while True:
            # what the row before it can join stays so however deep the box becomes
            open_ = (h > 0) & (south < h)
            o, h, east, west, below, south = (x[open_] for x in (o, h, east, west, below, south))
            if not len(o):
                break
            at = o + d * sy
            deeper = np.minimum(h, row[at])
            mine = (deeper < h) & (east < h) & (west < h) & (below == 0)
            tall = h[mine].astype(np.int64)
            found.append(((1 << 20) - w * d * tall << 42) + (o[mine] << 21) + (w << 14) + (d << 7) + tall)
            h, east, west, below = deeper, np.minimum(east, wider[at]), np.minimum(west, wider[at - sx]), np.minimum(below, row[at - 1])
            d += 1
        row, w = wider, w + 1


def _opened(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Volume, number of the origin, width, depth and height of boxes."""
    return (1 << 20) - (keys >> 42), (keys >> 21) & (1 << 21) - 1, (keys >> 14) & 127, (keys >> 7) & 127, keys & 127


def _corners(keys: np.ndarray, shape: tuple[int, ...], low: int):
    """The eight corners of boxes, `low` being 0 for their own first cells and -1 for those before, each with its sign."""
    _, o, *sizes = _opened(keys)
    at = np.unravel_index(o, shape)
    for ends in np.ndindex(2, 2, 2):
        yield tuple(x + low + end * size for x, end, size in zip(at, ends, sizes, strict=True)), 1 - 2 * (sum(ends) % 2)


def _summed(x: np.ndarray) -> np.ndarray:
    return x.cumsum(axis=0).cumsum(axis=1).cumsum(axis=2)


def _taken(filled: np.ndarray, ends: list[tuple[bool, bool]], listed: float) -> np.ndarray:
    """Keys of the boxes that the sequential order takes of `filled`, whose cells become empty.

    `filled` is as for `_maximal`; `ends` tells of each axis where cells may go on
    beyond it. A box that reaches such an end may be larger than is seen here, so
    its cells, and with them every box that shares one, stay.
    """
    shape = filled.shape
    stay = np.zeros(shape, bool)
    for axis, (low, high) in enumerate(ends):
        lines, into = (np.moveaxis(x, axis, 0) for x in (filled, stay))
        if low:
            into[1:] |= np.logical_and.accumulate(lines[1:], axis=0)
        if high:
            into[-2::-1] |= np.logical_and.accumulate(lines[-2::-1], axis=0)
    stay = stay.ravel()

    def seen(origins: np.ndarray) -> np.ndarray:
        keys = _maximal(filled, origins)
        _, o, *sizes = _opened(keys)
        cut = np.zeros(len(keys), bool)
        for x, size, n, (low, high) in zip(np.unravel_index(o, shape), sizes, shape, ends, strict=True):
            cut |= (low & (x == 1)) | (high & (x + size == n - 1))
        return keys[~cut]

    keys, done, cells = np.sort(seen(np.flatnonzero(filled))), [], filled.ravel()
    room = listed * np.count_nonzero(filled)
    while len(keys):
        # smaller boxes cannot keep a larger one from being taken, so they may wait
        few = max(1, int(np.searchsorted(_opened(keys)[0].cumsum(), room, "right")))
        volume, o, w, d, h = _opened(keys[:few])
        first = volume.cumsum() - volume
        which = np.repeat(np.arange(few), volume)
        k = np.arange(len(which)) - first[which]
        across, k = np.divmod(k, (d * h)[which])
        at = o[which] + across * (shape[1] * shape[2]) + k // h[which] * shape[2] + k % h[which]
        best = np.full(len(cells), few)
        np.minimum.at(best, at, which)
        best[stay] = -1
        won = np.logical_and.reduceat(best[at] == which, first)
        if not won.any():
            if few == len(keys):
                break
            room = 2 * max(room, int(volume.sum()))
            continue
        done.append(keys[:few][won])
        gone = np.zeros(shape, np.int32)
        gone.ravel()[at[won[which]]] = 1
        cells[at[won[which]]] = False
        gone = _summed(gone)
        met = sum(sign * gone[corner] for corner, sign in _corners(keys, shape, -1)) != 0
        # what such a box leaves lies inside it, so all boxes from there are listed anew
        near = np.zeros(shape, np.int32)
        for corner, sign in _corners(keys[met], shape, 0):
            np.add.at(near, corner, sign)
        near = (_summed(near) > 0) & filled
        kept = keys[~met]
        kept = kept[~near.ravel()[_opened(kept)[1]]]
        keys = np.sort(np.concatenate([kept, seen(np.flatnonzero(near))]))
        room = listed * np.count_nonzero(filled)
    return np.concatenate(done) if done else np.empty(0, np.int64)


def _merged_tile(side: int, shift: int, listed: float):
    """Function of a tile's cells: its boxes, then the cells that are left, with a width of 0."""

    def run(rows: pa.Table) -> pa.Table:
        place = np.stack([rows[c].to_numpy() for c in CELL[1:]]).astype(np.int64)
        least, most = place.min(axis=1), place.max(axis=1)
        filled = np.zeros(most - least + 3, bool)
        filled[tuple(place - least[:, None] + 1)] = True
        ends = [(bool((lo + shift) % side == 0), bool((hi + shift) % side == side - 1)) for lo, hi in zip(least, most, strict=True)]
        volume, o, *sizes = _opened(_taken(filled, ends, listed))
        rest = np.stack(np.nonzero(filled))
        at = np.concatenate([np.stack(np.unravel_index(o, filled.shape)), rest], axis=1) + least[:, None] - 1
        none = np.zeros(rest.shape[1], np.int64)
        made = {c: rows[c].take(pa.array(np.zeros(at.shape[1], np.int64))) for c in _LINE}
        made |= {c: pa.array(x).cast(rows[c].type) for c, x in zip(CELL[1:], at, strict=True)}
        made |= {c: pa.array(np.concatenate([x, none]).astype(np.int32)) for c, x in zip("wdh", sizes, strict=True)}
        return pa.table(made | {"voxel_count": pa.array(np.concatenate([volume, none]))})

    return run


def _in_tiles(cells: DataFrame, rows: int, side: int, shift: int) -> tuple[DataFrame, dict]:
    """Boxes taken in tiles, and with a width of 0 the cells that are left; their number `n`."""
    tile = [F.shiftright(F.col(c).cast("long") + shift, side.bit_length() - 1).alias(t) for c, t in zip(CELL[1:], _TILE, strict=True)]
    slim = cells.select(*_LINE, *CELL[1:], *tile)
    parts = max(-(-rows // PART), int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = StructType([*cells.select(*_LINE, *CELL[1:]).schema.fields, *(StructField(c, IntegerType()) for c in "wdh"), StructField("voxel_count", LongType())])
    # dealt by tile, a voxel's repeats are dropped where they lie
    dealt = slim.repartition(parts, *_LINE, *_TILE).dropDuplicates()
    made = dealt.groupBy(*_LINE, *_TILE).applyInArrow(_merged_tile(side, shift, LISTED), schema)
    return written(made, n=F.count_if(F.col("w") == 0))


def _ahead(cells: DataFrame, along: str, value: str, name: str) -> DataFrame:
    """`value` of the voxel itself and of those that follow it without a gap along one axis, as an array."""
    across = [*_LINE, *(c for c in ("ix", "iy", "iz") if c != along)]
    island = F.col(along) - F.row_number().over(Window.partitionBy(*across).orderBy(along))
    rest = Window.partitionBy(*across, "island").orderBy(along).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return cells.withColumn("island", island).withColumn(name, F.collect_list(value).over(rest)).drop("island")


def _candidates(cells: DataFrame) -> DataFrame:
    """Filled boxes by origin that neither a wider nor a deeper one of the same height contains."""
    up = _ahead(cells.withColumn("one", F.lit(1)), "iz", "one", "up").withColumn("h", F.size("up"))
    wide = _ahead(up, "ix", "h", "hs").withColumn("heights", F.expr("transform(sequence(1, size(hs)), w -> array_min(slice(hs, 1, w)))"))
    deep = _ahead(wide.drop("up", "one", "h", "hs"), "iy", "heights", "rows")
    # heights[d][w]: greatest height over the first d rows and w cells, shorter rows ending the width
    both = deep.withColumn("table", F.expr("""transform(sequence(1, size(rows)), d -> transform(sequence(1, array_min(transform(slice(rows, 1, d), r -> size(r)))),
        w -> array_min(transform(slice(rows, 1, d), r -> element_at(r, w)))))"""))
    spread = both.select(*_LINE, "ix", "iy", "iz", "table", F.posexplode("table").alias("d0", "heights"))
    spread = spread.select("*", F.posexplode("heights").alias("w0", "h"))
    wider, deeper = F.expr("get(heights, w0 + 1)"), F.expr("get(get(table, d0 + 1), w0)")
    maximal = ~F.coalesce(wider == F.col("h"), F.lit(False)) & ~F.coalesce(deeper == F.col("h"), F.lit(False))
    return spread.where(maximal).select(*_LINE, "ix", "iy", "iz", (F.col("w0") + 1).alias("w"), (F.col("d0") + 1).alias("d"), "h")


def _largest(found: DataFrame, cells: DataFrame) -> DataFrame:
    """The candidates of each grid and program from the volume on with which the larger ones' cells reach `LISTED` times the cells left.

    Smaller boxes cannot keep a larger one from being taken, so they may wait.
    """
    sizes = found.groupBy(*_LINE, "key.volume").agg((F.count(F.lit(1)) * F.col("volume")).alias("listed"))
    larger = F.sum("listed").over(Window.partitionBy(*_LINE).orderBy(F.col("volume").desc()).rowsBetween(Window.unboundedPreceding, -1))
    room = cells.groupBy(*_LINE).agg((F.count(F.lit(1)) * LISTED).alias("room"))
    least = sizes.withColumn("larger", F.coalesce(larger, F.lit(0))).join(room, _LINE).where("larger < room").groupBy(*_LINE).agg(F.min("volume").alias("least"))
    return found.join(least, _LINE).where("key.volume >= least").drop("least")


def _in_rounds(left: DataFrame, rows: int, max_rounds: int) -> list[DataFrame]:
    """Boxes of the cells that are left, by rounds over the whole table: each takes every box that is the best on all of its voxels."""
    done, heavy, kept = [], True, {"n": rows}
    for _ in range(max_rounds):
        if not kept["n"]:
            return done
        key = F.struct((F.col("w") * F.col("d") * F.col("h")).cast("long").alias("volume"), *((-F.col(c)).alias(c) for c in ("ix", "iy", "iz", "w", "d", "h")))
        inside = _candidates(left).select(*_LINE, key.alias("key"))
        if heavy:
            inside, seen = counted(inside, listed=F.sum("key.volume"))
            heavy = seen["listed"] > LISTED * kept["n"]
            if heavy:
                inside = _largest(inside, left)
        for c, size in (("ix", "w"), ("iy", "d"), ("iz", "h")):
            inside = inside.select("*", F.explode(F.expr(f"sequence(-key.{c}, -key.{c} - key.{size} - 1)")).alias(c))
        listed = Observation()
        inside = inside.observe(listed, F.count(F.lit(1)).alias("n"))
        best = inside.groupBy(*_LINE, "ix", "iy", "iz").agg(F.max("key").alias("key"))
        held = checkpointed(best.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*_LINE, "key"))))
        done.append(held.where("n = key.volume").select(*_LINE, "key").distinct().select(*_LINE, *((-F.col(f"key.{c}")).alias(c) for c in ("ix", "iy", "iz", "w", "d", "h")), F.col("key.volume").alias("voxel_count")))
        # `held` has every cell that is left, unless boxes wait
        rest = left.join(held.where("n = key.volume"), [*_LINE, "ix", "iy", "iz"], "left_anti") if heavy else held.where("n < key.volume").select(*left.columns)
        heavy = heavy or listed.get["n"] > LISTED * kept["n"]
        left, kept = counted(rest, n=F.count(F.lit(1)))
    if kept["n"]:
        raise RuntimeError(f"not settled in {max_rounds} rounds")
    return done


def merge_boxes(cells: DataFrame, max_rounds: int = 10_000, side: int = SIDE) -> DataFrame:
    """(grid_id, program_idx, ix, iy, iz, w, d, h, voxel_count): the largest filled box of a program, then that of the rest, and so on.

    Ties go to the least origin, then width, depth and height. The core is
    merged too, unassigned voxels are left out, a program below -2 is an error;
    a voxel given twice counts once. Tiles of `side` cells take what no cell
    beyond them can change; `max_rounds` bounds the rounds over what they leave,
    whose lists are bounded by the cells left and by boxes of one volume.
    """
    if side & side - 1 or not 0 < side <= SIDE:
        raise ValueError(f"the side of a tile has to be a power of 2, at most {SIDE}")
    known = cells.agg(F.min("program_idx").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if known["least"] is not None and known["least"] < CORE:
        raise ValueError("a program index below -2")
    left, rows, done = cells.where(F.col("program_idx") != UNASSIGNED).select(*_LINE, *CELL[1:]).dropna(), known["n"], []
    for k in range(SHIFTS):
        # the first tile begins below 0, where no cell is, so that a small grid lies inside it
        made, seen = _in_tiles(left, rows, side, side // 8 + k * side // SHIFTS)
        done.append(made.where("w > 0"))
        left, rows = made.where("w = 0").select(*left.columns), seen["n"]
        if not rows:
            break
    return reduce(DataFrame.unionByName, [*done, *_in_rounds(left, rows, max_rounds)])


def box_report(boxes: DataFrame) -> DataFrame:
    """Voxels, boxes and the share of rows that merging saves, in percent."""
    n, v = F.count(F.lit(1)), F.sum("voxel_count")
    return boxes.groupBy("grid_id").agg(v.alias("voxels"), n.alias("boxes"), (100.0 * (v - n) / v).alias("percent"))
