"""Waves over voxels, run inside bricks that exchange their faces.

Cells are packed into bricks of SIDE cells a side. A brick is settled by itself
with whole-array arithmetic, given what its neighbours last said about the cells
that touch it (its halo). Where that changes one of its faces, the neighbour
there is woken in the next round. Bricks that hear nothing new are neither read
nor written, so rounds follow the bricks that a wave crosses, and rows written
shrink with the front. A task holds one brick at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.session import checkpointed, counted
from latticework.sources.voxels import CELL, KEY

SIDE = 32
#: no value
FAR = 1 << 60
#: versions that are united before they are written anew
VERSIONS = 8
#: messages up to which the names of woken bricks are broadcast
WOKEN = 100_000
BRICK = ["grid_id", "bx", "by", "bz"]
_ROW = "grid_id string, bx int, by int, bz int, round int, fixed binary, halo binary, state binary, face int, said binary"
_ARROW = pa.schema([("grid_id", pa.string()), *((b, pa.int32()) for b in BRICK[1:]), ("round", pa.int32()), *((c, pa.binary()) for c in ("fixed", "halo", "state")), ("face", pa.int32()), ("said", pa.binary())])
#: of each face its axis, and the end of the axis it lies at; in the order of the face directions
FACES = ((0, 1), (0, 0), (1, 1), (1, 0), (2, 1), (2, 0))

#: planes of a brick, its cells' own values, and where its corner lies; gives the planes anew
Solve = Callable[[np.ndarray, np.ndarray, tuple[int, int, int]], np.ndarray]


def _packed(x: np.ndarray) -> bytes:
    """Values as their distance from the least of their slice, in as few bytes as the farthest needs, equal bytes side by side."""
    rows = np.ascontiguousarray(x, dtype="<i8").reshape(-1, x.shape[-2] * x.shape[-1])
    base = rows.min(axis=1, initial=FAR)
    far = np.where(rows == FAR, 0, rows - base[:, None] + 1).astype("<u8")
    width = -(-int(far.max(initial=0)).bit_length() // 8)
    body = far.reshape(-1, 1).view(np.uint8)[:, :width].T
    return zlib.compress(np.array([width, *rows.shape], "<i8").tobytes() + base.astype("<i8").tobytes() + body.tobytes(), 1)


def _opened(x: bytes, *shape: int) -> np.ndarray:
    raw = zlib.decompress(x)
    width, rows, each = np.frombuffer(raw, "<i8", 3)
    base = np.frombuffer(raw, "<i8", rows, 24)
    far = np.zeros((rows * each, 8), np.uint8)
    far[:, :width] = np.frombuffer(raw, np.uint8, width * rows * each, 24 + 8 * rows).reshape(width, rows * each).T
    far = far.view("<i8").reshape(rows, each)
    return np.where(far == 0, FAR, far - 1 + base[:, None]).reshape(-1, *shape)


def inner(planes: np.ndarray) -> np.ndarray:
    """The brick without the cells around it."""
    return planes[..., 1:-1, 1:-1, 1:-1]


def looked(planes: np.ndarray, axis: int, step: int) -> np.ndarray:
    """What each inner cell sees one step along an axis."""
    cut = [slice(1, -1)] * 3
    cut[axis] = slice(2, None) if step > 0 else slice(0, -2)
    return planes[(..., *cut)]


def _face(planes: np.ndarray, face: int) -> np.ndarray:
    axis, end = FACES[face]
    return np.take(planes, -1 if end else 0, axis=axis + 1)


def _halo(faces: np.ndarray) -> np.ndarray:
    """Planes of a brick and its surroundings, empty but for the six faces around."""
    out = np.full((faces.shape[1], SIDE + 2, SIDE + 2, SIDE + 2), FAR, dtype=np.int64)
    for face, (axis, end) in enumerate(FACES):
        cut: list = [slice(1, -1)] * 3
        cut[axis] = -1 if end else 0
        out[(slice(None), *cut)] = faces[face]
    return out


def _rows(key: tuple, round_: int, fixed: bytes, faces: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> pa.Table:
    """The brick's new version, and one message for each face that changed, addressed to the brick there."""
    rows = [(*key, round_, fixed, _packed(faces), _packed(after), None, None)]
    for face, (axis, end) in enumerate(FACES):
        mine = _face(after, face)
        if (before is None and (mine < FAR).any()) or (before is not None and (mine != _face(before, face)).any()):
            to = list(key)
            to[axis + 1] += 1 if end else -1
            rows.append((*to, round_, None, None, None, face ^ 1, _packed(mine)))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def settle(cells: DataFrame, own: list[str], planes: int, solve: Solve, max_rounds: int = 10_000) -> DataFrame:
    """Bricks (grid_id, bx, by, bz, round, fixed, halo, state) whose planes no longer change; `unpacked` gives rows.

    `cells` has grid_id, voxel_idx, ix, iy, iz and the long columns `own`, null
    where there is none. `solve` gets the planes, of shape (planes, SIDE + 2, ...),
    which hold FAR but around the brick, where they hold what its neighbours said
    last; the cells' own values, voxel_idx first; and the brick's least corner. It
    gives the planes of the inner cells and must leave FAR where there is no cell.
    """
    corner = [F.shiftright(c, SIDE.bit_length() - 1).alias(b) for c, b in zip(CELL[1:], BRICK[1:], strict=True)]
    names = ["voxel_idx", *own]
    slim = cells.select("grid_id", *corner, *CELL[1:], *(F.coalesce(F.col(c).cast("long"), F.lit(FAR)).alias(c) for c in names))

    def solved(faces: np.ndarray, fixed: np.ndarray, key: tuple) -> np.ndarray:
        return solve(_halo(faces), fixed, tuple(SIDE * b for b in key[1:]))

    def first(rows: pa.Table) -> pa.Table:
        key = tuple(rows[b][0].as_py() for b in BRICK)
        fixed = np.full((len(names), SIDE, SIDE, SIDE), FAR, dtype=np.int64)
        at = tuple(np.asarray(rows[c]) & (SIDE - 1) for c in CELL[1:])
        for k, c in enumerate(names):
            fixed[k][at] = np.asarray(rows[c])
        faces = np.full((6, planes, SIDE, SIDE), FAR, dtype=np.int64)
        return _rows(key, 0, _packed(fixed), faces, None, solved(faces, fixed, key))

    def again(rows: pa.Table, said: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _ARROW.empty_table()
        now = max(range(rows.num_rows), key=lambda i: rows["round"][i].as_py())
        key = tuple(rows[b][now].as_py() for b in BRICK)
        faces = _opened(rows["halo"][now].as_py(), planes, SIDE, SIDE).copy()
        for face, x in zip(said["to_face"].to_pylist(), said["to_said"].to_pylist(), strict=True):
            faces[face] = _opened(x, SIDE, SIDE)
        fixed = rows["fixed"][now].as_py()
        before = _opened(rows["state"][now].as_py(), SIDE, SIDE, SIDE)
        after = solved(faces, _opened(fixed, SIDE, SIDE, SIDE), key)
        return _rows(key, said["to_round"][0].as_py() + 1, fixed, faces, before, after)

    made, seen = counted(slim.groupBy(*BRICK).applyInArrow(first, _ROW), said=F.count("face"))
    versions = [made.where("face is null")]
    for _ in range(max_rounds):
        if not seen["said"]:
            return _latest(versions)
        if len(versions) > VERSIONS:
            versions = [checkpointed(_latest(versions))]
        messages = made.where("face is not null").select(*(F.col(c).alias(f"to_{c}") for c in (*BRICK, "round", "face", "said")))
        to = [F.col(f"to_{b}") for b in BRICK]
        keys = messages.select(*(F.col(f"to_{b}").alias(b) for b in BRICK)).distinct()
        # where few are woken, the others are not even dealt out
        woken = reduce(DataFrame.unionByName, versions).join(F.broadcast(keys) if seen["said"] <= WOKEN else keys, BRICK, "left_semi")
        made, seen = counted(woken.groupBy(*BRICK).cogroup(messages.groupBy(*to)).applyInArrow(again, _ROW), said=F.count("face"))
        versions.append(made.where("face is null"))
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def _latest(versions: list[DataFrame]) -> DataFrame:
    rest = ["round", "fixed", "halo", "state"]
    if len(versions) == 1:
        return versions[0].select(*BRICK, *rest, *(F.lit(None).cast(t).alias(c) for c, t in (("face", "int"), ("said", "binary"))))
    last = reduce(DataFrame.unionByName, versions).groupBy(*BRICK).agg(F.max_by(F.struct(*rest), "round").alias("v"))
    return last.select(*BRICK, *(f"v.{c}" for c in rest), *(F.lit(None).cast(t).alias(c) for c, t in (("face", "int"), ("said", "binary"))))


def unpacked(bricks: DataFrame, schema: str, rows: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]] | None = None, names: list[str] | None = None) -> DataFrame:
    """(grid_id, voxel_idx, ix, iy, iz, ...) of every cell of settled bricks, with the columns of `schema`.

    Either the planes `names`, or what `rows` makes of the planes with those
    around, the own values, and the inner places of the cells (axes by cells): a
    column for each name, whose key `cell` holds the numbers of the cells, each as
    often as it gives a row. FAR becomes null.
    """
    kinds = [f.split() for f in schema.split(",")]

    def run(batches):
        for batch in batches:
            for grid_id, *corner, fixed, halo, state in zip(*(batch[c].to_pylist() for c in (*BRICK, "fixed", "halo", "state")), strict=True):
                fixed = _opened(fixed, SIDE, SIDE, SIDE)
                inside = _opened(state, SIDE, SIDE, SIDE)
                place = np.array(np.nonzero(fixed[0] < FAR))
                if rows is None:
                    made = {n: inside[k][tuple(place)] for k, n in enumerate(names)} | {"cell": np.arange(place.shape[1])}
                else:
                    planes = _halo(_opened(halo, inside.shape[0], SIDE, SIDE))
                    inner(planes)[...] = inside
                    made = rows(planes, fixed, place)
                cell = made["cell"]
                m = len(cell)
                at = place[:, cell]
                columns = [pa.array([grid_id], pa.string()).take(pa.array(np.zeros(m, np.int64))), pa.array(fixed[0][tuple(at)]), *(pa.array((SIDE * corner[k] + at[k]).astype(np.int32)) for k in range(3))]
                columns += [pa.array(made[n].astype(np.int64), mask=made[n] >= FAR).cast({"int": pa.int32(), "long": pa.int64()}[t]) for n, t in kinds]
                yield pa.record_batch(columns, names=[*KEY, *CELL[1:], *(n for n, _ in kinds)])

    return bricks.select(*BRICK, "fixed", "halo", "state").mapInArrow(run, f"grid_id string, voxel_idx long, ix int, iy int, iz int, {schema}")
