"""Ways as pointers inside bricks: sums along them and flows over them, joined at the doors between bricks.

A node is a cell with the sideways steps in a row so far (its run). Each node
with a way has one move: down, sideways or none where the way ends. Moves never
go up and a sideways one adds to the run, so floors and runs order the nodes.
Inside a brick ways are followed with numpy. Only the nodes on which a way comes
in from another brick are rows, and only those are joined to one another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators import bricks
from latticework.operators.bricks import BRICK, FAR, SIDE
from latticework.session import written
from latticework.sources.voxels import CELL

#: axis and direction of each move, the first one down; then the number of a move that ends, and that of no way
STEPS = ((2, -1), (0, 1), (0, -1), (1, 1), (1, -1))
ENDS, NONE = len(STEPS), -1
SHIFT = np.array([[s if k == axis else 0 for axis in range(3)] for k, s in STEPS] + [[0, 0, 0]])
CUBE = SIDE**3
_AT = "grid_id string, bx int, by int, bz int"
_TO = [f"to_{b}" for b in BRICK[1:]]
_SUMS = ["steps", "sides", "lead"]
_MADE = f"{_AT}, voxels binary, programs binary, moves binary, node int, to_bx int, to_by int, to_bz int, to_node int, door int, steps long, sides long, lead long, level boolean, end_idx long"
#: what a brick hears: of a door the sums beyond it, of a node what is put there or comes in
_SAID = f"{_AT}, door int, steps long, sides long, lead long, end_idx long, node int, entered boolean, value double, height long, source long, step long"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}


def place_of(*cell: str) -> list[Column]:
    """The brick of a cell."""
    return [F.shiftright(c, SIDE.bit_length() - 1).cast("int").alias(b) for c, b in zip(cell, BRICK[1:], strict=True)]


def node_of(run: Column, *cell: str) -> Column:
    """The number within its brick of a cell's node."""
    inside = [F.col(c).bitwiseAND(SIDE - 1) for c in cell]
    return (run * CUBE + (inside[0] * SIDE + inside[1]) * SIDE + inside[2]).cast("int").alias("node")


def table(schema: str, rows: dict, m: int) -> pa.RecordBatch:
    """Columns by schema; what is missing is null, and what is no array stands in every row."""
    out, names = [], []
    for name, kind in (f.split() for f in schema.split(", ")):
        x, t = rows.get(name), _TYPES[kind]
        if x is None:
            x = pa.nulls(m, t)
        elif not isinstance(x, (np.ndarray, list, pa.Array)):
            x = pa.array([x], t).take(pa.array(np.zeros(m, np.int64)))
        elif isinstance(x, np.ndarray):
            x = pa.array(x).cast(t)
        else:
            x = pa.array(x, t)
        out.append(x)
        names.append(name)
    return pa.record_batch(out, names=names)


class Brick:
    """One brick's moves, with what is known of the ways beyond its doors."""

    def __init__(self, key: tuple, voxels: np.ndarray, programs: np.ndarray, moves: np.ndarray, said: pa.Table | None):
        self.key, self.voxels, self.programs, self.moves, self.said = key, voxels, programs, moves, said
        self.limit = len(moves) - 1
        self.node = np.flatnonzero(moves >= 0)
        self.move = moves.ravel()[self.node].astype(np.int64)
        self.run, *cell = np.unravel_index(self.node, moves.shape)
        self.cell = np.array(cell)
        to = self.cell + SHIFT[self.move].T
        self.out = ((to < 0) | (to >= SIDE)).any(axis=0)
        run = np.where(self.move == 0, 0, np.where(self.move == ENDS, self.run, self.run + 1))
        self.to_node = np.ravel_multi_index((run, *(to & (SIDE - 1))), moves.shape)
        self.place = np.full(moves.size, -1)
        self.place[self.node] = np.arange(len(self.node))

    def voxel(self, at: np.ndarray, shift: np.ndarray | int = 0) -> np.ndarray:
        """The voxel of nodes by place, or of the cells beside them."""
        return self.voxels[tuple(self.cell[:, at] + 1 + shift)]

    def where(self, at: np.ndarray) -> dict:
        """Columns of the nodes at these places."""
        return {"grid_id": self.key[0], "voxel_idx": self.voxel(at)} | {c: SIDE * self.key[k + 1] + self.cell[k, at] for k, c in enumerate(CELL[1:])}

    def door(self, at: np.ndarray) -> np.ndarray:
        return self.move[at] * self.moves.size + self.to_node[at]

    def beyond(self, at: np.ndarray) -> dict:
        """Brick and node to which the nodes at these places leave."""
        return {t: self.key[k + 1] + SHIFT[self.move[at], k] for k, t in enumerate(_TO)} | {"to_node": self.to_node[at]}

    def walked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each node where its way ends or leaves, the steps and sideways steps with the one that leaves, those before the first one down, and whether these leave."""
        here = np.arange(len(self.node))
        goes = (self.move < ENDS) & ~self.out
        last, (steps, sides) = _doubled(np.where(goes, self.place[self.to_node], here), [goes, goes & (self.move > 0)])
        flat, (lead,) = _doubled(np.where(goes & (self.move > 0), self.place[self.to_node], here), [goes & (self.move > 0)])
        level = self.out[flat] & (self.move[flat] > 0)
        return last, steps + self.out[last], sides + (self.out[last] & (self.move[last] > 0)), lead + level, level

    def sums(self) -> dict[str, np.ndarray]:
        """Of each node the steps, sideways steps, those before the first one down, and the end of its whole way."""
        last, steps, sides, lead, level = self.walked()
        leaves = self.out[last]
        end = self.voxel(last)
        if leaves.any():
            told = self.said.filter(pc.is_valid(self.said["door"])) if self.said is not None else None
            doors = np.asarray(told["door"])
            order = np.argsort(doors)
            at = order[np.searchsorted(doors, self.door(last[leaves]), sorter=order)]
            steps[leaves] += np.asarray(told["steps"])[at]
            sides[leaves] += np.asarray(told["sides"])[at]
            lead[leaves] += np.where(level[leaves], np.asarray(told["lead"])[at], 0)
            end[leaves] = np.asarray(told["end_idx"])[at]
        return {"steps": steps, "sides": sides, "lead": lead, "end_idx": end}

    def put(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Nodes, whether what is there came in from another brick, and the columns `names` of what the brick hears about nodes."""
        if self.said is None:
            return np.zeros(0, np.int64), np.zeros(0, bool), [np.zeros(0) for _ in names]
        told = self.said.filter(pc.is_valid(self.said["node"]))
        return np.asarray(told["node"]).astype(np.int64), np.asarray(told["entered"]).astype(bool), [np.asarray(told[n]) for n in names]

    def flowed(self, value: np.ndarray, there: np.ndarray, total: np.ufunc) -> None:
        """Sends what nodes hold along their moves, in place; both arrays have the shape of the moves."""
        for z in range(SIDE - 1, -1, -1):
            if not (self.moves[:, :, :, z] >= 0).any():
                continue
            for r in range(self.limit + 1):
                here = np.where(there[r, :, :, z], self.moves[r, :, :, z], NONE)
                for k, (axis, s) in enumerate(STEPS):
                    x, y = np.nonzero(here == k)
                    if not len(x):
                        continue
                    to = [x, y, np.full(len(x), z)]
                    to[axis] = to[axis] + s
                    stay = (to[axis] >= 0) & (to[axis] < SIDE)
                    spot = (0 if k == 0 else r + 1, *(t[stay] for t in to))
                    value[spot] = total(value[spot], value[r, x[stay], y[stay], z])
                    there[spot] = True


def _doubled(to: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where pointers lead in the end, and the sums over all hops."""
    sums = [s.astype(np.int64) for s in sums]
    while True:
        then = to[to]
        if (then == to).all():
            return to, sums
        sums = [s + s[to] for s in sums]
        to = then


def _chosen(planes: np.ndarray, fixed: np.ndarray, limit: int, onto: Callable, prices: tuple[int, int]) -> np.ndarray:
    """The move of every node; of equal costs the lesser voxel is next."""
    ends = np.where(fixed[1] < FAR, fixed[1], -1)
    moves = np.full((limit + 1, SIDE, SIDE, SIDE), NONE, np.int8)
    for r in range(limit + 1):
        best, to = np.full(ends.shape, FAR), np.full(ends.shape, FAR)
        for k, (axis, s) in enumerate(STEPS if r < limit else STEPS[:1]):
            paid = onto(bricks.looked(planes[r + 1 if k else 0], axis, s), bricks.looked(planes[limit + 1], axis, s), prices[min(k, 1)])
            voxel = bricks.looked(planes[limit + 2], axis, s)
            better = (paid < best) | ((paid == best) & (paid < FAR) & (voxel < to))
            best, to = np.where(better, paid, best), np.where(better, voxel, to)
            moves[r][better] = k
        moves[r][ends >= r] = ENDS
        moves[r][bricks.inner(planes[r]) >= FAR] = NONE
    return moves


class Forest:
    """The ways over settled bricks, whose planes are the costs of each run, the network and the voxel.

    `levels` has, for the nodes on which a way comes into a brick, their pointers
    over 1, 2, 4, ... bricks; `totals` the sums of the whole way from there.
    """

    def __init__(self, settled: DataFrame, limit: int, onto: Callable, prices: tuple[int, int], max_rounds: int = 60):
        def run(batches):
            for batch in batches:
                for *key, fixed, halo, state in zip(*(batch[c].to_pylist() for c in (*BRICK, "fixed", "halo", "state")), strict=True):
                    fixed, inside = (bricks._opened(x, SIDE, SIDE, SIDE) for x in (fixed, state))
                    planes = bricks._halo(bricks._opened(halo, inside.shape[0], SIDE, SIDE))
                    bricks.inner(planes)[...] = inside
                    moves = _chosen(planes, fixed, limit, onto, prices)
                    brick = Brick(tuple(key), planes[limit + 2], fixed[3], moves, None)
                    at = dict(zip(BRICK, key, strict=True))
                    yield table(_MADE, at | {"voxels": bricks._packed(brick.voxels), "programs": bricks._packed(fixed[3]), "moves": bricks.zlib.compress(moves.tobytes(), 1)}, 1)
                    leaving = np.flatnonzero(brick.out)
                    _, first = np.unique(brick.door(leaving), return_index=True)
                    leaving = leaving[first]
                    yield table(_MADE, at | {"door": brick.door(leaving)} | brick.beyond(leaving), len(leaving))
                    # a way may come in where there is a voxel beyond the face: from above with run 0, from a side with another
                    open_ = np.zeros(len(brick.node), bool)
                    for k, (axis, s) in enumerate(STEPS):
                        face = brick.cell[axis] == (SIDE - 1 if s < 0 else 0)
                        back = brick.voxels[tuple(brick.cell + 1 - SHIFT[k][:, None])] < FAR
                        open_ |= face & back & ((brick.run == 0) if k == 0 else (brick.run > 0))
                    comes = np.flatnonzero(open_)
                    last, steps, sides, lead, level = (x[comes] for x in brick.walked())
                    leaves = brick.out[last]
                    rows = at | {"node": brick.node[comes], "steps": steps, "sides": sides, "lead": lead, "level": level, "end_idx": pa.array(brick.voxel(last), mask=leaves)}
                    yield table(_MADE, rows | {n: pa.array(x.astype(np.int32), mask=~leaves) for n, x in brick.beyond(np.where(leaves, last, 0) if len(last) else last).items()}, len(comes))

        made, _ = written(settled.select(*BRICK, "fixed", "halo", "state").mapInArrow(run, _MADE))
        self.bricks = made.where("moves is not null").select(*BRICK, "voxels", "programs", "moves")
        self.exits = made.where("door is not null").select(*BRICK, "door", *_TO, "to_node")
        at = [*BRICK, "node"]
        used = self.exits.select("grid_id", *(F.col(t).alias(b) for t, b in zip(_TO, BRICK[1:], strict=True)), F.col("to_node").alias("node")).distinct()
        rest = [*_TO, "to_node", *_SUMS, "level", "end_idx"]
        now, seen = written(made.where("node is not null").select(*at, *rest).join(used, at, "left_semi"), more=F.count("to_node"))
        self.levels = [now]
        for _ in range(max_rounds):
            if not seen["more"]:
                break
            then = now.select("grid_id", *(F.col(b).alias(t) for b, t in zip((*BRICK[1:], "node"), (*_TO, "to_node"), strict=True)), *(F.col(c).alias(f"t_{c}") for c in rest))
            moved = now.join(then, ["grid_id", *_TO, "to_node"], "left").select(
                *at, *(F.col(f"t_{c}").alias(c) for c in (*_TO, "to_node")), *((F.col(c) + F.coalesce(f"t_{c}", F.lit(0))).alias(c) for c in ("steps", "sides")),
                (F.col("lead") + F.when(F.col("level"), F.coalesce("t_lead", F.lit(0))).otherwise(0)).alias("lead"), (F.col("level") & F.coalesce("t_level", F.lit(True))).alias("level"), F.coalesce("end_idx", "t_end_idx").alias("end_idx"),
            )
            now, seen = written(moved, more=F.count("to_node"))
            self.levels.append(now)
        else:
            raise RuntimeError(f"ways over more than 2 to the {max_rounds} bricks")
        self.totals = now.select(*at, *_SUMS, "end_idx")

    def told(self) -> DataFrame:
        """What each brick hears of the ways beyond its doors."""
        beyond = self.totals.select("grid_id", *(F.col(b).alias(t) for b, t in zip((*BRICK[1:], "node"), (*_TO, "to_node"), strict=True)), *_SUMS, "end_idx")
        return self.exits.join(beyond, ["grid_id", *_TO, "to_node"]).select(*BRICK, "door", *_SUMS, "end_idx")

    def visit(self, schema: str, rows: Callable[[Brick], tuple[dict, int]], *said: DataFrame) -> DataFrame:
        """What `rows` makes of every brick, and of what it hears by the frames `said`: columns and their length."""

        def opened(key, voxels, programs, moves, heard):
            shape = SIDE, SIDE, SIDE
            return Brick(key, bricks._opened(voxels, *(n + 2 for n in shape))[0], bricks._opened(programs, *shape)[0], np.frombuffer(bricks.zlib.decompress(moves), np.int8).reshape(-1, *shape), heard)

        def alone(batches):
            for batch in batches:
                for *key, voxels, programs, moves in zip(*(batch[c].to_pylist() for c in (*BRICK, "voxels", "programs", "moves")), strict=True):
                    yield table(schema, *rows(opened(tuple(key), voxels, programs, moves, None)))

        def hearing(brick: pa.Table, heard: pa.Table) -> pa.Table:
            if not brick.num_rows:
                return pa.Table.from_batches([table(schema, {}, 0)])
            row = brick.to_pylist()[0]
            return pa.Table.from_batches([table(schema, *rows(opened(tuple(row[b] for b in BRICK), row["voxels"], row["programs"], row["moves"], heard)))])

        if not said:
            return self.bricks.mapInArrow(alone, schema)
        every = None
        for s in said:
            full = s.select(*(F.col(n) if n in s.columns else F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in _SAID.split(", "))))
            every = full if every is None else every.unionByName(full)
        # under other names, as both sides come from one table
        every = every.withColumnsRenamed({b: f"by_{b}" for b in BRICK})
        return self.bricks.groupBy(*BRICK).cogroup(every.groupBy(*(f"by_{b}" for b in BRICK))).applyInArrow(hearing, schema)

    def come_in(self, values: dict[str, str], total: Callable, held: Callable[[Brick], tuple], *said: DataFrame) -> DataFrame:
        """(grid_id, bx, by, bz, node, entered, ...): what comes into each brick over its nodes, for `visit`.

        `held` gives what a brick's nodes hold, as `Brick.flowed` leaves it, with a
        function from held numbers to the columns `values`; `total` makes one of
        several. Values go over the doors by doubling, so rounds are the logarithm
        of the bricks that a way crosses.
        """

        def leaving(brick: Brick):
            value, there, columns = held(brick)
            at = np.flatnonzero(brick.out)
            at = at[there.ravel()[brick.node[at]]]
            return {"grid_id": brick.key[0]} | brick.beyond(at) | columns(value.ravel()[brick.node[at]]), len(at)

        one = F.struct(*values) if len(values) > 1 else F.col(next(iter(values)))
        sent = self.visit("grid_id string, to_bx int, to_by int, to_bz int, to_node int, " + ", ".join(f"{n} {t}" for n, t in values.items()), leaving, *said)
        at = [*BRICK, "node"]
        to = [F.col(t).alias(b) for t, b in zip((*_TO, "to_node"), at[1:], strict=True)]
        value, _ = written(sent.select("grid_id", *to, one.alias("held")).groupBy(*at).agg(total("held").alias("held")))
        for level in self.levels:
            moved = value.join(level.where("to_node is not null").select(*at, *_TO, "to_node"), at).select("grid_id", *to, "held")
            value, _ = written(value.unionByName(moved).groupBy(*at).agg(total("held").alias("held")))
        return value.select(*at, F.lit(True).alias("entered"), *((F.col(f"held.{n}") if len(values) > 1 else F.col("held")).alias(n) for n in values))
