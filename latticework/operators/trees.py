"""Ways to the ground over one grid that a task holds: what `forests` does over bricks, on lists of cells.

Cells are sorted by floor. A node is a cell with the sideways steps in a row so
far (its run), numbered run * cells + cell, and has one move. Ways never go up
and a sideways step adds to the run, so one turn over floors and runs settles
costs and sums, and one back sends what nodes hold along their ways.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from latticework.operators.allocation import CORE, UNASSIGNED
from latticework.operators.forests import STEPS
from latticework.sources.voxels import CELL

_FAR = 1 << 56


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


class Near:
    """The neighbours of cells by move, as numbers of cells (their number where there is none), and their order by voxel."""

    def __init__(self, voxel: np.ndarray, cell: np.ndarray):
        n = len(voxel)
        box = np.full(cell.max(axis=1, initial=0) + 2, n)
        box[tuple(cell)] = np.arange(n)
        self.at = np.array([box[tuple(c + (s if k == axis else 0) for k, c in enumerate(cell))] for axis, s in STEPS])
        there = np.append(voxel, np.iinfo(np.int64).max)[self.at]
        self.rank = np.array([sum((x < y).astype(np.int64) for x in there) for y in there])
        self.move = np.zeros(self.at.shape, np.int64)
        for k, rank in enumerate(self.rank):
            known = np.flatnonzero(self.at[k] < n)
            self.move[rank[known], known] = k


class Trees:
    """The cheapest ways of cells. `floors` are slices of them, the lowest first.

    `ends` is the most sideways steps in a row with which a way may end on a cell,
    or -1; a step onto a cell that is `joined` costs one part in `share`. Of equal
    costs the lesser voxel is next.
    """

    def __init__(self, near: Near, floors: list[slice], ends: np.ndarray, joined: np.ndarray, limit: int, prices: tuple[int, int, int]):
        n = len(ends)
        self.n, self.floors, self.runs = n, floors, range(limit + 1)
        # costs leave three bits for the order of the voxels they are paid to
        paid = [np.append(np.where(joined, p // prices[2], p), 0) * 8 for p in prices[:2]]
        fall, side = paid[0][near.at[0]] + near.rank[0], paid[1][near.at[1:]] + near.rank[1:]
        cost, order = np.full((limit + 1, n + 1), _FAR), np.zeros((limit + 1, n), np.int64)
        for f in floors:
            down = cost[0][near.at[0, f]] + fall[f]
            for r in reversed(self.runs):
                least = down
                if r < limit:
                    least = np.minimum(least, (cost[r + 1][near.at[1:, f]] + side[:, f]).min(axis=0))
                order[r, f] = least & 7
                cost[r, f] = np.where(ends[f] >= r, 0, np.minimum(least & ~7, _FAR))
        every = np.arange(n)
        self.move = near.move[np.minimum(order, len(STEPS) - 1), every]
        self.to = near.at[self.move, every] + np.where(self.move > 0, np.reshape(self.runs, (-1, 1)) * n + n, 0)
        #: nodes with a way, and those of them whose way goes on
        self.known = cost[:, :n] < _FAR
        self.goes = self.known & (ends < np.reshape(self.runs, (-1, 1)))

    def sums(self, *names: str) -> dict[str, np.ndarray]:
        """Of each node the `steps` of its way, the sideways steps (`sides`), those before the first one down (`lead`), and the cell on which it ends (`last`)."""
        out = {c: np.tile(np.arange(self.n), (len(self.runs), 1)) if c == "last" else np.zeros(self.move.shape, np.int64) for c in names}
        for f in self.floors:
            for r in reversed(self.runs):
                at = f.start + np.flatnonzero(self.goes[r, f])
                to, side = self.to[r, at], self.move[r, at] > 0
                for c, x in out.items():
                    beyond = x.reshape(-1)[to]
                    x[r, at] = beyond if c == "last" else beyond + 1 if c == "steps" else beyond + side if c == "sides" else np.where(side, beyond + 1, 0)
        return out

    def flowed(self, value: np.ndarray, there: np.ndarray, total: np.ufunc) -> None:
        """Sends what nodes hold along their ways, in place."""
        flat, reached = value.reshape(-1), there.reshape(-1)
        for f in reversed(self.floors):
            for r in self.runs:
                at = f.start + np.flatnonzero(there[r, f] & self.goes[r, f])
                to = self.to[r, at]
                total.at(flat, to, value[r, at])
                reached[to] = True


class Grid:
    """The ways of the core and program voxels of one grid, as `loads.Forests`; `rows` are its cells, and its ground with `down` true."""

    def __init__(self, rows: pa.Table, limit: int, prices: tuple[int, int, int], left: float):
        down = rows["voxel_idx"].filter(rows["down"]).to_numpy()
        placed = np.logical_and.reduce([np.asarray(rows[c].is_valid()) for c in ("voxel_idx", *CELL[1:])])
        rows = rows.filter(pa.array(placed))
        voxel, program = rows["voxel_idx"].to_numpy(), rows["program_idx"].fill_null(UNASSIGNED).to_numpy()
        cell = np.array([rows[c].to_numpy() for c in CELL[1:]], dtype=np.int64)
        order = np.lexsort((voxel, cell[1], cell[0], cell[2]))
        # each place once
        order = order[np.append(np.diff(cell[:, order]).any(axis=0), True)[: len(order)]]
        cell, self.voxel, self.program = cell[:, order], voxel[order], program[order]
        n = len(order)
        self.left, self.name = left, rows["grid_id"][0].as_py() if n else None
        cell = cell - cell.min(axis=1, initial=_FAR, keepdims=True) + 1
        starts = np.flatnonzero(np.diff(cell[2], prepend=-1))
        floors = [slice(int(a), int(b)) for a, b in zip(starts, [*starts[1:], n][: len(starts)], strict=True)]
        self.near, ground = Near(self.voxel, cell), np.where(np.isin(self.voxel, down), limit, -1)
        self.core = Trees(self.near, floors, ground, np.zeros(n, bool), limit, prices)
        self.core_sums = self.core.sums("steps", "sides", "lead")
        # the core of the highest, then least, voxel that passes a cell owns it
        cores = np.flatnonzero((self.program == CORE) & self.core.known[0])
        cores = cores[np.lexsort((self.voxel[cores], -cell[2, cores]))]
        held = np.full(self.core.known.shape, n)
        held[0, cores] = np.arange(len(cores))
        there = held < n
        self.core.flowed(held, there, np.minimum)
        self.owned, run = there.any(axis=0), held.argmin(axis=0)
        self.tail = run * n + np.arange(n)
        ends = np.where(ground >= 0, ground, np.where(self.owned, limit - self.core_sums["lead"].reshape(-1)[self.tail], -1))
        self.own = Trees(self.near, floors, ends, self.owned, limit, prices)

    def _programs(self) -> tuple[np.ndarray, ...]:
        """Cells of programs with a way, its steps and sideways steps, and the node on which a core's way takes over, -1 where none does."""
        at = np.flatnonzero((self.program >= 0) & self.own.known[0])
        sums = self.own.sums("steps", "sides", "last")
        last = sums["last"][0, at]
        over, tail = self.owned[last], self.tail[last]
        steps, sides = (sums[c][0, at] + np.where(over, self.core_sums[c].reshape(-1)[tail], 0) for c in ("steps", "sides"))
        return at, steps, sides, np.where(over, tail, -1)

    def routes(self) -> dict:
        at, steps, sides, _ = self._programs()
        cores = np.flatnonzero((self.program == CORE) & self.core.known[0])
        every = np.concatenate([at, cores])
        steps, sides = (np.concatenate([x, self.core_sums[c][0, cores]]) for c, x in (("steps", steps), ("sides", sides)))
        return {"source": self.voxel[every], "program_idx": self.program[every], "steps": steps, "capacity": self.left ** sides.astype(float)}

    def _carried(self) -> list[tuple[Trees, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the programs' and of the cores' ways what passes each node, where any does, and what goes over there; a core's way carries 1."""
        at, _, sides, tail = self._programs()
        amount, out = self.left ** sides.astype(float), []
        for tree in (self.own, self.core):
            value, put, there = np.zeros(tree.move.shape), np.zeros(tree.move.shape), np.zeros(tree.move.shape, bool)
            if tree is self.own:
                value[0, at], there[0, at] = amount, True
            else:
                over = tail >= 0
                np.add.at(put.reshape(-1), tail[over], amount[over])
                there.reshape(-1)[tail[over]] = True
                core = (self.program == CORE) & tree.known[0]
                value += put
                value[0, core] += 1.0
                there[0, core] = True
            tree.flowed(value, there, np.add)
            out.append((tree, value, there, put))
        return out

    def passing(self) -> dict:
        """A program's way that goes over to a core's is counted on its own cells."""
        total, on = np.zeros(len(self.voxel)), np.zeros(len(self.voxel), bool)
        for _, value, there, put in self._carried():
            total += (value - put).sum(axis=0)
            on |= there.any(axis=0)
        return {"voxel_idx": self.voxel[on], "value": total[on]}

    def edges(self) -> dict:
        pairs = []
        for tree, _, there, _ in self._carried():
            r, at = np.nonzero(there & tree.goes)
            here, to = self.voxel[at], self.voxel[self.near.at[tree.move[r, at], at]]
            pairs.append((np.minimum(here, to), np.maximum(here, to)))
        a, b = distinct(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        return {"a": a, "b": b}
