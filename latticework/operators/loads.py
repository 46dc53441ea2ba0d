"""Load paths: the cheapest ways of cores and programs to the ground, their capacity and what they lean on."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators import bricks, trees, whole
from latticework.operators.allocation import CORE, UNASSIGNED
from latticework.operators.forests import ENDS, SHIFT, Brick, Forest, node_of, place_of, table
from latticework.session import written
from latticework.sources.voxels import CELL, KEY

#: fixed values: cost of a step down and sideways, each a fifth onto the core network; here in fifths, so that costs are whole
DOWN, SIDE, SHARE = 5, 20, 5
#: fixed values: what a sideways step leaves of the capacity, and the capacity up to which a cluster is weak
LEFT, WEAK = 0.25, 0.25
#: the cell on which a program's way goes over to a core's
_TAIL = [f"tail_{c}" for c in CELL[1:]]


def _costs(limit: int):
    """Planes c0 to c<limit>: the cost from a cell to an end when that many sideways steps come before; then the network and the voxel."""

    def solve(planes, fixed, _corner):
        inside = bricks.inner(planes)
        empty = fixed[0] >= bricks.FAR
        ends = np.where(fixed[1] < bricks.FAR, fixed[1], -1)
        inside[limit + 1], inside[limit + 2] = fixed[2], fixed[0]
        # ways never go up, and a step sideways adds to the run: one turn over floors and runs settles a brick
        for z in range(bricks.SIDE):
            if empty[:, :, z].all():
                continue
            joined = planes[limit + 1]
            fall = _onto(planes[0, 1:-1, 1:-1, z], joined[1:-1, 1:-1, z], DOWN)
            for r in range(limit, -1, -1):
                best = np.where(ends[:, :, z] >= r, 0, fall)
                if r < limit:
                    paid = _onto(planes[r + 1, :, :, z + 1], joined[:, :, z + 1], SIDE)
                    best = np.minimum.reduce([best, paid[2:, 1:-1], paid[:-2, 1:-1], paid[1:-1, 2:], paid[1:-1, :-2]])
                inside[r, :, :, z] = np.where(empty[:, :, z], bricks.FAR, best)
        return inside.copy()

    return solve


def _onto(cost: np.ndarray, joined: np.ndarray, step: int) -> np.ndarray:
    """Costs over a step onto a cell: a fifth of it where the cell is on the network."""
    return np.where(cost < bricks.FAR, cost + np.where(joined < bricks.FAR, step // SHARE, step), bricks.FAR)


#: rows of a cell's way
_SUMS = "grid_id string, voxel_idx long, ix int, iy int, iz int, steps long, sides long, end_idx long"


def _grown(cells: DataFrame, limit: int, max_rounds: int) -> Forest:
    """The ways over `cells` with program_idx; `ends` is the most sideways steps with which a way may end there, `joined` marks the network."""
    settled = bricks.settle(cells, ["ends", "joined", "program_idx"], limit + 3, _costs(limit), max_rounds)
    return Forest(settled, limit, _onto, (DOWN, SIDE))


def _programs(brick: Brick) -> np.ndarray:
    """The program of each node's cell."""
    return brick.programs[tuple(brick.cell)]


def _summed(core: bool):
    """Rows of the ways of a brick's core or program voxels."""

    def rows(brick: Brick):
        program = _programs(brick)
        at = np.flatnonzero((brick.run == 0) & ((program == CORE) if core else (program >= 0) & (program < bricks.FAR)))
        return brick.where(at) | {"program_idx": program[at]} | {n: x[at] for n, x in brick.sums().items()}, len(at)

    return rows


def _highest(brick: Brick):
    """The highest, then least, core voxel that passes each node, as its place in a list of them."""
    at = np.flatnonzero((brick.run == 0) & (_programs(brick) == CORE))
    node, _, (height, source) = brick.put(["height", "source"])
    node = np.concatenate([brick.node[at], node])
    height = np.concatenate([-(bricks.SIDE * brick.key[3] + brick.cell[2, at]), height]).astype(np.int64)
    source = np.concatenate([brick.voxel(at), source]).astype(np.int64)
    order = np.lexsort((source, height))
    value = np.full(brick.moves.shape, len(order))
    np.minimum.at(value.reshape(-1), node[order], np.arange(len(order)))
    there = value < len(order)
    brick.flowed(value, there, np.minimum)
    return value, there, lambda places: {"height": height[order][places], "source": source[order][places]}


def _owned(brick: Brick):
    """Of each cell on a core's way the run of the core that owns it, with the sums of the way on from there."""
    value, there, _ = _highest(brick)
    held = np.where(there, value, bricks.FAR)
    run = held.argmin(axis=0)
    at = np.flatnonzero(there.ravel()[brick.node] & (brick.run == run[tuple(brick.cell)]))
    return brick.where(at) | {"run": brick.run[at]} | {n: x[at] for n, x in brick.sums().items()}, len(at)


def _carried(core: bool):
    """What passes each node, and what is put there by rows; a core's way carries 1."""

    def held(brick: Brick):
        value, put = np.zeros(brick.moves.shape), np.zeros(brick.moves.shape)
        there = np.zeros(brick.moves.shape, bool)
        node, entered, (amount,) = brick.put(["value"])
        np.add.at(value.reshape(-1), node, amount)
        np.add.at(put.reshape(-1), node[~entered], amount[~entered])
        there.reshape(-1)[node] = True
        if core:
            at = brick.node[(brick.run == 0) & (_programs(brick) == CORE)]
            value.reshape(-1)[at] += 1.0
            there.reshape(-1)[at] = True
        brick.flowed(value, there, np.add)
        return value, there, put

    return held


def _passed(core: bool):
    """The sum of what passes each cell; a program's way that goes over to a core's is counted on its own cells."""

    def rows(brick: Brick):
        value, there, put = _carried(core)(brick)
        every = (value - put if core else value).sum(axis=0)
        on = there.any(axis=0)
        at = np.flatnonzero(on[tuple(brick.cell)])
        _, first = np.unique(brick.voxel(at), return_index=True)
        at = at[first]
        return brick.where(at) | {"value": every[tuple(brick.cell[:, at])]}, len(at)

    return rows


def _stepped(core: bool):
    """The distinct steps of the ways in a brick."""

    def rows(brick: Brick):
        _, there, _ = _carried(core)(brick)
        at = np.flatnonzero(there.ravel()[brick.node] & (brick.move < ENDS))
        here, to = brick.voxel(at), brick.voxel(at, SHIFT[brick.move[at]].T)
        a, b = trees.distinct(np.minimum(here, to), np.maximum(here, to))
        return {"grid_id": brick.key[0], "a": a, "b": b}, len(a)

    return rows


def _puts(rows: DataFrame, run: Column, *cell: str) -> DataFrame:
    """`rows` with a value as what bricks hear of their nodes, summed."""
    return rows.select("grid_id", *place_of(*cell), node_of(run, *cell), "value").groupBy(*bricks.BRICK, "node").agg(F.sum("value").alias("value")).withColumn("entered", F.lit(False))


class Forests:
    """Ways of all core and program voxels to the ground, as two forests over bricks; see `find_ways`."""

    def __init__(self, cells: DataFrame, ground: DataFrame, limit: int, max_rounds: int):
        self.cells, _ = written(cells.select(*KEY, *CELL[1:], "program_idx"))
        grounded = self.cells.join(ground.select(*KEY).distinct().withColumn("ends", F.lit(limit).cast("long")), KEY, "left")
        self.core = _grown(grounded.withColumn("joined", F.lit(None).cast("long")), limit, max_rounds)
        # the core of the highest, then least, voxel that passes a cell owns it
        passing = self.core.come_in({"height": "long", "source": "long"}, F.min, _highest)
        self.owner, _ = written(self.core.visit(f"{_SUMS}, run int, lead long", _owned, self.core.told(), passing))
        onto = self.owner.select(*KEY, (F.lit(limit) - F.col("lead")).alias("free"))
        joined = grounded.join(onto, KEY, "left").select(*KEY, *CELL[1:], "program_idx", F.coalesce("ends", "free").alias("ends"), F.when(F.col("free").isNotNull(), 1).cast("long").alias("joined"))
        self.own = _grown(joined, limit, max_rounds)

    def routes(self) -> DataFrame:
        """(grid_id, source, program_idx, steps, capacity) of every core and program voxel with a way: a sideways step leaves a quarter, a step down all of it."""
        return self._routes().select("grid_id", F.col("voxel_idx").alias("source"), "program_idx", F.col("steps").cast("int").alias("steps"), F.pow(F.lit(LEFT), "sides").alias("capacity"))

    def _routes(self) -> DataFrame:
        """Sources with the sums of their ways, and the core way that a program's goes over to after `before` steps."""
        schema = f"{_SUMS}, program_idx int"
        cores = self.core.visit(schema, _summed(True), self.core.told())
        tails = self.owner.select("grid_id", F.col("voxel_idx").alias("end_idx"), F.col("run").alias("tail_run"), *(F.col(c).alias(f"tail_{c}") for c in (*CELL[1:], "steps", "sides")))
        own = self.own.visit(schema, _summed(False), self.own.told()).withColumn("before", F.col("steps")).join(tails, ["grid_id", "end_idx"], "left")
        more = [(F.col(c) + F.coalesce(f"tail_{c}", F.lit(0))).alias(c) for c in ("steps", "sides")]
        return cores.unionByName(own.select(*KEY, *CELL[1:], "program_idx", *more, "end_idx", "before", "tail_run", *_TAIL), allowMissingColumns=True)

    def _flows(self) -> tuple[list[DataFrame], list[DataFrame]]:
        """What the bricks of the programs' and of the cores' ways hear of it; a core's way carries 1 and a program's its capacity."""
        routes, _ = written(self._routes().where("program_idx >= 0").withColumn("value", F.pow(F.lit(LEFT), "sides")))
        own, _ = written(_puts(routes, F.lit(0), *CELL[1:]))
        tails, _ = written(_puts(routes.where("tail_run is not null"), F.col("tail_run"), *_TAIL))
        value = {"value": "double"}
        named = lambda core: lambda brick: (*_carried(core)(brick)[:2], lambda x: {"value": x})
        return [own, self.own.come_in(value, F.sum, named(False), own)], [tails, self.core.come_in(value, F.sum, named(True), tails)]

    def passing(self) -> DataFrame:
        """(grid_id, voxel_idx, value): the sum of what the ways through each voxel carry."""
        own, core = self._flows()
        schema = "grid_id string, voxel_idx long, value double"
        return self.own.visit(schema, _passed(False), *own).unionByName(self.core.visit(schema, _passed(True), *core)).groupBy(*KEY).agg(F.sum("value").alias("value"))

    def edges(self) -> DataFrame:
        """(grid_id, a, b) of the distinct steps of all ways, in either direction, with a < b."""
        own, core = self._flows()
        schema = "grid_id string, a long, b long"
        return self.own.visit(schema, _stepped(False), *own).unionByName(self.core.visit(schema, _stepped(True), *core)).distinct()


class Ways:
    """Ways of all core and program voxels to the ground; see `find_ways`.

    A task follows those of a grid that it can hold; larger grids go as forests over bricks.
    """

    def __init__(self, cells: DataFrame, ground: DataFrame, limit: int, max_rounds: int):
        self.cells, _ = written(cells.select(*KEY, *CELL[1:], "program_idx"))
        self.ground, self.limit, self.max_rounds = ground.select(*KEY), limit, max_rounds

    @cached_property
    def forests(self) -> Forests:
        """The forests of all grids, for lists of ways."""
        return Forests(self.cells, self.ground, self.limit, self.max_rounds)

    core, own = property(lambda self: self.forests.core), property(lambda self: self.forests.own)

    @cached_property
    def _parts(self) -> tuple[DataFrame, Forests | None]:
        # a cell has a node for each number of sideways steps
        small, large, parts = whole.split(self.cells, whole.PLACES // (4 * (self.limit + 1)))
        rows = small.withColumn("down", F.lit(False)).unionByName(self.ground.where("grid_id is not null and voxel_idx is not null").withColumn("down", F.lit(True)), allowMissingColumns=True)
        return rows.repartition(parts, "grid_id"), large and Forests(large, self.ground, self.limit, self.max_rounds)

    def _made(self, schema: str, made: Callable[[trees.Grid], dict], wide: Callable[[Forests], DataFrame]) -> DataFrame:
        small, large = self._parts
        limit = self.limit

        def rows(given: pa.Table) -> pa.Table:
            grid = trees.Grid(given, limit, (DOWN, SIDE, SHARE), LEFT)
            columns = made(grid)
            return pa.Table.from_batches([table(schema, {"grid_id": grid.name} | columns, len(next(iter(columns.values()))))])

        found = small.groupBy("grid_id").applyInArrow(rows, schema)
        return found if large is None else found.unionByName(wide(large))

    def routes(self) -> DataFrame:
        """(grid_id, source, program_idx, steps, capacity) of every core and program voxel with a way: a sideways step leaves a quarter, a step down all of it."""
        return self._made("grid_id string, source long, program_idx int, steps int, capacity double", trees.Grid.routes, Forests.routes)

    def passing(self) -> DataFrame:
        """(grid_id, voxel_idx, value): the sum of what the ways through each voxel carry."""
        return self._made("grid_id string, voxel_idx long, value double", trees.Grid.passing, Forests.passing)

    def edges(self) -> DataFrame:
        """(grid_id, a, b) of the distinct steps of all ways, in either direction, with a < b."""
        return self._made("grid_id string, a long, b long", trees.Grid.edges, Forests.edges)


def find_ways(cells: DataFrame, ground: DataFrame, max_cantilever: int = 4, max_rounds: int = 10_000) -> Ways:
    """The ways of each core and program voxel to the ground, without listing them.

    `cells` has grid_id, voxel_idx, ix, iy, iz, program_idx. A way goes down for
    1 or sideways for 4, never up, with at most max_cantilever sideways steps in
    a row, through any voxel. Cores go first, each by itself. The cells of their
    ways are the network: a step onto it costs a fifth, and a program may end on
    it and go on as the core of the highest, then least, voxel that passes there,
    where the sideways steps in a row allow it. Programs do not attract each
    other. Ties go to the lesser next voxel. Ground rows that are no voxels are
    dropped. Rows are at most voxels times max_cantilever + 1.
    """
    if max_cantilever < 0:
        raise ValueError("max_cantilever has to be 0 or more")
    return Ways(cells, ground, int(max_cantilever), max_rounds)


def _listed(forest: Forest, sources: DataFrame, max_rounds: int) -> DataFrame:
    """(grid_id, source, step, ix, iy, iz) of every source's way from its node, where `sources` has (grid_id, bx, by, bz, node, source, step); a round is a brick of all of them."""
    schema = f"grid_id string, bx int, by int, bz int, node int, source long, step long, {', '.join(f'{c} int' for c in CELL[1:])}"

    def rows(brick: Brick):
        node, _, (source, step) = brick.put(["source", "step"])
        at, out, gone = brick.place[node], [], []
        while len(at):
            out.append((source, step, at))
            leaves, goes = brick.out[at], (brick.move[at] < ENDS) & ~brick.out[at]
            gone.append((source[leaves], step[leaves] + 1, at[leaves]))
            at, source, step = brick.place[brick.to_node[at[goes]]], source[goes], step[goes] + 1
        if not out:
            return {}, 0
        listed, left = ([np.concatenate(x) for x in zip(*part, strict=True)] for part in (out, gone))
        k, m = len(listed[0]), len(left[0])
        none, beyond = np.zeros(k, bool), brick.beyond(left[2])
        columns = {b: pa.array(np.concatenate([np.zeros(k, np.int64), beyond[f"to_{b}"]]).astype(np.int32), mask=np.concatenate([~none, np.zeros(m, bool)])) for b in (*bricks.BRICK[1:], "node")}
        columns |= {c: pa.array(np.concatenate([x, np.zeros(m, np.int64)]).astype(np.int32), mask=np.concatenate([none, np.ones(m, bool)])) for c, x in brick.where(listed[2]).items() if c in CELL[1:]}
        return columns | {"grid_id": brick.key[0], "source": np.concatenate([listed[0], left[0]]), "step": np.concatenate([listed[1], left[1]])}, k + m

    at, pieces = sources, None
    for _ in range(max_rounds):
        made, seen = written(forest.visit(schema, rows, at.withColumn("entered", F.lit(True))), more=F.count("node"))
        found = made.where("node is null").select("grid_id", "source", "step", *CELL[1:])
        pieces = found if pieces is None else pieces.unionByName(found)
        if not seen["more"]:
            return pieces
        at = made.where("node is not null").select(*bricks.BRICK, "node", "source", "step")
    raise RuntimeError(f"ways not traced in {max_rounds} rounds")


def load_paths(cells: DataFrame, ground: DataFrame, max_cantilever: int = 4, max_rounds: int = 10_000) -> DataFrame:
    """(grid_id, source, program_idx, step, voxel_idx, ix, iy, iz): the ways of `find_ways`, cell by cell.

    Rows are the sum of all lengths; `Ways` has sums, capacities and importance
    without them. A voxel without a way has no rows.
    """
    ways = find_ways(cells, ground, max_cantilever, max_rounds).forests
    routes, _ = written(ways._routes())
    source, none = F.col("voxel_idx").alias("source"), F.lit(0)
    start = routes.select("grid_id", *place_of(*CELL[1:]), node_of(none, *CELL[1:]), source, none.cast("long").alias("step"), "program_idx")
    cores = _listed(ways.core, start.where(F.col("program_idx") == CORE), max_rounds)
    own = _listed(ways.own, start.where("program_idx >= 0"), max_rounds)
    over = routes.where("tail_run is not null").select("grid_id", *place_of(*_TAIL), node_of(F.col("tail_run"), *_TAIL), source, F.col("before").alias("step"))
    # the cell on which a way goes over to a core's is on both
    rest = _listed(ways.core, over, max_rounds).join(over.select("grid_id", "source", F.col("step").alias("before")), ["grid_id", "source"]).where("step > before").drop("before")
    every = cores.unionByName(own).unionByName(rest).join(ways.cells.select(*KEY, *CELL[1:]), CELL)
    programs = ways.cells.select("grid_id", F.col("voxel_idx").alias("source"), "program_idx")
    return every.join(programs, ["grid_id", "source"]).select("grid_id", "source", "program_idx", "step", "voxel_idx", *CELL[1:])


def capacities(paths: DataFrame) -> DataFrame:
    """(grid_id, source, program_idx, steps, capacity): a sideways step leaves a quarter, a step down all of it."""
    steps = F.max("step")
    return paths.groupBy("grid_id", "source", "program_idx").agg(steps.alias("steps"), F.pow(F.lit(LEFT), steps - (F.max("iz") - F.min("iz"))).alias("capacity"))


def cluster_strength(clustered: DataFrame, capacity: DataFrame) -> DataFrame:
    """(grid_id, program_idx, cluster, voxels, unrouted, unsupported, weak) of the clusters of `regions.clusters`."""
    known = capacity.select("grid_id", F.col("source").alias("voxel_idx"), "capacity")
    none = F.col("capacity").isNull()
    return clustered.join(known, KEY, "left").groupBy("grid_id", "program_idx", "cluster").agg(
        F.count(F.lit(1)).alias("voxels"), F.count_if(none).alias("unrouted"), F.bool_or(none).alias("unsupported"), F.bool_or(none | (F.col("capacity") <= WEAK)).alias("weak")
    )


def unsupported(cells: DataFrame, capacity: DataFrame) -> DataFrame:
    """(grid_id, voxel_idx, program_idx) of core and program voxels without a way to the ground."""
    known = capacity.select("grid_id", F.col("source").alias("voxel_idx"))
    return cells.where(F.col("program_idx") != UNASSIGNED).join(known, KEY, "left_anti").select(*KEY, "program_idx")


def importance(paths: DataFrame | Ways, cells: DataFrame) -> DataFrame:
    """(grid_id, voxel_idx, importance) of the unassigned voxels on a way: the structure.

    A core's way adds 1 to each, a program's way its capacity. Takes listed paths,
    or the ways themselves, which need no list.
    """
    free = cells.where(F.col("program_idx") == UNASSIGNED).select(*KEY)
    if isinstance(paths, Ways):
        return paths.passing().join(free, KEY, "left_semi").where("value > 0").select(*KEY, F.col("value").alias("importance"))
    weight = F.when(F.col("program_idx") == CORE, 1.0).otherwise(F.col("capacity"))
    on = paths.join(free, KEY, "left_semi").select("grid_id", "source", "voxel_idx")
    return on.join(capacities(paths).select("grid_id", "source", weight.alias("weight")), ["grid_id", "source"]).groupBy(*KEY).agg(F.sum("weight").alias("importance"))


def network_edges(paths: DataFrame) -> DataFrame:
    """(grid_id, a, b) of the distinct steps of all ways, in either direction, with a < b."""
    before = F.lag("voxel_idx").over(Window.partitionBy("grid_id", "source").orderBy("step"))
    steps = paths.select("grid_id", "voxel_idx", before.alias("before")).where("before is not null")
    return steps.select("grid_id", F.least("before", "voxel_idx").alias("a"), F.greatest("before", "voxel_idx").alias("b")).distinct()


def simplified(lines: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """The rows of (grid_id, source, step, x, y, z) lines that are ends or turns, with `turn`: the change of direction there, null at ends.

    The change is the length of the difference between the unit directions before
    and after. A point that repeats the one before it has no direction and stays.
    """
    order = Window.partitionBy("grid_id", "source").orderBy("step")

    def unit(ahead: bool) -> list[Column]:
        gap = [F.lead(c).over(order) - F.col(c) if ahead else F.col(c) - F.lag(c).over(order) for c in "xyz"]
        length = F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0]))
        return [F.when(length > 0, g / length).otherwise(g) for g in gap]

    apart = [b - a for a, b in zip(unit(False), unit(True), strict=True)]
    still = sum((F.abs(a) for a in unit(False)[1:]), F.abs(unit(False)[0])) == 0
    turned = lines.withColumns({"turn": F.sqrt(sum((a * a for a in apart[1:]), apart[0] * apart[0])), "still": still})
    return turned.where((F.col("turn").isNull()) | (F.col("turn") > tolerance) | F.col("still")).drop("still")
