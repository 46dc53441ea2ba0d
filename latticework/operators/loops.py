"""Boundary loops of floor regions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from latticework.session import parted, written

#: fixed values: for each side (south, east, north, west) the neighbour's offset, and the start of its edge with the cell on the left
SIDES = [((0, -1), (0, 0)), ((1, 0), (1, 0)), ((0, 1), (1, 1)), ((-1, 0), (0, 1))]
#: the step of an edge by side
STEPS = [(1, 0), (0, 1), (-1, 0), (0, -1)]


def boundary_edges(footprint: DataFrame, region: list[str]) -> DataFrame:
    """(region, x, y, side): directed unit edges of (region, ix, iy) cells towards cells outside the region."""
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.lit(o[0]).alias("ox"), F.lit(o[1]).alias("oy"), F.lit(s[0]).alias("sx"), F.lit(s[1]).alias("sy")) for k, (o, s) in enumerate(SIDES)))
    cells = footprint.select(*region, "ix", "iy").distinct()
    asked = cells.select("*", F.explode(sides).alias("s")).select(*region, (F.col("ix") + F.col("s.ox")).alias("nx"), (F.col("iy") + F.col("s.oy")).alias("ny"), (F.col("ix") + F.col("s.sx")).alias("x"), (F.col("iy") + F.col("s.sy")).alias("y"), F.col("s.side").alias("side"))
    there = cells.select(*region, F.col("ix").alias("nx"), F.col("iy").alias("ny"))
    rows, on = 4 * footprint.count(), [*region, "nx", "ny"]
    return parted(asked, rows, *on).join(parted(there, rows, *on), on, "left_anti").select(*region, "x", "y", "side")


#: corners a side of the tiles in which edges are chained in one go
TILE = 32


def _chains_of_tile(region: list[str]):
    """Function of a tile's edges: they with the head and end of the chain they are in, and their place in it."""

    def chain(rows: pa.Table) -> pa.Table:
        x, y, side = (rows[c].to_numpy().astype(np.int64) for c in ("x", "y", "side"))
        order = np.lexsort((side, y, x))
        x, y, side = x[order], y[order], side[order]
        n = len(x)
        # place of the edge that starts at each corner of the tile on each side, -1 if none; one corner more on either side is empty
        left, low = (x[0] // TILE) * TILE, (y[0] // TILE) * TILE
        starts = np.full((TILE + 2, TILE + 2, 4), -1, np.int64)
        starts[x - left + 1, y - low + 1, side] = np.arange(n)
        dx, dy = np.array(STEPS).T
        to = starts[x + dx[side] - left + 1, y + dy[side] - low + 1]
        follows = np.full(n, -1, np.int64)
        for turn in (0, 1, 2, 3):
            on = to[np.arange(n), (side + 1 - turn) % 4]
            follows = np.where(follows < 0, on, follows)
        # `least` of the edges ahead and the steps to it, by doubling; a chain that leaves the tile ends, a closed one goes round
        ahead, jump, last = follows.copy(), (follows >= 0).astype(np.int64), np.where(follows >= 0, follows, np.arange(n))
        least, steps = np.arange(n), np.zeros(n, np.int64)
        for _ in range(int(n).bit_length() + 1):
            go = ahead >= 0
            then = ahead[go]
            lower = least[then] < least[go]
            steps[go] = np.where(lower, jump[go] + steps[then], steps[go])
            least[go] = np.where(lower, least[then], least[go])
            jump[go] += jump[then]
            last[go] = last[then]
            ahead[go] = ahead[then]
        closed = ahead >= 0
        # an open chain's last edge names it until its head, the edge that none precedes, is known
        head = np.ones(n, bool)
        head[follows[follows >= 0]] = False
        head_of = np.full(n, -1, np.int64)
        firsts = np.nonzero(head)[0]
        head_of[last[firsts]] = firsts
        name = np.where(closed, least, head_of[last])
        size = np.where(closed, 0, jump[name] + 1)
        round_ = np.zeros(n, np.int64)
        np.maximum.at(round_, name[closed], steps[closed] + 1)
        size = np.where(closed, round_[name], size)
        place = np.where(closed, np.where(steps == 0, 0, size - steps), jump[name] - jump)
        out = {c: rows[c].take(pa.array(np.zeros(n, np.int64))) for c in region}
        end = last
        columns = {
            "x": x, "y": y, "side": side, "head_x": x[name], "head_y": y[name], "head_side": side[name], "place": place, "size": size,
            "least_x": x[least], "least_y": y[least], "least_side": side[least], "steps": steps, "end_x": x[end] + dx[side[end]], "end_y": y[end] + dy[side[end]], "came": side[end],
        }
        out |= {c: pa.array(v) for c, v in columns.items()}
        return pa.table(out | {"closed": pa.array(closed)})

    return chain


def region_loops(footprint: DataFrame, region: list[str], max_rounds: int = 60) -> DataFrame:
    """(region, loop_x, loop_y, loop_side, place, x, y): boundary loops with the region on the left.

    At a corner a loop turns left if it can, then goes straight on, then right.
    Loops are named by their least edge, which has place 0. `region` names the
    columns that tell regions apart. Edges are chained within tiles; only chains
    that leave their tile are joined to one another, in rounds.
    """
    edges = boundary_edges(footprint, region)
    tile = [F.shiftright(c, TILE.bit_length() - 1).alias(f"t{c}") for c in "xy"]
    numbers = ["x", "y", "side", "head_x", "head_y", "head_side", "place", "size", "least_x", "least_y", "least_side", "steps", "end_x", "end_y", "came"]
    schema = StructType([*(edges.schema[c] for c in region), *(StructField(c, LongType()) for c in numbers), StructField("closed", BooleanType())])
    chained, _ = written(edges.select("*", *tile).groupBy(*region, "tx", "ty").applyInArrow(_chains_of_tile(region), schema))
    head = [*region, "head_x", "head_y", "head_side"]
    heads = chained.where("place = 0 and not closed")
    # the chain that starts where another ends, at the first turn
    starts = heads.select(*region, F.col("x").alias("end_x"), F.col("y").alias("end_y"), F.struct("x", "y", "side").alias("next"))
    turn = F.pmod(F.col("came") + 1 - F.col("next.side"), F.lit(4))
    chain, least = F.struct("x", "y", "side"), F.struct(F.col("least_x").alias("x"), F.col("least_y").alias("y"), F.col("least_side").alias("side"))
    following = heads.join(starts, [*region, "end_x", "end_y"]).groupBy(*region, chain.alias("chain"), least.alias("least"), "steps", "size").agg(F.min_by("next", turn).alias("next"))
    # by doubling, each chain learns the least edge among those that follow and the steps to it, until that is its loop's
    now, seen = written(following.select(*region, "chain", "next", "least", "steps", "size", F.col("size").alias("span")), moved=F.count(F.lit(1)))
    for _ in range(max_rounds):
        if not seen["moved"]:
            break
        ahead = now.select(*region, F.col("chain").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"), F.col("steps").alias("steps2"), F.col("span").alias("span2"))
        lower = F.col("least2") < F.col("least")
        there = now.join(ahead, [*region, "next"]).select(
            *region, "chain", F.col("next2").alias("next"), F.when(lower, F.col("least2")).otherwise(F.col("least")).alias("least"),
            F.when(lower, F.col("span") + F.col("steps2")).otherwise(F.col("steps")).alias("steps"), "size", (F.col("span") + F.col("span2")).alias("span"), lower.alias("lower"),
        )
        now, seen = written(there, moved=F.count_if(F.col("lower")))
        now = now.drop("lower")
    else:
        raise RuntimeError(f"loops did not close in {max_rounds} rounds")
    sizes = now.groupBy(*region, "least").agg(F.sum("size").alias("loop_size"))
    loops, _ = written(now.join(sizes, [*region, "least"]).select(*region, *(F.col(f"chain.{c}").alias(f"head_{c}") for c in ("x", "y", "side")), F.col("least").alias("loop"), F.col("steps").alias("to_least"), "loop_size"))
    place = F.when(F.col("closed"), F.col("place")).otherwise(F.pmod(F.col("place") - F.col("to_least"), F.col("loop_size")))
    named = chained.select(*head, "x", "y", "place", "closed").join(loops, head, "left")
    return named.select(*region, *(F.coalesce(f"loop.{c}", f"head_{c}").cast("int").alias(f"loop_{c}") for c in ("x", "y", "side")), place.cast("long").alias("place"), *(F.col(c).cast("int").alias(c) for c in "xy"))
