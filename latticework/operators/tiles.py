"""Tile compatibility and arc consistency over voxel candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import bricks
from latticework.operators.grid import DIRECTIONS
from latticework.session import checkpointed, counted

#: fixed values: names of the directions +x, -x, +y, -y, +z, -z
NAMES = ["px", "nx", "py", "ny", "pz", "nz"]


def compat(tiles: DataFrame, tile_neighbors: DataFrame) -> DataFrame:
    """(tile_a, dir, tile_b): a allows b's type in dir and b allows a's type in the opposite one."""
    opposite = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(NAMES) for x in (n, NAMES[i ^ 1]))), F.col("dir"))
    allowed = tile_neighbors.distinct().join(tiles.select(F.col("tile_id").alias("tile_b"), F.col("tile_type").alias("allowed_type")), "allowed_type").select(F.col("tile_id").alias("tile_a"), "dir", "tile_b")
    back = allowed.select(F.col("tile_b").alias("tile_a"), opposite.alias("dir"), F.col("tile_a").alias("tile_b"))
    return allowed.join(back, ["tile_a", "dir", "tile_b"], "left_semi").distinct()


#: tiles of one plane of bits, and tiles whose rules may pass through the driver
BITS, MOST_TILES = 59, 4096


def propagate(candidates: DataFrame, compat: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The greatest arc-consistent subset of (grid_id, ix, iy, iz, tile_id) candidates.

    A candidate goes when some existing neighbour has no compatible one left; a
    voxel that loses all of them is a contradiction and is absent from the result,
    and so are all that it is connected to. Candidates are bits that are settled
    inside bricks; a round goes on only where a brick's face changed. Rules of
    more than MOST_TILES tiles stay a table, and candidates rows.
    """
    cell = ["grid_id", "ix", "iy", "iz"]
    kind = dict(candidates.dtypes)["tile_id"]
    known = compat.select(F.col("tile_a").alias("t")).union(compat.select("tile_b")).union(candidates.select("tile_id")).distinct().limit(MOST_TILES + 1).collect()
    if len(known) > MOST_TILES:
        return _by_joins(candidates, compat, max_rounds)
    ids = sorted(r["t"] for r in known)
    planes = max(1, -(-len(ids) // BITS))
    number = {t: i for i, t in enumerate(ids)}
    # for each direction and tile, the bits of the tiles that it allows there
    allowed = np.zeros((6, len(ids), planes), dtype=np.int64)
    for r in compat.distinct().collect():
        b = number[r["tile_b"]]
        allowed[NAMES.index(r["dir"]), number[r["tile_a"]], b // BITS] |= 1 << (b % BITS)
    names = candidates.sparkSession.createDataFrame([(t, i // BITS, 1 << (i % BITS)) for t, i in number.items()], f"tile_id {kind}, plane int, bit long")
    masks = candidates.join(F.broadcast(names), "tile_id").groupBy(*cell).agg(*(F.coalesce(F.bit_or(F.when(F.col("plane") == p, F.col("bit"))), F.lit(0)).alias(f"m{p}") for p in range(planes)))
    settled = bricks.settle(masks.withColumn("voxel_idx", F.lit(0).cast("long")), [f"m{p}" for p in range(planes)], planes, _consistent(allowed), max_rounds)

    def rows(around, fixed, place):
        held = bricks.inner(around)[(slice(None), *place)]
        found = [np.flatnonzero(held[i // BITS] & (1 << (i % BITS))) for i in range(len(ids))]
        return {"cell": np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64), "tile": np.repeat(np.array(ids, dtype=np.int64), [len(f) for f in found])}

    return bricks.unpacked(settled, "tile long", rows).select(*cell, F.col("tile").cast(kind).alias("tile_id"))


def _consistent(allowed: np.ndarray):
    def solve(planes, fixed, _corner):
        """The bits of each cell that every neighbour there is has something for."""
        now = bricks.inner(planes)
        empty = fixed[0] >= bricks.FAR
        now[...] = np.where(empty, bricks.FAR, fixed[1:])
        while True:
            before = now.copy()
            for d, (x, y, z) in enumerate(DIRECTIONS):
                axis = (x, y, z).index(x + y + z)
                other = bricks.looked(planes, axis, x + y + z)
                absent = other[0] >= bricks.FAR
                for t in range(allowed.shape[1]):
                    mine, bit = now[t // BITS], np.int64(1 << (t % BITS))
                    held = absent | ((other & allowed[d, t][:, None, None, None]) != 0).any(axis=0)
                    mine[...] = np.where(held | empty, mine, mine & ~bit)
            if (now == before).all():
                return before

    return solve


def _by_joins(candidates: DataFrame, compat: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """`propagate` for any number of tiles, a row a candidate.

    After the first round only candidates next to one that has just gone are
    judged again.
    """
    cell = ["grid_id", "ix", "iy", "iz"]
    key = [*cell, "tile_id"]
    bit = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(NAMES) for x in (n, 1 << i))), F.col("dir"))
    step = {c: F.element_at(F.create_map(*(F.lit(x) for n, o in zip(NAMES, DIRECTIONS, strict=True) for x in (n, o[k]))), F.col("dir")) for k, c in enumerate("xyz")}
    rules, size = counted(compat.select("tile_a", "dir", F.col("tile_b").alias("tile_id"), bit.alias("bit"), *(step[c].alias(f"o{c}") for c in "xyz")).distinct(), n=F.count(F.lit(1)))
    if size["n"] < 100_000:
        rules = F.broadcast(rules)
    back = [F.struct(F.lit(1 << i).alias("bit"), *(F.lit(-v).alias(f"o{c}") for c, v in zip("xyz", o, strict=True))) for i, o in enumerate(DIRECTIONS)]
    cells = candidates.select(*cell).distinct()
    seen = cells.select("*", F.explode(F.array(*back)).alias("s")).groupBy("grid_id", *((F.col(f"i{c}") + F.col(f"s.o{c}")).alias(f"i{c}") for c in "xyz")).agg(F.bit_or("s.bit").alias("sides"))
    # sides: a bit for each direction with an existing neighbour; a candidate needs a compatible one on all of them
    start = checkpointed(candidates.select(*key).distinct().join(seen, cell, "left").withColumn("sides", F.coalesce("sides", F.lit(0))))
    behind = [(F.col(f"i{c}") - F.col(f"o{c}")).alias(f"i{c}") for c in "xyz"]
    asked, left, gone = start, start, None
    for k in range(max_rounds):
        around = asked.select(*cell, F.col("tile_id").alias("tile_a"), "sides").join(rules, "tile_a").select("grid_id", *((F.col(f"i{c}") + F.col(f"o{c}")).alias(f"i{c}") for c in "xyz"), "tile_id", "bit", *(f"o{c}" for c in "xyz"), "tile_a", "sides")
        met = around.join(left.select(*key), key).groupBy("grid_id", *behind, F.col("tile_a").alias("tile_id"), "sides").agg(F.bit_or("bit").alias("met"))
        held = met.where(F.col("met").bitwiseAND(F.col("sides")) == F.col("sides")).select(*key)
        # a candidate without neighbours holds by itself
        lost, n = counted(asked.where("sides <> 0").join(held, key, "left_anti").select(*key), n=F.count(F.lit(1)))
        if not n["n"]:
            return left.select(*key)
        gone = lost if gone is None else gone.unionByName(lost)
        if k % 16 == 15:
            gone = checkpointed(gone)
        left = start.join(gone, key, "left_anti")
        near = lost.join(rules, "tile_id").select("grid_id", *behind, F.col("tile_a").alias("tile_id")).distinct()
        asked = checkpointed(left.join(near, key, "left_semi"))
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def prune_exhausted(candidates: DataFrame, tiles: DataFrame, compat: DataFrame) -> DataFrame:
    """Candidates left when used-up tiles leave every voxel that is not settled, made arc-consistent again.

    A voxel with one candidate is settled; a tile is used up when as many voxels
    of the grid are settled on it as its max_count (0 or more) allows.
    """
    cell = ["grid_id", "ix", "iy", "iz"]
    rows = candidates.select(*cell, "tile_id").distinct()
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.min("tile_id").alias("only"))
    settled = counts.where("n = 1").groupBy("grid_id", F.col("only").alias("tile_id")).agg(F.count(F.lit(1)).alias("held"))
    limits = tiles.where("max_count >= 0").select("tile_id", "max_count")
    full = rows.select("grid_id", "tile_id").distinct().join(limits, "tile_id").join(settled, ["grid_id", "tile_id"], "left").where("coalesce(held, 0) >= max_count").select("grid_id", "tile_id", F.lit(True).alias("full"))
    left = rows.join(counts, cell).join(full, ["grid_id", "tile_id"], "left").where("n = 1 or full is null")
    return propagate(left.select(*cell, "tile_id"), compat)
