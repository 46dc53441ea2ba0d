"""Waves over several bricks, ways without lists, and ties: against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from latticework.operators import allocation, bricks, grid, loads, support

STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def moved(cell, step):
    return tuple(a + b for a, b in zip(cell, step, strict=True))


@pytest.fixture(scope="module")
def solid():
    """Cells of a block over four bricks with a few holes, in an order that is not that of their places."""
    rng = random.Random(4)
    cells = [(x, y, z) for x in range(36) for y in range(35) for z in range(9) if rng.random() < 0.98]
    rng.shuffle(cells)
    return {c: i for i, c in enumerate(cells)}


def frame(spark, cells, grid_id="g"):
    return spark.createDataFrame([(grid_id, i, *c) for c, i in cells.items()], "grid_id string, voxel_idx long, ix int, iy int, iz int")


def waves(cells):
    """Level, and square and index of the seed, of each cell, level by level."""
    front = {c: (0, 0, i, c) for c, i in cells.items() if any(moved(c, s) not in cells for s in STEPS)}
    found, level = dict(front), 0
    while front:
        level, nxt = level + 1, {}
        for c, (_, _, i, seed) in front.items():
            for s in STEPS:
                to = moved(c, s)
                if to in cells and to not in found:
                    offer = (level, sum((a - b) ** 2 for a, b in zip(to, seed, strict=True)), i, seed)
                    nxt[to] = min(offer, nxt.get(to, offer))
        found |= nxt
        front = nxt
    return {cells[c]: v for c, v in found.items()}


def test_depth_and_distance_over_bricks(spark, solid, monkeypatch):
    monkeypatch.setattr(bricks, "VERSIONS", 2)
    rows = frame(spark, solid).unionByName(frame(spark, {(0, 0, 0): 0, (40, 3, 2): 7}, "other"))
    want = waves(solid)
    depth = {(r["grid_id"], r["voxel_idx"]): r["value"] for r in grid.surface_depth(rows).collect()}
    assert depth == {("g", i): float(v[0]) for i, v in want.items()} | {("other", 0): 0.0, ("other", 7): 0.0}
    far = {r["voxel_idx"]: r["value"] for r in grid.surface_distance(rows, 2.0).where("grid_id = 'g'").collect()}
    assert far == {i: pytest.approx(2.0 * v[1] ** 0.5) for i, v in want.items()}
    with pytest.raises(ValueError):
        grid.surface_depth(rows.limit(0))


def test_support_over_bricks(spark):
    # a comb: pillars far apart, and beams that need several bricks to be crossed
    cells = {(x, y, z) for x in range(40) for y in (0, 36) for z in (0, 18, 33) if z or x % 13 == 0} | {(x, y, z) for x in range(0, 40, 13) for y in (0, 36) for z in range(34)}
    numbered = {c: i for i, c in enumerate(sorted(cells))}
    rows = frame(spark, numbered).withColumn("program_idx", F.lit(0))
    for limit in (2, 6):
        got = {r["voxel_idx"]: r["overhang"] for r in support.support(rows, support.ground_contact(rows), limit).collect()}
        for (x, _, z), i in numbered.items():
            need = min(abs(x - p) for p in range(0, 40, 13))
            assert got[i] == (need if need <= limit and (z or not need) else None)


@pytest.mark.parametrize("limit", [1, 4])
def test_ways_without_lists(spark, limit):
    rng = random.Random(limit)
    cells = {(x, y, z): 0 for x in range(22, 42) for y in range(27, 36) for z in range(26, 38) if rng.random() < 0.6}
    cells = {c: i for i, c in enumerate(cells)}
    program = {i: -2 if c[0] in (30, 37) and c[1] == 31 else rng.choice([-1, -1, 0, 1]) for c, i in cells.items()}
    rows = spark.createDataFrame([("g", i, *c, program[i]) for c, i in cells.items()], "grid_id string, voxel_idx long, ix int, iy int, iz int, program_idx int")
    ground = support.ground_contact(rows, -26.0)
    ways, paths = loads.find_ways(rows, ground, limit), loads.load_paths(rows, ground, limit).cache()
    listed = Counter(map(tuple, loads.capacities(paths).select("source", "program_idx", "steps", "capacity").collect()))
    assert Counter(map(tuple, ways.routes().select("source", "program_idx", "steps", "capacity").collect())) == listed and listed
    heavy = {r["voxel_idx"]: r["importance"] for r in loads.importance(paths, rows).collect()}
    assert {r["voxel_idx"]: r["importance"] for r in loads.importance(ways, rows).collect()} == heavy
    edges = Counter(map(tuple, loads.network_edges(paths).collect()))
    assert Counter(map(tuple, ways.edges().collect())) == edges


def test_ties_spread_over_ranges(spark):
    flat = spark.range(60_000).select(F.lit("g").alias("grid_id"), F.col("id").alias("voxel_idx"), F.when(F.col("id") % 3 == 0, F.rand(1)).otherwise(0.5).alias("score"))
    flat = flat.cache()
    most = allocation.ranged(flat, ["grid_id"], "score").groupBy("range").count().agg(F.max("count")).first()[0]
    assert most < 60_000 / 64 * 1.3
    got = [r["voxel_idx"] for r in allocation.numbered(flat, ["grid_id"], "score", "k").orderBy("k").collect()]
    want = [r["voxel_idx"] for r in flat.orderBy(F.col("score").desc(), "voxel_idx").collect()]
    assert got == want


def test_numbers_do_not_depend_on_the_order_in_which_rows_come(spark):
    """Approximate quantiles differ with the order of rows; the ranges they give have to be the same for all that reads them."""

    def mixed(batches):
        import pandas as pd

        yield pd.concat(list(batches)).sample(frac=1)

    rows = spark.range(300_000, numPartitions=2).select(F.lit("g").alias("grid_id"), F.col("id").alias("voxel_idx"), F.xxhash64("id").cast("double").alias("score"))
    parts = allocation.ranged(rows.mapInPandas(mixed, rows.schema), ["grid_id"], "score")
    first, second = (parts.select("voxel_idx", "range").toPandas().sort_values("voxel_idx")["range"].tolist() for _ in range(2))
    assert first == second
