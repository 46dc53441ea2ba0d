"""Generated cores against a walk in plain Python, and labels, reports and paths."""

import math
import random

from pyspark.sql import functions as F

from latticework.operators import generated, whole


def walked(cells, bonus, radius, most_far, most):
    """Cores and unserved cells of {index: (x, y, z)}, floor by floor."""
    floors = {}
    for i in sorted(cells):
        floors.setdefault(cells[i][2], []).append(i)
    levels = sorted(floors)
    raw = {}
    for f in levels:
        some = floors[f][:50]
        for i in floors[f]:
            raw[i] = sum(math.dist(cells[i][:2], cells[j][:2]) for j in some) / len(some) / most_far - bonus.get(i, 0.0)

    def near(i, f):
        mine = [raw[j] for j in floors.get(f, []) if max(abs(cells[j][0] - cells[i][0]), abs(cells[j][1] - cells[i][1])) <= 1]
        return sum(mine) / len(mine) if mine else raw[floors[f][0]] if f in floors else 0.0

    score = {}
    for n, f in enumerate(levels):
        for i in floors[f]:
            score[i] = 0.6 * raw[i] + 0.25 * near(i, levels[n - 1] if n else None) + 0.15 * near(i, levels[n + 1] if n + 1 < len(levels) else None)
    left, cores, held = set(cells), [], set()
    while left and len(cores) < most:
        open_levels = [f for f in levels if any(i in left for i in floors[f])]
        dp = {i: (score[i] if i in left else 0.0, None) for i in floors[open_levels[0]]}
        for n, f in enumerate(levels[1:], 1):
            for i in floors[f]:
                options = [(dp[j][0] + (score[i] if i in left else 0.0) + math.dist(cells[i][:2], cells[j][:2]) * most_far / 10, j) for j in floors[levels[n - 1]] if j in dp and max(abs(cells[j][0] - cells[i][0]), abs(cells[j][1] - cells[i][1])) <= 1]
                if options:
                    dp[i] = min(options)
        ends = [(i not in left, dp[i][0], i) for i in floors[open_levels[-1]] if i in dp]
        at = min(ends)[2] if ends else min((score[i], i) for i in floors[open_levels[0]] if i in left)[1]
        path = []
        while at is not None:
            path.append(at)
            at = dp[at][1] if at in dp else None
        core = {(cells[p][2], i) for p in path for i in floors[cells[p][2]] if math.dist(cells[i][:2], cells[p][:2]) <= radius}
        cores.append(core)
        held |= {i for _, i in core}
        seen, front = set(held), set(held)
        where = {v: i for i, v in cells.items()}
        for _ in range(int(most_far)):
            front = {where[n] for i in front for d in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (n := (cells[i][0] + d[0], cells[i][1] + d[1], cells[i][2])) in where} - seen
            seen |= front
        if not left & seen:
            break
        left -= seen
    return cores, left


def test_generated_cores_match_a_walk(spark):
    rng = random.Random(21)
    rows, bonus = [], []
    for g in range(3):
        for x in range(7):
            for y in range(7):
                for z in (0, 1, 2, 4):
                    if rng.random() < 0.7:
                        i = (x * 7 + y) * 5 + z
                        rows.append((f"g{g}", i, x, y, z))
                        bonus.append((f"g{g}", i, "light", round(rng.random(), 3)))
    voxels = spark.createDataFrame(rows, "grid_id string, voxel_idx long, ix int, iy int, iz int")
    channels = spark.createDataFrame(bonus, "grid_id string, voxel_idx long, label string, value double")
    cores, left = (d.collect() for d in generated.generate_cores(voxels, channels, 1.0, 3.0, most=6))
    for g in ("g0", "g1", "g2"):
        want, open_ = walked({r[1]: r[2:] for r in rows if r[0] == g}, {b[1]: b[3] for b in bonus if b[0] == g}, 1.0, 3.0, 6)
        got = {}
        for r in cores:
            if r["grid_id"] == g:
                got.setdefault(r["core_id"], set()).add((r["iz"], r["voxel_idx"]))
        assert [got[k] for k in sorted(got)] == want
        assert {r["voxel_idx"] for r in left if r["grid_id"] == g} == open_
    none = generated.generate_cores(voxels.limit(0), None)
    assert none[0].count() == none[1].count() == 0


def test_floor_coverage_stays_on_its_floor(spark):
    rows = [("g", i, i, 0, 0) for i in range(6)] + [("g", 10, 0, 0, 1), ("g", 20, 8, 0, 0)]
    voxels = spark.createDataFrame(rows, "grid_id string, voxel_idx long, ix int, iy int, iz int")
    reached = generated.floor_coverage(voxels, voxels.where(F.col("voxel_idx") == 1), 3.0)
    assert {r["voxel_idx"] for r in reached.collect()} == {0, 1, 2, 3, 4}


def test_blending_over_tiles_is_that_within_one(spark):
    rng = random.Random(3)
    cells = [(x, y, z, rng.randrange(64) / 8) for x in range(8) for y in range(7) for z in range(4) if rng.random() < 0.8]
    found = []
    for d in (0, 28):
        rows = [("g", i, x + d, y + d, z + d, z + d, raw) for i, (x, y, z, raw) in enumerate(cells)]
        frame = spark.createDataFrame(rows, "grid_id string, voxel_idx long, ix int, iy int, iz int, level int, raw double")
        found.append({r.voxel_idx: r.score for r in generated.blended(frame).collect()})
    assert found[0] == found[1] and len(found[0]) == len(cells)
    # a cell is dealt to its tile and to those it touches, not nine times
    wide = spark.createDataFrame([(x, y) for x in range(64) for y in range(64)], "ix int, iy int")
    assert generated._tiled(wide, ["ix", "iy"]).count() == (64 + 2 + 2) ** 2


def test_cores_of_a_grid_that_a_task_holds_take_no_rounds_and_equal_those_over_tiles(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"g{g}", (x * 5 + y) * 3 + z, x, y, z) for g in range(2) for x in range(5) for y in range(5) for z in range(3) if rng.random() < 0.6]
    voxels = spark.createDataFrame([*rows, (None, 0, 0, 0, 0), ("g0", None, 1, None, 2)], "grid_id string, voxel_idx long, ix int, iy int, iz int")
    placed = lambda: [sorted(tuple(r) for r in d.collect()) for d in generated.generate_cores(voxels, None, 1.0, 2.0, most=2)]
    monkeypatch.setattr(whole, "PLACES", 0)
    want = placed()
    monkeypatch.undo()
    monkeypatch.setattr(generated, "core_path", None)
    assert placed() == want and {r[1] for r in want[0]} == {0, 1}


def test_the_query_places_all_cores_of_a_grid(spark, tmp_path):
    import __spark_entry__ as entry

    # cells of one floor that do not touch: a core serves what lies within 10 of its cell
    lines = [(x, y, 0, 1.0, 1.0) for x, y in ((0, 0), (6, 8), (20, 0), (40, 40), (47, 20))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    cores = {}
    for r in entry.queries()["v_generate_cores"](spark, str(tmp_path)).collect():
        cores.setdefault(r["core_id"], set()).add((r["voxel_idx"] // 960, r["voxel_idx"] // 20 % 48))
    assert sorted(cores) == [0, 1, 2, 3] and {frozenset(c) for c in cores.values()} == {frozenset(c) for c in ({(0, 0), (6, 8)}, {(20, 0)}, {(40, 40)}, {(47, 20)})}


def test_a_floor_without_distances_has_paths_only_where_one_comes_from_below():
    import pyarrow as pa

    # a row without a place leaves its floor without distances; the cell of least index there is out of reach
    rows = [(7, 0, 0, 0), (9, 0, 0, 1), (3, 5, 5, 1), (None, None, 0, 1)]
    table = pa.table({"grid_id": ["g"] * 4} | {c: pa.array([r[k] for r in rows], pa.int32() if k else pa.int64()) for k, c in enumerate(("voxel_idx", "ix", "iy", "iz"))})
    found = generated._placed(0.0, 3.0, 1.0, 20, False)(table).to_pylist()
    assert [(r["core_id"], r["iz"], r["voxel_idx"]) for r in found] == [(0, 1, 9), (0, 0, 7), (1, 1, 3)]
