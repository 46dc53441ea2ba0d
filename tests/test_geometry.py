"""Voxelising, views and the channel functions that follow the geometry."""

import itertools
import math
import random

import pytest

from latticework.functions import channels as ch
from latticework.operators import allocation as al
from latticework.operators import cores, grid, tiles, views
from latticework.sources import meshes, stack
from latticework.sources import voxels as vx

TRIANGLE = "grid_id string, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz")


def box(name, size, low=(0.0, 0.0, 0.0)):
    at = lambda k: [low[i] + size[i] * k[i] for i in range(3)]
    out = []
    for axis, side in itertools.product(range(3), (0, 1)):
        quad = []
        for p, q in ((0, 0), (1, 0), (1, 1), (0, 1)):
            k = [0, 0, 0]
            k[axis], k[(axis + 1) % 3], k[(axis + 2) % 3] = side, p, q
            quad.append(at(k))
        out += [(name, *quad[0], *quad[1], *quad[2]), (name, *quad[0], *quad[2], *quad[3])]
    return out


def test_boxes_fill_their_grid(spark):
    df = spark.createDataFrame(box("a", (4.0, 2.0, 1.0)) + box("b", (3.0, 3.0, 3.0), (5.0, 5.0, 5.0)) + [(None, *[0.0] * 9)], TRIANGLE)
    dims = {r["grid_id"]: (r["nx"], r["ny"], r["nz"], r["voxel_size"]) for r in meshes.grids_of(df, 8).collect()}
    assert dims == {"a": (8, 4, 2, 0.5), "b": (8, 8, 8, 0.375)}
    got = {r["grid_id"]: r["count"] for r in meshes.voxelize(df, 8).groupBy("grid_id").count().collect()}
    assert got == {"a": 64, "b": 512}
    with pytest.raises(ValueError):
        meshes.grids_of(df, 0)


def test_hollow_and_slanted_meshes(spark):
    hollow = box("h", (6.0, 6.0, 6.0)) + box("h", (2.0, 2.0, 2.0), (2.0, 2.0, 2.0))
    o, x, y, z = (0.0, 0.0, 0.0), (8.0, 0.0, 0.0), (0.0, 8.0, 0.0), (0.0, 0.0, 8.0)
    slant = [("s", *p, *q, *r) for p, q, r in ((o, x, y), (o, y, z), (o, z, x), (x, y, z))]
    df = spark.createDataFrame(hollow + slant, TRIANGLE)
    got = meshes.voxelize(df, 6).where("grid_id = 'h'")
    assert got.count() == 216 - 8
    cells = {(r["ix"], r["iy"], r["iz"]) for r in meshes.voxelize(df.where("grid_id = 's'"), 7).collect()}
    assert cells == {k for k in itertools.product(range(7), repeat=3) if sum(k) + 1.5 < 7}


def nearest(origin, d, rows, radius):
    best = radius
    for r in rows:
        a, b, c = (r[i : i + 3] for i in (1, 4, 7))
        e1, e2, t = ([p - q for p, q in zip(m, a, strict=True)] for m in (b, c, origin))
        cross = lambda m, n: (m[1] * n[2] - m[2] * n[1], m[2] * n[0] - m[0] * n[2], m[0] * n[1] - m[1] * n[0])
        dot = lambda m, n: sum(i * j for i, j in zip(m, n, strict=True))
        p, q = cross(d, e2), cross(t, e1)
        det = dot(e1, p)
        if abs(det) < 1e-12:
            continue
        s, w, far = dot(t, p) / det, dot(d, q) / det, dot(e2, q) / det
        if s >= 0 and w >= 0 and s + w <= 1 and far >= 0:
            best = min(best, far)
    return best


@pytest.mark.parametrize("kind", ["sky", "horizon"])
def test_views_against_every_triangle(spark, kind):
    rng = random.Random(4)
    rows = [("g", *(rng.uniform(-20, 20) for _ in range(9))) for _ in range(25)]
    v = spark.createDataFrame([("g", i, i, 2 * i, 3 - i) for i in range(5)], "grid_id string, voxel_idx long, ix int, iy int, iz int")
    centers = grid.centers(v)
    f, table = (views.sky_view, views.sphere_directions) if kind == "sky" else (views.horizon_view, views.planar_directions)
    directions = [tuple(r[1:]) for r in table(spark, 30).collect()]
    assert len(directions) == 30 and all(abs(math.hypot(*d) - 1) < 1e-9 for d in directions)
    got = {r["voxel_idx"]: r["value"] for r in f(centers, spark.createDataFrame(rows, TRIANGLE), 30, 40.0).collect()}
    for r in centers.collect():
        want = sum(nearest((r["x"], r["y"], r["z"]), d, rows, 40.0) for d in directions) if r["z"] >= 0 else 0.0
        assert got[r["voxel_idx"]] == pytest.approx(want, abs=1e-6)
    free = {r["value"] for r in f(centers.where("z >= 0"), None, 2, 0.5).collect()}
    assert free == {4.0}


def test_round_robin_in_small_batches(spark):
    rng = random.Random(8)
    rows = [(v, p, rng.randint(0, 9) / 9) for v in range(60) for p in range(3)]
    scored = spark.createDataFrame([("g", *r) for r in rows], "grid_id string, voxel_idx long, program_idx int, score double")
    programs = vx.programs(spark, [("a", 7), ("b", -1), ("c", 21)])
    caps, taken = {0: 7, 1: 999, 2: 21}, {}
    used = dict.fromkeys(caps, 0)
    order = {p: [r[0] for r in sorted((r for r in rows if r[1] == p), key=lambda r: (-r[2], r[0]))] for p in caps}
    claimed = True
    while claimed:
        claimed = False
        for p in caps:
            v = next((v for v in order[p] if v not in taken), None)
            if v is not None and used[p] < caps[p]:
                taken[v], used[p], claimed = p, used[p] + 1, True
    for batch in (5, 1000):
        got = al.assign_round_robin(scored, programs, show_all=False, batch=batch)
        assert {r["voxel_idx"]: r["program_idx"] for r in got.collect()} == {v: taken.get(v, -1) for v in range(60)}


def test_structure_program(spark):
    a = spark.createDataFrame([("g", i, -1, 0.0) for i in range(3)], "grid_id string, voxel_idx long, program_idx int, winning_score double")
    programs = vx.programs(spark, [("a", 7)])
    marked, more = al.with_structure(a, programs, a.where("voxel_idx < 2"))
    assert [r["program_idx"] for r in marked.orderBy("voxel_idx").collect()] == [1, 1, -1]
    assert [(r["name"], r["voxel_count"]) for r in more.orderBy("program_idx").collect()] == [("a", 7), ("Structure", 2)]
    with pytest.raises(ValueError):
        al.with_structure(a, more, a)


def test_surface_distance_of_a_block(spark):
    v = vx.from_keys(spark.createDataFrame([("g", *k) for k in itertools.product(range(5), repeat=3)], "grid_id string, ix int, iy int, iz int"))
    got = {r["value"]: r["count"] for r in grid.surface_distance(v, 2.0).groupBy("value").count().collect()}
    assert got == {0.0: 98, 2.0: 26, 4.0: 1}


def test_real_estate_curve(spark):
    tops = spark.createDataFrame([("low", 1), ("g", 40)], "grid_id string, top int")
    got = {(r["grid_id"], r["floor_idx"]): r["value"] for r in ch.real_estate_values(tops).collect()}
    curve = [1.0]
    for f in range(2, 41):
        curve.append(curve[-1] * next((g for last, g in ch.GROWTH if f <= last), ch.GROWTH_ABOVE))
    start = 38
    value = max(curve[start - 1], 1.35 * sum(curve[: start - 1]) / (start - 1))
    want = curve[: start - 1] + [value, value * 1.02, value * 1.02**2]
    assert [got["g", f] for f in range(1, 41)] == pytest.approx(want) and got["low", 1] == 1.0


def test_channel_accessors(spark):
    df = spark.createDataFrame([("g", 0, "b", 2.0), ("g", 0, "a", 1.0)], "grid_id string, voxel_idx long, label string, value double")
    assert ch.voxel_vectors(df).first()["values"] == {"a": 1.0, "b": 2.0}
    assert ch.channel_of(df, "a").count() == 1
    with pytest.raises(ValueError, match="'a', 'b'"):
        ch.channel_of(df, "c")


def test_exhausted_tiles(spark):
    t = spark.createDataFrame([(0, "A", 1), (1, "B", -1)], "tile_id int, tile_type string, max_count int")
    every = spark.createDataFrame([(i, d, x) for i in (0, 1) for d in tiles.NAMES for x in "AB"], "tile_id int, dir string, allowed_type string")
    allowed = tiles.compat(t, every)
    start = spark.createDataFrame([("g", 0, 0, 0, 0), ("g", 1, 0, 0, 0), ("g", 1, 0, 0, 1)], "grid_id string, ix int, iy int, iz int, tile_id int")
    left = tiles.prune_exhausted(start, t, allowed)
    assert sorted((r["ix"], r["tile_id"]) for r in left.collect()) == [(0, 0), (1, 1)]


def test_core_distance_and_curves(spark):
    rng = random.Random(6)
    keys = [k for k in itertools.product(range(7), range(6), range(5)) if rng.random() < 0.6]
    v = spark.createDataFrame([("g", i, *k) for i, k in enumerate(keys)] + [("none", 0, 0, 0, 0)], "grid_id string, voxel_idx long, ix int, iy int, iz int")
    picked = rng.sample(range(len(keys)), 4)
    core = spark.createDataFrame([("g", i) for i in picked] * 2 + [("g", 10_000)], "grid_id string, voxel_idx long")
    far = cores.core_distance(v, core, 2.0)
    got = {(r["grid_id"], r["voxel_idx"]): (r["distance"], r["is_core"]) for r in far.collect()}
    want = {("g", i): (pytest.approx(2.0 * min(math.dist(k, keys[c]) for c in picked)), i in picked) for i, k in enumerate(keys)}
    assert got == want | {("none", 0): (0.0, False)}
    near = {r["voxel_idx"]: r["value"] for r in cores.core_proximity(far).where("grid_id = 'g'").collect()}
    assert min(near.values()) == 0 and max(near, key=near.get) in picked
    assert cores.core_coverage(far, 1e9).where("grid_id = 'g'").first()["beyond"] == 0

    curves = [("g", 1, 0.0, 0.0, 0.0, 6.0, 5.0, 4.0), ("g", 1, 6.0, 5.0, 4.0, 6.0, 0.0, 4.0), ("g", 2, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0)]
    table = spark.createDataFrame(curves, "grid_id string, curve_id int, " + ", ".join(f"{p}{c} double" for p in "ab" for c in "xyz"))
    close = {(r["voxel_idx"], r["curve_id"]): r["distance"] for r in cores.core_from_curves(grid.centers(v), table, 1.3).where("grid_id = 'g'").collect()}
    brute = {}
    for i, k in enumerate(keys):
        p = [x + 0.5 for x in k]
        for _, c, *ends in curves:
            a, d = ends[:3], [y - x for x, y in zip(ends[:3], ends[3:], strict=True)]
            size = sum(x * x for x in d)
            t = max(0, min(1, sum((x - y) * z for x, y, z in zip(p, a, d, strict=True)) / size)) if size else 0
            brute[i, c] = min(brute.get((i, c), 1e9), math.dist(p, [x + t * y for x, y in zip(a, d, strict=True)]))
    assert close == {k: pytest.approx(x) for k, x in brute.items() if x <= 1.3}


def test_core_footprints(spark):
    at = spark.createDataFrame([("g", 1, z, x + 0.5, 0.5, z + 0.5) for z in range(2) for x in range(2)] + [("g", 2, 3, 9.5, 9.5, 3.5)], "grid_id string, core_id int, iz int, x double, y double, z double")
    floors = cores.footprints(at)
    assert [tuple(r)[3:] for r in floors.where("core_id = 1").orderBy("iz").collect()] == [(1.0, 0.5, 0.5, 0.0, 0.0, 2.0, 1.0), (1.0, 0.5, 1.5, 0.0, 0.0, 2.0, 1.0)]
    lines = {r["core_id"]: [tuple(p) for p in r["points"]] for r in cores.centerlines(floors).collect()}
    assert lines == {1: [(1.0, 0.5, 0.5), (1.0, 0.5, 1.5)], 2: [(9.5, 9.5, 3.5), (9.5, 9.5, 4.5)]}


def test_stack_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("7", 0, 1), ("b", 1, -1)], "grid_id string, voxel_idx long, program_idx int")
    programs = vx.programs(spark, [("a", 7)])
    stack.write_stack(str(tmp_path / "s"), {"assignment": a, "programs": programs})
    got = stack.read_stack(spark, str(tmp_path / "s"), ["assignment", "programs"])
    assert sorted((r["grid_id"], r["voxel_idx"], r["program_idx"]) for r in got["assignment"].collect()) == [("7", 0, 1), ("b", 1, -1)]
    assert got["programs"].collect() == programs.collect()
    with pytest.raises(ValueError):
        stack.write_stack(str(tmp_path / "t"), {"other": a})


def test_voxelize_broadcasts_no_row_of_each_mesh(spark, tmp_path):
    """Grids are as many as meshes, so their boxes and sizes are joined without the driver."""
    side = [((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((0, 0, 0), (1, 0, 0), (0, 0, 1)), ((0, 0, 0), (0, 1, 0), (0, 0, 1)), ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    rows = [("m", *(float(v) for p in t for v in p)) for t in side]
    # of a file the size is known, and is small
    spark.createDataFrame(rows, TRIANGLE).write.parquet(str(tmp_path / "m"))
    found = meshes.voxelize(spark.read.parquet(str(tmp_path / "m")), 4)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {(r["ix"], r["iy"], r["iz"]) for r in found.collect()} >= {(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)}


def test_rays_of_a_block_are_tested_together(monkeypatch):
    """The least distances are those of one ray, centre and triangle at a time, however few tests are done at once."""
    import numpy as np

    monkeypatch.setattr(views, "TESTS", 50)
    draw = np.random.default_rng(5)
    at, corners = draw.uniform(0, 4, (20, 3)), draw.uniform(-6, 10, (30, 3, 3))
    rays = draw.normal(size=(25, 3))
    rays /= np.sqrt((rays**2).sum(axis=1, keepdims=True))
    near = np.full((25, 20), 8.0)
    views._nearest(at, corners, rays, views._across(rays), near)
    for i, j in itertools.product(range(25), range(20)):
        ways = [8.0]
        for a, b, c in corners:
            far, s, t = np.linalg.solve(np.stack([-rays[i], b - a, c - a]).T, at[j] - a)
            if s >= 0 and t >= 0 and s + t <= 1 and far >= 0:
                ways.append(far)
        assert near[i, j] == pytest.approx(min(ways), abs=1e-9)


def test_meshes_that_a_task_holds_are_filled_there_as_by_lines(spark, monkeypatch):
    """Also where a mesh is too large for a task, its triangles come in rows, it has no extent, or it is cut at centres."""
    rng = random.Random(4)
    rows = [(None, *[0.0] * 9), ("flat", *[1.0] * 9), ("null", None, *[0.0] * 8)]
    for k in range(40):
        rows += box(f"b{k}", [rng.choice([0.5, 1.0, 1.75, 3.0, rng.random() + 0.1]) for _ in range(3)], [rng.choice([0.0, -2.5, rng.random()]) for _ in range(3)])
    rows += box("b0", (0.5, 0.25, 1.0), (0.25, 0.25, 0.0)) + box("b0", (0.5, 0.25, 1.0), (0.25, 0.25, 0.0))
    for k in range(20):
        o, x, y, z = ([rng.random() * 4 for _ in range(3)] for _ in range(4))
        rows += [(f"t{k}", *p, *q, *r) for p, q, r in ((o, x, y), (o, y, z), (o, z, x), (x, y, z))]
    rows += [("open", *(rng.random() for _ in range(9))) for _ in range(30)]
    df = spark.createDataFrame(rows, TRIANGLE).repartition(5).cache()
    for resolution in (1, 4, 7):
        want = sorted(map(tuple, meshes._by_lines(df, resolution).collect()))
        monkeypatch.setattr(meshes, "AT_ONCE", 3000)
        found = meshes.voxelize(df, resolution)
        # nothing is dealt out but the triangles
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        assert sorted(map(tuple, found.collect())) == want and want
        monkeypatch.setattr(meshes, "COLUMNS", 3 * (resolution + 1) ** 2 * 20)
        assert sorted(map(tuple, meshes.voxelize(df, resolution).collect())) == want
        monkeypatch.undo()
    twice = meshes.voxelize(df.select("grid_id").distinct(), 4, lambda d: d.join(df, "grid_id"), 12)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, meshes.voxelize(df, 4).collect()))
