"""Load paths against a search in plain Python, and the six known cases."""

import heapq
import random

import pytest

from latticework.operators import loads, regions, whole

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def cheapest(cells, sink, net, limit, source):
    """Cost of the cheapest way of `source`, or None; sink(voxel, run) ends a way, steps onto `net` cost a fifth."""
    at = {v: i for i, v in cells.items()}
    queue, seen = [(0, source, 0)], set()
    while queue:
        cost, i, run = heapq.heappop(queue)
        if (i, run) in seen:
            continue
        seen.add((i, run))
        if sink(i, run):
            return cost
        x, y, z = cells[i]
        steps = [((x, y, z - 1), 5, 0)] + [((x + a, y + b, z), 20, run + 1) for a, b in SIDES if run < limit]
        for to, step, k in steps:
            if to in at:
                heapq.heappush(queue, (cost + (step // 5 if at[to] in net else step), at[to], k))
    return None


def frames(spark, cells, programs, ground):
    rows = [("g", i, *cells[i], programs[i]) for i in cells]
    return spark.createDataFrame(rows, "grid_id string, voxel_idx long, ix int, iy int, iz int, program_idx int"), spark.createDataFrame([("g", i) for i in ground], "grid_id string, voxel_idx long")


def ways(paths):
    found = {}
    for r in sorted(paths.collect(), key=lambda r: (r.source, r.step)):
        found.setdefault(r.source, []).append(r.voxel_idx)
    return found


CASES = {
    "column": ([(0, 0, 0), (0, 0, 1), (0, 0, 2)], [-1, -1, 0], [0], 4, {2: [2, 1, 0]}, {0, 1}, set()),
    "floating core": ([(0, 0, 1), (0, 0, 2)], [-2, 0], [], 4, {}, set(), {0, 1}),
    "from above": ([(0, 0, 1), (0, 0, 2), (1, 0, 2), (2, 0, 2), (2, 0, 1), (2, 0, 0)], [0, -2, -1, -1, -1, -1], [5], 4, {1: [1, 2, 3, 4, 5]}, {2, 3, 4, 5}, {0}),
    "cantilever": ([(0, 0, 2), (1, 0, 2), (2, 0, 2), (2, 0, 1), (2, 0, 0)], [0, -1, -1, -1, -1], [4], 1, {}, set(), {0}),
    "cluster": ([(0, 0, 0), (0, 0, 1), (0, 0, 2), (1, 0, 2)], [-1, -1, 0, 0], [0], 4, {2: [2, 1, 0], 3: [3, 2, 1, 0]}, {0, 1}, set()),
    "near core": (
        [(0, 0, z) for z in range(7)] + [(1, 0, z) for z in range(7)], [-2] * 7 + [-1] * 6 + [0], [0, 7], 4,
        {k: list(range(k, -1, -1)) for k in range(7)} | {13: [13, 6, 5, 4, 3, 2, 1, 0]}, set(), set(),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_known_cases(spark, name):
    keys, programs, ground, limit, want, structure, lost = CASES[name]
    cells, down = frames(spark, dict(enumerate(keys)), programs, ground)
    paths = loads.load_paths(cells, down, limit)
    assert ways(paths) == want
    capacity = loads.capacities(paths)
    assert {r.voxel_idx for r in loads.importance(paths, cells).collect()} == structure
    assert {r.voxel_idx for r in loads.unsupported(cells, capacity).collect()} == lost
    if name == "column":
        assert [(r.steps, r.capacity) for r in capacity.collect()] == [(2, 1.0)]
    if name == "cluster":
        strong = loads.cluster_strength(regions.clusters(cells), capacity).collect()
        assert [(r.voxels, r.unrouted, r.unsupported, r.weak) for r in strong] == [(2, 0, False, True)]
        assert {r.voxel_idx: r.importance for r in loads.importance(paths, cells).collect()} == {0: 1.25, 1: 1.25}


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_costs_match_a_search(spark, limit):
    rng = random.Random(limit)
    cells = {}
    for x in range(7):
        for y in range(6):
            for z in range(6):
                if rng.random() < 0.62:
                    cells[len(cells)] = (x, y, z)
    programs = {i: rng.choice([-2, -1, -1, 0, 1]) for i in cells}
    ground = {i for i in cells if cells[i][2] == 0 and rng.random() < 0.5}
    frame, down = frames(spark, cells, programs, ground)
    rows = loads.load_paths(frame, down, limit)
    paths = ways(rows)
    net = {i for s, way in paths.items() if programs[s] == -2 for i in way}
    owner = {}
    for s in sorted((s for s in paths if programs[s] == -2), key=lambda s: (-cells[s][2], s)):
        for k, i in enumerate(paths[s]):
            owner.setdefault(i, paths[s][k:])

    def lead(i):
        return sum(cells[j][2] == cells[i][2] for j in owner[i]) - 1

    def paid(way, onto):
        return sum((5 if cells[a][2] > cells[b][2] else 20) // (5 if b in onto else 1) for a, b in zip(way, way[1:], strict=False))

    for s, p in programs.items():
        if p == -1:
            assert s not in paths
            continue
        onto = net if p >= 0 else set()
        want = cheapest(cells, lambda i, run, p=p: i in ground or (p >= 0 and i in owner and run + lead(i) <= limit), onto, limit, s)
        assert (want is None) == (s not in paths)
        if want is None:
            continue
        way, run = paths[s], 0
        assert way[0] == s and way[-1] in ground
        for a, b in zip(way, way[1:], strict=False):
            gap = [q - r for q, r in zip(cells[b], cells[a], strict=True)]
            assert gap == [0, 0, -1] or (gap[2] == 0 and abs(gap[0]) + abs(gap[1]) == 1)
            run = run + 1 if gap[2] == 0 else 0
            assert run <= limit
        # a way's own part costs what the search found; after it comes its core's tail
        ends = [k for k in range(len(way)) if paid(way[: k + 1], onto) == want and (way[k] in ground or owner.get(way[k]) == way[k:])]
        assert ends
    edges = {(r.a, r.b) for r in loads.network_edges(rows).collect()}
    assert edges == {(min(e), max(e)) for way in paths.values() for e in zip(way, way[1:], strict=False)}


def test_no_rows_and_simplified_lines(spark):
    cells, down = frames(spark, {}, [], [])
    assert loads.load_paths(cells, down).count() == 0
    line = [(0, 0, 0), (0, 0, 1), (0, 0, 2), (1, 0, 2), (2, 0, 2), (2, 0, 2), (3, 0, 2)]
    rows = spark.createDataFrame([("g", s, k, *map(float, p)) for s in (1, 2) for k, p in enumerate(line[: 7 if s == 1 else 3])], "grid_id string, source long, step int, x double, y double, z double")
    got = sorted((r.source, r.step) for r in loads.simplified(rows).collect())
    assert got == [(1, 0), (1, 2), (1, 4), (1, 5), (1, 6), (2, 0), (2, 2)]


def test_ways_over_bricks_are_those_within_one_and_join_only_doors(spark):
    rng = random.Random(5)
    cells = {}
    for x in range(7):
        for y in range(6):
            for z in range(6):
                if rng.random() < 0.62:
                    cells[len(cells)] = (x, y, z)
    programs = [rng.choice([-2, -1, -1, 0, 1]) for _ in cells]
    ground = [i for i in cells if cells[i][2] == 0 and rng.random() < 0.5]
    found = []
    for dx, dy, dz in ((0, 0, 0), (28, 30, 29)):
        frame, down = frames(spark, {i: (x + dx, y + dy, z + dz) for i, (x, y, z) in cells.items()}, programs, ground)
        way = loads.find_ways(frame, down, 3)
        doors = way.own.levels[0].count()
        # within one brick nothing is joined; over eight only where ways come in
        assert doors == 0 if dx == 0 else 0 < doors < len(cells)
        routes = sorted((r.source, r.program_idx, r.steps, r.capacity) for r in way.routes().collect())
        heavy = {r.voxel_idx: r.importance for r in loads.importance(way, frame).collect()}
        found.append((routes, heavy, {(r.a, r.b) for r in way.edges().collect()}, ways(loads.load_paths(frame, down, 3))))
    assert found[0] == found[1]
    assert len(found[0][0]) == len(found[0][3]) > 20


def test_a_grid_that_a_task_holds_takes_no_forests_and_its_ways_are_those_over_bricks(spark, monkeypatch):
    rng = random.Random(8)
    rows, down = [], [("a", 9_999), ("b", None), ("no", 0)]
    for grid, sides in (("a", (4, 4, 5)), ("b", (12, 4, 4))):
        ids = rng.sample(range(1000), 300)
        for x in range(sides[0]):
            for y in range(sides[1]):
                for z in range(sides[2]):
                    if rng.random() < 0.65:
                        rows.append((grid, ids.pop(), x + 3, y - 2, z, rng.choice([-2, -1, -1, 0, 1, None])))
                        down += [(grid, rows[-1][1])] * (2 if z == 0 and rng.random() < 0.6 else 0)
    cells = spark.createDataFrame([*rows, (None, 1, 0, 0, 0, 0)], "grid_id string, voxel_idx long, ix int, iy int, iz int, program_idx int")
    ground = spark.createDataFrame(down, "grid_id string, voxel_idx long")

    def found(ways):
        return [sorted(tuple(r) for r in d.collect()) for d in (ways.routes(), ways.passing(), ways.edges())]

    # only grid b is too wide for a task
    monkeypatch.setattr(whole, "PLACES", 20 * 300)
    want = found(loads.find_ways(cells.where("grid_id is not null"), ground))
    monkeypatch.undo()
    monkeypatch.setattr(loads, "_grown", None)
    got = found(loads.find_ways(cells, ground))
    assert got == want and {r[0] for r in got[2]} == {"a", "b"} and len(got[0]) > 40
