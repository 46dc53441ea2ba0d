"""Boxes, support, membranes and boundary loops against brute force."""

import itertools
import random

import pytest
from latticework.operators import boxes, loops, membranes
from latticework.operators import support as sp


def cells(spark, keys, programs):
    return spark.createDataFrame([("g", i, *k, p) for i, (k, p) in enumerate(zip(keys, programs, strict=True))], "grid_id string, voxel_idx long, ix int, iy int, iz int, program_idx int")


def greedy_boxes(filled):
    out, left = [], set(filled)
    while left:
        best = None
        for x, y, z in left:
            for w, d, h in itertools.product(range(1, 5), repeat=3):
                box = set(itertools.product(range(x, x + w), range(y, y + d), range(z, z + h)))
                if box <= left:
                    key = (-w * d * h, x, y, z, w, d, h)
                    if best is None or key < best[0]:
                        best = (key, box)
        out.append(best[0])
        left -= best[1]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_boxes_equal_the_greedy_order(spark, seed):
    rng = random.Random(seed)
    keys = [k for k in itertools.product(range(4), repeat=3) if rng.random() < 0.8]
    programs = [rng.choice([0, 0, 0, 0, -2, -1]) for _ in keys]
    got = sorted((r["program_idx"], -r["voxel_count"], r["ix"], r["iy"], r["iz"], r["w"], r["d"], r["h"]) for r in boxes.merge_boxes(cells(spark, keys, programs)).collect())
    want = sorted((p, *b) for p in (0, -2) for b in greedy_boxes([k for k, q in zip(keys, programs, strict=True) if q == p]))
    assert got == want


@pytest.mark.parametrize("listed", [0.01, 1, 2])
def test_boxes_are_the_same_when_smaller_ones_wait(spark, monkeypatch, listed):
    monkeypatch.setattr(boxes, "LISTED", listed)
    rng = random.Random(7)
    keys = [k for k in itertools.product(range(4), repeat=3) if rng.random() < 0.9]
    got = sorted((-r["voxel_count"], r["ix"], r["iy"], r["iz"], r["w"], r["d"], r["h"]) for r in boxes.merge_boxes(cells(spark, keys, [0] * len(keys))).collect())
    assert got == sorted(greedy_boxes(keys))


def test_a_solid_block_is_one_box(spark):
    keys = list(itertools.product(range(12), repeat=3))
    got = boxes.merge_boxes(cells(spark, [*keys, (20, 0, 0), (20, 0, 1)], [0] * (len(keys) + 2))).collect()
    assert sorted(r["voxel_count"] for r in got) == [2, 12**3]


def merged(df, **options):
    return sorted((-r["voxel_count"], r["ix"], r["iy"], r["iz"], r["w"], r["d"], r["h"]) for r in boxes.merge_boxes(df, **options).collect())


def test_boxes_of_small_grids_take_no_round_over_the_table(spark):
    rng = random.Random(3)
    keys = [k for k in itertools.product(range(4), repeat=3) if rng.random() < 0.7]
    assert merged(cells(spark, keys, [0] * len(keys)), max_rounds=0) == sorted(greedy_boxes(keys))


@pytest.mark.parametrize("side", [4, 8])
def test_boxes_are_the_same_over_many_tiles(spark, side):
    rng = random.Random(11)
    noise = [k for k in itertools.product(range(-3, 14), range(11), range(9)) if rng.random() < 0.5]
    # beside it a bar that no tile holds, with a hole, and voxels given twice
    bar = [(x, 20 + y, z) for x, y, z in itertools.product(range(20), range(2), range(2)) if (x, y, z) != (15, 0, 1)]
    df = cells(spark, [*noise, *bar, *bar[:5]], [0] * (len(noise) + len(bar) + 5))
    got = merged(df, side=side)
    assert got == merged(df, max_rounds=0)
    assert got[0] == (-60, 0, 20, 0, 15, 2, 2) and -sum(b[0] for b in got) == len(noise) + len(bar)
    with pytest.raises(RuntimeError):
        boxes.merge_boxes(df, max_rounds=0, side=side)


def test_box_report_over_tiles_takes_no_round_over_the_table(spark):
    rng = random.Random(5)
    keys = [k for k in itertools.product(range(20), range(20), range(4)) if rng.random() < 0.4]
    df = cells(spark, keys, [rng.choice([0, 1, -1]) for _ in keys])
    report = [boxes.box_report(boxes.merge_boxes(df, **options)).first() for options in ({"max_rounds": 0}, {"side": 8})]
    assert report[0] == report[1] and report[0]["voxels"] == df.where("program_idx >= 0").count()
    assert 0 < report[0]["boxes"] < report[0]["voxels"]


def test_boxes_small_cases(spark):
    block = boxes.merge_boxes(cells(spark, list(itertools.product(range(2), repeat=3)), [0] * 8))
    assert [(r["w"], r["d"], r["h"], r["voxel_count"]) for r in block.collect()] == [(2, 2, 2, 8)]
    assert boxes.box_report(block).first()["percent"] == 87.5
    gap = boxes.merge_boxes(cells(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)], [0, -1, 1])).collect()
    assert sorted(r["program_idx"] for r in gap) == [0, 1]
    assert boxes.merge_boxes(cells(spark, [(0, 0, 0)], [-1])).count() == 0
    with pytest.raises(ValueError):
        boxes.merge_boxes(cells(spark, [(0, 0, 0)], [-3]))


def brute_support(keys, ground, reach):
    filled, seen = set(keys), {(k, 0) for k in ground}
    stack = list(seen)
    while stack:
        (x, y, z), need = stack.pop()
        for k, n in [((x, y, z + 1), 0)] + [((x + a, y + b, z), need + 1) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]:
            if k in filled and n <= reach and (k, n) not in seen:
                seen.add((k, n))
                stack.append((k, n))
    best = {}
    for k, n in seen:
        best[k] = min(n, best.get(k, n))
    return best


@pytest.mark.parametrize("reach", [0, 2, 4])
def test_support_against_search(spark, reach):
    rng = random.Random(reach)
    keys = [k for k in itertools.product(range(6), range(6), range(5)) if rng.random() < 0.45]
    df = cells(spark, keys, [0] * len(keys))
    got = {keys[r["voxel_idx"]]: r["overhang"] for r in sp.support(df, sp.ground_contact(df), reach).collect()}
    want = brute_support(keys, [k for k in keys if k[2] == 0], reach)
    assert got == {k: want.get(k) for k in keys}


def test_support_cases(spark):
    hang = cells(spark, [(0, 0, 2), (1, 0, 2), (2, 0, 2), (2, 0, 1), (2, 0, 0)], [0, -1, -1, -1, -1])
    ground = spark.createDataFrame([("g", 4), ("g", 99)], "grid_id string, voxel_idx long")
    assert sp.support_report(sp.support(hang, ground, 4)).first()["grounded"] == 1
    assert sp.support_report(sp.support(hang, ground, 1)).first()["grounded"] == 0
    assert sp.support(hang, ground.limit(0), 4).where("overhang is not null").count() == 0


def test_membranes(spark):
    pair = cells(spark, [(0, 0, 0), (1, 0, 0)], [0, -1])
    faces = membranes.membrane_faces(pair, 1.0, 0.25)
    got = {(r["program_idx"], r["dir"]): {c["x"] for c in r["corners"]} for r in faces.collect()}
    assert got == {(0, 0): {1.25}, (-1, 1): {0.75}}
    closed = membranes.membrane_faces(pair, include_boundary=True)
    assert {(r["program_idx"], r["faces"], r["vertices"]) for r in membranes.membrane_summary(closed).collect()} == {(0, 6, 24), (-1, 6, 24)}
    before = {(r["program_idx"], r["dir"]): r["corners"] for r in closed.collect()}
    after = {(r["program_idx"], r["dir"]): r["corners"] for r in membranes.smoothed(closed, 5).collect()}
    assert after == {k: c[1:] + c[:1] for k, c in before.items()}


def test_loops_of_a_ring_and_of_touching_corners(spark):
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    bent = [c for c in ring if c != (0, 0)]  # (0, 1) and (1, 0) touch at a corner, where hole and outside meet
    df = spark.createDataFrame([("ring", *c) for c in ring] + [("bent", *c) for c in bent], "region string, ix int, iy int")
    rows = loops.region_loops(df, ["region"]).collect()
    by_loop = {}
    for r in rows:
        by_loop.setdefault((r["region"], r["loop_x"], r["loop_y"], r["loop_side"]), {})[r["place"]] = (r["x"], r["y"])
    assert sorted(len(v) for k, v in by_loop.items() if k[0] == "ring") == [4, 12]
    for (region, x, y, _), places in by_loop.items():
        path = [places[i] for i in range(len(places))]
        assert path[0] == (x, y) == min(path)
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:] + path[:1], strict=True))
    area = {r: 0 for r in ("ring", "bent")}
    for (region, *_), places in by_loop.items():
        path = [places[i] for i in range(len(places))]
        area[region] += sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(path, path[1:] + path[:1], strict=True)) / 2
    assert area == {"ring": 8, "bent": 7}


@pytest.mark.parametrize("tile", [4, 32])
def test_loops_cross_tiles(spark, monkeypatch, tile):
    """Edges are written once; rounds take only the chains that leave their tile."""
    sizes, cut = [], loops.written
    monkeypatch.setattr(loops, "TILE", tile)
    monkeypatch.setattr(loops, "written", lambda df, **sums: sizes.append(df.count()) or cut(df, **sums))
    rng = random.Random(tile)
    plate = {(x, y) for x in range(-5, 40) for y in range(28, 40) if rng.random() < 0.7}
    got = {(r["x"], r["y"], r["loop_x"], r["loop_y"], r["loop_side"], r["place"]) for r in loops.region_loops(spark.createDataFrame([("r", *c) for c in sorted(plate)], "region string, ix int, iy int"), ["region"]).collect()}
    edges = {(x + s[0], y + s[1], k) for x, y in plate for k, (o, s) in enumerate(loops.SIDES) if (x + o[0], y + o[1]) not in plate}
    want, left = set(), set(edges)
    while left:
        start = at = min(left)
        place = 0
        while at in left:
            left.remove(at)
            want.add((at[0], at[1], *start, place))
            x, y, k = at[0] + loops.STEPS[at[2]][0], at[1] + loops.STEPS[at[2]][1], at[2]
            at, place = next((x, y, (k + 1 - turn) % 4) for turn in range(4) if (x, y, (k + 1 - turn) % 4) in edges), place + 1
        assert at == start
    assert got == want
    assert sizes[0] == len(edges) and max(sizes[1:]) < len(edges) / (1 if tile == 4 else 4)
