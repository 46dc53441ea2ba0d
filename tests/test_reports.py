"""Names, colours, region numbers and reports, placed faces, and welded skins."""

import pytest

from latticework.functions import labels
from latticework.operators import interfaces, membranes, regions
from latticework.sources import voxels as vx

CELLS = "grid_id string, voxel_idx long, ix int, iy int, iz int, program_idx int"


def test_names_and_colours(spark):
    programs = vx.programs(spark, [("Office", 5, (1, 2, 3))])
    rows = spark.createDataFrame([(p,) for p in (-2, -1, 0, 7)], "program_idx int")
    got = {r.program_idx: tuple(r)[1:] for r in labels.coloured(labels.named(rows, programs), programs).collect()}
    assert got == {-2: ("Core", 180, 80, 80, 80), -1: ("Program -1", 255, 255, 0, 255), 0: ("Office", 220, 1, 2, 3), 7: ("Program 7", 255, 255, 0, 255)}
    names = {r.program_idx: r.program_name for r in labels.named(rows, programs, open_boundary=True).collect()}
    assert names[-1] == "Open Boundary"
    shades = {r.program_idx: (r.a, r.r) for r in labels.coloured(rows, programs, labels.REGION_COLOURS).collect()}
    assert shades == {-2: (255, 80), -1: (255, 128), 0: (255, 1), 7: (255, 128)}


def test_region_numbers_and_report(spark):
    keys = [(0, 0, 0, -1), (1, 0, 0, -2), (2, 0, 0, 0), (3, 0, 0, 1), (5, 0, 0, 0), (5, 0, 1, 0)]
    cells = spark.createDataFrame([("g", i, x, y, z, p, 1) for i, (x, y, z, p) in enumerate(keys)], CELLS + ", floor_idx int")
    found = regions.numbered_regions(regions.floor_regions(cells, structure_idx=1))
    assert sorted((r.program_idx, r.first_x, r.number) for r in found.collect()) == [(-2, 1, 0), (0, 2, 0), (0, 5, 1)]
    assert sorted(tuple(r)[1:] for r in regions.region_report(found).collect()) == [(-2, 1, 1, 1), (0, 2, 2, 3)]
    assert [tuple(r)[1:] for r in regions.skipped(cells, structure_idx=1).collect()] == [(1, 0, 1)]
    assert [tuple(r)[1:] for r in regions.skipped(cells, include_core=False, structure_idx=1, include_structure=True).collect()] == [(1, 1, 0)]


def test_placed_faces(spark):
    cells = spark.createDataFrame([("g", 0, 0, 0, 0, 1), ("g", 1, 1, 0, 0, 0)], CELLS)
    found = interfaces.faces(interfaces.contacts(cells), interfaces.caps(cells))
    quarter = [0.0, -1.0, 0.0, 100.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    got = interfaces.placed(found, cells, (0.0, 0.0, 0.0), 2.0, quarter).collect()
    assert sorted(r.kind for r in got) == ["exterior"] * 4 + ["face"]
    (face,) = (r for r in got if r.kind == "face")
    # program 0 at voxel 1 is A and looks along -x; a quarter turn makes that -y
    assert (face.voxel_a, face.direction, face.area) == (1, -1, 4.0)
    assert (face.normal_x, face.normal_y, face.normal_z) == (0.0, -1.0, 0.0)
    assert (face.x, face.y, face.z) == (99.0, 2.0, 1.0)
    assert {(c.x, c.y, c.z) for c in face.corners} == {(100.0, 2.0, 0.0), (98.0, 2.0, 0.0), (98.0, 2.0, 2.0), (100.0, 2.0, 2.0)}


@pytest.mark.parametrize("passes", [0, 1, 3])
def test_welded_skin_matches_a_walk(spark, passes):
    keys = [(x, y, z, 0 if z < 2 else 1) for x in range(2) for y in range(2) for z in range(3) if (x, y, z) != (1, 1, 1)]
    cells = spark.createDataFrame([("g", i, *k) for i, k in enumerate(keys)], CELLS)
    faces = membranes.membrane_faces(cells, 1.0, 0.05, include_boundary=True).where("voxel_idx <> 0")
    at, sides, spots = {}, {}, {}
    for r in faces.collect():
        ring = [(r.program_idx, *(keys[r.voxel_idx][k] + o[k] for k in range(3))) for o in membranes.CORNERS[r.dir]]
        spots[r.voxel_idx, r.dir] = ring
        for j, c in enumerate(ring):
            at.setdefault(c, []).append(tuple(r.corners[j]))
            for a, b in ((c, ring[(j + 1) % 4]), (ring[(j + 1) % 4], c)):
                sides[a, b] = sides.get((a, b), 0) + 1
    now = {c: tuple(sum(p[k] for p in ps) / len(ps) for k in range(3)) for c, ps in at.items()}
    pinned = {a for (a, _), n in sides.items() if n == 1}
    assert pinned and pinned != set(now)
    for _ in range(passes):
        near = {c: [now[b] for a, b in sides if a == c] for c in now}
        now = {c: now[c] if c in pinned else tuple(sum(p[k] for p in near[c]) / len(near[c]) for k in range(3)) for c in now}
    got = membranes.welded(faces, cells, passes).collect()
    assert {(r.voxel_idx, r.dir) for r in got} == set(spots) and len(got) == len(spots)
    for r in got:
        for corner, spot in zip(r.corners, spots[r.voxel_idx, r.dir], strict=True):
            assert tuple(corner) == pytest.approx(now[spot], abs=1e-9)


def test_only_changed_grids_are_rewritten(spark, tmp_path):
    import os

    from latticework.sources import stack

    names = "grid_id string, voxel_idx long, label string, value double"
    first = spark.createDataFrame([("a", 1, "q", 0.5), ("a", 2, "q", 1.0), ("b", 1, "q", 0.0)], names)
    stack.write_stack(str(tmp_path), {"channels": first})
    before = {f for f in os.listdir(tmp_path / "channels" / "grid_id=b")}
    fresh = spark.createDataFrame([("a", 1, "q", 0.25), ("a", 2, "q", 1.0), ("b", 1, "q", 0.0), ("c", 9, "q", None)], names)
    assert stack.update_stack(spark, str(tmp_path), "channels", fresh) == ["a", "c"]
    assert {f for f in os.listdir(tmp_path / "channels" / "grid_id=b")} == before
    got = stack.read_stack(spark, str(tmp_path), ["channels"])["channels"].select(fresh.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, fresh.collect()))
    assert stack.update_stack(spark, str(tmp_path), "channels", fresh) == []


def test_merged_weights(spark):
    from latticework.sources import voxels as vx

    stored = spark.createDataFrame([("A", "q", 3.0), ("A", "gone", 0.5), ("B", "q", None)], "program_name string, label string, weight double")
    live = spark.createDataFrame([("A", "q"), ("B", "q"), ("B", "p"), ("B", "p")], "program_name string, label string")
    merged = vx.merged_weights(stored, live)
    assert sorted(map(tuple, merged.collect())) == [("A", "gone", 0.5, False, True), ("A", "q", 1.0, True, True), ("B", "p", 1.0, True, False), ("B", "q", 1.0, True, True)]
    assert tuple(vx.weight_report(merged).first()) == (3, 1, 1)
