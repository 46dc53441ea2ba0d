"""Small scenarios of the voxel operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from latticework import session
from latticework.functions import channels as ch
from latticework.operators import allocation as al
from latticework.operators import grid, interfaces, regions, tiles
from latticework.operators.components import components
from latticework.sources import voxels as vx


def cells(spark, keys, programs=None):
    rows = [("g", i, *k, *([programs[i]] if programs else [])) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "grid_id string, voxel_idx long, ix int, iy int, iz int" + (", program_idx int" if programs else ""))


def test_keys_are_distinct_and_ordered(spark):
    df = spark.createDataFrame([("g", 1, 0, 1), ("g", 0, 1, 0), ("g", 1, 0, 1), ("g", 0, 0, 0), (None, 0, 0, 0)], "grid_id string, ix int, iy int, iz int")
    rows = vx.from_keys(df).orderBy("voxel_idx").select("ix", "iy", "iz").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (0, 1, 0), (1, 0, 1)]


def test_channel_errors(spark):
    v = cells(spark, [(0, 0, 0), (1, 0, 0)])
    good = vx.channel(v, " depth ", F.col("ix"))
    assert vx.check_channels(v, good).first()["label"] == "depth"
    with pytest.raises(ValueError, match="duplicate"):
        vx.check_channels(v, good.unionByName(good))
    with pytest.raises(ValueError, match="values for"):
        vx.check_channels(v, good.limit(1))
    with pytest.raises(ValueError):
        vx.channel(v, "  ", F.lit(0))


def test_programs_and_weights(spark):
    p = vx.programs(spark, [(" Office ", 3), ("Office", 5), ("Lobby", -1, (1, 2, 3))])
    assert [(r["name"], r["voxel_count"], r["r"]) for r in p.collect()] == [("Office", 3, 255), ("Lobby", -1, 1)]
    for bad in [("", 1), ("x", 0)]:
        with pytest.raises(ValueError):
            vx.programs(spark, [bad])
    stored = spark.createDataFrame([("Office", "d", 3.0), ("Gone", "d", 0.5)], "program_name string, label string, weight double")
    w = vx.weights(p, ["d", "e"], stored)
    assert {(r[0], r[1]): r[2] for r in w.collect()} == {("Office", "d"): 1.0, ("Office", "e"): 1.0, ("Lobby", "d"): 1.0, ("Lobby", "e"): 1.0}
    assert [r[0] for r in vx.stored_extras(stored, w).collect()] == ["Gone"]
    assert [r[0] for r in vx.purged(stored, w).collect()] == ["Office"]
    jittered = {r[0]: r[2] for r in vx.generated_weights(w, "random", 3).collect()}
    assert all(abs(x / 0.05 - round(x / 0.05)) < 1e-9 and -1 <= x <= 1 for x in jittered.values())


def test_normalise_flat_and_bad_values(spark):
    df = spark.createDataFrame([("g", i, "a", v) for i, v in enumerate([None, float("nan"), 4.0, float("inf")])] + [("g", i, "b", 7.0) for i in range(4)], "grid_id string, voxel_idx long, label string, value double")
    got = {(r["label"], r["voxel_idx"]): r["value"] for r in ch.normalized(ch.sanitized(df)).collect()}
    assert [got["a", i] for i in range(4)] == [0, 0, 1, 0] and all(got["b", i] == 0 for i in range(4))
    assert {r["value"] for r in ch.inverted(df.where("label = 'b'")).collect()} == {7.0}


def brute_greedy(scores, caps, per_program=False):
    taken, used = {}, dict.fromkeys(caps, 0)
    key = (lambda r: (r[1], -r[2], r[0])) if per_program else (lambda r: (-r[2], r[0], r[1]))
    for v, p, _ in sorted(scores, key=key):
        if v not in taken and (caps[p] < 0 or used[p] < caps[p]):
            taken[v] = p
            used[p] += 1
    return taken


@pytest.mark.parametrize("seed", [1, 2])
def test_limited_assignment_is_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(v, p, rng.randint(0, 6) / 6) for v in range(40) for p in range(3)]
    scored = spark.createDataFrame([("g", *r) for r in rows], "grid_id string, voxel_idx long, program_idx int, score double")
    programs = vx.programs(spark, [("a", 7), ("b", 11), ("c", 9)])
    caps = {0: 7, 1: 11, 2: 9}
    for f, per in ((al.assign_highest, False), (al.assign_per_program, True)):
        got = {r["voxel_idx"]: r["program_idx"] for r in f(scored, programs, show_all=False).collect()}
        want = brute_greedy(rows, caps, per)
        assert got == {v: want.get(v, -1) for v in range(40)}
    clamped = al.argmax_clamp(scored, programs, show_all=False).groupBy("program_idx").count().collect()
    assert all(r["count"] <= caps[r["program_idx"]] for r in clamped if r["program_idx"] >= 0)
    core = spark.createDataFrame([("g", 3), ("g", 3)], "grid_id string, voxel_idx long")
    assert {r["voxel_idx"] for r in al.assign_highest(scored, programs, core).where("program_idx = -2").collect()} == {3}


def test_rank_without_one_task(spark):
    rng = random.Random(5)
    rows = [("g", i, 0, rng.choice([0.1, 0.5, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "grid_id string, voxel_idx long, program_idx int, winning_score double")
    got = {r["voxel_idx"]: r["rank"] for r in al.ranked(df).collect()}
    want = {r[1]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[3], r[1])), 1)}
    assert got == want


def test_block_surface_and_depth(spark):
    v = cells(spark, list(itertools.product(range(5), repeat=3)))
    depth = {(r["value"]): r["count"] for r in grid.surface_depth(v).groupBy("value").count().collect()}
    assert depth == {0.0: 98, 1.0: 26, 2.0: 1}
    assert grid.neighbors(v).count() == 2 * 3 * 4 * 25
    corner = grid.orientation(v).where("voxel_idx = 124").first()
    assert corner["direction"] == 0 and corner["open_faces"] == 3 and abs(corner["normal_x"] - 3**-0.5) < 1e-9


@pytest.mark.parametrize(
    ("keys", "programs", "core", "faces", "counts"),
    [
        ([(0, 0, 0), (1, 0, 0)], [0, 1], True, [(0, 1, 0, 1)], {}),
        ([(0, 0, 0), (1, 0, 0)], [0, -1], True, [], {"unallocated": 1}),
        ([(0, 0, 0), (1, 0, 0)], [0, -2], True, [(0, -2, 0, 1)], {}),
        ([(0, 0, 0), (1, 0, 0)], [0, -2], False, [], {"core_ignored": 1}),
        ([(0, 0, 0), (1, 0, 0)], [1, 0], True, [(0, 1, 0, -1)], {}),
        ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [0, 1, 0, 1], True, [(0, 1, 0, 1)] * 2, {"same_program": 2}),
    ],
)
def test_interfaces(spark, keys, programs, core, faces, counts):
    touching = interfaces.contacts(cells(spark, keys, programs), core)
    got = [(r["program_a"], r["program_b"], r["axis"], r["direction"]) for r in touching.where("tag = 'face'").collect()]
    assert got == faces
    tags = {r["tag"]: r["contacts"] for r in interfaces.contact_counts(touching).collect()}
    assert all(tags.get(k) == n for k, n in counts.items())


@pytest.mark.parametrize(
    ("keys", "programs", "structure", "expected"),
    [
        ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [0] * 4, -1, [(0, 4, 4)]),
        ([(0, 0, 0), (2, 0, 0), (3, 0, 0)], [0, 0, 1], -1, [(0, 1, 1), (0, 1, 1), (1, 1, 1)]),
        ([(0, 0, 0), (0, 0, 1), (1, 0, 1)], [0, 0, 0], -1, [(0, 2, 3)]),
        ([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)], [-1, -2, 0, 1], 1, [(-2, 1, 1), (0, 1, 1)]),
    ],
)
def test_floor_regions(spark, keys, programs, structure, expected):
    df = cells(spark, keys, programs).withColumn("floor_idx", F.lit(1))
    got = sorted((r["program_idx"], r["cells"], r["source_voxels"]) for r in regions.floor_regions(df, structure_idx=structure).collect())
    assert got == expected


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(7, 7)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(n) == c for n, c in got.items())
    assert {n for a, b in edges if a != b for n in (a, b)} == set(got)


def test_tiles(spark):
    t = spark.createDataFrame([(0, "A"), (1, "B")], "tile_id int, tile_type string")
    both = [(i, d, x) for i in (0, 1) for d in tiles.NAMES for x in "AB"]
    assert tiles.compat(t, spark.createDataFrame(both, "tile_id int, dir string, allowed_type string")).count() == 24
    one_way = [r for r in both if not (r[1] in ("px", "nx"))] + [(0, "px", "A"), (0, "nx", "A"), (1, "nx", "B"), (1, "px", "B")]
    allowed = tiles.compat(t, spark.createDataFrame(one_way, "tile_id int, dir string, allowed_type string"))
    start = [("g", 0, 0, 0, 0)] + [("g", i, 0, 0, k) for i in (1, 2) for k in (0, 1)]
    left = tiles.propagate(spark.createDataFrame(start, "grid_id string, ix int, iy int, iz int, tile_id int"), allowed)
    assert sorted((r["ix"], r["tile_id"]) for r in left.collect()) == [(0, 0), (1, 0), (2, 0)]


def test_scores_group_by_voxel_alone(spark):
    """Channels become columns in one aggregate, not in one by label and one by voxel, and a missing one is null."""
    from latticework.operators import allocation

    rows = spark.createDataFrame([("g", 0, "a", 1.0), ("g", 0, "b", 2.0), ("g", 1, "b", 3.0)], "grid_id string, voxel_idx long, label string, value double")
    found = allocation.wide(rows, ["a", "b"])
    assert "pivotfirst" not in found._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(tuple(r) for r in found.collect()) == [("g", 0, 1.0, 2.0), ("g", 1, None, 3.0)]


def test_columns_score_as_channels_do(spark):
    odd = [None, float("nan"), float("inf"), 1.0, 4.0, 4.0, 2.5]
    v = spark.createDataFrame([(g, i, x, 7.0 if g == "h" else float(i)) for g in "gh" for i, x in enumerate(odd)], "grid_id string, voxel_idx long, a double, b double")
    channels = v.select(*vx.KEY, F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("value")) for x in "ab"))).alias("c")).select(*vx.KEY, "c.*")
    programs = vx.programs(spark, [("p", 1), ("q", 1), ("r", -1)])
    weights = vx.weights(programs, ["a", "b"], spark.createDataFrame([("p", "a", -0.5), ("r", "b", 0.25)], "program_name string, label string, weight double"))
    columns = ch.normalized_columns(v, ["a", "b"])
    scored = al.scores(ch.normalized(ch.sanitized(channels)), programs, weights)
    assert sorted(map(tuple, al.scores_of(columns, ["a", "b"], programs, weights).collect())) == sorted(map(tuple, scored.collect()))
    got = al.best_of(columns, ["a", "b"], programs, weights).select(*vx.KEY, "program_idx", "winning_score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, al.argmax(scored).collect()))


def test_neighbour_joins_are_parted_by_rows(spark, monkeypatch):
    """A task's share does not grow with the table: partitions do."""
    monkeypatch.setattr(session, "PART", 10)
    v = cells(spark, list(itertools.product(range(5), repeat=3)), [0] * 125)
    rows = interfaces.contacts(v)
    assert rows.rdd.getNumPartitions() == 38
    assert interfaces.contact_counts(rows).where("tag = 'same_program'").first()["contacts"] == 300


def test_capped_rounds_write_cuts_not_offers(spark, monkeypatch):
    """Rounds over many voxels that are turned down write no voxel anew."""
    rng = random.Random(3)
    rows = [(g, v, p, rng.randint(0, 40) / (40 if g == "g" else 7)) for g in "gh" for v in range(300) for p in range(3)]
    scored = spark.createDataFrame(rows, "grid_id string, voxel_idx long, program_idx int, score double")
    programs = vx.programs(spark, [("a", 31), ("b", 60), ("c", -1)])
    sizes, cut = [], al.written
    monkeypatch.setattr(al, "written", lambda df, **sums: sizes.append(df.count()) or cut(df, **sums))
    monkeypatch.setattr(al, "BINS", 4)
    got = {(r["grid_id"], r["voxel_idx"]): r["program_idx"] for r in al.assign_highest(scored, programs, show_all=False).collect()}
    for g in "gh":
        want = brute_greedy([r[1:] for r in rows if r[0] == g], {0: 31, 1: 60, 2: -1})
        assert {v: got[g, v] for v in range(300)} == want
    assert sizes[0] == 600 and len(sizes) > 3 and max(sizes[1:]) < 400


def test_clusters_and_regions_cross_blocks(spark, monkeypatch):
    """Blocks are labelled by themselves; only pairs across their sides enter the rounds."""
    seen, found = [], regions.components
    monkeypatch.setattr(regions, "components", lambda edges: seen.append(edges.count()) or found(edges))
    rng = random.Random(11)
    keys = sorted(k for k in itertools.product(range(-3, 70), range(30, 36), range(30, 34)) if rng.random() < 0.6)
    programs = [rng.choice([0, 1, -1]) for _ in keys]
    df = cells(spark, keys, programs)

    def least(nodes, steps):
        name, out = dict.fromkeys(nodes), {}
        for start in sorted(name):
            stack = [start]
            while stack:
                k = stack.pop()
                if k in out or k not in name:
                    continue
                out[k] = start
                stack += [tuple(x + s * (i == j) for j, x in enumerate(k)) for i in range(steps) for s in (1, -1)]
        return out

    want = {}
    for p in (0, 1):
        want |= {keys.index(k): keys.index(v) for k, v in least([k for k, q in zip(keys, programs, strict=True) if q == p], 3).items()}
    assert {r["voxel_idx"]: r["cluster"] for r in regions.clusters(df).collect()} == want
    assert seen[0] < len(keys) / 4
    plates = least({k[:2] for k, q in zip(keys, programs, strict=True) if q == 0}, 2)
    got = {(r["first_x"], r["first_y"]): r["cells"] for r in regions.floor_regions(df.withColumn("floor_idx", F.lit(1))).where("program_idx = 0").collect()}
    assert got == {v: list(plates.values()).count(v) for v in set(plates.values())}
