"""Registered queries that derive shapes and relations from the voxels of `lineitem`, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions import channels as ch
from latticework.functions import labels
from latticework.operators import allocation as al
from latticework.operators import boxes, cores, generated, grid, interfaces, loads, loops, membranes, regions, support, tiles, views
from latticework.plans import queries as base
from latticework.sources import meshes
from latticework.sources import voxels as vx


def _floors(cells, height=10.0):
    return cells.withColumn("floor_idx", ch.floor_of((F.col("iz") + 0.5) * 3.0, height))


def v_boxes(spark, sf_dir):
    return boxes.merge_boxes(base._assigned_cells(spark, sf_dir))


def v_box_report(spark, sf_dir):
    return boxes.box_report(boxes.merge_boxes(base._assigned_cells(spark, sf_dir)))


def v_support(spark, sf_dir):
    cells = base._assigned_cells(spark, sf_dir)
    return support.support(cells, support.ground_contact(cells)).drop("grid_id")


def v_membranes(spark, sf_dir):
    first = F.col("corners")[0]
    return membranes.membrane_faces(base._assigned_cells(spark, sf_dir), 1.0, 0.05).select("program_idx", "voxel_idx", "dir", *(F.round(first[c], 6).alias(c) for c in "xyz"))


def v_membrane_summary(spark, sf_dir):
    return membranes.membrane_summary(membranes.membrane_faces(base._assigned_cells(spark, sf_dir), include_boundary=True))


def _plan(spark, sf_dir):
    return _floors(base._assigned_cells(spark, sf_dir)).where("program_idx >= 0")


def v_boundary_edges(spark, sf_dir):
    return loops.boundary_edges(_plan(spark, sf_dir), ["grid_id", "program_idx", "floor_idx"])


def v_region_loops(spark, sf_dir):
    return loops.region_loops(_plan(spark, sf_dir), ["grid_id", "program_idx", "floor_idx"])


def v_surface_distance(spark, sf_dir):
    return grid.surface_distance(base.fixture(spark, sf_dir)).select("voxel_idx", "value")


def v_centers(spark, sf_dir):
    return grid.centers(base.fixture(spark, sf_dir), (1.0, 2.0, 3.0), 0.5).drop("grid_id")


def v_shader(spark, sf_dir):
    return al.shader(base._assigned(spark, sf_dir), vx.programs(spark, [(n, c, (10 * i, 20 * i, 255)) for i, (n, c) in enumerate(base.PROGRAMS)])).drop("grid_id")


def v_unassigned(spark, sf_dir):
    return al.unassigned(base._assigned_cells(spark, sf_dir)).select("voxel_idx")


def v_round_robin(spark, sf_dir):
    scored, programs = base._scored(spark, base.fixture(spark, sf_dir))
    return al.assign_round_robin(scored, programs, show_all=False).select("voxel_idx", "program_idx")


def v_real_estate(spark, sf_dir):
    return ch.real_estate_value(_floors(base.fixture(spark, sf_dir), 3.0).select(*vx.KEY, "floor_idx")).select("voxel_idx", F.round("value", 9).alias("value"))


def v_floor_distribution(spark, sf_dir):
    return ch.floor_distribution(_floors(base.fixture(spark, sf_dir)), 10.0)


def v_voxel_vectors(spark, sf_dir):
    vectors = ch.voxel_vectors(base._channels(base.fixture(spark, sf_dir)))
    return vectors.select("voxel_idx", F.col("values")["price"].alias("price"), F.col("values")["qty"].alias("qty"))


def v_tiles(spark, sf_dir):
    """Five grades on the cells, each meeting itself and the next ones; a cell of several lines starts with the grade 0 or 1 alone.

    Grades 0 and 1 meet each other, so nothing contradicts and the sets left are
    those within reach of the cells that are settled.
    """
    rules = spark.createDataFrame([(i, d, f"grade{x}") for i in range(5) for d in tiles.NAMES for x in range(max(i - 1, 0), min(i + 2, 5))], "tile_id int, dir string, allowed_type string")
    kinds = spark.createDataFrame([(i, f"grade{i}") for i in range(5)], "tile_id int, tile_type string")
    every = base.fixture(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, range(5)))).alias("tile_id"))
    start = every.where((F.col("n") == 1) | (F.col("tile_id") == F.col("qty").cast("int") % 2))
    return tiles.propagate(start, tiles.compat(kinds, rules))


def _upright(spark):
    """Grades that meet themselves and the next ones, upwards only themselves and greater ones; 0 asks for 4 at its +x side, but 4 does not ask back."""
    rows = [(i, d, x) for i in range(5) for d in tiles.NAMES for x in range(max(i - 1, 0), min(i + 2, 5)) if not (d == "pz" and x < i) and not (d == "nz" and x > i)]
    rules = spark.createDataFrame([(i, d, f"grade{x}") for i, d, x in rows + [(0, "px", 4)]], "tile_id int, dir string, allowed_type string")
    return tiles.compat(spark.createDataFrame([(i, f"grade{i}") for i in range(5)], "tile_id int, tile_type string"), rules)


def _upright_start(spark, sf_dir):
    """All grades on scattered cells; every third cell is settled, so that many groups of cells contradict themselves."""
    every = base.fixture(spark, sf_dir).where("qty <= 12").select("*", F.explode(F.array(*map(F.lit, range(5)))).alias("tile_id"))
    return every.where((F.col("voxel_idx") % 3 > 0) | (F.col("tile_id") == F.col("qty").cast("int") % 5))


def v_tiles_upright(spark, sf_dir):
    return tiles.propagate(_upright_start(spark, sf_dir), _upright(spark))


def v_tiles_used_up(spark, sf_dir):
    """What is left once grade 2 is used up on the cells that settle it."""
    limits = spark.createDataFrame([(i, f"grade{i}", 100 if i == 2 else -1) for i in range(5)], "tile_id int, tile_type string, max_count int")
    rules = _upright(spark)
    return tiles.prune_exhausted(tiles.propagate(_upright_start(spark, sf_dir), rules), limits, rules)


def _blades(spark, sf_dir):
    """Obstacles in every grid: a triangle for each supplier, placed by its key and leaning by its nation."""
    grids = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg((F.floor(F.max("l_orderkey") / base.ORDERS) + 1).alias("grids"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").crossJoin(F.broadcast(grids)).select((F.col("s_suppkey") * 7 % 61 - 5.25).cast("double").alias("px"), (F.col("s_suppkey") * 11 % 59 - 4.75).cast("double").alias("py"), F.col("s_nationkey").cast("double").alias("n"), F.concat(F.lit("g"), (F.col("s_suppkey") % F.col("grids")).cast("string")).alias("grid_id"))
    return s.select("grid_id", F.col("px").alias("ax"), F.col("py").alias("ay"), F.lit(-1.0).alias("az"), (F.col("px") + 2.0).alias("bx"), (F.col("py") + 1.0).alias("by"), F.lit(-1.0).alias("bz"), (F.col("px") + F.col("n") / 8).alias("cx"), (F.col("py") + 1.5).alias("cy"), (F.col("n") + 3.3).alias("cz"))


def v_horizon_view(spark, sf_dir):
    return views.horizon_view(grid.centers(base.fixture(spark, sf_dir)), _blades(spark, sf_dir)).select("voxel_idx", F.round("value", 3).alias("value"))


def v_sky_view(spark, sf_dir):
    return views.sky_view(grid.centers(base.fixture(spark, sf_dir)), _blades(spark, sf_dir)).select("voxel_idx", F.round("value", 3).alias("value"))


def v_core_distance(spark, sf_dir):
    cells = base._assigned_cells(spark, sf_dir)
    return cores.core_distance(cells, cells.where(F.col("program_idx") == al.CORE)).select("voxel_idx", F.round("distance", 9).alias("distance"), "is_core")


def v_core_proximity(spark, sf_dir):
    cells = base._assigned_cells(spark, sf_dir)
    return cores.core_proximity(cores.core_distance(cells, cells.where(F.col("program_idx") == al.CORE))).select("voxel_idx", F.round("value", 9).alias("value"))


def v_core_from_curves(spark, sf_dir):
    """Voxels within 10 of an edge of a supplier's triangle."""
    edges = _blades(spark, sf_dir).select("grid_id", F.lit(0).alias("curve_id"), *(f"a{c}" for c in "xyz"), *(F.col(f"c{c}").alias(f"b{c}") for c in "xyz"))
    return cores.core_from_curves(grid.centers(base.fixture(spark, sf_dir)), edges).select("voxel_idx", "curve_id", F.round("distance", 9).alias("distance"))


def v_core_coverage(spark, sf_dir):
    cells = base._assigned_cells(spark, sf_dir)
    return cores.core_coverage(cores.core_distance(cells, cells.where(F.col("program_idx") == al.CORE)), 20.0).select("grid_id", F.round("percent", 9).alias("percent"), "beyond", F.round("greatest", 9).alias("greatest"))


def v_support_report(spark, sf_dir):
    cells = base._assigned_cells(spark, sf_dir)
    return support.support_report(support.support(cells, support.ground_contact(cells)))


def v_gradient(spark, sf_dir):
    return ch.normalized(base._channels(base.fixture(spark, sf_dir))).select("voxel_idx", "label", ch.ramp(F.col("value")).alias("c")).select("voxel_idx", "label", "c.*")


def v_floor_neighbors(spark, sf_dir):
    return grid.neighbors(base.fixture(spark, sf_dir), 4).select("voxel_idx", "dir", "other_voxel_idx")


def v_centerlines(spark, sf_dir):
    """Points of the middle column's centreline, in order."""
    cells = base._assigned_cells(spark, sf_dir).where(F.col("program_idx") == al.CORE)
    core = grid.centers(cells).join(cells.select(*vx.KEY, "iz"), vx.KEY).withColumn("core_id", F.lit(0))
    lines = cores.centerlines(cores.footprints(core))
    return lines.select("grid_id", F.posexplode("points").alias("place", "p")).select("grid_id", "place", *(F.round(f"p.{c}", 9).alias(c) for c in "xyz"))


def v_structured(spark, sf_dir):
    """Programs and sizes once the weak cells of even index are Structure."""
    cells = base._assigned_cells(spark, sf_dir)
    programs = vx.programs(spark, base.PROGRAMS)
    marked, more = al.with_structure(cells, programs, cells.where((F.col("program_idx") == al.UNASSIGNED) & (F.col("voxel_idx") % 2 == 0)))
    return marked.join(F.broadcast(more.select("program_idx", "name")), "program_idx", "left").groupBy("grid_id", "program_idx", "name").agg(F.count(F.lit(1)).alias("voxels"))


def v_generate_cores(spark, sf_dir):
    """All cores of each grid."""
    return generated.generate_cores(base.fixture(spark, sf_dir))[0].select("grid_id", "core_id", "iz", "voxel_idx")


def v_footprints(spark, sf_dir):
    cells = base._assigned_cells(spark, sf_dir).where(F.col("program_idx") == al.CORE)
    core = grid.centers(cells).join(cells.select(*vx.KEY, "iz"), vx.KEY).withColumn("core_id", F.lit(0))
    return cores.footprints(core).select("grid_id", "core_id", "iz", *(F.round(c, 9).alias(c) for c in ("x", "y", "z", "x0", "y0", "x1", "y1")))


def _ways(spark, sf_dir):
    cells = base._assigned_cells(spark, sf_dir)
    return loads.find_ways(cells, support.ground_contact(cells)), cells


def v_load_paths(spark, sf_dir):
    """Steps and capacity of each core and program voxel's way to the ground."""
    return _ways(spark, sf_dir)[0].routes()


def v_structure(spark, sf_dir):
    """Unassigned voxels that ways lean on."""
    return loads.importance(*_ways(spark, sf_dir))


def v_load_clusters(spark, sf_dir):
    ways, cells = _ways(spark, sf_dir)
    return loads.cluster_strength(regions.clusters(cells), ways.routes())


def v_network_edges(spark, sf_dir):
    """Steps of all ways, once each."""
    return _ways(spark, sf_dir)[0].edges().drop("grid_id")


def v_region_report(spark, sf_dir):
    """Regions, cells and voxels of each program with its name and colour, and what each grid left out."""
    cells = _floors(base._assigned_cells(spark, sf_dir))
    report = labels.named(regions.region_report(regions.floor_regions(cells, structure_idx=2)), vx.programs(spark, base.PROGRAMS))
    return labels.coloured(report, vx.programs(spark, base.PROGRAMS), labels.REGION_COLOURS).join(regions.skipped(cells, structure_idx=2), "grid_id")


def v_region_numbers(spark, sf_dir):
    return regions.numbered_regions(regions.floor_regions(_floors(base._assigned_cells(spark, sf_dir))))


def v_interface_faces(spark, sf_dir):
    """Faces and caps with their place and the names of their programs."""
    cells = base._assigned_cells(spark, sf_dir)
    found = interfaces.placed(interfaces.faces(interfaces.contacts(cells), interfaces.caps(cells)), cells, (10.0, 20.0, 30.0), 2.0)
    programs = vx.programs(spark, base.PROGRAMS)
    both = labels.named(labels.named(found, programs, "program_a", "name_a"), programs, "program_b", "name_b", open_boundary=True)
    return both.drop("grid_id", "corners")


def v_voxelize(spark, sf_dir):
    """Voxels of one box for each order, as high as its price and as wide as its key says."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    size = {"x": (F.col("o_orderkey") % 3 + 1).cast("double"), "y": (F.col("o_custkey") % 4 + 1).cast("double"), "z": (F.col("o_totalprice") / 100_000 + 0.5).cast("double")}
    sides = [(k, s) for k in range(3) for s in (0, 1)]
    quads = []
    for axis, side in sides:
        quad = []
        for p, q in ((0, 0), (1, 0), (1, 1), (0, 1)):
            corner = [0, 0, 0]
            corner[axis], corner[(axis + 1) % 3], corner[(axis + 2) % 3] = side, p, q
            quad.append(corner)
        quads += [(quad[0], quad[1], quad[2]), (quad[0], quad[2], quad[3])]
    # of a box of side 1, which is one literal
    corners = [(p, k, c) for p in range(3) for k, c in enumerate("xyz")]
    faces = F.array(*(F.struct(*(F.lit(float(t[p][k])).alias(f"{'abc'[p]}{c}") for p, k, c in corners)) for t in quads))
    sized = o.select(F.col("o_orderkey").cast("string").alias("grid_id"), *(s.alias(c) for c, s in size.items()))
    stretched = [(F.col(f"t.{'abc'[p]}{c}") * F.col(c)).alias(f"{'abc'[p]}{c}") for p, _, c in corners]
    found = meshes.voxelize(sized, 4, lambda rows: rows.select("*", F.explode(faces).alias("t")).select("grid_id", *stretched), len(quads))
    return found.groupBy("grid_id").agg(F.count(F.lit(1)).alias("voxels"))


def v_limits(spark, sf_dir):
    """Voxels of each program beside its limit."""
    scored, programs = base._scored(spark, base.fixture(spark, sf_dir))
    return al.limits_report(al.argmax_clamp(scored, programs, show_all=False), programs)


def v_stats_report(spark, sf_dir):
    return ch.stats_report(base._channels(base.fixture(spark, sf_dir)))


def v_floor_report(spark, sf_dir):
    return ch.floor_report(_floors(base.fixture(spark, sf_dir), 3.0), 3.0, "real_estate").withColumn("value", F.round("value", 9))


def v_cap_counts(spark, sf_dir):
    return interfaces.cap_counts(interfaces.caps(base._assigned_cells(spark, sf_dir), include_core=False))


def v_core_report(spark, sf_dir):
    """Core ids of the middle column, and of cells of several lines beyond the grid."""
    cells = base.fixture(spark, sf_dir)
    middle = (F.abs(F.col("ix") - base.SIDES[0] // 2) <= 2) & (F.abs(F.col("iy") - base.SIDES[1] // 2) <= 2)
    beyond = cells.where("n > 1").select("grid_id", (F.col("voxel_idx") + 10**12).alias("voxel_idx"))
    return al.core_report(cells.where(middle).select(*vx.KEY).unionByName(beyond), cells)


def v_weight_archive(spark, sf_dir):
    """Weights of types and brands: those stored from parts of size 30 at most, merged with the pairs of size 20 and up."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("program_name"), F.col("p_brand").alias("label"), F.col("p_size").alias("size"))
    stored = part.where("size <= 30").groupBy("program_name", "label").agg(((F.min("size") - 3).cast("double") / 2).alias("weight"))
    return vx.merged_weights(stored, part.where("size >= 20"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("v_")}

_WALK = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)) AS s(dx, dy, up)"
_CORNER = ", ".join(f"({d}, {dx}, {dy}, {dz}, {c[0][0]}, {c[0][1]}, {c[0][2]})" for d, ((dx, dy, dz), c) in enumerate(zip(grid.DIRECTIONS, membranes.CORNERS, strict=True)))
_AXES = (("x", "dx"), ("y", "dy"), ("z", "dz"))
_TOWARDS = " + ".join(f"{d} * (m{c} - i{c} - 0.5 - {d} / 2.0)" for c, d in _AXES)
_MOVED = ", ".join(f"round(i{c} + c{c} + {d} * CASE WHEN {_TOWARDS} < 0 THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END, 6)::DOUBLE AS {c}" for c, d in _AXES)
_RATE = " ".join(f"WHEN f + 1 <= {last} THEN {rate}::DOUBLE" for last, rate in ch.GROWTH)

_BLADES = """blade AS (
  SELECT bg, px AS ax, py AS ay, -1.0::DOUBLE AS az, px + 2 AS bx, py + 1 AS "by", -1.0::DOUBLE AS bz, px + n / 8 AS cx, py + 1.5::DOUBLE AS cy, n + 3.3::DOUBLE AS cz
  FROM (SELECT (s_suppkey * 7 % 61 - 5.25)::DOUBLE AS px, (s_suppkey * 11 % 59 - 4.75)::DOUBLE AS py, s_nationkey::DOUBLE AS n, 'g' || (s_suppkey % (SELECT max(l_orderkey) // 10000 + 1 FROM lineitem)) AS bg FROM supplier))"""
_HITS = """shot AS (
  SELECT *, bx - ax AS e1x, "by" - ay AS e1y, bz - az AS e1z, cx - ax AS e2x, cy - ay AS e2y, cz - az AS e2z FROM ray CROSS JOIN blade),
crossed AS (SELECT *, dy * e2z - dz * e2y AS px, dz * e2x - dx * e2z AS py, dx * e2y - dy * e2x AS pz FROM shot),
sized AS (SELECT *, e1x * px + e1y * py + e1z * pz AS det FROM crossed),
seen AS (SELECT voxel_idx, s.*, ix + 0.5::DOUBLE - ax AS tx, iy + 0.5::DOUBLE - ay AS ty, iz + 0.5::DOUBLE - az AS tz FROM cells JOIN (SELECT * FROM sized WHERE abs(det) > 1e-12) s ON bg = g),
q AS (SELECT *, (tx * px + ty * py + tz * pz) / det AS s, ty * e1z - tz * e1y AS qx, tz * e1x - tx * e1z AS qy, tx * e1y - ty * e1x AS qz FROM seen),
near AS (
  SELECT voxel_idx, i, min((e2x * qx + e2y * qy + e2z * qz) / det) AS far FROM q
  WHERE s >= -1e-9 AND (dx * qx + dy * qy + dz * qz) / det >= -1e-9 AND s + (dx * qx + dy * qy + dz * qz) / det <= 1 + 1e-9 AND (e2x * qx + e2y * qy + e2z * qz) / det >= 0 GROUP BY ALL),
lost AS (SELECT voxel_idx, sum(1000.0::DOUBLE - far) AS lost FROM near WHERE far < 1000 GROUP BY voxel_idx)"""
_CORE = base._MIXED + """, far AS (
  SELECT p.voxel_idx, g, sqrt(min((p.ix - q.ix) * (p.ix - q.ix) + (p.iy - q.iy) * (p.iy - q.iy) + (p.iz - q.iz) * (p.iz - q.iz))::DOUBLE) AS far
  FROM a p JOIN (SELECT * FROM a WHERE program_idx = -2) q USING (g) GROUP BY p.voxel_idx, g)"""

_PLAN = f"""plan AS MATERIALIZED (
  SELECT *, (row_number() OVER (ORDER BY g, program_idx, floor_idx, ix, iy))::BIGINT AS node
  FROM (SELECT g, program_idx, {base._FLOOR} AS floor_idx, ix, iy, count(*) AS voxels, min(iz) AS min_z FROM a WHERE program_idx <> -1 GROUP BY ALL))"""
_TOUCHING = "p.g = q.g AND p.program_idx = q.program_idx AND p.floor_idx = q.floor_idx"


def _least(edges: str, nodes: str) -> str:
    """SQL of the least node that each node reaches over `edges` (a, b), in both directions."""
    return f"""{edges}, cc(node, least) USING KEY (node) AS (
  SELECT node, node FROM {nodes}
  UNION SELECT * FROM (SELECT DISTINCT ON (k.node) k.node, c.least FROM cc c JOIN edges e ON e.a = c.node JOIN recurring.cc k ON k.node = e.b WHERE c.least < k.least ORDER BY k.node, c.least))"""


_REGIONS = f"WITH RECURSIVE {base._MIXED}, {_PLAN}, " + _least(f"edges AS MATERIALIZED (SELECT p.node AS a, q.node AS b FROM plan p CROSS JOIN {_WALK} JOIN plan q ON {_TOUCHING} AND q.ix = p.ix + dx AND q.iy = p.iy + dy)", "plan") + """,
region AS (SELECT f.g AS grid_id, f.program_idx, f.floor_idx, f.ix AS first_x, f.iy AS first_y, count(*) AS cells, sum(p.voxels)::BIGINT AS source_voxels, min(p.min_z) AS min_z
  FROM plan p JOIN cc USING (node) JOIN plan f ON f.node = least GROUP BY ALL)"""
_CORNERS_OF = ", ".join(f"({d}, {sum(c[0] for c in k) / 4}::DOUBLE, {sum(c[1] for c in k) / 4}::DOUBLE, {sum(c[2] for c in k) / 4}::DOUBLE, {n[0]}::DOUBLE, {n[1]}::DOUBLE, {n[2]}::DOUBLE)" for d, (k, n) in enumerate(zip(membranes.CORNERS, grid.DIRECTIONS, strict=True)))
_NAMES = "(VALUES (-2, 'Core'), (-1, 'Open Boundary'), (0, 'Office'), (1, 'Retail'), (2, 'Housing'))"
_EDGES = f"""plan AS (SELECT DISTINCT g, program_idx, {base._FLOOR} AS floor_idx, ix, iy FROM a WHERE program_idx >= 0),
edge AS MATERIALIZED (
  SELECT p.g, p.program_idx, p.floor_idx, p.ix + sx AS x, p.iy + sy AS y, side, p.ix + sx + ex AS to_x, p.iy + sy + ey AS to_y, (row_number() OVER (ORDER BY p.g, p.program_idx, p.floor_idx, p.ix + sx, p.iy + sy, side))::BIGINT AS node
  FROM plan p CROSS JOIN (VALUES {", ".join(f"({k}, {o[0]}, {o[1]}, {c[0]}, {c[1]}, {e[0]}, {e[1]})" for k, ((o, c), e) in enumerate(zip(loops.SIDES, loops.STEPS, strict=True)))}) AS s(side, ox, oy, sx, sy, ex, ey)
  ANTI JOIN plan q ON {_TOUCHING} AND q.ix = p.ix + ox AND q.iy = p.iy + oy),
edges AS MATERIALIZED (SELECT p.node AS a, q.node AS b FROM edge p JOIN edge q ON {_TOUCHING} AND q.x = p.to_x AND q.y = p.to_y QUALIFY row_number() OVER (PARTITION BY p.node ORDER BY (p.side + 5 - q.side) % 4) = 1)"""

def _bits(pairs: list[tuple[int, int, int]]) -> str:
    """Rows (m, dir, allowed): the grades that a set of grades m allows in each direction, as bits."""
    found = {(a, d, b) for a, d, b in pairs if (b, d ^ 1, a) in pairs}
    return ", ".join(f"({m}, {d}, {sum(1 << b for b in range(5) if any((a, d, b) in found for a in range(5) if m >> a & 1))})" for m in range(32) for d in range(6))


_UPRIGHT = _bits([(i, d, x) for i in range(5) for d in range(6) for x in range(max(i - 1, 0), min(i + 2, 5)) if not (d == 4 and x < i) and not (d == 5 and x > i)] + [(0, 0, 4)])


def _settled(name: str, start: str) -> str:
    """SQL of the sets left on each cell, from the rows (v, m) of `start`."""
    return f"""{name}(v, m) USING KEY (v) AS (
  SELECT v, m FROM {start}
  UNION SELECT k.v, k.m & bit_and(allowed) FROM {name} w JOIN edges e ON e.a = w.v JOIN rule ON rule.m = w.m AND rule.dir = e.dir JOIN recurring.{name} k ON k.v = e.b GROUP BY k.v, k.m HAVING k.m & bit_and(allowed) <> k.m)"""


_TILES = f"""{base._CELLS}, few AS MATERIALIZED (SELECT * FROM cells WHERE qty <= 12), rule AS (FROM (VALUES {_UPRIGHT}) AS r(m, dir, allowed)),
edges AS MATERIALIZED (SELECT c.voxel_idx AS a, o.voxel_idx AS b, dir FROM few c CROSS JOIN {base._STEPS} JOIN few o ON o.gx = c.gx + dx AND o.iy = c.iy + dy AND o.iz = c.iz + dz),
given AS (SELECT voxel_idx AS v, CASE WHEN voxel_idx % 3 > 0 THEN 31 ELSE (1 << (qty::INTEGER % 5)) END AS m FROM few), {_settled("held", "given")}"""

#: costs, next moves and ways of cores, then of programs onto and over the cores' ways; a cantilever of 4
_WAYS = f"""ground AS MATERIALIZED (SELECT voxel_idx AS v FROM a WHERE iz = 0),
step AS MATERIALIZED (SELECT p.voxel_idx AS a, q.voxel_idx AS b, up = 1 AS falls FROM a p CROSS JOIN (SELECT * FROM {_WALK} UNION ALL SELECT 0, 0, 1) s JOIN a q ON q.gx = p.gx + dx AND q.iy = p.iy + dy AND q.iz = p.iz + up),
cost1(v, r, c) USING KEY (v, r) AS (
  SELECT v, r, 0 FROM ground CROSS JOIN range(5) AS t(r)
  UNION SELECT * FROM (SELECT DISTINCT ON (o.v, o.r) o.v, o.r, o.c
    FROM (SELECT b AS v, t.r, c + CASE WHEN falls THEN 5 ELSE 20 END AS c FROM cost1 k JOIN step ON a = k.v JOIN range(5) AS t(r) ON (falls AND k.r = 0) OR (NOT falls AND t.r = k.r - 1)) o
    LEFT JOIN recurring.cost1 n ON n.v = o.v AND n.r = o.r WHERE n.c IS NULL OR o.c < n.c ORDER BY o.v, o.r, o.c)),
move1 AS MATERIALIZED (
  SELECT DISTINCT ON (k.v, k.r) k.v, k.r, a AS goes, CASE WHEN falls THEN 0 ELSE k.r + 1 END AS run, NOT falls AS side
  FROM cost1 k JOIN step ON b = k.v JOIN cost1 n ON n.v = a AND n.r = CASE WHEN falls THEN 0 ELSE k.r + 1 END WHERE k.v NOT IN (FROM ground) ORDER BY k.v, k.r, n.c + CASE WHEN falls THEN 5 ELSE 20 END, a),
walk1 AS (
  SELECT v AS s, v, r, 0 AS n, 0 AS sides FROM cost1 JOIN a ON voxel_idx = v WHERE program_idx = -2 AND r = 0
  UNION ALL SELECT s, goes, run, n + 1, sides + side::INTEGER FROM walk1 w JOIN move1 m ON m.v = w.v AND m.r = w.r),
led AS (SELECT w.*, max(n) OVER (PARTITION BY s, p.iz) - n AS lead, q.iz AS top, max(n) OVER (PARTITION BY s) - n AS rest, max(sides) OVER (PARTITION BY s) - sides AS rest_sides FROM walk1 w JOIN a p ON p.voxel_idx = v JOIN a q ON q.voxel_idx = s),
owner AS MATERIALIZED (SELECT DISTINCT ON (v) v, s, n, lead, rest, rest_sides FROM led ORDER BY v, top DESC, s),
sink AS MATERIALIZED (SELECT v, max(ends) AS ends FROM (SELECT v, 4 AS ends FROM ground UNION ALL SELECT v, 4 - lead FROM owner) GROUP BY v),
paid AS MATERIALIZED (SELECT a, b, falls, CASE WHEN falls THEN 5 ELSE 20 END // CASE WHEN a IN (SELECT v FROM owner) THEN 5 ELSE 1 END AS c FROM step),
cost2(v, r, c) USING KEY (v, r) AS (
  SELECT v, r, 0 FROM sink JOIN range(5) AS t(r) ON r <= ends
  UNION SELECT * FROM (SELECT DISTINCT ON (o.v, o.r) o.v, o.r, o.c
    FROM (SELECT b AS v, t.r, k.c + p.c AS c FROM cost2 k JOIN paid p ON a = k.v JOIN range(5) AS t(r) ON (falls AND k.r = 0) OR (NOT falls AND t.r = k.r - 1)) o
    LEFT JOIN recurring.cost2 n ON n.v = o.v AND n.r = o.r WHERE n.c IS NULL OR o.c < n.c ORDER BY o.v, o.r, o.c)),
move2 AS MATERIALIZED (
  SELECT DISTINCT ON (k.v, k.r) k.v, k.r, a AS goes, CASE WHEN falls THEN 0 ELSE k.r + 1 END AS run, NOT falls AS side
  FROM cost2 k JOIN paid p ON b = k.v JOIN cost2 n ON n.v = a AND n.r = CASE WHEN falls THEN 0 ELSE k.r + 1 END LEFT JOIN sink ON sink.v = k.v WHERE coalesce(ends, -1) < k.r ORDER BY k.v, k.r, n.c + p.c, a),
walk2 AS (
  SELECT v AS s, v, r, 0 AS n, 0 AS sides FROM cost2 JOIN a ON voxel_idx = v WHERE program_idx >= 0 AND r = 0
  UNION ALL SELECT s, goes, run, n + 1, sides + side::INTEGER FROM walk2 w JOIN move2 m ON m.v = w.v AND m.r = w.r),
last AS (SELECT s, max(n) AS n, max(sides) AS sides, arg_max(v, n) AS v FROM walk2 GROUP BY s),
route AS MATERIALIZED (
  SELECT s, n + coalesce(rest, 0) AS n, sides + coalesce(rest_sides, 0) AS sides, core, core_n FROM (SELECT l.s, l.n, l.sides, o.s AS core, o.n AS core_n, rest, rest_sides FROM last l LEFT JOIN owner o ON o.v = l.v)
  UNION ALL SELECT s, max(n), max(sides), NULL, NULL FROM walk1 GROUP BY s),
capacity AS (SELECT g AS grid_id, s AS source, program_idx, n::INTEGER AS steps, 0.25::DOUBLE ** sides AS capacity, core, core_n FROM route JOIN a ON voxel_idx = s),
every AS (
  SELECT s, v, n FROM walk1 UNION ALL SELECT s, v, n FROM walk2
  UNION ALL SELECT r.s, w.v, l.n + w.n - core_n FROM route r JOIN last l USING (s) JOIN walk1 w ON w.s = core AND w.n > core_n)"""

ORACLE_SQL = {
    "v_tiles_upright": f"WITH RECURSIVE {_TILES} SELECT g AS grid_id, ix, iy, iz, t::INTEGER AS tile_id FROM few JOIN held ON v = voxel_idx CROSS JOIN range(5) AS r(t) WHERE (m >> t) & 1 = 1",
    "v_tiles_used_up": f"""WITH RECURSIVE {_TILES}, spent AS (SELECT g FROM few JOIN held ON v = voxel_idx WHERE m = 4 GROUP BY g HAVING count(*) >= 100),
rest AS (SELECT v, CASE WHEN m IN (1, 2, 4, 8, 16) OR g NOT IN (FROM spent) THEN m ELSE m & 27 END AS m FROM held JOIN few ON v = voxel_idx WHERE m > 0), {_settled("later", "rest").replace("JOIN edges e ON e.a = w.v", "JOIN near e ON e.a = w.v")}
SELECT g AS grid_id, ix, iy, iz, t::INTEGER AS tile_id FROM few JOIN later ON v = voxel_idx CROSS JOIN range(5) AS r(t) WHERE (m >> t) & 1 = 1""".replace("later(v, m)", "near AS MATERIALIZED (SELECT e.* FROM edges e WHERE a IN (SELECT v FROM rest) AND b IN (SELECT v FROM rest)), later(v, m)"),
    "v_limits": f"""WITH {base._BEST}, c AS (
  SELECT g, CASE WHEN row_number() OVER (PARTITION BY g, program_idx ORDER BY winning_score DESC, voxel_idx) > CASE program_idx WHEN 0 THEN 5000 WHEN 1 THEN 3000 ELSE 1000000000 END THEN -1 ELSE program_idx END AS program_idx FROM best),
p AS (SELECT * FROM (VALUES (0, 'Office', 5000), (1, 'Retail', 3000), (2, 'Housing', NULL)) AS v(i, name, voxel_limit))
SELECT gs.g AS grid_id, i AS program_idx, name, count(c.g) AS assigned, voxel_limit FROM (SELECT DISTINCT g FROM best) gs CROSS JOIN p LEFT JOIN c ON c.g = gs.g AND c.program_idx = i GROUP BY ALL""",
    "v_stats_report": f"""WITH {base._NORM} SELECT g AS grid_id, 'qty' AS label, min(c.qty) AS min_value, max(c.qty) AS max_value, min(n.qty) AS norm_min, max(n.qty) AS norm_max FROM cells c JOIN norm n USING (voxel_idx, g) GROUP BY g
UNION ALL SELECT g, 'price', min(c.price), max(c.price), min(n.price), max(n.price) FROM cells c JOIN norm n USING (voxel_idx, g) GROUP BY g""",
    "v_floor_report": f"""WITH RECURSIVE {base._CELLS}, tops AS (SELECT g, max(iz) + 1 AS top FROM cells GROUP BY g),
curve AS (SELECT g, top, 1 AS f, 1.0::DOUBLE AS v FROM tops UNION ALL SELECT g, top, f + 1, v * CASE {_RATE} ELSE {ch.GROWTH_ABOVE}::DOUBLE END FROM curve WHERE f < top),
start AS (SELECT g, greatest(2, top - floor(top * 0.06)::INTEGER) AS s FROM tops),
below AS (SELECT g, coalesce(avg(v) FILTER (f < s), 1) AS mean, max(v) FILTER (f = s) AS first FROM curve JOIN start USING (g) GROUP BY g),
value AS (SELECT g, f, f >= s AS penthouse, CASE WHEN f < s THEN v ELSE greatest(first, 1.35::DOUBLE * mean) * 1.02::DOUBLE ** (f - s) END AS v FROM curve JOIN start USING (g) JOIN below USING (g))
SELECT c.g AS grid_id, f AS floor_idx, count(*) AS voxels, (3.0 * (f - 1))::DOUBLE AS low, (3.0 * f)::DOUBLE AS high, round(any_value(v), 9) AS value, any_value(penthouse) AS penthouse FROM cells c JOIN value ON value.g = c.g AND f = iz + 1 GROUP BY c.g, f""",
    "v_cap_counts": f"""WITH {base._MIXED} SELECT p.g AS grid_id, CASE WHEN q.voxel_idx IS NULL THEN 'exterior' WHEN q.program_idx = -2 THEN 'core' ELSE 'unallocated' END AS kind, count(*) AS caps
FROM a p CROSS JOIN (VALUES (1), (-1)) AS s(direction) LEFT JOIN a q ON q.gx = p.gx AND q.iy = p.iy AND q.iz = p.iz + s.direction WHERE p.program_idx >= 0 AND (q.voxel_idx IS NULL OR q.program_idx < 0) GROUP BY ALL""",
    "v_core_report": f"WITH {base._CELLS} SELECT g AS grid_id, count(*) FILTER (abs(ix - 24) <= 2 AND abs(iy - 24) <= 2) AS valid, count(*) FILTER (n > 1) AS invalid FROM cells GROUP BY g HAVING valid + invalid > 0",
    "v_weight_archive": """WITH s AS (SELECT p_type, p_brand, (min(p_size) - 3)::DOUBLE / 2 AS w FROM part WHERE p_size <= 30 GROUP BY ALL), l AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size >= 20)
SELECT p_type AS program_name, p_brand AS label, greatest(-1, least(1, coalesce(w, 1)))::DOUBLE AS weight, l.p_type IS NOT NULL AS live, w IS NOT NULL AS stored FROM s FULL JOIN l USING (p_type, p_brand)""",
    "v_load_paths": f"WITH RECURSIVE {base._MIXED}, {_WAYS} SELECT grid_id, source, program_idx, steps, capacity FROM capacity",
    "v_structure": f"""WITH RECURSIVE {base._MIXED}, {_WAYS}
SELECT c.grid_id, voxel_idx, sum(CASE WHEN c.program_idx = -2 THEN 1.0::DOUBLE ELSE capacity END) AS importance FROM every e JOIN capacity c ON source = s JOIN a ON voxel_idx = v WHERE a.program_idx = -1 GROUP BY ALL""",
    "v_network_edges": f"""WITH RECURSIVE {base._MIXED}, {_WAYS}
SELECT DISTINCT least(x.v, y.v) AS a, greatest(x.v, y.v) AS b FROM every x JOIN every y ON y.s = x.s AND y.n = x.n + 1""",
    "v_load_clusters": f"WITH RECURSIVE {base._MIXED}, {_WAYS}, " + _least("edges AS MATERIALIZED (SELECT p.voxel_idx AS a, q.voxel_idx AS b FROM a p CROSS JOIN " + base._STEPS + " JOIN a q ON q.gx = p.gx + dx AND q.iy = p.iy + dy AND q.iz = p.iz + dz AND q.program_idx = p.program_idx WHERE p.program_idx >= 0), nodes AS MATERIALIZED (SELECT voxel_idx AS node FROM a WHERE program_idx >= 0)", "nodes") + """
SELECT g AS grid_id, a.program_idx, least AS cluster, count(*) AS voxels, count(*) FILTER (capacity IS NULL) AS unrouted, bool_or(capacity IS NULL) AS unsupported, bool_or(capacity IS NULL OR capacity <= 0.25) AS weak
FROM a JOIN cc ON node = voxel_idx LEFT JOIN capacity ON source = voxel_idx GROUP BY ALL""",
    "v_clusters": f"WITH RECURSIVE {base._MIXED}, " + _least("edges AS MATERIALIZED (SELECT p.voxel_idx AS a, q.voxel_idx AS b FROM a p CROSS JOIN " + base._STEPS + " JOIN a q ON q.gx = p.gx + dx AND q.iy = p.iy + dy AND q.iz = p.iz + dz AND q.program_idx = p.program_idx WHERE p.program_idx >= 0), nodes AS MATERIALIZED (SELECT voxel_idx AS node FROM a WHERE program_idx >= 0)", "nodes") + " SELECT voxel_idx, program_idx, least AS cluster FROM a JOIN cc ON node = voxel_idx",
    "v_floor_regions": f"{_REGIONS} SELECT * FROM region",
    "v_region_numbers": f"{_REGIONS} SELECT *, row_number() OVER (PARTITION BY grid_id, program_idx, floor_idx ORDER BY first_x, first_y) - 1 AS number FROM region",
    "v_region_report": f"""{_REGIONS}, left_out AS (SELECT g AS grid_id, count(*) FILTER (program_idx = -1) AS unallocated, 0::BIGINT AS core, count(*) FILTER (program_idx = 2) AS structure FROM a GROUP BY g)
SELECT grid_id, program_idx, count(*) AS regions, sum(cells)::BIGINT AS cells, sum(source_voxels)::BIGINT AS source_voxels, program_name, 255 AS a, CASE program_idx WHEN -2 THEN 80 ELSE 255 END AS r, CASE program_idx WHEN -2 THEN 80 ELSE 255 END AS g, CASE program_idx WHEN -2 THEN 80 ELSE 255 END AS b, unallocated, core, structure
FROM region JOIN {_NAMES} AS n(program_idx, program_name) USING (program_idx) JOIN left_out USING (grid_id) WHERE program_idx <> 2 GROUP BY ALL""",
    "v_region_loops": f"""WITH RECURSIVE {base._MIXED}, {_EDGES}, cc(node, least) USING KEY (node) AS (
  SELECT node, node FROM edge
  UNION SELECT k.node, c.least FROM cc c JOIN edges e ON e.a = c.node JOIN recurring.cc k ON k.node = e.b WHERE c.least < k.least),
walk AS (SELECT node, least, 0::BIGINT AS place FROM cc WHERE node = least UNION ALL SELECT b, least, place + 1 FROM walk JOIN edges ON a = node WHERE b <> least)
SELECT e.g AS grid_id, e.program_idx, e.floor_idx, f.x AS loop_x, f.y AS loop_y, f.side AS loop_side, place, e.x, e.y FROM walk w JOIN edge e ON e.node = w.node JOIN edge f ON f.node = w.least""",
    "v_surface_distance": f"""WITH RECURSIVE {base._CELLS}{base._OPEN},
edges AS MATERIALIZED (SELECT c.voxel_idx AS a, o.voxel_idx AS b, o.ix, o.iy, o.iz FROM cells c CROSS JOIN {base._STEPS} JOIN cells o ON o.gx = c.gx + dx AND o.iy = c.iy + dy AND o.iz = c.iz + dz),
far(v, square, seed, sx, sy, sz) USING KEY (v) AS (
  SELECT voxel_idx, 0, voxel_idx, ix, iy, iz FROM cells WHERE voxel_idx IN (SELECT voxel_idx FROM faces)
  UNION SELECT * FROM (SELECT DISTINCT ON (e.b) e.b, (e.ix - sx) * (e.ix - sx) + (e.iy - sy) * (e.iy - sy) + (e.iz - sz) * (e.iz - sz) AS square, seed, sx, sy, sz
    FROM far f JOIN edges e ON e.a = f.v WHERE NOT EXISTS (FROM recurring.far k WHERE k.v = e.b) ORDER BY e.b, square, seed))
SELECT v AS voxel_idx, sqrt(square::DOUBLE) AS value FROM far""",
    "v_tiles": f"""WITH RECURSIVE {base._CELLS},
edges AS MATERIALIZED (SELECT c.voxel_idx AS a, o.voxel_idx AS b FROM cells c CROSS JOIN {base._STEPS} JOIN cells o ON o.gx = c.gx + dx AND o.iy = c.iy + dy AND o.iz = c.iz + dz),
most(v, top) USING KEY (v) AS (
  SELECT voxel_idx, CASE WHEN n > 1 THEN qty::INTEGER % 2 ELSE 4 END FROM cells
  UNION SELECT * FROM (SELECT DISTINCT ON (e.b) e.b, m.top + 1 AS top FROM most m JOIN edges e ON e.a = m.v JOIN recurring.most k ON k.v = e.b WHERE m.top + 1 < k.top ORDER BY e.b, top))
SELECT g AS grid_id, ix, iy, iz, t AS tile_id FROM cells JOIN most ON v = voxel_idx CROSS JOIN range(5) AS r(t) WHERE t <= top AND (n = 1 OR t = qty::INTEGER % 2)""",
    "v_interface_faces": f"""WITH {base._TOUCH}, every AS (
  SELECT axis, program_a, program_b, voxel_a, voxel_b, direction, 'face' AS kind FROM face
  UNION ALL SELECT 2, p.program_idx, -1, p.voxel_idx, coalesce(q.voxel_idx, -1), s.direction, CASE WHEN q.voxel_idx IS NULL THEN 'exterior' ELSE 'unallocated' END
  FROM a p CROSS JOIN (VALUES (1), (-1)) AS s(direction) LEFT JOIN a q ON q.gx = p.gx AND q.iy = p.iy AND q.iz = p.iz + s.direction WHERE p.program_idx >= 0 AND (q.voxel_idx IS NULL OR q.program_idx = -1))
SELECT f.*, iz, 10.0::DOUBLE + 2 * (ix + cx) AS x, 20.0::DOUBLE + 2 * (iy + cy) AS y, 30.0::DOUBLE + 2 * (iz + cz) AS z, nx AS normal_x, ny AS normal_y, nz AS normal_z, 4.0::DOUBLE AS area, m.n AS name_a, o.n AS name_b
FROM every f JOIN a ON voxel_idx = voxel_a JOIN (VALUES {_CORNERS_OF}) AS c(d, cx, cy, cz, nx, ny, nz) ON d = axis * 2 + (direction < 0)::INTEGER JOIN {_NAMES} AS m(i, n) ON m.i = program_a JOIN {_NAMES} AS o(i, n) ON o.i = program_b""",
    "v_support": f"""WITH RECURSIVE {base._MIXED},
walk AS (
  SELECT gx, iy, iz, 0 AS need FROM a WHERE iz = 0
  UNION
  SELECT a.gx, a.iy, a.iz, CASE WHEN up = 1 THEN 0 ELSE need + 1 END FROM walk w CROSS JOIN (SELECT * FROM {_WALK} UNION ALL SELECT 0, 0, 1) s
  JOIN a ON a.gx = w.gx + dx AND a.iy = w.iy + dy AND a.iz = w.iz + up WHERE up = 1 OR need < 4)
SELECT voxel_idx, program_idx, min(need) AS overhang FROM a LEFT JOIN walk USING (gx, iy, iz) GROUP BY ALL""",
    "v_membranes": f"""WITH {base._MIXED}, centre AS (SELECT g, program_idx, avg(ix) + 0.5 AS mx, avg(iy) + 0.5 AS my, avg(iz) + 0.5 AS mz FROM a GROUP BY g, program_idx)
SELECT p.program_idx, p.voxel_idx, dir, {_MOVED.replace("ix", "p.ix").replace("iy", "p.iy").replace("iz", "p.iz")}
FROM a p JOIN centre USING (g, program_idx) CROSS JOIN (VALUES {_CORNER}) AS s(dir, dx, dy, dz, cx, cy, cz)
JOIN a q ON q.gx = p.gx + dx AND q.iy = p.iy + dy AND q.iz = p.iz + dz AND q.program_idx <> p.program_idx""",
    "v_membrane_summary": f"""WITH {base._MIXED}
SELECT p.g AS grid_id, p.program_idx, count(DISTINCT p.voxel_idx) AS voxels, 4 * count(*) AS vertices, count(*) AS faces
FROM a p CROSS JOIN {base._STEPS} LEFT JOIN a q ON q.gx = p.gx + dx AND q.iy = p.iy + dy AND q.iz = p.iz + dz
WHERE q.program_idx IS NULL OR q.program_idx <> p.program_idx GROUP BY p.g, p.program_idx""",
    "v_boundary_edges": f"""WITH {base._MIXED}, f AS (SELECT DISTINCT g, program_idx, {base._FLOOR} AS floor_idx, ix, iy FROM a WHERE program_idx >= 0)
SELECT g AS grid_id, program_idx, floor_idx, ix + sx AS x, iy + sy AS y, side FROM f CROSS JOIN (VALUES (0, 0, -1, 0, 0), (1, 1, 0, 1, 0), (2, 0, 1, 1, 1), (3, -1, 0, 0, 1)) AS s(side, dx, dy, sx, sy)
ANTI JOIN f o ON o.g = f.g AND o.program_idx = f.program_idx AND o.floor_idx = f.floor_idx AND o.ix = f.ix + dx AND o.iy = f.iy + dy""",
    "v_centers": f"WITH {base._CELLS} SELECT voxel_idx, 1.0::DOUBLE + (ix + 0.5::DOUBLE) * 0.5::DOUBLE AS x, 2.0::DOUBLE + (iy + 0.5::DOUBLE) * 0.5::DOUBLE AS y, 3.0::DOUBLE + (iz + 0.5::DOUBLE) * 0.5::DOUBLE AS z FROM cells",
    "v_shader": f"""WITH {base._BEST} SELECT voxel_idx, least(255, greatest(50, round_even(50 + 205 * (winning_score - min(winning_score) OVER (PARTITION BY g)) / (max(winning_score) OVER (PARTITION BY g) - min(winning_score) OVER (PARTITION BY g)), 0)))::INTEGER AS a,
10 * program_idx AS r, 20 * program_idx AS g, 255 AS b FROM best""",
    "v_unassigned": f"WITH {base._MIXED} SELECT voxel_idx FROM a WHERE program_idx = -1",
    "v_real_estate": f"""WITH RECURSIVE {base._CELLS}, tops AS (SELECT g, max(iz) + 1 AS top FROM cells GROUP BY g),
curve AS (SELECT g, top, 1 AS f, 1.0::DOUBLE AS v FROM tops UNION ALL SELECT g, top, f + 1, v * CASE {_RATE} ELSE {ch.GROWTH_ABOVE}::DOUBLE END FROM curve WHERE f < top),
start AS (SELECT g, greatest(2, top - floor(top * 0.06)::INTEGER) AS s FROM tops),
below AS (SELECT g, coalesce(avg(v) FILTER (f < s), 1) AS mean, max(v) FILTER (f = s) AS first FROM curve JOIN start USING (g) GROUP BY g),
value AS (SELECT g, f, CASE WHEN f < s THEN v ELSE greatest(first, 1.35::DOUBLE * mean) * 1.02::DOUBLE ** (f - s) END AS v FROM curve JOIN start USING (g) JOIN below USING (g)),
each AS (SELECT cells.g, voxel_idx, v FROM cells JOIN value ON value.g = cells.g AND f = iz + 1)
SELECT voxel_idx, round((v - min(v) OVER (PARTITION BY g)) / (max(v) OVER (PARTITION BY g) - min(v) OVER (PARTITION BY g)), 9) AS value FROM each""",
    "v_floor_distribution": f"""WITH {base._CELLS}, f AS (SELECT g, {base._FLOOR} AS floor_idx FROM cells)
SELECT g AS grid_id, floor_idx, count(*) AS voxels, ((floor_idx - 1) * 10)::DOUBLE AS low, (floor_idx * 10)::DOUBLE AS high FROM f GROUP BY g, floor_idx""",
    "v_voxel_vectors": f"WITH {base._CELLS} SELECT voxel_idx, price, qty FROM cells",
    "v_horizon_view": f"""WITH {base._CELLS}, {_BLADES}, ray AS (SELECT i, -sin(2 * pi() * i / 72) AS dx, cos(2 * pi() * i / 72) AS dy, 0.0::DOUBLE AS dz FROM range(72) r(i)),
{_HITS} SELECT voxel_idx, round(72 * 1000.0::DOUBLE - coalesce(lost, 0), 3) AS value FROM cells LEFT JOIN lost USING (voxel_idx)""",
    "v_sky_view": f"""WITH {base._CELLS}, {_BLADES}, ray AS (SELECT i, cos(pi() * (3 - sqrt(5)) * i) * sqrt(greatest(0, 1 - y * y)) AS dx, y AS dy, sin(pi() * (3 - sqrt(5)) * i) * sqrt(greatest(0, 1 - y * y)) AS dz FROM (SELECT i, 1.0::DOUBLE - 2.0::DOUBLE * i / 199 AS y FROM range(200) r(i))),
{_HITS} SELECT voxel_idx, round(200 * 1000.0::DOUBLE - coalesce(lost, 0), 3) AS value FROM cells LEFT JOIN lost USING (voxel_idx)""",
    "v_core_distance": f"WITH {_CORE} SELECT voxel_idx, round(far, 9) AS distance, far = 0 AS is_core FROM far",
    "v_core_proximity": f"WITH {_CORE} SELECT voxel_idx, round(max(far) OVER (PARTITION BY g) - far, 9) AS value FROM far",
    "v_core_from_curves": f"""WITH {base._CELLS}, {_BLADES}, e AS (SELECT bg, ax, ay, az, cx - ax AS sx, cy - ay AS sy, cz - az AS sz FROM blade),
t AS (SELECT voxel_idx, e.*, ix + 0.5::DOUBLE - ax AS px, iy + 0.5::DOUBLE - ay AS py, iz + 0.5::DOUBLE - az AS pz FROM cells JOIN e ON bg = g),
u AS (SELECT *, greatest(0, least(1, (px * sx + py * sy + pz * sz) / (sx * sx + sy * sy + sz * sz))) AS k FROM t),
d AS (SELECT voxel_idx, min(sqrt((px - k * sx) ** 2 + (py - k * sy) ** 2 + (pz - k * sz) ** 2)) AS distance FROM u GROUP BY voxel_idx)
SELECT voxel_idx, 0 AS curve_id, round(distance, 9) AS distance FROM d WHERE distance <= 10""",
    "v_core_coverage": f"WITH {_CORE} SELECT g AS grid_id, round(100.0::DOUBLE * count(*) FILTER (far = 0) / count(*), 9) AS percent, count(*) FILTER (far > 20) AS beyond, round(max(far), 9) AS greatest FROM far GROUP BY g",
    "v_gradient": f"""WITH {base._NORM}, v AS (SELECT voxel_idx, 'qty' AS label, qty AS t FROM norm UNION ALL SELECT voxel_idx, 'price', price FROM norm),
i AS (SELECT *, t * 4 AS u, least(floor(t * 4), 3)::INTEGER AS i FROM v), s AS (SELECT [255, 255, 0, 0, 0] AS r, [0, 255, 255, 255, 0] AS g, [0, 0, 0, 255, 255] AS b)
SELECT voxel_idx, label, round_even(s.r[i + 1] + (s.r[i + 2] - s.r[i + 1]) * (u - i), 0)::INTEGER AS r, round_even(s.g[i + 1] + (s.g[i + 2] - s.g[i + 1]) * (u - i), 0)::INTEGER AS g,
round_even(s.b[i + 1] + (s.b[i + 2] - s.b[i + 1]) * (u - i), 0)::INTEGER AS b FROM i, s""",
    "v_floor_neighbors": f"WITH {base._CELLS} SELECT c.voxel_idx, dir, o.voxel_idx AS other_voxel_idx FROM cells c CROSS JOIN {base._STEPS} JOIN cells o ON o.gx = c.gx + dx AND o.iy = c.iy + dy AND o.iz = c.iz + dz WHERE dir < 4",
    "v_centerlines": f"""WITH {base._MIXED}, f AS (SELECT g, iz, round(avg(ix + 0.5), 9)::DOUBLE AS x, round(avg(iy + 0.5), 9)::DOUBLE AS y, iz + 0.5::DOUBLE AS z FROM a WHERE program_idx = -2 GROUP BY g, iz),
n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM f)
SELECT g AS grid_id, (row_number() OVER (PARTITION BY g ORDER BY iz) - 1)::INTEGER AS place, x, y, z FROM n UNION ALL SELECT g, 1, x, y, z + 1 FROM n WHERE n = 1""",
    "v_structured": f"""WITH {base._MIXED}, p AS (SELECT g, CASE WHEN program_idx = -1 AND voxel_idx % 2 = 0 THEN 3 ELSE program_idx END AS program_idx FROM a)
SELECT g AS grid_id, program_idx, CASE program_idx WHEN 0 THEN 'Office' WHEN 1 THEN 'Retail' WHEN 2 THEN 'Housing' WHEN 3 THEN 'Structure' END AS name, count(*) AS voxels FROM p GROUP BY ALL""",
    "v_footprints": f"""WITH {base._MIXED} SELECT g AS grid_id, 0 AS core_id, iz, round(avg(ix + 0.5), 9)::DOUBLE AS x, round(avg(iy + 0.5), 9)::DOUBLE AS y, iz + 0.5::DOUBLE AS z,
min(ix)::DOUBLE AS x0, min(iy)::DOUBLE AS y0, max(ix) + 1.0::DOUBLE AS x1, max(iy) + 1.0::DOUBLE AS y1 FROM a WHERE program_idx = -2 GROUP BY g, iz""",
    "v_voxelize": """WITH s AS (SELECT o_orderkey, (o_orderkey % 3 + 1)::DOUBLE AS x, (o_custkey % 4 + 1)::DOUBLE AS y, (o_totalprice / 100000 + 0.5)::DOUBLE AS z FROM orders),
v AS (SELECT *, greatest(x, y, z) / 4 AS side FROM s)
SELECT o_orderkey::VARCHAR AS grid_id, (floor(x / side + 0.5) * floor(y / side + 0.5) * floor(z / side + 0.5))::BIGINT AS voxels FROM v WHERE floor(x / side + 0.5) * floor(y / side + 0.5) * floor(z / side + 0.5) > 0""",
}

ORACLE_SQL["v_support_report"] = f"""WITH s AS ({ORACLE_SQL["v_support"].replace("SELECT voxel_idx, program_idx, min(need)", "SELECT g, voxel_idx, program_idx, min(need)")})
SELECT g AS grid_id, count(*) FILTER (program_idx <> -1) AS allocated, count(*) FILTER (program_idx <> -1 AND overhang IS NOT NULL) AS grounded, ceil(0.25 * count(*) FILTER (program_idx = -1))::BIGINT AS target FROM s GROUP BY g"""
