"""Grids that one task holds whole, so that nothing is exchanged while they are worked on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.session import PART, written
from latticework.sources.voxels import CELL

#: places in the box around a grid's cells, with a margin, up to which one task holds it: 32 MB for each array of 8 bytes a place
PLACES = 1 << 22


def split(cells: DataFrame, places: int | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows of grids whose box has up to `places` (PLACES), those of larger grids, None where there are none, and in how many partitions the small ones go to tasks.

    `cells` is read once for the sizes, so it should be written. Rows without a grid are dropped.
    """
    known = cells.where("grid_id is not null")
    sides = [F.coalesce(F.max(c) - F.min(c) + 3.0, F.lit(0.0)) for c in CELL[1:]]
    sizes = known.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), (sides[0] * sides[1] * sides[2]).alias("places"))
    wide = F.greatest("n", "places") > (PLACES if places is None else places)
    sizes, seen = written(sizes, rows=F.sum("n"), wide=F.count_if(wide))
    small, large = known, None
    if seen["wide"]:
        small, large = (known.join(sizes.where(wide).select("grid_id"), "grid_id", how) for how in ("left_anti", "left_semi"))
    # not by bytes, as few of them may be much work
    return small, large, max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(seen["rows"] or 0) // PART))
