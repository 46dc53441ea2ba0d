"""Names and colours of program numbers on result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.allocation import CORE, UNASSIGNED

#: fixed values: (alpha, red, green, blue) of the core and of unknown programs, and the alpha of known ones
BOX_COLOURS = {"core": (180, 80, 80, 80), "unknown": (255, 255, 0, 255), "alpha": 220}
REGION_COLOURS = {"core": (255, 80, 80, 80), "unknown": (255, 128, 128, 128), "alpha": 255}


def named(rows: DataFrame, programs: DataFrame, column: str = "program_idx", name: str = "program_name", open_boundary: bool = False) -> DataFrame:
    """`rows` with the name of the program in `column`: Core, the program's own, or Program and its number; with open_boundary -1 is Open Boundary."""
    own = programs.select(F.col("program_idx").alias(column), F.col("name").alias(name))
    p = F.col(column)
    fixed = F.when(p == CORE, "Core").when((p == UNASSIGNED) & F.lit(open_boundary), "Open Boundary")
    return rows.join(own, column, "left").select(*rows.columns, fixed.otherwise(F.coalesce(name, F.concat(F.lit("Program "), p.cast("string")))).alias(name))


def coloured(rows: DataFrame, programs: DataFrame, colours: dict = BOX_COLOURS) -> DataFrame:
    """`rows` with a, r, g, b of their program_idx."""
    own = programs.select("program_idx", F.lit(colours["alpha"]).alias("a"), "r", "g", "b")
    core = F.col("program_idx") == CORE
    fill = [F.when(core, colours["core"][k]).otherwise(F.coalesce(c, F.lit(colours["unknown"][k]))).cast("int").alias(c) for k, c in enumerate("argb")]
    return rows.join(own, "program_idx", "left").select(*rows.columns, *fill)
