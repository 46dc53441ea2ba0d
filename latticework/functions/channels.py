"""Column functions and per-channel transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.session import written

GROUP = ["grid_id", "label"]


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def sanitized(channels: DataFrame, mode: str = "strict") -> DataFrame:
    """Values made usable: `strict` sets null, NaN and +inf to 0 and keeps -inf; `py` keeps both infinities; `finite` keeps neither."""
    return channels.withColumn("value", _usable(F.col("value"), mode))


def _usable(value: Column, mode: str) -> Column:
    bad = {"finite": ~finite(value), "strict": value.isNull() | F.isnan(value) | (value == float("inf")), "py": value.isNull() | F.isnan(value)}[mode]
    return F.when(bad, 0.0).otherwise(value)


def _between(value: Column, lo: Column, hi: Column, least: float) -> Column:
    return F.when(hi - lo > least, (value - lo) / (hi - lo)).otherwise(0.0)


def normalized(channels: DataFrame, least: float = 1e-12) -> DataFrame:
    """Min-max by grid and label; 0 where the range is at most `least`."""
    span = channels.groupBy(*GROUP).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return channels.join(span, GROUP).select(*channels.columns[:-1], _between(F.col("value"), F.col("lo"), F.col("hi"), least).alias("value"))


def normalized_columns(voxels: DataFrame, labels: list[str], mode: str = "strict", least: float = 1e-12) -> DataFrame:
    """`voxels` (one row each) whose columns `labels` are sanitized and normalized, as if each were a channel.

    The spans are written, so that the join with them is a broadcast where grids are few; `voxels` is read twice.
    """
    usable = voxels.withColumns({x: _usable(F.col(x), mode) for x in labels})
    spans = usable.groupBy("grid_id").agg(*(f(x).alias(f"{n}_{x}") for x in labels for n, f in (("lo", F.min), ("hi", F.max))))
    spans, _ = written(spans)
    return usable.join(spans, "grid_id").select(*(_between(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), least).alias(c) if c in labels else F.col(c) for c in voxels.columns))


def inverted(channels: DataFrame) -> DataFrame:
    """max - value + min over the finite values; 0 for others."""
    value = F.when(finite(F.col("value")), F.col("value"))
    span = channels.groupBy(*GROUP).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return channels.join(span, GROUP).select(*channels.columns[:-1], F.coalesce(F.col("hi") - value + F.col("lo"), F.lit(0.0)).alias("value"))


#: fixed values: five colour stops from red to blue
STOPS = [(255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255)]


def ramp(t: Column) -> Column:
    """struct(r, g, b) on the five-stop ramp for t in 0 to 1, half-even rounding."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * 4
    i = F.least(F.floor(at), F.lit(3)).cast("int")
    stops = F.array(*(F.array(*map(F.lit, s)) for s in STOPS))

    def mixed(k: int) -> Column:
        a, b = F.get(F.get(stops, i), F.lit(k)), F.get(F.get(stops, i + 1), F.lit(k))
        return F.bround(a + (b - a) * (at - i)).cast("int")

    return F.struct(mixed(0).alias("r"), mixed(1).alias("g"), mixed(2).alias("b"))


def stats(raw: DataFrame) -> DataFrame:
    """Least, greatest and mean value of each channel."""
    return raw.groupBy(*GROUP).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))


def stats_report(raw: DataFrame) -> DataFrame:
    """Least and greatest value of each channel before and after `normalized`."""
    after = stats(normalized(sanitized(raw))).select(*GROUP, F.col("min_value").alias("norm_min"), F.col("max_value").alias("norm_max"))
    return stats(sanitized(raw)).drop("mean_value").join(after, GROUP)


def floor_of(height: Column, floor_height: float) -> Column:
    """Floor of a height: 1 and up from 0, -1 and down below; there is no floor 0."""
    if floor_height <= 0:
        raise ValueError("floor height has to be positive")
    f = F.floor(height / floor_height).cast("int")
    return F.when(f >= 0, f + 1).otherwise(f)


def walkup_value(f: Column) -> Column:
    d = F.abs(f - 1)
    return F.when(d >= 7, 0).otherwise(F.greatest(F.lit(1), 5 - d)).cast("double")


def commercial_value(f: Column) -> Column:
    return F.when(f <= 0, 0).otherwise(F.greatest(F.lit(0), 5 - (f - 1))).cast("double")


#: fixed values: growth of value from one floor to the next, by the last floor it holds for
GROWTH = [(5, 1.010), (6, 0.990), (7, 1.030), (9, 1.015), (10, 1.050), (24, 1.015), (29, 1.050)]
GROWTH_ABOVE = 1.015


def real_estate_values(tops: DataFrame) -> DataFrame:
    """(grid_id, floor_idx, value) of floors 1 to `top` of (grid_id, top) rows.

    Value grows from 1 on floor 1. The upper 6 percent of floors, from floor 2
    up, are penthouses: the first is worth 1.35 times the mean of the floors
    below if that is more, each next one 2 percent more than the one before.
    """
    floors = tops.select("grid_id", "top", F.greatest(F.lit(2), F.col("top") - F.floor(F.col("top") * 0.06)).cast("int").alias("start"))
    # the curve multiplies floor by floor, in order, so that rounding is that of the running product
    growth = F.transform(F.sequence(F.lit(1), F.col("top").cast("int")), lambda f: F.when(f == 1, 1.0).otherwise(_rate(f)))
    curve = F.aggregate(growth, F.array().cast("array<double>"), lambda acc, g: F.concat(acc, F.array(F.when(F.size(acc) == 0, 1.0).otherwise(F.get(acc, F.size(acc) - 1) * g))))
    base = floors.withColumn("curve", curve).withColumn("below", F.slice("curve", 1, F.least(F.col("start") - 1, F.col("top")).cast("int")))
    mean = F.when(F.size("below") == 0, 1.0).otherwise(F.aggregate("below", F.lit(0.0), lambda a, x: a + x) / F.size("below"))
    spread = base.withColumn("mean", mean).select("grid_id", "start", "mean", "curve", F.posexplode("curve").alias("i", "plain"))
    first = F.greatest(F.get("curve", F.col("start") - 1), F.lit(1.35) * F.col("mean"))
    value = F.when(F.col("i") + 1 < F.col("start"), F.col("plain")).otherwise(first * F.pow(F.lit(1.02), F.col("i") + 1 - F.col("start")))
    return spread.select("grid_id", (F.col("i") + 1).alias("floor_idx"), value.alias("value"))


def _rate(f: Column) -> Column:
    rate = F.lit(GROWTH_ABOVE)
    for last, value in reversed(GROWTH):
        rate = F.when(f <= last, value).otherwise(rate)
    return rate


def real_estate_value(floors: DataFrame) -> DataFrame:
    """Channel of the normalised value of each voxel's floor, of (grid_id, voxel_idx, floor_idx) rows; 0 below floor 1."""
    tops = floors.groupBy("grid_id").agg(F.greatest(F.max("floor_idx"), F.lit(1)).alias("top"))
    rows = floors.join(real_estate_values(tops), ["grid_id", "floor_idx"], "left")
    return normalized(rows.select("grid_id", "voxel_idx", F.lit("real_estate_value").alias("label"), F.coalesce("value", F.lit(0.0)).alias("value")))


def floor_distribution(floors: DataFrame, floor_height: float) -> DataFrame:
    """Voxels and height band of each floor of (grid_id, voxel_idx, floor_idx) rows."""
    low = F.when(F.col("floor_idx") > 0, F.col("floor_idx") - 1).otherwise(F.col("floor_idx")) * float(floor_height)
    return floors.groupBy("grid_id", "floor_idx").agg(F.count(F.lit(1)).alias("voxels")).select("grid_id", "floor_idx", "voxels", low.alias("low"), (low + float(floor_height)).alias("high"))


def floor_report(floors: DataFrame, floor_height: float, kind: str) -> DataFrame:
    """`floor_distribution` with each floor's `value` and whether it is a penthouse.

    The kind is walkup, commercial or real_estate; the last one's value is 0 below
    floor 1, and it alone has penthouses.
    """
    rows = floor_distribution(floors, floor_height)
    f = F.col("floor_idx")
    if kind != "real_estate":
        return rows.withColumns({"value": {"walkup": walkup_value, "commercial": commercial_value}[kind](f), "penthouse": F.lit(False)})
    tops = floors.groupBy("grid_id").agg(F.greatest(F.max("floor_idx"), F.lit(1)).alias("top"))
    first = F.greatest(F.lit(2), F.col("top") - F.floor(F.col("top") * 0.06))
    valued = rows.join(real_estate_values(tops), ["grid_id", "floor_idx"], "left").join(tops, "grid_id")
    return valued.select(*rows.columns, F.coalesce("value", F.lit(0.0)).alias("value"), (f >= first).alias("penthouse"))


def voxel_vectors(channels: DataFrame) -> DataFrame:
    """(grid_id, voxel_idx, values): each voxel's values by label."""
    return channels.groupBy("grid_id", "voxel_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "value")))).alias("values"))


def channel_of(channels: DataFrame, label: str) -> DataFrame:
    """The rows of one label; ValueError names the labels there are if it is none of them."""
    rows = channels.where(F.col("label") == label)
    if rows.isEmpty():
        raise ValueError(f"no channel {label}; there are {sorted(r[0] for r in channels.select('label').distinct().collect())}")
    return rows
