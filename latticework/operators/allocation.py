"""Scoring voxels against programs, and assigning them under limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import checkpointed, counted, written
from latticework.sources.voxels import KEY

UNASSIGNED, CORE = -1, -2


def wide(channels: DataFrame, labels: list[str]) -> DataFrame:
    """One row a voxel with a column for each label."""
    # one aggregate; a pivot would first group by label too, over as many rows as there are channel values
    return channels.groupBy(*KEY).agg(*(F.first(F.when(F.col("label") == x, F.col("value")), ignorenulls=True).alias(x) for x in labels))


def score_of(weights: list[tuple[str, float]]) -> Column:
    """Sum over labels in order: w * c for positive weights, |w| * (1 - c) for negative ones."""
    terms = [F.lit(w) * F.col(label) if w > 0 else F.lit(-w) * (1 - F.col(label)) for label, w in weights if w]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def scores(channels: DataFrame, programs: DataFrame, weights: DataFrame) -> DataFrame:
    """(grid_id, voxel_idx, program_idx, score) of every voxel and program; a missing weight is 1.

    Programs and weights are the user's small tables and become expressions, so
    scoring is one projection over the pivoted channels.
    """
    labels = [r["label"] for r in channels.select("label").distinct().orderBy("label").collect()]
    return scores_of(wide(channels, labels), labels, programs, weights)


def _by_program(labels: list[str], programs: DataFrame, weights: DataFrame) -> dict[int, Column]:
    """The score of each program, from a column for each label."""
    table = {(r["program_name"], r["label"]): r["weight"] for r in weights.collect()}
    found = {p["program_idx"]: score_of([(x, table.get((p["name"], x), 1.0)) for x in labels]) for p in programs.orderBy("program_idx").collect()}
    if not labels or not found:
        raise ValueError("scoring needs channels and programs")
    return found


def scores_of(columns: DataFrame, labels: list[str], programs: DataFrame, weights: DataFrame) -> DataFrame:
    """As `scores`, of voxels with a column for each label: nothing is grouped."""
    each = [F.struct(F.lit(k).alias("program_idx"), s.alias("score")) for k, s in _by_program(labels, programs, weights).items()]
    return columns.select(*KEY, F.explode(F.array(*each)).alias("s")).select(*KEY, "s.program_idx", "s.score")


def best_of(columns: DataFrame, labels: list[str], programs: DataFrame, weights: DataFrame) -> DataFrame:
    """`columns` with program_idx and winning_score, as `argmax` of `scores_of` has them."""
    each = [F.struct(s.alias("score"), F.lit(-k).alias("neg")) for k, s in _by_program(labels, programs, weights).items()]
    best = columns.withColumn("m", F.greatest(*each) if len(each) > 1 else each[0])
    return best.select(*columns.columns, (-F.col("m.neg")).alias("program_idx"), F.col("m.score").alias("winning_score"))


def argmax(scored: DataFrame) -> DataFrame:
    """Each voxel's program of the highest score, the first on ties."""
    return scored.groupBy(*KEY).agg(F.max(F.struct("score", (-F.col("program_idx")).alias("neg"))).alias("m")).select(*KEY, (-F.col("m.neg")).alias("program_idx"), F.col("m.score").alias("winning_score"))


def ranged(df: DataFrame, group: list[str], value: str, buckets: int = 64) -> DataFrame:
    """`df` with `range`: numbers that rise along (value descending, voxel_idx) in each group, none with many more than 1/buckets of its rows.

    Quantiles of the value part the values between them; a value that is a
    quantile may stand for any number of rows, so it has ranges of its own, by
    the quantiles of the index over the whole group.
    """
    shares = [i / buckets for i in range(1, buckets)]
    # approximate quantiles depend on the order in which parts are merged, so they are taken once for all that reads the ranges
    cuts = checkpointed(df.groupBy(*group).agg(F.percentile_approx(value, shares, 2000).alias("cuts"), F.percentile_approx("voxel_idx", shares, 2000).alias("index_cuts")))
    above, tied = F.size(F.filter("cuts", lambda c: c > F.col(value))), F.array_contains("cuts", F.col(value))
    part = F.when(tied, F.lit(buckets) + F.size(F.filter("index_cuts", lambda c: c < F.col("voxel_idx")))).otherwise(0)
    return df.join(cuts, group).withColumn("range", above * (2 * buckets) + part).drop("cuts", "index_cuts")


def numbered(df: DataFrame, group: list[str], value: str, name: str, buckets: int = 64) -> DataFrame:
    """Row numbers by (value descending, voxel_idx) in each group, without one task a group, however many values are equal.

    The rows of each of the `ranged` parts are numbered by themselves and moved up
    by the counts of the parts before.
    """
    parts = ranged(df, group, value, buckets)
    counts = parts.groupBy(*group, "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*group, "range", before.alias("before"))
    within = F.row_number().over(Window.partitionBy(*group, "range").orderBy(F.col(value).desc(), "voxel_idx"))
    return parts.withColumn("k", within).join(starts, [*group, "range"]).withColumn(name, (F.col("before") + F.col("k")).cast("long")).drop("range", "before", "k")


def ranked(assignment: DataFrame) -> DataFrame:
    """Assigned voxels with their rank in their program by winning score, ties by index."""
    return numbered(assignment.where(F.col("program_idx") >= 0), ["grid_id", "program_idx"], "winning_score", "rank")


def _completed(voxels: DataFrame, taken: DataFrame, core: DataFrame | None) -> DataFrame:
    out = voxels.select(*KEY).join(taken, KEY, "left").select(*KEY, F.coalesce("program_idx", F.lit(UNASSIGNED)).alias("program_idx"), F.coalesce("winning_score", F.lit(0.0)).alias("winning_score"))
    if core is None:
        return out
    return out.join(core.select(*KEY, F.lit(True).alias("is_core")).distinct(), KEY, "left").select(*KEY, F.when(F.col("is_core"), CORE).otherwise(F.col("program_idx")).alias("program_idx"), F.when(F.col("is_core"), 0.0).otherwise(F.col("winning_score")).alias("winning_score"))


def assign_highest(scored: DataFrame, programs: DataFrame, core: DataFrame | None = None, show_all: bool = True, max_rounds: int = 200) -> DataFrame:
    """Highest score first: (grid_id, voxel_idx, program_idx, winning_score).

    With limits this equals walking all scores from the top (ties by voxel, then
    program) and skipping taken voxels and full programs. It is done in rounds
    that raise each full program's cut, see `_under_limits`.
    """
    free = scored if core is None else scored.join(core.select(*KEY).distinct(), KEY, "left_anti")
    limits = {r["program_idx"]: r["voxel_count"] for r in programs.collect() if r["voxel_count"] >= 0} if not show_all else {}
    if not limits:
        return _completed(scored.select(*KEY).distinct(), argmax(free), core)
    every = sorted({r["program_idx"] for r in programs.collect()} | {r["program_idx"] for r in free.select("program_idx").distinct().collect()})
    mine = {k: F.when(F.col("program_idx") == k, F.struct("score")) for k in every}
    offers = free.groupBy(*KEY).agg(*(F.first(x, ignorenulls=True).alias(f"offer{k}") for k, x in mine.items()))
    return _completed(scored.select(*KEY).distinct(), _under_limits(offers, every, limits, max_rounds), core)


def assign_highest_of(columns: DataFrame, labels: list[str], programs: DataFrame, weights: DataFrame, max_rounds: int = 200) -> DataFrame:
    """As `assign_highest` with limits, of voxels with a column for each label: nothing is grouped by voxel."""
    scored = _by_program(labels, programs, weights)
    limits = {r["program_idx"]: r["voxel_count"] for r in programs.collect() if r["voxel_count"] >= 0}
    offers = columns.select(*KEY, *(F.struct(s.alias("score")).alias(f"offer{k}") for k, s in scored.items()))
    return _completed(columns, _under_limits(offers, list(scored), limits, max_rounds), None)


#: parts of a program's span of scores in which its last place is looked for
BINS = 4096


def _under_limits(offers: DataFrame, every: list[int], limits: dict[int, int], max_rounds: int) -> DataFrame:
    """(grid_id, voxel_idx, program_idx, winning_score) of voxels that a program takes.

    `offers` has offer<program>, a struct of the score, null where there is none.
    The voxels stay as they are written; a round only raises the cuts: the least
    (score, voxel) that a full program of a grid still takes. Each voxel is at its
    best program whose cut it reaches. Cuts never fall, as a program is only
    offered more, so a voxel below one is turned down for good.
    """
    offers, _ = written(offers)
    capped = [k for k in every if k in limits]
    if not capped:
        return _at_best(offers, every).where("program_idx is not null")
    spans = offers.groupBy("grid_id").agg(*(f(f"offer{k}.score").alias(f"{n}{k}") for k in capped for n, f in (("lo", F.min), ("hi", F.max))))
    cut_type = "struct<score: double, neg: bigint>"
    cuts, _ = written(spans.select("*", *(F.lit(None).cast(cut_type).alias(f"cut{k}") for k in capped), F.lit(True).alias("open")))

    def of(values: dict[int, Column]) -> Column:
        return F.coalesce(*(F.when(F.col("program_idx") == k, v) for k, v in values.items()))

    limit = of({k: F.lit(n).cast("long") for k, n in limits.items() if k in capped})
    for _ in range(max_rounds):
        # a grid in which nothing was cut any more is settled
        now = _at_best(offers.join(cuts.where("open"), "grid_id"), capped + [k for k in every if k not in capped], ["grid_id", *(f"{n}{k}" for k in capped for n in ("lo", "hi"))])
        lo, hi = of({k: F.col(f"lo{k}") for k in capped}), of({k: F.col(f"hi{k}") for k in capped})
        share = F.floor((F.col("winning_score") - lo) / (hi - lo) * BINS)
        held = now.where(F.col("program_idx").isin(capped)).select(*KEY, "program_idx", "winning_score", F.when(hi > lo, F.coalesce(share, F.lit(0))).otherwise(0).alias("bin"))
        group = ["grid_id", "program_idx"]
        bins = held.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy(F.col("bin").desc()))
        total = F.sum("n").over(Window.partitionBy(*group))
        # the bin that holds the last place, and the place within it
        last = bins.withColumns({"upto": upto, "total": total}).where((F.col("total") > limit) & (F.col("upto") >= limit) & (F.col("upto") - F.col("n") < limit)).select(*group, "bin", (limit - F.col("upto") + F.col("n")).alias("at"))
        last, seen = written(last, n=F.count(F.lit(1)))
        if not seen["n"]:
            return _at_best(offers.join(cuts, "grid_id"), every).where("program_idx is not null")
        near = written(held.join(last, [*group, "bin"]))[0]
        found = numbered(near, group, "winning_score", "place").where(F.col("place") == F.col("at")).select(*group, F.struct(F.col("winning_score").alias("score"), (-F.col("voxel_idx")).alias("neg")).alias("cut"))
        raised = found.groupBy("grid_id").agg(*(F.max(F.when(F.col("program_idx") == k, F.col("cut"))).alias(f"new{k}") for k in capped)).withColumn("more", F.lit(True))
        cuts, _ = written(cuts.join(raised, "grid_id", "left").select("grid_id", *(f"{n}{k}" for k in capped for n in ("lo", "hi")), *(F.coalesce(f"new{k}", f"cut{k}").alias(f"cut{k}") for k in capped), F.coalesce("more", F.lit(False)).alias("open")))
    raise RuntimeError(f"not settled in {max_rounds} rounds")


def _at_best(offers: DataFrame, every: list[int], keep: list[str] | None = None) -> DataFrame:
    """Each voxel's best program whose cut it reaches, null where there is none."""
    reached = []
    for k in every:
        offer = F.struct(F.col(f"offer{k}.score").alias("score"), (-F.col("voxel_idx")).alias("neg"))
        open_ = F.col(f"offer{k}").isNotNull()
        if f"cut{k}" in offers.columns:
            open_ &= F.col(f"cut{k}").isNull() | (offer >= F.col(f"cut{k}"))
        reached.append(F.when(open_, F.struct(F.col(f"offer{k}.score").alias("score"), F.lit(-k).alias("neg"))))
    best = offers.withColumn("m", F.greatest(*reached) if len(reached) > 1 else reached[0])
    more = [c for c in keep or [] if c not in KEY]
    return best.select(*KEY, *more, (-F.col("m.neg")).alias("program_idx"), F.col("m.score").alias("winning_score"))


def assign_per_program(scored: DataFrame, programs: DataFrame, core: DataFrame | None = None, show_all: bool = True) -> DataFrame:
    """Program 0 takes its limit of the best voxels, then program 1 of what is left, and so on."""
    left = scored if core is None else scored.join(core.select(*KEY).distinct(), KEY, "left_anti")
    taken = None
    for p in programs.orderBy("program_idx").collect():
        mine = left.where(F.col("program_idx") == p["program_idx"]).select(*KEY, "program_idx", F.col("score").alias("winning_score"))
        if not show_all and p["voxel_count"] >= 0:
            mine = numbered(mine, ["grid_id"], "winning_score", "place").where(F.col("place") <= p["voxel_count"]).drop("place")
        mine = checkpointed(mine)
        taken = mine if taken is None else taken.unionByName(mine)
        left = left.join(mine.select(*KEY), KEY, "left_anti")
    return _completed(scored.select(*KEY).distinct(), taken, core)


def argmax_clamp(scored: DataFrame, programs: DataFrame, show_all: bool = True) -> DataFrame:
    """Best program each; beyond a program's limit a voxel is unassigned, not offered on, and keeps its score."""
    best = argmax(scored)
    if show_all:
        return best
    limits = programs.select("program_idx", "voxel_count")
    placed = numbered(best, ["grid_id", "program_idx"], "winning_score", "place").join(F.broadcast(limits), "program_idx")
    over = (F.col("voxel_count") >= 0) & (F.col("place") > F.col("voxel_count"))
    return placed.select(*KEY, F.when(over, UNASSIGNED).otherwise(F.col("program_idx")).alias("program_idx"), "winning_score")


def alpha(assignment: DataFrame) -> DataFrame:
    """Opacity of each voxel: 40 if not assigned, else 50 to 255 by winning score, half-even rounding."""
    span = assignment.where("program_idx >= 0").groupBy("grid_id").agg(F.min("winning_score").alias("lo"), F.max("winning_score").alias("hi"))
    t = F.when(F.col("hi") > F.col("lo"), (F.col("winning_score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    value = F.when(F.col("program_idx") < 0, 40).otherwise(F.greatest(F.lit(50), F.least(F.lit(255), F.bround(50 + 205 * t).cast("int"))))
    return assignment.join(span, "grid_id", "left").select(*KEY, "program_idx", value.cast("int").alias("alpha"))


def summary(assignment: DataFrame) -> DataFrame:
    """Voxels of each program, of the core and of none."""
    return assignment.groupBy("grid_id", "program_idx").agg(F.count(F.lit(1)).alias("voxels"))


def limits_report(assignment: DataFrame, programs: DataFrame) -> DataFrame:
    """(grid_id, program_idx, name, assigned, voxel_limit) of every grid and program, also those that hold nothing; no limit is null."""
    every = assignment.select("grid_id").distinct().crossJoin(F.broadcast(programs.select("program_idx", "name", "voxel_count")))
    return every.join(summary(assignment), ["grid_id", "program_idx"], "left").select("grid_id", "program_idx", "name", F.coalesce("voxels", F.lit(0)).alias("assigned"), F.when(F.col("voxel_count") >= 0, F.col("voxel_count")).alias("voxel_limit"))


def core_report(core: DataFrame, voxels: DataFrame) -> DataFrame:
    """(grid_id, valid, invalid) of the rows of `core`: distinct ids that are voxels, and rows whose id is none."""
    known = voxels.select(*KEY, F.lit(True).alias("known")).distinct()
    return core.select(*KEY).join(known, KEY, "left").groupBy("grid_id").agg(F.count_distinct(F.when(F.col("known"), F.col("voxel_idx"))).alias("valid"), F.count_if(F.col("known").isNull()).alias("invalid"))


#: fixed values: alpha and colour of core and unassigned voxels
SHADES = {CORE: (180, 80, 80, 80), UNASSIGNED: (40, 160, 160, 160)}


def shader(assignment: DataFrame, programs: DataFrame) -> DataFrame:
    """(grid_id, voxel_idx, a, r, g, b): the program's colour with the voxel's opacity."""
    shaded = alpha(assignment).join(programs.select("program_idx", "r", "g", "b"), "program_idx", "left")
    columns = {"a": "alpha", "r": "r", "g": "g", "b": "b"}
    fixed = [F.when(F.col("program_idx") == CORE, SHADES[CORE][k]).when(F.col("program_idx") == UNASSIGNED, SHADES[UNASSIGNED][k]).otherwise(F.col(c)).cast("int").alias(n) for k, (n, c) in enumerate(columns.items())]
    return shaded.select(*KEY, *fixed)


def unassigned(assignment: DataFrame, show: bool = True) -> DataFrame:
    """Voxels of no program that are not core; none if they are not to be shown."""
    return assignment.where((F.col("program_idx") == UNASSIGNED) & F.lit(show)).select(*KEY)


def assign_round_robin(scored: DataFrame, programs: DataFrame, core: DataFrame | None = None, show_all: bool = True, batch: int = 100_000) -> DataFrame:
    """Programs in turn take their best free voxel, one a round, until they are full or nothing is free.

    Ties go to the lesser voxel. A pass takes each program's next `batch` free
    voxels, replays the turns on these rows alone, one task a grid, and stops
    where a program has used up its rows; passes follow until nothing changes.
    """
    limits = {r["program_idx"]: (r["voxel_count"] if not show_all and r["voxel_count"] >= 0 else None) for r in programs.collect()}
    order = sorted(limits)
    left = checkpointed(scored if core is None else scored.join(core.select(*KEY).distinct(), KEY, "left_anti"))
    schema = "grid_id string, voxel_idx long, program_idx int, winning_score double"

    def replay(rows):
        import pandas as pd

        queues = {p: list(g.sort_values(["score", "voxel_idx"], ascending=[False, True])[["voxel_idx", "score", "used", "more"]].itertuples(index=False)) for p, g in rows.groupby("program_idx")}
        at, used = dict.fromkeys(queues, 0), {p: int(q[0].used) for p, q in queues.items()}
        turn = int(rows["turn"].iloc[0])
        taken, out = set(), []
        idle, k = 0, turn
        while idle < len(order):
            p = order[k % len(order)]
            q = queues.get(p)
            claimed = False
            if q is not None and (limits[p] is None or used[p] < limits[p]):
                while at[p] < len(q) and q[at[p]].voxel_idx in taken:
                    at[p] += 1
                if at[p] == len(q):
                    if q[0].more:
                        break
                else:
                    row = q[at[p]]
                    taken.add(row.voxel_idx)
                    used[p] += 1
                    out.append((rows["grid_id"].iloc[0], row.voxel_idx, p, row.score))
                    claimed = True
            idle = 0 if claimed else idle + 1
            k += 1
        return pd.DataFrame(out, columns=["grid_id", "voxel_idx", "program_idx", "winning_score"])

    taken = None
    while True:
        # the turn goes on after the last claim: claims so far give used counts, the last claimer the turn
        if taken is None:
            state = left.select("grid_id").distinct().select("grid_id", F.lit(0).alias("turn"))
            used = None
        else:
            used = taken.groupBy("grid_id", "program_idx").agg(F.count(F.lit(1)).alias("used"))
            place = F.lit(0)
            for i, p in enumerate(order):
                place = F.when(F.col("program_idx") == p, i).otherwise(place)
            # the program after the last of those with the most claims is next
            top = F.max(F.struct("used", place.alias("place")))
            state = used.groupBy("grid_id").agg(top.alias("top")).select("grid_id", (F.col("top.place") + 1).alias("turn"))
        placed = numbered(left, ["grid_id", "program_idx"], "score", "place")
        size = left.groupBy("grid_id", "program_idx").agg((F.count(F.lit(1)) > batch).alias("more"))
        front = placed.where(F.col("place") <= batch).join(size, ["grid_id", "program_idx"]).join(state, "grid_id")
        front = front.join(used, ["grid_id", "program_idx"], "left").withColumn("used", F.coalesce("used", F.lit(0))) if used is not None else front.withColumn("used", F.lit(0))
        claims, seen = counted(front.groupBy("grid_id").applyInPandas(replay, schema), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        taken = claims if taken is None else checkpointed(taken.unionByName(claims))
        left = checkpointed(left.join(claims.select(*KEY), KEY, "left_anti"))
    return _completed(scored.select(*KEY).distinct(), claims if taken is None else taken, core)


def with_structure(assignment: DataFrame, programs: DataFrame, structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignment, programs) with a last program Structure that holds the voxels of `structure`.

    ValueError if a program of that name, in any case, exists. The program is
    kept when no voxel is given.
    """
    if not programs.where(F.lower("name") == "structure").isEmpty():
        raise ValueError("there is a program named structure")
    kept = structure.select(*KEY).distinct()
    index = programs.agg(F.coalesce(F.max("program_idx"), F.lit(-1)) + 1).first()[0]
    #: fixed values: the colour of structure
    more = kept.agg(F.lit(index).alias("program_idx"), F.lit("Structure").alias("name"), F.lit(82).alias("r"), F.lit(87).alias("g"), F.lit(94).alias("b"), F.count(F.lit(1)).cast("int").alias("voxel_count"))
    marked = assignment.join(kept.withColumn("held", F.lit(True)), KEY, "left")
    return marked.withColumn("program_idx", F.when(F.col("held"), index).otherwise(F.col("program_idx"))).drop("held"), programs.unionByName(more.select(*programs.columns))
