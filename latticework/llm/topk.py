"""Exact top-k inner products by distributed histogram selection.

Every query is scored against every vector, in blocks. Rather than sorting, each
round counts the scores of each query into bins, over all partitions, and keeps
the bin that holds the k-th highest; the next round bins that bin's range. Once
a bin is one value wide, it is the k-th score, and one last pass keeps what
reaches it, with ties broken by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: bytes of quantised queries that one pass broadcasts; more queries take more passes
MAX_QUERY_BYTES = 8 << 20
BINS = 1024
#: equal query rows that are listed at once
_STEP = 4096
_COUNTS = "q int, bin long, n long"
_HITS = "q int, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null and no non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _matrix(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised components end to end, and n + 1 offsets."""
    flat = column.flatten()
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.floor(np.asarray(flat, dtype=np.float64) * scale), np.concatenate(([0], np.cumsum(sizes)))


def _scored(batches, queries: dict, scale: int, cells: int = 1 << 21):
    """(ids, query rows, scores, whether id and vector are the query's) for each block of vectors and each dimension."""
    for batch in batches:
        ids = np.asarray(batch[0], dtype=np.int64)
        values, offs = _matrix(batch[1], scale)
        dims = np.diff(offs)
        for d, (q_ids, q_rows, q) in queries.items():
            mine, step = np.flatnonzero(dims == d), max(16, cells // len(q_ids))
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                v = values[offs[part][:, None] + np.arange(d)] if d else np.zeros((len(part), 0))
                exact = d * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(v).max(initial=0)) < 2**52
                s = (q @ v.T if exact else q.astype(np.int64) @ v.T.astype(np.int64)).astype(np.int64)
                own = q_ids[:, None] == ids[part][None, :]
                i, j = np.nonzero(own)
                own[i, j] = (q[i] == v[j]).all(axis=1)
                yield ids[part], q_rows, s, own


def _bins(state, scale: int, k: int):
    def run(batches):
        queries, lo, width, span = state.value
        for ids, rows, s, own in _scored(batches, queries, scale):
            s = np.where(own, np.iinfo(np.int64).min, s)
            if s.shape[1] > k:  # the k-th score over all is not below the k-th of this block
                floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
                keep = (s >= floor) & ~own
            else:
                keep = ~own
            at = s - lo[rows][:, None]
            b = np.minimum(at // width[rows][:, None], span - 1)
            keep &= at >= 0
            i, j = np.nonzero(keep)
            if len(i):
                code, n = np.unique(rows[i] * np.int64(span + 1) + b[i, j], return_counts=True)
                yield pa.record_batch([pa.array((code // (span + 1)).astype(np.int32)), pa.array(code % (span + 1)), pa.array(n.astype(np.int64))], names=["q", "bin", "n"])

    return run


def _reach(state, scale: int, k: int):
    def run(batches):
        queries, kth = state.value
        for ids, rows, s, own in _scored(batches, queries, scale):
            limit = kth[rows][:, None]
            over = (s > limit) & ~own
            i, j = np.nonzero(over)
            out = [(rows[i], ids[j], s[i, j])]
            for r in np.flatnonzero(((s == limit) & ~own).any(axis=1)):
                tied = np.sort(ids[(s[r] == limit[r]) & ~own[r]])[:k]
                out.append((np.full(len(tied), rows[r]), tied, np.full(len(tied), limit[r, 0])))
            q, v, score = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(v.astype(np.int64)), pa.array(score.astype(np.int64))], names=["q", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Components become floor(scale * x), x as double. `is_query` is a condition on
    the id alone. A query meets the usable vectors of its dimension in all rows
    but its own; ties go to the smaller id; with fewer than k others all are
    returned. Rows that repeat an id are queries and candidates of their own, so
    one may find its copies, and each gives its rows of the result. Vectors that
    are null or hold a null or non-finite component, and rows with a null id,
    take no part; an empty table gives no rows; a vector may have any number of
    components; other columns are ignored, whatever their names. Queries are
    taken in blocks of `MAX_QUERY_BYTES`.
    """
    spark = vectors.sparkSession
    part = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("query"))
    quantised = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    asked = part.where("query").groupBy("vec_id", quantised.alias("z")).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    size = asked.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    blocks = -(-size // MAX_QUERY_BYTES) if size else 0
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for k_block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "z"), F.lit(blocks)) == k_block).orderBy("vec_id", "z").select("vec_id", "v", "copies").collect()
        found = found.unionByName(_block(part.select("vec_id", "v"), rows, k, scale))
    return found.withColumnRenamed("vec_id", id_col)


def _block(part: DataFrame, rows: list, k: int, scale: int) -> DataFrame:
    spark = part.sparkSession
    sc = spark.sparkContext
    by_dim: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_dim.setdefault(len(r["v"]), []).append(i)
    ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
    queries = {d: (ids[i], np.array(i, dtype=np.int64), np.floor(np.array([rows[j]["v"] for j in i], dtype=np.float64).reshape(len(i), d) * scale)) for d, i in by_dim.items()}
    norm, itself = np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64)
    for _, i, q in queries.values():
        norm[i] = np.sqrt((q * q).sum(axis=1))
        itself[i] = (q.astype(np.int64) ** 2).sum(axis=1)
    # the passes leave out a query's row and its equals; the latter come back here
    equals = [(i, r["copies"] - 1) for i, r in enumerate(rows) if r["copies"] > 1]
    longest = part.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x.cast("double")) * scale + 1) ** 2))).first()[0] or 0.0
    bound = np.ceil(norm * longest**0.5).astype(np.int64) + 1
    lo, width = -bound, -(-(2 * bound + 1) // BINS)
    while True:
        state = sc.broadcast((queries, lo, width, BINS + 1))
        found = part.mapInArrow(_bins(state, scale, k), _COUNTS)
        if equals:
            found = found.unionByName(spark.createDataFrame([(i, int(min((itself[i] - lo[i]) // width[i], BINS)), n) for i, n in equals if itself[i] >= lo[i]], _COUNTS))
        counts = found.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.col("bin").desc()))
        # the last bin holds every score above the range
        kth = counts.withColumn("to", above).where(F.col("to") >= k).groupBy("q").agg(F.max("bin").alias("bin")).collect()
        chosen = np.zeros(len(rows), dtype=np.int64)
        for r in kth:
            chosen[r["q"]] = r["bin"]
        short = np.ones(len(rows), dtype=bool)
        short[[r["q"] for r in kth]] = False
        lo = np.where(short, lo, lo + chosen * width)
        done = short | (width == 1)
        if done.all():
            break
        width = np.where(done, width, -(-width // BINS))
    state = sc.broadcast((queries, lo))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    hits = part.mapInArrow(_reach(state, scale, k), _HITS)
    if equals:
        hits = hits.unionByName(spark.createDataFrame([(i, int(ids[i]), int(itself[i])) for i, n in equals for _ in range(min(n, k))], _HITS))
    names = spark.createDataFrame([(i, int(x), r["copies"]) for i, (x, r) in enumerate(zip(ids, rows, strict=True))], "q int, query_id long, copies long")
    ranks = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(F.broadcast(names), "q")
    each = ranks.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(_STEP)))).withColumn("row", F.explode(F.sequence(F.lit(1), F.least(F.lit(_STEP), F.col("copies") - F.col("at")))))
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
