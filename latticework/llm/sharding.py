"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Rows of equal text form a group and stay together. Every group that is more than
1 / UNITS of the table's bytes, tokens or rows is placed by itself, so there are
at most 3 * UNITS of them; one that is a noticeable share of a shard is cut into
pieces first. The tail of small groups is hashed into UNITS units. Only the
loads of groups, pieces and units, a bounded number, reach the driver, which
places each on the shard where the dot product of its loads with the residual
capacity is highest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm import wordpiece
from latticework.session import checkpointed

UNITS = 8192
#: a group of over 1 / (shards * PIECES) of the bytes, tokens or rows is cut
PIECES = 16


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit; loads has a row of bytes, tokens and rows for each."""
    total = np.maximum(loads.sum(axis=0), 1)
    share = loads / total * shards
    left = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(loads), dtype=np.int64)
    for i in np.lexsort((np.arange(len(loads)), -share.max(axis=1))):
        score = left @ share[i]
        fits = (left >= share[i]).all(axis=1)
        best = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(left[:, 0]))
        out[i] = best
        left[best] -= share[i]
    return out


def _measured(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, overhead: int) -> DataFrame:
    """(row, id, size, crc, tokens, grp) of every row, written once, so that row numbers stay."""
    text = F.col(text_col).cast("string")
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def run(batches):
        counter = wordpiece.machine(vocabulary_path)
        for batch in batches:
            raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch["text"].cast(pa.binary())]
            columns = [[len(t) + overhead for t in raw], [zlib.crc32(t) for t in raw], [counter.text(t)[1] for t in raw]]
            yield pa.record_batch([batch["id"], *(pa.array(c, pa.int64()) for c in columns), batch["grp"]], names=["id", "size", "crc", "tokens", "grp"])

    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text, text.isNull()).alias("grp"))
    return checkpointed(rows.mapInArrow(run, f"id {kind}, size long, crc long, tokens long, grp long")).withColumn("row", F.monotonically_increasing_id())


def shard_documents(docs: DataFrame, vocabulary_path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, tokens, shard, slot) of every row; slots are gapless from 0 in a shard.

    size is the UTF-8 bytes of the text plus `overhead`, tokens the longest-match
    pieces of its words (see `wordpiece`); a null text has no bytes or tokens, a
    CRC of 0 and a group of its own. Shards come out near equal in size. Equal
    texts share a shard unless their group is heavy; a heavy one is cut by row,
    so rows that repeat an id, or have none, spread as well. Every row gets a
    slot; an empty table gives no rows; a text of any length is one row. Other
    columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    rows = _measured(docs, vocabulary_path, id_col, text_col, overhead)
    load = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    groups = rows.groupBy("grp").agg(*load)
    total = groups.agg(*(F.sum(c).alias(c) for c in ("size", "tokens", "n"))).first()
    cut = shards * PIECES
    share = F.greatest(*(F.col(c) / F.lit(max(1, total[c] or 0)) for c in ("size", "tokens", "n")))
    pieces = F.when((share * cut > 1) & (F.col("n") > 1), F.least(F.col("n"), F.ceil(share * cut))).otherwise(1)
    single = groups.where(share * UNITS > 1).select("grp", pieces.cast("int").alias("pieces")).orderBy("grp").collect()
    first = UNITS + np.concatenate(([0], np.cumsum([r["pieces"] for r in single]))) if single else []
    singles = spark.createDataFrame([(r["grp"], r["pieces"], int(b)) for r, b in zip(single, first)], "grp long, pieces int, base int")
    units = rows.join(F.broadcast(singles), "grp", "left").select(
        "row", "id", "size", "crc", "tokens", F.coalesce(F.col("base") + F.pmod(F.xxhash64("row"), F.col("pieces")), F.pmod(F.xxhash64("grp", F.lit(7)), F.lit(UNITS))).cast("int").alias("unit")
    )
    loads = units.groupBy("unit").agg(*load).orderBy("unit").collect()
    shard_of = place(np.array([[r["size"], r["tokens"], r["n"]] for r in loads], dtype=float).reshape(-1, 3), shards)
    filled = [0] * shards
    placed = []
    for r, s in zip(loads, shard_of.tolist(), strict=True):
        placed.append((r["unit"], s, filled[s]))
        filled[s] += r["n"]
    places = spark.createDataFrame(placed, "unit int, shard int, before long")
    within = Window.partitionBy("unit").orderBy("id", "row")
    return (
        units.withColumn("k", F.row_number().over(within))
        .join(F.broadcast(places), "unit")
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "tokens", "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"))
    )
