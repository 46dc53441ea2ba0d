"""Corpus-wide n-gram statistics by two all-to-all exchanges.

Documents are dealt by a hash of id and text into blocks of about BLOCK_BYTES,
whatever the size of the table. Each block sends the distinct n-gram hashes of its documents, with their counts, to
shards chosen by the hash; a shard adds the counts up over all blocks and sends
an answer for every hash back to each block that asked, in the order asked, so
answers carry no keys. A frequent n-gram costs each block one entry however
often it occurs, so no key is hot. Nothing passes through the driver but the
table's size in bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm import eliasfano

KEY_BITS = 40
#: text of one block, and text for each shard; both stay the same for a table of any size
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
MESSAGE = "shard int, block int, level int, keys binary, counts binary"
ANSWER = "block int, shard int, level int, codes binary"


def block_count(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Blocks of BLOCK_BYTES of text, and shards of SHARD_BYTES; no fewer than shuffle partitions, if the table is not tiny."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    least = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (1 << 18)))
    return max(1, -(-total // BLOCK_BYTES), least), max(1, -(-total // SHARD_BYTES), least)


def in_blocks(docs: DataFrame, id_col: str, text_col: str, n: int, *more: Column, key: Column | None = None) -> DataFrame:
    """(block, doc_id, text) and more columns, dealt by a hash of id and text, or by `key`, into n blocks."""
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)) if key is None else key, F.lit(n)).cast("int")
    return docs.select(block.alias("block"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more).repartition(n, "block")


def split(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 40-bit key of 64-bit hashes."""
    return ((hashes >> np.uint64(KEY_BITS)) % np.uint64(shards)).astype(np.int64), hashes & np.uint64((1 << KEY_BITS) - 1)


def coded(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard and key as one code that sorts by both."""
    shard, key = split(hashes, shards)
    return (shard.astype(np.uint64) << np.uint64(KEY_BITS)) | key


def messages(block: int, level: int, codes: np.ndarray, counts: np.ndarray, shards: int, every: bool = False) -> list[tuple]:
    """Rows of MESSAGE for a block's sorted distinct codes and their counts; with `every`, one for each shard."""
    bounds = np.searchsorted(codes, np.arange(shards + 1, dtype=np.uint64) << np.uint64(KEY_BITS))
    keys = codes & np.uint64((1 << KEY_BITS) - 1)
    counts = counts.astype(np.uint32)  # of one block; totals are 64 bit
    return [
        (s, block, level, eliasfano.encode(keys[a:b]), zlib.compress(counts[a:b].tobytes(), 1))
        for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        if b > a or every
    ]


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


MESSAGE_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("level", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER_ARROW = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("level", pa.int32()), ("codes", pa.binary())])


def totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    every = np.concatenate(keys)
    if not len(every):
        return every, np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[first], np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], first)


def opened(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys and counts of each message."""
    return [eliasfano.decode(x.as_buffer()) for x in rows["keys"]], [np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32) for x in rows["counts"]]


def answer(sent: DataFrame, reply: Callable[[int, np.ndarray, np.ndarray, list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """Rows of ANSWER: reply(level, keys, totals, asked) gives an array of codes for each asked array of keys."""

    def shard(rows: pa.Table) -> pa.Table:
        out = []
        level = np.asarray(rows["level"])
        for n in np.unique(level):
            mine = rows.filter(pa.array(level == n))
            asked, counts = opened(mine)
            keys, total = totals(asked, counts)
            for b, s, codes in zip(mine["block"].to_pylist(), mine["shard"].to_pylist(), reply(int(n), keys, total, asked), strict=True):
                out.append((b, s, int(n), zlib.compress(codes.tobytes(), 1)))
        return table(out, ANSWER_ARROW)

    return sent.groupBy("shard").applyInArrow(shard, ANSWER)


def received(answers: pa.Table, level: int, dtype) -> np.ndarray:
    """A block's answers for one level, in the order of its sorted codes."""
    mine = answers.filter(pa.array(np.asarray(answers["level"]) == level)).sort_by("shard")
    parts = [np.frombuffer(zlib.decompress(x.as_buffer()), dtype) for x in mine["codes"]]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
