"""Quality classifier by importance resampling with hashed n-gram models.

Two generative models over hashed n-grams are fitted: one on text labelled good
(the target), one on all raw text. A document's weight is the log ratio of the
two, over the root of its n-grams; documents are then sampled by Gumbel top-k.

The n-grams are those of one and two words of the text, and, as bad text may be
made of the same words, of one to three word symbols: how long ago the word last
occurred in the document, and its shape (capitals, marks, letters).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm import textkernel
from latticework.session import checkpointed

#: hash buckets of the word n-grams, and as many of the symbol n-grams
HALF = 1 << 16
BUCKETS = 2 * HALF
_SYMBOLS = 14 * 16


def symbols(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A symbol of each word."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    h = textkernel.mix64(hashes + row * np.uint64(0x9E3779B97F4A7C15))
    width = np.uint64(max(1, int(n - 1).bit_length()))
    tagged = np.sort(((h >> width) << width) | np.arange(n, dtype=np.uint64))
    at = (tagged & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    same = np.flatnonzero((tagged[1:] >> width) == (tagged[:-1] >> width))
    gap = np.zeros(n, dtype=np.int64)
    gap[at[same + 1]] = at[same + 1] - at[same]
    recency = np.minimum(np.frexp(gap.astype(np.float64))[1], 13)
    upper = np.concatenate(([0], np.cumsum((buf >= 65) & (buf <= 90), dtype=np.int32)))
    letter = np.concatenate(([0], np.cumsum((((buf | 32) >= 97) & ((buf | 32) <= 122)) | (buf >= 128), dtype=np.int32)))
    capitals, letters = upper[ends] - upper[starts], letter[ends] - letter[starts]
    marks = (ends - starts) - letters
    shape = (capitals > 1) + 2 * (marks >= 2) + 4 * (marks == 1) + 8 * (letters == 0)
    return recency * 16 + shape


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the n-grams that end at each word (-1 across rows), and first words."""
    begins, ends, first = textkernel.word_bounds(buf, offs, textkernel.SPACE_WORD)
    words = textkernel.hash_spans(buf, begins, ends)
    s = symbols(buf, begins, ends, first, words).astype(np.uint64)
    starts = np.zeros(len(s) + 1, bool)
    starts[first] = True
    pairs = np.concatenate((np.zeros(min(1, len(words)), np.uint64), textkernel.gram_hash(words, 2)))
    out = [(words >> np.uint64(48)).astype(np.int64), np.where(starts[:-1], -1, (pairs >> np.uint64(48)).astype(np.int64))]
    ahead = np.zeros(len(s), bool)  # whether an n-gram that ends here begins before its row
    code = s
    for n in range(3):
        if n:
            ahead |= np.concatenate((np.zeros(min(n - 1, len(s)), bool), starts[: max(0, len(s) - n + 1)]))
            code = code + s_before(s, n) * np.uint64(_SYMBOLS**n)
        bucket = (((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
        out.append(np.where(ahead, -1, HALF + bucket))
    return out, first


def s_before(s: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate((np.zeros(min(n, len(s)), s.dtype), s[: max(0, len(s) - n)]))


def _counts(batches):
    raw, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        buf, offs = textkernel.flat(batch["text"])
        good = np.asarray(batch["good"])
        for lo, hi in textkernel.chunks(offs):
            found, first = grams(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            mine = np.repeat(good[lo:hi], np.diff(first)).astype(bool)
            for g in found:
                raw += np.bincount(g + 1, minlength=BUCKETS + 1)
                if mine.any():
                    target += np.bincount(g[mine] + 1, minlength=BUCKETS + 1)
    used = np.flatnonzero(raw[1:])
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(raw[1:][used]), pa.array(target[1:][used])], names=["bucket", "raw", "target"])


def log_weights(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """Log ratio over the root of the n-grams of each row; -inf for a row without words."""
    buf, offs = textkernel.flat(column)
    out = np.full(len(offs) - 1, -np.inf)
    for lo, hi in textkernel.chunks(offs):
        found, first = grams(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        total = np.concatenate(([0.0], np.cumsum(sum(ratio[g] for g in found))))
        n = np.diff(first)
        some = n > 0
        out[lo:hi][some] = ((total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(5 * n - 4, 1)))[some]
    return out


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to clash with no column, in any case."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def with_log_weight(docs: DataFrame, ratio: np.ndarray, name: str, text_col: str = "text") -> DataFrame:
    """`docs` with a column of log weights; the name must be free."""
    model = docs.sparkSession.sparkContext.broadcast(ratio)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(log_weights(batch.column(at), model.value))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


class Model:
    """Log ratio of each bucket (one more, 0, for no n-gram) and the least weight taken for good."""

    def __init__(self, ratio: np.ndarray, least: float):
        self.ratio, self.least = ratio, least


def fit(docs: DataFrame, labels: DataFrame, most: int = 10_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The two n-gram models and the weight that parts good from bad.

    Raw counts cover all documents. Target counts, and the parting weight, come
    from at most `most` labelled rows of each class, those of the least id hash.
    Without rows of both classes every document with a word is good.
    """
    sample = []
    for label in (0, 1):
        rows = labels.where((F.col(label_col) == label) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("k")).distinct()
        sample += [(r["k"], label) for r in rows.orderBy(F.xxhash64("k"), "k").limit(most).collect()]
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    picked = F.broadcast(spark.createDataFrame(sample, f"k {kind}, label int").groupBy("k").agg(F.min("label").alias("label")))
    slim = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(picked, "k", "left")
    rows = slim.select("text", F.coalesce(F.col("label") == 1, F.lit(False)).alias("good")).mapInArrow(_counts, "bucket int, raw long, target long")
    raw, target = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.append(np.log(target / target.sum()) - np.log(raw / raw.sum()), 0.0)
    judged = with_log_weight(slim.where("label is not null").select("label", "text"), ratio, "w").where(F.col("w") > float("-inf")).select("label", "w").collect()
    w, y = np.array([r["w"] for r in judged]), np.array([r["label"] for r in judged])
    if len(set(y.tolist())) < 2:
        return Model(ratio, float("-inf"))
    order = np.argsort(w, kind="stable")
    w, y = w[order], y[order]
    # errors of each share when the first i rows are bad, both classes alike
    errors = np.concatenate(([0], np.cumsum(y == 1))) / (y == 1).sum() + (1 - np.concatenate(([0], np.cumsum(y == 0))) / (y == 0).sum())
    i = int(np.argmin(errors))
    return Model(ratio, float("-inf") if i == 0 else float(w[-1]) if i == len(w) else float((w[i - 1] + w[i]) / 2))


def gumbel(key: Column, seed: int = 5) -> Column:
    """Standard Gumbel noise that depends on the key and the seed alone."""
    uniform = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_highest(keys: DataFrame, k: int, bins: int = 4096, held: int = 10_000) -> float:
    """The k-th highest value of the column `key`, by refining global histograms."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        width = (hi - lo) / bins
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        if width <= 0 or lo + width == lo:
            return lo
        counts = inside.groupBy(F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)).alias("b")).count().orderBy(F.col("b").desc()).collect()
        for r in counts:
            if k <= r["count"]:
                break
            k -= r["count"]
        mine = inside.where(F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)) == r["b"])
        if r["count"] <= held:
            return mine.orderBy(F.col("key").desc()).limit(k).agg(F.min("key")).first()[0]
        lo, hi = mine.agg(F.min("key"), F.max("key")).first()


def _sampled(docs: DataFrame, model: Model, k: int | None, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, str, str, Column]:
    """`docs` with the weight and the key under free names, these names, and whether a row is kept."""
    weight, noisy = free_name(docs, "log_weight"), free_name(docs, "gumbel_key")
    noise = gumbel(F.col(id_col), seed)
    slim = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    keys = checkpointed(with_log_weight(slim, model.ratio, "w").select("w", (F.col("w") + noise).alias("key")).where(F.col("w") > float("-inf")))
    if k is None:
        k = keys.where(F.col("w") >= model.least).count()
    cut = kth_highest(keys, k) if 0 < k <= keys.count() else (float("inf") if k <= 0 else float("-inf"))
    scored = with_log_weight(docs, model.ratio, weight, text_col).withColumn(noisy, F.col(weight) + noise)
    return scored, weight, noisy, (F.col(weight) > float("-inf")) & (F.col(noisy) >= cut)


def resample(docs: DataFrame, model: Model, k: int | None = None, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with log_weight, gumbel_key and kept: the Gumbel top-k sample by weight.

    The default k is the number of documents of at least the model's parting
    weight. Rows without a word, null and empty texts among them, have weight
    -inf and are never kept. Rows with equal ids share their noise, so repeated
    rows are kept or dropped together, as are those with null ids and equal
    weights; ties at the k-th key are all kept. An empty table gives no rows; a
    text of any length is weighed whole. Other columns stay as they are, but one
    named log_weight, gumbel_key or kept is replaced.
    """
    docs = docs.drop(*({"log_weight", "gumbel_key", "kept"} - {id_col, text_col}))
    scored, weight, noisy, kept = _sampled(docs, model, k, seed, id_col, text_col)
    return scored.withColumn("kept", kept)


def sampled(docs: DataFrame, model: Model, k: int | None = None, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the sample keeps (see `resample`), with all of their columns and no other."""
    scored, _, _, kept = _sampled(docs, model, k, seed, id_col, text_col)
    return scored.where(kept).select(*(F.col(f"`{c}`") for c in docs.columns))
