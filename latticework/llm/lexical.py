"""Ranked lexical search with norm buckets.

A document's impact vector holds, for each term that some query asks for, the
term's weight times its damped frequency, so a score is the sum over a query's
terms. Vectors are ordered by length over the whole table and cut into buckets.
The longest range gives each query a first threshold, its k-th best score so
far. In every bucket a query is skipped where Cauchy-Schwarz, or the sum of the
bucket's greatest coordinates, stays below its threshold; inside, a vector has to
reach it by the coordinates that matter most plus what the rest can add. What
survives is scored anew exactly in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm import textkernel
from latticework.session import checkpointed

#: query text that one pass broadcasts; more takes further passes
QUERY_BYTES = 8 << 20
#: vectors of one bucket, and entries (term and frequency) of one range
BUCKET, RANGE_ENTRIES = 4096, 4 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "doc_id long, n long, terms array<int>, freqs array<long>, docs long, words long, term int, df long"
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", _INTS), ("freqs", _LONGS), ("docs", pa.int64()), ("words", pa.int64()), ("term", pa.int32()), ("df", pa.int64())])


def _partial(**columns) -> pa.RecordBatch:
    """Rows of _FOUND with nulls in all other columns."""
    n = len(next(iter(columns.values())))
    return pa.record_batch([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND_ARROW], schema=_FOUND_ARROW)


def _matched(vocabulary):
    """For each document with one of the terms: its length, those terms and their frequencies; at the end totals and document counts."""

    def run(batches):
        terms = pa.array(vocabulary.value, pa.binary())
        size = len(terms)
        df, docs, words = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            ids, text = batch["id"], batch["text"].cast(pa.binary())
            _, offs = textkernel.flat(text)
            for lo, hi in textkernel.chunks(offs):
                buf, at = textkernel.flat(text[lo:hi])
                buf = textkernel.LOWER[buf]
                starts, ends, first = textkernel.word_bounds(buf, at, textkernel.ALNUM_WORD)
                n = np.diff(first)
                docs, words = docs + int((n > 0).sum()), words + len(starts)
                if not len(starts) or not size:
                    continue
                bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
                spelled = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf[textkernel.ALNUM_WORD[buf]]))])
                term = np.asarray(pc.fill_null(pc.index_in(spelled, value_set=terms), -1))
                row = np.repeat(np.arange(hi - lo), n)[term >= 0]
                code, freq = np.unique(row * np.int64(size) + term[term >= 0], return_counts=True)
                term, row = code % size, code // size
                df += np.bincount(term, minlength=size)
                some, begin = np.unique(row, return_index=True)
                if len(some):
                    cuts = pa.array(np.append(begin, len(row)).astype(np.int32))
                    yield _partial(
                        doc_id=ids[lo:hi].take(pa.array(some)), n=pa.array(n[some]), terms=pa.ListArray.from_arrays(cuts, pa.array(term.astype(np.int32))), freqs=pa.ListArray.from_arrays(cuts, pa.array(freq.astype(np.int64)))
                    )
        yield _partial(docs=pa.array([docs]), words=pa.array([words]))
        seen = np.flatnonzero(df)
        if len(seen):
            yield _partial(term=pa.array(seen), df=pa.array(df[seen]))

    return run


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _impacts(n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, freqs: np.ndarray, weights: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Weight times damped frequency of every entry, in integers."""
    m = 10 + (90 * n * docs) // words
    return weights[terms] * ((1_000_000_000 * freqs) // (1000 * freqs + 8 * np.repeat(m, sizes)))


def _vectors(batch, weights, docs, words):
    sizes = np.asarray(batch["terms"].value_lengths(), dtype=np.int64)
    terms = np.asarray(batch["terms"].flatten())
    return sizes, terms, _impacts(np.asarray(batch["n"]), sizes, terms, np.asarray(batch["freqs"].flatten()), weights, docs, words)


def _lengths(state):
    def run(batches):
        weights, docs, words = state.value
        for batch in batches:
            sizes, _, impact = _vectors(batch, weights, docs, words)
            row = np.repeat(np.arange(len(sizes)), sizes)
            square = np.bincount(row, weights=impact.astype(float) ** 2, minlength=len(sizes))
            yield pa.record_batch([*(batch[c] for c in ("doc_id", "n", "terms", "freqs")), pa.array(np.sqrt(square) * (1 + 1e-9))], names=["doc_id", "n", "terms", "freqs", "norm"])

    return run


class _Bucket:
    """Vectors in order of falling length, by coordinates."""

    def __init__(self, ids, known, norms, sizes, terms, impact):
        self.ids, self.known, self.norms = ids, known, norms
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(order) else np.zeros(0, np.int64)

    def entries(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.doc[self.starts[t] : self.ends[t]], self.impact[self.starts[t] : self.ends[t]]

    def reaching(self, asked: np.ndarray, root: float, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors whose sum over the asked coordinates is at least `floor`, above 0, and the sums."""
        asked = asked[np.argsort(-self.most[asked], kind="stable")]
        rest = np.append(np.cumsum(self.most[asked][::-1])[::-1], 0)
        # the first coordinates, until those left cannot reach the floor by themselves
        focus = max(1, int((rest >= max(floor, 1)).sum()))
        last = int(np.searchsorted(-self.norms * root, -float(floor), "right"))  # lengths that Cauchy-Schwarz allows
        part = np.zeros(len(self.ids), np.int64)
        for t in asked[:focus]:
            doc, impact = self.entries(t)
            part[doc] += impact
        able = np.flatnonzero((part[:last] > 0) & (part[:last] + rest[focus] >= floor))
        total = part[able]
        for t in asked[focus:]:
            doc, impact = self.entries(t)
            at = np.minimum(np.searchsorted(doc, able), len(doc) - 1)
            total += np.where(doc[at] == able, impact[at], 0)
        good = total >= max(floor, 1)
        return able[good], total[good]


def _buckets(batches, weights, docs, words) -> Iterator[_Bucket]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BUCKET):
            part = batch.slice(lo, BUCKET)
            yield _Bucket(np.asarray(pc.fill_null(part["doc_id"], 0)), np.asarray(part["doc_id"].is_valid()), np.asarray(part["norm"]), *_vectors(part, weights, docs, words))


def _best(state, k: int):
    """(q, doc_id, score): the task's k best vectors of each query that reach its threshold."""

    def run(batches):
        weights, docs, words, terms, bounds, floors = state.value
        floors = floors.copy()
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        query = np.repeat(np.arange(len(floors)), np.diff(bounds))
        root = np.sqrt(np.diff(bounds)) * (1 + 1e-9)
        for bucket in _buckets(batches, weights, docs, words):
            at = np.minimum(np.searchsorted(bucket.terms, terms), len(bucket.terms) - 1)
            there = bucket.terms[at] == terms
            most = np.zeros(len(floors), np.int64)
            np.add.at(most, query[there], bucket.most[at[there]])
            ends = np.concatenate(([0], np.cumsum(there)))[bounds]
            slots = at[there]
            for q in np.flatnonzero((most > 0) & (most >= floors) & (root * bucket.norms[0] >= floors)).tolist():
                rows, score = bucket.reaching(slots[ends[q] : ends[q + 1]], root[q], int(floors[q]))
                if not len(rows):
                    continue
                new = bucket.ids[rows], bucket.known[rows], score
                ids, known, score = (np.concatenate(x) for x in zip(held[q], new, strict=True)) if q in held else new
                top = np.lexsort((ids, ~known, -score))[:k]
                held[q] = ids[top], known[top], score[top]
                if len(top) == k:
                    floors[q] = max(int(floors[q]), int(score[top[-1]]))
        for q, (ids, known, score) in held.items():
            yield pa.record_batch([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, pa.int64(), mask=~known), pa.array(score)], names=["q", "doc_id", "score"])

    return run


def query_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, terms): the distinct terms of each item."""
    return items.select(F.col(item_col).alias("item"), F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(TERM), 0)).alias("terms"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the k documents of highest score for each item.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII,
    A-Z lower-cased. With N documents that have a term, L terms in all of them,
    n in one, and a term's frequency tf in it and df documents that hold it, a
    document's score sums, over the item's terms once each,
    floor(1000 ln((2N+2)/(2df+1))) * (1000000000 tf div (1000 tf + 8 m)), with
    m = 10 + 90 n N div L. Documents of score 0 are left out; equal scores go by
    ascending id.

    A null or empty text has no terms and is found by none; an item without
    terms has no rows. Every row is an item or a document of its own, however
    often an id or a text repeats; null item ids stay null, null document ids
    come last among equals. An empty table gives no rows, texts of any length
    count whole, other columns are not read, and document ids have to be
    integers. Items are taken in passes of `QUERY_BYTES` of terms.
    """
    asked = checkpointed(query_terms(items, item_col, item_text_col).where(F.size("terms") > 0).withColumn("row", F.monotonically_increasing_id()))
    total = asked.agg(F.sum(F.octet_length(F.array_join("terms", " ")))).first()[0] or 0
    passes = -(-total // QUERY_BYTES)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = [checkpointed(_one_pass(given, asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p), k)) for p in range(passes)]
    names = asked.select("row", F.col("item").alias(item_col))
    if not found:
        return names.select(item_col, F.lit(0).alias("rank"), F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("score")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.join(names, "row").select(item_col, "rank", F.col("doc_id").alias(id_col), "score")


def _one_pass(given: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = given.sparkSession
    sc = spark.sparkContext
    rows = asked.select("row", "terms").orderBy("row").collect()
    vocabulary = sorted({t.encode() for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    words_sent = sc.broadcast(vocabulary)
    matched = checkpointed(given.mapInArrow(_matched(words_sent), _FOUND))
    words_sent.unpersist()
    totals = matched.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n_docs, n_words = totals["docs"] or 0, totals["words"] or 0
    empty = spark.createDataFrame([], "row long, rank int, doc_id long, score long")
    if not n_docs:
        return empty
    weights = np.zeros(len(vocabulary), np.int64)
    for r in matched.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect():
        weights[r["term"]] = weight(r["df"], n_docs)
    sent = sc.broadcast((weights, n_docs, n_words))
    vectors = matched.where("n is not null").select("doc_id", "n", "terms", "freqs").mapInArrow(_lengths(sent), "doc_id long, n long, terms array<int>, freqs array<long>, norm double")
    vectors = vectors.where("norm > 0").withColumn("place", F.monotonically_increasing_id())
    entries = matched.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    ranges = max(1, -(-entries // RANGE_ENTRIES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), entries >> 16))
    # equal lengths, as copies have, are spread by place
    ordered = checkpointed(vectors.repartitionByRange(ranges, F.col("norm").desc(), "place").sortWithinPartitions(F.col("norm").desc()).drop("place").withColumn("range", F.spark_partition_id()))
    flat = np.array([number[t.encode()] for r in rows for t in r["terms"]], dtype=np.int32)
    bounds = np.concatenate(([0], np.cumsum([len(r["terms"]) for r in rows])))
    floors = np.zeros(len(rows), np.int64)
    schema = "q int, doc_id long, score long"

    def best(part: DataFrame) -> DataFrame:
        state = sc.broadcast((weights, n_docs, n_words, flat, bounds, floors))
        return part.drop("range").mapInArrow(_best(state, k), schema)

    longest = checkpointed(best(ordered.where("range = 0")))
    for r in longest.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect():
        floors[r["q"]] = r["least"]
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = longest.unionByName(best(ordered.where("range > 0"))).withColumn("rank", place).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(rows)], "q int, row long")
    return ranked.join(names, "q").select("row", "rank", "doc_id", "score")
