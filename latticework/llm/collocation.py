"""Phrase collocation mining with counting quotient filters.

Texts are cut into chunks of bounded size. A chunk's words become local numbers;
words that are frequent over the whole corpus get ids, and only runs of such
words can hold a frequent phrase. Each chunk sends its bigrams as sorted
counting quotient filters, one for each shard (a range of permuted keys); a
shard merges the filters, keeps the frequent keys, and answers each chunk with
one bit a key it sent, in the order sent. Phrases of three and four words are
then counted the same way, only where all their bigrams are frequent. Scores
and what longer phrases absorb are joins among frequent phrases.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm import quotient, textkernel
from latticework.session import checkpointed

#: text of one chunk, and text for each shard
CHUNK_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
LONGEST = 4
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_BREAKS
_WORD[[0x20, 0x09]] = False

_CODED = "chunk long, at int, lang string, word string, n long, codes binary"
_CODED_ARROW = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("codes", pa.binary())])
_SEQ = "chunk long, ids binary"
_SEQ_ARROW = pa.schema([("chunk", pa.int64()), ("ids", pa.binary())])
_SENT = "shard int, chunk long, words int, keys binary"
_SENT_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("words", pa.int32()), ("keys", pa.binary())])
_MERGED = "chunk long, shard int, bits binary, w1 long, w2 long, w3 long, w4 long, f long"
_MERGED_ARROW = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("bits", pa.binary()), *((f"w{i}", pa.int64()) for i in range(1, 5)), ("f", pa.int64())])
_IDS = ["w1", "w2", "w3", "w4"]


def _words(lang: pa.Array, text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Local codes (0 between pieces), and for code i + 1 the word, the row of `lang` it stands in, and its count."""
    buf, offs = textkernel.flat(text)
    buf = textkernel.LOWER[buf]
    starts, ends, first = textkernel.word_bounds(buf, offs, _WORD)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(buf[_WORD[buf]]))]).dictionary_encode()
    langs = lang.dictionary_encode()
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pair = np.asarray(words.indices).astype(np.int64) * max(1, len(langs.dictionary)) + np.asarray(langs.indices)[row]
    _, some, code, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
    cut = np.concatenate(([0], np.cumsum(_BREAKS[buf])))
    fresh = np.ones(n, bool)
    fresh[1:] = (cut[starts[1:]] > cut[ends[:-1]]) | (row[1:] != row[:-1])
    out = np.zeros(n + int(fresh.sum()), np.uint32)
    out[np.arange(n) + np.cumsum(fresh)] = code + 1
    named = words.dictionary.take(words.indices.take(pa.array(some)))
    return out, named.cast(pa.string()), row[some], count


def _code(batches):
    context = TaskContext.get()
    chunk = (context.partitionId() if context else 0) << 32
    held, size = [], 0

    def coded():
        nonlocal chunk
        lang, text = (pa.concat_arrays([h[i] for h in held]) for i in range(2))
        codes, word, row, count = _words(lang, text)
        chunk += 1
        m = len(word)
        yield pa.record_batch([pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([_squeezed(codes)], pa.binary())], schema=_CODED_ARROW)
        yield pa.record_batch([pa.array(np.full(m, chunk)), pa.array(np.arange(m, dtype=np.int32)), lang.take(pa.array(row)), word, pa.array(count.astype(np.int64)), pa.nulls(m, pa.binary())], schema=_CODED_ARROW)

    for batch in batches:
        lang, text = batch["lang"].cast(pa.string()), batch["text"].cast(pa.binary())
        _, offs = textkernel.flat(text)
        for lo, hi in textkernel.chunks(offs, CHUNK_BYTES):
            held.append((lang[lo:hi], text[lo:hi]))
            size += int(offs[hi] - offs[lo])
            if size >= CHUNK_BYTES // 2:
                yield from coded()
                held, size = [], 0
    if held:
        yield from coded()


def _squeezed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, dtype="<u4").tobytes(), 1)


def _opened(x) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x.as_buffer()), "<u4")


def _identified(rows: pa.Table, ids: pa.Table) -> pa.Table:
    """A chunk's codes as ids of frequent words; 0 for all else."""
    if not rows.num_rows:
        return _SEQ_ARROW.empty_table()
    codes = _opened(rows["codes"][0])
    name = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)
    name[np.asarray(ids["at"]) + 1] = np.asarray(ids["id"]).astype(np.uint32)
    out = name[codes]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)  # one 0 stands for several
    return pa.table([rows["chunk"], pa.array([_squeezed(out[keep])], pa.binary())], schema=_SEQ_ARROW)


def _sent(chunk: int, ids: np.ndarray, at: np.ndarray, words: int, bits: int, shards: int) -> tuple[list[tuple], np.ndarray]:
    """A chunk's filters of the n-grams that begin at `at`, and each one's number among the distinct ones."""
    keys, counts, inverse = quotient.counted(quotient.permuted([ids[at + i] for i in range(words)], bits))
    high, low = quotient.key_bits(words, bits)
    step, begins = quotient.ranges(high, shards)
    bounds = [*np.searchsorted(keys.high, np.array(begins, dtype=np.uint64)).tolist(), len(counts)]
    out = [
        (s, chunk, words, quotient.encode(keys.take(slice(a, b)), counts[a:b], begin, step, low))
        for s, (begin, a, b) in enumerate(zip(begins, bounds[:-1], bounds[1:], strict=True))
        if b > a
    ]
    return out, inverse


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _bigrams(bits: int, shards: int):
    def run(batches):
        for batch in batches:
            for chunk, x in zip(batch["chunk"].to_pylist(), batch["ids"], strict=True):
                ids = _opened(x)
                at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
                yield from _table(_sent(chunk, ids, at, 2, bits, shards)[0], _SENT_ARROW).to_batches()

    return run


def _longer(bits: int, shards: int):
    def block(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _SENT_ARROW.empty_table()
        chunk, ids = rows["chunk"][0].as_py(), _opened(rows["ids"][0])
        at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
        _, _, inverse = quotient.counted(quotient.permuted([ids[at], ids[at + 1]], bits))
        answers = answers.sort_by("shard")
        known = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in answers["bits"]]) if answers.num_rows else np.zeros(0, np.uint8)
        frequent = np.zeros(len(ids) + LONGEST, bool)
        frequent[at] = known[inverse] != 0
        out = []
        for words in range(3, LONGEST + 1):
            begins = np.flatnonzero(np.logical_and.reduce([frequent[i : len(ids) + i] for i in range(words - 1)]))
            out += _sent(chunk, ids, begins, words, bits, shards)[0]
        return _table(out, _SENT_ARROW)

    return block


def _merge(bits: int, least: int, reply: bool):
    def shard(rows: pa.Table) -> pa.Table:
        parts = []
        number = rows["shard"][0].as_py()
        sizes = np.asarray(rows["words"])
        for words in np.unique(sizes).tolist():
            mine = rows.filter(pa.array(sizes == words))
            keys, total, places = quotient.merged([x.as_buffer() for x in mine["keys"]])
            keep = total >= least
            if reply:
                out = [(c, number, keep[p].astype(np.uint8).tobytes(), None, None, None, None, None) for c, p in zip(mine["chunk"].to_pylist(), places, strict=True)]
                parts.append(_table(out, _MERGED_ARROW))
            ids = quotient.restored(keys.take(keep), words, bits)
            m = int(keep.sum())
            columns = [pa.array(x.astype(np.int64)) for x in ids] + [pa.array(np.zeros(m, np.int64))] * (LONGEST - words)
            parts.append(pa.table([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), *columns, pa.array(total[keep])], schema=_MERGED_ARROW))
        return pa.concat_tables(parts)

    return shard


def frequent_phrases(docs: DataFrame, min_count: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of one to four words that occur `min_count` times or more in texts of one language.

    Returns (w1, w2, w3, w4, words, f) by word ids, 0 where there is no word;
    (id, lang, word); and (lang, n) with all word occurrences of each language.
    """
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = given.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = max(1, -(-size // SHARD_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (1 << 18))))
    coded = checkpointed(given.mapInArrow(_code, _CODED))
    local = coded.where("codes is null")
    counts = checkpointed(local.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    # ids: the rows of each partition of the written counts are numbered, with equal room for every partition
    kept = checkpointed(counts.where(F.col("n") >= min_count))
    numbered = kept.withColumn("at", F.monotonically_increasing_id())
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    most = numbered.agg((F.max(row) + 1).alias("rows"), (F.max(part) + 1).alias("parts")).first()
    room = most["rows"] or 1
    bits = int(room * (most["parts"] or 1)).bit_length()
    if bits > 32:
        raise ValueError("more than 4,000,000,000 frequent words")
    words = numbered.select((part * room + row + 1).alias("id"), "lang", "word", "n")

    ids = local.select(F.col("chunk").alias("of"), "at", "lang", "word").join(words.select("id", "lang", "word"), ["lang", "word"]).select("of", "at", "id")
    sequences = checkpointed(coded.where("codes is not null").select("chunk", "codes").groupBy("chunk").cogroup(ids.groupBy("of")).applyInArrow(_identified, _SEQ))
    pairs = checkpointed(sequences.mapInArrow(_bigrams(bits, shards), _SENT).groupBy("shard").applyInArrow(_merge(bits, min_count, True), _MERGED))
    answers = pairs.where("bits is not null").select("chunk", "shard", "bits")
    sent = sequences.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_longer(bits, shards), _SENT)
    longer = sent.groupBy("shard").applyInArrow(_merge(bits, min_count, False), _MERGED)
    none = F.lit(0).cast("long")
    found = pairs.where("f is not null").select(*_IDS, "f").unionByName(longer.select(*_IDS, "f")).unionByName(words.select(F.col("id").alias("w1"), none.alias("w2"), none.alias("w3"), none.alias("w4"), F.col("n").alias("f")))
    length = F.when(F.col("w4") > 0, 4).when(F.col("w3") > 0, 3).when(F.col("w2") > 0, 2).otherwise(1)
    return checkpointed(found.withColumn("words", length)), words.select("id", "lang", "word"), totals


def _part(begin, n):
    """w1 to w4 of the `n` words from place `begin` (1 is the first) of a phrase."""
    words = F.array(*_IDS)
    return [F.when(F.lit(i) < n, F.try_element_at(words, begin + i)).otherwise(F.lit(0)).cast("long").alias(f"w{i + 1}") for i in range(LONGEST)]


def scored(phrases: DataFrame) -> DataFrame:
    """(w1, w2, w3, w4, words, a, l, r, score) of phrases of two words and more, by the cut of lowest score; absorbed ones are left out."""
    several = phrases.where("words > 1").withColumnRenamed("f", "a")
    sizes = phrases.select(*(F.col(c).alias(f"p{c}") for c in _IDS), "f")

    def looked_up(rows: DataFrame, name: str) -> DataFrame:
        same = [F.col(f"{name}.{c}") == F.col(f"p{c}") for c in _IDS]
        return rows.join(sizes.withColumnRenamed("f", f"{name}_f"), same).drop(*(f"p{c}" for c in _IDS))

    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.struct(*_part(F.lit(1), F.col("k")))).withColumn("rest", F.struct(*_part(F.col("k") + 1, F.col("words") - F.col("k"))))
    both = looked_up(looked_up(cuts, "first"), "rest")
    # exact beyond 64 bits
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(first_f as decimal(20,0)) + rest_f)")
    best = both.groupBy(*_IDS, "words", "a").agg(F.min(F.struct(score.alias("score"), "k", F.col("first_f").alias("l"), F.col("rest_f").alias("r"))).alias("c"))

    inside = several.where("words > 2").select(F.explode(F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> struct(n as n, i as i))))")).alias("s"), *_IDS, "a")
    held = inside.select(*_part(F.col("s.i"), F.col("s.n")), "a").groupBy(*_IDS).agg(F.max("a").alias("longer"))
    return best.join(held, _IDS, "left").where("longer is null or 5 * longer < 4 * a").select(*_IDS, "words", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two to four words.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and
    pieces into words at spaces and tabs. A phrase occurs wherever its words
    follow one another in a piece; it takes part with `min_count` occurrences
    a. Cut in two, it scores 2000000 * a div (l + r), l and r being the
    occurrences of its parts; its lowest cut counts, of equal ones the first.
    Phrases inside a longer one with 80 in 100 of their occurrences are left
    out. Equal scores rank by a, then by phrase in byte order.

    A null text has no words, a null language is `und`, every row counts
    however often it repeats, ids and other columns are not read, a text of any
    length is read whole, and an empty table gives no rows. All counts are exact.
    """
    phrases, words, totals = frequent_phrases(docs, min_count, lang_col, text_col)
    in_lang = scored(phrases).join(words.select(F.col("id").alias("w1"), "lang"), "w1")
    order = [F.col("score").desc(), F.col("a").desc()]
    # all that ties with the last place stays until the words are known
    near = checkpointed(in_lang.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place"))
    spelled = near.select("lang", *_IDS, F.posexplode(F.filter(F.array(*_IDS), lambda w: w > 0)).alias("i", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy(*_IDS).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])).alias("phrase"))
    ranked = near.join(spelled, _IDS).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
