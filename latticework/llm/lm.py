"""LM scoring with a sharded Elias-Fano n-gram trie.

Documents lie in blocks; the n-grams of orders 1 to 3 of each block are sent to
shards (see `exchange`). A shard adds up the training counts, of all documents
that are not held out, and lays its n-grams out as a trie: for each order a
level of contexts, monotone pointers from a context to its words, a level of
words, which are coded relative to their context, and a value of each n-gram on
a logarithmic scale. The levels are written to one temporary file and mapped
into memory. A query finds the rank of its context by successor search, takes
the range of its words from the pointers, and searches the word in that range.

A value stands for two numbers: the n-gram's frequency, and its back-off weight
m / (n + m) as a context of longer ones. Dirichlet smoothing then mixes the
orders, p(w | c) = frequency(cw) * (1 - backoff(c)) / n(c) + backoff(c) * p'(w)
with p' of the next lower order, ending in one class of unknown words. No shard
holds all words of a context, so that no context is hot; the mix is therefore
taken where the text is, from the values of the n-gram and of its context.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm import eliasfano, exchange, textkernel

WORD_BITS = 18
ORDERS = 3
_END = np.uint64(0x1D8E4E27C47D124F)
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


#: fixed width of the low parts of a level of words, enough for the word of any context
_WORD_BYTES = -(-WORD_BITS // 8)


def quantise(counts: np.ndarray) -> np.ndarray:
    """8-bit codes: 0 to 31 exactly, then steps of about 9 percent."""
    counts = np.asarray(counts, dtype=np.float64)
    return np.where(counts < 32, counts, np.minimum(32 + np.round(8 * np.log2(np.maximum(counts, 32) / 32)), 255)).astype(np.uint8)


_VALUE = np.concatenate((np.arange(32.0), 32 * 2 ** (np.arange(224) / 8)))


class Trie:
    """One order's n-grams of one shard, as levels over a memory map."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        context, word = keys >> np.uint64(WORD_BITS), keys & np.uint64((1 << WORD_BITS) - 1)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), context[1:] != context[:-1])))
        rank = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(keys))))
        levels = [eliasfano.encode(context[first]), eliasfano.encode((rank << np.uint64(WORD_BITS)) | word, _WORD_BYTES), eliasfano.encode(np.append(first, len(keys)).astype(np.uint64)), quantise(counts).tobytes()]
        with tempfile.TemporaryFile() as file:
            file.write(b"".join(levels))
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) if sum(map(len, levels)) else b""
        at = np.cumsum([0, *map(len, levels)])
        view = np.frombuffer(self._map, np.uint8)
        self.contexts, self.words, self.pointers = (eliasfano.Sequence(view[a:b]) for a, b in zip(at[:3], at[1:4], strict=True))
        self.values = view[at[3] : at[4]]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, 0 where the trie has none."""
        rank, known = self.contexts.successor(keys >> np.uint64(WORD_BITS))
        out = np.zeros(len(keys), np.uint8)
        mine = np.flatnonzero(known)
        rank = rank[mine]
        word = (rank.astype(np.uint64) << np.uint64(WORD_BITS)) | (keys[mine] & np.uint64((1 << WORD_BITS) - 1))
        at, found = self.words.within(word, self.pointers.at(rank), self.pointers.at(rank + 1))
        out[mine[found]] = self.values[at[found]]
        return out


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, an end after each row, and n + 1 row bounds."""
    parts, sizes = [], []
    for lo, hi in textkernel.chunks(offs):
        part = buf[offs[lo] : offs[hi]]
        starts, ends, first = textkernel.word_bounds(part, offs[lo : hi + 1] - offs[lo], textkernel.SPACE_WORD)
        parts.append(np.insert(textkernel.hash_spans(part, starts, ends), first[1:], _END))
        sizes.append(np.diff(first) + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def _before(words: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """The word n places before each, a row's missing ones being a start mark."""
    out = np.full(len(words), np.uint64(7))
    out[n:] = words[:-n]
    start = np.repeat(bounds[:-1], np.diff(bounds))
    out[np.arange(len(words)) - start < n] = 7
    return out


def gram_codes(words: np.ndarray, bounds: np.ndarray, shards: int, orders: int = ORDERS) -> list[np.ndarray]:
    """Shard and key of the 1-, 2- and 3-gram that ends at each token.

    A key is the context's hash above the word's, so a shard's sorted keys lie
    context by context. The shard depends on both, so no context is hot.
    """
    out, context = [], np.full(len(words), np.uint64(11))
    for n in range(orders):
        if n:
            context = textkernel.mix64(context * np.uint64(0x9E3779B97F4A7C15) + _before(words, bounds, n))
        # unigrams differ by the word alone: its other bits stand for the context
        high = context if n else textkernel.mix64(words + np.uint64(3))
        key = ((high >> np.uint64(64 - exchange.KEY_BITS + WORD_BITS)) << np.uint64(WORD_BITS)) | (words >> np.uint64(64 - WORD_BITS))
        shard = textkernel.mix64(context ^ (words * np.uint64(0xC2B2AE3D27D4EB4F))) % np.uint64(shards)
        out.append((shard << np.uint64(exchange.KEY_BITS)) | key)
    return out


def _sent(part: int, level: int, code: np.ndarray, used: np.ndarray, shards: int) -> list[tuple]:
    order = np.argsort(code)
    code, used = code[order], used[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
    return exchange.messages(part, level, code[first], np.add.reduceat(used.astype(np.int64), first), shards, every=not level)


def _send(shards: int):
    def block(rows: pa.Table) -> pa.Table:
        words, bounds = tokens(*textkernel.flat(rows["text"]))
        trained = np.repeat(~np.asarray(rows["held"]), np.diff(bounds))
        out = []
        for n, code in enumerate(gram_codes(words, bounds, shards)):
            out += _sent(rows["block"][0].as_py(), n, code, trained, shards)
        return exchange.table(out, exchange.MESSAGE_ARROW)

    return block


def _reply(level, keys, total, asked):
    if level == 0:  # exact counts: the base score and the known words need them; before them the shard's distinct words and tokens
        exact = total.astype(np.uint64)
        sums = np.array([np.count_nonzero(exact), exact.sum(dtype=np.uint64)], np.uint64)
        return [np.concatenate((sums, exact[np.searchsorted(keys, x)])) for x in asked]
    seen = total > 0
    trie = Trie(keys[seen], total[seen])
    return [trie(x) for x in asked]


def _unigrams(answers: pa.Table) -> tuple[np.ndarray, int, int]:
    """Counts of a block's distinct words, and distinct words and tokens of all training rows: every shard answers every block."""
    mine = answers.filter(pa.array(np.asarray(answers["level"]) == 0)).sort_by("shard")
    parts = [np.frombuffer(zlib.decompress(x.as_buffer()), np.uint64) for x in mine["codes"]]
    return np.concatenate([x[2:] for x in parts]), sum(int(x[0]) for x in parts), sum(int(x[1]) for x in parts)


def _scores(shards: int, weight: float):
    def block(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _OUT_ARROW.empty_table()
        words, bounds = tokens(*textkernel.flat(rows["text"]))
        counts = []
        for n, code in enumerate(gram_codes(words, bounds, shards)):
            if n:
                got = exchange.received(answers, n, np.uint8)
            else:
                got, distinct, total = _unigrams(answers)
            mine = got[np.searchsorted(np.unique(code), code)]
            counts.append(_VALUE[mine] if n else mine.astype(np.float64))
        one, two, three = counts
        ends = bounds[1:] - 1
        starts = np.zeros(len(words), bool)
        starts[bounds[:-1]] = True

        def context(c):
            """The n-gram's context is the shorter n-gram that ends one token earlier; every training row has one start, and one end."""
            return np.where(starts, one[ends[0]], np.concatenate(([0.0], c[:-1])))

        p = np.where(one > 0, (one - 0.5) / max(1, total), 0.5 * distinct / total if total else 1.0)
        for c, n in ((two, context(one)), (three, context(two))):
            n = np.maximum(n, c)
            backoff = weight / (n + weight)
            p = c * (1 - backoff) / np.maximum(n, 1) + backoff * p
        base = np.log10((one + 1) / (total + distinct + 1))
        sums = [np.add.reduceat(x, bounds[:-1]) for x in (base, np.log10(p))]
        known = np.add.reduceat((one > 0).astype(np.int64), bounds[:-1])
        return pa.table([rows["doc_id"].cast(pa.int64()), rows["held"], pa.array(np.diff(bounds)), pa.array(known), pa.array(np.full(rows.num_rows, total)), *map(pa.array, sums)], schema=_OUT_ARROW)

    return block


def score(docs: DataFrame, held_out: Column, weight: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model is fitted on the rows where `held_out` is not true. Tokens are
    runs between ASCII white space, A-Z lower-cased, then one end. n_known
    counts the tokens that occur in training; base_score is the add-one unigram
    score and score the model's log10 probability of the text, whose unknown
    words are one class.

    A null, empty or wordless text is its end alone. Repeated rows are scored,
    and counted, each. Without training rows every token is unknown; an empty
    table gives no rows. Ids are whole numbers and may be null or repeat; rows of
    one id and one text share a block. Other columns are ignored, whatever their
    names. A text of any length is scored whole.
    """
    blocks, shards = exchange.block_count(docs, text_col)
    base = exchange.in_blocks(docs, id_col, text_col, blocks, F.coalesce(held_out, F.lit(False)).alias("held"))
    sent = base.groupBy("block").applyInArrow(_send(shards), exchange.MESSAGE)
    answers = exchange.answer(sent, _reply)
    scored = base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(shards, weight), _OUT)
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
