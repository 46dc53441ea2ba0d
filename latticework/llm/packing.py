"""Packing by vector bin packing with the dot-product heuristic.

Each task tokenises its documents and packs them into sequences of bounded
tokens, segments and loss-bearing tokens. Long documents first fill sequences of
their own. What is left is packed into one open sequence at a time: of the pieces
of the largest sizes that fit, the one whose demands have the highest dot product
with the sequence's free capacity is placed next. A gap that nothing fits is filled by cutting a piece. A sequence that the
segment or the loss limit closes early is cut back to a power of two, a length
that needs no padding. No row is shuffled, and a task holds one window of pieces
at a time.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: pieces that are packed together
WINDOW = 4096
#: a sequence closed early is padded if it lacks no more than one token in so many
SLACK = 64
#: white space in a row beyond which the faster library's pattern engine may give up
MOST_SPACE = 50_000
_SPACE = re.compile(r"\s{64,}+")
_TOKENIZERS: dict[str, "Ids"] = {}
_OUT = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())]


class Ids:
    """Token ids of a byte-level BPE file.

    The merges of the file are run by a faster library over the file's own
    vocabulary and pre-tokeniser pattern. A text with a special token's string,
    or with a very long run of white space, is given to the file's tokenizer.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        from latticework.llm.wordpiece import byte_vocabulary

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.encoder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_vocabulary(path), special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or (len(text) > MOST_SPACE and any(m.end() - m.start() > MOST_SPACE for m in _SPACE.finditer(text))):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.encoder.encode_ordinary(text)


def bearing(at: int, n: int, quiet: int) -> int:
    """Loss-bearing tokens among n from `at` on: those from `quiet` on, but never the first of a piece, which has no context."""
    return max(0, at + n - max(at + 1, quiet))


def own(at: int, total: int, quiet: int, capacity: int, loss: int) -> int:
    """Tokens from `at` on that fill a sequence by themselves: all of it, or a power of two if more would break the loss limit; else 0."""
    n = capacity
    while n > 1 and (bearing(at, n, quiet) > loss or (n < capacity and n & (n - 1))):
        n = 1 << ((n - 1).bit_length() - 1)
    return n if 2 * n >= capacity and at + n <= total else 0


def cut_back(bin_: list[tuple[int, int, int]], room: int, capacity: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The pieces up to the largest power of two, and the rest; all of them if little room is left anyway."""
    total = capacity - room
    if room * SLACK <= capacity:
        return bin_, []
    keep, kept, rest = 1 << (total.bit_length() - 1), [], []
    for i, at, n in bin_:
        m = min(n, keep)
        keep -= m
        if m:
            kept.append((i, at, m))
        if m < n:
            rest.append((i, at + m, n - m))
    return kept, rest


def pack(sizes: list[int], quiet: list[int], capacity: int, segments: int, loss: int, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Sequences as lists of (item, from, tokens), and the (item, from) cuts left for later.

    Item i has sizes[i] tokens, of which those from quiet[i] on bear loss; the
    first token of a piece never does. A sequence is full, or a limit closed it
    and it is cut back; if `last`, the final one may be neither.
    """
    limits = np.array([capacity, segments, max(loss, 1)], dtype=float)
    pieces: dict[int, list[tuple[int, int]]] = {}
    for i, n in enumerate(sizes):
        pieces.setdefault(n, []).append((i, 0))
    order = sorted(pieces)
    total = sum(sizes)
    done: list[list[tuple[int, int, int]]] = []

    def put(n: int, i: int, at: int) -> None:
        if n not in pieces:
            bisect.insort(order, n)
        pieces.setdefault(n, []).append((i, at))

    # an item's place counts from its own start, so quiet[i] holds for all of its pieces
    while order and (last or total >= capacity):
        left, bears, bin_, closed = capacity, loss, [], False
        while left and order and not closed and len(bin_) < segments:
            free = np.array([left, segments - len(bin_), bears]) / limits
            k = bisect.bisect_right(order, left)
            # the top of each of the largest stacks that fit, by the dot product of demand and room
            best, best_score = 0, -1.0
            for n in order[max(0, k - 8) : k]:
                i, at = pieces[n][-1]
                need = bearing(at, n, quiet[i])
                if need <= bears and (score := float(free @ (np.array([n, 1, need]) / limits))) > best_score:
                    best, best_score = n, score
            if best and len(bin_) == segments - 1 and best < left < order[-1]:
                best = 0  # the last segment is better filled by a cut
            n = best or order[-1]
            i, at = pieces[n][-1]
            take = min(n, left)
            if bearing(at, take, quiet[i]) > bears:
                take, closed = min(take, max(at + 1, quiet[i]) + bears - at), True
            pieces[n].pop()
            if not pieces[n]:
                del pieces[n]
                order.pop(bisect.bisect_left(order, n))
            bin_.append((i, at, take))
            left, bears, total = left - take, bears - bearing(at, take, quiet[i]), total - take
            if take < n:
                put(n - take, i, at + take)
        if left and order:
            bin_, rest = cut_back(bin_, left, capacity)
            for i, at, n in rest:
                total += n
                put(n, i, at)
        done.append(bin_)
    return done, [(i, at) for n in order for i, at in pieces[n]]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, segments: int = 128, loss: int | None = None, end_id: int = 0, prompt_end: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document, placed in a sequence.

    A document's ids are its text's, without special tokens, then `end_id`; a
    null or empty text has the end alone. Documents are cut freely. A sequence
    holds at most `capacity` ids, `segments` pieces and `loss` loss-bearing
    tokens (default: no more than the capacity allows). What stands before the
    first `prompt_end` in a text is its prompt, which bears no loss (as many
    tokens as it has by itself). Returns (id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, loss_tokens).

    Sequence ids are unique, not gapless. Rows that repeat an id or a text are
    documents of their own, null ids stay null, an empty table gives no rows, a
    text of any length is cut into as many pieces as it needs, and other columns
    are left out, whatever their names. The file has to be at `tokenizer_path`
    on the executors.
    """
    loss = capacity - 1 if loss is None else loss
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def run(batches):
        if tokenizer_path not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path] = Ids(tokenizer_path)
        encode = _TOKENIZERS[tokenizer_path]
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        state = {"n": 0}
        id_type = None

        def sequence() -> int:
            state["n"] += 1
            return (part << 36) + state["n"]

        def rows(out):
            ids, *columns = zip(*out, strict=True)
            return pa.record_batch([pa.array(ids, id_type), *(pa.array(c, t) for c, (_, t) in zip(columns, _OUT, strict=True))], names=["id", *(n for n, _ in _OUT)])

        def piece(doc, start, ids, total, seq, offset, quiet):
            return (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, offset, bearing(start, len(ids), quiet))

        held: list[tuple[object, int, np.ndarray, int, int]] = []

        def emit(last: bool):
            bins, rest = pack([len(h[2]) for h in held], [h[4] - h[1] for h in held], capacity, segments, loss, last)
            out = []
            for bin_ in bins:
                seq, offset = sequence(), 0
                for i, at, n in bin_:
                    doc, start, ids, total, quiet = held[i]
                    out.append(piece(doc, start + at, ids[at : at + n], total, seq, offset, quiet))
                    offset += n
            held[:] = [(held[i][0], held[i][1] + at, held[i][2][at:], held[i][3], held[i][4]) for i, at in rest]
            return out

        for batch in batches:
            id_type = batch["id"].type
            out = []
            for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py() or ""
                ids = np.array([*encode(text), end_id], dtype="<u4")
                cut = text.find(prompt_end) if prompt_end else -1
                quiet = len(encode(text[:cut])) if cut > 0 else 0
                at = 0
                while n := own(at, len(ids), quiet, capacity, loss):
                    out.append(piece(doc, at, ids[at : at + n], len(ids), sequence(), 0, quiet))
                    at += n
                if at < len(ids):
                    held.append((doc, at, ids[at:].copy(), len(ids), quiet))
                if len(held) >= WINDOW:
                    out += emit(False)
                if len(out) >= WINDOW:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)
        if held:
            yield rows(emit(True))

    schema = f"id {kind}, " + ", ".join(f"{n} long" for n, _ in _OUT)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
