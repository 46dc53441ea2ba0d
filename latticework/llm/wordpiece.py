"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. A node's failure link leads to where matching
goes on when the greedy longest pieces of its string are cut off, and carries
how many pieces that cuts. A word is read once, byte by byte, adding up those
counts; the pieces themselves are never built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MACHINES: dict[str, "LongestMatch"] = {}
#: words that a worker remembers, and their greatest length in bytes
CACHE, CACHED_BYTES = 400_000, 64


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Byte string and id of each piece of a byte-level BPE file, special tokens left out."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}


class LongestMatch:
    """Greedy longest-match piece counts over one vocabulary of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]):
        step: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                nxt = step[node].get(b)
                if nxt is None:
                    nxt = step[node][b] = len(step)
                    step.append({})
                    final.append(False)
                node = nxt
            if node:
                final[node] = True
        fail, popped = [-1] * len(step), [0] * len(step)
        level = [0]
        while level:
            below = []
            for u in level:
                for b, v in step[u].items():
                    below.append(v)
                    if final[v]:
                        fail[v], popped[v] = 0, 1
                        continue
                    z, count = fail[u], popped[u]
                    while z >= 0 and b not in step[z]:
                        z, count = fail[z], count + popped[z]
                    if z >= 0:
                        fail[v], popped[v] = step[z][b], count
            level = below
        self.step, self.fail, self.popped = step, fail, popped
        self.cache: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of the word, or -1 where the vocabulary cannot spell it."""
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        for b in word:
            while b not in step[node]:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = step[node][b]
        while node:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return total

    def text(self, raw: bytes) -> tuple[int, int]:
        """Words and pieces of a text; every word is read with one space before it."""
        cache = self.cache
        words = raw.split()
        try:
            return len(words), sum(map(cache.__getitem__, words))
        except KeyError:
            pass
        # long words are counted anew in every text, so the cache stays below CACHE times CACHED_BYTES
        fresh = {word: max(1, self.count(b" " + word)) for word in set(words) if word not in cache}
        out = len(words), sum(cache[word] if word in cache else fresh[word] for word in words)
        cache.update((word, n) for word, n in fresh.items() if len(word) <= CACHED_BYTES)
        if len(cache) > CACHE:
            cache.clear()
        return out


def machine(vocabulary_path: str) -> LongestMatch:
    """The automaton of a vocabulary file, built once a worker."""
    if vocabulary_path not in _MACHINES:
        _MACHINES[vocabulary_path] = LongestMatch(byte_vocabulary(vocabulary_path))
    return _MACHINES[vocabulary_path]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens): greedy longest-match pieces of every row's words.

    Words are runs between ASCII white space, read with a leading space. A word
    that the vocabulary cannot spell counts as one piece. A null or empty text
    has 0 of both; repeated rows are counted each, null ids stay null, an empty
    table gives no rows, a text of any length is counted whole, and other columns
    are left out, whatever their names.
    The vocabulary file has to be at `vocabulary_path` on the executors.
    """
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]

    def run(batches):
        counter = machine(vocabulary_path)
        for batch in batches:
            counts = [counter.text(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch["text"].cast(pa.binary())]
            yield pa.record_batch([batch["id"], pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], names=["id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
