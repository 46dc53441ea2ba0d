"""Benchmark decontamination with an Aho-Corasick automaton.

All windows of all benchmark items form one automaton over normalised words,
each written as a code of three characters, so that a window costs three nodes
a word. Every document is normalised, scanned from end to end, and the hit words
are mapped back to offsets in the original text. A large benchmark makes several
automata; each row's hits are united in the scan. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z, every separator to a space
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: bytes of benchmark text that one automaton may hold; more makes several, which scan each chunk of documents in turn
MAX_BENCHMARK_BYTES = 2 << 20
#: bytes of documents that several automata scan in turn
CHUNK = 64 << 20
_NONE = np.zeros(0, np.int64)
_FOUND = "row_key long, n_words long, hits array<int>, items array<string>, spans array<struct<start:int,end:int>>"
_AUTOMATA: dict[int, tuple[object, dict[bytes, str]]] = {}


def windows(text: str | None, n: int) -> list[list[bytes]]:
    """The item's windows of n words; all its words if fewer; none if it has none."""
    words = (text or "").encode().translate(_PLAIN).split()
    return [words[i : i + n] for i in range(max(1, len(words) - n + 1))] if words else []


def code_of(number: int) -> str:
    """Three characters; only the first is 128 or more, so matches begin at words."""
    return chr(128 + (number >> 14)) + chr(number >> 7 & 127) + chr(number & 127)


#: the code of every word that no benchmark item has
_OTHER = "\0\0\0"


def automaton(items: list[tuple[str, str | None]], n: int) -> tuple[ahocorasick.Automaton, dict[bytes, str]]:
    """Over windows of word codes, with the codes; a value is the window's words and item ids."""
    codes: dict[bytes, str] = {}
    owners: dict[tuple[str, ...], set[str]] = {}
    for item_id, text in items:
        for words in windows(text, n):
            window = tuple(codes.setdefault(w, code_of(len(codes))) for w in words)
            owners.setdefault(window, set()).add(item_id)
    out = ahocorasick.Automaton()
    for window, ids in owners.items():
        out.add_word("".join(window), (len(window), tuple(sorted(ids))))
    if owners:
        out.make_automaton()
    return out, codes


def scan(raw: bytes, found: tuple[ahocorasick.Automaton, dict[bytes, str]]) -> tuple[int, np.ndarray, set[str]]:
    """Words, indices of hit words in order, and ids of the items with an occurring window."""
    words = raw.translate(_PLAIN).split()
    items: set[str] = set()
    if not words or not found[1]:
        return len(words), np.zeros(0, np.int64), items
    ends: list[tuple[int, int]] = []
    for end, (n, ids) in found[0].iter("".join(map(found[1].get, words, repeat(_OTHER)))):
        ends.append((end // 3 + 1, n))
        items.update(ids)
    if not ends:
        return len(words), np.zeros(0, np.int64), items
    cover = np.zeros(len(words) + 1, np.int64)
    after, size = np.array(ends).T
    np.add.at(cover, after - size, 1)
    np.add.at(cover, after, -1)
    return len(words), np.flatnonzero(np.cumsum(cover[:-1]) > 0), items


def spans_of(raw: bytes, hits: np.ndarray) -> list[dict[str, int]]:
    """Character offsets in the original text of each run of hit words."""
    if not len(hits):
        return []
    bounds = [m.span() for m in _WORD.finditer(raw.translate(_PLAIN))]
    char = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    cut = np.flatnonzero(np.diff(hits) > 1)
    return [
        {"start": int(char[bounds[a][0]]), "end": int(char[bounds[b][1]])}
        for a, b in zip(hits[np.concatenate(([0], cut + 1))].tolist(), hits[np.concatenate((cut, [len(hits) - 1]))].tolist(), strict=True)
    ]


def pieces(text: str | None, n: int, limit: int) -> list[str | None]:
    """The item itself, or pieces of about `limit` bytes that together have the windows of a longer one."""
    if len((text or "").encode()) <= limit:
        return [text]
    words = text.encode().translate(_PLAIN).split()
    out, start, end = [], 0, 0
    while end < len(words):
        end, size = start, 0
        while end < len(words) and (end - start < n or size < limit):
            size, end = size + len(words[end]) + 1, end + 1
        out.append(b" ".join(words[start:end]).decode())
        start = end - n + 1
    return out


def parts_of(items: Iterable[tuple[str, str | None]], n: int, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items, or their pieces, in lists of at most `limit` bytes (or one piece); at least one list."""
    part, size = [], 0
    for item_id, text in items:
        for piece in pieces(text, n, limit):
            more = len((piece or "").encode())
            if part and size + more > limit:
                yield part
                part, size = [], 0
            part.append((item_id, piece))
            size += more
    yield part


def _scanned(parts: list[tuple[int, object]], n: int, text_at: int, chunk: int):
    """A function from batches to (batch, [(words, hit indices, item ids) of each row]).

    Several automata take turns over `chunk` bytes of batches, one in memory at a time.
    """

    def judged(held):
        texts = [batch[text_at].cast(pa.binary()) for batch in held]
        rows = [[(0, _NONE, frozenset())] * len(t) for t in texts]
        for key, items in parts:
            found = None
            if key not in _AUTOMATA:
                _AUTOMATA.clear()
                _AUTOMATA[key] = automaton(items.value, n)
                vars(items).pop("_value", None)
            found = _AUTOMATA[key]
            for mine, column in zip(rows, texts, strict=True):
                for k, text in enumerate(column):
                    words, hits, ids = scan(text.as_py() or b"", found)
                    old = mine[k]
                    mine[k] = (words, np.union1d(old[1], hits), old[2] | ids) if len(old[1]) and ids else (words, hits, ids) if ids else (words, *old[1:])
        return zip(held, rows, strict=True)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch[text_at].nbytes
            if len(parts) == 1 or size >= chunk:
                yield from judged(held)
                held, size = [], 0
        if held:
            yield from judged(held)

    return run


def _parts(benchmark: DataFrame, item_col: str, item_text_col: str, n: int) -> list[tuple[int, object]]:
    """Key and broadcast items of each automaton."""
    sc = benchmark.sparkSession.sparkContext
    wanted = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).distinct()
    size = wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    rows = wanted.orderBy("i", "t").collect() if size <= MAX_BENCHMARK_BYTES else wanted.toLocalIterator()
    shared = [sc.broadcast(part) for part in parts_of(map(tuple, rows), n, MAX_BENCHMARK_BYTES)]
    return [(hash((sc.applicationId, items._jbroadcast.id())), items) for items in shared]


def contaminated_words(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n_words: int = 13) -> DataFrame:
    """(id, n_words, hits, items, spans) of every row of `docs`.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased. A window is n_words consecutive words of a benchmark item, or
    all its words if it has fewer. `hits` are the indices of the words inside
    any occurrence of a window, `items` the ids (as strings) of the items that
    occur, `spans` the hit runs as character offsets of the original text.

    A null or empty text has no words and no hits, an empty benchmark hits
    nothing, items with a null id or without words are passed over, equal items
    all count. Every row is judged for itself, whatever its id, and comes back
    once, for a benchmark of any size.
    """
    scanned = _scanned(_parts(benchmark, item_col, item_text_col, n_words), n_words, 1, CHUNK)
    schema = pa.schema([("row_key", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        for batch, judged in scanned(batches):
            rows = [
                (at, words, hits.tolist(), sorted(ids), spans_of(text.as_py() or b"", hits) if len(hits) else [])
                for at, text, (words, hits, ids) in zip(batch[0].to_pylist(), batch[1].cast(pa.binary()), judged, strict=True)
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, _FOUND).withColumnRenamed("row_key", id_col)


def is_contaminated(n_hit: Column | int, n_words: Column | int, share: int = 20) -> Column | bool:
    """At least one hit word, and at least one in `share` of all words."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 13) -> DataFrame:
    """`docs` without the rows that are contaminated (see `contaminated_words`), each judged for itself."""
    scanned = _scanned(_parts(benchmark, "item_id", "text", n_words), n_words, docs.columns.index(text_col), CHUNK)

    def keep(batches):
        for batch, judged in scanned(batches):
            yield batch.filter(pa.array([not is_contaminated(len(hits), words) for words, hits, _ in judged], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
