"""N-gram Jaccard join: documents whose word-shingle sets are alike.

The document by shingle incidence is kept sparse and by blocks. Each document
orders its shingles from rare to frequent (exact document counts over the whole
corpus) and keeps the head that any partner at the threshold must share a part
of; only those cells enter the product. For each shared cell the ranks of the
shingle in both documents bound the overlap still possible, and pairs whose
bound is below what their sizes ask for are discarded before they are counted.

A group of thousands of near copies would make all its pairs. So each shared
shingle first links its documents with one leader; what is linked already is
one component, and the product then runs between different components only,
where it is exact: no link between components is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm import eliasfano, exchange, textkernel
from latticework.llm.quality import free_name
from latticework.operators.components import components
from latticework.session import checkpointed

_STAGE = "kind int, doc_id long, row long, n long, sig long, shingle long, pos int, cells binary"
_STAGE_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("shingle", pa.int64()), ("pos", pa.int32()), ("cells", pa.binary())])


def _send(n_words: int, shards: int):
    def block(rows: pa.Table) -> pa.Table:
        buf, offs = textkernel.flat(rows["text"])
        sets = [exchange.coded(x, shards) for x in textkernel.shingle_rows(buf, offs, n_words)]
        codes, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
        return exchange.table(exchange.messages(rows["block"][0].as_py(), 0, codes, counts, shards), exchange.MESSAGE_ARROW)

    return block


def _document_counts(level, keys, total, asked):
    """Document counts as 16 bits, exact below 60000 and equal above."""
    code = np.minimum(total, 60_000).astype(np.uint16)
    return [code[np.searchsorted(keys, x)] for x in asked]


def _heads(n_words: int, shards: int, percent: int):
    def block(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _STAGE_ARROW.empty_table()
        buf, offs = textkernel.flat(rows["text"])
        sets = list(textkernel.shingle_rows(buf, offs, n_words))
        codes = [exchange.coded(x, shards) for x in sets]
        every = np.unique(np.concatenate(codes))
        df = exchange.received(answers, 0, np.uint16)
        docs, entries, cells = [], [], []
        for doc_id, row, mine, code in zip(rows["doc_id"].to_pylist(), rows["row"].to_pylist(), sets, codes, strict=True):
            n = len(mine)
            sig = int(textkernel.mix64(np.array([np.bitwise_xor.reduce(textkernel.mix64(mine)) if n else 0, n], np.uint64)).sum(dtype=np.uint64).astype(np.int64))
            docs.append((doc_id, row, n, sig))
            if not n:
                continue
            count = df[np.searchsorted(every, code)]
            order = np.lexsort((mine, count))
            head = order[: n - (-(-percent * n // 100)) + 1]
            pos = np.flatnonzero(count[head] > 1)
            if len(pos):
                entries.append((n, sig, mine[head[pos]].view(np.int64), pos))
                cells.append((n, sig, eliasfano.encode(mine)))
        parts = [pa.table([pa.array([0] * len(docs), pa.int32()), *(pa.array(x, pa.int64()) for x in zip(*docs, strict=True)), pa.nulls(len(docs), pa.int64()), pa.nulls(len(docs), pa.int32()), pa.nulls(len(docs), pa.binary())], schema=_STAGE_ARROW)]
        if entries:
            size = [len(x[3]) for x in entries]
            m = sum(size)
            parts.append(pa.table([pa.array(np.full(m, 1, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.repeat([x[0] for x in entries], size)), pa.array(np.repeat([x[1] for x in entries], size)), pa.array(np.concatenate([x[2] for x in entries])), pa.array(np.concatenate([x[3] for x in entries]).astype(np.int32)), pa.nulls(m, pa.binary())], schema=_STAGE_ARROW))
            k = len(cells)
            parts.append(pa.table([pa.array(np.full(k, 2, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([x[0] for x in cells], pa.int64()), pa.array([x[1] for x in cells], pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array([x[2] for x in cells], pa.binary())], schema=_STAGE_ARROW))
        return pa.concat_tables(parts)

    return block


def _verified(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets pass the threshold, by their full overlap."""
    with_a = pairs.join(cells.select(F.col("node").alias("a"), F.col("cells").alias("cells_a")), "a")
    with_b = with_a.join(cells.select(F.col("node").alias("b"), F.col("cells").alias("cells_b")), "b")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["cells_a"], batch["cells_b"], strict=True):
                x, y = eliasfano.decode(x.as_buffer()), eliasfano.decode(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_b.select("a", "b", "cells_a", "cells_b").mapInArrow(check, pairs.select("a", "b").schema)


def _bounded(x: str, y: str, percent: int):
    """Whether the ranks of a shared shingle leave room for the overlap that both sizes ask for."""
    nx, ny, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    need = F.ceil((nx + ny) * F.lit(percent) / F.lit(100 + percent) - 1e-9)
    return (need <= F.least(nx, ny)) & (i <= nx - need) & (j <= ny - need) & (F.least(i, j) + F.least(nx - i, ny - j) >= need)


def _row_key(docs: DataFrame) -> Column:
    """A hash of all of a row's columns and of which of them are null; equal rows share it."""
    every = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema.fields]
    # maps have no hash of their own
    plain = [F.to_json(F.struct(c.alias("c"))) if "map<" in f.dataType.simpleString() else c for c, f in zip(every, docs.schema.fields, strict=True)]
    return F.xxhash64(*plain, *(c.isNull() for c in every))


def _components(docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n, sig, node) of each row, and (node, component) of each class.

    A class has one set and is named by its hash `sig`; ids may be null. The
    classes of a repeated id are linked, and its rows without words have one
    of them as their node. Other rows without words have none.
    """
    blocks, shards = exchange.block_count(docs, text_col)
    row = _row_key(docs)
    base = exchange.in_blocks(docs, id_col, text_col, blocks, row.alias("row"), key=row)
    sent = base.groupBy("block").applyInArrow(_send(n_words, shards), exchange.MESSAGE)
    answers = exchange.answer(sent, _document_counts)
    stage = checkpointed(base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_heads(n_words, shards, percent), _STAGE))

    rows = stage.where("kind = 0").select("doc_id", "row", "n", "sig")
    classes = rows.where("n > 0").select(F.col("sig").alias("node")).distinct()
    entries = checkpointed(stage.where("kind = 1").select(F.col("sig").alias("node"), "n", "shingle", "pos").distinct())
    cells = stage.where("kind = 2").groupBy(F.col("sig").alias("node")).agg(F.first("cells").alias("cells"))

    worded = F.when(F.col("n") > 0, F.col("sig"))
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(worded).alias("a"), F.max(worded).alias("z"), F.min("n").alias("least"))
    several = checkpointed(ids.where("a <> z or a is not null and least = 0").select("doc_id", "a"))
    same_id = rows.where("n > 0").select("doc_id", F.col("sig").alias("b")).distinct().join(several, "doc_id").where("a <> b").select("a", "b").distinct()

    leads = entries.groupBy("shingle").agg(F.min(F.struct("pos", "n", "node")).alias("lead"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    starred = entries.alias("x").join(leads.alias("l"), "shingle").select(F.struct("x.pos", "x.n", "x.node").alias("x"), F.col("lead").alias("y")).where("x.node <> y.node")
    star = starred.where(_bounded("x", "y", percent)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    first = checkpointed(components(_verified(star, cells, percent)))

    labelled = entries.join(first.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per_comp = labelled.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("rows"))
    main = per_comp.groupBy("shingle").agg(F.max(F.struct("rows", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    spread = checkpointed(
        labelled.join(main, "shingle").select("shingle", "comp", (F.col("comp") == F.col("m.comp")).alias("main"), F.struct("pos", "n", "node", "comp").alias("cell"))
    )
    # of a pair, the smaller side takes part with the shorter head that a partner of its size or more leaves it
    n, pos = F.col("cell.n"), F.col("cell.pos")
    short = spread.where(pos <= n - F.ceil(2 * n * F.lit(percent) / F.lit(100 + percent) - 1e-9)).select("shingle", "main", F.col("cell").alias("x"))
    rest, main_cells = spread.where("not main"), spread.where("main")
    larger = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")

    def crossed(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.select("shingle", "x").join(y.select("shingle", F.col("cell").alias("y")), "shingle").where(larger & (F.col("x.comp") != F.col("y.comp")) & _bounded("x", "y", percent))

    met = crossed(short.where("not main"), rest).unionByName(crossed(short.where("not main"), main_cells)).unionByName(crossed(short.where("main"), rest))
    cross = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    links = _verified(cross, cells, percent).unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(same_id)
    final = components(links)

    empty = rows.where("n = 0").join(several, "doc_id", "left").select("doc_id", "row", "n", "sig", F.col("a").alias("node"))
    placed = rows.where("n > 0").withColumn("node", F.col("sig")).unionByName(empty)
    return placed, classes.join(final, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """Shingle count and similarity component of every document.

    Words are maximal runs outside ASCII white space, A-Z lower-cased; a set is
    a document's distinct shingles of `n_words` words, or the whole sequence if
    it has fewer. Two documents link when 100 * intersection >= percent * union.

    Returns (id, n_shingles, component_id, class_id): the component is the
    least id reachable by links, the class the least id with an equal set. A
    null or empty text, or one without words, has n_shingles 0 and is its own
    class, and its own component unless its id has other rows. Rows that repeat
    an id are one node, so their sets are linked, and come back once each. Rows
    with a null id have no node and link nothing: they come back with their
    n_shingles and null for both ids (`one_of_each_component` judges them by
    their text). Other columns are ignored.
    """
    known = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    rows, found = _components(known, id_col, text_col, n_words, percent)
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("class_id")).join(found, "node")
    names = least.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = least.join(names, "component").select("node", "class_id", "component_id")

    def counted(batches):
        for batch in batches:
            n = pa.array([len(x) for x in textkernel.shingle_rows(*textkernel.flat(batch["text"]), n_words)], pa.int64())
            yield pa.record_batch([pa.nulls(len(n), pa.int64()), n, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names=["doc_id", "n", "c", "s"])

    nameless = docs.where(F.col(id_col).isNull()).select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "doc_id long, n long, c long, s long").toDF(id_col, "n_shingles", "component_id", "class_id")
    found_rows = rows.join(named, "node", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")
    )
    return found_rows.unionByName(nameless)


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without near duplicates: of each component one row stays, that of its least id.

    Rows with a null id take part by their text and come last; among rows of
    one id the one of least hash stays, and of equal rows one. Rows without
    words stay, once an id; those with a null id stay all.
    """
    rows, found = _components(docs, id_col, text_col, n_words, percent)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("b")
    chosen = rows.where("n > 0").groupBy("node").agg(best).join(found, "node").groupBy("component").agg(F.min("b").alias("b")).select("b.doc_id", "b.row")
    wordless = rows.where("n = 0 and doc_id is not null and node is null").groupBy("doc_id").agg(F.min("row").alias("row"))
    nameless = rows.where("n = 0 and doc_id is null").select("doc_id", "row").distinct()
    copies = rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("doc_id").alias("id2"), F.col("row").alias("row2"), "copies")
    once = chosen.unionByName(wordless)
    kept = checkpointed(once.join(copies, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")), "left").select("doc_id", "row", F.col("copies").isNotNull().alias("repeated")))

    key, kept_id, kept_row = (free_name(docs, n) for n in ("_row_key", "_kept_id", "_kept_row"))
    keyed = docs.withColumn(key, _row_key(docs))

    def having(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(kept_id), F.col("row").alias(kept_row))
        return keyed.join(keys, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_row)), "left_semi")

    out = having(kept.where("not repeated").select("doc_id", "row").unionByName(nameless))
    if not kept.where("repeated").isEmpty():
        out = out.unionByName(having(kept.where("repeated")).dropDuplicates([id_col, key]))
    return out.drop(key)
