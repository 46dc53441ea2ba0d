"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import decontaminate, lm, ngram_join, packing, quality, queries, quotes, sharding, topk, urlfilter, wordpiece

#: extra columns named like those that the operators use inside
CLASHING = "row id k n w t c z unit grp block node sig label bucket held shard slot host path rule verdict hits items q rank score parent root key".split()
LONG = " ".join(f"Word{i % 70_000}" for i in range(200_000))
TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (2, None), (3, ""), (3, ""), (4, " \n\t "), (None, None), (None, "eta theta iota kappa lambda mu"),
    (None, "eta theta iota kappa lambda mu"), (5, LONG), (6, LONG + " tail"), (7, "alpha beta gamma delta epsilon zeta"), (8, "one"), (9, "x" * 300_000), (10, "> " * 50_000),
]
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark, rows, names):
    """Rows with clashing columns beside, null in every other row."""
    return spark.createDataFrame(rows, names).select("*", *(F.when(F.rand(3) > 0.5, F.lit("mine")).alias(c) for c in CLASHING if c not in names.replace(",", " ").split()))


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS, "doc_id long, text string").repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_ngram_join(docs):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(docs).collect())
    want = Counter()
    for i, t in TEXTS:
        w = words(t)
        want[i, len({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))}) if w else 0, {6: 5, 7: 1}.get(i, i)] += 1
    assert got == want
    assert ngram_join.ngram_jaccard_components(docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each_component(docs)
    assert kept.columns == docs.columns
    # wordless rows without an id stay all, those with one once; of equal rows one
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter([1, 2, 3, 4, None, None, 5, 8, 9, 10])


def test_packing(docs):
    path = queries.tokenizer_path()
    pieces = packing.pack_documents(docs, path, **queries.PACKING).collect()
    assert all(0 < r["length"] <= 1024 for r in pieces)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    sizes = {t: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in {t for _, t in TEXTS}}
    assert sum(r["length"] for r in pieces) == sum(sizes[t] for _, t in TEXTS)
    starts = Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    assert starts == Counter(i for i, _ in TEXTS)
    assert {(r["doc_id"], r["doc_tokens"]) for r in pieces} == {(i, sizes[t]) for i, t in TEXTS}
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_url_filter(spark):
    urls = [(1, None), (2, ""), (2, ""), (None, "http://A.example.net/en/x"), (3, "http://a.net"), (3, "http://a.net"), (4, "nothing"), (5, "http://b.org/fr/" + "seg/" * 100_000), (6, "http://"), (7, "http://x.org?fr/")]
    pages = table(spark, urls, "page_id long, url string")
    weights = urlfilter.fit(urlfilter.labelled_urls(spark))
    got = urlfilter.judge_urls(pages, queries.RULES, weights).collect()
    assert Counter((r["page_id"], r["host"], len(r["path"]), r["rule"]) for r in got) == Counter(
        [(1, "", 0, None), (2, "", 0, None), (2, "", 0, None), (None, "a.example.net", 5, "example.net/en/"), (3, "a.net", 0, None), (3, "a.net", 0, None), (4, "", 0, None), (5, "b.org", 400_004, "org/fr/"), (6, "", 0, None), (7, "x.org", 0, None)]
    )
    assert all(r["verdict"] in ("allow", "block") for r in got)
    assert urlfilter.judge_urls(pages.limit(0), queries.RULES, weights).count() == 0


def test_lm_scoring(docs):
    got = lm.score(docs, F.col("doc_id") == 6).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"]) for r in got) == Counter((i, i == 6, len(words(t)) + 1) for i, t in TEXTS)
    train = Counter(w for i, t in TEXTS if i != 6 for w in [*words(t), "</s>"])
    known = {r["doc_id"]: r["n_known"] for r in got}
    assert known[6] == len(words(LONG)) + 1 and {r["train_tokens"] for r in got} == {sum(train.values())}
    assert all(np.isfinite(r["score"]) for r in got)
    assert lm.score(docs.limit(0), F.lit(False)).count() == 0


def test_quality_ties_and_empty(spark, docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (9, None), (1, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.resample(docs, model, k=2).collect()
    assert len(got) == len(TEXTS)
    wordless = [r for r in got if not words(r["text"])]
    assert all(r["log_weight"] == float("-inf") and not r["kept"] for r in wordless)
    # a tie at the k-th key is kept whole
    keys = sorted((r["gumbel_key"] for r in got if r["log_weight"] > float("-inf")), reverse=True)
    assert sum(r["kept"] for r in got) == sum(k >= keys[1] for k in keys)
    assert len({r["kept"] for r in got if r["doc_id"] == 1}) == 1
    assert quality.sampled(docs, model).columns == docs.columns
    empty = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.resample(docs.limit(0), empty).count() == 0


def test_token_counts(docs):
    path = queries.tokenizer_path()
    got = wordpiece.token_counts(docs, path).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter((i, len(words(t))) for i, t in TEXTS)
    assert all((r["n_tokens"] >= r["n_words"]) and (r["n_words"] > 0) == (r["n_tokens"] > 0) for r in got)
    assert wordpiece.token_counts(docs.limit(0), path).count() == 0


def test_decontamination(spark, docs):
    bench = table(spark, [(1, "ETA theta, iota"), (2, " ".join(f"word{i}" for i in range(69_980, 70_000))), (None, "alpha"), (3, None), (4, "one"), (4, "one"), (5, "")], "item_id long, text string")
    got = decontaminate.contaminated_words(docs, bench).collect()
    assert Counter((r["doc_id"], len(r["hits"]), tuple(r["items"])) for r in got) == Counter(
        (i, n, ids) for (i, t) in TEXTS for n, ids in [(3, ("1",)) if t and t.startswith("eta") else (40, ("2",)) if t and t.startswith("Word") else (1, ("4",)) if t == "one" else (0, ())]
    )
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter(i for i, t in TEXTS if t != "one" and not (t or "").startswith("eta"))
    assert decontaminate.contaminated_words(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(TEXTS)


def test_sharding(docs):
    path = queries.tokenizer_path()
    got = sharding.shard_documents(docs, path, shards=3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(docs.limit(0), path).count() == 0


def test_quote_linking(spark):
    rows = [
        ("a", 0, "user", "first line here\n\nsecond part"), ("a", 1, "bot", "> second part\nyes"), ("a", 1, "bot", "> second part\nyes"), ("a", None, "user", "> second part"), (None, 0, "user", "hello"), (None, None, None, None),
        ("b", 0, None, None), ("b", 1, "user", ""), ("b", 2, "user", "> " * 5_000 + "deep"), ("b", 3, "bot", "> a\nb\n" * 5_000), ("c", 7, "user", ">"),
    ]
    messages = table(spark, rows, "conv_id string, turn int, role string, text string")
    got = quotes.link_quotes(messages)
    seen = Counter((r["conv_id"], r["turn"], r["parent_turn"], r["n_linked"]) for r in got.collect())
    assert seen == Counter([("a", 0, None, 0), ("a", 1, 0, 1), ("a", 1, 0, 1), ("a", None, None, 0), (None, 0, None, 0), (None, None, None, 0), ("b", 0, None, 0), ("b", 1, 0, 0), ("b", 2, 1, 0), ("b", 3, 2, 0), ("c", 7, None, 0)])
    assert quotes.conversations(got).agg(F.sum("messages")).first()[0] == 8
    assert quotes.link_quotes(messages.limit(0)).count() == 0


@pytest.mark.parametrize("most", [topk.MAX_QUERY_BYTES, 64])
def test_top_k_with_repeated_ids(spark, monkeypatch, most):
    monkeypatch.setattr(topk, "MAX_QUERY_BYTES", most)
    rng = np.random.default_rng(4)
    rows = [(i % 25, [float(x) for x in rng.integers(-3, 4, size=3)]) for i in range(60)]
    rows += [(5, [3.0, 3.0, 3.0])] * 4 + [(None, [9.0] * 3), (5, None), (10, [float("nan"), 1.0, 1.0]), (15, []), (15, [])]
    got = topk.exact_top_k(table(spark, rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 5 == 0, k=3)
    part = [(i, v) for i, v in rows if i is not None and v is not None and all(np.isfinite(v))]
    want = Counter()
    for at, (i, v) in enumerate(part):
        if i % 5 == 0:
            best = sorted((-int(np.dot(np.floor(256 * np.array(v)), np.floor(256 * np.array(u)))) if v else 0, j) for b, (j, u) in enumerate(part) if b != at and len(u) == len(v))[:3]
            want.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == want


def test_pipeline_stages_keep_clean_rows(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "nothing of the kind here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
        left = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        # every row with words is clean without labels; one of each group stays
        assert left == (Counter([1, None, 5, 8, 9, 10]) if rows is docs else Counter())
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_packing_long_white_space(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = [f"a{c * 1_000_000}b" for c in (" ", "\n")] + ["a" + "\r\n\t " * 250_000, " " * 120_000, "x" + " " * 49_999 + "y"]
    pieces = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, **queries.PACKING).collect()
    whole = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == i)
        assert mine == [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n, _ in mine] and sum(n for _, n, _ in mine) == len(ids)


def test_pipeline_runs_with_clashing_columns_and_maps(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "nothing of the kind here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = {c: F.lit(c) for c in ("_row_key", "_KEPT_ID", "_kept_row", "log_weight", "Key")} | {"tags": F.create_map(F.lit("a"), F.col("doc_id")), "deep": F.array(F.struct(F.create_map(F.lit(1), F.lit("x")).alias("m")))}
    wider = docs.drop("key").withColumns(more)
    wider.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    starts = Counter(r["doc_id"] for r in pieces.where("start = 0").collect())
    assert starts == Counter([1, None, 5, 8, 9, 10])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wider, str(tmp_path)).columns == wider.columns


def test_long_words_are_not_kept():
    counter = wordpiece.machine(queries.tokenizer_path())
    text = b" ".join(bytes([97 + i]) * 5000 for i in range(20)) + b" short words and short ones"
    first = counter.text(text)
    assert counter.text(text) == first == (25, sum(max(1, counter.count(b" " + w)) for w in text.split()))
    assert max(map(len, counter.cache)) <= wordpiece.CACHED_BYTES
