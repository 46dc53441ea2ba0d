"""The corpus operators against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticework.llm import decontaminate, eliasfano, lm, ngram_join, packing, quality, queries, quotes, sharding, textkernel, topk, urlfilter, wordpiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, block int, label string, hits string"
LOWER = {c: c + 32 for c in range(65, 91)}


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x", "y") for i, t in texts], DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    base = " ".join(rng.choice(words) for _ in range(100)).split()
    for _ in range(40):  # near copies of one text, some on either side of the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(100)] = rng.choice(words) + "x"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[3].upper(), "", None, "  \n\t ", "one two", "One  two", "Ünï çödé ünï çödé x y z"]
    return list(enumerate(texts))


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1 << 40), (1000, 1 << 40), (500, 60), (2000, 1 << 13)):
        x = np.sort(rng.integers(0, top, n).astype(np.uint64))
        coded = eliasfano.encode(x)
        assert (eliasfano.decode(coded) == x).all()
        asked = rng.integers(0, top, 200).astype(np.uint64)
        at, equal = eliasfano.Sequence(coded).successor(asked)
        assert (at == np.searchsorted(x, asked)).all()
        assert (equal == np.isin(asked, x)).all()


def test_word_hashes_follow_the_words():
    texts = ["a B c", "", None, "B  b\tb", "x" * 10]
    buf, offs = textkernel.flat(pa.array(texts))
    starts, ends, first = textkernel.word_bounds(buf, offs, textkernel.SPACE_WORD)
    h = textkernel.hash_spans(buf, starts, ends)
    assert first.tolist() == [0, 3, 3, 3, 6, 7]
    assert len({h[1], h[3], h[4], h[5]}) == 1 and len(set(h.tolist())) == 4


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_is_exact(spark, seed):
    rows = corpus(seed)
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = ngram_join.ngram_jaccard_components(docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}
    kept = ngram_join.one_of_each_component(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == {find(i) for i in sets}


def test_ngram_join_empty_and_repeated(spark):
    assert ngram_join.ngram_jaccard_components(docs(spark, [])).count() == 0
    got = ngram_join.ngram_jaccard_components(docs(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "x"), (2, None)])).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter([(2, 0, 2), (5, 2, 5), (5, 2, 5), (None, 1, None)])


def test_ngram_join_judges_rows_with_null_and_repeated_ids(spark):
    a, b, c = ("p q r s t u v", "A b c d e f g", "k l m n o")
    rows = [(5, a), (7, a), (7, b), (9, b), (9, None), (3, c), (3, c), (None, c), (None, "only here"), (None, "only here"), (None, "ONLY here"), (4, ""), (4, ""), (None, ""), (None, "")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["class_id"]) for r in ngram_join.ngram_jaccard_components(docs(spark, rows)).collect())
    known = [(5, 3, 5, 5), (7, 3, 5, 5), (7, 3, 5, 7), (9, 3, 5, 7), (9, 0, 5, 9), (3, 1, 3, 3), (3, 1, 3, 3), (4, 0, 4, 4), (4, 0, 4, 4)]
    assert got == Counter(known + [(None, n, None, None) for n in (1, 1, 1, 1, 0, 0)])
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in ngram_join.one_of_each_component(docs(spark, rows)).collect()]
    assert Counter(kept) == Counter([(5, a), (3, c), (None, "only here"), (4, ""), (None, ""), (None, "")])


def test_decontamination_keeps_clean_rows_of_any_id(spark):
    item = "q1 q2 q3 q4"
    rows = [(1, item), (1, "clean text"), (None, item), (None, "clean text"), (2, None)]
    kept = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, "clean text"), (None, "clean text"), (2, None)])


def test_packing_covers_every_id(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    rows = corpus(3) + [(500, "a  b   c \n d"), (501, "x<|endoftext|>y"), (502, "word " * 3000), (503, " lead and trail "), (504, "tab\tnew\n\nline's don't 12,345"), (505, "\u00a0 no break \u3000 wide")]
    got = packing.pack_documents(docs(spark, rows), path).collect()
    for i, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    seqs = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert seqs.setdefault(r["sequence_id"], 0) == r["offset"]
        seqs[r["sequence_id"]] += r["length"]
    assert max(seqs.values()) <= 1024
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_packing_keeps_white_space_runs_whole(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    rng = random.Random(14)
    runs = [" \u00a0 \u00a0", " \u00a0 \u00a0 ", "\u00a0 ", " \n \n ", "\n \n", "\t ", "\u3000 \u2003 ", "\x85 \u2028 ", "\x1c ", " "]
    rows = [(0, "a \u00a0 \u00a0 b"), *((i, "".join(rng.choice(["a", "word", "\u00e9", "9", "."]) + "".join(rng.choices(runs, k=rng.randint(1, 3))) for _ in range(8))) for i in range(1, 200))]
    got = {r["doc_id"]: r for r in packing.pack_documents(docs(spark, rows), path).where("start = 0").collect()}
    for i, text in rows:
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        assert got[i]["doc_tokens"] == len(ids) and got[i]["ids_crc32"] == zlib.crc32(ids[: got[i]["length"]].tobytes())


def test_packing_keeps_three_limits():
    rng = random.Random(4)
    sizes = [rng.randint(1, 90) for _ in range(300)]
    quiet = [rng.choice([0, 10, 80]) for _ in sizes]
    bins, rest = packing.pack(sizes, quiet, 100, 6, 60, True)
    assert not rest
    covered = Counter()
    for b in bins:
        assert sum(n for _, _, n in b) <= 100 and len(b) <= 6
        assert sum(max(0, at + n - max(at + 1, quiet[i])) for i, at, n in b) <= 60
        covered.update({i: 0 for i, _, _ in b})
        for i, _, n in b:
            covered[i] += n
    assert [covered[i] for i in range(300)] == sizes


def test_url_rules_and_classifier(spark):
    urls = ["https://A.Example.NET/en/x?q#f", "http://example.net/fr/", "https://x.org/fr/1", "https://x.example.com/de/2", "no scheme", None, "https://h.com", "ftp://b.net#x://y", "https://borg/fr/"]
    pages = spark.createDataFrame([*((i, u, "h") for i, u in enumerate(urls)), (99, "https://a.net/", "")], "page_id long, url string, html string")
    train = spark.createDataFrame([(f"https://spam-{i}.com/a", 1) for i in range(30)] + [(f"https://news-{i}.com/a", 0) for i in range(60)], "url string, label int")
    w = urlfilter.fit(train)
    got = {r["page_id"]: r for r in urlfilter.judge_urls(pages, queries.RULES, w).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(9)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/fr/", "net/"), ("x.org", "/fr/1", "org/fr/"), ("x.example.com", "/de/2", "example.com/de/"), ("", "", None), ("", "", None), ("h.com", "", None), ("b.net", "", None), ("borg", "/fr/", None)
    ]
    assert got[99]["rule"] == "net/" and got[0]["verdict"] == "allow" and got[1]["verdict"] == "block"
    held = spark.createDataFrame([(1, "http://spam-77.org/z"), (2, "http://news-77.org/z")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(held, [], w).collect()} == {1: "block", 2: "allow"}
    assert urlfilter.judge_urls(pages.limit(0), queries.RULES, urlfilter.fit(train.limit(0))).count() == 0


def test_lm_counts_and_held_out_gain(spark):
    rows = corpus(6, 200)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    got = lm.score(docs(spark, rows), held).collect()
    tok = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    c = Counter(w for i, x in tok.items() if not out[i] for w in x)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        x = tok[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(x), sum(c[w] > 0 for w in x), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) < 1e-6
    better = [r["score"] - r["base_score"] for r in got if r["held_out"]]
    assert sum(better) > 0
    assert lm.score(docs(spark, []), held).count() == 0


def test_lm_trie_returns_counts():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 3000).astype(np.uint64))
    counts = rng.integers(1, 31, len(keys))
    trie = lm.Trie(keys, counts)
    assert (trie(keys) == counts).all() and not trie(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)].any()
    assert not lm.Trie(keys[:0], counts[:0])(keys).any()


def test_lm_probabilities_sum_to_one():
    one, two, three = np.array([5.0, 3, 2]), np.array([2.0, 1, 0]), np.array([1.0, 0, 0])
    total, distinct, m = 10, 3, 4.0
    p = np.append((one - 0.5) / total, 0.5 * distinct / total)
    for c, n in ((two, 3.0), (three, 1.0)):
        p = (np.append(c, 0) + m * p) / (n + m)
    assert abs(p.sum() - 1) < 1e-12


def test_quality_separates_and_keeps_columns(spark):
    rng = random.Random(8)
    words = [f"tok{i}" for i in range(200)]
    good = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(f"{rng.choice(words).upper()}!!" for _ in range(60)) for _ in range(20)] + [" ".join([rng.choice(words)] * 50) for _ in range(20)]
    rows = list(enumerate([*good, *bad, None, "", "   "]))
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 100, 2)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = quality.resample(df, model)
    assert {r["doc_id"] for r in got.where("kept").collect()} == set(range(60))
    assert [c for c in got.columns if c not in df.columns] == ["log_weight", "gumbel_key", "kept"]
    exact = sorted((r["gumbel_key"] for r in got.where("log_weight > double('-inf')").collect()), reverse=True)
    keys = got.where("log_weight > double('-inf')").select(F.col("gumbel_key").alias("key"))
    assert [quality.kth_highest(keys, k, bins=8, held=3) for k in (1, 7, 60)] == [exact[0], exact[6], exact[59]]
    assert quality.resample(df, model, k=5).where("kept").count() == 5
    assert quality.resample(df.limit(0), quality.fit(df.limit(0), labels.limit(0))).count() == 0


def test_token_counts_are_greedy(spark):
    path = queries.tokenizer_path()
    vocabulary = wordpiece.byte_vocabulary(path)
    rows = corpus(9) + [(700, "z" * 5000), (701, "Ünïcödé \U0001f600 漢字かな")]
    for r in wordpiece.token_counts(docs(spark, rows), path).collect():
        words = (dict(rows)[r["doc_id"]] or "").encode().split()
        total = 0
        for w in words:
            w, i = b" " + w, 0
            while i < len(w):
                i += next(k for k in range(min(128, len(w) - i), 0, -1) if w[i : i + k] in vocabulary)
                total += 1
        assert (r["n_words"], r["n_tokens"]) == (len(words), total)
    small = wordpiece.LongestMatch([b"a", b"ab", b"abcd", b"b", b"c"])
    assert [small.count(w) for w in (b"abc", b"abcd", b"abcabcd", b"ad", b"")] == [2, 1, 3, -1, 0]


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(10)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 13, 20])))) for i in range(8)] + [(8, None), (9, " .. "), (None, "v1 v2"), (10, "V1, v2")]
    texts = []
    for _ in range(50):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            t[5:5] = rng.choice(items[:8])[1].upper().split()
        texts.append(rng.choice([" ", "--", "\n"]).join(t))
    rows = list(enumerate([*texts, None, "", "é" * 50]))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated_words(docs(spark, rows), bench).collect()}
    for i, t in rows:
        w, hit, ids = word.findall((t or "").translate(LOWER)), set(), set()
        for k, x in items:
            x = word.findall((x or "").translate(LOWER))
            for a in range(max(1, len(x) - 12)) if x and k is not None else ():
                win = x[a : a + 13]
                for b in range(len(w) - len(win) + 1):
                    if w[b : b + len(win)] == win:
                        hit.update(range(b, b + len(win)))
                        ids.add(str(k))
        assert (got[i]["n_words"], got[i]["hits"], got[i]["items"]) == (len(w), sorted(hit), sorted(ids))
        assert sum(len(word.findall(t[s["start"] : s["end"]])) for s in got[i]["spans"]) == len(hit)
    kept = decontaminate.decontaminate(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns and 0 < kept.count() < len(rows)
    assert decontaminate.contaminated_words(docs(spark, rows), bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.contaminated_words(docs(spark, []), bench).count() == 0


def test_decontamination_is_the_same_for_any_benchmark_size(spark, monkeypatch):
    rng = random.Random(15)
    items = [(i, " ".join(rng.choice("abcdefg") + str(rng.randint(0, 9)) for _ in range(n))) for i, n in enumerate([3, 13, 20, 60, 60])] + [(3, "x1 x2 x3"), (7, None), (8, " .. ")]
    rows = [(i, " ".join(rng.sample([t or "" for _, t in items] + ["clean words"] * 3, 4))) for i in [1, 1, 1, None, None, 2, 3]] + [(1, "clean"), (None, "clean"), (None, None), (2, "a b")] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found():
        return sorted(repr(tuple(r)) for r in decontaminate.contaminated_words(docs(spark, rows), bench).collect())

    whole = found()
    assert len(whole) == len(rows)
    for limit, chunk in [(200, 1 << 20), (50, 100), (1, 1)]:
        monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", limit)
        monkeypatch.setattr(decontaminate, "CHUNK", chunk, raising=False)
        assert found() == whole
    windows = {tuple(w) for w in decontaminate.windows(items[4][1], 13)}
    for limit in (1, 40, 100):
        cut = decontaminate.pieces(items[4][1], 13, limit)
        assert {tuple(w) for p in cut for w in decontaminate.windows(p, 13)} == windows and len(cut) > 1


def test_sharding_balances(spark):
    rng = random.Random(11)
    rows = [(i, "hot text " * 9 if i % 3 == 0 else "w " * rng.randint(0, 60)) for i in range(3000)] + [(5000, None), (5001, ""), (7, "w")]
    got = sharding.shard_documents(docs(spark, rows), queries.tokenizer_path()).collect()
    size, slots = Counter(), {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and set(size) == set(range(40))
    assert max(size.values()) < 1.02 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5000]["size"] == 16 and by_id[5000]["text_crc32"] == 0
    assert sharding.shard_documents(docs(spark, []), queries.tokenizer_path()).count() == 0


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "user", "First question?\nSecond line."),
        (1, 1, "assistant", "An answer."),
        (1, 2, "user", "> first   QUESTION?\n> Second line.\nMore on that."),
        (1, 3, "user", "> > First question?\n> > Second line.\n> More on that.\nDeep reply."),
        (1, 5, "user", "> never said\nA new thread"),
        (2, 0, "user", "> An answer.\nother conversation"),
        (3, 0, None, None), (3, 0, "user", "same turn"), (None, 1, "user", "x"), (4, 2, "user", "> only quote"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    got = {(r["conv_id"], r["turn"], r["body"]): r for r in quotes.link_quotes(df).collect()}
    assert len(got) == len(rows)
    assert got[1, 2, "More on that."]["parent_turn"] == 0 and got[1, 3, "Deep reply."]["parent_turn"] == 2
    assert got[1, 3, "Deep reply."]["n_linked"] == 2 and got[1, 3, "Deep reply."]["depth"] == 2 and got[1, 3, "Deep reply."]["root_turn"] == 0
    assert got[1, 1, "An answer."]["parent_turn"] == 0
    assert got[1, 5, "A new thread"]["parent_turn"] is None and got[1, 5, "A new thread"]["root_turn"] == 5
    assert got[2, 0, "other conversation"]["n_linked"] == 0 and got[4, 2, ""]["n_quotes"] == 1
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)], 0) for i in range(300)] + [(i, [1.0] * 6, 0) for i in range(300, 400)]
    rows += [(1000, None, 0), (1001, [float("nan")] * 6, 0), (1002, [None] * 6, 0), (1050, [float("inf")] * 6, 0), (1100, [0.5] * 2, 0), (1101, [0.5] * 2, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e, _ in rows if e and all(x is not None and math.isfinite(x) for x in e)}
    for q in (i for i in v if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
        assert sorted(got[q]) == [(k, c, -x) for k, (x, c) in enumerate(s, 1)]
    assert set(got) == {i for i in v if i % 50 == 0}
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(13, 30)
    junk = [(900 + i, "BAD!! WORD!! " * 30) for i in range(10)]
    leaked = (950, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 and more")
    df = docs(spark, [*rows, *junk, leaked]).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(25)] + [(900 + i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leaked[1][:60])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = df
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == df.columns
        seen.append({r["doc_id"] for r in out.collect()})
    assert not seen[0] & {j[0] for j in junk} and 950 in seen[1] and 950 not in seen[2]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == seen[2]


def test_lm_score_matches_brute_force(spark):
    rows = [*corpus(16, 80), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3")]
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    tok = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"] for _, t in rows]
    train = [x for (i, _), x in zip(rows, tok, strict=True) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter()
    for x in train:
        y = ["<s>", "<s>", *x]
        for k in range(2, len(y)):
            count.update([(y[k],), tuple(y[k - 1 : k + 1]), tuple(y[k - 2 : k + 1])])
    total, distinct, m = sum(map(len, train)), len({w for x in train for w in x}), 4.0

    def value(n):  # counts of 32 and more are kept in steps of 9 percent
        return float(lm._VALUE[lm.quantise(np.array([n]))[0]])

    def p(u, v, w):
        out = (count[(w,)] - 0.5) / total if count[(w,)] else 0.5 * distinct / total
        c, n = value(count[(v, w)]), float(count[(v,)])
        n = max(n, c)
        out = (c + m * out) / (n + m)
        c, n = value(count[(u, v, w)]), len(train) if v == "<s>" else value(count[(u, v)])
        n = max(n, c)
        return (c + m * out) / (n + m)

    count[("<s>",)] = len(train)
    want = Counter()
    for x in tok:
        y = ["<s>", "<s>", *x]
        want[round(sum(math.log10(p(*y[k - 2 : k + 1])) for k in range(2, len(y))), 6)] += 1
    assert Counter(round(r["score"], 6) for r in lm.score(docs(spark, rows), held).collect()) == want


def test_url_table_has_both_classes_and_generalises(spark):
    table = urlfilter.labelled_urls(spark)
    assert {r["label"]: r["count"] > 50 for r in table.groupBy("label").count().collect()} == {0: True, 1: True}
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    right = n = 0
    for k in range(5):
        w = urlfilter.fit(table.where(fold != k))
        held = table.where(fold == k).withColumn("page_id", F.xxhash64("url"))
        got = {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(held, [], w).collect()}
        truth = {r["page_id"]: "block" if r["label"] else "allow" for r in held.collect()}
        right, n = right + sum(got[i] == truth[i] for i in truth), n + len(truth)
    assert right / n > 0.75


def test_quality_leaves_clashing_columns_alone(spark):
    rows = [(i, "plain words " * 5 if i % 2 else "BAD!! " * 9) for i in range(20)] + [(None, "plain words " * 5), (3, "plain words " * 5), (3, "plain words " * 5), (40, "w " * 200_000)]
    df = docs(spark, rows).withColumn("log_weight", F.lit("mine")).withColumn("kept", F.lit("mine")).withColumn("gumbel_key", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = quality.resample(df, model)
    assert got.count() == len(rows) and dict(got.dtypes)["log_weight"] == "double"
    kept = quality.sampled(df, model)
    assert kept.schema == df.schema and {r["kept"] for r in kept.collect()} == {"mine"}
    assert Counter(r["doc_id"] for r in kept.collect())[3] in (0, 3)


def test_packing_limits_bind_and_lengths_need_little_padding(spark):
    path = queries.tokenizer_path()
    rng = random.Random(17)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(1, 30)) + "\n" + text(rng.randint(1, 900))) for i in range(60)] + [(i, "x") for i in range(100, 400)] + [(400, text(9000)), (None, "x"), (None, None), (5, "again"), (5, "again")]
    got = packing.pack_documents(docs(spark, rows).coalesce(1), path, **queries.PACKING).collect()
    seqs = {}
    for r in got:
        s = seqs.setdefault(r["sequence_id"], [0, 0, 0])
        for k, v in enumerate((r["length"], 1, r["loss_tokens"])):
            s[k] += v
    assert all(n <= 1024 and k <= 32 and b <= 960 for n, k, b in seqs.values())
    assert any(k == 32 for _, k, _ in seqs.values()) and max(b for _, _, b in seqs.values()) > 900
    short = [n for n, _, _ in seqs.values() if n & (n - 1)]
    assert sum(1024 - n for n in short) <= 1024 + 16 * len(short)
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(i for i, _ in rows)


def test_sharding_spreads_rows_of_one_id_and_text(spark):
    rows = [(7, "the same text of one id")] * 900 + [(None, "none")] * 600 + [(i, "w " * (i % 50)) for i in range(1500)] + [(9999, "long " * 30_000)]
    got = sharding.shard_documents(docs(spark, rows).repartition(4), queries.tokenizer_path()).collect()
    n = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(n.values()) < 0.1 * len(rows)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) > 5
    small = Counter(rng for rng in [(r["text_crc32"], r["shard"]) for r in got if r["size"] == 16 + 2 * 13])
    assert sum(small.values()) == 30


def test_quotes_link_parts_of_messages_and_order_replies(spark):
    long = "\n".join(f"line number {i}" if i % 7 else "" for i in range(40))
    part = "\n".join("> " + x for x in long.split("\n")[8:13])
    rows = [
        (1, 0, "user", long), (1, 1, "assistant", "Well.\n\nA paragraph\nof two lines.\n\nEnd."), (1, 2, "user", part + "\nOn part."),
        (1, 3, "user", "> A paragraph\n> of two lines.\nOn paragraph."), (1, 4, "user", "Follows."), (1, 5, "user", "> line number 9\n> line number 3\nOut of order but held."),
        (1, 6, "user", "> line number 9\n> never said\nNot held."), (1, 7, "user", "> > never\n> Follows.\nTo 4."),
    ]
    got = {r["turn"]: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: r["parent_turn"] for t, r in got.items()} == {0: None, 1: 0, 2: 0, 3: 1, 4: 3, 5: 0, 6: 5, 7: 4}
    order = [r["turn"] for r in sorted(got.values(), key=lambda r: (r["path"], r["turn"]))]

    def walk(t):
        return [t, *(x for c in sorted(k for k in got if got[k]["parent_turn"] == t) for x in walk(c))]

    assert order == walk(0)
    runs = quotes.conversations(quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).orderBy("path").collect()
    assert "".join(r["text"] for r in runs) == "".join(got[t]["formatted"] for t in order) and sum(r["messages"] for r in runs) == len(rows)


def test_quotes_of_random_trees_keep_reply_order(spark, monkeypatch):
    monkeypatch.setattr(quotes, "RUN", 4)
    rng = random.Random(18)
    rows = []
    for c in range(6):
        for t in range(40):
            quote = f"> message {c} {rng.randrange(t)}\n" if t and rng.random() < 0.4 else ""
            rows.append((c, t if c else 3 * t, "user", quote + f"message {c} {t}"))
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c in range(6):
        mine = {r["turn"]: r for r in got if r["conv_id"] == c}

        def walk(t, depth, root):
            assert (mine[t]["depth"], mine[t]["root_turn"]) == (depth, root)
            return [t, *(x for k in sorted(k for k in mine if mine[k]["parent_turn"] == t) for x in walk(k, depth + 1, root))]

        roots = sorted(t for t, r in mine.items() if r["parent_turn"] is None)
        assert [r["turn"] for r in sorted(mine.values(), key=lambda r: (r["path"], r["turn"]))] == [x for t in roots for x in walk(t, 0, t)]


def test_long_quotes_parse_in_linear_time(spark):
    text = "\n".join(("> " if i % 2 else "") + f"l{i}" for i in range(40_000))
    got = quotes.link_quotes(spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")).first()
    assert got["n_quotes"] == 20_000 and got["n_linked"] == 0 and got["body"].count("\n") == 19_999
