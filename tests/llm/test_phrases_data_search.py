"""Collocations, personal data and lexical search against plain versions, and on odd input."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.llm import collocation, lexical, pii, quotient

LOWER = {c: c + 32 for c in range(65, 91)}
#: extra columns named like those that the operators use inside
CLASHING = "id n words terms freqs term df chunk at codes shard f rank score row q norm range spans start kind place".split()


def table(spark, rows, names):
    """Rows with clashing columns beside, null in every other row."""
    return spark.createDataFrame(rows, names).select("*", *(F.when(F.rand(3) > 0.5, F.lit("mine")).alias(c) for c in CLASHING)).repartition(3)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 4), st.integers(1, 32), st.integers(1, 9), st.lists(st.lists(st.integers(0, (1 << 32) - 1), min_size=4, max_size=4), max_size=60))
def test_filters_lose_nothing(words, bits, shards, grams):
    grams = [tuple(x % (1 << bits) for x in g[:words]) for g in grams]
    grams += grams[: len(grams) // 3]
    columns = [np.array([g[i] for g in grams], np.uint64) for i in range(words)]
    keys, counts, inverse = quotient.counted(quotient.permuted(columns, bits))
    high, low = quotient.key_bits(words, bits)
    step, begins = quotient.ranges(high, shards)
    cuts = [*np.searchsorted(keys.high, np.array(begins, np.uint64)).tolist(), len(counts)]
    found, many = Counter(), Counter(grams)
    for begin, a, b in zip(begins, cuts[:-1], cuts[1:], strict=True):
        if a < b:
            one = quotient.encode(keys.take(slice(a, b)), counts[a:b], begin, step, low)
            back, total, places = quotient.merged([one, one])
            assert (total == 2 * counts[a:b]).all() and all(len(p) == b - a for p in places)
            found.update(dict(zip(zip(*(x.tolist() for x in quotient.restored(back, words, bits)), strict=True), (total // 2).tolist(), strict=True)))
    assert found == many
    assert len(inverse) == len(grams)


def test_large_counters():
    keys, _, _ = quotient.counted(quotient.permuted([np.arange(300, dtype=np.uint64), np.arange(300, dtype=np.uint64)], 9))
    counts = np.array([1, 2, 3, 256, 257, 70_000, 1 << 40] * 50)[:300]
    back, total = quotient.decode(quotient.encode(keys, counts, 0, 1 << 18, 0))
    assert (back.high == keys.high).all() and (total == counts).all()


def phrases_of(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, g in f.items():
        found = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * g[p[i : i + k]]}
        ranked = []
        for p, a in found.items():
            if p not in inside:
                s, k = min((2_000_000 * a // (g[p[:k]] + g[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations(spark, monkeypatch):
    rnd = random.Random(5)
    few = ["ab", "Cd", "é", "x-y", "(q", "日本"]
    rows = [(rnd.choice(["en", "de", None]), " ".join(rnd.choice(few) + rnd.choice(["", "", "", ". ", "\n", "\t", " ,"]) for _ in range(rnd.randint(0, 40)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " \t "), ("en", "one two three four five " * 9), ("zz", "tie a. tie b. tie c. " * 8)] + [("fr", "same same same same")] * 9
    rows.append(("en", " ".join(rnd.choice(few) for _ in range(60_000))))
    docs = table(spark, [(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    for chunk, least, top in ((1 << 10, 4, 7), (8 << 20, 8, 2000)):
        monkeypatch.setattr(collocation, "CHUNK_BYTES", chunk)
        got = collocation.collocations(docs, least, top).select(COLUMNS)
        assert sorted(map(tuple, got.collect())) == phrases_of(rows, least, top)
    assert got.schema.simpleString() == "struct<lang:string,rank:int,phrase:string,a:bigint,l:bigint,r:bigint,n:bigint,score:bigint>"
    assert collocation.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    rows = [(1, 0, 0, 0, 1, big), (2, 0, 0, 0, 1, big + 1), (1, 2, 0, 0, 2, big - 7)]
    got = collocation.scored(spark.createDataFrame(rows, "w1 long, w2 long, w3 long, w4 long, words int, f long")).first()
    assert got["score"] == 2_000_000 * (big - 7) // (2 * big + 1)


def plain_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text("0123456789012345 .-+()@ab.é", max_size=70))
def test_base_spans_are_those_of_the_patterns(text):
    assert [tuple(s[:3]) for s in pii.base_spans(text)] == plain_spans(text)


@pytest.fixture(scope="module")
def model():
    return pii.trained()


@settings(max_examples=80, deadline=None)
@given(st.text("0123456789 -+.()", min_size=7, max_size=34))
def test_best_cut_and_probabilities(text):
    rnd = random.Random(text)
    weights = defaultdict(lambda: rnd.uniform(-1, 1.5))
    model = pii.Model({})
    model.score = lambda t, c: weights[c]
    for a, b in pii.windows(text):
        n, found = pii.candidates(text, a, b, [])
        if not 0 < len(found) <= 12:
            continue
        cuts = [s for k in range(len(found) + 1) for s in itertools.combinations(found, k) if all(x.last <= y.first or y.last <= x.first for x, y in itertools.combinations(s, 2))]
        totals = [sum(weights[c] for c in s) for s in cuts]
        got = model.segments(text, a, b, [])
        assert sum(weights[c] for c in found if pii.Span(c.kind, c.start, c.end, False) in got) == pytest.approx(max(totals))
        mass = [math.exp(t) for t in totals]
        order = sorted(range(len(found)), key=lambda i: found[i].last)
        share = [sum(m for m, s in zip(mass, cuts, strict=True) if c in s) / sum(mass) for c in found]
        assert pii._marginals(n, order, found, [weights[c] for c in found]) == pytest.approx(share)


def test_held_out_lines(model):
    right = added = missed = 0
    for text, marked in pii.training_lines(400, seed=7):
        got, want = {tuple(s[:3]) for s in model.spans(text)}, set(marked)
        right, added, missed = right + len(got & want), added + len(got - want), missed + len(want - got)
    assert right / (right + added) > 0.97 and right / (right + missed) > 0.98


def test_boundaries_between_neighbours(model):
    card, other = "4524132264652876", "4918187128635271"

    def kinds(text):
        return [(s.kind, text[s.start : s.end]) for s in model.spans(text)]

    assert kinds(f"see +1 (269) 555-3296 {card} and") == [("card", card), ("phone", "+1 (269) 555-3296")]
    assert kinds(f"both {card} {other} here") == [("card", card), ("card", other)]
    assert kinds("both 7536784127813051 4845168114407328 here") == []
    assert kinds("write jo.19 (at) mail5 (dot) example (dot) com today") == [("email", "jo.19 (at) mail5 (dot) example (dot) com")]
    assert kinds("1.2.3.4 " * 20_000) == [("ip", "1.2.3.4")] * 20_000
    assert kinds("version 1.2.3, page 2020-01-02, order 4785380592391138, 978-3-16-148410-0") == []


def test_find_spans(spark, model):
    rows = [(1, "a@b.co 1.2.3.4 é +1 (269) 555-3296 4524132264652876"), (1, "a@b.co"), (2, None), (3, ""), (None, "999.1.1.1"), (4, "7" * 500_000), (4, "0" * 6_000 + ".1.1.1"), (5, "1 " * 3_000), (6, "@" * 50_000 + "a." * 50_000), (7, "+(" * 50_000 + "1"), (7, "x" * 300_000 + "@b.c")]
    docs = table(spark, rows, "doc_id long, text string")
    found = pii.find_spans(docs, model)
    assert found.columns == ["doc_id", "spans"]
    got = Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"])) for r in found.collect())
    assert got == Counter((i, tuple(tuple(s) for s in model.spans(t or ""))) for i, t in rows)
    assert all([tuple(s[:3]) for s in model.spans(t or "") if s.base] == plain_spans(t or "") for _, t in rows[:5])
    first = [tuple(s) for s in model.spans(rows[0][1])]
    assert first == [("email", 0, 6, True), ("ip", 7, 14, True), ("card", 35, 51, False), ("phone", 17, 34, False)]
    hidden = pii.mask_documents(docs.where("doc_id = 1"), model)
    assert hidden.columns == docs.columns
    assert {r["text"] for r in hidden.collect()} == {"[email] [ip] é [phone] [card]", "[email]"}
    assert pii.find_spans(docs.limit(0), model).count() == 0


def ranks_of(docs, items, k):
    term = re.compile(lexical.TERM)
    held = [(i, Counter(term.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, w, sum(w.values())) for i, w in held if w]
    n, words, df = len(held), sum(x for *_, x in held), Counter(t for _, w, _ in held for t in w)
    out = []
    for item, text in items:
        asked, found = set(term.findall((text or "").translate(LOWER))), []
        for i, w, size in held:
            m = 10 + 90 * size * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t in asked if t in w)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize("bucket", [3, 4096])
def test_lexical_search(spark, monkeypatch, bucket):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "RANGE_ENTRIES", 200)
    rnd = random.Random(9)
    few = ["alpha", "Beta", "GAMMA9", "éta", "d", "日本", "e", "f", "g", "h", "common"]
    docs = [(i, " ".join(rnd.choice(few[: rnd.randint(1, 11)]) + rnd.choice(["", ",", "-"]) for _ in range(rnd.randint(1, 60)))) for i in range(150)]
    docs += [(300 + i, "alpha beta d") for i in range(70)] + [(None, "alpha beta d"), (5, "alpha beta d"), (400, None), (401, ""), (402, " ., "), (403, "common " * 50_000 + "alpha")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "nothing here fits"), (None, "d d d Common"), (5, " ".join(few)), (6, "éta-日本")]
    got = lexical.rank_documents(table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string"), 10)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    assert Counter(map(tuple, got.collect())) == ranks_of(docs, items, 10)


def test_lexical_passes_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(9)], "item_id long, text string")
    monkeypatch.setattr(lexical, "QUERY_BYTES", 12)
    got = Counter(map(tuple, lexical.rank_documents(docs, items, 3).collect()))
    assert got == ranks_of([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 3)
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0
