"""Personal data by a semi-Markov conditional random field.

Plain patterns give the base spans. Where they drop or miss something (two
numbers that stand side by side, a number that a pattern ran past, a spelt-out
address) the model chooses. A window's tokens can be cut into segments: a whole
candidate span of some kind, of bounded length, or a single token outside. A
span is scored as a whole (check digits, grouping, what stands around it), and
dynamic programming takes the cut of highest total score, so boundaries and
kinds are settled together. The model is trained here, by the gradient of the
conditional likelihood, on a bounded number of generated lines with marked
spans.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: bounds of an entity: tokens, and characters of either side of an address
MAX_TOKENS, MAX_SIDE = 24, 64
#: generated lines that the model is fitted on
TRAINING_LINES = 900

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# every ip, card and phone lies in one such region, as none of their characters stands outside it
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[0-9+(). -]*[0-9])?")
# a run of digits is taken whole, with or without three more parts, so no run is read twice
_IP = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_AT = re.compile(r" ?[(\[{<] ?(?:at|AT|@) ?[)\]}>] ?| (?:at|AT) ")
_DOT = re.compile(r" ?[(\[{<] ?(?:dot|DOT|\.) ?[)\]}>] ?| (?:dot|DOT) |\.")
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_SPELT = ("(at", "[at", "{at", "<at", "( at", "[ at", "(AT", "[AT", "{AT", "(@", "[@", "( @", "[ @", " dot ", " DOT ", "(dot", "[dot")
_CUES = frozenset("tel telephone phone call mobile fax cell card visa pay mastercard email mail contact write ip host server address order version isbn id no number page date invoice ref sku part serial since from to in".split())
#: endings of host names that addresses commonly have; fixed values
_ENDINGS = frozenset("com org net edu gov io de fr es uk it eu ch at info".split())


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The spans of the plain patterns, by kind and start; those of one kind do not overlap."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        run = len(text[last:at].rstrip(_LOCAL)) + last
        found = _DOMAIN.match(text, at + 1) if run < at else None
        if found:
            out.append(Span("email", run, found.end(), True))
        last = found.end() if found else at + 1
        at = text.find("@", last)
    regions = [m for m in _NUMBER.finditer(text) if m.end() - m.start() > 6]
    for m in regions:
        for x in _IP.finditer(text, m.start(), m.end()):
            if "." in x.group() and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in x.group().split(".")):
                out.append(Span("ip", x.start(), x.end(), True))
    for m in regions:
        for x in _CARD.finditer(text, m.start(), m.end()):
            if x.end() - x.start() >= 16 and 16 <= len(d := _digits(x.group())) <= 19 and luhn(d):
                out.append(Span("card", x.start(), x.end(), True))
    for m in regions:
        if "+" in m.group():
            out += [Span("phone", x.start(), x.end(), True) for x in _PHONE.finditer(text, m.start(), m.end()) if 8 <= len(_digits(x.group())) <= 15]
    return out


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() > 6:
            yield m.start(), m.end()


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    """Where an address may be spelt out: the sign's left side and as many labels as follow."""
    if not any(s in text for s in _SPELT):
        return
    for m in _AT.finditer(text):
        side = text[max(0, m.start() - MAX_SIDE) : m.start()]
        begin, at, labels = m.start() - len(side) + len(side.rstrip(_LOCAL)), m.end(), 0
        while (label := _LABEL.match(text, at)) and labels < 6:
            end, labels = label.end(), labels + 1
            dot = _DOT.match(text, end)
            if not dot:
                break
            at = dot.end()
        if begin < m.start() and labels > 1:
            yield begin, end


def windows(text: str) -> list[tuple[int, int]]:
    """Disjoint ranges of the text outside of which no candidate can lie."""
    out: list[list[int]] = []
    for a, b in sorted([*_numbers(text), *_spelt(text)]):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Candidate(NamedTuple):
    kind: str
    first: int  # tokens
    last: int
    start: int  # characters
    end: int


def _edge(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "none"
    c = text[at]
    return "digit" if "0" <= c <= "9" else "letter" if c.isalnum() else "space" if c.isspace() else c if c in ".-+/:#$,_=" else "mark"


def candidates(text: str, start: int, end: int, blocked: list[tuple[int, int]]) -> tuple[int, list[Candidate]]:
    """Number of the window's tokens, and the spans of bounded length that touch none of the blocked ranges."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
    taken, over = [False] * len(tokens), [y for _, y in tokens]
    for a, b in blocked:
        i = bisect.bisect_right(over, a)
        while i < len(tokens) and tokens[i][0] < b:
            taken[i] = True
            i += 1
    out = []
    for i, (a, _) in enumerate(tokens):
        c = text[a]
        if taken[i] or not ("0" <= c <= "9" or c in "+("):
            continue
        digits, runs, between, dotted, carded = 0, 0, "", True, True
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            x, y = tokens[j]
            if taken[j]:
                break
            d = text[x]
            if "0" <= d <= "9":
                digits, runs = digits + y - x, runs + 1
                if digits > 19:
                    break
                dotted = dotted and (runs == 1 or between == ".")
                carded = carded and (runs == 1 or between in ("", " ", "-"))
                between = ""
                if dotted and runs == 4 and "0" <= c <= "9":
                    out.append(Candidate("ip", i, j + 1, a, y))
                if carded and digits >= 13 and "0" <= c <= "9":
                    out.append(Candidate("card", i, j + 1, a, y))
                if 7 <= digits <= 15 and (runs > 1 or c == "+"):
                    out.append(Candidate("phone", i, j + 1, a, y))
            elif d in "+(). -":
                between += d
                if j > i and (d == "+" or len(between) > 3):
                    break
                dotted, carded = dotted and runs > 0, carded and runs > 0
            else:
                break
    begins, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    for m in _AT.finditer(text, start, end) if any(s in text[start:end] for s in ("at", "AT", "@")) else ():
        side = text[max(start, m.start() - MAX_SIDE) : m.start()]
        begin, at, labels = m.start() - len(side) + len(side.rstrip(_LOCAL)), m.end(), 0
        firsts = [x for x in range(begin, m.start()) if x in begins and not text[x] in ".-"]
        while labels < 6 and (label := _LABEL.match(text, at, end)):
            labels += 1
            if labels > 1 and label.end() in ends:
                out += [Candidate("email", begins[x], ends[label.end()], x, label.end()) for x in firsts if not any(taken[begins[x] : ends[label.end()]])]
            dot = _DOT.match(text, label.end(), end)
            if not dot:
                break
            at = dot.end()
    return len(tokens), out


def features(text: str, c: Candidate) -> list[str]:
    """What is true of a whole span, by kind."""
    span, kind = text[c.start : c.end], c.kind
    before = re.findall(r"[a-z]+", text[max(0, c.start - 14) : c.start].lower())
    cues = {w for w in before[-2:] if w in _CUES}
    said = ["", f"left {_edge(text, c.start - 1)}", f"right {_edge(text, c.end)}", *(f"cue {w}" for w in sorted(cues))]
    # a digit that follows a space may belong to the span
    if c.start >= 2 and text[c.start - 1] in " -" and "0" <= text[c.start - 2] <= "9":
        said.append("digits before")
    if c.end + 1 < len(text) and text[c.end] in " -" and "0" <= text[c.end + 1] <= "9":
        said.append("digits behind")
    if kind == "email":
        sign, parts = _AT.search(span), [p for p in _DOT.split(_AT.split(span, maxsplit=1)[-1]) if p]
        spelt = "bare" if sign and sign.group().strip().isalpha() else "bracket"
        said += [f"sign {spelt}", f"labels {min(len(parts), 4)}", "known ending" if parts[-1].lower() in _ENDINGS else f"other ending {spelt}", f"dots {'spelt' if re.search('dot|DOT', span) else 'plain'} {spelt}"]
        if c.start and text[c.start - 1] in _LOCAL:
            said.append("cut inside")
    else:
        groups = re.findall(r"[0-9]+", span)
        digits = sum(map(len, groups))
        marks = "".join(sorted(set(re.sub(r"[0-9]", "", span)))) or "none"
        shape = "-".join(str(len(g)) for g in groups)
        if kind == "ip":
            said += ["parts fit" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "parts too large"]
        elif kind == "card":
            right, long_ = luhn("".join(groups)), digits >= 16
            said += [f"check {right} {long_}", f"digits {digits} {right}", f"groups {shape if shape in ('16', '4-4-4-4', '4-6-5', '15') else 'other'} {right}", f"marks {len(marks) if marks != 'none' else 0}"]
        else:
            plus, bracket = span[0] == "+", "(" in span
            balanced = span.count("(") == span.count(")")
            said += [f"plus {plus}", f"balanced {balanced}", f"digits {digits} {plus}", f"last {'-'.join(shape.split('-')[-2:]) if max(map(len, groups)) < 8 else 'long'} {plus}", f"first {min(len(groups[0]), 5)} {plus}", f"runs {min(len(groups), 6)} {plus}", f"bracket {bracket} {plus}", f"marks {marks} {plus}", f"longest {min(max(map(len, groups)), 12)}"]
            if not plus:
                said += [f"shape {shape} {bracket}", f"cued {bool(cues & {'tel', 'telephone', 'phone', 'call', 'mobile', 'fax', 'cell'})}"]
                if c.start and text[c.start - 1] in "+(":
                    said.append("cut inside")
    return [f"{kind} {s}" for s in said]


class Model:
    """Weights of the whole-span features."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, text: str, c: Candidate) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(text, c))

    def segments(self, text: str, start: int, end: int, blocked: list[tuple[int, int]]) -> list[Span]:
        """The spans of the best cut of a window; tokens outside score 0."""
        n, found = candidates(text, start, end, blocked)
        if not found:
            return []
        by_end: dict[int, list[tuple[float, Candidate]]] = {}
        for c in found:
            if (s := self.score(text, c)) > 0:
                by_end.setdefault(c.last, []).append((s, c))
        best, chosen = [0.0] * (n + 1), [None] * (n + 1)
        for t in range(1, n + 1):
            best[t] = best[t - 1]
            for s, c in by_end.get(t, ()):
                if best[c.first] + s > best[t]:
                    best[t], chosen[t] = best[c.first] + s, c
        out, t = [], n
        while t > 0:
            c = chosen[t]
            if c is None:
                t -= 1
            else:
                out.append(Span(c.kind, c.start, c.end, False))
                t = c.first
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        """Base spans and those that the model adds beside them, by kind and start."""
        base = base_spans(text)
        held = sorted((s.start, s.end) for s in base)
        out, at = list(base), 0
        for a, b in windows(text):
            while at < len(held) and held[at][1] <= a:
                at += 1
            near = at
            while near < len(held) and held[near][0] < b:
                near += 1
            out += self.segments(text, a, b, held[at:near])
        return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def fit(lines: Iterable[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.3, decay: float = 2e-4) -> Model:
    """Weights that raise the likelihood of the marked spans among all cuts of each window (AdaGrad over all windows)."""
    number: dict[str, int] = {}
    problems = []
    for text, marked in lines:
        true = set(marked)
        for a, b in windows(text):
            n, found = candidates(text, a, b, [])
            if found:
                rows = [np.array([number.setdefault(f, len(number)) for f in features(text, c)]) for c in found]
                gold = np.array([(c.kind, c.start, c.end) in true for c in found], dtype=float)
                problems.append((n, sorted(range(len(found)), key=lambda i, found=found: found[i].last), found, rows, gold))
    flat = np.concatenate([r for p in problems for r in p[3]])
    sizes = np.array([len(r) for p in problems for r in p[3]])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    gold = np.concatenate([p[4] for p in problems])
    weights, seen = np.zeros(len(number)), np.full(len(number), 1e-6)
    for _ in range(rounds):
        score = np.add.reduceat(weights[flat], begins).tolist()
        expected, at = [], 0
        for n, order, found, rows, _g in problems:
            expected += _marginals(n, order, found, score[at : at + len(found)])
            at += len(found)
        gradient = np.bincount(flat, weights=np.repeat(gold - np.array(expected), sizes), minlength=len(weights)) - decay * len(problems) * weights
        seen += gradient**2
        weights += rate * gradient / np.sqrt(seen)
    return Model({f: round(float(weights[i]), 6) for f, i in number.items()})


def _marginals(n: int, order: list[int], found: list[Candidate], score: list[float]) -> list[float]:
    """Each candidate's probability by the forward and backward sums over all cuts."""
    forward, back = [0.0] * (n + 1), [0.0] * (n + 1)
    k = 0
    for t in range(1, n + 1):
        total = forward[t - 1]
        while k < len(order) and found[order[k]].last == t:
            total = _log_add(total, forward[found[order[k]].first] + score[order[k]])
            k += 1
        forward[t] = total
    starts: dict[int, list[int]] = {}
    for i, c in enumerate(found):
        starts.setdefault(c.first, []).append(i)
    for t in range(n - 1, -1, -1):
        total = back[t + 1]
        for i in starts.get(t, ()):
            total = _log_add(total, back[found[i].last] + score[i])
        back[t] = total
    return [math.exp(min(0.0, forward[c.first] + score[i] + back[c.last] - forward[n])) for i, c in enumerate(found)]


def training_lines(n: int = TRAINING_LINES, seed: int = 1) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented lines with their marked spans: personal data alone, side by side and spelt out, among numbers of other sorts."""
    rnd = random.Random(seed)

    def some(k: int) -> str:
        return "".join(rnd.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8)))

    def number(right: bool, k: int = 16) -> str:
        while luhn(d := str(rnd.randint(2, 9)) + some(k - 1)) != right:
            pass
        return d

    def grouped(d: str) -> str:
        mark = rnd.choice(["", "", " ", "-"])
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))

    def card() -> str:
        return grouped(number(True, 19 if rnd.random() < 0.1 else 16))

    def phone() -> str:
        a, b, c = some(3), some(3), some(4)
        return rnd.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+{rnd.randint(20, 99)} {some(2)} {some(7)}", f"+{rnd.randint(20, 99)} {a} {some(3)} {some(3)}"])

    def plain_phone() -> str:
        a, b, c = some(3), some(3), some(4)
        return rnd.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])

    def ip() -> str:
        return ".".join(str(rnd.randint(0, 255)) for _ in range(4))

    def email() -> str:
        at, dot = rnd.choice([(" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "[dot]"), (" AT ", " DOT "), (" (at) ", ".")])
        name = rnd.choice([word(), f"{word()}.{rnd.randint(1, 99)}", f"{word()}{dot if dot == '.' else '.'}{word()}"])
        return f"{name}{at}{word()}{rnd.choice(['', str(rnd.randint(0, 9))])}{dot}{rnd.choice([word() + dot, ''])}{rnd.choice(['com', 'org', 'net', 'de', 'fr'])}"

    def other() -> str:
        year = rnd.randint(1900, 2040)
        return rnd.choice([
            grouped(number(False)), number(False), number(False, 19), number(rnd.random() < 0.5, rnd.choice([13, 14, 15])), some(rnd.randint(20, 30)), f"{year}-{some(2)}-{some(2)}", f"{year}-{year + 5}", f"{year} {year + 1} {year + 2}",
            f"978-{some(1)}-{some(2)}-{some(6)}-{some(1)}", ".".join(str(rnd.randint(0, 30)) for _ in range(rnd.choice([2, 3, 5, 6]))), f"{rnd.randint(256, 999)}.{some(3)}.{some(2)}.{some(2)}", f"{some(2)} {some(2)} {some(3)} {some(2)}",
            f"{some(3)}.{some(3)}.{some(3)}", f"{some(1)}.{some(3)}.{some(3)} {some(4)}", f"look at {word()} dot {word()}", f"{word()} at {word()}.{word()}", f"{some(4)}-{some(4)}-{some(3)}", f"#{some(9)}", f"{some(5)}-{some(4)}", f"({year}) {some(3)}-{some(3)}", f"{some(8)} {some(6)}", f"{some(10)}",
        ])

    cued = {"phone": ["tel", "phone", "call", "mobile", "fax"], "card": ["card", "visa"], "ip": ["host", "server", "ip"], "email": ["mail", "email", "contact", "write"]}
    stray = ["order", "version", "isbn", "id", "page", "invoice", "part", "serial", "no", "from", "in"]
    made: dict[str, Callable[[], str]] = {"card": card, "phone": phone, "ip": ip, "email": email}
    out = []
    for _ in range(n):
        text, marked = word() + " ", []
        for _ in range(rnd.randint(1, 4)):
            kind = rnd.choice([*made, "phone", "card", "other", "other", "plain"])
            cue = rnd.random() < 0.3
            if kind == "other":
                text += f"{rnd.choice(stray)} " * cue + other()
            elif kind == "plain":
                if bare := rnd.random() < 0.15:
                    text += f"{rnd.choice(stray)} "
                else:
                    text += f"{rnd.choice(cued['phone'])} "
                said = plain_phone()
                if not bare or "(" in said:
                    marked.append(("phone", len(text), len(text) + len(said)))
                text += said
            else:
                said = made[kind]()
                text += f"{rnd.choice(cued[kind])} " * cue
                marked.append((kind, len(text), len(text) + len(said)))
                text += said
            # what follows may touch: one space is all that parts two numbers
            text += rnd.choice([" ", " ", f" {word()} ", ", ", f". {word()} ", f" {word()} {word()} "])
        out.append((text + word(), marked))
    return out


def trained(lines: int = TRAINING_LINES) -> Model:
    """The model fitted on `lines` generated lines."""
    return fit(training_lines(lines))


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): personal data in every whole text, as (kind, start, end, base) by kind and start.

    Offsets count code points, the end is exclusive. Kinds are those of KINDS,
    in that order; `base` marks the spans of the plain patterns, which always
    stay; the model's own overlap none of them. A null or empty text has no
    spans, every row is judged for itself however often it repeats, null ids
    stay null, an empty table gives no rows, a text of any length is read whole,
    and other columns are left out, whatever their names.
    """
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            found = [[s._asdict() for s in model.spans(t)] if t else [] for t in (x.as_py() for x in batch["text"])]
            yield pa.record_batch([batch["id"], pa.array(found, arrow)], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, spans {_SPANS}").withColumnRenamed("id", id_col)


def masked(text: str, spans: Iterable[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping ones the first is named."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in `text_col` replaced by its kind; nulls stay."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            new = pa.array([masked(t, model.spans(t)) if t else t for t in (x.as_py() for x in batch.column(place))], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), new)

    return docs.mapInArrow(run, docs.schema)
