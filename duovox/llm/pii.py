"""Personal data: fixed patterns, and a semi-Markov conditional random field that chooses spans and types together.

A text is cut into windows around digits and at-signs, a window into tokens. The field scores whole segments of up to LONGEST
tokens as one entity, everything else as single outside tokens; forward sums over all segmentations give its likelihood
in training, and the best segmentation and its probabilities in use.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duovox.llm.common import batch_udf, ready, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
#: The patterns. A run of digits starts an address only at its first digit, which changes no match but keeps long runs linear.
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LONGEST = 16
WIDEST = 64
BINS = 1 << 14
SURE = 0.95
#: Characters of a window at most; longer ones are cut into pieces that overlap by WIDEST.
WINDOW = 384
_digit = re.compile("[0-9]")
_anchor = re.compile(r"[0-9@]+|[\[(](?:at|AT)[\])]")
#: Each text has one parse: with an optional separator a long number would be split in exponentially many ways.
_grouped = re.compile(r"[0-9]+(?:[ ./-][0-9]+)*")
_token = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at-sign and domain, in one pass: the local part is the run before each at-sign."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all pattern matches, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _digit.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def windows(text: str) -> list[tuple[int, int]]:
    """Words that hold a digit, at-sign or written [at]; such words with one white space between them share a window. At most WINDOW
    characters each: a longer stretch gives pieces that overlap by WIDEST, so every span of that width lies whole in one of them."""
    out: list[list[int]] = []
    for m in _anchor.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        floor = out[-1][1] if out else 0
        a = m.start()
        while a > floor and not text[a - 1].isspace():
            a -= 1
        b = m.end()
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a - out[-1][1] <= 1:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(at, min(b, at + WINDOW)) for a, b in out for at in range(a, max(a + 1, b - WIDEST), WINDOW - WIDEST)]


def segments(tokens: list[tuple[str, int]]) -> list[tuple[int, int, str]]:
    """Candidate entities (first token, token after the last, text): of bounded length, without white space at
    their ends, with an at-sign, plain or written, seven digits, or four numbers with points between them."""
    out = []
    for i, (word, at) in enumerate(tokens):
        if word.isspace():
            continue
        text, digits, numbers, points = "", 0, 0, 0
        for j in range(i, min(len(tokens), i + LONGEST)):
            piece = tokens[j][0]
            text += piece
            if len(text) > WIDEST:
                break
            if piece.isdigit():
                digits, numbers = digits + len(piece), numbers + 1
            points += piece == "."
            if not piece.isspace() and (digits >= 7 or numbers == 4 and points >= 3 or "@" in text or "at]" in text or "at)" in text):
                out.append((i, j + 1, text))
    return out


@functools.lru_cache(maxsize=20_000)
def span_features(text: str, before: str, after: str, word: str) -> np.ndarray:
    """Bins of a candidate's features: outline, counts, checks and surroundings of the whole span."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    outline = re.sub(r"[0-9]+", "0", re.sub(r"[A-Za-z]+", "a", text))
    exact = re.sub(r"[0-9]", "0", re.sub(r"[A-Za-z]+", "a", text))
    plain = text.replace("[.]", ".").replace("[at]", "@").replace("(at)", "@")
    parts = plain.split(".")
    grouped = _grouped.fullmatch(text) is not None
    edge = lambda c: "a" if c.isalnum() else c
    names = [
        "bias", "outline " + outline, "exact " + exact[:32], f"digits {len(digits)}", f"dots {text.count('.')}", f"at {text.count('@')}", f"plus {text[:1] == '+'} {len(digits)}",
        f"card {12 <= len(digits) <= 19 and grouped and luhn(digits)} {len(digits) == len(text)}", f"ip {len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}",
        f"ends {edge(text[0])} {edge(text[-1])}", f"before {edge(before)} {edge(text[0])}", f"after {edge(text[-1])} {edge(after)}", "word " + word.lower(), f"domain {re.sub('[A-Za-z]+', 'a', plain.rpartition('@')[2]) if '@' in plain else ''}", f"phone {text[:1] in '+('} {grouped} {len(digits)} {text.count('-') + text.count(' ')}",
    ]
    return np.array([xxhash.xxh3_64_intdigest(n.encode("utf-8", "replace")) % BINS for n in names])


class Lattice:
    """All segmentations of one window: tokens, candidate segments and their features."""

    def __init__(self, text: str, start: int, end: int):
        self.tokens = [(m[0], m.start() + start) for m in _token.finditer(text[start:end])]
        n = len(self.tokens)
        word = text[max(0, start - 24) : start].split()
        around = lambda k: text[k] if 0 <= k < len(text) else "^"
        self.where, rows = [], []
        for i, j, span in segments(self.tokens):
            a, b = self.tokens[i][1], self.tokens[j - 1][1] + len(self.tokens[j - 1][0])
            self.where.append((i, j, a, b))
            left = self.tokens[i - 2][0] if i >= 2 else word[-1] if word and i == 0 else ""
            rows.append(span_features(span, around(a - 1), around(b), left))
        self.n, self.rows = n, np.array(rows) if rows else np.empty((0, 1), int)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Score of each candidate as each kind; an outside token scores 0."""
        return weights[:, self.rows].sum(axis=2).T if len(self.where) else np.empty((0, len(KINDS)))

    def sums(self, score: np.ndarray) -> tuple[float, np.ndarray]:
        """Log of the sum over all segmentations, and the probability of each candidate as each kind."""
        ahead, back = [-math.inf] * (self.n + 1), [-math.inf] * (self.n + 1)
        best = np.logaddexp.reduce(score, axis=1) if len(score) else score[:, 0]
        ending, starting = {}, {}
        for k, (i, j, _, _) in enumerate(self.where):
            ending.setdefault(j, []).append((i, best[k]))
            starting.setdefault(i, []).append((j, best[k]))
        ahead[0] = back[self.n] = 0.0
        for t in range(1, self.n + 1):
            ahead[t] = _log_sum([ahead[t - 1], *(ahead[i] + s for i, s in ending.get(t, ()))])
        for t in range(self.n - 1, -1, -1):
            back[t] = _log_sum([back[t + 1], *(back[j] + s for j, s in starting.get(t, ()))])
        total = ahead[self.n]
        rest = np.array([ahead[i] + back[j] - total for i, j, _, _ in self.where])
        return total, np.exp(score + rest[:, None]) if len(score) else score

    def best(self, score: np.ndarray) -> list[tuple[int, int]]:
        """Candidates and kinds of the best segmentation."""
        value, step = [0.0] * (self.n + 1), [None] * (self.n + 1)
        ending: dict[int, list] = {}
        kind = score.argmax(axis=1) if len(score) else ()
        for k, (i, j, _, _) in enumerate(self.where):
            ending.setdefault(j, []).append((i, k, score[k, kind[k]]))
        for t in range(1, self.n + 1):
            value[t] = value[t - 1]
            for i, k, s in ending.get(t, ()):
                if value[i] + s > value[t]:
                    value[t], step[t] = value[i] + s, (i, k)
        out, t = [], self.n
        while t:
            if step[t]:
                t, k = step[t]
                out.append((k, int(kind[k])))
            else:
                t -= 1
        return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def fit(examples: list[tuple[Lattice, list[tuple[int, int]]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights (kind, bin) that raise the likelihood of the given segmentations (candidate, kind), by adaptive gradient steps."""
    weights, squares = np.zeros((len(KINDS), BINS)), np.full((len(KINDS), BINS), 1e-6)
    weights[:, span_features(" ", " ", " ", "")[0]] = -2.0  # the bias: without evidence a span is no entity
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for e in order.permutation(len(examples)):
            lattice, gold = examples[e]
            if not len(lattice.where):
                continue
            _, p = lattice.sums(lattice.score(weights))
            wrong = -p
            for k, kind in gold:
                wrong[k, kind] += 1
            used = np.flatnonzero(np.abs(wrong).max(axis=1) > 1e-4)
            if not len(used):
                continue
            bins = lattice.rows[used]
            for kind in range(len(KINDS)):
                g = np.bincount(bins.ravel(), np.repeat(wrong[used, kind], bins.shape[1]), BINS)
                at = np.flatnonzero(g)
                g = g[at] - decay * weights[kind, at]
                squares[kind, at] += g * g
                weights[kind, at] += rate * g / np.sqrt(squares[kind, at])
    return weights


def labelled(text: str, start: int, end: int, known: list[tuple[int, int, int]] | None = None) -> tuple[Lattice, list[tuple[int, int]]] | None:
    """A window with known spans (those of the patterns, if not given) as its segmentation; None if some of them isn't a candidate
    or they overlap, and for windows without any that hold a candidate which checks as a number: the patterns may have missed it."""
    lattice = Lattice(text, start, end)
    at = {(a, b): k for k, (_, _, a, b) in enumerate(lattice.where)}
    gold, last = [], -1
    for a, kind, b in base_spans(text) if known is None else known:
        if (a, b) not in at or a < last:
            return None
        last = b
        gold.append((at[a, b], kind))
    if known is None and not gold and any(base_spans(text[a:b]) for _, _, a, b in lattice.where):
        return None
    return lattice, gold


def made_texts(contexts: list[str], count: int, seed: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with known spans, by rule, of what the patterns miss or cut wrongly: numbers run together, other separators, phones without a
    plus, addresses with written at-signs and bracketed points, and look-alikes that are nothing. Contexts give the words around them."""
    rnd = random.Random(seed)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    words = sorted({w for c in contexts for w in re.findall("[^0-9@ \\s]{2,12}", c)}) or ["of"]
    name = lambda: "".join(c for c in rnd.choice(words) if c.isascii() and c.isalpha()) or "name"

    def card(gap: str) -> str:
        body = rnd.choice("3456") + digits(14)
        body = next(body + c for c in "0123456789" if luhn(body + c))
        return gap.join(body[k : k + 4] for k in range(0, 16, 4))

    host = lambda: f"{name()}{rnd.choice(['', digits(1)])}.{rnd.choice(['example.com', 'example.org', name() + '.net'])}".lower()
    user = lambda: f"{name()}{rnd.choice(['', '.' + name(), '.' + digits(2), '_' + digits(1)])}".lower()
    phone = lambda: f"+{rnd.choice(['1', '44', '49', '33'])} ({digits(3)}) {digits(3)}-{digits(4)}"
    local = lambda: rnd.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
    address = lambda: [str(rnd.randrange(1, 256)) for _ in range(4)]
    bad = lambda: next(d for d in iter(lambda: rnd.choice("3456") + digits(15), "") if not luhn(d))
    rules = [
        lambda: [(card(""), 2), (" ", None), (card(""), 2)], lambda: [(phone(), 3), (" ", None), (card(""), 2)], lambda: [(card(""), 2), (" ", None), (bad(), None)],
        lambda: [(bad(), None), (" ", None), (card(""), 2)], lambda: [(card("."), 2)], lambda: [(card("/"), 2)], lambda: [(local(), 3)], lambda: [(local(), 3)],
        lambda: [(f"{user()}[at]{host()}", 0)], lambda: [(f"{user()}(at){host()}", 0)], lambda: [("[.]".join(address()), 1)],
        lambda: [(card(""), 2)], lambda: [(phone(), 3)], lambda: [(f"{user()}@{host()}", 0)], lambda: [(".".join(address()), 1)],
        lambda: [(bad(), None)], lambda: [(bad(), None), (" ", None), (bad(), None)], lambda: [(digits(rnd.randrange(7, 12)), None)], lambda: [(f"20{digits(2)}-0{rnd.randrange(1, 9)}-1{digits(1)}", None)],
        lambda: [(f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}", None)], lambda: [(f"978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", None)], lambda: [(f"v{digits(1)}.{digits(1)}.{digits(2)}", None)], lambda: [(f"{digits(8)}/{digits(4)}", None)],
    ]
    out = []
    for _ in range(count):
        text, spans = " ".join(rnd.choice(words) for _ in range(3)) + " ", []
        for part, kind in rnd.choice(rules)():
            if kind is not None:
                spans.append((len(text), kind, len(text) + len(part)))
            text += part
        out.append((f"{text} {rnd.choice(words)}", spans))
    return out


def training_windows(docs: DataFrame, sample: int) -> list[str]:
    """At most `sample` windows, each with 24 characters before it, taken by least hash from all documents; copies count once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text in f["text"]:
                for a, b in windows(text):
                    cut = text[max(0, a - 24) : b + 1]
                    rows.append((int.from_bytes(hashlib.blake2b(cut.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1, cut))
            yield pd.DataFrame(rows, columns=["order", "cut"])

    picked = docs.mapInPandas(run, "order long, cut string").groupBy("order").agg(F.min("cut").alias("cut")).orderBy("order").limit(sample)
    return [r["cut"] for r in picked.collect()]


def examples(cuts: list[str], made: int, seed: int = 0) -> list[tuple[Lattice, list[tuple[int, int]]]]:
    """Windows with the patterns' spans, and `made` windows with spans by rule."""
    real = [e for cut in cuts if (w := windows(cut)) if (e := labelled(cut, w[0][0], w[-1][1]))]
    ruled = [e for text, spans in made_texts(cuts, made, seed) if (w := windows(text)) if (e := labelled(text, w[0][0], w[-1][1], spans))]
    return real + ruled


def train(docs: DataFrame, sample: int = 800, made: int = 1200) -> np.ndarray:
    """Weights from a bounded sample of windows of docs (text), labelled by the patterns, and from as bounded a number of windows made by
    rule, labelled by what was put in. Without any windows in docs nothing is learned."""
    cuts = training_windows(docs, sample)
    return fit(examples(cuts, made)) if cuts else fit([])


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray, sure: float = SURE) -> list[tuple[int, int, int]]:
    """Spans of the best segmentations that touch no pattern span, nor a cut between two pieces of a long window, and have a probability of at least sure.

    base: ascending; each window meets only the pattern spans near it.
    """
    out: list[tuple[int, int, int]] = []
    first, last = 0, -1
    reach = max((b - a for a, _, b in base), default=0)
    for start, end in windows(text):
        while first < len(base) and base[first][0] + reach <= start:
            first += 1
        here = []
        for a, _, b in base[first:]:
            if a >= end:
                break
            if start < b:
                here.append((a, b))
        lattice = Lattice(text, start, end)
        if all(any(a < w[3] and w[2] < b for a, b in here) for w in lattice.where):
            continue
        score = lattice.score(weights)
        if score.max() <= 0:
            continue
        left = start > 0 and not text[start - 1].isspace()
        right = end < len(text) and not text[end].isspace()
        _, p = lattice.sums(score)
        for k, kind in lattice.best(score):
            _, _, a, b = lattice.where[k]
            cut = left and a == start or right and b == end
            if p[k, kind] >= sure and a >= last and not cut and not any(x < b and a < y for x, y in here):
                out.append((a, kind, b))
                last = b
    return out


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def private_spans(docs: DataFrame, sample: int = 800) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of each row's whole text; offsets in code points.

    The counts and base_sha256 are of the patterns alone. Null texts are empty; null ids and repeated rows pass through; other
    columns are ignored; an empty table gives no rows. A long text is worked on window by window, each of bounded size. One pass without
    a shuffle, after one that draws the training windows. Without windows nothing is added.
    """
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(slim.select("text"), sample))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for texts in parts:
            rows = []
            for text in texts:
                base = base_spans(text)
                more = added_spans(text, base, weights) if _anchor.search(text) else []
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(said(base).encode()).hexdigest(), said(base + more), len(more)))
            yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    spans = batch_udf(run, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return slim.select("doc_id", spans("text").alias("_out")).select("doc_id", "_out.*")
