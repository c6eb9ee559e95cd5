import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duovox.llm import pii

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * 2 if k % 2 else int(c) for k, c in enumerate(reversed(digits))]
            fine = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else 0, 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in twice) % 10 == 0, 9 <= len(digits) <= 15]
            if fine[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("aB@.-_+%1250() 4é"), max_size=40))
def test_patterns_against_plain_expressions(text):
    assert pii.base_spans(text) == plain(text)


def test_known_cases():
    text = "é a.b@c.d_e@f.g x@y 1.2.3.4.5 256.1.1.1, 4111 1111-1111 1111 +1 (918) 555-4124, 01.002.3.4"
    assert pii.base_spans(text) == plain(text) and len(pii.base_spans(text)) == 6
    assert pii.base_spans("4" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "in", "an", "ou"]) for _ in range(rnd.randrange(1, 4)))

    def card():
        d = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def thing():
        return rnd.choice([
            lambda: f"{word()}.{rnd.randrange(10, 99)}@mail{rnd.randrange(9)}.example.com", lambda: ".".join(str(rnd.randrange(1, 255)) for _ in range(4)), card,
            lambda: f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}", lambda: str(rnd.randrange(2000)), lambda: f"{rnd.randrange(10**9, 10**10)}",
        ])()

    return [" ".join([*(word() for _ in range(8)), thing(), *(word() for _ in range(8))]) for _ in range(n)]


def examples(texts):
    return [e for t in texts for w in [pii.windows(t)] if w for e in [pii.labelled(t, w[0][0], w[-1][1])] if e]


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.examples(corpus(1, 400), 1200))


def test_held_out_segmentations(field):
    held = examples(corpus(2, 300))
    right = sum(sorted(lattice.best(lattice.score(field))) == sorted(gold) for lattice, gold in held)
    assert right >= 0.97 * len(held) > 250
    # two neighbours that the patterns run together, at the production threshold
    card = next(f"4917662368411{k:03}" for k in range(1000) if pii.luhn(f"4917662368411{k:03}"))
    text = f"to +1 (918) 555-4124 {card} or"
    assert pii.base_spans(text) == []
    assert pii.added_spans(text, [], field) == [(3, 3, 20), (21, 2, 37)]
    assert not any(pii.added_spans(t, pii.base_spans(t), field) for t in ["version 2.0 of 3 things", "in 1999 and 2024", "a@b", "no"])


def test_added_spans_held_out(field):
    """Spans that the patterns miss, made with another seed: precision and recall at the production threshold."""
    hit = wanted = given_ = 0
    for text, spans in pii.made_texts(corpus(2, 300), 800, seed=99):
        base = pii.base_spans(text)
        missed = {s for s in spans if not any(a < s[2] and s[0] < b for a, _, b in base)}
        added = set(pii.added_spans(text, base, field))
        hit, wanted, given_ = hit + len(missed & added), wanted + len(missed), given_ + len(added)
    assert wanted > 300 and hit >= 0.9 * wanted and hit >= 0.97 * given_


def test_long_text_without_white_space(field):
    text = "12,3456," * 2000
    assert max(b - a for a, b in pii.windows(text)) <= pii.WINDOW and pii.windows(text)[-1][1] == len(text)
    assert pii.added_spans(text, pii.base_spans(text), field) == []
    for lead in range(0, pii.WINDOW, 61):  # a span near a cut is found whole, once
        text = "x," * (lead // 2) + "y;jane.roe[at]mail.example.com;" + "z," * 400
        assert len(pii.windows(text)) >= 1 and all(0 <= a < b <= len(text) for a, b in pii.windows(text))


def test_long_numbers_take_linear_time(field):
    """A number of any length before any sign: a grouped number has one parse."""
    for n in (20, 27, 40, 64):
        for end in (", thanks", ". x", "; 4", ":", "/"):
            text = f"the number is {'7' * n}{end}"
            began = time.perf_counter()
            pii.added_spans(text, pii.base_spans(text), field)
            assert time.perf_counter() - began < 0.5, (n, end)
    chars = random.Random(1)
    text = "".join(chars.choice("0123456789,") for _ in range(20_000))
    began = time.perf_counter()
    pii.added_spans(text, pii.base_spans(text), field)
    assert time.perf_counter() - began < 30
    old, new = re.compile(r"[0-9]+([ ./-]?[0-9]+)*"), pii._grouped
    for _ in range(3000):
        s = "".join(chars.choice("12 .-/,a") for _ in range(chars.randrange(1, 12)))
        assert bool(old.fullmatch(s)) == bool(new.fullmatch(s)), s


def test_sums_and_best_against_all_segmentations():
    text = "12345678 9@1"
    lattice = pii.Lattice(text, 0, len(text))
    rng = np.random.default_rng(3)
    score = rng.normal(size=(len(lattice.where), len(pii.KINDS)))

    def walk(t):
        if t == lattice.n:
            yield 0.0, ()
            return
        for s, path in walk(t + 1):
            yield s, path
        for k, (i, j, _, _) in enumerate(lattice.where):
            if i == t:
                for kind in range(len(pii.KINDS)):
                    for s, path in walk(j):
                        yield s + score[k, kind], ((k, kind), *path)

    every = list(walk(0))
    total, p = lattice.sums(score)
    z = sum(np.exp(s) for s, _ in every)
    assert abs(total - np.log(z)) < 1e-9
    for k in range(len(lattice.where)):
        for kind in range(len(pii.KINDS)):
            assert abs(p[k, kind] - sum(np.exp(s) for s, path in every if (k, kind) in path) / z) < 1e-9
    top = max(every)
    assert tuple(lattice.best(score)) == top[1]


def test_table(spark):
    texts = [None, "", *corpus(3, 60), "x 1.2.3.4 " * 5000]
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_ip int").repartition(3)
    got = pii.private_spans(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[5 if r.doc_id is None else r.doc_id] or ""
        want = plain(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.said(want).encode()).hexdigest()
        assert set(pii.said(want).split(",")) - {""} <= set(r.spans.split(","))
    assert pii.private_spans(docs.limit(0)).collect() == []
