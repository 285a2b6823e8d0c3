import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from textscore.llm import charmodel, pii
from tests.llm.helpers import docs, empty, odd_docs, words

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                    "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+%01259 (),é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_of_written_cases():
    text = ("a.b@c.d-e.fr x@y @z.com a@b@c.de 1.2.3.4.5 256.1.1.1 001.2.3.255 x 4111 1111 1111 1111, 4111-1111-1111-1112 "
            "+1 (555) 555-0100. +12 é +99 888-77 6666 5555 4444 1.2.3.4.5.6.7.8")
    assert pii.base_spans(text) == brute(text)
    assert {k for k, _, _ in pii.base_spans(text)} == set(pii.KINDS)
    assert pii.base_spans("9" * 20_000 + "." + "0" * 9000 + "1.2.3") == brute("9" * 4000 + ".1.2.3")[:0]


def planted(n):
    fill = lambda s: " ".join(words(15, s, 10 ** 4)).replace("w", "word")
    kinds = [lambda i: f"user{i}.name@mail{i % 9}.example.com", lambda i: f"{i % 200 + 3}.44.{i % 251}.7",
             lambda i: "4111 1111 1111 1111", lambda i: f"+1 ({200 + i % 700}) 555-{1000 + i}"]
    return [f"{fill(i)} {kinds[i % 4](i)} {fill(i + 5000)} {i}" for i in range(n)] + [fill(i) for i in range(9000, 9020)]


@pytest.fixture(scope="module")
def model():
    m = charmodel.Model(pii.KINDS, 16)
    m.losses = m.fit(*pii.training_windows(planted(160)), steps=220)
    return m


def test_training_lowers_the_loss_and_finds_spans_of_unseen_texts(model):
    assert model.losses[-1] < model.losses[0] / 50
    texts = planted(400)[200:400]
    found = pii.model_spans(model, texts)
    base = [set(pii.base_spans(t)) for t in texts]
    hits = sum(len(b & {s[:3] for s in f}) for b, f in zip(base, found))
    assert hits >= 0.8 * sum(map(len, base))


def test_windows_without_an_anchor_change_nothing(model):
    texts = planted(40) + ["x" * 500, "é" * 100 + " 1", "", " ".join(words(400, 3))]
    assert pii.model_spans(model, texts) == pii.model_spans(model, texts, every=True)


class Marks:
    """Decodes runs of capitals, digits and `@` as one span, as far as a window shows them."""

    tags = charmodel.tag_names(pii.KINDS)

    def decode(self, x):
        held = ((x >= 48) & (x <= 57)) | ((x >= 64) & (x <= 90))
        begins = held & ~np.concatenate([held[:1], held[:-1]])
        return np.where(begins, 1, np.where(held, 2, 0)).astype(np.int8), np.full(x.shape, 0.9, np.float32)


@pytest.mark.parametrize("length", [1, 2, 31, 32, 33, 63, 64, 65, 96, 97, 128, 200])
def test_spans_of_any_length_are_found_at_every_offset(length):
    """The one anchor of a span may be at its start, middle or end, windows away from the rest."""
    texts, expected = [], []
    for offset in range(130):
        mark = (0, length // 2, length - 1)[offset % 3]
        body = "Z" * mark + "@" + "Z" * (length - mark - 1)
        texts.append("x" * offset + body + "y" * ((7 * offset + length) % 90))
        expected.append([("email", offset, offset + length)])
    found = pii.model_spans(Marks(), texts)
    assert [[s[:3] for s in f] for f in found] == expected
    assert found == pii.model_spans(Marks(), texts, every=True)


def test_windows_read_on_demand_give_what_all_windows_give():
    """Random tags, which do not agree between windows: the same spans with and without the unread windows."""
    class Noise(Marks):
        def decode(self, x):
            mixed = (x.astype(np.int64) * np.arange(3, 3 + len(x))[:, None] + x.sum(0) * 7) % 29
            tags = np.where(mixed < 24, mixed % 3 * (mixed > 5), 3 + mixed % 2)
            return tags.astype(np.int8), (0.4 + (mixed % 6) / 10).astype(np.float32)

    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("abcdefghij 5"), size=n, p=[0.09] * 11 + [0.01])) for n in range(1, 900, 13)]
    found = pii.model_spans(Noise(), texts)
    assert found == pii.model_spans(Noise(), texts, every=True) and sum(map(len, found)) > 50


def test_gradients_against_differences():
    m = charmodel.Model(("a", "b"), 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(1)
    x, y = r.integers(0, 129, (7, 4)), np.zeros((7, 4), int)
    y[2:4, 1], y[2, 1], y[5, 2] = 2, 1, 3
    _, g = m.gradients(x, y)
    for k in g:
        for at in [np.unravel_index(i, g[k].shape) for i in np.argsort(-np.abs(g[k]), None)[:3]]:
            old, e = m.p[k][at], 1e-3
            m.p[k][at] = old + e
            up = m.gradients(x, y)[0]
            m.p[k][at] = old - e
            down = m.gradients(x, y)[0]
            m.p[k][at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3 * max(1, abs(g[k][at]))


def test_decoding_against_all_paths():
    m = charmodel.Model(("a",), 2, seed=9)
    r = np.random.default_rng(2)
    m.p["trans"] = r.standard_normal((3, 3)).astype(np.float32)
    x = r.integers(0, 129, (5, 1))
    e = m.emissions(x)[0][:, 0]
    trans, start = m._scores()
    score = {p: start[p[0]] + sum(e[t, k] for t, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
             for p in itertools.product(range(3), repeat=5)}
    best = max(score, key=score.get)
    tags, chance = m.decode(x)
    assert tuple(tags[:, 0]) == best
    total = sum(np.exp(v) for v in score.values())
    for t in range(5):
        share = sum(np.exp(v) for p, v in score.items() if p[t] == best[t]) / total
        assert abs(share - chance[t, 0]) < 1e-3


def test_reconciliation_keeps_base_spans_and_never_overlaps():
    base = [("ip", 5, 12)]
    found = [("card", 10, 20, 3, 0.9), ("card", 20, 30, 1, 0.9), ("phone", 25, 40, 2, 0.6), ("email", 40, 50, 1, 0.7)]
    assert pii.reconcile(base, found) == [("email", 40, 50), ("ip", 5, 12), ("phone", 25, 40)]


def test_query_shape_and_odd_rows(spark, model):
    texts = planted(20) + [None, ""]
    rows = pii.scan(docs(spark, texts), model).collect()
    for r in rows:
        expected = brute(texts[r["doc_id"]] or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in expected) for k in pii.KINDS]
        assert set(written.split(",")) - {""} <= set(r["spans"].split(","))
    odd = pii.scan(odd_docs(spark), model).collect()
    assert len(odd) == 10 and "kept" in odd[0].asDict() and all(r["spans"] != "x" for r in odd)
    assert pii.scan(empty(spark), model).collect() == []
    assert pii.fit(docs(spark, ["no anchors", None, ""]), steps=1) is None
    assert pii.find_pii(empty(spark)).collect() == []
