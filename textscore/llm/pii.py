"""PII: a character-level BiLSTM-CRF beside exact base patterns.

Base spans (email, ip, card, phone) are found by pattern, leftmost and non-overlapping per kind. The
model is trained in numpy on windows around labelled spans, the base spans of a bounded sample of documents
(`sample` documents with an anchor character, the smallest hashes of the id, and `pieces` surroundings of anchors
in each, the smallest hashes too) and on windows without any.
It then reads overlapping windows of every text and stitches their tags: a character has the tag of the window whose
centre is nearest, so spans of any length are found at any place. The spans of the stitched tags are reconciled over
the whole text: those over most windows first, then the most probable, and never overlapping a base span or each other.
Base spans always stay.

A span of any kind holds a digit or `@` (an anchor); spans without one are no spans. So windows are read
whose own characters hold an anchor, and from there on as long as a span goes on into the next window, on either side.
No other window can hold a part of a span: the result is that of reading all, and the tests hold both equal.

Defined results: null and empty texts have no spans and the digest of the empty string. Without anchors in the
sample there is no model and only base spans. Repeated rows are scanned one by one. Offsets are code
points, ends exclusive. Extra columns stay; one named like a new column is replaced.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textscore.llm.charmodel import PAD, Model, encode
from textscore.llm.text import over_texts, without

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
_ANCHOR_BYTES = re.compile(rb"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A digit before cannot begin an address: its run would have been taken whole.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    """Whether a string of digits passes the Luhn check."""
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _emails(text):
    """From each `@`, the longest run of local characters before it and the domain after it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        at = max(at + 1, done)


def base_spans(text):
    """(kind, start, end) of the base patterns, by kind as listed and start."""
    spans = [("email", *s) for s in _emails(text)]
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
              if all(len(p) <= 3 and int(p or "0") <= 255
                     for p in (part.lstrip("0") for part in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
              if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return spans


def has_anchor(text):
    return _ANCHOR_BYTES.search(text) is not None


def _anchored(codes):
    return ((codes >= 48) & (codes <= 57)) | (codes == 64)


def window_starts(length):
    """Starts of overlapping windows that cover a text; the last one ends with it."""
    if length <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, length - WINDOW + 1, STRIDE)
    return starts if starts[-1] == length - WINDOW else np.append(starts, length - WINDOW)


def own_borders(starts, length):
    """Where each window's own characters begin, those nearest to its centre, and the text's end."""
    return np.concatenate([[0], (starts[:-1] + starts[1:]) // 2 + WINDOW // 2, [length]])


def _cut(codes, starts):
    """Windows as columns [WINDOW, n], padded at the end of a short text."""
    padded = np.concatenate([codes, np.full(max(0, WINDOW - len(codes)), PAD, codes.dtype)])
    return padded[starts[None, :] + np.arange(WINDOW)[:, None]]


def training_windows(texts, extra=2):
    """(x, y) from texts and their base spans: windows around spans, `extra` at other anchors and `extra` anywhere per text."""
    tags = {t: i for i, t in enumerate(Model(KINDS, 1).tags)}
    xs, ys = [], []
    for n, text in enumerate(texts):
        codes, y = encode(text), np.zeros(max(len(text), WINDOW), np.int64)
        taken = np.zeros(len(text), bool)
        spans = base_spans(text)
        for kind, a, b in spans:
            if not taken[a:b].any():
                taken[a:b] = True
                y[a:b], y[a] = tags[f"I-{kind}"], tags[f"B-{kind}"]
        rng = np.random.default_rng(n)
        last = max(0, len(text) - WINDOW)
        at = [min(max(0, (a + b) // 2 - WINDOW // 2 + int(rng.integers(-16, 17))), last) for _, a, b in spans]
        anchors = np.flatnonzero(_anchored(codes) & ~taken)
        others = rng.choice(anchors, min(extra, len(anchors)), replace=False) if len(anchors) else anchors
        at += [min(max(0, int(i) - int(rng.integers(0, WINDOW))), last) for i in others]
        at += [int(rng.integers(0, last + 1)) for _ in range(extra)]
        starts = np.array(at)
        xs.append(_cut(codes, starts))
        ys.append(y[starts[None, :] + np.arange(WINDOW)[:, None]])
    return np.concatenate(xs, 1), np.concatenate(ys, 1)


def fit(docs, text="text", key="doc_id", sample=1_000, pieces=8, steps=300, hidden=24):
    """A trained model, or None where no document of the sample holds an anchor."""
    body = F.col(f"`{text}`")
    own = F.col(f"`{key}`")
    held = docs.filter(own.isNotNull() & body.rlike("[0-9@]")).select(
        own.alias("id"), F.xxhash64(own).alias("h"), body.alias("t"))
    # Numbers alone are sorted; `sample` of them then pick their texts.
    chosen = held.select("h", "id").distinct().orderBy("h", "id").limit(sample)
    rows = (held.join(F.broadcast(chosen.select("id")), "id", "left_semi")
            # Bounded training texts: the surroundings of anchors.
            .withColumn("t", F.regexp_extract_all("t", F.lit(r"(?s)(.{0,200}[0-9@].{0,200})"), F.lit(1)))
            .withColumn("t", F.array_sort(F.transform("t", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))))
            .withColumn("t", F.array_join(F.slice("t", 1, pieces)["x"], "\n"))
            .select("h", "t").collect())
    rows.sort()
    if not rows:
        return None
    model = Model(KINDS, hidden)
    model.losses = model.fit(*training_windows([r["t"] for r in rows]), steps=steps)
    return model


def _spans_of(tags, chance, names):
    """(kind, start, end, probability) of a text's tags; an I- tag that continues nothing begins a span."""
    at = np.flatnonzero(tags)
    i = 0
    while i < len(at):
        kind, j = names[tags[at[i]]][2:], i + 1
        while j < len(at) and at[j] == at[j - 1] + 1 and names[tags[at[j]]] == f"I-{kind}":
            j += 1
        begin, end = int(at[i]), int(at[j - 1]) + 1
        yield kind, begin, end, float(chance[begin:end].min())
        i = j


def model_spans(model, texts, least=0.5, every=False, batch=512):
    """Per text the model's spans (kind, start, end, windows, probability) from stitched tags.

    `windows` is the number of windows that a span's characters belong to. `every` reads all windows,
    for the test of equality.
    """
    codes = [encode(t) for t in texts]
    starts = [window_starts(len(c)) if len(c) else np.zeros(0, np.int64) for c in codes]
    borders = [own_borders(s, len(c)) for s, c in zip(starts, codes)]
    read = [np.full(len(s), every) for s in starts]
    for n, c in enumerate(codes):
        if len(c) and not every:
            marks = np.concatenate([[0], np.cumsum(_anchored(c))])[borders[n]]
            read[n] = marks[1:] > marks[:-1]
    stitched = [np.zeros(len(c), np.int8) for c in codes]
    chances = [np.zeros(len(c), np.float32) for c in codes]
    inside = np.array([name[0] == "I" for name in model.tags])
    todo = [np.flatnonzero(r) for r in read]
    while any(len(t) for t in todo):
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in todo])
        number = np.concatenate(todo)
        x = np.concatenate([_cut(codes[n], starts[n][t]) for n, t in enumerate(todo) if len(t)], 1)
        more = [[] for _ in texts]
        for k in range(0, x.shape[1], batch):
            tags, chance = model.decode(x[:, k:k + batch])
            for c in np.flatnonzero(tags.any(0)):
                n, w = int(owner[k + c]), int(number[k + c])
                a, b = int(borders[n][w]), int(borders[n][w + 1])
                own = slice(a - int(starts[n][w]), b - int(starts[n][w]))
                stitched[n][a:b], chances[n][a:b] = tags[own, c], chance[own, c]
                if inside[stitched[n][a]] and w > 0:
                    more[n].append(w - 1)
                if stitched[n][b - 1] and w + 1 < len(starts[n]):
                    more[n].append(w + 1)
        todo = [np.array(sorted(w for w in set(m) if not read[n][w]), np.int64) for n, m in enumerate(more)]
        for n, t in enumerate(todo):
            read[n][t] = True
    found = []
    for n, text in enumerate(texts):
        spans = []
        for kind, a, b, p in _spans_of(stitched[n], chances[n], model.tags):
            if p >= least and re.search(r"[0-9@]", text[a:b]):
                first, last = np.searchsorted(borders[n], [a, b - 1], side="right")
                spans.append((kind, a, b, int(last - first) + 1, p))
        found.append(spans)
    return found


def reconcile(base, found):
    """Base spans and the model's spans that overlap neither them nor a better one, in order."""
    spans = list(base)
    taken = np.zeros(max([s[2] for s in (*base, *found)], default=0), bool)
    for _, a, b in base:
        taken[a:b] = True
    for kind, a, b, _, _ in sorted(found, key=lambda s: (-s[3], -s[4], s[1], s[2], s[0])):
        if not taken[a:b].any():
            spans.append((kind, a, b))
            taken[a:b] = True
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs, model, text="text"):
    """`docs` without the text, with base counts, `base_sha256` and `spans` (kind:start:end, ...)."""
    nothing = hashlib.sha256(b"").hexdigest()
    names = [f"n_{k}" for k in KINDS]

    def work(texts):
        base, found = [()] * len(texts), [()] * len(texts)
        held = [i for i, t in enumerate(texts) if has_anchor(t)]
        bodies = [texts[i].decode("utf-8", "replace") for i in held]
        learned = model_spans(model, bodies) if model else [()] * len(held)
        for i, body, more in zip(held, bodies, learned):
            base[i] = base_spans(body)
            found[i] = reconcile(base[i], more)
        count = lambda k: np.array([sum(s[0] == k for s in b) for b in base], np.int64)
        return {**{f"n_{k}": count(k) for k in KINDS},
                "base_sha256": [hashlib.sha256(_written(b).encode()).hexdigest() if b else nothing for b in base],
                "spans": pa.array([_written(f) for f in found], pa.string())}

    docs = without(docs, *names, "base_sha256", "spans")
    schema = ", ".join([*(f"{n} long" for n in names), "base_sha256 string", "spans string"])
    return over_texts(docs, text, schema, work, [c for c in docs.columns if c != text])


def find_pii(docs, text="text", key="doc_id", **options):
    return scan(docs, fit(docs, text, key, **options), text)
