"""Token counts by a map-side two-tier lookup of pre-tokens.

A byte-level vocabulary splits a text by fixed rules into pre-tokens and encodes each by itself, so a
text's count is a sum of lengths. Tier one is a table of frequent pre-tokens with their lengths, read
off a bounded sample and broadcast; its size is a parameter. Tier two is a cache of each worker:
a pre-token the table misses is encoded there once, by the vocabulary's own model. No pre-token is ever
shuffled, and the two tiers change the work only, never a count.

The splitting rules are applied by a regular expression. Characters that it classes otherwise than the
tokenizer does (their tables of Unicode may differ in age) are found once, on the driver, by asking both; a text
that holds one goes whole through the tokenizer. So do all texts under vocabularies that do not split in
this way (other pre-tokenizers, normalisers, sentencepiece models).

Special strings inside a text are one token each, as is the tokenizers' default; none are added. Texts are
never cut or padded.

Defined results: a null or empty text has 0 bytes and 0 tokens. Each row gets its own result, so repeated
rows get the same. Extra columns stay out, whatever their names; a null key stays null.
"""

import json
import os
import re
from collections import Counter

import pyarrow as pa
import regex

from pyspark.sql import functions as F

from textscore.llm.text import over_texts

# The splitting rules of byte-level vocabularies, and the same with ASCII classes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+"
               r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
# Blocks in these ranges are as old as Unicode 3 and alike everywhere: ideographs, syllables, private use.
OLD = (range(0x4E00, 0x9FA6), range(0xAC00, 0xD7A4), range(0xE000, 0xF900))
# Characters past the first two planes are rare enough to take the tokenizer's own way.
PAST = 0x20000


def visible():
    """Byte -> character of byte-level vocabularies: printable bytes stay, the others follow from 256 on."""
    stays = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(stays)))}
    return {**{b: b for b in stays}, **moved}


def odd_characters(tokenizer):
    """The characters that the rules and the tokenizer class differently."""
    split = regex.compile(SPLIT)
    points = [c for c in range(PAST) if not 0xD800 <= c < 0xE000 and not any(c in block for block in OLD)]
    odd = set()
    for k in range(0, len(points), 1024):
        some = [chr(c) for c in points[k:k + 1024]]
        # A character between a letter, a number and a sign shows its class by what it joins.
        text = "".join(f"a{c}1{c}!{c} " for c in some)
        seen = {end for _, (_, end) in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        for end in seen ^ {m.end() for m in split.finditer(text)}:
            # An end on a border belongs to the character beside it; take both neighbours.
            odd.update(some[i] for i in ((end - 1) // 7, min(end // 7, len(some) - 1)))
    return frozenset(odd)


class Lengths(dict):
    """Tokens of a pre-token: the frequent ones given, each other one encoded once and kept.

    At most `room` pre-tokens are kept, of at most `longest` characters each.
    """

    def __init__(self, frequent, model, room=1 << 18, longest=64):
        super().__init__(frequent)
        self.frequent, self.model, self.room, self.longest = frequent, model, room, longest
        self.table = visible()

    def __missing__(self, piece):
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.table)))
        if len(piece) <= self.longest:
            if len(self) >= len(self.frequent) + self.room:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


class Vocabulary:
    """A vocabulary file's bytes and how its texts are counted."""

    def __init__(self, data, kind, odd=None, frequent=None):
        if kind not in (".json", ".model"):
            raise ValueError(f"no reader for vocabularies of kind {kind}")
        self.data, self.kind, self.odd, self.frequent = data, kind, odd, frequent or {}
        rules = json.loads(data) if kind == ".json" else {}
        added, pre = rules.get("added_tokens") or [], rules.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in added]
        # Whether texts are split by the rules above and by nothing else.
        self.splits = (rules.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                       and not pre.get("add_prefix_space") and not rules["model"].get("dropout")
                       and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added))

    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        if self.kind == ".model":
            import sentencepiece
            return sentencepiece.SentencePieceProcessor(model_proto=self.data)
        from tokenizers import Tokenizer
        made = Tokenizer.from_str(self.data.decode())
        made.no_truncation()
        made.no_padding()
        return made

    def splitter(self):
        return splitter(self.odd, self.specials)

    def counter(self):
        """A function from one text (str) to its number of tokens."""
        made = self.tokenizer()
        if self.kind == ".model":
            return lambda text: len(made.encode(text))
        whole = lambda text: len(made.encode(text, add_special_tokens=False))
        if not self.splits:
            return whole
        of, cut = Lengths(self.frequent, made.model).__getitem__, self.splitter()

        def count(text):
            pieces, special = cut(text)
            return whole(text) if pieces is None else special + sum(map(of, pieces))

        return count


def load(path):
    """The vocabulary of a file as plain values, which every worker can unpickle."""
    with open(path, "rb") as f:
        found = {"data": f.read(), "kind": os.path.splitext(path)[1]}
    own = Vocabulary(**found)
    return {**found, "odd": odd_characters(own.tokenizer()) if own.splits else None}


def worker_counter(shared):
    """The counter of this worker process: kept with its copy of the broadcast, so that tasks share one cache."""
    own = shared.value
    if "counter" not in own:
        own["counter"] = Vocabulary(**own).counter()
    return own["counter"]


def splitter(odd, specials):
    """A function from a text to (its pre-tokens, its special strings), the former None if an odd character is in it."""
    plain, every = re.compile(ASCII_SPLIT).findall, regex.compile(SPLIT).findall
    named = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) or r"(?!)")

    def cut(text):
        find = plain
        if not text.isascii():
            letters = set(text)
            if ord(max(letters)) >= PAST or not odd.isdisjoint(letters):
                return None, 0
            find = every
        if not any(s in text for s in specials):
            return find(text), 0
        parts = named.split(text)
        return [p for part in parts for p in find(part)], len(parts) - 1

    return cut


def frequent_lengths(docs, shared, text="text", entries=1 << 16, sample=20_000, tasks=8):
    """{pre-token: tokens} of the most frequent pre-tokens of about `sample` rows; empty texts give none.

    The rows are drawn from the whole table and dealt to `tasks` tasks, each of which returns its `entries`
    most frequent ones at most. Which rows are drawn changes no count.
    """
    rows = docs.count()
    if not rows or not Vocabulary(**shared.value).splits:
        return {}
    drawn = docs.select(F.col(f"`{text}`").alias("text")).sample(min(1.0, sample / rows), seed=11)

    def run(batches):
        own = Vocabulary(**shared.value)
        cut, found = own.splitter(), Counter()
        for batch in batches:
            for value in batch.column(0):
                found.update(cut(value.as_py() or "")[0] or ())
        lengths = Lengths({}, own.tokenizer().model, room=0)
        most = [(p, n) for p, n in found.most_common(entries) if n > 1 and len(p) <= lengths.longest]
        yield pa.RecordBatch.from_pydict({
            "piece": pa.array([p for p, _ in most], pa.string()), "n": pa.array([n for _, n in most], pa.int64()),
            "tokens": pa.array([lengths[p] for p, _ in most], pa.int32())})

    parts = drawn.repartition(tasks).mapInArrow(run, "piece string, n long, tokens int").toArrow()
    total, tokens = Counter(), {}
    for piece, n, k in zip(*(parts.column(c).to_pylist() for c in ("piece", "n", "tokens"))):
        total[piece] += n
        tokens[piece] = k
    return {p: tokens[p] for p, _ in total.most_common(entries)}


def count_tokens(docs, path, text="text", key="doc_id", limit=1024, entries=1 << 16, sample=20_000):
    """(key, n_bytes, n_tokens, over_limit) per row of `docs`, by the vocabulary file at `path`.

    `path` is read on the driver. `over_limit` tells whether a text has more than `limit` tokens.
    """
    context, own = docs.sparkSession.sparkContext, load(path)
    frequent = frequent_lengths(docs, context.broadcast(own), text, entries, sample)
    shared = context.broadcast({**own, "frequent": frequent})

    def work(texts):
        count = worker_counter(shared)
        return {"n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_tokens": pa.array([count(t.decode("utf-8", "replace")) for t in texts], pa.int64())}

    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    return (over_texts(rows, "_text", "n_bytes long, n_tokens long", work, keep=(key,))
            .withColumn("over_limit", F.col("n_tokens") > limit))
