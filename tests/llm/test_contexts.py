"""Scoring by contexts over whole texts against a plain version."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import pytest

from grantlake.llm import contexts, registered, scoring

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, learned boolean"


class WholeTrie(scoring.AdaptiveTrie):
    def symbols(self, text):
        whole = b"\n" * 5 + b" " + b"".join(w + b" " for w in (text or "").encode().lower().split()) + b" "
        for k in range(6, len(whole)):
            yield whole[k - self.order : k], whole[k]


def plain(rows):
    trie, counts = WholeTrie(), Counter()
    for _, text, learned in rows:
        if learned:
            for pair in trie.symbols(text):
                trie.learn(*pair)
            counts.update([*(text or "").encode().lower().split(), b""])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc, text, _ in rows:
        words = [*(text or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        out.append((doc, len(words), sum(counts[w] > 0 for w in words), total, base, trie.score(text, adapt=False)))
    return out


def compare(spark, rows):
    key = lambda r: tuple(math.inf if v is None else v for v in r)
    got = contexts.scores(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(plain(rows), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-7)


def test_against_plain(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    compare(spark, [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in table])


def test_odd(spark, monkeypatch):
    monkeypatch.setattr(contexts, "AT_A_TIME", 64)
    rows = [(1, None, True), (2, "", False), (3, "a b a", True), (3, "a b a", True), (None, "B c", None), (4, "x" * 3000, False), (5, "\x00\x00 é", True), (6, "\x00\x00\x00", False)]
    compare(spark, rows)
    compare(spark, [(1, "a b", False), (2, None, None)])
    assert contexts.scores(spark.createDataFrame([], SCHEMA)).count() == 0


def phrases():
    """A text of six-word phrases, the phrases in another order, and the words in another order."""
    rng = random.Random(4)
    made = [" ".join(f"w{rng.randrange(200)}" for _ in range(6)) for _ in range(60)]
    other, words = rng.sample(made, len(made)), " ".join(made).split()
    return " ".join(made), " ".join(other), " ".join(rng.sample(words, len(words)))


def test_order_of_words_counts(spark, monkeypatch):
    """The registered query tells a text from the same words in another order."""
    held = [k for k in range(2, 200) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    learned = next(k for k in range(2, 200) if zlib.crc32(str(k).encode()) % 7 != 2)
    rows = list(zip((learned, *held), phrases()))
    monkeypatch.setattr(registered, "parquet", lambda *_: spark.createDataFrame(rows, "doc_id long, text string"))
    score = {r.doc_id: r.score for r in registered.op1_scoring(spark, "").collect()}
    assert score[held[1]] < 1.2 * score[held[0]]


def test_written_tables_stay_small(spark, monkeypatch):
    """Pairs and words of a block are written as packed rows, a row per bucket. Without that, these random texts took over five times their bytes."""
    kept = []
    keep = contexts.Scratch.keep
    monkeypatch.setattr(contexts.Scratch, "keep", lambda self, df, name: kept.append(keep(self, df, name)) or kept[-1])
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows = [(k, " ".join(rng.choice(stems) for _ in range(2000)), True) for k in range(80)]
    assert contexts.scores(spark.createDataFrame(rows, SCHEMA).coalesce(1)).count() == len(rows)
    size = sum(Path(f.removeprefix("file:")).stat().st_size for df in kept for f in df.inputFiles())
    assert size < 2.5 * sum(len(text) for _, text, _ in rows)
    assert max(df.count() for df in kept) < 20_000
