"""Scoring, language, near duplicates, passages, mixing and packing against plain versions, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grantlake.llm import langid, mixing, neardup, packing, registered, scoring, substrings, texts
from grantlake.llm.components import components
from grantlake.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, block string, node long, tag long, kept string, score double, n_tokens long"


def docs_of(spark, rows):
    """Documents with further columns whose names clash with those that operators use."""
    full = [(i, t, lang, src, "b", 1, 2, "k", 0.5, 7) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


def odd_docs(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}é" for k in range(400)]
    long_ = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    part = " ".join(rng.choice(vocabulary) for _ in range(120))
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "a"), (4, "one", "en", "b"), (5, "one", None, "b"), (5, "one", None, "b"),
        (6, long_, "fr", "a"), (7, long_ + " more", "fr", None), (8, part, "fr", "a"), (9, "before " + part + " after", None, "b"),
        (None, part, "fr", "a"), (None, None, None, None), (10, "a b c d e f", "en", "a"), (11, "A B C D E F", "en", "a"), (12, "12 34 \x00\x1c ", "en", "c"),
        (9, "another text of document nine", "en", "b"), (13, "<|endoftext|> it's ΑΣ", "en", "c"),
    ]
    return docs_of(spark, rows), rows


def words_of(text):
    return (text or "").encode().split()


# --- words and hashes -------------------------------------------------------------------------------


def test_words_and_hashes():
    values = ["a b", None, "", "  x\ty\x1cz ", "é É", "b"]
    words = texts.Words(pa.array(values), lower=False)
    got = [[bytes(words.data[s:e]) for s, e in zip(words.start[a:b], words.end[a:b])] for a, b in zip(words.first[:-1], words.first[1:])]
    assert got == [words_of(v) for v in values]
    hashes = words.hashes()
    assert hashes[1] == hashes[-1] and len(set(hashes.tolist())) == len({bytes(words.data[s:e]) for s, e in zip(words.start, words.end)})
    runs = texts.run_hashes(np.concatenate((hashes, hashes)), 3)
    assert runs[0] == runs[len(hashes)] and runs[0] != runs[1]


# --- op1 --------------------------------------------------------------------------------------------


def plain_scores(rows):
    trie, counts = scoring.AdaptiveTrie(), Counter()
    for _, text, learned in rows:
        if learned:
            for pair in trie.symbols(text):
                trie.learn(*pair)
            counts.update([*(text or "").encode().lower().split(), b""])
    total, distinct = sum(counts.values()), len(counts)
    gains = plain_long_contexts(rows)
    out = []
    for (doc, text, _), (gain, met) in zip(rows, gains):
        words = [*(text or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        left = trie.score(text, adapt=False) - sum(trie.score(w.decode(), adapt=False) - trie.score("", adapt=False) for w in met)
        out.append((doc, len(words), sum(counts[w] > 0 for w in words), total, base, left + gain))
    return out


def plain_long_contexts(rows):
    """Log-probability of what anchors predict, and the words met, per row."""
    kept = defaultdict(list)
    places = []
    for row, (doc, text, learned) in enumerate(rows):
        words = (text or "").encode().lower().split() if doc is not None else []
        hashes = texts.Words(pa.array([text or ""]), lower=True).hashes()
        runs = texts.run_hashes(hashes, scoring.LONG)
        at = [k + scoring.LONG for k in range(len(runs)) if (int(runs[k]) >> 20) % scoring.EVERY == 0] if words else []
        for k, start in enumerate(at):
            end = min(start + scoring.AHEAD, len(words), at[k + 1] if k + 1 < len(at) else len(words))
            context, following = tuple(words[start - scoring.LONG : start]), words[start:end]
            places.append((row, doc, learned, context, following))
            if learned:
                kept[context].append((doc, start, following))
    outcome = []
    for row, doc, learned, context, following in places:
        known = sorted(kept[context], key=lambda x: x[:2])
        other = next((x[2] for x in (known[:1] + known[-1:]) if x[0] != doc), None)
        if other is not None:
            n = 0
            while n < min(len(following), len(other)) and following[n] == other[n]:
                n += 1
            outcome.append((row, learned, following[:n], n < min(len(following), len(other))))
    step = lambda k: sum(k >= low for low in scoring.STEPS) - 1
    hits, misses = Counter(), Counter()
    for _, learned, met, missed in outcome:
        if learned:
            hits.update(step(k) for k in range(len(met)))
            misses.update([step(len(met))] if missed else [])
    escape = [(misses[k] + 0.5) / (hits[k] + misses[k] + 1) for k in range(len(scoring.STEPS))]
    out = [[0.0, []] for _ in rows]
    for row, _, met, missed in outcome:
        out[row][0] += sum(math.log10(1 - escape[step(k)]) for k in range(len(met))) + (math.log10(escape[step(len(met))]) if missed else 0)
        out[row][1] += met
    return out


def compare_scores(spark, rows):
    got = scoring.scores(spark.createDataFrame(rows, "doc_id long, text string, learned boolean")).collect()
    key = lambda r: tuple(math.inf if v is None else v for v in r)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(plain_scores(rows), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-7)


def test_scores(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    compare_scores(spark, [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in table])


def test_scores_odd(spark):
    rows = [(1, None, True), (2, "", False), (3, "a b a", True), (3, "a b a", True), (None, "B c", None), (4, "x" * 3000, False), (5, "\x00\x00 é", True), (6, "\x00\x00\x00", False)]
    rng = random.Random(1)
    passage = [f"p{rng.randrange(1000)}" for _ in range(300)]
    for doc in range(20, 32):
        a, b = sorted(rng.sample(range(300), 2))
        rows.append((doc, " ".join([*passage[:a], "other", *passage[a:b], "B" if doc % 2 else "c"]), doc % 3 > 0))
    rows += [(20, "another text of " + " ".join(passage[40:200]), True), (25, None, True)]
    compare_scores(spark, rows)
    compare_scores(spark, [(1, "nothing learned", False)])
    assert scoring.scores(spark.createDataFrame([], "doc_id long, text string, learned boolean")).count() == 0


def test_probabilities_sum_to_one():
    trie = scoring.AdaptiveTrie(3)
    for text in ("the cat sat", "that hat", "a cat"):
        for pair in trie.symbols(text):
            trie.learn(*pair)
    symbols = [s for s in range(256) if not 9 <= s <= 13]
    for context in (b" ", b" t", b" th", b"cat", b"zzz", b""):
        assert sum(10 ** trie.log10(context, s) for s in symbols) == pytest.approx(1)


def test_adaptive_scores(spark):
    got = {r.doc_id: r.score for r in scoring.adaptive_scores(spark.createDataFrame([(1, "ab " * 50), (2, "ab"), (3, None)], "doc_id long, text string")).collect()}
    assert got[1] < got[2] < got[3] < 0 and got[1] > 25 * got[2]


# --- op3 --------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    got = registered.op3_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cosine(spark):
    """Bundles and cosines as the definition has them, letter by letter."""
    texts_ = ["the thing is there", "Ça été là", "der und die"]
    train = spark.createDataFrame([(t, k) for t, k in zip(texts_, "abc")], "text string, lang string")
    learned = {r.lang: np.array(r.prototype) for r in langid.learn(train).collect()}
    vectors, table = langid.trigram_vectors(), langid.letter_classes()

    def bundle(text):
        letters = [0]
        for c in text:
            if table[ord(c)] or letters[-1]:
                letters.append(int(table[ord(c)]))
        letters += [0] if letters[-1] else []
        return sum(vectors[(a * langid.CLASSES + b) * langid.CLASSES + c].astype(float) for a, b, c in zip(letters, letters[1:], letters[2:]))

    for text, name in zip(texts_, "abc"):
        assert np.array_equal(bundle(text), learned[name])
    asked = "is it the hat"
    row = langid.predict(spark.createDataFrame([(asked,)], "text string"), {k: list(v) for k, v in learned.items()}).first()
    cosine = {k: bundle(asked) @ v / np.linalg.norm(bundle(asked)) / np.linalg.norm(v) for k, v in learned.items()}
    assert row.lang_pred == max(cosine, key=cosine.get) and row.score == pytest.approx(max(cosine.values()), abs=1e-5)


def test_language_odd(spark):
    docs, rows = odd_docs(spark)
    got = langid.fit_predict(docs, docs.select("text", "lang"))
    assert set(docs.columns) - {"score"} < set(got.columns) and got.count() == len(rows)
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    empty = docs.limit(0)
    assert langid.fit_predict(empty, empty.select("text", "lang")).count() == 0
    assert {r.lang_pred for r in langid.fit_predict(docs, empty.select("text", "lang")).collect()} == {"und"}


# --- op4 --------------------------------------------------------------------------------------------


def plain_groups(rows, size, percent=80):
    sets, owner = [], []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]))
        owner.append(doc)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for k, s in enumerate(sets):
        if owner[k] is None:
            continue
        common = Counter(o for g in s for o in having[g])
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                parent[find(k)] = find(o)
        for g in s:
            having[g].append(k)
        if s:
            for o in range(k):
                if owner[o] == owner[k] and sets[o]:
                    parent[find(k)] = find(o)
    least = {}
    for k, doc in enumerate(owner):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return Counter((doc, len(sets[k]), None if doc is None else least[find(k)] if sets[k] else doc) for k, doc in enumerate(owner))


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = neardup.near_duplicates(docs, shingle=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_groups([(r.doc_id, r.text) for r in docs.collect()], size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd(spark):
    docs, rows = odd_docs(spark)
    got = neardup.near_duplicates(docs, shingle=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_groups([r[:2] for r in rows], 4)
    assert all(r.kept for r in got if r.doc_id is None)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_group_of_near_copies(spark):
    """Copies that differ by several words each: many pairs just below and above the threshold, chains included."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(10_000 - k, " ".join(rng.choice([f"x{k}_{j}"]) if rng.random() < (k % 9) * 0.006 else w for j, w in enumerate(base))) for k in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, shingle=4).collect()
    want = plain_groups(rows, 4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert 3 < len({c for _, _, c in want}) < 200


def test_odd_sketch_estimates():
    rng = np.random.default_rng(2)
    for similarity in (0.7, 0.8, 0.95):
        errors = []
        for _ in range(40):
            shared = int(1000 * similarity)
            pool = rng.integers(0, 2**63, size=2000 - shared, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(pool[:1000]), np.sort(np.concatenate((pool[:shared], pool[1000:])))
            sketch = neardup.sketches(neardup.samples(np.concatenate((a, b)), np.array([len(a), len(b)])))
            differ = sum(bin(int(x)).count("1") for x in sketch[0] ^ sketch[1])
            bits = 64 * neardup.SKETCH_LONGS
            errors.append(1 + bits / (4 * neardup.SAMPLES) * math.log(1 - 2 * differ / bits) - shared / (2000 - shared))
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < neardup.MARGIN


def near_copies(n):
    """Near copies of one text, three of 120 words changed in each: most pairs lie at about 0.66."""
    rng = random.Random(44)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(n):
        changed = set(rng.sample(range(120), 3))
        rows.append((k, " ".join(f"x{k}_{j}" if j in changed else w for j, w in enumerate(base))))
    return rows


def test_last_pairs_grow_slowly(spark, monkeypatch):
    """Pairs of open buckets that lie well below the threshold are never confirmed on full sets."""
    sent = []
    last = neardup.last_pairs

    def counted(*args):
        pairs = last(*args).persist()
        sent.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "last_pairs", counted)
    rows = near_copies(300)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_groups(rows, 5)
    print("pairs confirmed", sent)
    assert all(n < 4000 for n in sent)


def test_long_sketch_estimates(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for k in range(120):
        similarity = (0.66, 0.8, 0.95)[k % 3]
        shared = int(600 * similarity)
        pool = rng.integers(-(2**62), 2**62, size=1200 - shared)
        rows += [(2 * k, sorted(pool[:600].tolist())), (2 * k + 1, sorted(np.concatenate((pool[:shared], pool[600:])).tolist()))]
        want.append(shared / (1200 - shared))
    found = {r.node: r.long_sketch for r in neardup.long_sketches(spark.createDataFrame(rows, "node long, shingles array<long>")).collect()}
    pairs = spark.createDataFrame([(k, found[2 * k], found[2 * k + 1]) for k in range(120)], "k int, a array<long>, b array<long>")
    got = {r.k: r.e for r in pairs.select("k", neardup.estimate("a", "b", neardup.LONG_LONGS, neardup.LONG_SAMPLES).alias("e")).collect()}
    errors = [got[k] - want[k] for k in range(120)]
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < neardup.LONG_MARGIN


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(frame, Scratch(spark, "test"), "c").collect()}
    alone = {a for a, b in edges if a == b and sum(a in e for e in edges) == 1}
    assert got == {x: find(x) for x in parent if x not in alone}


# --- op6 --------------------------------------------------------------------------------------------


def plain_passages(rows, length):
    low = {}
    for doc, text in rows:
        w = words_of(text)
        for k in range(len(w) - length + 1):
            if doc is not None:
                key = tuple(w[k : k + length])
                low[key] = min(doc, low.get(key, doc))
    out = []
    for doc, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if doc is not None and low[tuple(w[k : k + length])] < doc:
                gone[k : k + length] = [True] * length
        out.append((doc, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("length", [50, 8])
def test_passages(spark, length):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_passages([(r.doc_id, r.text) for r in docs.collect()], length)
    got = Counter(map(tuple, substrings.digests(docs, length).collect()))
    assert got == Counter((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in want)


def test_passages_odd(spark):
    docs, rows = odd_docs(spark)
    want = plain_passages([r[:2] for r in rows], 50)
    got = Counter(map(tuple, substrings.digests(docs, 50).collect()))
    assert got == Counter((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in want)
    cleaned = substrings.clean(docs, 50)
    assert cleaned.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in cleaned.collect()) == Counter((d, text if not g else t) for (d, text, *_), (_, _, g, t) in zip(rows, want))
    assert substrings.digests(docs.limit(0), 50).count() == 0 and substrings.clean(docs.limit(0), 50).count() == 0


def test_repeat_levels(spark):
    rng = random.Random(6)
    text = [str(rng.randrange(10**6)) for _ in range(100)]
    rows = [(1, " ".join(text)), (2, " ".join(["x", *text[:70], "y"])), (3, "z " + " ".join(text[:9]))]
    got = {r.length: r.n_windows for r in substrings.repeat_levels(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()}
    assert got == {8: 63 + 63 + 2, 16: 2 * 55, 32: 2 * 39, 64: 2 * 7}


# --- op8 --------------------------------------------------------------------------------------------


def mixture_input(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)), "big" if k < 900 else f"s{k % 4}") for k in range(1200)] + [(None, "x y", None), (5000, None, None), (5001, "", "empty")]
    return docs_of(spark, [(i, t, None, s) for i, t, s in rows]), rows


def test_mixing_weights(spark):
    docs, rows = mixture_input(spark)
    got = mixing.order(docs, entropy_share=0.9, max_repeats=5.0, block_tokens=256).collect()
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len(words_of(text))
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items() if n}
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        power = {s: p**a for s, p in shares.items()}
        weights = {s: x / sum(power.values()) for s, x in power.items()}
        enough = -sum(w * math.log(w) for w in weights.values()) >= 0.9 * math.log(len(shares))
        few = all(w * total / tokens[s] <= 5 for s, w in weights.items())
        low, high = (a, high) if enough or not few else (low, a)
    realised = Counter()
    for r in got:
        realised[r.source] += r.n_tokens
    for s, w in weights.items():
        assert w * total - 62 <= realised[s] <= w * total + 1
        copies = Counter(r.doc_id for r in got if r.source == s)
        assert max(copies.values()) - min(copies.values()) <= 1
    assert any(r.source == "empty" for r in got)
    assert all(Counter((r.doc_id, r.epoch) for r in got if r.doc_id is not None)[r.doc_id, r.epoch] == 1 for r in got[:50] if r.doc_id is not None)


def test_mixing_rows(spark):
    docs, rows = mixture_input(spark)
    out = mixing.mix(docs, entropy_share=0.9, max_repeats=5.0, block_tokens=256)
    assert out.columns == docs.columns
    slim = mixing.order(docs, entropy_share=0.9, max_repeats=5.0, block_tokens=256)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in slim.collect())
    assert mixing.mix(docs.limit(0)).count() == 0
    flat = spark.createDataFrame([(k, "a b c", f"s{k % 3}") for k in range(30)], "doc_id long, text string, source string")
    assert Counter(r.doc_id for r in mixing.mix(flat).collect()) == Counter(range(30))


def test_mixing_blocks(spark):
    """Blocks stay as they are, every epoch has its own order of them, and a plain walk along the last
    epoch's order ends at the same document."""
    docs, rows = mixture_input(spark)
    got = mixing.order(docs, entropy_share=0.99, max_repeats=5.0, block_tokens=64).collect()
    sizes = {(k, s): len(words_of(text)) for k, text, s in rows}
    by_source: dict = {}
    for r in got:
        by_source.setdefault(r.source, {}).setdefault(r.epoch, []).append(r)
    assert any(len(e) > 2 for e in by_source.values())
    total = sum(sizes.values())
    slim = mixing.planned(docs, None, 0.99, 5.0, 64, 8)[1].collect()
    for p in slim:
        epochs = by_source.get(p.source, {})
        blocks = {e: {r.block: r.turn for r in of} for e, of in epochs.items()}
        block_of: dict = {}
        for of in epochs.values():
            for r in of:
                assert block_of.setdefault(r.doc_id, r.block) == r.block
        whole = [sorted(blocks[e], key=lambda b: (blocks[e][b], b)) for e in range(p.epochs)]
        assert all(set(w) == set(whole[0]) for w in whole)
        if len(whole) > 1 and len(whole[0]) > 6:
            assert all(a != b for a, b in zip(whole, whole[1:]))
        if not p.epochs or p.end_turn is None:
            continue
        left = int(p.weight * total) - p.epochs * sum(n for (_, s), n in sizes.items() if s == p.source)
        last = {r.doc_id for r in epochs.get(p.epochs, [])}
        members: dict = {}
        for k, b in block_of.items():
            members.setdefault(b, set()).add(k)
        keys = {r.block: r.own for r in spark.createDataFrame([(p.source, b) for b in members], "source string, block long").withColumn("own", mixing.turn(F.lit(p.epochs), 8)).collect()}
        for b in sorted(members, key=lambda b: (keys[b], b)):
            n = sum(sizes[k, p.source] for k in members[b])
            if n > left:
                assert b == p.end_block and sum(sizes[k, p.source] for k in last) <= left
                break
            assert members[b] <= last
            left, last = left - n, last - members[b]
        assert last <= members[b] and last != members[b]


# --- op10 -------------------------------------------------------------------------------------------


def check_packing(rows, got, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registered.tokenizer_file())
    want = Counter()
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack_documents(docs, registered.tokenizer_file()).collect()
    used = check_packing([(r.doc_id, r.text) for r in docs.collect()], got, 2048)
    assert used <= math.ceil(sum(r.length for r in got) / 2048) + 2


def test_packing_odd(spark):
    docs, rows = odd_docs(spark)
    got = packing.pack_documents(docs, registered.tokenizer_file(), capacity=64, per_task=5, with_ids=True).collect()
    check_packing([r[:2] for r in rows], got, 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert packing.pack_documents(docs.limit(0), registered.tokenizer_file()).count() == 0


def test_sum_of_squares_choice():
    """Each placement leaves the smallest sum of squared counts among the open sequences it fits."""
    rng = random.Random(10)
    bins = packing.Bins(12)
    for _ in range(300):
        size = rng.randint(1, 11)
        before = bins.count.copy()
        options = {}
        for gap in range(size, 12):
            if before[gap]:
                after = before.copy()
                after[gap] -= 1
                if gap > size:
                    after[gap - size] += 1
                options[gap] = int((after**2).sum())
        bins.place(size)
        assert int((bins.count**2).sum()) == (min(options.values()) if options else int((before**2).sum()) + 2 * before[12 - size] + 1)


def test_token_cache_is_exact():
    coder = packing.WordTokens(registered.tokenizer_file())
    odd = ["'s don't I'LL a.b a., é. ÀÉ ß. ª. µ, 12. x1. naïve ǅ İ ΑΣ H̱ Á. a b ... , . .a ,b ÿ. ×÷ l'été. <|endoftext|>", "", "x"]
    ids, sizes = coder.encode([t.encode() for t in odd])
    at = 0
    for text, n in zip(odd, sizes):
        assert ids[at : at + n].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
        at += n


def test_pipeline(spark):
    import corpus_pipeline

    docs, rows = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = Scratch(spark, "test").keep(stage(spark, docs, ""), name)
        assert name == "packed" or docs.columns == before
        if name == "language":
            assert Counter(r.doc_id for r in docs.collect()) == Counter(i for i, t, *_ in rows if any(c.isalpha() for c in t or ""))
        if name == "near_duplicates":
            assert Counter(r.doc_id for r in docs.collect()) == Counter({4: 1, 6: 1, 8: 1, 10: 1, None: 1, 13: 1})  # rows of document 9 are one document, and near 8
        if name == "passages":
            assert {r.doc_id: r.text for r in docs.collect()}[6] == rows[6][1]
    assert docs.count() > 0
    empty = odd_docs(spark)[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = Scratch(spark, "test").keep(stage(spark, empty, ""), name)
    assert empty.count() == 0


def test_pipeline_language_sends_the_text_once(spark, monkeypatch):
    import corpus_pipeline

    seen = []
    fit_predict = corpus_pipeline.langid.fit_predict
    monkeypatch.setattr(corpus_pipeline.langid, "fit_predict", lambda docs, *a, **k: seen.append(docs) or fit_predict(docs, *a, **k))
    docs = spark.createDataFrame([(1, "the cat", "en", 0.5, "x"), (2, "12", "en", 0.5, "y")], "doc_id long, text string, lang string, score double, lang_pred string")
    found = corpus_pipeline.language(spark, docs, "")
    assert [tuple(r) for r in found.collect()] == [(1, "the cat", "en", 0.5, "x")] and found.columns == docs.columns
    assert seen[0].schema.simpleString().count("text") == 1


def test_pipeline_sends_texts_to_python_in_small_batches(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text", "'en' AS lang").coalesce(1)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        for _, stage in corpus_pipeline.STAGES[:1]:
            stage(spark, docs, "")

        def sizes(batches):
            yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set(key, before)


def test_pipeline_sends_long_texts_in_batches_of_few_bytes(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('some words ', 4000) AS text", "'en' AS lang").coalesce(1)
    try:
        spark.conf.set(key, "64m")
        corpus_pipeline.language(spark, docs, "")

        def sizes(batches):
            yield from (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)

        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(key, before)


def test_word_tokens_keep_a_bounded_number_of_words_and_the_same_ids():
    coder = packing.WordTokens(registered.tokenizer_file())
    first = coder.encode([b"once w1 again"])[0].tolist()
    for at in range(0, 300_000, 25_000):
        coder.encode([b" ".join(b"w%d" % k for k in range(at, at + 25_000))])
        assert len(coder.number) <= 225_003
    assert coder.encode([b"once w1 again"])[0].tolist() == first
