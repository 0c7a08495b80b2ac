"""Counts, model and verdicts against plain loops, and odd input."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from grantlake.llm import perplexity, registered, whole_models

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, word long, n int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_counts(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered)


def plain_discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if not all(n):
        return lambda c: [0.0, 0.5, 1.0, 1.5][min(c, 3)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [max(0.0, min(k, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]
    return lambda c: d[min(c, 3)]


def mean_and_error(logs):
    mean = -sum(logs) / len(logs)
    return mean, math.sqrt(sum((x + mean) ** 2 for x in logs)) / len(logs)


def plain(rows, share=perplexity.SHARE, wide=perplexity.WIDE):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        counts[lang].update(WORD.findall(lower(text)))
    least = share * (sum(sum(c.values()) for c in counts.values()) + len(rows))
    logs = {}
    for lang, own in counts.items():
        known = {w for w, n in own.items() if n >= least}
        if not known:
            continue
        seq = [["<s>", *(w if w in known else None for w in WORD.findall(lower(t))), "</s>"] for _, t, g in rows if g == lang]
        pairs = Counter((a, b) for s in seq for a, b in zip(s, s[1:]))
        after = Counter()
        for (a, _), n in pairs.items():
            after[a] += n
        before = Counter(b for _, b in pairs)
        d1, d2 = plain_discounts(before.values()), plain_discounts(pairs.values())
        spare = sum(min(d1(n), n) for n in before.values())
        single = lambda w: (max(before[w] - d1(before[w]), 0) + spare / (len(known) + 2)) / sum(before.values())
        unseen = max(len(own) - len(known), 1)
        less = lambda w, unseen=unseen: unseen if w is None else 1
        value = {p: max(n - d2(n), 0) / after[p[0]] for p, n in pairs.items() if n >= least}
        rest = defaultdict(lambda: 1.0)
        for (a, _), v in value.items():
            rest[a] -= v
        logs[lang] = [
            (*mean_and_error([math.log10((value.get(p, 0) + rest[p[0]] * single(p[1])) / less(p[1])) for p in zip(s, s[1:])]), *mean_and_error([math.log10(single(w) / less(w)) for w in s[1:]]))
            for s in seq
        ]
    out, place = [], Counter()
    for doc, text, lang in rows:
        c = plain_counts(text)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        log = logs[lang][place[lang]] if lang in logs else None
        place[lang] += 1
        out.append((doc, *c, failed, lang, log))
    band = {}
    for lang in logs:
        ends = []
        for k in (0, 2):
            steps = [math.floor(r[8][k] * 100 + 0.5) for r in out if r[7] == lang and not r[6]]
            if steps:
                q1, q3 = np.percentile(steps, [25, 75])
                ends.append(((q1 - wide * (q3 - q1) - 1) / 100, (q3 + wide * (q3 - q1) + 1) / 100))
        if ends:
            band[lang] = ends[0][1], ends[1][0]
    inside = lambda r: r[7] not in band or (r[8][0] - 3 * r[8][1] <= band[r[7]][0] and r[8][2] + 3 * r[8][3] >= band[r[7]][1])
    return [(*r[:7], not r[6] and inside(r), None if r[8] is None else 10 ** r[8][0]) for r in out]


def compare(spark, rows, **params):
    got = perplexity.judge(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), **params).collect()
    want = plain(rows, **params)
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted((w[:8] for w in want), key=repr)
    for g, w in zip(sorted(got, key=lambda r: (repr(tuple(r)[:8]), r.perplexity or 0)), sorted(want, key=lambda r: (repr(r[:8]), r[8] or 0))):
        assert (g.perplexity is None) == (w[8] is None) and (w[8] is None or g.perplexity == pytest.approx(w[8], rel=1e-9))
    return want


def test_table(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    compare(spark, rows)
    compare(spark, rows, share=1e-3, wide=0.5)


def prose(rng, n):
    vocabulary = [a + b + c for a in "bdgk" for b in "aeiou" for c in ("l", "n", "st")]
    return " ".join(vocabulary[min(int(rng.exponential(12)), 59)] for _ in range(n))


def test_odd_texts_are_rejected_and_clean_ones_stay(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "HELD_KEYS", 100)
    rng = np.random.default_rng(8)
    rows = [(k, prose(rng, 60 + k % 90), "aa" if k % 3 else "bb") for k in range(300)]
    rows += [(1000, " ".join(f"q{k}x" for k in range(120)), "aa"), (1001, "#$ %& ** ||\n" * 40, "aa"), (1002, "bal " * 200, "bb")]
    want = compare(spark, rows, share=1e-4)
    assert [r[7] for r in want[:300]].count(False) == 0
    assert not any(r[7] for r in want[300:])


def test_odd_rows(spark):
    long = "Word WORD word,\n\n word  \t x\x0by # é 中文 ½\n" * 400
    rows = [(1, None, "aa"), (2, "", None), (3, " \n\t", "bb"), (4, long, None), (4, long, None), (None, "a b a b a b a", "aa"), (5, "a b c\na b c\n \n \na b c", ""), (6, "\x00 \x00 \x00", "aa")]
    compare(spark, rows)
    compare(spark, rows, share=0.4)
    assert perplexity.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_values_of_a_context_add_up_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'")
    words = perplexity.word_counts(docs)
    for least in (1, 20):
        vocabulary = perplexity.Vocabulary(words.where(f"n >= {least}").select("lang", "word").toArrow())
        model = perplexity.models(perplexity.pair_counts(docs, vocabulary), words, vocabulary, least)[0]
        model.share = 0.0  # of all unknown words together
        words_ = np.array([w for w in range(len(vocabulary.hashes[0]) + perplexity.FIRST) if w != perplexity.START])
        for context in (0, 2, 5, len(words_)):
            assert (10 ** model.logs(context << perplexity.BITS | words_)[0]).sum() == pytest.approx(1, abs=1e-6)


def test_verdicts_on_tables(spark):
    got = registered.op12_quality(spark, "/root/testdata/sf0.01").select("kept", "base_failed").collect()
    assert sum(r.kept for r in got) > 0.99 * sum(not r.base_failed for r in got)


def test_copies_are_not_rejected_for_being_copied(spark):
    rng = np.random.default_rng(9)
    rows = [(k, prose(rng, 80), "aa") for k in range(200)]
    rows += [(1000 + k, rows[7][1], "aa") for k in range(150)]
    assert all(r[7] for r in compare(spark, rows))


def test_languages_without_a_frequent_word_have_a_model(spark):
    rng = np.random.default_rng(10)
    rows = [(k, prose(rng, 60 + k % 50), "aa") for k in range(120)]
    rare = [(500 + k, " ".join(f"r{int(rng.exponential(60))}" for _ in range(70)), lang) for k in range(24) for lang in (None, "cc")]
    rare += [(900, " ".join(f"q{k}x" for k in range(120)), "cc"), (901, "r1 r2", None), (901, "r1 r2", None), (None, None, "cc"), (902, " ", None)]
    share = 0.008
    by = lambda r: (repr(tuple(r)[:8]), r[8] or 0)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows + rare], SCHEMA)
    got = sorted(perplexity.judge(docs, share=share, every_language=True).collect(), key=by)
    common = [w for w, r in zip(plain(rows + rare, share=share), rows + rare) if r[2] == "aa"]
    whole = plain(rare, share=0)
    want = sorted([tuple(w) for w in common + whole], key=by)
    assert [tuple(r)[:8] for r in got] == [w[:8] for w in want]
    assert [r.perplexity for r in got] == [w[8] if w[8] is None else pytest.approx(w[8], rel=1e-9) for w in want]
    assert all(w[8] is not None for w in whole) and all(w[8] is None for w, r in zip(plain(rows + rare, share=share), rows + rare) if r[2] != "aa")


def compare_whole(spark, rows):
    by = lambda r: (repr(tuple(r)[:8]), r[8] or 0)
    got = sorted(perplexity.judge(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), every_language=True).collect(), key=by)
    want = sorted(map(tuple, plain(rows, share=0)), key=by)
    assert [tuple(r)[:8] for r in got] == [w[:8] for w in want]
    assert [r.perplexity for r in got] == [w[8] if w[8] is None else pytest.approx(w[8], rel=1e-9) for w in want]


def test_words_and_pairs_count_however_rare_in_a_large_table(spark):
    rng = np.random.default_rng(11)
    rows = [(k, f"{prose(rng, 60)} w{k} w{k % 7}", "aa") for k in range(60)]
    compare_whole(spark, [*rows, (900, "bal dol " * 1_100_000, "aa")])


@pytest.mark.parametrize("frequent", [0.004, 2.0])
def test_whole_model_from_many_blocks(spark, monkeypatch, frequent):
    for name, value in {"BLOCK_WORDS": 400, "NAMED": 2, "FREQUENT": frequent, "LEAST_BITS": 2, "ROUNDS": 3}.items():
        monkeypatch.setattr(whole_models, name, value)
    rng = np.random.default_rng(12)
    rare = lambda n: " ".join(f"r{int(rng.exponential(200))}" for _ in range(n))
    rows = [(k, f"{prose(rng, 40)} {rare(20)} {prose(rng, 5)}", ("aa", "bb", None)[k % 3]) for k in range(90)]
    rows += [(500, rare(300), "aa"), (500, rare(300), "bb"), (None, None, "aa"), (501, "", "cc"), (502, "bal", "dd"), rows[3], rows[3]]
    compare_whole(spark, rows)
