"""Aligned tokens against plain loops over both tokenizers, and odd input."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from grantlake.llm import alignment, registered

SF = "/root/testdata/sf0.001"
BYTE, PIECE = registered.tokenizer_file("byte_bpe_50k.json"), registered.tokenizer_file("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, chunk int, pair string"


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(BYTE)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    docs, counts = [], Counter()
    for doc, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
            for i in two.encode(text):
                piece = two.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()))
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a, b = [], []
        end_a, end_b, left, right = 0, 0, [], []
        rest = list(b)
        for i, own in a:
            end_a += len(own)
            left.append(i)
            while rest and end_b + len(rest[0][1]) <= end_a:
                end_b += len(rest[0][1])
                right.append(rest.pop(0)[0])
            if end_a == end_b:
                links.append((left[-1], right[-1]))
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                left, right = [], []
        counts.update(links)
        docs.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    out = [(d, a, b, g, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), h) for d, a, b, g, ls, h in docs]
    return sorted(out, key=repr), counts


def compare(spark, rows):
    docs, pairs = alignment.align(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA), BYTE, PIECE)
    want, counts = plain(rows)
    assert sorted(map(tuple, docs.collect()), key=repr) == want
    got = pairs.collect()
    assert {(r.a, r.b): r.links for r in got} == counts and len(got) == len(counts)
    return got


ODD = [
    (1, None), (2, ""), (3, " "), (3, " "), (None, "a  b   c\n\n d\t"), (4, "<|endoftext|> <s> </s> <unk> <0x41>"), (5, "\x00\x01 \x7f"), (6, "naïve Straße  中文 字 😀👩‍👩‍👧 ﬁ Å ①"),
    (7, "the " * 5000), (8, "x" * 20000), (9, "▁ ▁a"), (10, "﻿   z"), (11, "a"), (12, "don't we'll I'M 123,456.789"), (13, "é กำ ‍"),
]


def test_odd(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_DOCS", 64)
    compare(spark, ODD * 5 + [(100 + k, "the cat and the hat, the end. " * (k % 7)) for k in range(200)])
    docs, pairs = alignment.align(spark.createDataFrame([], SCHEMA), BYTE, PIECE)
    assert docs.count() == 0 and pairs.count() == 0


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registered.op13_alignment(spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)[0]


def test_pairs_know_their_documents(spark):
    got = compare(spark, [(1, "one two two two"), (2, "two three"), (3, "one one")])
    import sentencepiece

    two = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found = {two.id_to_piece(r.b): (r.documents, r.links) for r in got}
    assert found["▁two"] == (2, 4) and found["▁one"] == (2, 3)


def test_planes_count_links():
    rng = np.random.default_rng(2)
    pair, slot = rng.integers(0, 6, 5000), rng.integers(0, 900, 5000)
    pair[:3000] = 2
    made = alignment.planes(pair, slot, 900)
    assert {b[0] for b in made["bits"]} == {0, 1}
    times, held = np.zeros((6, 900), int), np.zeros((6, 900), bool)
    for of, plane, bits in zip(made["of"], made["plane"], made["bits"]):
        times[of, alignment.members(bits)] += 2**plane
        held[of, alignment.members(bits)] = True
    assert (times == [[((pair == p) & (slot == s)).sum() for s in range(900)] for p in range(6)]).all()
    assert made["documents"] == held.sum(axis=1).tolist() and made["links"] == times.sum(axis=1).tolist()


def test_quick_merger_equals_the_library():
    one = alignment.ByteTokens(BYTE)
    rng = np.random.default_rng(1)
    alphabet = list("abcdeTHE  \n\t\r'.,-0129éüßñ¡­²½—’…ƀɏ")
    whole = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(4000)]
    assert all(alignment.PLAIN_TEXT.fullmatch(t) for t in whole)
    slow = [e.ids for e in one.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
    assert one.encode(whole) == slow
