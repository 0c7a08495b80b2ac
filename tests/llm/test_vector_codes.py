"""Product codes against a plain k-means, trees against plain assignment, and odd input."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from grantlake.llm import vector_codes as vc

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, code string, part int"


def whole(x):
    return [max(-(2**26), min(2**26, math.floor(4096 * v))) for v in x]


def plain(rows, rounds=6):
    """(vec_id, label, code, error, label_error, digest) by dimension, with plain loops."""
    kept = defaultdict(list)
    for vec, x, label in rows:
        if x is not None and all(v is not None and math.isfinite(v) for v in x):
            kept[len(x)].append((vec, label, x))
    out = []
    for dim, own in kept.items():
        width = -(-dim // 8)
        cut = lambda x: [(whole(x) + [0] * (8 * width - dim))[p * width : (p + 1) * width] for p in range(8)]
        first = {}
        for vec, _, x in own:
            if vec is not None:
                first[vec] = min(x, first.get(vec, x))
        books = [[cut(first[v])[p] for v in sorted(first)[:16]] for p in range(8)]
        parts = [cut(x) for _, _, x in own]
        if not first:
            out += [(vec, label, None, None, None) for vec, label, _ in own]
            continue
        near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            for p, book in enumerate(books):
                found = defaultdict(list)
                for v in parts:
                    found[near(v[p], book)[1]].append(v[p])
                books[p] = [[sum(c) // len(c) for c in zip(*found[k])] if k in found else e for k, e in enumerate(book)]
        digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for (vec, label, _), v in zip(own, parts):
            best = [near(v[p], books[p]) for p in range(8)]
            out.append((vec, label, "".join("%02x" % k for _, k in best), sum(d for d, _ in best), digest))
    total = defaultdict(int)
    for _, label, _, error, _ in out:
        total[label] += error or 0
    seen = {label for _, label, _, error, _ in out if error is not None}
    return sorted(((v, c, e, total[lab] if lab in seen else None, d) for v, lab, c, e, d in out), key=repr)


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(16).tolist(), k % 3) for k in range(120)]
    rows += [(200 + k, rows[7][1], None) for k in range(90)]
    rows += [(3, rows[9][1], 4), (3, rows[9][1], 4), (None, rows[11][1], 1), (300, [0.0] * 16, 9), (301, [1e300] * 16, 9), (302, [-1e9] + [0.5] * 15, 9)]
    rows += [(400, None, 1), (401, [NAN] * 16, 1), (402, [INF] + [0.0] * 15, 1), (403, [None] + [0.0] * 15, 1)]
    rows += [(500 + k, rng.standard_normal(11).tolist(), 7) for k in range(5)]
    return rows + [(600, [], 8), (None, [], 8), (None, [1.0] * 24, 10)]


def encoded(spark, rows):
    got = vc.encode(spark.createDataFrame([(v, x, lab, "c", 1) for v, x, lab in rows], SCHEMA)).drop("label")
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in got.collect()), key=repr)


def test_odd(spark, monkeypatch):
    monkeypatch.setattr(vc, "LEAF", 4)
    monkeypatch.setattr(vc, "BLOCK_ROWS", 64)
    rows = odd_rows()
    assert encoded(spark, rows) == plain(rows)
    assert encoded(spark, []) == []


def test_without_labels(spark):
    rows = [(k, [float(k % 5), 1.0] * 4, None) for k in range(30)]
    frame = spark.createDataFrame([(v, x) for v, x, _ in rows], "vec_id long, embedding array<double>")
    got = vc.encode(frame).drop("label").collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=repr) == plain(rows)


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies", "line"])
def test_tree_equals_plain_assignment(kind, monkeypatch):
    monkeypatch.setattr(vc, "LEAF", 6)
    rng = np.random.default_rng(3)
    points = {
        "spread": rng.integers(-2000, 2000, (3000, 8)),
        "clusters": rng.integers(-90000, 90000, (20, 8))[rng.integers(0, 20, 3000)] + rng.integers(-40, 40, (3000, 8)),
        "copies": np.repeat(rng.integers(-5, 5, (6, 8)), 500, axis=0),
        "line": np.arange(3000)[:, None] * np.ones((1, 8), int),
    }[kind].astype(np.int32)
    tree = vc.Tree.of_bytes(vc.Tree.build(points).to_bytes(), 8)
    assert sorted(tree.order.tolist()) == list(range(3000))
    entries = points[rng.integers(0, 3000, 16)].astype(np.int64)
    entries[5] = entries[2]
    dist = ((points[:, None].astype(np.int64) - entries[None]) ** 2).sum(axis=2)
    want = dist.argmin(axis=1)
    sums, counts, chosen = tree.assign(points, entries, each=True)
    assert (chosen == want).all() and (counts == np.bincount(want, minlength=16)).all()
    assert all((sums[e] == points[want == e].astype(np.int64).sum(axis=0)).all() for e in range(16))


def test_balls_are_owned_without_their_points():
    """On separate clusters most points are never looked at: sums come from cached balls."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-90000, 90000, (16, 8))
    points = (centres[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 8))).astype(np.int32)
    tree = vc.Tree.build(points)
    blind = np.zeros_like(points)  # points as leaves would see them
    sums, counts, _ = tree.assign(blind, centres.astype(np.int64), each=False)
    nearest = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (counts == np.bincount(nearest, minlength=16)).all()
    assert (sums[3] == points[nearest == 3].sum(axis=0)).all()
