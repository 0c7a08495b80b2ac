"""Searches, chat windows and extraction against plain versions, and on odd input."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from grantlake.llm import chat, extraction, neighbours, products, registered
from grantlake.llm.markup import leaf_blocks

VECS = "vec_id long, embedding array<double>, dim int, n int, block long, score double"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 0.5) for i, v in rows], VECS)


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def plain_products(rows, asked, k, scale=64):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and good(v)]
    out = []
    for q, v in asked:
        a = [math.floor(scale * x) for x in v]
        found = sorted((-max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63) + 1), i) for i, b in whole if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def odd_vectors():
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) * (3 if k % 7 == 0 else 1) for _ in range(6)]) for k in range(300)]
    rows += [(300 + k, rows[20][1]) for k in range(60)]
    rows += [(400, None), (None, rows[0][1]), (401, []), (402, [0.0] * 6), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [NAN] + [1.0] * 5), (405, [INF] + [1.0] * 5)]
    rows += [(420, [1.0, 2.0, 3.0]), (421, [3.0, 2.0, 1.0]), (440, [1e300] * 6), (7, rows[7][1]), (460, [5e-324] * 6), (480, [-1e200] * 6)]
    return rows


def test_products(spark):
    rows = odd_vectors()
    vecs = vectors_of(spark, rows)
    got = products.largest_products(vecs, vecs.where("vec_id % 20 = 0"), k=5)
    asked = [(i, v) for i, v in rows if i is not None and i % 20 == 0 and good(v)]
    assert sorted(map(tuple, got.collect())) == plain_products(rows, asked, 5)
    assert products.largest_products(vecs.limit(0), vecs.limit(0)).count() == 0


def test_products_of_a_repeated_query(spark):
    """Rows of a query's own vec_id take no place of other rows."""
    rows = odd_vectors() + [(20, [3.0, -2.0, 4.0, 1.0, 2.0, k / 64]) for k in range(30)]
    rows = [(i, [3.0, -2.0, 4.0, 1.0, 2.0, 0.0]) if i == 20 and k < 300 else (i, v) for k, (i, v) in enumerate(rows) if not v or max((abs(x) for x in v if x is not None), default=0) < 1e6]
    vecs = vectors_of(spark, rows)
    asked = vectors_of(spark, [(20, [3.0, -2.0, 4.0, 1.0, 2.0, 0.0])])
    got = products.largest_products(vecs, asked, k=5)
    assert sorted(map(tuple, got.collect())) == plain_products(rows, [(20, [3.0, -2.0, 4.0, 1.0, 2.0, 0.0])], 5)


def test_products_table(spark):
    vecs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in vecs.collect()]
    got = registered.op2_products(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == plain_products(rows, [r for r in rows if r[0] % 20 == 0], 20)


def test_pruned_search_is_exact():
    """Buckets whose lengths and directions let every kind of pruning act."""
    rng = np.random.default_rng(7)
    p = np.floor(64 * rng.standard_normal((4000, 8)) * rng.uniform(0.2, 3, (4000, 1)))
    p[:40] = np.floor(p[40] * rng.uniform(0.9, 1.1, (40, 1)))
    q, ids = p[::100], np.arange(4000)
    exact = q @ p.T
    exact[np.arange(len(q)), ids[::100]] = -1e18
    for least in (np.full(len(q), -np.inf), np.sort(exact, axis=1)[:, -8], np.sort(exact, axis=1)[:, -1] * 0.97):
        a, b, s = products.search(ids[::100], q, ids, p, least, 5)
        got = defaultdict(list)
        for x, y, z in zip(a.tolist(), b.tolist(), s.tolist()):
            got[x].append((-z, y))
        for row, x in enumerate(ids[::100].tolist()):
            want = sorted((-int(v), int(i)) for i, v in zip(ids, exact[row]) if v >= least[row] and i != x)[:5]
            assert sorted(got[x])[:5] == want


def test_neighbours_recall(spark):
    vecs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids = np.array([r.vec_id for r in vecs.collect()])
    data = np.array([r.embedding for r in vecs.collect()], dtype=float)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    found = defaultdict(dict)
    for r in registered.op5_neighbours(spark, "/root/testdata/sf0.1").collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        cosine = unit @ unit[at]
        order = [k for k in np.lexsort((ids, -cosine)) if ids[k] != ids[at]][:5]
        own = found[ids[at]]
        assert sorted(own) == [1, 2, 3, 4, 5]
        hits += len({int(ids[k]) for k in order} & {v for v, _ in own.values()})
        total += 5
        for v, s in own.values():
            assert s == pytest.approx(float(cosine[np.flatnonzero(ids == v)[0]]), abs=1e-12)
    assert hits / total >= 0.95


def test_neighbours_odd(spark):
    rows = odd_vectors()
    vecs = vectors_of(spark, rows)
    got = neighbours.nearest(vecs, vecs.where("vec_id % 20 = 0"), k=5).collect()
    usable = [(i, np.array(v)) for i, v in rows if i is not None and good(v) and any(v)]
    unit = {k: (i, neighbours.scaled(v[None])[0]) for k, (i, v) in enumerate(usable)}
    assert {r.query_id for r in got} == {i for i, _ in usable if i % 20 == 0}
    hits = total = 0
    for q, u in unit.values():
        if q % 20:
            continue
        want = sorted((-round(float(u @ v), 12), i) for i, v in unit.values() if i != q and len(u) == len(v))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, len(want) + 1))
        hits += sum(i in {v for _, v, _ in own} for _, i in want)
        total += len(want)
    assert hits / total >= 0.9
    ties = [r.vec_id for r in sorted((r for r in got if r.query_id == 20), key=lambda r: r.rank)]
    assert ties == [300, 301, 302, 303, 304]
    assert neighbours.nearest(vecs.limit(0), vecs.limit(0)).count() == 0


def test_chi_square():
    assert neighbours.chi_square(neighbours.chi_square_limit(0.97)) == pytest.approx(0.97)
    assert neighbours.chi_square_limit(0.95) == pytest.approx(15.507, abs=1e-3)


# --- chat -------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, span long, k long, system string, place int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digest(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in own.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "s", 3) for r in rows], CHAT)


def odd_chats():
    rng = random.Random(7)
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\b\\l\\i\\r", "<s>[user]x</s>", "a\\", "", None, "]", "é" * 40, "</s>", "\n", "[", "<"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a]b", "<s>["]), rng.choice(nasty)) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(50, 0, "system", "be kind"), (50, 1, "user", "word " * 700), (50, 2, "assistant", "word " * 300), (50, 3, "user", "x"), (50, 4, "assistant", "y " * 200), (50, 5, "assistant", "z")]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (60, None, "user", "c"), (61, 1, "assistant", "d"), (61, 1, "assistant", "d")]
    return rows + [(70, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(400)]


def test_chat_digests(spark):
    rows = odd_chats()
    made = chat.windows(chats(spark, rows), budget=200, history=2)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == plain_digest(rows)
    read = defaultdict(list)
    for r in chat.read_back(made).orderBy("conv_id", "span", "place").collect():
        read[r.conv_id].append((r.role, r.text))
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert read == want
    assert chat.digests(chat.windows(chats(spark, []))).count() == 0


def test_chat_windows_keep_their_budget(spark):
    rows = odd_chats()
    tokens = chat.turns(chats(spark, rows)).select("conv_id", "k", "tokens").collect()
    size = {(r.conv_id, r.k): r.tokens for r in tokens}
    for r in chat.windows(chats(spark, rows), budget=200, history=2).collect():
        pieces = r.formatted.removesuffix("</s>").split("</s>")
        fresh = len(pieces) - r.repeated
        assert fresh >= 1 and r.repeated <= 3
        if r.conv_id == 70:
            assert sum(21 + 20 + 4 for _ in range(fresh)) <= 200 and (r.span == 0 or r.repeated == 1)
        for m in r.mask:
            assert r.formatted[m.start + m.length :].startswith("</s>") and r.formatted[: m.start].endswith("<s>[assistant]")
        if r.conv_id == 50 and r.span:
            assert r.formatted.startswith("<s>[system]be kind</s>")
    assert max(size.values()) > 200


def test_chat_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", registered.CONTROL_TEXT), (-1, 1, "assistant", registered.CONTROL_TEXT)]
    out = registered.op7_chat(spark, sf)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()} == plain_digest(rows)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- pages ------------------------------------------------------------------------------------------


def test_leaf_blocks():
    page = "<title>T&amp;T</title><p>a<b>b</b> c<br>d<p>e&nbsp;f<ul><li>x<li>y</ul><script>var t='</p>'</script><!-- no --><div class='Ad-Box'>z<a href='q'>w</a></div>1 < 2 &lt;i&gt;"
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks] == ["T&T", "ab c d", "e f", "x", "y", "zw", "1 < 2 <i>"]
    assert ".ad" in blocks[5].path and ".box" in blocks[5].path and blocks[5].linked == 0.5
    assert leaf_blocks("") == [] and [b.text for b in leaf_blocks("<div" * 3)] == ["<div<div<div"]
    assert [b.text for b in leaf_blocks("<b>" * 5000 + "deep")] == ["deep"]


def test_tags_end_as_in_browsers():
    def said(page):
        return [b.text for b in leaf_blocks(page)]

    assert said("<p>a<script>x</scripty></p></script foo='1'>b</p><p>c") == ["ab", "c"]
    assert said("<p>a<style>x</style/>b<script>y</SCRIPT\n>c") == ["abc"]
    assert said("<p title=it\"s>one</p><p title=o'clock>two</p>") == ["one", "two"]
    assert said("<p title=\"a>b\" id = 'c>d'>one<p class=>two") == ["one", "two"]
    assert said("<p>a<!-- > b <p>c") == ["a"] and said("<p>a<!-- b") == ["a"] and said("<p>a<script>b") == ["a"]
    assert said("<p>1 > 0 " + "<x " * 200_000) == ["1 > 0 " + ("<x " * 200_000).strip()]


def test_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    model = extraction.train([r.html for r in rows[:150]])
    got = {r.page_id: r for r in extraction.extract(pages, model).collect()}
    wrong = 0
    for r in rows:
        blocks = leaf_blocks(r.html)
        want = "\n".join(b.text for b, y in zip(blocks, extraction.known_labels(blocks)) if y)
        wrong += got[r.page_id].text != want
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert len(got) == len(rows) and wrong <= len(rows) // 100
    rng = random.Random(99)
    stock = [b.text for r in rows[150:] for b in leaf_blocks(r.html) if "article" in b.path]
    right = total = 0
    for _ in range(200):
        blocks, labels = extraction.marked(extraction.invented(rng.sample(stock, 8), rng))
        right += int((model.label([blocks])[0] == (labels > 0)).sum())
        total += len(blocks)
    assert right / total > 0.97
    schema = "page_id long, url string, html string, text string, n_chars int"
    odd = [(1, None, None, "x", 1), (2, "u", "", "x", 1), (3, "u", rows[0].html, "x", 1), (3, "u", rows[0].html, "x", 1), (None, "u", "<p>" + "w " * 200_000, None, None), (4, "u", "no mark & up", "x", 1)]
    out = extraction.extract(spark.createDataFrame(odd, schema), model).collect()
    assert len(out) == 6 and {r.text for r in out if r.page_id in (1, 2)} == {""}
    assert {r.text for r in out if r.page_id == 3} == {got[rows[0].page_id].text}
    assert extraction.main_texts(spark.createDataFrame([], schema)).count() == 0


def test_gradients():
    """Against differences."""
    rng = np.random.default_rng(1)
    model = extraction.Labeller(3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    pages = [extraction.coded(leaf_blocks("<p>a b</p><div class=c>d</div><p>e</p>")), extraction.coded(leaf_blocks("<h1>x</h1>"))]
    labels = [np.array([1.0, 0, 1]), np.array([1.0])]

    def loss():
        p, (_, mask, (where, _), *_) = model.forward(pages)
        y = np.concatenate(labels)
        return -(y * np.log(p[where]) + (1 - y) * np.log(1 - p[where])).sum() / mask.sum()

    grad = model.gradients(pages, labels)
    for name in ("out", "xf", "hb", "cf"):
        at = tuple(rng.integers(0, n) for n in model.w[name].shape)
        kept = model.w[name][at]
        model.w[name][at] = kept + 1e-2
        up = loss()
        model.w[name][at] = kept - 1e-2
        down = loss()
        model.w[name][at] = kept
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-4)
