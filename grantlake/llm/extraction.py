"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. A block is a vector: learned vectors of the words in its
tag path (names, and parts of class, id and role), learned vectors of its hashed text words, and a
few figures such as its length and its share of links. A bidirectional LSTM reads the sequence both
ways, so every block is classed in the context of the whole page. Blocks classed as main text are
joined by line breaks.

Learning: at most ``TRAIN_PAGES`` pages, the first by a hash of their address, give texts. A block of
these is main text if it lies in an ``article`` or ``main`` and in nothing that is named as something
else (``ASIDE``). The same texts are set again in invented layouts, whose parts are known, with other
tags, class names, and kinds of extra matter; so the labeller does not depend on one template. If no
page has such an element, the invented layouts alone teach. The model is a few hundred kilobytes; it
is trained on the driver from that bounded sample, and applied where the pages are.

Results for odd input: a null or empty page has an empty text and no characters; so has a page in
which no block is main text; null urls and ids pass; repeated rows are treated alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import texts
from .markup import Block, leaf_blocks

TRAIN_PAGES = 250
LAYOUTS = 2
PATH_ROWS, PATH_SIZE = 2048, 24
WORD_ROWS, WORD_SIZE = 2048, 8
FIGURES = 8
HIDDEN = 24
INPUT = PATH_SIZE + WORD_SIZE + FIGURES
EPOCHS, BATCH, RATE = 14, 24, 0.01
#: Private-use character that marks main text in invented pages.
MARK = "\ue000"

#: Names that mark matter beside the main text.
ASIDE = frozenset(
    "nav footer aside form .ad .ads .advert .advertisement .sponsor .sponsored .promo .promotion .banner .cookie .consent .notice .alert .popup .modal .nav .navbar "
    ".navigation .menu .breadcrumb .breadcrumbs .sidebar .widget .footer .comment .comments .reply .respond .discussion .share .social .related .recommended "
    ".newsletter .subscribe .signup .login .search .pagination .toolbar .skip .copyright .legal .disclaimer .tags .masthead head title".split()
)
#: Names of parts, by kind, for invented layouts.
NAMES = {
    "main": "content post entry article story body text main copy page single post-content entry-content article-body story-body main-content rich-text prose".split(),
    "menu": "nav navbar navigation menu main-menu top-nav site-nav breadcrumb breadcrumbs pagination links toc-nav".split(),
    "header": "header masthead site-header top branding banner-top page-header logo".split(),
    "footer": "footer site-footer bottom colophon copyright legal foot footer-links".split(),
    "side": "sidebar side widget aside rail secondary related recommended more-stories popular trending tags share social".split(),
    "notice": "cookie cookie-banner notice alert consent gdpr popup modal overlay disclaimer warning-bar".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion ad-slot adbox banner-ad".split(),
    "form": "form signup subscribe newsletter login search contact search-box register".split(),
    "comments": "comments comment comment-list discussion responses reply thread user-comments respond reactions".split(),
}
#: What such parts say.
SAYINGS = {
    "menu": "Home|About|Contact|News|Products|Blog|Archive|Next|Previous|Sitemap|Log in|Skip to content|Search|Categories".split("|"),
    "header": "Welcome to our site|Your daily source|Sign in|Subscribe|The official site|Established 1998".split("|"),
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Powered by|Copyright notice|Imprint|Contact us".split("|"),
    "side": "Related articles|Most read|Share this|Tags|Follow us|Recent posts|You may also like|Popular".split("|"),
    "notice": "We use cookies to improve this site.|Accept all|This site uses cookies. By continuing you agree.|Please enable JavaScript.|Your browser is out of date.".split("|"),
    "advert": "Advertisement|Sponsored content|Buy now and save|Limited offer|Special deal today|Click here".split("|"),
    "form": "Your email|Subscribe to our newsletter|Send|Name|Password|Sign up|Enter your search|Submit".split("|"),
    "comments": "Reply|3 comments|Leave a comment|posted on|says:|Report|2 hours ago|Anonymous wrote".split("|"),
}


def figures(block: Block, place: float) -> list[float]:
    text, n = block.text, len(block.text)
    return [
        min(np.log1p(n) / 6, 2.0), block.linked, place, 1.0 if text[-1:] in ".!?…:;\"”»" else 0.0, min(len(block.path) / 12, 2.0),
        min(text.count(".") + text.count(","), 20) / 20, sum(c.isupper() for c in text[:200]) / max(min(n, 200), 1), 1.0 if n < 25 else 0.0,
    ]


def coded(blocks: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Rows of the two tables of vectors, and the figures, per block."""
    path = [np.array([zlib.crc32(w.encode()) % PATH_ROWS for w in b.path], dtype=np.int64) for b in blocks]
    words = [np.array([zlib.crc32(w.encode()) % WORD_ROWS for w in {*b.text.lower().split()}], dtype=np.int64) for b in blocks]
    return path, words, np.array([figures(b, k / len(blocks)) for k, b in enumerate(blocks)], dtype=np.float32).reshape(-1, FIGURES)


class Labeller:
    """Tables of vectors, one LSTM per direction and a logistic output, in numpy."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.w = {"path": normal(PATH_ROWS, PATH_SIZE, scale=0.3), "word": normal(WORD_ROWS, WORD_SIZE, scale=0.1), "out": normal(2 * HIDDEN + INPUT, scale=0.1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w[f"x{d}"] = normal(INPUT, 4 * HIDDEN, scale=1 / np.sqrt(INPUT))
            self.w[f"h{d}"] = normal(HIDDEN, 4 * HIDDEN, scale=1 / np.sqrt(HIDDEN))
            self.w[f"c{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)

    def gather(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Inputs (time, page, size), their mask, and where they came from."""
        sizes = np.array([len(p[2]) for p in pages])
        where = (np.concatenate([np.arange(n) for n in sizes]), np.repeat(np.arange(len(pages)), sizes))
        x = np.zeros((sizes.max(), len(pages), INPUT), np.float32)
        sources = []
        flat = np.zeros((len(where[0]), INPUT), np.float32)
        for k, (name, low, size) in enumerate((("path", 0, PATH_SIZE), ("word", PATH_SIZE, WORD_SIZE))):
            rows = [r for p in pages for r in p[k]]
            counts = np.array([len(r) for r in rows])
            index = np.concatenate(rows) if counts.sum() else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(rows)), counts)
            scale = (1 / np.sqrt(np.maximum(counts, 1))).astype(np.float32)
            starts = np.cumsum(counts) - counts
            has = counts > 0
            if has.any():
                flat[has, low : low + size] = np.add.reduceat(self.w[name][index], starts[has], axis=0)
            flat[:, low : low + size] *= scale[:, None]
            sources.append((name, low, size, index, owner, scale))
        flat[:, PATH_SIZE + WORD_SIZE :] = np.concatenate([p[2] for p in pages])
        x[where] = flat
        mask = np.zeros(x.shape[:2], np.float32)
        mask[where] = 1
        return x, mask, (where, sources)

    def read(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        steps, n, _ = x.shape
        gates_x = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, trace = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates_x[t] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            fresh = f * c + i * g
            tanh = np.tanh(fresh)
            trace.append((t, i, f, o, g, c, h, tanh, m))
            c, h = m * fresh + (1 - m) * c, m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, trace

    def forward(self, pages: list[tuple]) -> tuple[np.ndarray, tuple]:
        x, mask, source = self.gather(pages)
        forth, trace_f = self.read(x, mask, "f")
        back, trace_b = self.read(x, mask, "b")
        seen = np.concatenate((forth, back, x), axis=2)
        p = 1 / (1 + np.exp(-np.clip(seen @ self.w["out"] + self.w["bias"], -30, 30)))
        return p, (x, mask, source, seen, trace_f, trace_b)

    def gradients(self, pages: list[tuple], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        p, (x, mask, (where, sources), seen, trace_f, trace_b) = self.forward(pages)
        y = np.zeros_like(p)
        y[where] = np.concatenate(labels)
        error = ((p - y) * mask / mask.sum()).astype(np.float32)
        grad = {"out": np.einsum("tn,tnk->k", error, seen), "bias": np.array([error.sum()], np.float32)}
        d_seen = error[:, :, None] * self.w["out"]
        dx = d_seen[:, :, 2 * HIDDEN :].copy()
        for d, trace, low in (("f", trace_f, 0), ("b", trace_b, HIDDEN)):
            wx, wh = self.w[f"x{d}"], self.w[f"h{d}"]
            gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN, np.float32)
            dh, dc = np.zeros_like(trace[0][6]), np.zeros_like(trace[0][5])
            for t, i, f, o, g, c, h, tanh, m in reversed(trace):
                dh = dh + d_seen[t][:, low : low + HIDDEN]
                own_h, own_c = dh * m, dc * m
                do = own_h * tanh
                dn = own_c + own_h * o * (1 - tanh**2)
                z = np.concatenate((dn * g * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - g**2)), axis=1)
                gx += x[t].T @ z
                gh += h.T @ z
                gc += z.sum(axis=0)
                dx[t] += z @ wx.T
                dh, dc = dh * (1 - m) + z @ wh.T, dc * (1 - m) + dn * f
            grad |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        flat = dx[where]
        for name, low, size, index, owner, scale in sources:
            table = np.zeros_like(self.w[name])
            np.add.at(table, index, (flat[:, low : low + size] * scale[:, None])[owner])
            grad[name] = table
        return grad

    def fit(self, pages: list[tuple], labels: list[np.ndarray], seed: int = 9) -> None:
        """Adam over batches of pages of like length. Path words are dropped at random, so that no single name decides."""
        rng = np.random.default_rng(seed)
        mean, square = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][2]))
        batches = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for epoch in range(EPOCHS):
            for b in rng.permutation(len(batches)):
                chosen = []
                for k in batches[b]:
                    path, word, fig = pages[k]
                    chosen.append(([r[rng.random(len(r)) > 0.04] for r in path], [r[rng.random(len(r)) > 0.5] for r in word], fig))
                grad = self.gradients(chosen, [labels[k] for k in batches[b]])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) + 0.001
                for name, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    mean[name] = 0.9 * mean[name] + 0.1 * g
                    square[name] = 0.999 * square[name] + 0.001 * g * g
                    self.w[name] -= (rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                self.w["word"] *= np.float32(0.995)  # words that come rarely must not decide

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            # as many pages as keep the padded batch below about 8000 blocks
            to = at + 1
            while to < len(order) and to - at < 256 and len(pages[order[to]]) * (to + 1 - at) <= 8000:
                to += 1
            p, (_, _, (where, _), *_) = self.forward([coded(pages[k]) for k in order[at:to]])
            ends = np.cumsum([0, *(len(pages[k]) for k in order[at:to])])
            flat = p[where] > 0.5
            for j, k in enumerate(order[at:to]):
                out[k] = flat[ends[j] : ends[j + 1]]
            at = to
        return out


def known_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels from the elements of a page that name its parts; None if it names no main part."""
    main = [("article" in b.path or "main" in b.path) for b in blocks]
    if not any(main):
        return None
    return np.array([m and not ASIDE & set(b.path) for m, b in zip(main, blocks)], dtype=np.float32)


def invented(paragraphs: list[str], rng: random.Random) -> str:
    """A page in an invented layout around the given paragraphs, each of which begins with ``MARK``."""
    import html

    def attribute(kind: str) -> str:
        if rng.random() < 0.12:
            return f' class="c{rng.randrange(999)}"'
        name = rng.choice(NAMES[kind])
        extra = rng.choice(["", "", " row", " col-8", " block", " inner", " wrapper"])
        return f' {rng.choice(["class", "class", "class", "id"])}="{name}{extra}"'

    def words(low: int, high: int) -> str:
        source = rng.choice(paragraphs).split()
        k = rng.randrange(max(1, len(source)))
        return html.escape(" ".join(source[k : k + rng.randint(low, high)]) or "x")

    def sentence(kind: str) -> str:
        return html.escape(rng.choice(SAYINGS[kind])) if rng.random() < 0.5 else words(2, 14)

    def links(n: int, kind: str) -> str:
        item = rng.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> | ", "<div><a href='/x'>{}</a></div>"])
        body = "".join(item.format(words(1, 3) if rng.random() < 0.6 else rng.choice(SAYINGS[kind])) for _ in range(n))
        return f"<ul>{body}</ul>" if item.startswith("<li") else body

    def wrap(tags: str, kind: str, body: str) -> str:
        tag = rng.choice(tags.split())
        plain = tag != "div" and rng.random() < 0.5
        return f"<{tag}{'' if plain else attribute(kind)}>{body}</{tag}>"

    def menu() -> str:
        return wrap("nav div ul", "menu", links(rng.randint(3, 8), "menu"))

    def header() -> str:
        return wrap("header div", "header", rng.choice([f"<h2>{words(1, 4)}</h2>", f"<p>{sentence('header')}</p>", f"<a href='/'>{words(1, 3)}</a>", ""]) + (menu() if rng.random() < 0.5 else f"<span>{sentence('header')}</span>"))

    def footer() -> str:
        return wrap("footer div", "footer", f"<p>{sentence('footer')}</p>" * rng.randint(0, 2) + sentence("footer") + (links(rng.randint(2, 5), "footer") if rng.random() < 0.5 else ""))

    def side() -> str:
        body = f"<h3>{sentence('side')}</h3>" + (links(rng.randint(2, 6), "side") if rng.random() < 0.6 else f"<p>{words(4, 40)}</p>" * rng.randint(1, 2))
        return wrap("aside div section", "side", body)

    def notice() -> str:
        return wrap("div section", "notice", rng.choice([f"<p>{sentence('notice')}</p><button>{rng.choice(SAYINGS['notice'])}</button>", sentence("notice")]))

    def advert() -> str:
        return wrap("div aside", "advert", rng.choice([f"<p>{sentence('advert')} {words(3, 25)}</p>", sentence("advert"), f"<a href='/ad'>{words(2, 12)}</a>", words(4, 20)]))

    def form() -> str:
        return wrap("form form div", "form", f"<label>{sentence('form')}</label><input name='q'><p>{sentence('form')}</p><button>{rng.choice(SAYINGS['form'])}</button>")

    def comments() -> str:
        one = rng.choice(["<li>{}<p>{}</p></li>", "<div class='comment'><b>{}</b><p>{}</p></div>", "<div><span>{}</span><div>{}</div></div>", "<article class='comment'>{}<p>{}</p></article>"])
        body = "".join(one.format(sentence("comments"), words(5, 60)) for _ in range(rng.randint(1, 5)))
        return wrap("section div ol", "comments", f"<h3>{rng.choice(SAYINGS['comments'])}</h3>" + body + (form() if rng.random() < 0.3 else ""))

    def main() -> str:
        body = []
        for k, text in enumerate(paragraphs):
            shown = MARK + html.escape(text, quote=False)
            if k == 0 and rng.random() < 0.7:
                body.append(f"<h1>{shown}</h1>")
            elif len(text) < 80 and rng.random() < 0.4:
                body.append(rng.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<figure><figcaption>{}</figcaption></figure>", "<pre>{}</pre>"]).format(shown))
            else:
                body.append(rng.choice(["<p>{}</p>"] * 6 + ["<div>{}</div>", "<blockquote>{}</blockquote>", "<p>{}", "<p><b>{}</b></p>", "<table><tr><td>{}</td></tr></table>"]).format(shown))
            if rng.random() < 0.08:
                body.append(rng.choice([advert, form, side, notice])())
        inside = "".join(body) + (comments() if rng.random() < 0.2 else "")
        tag = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        # An unnamed box is main text by its content alone; it keeps the labeller from asking for a name.
        name = attribute("main") if tag in ("div", "section") or rng.random() < 0.3 else ""
        whole = f"<{tag}{name}>{inside}</{tag}>"
        return f"<div class='container'>{whole}</div>" if rng.random() < 0.3 else whole

    before = [f() for f in (header, menu, notice, advert, side) if rng.random() < 0.5]
    after = [f() for f in (comments, side, advert, form, notice, footer, footer) if rng.random() < 0.4]
    page = f"<html><head><title>{html.escape(paragraphs[0][:60])}</title></head><body>{''.join(before)}{main()}{''.join(after)}"
    return page + ("</body></html>" if rng.random() < 0.9 else "")


def marked(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of an invented page without their marks, and which had one."""
    blocks = leaf_blocks(page)
    labels = np.array([b.text.startswith(MARK) for b in blocks], dtype=np.float32)
    return [b._replace(text=b.text.removeprefix(MARK)) for b in blocks], labels


def train(pages: list[str], seed: int = 9) -> Labeller:
    """A labeller from whole pages."""
    rng = random.Random(seed)
    inputs, labels = [], []
    stock = ["A heading of a page", "This is a paragraph with a few words, and it ends with a stop.", "Another paragraph follows here. It is longer than the first one, as it has two sentences."]
    for page in [*pages, *([""] * (60 if len(pages) < 60 else 0))]:
        blocks = leaf_blocks(page)
        known = known_labels(blocks)
        if known is not None:
            inputs.append(coded(blocks))
            labels.append(known)
            stock = [b.text for b, y in zip(blocks, known) if y] or stock
        for _ in range(LAYOUTS):
            blocks, part = marked(invented(stock[:1] + rng.sample(stock[1:], min(len(stock) - 1, rng.randint(1, 14))), rng))
            inputs.append(coded(blocks))
            labels.append(part)
    model = Labeller(seed)
    model.fit(inputs, labels, seed)
    return model


def sample(pages: DataFrame, count: int = TRAIN_PAGES) -> list[str]:
    """At most ``count`` whole pages, the first by a hash of their address and id."""
    order = F.xxhash64(F.coalesce(F.col("url").cast("string"), F.lit("")), F.col("page_id"))
    rows = pages.where("html is not null and html <> ''").select("html", order.alias("o"))
    # Hashes first: pages themselves are sent only up to the last one wanted.
    last = rows.select("o").orderBy("o").limit(count).agg(F.max("o")).first()[0]
    if last is None:
        return []
    return [html for _, html in sorted((r.o, r.html) for r in rows.where(F.col("o") <= last).limit(count).collect())]


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars (code points) of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole, "html", 1 << 20):
                blocks = [leaf_blocks(p or "") for p in batch.column("html").to_pylist()]
                out = ["\n".join(b.text for b, y in zip(own, main) if y) for own, main in zip(blocks, model.label(blocks))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_texts(pages: DataFrame) -> DataFrame:
    """Train on a bounded sample of ``pages``, then extract all of them."""
    return extract(pages, train(sample(pages)))
