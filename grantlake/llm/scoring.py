"""Prediction by partial matching: log-probabilities of texts under a byte-context trie.

A text is its lower-cased (A-Z) words, each closed by a space, and an end. A symbol, a byte or the
space, is predicted from the bytes before it in its word, the space that opens the word included, at
most ``ORDER`` of them. The end is a word without bytes.

The longest context seen in learning predicts first. A context of total count T with q distinct
symbols gives a symbol of count n the probability (n - 1/2) / T, and an escape q / 2T to the context
shorter by one byte (method D). Symbols of the longer context are excluded there: their counts and
number leave T and q. Below the empty context, the symbols that are not excluded are equally likely.

Long contexts: where the last ``LONG`` words of a text have a hash that marks an anchor (one in
``EVERY``), the trie also keeps what followed these words, up to the next anchor. If another learned
document has the anchor (of several, that of the smallest or largest ``doc_id``), its words are
predicted one by one with the probability 1 - e each, until one is not met. That word escapes: it
costs e and is coded as above. The escapes e are estimated from the learned documents, each held
against the others, for the first, the next three and all later words. A document is never its own
continuation. So passages that documents share cost little, as in a trie of unbounded depth.

How it is spread: documents are coded in blocks, as numbers into the words of their block, and words
in blocks likewise, as numbers into the context-symbol pairs of their block. Only the dictionaries of
blocks are shuffled: words meet the counts of all words, pairs meet the trie, and the values come
back to their blocks. The trie is a table of (context, symbol, count), summed in each task first; it
grows with the corpus, is never held in one place and is not broadcast. Anchors are met twice: first as hashes
alone; only those of several documents are sent with what follows.

Results for odd input: a null or empty text is the end alone; if nothing is learned, all symbols are
equally likely; repeated rows are learned and scored as often as they occur; rows with a null
``doc_id`` are learned and scored, but have no long contexts; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import texts
from .scratch import Scratch
from .substrings import SENT_IDS, of_ids

ORDER = 6
#: Bytes that a word may hold, and the space.
SYMBOLS = 256 - 5
SPACE = 32
#: A block of documents ends at so many words, a block of words at so many bytes.
BLOCK_TOKENS = 2_000_000
BLOCK_BYTES = 2 << 20

#: Words of a long context, one anchor in how many words, and the most words that follow one.
LONG, EVERY, AHEAD = 8, 16, 48
#: First word after an anchor, the next three, all later ones: their bounds.
STEPS = (0, 1, 4)
TAG = (1 << 40) - 1

CODED = "block string, doc_id long, learned boolean, n_tokens long, gain double, words binary, counts binary, left binary, word binary, number int, seen long"


class Anchors:
    """Anchors of the texts of a slice: the number of the text, the hash of the context, and the place
    of the word after it. ``tags`` names the rows of one doc_id by their words."""

    def __init__(self, column: pa.Array):
        words = texts.Words(column, lower=True)
        self.words, self.hashes = words, words.hashes()
        runs = texts.run_hashes(self.hashes, LONG)
        many = np.maximum(words.counts() - LONG + 1, 0)
        start = texts.ranges(words.first[:-1], many)
        chosen = (runs[start] >> np.uint64(20)) % np.uint64(EVERY) == 0 if len(start) else np.zeros(0, bool)
        self.text = np.repeat(np.arange(words.texts), many)[chosen]
        self.context = runs[start[chosen]].view(np.int64) if len(start) else np.zeros(0, np.int64)
        self.after = start[chosen] + LONG
        self.tags = np.array([int(texts.fold_hash(self.hashes[a:b])) & TAG if b > a else 0 for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())], dtype=np.int64)

    def ends(self) -> np.ndarray:
        """Where the words after each anchor end: at the next anchor, the text's end or after ``AHEAD``."""
        limit = np.minimum(self.after + AHEAD, self.words.first[1:][self.text])
        if len(limit) > 1:
            near = self.text[1:] == self.text[:-1]
            limit[:-1][near] = np.minimum(limit[:-1][near], self.after[1:][near])
        return limit


def anchors(docs: DataFrame) -> DataFrame:
    """context, doc_id, tag and learned of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole):
                found = Anchors(batch.column("text"))
                at = pa.array(found.text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.context), batch.column("doc_id").take(at), pa.array(found.tags[found.text]), batch.column("learned").take(at)], ["context", "doc_id", "tag", "learned"]
                )

    return docs.where("doc_id is not null").mapInArrow(run, "context long, doc_id long, tag long, learned boolean")


def following(rows: DataFrame) -> DataFrame:
    """What follows the anchors that ``rows`` (doc_id, learned, text, tag, contexts) ask for: context,
    doc_id, tag, learned, start and the hashes of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole):
                found = Anchors(batch.column("text"))
                ends = found.ends()
                out: list[list] = [[] for _ in range(6)]
                ids, learned, tags = (batch.column(c).to_pylist() for c in ("doc_id", "learned", "tag"))
                bounds = np.searchsorted(found.text, np.arange(batch.num_rows + 1))
                short = found.hashes.astype("<u4")
                for k in range(batch.num_rows):
                    if found.tags[k] != tags[k]:
                        continue
                    own = slice(bounds[k], bounds[k + 1])
                    asked = np.isin(found.context[own], batch.column("contexts")[k].values.to_numpy())
                    for at in np.flatnonzero(asked) + bounds[k]:
                        a = int(found.after[at])
                        for column, value in zip(out, (int(found.context[at]), ids[k], tags[k], learned[k], a - int(found.words.first[k]), short[a : int(ends[at])].tobytes())):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["context", "doc_id", "tag", "learned", "start", "next"])

    return rows.mapInArrow(run, "context long, doc_id long, tag long, learned boolean, start long, next binary")


def met_words(own: bytes, other: bytes | None) -> tuple[int, bool]:
    """How many words are as predicted, and whether one follows that is not."""
    if other is None:
        return 0, False
    a, b = np.frombuffer(own, "<u4"), np.frombuffer(other, "<u4")
    n = min(len(a), len(b))
    wrong = np.flatnonzero(a[:n] != b[:n])
    return (int(wrong[0]), True) if len(wrong) else (n, False)


def met(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, tag, learned, start, next, other) with the number of words met, and missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [met_words(a, b) for a, b in zip(batch.column("next").to_pylist(), batch.column("other").to_pylist())]
            counts, missed = (list(c) for c in zip(*pairs)) if pairs else ([], [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "tag", "learned", "start")), pa.array(counts, pa.int64()), pa.array(missed, pa.bool_())], ["doc_id", "tag", "learned", "start", "met", "missed"]
            )

    return rows.mapInArrow(run, "doc_id long, tag long, learned boolean, start long, met long, missed boolean")


def of_step(k: int) -> tuple[Column, Column]:
    """Words met in a step of ``STEPS``, and whether the missed word lies in it."""
    low, high = STEPS[k], STEPS[k + 1] if k + 1 < len(STEPS) else 1 << 40
    inside = F.least(F.greatest(F.col("met") - low, F.lit(0)), F.lit(high - low))
    return inside, F.col("missed") & (F.col("met") >= low) & (F.col("met") < high)


def long_contexts(plain: DataFrame, tables: Scratch) -> DataFrame:
    """doc_id, tag, the log-probability of what long contexts predict (gain), and the words met: starts
    and lengths."""
    every = tables.keep(anchors(plain), "anchors")
    shared = every.groupBy("context").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bool_or("learned").alias("any")).where("lo < hi and any")
    wanted = every.join(shared.select("context"), "context").groupBy("doc_id", "tag").agg(F.collect_set("context").alias("contexts"))
    wanted = tables.keep(wanted, "wanted")
    chosen = of_ids(plain, wanted, wanted.count()).join(wanted, "doc_id")
    after = tables.keep(following(chosen.select("doc_id", "learned", "text", "tag", "contexts")), "following")
    tables.drop("anchors", "wanted")
    one = F.struct("doc_id", "start", "next")
    sources = after.where("learned").groupBy("context").agg(F.min(one).alias("lo"), F.max(one).alias("hi"))
    other = F.when(F.col("lo.doc_id") != F.col("doc_id"), F.col("lo.next")).when(F.col("hi.doc_id") != F.col("doc_id"), F.col("hi.next"))
    compared = after.join(sources, "context").withColumn("other", other).where("other is not null")
    outcome = tables.keep(met(compared.select("doc_id", "tag", "learned", "start", "next", "other")), "met")
    sums = []
    for k in range(len(STEPS)):
        inside, missed = of_step(k)
        sums += [F.coalesce(F.sum(inside), F.lit(0)), F.count_if(missed)]
    found = outcome.where("learned").agg(*sums).first()
    gain = F.lit(0.0)
    for k in range(len(STEPS)):
        inside, missed = of_step(k)
        escape = (found[2 * k + 1] + 0.5) / (found[2 * k] + found[2 * k + 1] + 1)
        gain = gain + inside * F.lit(math.log10(1 - escape)) + F.when(missed, F.lit(math.log10(escape))).otherwise(0.0)
    spans = outcome.withColumn("gain", gain).groupBy("doc_id", "tag").agg(F.sum("gain").alias("gain"), F.collect_list(F.struct("start", "met")).alias("spans"))
    tables.drop("following")
    return tables.keep(spans, "spans")


def tagged(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, learned, text) with the tag of the row's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(Anchors(batch.column("text")).tags)], [*batch.schema.names, "tag"])

    return docs.mapInArrow(run, "doc_id long, learned boolean, text string, tag long")


def with_spans(plain: DataFrame, spans: DataFrame) -> DataFrame:
    """All rows of ``plain`` with gain and spans, null where there are none."""
    ids, count = spans.select("doc_id").distinct(), spans.count()
    rest = plain.join(F.broadcast(ids) if count <= SENT_IDS else ids, "doc_id", "left_anti")
    some = tagged(of_ids(plain, spans, count).select("doc_id", "learned", "text")).join(spans, ["doc_id", "tag"], "left")
    kind = spans.schema["spans"].dataType
    rest = rest.select("doc_id", "learned", "text", F.lit(None).cast("double").alias("gain"), F.lit(None).cast(kind).alias("spans"))
    return some.select("doc_id", "learned", "text", "gain", "spans").unionByName(rest)


def coded(docs: DataFrame) -> DataFrame:
    """Two kinds of rows per block: documents (numbers of their distinct words and how often), and
    words (word, number, and its count in learned documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        seen: list[int] = []
        rows: list[tuple] = []
        tokens = 0

        def out() -> Iterator[pa.RecordBatch]:
            block, n = uuid.uuid4().hex, len(number)
            nothing = [None] * n
            yield batch_of([[block] * len(rows), *map(list, zip(*rows)), *([None] * len(rows) for _ in range(3))])
            yield batch_of([[block] * n, *(nothing for _ in range(7)), list(number), list(range(n)), seen])

        for batch in batches:
            for doc, learned, raw, gain, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "learned")), batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("gain", "spans"))):
                words = (raw or b"").lower().split()
                count = Counter(words)
                count[b""] = 1
                own = [number.setdefault(w, len(number)) for w in count]
                seen.extend(itertools.repeat(0, len(number) - len(seen)))
                if learned:
                    for k, c in zip(own, count.values()):
                        seen[k] += c
                counts = np.fromiter(count.values(), "<i4", len(own))
                left = None
                if spans:
                    met_here = Counter(itertools.chain.from_iterable(words[x["start"] : x["start"] + x["met"]] for x in spans))
                    left = np.fromiter((c - met_here[w] for w, c in count.items()), "<i4", len(own))
                rows.append((doc, learned, len(words) + 1, gain or 0.0, np.array(own, "<i4").tobytes(), small(counts), small(left)))
                tokens += len(words) + 1
                if tokens >= BLOCK_TOKENS:
                    yield from out()
                    number, seen, rows, tokens = {}, [], [], 0
        if rows:
            yield from out()

    return docs.mapInArrow(run, CODED)


def small(counts: np.ndarray | None) -> bytes | None:
    """Counts as a byte each if all fit, else as four."""
    if counts is None:
        return None
    return counts.astype("<u1" if counts.max(initial=0) < 256 else "<i4").tobytes()


def read_small(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u1" if len(raw) == n else "<i4").astype(np.int64)


def batch_of(columns: list[list]) -> pa.RecordBatch:
    names = [c.split()[0] for c in CODED.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[c.split()[1]]) for v, c in zip(columns, CODED.split(", "))], names=names)


def pairs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context-symbol pair of every symbol of the words, and each word's number of symbols. A pair is
    the context's bytes (up to ``ORDER``, the last ones) and the symbol, as one number. Only a context
    that reaches back to the start of its word holds a space, as its first byte, so zeros before it
    do not blur its length."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(sizes) - sizes
    at = 1 + np.arange(int(sizes.sum()))
    depth = at - np.repeat(begin, sizes)
    pair = data[at].copy()
    for k in range(1, ORDER + 1):
        inside = depth >= k
        pair[inside] |= data[at[inside] - k] << np.uint64(8 * k)
    return pair.view(np.int64), sizes


def pair_blocks(words: DataFrame) -> DataFrame:
    """Blocks of ``words`` (word, seen): a row with all words and numbers of their pairs, and rows with
    each distinct pair, its number and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        seen: list[int] = []

        def out() -> Iterator[pa.RecordBatch]:
            block = uuid.uuid4().hex
            pair, sizes = pairs_of(held)
            distinct, number = np.unique(pair, return_inverse=True)
            count = np.bincount(number, weights=np.repeat(np.array(seen, dtype=np.float64), sizes), minlength=len(distinct)).astype(np.int64)
            n = len(distinct)
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
            names = ["block", "words", "sizes", "numbers", "pair", "number", "seen"]
            whole = [[block], [b"\n".join(held)], [sizes.astype("<i4").tobytes()], [number.astype("<i4").tobytes()], [None], [None], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(whole, kinds)], names=names)
            for k in range(0, n, 100_000):
                m = len(distinct[k : k + 100_000])
                part = [[block] * m, *([None] * m for _ in range(3)), distinct[k : k + m], np.arange(k, k + m, dtype=np.int32), count[k : k + m]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(part, kinds)], names=names)

        size = 0
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("seen").to_pylist()):
                held.append(word)
                seen.append(n)
                size += len(word) + 1
                if size >= BLOCK_BYTES:
                    yield from out()
                    held, seen, size = [], [], 0
        if held:
            yield from out()

    return words.mapInArrow(run, "block string, words binary, sizes binary, numbers binary, pair long, number int, seen long")


def pair_length() -> Column:
    """Bytes of the context of a pair: up to its space, else all ``ORDER``."""
    length = F.lit(ORDER)
    for k in range(ORDER, 0, -1):
        # a space as the k-th byte back closes the context there
        length = F.when(byte(k) == SPACE, F.lit(k)).otherwise(length)
    return length


def byte(k: int) -> Column:
    return F.shiftright("pair", 8 * k).bitwiseAND(F.lit(255))


def suffixes(pairs: DataFrame, *columns: str) -> DataFrame:
    """A row for every context of each pair, from all its bytes down to none: level, context, symbol."""
    level = F.explode(F.sequence(F.lit(0), pair_length()))
    rows = pairs.select("pair", *columns, level.alias("level"))
    mask = F.element_at(F.array(*[F.lit((1 << 8 * k) - 1) for k in range(ORDER + 1)]), F.col("level") + 1)
    return rows.select(
        "pair", *columns, "level", F.shiftright("pair", 8).bitwiseAND(mask).alias("context"), F.col("pair").bitwiseAND(F.lit(255)).cast("int").alias("symbol")
    )


def trie(pairs: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """``counts`` (level, context, symbol, n) and ``nodes`` (level, context, total, distinct, and
    ``shared``: the count that its symbols have in the context shorter by one byte)."""
    counts = suffixes(pairs.where("n > 0"), "n").groupBy("level", "context", "symbol").agg(F.sum("n").alias("n"))
    counts = tables.keep(counts, "counts")
    mask = F.element_at(F.array(*[F.lit((1 << 8 * k) - 1) for k in range(ORDER + 1)]), F.col("level"))
    parent = F.when(F.col("level") > 0, F.col("context").bitwiseAND(mask))
    child = counts.where("level > 0").withColumn("context_up", parent).withColumn("level_up", F.col("level") - 1)
    above = counts.select(F.col("level").alias("level_up"), F.col("context").alias("context_up"), "symbol", F.col("n").alias("n_up"))
    low = child.join(above, ["level_up", "context_up", "symbol"]).select("level", "context", "n", "n_up")
    root = counts.where("level = 0").select("level", "context", "n", F.lit(0).cast("long").alias("n_up"))
    nodes = low.unionByName(root).groupBy("level", "context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("n_up").alias("shared"))
    return counts, tables.keep(nodes, "nodes")


def pair_scores(pairs: DataFrame, counts: DataFrame, nodes: DataFrame, tables: Scratch) -> DataFrame:
    """(pair, logp): base-10 log-probability of the symbol in its context. Pairs that were learned end
    in their longest context; only the others go down the trie."""
    top = pairs.where("n > 0").withColumn("level", pair_length()).withColumn("context", F.shiftright("pair", 8))
    first = top.join(nodes, ["level", "context"]).select("pair", F.log10((F.col("n") - 0.5) / F.col("total")).alias("logp"))
    path = suffixes(pairs.where("n = 0"))
    path = path.join(nodes, ["level", "context"], "left").join(counts, ["level", "context", "symbol"], "left")
    # No level beyond the first with a count matters, and levels without a node lie above those with one.
    steps = path.groupBy("pair").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("level")).alias("down"), "n", "total", "distinct", "shared"))).alias("steps")
    )
    zero = F.struct(F.lit(0.0).alias("logp"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("gone"))

    def step(state: Column, x: Column) -> Column:
        left, fresh = x["total"] - state["gone"], x["distinct"] - state["q"]
        found = x["n"].isNotNull()
        gain = F.when(found, F.log10((x["n"] - 0.5) / left)).when(fresh > 0, F.log10(fresh / (2 * left))).otherwise(0.0)
        after = F.struct((state["logp"] + gain).alias("logp"), found.alias("done"), x["distinct"].alias("q"), x["shared"].alias("gone"))
        return F.when(state["done"] | x["total"].isNull(), state).otherwise(after)

    def finish(state: Column) -> Column:
        last = F.log10(F.greatest(F.lit(SYMBOLS) - state["q"], F.lit(1)).cast("double"))
        return F.when(state["done"], state["logp"]).otherwise(state["logp"] - last)

    rest = steps.select("pair", F.aggregate("steps", zero, step, finish).alias("logp"))
    return tables.keep(first.unionByName(rest), "pair_scores")


def word_scores(blocks: DataFrame, scored: DataFrame) -> DataFrame:
    """(word, logp) from the pairs of each block of words."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        table = np.zeros(rows.num_rows)
        number = rows.column("number").fill_null(-1).to_numpy()
        values = rows.column("logp").fill_null(0.0).to_numpy()
        table[number[number >= 0]] = values[number >= 0]
        whole = int(np.flatnonzero(number < 0)[0])
        words = rows.column("words")[whole].as_py().split(b"\n")  # no word holds a line break
        sizes = np.frombuffer(rows.column("sizes")[whole].as_py(), "<i4")
        each = table[np.frombuffer(rows.column("numbers")[whole].as_py(), "<i4")]
        ends = np.cumsum(sizes)
        return pa.table({"word": pa.array(words, pa.binary()), "logp": np.add.reduceat(each, ends - sizes)})

    filled = blocks.where("pair is not null").join(scored, "pair").select("block", *[F.lit(None).cast("binary").alias(c) for c in ("words", "sizes", "numbers")], "number", "logp")
    whole = blocks.where("pair is null").select("block", "words", "sizes", "numbers", F.lit(None).cast("int").alias("number"), F.lit(None).cast("double").alias("logp"))
    return filled.unionByName(whole).groupBy("block").applyInArrow(run, "word binary, logp double")


def document_scores(rows: DataFrame, known: DataFrame, total: int, distinct: int) -> DataFrame:
    """Sums over the tokens of each document, from the words of its block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number = table.column("number").fill_null(-1).to_numpy()
        is_word = number >= 0
        logp, seen = np.zeros(table.num_rows), np.zeros(table.num_rows, dtype=np.int64)
        logp[number[is_word]] = table.column("logp").fill_null(0.0).to_numpy()[is_word]
        seen[number[is_word]] = table.column("seen").fill_null(0).to_numpy()[is_word]
        base = np.log10((seen + 1) / (total + distinct + 1))
        docs = table.filter(pa.array(~is_word))
        out = []
        for words, counts, left, gain in zip(*(docs.column(c).to_pylist() for c in ("words", "counts", "left", "gain"))):
            k = np.frombuffer(words, "<i4")
            c = read_small(counts, len(k))
            out.append((int(c[seen[k] > 0].sum()), float(base[k] @ c), float(logp[k] @ (c if left is None else read_small(left, len(k)))) + gain))
        n_known, base_score, score = zip(*out) if out else ((), (), ())
        return pa.table({
            "doc_id": docs.column("doc_id"), "learned": docs.column("learned"), "n_tokens": docs.column("n_tokens"),
            "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64()),
        })

    words = rows.where("word is not null").select("block", "word", "number").join(known, "word")
    empty = {"words": "binary", "counts": "binary", "left": "binary", "doc_id": "long", "learned": "boolean", "n_tokens": "long", "gain": "double"}
    words = words.select("block", "number", "seen", "logp", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    docs = rows.where("word is null").select("block", *[F.lit(None).cast(t).alias(c) for c, t in {"number": "int", "seen": "long", "logp": "double"}.items()], *empty)
    schema = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"
    return words.unionByName(docs).groupBy("block").applyInArrow(run, schema)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score and score of ``docs`` (doc_id, text,
    learned): the model learns from the rows with ``learned`` and scores all."""
    tables = Scratch(docs.sparkSession, "scoring")
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("learned", F.lit(False)).alias("learned"), F.col("text").cast("string"))
    rows = tables.keep(coded(with_spans(plain, long_contexts(plain, tables))), "coded")
    vocabulary = rows.where("word is not null").groupBy("word").agg(F.sum("seen").alias("seen"))
    vocabulary = tables.keep(vocabulary, "vocabulary")
    total, distinct = vocabulary.where("seen > 0").agg(F.coalesce(F.sum("seen"), F.lit(0)), F.count("*")).first()
    blocks = tables.keep(pair_blocks(vocabulary), "pairs")
    pairs = tables.keep(blocks.where("pair is not null").groupBy("pair").agg(F.sum("seen").alias("n")), "pair_counts")
    counts, nodes = trie(pairs, tables)
    scored = pair_scores(pairs, counts, nodes, tables)
    known = word_scores(blocks, scored).join(vocabulary, "word")
    known = tables.keep(known.select("word", "seen", "logp"), "words")
    tables.drop("pairs", "pair_counts", "counts", "nodes", "pair_scores", "vocabulary")
    found = document_scores(rows, known, total, distinct)
    return found.withColumn("train_tokens", F.lit(total).cast("long"))


class AdaptiveTrie:
    """The same model learning as it goes, in plain Python: the code length of a text when every symbol
    is first predicted and then learned."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.nodes: dict[bytes, Counter] = {}

    def symbols(self, text: str | None) -> Iterator[tuple[bytes, int]]:
        for word in [*(text or "").encode().lower().split(), b""]:
            whole = b" " + word + b" "
            for k in range(1, len(whole)):
                yield whole[max(0, k - self.order) : k], whole[k]

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(len(context) + 1):
            self.nodes.setdefault(context[k:], Counter())[symbol] += 1

    def log10(self, context: bytes, symbol: int) -> float:
        excluded: set[int] = set()
        out = 0.0
        for k in range(len(context) + 1):
            node = self.nodes.get(context[k:])
            if node is None:
                continue
            left = {s: n for s, n in node.items() if s not in excluded}
            whole = sum(left.values())
            if symbol in left:
                return out + math.log10((left[symbol] - 0.5) / whole)
            if left:
                out += math.log10(len(left) / (2 * whole))
            excluded |= set(node)
        return out - math.log10(max(SYMBOLS - len(excluded), 1))

    def score(self, text: str | None, adapt: bool) -> float:
        total = 0.0
        for context, symbol in self.symbols(text):
            total += self.log10(context, symbol)
            if adapt:
                self.learn(context, symbol)
        return total


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id and score of ``docs`` (doc_id, text), each text coded on its own from an empty trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [AdaptiveTrie(order).score(t, adapt=True) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
