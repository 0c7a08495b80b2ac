"""Prediction by partial matching over the whole byte sequence of a text, spaces and earlier words included.

A text is its lower-cased (A-Z) words, each closed by a space, and an end, which is one more space.
Before it lie a space and start marks (a byte that no word holds). Every symbol, a byte, is predicted
from the ``ORDER`` bytes before it, wherever words begin.

The longest context seen in learning predicts first. A context of total count T with q distinct
symbols gives a symbol of count n the probability (n - 1/2) / T, and an escape q / 2T to the context
shorter by one byte (method D). Symbols of the longer context are excluded there: their counts and
number leave T and q. Below the empty context, the symbols that are not excluded are equally likely.
Nothing is sampled: the counts are those of all learned texts, the scored one included if it is learned.

How it is spread: texts lie in blocks. A block gives its distinct (context, symbol) pairs with their
counts in learned texts, and its distinct words likewise. Pairs are dealt to buckets by the last ``NEAR``
bytes of their context, so that a bucket has all longer contexts of its pairs; of the shorter ones there are
at most 256 ** ``NEAR`` counts, which go to every task. What a block has in a bucket is one row of packed
columns, pairs ordered nearest byte first, and so is the answer. A pair that the longest context predicts is answered
by its count and the total of its context, which pack better than a logarithm. A block finds the order of its words
again from its text.

Results for odd input: a null or empty text is the end alone; if nothing is learned, all symbols are
equally likely; repeated rows and rows with a null ``doc_id`` are learned and scored as often as they
occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scoring import SYMBOLS
from .scratch import Scratch

ORDER = 6
#: What precedes a text, and the end.
START, END = b"\n" * (ORDER - 1) + b" ", b" "
#: A block of texts ends at so many bytes; so many symbols are worked on at a time.
BLOCK_BYTES, AT_A_TIME = 20 << 20, 2 << 20
#: Bytes of a context that deal out pairs, and buckets of pairs and words.
NEAR, BUCKETS = 3, 1024
#: So many keys of a bucket are held before they are summed; so many symbols are looked up in order.
HELD_KEYS, LOOKED_UP = 4_000_000, 1 << 18

BLOCK = {"block": pa.int64(), "ids": pa.list_(pa.int64()), "learned": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "text": pa.binary()}
OF_BUCKET = {"bucket": pa.int32(), "words": pa.binary(), "word_seen": pa.binary(), "pairs": pa.binary(), "pair_seen": pa.binary()}
SHORT = {"pair": pa.int64(), "seen": pa.int64()}
PARTS = (
    "block long, ids array<long>, learned array<boolean>, sizes array<long>, text binary, "
    "bucket int, words binary, word_seen binary, pairs binary, pair_seen binary, pair long, seen long"
)
ANSWERS = {"block": pa.int64(), "bucket": pa.int32(), "word_seen": pa.binary(), "pairs": pa.binary(), "pair_seen": pa.binary(), "contexts": pa.binary(), "rest": pa.binary(), "total": pa.int64(), "distinct": pa.int64()}
RESULT = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"


def mask(level: int) -> int:
    """Bits of a pair that hold the symbol and the ``level`` bytes before it."""
    return (1 << 8 * (level + 1)) - 1


def normal(text: bytes | None) -> tuple[list[bytes], bytes]:
    """The words of a text, and its bytes with start and end."""
    words = (text or b"").lower().split()
    return words, START + b"".join(w + b" " for w in words) + END


def pairs_of(data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Number of the text and pair of every symbol of texts of ``sizes`` bytes, in runs. A pair is the symbol (lowest byte) and
    the bytes before it, the nearest lowest, as one number."""
    ends = np.cumsum(sizes)
    symbol = np.ones(len(data), dtype=bool)
    for k in range(ORDER):
        symbol[ends - sizes + k] = False
    # eight bytes from each place on as one number, the first highest
    eight = np.ndarray(max(len(data) - ORDER, 0), ">u8", np.append(data, np.uint8(0)).tobytes(), strides=(1,))
    for low in range(0, len(data), AT_A_TIME):
        at = np.flatnonzero(symbol[low : low + AT_A_TIME])
        if not len(at):
            continue
        first = max(low - ORDER, 0)
        run = (eight[first : low + AT_A_TIME - ORDER].astype(np.uint64) >> np.uint64(8)).astype(np.int64)
        yield np.searchsorted(ends, low + at, side="right"), run[low + at - ORDER - first]


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` of each."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


def found_at(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``key`` in the ordered ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return at, keys[at] == key


def turned(pair: np.ndarray) -> np.ndarray:
    """Pairs with the bytes of the context the other way round, the nearest highest; and back again."""
    return pair.byteswap() & np.int64((1 << 56) - 1) | pair & np.int64(255)


def bucket_of(key: np.ndarray) -> np.ndarray:
    """Bucket of each turned pair, by the ``NEAR`` bytes before the symbol."""
    near = (key >> np.int64(8 * (ORDER - NEAR + 1))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((near >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int16)


def squeezed(data: bytes, level: int = 1) -> bytes:
    """Compressed bytes after their number."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte column by byte column, compressed."""
    return squeezed(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    columns = np.frombuffer(whole(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(columns.T).view("<i8").reshape(-1)


def begins(key: np.ndarray) -> np.ndarray:
    """Which of some ordered turned pairs are the first of their context."""
    context = key >> np.int64(8)
    return np.append(True, context[1:] != context[:-1])[: len(key)]


def block_pairs(text: bytes, sizes: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct turned pairs of a block in order, and how often learned texts have each."""
    keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for owner, pair in pairs_of(np.frombuffer(text, np.uint8), sizes):
        key = turned(pair) << np.int64(1) | learned[owner]
        key.sort()
        own = key >> np.int64(1)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        keys.append(own[first])
        counts.append(np.add.reduceat(key & np.int64(1), first))
        held += len(first)
        if held >= AT_A_TIME:
            found = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [found[0]], [found[1]], 0
    return summed(np.concatenate(keys), np.concatenate(counts))


def looked_up(keys: np.ndarray, values: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The value of each ``key`` of the ordered ``keys``; all of them are there. They are looked up in order, a run at a
    time, as many are equal."""
    out = np.empty(len(key), values.dtype)
    for low in range(0, len(key), LOOKED_UP):
        run = key[low : low + LOOKED_UP]
        order = np.argsort(run)
        ordered = run[order]
        first = np.append(True, ordered[1:] != ordered[:-1])
        out[low + order] = values[np.searchsorted(keys, ordered[first])][np.cumsum(first) - 1]
    return out


def by_bucket(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of turned pairs by bucket, and where each bucket begins in it, with the end."""
    bucket = bucket_of(key)
    return np.argsort(bucket, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))))


def words_by_bucket(words: dict[bytes, int]) -> dict[int, list[bytes]]:
    """Distinct words by bucket, each bucket in the order given."""
    listed = list(words)
    bucket = np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) % BUCKETS
    order = np.argsort(bucket.astype(np.int16), kind="stable")
    begin = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=BUCKETS)))).tolist()
    listed = [listed[k] for k in order.tolist()]
    return {k: listed[begin[k] : begin[k + 1]] for k in range(BUCKETS) if begin[k] < begin[k + 1]}


def coded(docs: DataFrame) -> DataFrame:
    """Per block: a row with its texts, and a row for each bucket with its distinct words and pairs there and
    their counts in learned texts. Per task: the counts of learned pairs of short contexts."""

    def part(n: int, **columns) -> pa.RecordBatch:
        kinds = BLOCK | OF_BUCKET | SHORT
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        learned: list[bool] = []
        held: list[bytes] = []
        seen: dict[bytes, int] = {b"": 0}
        size = 0
        short = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal short
            block = uuid.uuid4().int >> 65
            text, sizes = b"".join(held), np.fromiter(map(len, held), np.int64, len(held))
            yield part(1, block=[block], ids=[ids], learned=[learned], sizes=[sizes], text=[squeezed(text, 6)])
            key, n = block_pairs(text, sizes, np.array(learned, dtype=np.int64))
            known = n > 0
            few = summed(turned(key[known]) & np.int64(mask(NEAR - 1)), n[known])
            short = summed(np.concatenate((short[0], few[0])), np.concatenate((short[1], few[1])))
            order, begin = by_bucket(key)
            words = words_by_bucket(seen)
            rows: dict[str, list] = {c: [] for c in OF_BUCKET}
            for k in range(BUCKETS):
                own, at = words.get(k), order[begin[k] : begin[k + 1]]
                if own or len(at):
                    rows["bucket"].append(k)
                    rows["words"].append(squeezed(b"\n".join(own)) if own else None)
                    rows["word_seen"].append(packed(np.array([seen[w] for w in own])) if own else None)
                    rows["pairs"].append(packed(key[at]))
                    rows["pair_seen"].append(packed(n[at]))
            yield part(len(rows["bucket"]), block=[block] * len(rows["bucket"]), **rows)

        for batch in batches:
            for doc, own, raw in zip(batch.column("doc_id").to_pylist(), batch.column("learned").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words, normed = normal(raw)
                words.append(b"")
                if own:
                    for w in words:
                        seen[w] = seen.get(w, 0) + 1
                else:
                    for w in words:
                        seen.setdefault(w, 0)
                ids.append(doc)
                learned.append(own)
                held.append(normed)
                size += len(normed)
                if size >= BLOCK_BYTES:
                    yield from out()
                    ids, learned, held, seen, size = [], [], [], {b"": 0}, 0
        if held:
            yield from out()
        for k in range(0, len(short[0]), 100_000):
            some = short[0][k : k + 100_000]
            yield part(len(some), pair=some, seen=short[1][k : k + 100_000])

    return docs.mapInArrow(run, PARTS)


class Level:
    """Counts of contexts of one length: ``keys`` (pairs cut to it) and ``n``; per context its total, its
    number of symbols, and the count that these have in the context shorter by one byte."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, level: int, below: Level | None):
        self.keys, self.n = keys, n
        above = np.zeros(len(keys), np.int64) if below is None else below.n[found_at(below.keys, keys & mask(level - 1))[0]]
        context = keys >> 8
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.total, self.shared = (np.add.reduceat(x, first) if len(keys) else x for x in (n, above))
        self.distinct = np.diff(np.append(first, len(keys)))


def levels(key: np.ndarray, n: np.ndarray, high: int, low: int, below: Level | None) -> list[Level]:
    """Levels from ``low`` to ``high``, from the pairs of ``high``."""
    tables = [(key, n)]
    for level in range(high - 1, low - 1, -1):
        tables.append(summed(tables[-1][0] & mask(level), tables[-1][1]))
    out: list[Level] = []
    for level, table in zip(range(low, high + 1), reversed(tables)):
        below = Level(*table, level, below)
        out.append(below)
    return out


def log_probabilities(pair: np.ndarray, trie: list[Level]) -> np.ndarray:
    """Base-10 log-probability of the symbol of each pair, from the longest context down."""
    value, done = np.zeros(len(pair)), np.zeros(len(pair), bool)
    excluded, gone = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
    for level in range(len(trie) - 1, -1, -1):
        own = trie[level]
        open_ = np.flatnonzero(~done)
        key = pair[open_] & mask(level)
        node, known = found_at(own.contexts, key >> 8)
        open_, key, node = open_[known], key[known], node[known]
        at, met = found_at(own.keys, key)
        left = own.total[node] - gone[open_]
        fresh = own.distinct[node] - excluded[open_]
        value[open_[met]] += np.log10((own.n[at[met]] - 0.5) / left[met])
        escapes = ~met & (fresh > 0)
        value[open_[escapes]] += np.log10(fresh[escapes] / (2 * left[escapes]))
        done[open_[met]] = True
        excluded[open_], gone[open_] = own.distinct[node], own.shared[node]
    value[~done] -= np.log10(np.maximum(SYMBOLS - excluded[~done], 1))
    return value


def values(key: np.ndarray, n: np.ndarray, totals: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Base-10 log-probabilities of ordered turned pairs: from their counts and the totals of their contexts if the
    longest context predicts them, else as they were sent."""
    out, met = np.empty(len(key)), n > 0
    of = totals[np.cumsum(begins(key)) - 1]
    out[met] = np.log10((n[met] - 0.5) / of[met])
    out[~met] = rest
    return out


def answers(parts: DataFrame) -> DataFrame:
    """Per block and bucket: counts of its words; counts of its pairs, totals of their contexts and the
    log-probabilities of pairs that were not learned, all in their order. Per bucket, without a block: the
    total and the number of learned words."""
    short = parts.where("pair is not null").groupBy("pair").agg(F.sum("seen").alias("n")).toArrow()
    key, n = summed(short.column("pair").to_numpy(), short.column("n").to_numpy())
    below = levels(key, n, NEAR - 1, 0, None)

    def all_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for key, n in zip(table.column("pairs"), table.column("pair_seen")):
            keys.append(turned(unpacked(key.as_py())))
            counts.append(unpacked(n.as_py()))
            held += len(keys[-1])
            if held >= HELD_KEYS + 2 * len(keys[0]):
                found = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [found[0]], [found[1]], len(found[0])
        return summed(np.concatenate(keys), np.concatenate(counts))

    def run(table: pa.Table) -> pa.Table:
        pair, n = all_pairs(table)
        trie = below + levels(pair[n > 0], n[n > 0], ORDER, NEAR, below[-1])
        new = np.flatnonzero(n == 0)
        logp = np.zeros(len(pair))
        logp[new] = log_probabilities(pair[new], trie)
        total = np.zeros(len(pair), np.int64)
        node, known = found_at(trie[-1].contexts, pair >> 8)
        total[known] = trie[-1].total[node[known]]
        count: dict[bytes, int] = {}
        listed = lambda words: whole(words.as_py()).split(b"\n")
        for words, seen in zip(table.column("words"), table.column("word_seen")):
            if words.is_valid:
                for w, k in zip(listed(words), unpacked(seen.as_py()).tolist()):
                    count[w] = count.get(w, 0) + k
        found = [packed(np.array([count[w] for w in listed(x)])) if x.is_valid else None for x in table.column("words")]
        of_pairs: dict[str, list] = {"pair_seen": [], "contexts": [], "rest": []}
        for x in table.column("pairs"):
            key = unpacked(x.as_py())
            at = np.searchsorted(pair, turned(key))
            of_pairs["pair_seen"].append(packed(n[at]))
            of_pairs["contexts"].append(packed(total[at][begins(key)]))
            of_pairs["rest"].append(logp[at][n[at] == 0].astype("<f8").tobytes())
        columns = {
            "block": [*table.column("block").to_pylist(), None], "bucket": [*table.column("bucket").to_pylist(), None],
            "word_seen": [*found, None], "pairs": [*table.column("pairs").to_pylist(), None], **{c: [*x, None] for c, x in of_pairs.items()},
            "total": [None] * len(found) + [sum(count.values())], "distinct": [None] * len(found) + [sum(k > 0 for k in count.values())],
        }
        return pa.table({c: pa.array(columns[c], t) for c, t in ANSWERS.items()})

    rows = parts.where("bucket is not null").select("block", *OF_BUCKET)
    return rows.groupBy("bucket").applyInArrow(run, "block long, bucket int, word_seen binary, pairs binary, pair_seen binary, contexts binary, rest binary, total long, distinct long")


def document_scores(parts: DataFrame, answered: DataFrame, total: int, distinct: int) -> DataFrame:
    """Sums over the words and the symbols of each text, from the texts of its block."""

    def run(key: tuple, block: pa.Table, table: pa.Table) -> pa.Table:
        own_block = block.to_pylist()[0]
        text, sizes = whole(own_block.pop("text")), np.array(own_block["sizes"], dtype=np.int64)
        pairs, logps = [], []
        for own, n, totals, rest in zip(*(table.column(c) for c in ("pairs", "pair_seen", "contexts", "rest"))):
            pairs.append(unpacked(own.as_py()))
            logps.append(values(pairs[-1], unpacked(n.as_py()), unpacked(totals.as_py()), np.frombuffer(rest.as_py(), "<f8")))
        pair, logp = np.concatenate(pairs), np.concatenate(logps)
        order = np.argsort(pair)
        pair, logp = pair[order], logp[order]
        words = words_by_bucket(dict.fromkeys([b"", *text.split()]))
        count: dict[bytes, int] = {}
        for bucket, seen in zip(table.column("bucket").to_pylist(), table.column("word_seen")):
            if seen.is_valid:
                count.update(zip(words[bucket], unpacked(seen.as_py()).tolist()))
        score = np.zeros(len(sizes))
        for owner, own in pairs_of(np.frombuffer(text, np.uint8), sizes):
            first = int(owner[0])
            found = np.bincount(owner - first, weights=looked_up(pair, logp, turned(own)))
            score[first : first + len(found)] += found
        n_tokens, n_known, base_score = [], [], []
        begin = 0
        for size in sizes.tolist():
            own_words = text[begin + ORDER : begin + size].split()
            begin += size
            seen = np.array([count[w] for w in own_words] + [count[b""]], dtype=np.int64)
            n_tokens.append(len(seen))
            n_known.append(int((seen > 0).sum()))
            base_score.append(float(np.log10((seen + 1) / (total + distinct + 1)).sum()))
        return pa.table({
            "doc_id": pa.array(own_block["ids"], pa.int64()), "learned": pa.array(own_block["learned"], pa.bool_()), "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64()),
        })

    blocks = parts.where("text is not null").select(F.col("block").alias("of_block"), "ids", "learned", "sizes", "text")
    found = answered.where("block is not null").drop("total", "distinct")
    return blocks.groupBy("of_block").cogroup(found.groupBy("block")).applyInArrow(run, RESULT)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score and score of ``docs`` (doc_id, text,
    learned): the model learns from the rows with ``learned`` and scores all."""
    tables = Scratch(docs.sparkSession, "contexts")
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("learned", F.lit(False)).alias("learned"), F.col("text").cast("string"))
    parts = tables.keep(coded(plain), "parts")
    answered = tables.keep(answers(parts), "answers")
    total, distinct = answered.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct")]).first()
    found = document_scores(parts, answered, total, distinct)
    return found.withColumn("train_tokens", F.lit(total).cast("long"))
