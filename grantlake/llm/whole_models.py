"""The word model of ``perplexity`` with all words and pairs of every language.

Nothing is left out: every word has its own number of different words before it, every pair its own count, however
rare. Texts lie in blocks of one language. A block is written once: its distinct words as hashes, the most frequent
first, and its texts as places in that list. From these a block gives its distinct pairs with their counts, dealt to
buckets, and what it has in a bucket is one row of packed columns; so is the answer.

Words with at least ``FREQUENT`` of all tokens (at most 1 / ``FREQUENT`` over all languages) have a number that all
tasks know; this only shortens rows, as other words are sent as hashes. A pair of two such words is dealt by itself,
one with a rare word by that word, so that a bucket has all pairs of its rare words; a pair of two rare words goes to
the first one's bucket to be counted, and to the second one's as one more word before it. A bucket answers with
the total of each pair of a block and with the counts of its rare words. The counts of frequent words, and of words and pairs by
how often they come, are summed over buckets and go to every task: a row per frequent word and one per language.

Results for odd input: texts without a word are scored by their end alone, and in a language without
any word not at all; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import texts
from .contexts import packed, unpacked
from .scratch import Scratch

#: Symbols: what stands before a text and after it, a rare word of another bucket; frequent words follow, then rare ones.
START, END, FAR, FIRST = 0, 1, 2, 3
#: Share of all tokens from which a word has a number, and how often a block must have it to name it.
FREQUENT, NAMED = 2.0**-20, 4
#: A block ends at so many words; so many of all words are dealt to a bucket, and buckets are so many bits at least.
BLOCK_WORDS, BUCKET_WORDS, LEAST_BITS = 5 << 20, 1 << 21, 7
#: Buckets, and then blocks, are gone through in so many rounds, as what is dealt in one lies on disk until its end.
ROUNDS = 2
LOW = (1 << 32) - 1
DEALT = 0x9E3779B97F4A7C15

Known = dict[str, tuple[np.ndarray, np.ndarray]]
NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64)

BLOCK = {"block": pa.int64(), "key": pa.string(), "size": pa.int64(), "ids": pa.list_(pa.int64()), "counts": pa.binary(), "words": pa.binary(), "line": pa.binary()}
PIECE = {"block": pa.int64(), "key": pa.string(), "bucket": pa.int32(), **{c: pa.binary() for c in ("rare", "before", "word", "n", "far", "back_word", "back")}}
ANSWER = {"block": pa.int64(), "bucket": pa.int32(), "n": pa.binary(), "rare": pa.binary(), "key": pa.string(), "of_all": pa.list_(pa.int64()), "word": pa.binary(), "sums": pa.binary()}
BLOCKS = "block long, key string, size long, ids array<long>, counts binary, words binary, line binary"
PIECES = "block long, key string, bucket int, rare binary, before binary, word binary, n binary, far binary, back_word binary, back binary"
ANSWERS = "block long, bucket int, n binary, rare binary, key string, of_all array<long>, word binary, sums binary"
#: Counts of a word: what follows it in all, its successors with counts of 1, 2, 3 or more, different words before it.
#: Of a language: pairs with counts of 1 to 4; words with 1, 2, 3, 4, 3 or more different words before, the sum of these, words.
OF_WORD, OF_LANGUAGE = 5, 11
MEANS = ["log_perplexity", "error", "log_single", "error_single"]


def discounts(n: list[int]) -> np.ndarray:
    """What counts of 1, 2 and 3 or more lose, from the numbers of keys with counts of 1 to 4. Where one of
    them is missing the estimate is undefined: a half of the count, at most 1.5, is used."""
    if not all(n):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0.0, [0.0, 1.0, 2.0, 3.0])


def means(logs: np.ndarray, text: np.ndarray, texts_: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of -logs of each text, and its standard error."""
    n = np.bincount(text, minlength=texts_)
    mean = -np.bincount(text, weights=logs, minlength=texts_) / n
    spread = np.bincount(text, weights=(logs + mean[text]) ** 2, minlength=texts_)
    return mean, np.sqrt(spread) / n


def rows_of(kinds: dict[str, pa.DataType], **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in kinds.items()], list(kinds))


def steps(hashes: np.ndarray) -> bytes:
    return packed(np.diff(hashes, prepend=np.uint64(0)).view(np.int64))


def hashes_of(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).view(np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame, coded: Callable) -> DataFrame:
    """A row per block, from what ``coded`` gives of the batches: language key, ids, counts (the first the number of
    words) and hashes of the words of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for key in list(held):
                ids, counts, hashes = zip(*held.pop(key))
                words, place, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                order = np.lexsort((words, -n))
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                line, own = packed(rank[place]), np.concatenate(counts, axis=1)
                yield rows_of(
                    BLOCK, block=[uuid.uuid4().int >> 65], key=[key], size=[int(own[0].sum()) + own.shape[1]], ids=[pa.concat_arrays(ids).to_pylist()],
                    counts=[packed(own.reshape(-1))], words=[steps(words[order])], line=[line],
                )

        for key, ids, counts, hashes in coded(batches):
            held.setdefault(key, []).append((ids, counts, hashes))
            size += len(hashes) + len(ids)
            if size >= BLOCK_WORDS:
                yield from out()
                size = 0
        yield from out()
        texts.release()

    return docs.mapInArrow(run, BLOCKS)


def frequent(parts: DataFrame, least: float) -> Known:
    """Hashes of the frequent words of each language, in order, and the numbers of these, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                n = np.bincount(unpacked(row["line"]))
                n = n[n >= NAMED]  # the most frequent come first
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(n)), pa.array(hashes_of(row["words"])[: len(n)].view(np.int64)), pa.array(n)], ["key", "word", "n"])

    rows = parts.select("key", "words", "line").mapInArrow(run, "key string, word long, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))
    found = rows.where(F.col("n") >= least).toArrow()
    keys, word, n = found.column("key").combine_chunks().dictionary_encode(), found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    code = keys.indices.to_numpy(zero_copy_only=False)
    out = {}
    for k, key in enumerate(keys.dictionary.to_pylist()):
        own = np.flatnonzero(code == k)
        own = own[np.argsort(word[own])]
        number = np.empty(len(own), np.int64)
        number[np.argsort(-n[own], kind="stable")] = np.arange(len(own))
        out[key] = word[own], number
    return out


def base_of(key: str, known: Known) -> int:
    """The first symbol of a language that no frequent word has."""
    return FIRST + len(known.get(key, NONE)[0])


def marks(hashes: np.ndarray, key: str, known: Known, bits: int) -> np.ndarray:
    """Symbols of frequent words; of rare ones, the first symbol that no frequent word has, and their bucket on top."""
    words, number = known.get(key, NONE)
    out = (hashes >> np.uint64(64 - bits)).astype(np.int64) + FIRST + len(words)
    if len(words):
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        met = words[at] == hashes
        out[met] = number[at[met]] + FIRST
    return out


class Dealt:
    """Words and pairs of a block as symbols, and their order by bucket, from ``marks`` of its words and its texts."""

    def __init__(self, mark: np.ndarray, line: np.ndarray, sizes: np.ndarray, base: int, bits: int):
        rare = np.flatnonzero(mark >= base)
        bucket = mark[rare] - base
        order = np.argsort(bucket, kind="stable")
        #: Places of rare words, by bucket; the bucket of each; where a bucket begins.
        self.rare, self.bucket = rare[order], bucket[order]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=1 << bits))))
        symbol = mark.copy()
        symbol[self.rare] = base + np.arange(len(rare))
        first = np.cumsum(sizes + 2) - (sizes + 2)
        row = np.full(int(sizes.sum()) + 2 * len(sizes), END, dtype=np.int64)
        row[first] = START
        row[texts.ranges(first + 1, sizes)] = symbol[line]
        at = texts.ranges(first, sizes + 1)
        #: Pairs of the texts as one number each.
        self.pairs = row[at] << 32 | row[at + 1]
        self.base, self.bits = base, bits

    def by_bucket(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of distinct pairs by bucket, and where each bucket begins in it, with the end."""
        before, word = pairs >> 32, pairs & LOW
        bucket = (texts.mix(pairs.astype(np.uint64) * np.uint64(DEALT)) >> np.uint64(64 - self.bits)).astype(np.int64)
        for side in (word, before):
            own = side >= self.base
            bucket[own] = self.bucket[side[own] - self.base]
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=1 << self.bits))))


def pieces(parts: DataFrame, known: Known, bits: int, part: int = 0, of: int = 1) -> DataFrame:
    """What each block has in each bucket, one in ``of`` of these: its rare words, its distinct pairs with their counts, and rare words before
    rare words of the bucket."""

    def of_block(row: dict) -> Iterator[pa.RecordBatch]:
        base, words = base_of(row["key"], known), hashes_of(row["words"])
        sizes = unpacked(row["counts"])[: len(row["ids"])]
        own = Dealt(marks(words, row["key"], known, bits), unpacked(row["line"]), sizes, base, bits)
        pairs, n = np.unique(own.pairs, return_counts=True)
        rare = words[own.rare]
        order, begin = own.by_bucket(pairs)
        before, word, n = pairs[order] >> 32, pairs[order] & LOW, n[order]
        both = (before >= base) & (word >= base)
        back = np.flatnonzero(both)
        back = back[np.argsort(word[back], kind="stable")]
        back_begin = np.searchsorted(word[back], base + own.begin)
        columns: dict[str, list] = {c: [] for c in PIECE}
        for k in (np.flatnonzero(np.diff(begin)[part::of]) * of + part).tolist():
            at, low = slice(begin[k], begin[k + 1]), own.begin[k]
            a, b, far = before[at], word[at], both[at]
            back_at = back[back_begin[k] : back_begin[k + 1]]
            columns["bucket"].append(k)
            columns["rare"].append(steps(rare[low : own.begin[k + 1]]))
            columns["before"].append(packed(np.diff(np.where(a >= base, a - low, a), prepend=0)))
            columns["word"].append(packed(np.where(far, FAR, np.where(b >= base, b - low, b))))
            columns["n"].append(packed(n[at]))
            columns["far"].append(rare[b[far] - base].tobytes())
            columns["back_word"].append(packed(word[back_at] - base - low))
            columns["back"].append(rare[before[back_at] - base].tobytes())
        columns["block"], columns["key"] = ([row[c]] * len(columns["bucket"]) for c in ("block", "key"))
        yield rows_of(PIECE, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from of_block(batch.slice(k, 1).to_pylist()[0])
        texts.release()

    return parts.select("block", "key", "ids", "counts", "words", "line").mapInArrow(run, PIECES)


def answers(dealt: DataFrame, known: Known) -> DataFrame:
    """Per block and bucket: the total of each of its pairs and the counts of each of its rare words, in their order.
    Without a block: the counts of a language and of its frequent words, to be summed over buckets."""

    def of_language(key: str, rows: list[dict], out: dict[str, list]) -> None:
        base = base_of(key, known)
        rares, fars, backs = [hashes_of(r["rare"]) for r in rows], [np.frombuffer(r["far"], np.uint64) for r in rows], [np.frombuffer(r["back"], np.uint64) for r in rows]
        rare, far, back = (np.unique(np.concatenate(x)) for x in (rares, fars, backs))
        places, top = [np.searchsorted(rare, x) for x in rares], base + len(rare)
        pairs, preceded = [], []
        for r, place, own_far, own_back in zip(rows, places, fars, backs):
            a, b = np.cumsum(unpacked(r["before"])), unpacked(r["word"]).copy()
            elsewhere = b == FAR
            for side in (a, b):
                own = side >= base
                side[own] = base + place[side[own] - base]
            b[elsewhere] = top + np.searchsorted(far, own_far)
            pairs.append(a << 32 | b)
            preceded.append(place[unpacked(r["back_word"])] << 32 | np.searchsorted(back, own_back))
        pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unpacked(r["n"]) for r in rows]), minlength=len(pair)).astype(np.int64)
        before, word = pair >> 32, pair & LOW
        counts = np.zeros((OF_WORD, top), np.int64)
        counts[0] = np.bincount(before, weights=total, minlength=top)
        for k, has in ((1, total == 1), (2, total == 2), (3, total >= 3)):
            counts[k] = np.bincount(before[has], minlength=top)
        counts[4] = np.bincount(word, minlength=top)[:top]
        counts[4, base:] += np.bincount(np.unique(np.concatenate(preceded)) >> 32, minlength=len(rare))
        begin = 0
        for r, place, own in zip(rows, places, pairs):
            found = {"block": r["block"], "bucket": r["bucket"], "n": packed(total[at[begin : begin + len(own)]]), "rare": packed(counts[:, base + place].reshape(-1))}
            begin += len(own)
            for c in ANSWER:
                out[c].append(found.get(c))
        different = counts[4, base:]
        of_all = [*(int((total == k).sum()) for k in (1, 2, 3, 4)), *by_size(different), len(rare)]
        met = np.flatnonzero(counts[:, :base].any(axis=0))
        found = {"key": key, "of_all": of_all, "word": packed(np.diff(met, prepend=0)), "sums": packed(counts[:, met].reshape(-1))}
        for c in ANSWER:
            out[c].append(found.get(c))

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ANSWER}
        rows: dict[str, list[dict]] = {}
        for row in table.to_pylist():
            rows.setdefault(row["key"], []).append(row)
        for key, own in rows.items():
            of_language(key, own, out)
        return pa.Table.from_batches([rows_of(ANSWER, **out)])

    return dealt.groupBy("bucket").applyInArrow(run, ANSWERS)


def by_size(different: np.ndarray) -> list[int]:
    """How many numbers are 1, 2, 3, 4, and 3 or more, and the sum of all."""
    return [*(int((different == k).sum()) for k in (1, 2, 3, 4)), int((different >= 3).sum()), int(different.sum())]


class Language:
    """The counts of frequent words of a language, and what it takes to make probabilities of counts."""

    def __init__(self, base: int, word: np.ndarray, sums: np.ndarray, of_all: np.ndarray):
        self.counts = np.zeros((OF_WORD, base), np.int64)
        self.counts[:, word] = sums
        self.pair_lost = discounts(of_all[:4].tolist())
        size = of_all[4:10] + by_size(self.counts[4])
        self.word_lost = discounts(size[:4].tolist())
        self.words = int(of_all[10]) + base - FIRST
        self.total = max(int(size[5]), 1)
        # all that single words lose goes evenly to the words, the unknown one and the end
        self.even = float(self.word_lost[1:] @ size[[0, 1, 4]]) / (self.words + 2)

    def logs(self, pairs: np.ndarray, n: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each pair's second word after its first, and by itself."""
        counts = np.concatenate((self.counts, rare), axis=1)
        before, word = pairs >> 32, pairs & LOW
        different = counts[4]
        alone = ((np.maximum(different - self.word_lost[np.minimum(different, 3)], 0) + self.even) / self.total)[word]
        rest = self.pair_lost[1:] @ counts[1:4]
        after = (np.maximum(n - self.pair_lost[np.minimum(n, 3)], 0) + rest[before] * alone) / counts[0][before]
        return np.log10(np.maximum(after, 1e-30)), np.log10(np.maximum(alone, 1e-30))


def languages(answered: DataFrame, known: Known) -> dict[str, Language]:
    """The counts of all buckets, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, word, sums in zip(*(batch.column(c) for c in ("key", "word", "sums"))):
                if (key := key.as_py()) not in held:
                    held[key] = np.zeros((OF_WORD, base_of(key, known)), np.int64)
                held[key][:, np.cumsum(unpacked(word.as_py()))] += unpacked(sums.as_py()).reshape(OF_WORD, -1)
        for key, counts in held.items():
            met = np.flatnonzero(counts.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(met), pa.string()), pa.array(met), *map(pa.array, counts[:, met])], ["key", "word", *of_word])

    of_word, of_all = [f"s{k}" for k in range(OF_WORD)], [f"s{k}" for k in range(OF_LANGUAGE)]
    own = answered.where("key is not null")
    words = own.select("key", "word", "sums").mapInArrow(run, "key string, word long, " + ", ".join(f"{c} long" for c in of_word))
    words = words.groupBy("key", "word").agg(*[F.sum(c).alias(c) for c in of_word]).toArrow()
    whole = own.groupBy("key").agg(*[F.sum(F.get("of_all", F.lit(k))).alias(c) for k, c in enumerate(of_all)]).collect()
    keys = words.column("key").combine_chunks().dictionary_encode()
    code, word, sums = keys.indices.to_numpy(zero_copy_only=False), words.column("word").to_numpy(), np.stack([words.column(c).to_numpy() for c in of_word])
    order = np.argsort(code, kind="stable")
    cut = np.searchsorted(code[order], np.arange(len(keys.dictionary) + 1))
    at = {key: order[cut[k] : cut[k + 1]] for k, key in enumerate(keys.dictionary.to_pylist())}
    return {r.key: Language(base_of(r.key, known), word[at[r.key]], sums[:, at[r.key]], np.array(r[1:])) for r in whole}


def document_means(parts: DataFrame, answered: DataFrame, of: dict[str, Language], known: Known, bits: int, names: list[str]) -> DataFrame:
    """doc_id, language (null if it has no words), the counts as ``names`` and the mean logs of each text, from its block."""
    result = {"doc_id": pa.int64(), "language": pa.string(), **{c: pa.int64() for c in names}, **{c: pa.float64() for c in MEANS}}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                mark = marks(hashes_of(row.column("words")[0].as_py()), row.column("key")[0].as_py(), known, bits)
                yield row.set_column(row.schema.get_field_index("words"), "words", pa.array([packed(mark)], pa.binary()))

    def run(_: tuple, block: pa.Table, table: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        ids, key, counts = row["ids"], row["key"], unpacked(row["counts"]).reshape(len(names), -1)
        model = of[key]
        own = Dealt(unpacked(row["words"]), unpacked(row["line"]), counts[0], base_of(key, known), bits)
        pairs, at = np.unique(own.pairs, return_inverse=True)
        sent = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "n", "rare"))))
        n = np.empty(len(pairs), np.int64)
        n[own.by_bucket(pairs)[0]] = np.concatenate([unpacked(x) for _, x, _ in sent])
        pair, alone = model.logs(pairs, n, np.concatenate([unpacked(x).reshape(OF_WORD, -1) for *_, x in sent], axis=1))
        text = np.repeat(np.arange(len(ids)), counts[0] + 1)
        found = [*means(pair[at], text, len(ids)), *means(alone[at], text, len(ids))]
        none = np.full(len(ids), model.words == 0)
        columns = [pa.array(ids, pa.int64()), pa.array([key if model.words else None] * len(ids), pa.string()), *map(pa.array, counts), *[pa.array(m, mask=none) for m in found]]
        return pa.table(dict(zip(result, columns)))

    kinds = "block long, key string, ids array<long>, counts binary, words binary, line binary"
    whole = parts.select("block", "key", "ids", "counts", "words", "line").mapInArrow(marked, kinds).withColumnRenamed("block", "of_block")
    sent = answered.where("block is not null").select("block", "bucket", "n", "rare")
    schema = "doc_id long, language string, " + ", ".join(f"{c} long" for c in names) + ", " + ", ".join(f"{c} double" for c in MEANS)
    return whole.groupBy("of_block").cogroup(sent.groupBy("block")).applyInArrow(run, schema)


def measured(docs: DataFrame, tables: Scratch, coded: Callable, names: list[str]) -> DataFrame:
    """``document_means`` of all texts of ``docs``, which ``coded`` reads, under the models of their languages. The files of a
    shuffle go with the step that made them, as later steps read tables."""
    with tables.lean():
        parts = tables.keep(blocks(docs, coded), "blocks")
        total = parts.agg(F.sum("size")).first()[0] or 0
        bits = max(LEAST_BITS, int(np.ceil(np.log2(max(total, 1) / BUCKET_WORDS))))
        known = frequent(parts, FREQUENT * total)
        rounds = [tables.keep(answers(pieces(parts, known, bits, k, ROUNDS), known), f"answers{k}") for k in range(ROUNDS)]
        answered = functools.reduce(DataFrame.unionAll, rounds)
        of, turn = languages(answered, known), F.pmod("block", F.lit(ROUNDS))
        found = [tables.keep(document_means(parts.where(turn == k), answered.where(turn == k), of, known, bits, names), f"measured{k}") for k in range(ROUNDS)]
    tables.drop("blocks", *[f"answers{k}" for k in range(ROUNDS)])
    return functools.reduce(DataFrame.unionAll, found)
