"""Sum-of-squares packing of tokenised documents into sequences of a fixed number of tokens.

A document becomes its token ids and one closing id. Only documents longer than a sequence are cut,
into full pieces and a shorter last one. A piece is then placed where the sum of the squared counts
of open sequences per residual gap becomes smallest.

Spark tokenises in parallel and deals pieces to a number of packing tasks by a hash, so that each
task packs about ``per_task`` pieces; only (document, piece, length) reaches a packing task, never
text or ids. Full pieces are sequences of their own and are not dealt at all. What a packing task
costs is the last few sequences that it can't fill, so the loss is a few in ``per_task``.

Results for odd input: a null or empty text is the closing id alone; null ``doc_id`` and repeated
rows are packed like any other; an empty table gives no rows; columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import itertools
import os
import string
import sys
import types
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import scratch, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_IDS = PIECES + ", ids array<int>, row long"
#: Words that a worker remembers, over all its tasks, before it starts anew. Frequent words come again soon, and words
#: that occur once would fill any cache: a worker took 296 MB with 800,000 words and takes some 140 MB with these.
CACHED_WORDS = 200_000


class WordTokens:
    """Ids of whole texts. A tokenizer that splits at white space and drops it gives a text's ids as
    those of its words in order, so each word is encoded once while it stays in the cache.

    ``letters_first`` states that the tokenizer lower-cases, splits runs of letters from other
    characters and maps bytes to characters before its merges. Latin-1 letters with ASCII marks
    after them then go straight to its merges, all other words through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str, letters_first: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.direct = letters_first
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [x for x in range(256) if x not in shown]
        self.as_letters = [(chr(x), chr(256 + k)) for k, x in enumerate(hidden) if x >= 128]
        self.clear()

    @classmethod
    def of_worker(cls, tokenizer_file: str) -> "WordTokens":
        """The one that earlier tasks of this Python worker have left, if there is one. Code comes anew
        with each task, so what stays is kept in a module of the worker."""
        kept = sys.modules.setdefault("kept_by_worker", types.ModuleType("kept_by_worker")).__dict__
        old = kept.get(tokenizer_file)
        new = kept[tokenizer_file] = cls.__new__(cls)
        if old is None:
            new.__init__(tokenizer_file)
        else:
            new.__dict__.update(old.__dict__)
        return new

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.first, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn_stems(self, stems: set[str]) -> None:
        fresh = list(stems.difference(self.stems))
        if not fresh:
            return
        joined = "\n".join(fresh).encode().decode("latin-1")
        for byte, letter in self.as_letters:
            joined = joined.replace(byte, letter)
        merge = self.tokenizer.model.tokenize
        self.stems.update(zip(fresh, (array("I", [t.id for t in merge(w)]).tobytes() for w in joined.split("\n"))))

    def learn(self, words: list[bytes]) -> None:
        parts: list[tuple[str, str] | None] = []
        for raw in words:
            word = raw.decode()
            stem = word.rstrip(string.punctuation)
            if self.direct and stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
                parts.append((stem.lower(), word[len(stem) :]))
            else:
                parts.append(None)
        self.learn_stems({p[0] for p in parts if p})
        rest = [w.decode() for w, p in zip(words, parts) if not p]
        marks = list({p[1] for p in parts if p}.difference(self.marks))
        encoded = self.tokenizer.encode_batch_fast(rest + marks, add_special_tokens=False)
        coded = [array("I", e.ids).tobytes() for e in encoded]
        self.marks.update(zip(marks, coded[len(rest) :]))
        whole = iter(coded)
        stems, ends = self.stems, self.marks
        found = [stems[p[0]] + ends[p[1]] if p else next(whole) for p in parts]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(found), np.uint32)))

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's number of ids."""
        if len(self.number) > CACHED_WORDS:
            self.clear()
        split = [t.split() for t in batch]
        words = np.array(list(map(self.number.__getitem__, itertools.chain.from_iterable(split))), dtype=np.int64)
        if new := len(self.number) - len(self.sizes):
            self.learn(list(itertools.islice(reversed(self.number), new))[::-1])
        sizes = self.sizes[words]
        ids = self.flat[texts.ranges(self.first[words], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(ends[np.cumsum([0, *map(len, split)])])


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, closing_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and if wanted the ids and a number
    ``row`` of its own (documents may repeat, so doc_id and piece are no key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokens.of_worker(tokenizer_file)
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in texts.slices(whole):
                raw = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
                ids, sizes = coder.encode(raw)
                out: list[list] = [[] for _ in names]
                at = 0
                for doc, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist()):
                    own = np.append(ids[at : at + size], np.uint32(closing_id)).astype("<u4")
                    at += size
                    for k, start in enumerate(range(0, size + 1, capacity)):
                        part = own[start : start + capacity]
                        for column, value in zip(out, (doc, k, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32), row)):
                            column.append(value)
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "row"][: 7 if with_ids else 5]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()]
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, PIECES_IDS if with_ids else PIECES)


class Bins:
    """Open sequences by gap, and the choice of one by the sum of squares."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset for a piece. Placing into gap g changes the sum of squares by
        2 (count[g - size] - count[g] + 1), or by 1 - 2 count[g] if it fills the sequence, which then
        is no longer open. A new sequence is opened only if the piece fits into no open one."""
        count, full = self.count, self.capacity
        there = count[size:full]
        change = np.where(there > 0, 2 * (count[: full - size] - there) + 2, np.iinfo(np.int64).max)
        if size < full and there[0]:
            change[0] = 1 - 2 * there[0]
        best = int(change.argmin()) if size < full else 0
        if size < full and there[best]:
            gap = best + size
            bin_ = self.open[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_ = full, self.used
            self.used += 1
        left = gap - size
        if left:
            self.open[left].append(bin_)
            count[left] += 1
        return bin_, full - gap


def pack(found: DataFrame, capacity: int = 2048, per_task: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``, which should be a written table: it is read twice.

    Full pieces are sequences by themselves, with negative numbers. The others are dealt by a hash
    and placed in falling length, equal lengths in the order of (doc_id, piece, ids_crc32). Ids stay behind:
    pieces that carry them meet their places by their row numbers.
    """
    short = found.where(F.col("length") < capacity)
    tasks = max(1, -(-short.count() // per_task))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins = Bins(capacity)
        placed = np.array([bins.place(n) for n in rows.column("length").to_pylist()], dtype=np.int64).reshape(-1, 2)
        sequence = placed[:, 0] * tasks + rows.column("task").to_numpy()
        return rows.drop_columns(["task"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(placed[:, 1]))

    carried = "ids" in found.columns
    light = short.drop("ids", "start") if carried else short
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in light.schema) + ", sequence_id long, offset long"
    dealt = light.withColumn("task", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks)))
    full = found.where(F.col("length") == capacity)
    full = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    packed = dealt.groupBy("task").applyInArrow(run, schema)
    if carried:
        packed = short.join(packed.select("row", "sequence_id", "offset"), "row")
    return packed.unionByName(full).drop("row")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, closing_id: int = 0, with_ids: bool = False, per_task: int = 100_000) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and the offset of each."""
    tables = scratch.Scratch(docs.sparkSession, "packing")
    found = tables.keep(pieces(docs, tokenizer_file, capacity, closing_id, with_ids), "pieces")
    return pack(found, capacity, per_task)
