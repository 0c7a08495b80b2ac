"""Alignment of two tokenizers over the same bytes, by inverted bitmaps of linked id pairs.

Both tokenizers cut the bytes of a space and the text. Where tokens of both end, a group ends, and the two
tokens that end there are linked. A chunk of documents holds, for each pair of ids linked in it, the
documents as compressed bitmaps: plane k has the documents in which bit k of the number of links is set,
as 16-bit places where they are few and as a bit set where they are many. All planes OR-merged are the pair's
documents; bits counted plane by plane, times 2**k, are its links. Chunks have documents of their own, so
a pair's counts over the corpus are sums of such bit counts. The postings then carry each pair's count back
to the documents.

Spark tokenises in parallel. A chunk is one written row; what moves is one line per chunk and pair, first
its bit counts, then its corpus-wide count, and each chunk once. A chunk ends at ``CHUNK_DOCS`` documents or
``CHUNK_BYTES`` of text, so no group grows with the corpus or with the use of a pair.

Results for odd input: null or empty texts, and texts whose bytes a tokenizer does not give back, have no
tokens: zeros and an empty digest. Repeated rows and ids are documents of their own; ``doc_id`` may be null;
very long texts are whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import texts
from .scratch import Scratch

CHUNK_DOCS = 4096
CHUNK_BYTES = 8 << 20
DOCS = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>"
POSTINGS = "pair array<long>, documents array<int>, links array<long>, of array<int>, plane array<int>, bits array<binary>"
#: Characters on which regular-expression engines agree about letters, numbers and spaces.
PLAIN_TEXT = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧]*")


class Table:
    """Byte strings by number, gathered many at a time."""

    def __init__(self, values: list[bytes]):
        self.size = np.array(list(map(len, values)), dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(values), dtype=np.uint8)

    def gather(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[texts.ranges(self.first[ids], self.size[ids])]


class ByteTokens:
    """A byte-level BPE file of the tokenizers library. Texts of common characters go through a quicker
    merger that is built from the same vocabulary and gives the same ids; all others through the library."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
        with open(file, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        vocabulary = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        values = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            values[i] = bytes(map(byte.__getitem__, token))
        self.bytes = Table(values)
        ranks = {values[i]: i for i in vocabulary.values()}
        self.quick = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, whole: list[str]) -> list[list[int]]:
        out = [self.quick.encode_ordinary(t) if PLAIN_TEXT.fullmatch(t) else None for t in whole]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([whole[k] for k in rest], add_special_tokens=False)):
            out[k] = found.ids
        return out


class PieceTokens:
    """A sentencepiece model; it puts the space before the text itself."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        coded = re.compile("<0x([0-9A-F]{2})>")
        values = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            is_byte = coded.fullmatch(piece)
            values.append(bytes([int(is_byte[1], 16)]) if is_byte else piece.replace("▁", " ").encode())
        self.bytes = Table(values)

    def encode(self, whole: list[str]) -> list[list[int]]:
        return self.model.encode(whole, num_threads=1)


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Aligned:
    """Tokens, groups and links of some documents with text."""

    def __init__(self, whole: list[str], one: ByteTokens, two: PieceTokens):
        raw = [b" " + t.encode() for t in whole]
        size = np.array(list(map(len, raw)), dtype=np.int64)
        found = [(t, t.encode(w)) for t, w in ((one, [" " + x for x in whole]), (two, whole))]
        n = [np.array(list(map(len, ids)), dtype=np.int64) for _, ids in found]
        flat = [np.array([i for own in ids for i in own], dtype=np.int64) for _, ids in found]
        good = np.ones(len(whole), dtype=bool)
        for (side, _), ids, count in zip(found, flat, n):
            good &= segment_sums(side.bytes.size[ids], count) == size
        target = np.frombuffer(b"".join(r for r, g in zip(raw, good) if g), dtype=np.uint8)
        for (side, _), ids, count in zip(found, flat, n):
            differs = side.bytes.gather(ids[np.repeat(good, count)]) != target
            good[np.flatnonzero(good)[segment_sums(differs, size[good]) > 0]] = False
        self.good = good
        self.n = [np.where(good, count, 0) for count in n]
        self.ids = [ids[np.repeat(good, count)] for ids, count in zip(flat, n)]
        ends = [np.cumsum(side.bytes.size[ids]) for (side, _), ids in zip(found, self.ids)]
        place = np.searchsorted(ends[1], ends[0])
        self.last = [ends[1][place] == ends[0], None] if len(place) else [np.zeros(0, bool)] * 2
        if len(place):
            self.last[1] = ends[0][np.searchsorted(ends[0], ends[1])] == ends[1]
        self.linked = self.ids[0][self.last[0]], self.ids[1][self.last[1]]
        self.document = np.repeat(np.arange(len(whole)), self.n[0])[self.last[0]]
        self.groups = np.bincount(self.document, minlength=len(whole))

    def texts(self, numbers: Table) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document; empty without tokens."""
        group = [np.cumsum(last) - last for last in self.last]
        total = int(self.groups.sum())
        upto = [np.concatenate(([0], np.cumsum(np.bincount(g, minlength=total)))) for g in group]
        order = [np.arange(len(g)) + upto[1 - side][g + (1 if side else 0)] for side, g in enumerate(group)]
        tokens = np.zeros(len(group[0]) + len(group[1]), dtype=np.int64)
        ends = np.full(len(tokens), ord(","), dtype=np.uint8)
        for side, mark in enumerate(b"|;"):
            tokens[order[side]] = self.ids[side]
            ends[order[side][self.last[side]]] = mark
        size = numbers.size[tokens] + 1
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), dtype=np.uint8)
        out[texts.ranges(start, size - 1)] = numbers.gather(tokens)
        out[start + size - 1] = ends
        data, at = out.tobytes(), np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(self.n[0] + self.n[1])))].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(at, at[1:])]


def planes(pair: np.ndarray, slot: np.ndarray, documents: int) -> dict[str, list]:
    """Postings of one chunk from its links (pair, document): see ``POSTINGS``."""
    both, times = np.unique(pair * CHUNK_DOCS + slot, return_counts=True)
    pairs, row, held = np.unique(both // CHUNK_DOCS, return_inverse=True, return_counts=True)
    slot = both % CHUNK_DOCS
    dense = 1 + -(-documents // 8)
    of, plane, bits = [], [], []
    for k in range(int(times.max()).bit_length() if len(times) else 0):
        there = (times >> k) & 1 == 1
        rows, first, n = np.unique(row[there], return_index=True, return_counts=True)
        places = slot[there].astype("<u2")
        for r, f, m in zip(rows.tolist(), first.tolist(), n.tolist()):
            own = places[f : f + m]
            if 1 + 2 * m <= dense:
                bits.append(b"\0" + own.tobytes())
            else:
                set_ = np.zeros(documents, dtype=bool)
                set_[own] = True
                bits.append(b"\1" + np.packbits(set_, bitorder="little").tobytes())
        of += rows.tolist()
        plane += [k] * len(rows)
    links = np.bincount(row, weights=times, minlength=len(pairs)).astype(np.int64)
    return {"pair": pairs.tolist(), "documents": held.tolist(), "links": links.tolist(), "of": of, "plane": plane, "bits": bits}


def members(bits: bytes) -> np.ndarray:
    """Places of the documents of a plane."""
    if bits[0]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8, offset=1), bitorder="little"))
    return np.frombuffer(bits, "<u2", offset=1).astype(np.int64)


def chunks(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """One row per chunk: its documents with their digests, and its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteTokens(byte_file), PieceTokens(piece_file)
        base = max(len(two.bytes.size), len(one.bytes.size))
        numbers = Table([b"%d" % k for k in range(base)])
        part, done = TaskContext.get().partitionId(), 0
        schema = pa.schema([("chunk", pa.int64()), *[(f, pa.list_(pa.string() if f == "groups_sha256" else pa.int64())) for f in kinds[:5]],
            *[(f, pa.list_({"documents": pa.int32(), "of": pa.int32(), "plane": pa.int32(), "bits": pa.binary()}.get(f, pa.int64()))) for f in kinds[5:]]])
        held: dict[str, list] = {f: [] for f in kinds[:5]}
        pairs: list[np.ndarray] = []
        slots: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal done, size
            joined = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, slots))
            row = {"chunk": (part << 32) + done, **held, **planes(*joined, len(held["doc_id"]))}
            out = pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)
            for lists in (*held.values(), pairs, slots):
                lists.clear()
            done, size = done + 1, 0
            return out

        for whole in batches:
            for batch in texts.slices(whole):
                for at in range(0, batch.num_rows, CHUNK_DOCS):
                    rows = batch.slice(at, CHUNK_DOCS)
                    if held["doc_id"] and (len(held["doc_id"]) + rows.num_rows > CHUNK_DOCS or size >= CHUNK_BYTES):
                        yield close()
                    values = rows.column("text").fill_null("").to_pylist()
                    with_text = [k for k, t in enumerate(values) if t]
                    found = Aligned([values[k] for k in with_text], one, two)
                    counts = np.zeros((3, rows.num_rows), dtype=np.int64)
                    counts[:, with_text] = [*found.n, found.groups]
                    digests = [""] * rows.num_rows
                    for k, good, text in zip(with_text, found.good.tolist(), found.texts(numbers)):
                        digests[k] = hashlib.sha256(text).hexdigest() if good else ""
                    pairs.append(found.linked[0] * base + found.linked[1])
                    slots.append(np.array(with_text, dtype=np.int64)[found.document] + len(held["doc_id"]))
                    for name, own in zip(kinds[:5], (rows.column("doc_id").to_pylist(), *counts.tolist(), digests)):
                        held[name] += own
                    size += sum(map(len, values))
        if held["doc_id"]:
            yield close()

    kinds = [f.split()[0] for f in f"{DOCS}, {POSTINGS}".split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"chunk long, {DOCS}, {POSTINGS}")


def pair_base(byte_file: str, piece_file: str) -> int:
    return max(len(ByteTokens(byte_file).bytes.size), len(PieceTokens(piece_file).bytes.size))


def pair_counts(written: DataFrame, base: int) -> DataFrame:
    """pair, a, b, documents, links and whether no other pair of the same b has more links."""
    lines = written.select(F.explode(F.arrays_zip("pair", "documents", "links")).alias("p")).select("p.*")
    found = lines.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    found = found.select("pair", (F.col("pair") / base).cast("long").alias("a"), (F.col("pair") % base).alias("b"), "documents", "links")
    highest = found.groupBy("b").agg(F.max("links").alias("highest"))
    return found.join(highest, "b").select("pair", "a", "b", "documents", "links", (F.col("links") == F.col("highest")).alias("best"))


def scored(written: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents of all chunks with n_best and count_sum, by their postings."""

    def run(key: tuple, own: pa.Table, counts: pa.Table) -> pa.Table:
        row = own.slice(0, 1).to_pydict()
        docs = {f: row[f][0] for f in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
        by_pair = np.argsort(counts.column("pair").to_numpy())  # the postings' own order
        score = np.stack([np.asarray(counts.column("links"))[by_pair], np.asarray(counts.column("best").cast(pa.int64()))[by_pair]]) if counts.num_rows else np.zeros((2, 0), np.int64)
        total = np.zeros((2, len(docs["doc_id"])), dtype=np.int64)
        places = [members(b) for b in row["bits"][0]]
        if places:
            sizes = list(map(len, places))
            at = np.concatenate(places)
            of, times = np.repeat(row["of"][0], sizes), np.left_shift(1, np.repeat(row["plane"][0], sizes))
            np.add.at(total[0], at, score[0][of] * times)
            np.add.at(total[1], at, score[1][of] * times)
        arrays = [pa.array(v) for v in (docs["n_groups"], total[1], total[0])]
        return pa.table([pa.array(docs["doc_id"], pa.int64()), pa.array(docs["n_a"]), pa.array(docs["n_b"]), arrays[0], *arrays, pa.array(docs["groups_sha256"], pa.string())], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    wanted = written.select(F.col("chunk").alias("in_chunk"), F.explode("pair").alias("pair")).join(counts.select("pair", "links", "best"), "pair")
    own = written.drop("pair", "documents", "links").groupBy("chunk")
    schema = ", ".join(f"{f} {'string' if f == 'groups_sha256' else 'long'}" for f in names)
    return own.cogroup(wanted.groupBy("in_chunk")).applyInArrow(run, schema)


def align(docs: DataFrame, byte_file: str, piece_file: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) with their groups, links and scores, and the table of linked pairs."""
    tables = Scratch(docs.sparkSession, "alignment")
    written = tables.keep(chunks(docs, byte_file, piece_file), "chunks")
    counts = tables.keep(pair_counts(written, pair_base(byte_file, piece_file)), "pairs")
    return scored(written, counts), counts
