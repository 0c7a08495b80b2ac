"""Removal of word passages that an earlier document has, by windows of doubling length.

A window is ``length`` consecutive words of one document. A word goes if a window covers it whose
words also start somewhere in a document with a smaller ``doc_id``; windows are judged on the input.

* Documents with the same words are one class: only the first takes part, the others are covered
  wholly. So groups of copies send nothing.
* First level, windows of ``length / 2``: of the half windows inside each window only the one with
  the smallest hash is looked at. Equal windows choose equal half windows, so a window that occurs
  twice has a half window that occurs twice, while about one in thirteen half windows is moved.
* Second level, the full length: only windows whose half window is repeated are extended, hashed
  (128 bits) and held against the smallest ``doc_id`` that has them.
* ``repeat_levels`` goes on doubling until no window survives, for a report of how long repeats are.

Minimum and maximum per hash combine before they move, and rows come back by a join, so a passage
that a third of all documents share does not meet in one task.

Results for odd input: null or empty texts have no words; documents shorter than ``length`` keep
all; rows with a null ``doc_id`` keep all and remove nothing; rows that share a ``doc_id`` do not
remove from each other; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import texts
from .scratch import Scratch

#: A list of ids is sent to all executors up to this many (32 MB); beyond it, tables are joined by a shuffle.
SENT_IDS = 4_000_000
TAG_BITS, PLACE_BITS = 22, 40


def tag_of(f1):
    """Short name of a row among rows with one doc_id, from the hash of its words."""
    return f1.bitwiseAND(F.lit((1 << TAG_BITS) - 1))


def least_half(half: np.ndarray, count: int, length: int, step: int) -> np.ndarray:
    """Start of the smallest half window inside each of ``count`` windows (the leftmost of equals)."""
    spread = length - step + 1
    best = np.arange(count)
    low = half[:count].copy()
    for k in range(1, spread):
        other = half[k : k + count]
        better = other < low
        low[better] = other[better]
        best[better] = np.flatnonzero(better) + k
    return best


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def profiles(docs: DataFrame, length: int, with_sha: bool = True) -> DataFrame:
    """doc_id, n_words, hash of all words (f1, f2), sha256 of the words, chosen half windows."""
    step = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole):
                column = batch.column("text")
                words = texts.Words(column, lower=False)
                hashes, other = words.hashes(0), words.hashes(1)
                counts = words.counts()
                half = texts.run_hashes(hashes, step)
                f1, f2, chosen = [], [], []
                for a, n in zip(words.first[:-1].tolist(), counts.tolist()):
                    f1.append(texts.fold_hash(hashes[a : a + n]) if n else np.uint64(0))
                    f2.append(texts.run_hashes(other[a : a + n], n, 1)[0] if n else np.uint64(0))
                    windows = n - length + 1
                    if windows > 0:
                        at = np.unique(least_half(half[a : a + n - step + 1], windows, length, step))
                        chosen.append(np.unique(half[a + at]).view(np.int64))
                    else:
                        chosen.append(np.zeros(0, np.int64))
                sha = [hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in column.cast(pa.binary()).to_pylist()] if with_sha else [None] * len(f1)
                ends = np.cumsum([0, *map(len, chosen)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)),
                        pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*chosen, np.zeros(0, np.int64)]))),
                    ],
                    ["doc_id", "n_words", "f1", "f2", "sha256", "halves"],
                )

    return plain(docs).mapInArrow(run, "doc_id long, n_words long, f1 long, f2 long, sha256 string, halves array<long>")


def windows_of(candidates: DataFrame, length: int) -> DataFrame:
    """Hash, doc_id and place of the windows of ``candidates`` (doc_id, text, tag, halves) whose chosen
    half window is among ``halves``. The place is the start, with the tag in its upper bits."""
    step = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole):
                words = texts.Words(batch.column("text"), lower=False)
                hashes, other = words.hashes(0), words.hashes(1)
                half = texts.run_hashes(hashes, step)
                h1, h2 = texts.run_hashes(hashes, length), texts.run_hashes(other, length, 1)
                at, docs_, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                tags, ids = batch.column("tag").to_pylist(), batch.column("doc_id").to_pylist()
                wanted = batch.column("halves")
                for k, (a, n) in enumerate(zip(words.first[:-1].tolist(), words.counts().tolist())):
                    count = n - length + 1
                    if count <= 0 or int(texts.fold_hash(hashes[a : a + n])) & ((1 << TAG_BITS) - 1) != tags[k]:
                        continue
                    chosen = half[a + least_half(half[a : a + n - step + 1], count, length, step)]
                    start = np.flatnonzero(np.isin(chosen.view(np.int64), wanted[k].values.to_numpy()))
                    at.append(a + start)
                    docs_.append(np.full(len(start), ids[k], np.int64))
                    places.append(start + (tags[k] << PLACE_BITS))
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(np.concatenate(docs_)), pa.array(np.concatenate(places))],
                    ["h1", "h2", "doc_id", "place"],
                )

    return candidates.mapInArrow(run, "h1 long, h2 long, doc_id long, place long")


def of_ids(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``."""
    ids = ids.select("doc_id").distinct()
    return docs.join(F.broadcast(ids) if count <= SENT_IDS else ids, "doc_id", "left_semi")


class Repeats:
    """The tables that lead from texts to the starts of repeated windows."""

    def __init__(self, docs: DataFrame, length: int, with_sha: bool = True):
        if length < 2 or length % 2:
            raise ValueError("length must be even")
        self.length = length
        self.docs = plain(docs)
        self.tables = tables = Scratch(docs.sparkSession, "substrings")
        self.profile = tables.keep(profiles(self.docs, length, with_sha), "profile")
        named = self.profile.where("doc_id is not null and n_words > 0")
        self.classes = named.groupBy("f1", "f2", "n_words").agg(F.min("doc_id").alias("first"))
        long_ = named.where(F.size("halves") > 0)
        own = long_.join(self.classes, ["f1", "f2", "n_words"]).where("doc_id = first")
        chosen = own.select("doc_id", tag_of(F.col("f1")).alias("tag"), F.explode("halves").alias("half"))
        chosen = tables.keep(chosen, "halves")
        again = chosen.groupBy("half").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("half")
        found = chosen.join(again, "half").groupBy("doc_id", "tag").agg(F.collect_set("half").alias("halves"))
        self.candidates = tables.keep(found, "candidates")
        tables.drop("halves")

    def windows(self) -> DataFrame:
        """Windows of the full length that may be repeated, written."""
        count = self.candidates.count()
        chosen = of_ids(self.docs, self.candidates, count).join(self.candidates, "doc_id")
        return self.tables.keep(windows_of(chosen.select("doc_id", "text", "tag", "halves"), self.length), "windows")

    def removed(self) -> DataFrame:
        """doc_id, tag and the starts of windows that a smaller doc_id has."""
        windows = self.windows()
        first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        hit = windows.join(first.select("h1", "h2", "lo"), ["h1", "h2"]).where("lo < doc_id")
        hit = hit.select("doc_id", F.shiftright("place", PLACE_BITS).alias("tag"), F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("start"))
        starts = self.tables.keep(hit.groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts")), "starts")
        self.tables.drop("windows", "candidates")
        return starts


def cut(rows: DataFrame, length: int) -> DataFrame:
    """Kept text of ``rows`` (doc_id, text, tag, starts): doc_id, tag, n_removed, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole):
                words = texts.Words(batch.column("text"), lower=False)
                hashes = words.hashes(0)
                out: list[list] = [[], [], [], []]
                starts = batch.column("starts")
                for k, (raw, doc, tag) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist())):
                    a, n = int(words.first[k]), int(words.first[k + 1] - words.first[k])
                    if not n or int(texts.fold_hash(hashes[a : a + n])) & ((1 << TAG_BITS) - 1) != tag:
                        continue
                    change = np.zeros(n + 1, dtype=np.int64)
                    at = starts[k].values.to_numpy()
                    np.add.at(change, at, 1)
                    np.add.at(change, at + length, -1)
                    gone = np.cumsum(change)[:n] > 0
                    split = raw.split()
                    for column, value in zip(out, (doc, tag, int(gone.sum()), b" ".join(split[i] for i in np.flatnonzero(~gone)).decode())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "tag", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, tag long, n_removed long, kept string")


def deduplicated(docs: DataFrame, length: int = 50, with_sha: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, tag, sha256 (of all words), n_removed, kept (null if nothing was removed)."""
    found = Repeats(docs, length, with_sha)
    starts = found.removed()
    cut_rows = of_ids(found.docs, starts, starts.count()).join(starts, "doc_id")
    changed = found.tables.keep(cut(cut_rows.select("doc_id", "text", "tag", "starts"), length).dropDuplicates(["doc_id", "tag"]), "changed")
    rows = found.profile.drop("halves").withColumn("tag", tag_of(F.col("f1")))
    rows = rows.join(found.classes.withColumnRenamed("first", "first_id"), ["f1", "f2", "n_words"], "left")
    rows = rows.join(changed, ["doc_id", "tag"], "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= length)
    return rows.select(
        "doc_id", "n_words", "tag", "sha256",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept words joined by one space."""
    kept = F.when(F.col("kept").isNull(), F.col("sha256")).otherwise(F.sha2(F.col("kept"), 256))
    return deduplicated(docs, length).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def clean(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; unchanged texts stay as they are.

    Of rows with one doc_id and one text all are treated alike."""
    words = deduplicated(docs, length, with_sha=False).where("n_removed > 0").select("doc_id", "tag", "kept").distinct()
    tagged = tagged_rows(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")))
    joined = tagged.join(words.withColumnRenamed("doc_id", "id"), ["id", "tag"], "left")
    return joined.select([F.coalesce("kept", "row.text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def tagged_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (row, id, text) as row, id and tag, that of the words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole):
                words = texts.Words(batch.column("text"), lower=False)
                hashes = words.hashes(0)
                tag = [int(texts.fold_hash(hashes[a:b])) & ((1 << TAG_BITS) - 1) if b > a else 0 for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(tag, pa.int64())], ["row", "id", "tag"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, id long, tag long")


def repeat_levels(docs: DataFrame, start: int = 50) -> DataFrame:
    """How many windows of each length start, start * 2, ... occur in several documents: length, n_windows.

    A window of twice the length is looked at only if both its halves are repeated; levels end when
    none survives. Documents that are copies count once."""
    found = Repeats(docs, start, with_sha=False)
    windows, length, counts = found.windows(), start, []
    while True:
        again = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2")
        level = found.tables.keep(windows.join(again, ["h1", "h2"]), f"level-{length}")
        if not (n := level.count()):
            break
        counts.append((length, n))
        left, right = level.alias("left"), level.alias("right")
        both = left.join(right, (F.col("left.doc_id") == F.col("right.doc_id")) & (F.col("left.place") + length == F.col("right.place")))
        windows = both.select(
            F.xxhash64("left.h1", "right.h1").alias("h1"), F.xxhash64("left.h2", "right.h2", F.lit(1)).alias("h2"), F.col("left.doc_id").alias("doc_id"), F.col("left.place").alias("place")
        )
        length *= 2
    return docs.sparkSession.createDataFrame(counts, "length int, n_windows long")
