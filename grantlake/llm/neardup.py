"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

A document's set holds its distinct runs of ``shingle`` words (lower-cased A-Z); a document with
fewer words has one run, all of them. Documents are linked if their sets reach ``percent`` in
100 * intersection >= percent * union; groups are the connected components of all links.

* Documents with equal sets are one class from the start, so groups of copies never meet as pairs.
* A class has ``SAMPLES`` MinHash samples. ``BANDS`` bands of ``ROWS`` samples give bucket keys: a pair
  at a similarity of 0.8 shares none with a probability below 1e-7.
* The samples are folded into an odd sketch: each sample flips one bit of a bitmap. The number of
  bits in which two bitmaps differ estimates the similarity; candidates ``MARGIN`` (over five
  standard deviations) below the threshold go no further, all others are confirmed on full sets.
* A bucket is never expanded into all pairs. In a few rounds each member is held against one
  centre of the bucket, a new centre every round, and links merge groups. What then still lies in
  different groups of one bucket is compared in full, with three tests inside the join: that of the
  sketches, that of sketches four times as long (made for these members alone, with half the
  margin), and an exact one. Shingles that no other member of an open bucket has can't be common,
  so a document with many of them can't reach the threshold with a document of a given size. So no
  link between groups is lost, and members of one group are not compared again.

Results for odd input: documents without words or text have an empty set and are linked with
nothing; rows with a null ``doc_id`` have no component and are kept; rows that share a ``doc_id``
are one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import texts
from .components import components
from .scratch import Scratch

BANDS, ROWS = 32, 4
SAMPLES = 256
SKETCH_LONGS = 16
MARGIN = 0.13
#: Sketches of members whose buckets stay open: four times the samples and bits, half the margin.
LONG_SAMPLES, LONG_LONGS, LONG_MARGIN = 1024, 64, 0.065
LONG_ROWS = 1000
ROUNDS = 3
#: A list of ids is sent to all executors up to this many (32 MB); beyond it, tables are joined by a shuffle.
SENT_IDS = 4_000_000

_rng = np.random.default_rng(4)
_FACTORS = _rng.integers(0, 2**31, size=SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 2**32, size=SAMPLES, dtype=np.uint32)
_LONG_FACTORS = _rng.integers(0, 2**31, size=LONG_SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LONG_SHIFTS = _rng.integers(0, 2**32, size=LONG_SAMPLES, dtype=np.uint32)


def shingle_sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingle hashes, text by text in rising order, and each text's number of them."""
    words = texts.Words(batch.column("text"), lower=True)
    hashes = words.hashes()
    counts = words.counts()
    runs = texts.run_hashes(hashes, size)
    many = np.maximum(counts - size + 1, 0)
    value = runs[texts.ranges(words.first[:-1], many)] if len(runs) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(words.texts), many)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        whole = np.array([texts.fold_hash(hashes[words.first[t] : words.first[t + 1]]) for t in few], dtype=np.uint64)
        value, owner = np.concatenate((value, whole)), np.concatenate((owner, few))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])) if len(value) else np.zeros(0, bool)
    value, owner = value[fresh], owner[fresh]
    return value, np.bincount(owner, minlength=words.texts)


def samples(value: np.ndarray, counts: np.ndarray, factors: np.ndarray = _FACTORS, shifts: np.ndarray = _SHIFTS) -> np.ndarray:
    """MinHash samples of each non-empty set, as a row each."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    short = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), len(factors)), dtype=np.uint32)
    for k in range(len(factors) if len(starts) else 0):
        out[:, k] = np.minimum.reduceat(short * factors[k] + shifts[k], starts)
    return out


def sketches(sample: np.ndarray, longs: int = SKETCH_LONGS) -> np.ndarray:
    """Odd sketches: bit h(k, sample k) of the bitmap is flipped for every k."""
    n = sample.shape[1]
    bits = texts.mix(sample.astype(np.uint64) + (np.arange(n, dtype=np.uint64) << np.uint64(32))) % np.uint64(64 * longs)
    out = np.zeros((len(sample), longs), dtype=np.uint64)
    rows = np.arange(len(sample))
    for k in range(n):
        out[rows, bits[:, k] >> np.uint64(6)] ^= np.uint64(1) << (bits[:, k] & np.uint64(63))
    return out


def long_sketches(sets: DataFrame) -> DataFrame:
    """node and the longer sketch of each of ``sets`` (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, LONG_ROWS):
                batch = whole.slice(at, LONG_ROWS)
                shingles = batch.column("shingles")
                value = shingles.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                counts = pa.compute.list_value_length(shingles).to_numpy(zero_copy_only=False).astype(np.int64)
                sketch = sketches(samples(value, counts, _LONG_FACTORS, _LONG_SHIFTS), LONG_LONGS)
                yield pa.RecordBatch.from_arrays([batch.column("node"), lists(sketch)], ["node", "long_sketch"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, long_sketch array<long>")


def bands(sample: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sample), BANDS), dtype=np.uint64)
    for k in range(ROWS):
        keys = texts.mix(keys * np.uint64(31) + sample[:, k : BANDS * ROWS : ROWS].astype(np.uint64) + np.uint64(k + 1))
    return texts.mix(keys + np.arange(BANDS, dtype=np.uint64))


def lists(values: np.ndarray) -> pa.Array:
    """A matrix as an Arrow array of lists of longs."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).view(np.int64)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (f1, f2), band keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole):
                value, counts = shingle_sets(batch, size)
                has = counts > 0
                starts = (np.cumsum(counts) - counts)[has]
                f1, f2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
                if len(starts):
                    f1[has] = np.add.reduceat(value, starts)
                    f2[has] = np.add.reduceat(texts.mix(value ^ np.uint64(0x5851F42D4C957F2D)), starts)
                sample = samples(value, counts)
                key, sketch = np.zeros((len(counts), BANDS), np.uint64), np.zeros((len(counts), SKETCH_LONGS), np.uint64)
                key[has], sketch[has] = bands(sample), sketches(sample)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists(key), lists(sketch)],
                    ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"],
                )

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, f1 and the full set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole):
                value, counts = shingle_sets(batch, size)
                ends = np.concatenate(([0], np.cumsum(counts)))
                f1 = np.array([int(value[a:b].sum(dtype=np.uint64)) for a, b in zip(ends[:-1], ends[1:])], dtype=np.uint64)
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(f1.view(np.int64)), sets], ["doc_id", "f1", "shingles"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, f1 long, shingles array<long>")


def estimate(a: str, b: str, longs: int = SKETCH_LONGS, n_samples: int = SAMPLES):
    """Similarity of two sets from their odd sketches."""
    bits = 64 * longs
    differ = sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(longs)), F.lit(0))
    left = F.greatest(1 - 2 * differ / F.lit(float(bits)), F.lit(1e-6))
    return 1 + F.lit(bits / (4.0 * n_samples)) * F.log(left)


class Linker:
    """Holds candidate pairs of classes against the threshold."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int):
        self.classes, self.sets, self.percent = classes.select("node", "sketch"), sets, percent

    def close(self, a: str = "sketch_a", b: str = "sketch_b"):
        return estimate(a, b) >= self.percent / 100 - MARGIN

    def closer(self, a: str = "long_sketch_a", b: str = "long_sketch_b"):
        return estimate(a, b, LONG_LONGS, LONG_SAMPLES) >= self.percent / 100 - LONG_MARGIN

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of ``pairs`` (a, b)."""
        left = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
        right = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - both
        return pairs.join(left, "a").join(right, "b").where(100 * both >= self.percent * union).select("a", "b")

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose sketches are close."""
        left = self.classes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
        right = self.classes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
        return pairs.join(left, "a").join(right, "b").where(self.close()).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    tables = Scratch(docs.sparkSession, "neardup")
    signed = tables.keep(signatures(docs, shingle), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    members = filled.groupBy("f1", "f2", "n_shingles").agg(
        F.min("doc_id").alias("node"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("own")
    )
    classes = tables.keep(members.select("f1", "f2", "node", "own.bands", "own.sketch"), "classes")

    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = tables.keep(keyed.join(shared, "key").distinct(), "buckets")
    wanted = tables.keep(buckets.select("node").distinct().join(classes.select("node", "f1", "sketch"), "node"), "wanted")

    ids = wanted.select(F.col("node").alias("doc_id")).distinct()
    if wanted.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    sets = full_sets(docs.join(ids, "doc_id", "left_semi"), shingle)
    sets = sets.join(wanted.select(F.col("node").alias("doc_id"), "f1"), ["doc_id", "f1"]).dropDuplicates(["doc_id", "f1"])
    sets = tables.keep(sets.select(F.col("doc_id").alias("node"), "shingles"), "sets")
    linker = Linker(wanted, sets, percent)

    links = same_document(signed, classes)
    group = None
    for number in range(ROUNDS + 1):
        placed = grouped(buckets, group)
        if number:
            open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
            placed = tables.keep(placed.join(open_, "key"), f"open-{number}")
            if placed.isEmpty():
                break
        pairs = last_pairs(placed, wanted, sets, linker, tables) if number == ROUNDS else linker.candidates(star_pairs(placed, number))
        found = tables.keep(linker.confirm(pairs), f"links-{number}")
        if number == ROUNDS and found.isEmpty():
            break
        links = links.unionByName(found)
        group = tables.keep(components(links, tables, f"components-{number}"), f"groups-{number}")
        tables.drop(f"open-{number}")

    named = filled.select("doc_id", "n_shingles", "f1", "f2").join(classes.select("f1", "f2", "node"), ["f1", "f2"])
    if group is not None:
        named = named.join(group.select(F.col("id").alias("node"), "component"), "node", "left")
    else:
        named = named.withColumn("component", F.lit(None).cast("long"))
    found = named.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    rest = signed.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes of rows that share a doc_id."""
    filled = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "f1", "f2")
    several = filled.groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo < hi").select("doc_id")
    rows = filled.join(several, "doc_id").join(classes.select("f1", "f2", "node"), ["f1", "f2"])
    return rows.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def grouped(buckets: DataFrame, group: DataFrame | None) -> DataFrame:
    if group is None:
        return buckets.withColumn("component", F.col("node"))
    joined = buckets.join(group.select(F.col("id").alias("node"), "component"), "node", "left")
    return joined.withColumn("component", F.coalesce("component", "node"))


def star_pairs(placed: DataFrame, number: int) -> DataFrame:
    """Each member of a bucket with one centre of it, if they lie in different groups."""
    order = F.col("node") if number == 0 else F.xxhash64("node", F.lit(number))
    centre = placed.groupBy("key").agg(F.min_by(F.struct("node", "component"), order).alias("c"))
    pairs = placed.join(centre, "key").where("component <> c.component")
    return pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def last_pairs(placed: DataFrame, wanted: DataFrame, sets: DataFrame, linker: Linker, tables: Scratch) -> DataFrame:
    """Pairs of one bucket in different groups: members outside the bucket's largest group with all
    members of other groups, as far as sketches and own shingles allow a link. A pair that shares
    several buckets comes from the first of them alone."""
    sized = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sized.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    open_sets = sets.join(placed.select("node").distinct(), "node")
    single = open_sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    own = single.where("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    sizes = open_sets.select("node", F.size("shingles").alias("size")).join(own, "node", "left")
    keys = placed.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    facts = sizes.join(wanted.select("node", "sketch"), "node").join(keys, "node").join(long_sketches(open_sets), "node")
    facts = tables.keep(facts.select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("common"), "sketch", "long_sketch", "keys"), "open-facts")
    rows = placed.join(main, "key").join(facts, "node")

    def side(name: str, rows: DataFrame) -> DataFrame:
        return rows.select("key", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "component", "main", "size", "common", "sketch", "long_sketch", "keys")])

    percent = linker.percent
    most = F.least("common_a", "common_b")
    possible = most * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b"))
    left, right = side("a", rows.where("component <> main")), side("b", rows)
    once = (F.col("node_a") < F.col("node_b")) | (F.col("component_b") == F.col("main_b"))
    first = F.element_at(F.array_intersect("keys_a", "keys_b"), 1) == left.key
    pairs = left.join(right, (left.key == right.key) & (F.col("component_a") != F.col("component_b")) & once & possible & first & linker.close() & linker.closer())
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
