"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A trigram of letters is the componentwise
product of its three letter vectors, rotated by two, one and no places (binding with position).
A text is the sum of the vectors of all its trigrams (bundling), and so is a language, over all its
learning texts. A text gets the language whose prototype has the largest cosine with it.

Letters are lower-cased; a to z have classes of their own, other letters share the rest by code
point; any run of other characters is one gap, and a text starts and ends with a gap. Learning
gathers trigram counts per language (at most ``CLASSES ** 3`` rows for each), so what moves between
executors is bounded by the number of languages, and a language that holds most rows is summed in
every task before it moves.

Results for odd input: a text that is null, empty or without letters is ``und`` with score 0; so is
every text if nothing was learned. Of equal cosines the first language in string order wins. Rows
with a null language teach nothing. Repeated rows count as often as they occur. Columns other than
those named are passed through, except those the result adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import texts

CLASSES = 40
DIMENSIONS = 512
UNKNOWN = "und"


def letter_classes() -> np.ndarray:
    """Class of each code point: 0 for no letter, 1 to 26 for a to z, else one of the rest."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        if (letter := chr(point)).isalpha():
            low = ord(letter.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 * (CLASSES - 27) // 2**32
    return table


def trigram_vectors(dimensions: int = DIMENSIONS, seed: int = 3) -> np.ndarray:
    """Bound vectors of all trigrams of classes, as int8."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(CLASSES, dimensions))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return (first[:, None, None] * second[None, :, None] * letters[None, None]).reshape(-1, dimensions)


def trigrams(batch: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and number of the trigram, for every trigram of the texts."""
    joined = "\n" + "\n\n".join(batch) + "\n"
    codes = table[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
    text = np.repeat(np.arange(len(batch)), np.fromiter((len(t) + 2 for t in batch), np.int64, len(batch)))
    edge = np.append(True, text[1:] != text[:-1])
    keep = (codes > 0) | np.append(True, codes[:-1] > 0) | edge
    codes, text = codes[keep].astype(np.int32), text[keep]
    inside = (text[2:] == text[:-2]) & (codes[1:-1] > 0) | (text[2:] == text[:-2]) & (codes[2:] > 0) & (codes[:-2] > 0)
    gram = (codes[:-2] * CLASSES + codes[1:-1]) * CLASSES + codes[2:]
    return text[:-2][inside], gram[inside]


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per language of ``docs`` (text, lang): lang and its prototype (array of doubles)."""
    classes = letter_classes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "gram", "n"])
            totals.clear()

        for whole in batches:
            for batch in texts.slices(whole):
                langs, owner = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
                text, gram = trigrams(batch.column("text").fill_null("").to_pylist(), classes)
                owner = owner[text]
                for k, lang in enumerate(langs):
                    if lang not in totals and len(totals) >= 64:
                        yield from out()
                    total = totals.setdefault(lang, np.zeros(CLASSES**3, dtype=np.int64))
                    total += np.bincount(gram[owner == k], minlength=CLASSES**3)
        yield from out()

    def bundle(key: tuple, rows: pa.Table) -> pa.Table:
        vectors = trigram_vectors(dimensions)
        counts = rows.column("n").to_numpy().astype(np.float64)
        total = np.zeros(dimensions)
        grams = rows.column("gram").to_numpy()
        for k in range(0, len(grams), 4096):
            total += counts[k : k + 4096] @ vectors[grams[k : k + 4096]]
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "prototype": pa.array([total], pa.list_(pa.float64()))})

    usable = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null")
    counts = usable.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return counts.groupBy("lang").applyInArrow(bundle, "lang string, prototype array<double>")


def predict(docs: DataFrame, prototypes: dict[str, list[float]], dimensions: int = DIMENSIONS, keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score. ``prototypes`` has one vector per language."""
    classes = letter_classes()
    known = sorted(k for k, v in prototypes.items() if any(v))
    profile = np.array([prototypes[k] for k in known], dtype=np.float64).reshape(len(known), dimensions)
    profile = (profile / np.linalg.norm(profile, axis=1, keepdims=True)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = trigram_vectors(dimensions)
        names = np.array([UNKNOWN, *known], dtype=object)
        for whole in batches:
            for batch in texts.slices(whole, limit=128 << 10):
                n = batch.num_rows
                text, gram = trigrams(batch.column("text").fill_null("").to_pylist(), classes)
                used, place = np.unique(gram, return_inverse=True) if len(gram) < 2000 else dense(gram)
                counts = np.bincount(text * len(used) + place, minlength=n * len(used)).reshape(n, len(used)).astype(np.float32)
                bundled = counts @ vectors[used].astype(np.float32)
                best, score = np.zeros(n, dtype=np.int64), np.zeros(n)
                if known and len(used):
                    length = np.sqrt(np.einsum("ij,ij->i", bundled, bundled, dtype=np.float64))
                    cosine = (bundled @ profile.T) / np.maximum(length, 1e-9)[:, None]
                    has = length > 0
                    best = np.where(has, 1 + cosine.argmax(axis=1), 0)
                    score = np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                kept = batch if keep_text else batch.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [*kept.schema.names, "lang_pred", "score"])

    plain = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if keep_text or f.name != "text") + ", lang_pred string, score double"
    return plain.mapInArrow(run, schema)


def dense(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with inverse, by a table over all trigrams."""
    seen = np.zeros(CLASSES**3, dtype=np.int64)
    seen[gram] = 1
    used = np.flatnonzero(seen)
    seen[used] = np.arange(len(used))
    return used, seen[gram]


def fit_predict(docs: DataFrame, training: DataFrame, keep_text: bool = True) -> DataFrame:
    """Learn from ``training`` (text, lang) and predict ``docs``. Prototypes, one short vector per
    language, are the only thing the driver holds."""
    found = {row.lang: list(row.prototype) for row in learn(training).collect()}
    return predict(docs, found, keep_text=keep_text)
