"""Quality rules: counts of a text, and the perplexity of its words under an n-gram model of its language.

The model is of order two with modified Kneser-Ney discounts, counted by Spark over all documents of a language
(lower-cased A-Z, an end after each text). Every word and every pair counts, however rare (``whole_models``).

With a ``share``, which the query does not have, words with at least that share of all tokens of the corpus are the
vocabulary, all others one unknown word, whose probability they share evenly; pairs with at least that share keep a value of their own, and the
mass of the others goes to the shorter context. Discounts and totals come from the counts of all pairs.
As shares add up to one, such a model of any corpus has at most 1 / share words and pairs over all languages: that
bound lets it travel to every task as sorted arrays of word hashes and of pair keys, searched by halving.

A document fails if it breaks a base rule, or if its perplexity lies outside its language's bands by more than
``ERRORS`` standard errors of its own mean, as few words vary more. Bands come from the quartiles of the language's
documents that pass the base rules, ``WIDE`` times their distance up and down; quartiles are exact over steps
of 0.01. The upper band is on the whole model. The lower one is on its shorter context, where a word counts by
the number of different words before it: copies make their own pairs frequent, but give no word new neighbours, so
a text is not rejected for having been copied.

Results for odd input: a null text has no words, and a text without words fails the base rules; rows
without a language are a language of their own; a language without words has no model, nor has one with a ``share``
that none of its words reaches, unless ``every_language`` is set, so its documents are held to the base rules alone; repeated rows count as often as they come; a
null ``doc_id`` is kept as such; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import texts, whole_models
from .scratch import Scratch
from .whole_models import MEANS, discounts, means

SHARE = 0.0  # nothing is left out
WIDE = 3.0
ERRORS = 3.0
STEPS = 100  # per unit of log10 perplexity
MIN_WORDS, MAX_REPEATED = 50, 50
UNKNOWN, END, START, FIRST = 0, 1, 2, 3  # ids; words follow
BITS = 21
HELD_KEYS = 2_000_000
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
BLANKS = " \t\n\x0b\x0c\r"


class Tally:
    """Counts of keys by language, merged whenever many are held."""

    def __init__(self):
        self.parts: dict[object, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, language: object, keys: np.ndarray) -> None:
        found = np.unique(keys, return_counts=True)
        self.parts.setdefault(language, []).append(found)
        self.held += len(found[0])

    def full(self) -> bool:
        """Whether the keys held fill their room even after they are merged."""
        if self.held < HELD_KEYS:
            return False
        self.merge()
        return self.held >= HELD_KEYS // 2

    def merge(self) -> None:
        self.held = 0
        for language, parts in self.parts.items():
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)
            self.parts[language] = [(keys, total)]
            self.held += len(keys)

    def rows(self, names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        self.merge()
        for language, [(keys, total)] in self.parts.items():
            for k in range(0, len(keys), 65536):
                own = keys[k : k + 65536].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(own), kind), pa.array(own), pa.array(total[k : k + 65536])], names)
        self.parts, self.held = {}, 0


class Languages:
    """The documents of a slice by language: words as hashes, one text after another, and texts' sizes."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = texts.Words(batch.column("text"), lower=True)
        self.hashes = self.words.hashes()
        coded = batch.column("lang").dictionary_encode()
        names = coded.dictionary.to_pylist()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.of = [(None if c < 0 else names[c], np.flatnonzero(code == c)) for c in np.unique(code).tolist()]

    def __iter__(self) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
        counts = self.words.counts()
        for language, rows in self.of:
            yield language, rows, self.hashes[texts.ranges(self.words.first[:-1][rows], counts[rows])], counts[rows]


def tokens(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (a hash), n; the end of a text is not a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for whole in batches:
            for batch in texts.slices(whole):
                for language, _, hashes, _ in Languages(batch):
                    tally.add(language, hashes.astype(np.int64))
                if tally.full():
                    yield from tally.rows(["lang", "word", "n"], pa.string())
        yield from tally.rows(["lang", "word", "n"], pa.string())

    return tokens(docs).mapInArrow(run, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ids of frequent words: sorted hashes of each language that has any."""

    def __init__(self, rows: pa.Table):
        self.languages: dict[object, int] = {}
        self.hashes: list[np.ndarray] = []
        for language in sorted(set(rows.column("lang").to_pylist()), key=lambda x: (x is not None, x)):
            own = rows.filter(pa.compute.is_null(rows.column("lang")) if language is None else pa.compute.equal(rows.column("lang"), language))
            self.languages[language] = len(self.hashes)
            self.hashes.append(np.sort(own.column("word").to_numpy()))

    def ids(self, language: int, hashes: np.ndarray) -> np.ndarray:
        known = self.hashes[language]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at + FIRST, UNKNOWN)

    def pairs(self, language: int, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the word pairs of texts, from the start to the end of each, and the text of each pair."""
        size = counts + 2
        first = np.cumsum(size) - size
        ids = np.full(int(size.sum()), END, dtype=np.int64)
        ids[first] = START
        ids[texts.ranges(first + 1, counts)] = self.ids(language, hashes)
        inside = texts.ranges(first, counts + 1)
        return ids[inside] << BITS | ids[inside + 1], np.repeat(np.arange(len(counts)), counts + 1)


def pair_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """language (a number), pair (a key), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for whole in batches:
            for batch in texts.slices(whole):
                for language, _, hashes, counts in Languages(batch):
                    if language in vocabulary.languages:
                        number = vocabulary.languages[language]
                        tally.add(number, vocabulary.pairs(number, hashes.astype(np.int64), counts)[0])
                if tally.full():
                    yield from tally.rows(["language", "pair", "n"], pa.int32())
        yield from tally.rows(["language", "pair", "n"], pa.int32())

    return tokens(docs).mapInArrow(run, "language int, pair long, n long").groupBy("language", "pair").agg(F.sum("n").alias("n"))


class Model:
    """Values of one language: sorted pair keys with what they add, weights of contexts, values of single words."""

    def __init__(self, words: int, singles: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], kept: tuple[np.ndarray, np.ndarray], n: list[int], unknown: int):
        self.share = np.log10(max(unknown, 1))
        size = words + FIRST
        before = np.zeros(size, dtype=np.int64)  # different words before each
        before[singles[0]] = singles[1]
        lost = discounts([int((before == k).sum()) for k in (1, 2, 3, 4)])[np.minimum(before, 3)]
        total = max(int(before.sum()), 1)
        # all that single words lose goes evenly to the words, the unknown one and the end
        self.single = (np.maximum(before - lost, 0) + np.minimum(lost, before).sum() / (words + 2)) / total
        whole = np.ones(size, dtype=np.int64)
        whole[contexts[0]] = contexts[1]
        order = np.argsort(kept[0])
        self.keys, counts = kept[0][order], kept[1][order]
        added = np.maximum(counts - discounts(n)[np.minimum(counts, 3)], 0)
        context = self.keys >> BITS
        self.value = added / whole[context]
        self.rest = 1 - np.bincount(context, weights=added, minlength=size) / whole

    def logs(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each pair's second word after its first, and by itself."""
        value = np.zeros(len(pairs))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            value = np.where(self.keys[at] == pairs, self.value[at], 0.0)
        word = pairs & ((1 << BITS) - 1)
        alone, less = self.single[word], np.where(word == UNKNOWN, self.share, 0.0)
        return np.log10(np.maximum(value + self.rest[pairs >> BITS] * alone, 1e-30)) - less, np.log10(np.maximum(alone, 1e-30)) - less


def models(counts: DataFrame, words: DataFrame, vocabulary: Vocabulary, least: float) -> list[Model]:
    """What reaches the driver are totals of frequent words and frequent pairs: at most 1 / share of each."""
    word = F.col("pair").bitwiseAND((1 << BITS) - 1).cast("int")
    singles = counts.groupBy("language", word.alias("word")).agg(F.count("*").alias("n")).toArrow()
    contexts = counts.groupBy("language", F.shiftright("pair", BITS).cast("int").alias("word")).agg(F.sum("n").alias("n")).toArrow()
    kept = counts.where(F.col("n") >= least).select("language", "pair", "n").toArrow()
    few = {r.language: list(r)[1:] for r in counts.groupBy("language").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()}

    own = words.groupBy("lang").agg(F.count_if(F.col("n") >= least).alias("known"), F.count("*").alias("n")).where("known > 0")
    unknown = {vocabulary.languages[r.lang]: r.n - r.known for r in own.collect()}

    def of(table: pa.Table, column: str, number: int) -> tuple[np.ndarray, np.ndarray]:
        own = table.filter(pa.compute.equal(table.column("language"), number))
        return own.column(column).to_numpy(), own.column("n").to_numpy()

    return [Model(len(h), of(singles, "word", k), of(contexts, "word", k), of(kept, "pair", k), few.get(k, [0] * 4), unknown[k]) for k, h in enumerate(vocabulary.hashes)]


def base_counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """n_words and the four counts of the base rules of every text."""
    words = texts.Words(batch.column("text"), lower=False)
    n = words.counts()
    sizes = pa.compute.binary_length(batch.column("text").cast(pa.large_binary()).fill_null(b"")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)

    def per_text(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks)))
        return total[ends] - total[ends - sizes]

    begins = (words.data & 0xC0) != 0x80
    blank = (words.data == 32) | ((words.data >= 9) & (words.data <= 13))
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in batch.column("text").fill_null("").to_pylist()]
    text = np.repeat(np.arange(len(n)), n)
    runs = texts.run_hashes(words.hashes(), 3)
    at = np.flatnonzero(text[2:] == text[:-2]) if len(runs) else np.zeros(0, np.int64)
    order = at[np.lexsort((runs[at], text[at]))] if len(at) else at
    same = (runs[order][1:] == runs[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    covered = np.zeros(len(text), dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    return {
        "n_words": n,
        "word_chars": per_text(begins & ~blank),
        "n_symbols": per_text(SYMBOLS[words.data]),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": np.bincount(text[covered], minlength=len(n)),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, vocabulary: Vocabulary, known: list[Model]) -> DataFrame:
    """doc_id, language (null without a model), the counts, base_failed and mean logs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in texts.slices(whole):
                counts = base_counts(batch)
                number, found = np.full(batch.num_rows, -1), np.zeros((4, batch.num_rows))
                for language, rows, hashes, sizes in Languages(batch):
                    if language in vocabulary.languages:
                        number[rows] = vocabulary.languages[language]
                        pairs, text = vocabulary.pairs(int(number[rows[0]]), hashes.astype(np.int64), sizes)
                        pair, alone = known[number[rows[0]]].logs(pairs)
                        found[:, rows] = [*means(pair, text, len(rows)), *means(alone, text, len(rows))]
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"])
                columns = [batch.column("doc_id"), pa.array(number, pa.int32(), mask=number < 0), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS], pa.array(failed), *[pa.array(m, mask=number < 0) for m in found]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "language", *COUNTS, "base_failed", *MEANS])

    schema = "doc_id long, language int, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{c} double" for c in MEANS)
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema)


def bands(found: DataFrame, wide: float) -> DataFrame:
    """of (a language), upper bound of log_perplexity and lower bound of log_single."""

    def quartiles(column: str):
        return F.expr(f"percentile(cast(round({column} * {STEPS}) as long), array(0.25, 0.75))")

    sound = found.where(~F.col("base_failed") & F.col("language").isNotNull())
    both = sound.groupBy(F.col("language").alias("of")).agg(quartiles("log_perplexity").alias("p"), quartiles("log_single").alias("s"))
    reach = lambda q: wide * (q[1] - q[0]) + 1
    p, s = F.col("p"), F.col("s")
    return both.select("of", ((p[1] + reach(p)) / STEPS).alias("upper"), ((s[0] - reach(s)) / STEPS).alias("lower"))


def verdicts(found: DataFrame, wide: float, errors: float) -> DataFrame:
    """``found`` (as ``measured`` gives it) held against the bands of each language."""
    limits = bands(found, wide)
    low_enough = F.col("log_perplexity") - errors * F.col("error") <= F.col("upper")
    high_enough = F.col("log_single") + errors * F.col("error_single") >= F.col("lower")
    inside = F.coalesce(low_enough & high_enough, F.lit(True))
    out = found.join(limits, found.language == limits.of, "left")
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"))


def language_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """Language key, ids, counts and hashes of the words of the texts of a language, slice by slice."""
    for whole in batches:
        for batch in texts.slices(whole):
            found = base_counts(batch)
            counts = np.stack([found[c].astype(np.int64) for c in COUNTS])
            for language, rows, hashes, _ in Languages(batch):
                yield language or "", batch.column("doc_id").take(pa.array(rows)), counts[:, rows], hashes


def whole_verdicts(docs: DataFrame, tables: Scratch, wide: float, errors: float) -> DataFrame:
    """Verdicts on documents by models of all words and pairs of their languages."""
    rows = docs.select(F.col("doc_id").cast("long"), language_key().alias("lang"), F.col("text").cast("string"))
    found = whole_models.measured(rows, tables, by_language, COUNTS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return verdicts(found.withColumn("base_failed", failed), wide, errors)


def judge(docs: DataFrame, share: float = SHARE, wide: float = WIDE, errors: float = ERRORS, every_language: bool = False) -> DataFrame:
    """Documents (doc_id, text, lang) with their counts, verdict and perplexity. Without a ``share``, all words and
    pairs count. With one and ``every_language``, so they do in languages without a frequent word."""
    tables = Scratch(docs.sparkSession, "perplexity")
    if not share:
        return whole_verdicts(docs, tables, wide, errors)
    words = tables.keep(word_counts(docs), "words")
    total = (words.agg(F.sum("n")).first()[0] or 0) + docs.count()
    least = share * total
    rare = None
    if every_language:
        most = words.groupBy(language_key().alias("key")).agg(F.max("n").alias("most")).where(F.col("most") < least).select("key")
        most = tables.keep(most, "rare_languages")
        if not most.isEmpty():
            keyed = docs.select("doc_id", "text", "lang", language_key().alias("key"))
            rare = whole_verdicts(keyed.join(most, "key", "left_semi"), Scratch(docs.sparkSession, "perplexity"), wide, errors)
            docs = keyed.join(most, "key", "left_anti").drop("key")
    vocabulary = Vocabulary(words.where(F.col("n") >= least).select("lang", "word").toArrow())
    pairs = tables.keep(pair_counts(docs, vocabulary), "pairs")
    found = tables.keep(measured(docs, vocabulary, models(pairs, words, vocabulary, least)), "measured")
    tables.drop("words", "pairs")
    out = verdicts(found, wide, errors)
    return out if rare is None else out.unionByName(rare)
