"""Mixing sources to target weights: a temperature on token shares, realised by block permutations.

A source with token share p gets the weight p ** a / sum(p ** a). The exponent a in [0, 1] is
bisected: it is the largest one at which the entropy of the weights reaches ``entropy_share`` of
the most there can be (the logarithm of the number of sources), but not so small that a source is
repeated more than ``max_repeats`` times. Weights times the token budget are quotas.

A source is cut into blocks of about ``block_tokens`` once, by a hash of its documents. Every epoch
has a permutation of these blocks of its own, drawn by source and epoch: a block's ``turn`` is a keyed
hash of its number, and blocks are read in the order of turn and number. Whole epochs come as far as
the quota goes. Of the last epoch come the first blocks of its permutation that fit, and of the next
block the documents in the order of a hash, as long as they fit. So a source misses its quota by
less than one document.

Only sums over sources reach the driver, never the sources. Block sums of a source are added up in
runs of about ``RUN_BLOCKS`` neighbours of the permutation; only the run in which the quota ends is
looked at block by block. A source that holds most rows is summed before anything moves.

Results for odd input: a null source is a source of its own; a null or empty text has no tokens and
comes with the first block prefix that reaches it; a source without tokens has weight 0 and its
documents come once; if ``max_repeats`` is below budget / tokens, no exponent can meet it and the
shares stay as they are; rows that share a ``doc_id`` and source come together; an empty table
gives no rows; columns other than those named pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from .scratch import Scratch

RUN_BLOCKS = 1 << 10
SECTIONS, SEARCHES = 32, 7
#: Plans of sources are sent to all executors up to this many (about 64 MB); beyond it they are joined by a shuffle.
SENT_SOURCES = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def exponent(sources: DataFrame, total: int, budget: float, entropy_share: float, max_repeats: float) -> tuple[float, float]:
    """The exponent and the sum of p ** exponent. Each search cuts the interval in ``SECTIONS`` parts,
    whose sums come from one aggregate."""
    share = F.col("tokens") / F.lit(float(total))
    positive = sources.where("tokens > 0")
    base = positive.agg(F.count("*"), F.min(share)).first()
    most, least = math.log(base[0]) if base[0] else 0.0, base[1] or 1.0

    def sums(points: list[float]) -> list[tuple[float, float]]:
        columns = []
        for a in points:
            power = F.pow(share, F.lit(a))
            columns += [F.sum(power), F.sum(power * F.log(share))]
        row = positive.agg(*columns).first()
        return [(row[2 * k] or 1.0, row[2 * k + 1] or 0.0) for k in range(len(points))]

    def flat_enough(a: float, z: float, zlog: float) -> bool:
        return math.log(z) - a * zlog / z >= entropy_share * most

    def repeated_little(a: float, z: float) -> bool:
        return budget / total * least ** (a - 1) / z <= max_repeats

    low, high = 0.0, 1.0
    z, zlog = sums([1.0])[0]
    if flat_enough(1.0, z, zlog):
        return 1.0, z
    for _ in range(SEARCHES):
        points = [low + (high - low) * k / SECTIONS for k in range(1, SECTIONS)]
        for a, (z, zlog) in zip(points, sums(points)):
            if flat_enough(a, z, zlog) or not repeated_little(a, z):
                low = a
            else:
                high = a
                break
    # At ``low`` the entropy holds or repeats are too many; at ``high`` repeats hold.
    (z_low, _), (z_high, _) = sums([low, high])
    return (low, z_low) if repeated_little(low, z_low) else (high, z_high)


def plan(slim: DataFrame, tables: Scratch, budget: int | None, entropy_share: float, max_repeats: float, block_tokens: int, seed: int) -> DataFrame:
    """One row per source: weight, epochs, blocks, the block at which the last epoch ends (``end_turn``,
    ``end_block``; null if no block is cut) and the hash up to which documents of that block come.
    ``slim`` has doc_id, source, n_tokens."""
    sources = tables.keep(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    wanted = float(total if budget is None else budget)
    a, z = exponent(sources, max(total, 1), wanted, entropy_share, max_repeats)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a)) / F.lit(z)).otherwise(0.0)
    quotas = sources.withColumn("weight", weight).withColumn("quota", (F.col("weight") * F.lit(wanted)).cast("long"))
    quotas = quotas.withColumns({
        "epochs": F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(0)).cast("int"),
        "blocks": F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("long"),
    }).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
    quotas = tables.keep(quotas, "quotas")

    ranked = join_plan(slim, quotas.select("source", "blocks", "epochs", "rest"), quotas.count())
    ranked = ranked.withColumn("block", block_number(seed))
    sizes = ranked.groupBy("source", "blocks", "epochs", "rest", "block").agg(F.sum("n_tokens").alias("n"))
    sizes = tables.keep(sizes.withColumn("turn", turn(F.col("epochs"), seed)).withColumn("run", run_number()), "blocks")
    runs = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, 0)
    ends = sizes.groupBy("source", "rest", "run").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(runs) - F.col("n"))
    ends = ends.where("before <= rest and before + n > rest").select("source", "run", "before")
    blocks = W.partitionBy("source").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, 0)
    inside = sizes.alias("s").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.run") == F.col("e.run")))
    inside = inside.select("s.source", "rest", "turn", "block", "n", "before").withColumn("before", F.col("before") + F.sum("n").over(blocks) - F.col("n"))
    inside = inside.where("before <= rest and before + n > rest")
    cuts = tables.keep(inside.select("source", F.col("turn").alias("end_turn"), F.col("block").alias("end_block"), (F.col("rest") - F.col("before")).alias("left")), "cuts")

    edge = join_plan(ranked.select("doc_id", "source", "n_tokens", "block"), cuts, cuts.count()).where("block = end_block").withColumn("place", place(seed))
    within = F.sum("n_tokens").over(W.partitionBy("source").orderBy("place"))
    upto = edge.withColumn("sum", within).where("sum <= left").groupBy("source").agg(F.max("place").alias("upto"))
    out = quotas.alias("q").join(cuts.alias("c"), F.col("q.source").eqNullSafe(F.col("c.source")), "left")
    out = out.join(upto.alias("u"), F.col("q.source").eqNullSafe(F.col("u.source")), "left")
    return tables.keep(out.select("q.source", "q.weight", "q.epochs", "q.blocks", "c.end_turn", "c.end_block", "u.upto"), "plan")


def join_plan(rows: DataFrame, small: DataFrame, count: int) -> DataFrame:
    """``rows`` with the columns of their source in ``small``."""
    right = small.withColumnRenamed("source", "plan_source")
    right = F.broadcast(right) if count <= SENT_SOURCES else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def block_number(seed: int):
    """The block of a document within its source, the same in every epoch."""
    return F.pmod(F.xxhash64("doc_id", "source", F.lit(seed)), F.col("blocks"))


def turn(epoch, seed: int):
    """What the permutation of an epoch orders the blocks of a source by."""
    return F.xxhash64("source", epoch.cast("int"), "block", F.lit(seed + 2))


def run_number():
    """Neighbours of the permutation in runs of about ``RUN_BLOCKS``: turns are cut evenly, in their order."""
    high = F.shiftrightunsigned(F.col("turn").bitwiseXOR(F.lit(-(2**63))), 33)
    return F.shiftrightunsigned(high * (1 + F.expr(f"blocks div {RUN_BLOCKS}")), 31)


def place(seed: int):
    return F.xxhash64("doc_id", F.lit(seed + 1))


def mix(docs: DataFrame, budget: int | None = None, entropy_share: float = 0.95, max_repeats: float = 4.0, block_tokens: int = 1 << 18, seed: int = 8) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, text and others) repeated or left out to meet the target
    weights, unchanged. ``budget`` is in words; None: as many as there are."""
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return realised(row, *planned(row, budget, entropy_share, max_repeats, block_tokens, seed), seed).select("row.*")


def order(docs: DataFrame, budget: int | None = None, entropy_share: float = 0.95, max_repeats: float = 4.0, block_tokens: int = 1 << 18, seed: int = 8) -> DataFrame:
    """The realised mixture without texts: doc_id, source, n_tokens, and epoch (from 0), block and turn of
    each row. Read in the order of epoch and turn, every source gives its blocks in an order of that epoch."""
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    slim, plans = planned(row, budget, entropy_share, max_repeats, block_tokens, seed)
    return realised(slim, slim, plans, seed).select("doc_id", "source", "n_tokens", "epoch", "block", "turn")


def planned(rows: DataFrame, budget: int | None, entropy_share: float, max_repeats: float, block_tokens: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents without texts, and the plan of each source."""
    tables = Scratch(rows.sparkSession, "mixing")
    slim = tables.keep(rows.select("doc_id", "source", word_count().alias("n_tokens")), "slim")
    return slim, plan(slim, tables, budget, entropy_share, max_repeats, block_tokens, seed)


def realised(rows: DataFrame, slim: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    met = join_plan(rows, plans.select("source", "epochs", "blocks", "end_turn", "end_block", "upto"), plans.count())
    met = met.withColumn("block", block_number(seed))
    own = turn(F.col("epochs"), seed)
    first = (own < F.col("end_turn")) | ((own == F.col("end_turn")) & (F.col("block") < F.col("end_block")))
    cut = (F.col("block") == F.col("end_block")) & F.coalesce(place(seed) <= F.col("upto"), F.lit(False))
    last = F.coalesce(first, F.lit(True)) | F.coalesce(cut, F.lit(False))
    met = met.withColumn("copies", F.col("epochs") + last.cast("int")).where("copies > 0")
    met = met.withColumn("epoch", F.explode(F.expr("sequence(0, copies - 1)")))
    return met.withColumn("turn", turn(F.col("epoch"), seed))
