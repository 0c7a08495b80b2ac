"""Chat formatting in budgeted windows, with SQL functions only.

A conversation is its rows in the order of ``turn`` (then role and text). A turn becomes

    <s>[role] text </s>        without the blanks

where, inside role and text, the three characters that build marks or escapes are written as ``\\b``
(backslash), ``\\l`` (<) and ``\\i`` ([). So marks can't occur inside texts, and the text can be read
back whatever it holds.

Windows: prefix sums of turn tokens cut a conversation at multiples of the room for new turns. Turns
that lie between two cuts form a span, a turn that a cut crosses forms one by itself, so spans are
turn-aligned and, but for a single turn that is longer, within the room. A window is the leading
system turn of the conversation (again, if it isn't in the span), up to ``history`` turns before the
span as far as they fit into their own budget (again), and the span. The loss mask covers assistant
texts of the span only: repeated turns are no targets.

``budget`` tokens hold all of it, counting words and marks: a quarter at most is for history, and the
system turn is taken off first. Sums and orders are windows over one conversation; texts of more than
one window are never put together, but for the digest of a conversation, which is of all its text.

Results for odd input: null role or text are empty; a null ``turn`` comes first, a null ``conv_id`` is
a conversation of its own; repeated rows are turns each; a turn longer than the budget has a window of
its own, whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

START, MIDDLE, END = "<s>[", "]", "</s>"
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]"


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\i")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in (("[", "\\i"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def opening(role: Column) -> Column:
    # a closing bracket inside a role would end it, so it is written as an escape too
    return F.concat(F.lit(START), F.replace(escaped(role), F.lit("]"), F.lit("\\r")), F.lit(MIDDLE))


def read_role(text: Column) -> Column:
    return unescaped(F.replace(text, F.lit("\\r"), F.lit("]")))


def turns(conversations: DataFrame) -> DataFrame:
    """Rows in order, with their escaped parts, tokens and the number of each in its conversation."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    tokens = F.regexp_count("text", F.lit(TOKEN)).cast("long") + 4
    return rows.withColumn("tokens", tokens).withColumn("k", F.row_number().over(order).cast("long"))


def windows(conversations: DataFrame, budget: int = 512, history: int = 2) -> DataFrame:
    """One row per window: conv_id, span, formatted, repeated (turns at its start that were given
    before) and mask (start and length in code points of each target in ``formatted``)."""
    conversation = W.partitionBy("conv_id").orderBy("k")
    rows = turns(conversations)
    is_system = F.when((F.col("k") == 1) & (F.col("role") == "system"), F.struct("role", "text", "tokens"))
    rows = rows.withColumn("system", F.first(is_system).over(conversation.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("upto", F.sum("tokens").over(conversation.rowsBetween(W.unboundedPreceding, W.currentRow)))
    past = budget // 4
    room = F.greatest(F.lit(budget - past) - F.coalesce("system.tokens", F.lit(0)), F.lit(1))
    last = F.floor((F.col("upto") - 1) / room)
    first = F.floor((F.col("upto") - F.col("tokens")) / room)
    rows = rows.withColumn("span", F.when(first == last, 2 * last).otherwise(2 * last - 1).cast("long"))
    for back in range(1, history + 1):
        rows = rows.withColumn(f"back{back}", F.lag(F.struct("role", "text", "tokens", "k"), back).over(conversation))
    span = W.partitionBy("conv_id", "span").orderBy("k")
    rows = rows.withColumn("place", F.row_number().over(span))

    def shown(turn: str) -> Column:
        return F.concat(opening(F.col(f"{turn}.role")), escaped(F.col(f"{turn}.text")), F.lit(END))

    again = [F.when(F.col("system").isNotNull() & (F.col("k") > 1), shown("system"))]
    spent = F.lit(0).cast("long")
    fits = F.lit(True)
    older: list[Column] = []
    for back in range(1, history + 1):
        turn = F.col(f"back{back}")
        spent = spent + F.coalesce(turn["tokens"], F.lit(0))
        fits = fits & turn.isNotNull() & (spent <= past) & ~(F.col("system").isNotNull() & (turn["k"] == 1))
        older.insert(0, F.when(fits, shown(f"back{back}")))
    before = F.array_compact(F.array(*again, *older))
    before = F.when(F.col("place") == 1, before).otherwise(F.array().cast("array<string>"))
    head = opening(F.col("role"))
    own = F.struct(
        F.col("place"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("target"), before.alias("before")
    )
    grouped = rows.select("conv_id", "span", own.alias("own")).groupBy("conv_id", "span").agg(F.sort_array(F.collect_list("own")).alias("turns"))
    lead = F.col("turns")[0]["before"]
    parts = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    zero = F.struct(F.length(F.array_join(lead, "")).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def step(state: Column, t: Column) -> Column:
        start, size = state["at"] + F.length(t["head"]), F.length(t["body"])
        target = F.when(t["target"], F.array(F.struct(start.alias("start"), size.alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((start + size + len(END)).alias("at"), F.concat(state["mask"], target).alias("mask"))

    return grouped.select(
        "conv_id", "span", F.concat(F.array_join(lead, ""), F.array_join(parts, "")).alias("formatted"),
        F.size(lead).alias("repeated"), F.aggregate("turns", zero, step, lambda s: s["mask"]).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (conv_id, span, place, role, text) that the windows gave first, from their text alone."""
    pieces = F.split(F.regexp_replace("formatted", "</s>$", ""), F.lit("</s>"))
    rows = formatted.select("conv_id", "span", "repeated", F.posexplode(pieces).alias("place", "piece")).where("place >= repeated")
    role = read_role(F.substring_index(F.expr("substring(piece, 5)"), "]", 1))
    text = unescaped(F.expr("substring(piece, 6 + length(substring_index(substring(piece, 5), ']', 1)))"))
    return rows.select("conv_id", "span", "place", role.alias("role"), text.alias("text"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows say, read back from ``formatted`` and ``mask``, per conversation."""
    pieces = F.split(F.expr("substring(formatted, 1, length(formatted) - 4)"), F.lit("</s>"))
    fresh = F.filter(F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: x["i"] >= F.col("repeated"))

    def said(x: Column) -> Column:
        after = F.substring(x["p"], F.lit(len(START) + 1), F.length(x["p"]))
        role = F.substring_index(after, MIDDLE, 1)
        text = F.substring(after, F.length(role) + 2, F.length(after))
        return F.concat(read_role(role), F.lit("\n"), unescaped(text), F.lit("\n"))

    spoken = F.array_join(F.transform(fresh, said), "")
    learned = F.array_join(F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    rows = formatted.select(
        "conv_id", F.struct("span", spoken.alias("said"), learned.alias("learned")).alias("own"), F.size(fresh).alias("n"), F.length("formatted").alias("chars")
    )
    whole = rows.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.sort_array(F.collect_list("own")).alias("own"))
    loss = F.array_join(F.col("own.learned"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("own.said"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
