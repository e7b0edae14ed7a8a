"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into windows that begin and end with whole turns. Each
window opens with the conversation's system turn and repeats a limited history of the turns before
it; repeated turns are outside the loss mask, so every assistant turn is learnt exactly once.

Conversations are gathered in stretches: runs of turns of a bounded number of tokens, with the
history that leads into them. Nearly all conversations are one stretch, found in one shuffle. Only
those of more tokens than a stretch get their prefix sums over many tasks first, so a conversation
with a third of all rows is no task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import running_totals
from millrace.plans.staging import stage

BUDGET = 1024
HISTORY = 256
# Tokens of a stretch, as a multiple of the budget.
STRETCH = 16
# The template. The control strings open a turn, end its role and end the turn.
OPEN, MIDDLE, CLOSE = "<turn>", "</role>", "</turn>"
CONTROL = r"<(/?)(turn|role)"
LEARNT_ROLE, SYSTEM_ROLE = "assistant", "system"
# Tokens that the template adds to a turn.
MARK_TOKENS = 6


def escaped(text: Column) -> Column:
    r"""``\`` doubled, and ``\`` put into whatever begins like a control string: no control string is left."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"<$1\\$2")


def unescaped(text: Column) -> Column:
    r"""The inverse of :func:`escaped`: every ``\`` goes and lets the character after it stand."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """An estimate of a text's tokens: a quarter of its UTF-8 bytes, rounded up. As it follows bytes, a
    budget of tokens also bounds memory."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, role, bytes, hash, text, tokens``; ``conv`` is a struct, so that null is a conversation too."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = df.select(F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    tokens = turn_tokens(F.col("text")) + turn_tokens(F.col("role")) + F.lit(MARK_TOKENS)
    return named.select("conv", "turn", "role", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash"), "text", tokens.alias("tokens"))


ORDER = ["turn", "role", "bytes", "hash"]


def _short_stretches(turns: DataFrame) -> DataFrame:
    """Whole conversations, with the prefix sums of their arrays."""
    rows = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*ORDER, "text", "tokens"))).alias("sorted"))
    upto = F.aggregate(
        "sorted", F.array().cast("array<bigint>"),
        lambda sums, x: F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + x["tokens"])),
    )
    own = F.lit(0).cast("long")
    entry = lambda x: F.struct((x["upto"] - x["sorted"]["tokens"]).alias("before"), own.alias("own"), *[x["sorted"][c].alias(c) for c in ("role", "text", "tokens")])
    return rows.withColumn("upto", upto).select(
        "conv", own.alias("stretch"), F.transform(F.arrays_zip("sorted", "upto"), entry).alias("entries"), F.element_at("upto", -1).alias("all")
    )


def _long_stretches(turns: DataFrame, stretch: int, history: int) -> DataFrame:
    """Parts of long conversations: prefix sums over many tasks, then each turn in its stretch, in the
    next one if it can be history there, and a system turn in all."""
    rows = stage(turns.withColumn("row", F.monotonically_increasing_id()), "chat-turns")
    order = [F.col(c) for c in [*ORDER, "row"]]
    summed = running_totals(rows.drop("text"), order, ["tokens"], ["conv"])
    placed = summed.select("row", (F.col("tokens_upto") - F.col("tokens")).alias("before"), F.col("tokens_all").alias("all"))
    own = F.floor(F.col("before") / stretch)
    is_system = (F.col("before") == 0) & (F.col("role") == SYSTEM_ROLE)
    until = F.when(is_system, F.floor((F.col("all") - 1) / stretch)).otherwise(F.least(own + 1, F.floor((F.col("before") + history) / stretch)))
    # Numbers in two steps: no array is as long as a long conversation.
    copies = rows.join(placed, "row").withColumns({"own": own, "until": until})
    copies = copies.withColumn("block", F.explode(F.sequence(F.floor(F.col("own") / 1024), F.floor(F.col("until") / 1024))))
    within = F.sequence(F.greatest(F.col("own"), F.col("block") * 1024), F.least(F.col("until"), F.col("block") * 1024 + 1023))
    copies = copies.withColumn("stretch", F.explode(within))
    entries = F.sort_array(F.collect_list(F.struct("before", "own", "role", "text", "tokens")))
    return copies.groupBy("conv", "stretch").agg(entries.alias("entries"), F.max("all").alias("all"))


def _windows(stretches: DataFrame, budget: int, history: int) -> DataFrame:
    """``conv, window, n_repeated, turns``: each stretch's windows, filled turn by turn up to the budget."""
    system = F.filter("entries", lambda x: (x["before"] == 0) & (x["role"] == SYSTEM_ROLE))
    others = F.filter("entries", lambda x: (x["before"] > 0) | (x["role"] != SYSTEM_ROLE))
    parts = stretches.select("conv", "stretch", "all", system.alias("system"), others.alias("others"))
    parts = parts.withColumn("opening", F.coalesce(F.try_element_at("system", F.lit(1))["tokens"], F.lit(0)))
    parts = parts.withColumn("room", F.greatest(F.lit(budget) - F.col("opening"), F.lit(budget // 4)).cast("long")).withColumn("reach", F.least(F.lit(history), F.floor(F.col("room") / 2)).cast("long"))

    def repeated(start: Column) -> Column:
        """Tokens of the history that a window beginning at ``start`` repeats."""
        before = F.filter("others", lambda y: (y["before"] < start) & (y["before"] >= start - F.col("reach")))
        return start - F.coalesce(F.try_element_at(before, F.lit(1))["before"], start)

    nothing = F.struct(F.array().cast("array<bigint>").alias("starts"), F.lit(-1).cast("long").alias("limit"))
    starts = F.aggregate(
        F.filter("others", lambda x: x["own"] == F.col("stretch")), nothing,
        lambda got, x: F.when(
            x["before"] + x["tokens"] > got["limit"],
            F.struct(F.concat(got["starts"], F.array(x["before"])).alias("starts"), (x["before"] + F.col("room") - repeated(x["before"])).alias("limit")),
        ).otherwise(got),
        lambda got: got["starts"],
    )
    # A system turn alone is a window; a stretch without a turn of its own has none.
    alone = F.when((F.col("stretch") == 0) & (F.col("opening") == F.col("all")), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    begun = parts.withColumn("starts", starts).withColumn("starts", F.when(F.size("starts") > 0, F.col("starts")).otherwise(alone))
    rows = begun.select("*", F.posexplode("starts").alias("number", "start"))
    after = F.coalesce(F.try_element_at("starts", F.col("number") + 2), F.lit((1 << 63) - 1))
    shown = F.filter("others", lambda x: (x["before"] >= F.col("start") - F.col("reach")) & (x["before"] < after))
    again = F.when(F.col("start") <= F.col("opening"), 0).otherwise(F.size("system")) + F.size(F.filter("others", lambda x: (x["before"] >= F.col("start") - F.col("reach")) & (x["before"] < F.col("start"))))
    # A stretch has fewer windows than tokens, so the numbers grow with the conversation.
    window = F.col("stretch") * (1 << 20) + F.col("number")
    return rows.select("conv", window.alias("window"), again.cast("int").alias("n_repeated"), F.concat("system", shown).alias("turns"))


def format_windows(
    df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    r"""``conv_id, window, n_turns, n_repeated, tokens, text, loss`` for each window of each conversation.

    ``text`` is the window's formatted turns, ``<turn>role</role>text</turn>`` each, with whatever
    looks like these marks escaped by ``\`` (see :func:`unescaped`). Its first ``n_repeated`` turns
    were shown before; ``loss`` lists the code points ``start`` to ``end`` of the assistant texts that
    are shown for the first time. ``window`` numbers rise within a conversation.

    Turns go into the current window while system turn, history and new turns stay within ``budget``
    tokens, as :func:`turn_tokens` counts them; a turn that is too long is a window's only new one,
    whole. The history is the longest run of whole turns of at most ``history`` tokens, and of half of
    what the system turn leaves; a system turn of over three quarters of the budget is kept whole, beyond it.
    A first turn of role ``system`` is the system turn; later ones are turns like others.

    Null texts and roles count as empty; a null id is a conversation of its own. Turns are ordered by
    number, null first, then by role and text, and repeated rows are turns of their own. An empty
    table gives no rows; other columns are ignored. No row holds more than a stretch of ``STRETCH``
    budgets, its system turn and the last turn that begins in it.
    """
    turns = _turns(df, conv_col, turn_col, role_col, text_col)
    stretch = STRETCH * budget
    history = min(history, budget)
    sizes = turns.groupBy("conv").agg(F.sum("tokens").alias("all")).filter(F.col("all") > stretch)
    long = stage(sizes.select(F.col("conv").alias("long_conv")), "chat-long")
    is_long = F.col("conv") == F.col("long_conv")
    short_ones = _short_stretches(turns.join(long, is_long, "left_anti"))
    long_ones = _long_stretches(turns.join(long, is_long, "left_semi"), stretch, history)
    windows = _windows(short_ones.unionByName(long_ones), budget, history)

    written = lambda x: F.struct(
        F.concat(F.lit(OPEN), escaped(x["role"]), F.lit(MIDDLE)).alias("head"), escaped(x["text"]).alias("body"), (x["role"] == LEARNT_ROLE).alias("learnt")
    )
    pieces = windows.select(
        F.col("conv.id").alias("conv_id"), "window", F.size("turns").alias("n_turns"), "n_repeated",
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("tokens"), F.transform("turns", written).alias("pieces"),
    )
    spans = F.aggregate(
        F.transform("pieces", lambda x, i: F.struct(x["head"].alias("head"), x["body"].alias("body"), (x["learnt"] & (i >= F.col("n_repeated"))).alias("learnt"))),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda got, x: F.struct(
            (got["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).alias("at"),
            F.when(x["learnt"], F.concat(got["spans"], F.array(F.struct(
                (got["at"] + F.length(x["head"])).alias("start"), (got["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"),
            )))).otherwise(got["spans"]).alias("spans"),
        ),
        lambda got: got["spans"],
    )
    text = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return pieces.select("conv_id", "window", "n_turns", "n_repeated", "tokens", text.alias("text"), spans.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id, window, turns, learnt, chars``: the turns (role, text) that a window shows for the first
    time and the texts under its loss mask, from ``text``, ``n_repeated`` and ``loss`` alone."""
    shown = F.slice(F.split("text", OPEN), F.col("n_repeated") + 2, F.greatest(F.size(F.split("text", OPEN)), F.lit(1)))
    turn = lambda x: F.struct(
        unescaped(F.substring_index(x, MIDDLE, 1)).alias("role"), unescaped(F.substring_index(F.substring_index(x, MIDDLE, -1), CLOSE, 1)).alias("text")
    )
    learnt = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.select("conv_id", "window", F.transform(shown, turn).alias("turns"), learnt.alias("learnt"), F.length("text").cast("long").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation: what :func:`read_back` finds, as counts and SHA-256 digests.

    A digest of a whole conversation needs it in one value, which is the size of the conversation;
    formatting does not.
    """
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = read_back(windows).select("conv_id", "chars", F.struct("window", said.alias("said"), F.array_join("learnt", "").alias("learnt"), F.size("turns").alias("n")).alias("part"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.col(f"parts.{c}"), "")
    return whole.select(
        "conv_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("learnt")).cast("long").alias("loss_chars"), F.sha2(joined("learnt"), 256).alias("loss_sha256"), "formatted_chars",
    )
