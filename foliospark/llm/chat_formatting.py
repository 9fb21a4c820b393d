"""Chat formatting: preference pairs with a prompt rendered once and masked completions.

For each pair the longest common turn prefix of the chosen and the rejected
conversation becomes the prompt; what is left of each becomes a completion,
with a mask that trains on assistant text alone. DataFrame functions only.

Pairs are given, or made from plain conversations by ``borrowed_endings``.

Scale: one shuffle of the turns by pair. A group holds the two conversations
that the output row must hold anyway.

Defined cases: turns without a pair id are left out, as are pairs that lack a
side. Null roles and texts render as "". Turns order by turn (nulls first), role,
text; repeated rows stay. Identical conversations leave two empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import let


def _rendered(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit("<|"), t.role, F.lit("|>\n"), t.text, F.lit("<|end|>\n"))
    return F.array_join(F.transform(turns, one), "")


def _mask(turns: Column) -> Column:
    """Runs of "characters:trained" that cover the rendered turns."""
    one = lambda t: F.concat((F.length(t.role) + 5).cast("string"), F.lit(":0,"), F.length(t.text).cast("string"), F.when(t.role == "assistant", ":1,8:0").otherwise(":0,8:0"))
    return F.array_join(F.transform(turns, one), ",")


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that two arrays share in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))
    return F.aggregate(same, start, lambda acc, x: F.struct((acc.on & x).alias("on"), (acc.n + (acc.on & x).cast("int")).alias("n")), lambda acc: acc.n)


def _turn() -> Column:
    return F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "conv_id")


def _formatted(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen_conv, rejected_conv, and the turns of both sides as arrays c and r."""
    rest = lambda c, n: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    made = let(
        common_turns(F.col("c"), F.col("r")),
        lambda n: F.struct(
            n.cast("long").alias("n_common"), _rendered(F.slice(F.col("c"), F.lit(1), n)).alias("prompt"),
            _rendered(rest(F.col("c"), n)).alias("chosen"), _mask(rest(F.col("c"), n)).alias("chosen_mask"),
            _rendered(rest(F.col("r"), n)).alias("rejected"), _mask(rest(F.col("r"), n)).alias("rejected_mask"),
        ),
    )
    return pairs.select("pair_id", "chosen_conv", "rejected_conv", made.alias("m")).select("pair_id", "chosen_conv", "rejected_conv", "m.*")


def format_preferences(turns: DataFrame, pair_id: Column, chosen: Column) -> DataFrame:
    """turns: conv_id, turn, role, text. pair_id and chosen (boolean) say which pair and side a turn belongs to."""
    side = lambda on: F.sort_array(F.collect_list(F.when(F.col("_chosen") == on, F.col("_turn"))))
    pairs = (
        turns.select(pair_id.alias("pair_id"), chosen.alias("_chosen"), _turn().alias("_turn")).filter("pair_id is not null")
        .groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
        .filter((F.size("c") > 0) & (F.size("r") > 0))
    )
    first = lambda c: F.get(c, F.lit(0)).conv_id
    return _formatted(pairs.select("pair_id", first("c").alias("chosen_conv"), first("r").alias("rejected_conv"), "c", "r"))


def borrowed_endings(turns: DataFrame, donor: Column) -> DataFrame:
    """Preferences from plain conversations: the rejected side is the conversation with its last assistant turn said as the donor's last one was.

    donor: from conv_id, the conversation that a conversation borrows from. Conversations without an assistant turn, and those whose donor is missing or has
    none, make no pair. The last turn is that of the greatest turn, then text; if it is repeated, all of it is replaced. Both sides share one array, so texts are shuffled once;
    of donors only the last assistant turns move.
    """
    last = F.max(F.when(F.col("role") == "assistant", F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    own = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(_turn())).alias("c"), last.alias("last"))
    lenders = turns.filter("conv_id is not null").groupBy(F.col("conv_id").alias("rejected_conv")).agg(last.alias("lent")).filter("lent is not null")
    pairs = own.filter("last is not null").withColumn("rejected_conv", donor).join(lenders, "rejected_conv")
    is_last = lambda t: (t.role == "assistant") & t.turn.eqNullSafe(F.col("last.turn")) & (t.text == F.col("last.text"))
    said = F.transform("c", lambda t: F.struct(t.turn.alias("turn"), t.role.alias("role"), F.when(is_last(t), F.col("lent.text")).otherwise(t.text).alias("text"), t.conv_id.alias("conv_id")))
    return _formatted(pairs.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_conv"), "rejected_conv", "c", said.alias("r")))
