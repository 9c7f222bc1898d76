"""Preference formatting of chat conversations.

A chosen and a rejected conversation share a prompt: their longest common prefix of turns, equal in role and
text. It is rendered once; what follows in each is its completion, with a mask of 1 for the characters that the
assistant wrote and 0 for the template and other roles. Only DataFrame functions; a pair's turns are one row.

Null roles and texts count as empty. Turns are in the order of their number, equal numbers by role and text.
Where one conversation is a prefix of the other, its completion is empty. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
TURN = "array<struct<role:string,text:string>>"
RESULT = ("prefix_turns", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask")


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns) with the turns in order."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def stale_answers(convs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): against each conversation with an assistant's turn, itself with that last turn
    answered by its assistant's turn before, or by nothing where there is none; later turns are left out of both."""
    last = F.aggregate(F.sequence(F.lit(1), F.size("turns")), F.lit(0), lambda a, i: F.when(F.element_at("turns", i).role == "assistant", i).otherwise(a))
    before = F.filter(F.slice("turns", 1, F.col("last") - 1), lambda t: t.role == "assistant")
    stale = F.coalesce(F.try_element_at(before, F.lit(-1)).text, F.lit(""))
    return (
        convs.withColumn("last", last)
        .filter("last > 0")
        .select(F.col("conv_id").alias("pair_id"), F.slice("turns", 1, F.col("last")).alias("chosen"), F.concat(F.slice("turns", 1, F.col("last") - 1), F.array(F.struct(F.lit("assistant").alias("role"), stale.alias("text")))).alias("rejected"))
    )


def _render(turns):
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.format_string(OPEN.replace("{}", "%s"), t.role), t.text, F.lit(CLOSE))))


def _mask(turns):
    """Runs of characters as (length, bit), in order: template, text, template of each turn."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                F.struct((F.length(t.role) + len(OPEN.format(""))).alias("length"), F.lit(0).alias("bit")),
                F.struct(F.length(t.text).alias("length"), (t.role == "assistant").cast("int").alias("bit")),
                F.struct(F.lit(len(CLOSE)).alias("length"), F.lit(0).alias("bit")),
            ),
        )
    )


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Every pair's columns other than the two conversations, and prefix_turns, prompt, chosen_completion,
    chosen_mask, rejected_completion, rejected_mask. A null conversation counts as one without turns. Columns
    of pairs that bear a result's name give way to it."""
    kept = [c for c in pairs.columns if c not in (chosen, rejected, *RESULT)]
    at_a, at_b, turns = unused(pairs.columns, "_a", "_b", "_turns")
    a, b = (F.coalesce(F.col(c), F.array().cast(TURN)) for c in (chosen, rejected))
    common = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.size(at_a), F.size(at_b)), F.lit(1))),
        F.struct(F.lit(True).alias("same"), F.lit(0).alias("n")),
        lambda s, i: F.struct(
            (s.same & F.coalesce(F.try_element_at(at_a, i) == F.try_element_at(at_b, i), F.lit(False))).alias("same"),
            F.when(s.same & F.coalesce(F.try_element_at(at_a, i) == F.try_element_at(at_b, i), F.lit(False)), i).otherwise(s.n).alias("n"),
        ),
        lambda s: s.n,
    )
    rest = lambda c: F.slice(c, F.col(turns) + 1, F.size(c))
    out = pairs.withColumns({at_a: a, at_b: b}).withColumn(turns, F.when((F.size(at_a) > 0) & (F.size(at_b) > 0), common).otherwise(0))
    return out.select(
        *kept,
        F.col(turns).alias("prefix_turns"),
        _render(F.slice(at_a, F.lit(1), F.col(turns))).alias("prompt"),
        *(x for name, c in (("chosen", at_a), ("rejected", at_b)) for x in (_render(rest(c)).alias(f"{name}_completion"), _mask(rest(c)).alias(f"{name}_mask"))),
    )
